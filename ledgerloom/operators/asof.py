"""What was known at many cutoffs at once, of facts that have to be known on two time axes.

Facts and cutoffs are sorted together by subject and time and dealt over tasks in
ranges, so that no task gets a subject as a whole. A range carries the last fact
along by itself; what the ranges before hold of a subject comes from one row a
subject and range.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.written import written


def known_from(*times: Column) -> Column:
    """When a fact is known on all of its axes: at the latest of its times, and never where one is not recorded."""
    every = times[0].isNotNull()
    for t in times[1:]:
        every = every & t.isNotNull()
    return F.when(every, F.greatest(*times) if len(times) > 1 else times[0])


def known_at(facts: DataFrame, cutoffs: DataFrame, subject: str, fact_time: str, fact_id: str, cutoff_time: str, cutoff_id: str, carried: Sequence[str] = ()) -> DataFrame:
    """(cutoff_id, subject, cutoff_time, n_known, fact_id, *carried) of every cutoff: how many facts of its subject were known by then, and the last of them, of equal times that with the largest id.

    Facts without a time are never known; at a cutoff without a time nothing is
    known. A null subject is a subject. Facts and cutoffs may repeat.
    """
    fact = F.struct(F.col(fact_id).alias("fact_id"), *carried)
    nothing = F.lit(None).cast(facts.select(fact.alias("x")).schema["x"].dataType)
    key_type = facts.schema[fact_id].dataType
    rows = facts.where(F.col(fact_time).isNotNull()).select(F.col(subject).alias("subject"), F.col(fact_time).alias("at"), F.lit(0).alias("side"), F.col(fact_id).alias("tie"), fact.alias("fact"), F.lit(None).cast(cutoffs.schema[cutoff_id].dataType).alias("cutoff"))
    rows = rows.unionByName(cutoffs.select(F.col(subject).alias("subject"), F.col(cutoff_time).alias("at"), F.lit(1).alias("side"), F.lit(None).cast(key_type).alias("tie"), nothing.alias("fact"), F.col(cutoff_id).alias("cutoff")))
    order = ["subject", "at", "side", "tie"]
    parts = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # cutoffs of one time are alike, and so is what they find, whichever comes first
    dealt = rows.repartitionByRange(parts, *order, "cutoff").sortWithinPartitions(*order)
    dealt = written(dealt.withColumns({"place": F.monotonically_increasing_id(), "part": F.spark_partition_id()}), "known")
    here = Window.partitionBy("part", "subject").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = dealt.withColumns({"n_here": F.count("fact").over(here), "last_here": F.last("fact", ignorenulls=True).over(here)}).where("side = 1")
    sums = dealt.where("side = 0").groupBy("subject", "part").agg(F.count("*").alias("n"), F.max_by("fact", "place").alias("last"))
    ends = dealt.select("subject", "part").distinct().join(sums.select(F.col("subject").alias("s"), F.col("part").alias("p"), "n", "last"), F.col("subject").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")), "left")
    before = Window.partitionBy("subject").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(F.col("subject").alias("of"), F.col("part").alias("in"), F.sum("n").over(before).alias("n_before"), F.last("last", ignorenulls=True).over(before).alias("last_before"))
    both = own.join(carry, F.col("subject").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in")))
    found = F.coalesce("last_here", "last_before")
    n = (F.col("n_here") + F.coalesce("n_before", F.lit(0))).alias("n_known")
    return both.select(F.col("cutoff").alias(cutoff_id), F.col("subject").alias(subject), F.col("at").alias(cutoff_time), n, found["fact_id"].alias(fact_id), *(found[c].alias(c) for c in carried))
