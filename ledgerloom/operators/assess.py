"""Assessments over relations: multisets, ordered tables, numbered names, states at cutoffs, separation of duties."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.compare import gated, ladder
from ledgerloom.operators.evidence import examples


def multisets(left: DataFrame, right: DataFrame, *columns: str) -> DataFrame:
    """(columns, n_left, n_right, status) for each value that either side has; both are counted before they meet, nulls are values."""
    tagged = left.select(*columns, F.lit(1).alias("l"), F.lit(0).alias("r")).union(right.select(*columns, F.lit(0), F.lit(1)))
    counts = tagged.groupBy(*columns).agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right"))
    rungs = [("UNEXPECTED", F.col("n_left") == 0), ("MISSING", F.col("n_right") == 0), ("EQUAL", F.col("n_left") == F.col("n_right"))]
    return counts.withColumn("status", ladder(rungs, "COUNT_DIFFERS"))


def ranked_tables(reference: DataFrame, candidate: DataFrame, rank: str, item: str) -> DataFrame:
    """(rank, expected, found, status) of two ordered tables, rank by rank.

    A rank that one side lacks is EXTRA or MISSING; where the items differ it is
    ORDER if the reference's item stands elsewhere in the candidate, else OPERAND.
    A table with an item or a rank twice, or a null one, makes the two NOT_COMPARABLE, as a whole.
    """
    elsewhere = candidate.select(F.col(item).alias("there")).distinct()
    own = reference.select(F.col(rank).alias("r_rank"), F.col(item).alias("expected")).join(elsewhere, F.col("expected") == F.col("there"), "left")
    other = candidate.select(F.col(rank).alias("c_rank"), F.col(item).alias("found"))
    both = own.join(other, F.col("r_rank") == F.col("c_rank"), "full_outer")
    rungs = [("EXTRA", F.col("r_rank").isNull()), ("MISSING", F.col("c_rank").isNull()), ("MATCH", F.col("expected").eqNullSafe(F.col("found"))), ("ORDER", F.col("there").isNotNull())]
    out = both.select(F.coalesce("r_rank", "c_rank").alias(rank), "expected", "found", ladder(rungs, "OPERAND").alias("status"))
    return gated(out, [reference, candidate], [item, rank], "status")


def numbered_sets(names: DataFrame, name: str) -> DataFrame:
    """(base, total, n_present, n_missing, status) of names like ``base-00001-of-00005``; other names are left out.

    INVALID has a number outside 1..total, DUPLICATE a number twice.
    """
    pattern = r"^(.*)-([0-9]{5})-of-([0-9]{5})$"
    part = lambda k: F.regexp_extract(name, pattern, k)
    rows = names.where(F.col(name).rlike(pattern)).select(part(1).alias("base"), part(2).cast("long").alias("number"), part(3).cast("long").alias("total"))
    sets = rows.groupBy("base", "total").agg(F.count("*").alias("n"), F.countDistinct("number").alias("n_present"), F.min("number").alias("lo"), F.max("number").alias("hi"))
    rungs = [("INVALID", (F.col("lo") < 1) | (F.col("hi") > F.col("total"))), ("DUPLICATE", F.col("n") > F.col("n_present")), ("INCOMPLETE", F.col("n_present") < F.col("total"))]
    return sets.select("base", "total", "n_present", (F.col("total") - F.col("n_present")).alias("n_missing"), ladder(rungs, "COMPLETE").alias("status"))


def states_at(facts: DataFrame, key: str, time: str, value: str, cutoffs: Mapping[str, Column], *tie: str) -> DataFrame:
    """(key, a column for each cutoff): the latest value by each cutoff, null where there was none; one aggregation for all cutoffs."""
    newest = [F.max_by(F.when(F.col(time) <= at, F.col(value)), F.when(F.col(time) <= at, F.struct(time, *tie, value))).alias(name) for name, at in cutoffs.items()]
    return facts.groupBy(key).agg(*newest)


def separation(requests: DataFrame, approvals: DataFrame, key: str, requester: str, approver: str) -> DataFrame:
    """(key, n_approvals, n_same, status): approvals by the requester's own party violate the separation of duties.

    Requests are unique; approvals are counted by party before they meet the
    requests. A null party is NOT_IDENTIFIED unless another approval violates.
    """
    counted = approvals.groupBy(F.col(key).alias("a_key"), F.col(approver).alias("party")).agg(F.count("*").alias("n"))
    both = requests.select(key, F.col(requester).alias("asker")).join(counted, F.col(key) == F.col("a_key"), "left")
    sums = both.groupBy(key).agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_approvals"),
        F.coalesce(F.sum(F.when(F.col("party") == F.col("asker"), F.col("n"))), F.lit(0)).cast("long").alias("n_same"),
        F.coalesce(F.bool_or(F.col("n").isNotNull() & (F.col("party").isNull() | F.col("asker").isNull())), F.lit(False)).alias("unknown"),
    )
    rungs = [("VIOLATED", F.col("n_same") > 0), ("NOT_IDENTIFIED", F.col("unknown")), ("NOT_EVALUATED", F.col("n_approvals") == 0)]
    return sums.withColumn("status", ladder(rungs, "SATISFIED")).drop("unknown")


def frequent(rows: DataFrame, key: str, item: str, most: int, shown: int) -> DataFrame:
    """(key, n, examples): the ``most`` keys with most rows, ties by key, each with its ``shown`` smallest items. Only those keys' rows are ranked."""
    top = rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(most)
    return examples(rows.join(F.broadcast(top.select(key)), key, "left_semi"), key, item, shown)


def within(value: Column, thresholds: Sequence[Column]) -> Column:
    """Whether ``value`` is at most the first threshold that is not null; null where none is set."""
    return value <= F.coalesce(*thresholds)
