"""Coverage of requirements, unanimity of groups, capped examples and deterministic samples."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unanimity(rows: DataFrame, group: str, *columns: str) -> DataFrame:
    """(group, n, n_distinct, unanimous) of the tuples of ``columns``; nulls count as values."""
    out = rows.groupBy(group).agg(F.count("*").alias("n"), F.countDistinct(F.struct(*columns)).alias("n_distinct"))
    return out.withColumn("unanimous", F.col("n_distinct") == 1)


def missing_requirements(required: DataFrame, observed: DataFrame, *key: str) -> DataFrame:
    """Required keys that were not observed."""
    return required.join(observed.select(*key).distinct(), list(key), "left_anti")


def examples(rows: DataFrame, group: str, item: str, most: int) -> DataFrame:
    """(group, n, examples): the number of rows and the ``most`` smallest distinct items as one string.

    Counting and choosing are apart: ranks are filtered at once, so that each
    task keeps ``most`` items of a group before any are shuffled.
    """
    counts = rows.groupBy(group).agg(F.count("*").alias("n"))
    kept = rows.where(F.col(item).isNotNull()).select(F.col(group).alias("of"), F.col(item).alias("item")).distinct()
    kept = kept.withColumn("place", F.row_number().over(Window.partitionBy("of").orderBy("item"))).where(F.col("place") <= most)
    shown = kept.groupBy("of").agg(F.array_join(F.array_sort(F.collect_list("item")), ",").alias("examples"))
    return counts.join(shown, F.col(group).eqNullSafe(F.col("of")), "left").select(group, "n", F.coalesce("examples", F.lit("")).alias("examples"))


def draw(key: Column, seed: str, out_of: int) -> Column:
    """A number below ``out_of`` from the first 60 bits of the key's digest; the same in every run."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256), 1, 15)
    return F.conv(digits, 16, 10).cast("long") % out_of
