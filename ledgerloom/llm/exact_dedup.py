"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest; it says which document of
each digest stays. A batch is reduced to one row per digest, freed of digests
that the index has by a sort-merge anti-join (the index side needs no shuffle),
and what is left is appended. The batch's rows then get the document that stays
from the index.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import pin_scans, row_number, stored

#: The characters that do not count when texts are compared.
SPACE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), SPACE, "")


@dataclass(frozen=True)
class DigestIndex:
    """A digest index below ``path``, known to this session as ``table``.

    The number of buckets is fixed by the first batch, at one for each
    ``digests_per_bucket`` and at least as many as the session's shuffle
    partitions, and is kept beside the entries, so that any session can open it.
    """

    table: str
    path: str
    digests_per_bucket: int = 4_000_000

    def open(self, spark: SparkSession, n_digests: int = 0) -> int:
        """Makes the index known to the session, or makes it; the number of its buckets."""
        buckets = f"{self.path}/buckets"
        spark.createDataFrame([], "buckets int").write.mode("append").parquet(buckets)
        kept = spark.read.schema("buckets int").parquet(buckets).agg(F.max("buckets").alias("n")).first()["n"]
        if kept is None:
            kept = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_digests // self.digests_per_bucket))
            spark.createDataFrame([(kept,)], "buckets int").coalesce(1).write.mode("append").parquet(buckets)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {kept} BUCKETS LOCATION '{self.path}/entries'"
        )
        return kept

    def entries(self, spark: SparkSession) -> DataFrame:
        """(digest, keep_id, batch), a row a digest: of batches that brought one at the same time the first by name holds. The bucketing spares the shuffle."""
        first = F.min(F.struct("batch", F.col("keep_id").isNull().alias("no_id"), "keep_id"))
        return spark.table(self.table).groupBy("digest").agg(first.alias("x")).select("digest", "x.keep_id", "x.batch")

    def append(self, rows: DataFrame, buckets: int) -> None:
        placed = rows.select("digest", "keep_id", "batch").repartition(buckets, "digest")
        placed.write.format("parquet").mode("append").bucketBy(buckets, "digest").sortBy("digest").option("path", f"{self.path}/entries").saveAsTable(self.table)

    def compacted(self, spark: SparkSession, table: str, path: str) -> "DigestIndex":
        """A copy with one file a bucket, after many appends; the old index stays as it is."""
        copy = DigestIndex(table, path, self.digests_per_bucket)
        copy.append(self.entries(spark), copy.open(spark, spark.table(self.table).count()))
        return copy


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str = "first") -> DataFrame:
    """A row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 and row.

    Texts are equal when they are identical without ASCII white space. Of equal
    texts in a batch the longest original stays, then the smallest doc_id (a
    null one last); one that an earlier batch brought stays before all of them,
    and its doc_id is the keep_id of the copies. ``group_size`` counts the rows
    of this batch. A null text is empty; empty texts are equal to each other. Of
    rows that are wholly alike one is kept. A batch may be run again under its
    name, also after it was cut off: entries that it brought keep their rows. An
    empty table gives no rows; columns other than doc_id and text are not read.
    ``row`` is ``row_number``.
    """
    spark = docs.sparkSession
    pin_scans(spark)
    text = F.col("text").cast("string")
    digests = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(normalised(text), 256)).alias("digest"),
            F.coalesce(F.char_length(text), F.lit(0)).alias("n_points"), row_number().alias("row"),
        ),
        "digests",
    )
    first = F.min(F.struct((-F.col("n_points")).alias("rank"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    groups = stored(digests.groupBy("digest").agg(first.alias("first"), F.count("*").alias("group_size")), "digest-groups")
    buckets = index.open(spark, groups.count())
    unseen = groups.join(index.entries(spark).hint("merge"), "digest", "left_anti")
    index.append(unseen.select("digest", F.col("first.doc_id").alias("keep_id"), F.lit(batch).alias("batch")), buckets)
    own_row = F.when(F.col("batch") == batch, F.col("first.row"))
    owners = stored(groups.join(index.entries(spark).hint("merge"), "digest").select("digest", "group_size", "keep_id", own_row.alias("keep_row")), "digest-owners")
    return digests.join(owners, "digest").select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "row"
    )
