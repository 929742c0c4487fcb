"""Written intermediate tables in the folder that the whole cluster shares: a lost executor costs at most the stage that runs."""

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _shared(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode one of our own where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="ledgerloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder where the whole cluster can write."""
    return f"{_shared(spark)}/ledgerloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written as a table and read again."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discarded(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for path in {file.rsplit("/", 1)[0] for table in tables for file in table.inputFiles()}:
        jvm, context = tables[0].sparkSession._jvm, tables[0].sparkSession._jsc
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(context.hadoopConfiguration()).delete(folder, True)


def ranked(rows: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "place") -> DataFrame:
    """``rows`` with their place (from 1) in the order of their group, however large that is.

    Rows are dealt out by ranges of group and order, so that no task gets a
    group as a whole; a place is that in the row's range plus the rows of the
    group in the ranges before. ``order`` leaves no ties. Nulls of ``group``
    are a group.
    """
    keys = [F.col(c) for c in group]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    dealt = written(dealt.withColumn("dealt_id", F.monotonically_increasing_id()), "ranked").withColumn("dealt_part", F.shiftright("dealt_id", 33))
    before = F.coalesce(F.sum("dealt_n").over(Window.partitionBy(*keys).orderBy("dealt_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = dealt.groupBy(*keys, "dealt_part").agg(F.count("*").alias("dealt_n"), F.min("dealt_id").alias("dealt_first"))
    starts = starts.select(F.struct(*keys).alias("dealt_group"), F.col("dealt_part").alias("dealt_of"), (before - F.col("dealt_first") + 1).alias("dealt_shift"))
    both = dealt.join(starts, (F.col("dealt_part") == F.col("dealt_of")) & F.struct(*keys).eqNullSafe(F.col("dealt_group")))
    return both.select(*rows.columns, (F.col("dealt_id") + F.col("dealt_shift")).alias(name))
