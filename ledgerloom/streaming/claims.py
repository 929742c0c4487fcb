"""Claims that arrive as streams: the first of each kind, and censuses of closed windows."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A stream of the Parquet files of ``path``: a folder, to which files may be added, or one file."""
    return spark.readStream.schema(schema).parquet(f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]")  # a pattern that only this path matches, since a stream takes no plain file


def first_claims(stream: DataFrame, *keys: str) -> DataFrame:
    """Each combination of ``keys`` once, as soon as it is seen; its state stays, so keep keys coarse."""
    return stream.select(*keys).dropDuplicates(list(keys))


def window_census(stream: DataFrame, time: str, key: str, width: str, lateness: str) -> DataFrame:
    """(start, end, key, n) of windows that have closed; rows later than ``lateness`` are left out and state is dropped behind the watermark."""
    counts = stream.withWatermark(time, lateness).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def drain(stream: DataFrame, folder: str) -> DataFrame:
    """All that has arrived, written below ``folder`` and read back; a later call goes on where this one ended, each row is written once."""
    run = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/progress").outputMode("append").trigger(availableNow=True).start(f"{folder}/rows")
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
