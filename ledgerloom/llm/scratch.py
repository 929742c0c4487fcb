"""Written intermediate tables, in the folder that the whole cluster shares.

A written table cuts the lineage: a lost executor costs at most the stage that
runs, never the stages before it.
"""

import re
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode one of our own where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="ledgerloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/ledgerloom/{name}-{uuid.uuid4().hex}"


#: The tables stored since each ``discarding`` that is open in this thread, which other threads don't see.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back."""
    path = fresh_path(df.sparkSession, name)
    if _OPEN.get():
        _OPEN.get()[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def discarding(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Deletes the tables that are ``stored`` meanwhile, but for those that are stored by the function it gives: an operator's result may read these."""
    kept: set[str] = set()
    made: list[str] = []
    token = _OPEN.set((*_OPEN.get(), made))

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = stored(df, name)
        kept.add(made[-1])
        return out

    try:
        yield keep
    finally:
        _OPEN.reset(token)
        for path in set(made) - kept:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def row_number() -> Column:
    """The number of a row of a written table: its partition of the scan and its place there, the same in every scan of it after ``pin_scans``.

    It tells rows apart where doc_id does not, and joins an operator's rows back to the table's.
    """
    return F.monotonically_increasing_id()


def pin_scans(spark: SparkSession) -> None:
    """Files are split alike from now on, also after executors have come or gone: the number of splits follows the cores of now unless the session sets it."""
    key = "spark.sql.files.minPartitionNum"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(spark.sparkContext.defaultParallelism))


def per_process(key: str, make: Callable[[], Any]) -> Any:
    """An object that a Python worker keeps from task to task, until one of another key takes its place: what one stage needs doesn't stay for the next."""
    home = sys.modules.setdefault("ledgerloom_worker_state", types.ModuleType("ledgerloom_worker_state"))
    if getattr(home, "key", None) != key:
        home.key = home.held = None
        home.held = make()
        home.key = key
    return home.held


def small_batches(spark: SparkSession) -> None:
    """What every operator with Python tasks begins with: scans are pinned, and Arrow batches hold at most 4 MB, or one row.

    Both stay set, since the operators' results are read after they have returned. A smaller bound of the session stays.
    """
    pin_scans(spark)
    most_bytes = 4 << 20
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    bound = re.fullmatch(r"([0-9]+)b?", spark.conf.get(key))
    if not bound or not 0 < int(bound[1]) <= most_bytes:
        spark.conf.set(key, f"{most_bytes}b")
