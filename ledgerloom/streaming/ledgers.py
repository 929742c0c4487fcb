"""Ledgers that grow by a stream: one state a chain, which outlives restarts."""

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

APPENDS = "chain string, seq long, outcome string, head string"


class _Append(StatefulProcessor):
    """A chain's length, its head, and the entries that came before their predecessors."""

    def __init__(self, wait_ms: int | None) -> None:
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.end = handle.getValueState("end", "n long, head string")
        self.waiting = handle.getMapState("waiting", "seq long", "entry string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ARG002  the interface's names
        n, head = self.end.get() if self.end.exists() else (0, "")
        out = []
        for part in rows:
            for seq, entry in sorted(zip(part["seq"].tolist(), part["entry"].fillna("").tolist(), strict=True)):
                if seq <= n:
                    out.append((seq, "CLOSED"))
                elif self.waiting.containsKey((seq,)):
                    known = self.waiting.getValue((seq,))[0]
                    out.append((seq, "REPEATED" if known == entry else "CONFLICT"))
                else:
                    self.waiting.updateValue((seq,), (entry,))
        while self.waiting.containsKey((n + 1,)):
            entry = self.waiting.getValue((n + 1,))[0]
            self.waiting.removeKey((n + 1,))
            n, head = n + 1, hashlib.sha256(f"{head}|{entry}".encode()).hexdigest()
            out.append((n, "APPENDED", head))
        self.end.update((n, head))
        if self.wait_ms is not None and self.waiting.exists():
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
        yield self._rows(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ARG002
        waiting = sorted(k[0] for k in self.waiting.keys())  # noqa: SIM118  it is no dict
        yield self._rows(key, [(seq, "MISSING_PREDECESSOR") for seq in waiting])

    @staticmethod
    def _rows(key: tuple, out: list[tuple]) -> pd.DataFrame:
        rows = [(str(key[0]), x[0], x[1], x[2] if len(x) > 2 else None) for x in out]
        return pd.DataFrame(rows, columns=["chain", "seq", "outcome", "head"])

    def close(self) -> None:
        pass


def appends(stream: DataFrame, chain: str, seq: str, entry: str, *, wait_ms: int | None = None) -> DataFrame:
    """(chain, seq, outcome, head) of a stream of entries: each is appended when its predecessor has been, in whatever order they come, and the head is the digest of all so far.

    A number that was appended before is CLOSED; one that waits is REPEATED by an
    equal entry and in CONFLICT with another, which is not taken. With ``wait_ms``
    entries that have waited that long for a predecessor are told as
    MISSING_PREDECESSOR and go on waiting. Entries without a chain or a number are
    left out; a null entry is an empty text. State is a chain's end and what waits.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = stream.select(F.col(chain).cast("string").alias("chain"), F.col(seq).cast("long").alias("seq"), F.col(entry).cast("string").alias("entry")).where("chain is not null and seq is not null")
    mode = "None" if wait_ms is None else "ProcessingTime"
    return rows.groupBy("chain").transformWithStateInPandas(statefulProcessor=_Append(wait_ms), outputStructType=APPENDS, outputMode="Append", timeMode=mode)


def drained(spark: SparkSession, source: str, schema: object, folder: str, **how: object) -> DataFrame:
    """What has been appended of the Parquet files in ``source`` (chain, seq, entry); a later call goes on where this one ended."""
    from ledgerloom.streaming.claims import drain

    return drain(appends(spark.readStream.schema(schema).parquet(source), "chain", "seq", "entry", **how), folder)
