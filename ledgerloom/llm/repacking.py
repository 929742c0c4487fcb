"""Best-fit packing, certified by lower bounds and repaired by exchange.

Documents become pieces of at most ``capacity`` tokens. Pieces are dealt to
partitions of a few thousand, each packed by best-fit decreasing. Dual feasible
functions give a lower bound on the bins that a partition needs: where packing
meets it, the partition is certified and rests. Partitions with a gap exchange
documents: what lies in their bins with free space is pooled, several partitions
to a pool, and best-fit decreasing runs again; a pool keeps its former bins
unless the new ones are fewer. Pools grow round by round, up to ``MOST_POOLED``
pieces, until all are certified or a round saves nothing.

Only keys and lengths move in these rounds. Tokens are written once; where they
lie follows by a join.

Edge cases: a null text is empty and holds its end token; a null doc_id stays
null; rows that share a doc_id or are wholly alike are packed one by one; a very
long text is cut into as many pieces as it needs, of which the first alone may be
shorter; documents of equal length are placed in the order of their keys; an
empty table gives no rows; columns other than ``doc_id`` and ``text`` are not read.
"""

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import small_batches, stored
from ledgerloom.llm.tokens import ByteTokenizer

PIECES = "key long, doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = "key long, length long, pool long, bin int, offset long, bins int, bound int, fill int"
#: Pieces of a partition at first, and at most in a pool later.
PART, MOST_POOLED = 4096, 1 << 16
#: Partitions whose open bins meet in a pool.
TOGETHER = 6


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best-fit decreasing: bin and offset of every length, and the number of bins. Equal lengths keep their order."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    free, made = 0, 0  # bit s of free: some bin has s tokens left
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        fits = free >> n
        if fits:
            left = n + (fits & -fits).bit_length() - 1
            chosen = open_bins[left].pop()
            if not open_bins[left]:
                free ^= 1 << left
        else:
            left, chosen, made = capacity, made, made + 1
        bins[k], offsets[k] = chosen, capacity - left
        if rest := left - n:
            open_bins[rest].append(chosen)
            free |= 1 << rest
    return bins, offsets, made


def least_bins(lengths: np.ndarray, capacity: int, steps: Sequence[int] = range(1, 33)) -> int:
    """A lower bound on the bins of any packing, the best of two families of dual feasible functions.

    With a threshold e, lengths over capacity - e count as whole bins and those under e
    not at all; the rest count as they are, or as ``floor((k + 1) x / capacity) / k`` where
    that isn't exact.
    """
    if not len(lengths):
        return 0
    held = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    low = np.arange(0, capacity // 2 + 1)
    over = np.append(np.cumsum(held[::-1])[::-1], 0)[capacity - low + 1]  # how many are longer than capacity - e
    best = 0
    for k in (0, *steps):
        # in units of 1 / (capacity * k) of a bin
        unit = capacity * max(k, 1)
        worth = size if not k else np.where((k + 1) * size % capacity == 0, size * k, (k + 1) * size // capacity * capacity)
        upto = np.concatenate([[0], np.cumsum(worth * held)])
        total = upto[capacity - low + 1] - upto[low] + over * unit
        best = max(best, int(-(-total.max() // unit)))
    return best


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """A row per piece, under a key of its own; only documents over ``capacity`` are cut, and all their pieces but the first are full."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of, end, key = ByteTokenizer(tokenizer_path), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId() << 36
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = memoryview((ids_of(text) if isinstance(text, str) else b"") + end)
                total = len(ids) // 4
                cuts = [0, *range(total % capacity or capacity, total + 1, capacity)]
                for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    part = ids[4 * a : 4 * b]
                    rows.append((key, doc_id, n, a, b - a, zlib.crc32(part), bytes(part) if with_ids else None))
                    key += 1
            out = pd.DataFrame(rows, columns=["key", "doc_id", "piece", "start", "length", "ids_crc32", "ids"]).astype({"doc_id": "Int64"})
            yield out if with_ids else out.drop(columns="ids")

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, PIECES + ", ids binary" * with_ids)


def _first_packing(capacity: int):
    def run(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key")
        lengths = rows["length"].to_numpy(np.int64)
        return _table(rows["key"], lengths, keys[0], *best_fit(lengths, capacity), capacity)

    return run


def _table(keys: pd.Series, lengths: np.ndarray, pool: int, bins: np.ndarray, offsets: np.ndarray, made: int, capacity: int) -> pd.DataFrame:
    fill = np.bincount(bins, weights=lengths, minlength=made).astype(np.int64)
    return pd.DataFrame({"key": keys.to_numpy(), "length": lengths, "pool": pool, "bin": bins, "offset": offsets, "bins": made, "bound": least_bins(lengths, capacity), "fill": fill[bins]})


def _repacked(capacity: int):
    """A pool's documents anew; in their former bins where that doesn't save one."""

    def run(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key")
        lengths = rows["length"].to_numpy(np.int64)
        bins, offsets, made = best_fit(lengths, capacity)
        former = rows.groupby(["pool", "bin"]).ngroup().to_numpy()
        if len(former) and made >= former.max() + 1:
            bins, offsets, made = former, rows["offset"].to_numpy(), int(former.max()) + 1
        return _table(rows["key"], lengths, keys[0], bins, offsets, made, capacity)

    return run


def exchange(items: DataFrame, capacity: int, *, part: int = PART, together: int = TOGETHER, most_pooled: int = MOST_POOLED) -> DataFrame:
    """``pool, bin, offset, bins, bound`` for every ``key, length`` of ``items``: ``bins`` and ``bound`` are those of the row's pool, which is certified where they are equal.

    The driver gets four numbers a round: bins, gaps, and the documents and bins with
    free space where there is one.
    """
    spark = items.sparkSession
    n = items.count()
    if not n:
        return spark.createDataFrame([], PLACED)
    groups, loose = -(-n // part), F.col("fill") < capacity
    dealt = items.select("key", "length", F.pmod(F.xxhash64("key"), F.lit(groups)).alias("pool"))
    placed = stored(dealt.groupBy("pool").applyInPandas(_first_packing(capacity), PLACED), "bins-0")
    begin, rests, turn, before = groups, [], 0, None
    while True:
        pools = placed.groupBy("pool").agg(F.first("bins").alias("bins"), F.first("bound").alias("bound"), F.count_if(loose).alias("open"), F.count_if(loose & (F.col("offset") == 0)).alias("open_bins"))
        counts = [F.sum(F.when(F.col("bins") > F.col("bound"), F.col(c)).otherwise(0)) for c in ("open", "open_bins")]
        n_bins, n_gaps, n_open, n_open_bins = pools.agg(F.sum("bins"), F.count_if(F.col("bins") > F.col("bound")), *counts).first()
        if n_gaps < 2 or before is not None and n_bins >= before:
            return _union([*rests, placed])
        turn, before = turn + 1, n_open_bins
        clusters = max(1, -(-n_gaps // together), -(-n_open // most_pooled))
        named = pools.where("bins > bound").select(F.col("pool").alias("gap"), (F.lit(begin) + F.pmod(F.xxhash64("pool", F.lit(turn)), F.lit(clusters))).alias("cluster"))
        told = placed.join(named, F.col("pool") == F.col("gap"), "left")
        moving = F.col("cluster").isNotNull() & loose
        rests.append(told.where(~moving).select(placed.columns))
        placed = stored(told.where(moving).groupBy("cluster").applyInPandas(_repacked(capacity), PLACED), f"bins-{turn}")
        begin += clusters


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def pack_best_fit(docs: DataFrame, tokenizer_path: str, *, capacity: int = 1024, end_id: int = 2, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents in as few sequences as the bound-certified repacking finds.

    A full piece is a sequence of its own, with a negative number. ``certified`` tells
    whether the pool of the piece is proven to use the fewest sequences for what it holds.
    """
    spark = docs.sparkSession
    small_batches(spark)
    pieces = stored(token_pieces(docs, tokenizer_path, capacity, end_id, with_ids), "pieces")
    placed = stored(exchange(pieces.where(F.col("length") < capacity).select("key", "length"), capacity), "bins")
    own = placed.select(F.col("key").alias("own_key"), (F.col("pool") * 2**24 + F.col("bin")).alias("sequence_id"), "offset", (F.col("bins") == F.col("bound")).alias("certified"))
    sequence = F.coalesce("sequence_id", -1 - F.col("key")).alias("sequence_id")
    out = pieces.join(own, F.col("key") == F.col("own_key"), "left")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", sequence, F.coalesce("offset", F.lit(0)).cast("long").alias("offset"), F.coalesce("certified", F.lit(True)).alias("certified"), *(["ids"] if with_ids else []))
