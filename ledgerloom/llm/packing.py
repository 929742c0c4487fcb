"""Mixture-controlled packing by deficit round-robin over source queues.

Each source's tokens form a queue. Rounds of about one window go over the
queues; a round gives queue q a quantum of ``take_q / rounds`` tokens and q sends
the whole tokens of its quantum plus what it was owed, so its deficit stays
below one token. After j rounds q has therefore sent exactly
``floor(take_q * j / rounds)`` tokens, which any task can work out by itself:
the deficits are carried across windows and across partitions without a
sequential pass. Where target weights are given, a queue that runs dry ends a
phase and the rest share the following rounds by weight.

Edge cases: a null text is empty and still holds its end token; a null source
is a queue of its own; rows that share a doc_id or are wholly alike are packed
one by one; an empty table gives no rows; columns other than the three that are
named are not read.
"""

import zlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import small_batches, stored
from ledgerloom.llm.tokens import WordTokenizer

TOKENS = "part int, doc_id long, queue_key string, doc_tokens long, at long, ids binary"
PIECES = "doc_id long, queue_key string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


@dataclass
class Phase:
    """``rounds`` rounds in which queue q sends ``take[q]`` tokens after the ``sent[q]`` of earlier phases."""

    rounds: int
    sent: list[int]
    take: list[int]


@dataclass
class Schedule:
    window: int
    total: int
    phases: list[Phase]

    def tail_starts(self) -> list[int]:
        """Where the sequences after the last full window start: its rest, cut into powers of two, needs no padding."""
        at, starts = self.total // self.window * self.window, []
        while at < self.total:
            starts.append(at)
            at += 1 << ((self.total - at).bit_length() - 1)
        return starts


def schedule(totals: Sequence[int], window: int, weights: Sequence[float] | None = None) -> Schedule:
    """Phases for queues of ``totals`` tokens. Without weights, every window gets the queues' own proportions."""
    sent, phases = [0] * len(totals), []
    while any(left := [t - s for t, s in zip(totals, sent, strict=True)]):
        share = [w if n else 0 for w, n in zip(weights, left, strict=True)] if weights else left
        if not any(share):
            share = left
        until = min(n / w for n, w in zip(left, share, strict=True) if w)
        take = [n if w and n / w <= until else min(n, int(w * until)) for n, w in zip(left, share, strict=True)]
        phases.append(Phase(max(1, -(-sum(take) // window)), sent, take))
        sent = [s + n for s, n in zip(sent, take, strict=True)]
    return Schedule(window, sum(totals), phases)


def cut(plan: Schedule, queue: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces of runs of queue positions: run number, first position, length, sequence and offset there."""
    runs, firsts, lengths, places = [], [], [], []
    for phase in plan.phases:
        kind = np.int64 if max(phase.take) * (phase.rounds + 2) < 2**62 else object
        take, sent, rounds = np.array(phase.take, kind), np.array(phase.sent, kind), phase.rounds
        a = np.maximum(first, sent[queue])
        b = np.minimum(first + length, (sent + take)[queue])
        run = np.flatnonzero(b > a)
        q, a, b = queue[run], a[run], b[run]
        of, before = take[q], sent[q]
        j0, j1 = ((a - before + 1) * rounds - 1) // of, ((b - before) * rounds - 1) // of
        n = (j1 - j0 + 1).astype(np.int64)
        each = np.repeat(np.arange(len(run)), n)
        j = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n) + j0[each]
        own, start = of[each], before[each]
        lo = np.maximum(a[each], start + own * j // rounds)
        hi = np.minimum(b[each], start + own * (j + 1) // rounds)
        others = _sent_by_others(take, sent, rounds, q[each], j)
        runs.append(run[each])
        firsts.append(lo)
        lengths.append(hi - lo)
        places.append(others + lo)
    run, lo, n, place = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (runs, firsts, lengths, places))
    keep = n > 0
    run, lo, n, place = run[keep], lo[keep], n[keep], place[keep]
    full = plan.total // plan.window
    starts = np.array([*plan.tail_starts(), plan.total], np.int64)
    out = []
    while len(run):
        late = place >= full * plan.window
        k = np.searchsorted(starts, place, "right")
        begin = np.where(late, starts[np.maximum(k - 1, 0)], place // plan.window * plan.window)
        end = np.where(late, starts[np.minimum(k, len(starts) - 1)], begin + plan.window)
        sequence = np.where(late, full + k - 1, place // plan.window)
        here = np.minimum(n, end - place)
        out.append((run, lo, here, sequence, place - begin))
        more = n > here
        run, lo, n, place = run[more], (lo + here)[more], (n - here)[more], (place + here)[more]
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    joined = [np.concatenate(x) for x in zip(*out, strict=True)]
    order = np.lexsort((joined[1], joined[0]))
    return tuple(x[order] for x in joined)


def _sent_by_others(take: np.ndarray, sent: np.ndarray, rounds: int, queue: np.ndarray, j: np.ndarray) -> np.ndarray:
    """What the other queues have sent when a queue's turn of round j comes: queues before it have had theirs of this round."""
    out = sent.sum() - sent[queue]
    turns, at = np.unique(np.concatenate([j, j + 1]), return_inverse=True)
    for lo in range(0, len(turns), step := max(1, (1 << 20) // len(take))):  # a table of rounds by queues, a part at a time
        upto = np.zeros((min(step, len(turns) - lo), len(take) + 1), take.dtype)
        np.cumsum(take[None, :] * turns[lo : lo + step, None] // rounds, axis=1, out=upto[:, 1:])
        now, after = at[: len(j)] - lo, at[len(j) :] - lo
        x = np.flatnonzero((now >= 0) & (now < len(upto)))
        out[x] += upto[now[x], -1] - upto[now[x], queue[x] + 1]
        x = np.flatnonzero((after >= 0) & (after < len(upto)))
        out[x] += upto[after[x], queue[x]]
    return out


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """A row per document: its ids, and how many tokens of its source precede it in its partition of the scan."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of, part = WordTokenizer(tokenizer_path), TaskContext.get().partitionId()
        end, sent = np.array([end_id], "<u4").tobytes(), {}
        for batch in batches:
            rows = []
            for doc_id, text, source in zip(batch["doc_id"], batch["text"], batch["source"], strict=True):
                ids = np.frombuffer((ids_of(text) if isinstance(text, str) else b"") + end, "<u4")
                key = f"s{source}" if isinstance(source, str) else "null"
                at = sent.get(key, 0)
                sent[key] = at + len(ids)
                rows.append((part, doc_id, key, len(ids), at, ids.astype("<u2" if ids.max() < 2**16 else "<u4").tobytes()))
            yield pd.DataFrame(rows, columns=["part", "doc_id", "queue_key", "doc_tokens", "at", "ids"]).astype({"doc_id": "Int64"})

    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string"))
    return chosen.mapInPandas(run, TOKENS)


def pack(docs: DataFrame, tokenizer_path: str, *, window: int = 4096, end_id: int = 2, weights: Mapping[str | None, float] | None = None, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents, placed in sequences of at most ``window`` tokens.

    Every source has a queue. ``weights`` are target proportions by source
    (others: 0, served when the rest is dry); without them every window has the
    corpus's proportions. The tokenised table is written once in the shared
    folder. The driver gets one total a source.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tokens = stored(tokenized(docs, tokenizer_path, end_id), "tokens")
    sizes = stored(tokens.groupBy("part", "queue_key").agg(F.sum("doc_tokens").alias("n")), "queue-sizes")
    top = sizes.groupBy("queue_key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "queue_key").collect()
    share = None if weights is None else [weights.get(None if r["queue_key"] == "null" else r["queue_key"][1:], 0) for r in top]
    plan = schedule([r["n"] for r in top], window, share)
    own = sizes.join(spark.createDataFrame([(r["queue_key"], k) for k, r in enumerate(top)], "queue_key string, queue int"), "queue_key")
    over_parts = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # written, so that the join knows how small it is and leaves the tokens where they are, or shuffles them where it is not
    base = stored(own.select("part", "queue_key", "queue", F.coalesce(F.sum("n").over(over_parts), F.lit(0)).alias("base")), "queue-starts")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            run, lo, n, sequence, offset = cut(plan, batch["queue"].to_numpy(np.int64), batch["first"].to_numpy(np.int64), batch["doc_tokens"].to_numpy(np.int64))
            start = lo - batch["first"].to_numpy(np.int64)[run]
            ids = [np.frombuffer(x, "<u2" if len(x) == 2 * n_ids else "<u4").astype("<u4").tobytes() for x, n_ids in zip(batch["ids"], batch["doc_tokens"], strict=True)]
            parts = [memoryview(ids[r])[4 * a : 4 * (a + m)] for r, a, m in zip(run.tolist(), start.tolist(), n.tolist(), strict=True)]
            crc = [zlib.crc32(p) for p in parts]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64").to_numpy()[run], "queue_key": batch["queue_key"].to_numpy()[run], "start": start, "length": n, "ids_crc32": np.array(crc, np.int64),
                "doc_tokens": batch["doc_tokens"].to_numpy(np.int64)[run], "sequence_id": sequence, "offset": offset, "ids": [bytes(p) if with_ids else b"" for p in parts],
            }).astype({"doc_id": "Int64"})

    placed = tokens.join(base, ["part", "queue_key"]).select("doc_id", "queue_key", "queue", (F.col("base") + F.col("at")).alias("first"), "doc_tokens", "ids").mapInPandas(place, PIECES)
    source = F.when(F.col("queue_key") != "null", F.substring("queue_key", 2, 2**30))
    out = placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", source.alias("source"), *(["ids"] if with_ids else []))
    return out
