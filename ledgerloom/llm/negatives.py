"""Hard-negative mining over one-dimensional distance keys.

Vectors are lengthened by one component so that all lie on a sphere; the nearest
of a query's lengthened vector are then those with the highest inner product. The
index stores each vector under its nearest pivot and its distance from it, sorted
by (pivot, ring, distance) and cut into cells of up to ``CELL`` vectors. By the
triangle inequality a vector within r of a query has, at every pivot, a key within
r of the query's. So a search scans an interval of keys a pivot and widens it; when
no vector beyond the interval can reach the last of the best found so far, the
result is certified. All scores are exact integers.

Positives are searched from distance 0 on, negatives from the distance at which a
score is just low enough. Queries lie in chunks, and a chunk meets a cell once,
as a product of two matrices. Pivots are fitted to a bounded sample; every vector
is indexed, and results do not depend on the pivots.

Edge cases: rows with a null label, vector or component, or one that is not finite,
take no part; shorter vectors are as if ended by zeros; a null vec_id is no anchor,
keeps its label, comes last among equal scores; rows that share a vec_id or are
wholly alike are rows of their own, each with its own results as an anchor; an
empty table gives no rows; columns other than the three that are named are not read.
Squares of integer vectors must fit in 62 bits, else the job fails.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import discarding, row_number, small_batches, stored

#: Vectors of a cell, queries of a chunk, rings of a pivot's longest distance.
CELL, CHUNK, RINGS = 1024, 512, 24
#: Pivots at most, and the vectors they are fitted to.
MOST_PIVOTS, SAMPLE = 64, 4096
#: What a vec_id counts as where it is null.
NO_ID = 2**63 - 1
VECTORS = "n int, ids binary, rows binary, labels binary, vectors binary"


@dataclass
class Index:
    """Pivots with their additional component, the sphere's squared radius, and the width of a ring."""

    pivots: np.ndarray
    radius2: int
    width: float
    size: int
    dim: int

    def distances(self, vectors: np.ndarray, outer: np.ndarray) -> np.ndarray:
        """From vectors, lengthened by ``outer``, to every pivot."""
        inner = vectors.astype(np.float64) @ self.pivots[:, :-1].T + outer[:, None] * self.pivots[None, :, -1]
        own = (vectors.astype(np.float64) ** 2).sum(1) + outer**2
        return np.sqrt(np.maximum(own[:, None] + (self.pivots**2).sum(1)[None, :] - 2 * inner, 0))

    def slack(self) -> float:
        """More than what rounding can move a distance by."""
        return 1e-6 * max(1.0, float(self.radius2) ** 0.5)

    def ring(self, distance: np.ndarray) -> np.ndarray:
        return np.clip(np.floor(distance / self.width), 0, None).astype(np.int64)


def integer_vectors(table: DataFrame) -> DataFrame:
    """``row, vec_id, label, vector, square`` of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    vector = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    own = table.select(row_number().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding"))
    used = own.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    square = F.aggregate("vector", F.lit(0).cast("long"), lambda total, x: total + x * x)
    return used.select("row", "vec_id", label.cast("long").alias("label"), vector.alias("vector")).withColumn("square", square)


def fit(vectors: DataFrame) -> Index | None:
    """Pivots by a few rounds of k-means on at most ``SAMPLE`` vectors, chosen by a hash of the row."""
    size, radius2, dim = vectors.agg(F.count("*"), F.max("square"), F.max(F.size("vector"))).first()
    if not size:
        return None
    sample = vectors.orderBy(F.xxhash64("row")).limit(SAMPLE).select("vector", "square").collect()
    points = np.zeros((len(sample), dim + 1))
    for k, r in enumerate(sample):
        points[k, : len(r.vector)] = r.vector
        points[k, -1] = max(radius2 - r.square, 0) ** 0.5
    pivots = np.unique(points, axis=0)
    pivots = pivots[np.random.default_rng(1).permutation(len(pivots))[: max(1, min(MOST_PIVOTS, size // CELL))]]
    for _ in range(8):
        nearest = np.argmin((pivots**2).sum(1)[None, :] - 2 * points @ pivots.T, axis=1)
        pivots = np.array([points[nearest == k].mean(0) if (nearest == k).any() else pivots[k] for k in range(len(pivots))])
    return Index(pivots, int(radius2), max(2 * float(radius2) ** 0.5 / RINGS, 1e-3), int(size), int(dim))


def _matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim), np.int64)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def _small(index: Index) -> str:
    """The integers in which components are stored."""
    return "<i2" if index.radius2 < 2**30 else "<i8"


def keyed(vectors: DataFrame, index: Index) -> DataFrame:
    """``pivot, ring, distance`` of every row, with its integers as bytes."""
    kind = _small(index)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            matrix, square = _matrix(batch["vector"], index.dim), batch["square"].to_numpy(np.int64)
            distance = index.distances(matrix, np.sqrt((index.radius2 - square).astype(np.float64)))
            pivot = distance.argmin(1)
            own = distance[np.arange(len(pivot)), pivot]
            yield pd.DataFrame({"row": batch["row"], "vec_id": batch["vec_id"].fillna(NO_ID).astype(np.int64), "label": batch["label"], "pivot": pivot, "ring": index.ring(own), "distance": own, "vector": [v.tobytes() for v in matrix.astype(kind)], "square": square})

    return vectors.select("row", F.coalesce("vec_id", F.lit(NO_ID)).alias("vec_id"), "label", "vector", "square").mapInPandas(run, "row long, vec_id long, label long, pivot int, ring int, distance double, vector binary, square long")


def _cells(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Up to ``most`` neighbouring rows of one pivot and ring as one row."""
    for batch in batches:
        held = []
        for (pivot, ring), rows in batch.groupby(["pivot", "ring"], sort=False):
            held += [{"pivot": pivot, "ring": ring} | _packed(rows.iloc[at : at + most]) for at in range(0, len(rows), most)]
        yield pd.DataFrame(held, columns=["pivot", "ring", "n", "ids", "rows", "labels", "vectors"])


def _packed(rows: pd.DataFrame) -> dict:
    return {"n": len(rows), "ids": rows["vec_id"].to_numpy(np.int64).tobytes(), "rows": rows["row"].to_numpy(np.int64).tobytes(), "labels": rows["label"].to_numpy(np.int64).tobytes(), "vectors": b"".join(rows["vector"])}


def cells(keys: DataFrame, size: int, most: int = CELL) -> DataFrame:
    """The index: vectors sorted by (pivot, ring, distance), dealt in ranges, so that rings of any size have many cells."""
    parts = max(1, -(-size // (16 * most)))
    sorted_keys = keys.repartitionByRange(parts, "pivot", "ring", "distance", "row").sortWithinPartitions("pivot", "ring", "distance", "row")
    return sorted_keys.mapInPandas(lambda batches: _cells(batches, most), f"pivot int, ring int, {VECTORS}")


def chunks(keys: DataFrame, anchors: str, most: int = CHUNK) -> DataFrame:
    """The queries, sorted like the index, by up to ``most``."""
    queries = keys.where(anchors)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [batch.iloc[at : at + most] for at in range(0, len(batch), most)]
            yield pd.DataFrame([{"chunk": int(part["row"].iloc[0])} | _packed(part) for part in parts], columns=["chunk", "n", "ids", "rows", "labels", "vectors"])

    parts = max(1, -(-queries.count() // (4 * most)))
    order = ["pivot", "ring", "distance", "row"]
    return queries.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInPandas(run, f"chunk long, {VECTORS}")


#: What a slot of a query asks for: scores from lo to hi; how many there are at all, or NO_ID where that is not known.
SLOTS = "lo binary, hi binary, there binary"


def _longs(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i8")


class _Queries:
    """A chunk, with what its searches have reached in a round."""

    def __init__(self, row, index: Index) -> None:
        self.n, self.rows, self.labels = row.n, _longs(row.rows), _longs(row.labels)
        self.vectors = np.frombuffer(row.vectors, _small(index)).reshape(row.n, -1)
        self.lo, self.hi, self.there = (_longs(x).reshape(row.n, -1) for x in (row.lo, row.hi, row.there))
        self.square = (self.vectors.astype(np.int64) ** 2).sum(1)

    def apart(self, score: np.ndarray, index: Index) -> np.ndarray:
        """The distance at which a vector has a score."""
        return np.sqrt(np.maximum(self.square + index.radius2 - 2.0 * score, 0))

    def start(self, index: Index) -> np.ndarray:
        """Where a query's search begins: nothing nearer is low enough."""
        open_slots = self.lo <= self.hi
        return self.apart(np.where(open_slots, self.hi, -index.radius2 - 1).max(1).clip(-index.radius2 - 1, index.radius2), index)

    def reach(self, index: Index, rings: float) -> np.ndarray:
        return np.where((self.lo <= self.hi).any(1), self.start(index) + rings * index.width, -np.inf)

    def needed(self, index: Index, rings: float | None) -> np.ndarray:
        """Which (pivot, ring) a search of this reach scans: for some query a vector there may be within reach, and not too near."""
        total = int(2 * index.radius2**0.5 / index.width) + 2
        if rings is None:
            return np.zeros((len(index.pivots), total), bool)
        own = index.distances(self.vectors, np.zeros(self.n))
        low = np.arange(total) * index.width
        out = np.zeros((len(index.pivots), total), bool)
        start, reach, slack = self.start(index)[:, None], self.reach(index, rings)[:, None], index.slack()
        for p in range(len(index.pivots)):
            d = own[:, p : p + 1]
            gap = np.maximum(np.maximum(low - d, d - low - index.width), 0)
            out[p] = ((gap <= reach + slack) & (d + low + index.width >= start - slack)).any(0)
        return out

    def unseen(self, index: Index, rings: float) -> np.ndarray:
        """A bound on the scores of all that a search of this reach hasn't scanned, but for what is too near."""
        reach = np.maximum(self.start(index) + rings * index.width - 2 * index.slack(), 0)
        bound = (self.square + index.radius2 - reach**2) / 2 + 1e-6 * max(1, index.radius2)
        return np.where(reach > 2 * index.radius2**0.5 + index.slack(), -np.inf, bound)


class _Best:
    """The best candidates of a chunk so far, ``k`` of each query and slot."""

    def __init__(self, queries: _Queries, k: int, kind: np.dtype) -> None:
        self.queries, self.k, self.parts, self.many = queries, k, [], 0
        self.last = np.full(queries.lo.shape, -(2**62), np.int64)
        self.matrix = queries.vectors.astype(kind)

    def add(self, slot: int, query: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        self.parts.append((query * self.last.shape[1] + slot, score.astype(np.int64), ids, rows))
        self.many += len(query)
        if self.many > 4 * self.k * self.last.size + 100_000:
            self.shrink()

    def shrink(self) -> None:
        place, score, ids, rows = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((rows, ids, -score, place))
        place, score, ids, rows = place[order], score[order], ids[order], rows[order]
        rank = np.arange(len(place)) - np.searchsorted(place, place)
        full = place[rank == self.k - 1]
        self.last.reshape(-1)[full] = score[rank == self.k - 1]
        keep = rank < self.k
        self.parts, self.many = [(place[keep], score[keep], ids[keep], rows[keep])], int(keep.sum())


FOUND = "chunk long, row long, slot int, other_row long, other_id long, score long"


def _meeting(index: Index, k: int, same_label: bool):
    """Chunks and cells as products of matrices; a task gives its best candidates of each query and slot."""
    kind = np.dtype("f4" if index.radius2 < 2**24 else "f8" if index.radius2 < 2**53 else "i8")

    def given(chunk: int, best: _Best) -> pd.DataFrame:
        best.shrink()
        place, score, ids, rows = best.parts[0]
        slots = best.last.shape[1]
        return pd.DataFrame({"chunk": chunk, "row": best.queries.rows[place // slots], "slot": place % slots, "other_row": rows, "other_id": ids, "score": score})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, _Best] = {}
        for batch in batches:
            for r in batch.itertuples():
                if r.chunk not in held:
                    if len(held) >= 8:
                        chunk = next(iter(held))
                        if (best := held.pop(chunk)).parts:
                            yield given(chunk, best)
                    held[r.chunk] = _Best(_Queries(r, index), k, kind)
                best = held[r.chunk]
                q = best.queries
                ids, rows, labels = _longs(r.cell_ids), _longs(r.cell_rows), _longs(r.cell_labels)
                scores = best.matrix @ np.frombuffer(r.cell_vectors, _small(index)).reshape(r.cell_n, -1).astype(kind).T
                fits = (q.labels[:, None] == labels) & (q.rows[:, None] != rows) if same_label else q.labels[:, None] != labels
                bound = lambda x: x.clip(-index.radius2 - 1, index.radius2 + 1).astype(kind)[:, None]
                for slot in range(best.last.shape[1]):
                    lo, hi = np.maximum(q.lo[:, slot], best.last[:, slot]), q.hi[:, slot]
                    able = fits & (scores >= bound(lo)) & (scores <= bound(hi)) & (q.lo[:, slot] <= hi)[:, None]
                    if able.shape[1] > k and able.sum() > 2 * k * q.n:  # what k others of this cell exceed can go at once
                        kept = np.where(able, scores, -index.radius2 - 2)
                        able &= scores >= np.partition(kept, -k, axis=1)[:, -k][:, None]
                    a, b = np.nonzero(able)
                    if len(a):
                        best.add(slot, a, scores[a, b], ids[b], rows[b])
        for chunk, best in held.items():
            if best.parts:
                yield given(chunk, best)

    return run


def search(index: Index, cell_table: DataFrame, asked: DataFrame, k: int, same_label: bool) -> DataFrame:
    """The ``k`` best rows for every query and slot of ``asked``, and their ranks: intervals of keys are widened until every chunk is certified.

    The driver gets a number of chunks a round, of at most four rounds: the last one reaches every ring.
    """
    order = [F.desc("score"), F.asc("other_id"), F.asc("other_row")]
    best_first = Window.partitionBy("chunk", "row", "slot").orderBy(*order)
    renamed = cell_table.select("pivot", "ring", *(F.col(c).alias(f"cell_{c}") for c in ("n", "ids", "rows", "labels", "vectors")))
    found, pending, former = None, asked, None
    for rings in (2, 6, 14, RINGS + 3):

        def pairs(batches: Iterator[pd.DataFrame], rings=rings, former=former) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for r in batch.itertuples():
                    q = _Queries(r, index)
                    pivot, ring = np.nonzero(q.needed(index, rings) & ~q.needed(index, former))
                    yield pd.DataFrame({"chunk": r.chunk, "pivot": pivot, "ring": ring})

        met = pending.mapInPandas(pairs, "chunk long, pivot int, ring int").join(renamed, ["pivot", "ring"]).join(pending, "chunk")
        new = met.mapInPandas(_meeting(index, k, same_label), FOUND)
        every = new if found is None else new.unionByName(found.select(new.columns))
        found = stored(every.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k), "found")

        def uncertain(batches: Iterator[pd.DataFrame], rings=rings) -> Iterator[pd.DataFrame]:
            for batch in batches:
                open_chunks = []
                for r in batch.itertuples():
                    q = _Queries(r, index)
                    place = {row: at for at, row in enumerate(q.rows.tolist())}
                    n, last = np.zeros(q.lo.shape, np.int64), np.zeros(q.lo.shape)
                    for x in r.results if r.results is not None else ():
                        n[place[x["row"]], x["slot"]], last[place[x["row"]], x["slot"]] = x["n"], x["last"]
                    unseen = q.unseen(index, rings)[:, None]
                    done = (q.lo > q.hi) | (n >= q.there) | (q.lo > unseen) | (n >= k) & (last > unseen)
                    if not done.all():
                        open_chunks.append(r.chunk)
                yield pd.DataFrame({"chunk": np.array(open_chunks, np.int64)})

        so_far = found.groupBy("chunk", "row", "slot").agg(F.count("*").alias("n"), F.min("score").alias("last")).groupBy("chunk").agg(F.collect_list(F.struct("row", "slot", "n", "last")).alias("results"))
        left = stored(pending.join(so_far, "chunk", "left").mapInPandas(uncertain, "chunk long"), "uncertain")
        former = rings
        if not left.count():
            break
        pending = pending.join(left, "chunk", "left_semi")
    return found


def hard_negatives(table: DataFrame, *, anchors: str = "vec_id % 100 = 0", positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, cell: int = CELL, chunk: int = CHUNK) -> DataFrame:
    """For each anchor and each of its best ``positives`` of the same label, the best ``negatives`` of other labels whose score is ``least`` to ``most`` per cent of the positive's."""
    spark = table.sparkSession
    small_batches(spark)
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    with discarding(spark) as keep:
        vectors = stored(integer_vectors(table), "integer-vectors")
        index = fit(vectors)
        if index is None:
            return spark.createDataFrame([], out)
        if index.radius2 >= 2**55:
            raise ValueError("squares of integer vectors must be below 2 ** 55")
        keys = stored(keyed(vectors, index), "keys")
        cell_table = stored(cells(keys, index.size, cell), "cells")
        asked = stored(chunks(keys.where(F.col("vec_id") != NO_ID), anchors, chunk), "chunks")
        per_label = stored(keys.groupBy("label").agg(F.count("*").alias("n")), "labels")

        def slots(n_slots: int, of):
            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    made = []
                    for r in batch.itertuples():
                        lo, hi, there = np.full((r.n, n_slots), 1, np.int64), np.zeros((r.n, n_slots), np.int64), np.full((r.n, n_slots), NO_ID, np.int64)
                        of({row: at for at, row in enumerate(_longs(r.rows).tolist())}, r.facts if r.facts is not None else (), lo, hi, there)
                        made.append([x.tobytes() for x in (lo, hi, there)])
                    yield batch.drop(columns="facts").assign(**{c: [x[k] for x in made] for k, c in enumerate(("lo", "hi", "there"))})

            return run

        def any_score(place: dict, facts, lo, hi, there) -> None:
            lo[:], hi[:] = -(2**60), 2**60
            for x in facts:
                there[place[x["row"]]] = x["n"] - 1

        def below(place: dict, facts, lo, hi, there) -> None:
            for x in facts:
                at = place[x["row"]], x["rank"] - 1
                lo[at], hi[at] = -(-least * x["score"] // 100), most * x["score"] // 100

        schema = f"chunk long, {VECTORS}, {SLOTS}"

        def with_slots(facts: DataFrame, n_slots: int, of) -> DataFrame:
            each = facts.groupBy("chunk").agg(F.collect_list(F.struct(*(c for c in facts.columns if c != "chunk"))).alias("facts"))
            return asked.join(each, "chunk", "left").mapInPandas(slots(n_slots, of), schema)

        def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for r in batch.itertuples():
                    yield pd.DataFrame({"chunk": r.chunk, "row": _longs(r.rows), "vec_id": _longs(r.ids), "label": _longs(r.labels)})

        queries = stored(asked.select("chunk", "n", "rows", "ids", "labels").mapInPandas(members, "chunk long, row long, vec_id long, label long"), "queries")
        near = search(index, cell_table, stored(with_slots(queries.join(per_label, "label").select("chunk", "row", "n"), 1, any_score), "asked-positives"), positives, True)
        far = search(index, cell_table, stored(with_slots(near.select("chunk", "row", "rank", "score"), positives, below), "asked-negatives"), negatives, False)
        known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))  # noqa: E731  a null vec_id is null again
        pairs = near.select("row", (F.col("rank") - 1).alias("slot"), known("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
        result = far.select("row", "slot", "rank", known("other_id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, ["row", "slot"]).join(queries.select("row", F.col("vec_id").alias("anchor_id")), "row")
        return keep(result.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "hard-negatives")
