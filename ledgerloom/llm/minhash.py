"""Near-duplicates by bottom-k sketches from one hash function.

A document's set is its distinct five-word shingles as 64-bit hashes; its
sketch is the ``k`` smallest, of which the ``listed`` smallest are put in
inverted lists. Documents with the same set are one node.

1. Star round: every node of a list is compared with two hubs, the list's
   smallest set and the one that has the most values in lists of about this length.
   Where a list's nodes have only a passage in common, any two that are near
   each other are near the smallest, too; where they are changed copies of one
   text, that text has the most values in common with all.
2. Cross round, only between nodes that are not connected yet, in the rarest
   lists of each node: near nodes share one of them. In lists of at most
   ``short`` nodes all pairs are compared by a join. Longer ones are dealt into
   blocks, and in each pair of blocks all sketches and sets are compared as bits, but
   for the list's largest component with itself. This is done twice: pairs that
   look nearest are verified first, then all that are still not connected. No
   pair is left out; the work grows with the square of the nodes of a list that
   are not connected.

A pair goes on if the estimate from the sketch of the union allows the
threshold, and is a link if the full sets reach it. Two sets at the threshold
retain no common value with a probability of 0.25 to the power ``listed``.
Components of links are all that is returned, so links inside a component need
not be listed.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.components import components
from ledgerloom.llm.scratch import discarding, row_number, small_batches, stored
from ledgerloom.llm.words import mixed, word_hashes

SIGNATURE = "row long, doc_id long, n_shingles long, digest binary, sketch array<long>, marks binary, bits binary"
#: Bits for a whole set, and for a sketch while blocks are compared.
_SET_BITS, _SKETCH_BITS = 2048, 512


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct word shingles; one for all words where there are fewer, none without words."""
    w = word_hashes(text)
    if not len(w):
        return w
    n = min(words, len(w))
    acc = w[: len(w) - n + 1].copy()
    for k in range(1, n):
        acc ^= acc >> np.uint64(29)
        acc *= np.uint64(0x9E3779B97F4A7C15)
        acc += w[k : len(w) - n + 1 + k]
    return np.unique(mixed(acc + np.uint64(n)))


def _bits(s: np.ndarray, size: int) -> bytes:
    """A set as bits, by the low bits of its hashes; empty for sets that would fill most of them."""
    flags = np.zeros(size if len(s) <= size // 2 else 0, bool)
    if len(flags):
        flags[s & np.uint64(size - 1)] = True
    return np.packbits(flags).tobytes()


def signatures(docs: DataFrame, words: int, k: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                s = shingle_set(text, words)
                sketch = (s[:k] ^ np.uint64(1 << 63)).view(np.int64)  # in the order of the unsigned values
                out.append((row, doc_id, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None, sketch, _bits(s[:k], _SKETCH_BITS), _bits(s, _SET_BITS)))
                row += 1
            yield pd.DataFrame(out, columns=["row", "doc_id", "n_shingles", "digest", "sketch", "marks", "bits"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, SIGNATURE)


def least_common(k: int, percent: int) -> int:
    """How many of the k smallest values of a union both sets have at least, where they are linked."""
    return max(1, round(k * percent / 100 - 5.6 * (k * percent * (100 - percent)) ** 0.5 / 100))


def may_link(n1: Column, n2: Column, s1: Column, s2: Column, k: int, percent: int) -> Column:
    """Whether sizes and the sketch of the union allow a link: at 75 percent and k = 64 a link is missed with a probability below 1e-6."""
    union = F.slice(F.array_sort(F.array_union(s1, s2)), 1, k)
    both = F.size(F.array_intersect(F.array_intersect(s1, s2), union))
    least = least_common(k, percent)
    return (n1 * 100 >= n2 * percent) & (n2 * 100 >= n1 * percent) & (both * k >= least * F.size(union))


def full_sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, whole): the whole sets of ``nodes`` (node), from the rows of ``docs`` that they are; other texts are not hashed again."""
    numbered = docs.select(row_number().alias("own_row"), F.col("text").cast("string").alias("text"))
    texts = numbered.join(nodes, F.col("own_row") == F.col("node")).select("node", "text")

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"node": batch["node"], "whole": [shingle_set(text, words).tobytes() for text in batch["text"]]})

    return stored(texts.mapInPandas(build, "node long, whole binary"), "sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets reach the threshold."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(sets.select(F.col("node").alias("b"), F.col("whole").alias("y")), "b")
    joined = left.join(sets.select(F.col("node").alias("a"), F.col("whole").alias("x")), "a")
    return stored(joined.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"), "links")


def _shared_at_least() -> Column:
    """How many of a node's listed values are in lists of another node, where they are linked: 10 of 32."""
    return F.greatest(F.lit(1), F.floor(F.col("listed") * 10 / 32))


def _rarest(postings: DataFrame) -> DataFrame:
    """The entries in a node's rarest lists: two nodes that share 10 of 32 listed values share one of the 23 rarest."""
    place = F.row_number().over(Window.partitionBy("node").orderBy("n", "value"))
    return postings.withColumn("place", place).where(F.col("place") <= F.col("listed") - _shared_at_least() + 1).select("value", "node")


def _hubs(*more: str) -> list[Column]:
    """The two nodes of a list that all others are compared with."""
    return [F.min(F.struct("n_shingles", "node", *more)).alias("small"), F.max(F.struct("shared", "copies", (-F.col("node")).alias("rank"), "node", "n_shingles", *more)).alias("central")]


def _cross(entries: DataFrame, nodes: DataFrame, roots: DataFrame, percent: int, k: int, short: int, best: bool) -> DataFrame:
    """Pairs (a, b) of unconnected nodes to compare: with ``best`` those that look nearest in long lists, without it all that sizes and sketches allow."""
    sizes = nodes.select("node", "n_shingles").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    level = stored(entries.join(sizes, "node"), "level")
    lists = level.groupBy("value").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    level = stored(level.join(lists.select("value", "n"), "value"), "level-lists")
    x, y = (level.where(F.col("n") <= short).select("value", *(F.col(c).alias(f"{c}_{side}") for c in ("node", "n_shingles", "root"))) for side in "xy")
    near = (F.col("n_shingles_x") * 100 >= F.col("n_shingles_y") * percent) & (F.col("n_shingles_y") * 100 >= F.col("n_shingles_x") * percent)
    found = x.join(y, "value").where((F.col("node_x") < F.col("node_y")) & (F.col("root_x") != F.col("root_y")) & near).select(F.col("node_x").alias("a"), F.col("node_y").alias("b"))
    hot = level.where(F.col("n") > short)
    if hot.isEmpty():
        return (found.limit(0) if best else found).distinct()
    blocks = _block_pairs(hot, nodes, percent, k, best)
    return (blocks if best else found.union(blocks)).distinct()


def _dealt(hot: DataFrame, percent: int, block: int) -> DataFrame:
    """(node, root, n_shingles, class, own, block): the nodes of long lists, each in one block of about ``block``.

    A block is of one size class; large components (``own``) and the nodes whose
    longest list is long have blocks of their own, so that few blocks meet.
    """
    size_class = F.floor(F.log("n_shingles") / float(np.log(100 / percent) + 1e-9))  # sizes that allow a link are less than one class apart
    members = stored(hot.groupBy("node", "root", "n_shingles").agg(F.max_by("value", F.struct("n", "value")).alias("main")).withColumn("class", size_class), "hot-nodes")
    large = members.groupBy("root").agg(F.count("*").alias("n_root")).where(F.col("n_root") >= block // 8).select("root", F.col("root").alias("own"))
    place = ["class", "own", "main"]
    placed = members.join(large, "root", "left").withColumn("own", F.coalesce("own", F.lit(-1))).withColumn("main", F.col("main").cast("string"))
    mains = placed.groupBy(*place).agg(F.count("*").alias("n_main")).where(F.col("n_main") >= block // 4)
    placed = placed.join(mains, place, "left").withColumn("main", F.when(F.col("n_main").isNull(), "").otherwise(F.col("main")))
    placed = placed.join(placed.groupBy(*place).agg(F.ceil(F.count("*") / block).alias("salts")), place)
    return stored(placed.select("node", "root", "n_shingles", "class", "own", F.xxhash64(*place, F.pmod(F.xxhash64("node"), F.col("salts"))).alias("block")), "dealt")


def _block_pairs(hot: DataFrame, nodes: DataFrame, percent: int, k: int, best: bool, block: int = 4096) -> DataFrame:
    """Pairs (a, b) of unconnected nodes of long lists (value, node, n_shingles, root, n) that sizes, sketches and bits allow; with ``best`` the nearest of each node.

    Each node is in one block, however many lists it is in. Two blocks are
    compared if they have a list in common; blocks of one large component are not
    compared with each other. A row is a pair of blocks, so rows stay few and
    tasks even.
    """
    dealt = _dealt(hot, percent, block)
    met = stored(hot.select("value", "node").join(dealt, "node").select("value", "block", "class", "own").distinct(), "met")
    x, y = (met.select("value", *(F.col(c).alias(f"{c}_{side}") for c in ("block", "class", "own"))) for side in "xy")
    apart = (F.col("own_x") != F.col("own_y")) | (F.col("own_x") < 0)
    two = x.join(y, "value").where((F.col("block_x") <= F.col("block_y")) & (F.abs(F.col("class_x") - F.col("class_y")) <= 1) & apart).select(F.col("block_x").alias("l"), F.col("block_y").alias("r")).distinct()
    member = F.struct("node", "root", "n_shingles", F.least(F.size("sketch"), F.lit(k)).alias("held"), "marks", "bits")
    blocks = stored(dealt.select("node", "root", "block").join(nodes, "node").groupBy("block").agg(F.collect_list(member).alias("members")), "blocks")
    side = lambda x: blocks.select(F.col("block").alias(x), F.col("members").alias(f"members_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros((2, 0), np.int64)]
            for own, other in zip(batch.column("members_l"), batch.column("members_r"), strict=True):
                own, other = _unpacked(own.values), _unpacked(other.values)
                found += [_allowed(_part(own, a), _part(other, b), percent, k, best) for a in range(0, len(own["node"]), 512) for b in range(0, len(other["node"]), 512)]
            out = np.unique(np.concatenate(found, axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1])], ["a", "b"])

    return stored(two.join(side("r"), "r").join(side("l"), "l").select("members_l", "members_r").mapInArrow(run, "a long, b long"), "block-pairs")


def _unpacked(members: pa.StructArray) -> dict[str, np.ndarray]:
    """A block's members: node, root and size, and the bits of sketch and set, each with how many of its values share another's bit."""
    out = {c: members.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("node", "root", "n_shingles", "held")}
    for c, n, size in (("marks", out["held"], _SKETCH_BITS), ("bits", out["n_shingles"], _SET_BITS)):
        rows = np.frombuffer(b"".join(x or b"\xff" * (size // 8) for x in members.field(c).to_pylist()), np.uint64).reshape(len(members), -1)
        out |= {c: rows, f"{c}_lost": np.where(n > size // 2, n, n - np.bitwise_count(rows).sum(axis=1, dtype=np.int64))}
    return out


def _part(members: dict[str, np.ndarray], at: int) -> dict[str, np.ndarray]:
    return {c: x[at : at + 512] for c, x in members.items()}


def _allowed(x: dict[str, np.ndarray], y: dict[str, np.ndarray], percent: int, k: int, best: bool) -> np.ndarray:
    """The pairs of two blocks' nodes that may be linked: no bound here is below the number of common values."""
    n, m = x["n_shingles"][:, None], y["n_shingles"][None, :]
    may = (x["root"][:, None] != y["root"][None, :]) & (n * 100 >= m * percent) & (m * 100 >= n * percent)
    if not may.any():
        return np.zeros((2, 0), np.int64)
    both = np.zeros(may.shape, np.uint8)
    for w in range(x["marks"].shape[1]):
        both += np.bitwise_count(x["marks"][:, w, None] & y["marks"][None, :, w])
    both = both + np.minimum(x["marks_lost"][:, None], y["marks_lost"][None, :])
    may &= both * k >= least_common(k, percent) * np.minimum(k, x["held"][:, None] + y["held"][None, :] - both)
    i, j = np.nonzero(may)
    shared = np.concatenate([np.zeros(0, np.int64), *(np.bitwise_count(x["bits"][i[c : c + 4096]] & y["bits"][j[c : c + 4096]]).sum(axis=1, dtype=np.int64) for c in range(0, len(i), 4096))])
    n, m = x["n_shingles"][i], y["n_shingles"][j]
    shared = np.minimum(np.minimum(n, m), shared + np.minimum(x["bits_lost"][i], y["bits_lost"][j]))
    keep = 100 * shared >= percent * (n + m - shared)
    i, j, score = i[keep], j[keep], (shared / (n + m - shared) + both[i, j] / 1000)[keep]
    if best and len(i):
        order = np.argsort(-score, kind="stable")
        i, j = i[order], j[order]
        first = np.union1d(np.unique(i, return_index=True)[1], np.unique(j, return_index=True)[1])
        i, j = i[first], j[first]
    a, b = x["node"][i], y["node"][j]
    return np.stack([np.minimum(a, b), np.maximum(a, b)])


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 75, k: int = 64, listed: int = 32, short: int = 16) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_shingles, component_id, kept, stays and row.

    ``component_id`` is the smallest doc_id that links reach, ``kept`` whether
    it is the row's own; ``stays`` is true for one row of each component, also where
    doc_ids repeat; ``row`` is ``row_number``. A text that is
    null, empty or only white space has no set and stays alone. Rows with equal
    sets are linked; rows that are wholly alike share their component. A null
    doc_id counts after all others. An empty table gives no rows; columns other
    than doc_id and text are not read.
    """
    small_batches(docs.sparkSession)
    with discarding(docs.sparkSession) as keep:
        docs = docs.select("doc_id", "text")
        signed = stored(signatures(docs, words, k), "signatures")
        chosen = F.min_by(F.struct("n_shingles", "sketch", "marks", "bits"), "row")
        nodes = signed.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("row").alias("node"), F.count("*").alias("copies"), chosen.alias("x"))
        nodes = stored(nodes.select("node", "digest", "copies", "x.*"), "nodes")

        values = nodes.select("node", "n_shingles", "copies", F.least(F.size("sketch"), F.lit(listed)).alias("listed"), F.explode(F.slice("sketch", 1, listed)).alias("value"))
        lists = stored(values.groupBy("value").agg(F.count("*").alias("n")).where("n > 1"), "lists")
        entries = values.join(lists, "value")
        lengths = entries.groupBy("node", "listed").agg(F.collect_list(F.log2("n").cast("tinyint")).alias("lengths"))
        active = lengths.where(F.size("lengths") >= _shared_at_least()).drop("listed")
        shared = F.size(F.filter("lengths", lambda c: F.abs(c - F.log2("n").cast("tinyint")) <= 1))
        postings = stored(entries.join(active, "node").withColumn("shared", shared).drop("lengths"), "postings")
        sets = full_sets(docs, stored(postings.select("node").distinct(), "active"), words)
        brief = nodes.select("node", "n_shingles", "sketch")
        a, b = (brief.toDF(x, f"n_shingles_{x}", f"sketch_{x}") for x in ("a", "b"))
        allowed = may_link(F.col("n_shingles_a"), F.col("n_shingles_b"), F.col("sketch_a"), F.col("sketch_b"), k, percent)
        promising = lambda pairs, name: stored(pairs.join(b, "b").join(a, "a").where(allowed).select("a", "b"), name)
        hubs = postings.groupBy("value").agg(*_hubs()).select("value", F.explode(F.array_distinct(F.array("small.node", "central.node"))).alias("hub"))
        star = postings.select("value", "node").join(hubs, "value").where("node <> hub").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
        links = verified(promising(star, "star-pairs"), sets, percent)
        roots = components(links)

        rarest = stored(_rarest(postings), "rarest")
        for best in (True, False):  # what looks nearest first: most of the others are connected then
            cross = promising(_cross(rarest, nodes, roots, percent, k, short, best), "cross-pairs")
            if not cross.isEmpty():
                links = links.union(verified(cross, sets, percent))
                roots = components(links)

        owners = signed.join(nodes.select("digest", "node"), "digest", "left").join(roots, "node", "left")
        owners = keep(owners.select("row", "doc_id", "n_shingles", F.coalesce("root", "node").alias("root")), "owners")
        smallest = keep(owners.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))["row"].alias("first_row")), "smallest")
    alone = F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return owners.join(smallest, "root", "left").select("doc_id", "n_shingles", alone.alias("component_id"), alone.eqNullSafe(F.col("doc_id")).alias("kept"), F.coalesce(F.col("row") == F.col("first_row"), F.lit(True)).alias("stays"), "row")
