"""Removal of repeated passages by hashing of units.

A unit is a whole line, and each of the parts into which a line is cut after
words whose hash is the smallest of its neighbourhood; so a passage gives the
same parts wherever it stands in a line, but for its first and last. Units are
normalised to their lower-case words and hashed, digests are grouped over the
whole table, and the occurrence with the smallest (doc_id, unit number) stays.
The others are repeats. Every repeated line is removed, however short. Repeated
parts that follow each other in a document form a run; runs of at least
``least_words`` words are removed, too, since a few words are common by chance.
Removed units that touch are one passage, with its offsets in the original text.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import discarding, row_number, small_batches, stored
from ledgerloom.llm.words import mixed, word_hashes

#: ``no`` and ``upto`` are the first and last part of a unit, ``at`` the number of words before it; ``line`` tells whole lines, of one part or more.
UNITS = "row long, doc_id long, no int, upto int, at int, start long, end long, words int, line boolean, digest long, check int"
#: Words to either side among which the last word of a unit has the smallest hash.
_REACH = 3


def unit_ends(hashes: np.ndarray, line_ends: np.ndarray) -> np.ndarray:
    """Whether each word ends a unit."""
    ends = np.zeros(len(hashes), bool)
    if len(hashes) > 2 * _REACH:
        inner = np.lib.stride_tricks.sliding_window_view(hashes, 2 * _REACH + 1)
        mid = inner[:, _REACH]
        ends[_REACH : len(hashes) - _REACH] = (mid < inner[:, _REACH + 1 :].min(axis=1)) & (mid <= inner[:, :_REACH].min(axis=1))
    ends |= line_ends
    ends[-1:] = True
    return ends


def text_units(text: str | None) -> tuple[np.ndarray, ...]:
    """Of each unit of a text: first and last part, words before it, start and end (code points), word count, whether it is a line, digest in two lanes. Lines of several parts come last."""
    hashes = word_hashes(text)
    if not len(hashes):
        return (*(np.zeros(0, np.int64),) * 6, np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int32))
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    space = (points == 32) | ((points >= 9) & (points <= 13))
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    lines = np.concatenate([[0], np.cumsum(points == 10)])
    line_ends = np.concatenate([lines[first[1:]] > lines[last[:-1]], [True]])
    stop, line_stop = np.flatnonzero(unit_ends(hashes, line_ends)), np.flatnonzero(line_ends)
    begin, line_begin = (np.concatenate([[0], s[:-1] + 1]) for s in (stop, line_stop))
    no, upto = np.searchsorted(begin, line_begin), np.searchsorted(stop, line_stop)
    whole = np.zeros(len(begin), bool)
    whole[no[no == upto]] = True
    more = no < upto
    parts = np.arange(len(begin))
    return (
        np.concatenate([parts, no[more]]), np.concatenate([parts, upto[more]]), np.concatenate([begin, line_begin[more]]), np.concatenate([first[begin], first[line_begin[more]]]), np.concatenate([last[stop], last[line_stop[more]]]),
        np.concatenate([stop - begin + 1, (line_stop - line_begin + 1)[more]]), np.concatenate([whole, np.ones(more.sum(), bool)]), *(np.concatenate([a, b[more]]) for a, b in zip(_digests(hashes, begin, stop), _digests(hashes, line_begin, line_stop), strict=True)),
    )


def _digests(hashes: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The digest of the words of each unit, in 96 bits: among 10 ** 12 units two that differ have the same one with a probability of 1e-5. Units follow each other without gaps."""
    words = stop - begin + 1
    place = mixed(hashes + (np.arange(len(hashes)) - np.repeat(begin, words)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    lanes = [mixed(np.add.reduceat(x, begin) + words.astype(np.uint64)) for x in (place, place ^ (hashes >> np.uint64(7)) * np.uint64(0xD6E8FEB86659FD93))]
    return lanes[0].view(np.int64), (lanes[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def units(docs: DataFrame) -> DataFrame:
    """A row per unit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            parts = [text_units(text) for text in batch["text"]]
            each = [len(p[0]) for p in parts]
            names = ["no", "upto", "at", "start", "end", "words", "line", "digest", "check"]
            columns = {c: np.concatenate(x) for c, x in zip(names, zip(*parts, strict=True), strict=True)} if parts else {c: np.zeros(0, np.int64) for c in names}
            ids = batch["doc_id"].astype("Int64").repeat(each).reset_index(drop=True)
            yield pd.DataFrame({"row": np.repeat(row + np.arange(len(each)), each), "doc_id": ids, **columns})
            row += len(each)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, UNITS)


def repeated_passages(docs: DataFrame, *, least_words: int = 20) -> DataFrame:
    """A row per removed passage: doc_id, start, end, n_words, n_units, kept_in and row.

    Offsets are code points of the original text, end exclusive; ``kept_in``
    has the doc_ids of the first occurrences, which stay; ``row`` is
    ``row_number``. A null or empty text has no units. Null doc_ids rank last;
    of rows with the same doc_id the first that was read ranks first, so of rows
    that are wholly alike one stays whole. An empty table gives no rows; columns
    other than doc_id and text are not read.
    """
    small_batches(docs.sparkSession)
    with discarding(docs.sparkSession) as keep:
        found = stored(units(docs), "units")
        rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "no", "upto")
        firsts = found.groupBy("digest", "check").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1")
        firsts = stored(firsts.select("digest", "check", F.col("first.doc_id").alias("first_id"), F.col("first.row").alias("first_row"), F.col("first.no").alias("first_no"), F.col("first.upto").alias("first_upto")), "first-units")
        repeats = keep(found.join(firsts, ["digest", "check"]).where("row <> first_row or no <> first_no or upto <> first_upto").drop("digest", "check", "first_row", "first_no", "first_upto"), "repeats")
    spans = ("row", "doc_id", "no", "upto", "at", "words", "start", "end")
    island = F.col("no") - F.row_number().over(Window.partitionBy("row").orderBy("no"))
    runs = repeats.where("no = upto").withColumn("island", island).groupBy("row", "island").agg(
        F.first("doc_id").alias("doc_id"), F.min("no").alias("no"), F.max("upto").alias("upto"), F.min("at").alias("at"), F.sum("words").cast("int").alias("words"),
        F.min("start").alias("start"), F.max("end").alias("end"), F.collect_set("first_id").alias("kept_in"),
    )
    lines = repeats.where("line").select(*spans, F.when(F.col("first_id").isNull(), F.array().cast("array<bigint>")).otherwise(F.array("first_id")).alias("kept_in"))
    removed = runs.where(F.col("words") >= least_words).select(*spans, "kept_in").union(lines)
    order = Window.partitionBy("row").orderBy("no", "upto")
    reach = F.max("upto").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = removed.withColumn("begins", F.coalesce(F.col("no") > reach + 1, F.lit(True)).cast("int")).withColumn("passage", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = apart.groupBy("row", "passage").agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("end").alias("end"), (F.max(F.col("at") + F.col("words")) - F.min("at")).cast("long").alias("n_words"),
        (F.max("upto") - F.min("no") + 1).cast("long").alias("n_units"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("kept_in")))).alias("kept_in"),
    )
    return whole.select("doc_id", "start", "end", "n_words", "n_units", "kept_in", "row")


def without_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``docs`` with the passages that ``repeated_passages`` found in them cut from their text.

    ``docs`` is the table, as it was read, that the passages were found in. A null
    text stays null; rows without passages stay as they are, repeated rows and null
    doc_ids included, since rows are told apart by their number; other columns,
    whatever their names, stay. An empty table gives no rows.
    """
    at = "_".join(["row", *docs.columns])  # no column has this name
    spans = passages.groupBy(F.col("row").alias("cut_row")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cut_spans"))
    own = docs.select(row_number().alias("own_row"), F.struct("*").alias(at)).join(spans, F.col("own_row") == F.col("cut_row"), "left")
    text = F.col(at)["text"].cast("string")
    edges = F.concat(F.array(F.lit(0).cast("bigint")), F.flatten(F.transform("cut_spans", lambda s: F.array(s["start"], s["end"]))), F.array(F.char_length(text).cast("bigint")))
    pieces = F.transform(F.sequence(F.lit(1), F.size(edges), F.lit(2)), lambda k: F.substring(text, (F.element_at(edges, k) + 1).cast("int"), (F.element_at(edges, k + 1) - F.element_at(edges, k)).cast("int")))
    out = {c: F.col(at)[c] for c in docs.columns} | {"text": F.when(F.size("cut_spans") > 0, F.concat_ws("", pieces)).otherwise(text)}
    return own.select(*(out[c].alias(c) for c in docs.columns))
