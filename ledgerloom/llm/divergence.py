"""Which terms and which sources set a source apart from its language.

Every language keeps the terms that are in at least ``least_documents`` of its
documents. A (lang, source) group and the language give each kept term a smoothed
share in billionths, and ``(p - q) ** 2 / q``, rounded down, tells how far the
group's share p lies from another share q. All arithmetic is exact.

Terms: every group has buckets of terms whose counts are alike. Among the terms of
a bucket the lowest share in the language bounds what any of them can reach. The
buckets with the highest bounds are evaluated until they hold enough terms; the
last rank so far then decides which other buckets could still matter, and buckets
whose bound is strictly below it are never read. Ranks come from what was evaluated.

Pairs: a term's posting lists the sources that have it, in blocks, so that a
posting with any number of sources is dealt over tasks. A pair's sum over all kept
terms is what it would be if no source had any term, corrected by each source's
own terms alone, and then by the terms both have, which postings give.

Edge cases: null text, lang and source are empty strings; empty texts, and groups
without kept terms, still are groups, and have pairs; equal values rank by the term
or source in UTF-8 order; rows that are wholly alike all count; an empty table
gives no rows; columns other than the three that are named are not read.
"""

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import discarding, small_batches, stored

#: Letters of ASCII, and any code point beyond it, in UTF-8.
_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
#: Counters of a task before they are given out.
_MOST_COUNTERS = 200_000
#: Sources of a block of a posting, pairs worked out at once, and pairs summed in a task before they are given out.
BLOCK, _AT_ONCE, _MOST_PAIRS = 256, 1 << 20, 1 << 18
UNIT = 1_000_000_000


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, count, documents``: partial sums, and a row with a null term for every group that a task has met."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("count", pa.int64()), ("documents", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], Counter] = defaultdict(Counter)
        within: dict[tuple[str, str], Counter] = defaultdict(Counter)

        def given() -> Iterator[pa.RecordBatch]:
            for group, own in counts.items():
                terms = pa.array([None, *own], pa.binary()).cast(pa.string())
                n, held = [0, *own.values()], [0, *map(within[group].__getitem__, own)]
                yield pa.RecordBatch.from_arrays([pa.repeat(group[0], len(n)), pa.repeat(group[1], len(n)), terms, pa.array(n, pa.int64()), pa.array(held, pa.int64())], schema=schema)
            counts.clear()
            within.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                found = _TERM.findall(text.encode().lower())
                counts[lang, source].update(found)
                within[lang, source].update(set(found))
            if sum(map(len, counts.values())) >= _MOST_COUNTERS:
                yield from given()
        yield from given()

    chosen = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return chosen.mapInArrow(run, "lang string, source string, term string, count long, documents long")


def _share(count: str, total: str, terms: str) -> Column:
    """``1 + floor(UNIT * (count + 1) / (total + terms))``; the product is a decimal, so that no count is too large."""
    return F.expr(f"1 + (CAST({UNIT} AS DECIMAL(10, 0)) * CAST({count} + 1 AS DECIMAL(19, 0))) div CAST({total} + {terms} AS DECIMAL(19, 0))")


def _distance(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def kept_terms(docs: DataFrame, least_documents: int) -> DataFrame:
    """``lang, source, term, count, lang_count, first``: the kept terms of every group, ``first`` once a language and term; and the groups themselves, under a null term."""
    summed = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("documents").alias("documents"))
    of_term = Window.partitionBy("lang", "term")
    told = summed.withColumns({"lang_count": F.sum("count").over(of_term), "held": F.sum("documents").over(of_term), "least": F.min("source").over(of_term)})
    kept = told.where(F.col("term").isNull() | (F.col("held") >= least_documents))
    return kept.select("lang", "source", "term", "count", "lang_count", (F.col("term").isNotNull() & (F.col("source") == F.col("least"))).alias("first"))


def groups_of(kept: DataFrame) -> DataFrame:
    """A row per group: its number in its language, its total and its share of a term that it hasn't, with the language's total, terms and sources."""
    langs = kept.groupBy("lang").agg(F.sum("count").alias("lang_total"), F.count_if("first").alias("terms"))
    own = kept.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    numbered = own.join(langs, "lang").withColumns({"no": (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("int"), "sources": F.count("*").over(Window.partitionBy("lang"))})
    return numbered.withColumn("zero", F.when(F.col("terms") > 0, _share("0", "total", "terms")))


def top_terms(shares: DataFrame, most: int) -> DataFrame:
    """The ``most`` terms of each group whose share exceeds the language's, by distance."""
    own, ordered = ["lang", "source"], Window.partitionBy("lang", "source")
    alike = F.when(F.col("count") < 32, F.col("count")).otherwise(32 + F.floor(16 * F.log2("count"))).cast("int")
    above = shares.where("p > q").select(*own, "term", "p", "q", alike.alias("bucket"))
    extremes = above.groupBy(*own, "bucket").agg(F.max("p").alias("most_p"), F.min("q").alias("least_q"), F.count("*").alias("n"))
    bounded = extremes.select(*own, "bucket", "n", _distance("most_p", "least_q").alias("bound"))
    before = F.coalesce(F.sum("n").over(ordered.orderBy(F.desc("bound"), "bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = stored(bounded.withColumn("at_once", before < most), "term-buckets")

    def ranked(chosen: DataFrame) -> DataFrame:
        values = above.join(chosen.select(*own, "bucket"), [*own, "bucket"], "left_semi").withColumn("value", _distance("p", "q"))
        return values.withColumn("rank", F.row_number().over(ordered.orderBy(F.desc("value"), "term"))).where(F.col("rank") <= most)

    last = stored(ranked(buckets.where("at_once")).where(F.col("rank") == most).select(*own, F.col("value").alias("last")), "last-ranks")
    open_still = F.col("at_once") | F.col("last").isNull() | (F.col("bound") >= F.col("last"))
    chosen = stored(buckets.join(last, own, "left").where(open_still), "open-buckets")
    return ranked(chosen).select(*own, F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")


def _far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


class _Sums:
    """Sums by (lang, source, other), given out when they are many."""

    def __init__(self) -> None:
        self.held: dict[tuple[str, int, int], int] = {}

    def add(self, lang: str, source: np.ndarray, other: np.ndarray, value: np.ndarray) -> None:
        if not len(source):
            return
        code = source.astype(np.int64) << 32 | other
        order = np.argsort(code, kind="stable")
        code, value = code[order], value[order]
        begin = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        for c, v in zip(code[begin].tolist(), np.add.reduceat(value, begin).tolist(), strict=True):
            key = lang, c >> 32, c & 0xFFFFFFFF
            self.held[key] = self.held.get(key, 0) + v

    def rows(self, least: int) -> Iterator[pd.DataFrame]:
        if len(self.held) > least:
            yield pd.DataFrame([(*k, v) for k, v in self.held.items()], columns=["lang", "no", "other_no", "value"])
            self.held.clear()


SUMS = "lang string, no int, other_no int, value long"


def _of_postings(batches: Iterator[pd.DataFrame], size: int, at_once: int) -> Iterator[pd.DataFrame]:
    """By how much two sources that both have a term depart from what each one's having it says."""
    sums = _Sums()
    for batch in batches:
        for (lang, cross), rows in batch.groupby(["lang", "cross"]):
            n = rows["no"].map(len).to_numpy()
            ends = np.cumsum(n * n)
            at = 0
            while at < len(rows):
                until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + at_once, "right")))
                part, m = rows.iloc[at:until], n[at:until]
                no, p, zero = (np.concatenate(part[c].to_list()).astype(np.int64) for c in ("no", "p", "zero"))
                each = np.repeat(m, m)
                left = np.repeat(np.arange(len(no)), each)
                right = np.repeat(np.repeat(np.cumsum(m) - m, m), each) + np.arange(len(left)) - np.repeat(np.cumsum(each) - each, each)
                two = no[left] // size != no[right] // size if cross else left != right
                a, b = left[two], right[two]
                sums.add(lang, no[a], no[b], _far(p[a], p[b]) - _far(p[a], zero[b]) - _far(zero[a], p[b]) + _far(zero[a], zero[b]))
                at = until
        yield from sums.rows(_MOST_PAIRS)
    yield from sums.rows(0)


def _of_one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """By how much the terms of one source alone change its sums with every source of a block, in both directions."""
    sums = _Sums()
    for batch in batches:
        for r in batch.itertuples():
            p, n, other, zeros = (np.asarray(x, np.int64) for x in (r.p, r.n, r.other_no, r.zeros))
            for a in range(0, len(p), step := max(1, _AT_ONCE // len(zeros))):
                part, many = p[a : a + step, None], n[a : a + step, None]
                no = np.full(len(other), r.no)
                sums.add(r.lang, no, other, (many * (_far(part, zeros) - _far(np.int64(r.zero), zeros))).sum(axis=0))
                sums.add(r.lang, other, no, (many * (_far(zeros, part) - _far(zeros, np.int64(r.zero)))).sum(axis=0))
        yield from sums.rows(_MOST_PAIRS)
    yield from sums.rows(0)


def source_pairs(shares: DataFrame, groups: DataFrame, size: int = BLOCK, at_once: int = _AT_ONCE) -> DataFrame:
    """Every source against every other of its language, over all kept terms; postings in blocks of ``size`` sources."""
    block = F.floor(F.col("no") / size).cast("int")
    blocks = F.ceil(F.col("sources") / size).cast("int")
    with_all = shares.select("lang", "term", "no", "p", "zero", block.alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("met"))
    cell = with_all.withColumns({"lo": F.least("block", "met"), "hi": F.greatest("block", "met")}).groupBy("lang", "term", "lo", "hi")
    postings = cell.agg(*(F.collect_list(c).alias(c) for c in ("no", "p", "zero"))).where(F.size("no") > 1)
    both = postings.select("lang", (F.col("lo") != F.col("hi")).alias("cross"), "no", "p", "zero").mapInPandas(lambda batches: _of_postings(batches, size, at_once), SUMS)
    counted = shares.groupBy("lang", "no", "zero", "p").agg(F.count("*").alias("n"))
    counted = counted.groupBy("lang", "no", "zero", F.pmod("p", F.lit(16)).alias("slice")).agg(F.collect_list("p").alias("p"), F.collect_list("n").alias("n"))
    zeros = groups.where("terms > 0").groupBy("lang", block.alias("block")).agg(F.collect_list("no").alias("other_no"), F.collect_list("zero").alias("zeros"))
    one = counted.join(zeros, "lang").drop("slice", "block").mapInPandas(_of_one, SUMS)
    sums = both.unionByName(one).groupBy("lang", "no", "other_no").agg(F.sum("value").alias("value"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("no").alias("other_no"), F.col("zero").alias("other_zero"))
    pairs = groups.join(other, "lang").where("no <> other_no").join(sums, ["lang", "no", "other_no"], "left")
    value = F.when(F.col("terms") > 0, F.col("terms") * _distance("zero", "other_zero") + F.coalesce("value", F.lit(0))).otherwise(0)
    valued = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    return valued.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def divergence(docs: DataFrame, *, least_documents: int = 3, most_terms: int = 200, block: int = BLOCK) -> DataFrame:
    """``lang, source, part, item, value, rank``: every other source of the language, and the ``most_terms`` terms that set the source apart."""
    spark = docs.sparkSession
    small_batches(spark)
    with discarding(spark) as keep:
        kept = stored(kept_terms(docs, least_documents), "kept-terms")
        groups = stored(groups_of(kept), "groups")
        joined = kept.where("term IS NOT NULL").join(groups, ["lang", "source"])
        shares = stored(joined.select("lang", "source", "term", "no", "count", "sources", "zero", _share("count", "total", "terms").alias("p"), _share("lang_count", "lang_total", "terms").alias("q")), "shares")
        return keep(source_pairs(shares, groups, block).unionByName(top_terms(shares, most_terms)), "divergence")
