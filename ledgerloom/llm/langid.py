"""Language identification by rank-order profiles of character n-grams.

A profile is the list of a language's most frequent n-grams, most frequent
first. A document's distance to it is the sum, over the document's own most
frequent n-grams, of how far each is out of place, with ``size`` for one that
the profile lacks.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import per_process, row_number, small_batches, stored
from ledgerloom.operators.written import ranked as ranked_rows

UNKNOWN = "und"
#: Characters of a text that are coded at once.
_SLICE = 1_000_000
_GAP = np.uint64(ord("_"))


def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _points(text: str) -> Iterator[np.ndarray]:
    """The letters of a text in lower case, one underscore for each gap and one at either end, slice by slice."""
    is_letter = per_process("letters", _letters)
    low, last = text.lower(), None
    for at in range(0, len(low) + 1, _SLICE):
        points = np.frombuffer(low[at : at + _SLICE].encode("utf-32-le", "surrogatepass"), "<u4")
        points = np.where(is_letter[points], points, ord("_")).astype(np.uint64)
        begin, end = [_GAP] if not at else [], [_GAP] if at + _SLICE > len(low) else []
        points = np.concatenate([begin, points, end]).astype(np.uint64)
        before = np.concatenate([[0 if last is None else last], points[:-1]]).astype(np.uint64)
        points = points[(points != _GAP) | (before != _GAP)]
        last = points[-1] if len(points) else last
        yield points


def ngram_counts(text: str, orders: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text's lower-case words, an underscore for each gap, and how often each occurs.

    An n-gram of up to three characters is one number of 21 bits a character.
    Slices of a long text overlap by what the n-grams across their border need.
    """
    grams, counts, carry = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for points in _points(text):
        stream = np.concatenate([carry, points])
        parts = [points[points != _GAP]]
        for n in range(2, orders + 1):
            own = stream[max(0, len(carry) - n + 1) :]
            code = own[: max(0, len(own) - n + 1)]
            for k in range(1, n):
                code = (code << np.uint64(21)) | own[k : len(own) - n + 1 + k]
            parts.append(code)
        carry = stream[max(0, len(stream) - orders + 1) :]
        more, n_more = np.unique(np.concatenate(parts), return_counts=True)
        if not len(grams):
            grams, counts = more, n_more
        else:
            grams, back = np.unique(np.concatenate([grams, more]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, n_more])).astype(np.int64)
    return grams, counts


def ranked(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, ties by code."""
    if len(grams) > 4 * size:
        keep = counts >= np.partition(counts, len(counts) - size)[len(counts) - size]
        grams, counts = grams[keep], counts[keep]
    return grams[np.lexsort((grams, -counts))[:size]]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _labelled(docs: DataFrame) -> DataFrame:
    """(lang, text) of every row with a label and a text."""
    return docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Each n-gram of all parts once, its counts added up."""
    grams, back = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    counts = np.zeros(len(grams), np.int64)
    np.add.at(counts, back, np.concatenate([n for _, n in parts]))
    return grams, counts


def language_counts(batches: Iterator[pd.DataFrame], most: int = 1 << 20) -> Iterator[pd.DataFrame]:
    """(lang, gram, n) of all texts of the batches; an n-gram comes again where those of a task are many.

    About ``most`` n-grams and those of one text are held at a time, whatever the
    number of texts, languages and letters.
    """
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    n_held = 0

    def given() -> Iterator[pd.DataFrame]:
        for lang, parts in held.items():
            grams, counts = _merged(parts)
            yield pd.DataFrame({"lang": lang, "gram": grams.astype(np.int64), "n": counts})

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            part = ngram_counts(text)
            if not len(part[0]):
                continue
            held.setdefault(lang, []).append(part)
            n_held += len(part[0])
            if n_held > most:
                held = {lang: [_merged(parts)] for lang, parts in held.items()}
                n_held = sum(len(parts[0][0]) for parts in held.values())
                if n_held > most // 2:
                    yield from given()
                    held, n_held = {}, 0
    yield from given()


def learn(docs: DataFrame, *, size: int = 400) -> DataFrame:
    """Profiles (lang, place, gram) from all labelled rows of ``docs``.

    Every text is read whole and every label is learned; ties of n-grams go to the
    lesser code. Rows without a label or a text teach nothing; an empty table
    gives no profiles.
    """
    small_batches(docs.sparkSession)
    counted = _labelled(docs).mapInPandas(language_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counted.withColumn("place", place).where(F.col("place") <= size).select("lang", "place", "gram")


def predict(docs: DataFrame, profiles: DataFrame, *, size: int = 400) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``nearness``; only the text leaves the JVM.

    ``score`` is the share of the distance by which the best language beats the
    second (1 where only one was learned); ``nearness`` is 1 less the best
    distance over the greatest possible. A text that is null or has no letter
    is ``und`` with 0 for both, and so is every text if nothing was learned.
    Ties go to the first language by name. The driver gets the profiles, ``size`` rows a
    language. Empty tables give no rows; columns of
    ``docs`` with the names of the new ones are replaced, others are kept.
    """
    small_batches(docs.sparkSession)
    rows = sorted(profiles.collect(), key=lambda r: r["gram"])
    names = sorted({r["lang"] for r in rows})
    number = {name: k for k, name in enumerate(names)}
    known, of = np.unique(np.array([r["gram"] for r in rows], np.uint64), return_inverse=True)
    first = np.searchsorted(of, np.arange(len(known) + 1))
    held_by, held_at = np.array([number[r["lang"]] for r in rows], np.int64), np.array([r["place"] - 1 for r in rows], np.int64)

    def nearest(text: str | None) -> tuple[str, float, float]:
        grams, counts = ngram_counts(text) if isinstance(text, str) else (np.zeros(0, np.uint64),) * 2
        own = ranked(grams, counts, size)
        if not len(own) or not names or own.max() == _GAP:
            return UNKNOWN, 0.0, 0.0
        k = np.minimum(np.searchsorted(known, own), len(known) - 1)
        ranks = np.flatnonzero(known[k] == own)
        begin, n = first[k[ranks]], first[k[ranks] + 1] - first[k[ranks]]
        entries = np.arange(n.sum()) + np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        gain = np.bincount(held_by[entries], size - np.abs(held_at[entries] - np.repeat(ranks, n)), len(names))
        far = (size * len(own) - gain) / (size * len(own))
        best = int(far.argmin())
        second = np.delete(far, best).min() if len(far) > 1 else None
        score = 1.0 if second is None else float((second - far[best]) / second) if second else 0.0
        return names[best], score, float(1 - far[best])

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([nearest(t) for t in texts], columns=["lang_pred", "score", "nearness"])

    identify = F.pandas_udf(run, "lang_pred string, score double, nearness double").asNondeterministic()
    rest = docs.drop("lang_pred", "score", "nearness")
    name = "_".join(["found", *rest.columns])  # no column has this name
    return rest.withColumn(name, identify(F.col("text").cast("string"))).select(*(rest.columns), F.col(name)["lang_pred"].alias("lang_pred"), F.col(name)["score"].alias("score"), F.col(name)["nearness"].alias("nearness"))


def least_nearness(docs: DataFrame, profiles: DataFrame, *, share: float = 0.5) -> DataFrame:
    """(lang, bound): what texts found to be in a language keep well above, ``share`` of what 999 in 1000 of the labelled ``docs`` found to be in it reach.

    Every labelled row with a letter counts, and the percentile is exact, with the
    line between two neighbours; a language that no row is found to be in has no
    bound. Give it rows that the profiles were not learned from. Rows are ranked in
    ranges, however many a language has.
    """
    found = predict(_labelled(docs), profiles).where(F.col("lang_pred") != UNKNOWN)
    reached = stored(found.select(F.col("lang_pred").alias("lang"), "nearness"), "nearness")
    cuts = reached.groupBy("lang").agg((0.001 * (F.count("*") - 1)).alias("cut"))
    placed = ranked_rows(reached.select("lang", "nearness", row_number().alias("row")), ["lang"], [F.col("nearness"), F.col("row")])
    weight = 1 - F.abs(F.col("place") - 1 - F.col("cut"))
    beside = placed.join(F.broadcast(cuts), "lang").withColumn("weight", weight).where(F.col("weight") > 0)
    return beside.groupBy("lang").agg((share * F.sum(F.col("weight") * F.col("nearness"))).alias("bound"))
