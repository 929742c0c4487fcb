"""Thousands of ordered patterns as a table that names are joined to.

Each pattern is filed under a piece of text that any name it matches has to hold:
how the name begins, how it ends, one of its words (runs of ASCII letters and
digits), how a word begins or ends, or three letters of its longest literal. A name
meets the patterns under its own pieces only, and those are then tried in full. A
plan has the same size for any number of rules.
"""

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.compare import glob_pattern
from ledgerloom.operators.written import written

#: Letters of a beginning, an ending or a word that are filed, and of an inner piece.
MOST, GRAM = 24, 3
#: Bits a filed piece in the filter of pieces that occur, and how many longs the filter has at most (16 MB).
_BITS, _MOST_LONGS = 16, 1 << 21
#: As ``glob_pattern`` reads them: the first letter of a class can be a closing bracket.
_WILD = re.compile(r"\[(?:!.|[^!])[^\]]*\]|[*?\[]", re.DOTALL)
_WORD = "[A-Za-z0-9]+"


def _words(pieces: list[str]) -> list[tuple[str, str]]:
    """(kind, text) of the words of literals between wildcards; a word that a wildcard cuts off is known by its start or its stop."""
    found = []
    for k, piece in enumerate(pieces):
        for m in re.finditer(_WORD, piece):
            starts, stops = m.start() > 0 or k == 0, m.end() < len(piece) or k == len(pieces) - 1
            if starts:
                found.append(("word", m[0]) if stops and len(m[0]) <= MOST else ("start", m[0][:MOST]))
            elif stops:
                found.append(("stop", m[0][-MOST:]))
    return found


def _filed(glob: str) -> tuple[str, int, str]:
    """Kind, length and text of the piece that a glob is filed under: the longest, where the ends of a word count as letters."""
    pieces = _WILD.split(glob)
    inner = max(pieces, key=len)
    known = [("begin", pieces[0][:MOST], 0), ("end", pieces[-1][-MOST:] if len(pieces) > 1 else "", 0), *((kind, text, 2 if kind == "word" else 1) for kind, text in _words(pieces))]
    kind, piece, closed = max(known, key=lambda x: len(x[1]) + x[2])
    if len(piece) + closed < GRAM <= len(inner):
        kind, piece = "inner", inner[len(inner) // 2 - GRAM // 2 :][:GRAM] if len(inner) > GRAM else inner
    return (kind, len(piece), piece) if piece else ("any", 0, "")


def indexed(rules: DataFrame, pattern: str) -> DataFrame:
    """``rules`` with ``kind``, ``length`` and ``piece``, under which each glob is filed, and ``expression``, which tries it in full."""

    def run(globs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(*_filed(g), glob_pattern(g)) for g in globs], columns=["kind", "length", "piece", "expression"])

    filed = F.pandas_udf(run, "kind string, length int, piece string, expression string")(F.col(pattern))
    return rules.where(F.col(pattern).isNotNull()).withColumn("filed", filed).select(*rules.columns, "filed.*")


def _key(kind: Column, length: Column, piece: Column) -> Column:
    """What a piece is joined by. Two pieces with one key cost a try, since each rule is tried in full."""
    return F.xxhash64(kind, length, piece)


def _bits(key: Column, longs: int) -> list[Column]:
    """The three bits that a key sets in the filter."""
    return [F.shiftrightunsigned(key, k).bitwiseAND(F.lit(longs * 64 - 1)) for k in (0, 19, 37)]


def _filter(index: DataFrame, longs: int) -> Column:
    """An array of ``longs`` longs, as a scalar, in which the bits of all keys of ``index`` are set."""
    one = index.select(F.explode(F.array(*_bits(F.col("key"), longs))).alias("bit")).select(F.shiftright("bit", 6).alias("at"), F.expr("shiftleft(1L, int(bit & 63))").alias("mask"))
    of = one.groupBy("at").agg(F.bit_or("mask").alias("mask"))
    dense = index.sparkSession.range(longs).join(of, F.col("id") == F.col("at"), "left").select("id", F.coalesce("mask", F.lit(0)).alias("mask"))
    return dense.agg(F.sort_array(F.collect_list(F.struct("id", "mask"))).alias("x")).select(F.col("x.mask")).scalar()


def first_matches(names: DataFrame, rules: DataFrame, name: str, rule: str, order: str, pattern: str) -> DataFrame:
    """(name, rule) of the distinct ``names``: the first rule by (order, rule) whose glob is the whole name, null where none is.

    Of rules with the same glob the first is tried. The pieces of names that no rule
    is filed under are left out before they are dealt: a filter of 16 bits a piece,
    which goes to every task, passes all that occur and about one in 200 of the others.
    The driver gets the kinds and lengths that occur, at most ``4 * MOST + 3``, and the filter.
    Globs without any piece meet every name, so their number is what makes work grow.
    """
    once = rules.where(F.col(pattern).isNotNull()).groupBy(pattern).agg(F.min(F.struct(order, rule)).alias("first")).select("first.*", pattern)
    index = written(indexed(once, pattern).withColumn("key", _key(F.col("kind"), F.col("length"), F.col("piece"))), "rule-index")
    used = {(r["kind"], r["length"]): r["count"] for r in index.groupBy("kind", "length").count().collect()}
    longs = min(_MOST_LONGS, 1 << max(6, (sum(used.values()) * _BITS // 64).bit_length()))
    distinct = names.select(name).distinct()
    text, word = F.col(name), F.col("word")
    none = F.array().cast("array<bigint>")

    def cut(of: str, piece: Column, take) -> list[Column]:  # noqa: ANN001
        lengths = sorted(n for kind, n in used if kind == of)
        return [F.when(F.char_length(piece) >= n, _key(F.lit(of), F.lit(n), take(piece, F.lit(n)))) for n in lengths]

    whole = [*cut("begin", text, F.left), *cut("end", text, F.right), *([_key(F.lit("any"), F.lit(0), F.lit(""))] if ("any", 0) in used else [])]
    whole = F.array(*whole) if whole else none
    if ("inner", GRAM) in used:
        grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(text) - GRAM + 1)), lambda k: F.substring(text, k, F.lit(GRAM))))
        whole = F.concat(whole, F.transform(grams, lambda g: _key(F.lit("inner"), F.lit(GRAM), g)))
    parts = [*cut("start", word, F.left), *cut("stop", word, F.right), *([_key(F.lit("word"), F.char_length(word), word)] if any(kind == "word" for kind, _ in used) else [])]
    words = F.concat(F.array(F.lit(None).cast("string")), F.array_distinct(F.split(text, f"[^{_WORD[1:]}")))
    keys = F.when(word.isNull(), whole).otherwise(F.array(*parts) if parts else none)
    passes, bits = F.col("own_key").isNotNull(), _filter(index, longs)
    for bit in _bits(F.col("own_key"), longs):
        passes &= F.bit_get(F.get(bits, F.shiftright(bit, 6).cast("int")), bit.bitwiseAND(F.lit(63)).cast("int")) == 1
    asked = distinct.where(text.isNotNull()).select(name, F.explode(words if parts else F.array(F.lit(None).cast("string"))).alias("word")).select(name, F.explode(keys).alias("own_key")).where(passes)
    tried = asked.join(index, F.col("own_key") == F.col("key")).where(F.rlike(name, F.col("expression")))
    first = tried.select(F.col(name).alias("matched"), F.struct(order, rule).alias("first")).repartition("matched").groupBy("matched").agg(F.min("first")[rule].alias(rule))
    return distinct.join(first, F.col(name) == F.col("matched"), "left").select(name, rule)
