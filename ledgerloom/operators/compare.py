"""Keyed comparison of two relations, and statuses drawn from its findings."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compare(expected: DataFrame, observed: DataFrame, key: str, fields: Mapping[str, str]) -> DataFrame:
    """(key, findings) for each key of either side; ``fields`` names the finding for each column that differs.

    Columns are compared null-safely. A key that one side lacks gets MISSING or
    UNEXPECTED and nothing else. Keys are unique on each side.
    """
    e = expected.select(F.col(key).alias("ekey"), *(F.col(c).alias(f"e_{c}") for c in fields))
    o = observed.select(F.col(key).alias("okey"), *(F.col(c).alias(f"o_{c}") for c in fields))
    both = e.join(o, F.col("ekey") == F.col("okey"), "full_outer")
    differs = [F.when(~F.col(f"e_{c}").eqNullSafe(F.col(f"o_{c}")), name) for c, name in fields.items()]
    found = F.when(F.col("okey").isNull(), F.array(F.lit("MISSING"))).when(F.col("ekey").isNull(), F.array(F.lit("UNEXPECTED"))).otherwise(F.array_compact(F.array(*differs)))
    return both.select(F.coalesce("ekey", "okey").alias(key), found.alias("findings"))


def ladder(rungs: Sequence[tuple[str, Column]], otherwise: str) -> Column:
    """The status of the first condition that holds."""
    out = F.lit(otherwise)
    for status, condition in reversed(rungs):
        out = F.when(condition, status).otherwise(out)
    return out


def matched(text: Column, rules: Sequence[tuple[str, str]], otherwise: str) -> Column:
    """The class of the first pattern that is found in ``text``."""
    return ladder([(name, F.coalesce(text.rlike(pattern), F.lit(False))) for name, pattern in rules], otherwise)


def glob_pattern(glob: str) -> str:
    """A regular expression for the whole of what ``*``, ``?`` and ``[..]`` match, case and all; ``*`` crosses dots, slashes and line ends.

    ``[!..]`` is a class of all others; a bracket that nothing closes stands for itself.
    """
    out, k = "", 0
    while k < len(glob):
        c, k = glob[k], k + 1
        close = glob.find("]", k + 1 + (glob[k : k + 1] == "!")) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif close > 0:
            body, k = glob[k:close], close + 1
            ranges = "".join("\\" + x if x in "\\[]^&~" else x for x in body[body.startswith("!") :])
            out += f"[{'^' * body.startswith('!')}{ranges}]"
        else:
            out += c if c.isalnum() or c in "_ " else "\\" + c if ord(c) < 128 else c
    return rf"(?s)\A{out}\z"


def worked_out(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with ``columns``, each worked out once a row, however often what follows names it.

    A later projection would otherwise put the expression in place of the name
    everywhere, and conditions don't share what is in their branches.
    """
    own = F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items()))))
    return rows.select(*(F.col(c) for c in rows.columns if c not in columns), own)


def gated(found: DataFrame, sides: Sequence[DataFrame], keys: Sequence[str], status: str) -> DataFrame:
    """``found`` where every one of ``sides`` can be compared, else one row with ``status`` NOT_COMPARABLE and nothing else.

    A side with a null in one of ``keys``, or a value of one of them twice, can't be compared.
    """
    bad = F.lit(False)
    for side in sides:
        repeated = [(F.count("*") > F.countDistinct(k)) for k in keys]  # a null is not counted as a value
        any_of = repeated[0]
        for r in repeated[1:]:
            any_of = any_of | r
        bad = bad | side.agg(any_of.alias("bad")).scalar()
    alone = found.sparkSession.range(1).select(*((F.lit("NOT_COMPARABLE") if c == status else F.lit(None).cast(found.schema[c].dataType)).alias(c) for c in found.columns))
    return found.where(~bad).unionByName(alone.where(bad))
