"""Paths that have to mean the same on every platform, judged by rules that are rows, and sets of them."""

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.compare import worked_out

MOST, MOST_PART = 1024, 255
_BEGIN, _END = r"(?:\A|/)", r"(?:/|\z)"
#: The last two code points of every plane, which are no characters.
_NO_CHARACTERS = "".join(rf"\x{{{plane:X}FFFE}}\x{{{plane:X}FFFF}}" for plane in range(17))
#: A rule's name and the expression that finds where a path breaks it; a path's fault is the first.
RULES = (
    ("EMPTY", r"\A\z"),
    ("ROOTED", r"\A/"),
    ("DRIVE", r"\A[A-Za-z]:"),
    ("SCHEME", r"://"),
    ("BACKSLASH", r"\\"),
    ("CONTROL", r"[\x00-\x1f\x7f]"),
    ("NO_CHARACTER", f"[{_NO_CHARACTERS}]"),
    ("EMPTY_PART", rf"/{_END}"),
    ("DOTS", rf"{_BEGIN}\.\.?{_END}"),
    ("LONG_PART", rf"[^/]{{{MOST_PART + 1}}}"),
    ("BLURRED_END", rf"[ .]{_END}"),
    ("RESERVED", rf"(?i){_BEGIN}(?:con|prn|aux|nul|com[1-9]|lpt[1-9])(?:\.[^/]*)?{_END}"),  # fixed values: names that some platforms keep
    ("COLON", ":"),
)


def _forms(path: Column) -> Column:
    """A struct (composed, folded): a path in composed form, and that without case. What is ASCII needs no Python."""

    def run(paths: pd.Series) -> pd.DataFrame:
        composed = [None if p is None else unicodedata.normalize("NFC", p) for p in paths]
        return pd.DataFrame({"composed": composed, "folded": [None if c is None else c.casefold() for c in composed]}, dtype=object)

    return F.pandas_udf(run, "composed string, folded string")(path)


def judged(paths: DataFrame, path: str) -> DataFrame:
    """``paths`` with ``fault``, the first rule that ``path`` breaks, and ``folded``, in which portable paths may not meet.

    A null path is EMPTY; TOO_LONG and NOT_COMPOSED come after EMPTY.
    """
    plain = F.col(path).rlike(r"\A[\x00-\x7f]*\z")
    ascii_, other = paths.where(F.coalesce(plain, F.lit(True))), paths.where(~plain)
    both = ascii_.select("*", F.col(path).alias("composed"), F.lower(path).alias("folded")).unionByName(other.withColumn("forms", _forms(F.col(path))).select(*paths.columns, "forms.composed", "forms.folded"))
    broken = [F.when(F.col(path).rlike(pattern), name) for name, pattern in RULES]
    whole = [F.when(F.col(path).isNull(), "EMPTY"), F.when(F.char_length(path) > MOST, "TOO_LONG"), F.when(F.col("composed") != F.col(path), "NOT_COMPOSED")]
    return worked_out(both, fault=F.coalesce(broken[0], *whole, *broken[1:])).drop("composed")


def path_findings(paths: DataFrame, scope: str, path: str) -> DataFrame:
    """(scope, path, n, finding) of the distinct paths of each scope: a fault of its own, DUPLICATE, COLLISION with another in all but case, PREFIX_CONFLICT if another has it as a folder, or OK."""
    own = judged(paths.groupBy(scope, path).agg(F.count("*").alias("n")), path)
    crowded = own.groupBy(F.col(scope).alias("c_scope"), F.col("folded").alias("c_folded")).agg(F.count("*").alias("n_folded"))
    parts = F.split(path, "/")
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))
    folders = own.where(F.size(parts) > 1).select(F.col(scope).alias("f_scope"), above.alias("folder")).distinct()
    both = own.join(crowded, F.col(scope).eqNullSafe(F.col("c_scope")) & F.col("folded").eqNullSafe(F.col("c_folded"))).join(folders, F.col(scope).eqNullSafe(F.col("f_scope")) & (F.col(path) == F.col("folder")), "left")
    finding = F.coalesce("fault", F.when(F.col("n") > 1, "DUPLICATE"), F.when(F.col("n_folded") > 1, "COLLISION"), F.when(F.col("folder").isNotNull(), "PREFIX_CONFLICT"), F.lit("OK"))
    return both.select(scope, path, "n", finding.alias("finding"))
