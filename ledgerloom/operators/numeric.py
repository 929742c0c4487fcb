"""Numeric fidelity: metrics of pairs of vectors with explicit undefined states, exact decimals, counter-based samples, and roll-ups."""

from collections.abc import Iterator, Sequence
from decimal import ROUND_HALF_EVEN, Context, Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.compare import ladder

#: Fixed value: digits of exact arithmetic.
_DIGITS = 50


def metrics(source: Column, candidate: Column) -> dict[str, Column]:
    """Metrics of two arrays of doubles of one length, the error being candidate less source; null where a metric is undefined, which ``cosine_state`` and ``relative_state`` name."""
    pairs = F.zip_with(source, candidate, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    total = lambda f: F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + f(p["a"], p["b"]))
    n = F.size(source).cast("long")
    mean = lambda x: F.when(n > 0, x / n)
    exact = F.size(F.filter(pairs, lambda p: p["a"] == p["b"])).cast("long")
    aa, bb, ab, ee = total(lambda a, b: a * a), total(lambda a, b: b * b), total(lambda a, b: a * b), total(lambda a, b: (b - a) * (b - a))
    return {
        "n": n, "n_exact": exact, "max_error": F.array_max(F.transform(pairs, lambda p: F.abs(p["b"] - p["a"]))), "mean_error": mean(total(lambda a, b: F.abs(b - a))), "mse": mean(ee), "rmse": F.sqrt(mean(ee)), "source_l2": F.sqrt(aa), "error_l2": F.sqrt(ee),
        "relative_l2": F.when(aa > 0, F.sqrt(ee / F.nullif(aa, F.lit(0.0)))), "relative_state": F.when(n == 0, "INSUFFICIENT_COVERAGE").when(aa == 0, "UNDEFINED_ZERO_REFERENCE_NORM").when(exact == n, "EXACT").otherwise("AVAILABLE"),
        "dot": ab, "cosine": F.when((aa > 0) & (bb > 0), F.when(exact == n, F.lit(1.0)).otherwise(ab / F.nullif(F.sqrt(aa * bb), F.lit(0.0)))),
        "cosine_state": F.when((aa == 0) | (bb == 0), "UNDEFINED_ZERO_VECTOR").when(exact == n, "EXACT").otherwise("AVAILABLE"), "bias": mean(total(lambda a, b: b - a)),
    }


def canonical_decimal(value: Decimal) -> str:
    """A decimal without exponent, trailing zeros or negative zero."""
    text = format(value, "f")
    text = text.rstrip("0").rstrip(".") if "." in text else text
    return "0" if text in ("-0", "") else text


def exact_metrics(rows: DataFrame, source: str, candidate: str) -> DataFrame:
    """``rows`` with (max_error, mean_error, mse, rmse, error_squares, dot, cosine) of arrays of decimal strings, in decimal arithmetic of 50 digits, half to even; null where undefined or where the arrays differ in length or hold no number."""
    names = ["max_error", "mean_error", "mse", "rmse", "error_squares", "dot", "cosine"]

    def one(xs: Sequence[str] | None, ys: Sequence[str] | None) -> tuple:
        c = Context(prec=_DIGITS, rounding=ROUND_HALF_EVEN)
        try:
            a, b = [Decimal(x) for x in xs], [Decimal(y) for y in ys]
        except (InvalidOperation, TypeError):
            return (None,) * len(names)
        if len(a) != len(b) or not a or not all(x.is_finite() for x in (*a, *b)):
            return (None,) * len(names)

        def total(values: Iterator[Decimal]) -> Decimal:
            acc = Decimal(0)
            for v in values:
                acc = c.add(acc, v)
            return acc

        e = [c.subtract(y, x) for x, y in zip(a, b, strict=True)]
        n, ee = Decimal(len(a)), total(c.multiply(x, x) for x in e)
        aa, bb, ab = total(c.multiply(x, x) for x in a), total(c.multiply(x, x) for x in b), total(c.multiply(x, y) for x, y in zip(a, b, strict=True))
        mse = c.divide(ee, n)
        cosine = None if not aa or not bb else Decimal(1) if a == b else c.divide(ab, c.sqrt(c.multiply(aa, bb)))
        found = (max(map(abs, e)), c.divide(total(map(abs, e)), n), mse, c.sqrt(mse), ee, ab, cosine)
        return tuple(None if x is None else canonical_decimal(x) for x in found)

    @F.pandas_udf(", ".join(f"{c} string" for c in names))
    def run(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(x, y) for x, y in zip(xs, ys, strict=True)], columns=names)

    at = "_".join(["metrics", *rows.columns])  # no column has this name
    return rows.withColumn(at, run(F.col(source), F.col(candidate))).select(*rows.columns, *(F.col(at)[c].alias(c) for c in names))


def _below(digest: Column, n: Column) -> Column:
    """A hexadecimal digest modulo ``n``, four digits at a time, for ``n`` up to 10^9."""
    digits = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.conv(F.substring(digest, k * 4 + 1, F.lit(4)), 16, 10).cast("bigint"))
    return F.aggregate(digits, F.lit(0).cast("bigint"), lambda acc, d: F.pmod(acc * 65536 + d, n))


def samples(populations: DataFrame, key: str, prefix: Column, most: int = 100_000, most_population: int = 1_000_000_000) -> DataFrame:
    """(key, index) of populations (key, population, wanted): ``wanted`` distinct indices below ``population``, drawn by the digests of ``prefix`` and a counter.

    All indices where that many are wanted; none where either is 0 or a bound is
    passed. Counters that repeat an index are skipped. About twice the counters
    that are needed are tried at first; what is still short then gets all of the
    128 for each index that the rule allows.
    """
    fits = (F.col("population") <= most_population) & (F.col("wanted") <= most) & (F.col("population") > 0) & (F.col("wanted") > 0)
    rows = populations.where(fits).select(key, F.col("population").cast("bigint").alias("population"), F.least("wanted", "population").cast("bigint").alias("wanted"), prefix.alias("prefix"))
    whole = rows.where("wanted = population").select(key, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("population") - 1)).alias("index"))

    def drawn(asked: DataFrame, tries: Column) -> DataFrame:
        tried = asked.withColumn("counter", F.explode(F.sequence(F.lit(0).cast("bigint"), tries - 1)))
        index = _below(F.sha2(F.concat("prefix", F.col("counter").cast("string")), 256), F.col("population"))
        firsts = tried.withColumn("index", index).groupBy(key, "wanted", "index").agg(F.min("counter").alias("counter"))
        return firsts.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("counter"))).where(F.col("place") <= F.col("wanted")).select(key, "wanted", "index")

    part = rows.where("wanted < population")
    early = drawn(part, F.col("wanted") * 2 + 64)
    done = early.groupBy(key, "wanted").agg(F.count("*").alias("n")).where("n = wanted").select(key)
    late = drawn(part.join(done, key, "left_anti"), F.greatest(F.lit(1024), F.col("wanted") * 128).cast("bigint"))
    full = late.groupBy(key, "wanted").agg(F.count("*").alias("n")).where("n = wanted").select(key)
    return whole.union(early.join(done, key, "left_semi").select(key, "index")).union(late.join(full, key, "left_semi").select(key, "index"))


def measurement_status(n_metrics: Column, n_elements: Column, sampled: Column, all_exact: Column) -> Column:
    return ladder([("INSUFFICIENT_COVERAGE", (n_metrics == 0) | (n_elements == 0)), ("SAMPLED", sampled), ("EXACT", all_exact)], "EVALUATED")


def numeric_rollup(statuses: Column, sample_scope: Column) -> Column:
    """The status of all measurements from the set of theirs."""
    has = lambda s: F.array_contains(statuses, s)
    rungs = [("VALUES_UNAVAILABLE", F.size(statuses) == 0), ("INVALID", has("INVALID")), ("INSUFFICIENT_COVERAGE", has("INSUFFICIENT_COVERAGE")), ("NOT_SUPPORTED", has("NOT_SUPPORTED")), ("SAMPLED", sample_scope | has("SAMPLED")), ("EXACT", F.size(F.array_except(statuses, F.array(F.lit("EXACT")))) == 0)]
    return ladder(rungs, "EVALUATED")


def policy_result(requirements: DataFrame, key: str) -> DataFrame:
    """(key, n_failed, n_pending, status) of requirements (key, state in PASSED, FAILED, PENDING): no requirement at all is indeterminate."""
    sums = requirements.groupBy(key).agg(F.count("state").alias("n"), F.count_if(F.col("state") == "FAILED").alias("n_failed"), F.count_if(F.col("state") == "PENDING").alias("n_pending"))
    rungs = [("CONFORMS", (F.col("n") > 0) & (F.col("n_failed") == 0) & (F.col("n_pending") == 0)), ("DOES_NOT_CONFORM", F.col("n_failed") > 0)]
    return sums.select(key, "n_failed", "n_pending", ladder(rungs, "INDETERMINATE").alias("status"))


def decimal_grammar(text: Column, digits: int = 100) -> Column:
    """Whether a text is a plain decimal of at most ``digits`` significant digits, with an optional exponent."""
    mantissa = F.regexp_replace(F.regexp_replace(text, r"[eE].*$", ""), r"[^0-9]", "")
    return F.coalesce(text.rlike(r"\A-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]{1,4})?\z") & (F.char_length(F.regexp_replace(mantissa, "^0+", "")) <= digits), F.lit(False))
