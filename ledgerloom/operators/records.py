"""JSON records under contracts: bounded reading, closed sets of names, typed configurations."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.compare import ladder, worked_out
from ledgerloom.operators.texts import nesting, whole_json


def bounded(rows: DataFrame, key: str, text: str, most_bytes: int, most_depth: int) -> DataFrame:
    """(key, status, fields) of JSON texts, a row each: ``fields`` is the map of an object's names to VARIANT, held only where the status is READ.

    UNAVAILABLE is a null text, TOO_LARGE one of more UTF-8 bytes than ``most_bytes``,
    TOO_DEEP one whose brackets nest deeper than ``most_depth``; neither is parsed.
    BROKEN is no JSON, an empty text among it, or repeats a name; NO_OBJECT another
    value than an object. Repeated rows stay repeated.
    """
    own = rows.select(F.col(key).alias("key"), F.col(text).alias("text"))
    large = F.octet_length("text") > most_bytes
    deep = (F.regexp_count("text", F.lit(r"[\[{]")) > most_depth) & (nesting(F.col("text"))["most"] > most_depth)  # few brackets can't nest deep
    sized = worked_out(own, deep=F.when(~large, deep))
    read = worked_out(sized, record=F.when(~F.col("deep"), whole_json(F.col("text"))))
    opened = worked_out(read, fields=F.try_variant_get("record", "$", "map<string,variant>"))  # null for what is no object
    rungs = [("UNAVAILABLE", F.col("text").isNull()), ("TOO_LARGE", large), ("TOO_DEEP", F.col("deep")), ("BROKEN", F.col("record").isNull()), ("NO_OBJECT", F.col("fields").isNull())]
    return opened.select(F.col("key").alias(key), ladder(rungs, "READ").alias("status"), "fields")


def _kind(name: str) -> Column:
    """What a field holds; null where the record has none of that name."""
    return F.schema_of_variant(F.col("fields")[name])


def _listed(*conditions: Column) -> Column:
    return F.array_compact(F.array(*conditions))


def sidecars(rows: DataFrame, key: str, text: str, names: Sequence[str], most_bytes: int, most_depth: int) -> DataFrame:
    """(key, status, faults, *names) of records that may hold ``names`` only, each null or a text that is neither empty nor an absolute path.

    The status is that of reading, or the first of UNSUPPORTED_NAMES, NO_TEXT,
    ABSOLUTE_PATH and AVAILABLE; ``faults`` are the names it is about, in order.
    Values are given where all is well; a name that is absent is null.
    """
    read = bounded(rows, key, text, most_bytes, most_depth)
    value = {n: F.try_variant_get(F.col("fields")[n], "$", "string") for n in names}
    other = F.sort_array(F.array_except(F.map_keys("fields"), F.array(*map(F.lit, names))))
    blank = _listed(*(F.when((_kind(n) != "VOID") & ((_kind(n) != "STRING") | (value[n] == "")), n) for n in names))
    rooted = _listed(*(F.when((_kind(n) == "STRING") & value[n].rlike(r"\A(?:/|file:)"), n) for n in names))
    found = worked_out(read, other=other, blank=blank, rooted=rooted)
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    status = F.when(F.col("status") != "READ", F.col("status")).otherwise(ladder([("UNSUPPORTED_NAMES", some("other")), ("NO_TEXT", some("blank")), ("ABSOLUTE_PATH", some("rooted"))], "AVAILABLE"))
    faults = F.when(status == "UNSUPPORTED_NAMES", F.col("other")).when(status == "NO_TEXT", F.col("blank")).when(status == "ABSOLUTE_PATH", F.col("rooted")).otherwise(F.array().cast("array<string>"))
    return found.select(F.col(key), status.alias("status"), faults.alias("faults"), *(F.when(status == "AVAILABLE", value[n]).alias(n) for n in names))


#: What a field of a configuration can be: the kinds of VARIANT, the type it is read as, and a condition.
_TYPES = {
    "text": ("STRING", "string", lambda v: v != ""),
    "count": ("BIGINT", "long", lambda v: v > 0),
    "flag": ("BOOLEAN", "boolean", lambda v: F.lit(True)),
    "texts": ("ARRAY<STRING>", "array<string>", lambda v: ~F.array_contains(v, "")),
}


def configurations(rows: DataFrame, key: str, text: str, contract: Mapping[str, str], family: Sequence[tuple[str, str]], divides: Sequence[tuple[str, str]], most_bytes: int, most_depth: int) -> DataFrame:
    """(key, status, findings, *contract) of configurations under a contract of names and kinds (text, count, flag, texts).

    ``family`` has names with the value that a text has to be or a list has to
    hold, ``divides`` pairs of counts whose first divides the second. Every breach is
    a finding: TYPE:name, and where no type is wrong FAMILY:name and DIVIDES:part:whole.
    The status is that of reading, INVALID or VALID; a field of the wrong type is null.
    """
    read = bounded(rows, key, text, most_bytes, most_depth)
    typed = {}
    for name, kind in contract.items():
        form, as_, holds = _TYPES[kind]
        value = F.try_variant_get(F.col("fields")[name], "$", as_)
        typed[f"f_{name}"] = F.when((_kind(name) == form) & holds(value), value)
    known = worked_out(read, **typed)
    own = lambda n: F.col(f"f_{n}")
    wrong = _listed(*(F.when(own(n).isNull(), f"TYPE:{n}") for n in contract))
    apart = [F.when(~(F.array_contains(own(n), v) if contract[n] == "texts" else own(n) == v), f"FAMILY:{n}") for n, v in family]
    uneven = [F.when(own(whole) % own(part) != 0, f"DIVIDES:{part}:{whole}") for part, whole in divides]
    judged = worked_out(known, wrong=wrong, later=_listed(*apart, *uneven))
    none = F.array().cast("array<string>")
    findings = F.when(F.col("status") != "READ", none).when(F.size("wrong") > 0, F.col("wrong")).otherwise(F.col("later"))
    status = F.when(F.col("status") != "READ", F.col("status")).when(F.size(findings) > 0, "INVALID").otherwise("VALID")
    return judged.select(F.col(key), status.alias("status"), findings.alias("findings"), *(own(n).alias(n) for n in contract))
