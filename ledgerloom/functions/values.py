"""Column functions: exact ratios, canonical records, tri-state fields, redaction."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def greatest_common_divisor(a: Column, b: Column) -> Column:
    """Euclid's algorithm as a fold of at most 92 steps, as for any two longs; gcd(a, 0) is a."""
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), F.when(s["y"] != 0, F.try_mod(s["x"], s["y"])).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), F.struct(a.cast("long").alias("x"), b.cast("long").alias("y")), step)["x"]


def canonical_identity(columns: Sequence[str]) -> Column:
    """The digest of a record's canonical JSON: keys in order, nulls kept, no spaces."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def domain_digest(domain: str, *parts: Column) -> Column:
    """A digest that tells domains and the borders of parts apart: each part goes in with its length; null parts are marked."""
    framed = [F.when(p.isNull(), F.lit("-;")).otherwise(F.concat(F.octet_length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string"), F.lit(";"))) for p in parts]
    return F.sha2(F.concat(F.lit(f"{len(domain)}:{domain};"), *framed), 256)


def presence(document: Column, field: str) -> Column:
    """ABSENT, NULL or VALUE for a field of a JSON object; a document that is no JSON object has all fields absent."""
    keys = F.json_object_keys(document)
    return F.when(~F.coalesce(F.array_contains(keys, field), F.lit(False)), "ABSENT").when(F.get_json_object(document, f"$['{field}']").isNull(), "NULL").otherwise("VALUE")


def redacted(text: Column, shown: int) -> Column:
    """The first ``shown`` characters and the number of those hidden."""
    hidden = F.greatest(F.lit(0), F.char_length(text) - shown)
    return F.concat(F.left(text, F.lit(shown)), F.when(hidden > 0, F.concat(F.lit("…+"), hidden.cast("string"))).otherwise(""))
