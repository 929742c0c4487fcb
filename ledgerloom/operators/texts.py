"""Texts as evidence: findings with offsets, lint of publications, canonical JSON, identities."""

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.written import written

#: Patterns of a scan over lower-case text, each with category, severity and whether what it finds is redacted.
SCAN = (
    (r"begin (?:rsa |ec |openssh )?private key", "PRIVATE_KEY_MATERIAL_PATTERN", "CRITICAL", True),
    (r"x-amz-[a-z0-9_-]+", "SIGNED_URL_PATTERN", "HIGH", True),
    (r"signature=[^\s&]+", "SIGNED_URL_PATTERN", "HIGH", True),
    (r"\bsubprocess\.(?:run|popen|call|check_call|check_output)\s*\(", "SUBPROCESS_EXECUTION_PATTERN", "MEDIUM", False),
    (r"\bos\.system\s*\(", "SHELL_EXECUTION_PATTERN", "HIGH", False),
    (r"\b__import__\s*\(", "DYNAMIC_IMPORT_PATTERN", "MEDIUM", False),
    (r"\bpickle\.loads?\s*\(", "DESERIALIZATION_EXECUTION_PATTERN", "HIGH", False),
    (r"""(?:download_url|remote_code|endpoint|source_url)\s*[:=]\s*['"]http://""", "SUSPICIOUS_NETWORK_REFERENCE", "LOW", False),
    (r"""(?:download_url|remote_code|endpoint|source_url)\s*[:=]\s*['"]https://""", "SUSPICIOUS_NETWORK_REFERENCE", "LOW", False),
)


def scanned(rows: DataFrame, key: str, text: str, patterns: Sequence[tuple] = SCAN) -> DataFrame:
    """(key, pattern, offset, length, category, severity, excerpt) of every match in a text's lower-case form; sensitive matches are shown by length only.

    Offsets are characters, summed over the pieces between matches; a text without
    any match makes no row.
    """
    low = rows.select(key, F.lower(text).alias("low"))
    wide = low.select(key, *(F.when(F.col("low").rlike(p), F.arrays_zip(F.regexp_extract_all("low", F.lit(p), F.lit(0)).alias("whole"), F.split("low", p, -1).alias("before"))).alias(f"m{k}") for k, (p, *_) in enumerate(patterns)))
    listed = F.filter(F.array(*(F.struct(F.lit(k).alias("pattern"), F.col(f"m{k}").alias("found")) for k in range(len(patterns)))), lambda x: x["found"].isNotNull())
    hits = wide.select(key, F.explode(listed).alias("x")).select(key, "x.pattern", F.posexplode("x.found").alias("no", "piece"))
    along = Window.partitionBy(key, "pattern").orderBy("no")
    placed = hits.withColumn("upto", F.sum(F.char_length("piece.before") + F.coalesce(F.char_length("piece.whole"), F.lit(0))).over(along)).where(F.col("piece.whole").isNotNull())
    of = lambda k: F.element_at(F.array(*(F.lit(p[k]) for p in patterns)), F.col("pattern") + 1)
    length = F.char_length("piece.whole")
    shown = F.when(of(3), F.concat(F.lit("<redacted:"), length.cast("string"), F.lit(">"))).otherwise(F.col("piece.whole"))
    return placed.select(key, "pattern", (F.col("upto") - length).cast("long").alias("offset"), length.cast("long").alias("length"), of(1).alias("category"), of(2).alias("severity"), shown.alias("excerpt"))


def whole_words(*words: str) -> str:
    """An expression for any of ``words`` that no ASCII letter, digit or underscore touches, as SQL's engines read ``\\b``; Java's own, before version 19, counts all letters."""
    return rf"(?<![A-Za-z0-9_])(?:{'|'.join(words)})(?![A-Za-z0-9_])"


def linted(rows: DataFrame, key: str, text: str, claims: DataFrame, forbidden: Sequence[str], boast: str, negation: str) -> DataFrame:
    """(key, finding) of texts against a register of claims (claim): unknown claims (UNKNOWN:id), forbidden phrases and boasts in lines that don't negate them, credentials."""
    found = rows.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"CLAIM-[0-9]{3}"), F.lit(0)))).alias("claim")).join(claims, "claim", "left_anti")
    unknown = found.select(key, F.concat(F.lit("UNKNOWN:"), "claim").alias("finding"))
    lines = rows.select(key, F.explode(F.split(F.lower(text), "\n")).alias("line")).where(~F.col("line").rlike(negation))
    said = F.array_compact(F.array(F.when(F.col("line").rlike(boast), "BOAST"), *(F.when(F.col("line").contains(p), f"FORBIDDEN:{p}") for p in forbidden)))
    bad = lines.select(key, F.explode(said).alias("finding")).distinct()
    secret = rows.where(F.col(text).contains("Authorization:") | F.col(text).contains("Bearer ")).select(key, F.lit("CREDENTIAL").alias("finding"))
    return unknown.union(bad).union(secret)


def _strict(text: str) -> object:
    def pairs(found: list[tuple[str, object]]) -> dict:
        out = dict(found)
        if len(out) < len(found):
            raise ValueError("repeated key")
        return out

    def none(name: str) -> None:
        raise ValueError(name)

    return json.loads(text, object_pairs_hook=pairs, parse_constant=none)


def canonical_json(text: Column) -> Column:
    """The canonical form of JSON texts: keys in order at every level, no spaces, no escapes beyond what JSON needs; null for what is no JSON, repeats a key or holds NaN."""

    def one(value: str | None) -> str | None:
        try:
            return None if value is None else json.dumps(_strict(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
        except ValueError:
            return None

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([one(t) for t in texts], dtype=object)

    return F.pandas_udf(run, "string")(text)


def identified(rows: DataFrame, columns: Sequence[str], id_: str, prefix: str, digest: str) -> DataFrame:
    """``rows`` with an id made of the digest of their canonical record, and a digest of the record with that id."""
    body = lambda *more: F.to_json(F.struct(*sorted([*columns, *more])), {"ignoreNullFields": "false"})
    named = rows.withColumn(id_, F.concat(F.lit(prefix), F.left(F.sha2(body(), 256), F.lit(32))))
    return named.withColumn(digest, F.sha2(body(id_), 256))


def nesting(text: Column) -> Column:
    """A struct (level, most, least) of the brackets outside strings: how many stay open, the deepest level, and the lowest, below zero where one closes that none opened."""
    plain = F.regexp_replace(F.regexp_replace(text, r"(?s)\\.", ""), r'"[^"]*"', "")
    brackets = F.split(F.regexp_replace(plain, r"[^\[\]{}]", ""), "")
    named = lambda level, most, least: F.struct(level.alias("level"), most.alias("most"), least.alias("least"))

    def step(a: Column, c: Column) -> Column:
        level = a["level"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return named(level, F.greatest(a["most"], level), F.least(a["least"], level))

    return F.aggregate(brackets, named(F.lit(0), F.lit(0), F.lit(0)), step)


def whole_json(text: Column) -> Column:
    """A text as VARIANT; null for what is no JSON, repeats a name, or goes on after its value.

    The parser stops at a value's end. So the text is read as the only member of an
    array, and of an object as well: what would close the one can't close the other.
    """
    members = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    alone = F.filter(F.array(members), lambda m: F.size(m) == 1)
    inside = F.try_parse_json(F.concat(F.lit('{"":'), text, F.lit("}")))
    return F.when(inside.isNotNull(), F.try_element_at(alone, F.lit(1))[0])


def json_leaves(documents: DataFrame, key: str, text: str, most_depth: int = 32) -> DataFrame:
    """(key, name, value) of the leaves of JSON documents, at any depth: ``name`` is the nearest name above a leaf, so that an array's members have the array's.

    Texts are parsed once, in the JVM; then a level at a time is opened, as many as
    the deepest document has. What is no JSON, or repeats a name, gives one row with
    the name ``!`` and no value, and so does a document that goes deeper than
    ``most_depth``.
    """
    parsed = written(documents.select(F.col(key).alias("key"), whole_json(F.col(text)).alias("x")), "parsed")
    wrong = parsed.where("x is null").select("key", F.lit("!").alias("name"), F.lit(None).cast("string").alias("value"))
    level, leaves, depth = parsed.where("x is not null").select("key", F.lit("").alias("name"), "x"), [wrong], 0
    while not level.isEmpty():
        kind = F.schema_of_variant("x")
        inner = F.col("kind").startswith("OBJECT") | F.col("kind").startswith("ARRAY")
        known = level.withColumn("kind", kind)
        leaves.append(known.where(~inner).select("key", "name", F.try_variant_get("x", "$", "string").alias("value")))
        below = known.where(inner)
        if depth == most_depth:
            leaves.append(below.select("key", F.lit("!").alias("name"), F.lit(None).cast("string").alias("value")).distinct())
            break
        opened = documents.sparkSession.sql("SELECT b.key, coalesce(e.key, b.name) AS name, e.value AS x FROM {below} b, LATERAL variant_explode(b.x) AS e", below=below)
        level, depth = written(opened, "json-level"), depth + 1
    out = leaves[0]
    for part in leaves[1:]:
        out = out.union(part)
    return out


def references(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(src, dst) of the references in JSON documents: every string under a name that ends in ``_id`` or ``_ref``, at any depth and in arrays, to another document than its own."""
    leaves = json_leaves(documents, key, text).where(F.col("name").rlike("_(?:id|ref)$") & F.col("value").isNotNull())
    return leaves.select(F.col("key").alias("src"), F.col("value").alias("dst")).where("src <> dst").distinct()


def utc(text: Column) -> Column:
    """Whether a text is a time in the recorded form that exists."""
    formed = text.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z\z")
    return F.coalesce(formed & F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")).isNotNull(), F.lit(False))


def escaped(text: Column) -> Column:
    """A text for display: control, bidirectional and zero-width characters as their code points."""
    marks = "".join(chr(c) for c in (0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x202A, 0x202B, 0x202C, 0x202D, 0x202E, 0x2066, 0x2067, 0x2068, 0x2069, 0xFEFF))
    out = text
    for c in [*map(chr, range(32)), chr(127), *marks]:
        out = F.replace(out, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
    return out


def unsafe(text: Column) -> Column:
    """Whether a text holds an absolute path or a credential."""
    return F.coalesce(text.rlike(r"""(?:^|[\s"'=:])(?:/(?:home|root|etc|usr|var|tmp)/|[A-Za-z]:\\)|Bearer\s|Authorization:|-----BEGIN [A-Z ]*PRIVATE KEY|(?:password|secret|token)\s*[:=]"""), F.lit(False))
