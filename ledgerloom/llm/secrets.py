"""Secret scans by an incremental ledger of blobs.

Every version of a text is a blob, named by its SHA-256. The ledger has the
findings of each blob under each version of the rules; only pairs that it lacks
are scanned, each blob once however many paths hold it, and the findings are
joined back to all paths.
"""

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.scratch import stored

LEDGER = "blob binary, rules string, spans array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds, ``least`` characters of ``group`` confirm; texts without ``needs`` are passed over."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    needs: str = ""


#: The base rules, in the order in which their kinds are listed.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20, needs="AKIA"),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
#: The public forms of other credentials.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", needs="-----BEGIN "),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", needs="gh"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", needs="eyJ"),
)


def matches(text: Column, rule: Rule) -> Column:
    """The leftmost non-overlapping matches of a rule, what lies before each, and the group that confirms it."""
    if rule.needs:
        text = F.when(F.contains(text, F.lit(rule.needs)), text).otherwise("")
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    return F.when(F.size(whole) > 0, F.arrays_zip(whole.alias("whole"), group.alias("confirm"), F.split(text, rule.pattern, -1).alias("before")))


def scan(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The spans of all rules, in code points, of the blobs (blob, text) that have any.

    Positions are running sums over the lengths of matches and of what lies
    between them, one row a match; copies of a blob fall together there.
    """
    wide = texts.select("blob", *(matches(F.col("text"), rule).alias(f"m{k}") for k, rule in enumerate(rules)))
    listed = F.array(*(F.struct(F.lit(k).alias("rank"), F.col(f"m{k}").alias("found")) for k in range(len(rules))))
    hits = wide.select("blob", F.explode(F.filter(listed, lambda x: x["found"].isNotNull())).alias("rule")).select("blob", "rule.rank", F.posexplode("rule.found").alias("no", "piece"))
    lengths = [F.first(F.coalesce(F.char_length(f"piece.{part}"), F.lit(0))).alias(part) for part in ("whole", "confirm", "before")]
    along = Window.partitionBy("blob", "rank").orderBy("no")
    placed = hits.groupBy("blob", "rank", "no").agg(*lengths).withColumn("end", F.sum(F.col("before") + F.col("whole")).over(along))
    least = F.element_at(F.array(*(F.lit(r.least) for r in rules)), F.col("rank") + 1)
    kind = F.element_at(F.array(*(F.lit(r.kind) for r in rules)), F.col("rank") + 1)
    good = placed.where((F.col("whole") > 0) & (F.col("confirm") >= least))
    span = F.struct((F.col("end") - F.col("whole")).cast("bigint").alias("start"), F.col("rank").cast("int").alias("rank"), kind.alias("kind"), F.col("end").cast("bigint").alias("end"))
    return good.groupBy("blob").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def ledger_of(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at ``path``; made empty where there is none."""
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def version_of(rules: tuple[Rule, ...]) -> str:
    """The version of rules: a digest of all that they say, so that changed rules find no stale entries."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def scan_incrementally(docs: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """A row per row of ``docs``: doc_id (its path), blob and the spans of its text under these rules.

    A null text is an empty blob and has no spans. Equal texts share one blob,
    which is scanned through the path with the smallest doc_id (null last; rows
    that are wholly alike may each be read). Findings are appended to the ledger
    at ``ledger_path``, a row per blob and version, also where there are none; if
    two runs append a blob at the same time, one row of it counts.
    An empty table gives no rows; columns other than doc_id and text are not
    read.
    """
    spark, version = docs.sparkSession, version_of(rules)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("text"))
    paths = stored(rows.select("doc_id", "blob"), "paths")
    known = ledger_of(spark, ledger_path).where(F.col("rules") == version)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id"))
    unseen = stored(paths.groupBy("blob").agg(first.alias("first")).join(known, "blob", "left_anti").select(F.col("blob").alias("of"), F.col("first.doc_id").alias("by")), "unseen")
    texts = rows.join(unseen, (F.col("blob") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("by"))).select("blob", "text")
    found = scan(texts, rules)
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    entries = unseen.select(F.col("of").alias("blob")).join(found, "blob", "left").select("blob", F.lit(version).alias("rules"), F.coalesce("spans", none).alias("spans"))
    entries.write.mode("append").parquet(ledger_path)
    # written, so that a blob with very many paths can be dealt to several tasks
    findings = stored(ledger_of(spark, ledger_path).where(F.col("rules") == version).groupBy("blob").agg(F.first("spans").alias("spans")), "findings")
    return paths.join(findings, "blob").select("doc_id", "blob", "spans")


def digest_columns(spans: Column, kinds: tuple[str, ...], is_base: Callable[[Column], Column] | None = None) -> dict[str, Column]:
    """Counts of base kinds, the digest of base spans, and all spans as one string.

    Base spans are those of the first ``kinds``, or of these that ``is_base`` names.
    """
    said = lambda found: F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter(spans, lambda x: (x["rank"] < len(kinds)) & (is_base(x) if is_base else F.lit(True)))
    of_rank = lambda k: F.size(F.filter(base, lambda x: x["rank"] == k)).cast("long")
    return {f"n_{kind}": of_rank(k) for k, kind in enumerate(kinds)} | {"base_sha256": F.sha2(said(base), 256), "spans": said(spans)}
