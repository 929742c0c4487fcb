"""All registered queries over the reference tables, each beside the SQL that checks it."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.values import canonical_identity as identity
from ledgerloom.functions.values import greatest_common_divisor
from ledgerloom.operators import compare as cmp
from ledgerloom.operators import evidence, graphs, sequences
from ledgerloom.operators.written import ranked

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_MANIFEST = """
WITH e AS (SELECT doc_id, n_chars AS size, sha256(coalesce(text, '')) AS sha FROM documents),
o AS (SELECT doc_id + CASE WHEN doc_id % 7 = 1 THEN 1000000000000 ELSE 0 END AS doc_id, n_chars + CASE WHEN doc_id % 13 = 5 THEN 1 ELSE 0 END AS size, sha256(coalesce(text, '') || CASE WHEN doc_id % 17 = 2 THEN '!' ELSE '' END) AS sha FROM documents),
f AS (SELECT coalesce(e.doc_id, o.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'MISSING' WHEN e.doc_id IS NULL THEN 'UNEXPECTED'
      ELSE concat_ws(',', CASE WHEN e.size IS DISTINCT FROM o.size THEN 'SIZE_MISMATCH' END, CASE WHEN e.sha IS DISTINCT FROM o.sha THEN 'DIGEST_MISMATCH' END) END AS findings
      FROM e FULL JOIN o ON e.doc_id = o.doc_id)
"""


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, text = table(spark, sf_dir, "documents"), F.coalesce("text", F.lit(""))
    expected = docs.select("doc_id", F.col("n_chars").alias("size"), F.sha2(text, 256).alias("sha"))
    size = F.col("n_chars") + F.when(F.col("doc_id") % 13 == 5, 1).otherwise(0)
    sha = F.sha2(F.concat(text, F.when(F.col("doc_id") % 17 == 2, "!").otherwise("")), 256)
    path = F.col("doc_id") + F.when(F.col("doc_id") % 7 == 1, 1_000_000_000_000).otherwise(0)
    observed = docs.select(path.alias("doc_id"), size.alias("size"), sha.alias("sha"))
    return cmp.compare(expected, observed, "doc_id", {"size": "SIZE_MISMATCH", "sha": "DIGEST_MISMATCH"})


@query(_MANIFEST + "SELECT doc_id, findings FROM f")
def manifest_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of all documents against one where some are renamed or changed: findings for each path; manifest_findings has the whole of it."""
    return _manifest(spark, sf_dir).select("doc_id", F.array_join("findings", ",").alias("findings"))


@query(
    _MANIFEST
    + """SELECT count(*) AS n_paths, count(*) FILTER (findings = 'MISSING') AS n_missing, count(*) FILTER (findings = 'UNEXPECTED') AS n_unexpected, count(*) FILTER (findings LIKE '%MISMATCH%') AS n_mismatch,
    CASE WHEN count(*) FILTER (findings <> '') > 0 THEN 'MISMATCH' ELSE 'EXACT_MATCH_FOR_EXPECTATION_SCOPE' END AS status FROM f"""
)
def manifest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One status for the comparison of complete file sets: any path that differs, lacks or is extra is a mismatch (``manifest_ladder`` has all rungs)."""
    has = lambda name: F.array_contains("findings", name)
    mismatch = has("SIZE_MISMATCH") | has("DIGEST_MISMATCH")
    counts = _manifest(spark, sf_dir).agg(F.count("*").alias("n_paths"), F.count_if(has("MISSING")).alias("n_missing"), F.count_if(has("UNEXPECTED")).alias("n_unexpected"), F.count_if(mismatch).alias("n_mismatch"))
    status = cmp.ladder([("MISMATCH", F.col("n_mismatch") + F.col("n_missing") + F.col("n_unexpected") > 0)], "EXACT_MATCH_FOR_EXPECTATION_SCOPE")
    return counts.withColumn("status", status)


@query("SELECT p_brand, count(*) AS n, count(DISTINCT (p_type, p_size)) AS n_distinct, count(DISTINCT (p_type, p_size)) = 1 AS unanimous FROM part GROUP BY 1")
def unanimity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all members of a group agree."""
    return evidence.unanimity(table(spark, sf_dir, "part"), "p_brand", "p_type", "p_size")


@query("SELECT l_orderkey, count(DISTINCT l_linenumber) AS n, min(l_linenumber) AS first, max(l_linenumber) AS last, max(l_linenumber) - min(l_linenumber) + 1 = count(DISTINCT l_linenumber) AS contiguous FROM lineitem GROUP BY 1")
def contiguous_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.contiguity(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("""WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), g AS (SELECT *, lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS after FROM d)
SELECT l_orderkey, unnest(generate_series(l_linenumber + 1, after - 1))::INT AS l_linenumber FROM g WHERE after > l_linenumber + 1""")
def missing_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinals that are missing inside a numbered set."""
    return sequences.missing_ordinals(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


_SPANS = "SELECT l_orderkey, l_linenumber, l_partkey % 1000 AS s, l_partkey % 1000 + l_quantity::BIGINT AS e FROM lineitem"


@query(f"""WITH t AS ({_SPANS}) SELECT l_orderkey, l_linenumber, s, e, coalesce(lag(e) OVER w > s, false) AS adjacent_overlap,
coalesce(max(e) OVER r > s, false) AS running_overlap, greatest(0, coalesce(s - max(e) OVER r, 0))::BIGINT AS gap FROM t
WINDOW w AS (PARTITION BY l_orderkey ORDER BY s, e, l_linenumber), r AS (PARTITION BY l_orderkey ORDER BY s, e, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def span_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-range checks: overlap with the span before, with any before, and gaps."""
    spans = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 1000).alias("s"), (F.col("l_partkey") % 1000 + F.col("l_quantity").cast("long")).alias("e"))
    return sequences.overlaps(spans, "l_orderkey", "s", "e", ["l_linenumber"])


_RULES = (("steel", "*STEEL*"), ("eco", "ECO*"), ("std", "STANDARD*"), ("promo", "PROMO*"))


@query("SELECT p_partkey, CASE WHEN p_type LIKE '%STEEL%' THEN 'steel' WHEN p_type LIKE 'ECO%' THEN 'eco' WHEN p_type LIKE 'STANDARD%' THEN 'std' WHEN p_type LIKE 'PROMO%' THEN 'promo' ELSE 'unclassified' END AS class FROM part")
def classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first glob rule that matches; inventory_classes has the whole of it."""
    rules = [(name, cmp.glob_pattern(g)) for name, g in _RULES]
    return table(spark, sf_dir, "part").select("p_partkey", cmp.matched(F.col("p_type"), rules, "unclassified").alias("class"))


@query("SELECT source, count(*) AS n, array_to_string(list_sort(list(DISTINCT doc_id))[1:12], ',') AS examples FROM documents WHERE source IS NOT NULL GROUP BY 1")
def descriptor_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group counts with a capped list of examples."""
    return evidence.examples(table(spark, sf_dir, "documents").where("source is not null"), "source", "doc_id", 12)


@query("SELECT l_returnflag, l_linestatus, year(l_shipdate) AS ship_year, count(*) AS n, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS cents FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), (year(l_shipdate)), ())")
def census_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("ship_year", F.year("l_shipdate").cast("long")).withColumn("c", F.round(F.col("l_extendedprice") * 100).cast("long"))
    flag, status, year = (F.col(c) for c in ("l_returnflag", "l_linestatus", "ship_year"))
    return rows.groupingSets([[flag, status], [flag], [year], []], flag, status, year).agg(F.count("*").alias("n"), F.sum("c").alias("cents"))


@query("""WITH r(rule, pattern, hi) AS (VALUES ('nation', 'NATION_{n}', 9), ('zone', 'ZONE_{n}', 3), ('late', 'NATION_{n}', 4)),
x AS (SELECT rule, replace(pattern, '{n}', unnest(generate_series(0, hi))::VARCHAR) AS name FROM r)
SELECT x.rule, x.name, count(n.n_nationkey) AS n_targets, CASE count(n.n_nationkey) WHEN 0 THEN 'UNMAPPED' WHEN 1 THEN 'MAPPED' ELSE 'AMBIGUOUS' END AS status FROM x LEFT JOIN nation n ON n.n_name = x.name GROUP BY 1, 2""")
def rule_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules expanded over an index, resolved against names: none, one or many; mapping_resolution has the whole of it."""
    rules = spark.createDataFrame([("nation", "NATION_{n}", 9), ("zone", "ZONE_{n}", 3), ("late", "NATION_{n}", 4)], "rule string, pattern string, hi int")
    names = rules.select("rule", "pattern", F.explode(F.sequence(F.lit(0), "hi")).alias("k")).select("rule", F.replace("pattern", F.lit("{n}"), F.col("k").cast("string")).alias("name"))
    counts = names.join(table(spark, sf_dir, "nation"), F.col("name") == F.col("n_name"), "left").groupBy("rule", "name").agg(F.count("n_nationkey").alias("n_targets"))
    return counts.withColumn("status", cmp.ladder([("UNMAPPED", F.col("n_targets") == 0), ("MAPPED", F.col("n_targets") == 1)], "AMBIGUOUS"))


@query("SELECT 'unlabelled' AS gap, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'unused', item_id FROM benchmark WHERE item_id NOT IN (SELECT doc_id FROM labels)")
def mapping_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What nothing maps to, from both sides: documents without a label, and items that no label has."""
    labels = table(spark, sf_dir, "labels")
    documents = evidence.missing_requirements(table(spark, sf_dir, "documents").select("doc_id"), labels, "doc_id")
    items = evidence.missing_requirements(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id")), labels, "doc_id")
    return documents.select(F.lit("unlabelled").alias("gap"), "doc_id").union(items.select(F.lit("unused"), "doc_id"))


@query("SELECT sha256(text) AS claim, count(*) AS n, count(DISTINCT lang) AS n_lang, min(doc_id) AS first_id, CASE WHEN count(DISTINCT lang) > 1 THEN 'CONFLICT' ELSE 'EXACT' END AS kind FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims made more than once: alike or in conflict."""
    rows = table(spark, sf_dir, "documents").where("text is not null").groupBy(F.sha2("text", 256).alias("claim")).agg(F.count("*").alias("n"), F.countDistinct("lang").alias("n_lang"), F.min("doc_id").alias("first_id"))
    return rows.where("n > 1").withColumn("kind", cmp.ladder([("CONFLICT", F.col("n_lang") > 1)], "EXACT"))


_PROFILE = ("click", "error", "purchase", "refund", "view")


@query("SELECT u.user_id, t.event_type FROM (SELECT DISTINCT user_id FROM events) u, (VALUES ('click'), ('error'), ('purchase'), ('refund'), ('view')) t(event_type) WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND e.event_type = t.event_type)")
def required_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required kinds of evidence that a subject lacks."""
    need = F.array(*map(F.lit, _PROFILE))
    have = F.collect_set(F.when(F.col("event_type").isin(*_PROFILE), F.col("event_type")))
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(have.alias("have"))
    return rows.select("user_id", F.explode(F.array_except(need, "have")).alias("event_type"))


_TURN = "conv_id::VARCHAR || ':' || turn::VARCHAR || ':' || role || ':' || coalesce(text, '')"
_ENTRY = lambda: F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", F.coalesce("text", F.lit("")))


@query(f"SELECT conv_id, turn, sha256({_TURN}) AS digest, lag(sha256({_TURN})) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM (SELECT * FROM conversations WHERE role IS NOT NULL QUALIFY count(*) OVER (PARTITION BY conv_id, turn) = 1)")
def custody_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entry's digest and that of its predecessor; entries that claim the same turn are forks and left out."""
    rows = table(spark, sf_dir, "conversations").where("role is not null").withColumn("claims", F.count("*").over(Window.partitionBy("conv_id", "turn"))).where("claims = 1")
    return sequences.linked(rows, "conv_id", "turn", _ENTRY()).select("conv_id", "turn", "digest", "previous")


@query(f"""WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, {_TURN}) AS k, {_TURN} AS entry FROM conversations WHERE role IS NOT NULL),
c AS (SELECT conv_id, k, sha256('|' || entry) AS head FROM t WHERE k = 1 UNION ALL SELECT t.conv_id, t.k, sha256(c.head || '|' || t.entry) FROM c JOIN t ON t.conv_id = c.conv_id AND t.k = c.k + 1)
SELECT conv_id, max(k) AS n, arg_max(head, k) AS head FROM c GROUP BY 1""")
def custody_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head of each hash chain."""
    rows = table(spark, sf_dir, "conversations").where("role is not null").withColumn("entry", _ENTRY())
    return sequences.chain_heads(rows, "conv_id", "turn", "entry")


@query("SELECT user_id, date_trunc('hour', ts)::TIMESTAMP AS epoch, count(DISTINCT event_type) AS n_claims FROM events GROUP BY 1, 2 HAVING count(DISTINCT event_type) > 1")
def timeline_forks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epochs for which a subject has conflicting claims; timeline_fork_kinds has the whole of it."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("epoch")).agg(F.countDistinct("event_type").alias("n_claims"))
    return rows.where("n_claims > 1")


@query("SELECT user_id, arg_max(event_type, (ts, ts + to_seconds(user_id % 600), event_type)) AS event_type, count(*) AS n FROM events WHERE ts + to_seconds(user_id % 600) <= TIMESTAMP '2024-01-01 12:00:00' GROUP BY 1")
def known_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest claim among those known at a cutoff; a claim is known some minutes after it takes effect; knowledge_states has the whole of it."""
    facts = table(spark, sf_dir, "events").withColumn("available", F.expr("timestampadd(SECOND, user_id % 600, ts)"))
    return sequences.known_as_of(facts, "user_id", "ts", "available", "2024-01-01 12:00:00", "event_type")


@query("SELECT user_id, max(epoch_us(ts)) AS last_us, CASE WHEN epoch_us(TIMESTAMP '2024-01-02 00:00:00') - max(epoch_us(ts)) <= 3600000000 THEN 'FRESH' ELSE 'STALE' END AS status FROM events WHERE ts <= TIMESTAMP '2024-01-02 00:00:00' GROUP BY 1")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether evidence is recent enough at a given time."""
    now = F.lit("2024-01-02 00:00:00").cast("timestamp")
    rows = table(spark, sf_dir, "events").where(F.col("ts") <= now).groupBy("user_id").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("last_us"))
    return rows.withColumn("status", cmp.ladder([("FRESH", F.unix_micros(now) - F.col("last_us") <= 3_600_000_000)], "STALE"))


_EDGES = "SELECT DISTINCT 'n' || c_nationkey AS src, 'c' || c_custkey AS dst FROM customer UNION SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders UNION SELECT 'r' || n_regionkey, 'n' || n_nationkey FROM nation"


@query(f"WITH RECURSIVE e AS ({_EDGES}), w AS (SELECT 'r1' AS node, 0 AS level UNION SELECT e.dst, w.level + 1 FROM w JOIN e ON e.src = w.node) SELECT node, min(level) AS level FROM w GROUP BY 1")
def revocation_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that depends on a revoked node."""
    read = lambda name, a, src, b, dst: table(spark, sf_dir, name).select(F.concat(F.lit(a), F.col(src).cast("string")).alias("src"), F.concat(F.lit(b), F.col(dst).cast("string")).alias("dst"))
    edges = read("nation", "r", "n_regionkey", "n", "n_nationkey").union(read("customer", "n", "c_nationkey", "c", "c_custkey")).union(read("orders", "c", "o_custkey", "o", "o_orderkey"))
    return graphs.reach(edges, spark.createDataFrame([("r1",)], "node string"))


@query("""SELECT l_orderkey, count(DISTINCT l_suppkey) AS n_signers, count(DISTINCT s_nationkey) AS n_roots, CASE WHEN count(DISTINCT l_suppkey) < 3 THEN 'NO_QUORUM' WHEN count(DISTINCT s_nationkey) < 2 THEN 'NOT_INDEPENDENT' ELSE 'MET' END AS status
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1""")
def quorum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enough signers, from enough independent roots; quorum_eval has the whole of it."""
    signed = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    counts = signed.groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias("n_signers"), F.countDistinct("s_nationkey").alias("n_roots"))
    return counts.withColumn("status", cmp.ladder([("NO_QUORUM", F.col("n_signers") < 3), ("NOT_INDEPENDENT", F.col("n_roots") < 2)], "MET"))


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'NOT_EVALUATED' WHEN l.toxic = 1 THEN 'REJECTED' WHEN l.quality = 1 THEN 'ACCEPTED' WHEN d.n_chars >= 1000 THEN 'REVIEW' ELSE 'REJECTED' END AS decision
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def policy_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions from evidence, by the first requirement that settles it; requirement_eval and policy_decisions have the whole of it."""
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "label_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(labels, F.col("doc_id") == F.col("label_id"), "left")
    rungs = [("NOT_EVALUATED", F.col("label_id").isNull()), ("REJECTED", F.col("toxic") == 1), ("ACCEPTED", F.col("quality") == 1), ("REVIEW", F.col("n_chars") >= 1000)]
    return rows.select("doc_id", cmp.ladder(rungs, "REJECTED").alias("decision"))


_QUANT = "SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings"


@query(f"""WITH v AS ({_QUANT}), s AS (SELECT vec_id, max(abs(x)) / 127 AS scale FROM v GROUP BY 1),
q AS (SELECT v.vec_id, x, CASE WHEN scale = 0 THEN 0 ELSE greatest(-127, least(127, sign(x / scale) * floor(abs(x / scale) + 0.5))) * scale END AS y FROM v JOIN s ON v.vec_id = s.vec_id)
SELECT vec_id, count(*) AS n, round(max(abs(y - x)), 6) AS max_error, round(avg(abs(y - x)), 6) AS mean_error, round(avg(y - x), 6) + 0.0 AS bias FROM q GROUP BY 1""")
def quant_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of symmetric 8-bit reconstruction, candidate less source, for each vector; without shuffling, since a vector is a row."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    scaled = rows.withColumn("scale", F.array_max(F.transform("v", F.abs)) / 127)
    level = lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.signum(x / F.col("scale")) * F.floor(F.abs(x / F.col("scale")) + 0.5)))
    error = F.transform("v", lambda x: F.when(F.col("scale") == 0, 0.0).otherwise(level(x) * F.col("scale")) - x)
    summed = lambda f: F.aggregate("error", F.lit(0.0), lambda acc, x: acc + f(x)) / F.size("error")
    out = scaled.withColumn("error", error)
    return out.select("vec_id", F.size("error").cast("long").alias("n"), F.round(F.array_max(F.transform("error", F.abs)), 6).alias("max_error"), F.round(summed(F.abs), 6).alias("mean_error"), (F.round(summed(lambda x: x), 6) + 0.0).alias("bias"))


@query("SELECT vec_id, label, ('0x' || substr(sha256('s1:' || vec_id::VARCHAR), 1, 15))::BIGINT % 1000 AS draw FROM embeddings WHERE ('0x' || substr(sha256('s1:' || vec_id::VARCHAR), 1, 15))::BIGINT % 1000 < 100")
def deterministic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample by digest; the sampling operator's share is a tenth."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", evidence.draw(F.col("vec_id"), "s1", 1000).alias("draw"))
    return rows.where("draw < 100")


@query("""WITH w AS (SELECT lang, unnest(string_split_regex(lower(text), '[^a-z]+')) AS token FROM documents WHERE lang IN ('en', 'de')),
c AS (SELECT lang, token, count(*) AS n FROM w WHERE token <> '' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS id FROM c),
a AS (SELECT token, id FROM r WHERE lang = 'en'), b AS (SELECT token, id FROM r WHERE lang = 'de')
SELECT coalesce(a.token, b.token) AS token, CASE WHEN b.id IS NULL THEN 'MISSING' WHEN a.id IS NULL THEN 'UNEXPECTED' WHEN a.id <> b.id THEN 'ID_MISMATCH' ELSE '' END AS findings FROM a FULL JOIN b ON a.token = b.token""")
def vocab_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two vocabularies, compared by token and id; ids are ranks by count; vocab_tokens and vocab_ids have the whole of it."""
    words = table(spark, sf_dir, "documents").where("lang in ('en', 'de')").select("lang", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("token"))
    counts = words.where("token <> ''").groupBy("lang", "token").agg(F.count("*").alias("n"))
    ranks = ranked(counts, ["lang"], [F.desc("n"), F.col("token")], "id")
    found = cmp.compare(ranks.where("lang = 'en'"), ranks.where("lang = 'de'"), "token", {"id": "ID_MISMATCH"})
    return found.select("token", F.array_join("findings", ",").alias("findings"))


@query("""SELECT user_id, count(*) AS n, count(*) FILTER (k IS NULL) AS n_missing, count(DISTINCT k) AS n_values, CASE WHEN count(k) = 0 THEN 'ABSENT' WHEN count(DISTINCT k) = 1 THEN 'EQUAL' ELSE 'DRIFT' END AS status
FROM (SELECT user_id, json_extract_string(props, '$.k') AS k FROM events) GROUP BY 1""")
def config_field_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One field of all of a subject's configurations: absent, equal or drifting; configuration_parity has the whole of it."""
    rows = table(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").alias("k"))
    counts = rows.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("k").isNull()).alias("n_missing"), F.countDistinct("k").alias("n_values"))
    return counts.withColumn("status", cmp.ladder([("ABSENT", F.col("n_missing") == F.col("n")), ("EQUAL", F.col("n_values") == 1)], "DRIFT"))


@query("SELECT l_suppkey, (sum(round(l_extendedprice * 100)::BIGINT) // gcd(sum(round(l_extendedprice * 100)::BIGINT)::BIGINT, sum(l_quantity::BIGINT)::BIGINT))::BIGINT AS numerator, (sum(l_quantity::BIGINT) // gcd(sum(round(l_extendedprice * 100)::BIGINT)::BIGINT, sum(l_quantity::BIGINT)::BIGINT))::BIGINT AS denominator FROM lineitem GROUP BY 1")
def exact_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios of integers in lowest terms."""
    sums = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("a"), F.sum(F.col("l_quantity").cast("long")).alias("b"))
    gcd = greatest_common_divisor(F.col("a"), F.col("b"))
    return sums.withColumn("g", gcd).select("l_suppkey", F.expr("a div g").alias("numerator"), F.expr("b div g").alias("denominator"))


@query("""WITH o AS (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linestatus = 'F'), n AS (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linestatus = 'O')
SELECT 'lost' AS change, * FROM (SELECT * FROM o EXCEPT SELECT * FROM n) UNION ALL SELECT 'added', * FROM (SELECT * FROM n EXCEPT SELECT * FROM o)""")
def preservation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pairs of part and supplier the open lines lost and added against the closed ones; one aggregation instead of two set differences."""
    lines = table(spark, sf_dir, "lineitem").where("l_linestatus in ('F', 'O')")
    seen = lambda status: F.bool_or(F.col("l_linestatus") == status)
    pairs = lines.groupBy("l_partkey", "l_suppkey").agg(seen("F").alias("old"), seen("O").alias("new")).where("old <> new")
    return pairs.select(F.when(F.col("old"), "lost").otherwise("added").alias("change"), "l_partkey", "l_suppkey")


@query("""SELECT doc_id, sha256('{"lang":' || coalesce('"' || lang || '"', 'null') || ',"n_chars":' || coalesce(n_chars::VARCHAR, 'null') || ',"source":' || coalesce('"' || source || '"', 'null') || '}') AS identity FROM documents""")
def canonical_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of a record's canonical JSON: keys in order, nulls kept, no spaces."""
    return table(spark, sf_dir, "documents").select("doc_id", identity(["lang", "n_chars", "source"]).alias("identity"))


@query("SELECT page_id, len(regexp_extract_all(html, '<script'))::BIGINT AS n_script, len(regexp_extract_all(html, 'https?://'))::BIGINT AS n_link, len(regexp_extract_all(html, '<iframe|javascript:|onerror='))::BIGINT AS n_active, CASE WHEN len(regexp_extract_all(html, '<iframe|javascript:|onerror=')) > 0 THEN 'BLOCK' WHEN len(regexp_extract_all(html, '<script')) > 0 THEN 'WARN' ELSE 'PASS' END AS verdict FROM pages WHERE html IS NOT NULL")
def security_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active content in text artifacts, and a verdict; page_scan, document_scan and security_eval have the whole of it."""
    count = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    rows = table(spark, sf_dir, "pages").where("html is not null").select("page_id", count("<script").alias("n_script"), count("https?://").alias("n_link"), count("<iframe|javascript:|onerror=").alias("n_active"))
    return rows.withColumn("verdict", cmp.ladder([("BLOCK", F.col("n_active") > 0), ("WARN", F.col("n_script") > 0)], "PASS"))
