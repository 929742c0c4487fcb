"""Queries of roll-ups and set-level checks."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators import rollups
from ledgerloom.plans.catalogue import query, table
from ledgerloom.plans.drawn import drawn, drawn_sql, one_of, one_of_sql

_MEMBERS = "m AS (SELECT l_returnflag || l_linestatus AS family, l_linenumber AS layer, l_quantity::BIGINT // 25 AS shape, l_partkey % 3 AS kind, l_orderkey || '.' || l_partkey || '.' || l_suppkey AS name FROM lineitem WHERE l_suppkey = 7 OR l_suppkey % 40 = 3)"
_POLICY = (("AF", (1, 2, 3), 0), ("NO", (1, 2, 9), 1), ("RF", (1, 2, 3, 4, 5, 6, 7), 0), ("ZZ", (1,), 0))


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_suppkey = 7 or l_suppkey % 40 = 3")
    return rows.select(F.concat("l_returnflag", "l_linestatus").alias("family"), F.col("l_linenumber").alias("layer"), F.floor(F.col("l_quantity") / 25).alias("shape"), (F.col("l_partkey") % 3).alias("kind"), F.concat_ws(".", "l_orderkey", "l_partkey", "l_suppkey").alias("name"))


@query(f"""WITH {_MEMBERS}, p(family, layers, shape) AS (VALUES {", ".join(f"('{f}', {list(ls)}, {s})" for f, ls, s in _POLICY)}), o AS (SELECT family, layer, count(*) AS n FROM m GROUP BY 1, 2),
s AS (SELECT family, sum(n)::BIGINT AS n, list(layer) AS held, coalesce(list(layer) FILTER (n > 1), []) AS twice FROM o GROUP BY 1), k AS (SELECT family, count(DISTINCT shape) AS ns, min(shape) AS sh, bool_and(kind IN (0, 1)) AS ok FROM m GROUP BY 1)
SELECT p.family, coalesce(n, 0) AS n, array_to_string(list_sort(list_filter(layers, lambda x: NOT list_contains(coalesce(held, []), x))), ',') AS missing, array_to_string(list_sort(coalesce(twice, [])), ',') AS duplicate, array_to_string(list_sort(list_filter(coalesce(held, []), lambda x: NOT list_contains(layers, x))), ',') AS unexpected,
coalesce(ns = 1 AND sh = p.shape, false) AS shape_ok, coalesce(ok, false) AS type_ok FROM p LEFT JOIN s ON s.family = p.family LEFT JOIN k ON k.family = p.family""")
def family_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every family of a policy: layers that lack, repeat or are beyond it, shapes and types."""
    policy = spark.createDataFrame([(f, list(ls), s, [0, 1]) for f, ls, s in _POLICY], "family string, layers array<int>, shape bigint, kinds array<bigint>")
    return rollups.family_summaries(_members(spark, sf_dir).withColumnRenamed("shape", "own_shape"), policy, "family", "layer", "own_shape", "kind")


@query(f"""WITH {_MEMBERS}, s AS (SELECT family, shape, count(*) AS n FROM m GROUP BY 1, 2), k AS (SELECT family, kind, count(*) AS n FROM m GROUP BY 1, 2)
SELECT family, count(*) AS n, (SELECT string_agg(shape || ':' || n, ',' ORDER BY shape || ':' || n) FROM s WHERE s.family = m.family) AS shapes, (SELECT string_agg(kind || ':' || n, ',' ORDER BY kind || ':' || n) FROM k WHERE k.family = m.family) AS kinds, array_to_string(list_sort(list(DISTINCT name))[1:3], ',') AS examples FROM m GROUP BY 1""")
def family_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of shapes and kinds by family, with three names."""
    return rollups.breakdown(_members(spark, sf_dir), "family", "shape", "kind", "name", 3)


_DOMAIN = ("view", "click", "purchase", "refund", "error", "archived")


@query(f"""SELECT d.value, count(event_id) AS n FROM (VALUES {", ".join(f"('{v}')" for v in _DOMAIN)}) d(value) LEFT JOIN events ON event_type = d.value GROUP BY 1""")
def state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over a whole domain, zeros kept."""
    return rollups.counts_over(table(spark, sf_dir, "events"), "event_type", _DOMAIN)


@query("""WITH f AS (SELECT l_orderkey AS k, l_linenumber || '/' || l_partkey || '/' || l_suppkey AS pos, sha256(len(l_partkey::VARCHAR) || ':' || l_partkey || ';' || CASE WHEN l_returnflag = 'N' THEN '-;' ELSE len(l_returnflag) || ':' || l_returnflag || ';' END) AS d FROM lineitem)
SELECT k, count(*) AS n, sha256(string_agg(d, '' ORDER BY pos, d)) AS digest FROM f GROUP BY 1""")
def member_set_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest of each set of members, whatever order they come in."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.concat_ws("/", "l_linenumber", "l_partkey", "l_suppkey").alias("at"), "l_partkey", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag"))
    return rollups.set_digests(rows, "k", "at", "l_partkey", "flag")


@query(f"""WITH l AS (SELECT user_id, event_id, ts, sha256(event_id::VARCHAR) AS d FROM events WHERE event_id % 10 > 0), t AS (SELECT user_id, arg_max(d, event_id) AS last FROM l GROUP BY 1),
n AS (SELECT user_id, CASE WHEN {drawn_sql("event_id", "again", 6)} = 0 THEN event_id + 1 ELSE event_id END AS claim, CASE WHEN {drawn_sql("event_id", "follows", 3)} > 0 THEN (SELECT last FROM t WHERE t.user_id = e.user_id) ELSE 'x' END AS previous FROM events e WHERE event_id % 10 = 0)
SELECT n.user_id, claim, CASE WHEN EXISTS (SELECT 1 FROM l WHERE l.user_id = n.user_id AND l.event_id = n.claim) THEN 'DUPLICATE_CLAIM' WHEN previous IS DISTINCT FROM (SELECT last FROM t WHERE t.user_id = n.user_id) THEN 'WRONG_PREDECESSOR' ELSE 'APPENDABLE' END AS status FROM n""")
def ledger_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether new entries may follow a chain."""
    events, key = table(spark, sf_dir, "events"), F.col("event_id")
    ledger = events.where("event_id % 10 > 0").select("user_id", F.col("event_id").alias("claim"), F.sha2(key.cast("string"), 256).alias("digest"), F.col("event_id").alias("seq"))
    last = ledger.groupBy("user_id").agg(F.max_by("digest", "seq").alias("tip"))
    new = events.where("event_id % 10 = 0").join(last, "user_id", "left").select("user_id", (key + F.when(drawn(key, "again", 6) == 0, 1).otherwise(0)).alias("claim"), F.when(drawn(key, "follows", 3) > 0, F.col("tip")).otherwise("x").alias("previous"))
    return rollups.appendable(ledger, new, "user_id", "seq", "claim", "digest", "previous")


@query(f"""WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) + CASE WHEN {drawn_sql("event_id", "jump", 200)} = 0 THEN 1000 ELSE 0 END AS seq, event_type, {one_of_sql("event_id", "class", "DECLARED", "OBSERVED", "VERIFIED")} AS cls, sha256(event_id::VARCHAR) AS d FROM events),
c AS (SELECT user_id, cls, count(*) AS n FROM e GROUP BY 1, 2) SELECT user_id, count(*) AS n, arg_min(d, seq) AS first_digest, arg_max(d, seq) AS last_digest, max(seq) - min(seq) + 1 = count(DISTINCT seq) AS contiguous, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds,
(SELECT string_agg(cls || ':' || n, ',' ORDER BY cls || ':' || n) FROM c WHERE c.user_id = e.user_id) AS authenticities FROM e GROUP BY 1""")
def ledger_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a ledger says of itself, rebuilt from its events."""
    key = F.col("event_id")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) + F.when(drawn(key, "jump", 200) == 0, 1000).otherwise(0)
    rows = table(spark, sf_dir, "events").select("user_id", seq.alias("seq"), "event_type", one_of(key, "class", "DECLARED", "OBSERVED", "VERIFIED").alias("cls"), F.sha2(key.cast("string"), 256).alias("digest"))
    return rollups.ledger_summaries(rows, "user_id", "seq", "event_type", "cls", "digest")


@query("""WITH e AS (SELECT c_custkey AS old, CASE c_custkey % 9 WHEN 0 THEN c_custkey ELSE c_custkey + 1 END AS new FROM customer WHERE c_custkey % 4 > 0 UNION ALL SELECT c_custkey, c_custkey + 2 FROM customer WHERE c_custkey % 20 = 1)
SELECT old AS c_custkey, count(DISTINCT new) AS n, CASE WHEN bool_or(old = new) THEN 'SELF' WHEN count(DISTINCT new) > 1 THEN 'AMBIGUOUS' ELSE 'SUPERSEDED' END AS status FROM e GROUP BY 1""")
def supersession_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What supersedes what: once, several times, or itself."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer")
    edges = rows.where("c_custkey % 4 > 0").select(k, F.when(k % 9 == 0, k).otherwise(k + 1).alias("new")).union(rows.where("c_custkey % 20 = 1").select(k, k + 2))
    return rollups.supersessions(edges, "c_custkey", "new")


@query("""WITH p AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN '../x' WHEN 1 THEN 'a/..\\b' WHEN 2 THEN '/abs' WHEN 3 THEN 'ok/..x' WHEN 4 THEN 'C:\\x' ELSE 'fine' END AS path, CASE WHEN page_id % 4 = 0 THEN 'symlink' ELSE 'file' END AS type FROM pages WHERE page_id % 10 < 8)
SELECT page_id, path AS entry, 'PATH_TRAVERSAL_ENTRY' AS finding FROM p WHERE page_id % 6 IN (0, 1, 2, 4) UNION ALL SELECT page_id, path, 'SYMLINK_ENTRY' FROM p WHERE type = 'symlink' UNION ALL SELECT page_id, NULL, CASE page_id % 10 WHEN 8 THEN 'MALFORMED_ARCHIVE' ELSE 'LIMIT_EXCEEDED' END FROM pages WHERE page_id % 10 >= 8""")
def archive_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of archives that leave their folder or are links."""
    k = F.col("page_id")
    path = F.element_at(F.array(*map(F.lit, ("../x", "a/..\\b", "/abs", "ok/..x", "C:\\x", "fine"))), (k % 6 + 1).cast("int"))
    entry = F.to_json(F.struct(path.alias("path"), F.when(k % 4 == 0, "symlink").otherwise("file").alias("type")))
    many = F.concat(F.lit('{"entries": ['), F.array_join(F.array_repeat(entry, 4), ","), F.lit("]}"))
    text = F.when(k % 10 == 8, F.lit("{broken")).when(k % 10 == 9, many).otherwise(F.concat(F.lit('{"entries": ['), entry, F.lit("]}")))
    return rollups.archive_findings(table(spark, sf_dir, "pages").select("page_id", text.alias("text")), "page_id", "text", 3)


@query(f"""WITH i AS (SELECT o_custkey AS s, CASE WHEN o_custkey % 3 = 0 THEN 'INSPECTED' ELSE {one_of_sql("o_orderkey", "item", *["INSPECTED"] * 6, "FAILED", "UNSUPPORTED", "NOT_CHECKED", "UNSUPPORTED")} END AS st, round(o_totalprice)::BIGINT AS b, CASE WHEN o_custkey % 6 = 3 AND {drawn_sql("o_orderkey", "short", 9)} = 0 THEN 1 ELSE 0 END AS short FROM orders)
SELECT s AS o_custkey, count(*) AS n_items, count(*) FILTER (st = 'INSPECTED') AS n_inspected, sum(b)::BIGINT AS declared, sum(b - short)::BIGINT AS inspected, CASE WHEN bool_or(st = 'FAILED') THEN 'FAILED' WHEN bool_or(st = 'UNSUPPORTED') AND count(*) FILTER (st = 'INSPECTED') = 0 THEN 'UNSUPPORTED'
WHEN bool_and(st = 'INSPECTED') AND sum(short) = 0 THEN 'COMPLETE_FOR_DECLARED_SCOPE' WHEN bool_or(st = 'INSPECTED') THEN 'PARTIAL' ELSE 'INCOMPLETE' END AS status FROM i GROUP BY 1""")
def scan_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each subject was inspected."""
    key, who = F.col("o_orderkey"), F.col("o_custkey")
    size = F.round("o_totalprice").cast("long")
    status = F.when(who % 3 == 0, "INSPECTED").otherwise(one_of(key, "item", *["INSPECTED"] * 6, "FAILED", "UNSUPPORTED", "NOT_CHECKED", "UNSUPPORTED"))
    short = F.when((who % 6 == 3) & (drawn(key, "short", 9) == 0), 1).otherwise(0)
    return rollups.scan_coverage(table(spark, sf_dir, "orders").select("o_custkey", status.alias("status"), size.alias("declared_bytes"), (size - short).alias("inspected_bytes")), "o_custkey")


@query("""SELECT o_orderkey, coalesce(bool_or(l.l_partkey IS NOT NULL), false) AS accepted FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_partkey % 50 = o.o_custkey % 50 AND l.l_returnflag = CASE WHEN o_orderstatus = 'F' THEN 'R' ELSE 'N' END AND l.l_quantity > 10 GROUP BY 1""")
def security_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that evidence of the same subject, digest and scope supports, where its coverage is complete."""
    links = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("subject"), (F.col("o_custkey") % 50).alias("digest"), F.when(F.col("o_orderstatus") == "F", "R").otherwise("N").alias("scope"))
    evidence = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("subject"), (F.col("l_partkey") % 50).alias("digest"), F.col("l_returnflag").alias("scope"), (F.col("l_quantity") > 10).alias("complete"))
    return rollups.bound(links, evidence, ["subject", "digest", "scope"], "o_orderkey")


_BSTATES = ("VERIFIED_BY_TRUST_BUNDLE", "EVIDENCE_LINKED", "DECLARED", "REVOKED")


@query(f"""WITH b AS (SELECT s_suppkey AS id, s_suppkey % 60 AS key_id, s_nationkey + CASE WHEN s_suppkey % 12 = 0 THEN 100 ELSE 0 END AS identity, CASE WHEN s_suppkey % 8 = 1 THEN TIMESTAMP '2003-01-01' END AS nb, CASE WHEN s_suppkey % 8 = 2 THEN TIMESTAMP '1999-01-01' END AS na, {one_of_sql("s_suppkey", "bstate", *_BSTATES)} AS st FROM supplier),
r AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 15 > 0 THEN l_suppkey + CASE WHEN l_partkey % 33 = 1 THEN 10000 ELSE 0 END END AS bid, l_suppkey % 60 + CASE WHEN l_partkey % 21 = 2 THEN 1 ELSE 0 END AS key_id FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN bid IS NULL THEN 'UNAVAILABLE' WHEN b.id IS NULL OR b.key_id <> r.key_id OR NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = identity) THEN 'BROKEN' WHEN na < TIMESTAMP '2001-01-01' THEN 'EXPIRED' WHEN nb > TIMESTAMP '2001-01-01' THEN 'BROKEN' WHEN st = 'VERIFIED_BY_TRUST_BUNDLE' THEN 'VERIFIED' ELSE st END AS result FROM r LEFT JOIN b ON b.id = bid""")
def signer_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the key of each signature is bound to a known signer."""
    k, p = F.col("s_suppkey"), F.col("l_partkey")
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    held = table(spark, sf_dir, "supplier").select(
        k.alias("binding_id"), (k % 60).alias("key_id"), (F.col("s_nationkey") + F.when(k % 12 == 0, 100).otherwise(0)).alias("identity"), F.when(k % 8 == 1, at("2003-01-01")).alias("not_before"), F.when(k % 8 == 2, at("1999-01-01")).alias("not_after"), one_of(k, "bstate", *_BSTATES).alias("state"),
    )
    records = table(spark, sf_dir, "lineitem").select(F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("sig"), F.when(p % 15 > 0, F.col("l_suppkey") + F.when(p % 33 == 1, 10000).otherwise(0)).alias("binding_id"), (F.col("l_suppkey") % 60 + F.when(p % 21 == 2, 1).otherwise(0)).alias("key_id"))
    found = rollups.bindings(records, held, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("identity")), "sig", at("2001-01-01"))
    return found.select("sig.*", "result")


@query("""SELECT 'lineitem' AS "table", 'l_orderkey' AS "column", (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')) AS n_broken UNION ALL SELECT 'orders', 'o_custkey', (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P' AND o_custkey NOT IN (SELECT c_custkey FROM customer)) UNION ALL SELECT 'labels', 'doc_id', (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))""")
def bundle_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References within a bundle that lead nowhere."""
    bundle = {n: table(spark, sf_dir, n) for n in ("lineitem", "customer", "labels", "documents")} | {"orders": table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")}
    return rollups.bundle_references(bundle, [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("labels", "doc_id", "documents", "doc_id")])


@query(f"""SELECT l_orderkey, CASE WHEN bool_and({drawn_sql("l_orderkey * 10 + l_linenumber", "control", 12)} > 0) THEN CASE WHEN bool_or(l_returnflag = 'R') THEN 'EQUIVALENCE_WITH_QUANTIZATION_DIFFERENCES' ELSE 'EQUIVALENCE_WITH_LIMITATIONS' END WHEN bool_or(l_linestatus = 'F') THEN 'DIFFERENT' ELSE 'INCOMPARABLE' END AS result FROM lineitem GROUP BY 1""")
def structural_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of each comparison from its controls."""
    held = drawn(F.col("l_orderkey") * 10 + F.col("l_linenumber"), "control", 12) > 0
    sums = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_and(held).alias("controls"), F.bool_or(F.col("l_returnflag") == "R").alias("changes"), F.bool_or(F.col("l_linestatus") == "F").alias("compatible"))
    return sums.select("l_orderkey", rollups.overall_comparison({"controls": F.col("controls")}, F.col("changes"), F.col("compatible")).alias("result"))


_CLASSES = ("REQUIRED_EQUAL", "ALLOWED_DIFFERENT", "INFORMATIONAL")


@query(f"""WITH x AS (SELECT c_custkey, f.f AS field, {one_of_sql("f.f", "class", *_CLASSES)} AS cls, c_nationkey AS a, CASE WHEN {drawn_sql("c_custkey || f.f", "other", 5)} = 0 THEN c_nationkey + 1 WHEN {drawn_sql("c_custkey || f.f", "other", 5)} = 1 THEN NULL ELSE c_nationkey END AS b FROM customer, (VALUES ('repo'), ('revision'), ('name'), ('size'), ('owner')) f(f))
SELECT c_custkey, field, CASE WHEN a IS NOT DISTINCT FROM b THEN 'EQUAL' WHEN cls = 'ALLOWED_DIFFERENT' THEN 'DIFFERENT_ALLOWED' WHEN cls = 'INFORMATIONAL' THEN 'INFORMATIONAL' ELSE 'DIFFERENT_UNEXPECTED' END AS status FROM x""")
def identity_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of two identities by the class of each."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.explode(F.array(*map(F.lit, ("repo", "revision", "name", "size", "owner")))).alias("field"))
    key = drawn(F.concat(F.col("c_custkey").cast("string"), F.col("field")), "other", 5)
    other = F.when(key == 0, F.col("c_nationkey") + 1).when(key == 1, None).otherwise(F.col("c_nationkey"))
    return rows.select("c_custkey", "field", rollups.value_statuses(F.col("c_nationkey"), other, one_of(F.col("field"), "class", *_CLASSES)).alias("status"))


_RESULTS = ("PASS", "PASS", "PASS", "WARN", "UNAVAILABLE", "NOT_CHECKED")


@query(f"""WITH l AS (SELECT l_orderkey AS k, l_linenumber AS stage, {one_of_sql("l_linenumber + l_orderkey % 5", "result", *_RESULTS)} AS st FROM lineitem GROUP BY 1, 2, 3), r AS (SELECT k, stage, CASE WHEN {drawn_sql("k * 10 + stage", "moved", 20)} = 0 THEN {one_of_sql("k * 10 + stage", "to", *_RESULTS)} ELSE st END AS st FROM l WHERE {drawn_sql("k * 10 + stage", "kept", 60)} > 0),
j AS (SELECT coalesce(l.k, r.k) AS k, l.st AS a, r.st AS b FROM l FULL JOIN r ON l.k = r.k AND l.stage = r.stage) SELECT k, bool_and(a IS NOT DISTINCT FROM b) AS equal, bool_and(a IS NOT DISTINCT FROM b OR NOT (coalesce(a, '') IN ('UNAVAILABLE', 'NOT_CHECKED') OR coalesce(b, '') IN ('UNAVAILABLE', 'NOT_CHECKED'))) AS apart_equal FROM j GROUP BY 1""")
def validation_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages of two validations: the whole map, and the stages that could not be checked."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("stage")).distinct().withColumn("st", one_of(F.col("stage") + F.col("k") % 5, "result", *_RESULTS))
    key = F.col("k") * 10 + F.col("stage")
    other = lines.where(drawn(key, "kept", 60) > 0).withColumn("st", F.when(drawn(key, "moved", 20) == 0, one_of(key, "to", *_RESULTS)).otherwise(F.col("st")))
    return rollups.whole_maps(lines, other, "k", "stage", "st", ["UNAVAILABLE", "NOT_CHECKED"])


@query("""SELECT l_suppkey, l_partkey % 500 AS name, arg_max(l_returnflag, (l_orderkey, l_linenumber, l_partkey)) AS kind, arg_max(l_partkey, (l_orderkey, l_linenumber, l_partkey)) AS part FROM lineitem GROUP BY 1, 2""")
def last_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last of the rows that share a name."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_partkey") % 500).alias("name"), F.col("l_returnflag").alias("kind"), F.col("l_partkey").alias("part"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("at"))
    return rollups.latest_by_name(rows, "l_suppkey", "name", "at").drop("at")


@query("""WITH n AS (SELECT 'model.layers.' || (l_suppkey % 93) || '.mlp.experts.' || (l_partkey % 8) || '.w' || (l_linenumber % 3) AS name FROM lineitem) SELECT 'model.layers.{layer}.mlp.experts.{expert}.' || split_part(name, '.', 7) AS family, count(*) AS n, count(DISTINCT name) AS n_names FROM n GROUP BY 1""")
def name_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without their numbers."""
    name = F.concat(F.lit("model.layers."), (F.col("l_suppkey") % 93).cast("string"), F.lit(".mlp.experts."), (F.col("l_partkey") % 8).cast("string"), F.lit(".w"), (F.col("l_linenumber") % 3).cast("string"))
    return table(spark, sf_dir, "lineitem").select(name.alias("name")).groupBy(rollups.name_family(F.col("name")).alias("family")).agg(F.count("*").alias("n"), F.countDistinct("name").alias("n_names"))


@query("""WITH p AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages), x AS (SELECT page_id, path, unnest(['', split_part(path, '/', 1), split_part(path, '/', 1) || '/fr', 'th']) AS prefix FROM p)
SELECT page_id, prefix, prefix = '' OR path = prefix OR starts_with(path, prefix || '/') AS inside FROM x""")
def prefix_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths inside prefixes, at borders of components."""
    path = F.regexp_replace("url", "^https?://", "")
    host = F.split_part(path, F.lit("/"), F.lit(1))
    rows = table(spark, sf_dir, "pages").select("page_id", path.alias("path"), F.explode(F.array(F.lit(""), host, F.concat(host, F.lit("/fr")), F.lit("th"))).alias("prefix"))
    return rows.select("page_id", "prefix", rollups.within_prefix(F.col("path"), F.col("prefix")).alias("inside"))


@query("""WITH f AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'R'), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS place, count(*) OVER (PARTITION BY l_suppkey) AS total FROM f) SELECT * FROM r WHERE place <= 5""")
def report_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's first five findings of each scope, with the total; the limit is the report's."""
    rows = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")
    return rollups.limited(rows, "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey"], 5)
