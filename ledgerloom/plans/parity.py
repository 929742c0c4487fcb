"""Queries of parity: two languages' vocabularies, roles of conversations as backends, and numeric fidelity of vectors."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import numeric, parity
from ledgerloom.operators.written import ranked
from ledgerloom.plans.catalogue import query, table
from ledgerloom.plans.drawn import drawn, drawn_sql, one_of, one_of_sql

_VOCAB = """w AS (SELECT lang, unnest(string_split_regex(lower(text), '[^a-z]+')) AS token FROM documents WHERE lang IN ('en', 'de')),
c AS (SELECT lang, token, count(*) AS n FROM w WHERE token <> '' GROUP BY 1, 2), v AS (SELECT lang, token, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS id FROM c)"""


def _vocabularies(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").where("lang in ('en', 'de')").select("lang", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("token"))
    return ranked(words.where("token <> ''").groupBy("lang", "token").agg(F.count("*").alias("n")), ["lang"], [F.desc("n"), F.col("token")], "id")


@query(f"""WITH {_VOCAB}, e AS (SELECT * FROM v WHERE lang = 'en'), d AS (SELECT * FROM v WHERE lang = 'de')
SELECT coalesce(e.token, d.token) AS token, CASE WHEN e.token IS NULL THEN 'EXTRA_CANDIDATE_TOKEN' WHEN d.token IS NULL THEN 'TOKEN_MISSING_FROM_CANDIDATE' WHEN e.id <> d.id THEN 'TOKEN_ID_MISMATCH' ELSE 'TOKEN_TO_ID_MATCH' END AS finding FROM e FULL JOIN d ON e.token = d.token""")
def vocab_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids by token."""
    rows = _vocabularies(spark, sf_dir)
    return parity.tokens_to_ids(rows.where("lang = 'en'"), rows.where("lang = 'de'"), "token", "id")


@query(f"""WITH {_VOCAB}, e AS (SELECT * FROM v WHERE lang = 'en'), d AS (SELECT * FROM v WHERE lang = 'de'), x AS (SELECT e.token AS a, d.token AS b FROM e FULL JOIN d ON e.id = d.id)
SELECT count(*) AS n_compared, count(*) FILTER (a IS DISTINCT FROM b) AS n_mismatches, CASE WHEN count(*) FILTER (a IS DISTINCT FROM b) > 0 THEN 'MISMATCH' ELSE 'OBSERVED' END AS status FROM x""")
def vocab_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by id."""
    rows = _vocabularies(spark, sf_dir)
    return parity.ids_to_tokens(rows.where("lang = 'en'"), rows.where("lang = 'de'"), "token", "id")


_BASES = ("RECORD_COUNT", "DISTINCT_TOKEN_COUNT", "DISTINCT_ID_COUNT", "MAX_ID_PLUS_ONE", "BASE_VOCABULARY_COUNT", "TOTAL_WITH_ADDED_TOKENS")


@query("""WITH e AS (SELECT l_suppkey AS side, l_partkey % 997 AS token, CASE WHEN l_suppkey % 3 = 0 THEN l_partkey % 997 ELSE l_linenumber END AS id FROM lineitem WHERE l_suppkey % 3 > 0 OR l_linenumber = 1 QUALIFY l_suppkey % 3 > 0 OR row_number() OVER (PARTITION BY l_suppkey, l_partkey % 997) = 1),
s AS (SELECT side, count(*) AS n_records, count(DISTINCT token) AS n_tokens, count(DISTINCT id) AS n_ids, max(id) + 1 AS top FROM e GROUP BY 1),
b AS (SELECT *, n_records = n_tokens AND n_records = n_ids AS comparable, CASE WHEN side % 4 > 0 THEN n_tokens END AS base, unnest(['RECORD_COUNT', 'DISTINCT_TOKEN_COUNT', 'DISTINCT_ID_COUNT', 'MAX_ID_PLUS_ONE', 'BASE_VOCABULARY_COUNT', 'TOTAL_WITH_ADDED_TOKENS']) AS basis FROM s),
x AS (SELECT *, (CASE basis WHEN 'RECORD_COUNT' THEN n_records WHEN 'DISTINCT_TOKEN_COUNT' THEN n_tokens WHEN 'DISTINCT_ID_COUNT' THEN n_ids WHEN 'MAX_ID_PLUS_ONE' THEN top WHEN 'BASE_VOCABULARY_COUNT' THEN base ELSE base + 3 END)::BIGINT AS observed, CASE WHEN side % 5 > 0 THEN n_tokens END AS declared FROM b)
SELECT side, comparable, basis, observed, CASE WHEN declared IS NULL THEN 'REQUIRED_INPUT_MISSING' WHEN observed IS NULL THEN 'NOT_EVALUATED' WHEN declared = observed THEN 'CONSISTENT_FOR_DECLARED_RULE' ELSE 'INCONSISTENT_FOR_DECLARED_RULE' END AS status FROM x""")
def vocab_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabularies that are ambiguous, and their sizes by six bases against a declared one."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("side"), (F.col("l_partkey") % 997).alias("token"), "l_linenumber")
    plain = lines.where("side % 3 > 0").withColumn("id", F.col("l_linenumber").cast("long"))
    clean = lines.where("side % 3 = 0 and l_linenumber = 1").dropDuplicates(["side", "token"]).withColumn("id", F.col("token"))
    sums = parity.ambiguity(plain.union(clean), "side", "token", "id")
    base = F.when(F.col("side") % 4 > 0, F.col("n_tokens"))
    listed = F.explode(F.array(*(F.struct(F.lit(b).alias("basis"), parity.cardinality(b, base, F.lit(3)).alias("observed")) for b in _BASES)))
    return sums.select("side", "comparable", F.when(F.col("side") % 5 > 0, F.col("n_tokens")).alias("declared"), listed.alias("x")).select("side", "comparable", "x.basis", "x.observed", parity.size_rule(F.col("declared"), F.col("x.observed")).alias("status"))


_TOKEN_FIELDS = ("token_id", "special", "lstrip", "normalized")
_ADDED = f"""r AS (SELECT l_orderkey AS k, l_linenumber AS tok, min(l_partkey) AS token_id, CASE WHEN bool_or(l_quantity > 25) THEN true END AS special, bool_or(l_tax > 0.04) AS lstrip, min(l_returnflag) AS normalized FROM lineitem GROUP BY 1, 2),
c AS (SELECT k, tok, token_id + CASE WHEN {drawn_sql("k * 10 + tok", "id", 30)} = 0 THEN 1 ELSE 0 END AS token_id, CASE WHEN {drawn_sql("k * 10 + tok", "special", 30)} = 0 THEN false ELSE special END AS special, lstrip <> ({drawn_sql("k * 10 + tok", "strip", 40)} = 0) AS lstrip, normalized FROM r WHERE {drawn_sql("k * 10 + tok", "kept", 25)} > 0
UNION ALL SELECT k, tok + 100, token_id, special, lstrip, normalized FROM r WHERE {drawn_sql("k * 10 + tok", "more", 40)} = 0)"""


@query(f"""WITH {_ADDED}, j AS (SELECT coalesce(r.k, c.k) AS k, coalesce(r.tok, c.tok) AS tok, r.k IS NULL OR c.k IS NULL AS alone, concat_ws(',', CASE WHEN r.token_id IS DISTINCT FROM c.token_id THEN 'token_id' END, CASE WHEN r.special IS DISTINCT FROM c.special THEN 'special' END, CASE WHEN r.lstrip IS DISTINCT FROM c.lstrip THEN 'lstrip' END, CASE WHEN r.normalized IS DISTINCT FROM c.normalized THEN 'normalized' END) AS ch
FROM r FULL JOIN c ON r.k = c.k AND r.tok = c.tok) SELECT k, tok, CASE WHEN alone THEN 'ADDED_TOKEN_MISSING' WHEN ch <> '' THEN 'ADDED_TOKEN_PROPERTY_MISMATCH' ELSE 'ADDED_TOKEN_PROPERTIES_MATCH' END AS finding, CASE WHEN alone THEN '' ELSE ch END AS changed FROM j""")
def added_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added tokens by their properties; absent and false differ."""
    key = F.col("k") * 10 + F.col("tok")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("tok"))
    own = lines.agg(F.min("l_partkey").alias("token_id"), F.when(F.bool_or(F.col("l_quantity") > 25), True).alias("special"), F.bool_or(F.col("l_tax") > 0.04).alias("lstrip"), F.min("l_returnflag").alias("normalized"))
    kept = own.where(drawn(key, "kept", 25) > 0).select(
        "k", "tok", (F.col("token_id") + F.when(drawn(key, "id", 30) == 0, 1).otherwise(0)).alias("token_id"), F.when(drawn(key, "special", 30) == 0, False).otherwise(F.col("special")).alias("special"),
        (F.col("lstrip") != (drawn(key, "strip", 40) == 0)).alias("lstrip"), "normalized",
    )
    more = own.where(drawn(key, "more", 40) == 0).withColumn("tok", F.col("tok") + 100)
    return parity.keyed_properties(own, kept.union(more), ["k", "tok"], _TOKEN_FIELDS, "ADDED_TOKEN_MISSING", "ADDED_TOKEN_PROPERTY_MISMATCH", "ADDED_TOKEN_PROPERTIES_MATCH")


@query(f"""WITH r AS (SELECT c_nationkey AS model, c_mktsegment AS role, min(c_name) AS content, min(c_custkey) AS token_id FROM customer GROUP BY 1, 2), c AS (SELECT model, role, content || CASE WHEN {drawn_sql("model || role", "content", 12)} = 0 THEN '!' ELSE '' END AS content, CASE WHEN {drawn_sql("model || role", "id", 12)} > 0 THEN token_id END AS token_id FROM r WHERE {drawn_sql("model || role", "kept", 12)} > 0)
SELECT r.model, r.role, CASE WHEN c.model IS NULL THEN 'SPECIAL_TOKEN_ROLE_MISMATCH' WHEN r.content IS DISTINCT FROM c.content OR r.token_id IS DISTINCT FROM c.token_id THEN 'SPECIAL_TOKEN_ROLE_ID_MISMATCH' ELSE 'SPECIAL_TOKEN_ROLE_MATCH' END AS finding FROM r LEFT JOIN c USING (model, role)""")
def special_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Special tokens by role."""
    key = F.concat(F.col("model").cast("string"), F.col("role"))
    own = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("model"), F.col("c_mktsegment").alias("role")).agg(F.min("c_name").alias("content"), F.min("c_custkey").alias("token_id"))
    other = own.where(drawn(key, "kept", 12) > 0).select("model", "role", F.concat("content", F.when(drawn(key, "content", 12) == 0, "!").otherwise("")).alias("content"), F.when(drawn(key, "id", 12) > 0, F.col("token_id")).alias("token_id"))
    return parity.keyed_properties(own, other, ["model", "role"], ["content", "token_id"], "SPECIAL_TOKEN_ROLE_MISMATCH", "SPECIAL_TOKEN_ROLE_ID_MISMATCH", "SPECIAL_TOKEN_ROLE_MATCH").drop("changed")


_KINDS = ("NORMALIZER", "PRE_TOKENIZER", "MODEL", "DECODER")
_COMPONENTS = f"""r AS (SELECT l_orderkey AS model, l_linenumber AS place, l_linenumber AS position, {one_of_sql("l_linenumber", "kind", *_KINDS)} AS kind, min(l_returnflag) AS type, min(l_partkey) AS parameters, {drawn_sql("l_orderkey * 10 + l_linenumber", "opaque", 15)} = 0 AS opaque FROM lineitem GROUP BY 1, 2),
c AS (SELECT model, place, position + CASE WHEN {drawn_sql("model * 10 + place", "order", 30)} = 0 THEN 1 ELSE 0 END AS position, kind, CASE WHEN {drawn_sql("model * 10 + place", "type", 30)} = 0 THEN 'Z' ELSE type END AS type, parameters + CASE WHEN {drawn_sql("model * 10 + place", "parameters", 20)} = 0 THEN 1 ELSE 0 END AS parameters, opaque FROM r WHERE NOT (place = 1 AND model % 50 = 0)
UNION ALL SELECT model, 9, 9, kind, type, parameters, opaque FROM r WHERE place = 2 AND model % 40 = 0)"""


@query(f"""WITH {_COMPONENTS} SELECT coalesce(r.model, c.model) AS model, coalesce(r.place, c.place) AS place, CASE WHEN r.model IS NULL THEN 'COMPONENT_EXTRA' WHEN c.model IS NULL THEN 'COMPONENT_MISSING' WHEN r.position <> c.position THEN 'COMPONENT_ORDER_MISMATCH' WHEN r.kind <> c.kind OR r.type <> c.type THEN 'COMPONENT_TYPE_MISMATCH'
WHEN r.parameters <> c.parameters THEN 'COMPONENT_PARAMETER_MISMATCH' WHEN r.opaque OR c.opaque THEN 'OPAQUE_COMPONENT_PRESENT' ELSE 'PIPELINE_STRUCTURE_MATCH' END AS finding FROM r FULL JOIN c ON r.model = c.model AND r.place = c.place""")
def pipeline_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of tokenizer pipelines, place by place."""
    key = F.col("model") * 10 + F.col("place")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("model"), F.col("l_linenumber").alias("place")).agg(F.min("l_returnflag").alias("type"), F.min("l_partkey").alias("parameters"))
    own = lines.select("model", "place", F.col("place").alias("position"), one_of(F.col("place"), "kind", *_KINDS).alias("kind"), "type", "parameters", (drawn(key, "opaque", 15) == 0).alias("opaque"))
    kept = own.where("not (place = 1 and model % 50 = 0)").select(
        "model", "place", (F.col("position") + F.when(drawn(key, "order", 30) == 0, 1).otherwise(0)).alias("position"), "kind", F.when(drawn(key, "type", 30) == 0, "Z").otherwise(F.col("type")).alias("type"),
        (F.col("parameters") + F.when(drawn(key, "parameters", 20) == 0, 1).otherwise(0)).alias("parameters"), "opaque",
    )
    more = own.where("place = 2 and model % 40 = 0").withColumn("place", F.lit(9)).withColumn("position", F.lit(9))
    return parity.pipelines(own, kept.union(more), "model")


@query(f"""WITH t AS (SELECT doc_id, coalesce(lang, 'none') AS a, CASE WHEN {drawn_sql("doc_id", "language", 9)} = 0 THEN 'other' ELSE coalesce(lang, 'none') END AS b, sha256(coalesce(text, '')) AS x, sha256(coalesce(text, '') || CASE WHEN {drawn_sql("doc_id", "content", 9)} = 0 THEN ' ' ELSE '' END) AS y FROM documents)
SELECT doc_id, concat_ws(',', CASE WHEN a <> b THEN 'TEMPLATE_LANGUAGE_MISMATCH' END, CASE WHEN x = y THEN 'TEMPLATE_EXACT_CONTENT_MATCH' ELSE 'TEMPLATE_CONTENT_MISMATCH' END, 'TEMPLATE_PRESENT_NOT_EXECUTED') AS findings FROM t""")
def template_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates by language and digest."""
    text, lang = F.coalesce("text", F.lit("")), F.coalesce("lang", F.lit("none"))
    other = F.when(drawn(F.col("doc_id"), "language", 9) == 0, "other").otherwise(lang)
    changed = F.concat(text, F.when(drawn(F.col("doc_id"), "content", 9) == 0, " ").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", parity.template_findings(lang, other, F.sha2(text, 256), F.sha2(changed, 256)).alias("findings"))


_PATHS = ("dim", "layers", "heads", "vocab", "extra")
_FIELDS = f"""f AS (SELECT c_custkey AS k, p.path, {one_of_sql("c_custkey || p.path", "presence", "VALUE", "VALUE", "VALUE", "NULL")} AS presence, c_nationkey::VARCHAR AS value FROM customer, (VALUES {", ".join(f"('{p}')" for p in _PATHS)}) p(path) WHERE c_custkey % 4 = 0 OR {drawn_sql("c_custkey || p.path", "there", 40)} > 0),
g AS (SELECT k, CASE WHEN path = 'heads' THEN 'n_heads' ELSE path END AS path, presence, CASE WHEN k % 3 > 0 AND {drawn_sql("k || path", "differs", 25)} = 0 THEN value || 'x' ELSE value END AS value FROM f WHERE k % 5 > 0 OR {drawn_sql("k || path", "lost", 30)} > 0)"""


@query(f"""WITH {_FIELDS}, q(path, other, may) AS (VALUES ('dim', 'dim', false), ('layers', 'layers', false), ('heads', 'n_heads', false), ('vocab', 'vocab', true)), c AS (SELECT DISTINCT k FROM (SELECT k FROM f UNION ALL SELECT k FROM g)),
j AS (SELECT c.k, q.may, f.k IS NULL OR g.k IS NULL AS lacks, f.presence IS DISTINCT FROM g.presence OR f.value IS DISTINCT FROM g.value AS differs FROM c CROSS JOIN q LEFT JOIN f ON f.k = c.k AND f.path = q.path LEFT JOIN g ON g.k = c.k AND g.path = q.other),
s AS (SELECT k, count(*) FILTER (NOT lacks) AS n_compared, count(*) FILTER (lacks OR (differs AND NOT may)) AS n_mismatches FROM j GROUP BY 1)
SELECT k, n_compared, n_mismatches, CASE WHEN n_mismatches > 0 THEN 'FIELD_MISMATCH' WHEN k % 3 = 0 THEN 'EXACT_RAW_BYTES_FOR_SCOPE' WHEN k % 3 = 1 THEN 'CANONICAL_JSON_EQUAL_FOR_SCOPE' ELSE 'FIELD_PARITY_FOR_DECLARED_SCOPE' END AS status FROM s""")
def configuration_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required fields of pairs of configurations, under aliases and allowed transformations."""
    key = F.concat(F.col("k").cast("string"), F.col("path"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.explode(F.array(*map(F.lit, _PATHS))).alias("path"), F.col("c_nationkey").cast("string").alias("value"))
    own = rows.where((F.col("k") % 4 == 0) | (drawn(key, "there", 40) > 0)).withColumn("presence", one_of(key, "presence", "VALUE", "VALUE", "VALUE", "NULL"))
    changed = F.when((F.col("k") % 3 > 0) & (drawn(key, "differs", 25) == 0), F.concat("value", F.lit("x"))).otherwise(F.col("value"))
    other = own.where((F.col("k") % 5 > 0) | (drawn(key, "lost", 30) > 0)).withColumn("value", changed).withColumn("path", F.when(F.col("path") == "heads", "n_heads").otherwise(F.col("path")))
    third = F.col("k") % 3
    said = lambda df, side, raw, canonical: df.select("k", F.lit(side).alias("side"), "path", "presence", F.lit("STRING").alias("type"), "value", raw.alias("raw"), canonical.alias("canonical"))
    fields = said(own, "reference", F.lit("a"), F.lit("a")).union(said(other, "candidate", F.when(third == 0, "a").otherwise("b"), F.when(third < 2, "a").otherwise("b")))
    return parity.configurations(fields, "k", ["dim", "layers", "heads", "vocab"], {"heads": "n_heads"}, ["vocab"])


_PROBES = f"""p AS (SELECT conv_id, turn AS probe_id, role, {one_of_sql("conv_id * 100 + turn", "kind", "ENCODE", "DECODE", "RENDER")} AS kind, {drawn_sql("conv_id * 100 + turn", "digest", 25)} = 0 AS digest_only, max(coalesce(text, '')) AS output FROM conversations WHERE role IS NOT NULL GROUP BY 1, 2, 3),
a AS (SELECT conv_id, probe_id, kind, digest_only, max(output) AS output FROM p GROUP BY 1, 2, 3, 4), b AS (SELECT conv_id, probe_id, CASE WHEN {drawn_sql("conv_id * 100 + probe_id", "kinds", 30)} = 0 THEN 'OTHER' ELSE kind END AS kind, digest_only, output || CASE WHEN {drawn_sql("conv_id * 100 + probe_id", "output", 20)} = 0 THEN '?' ELSE '' END AS output FROM a WHERE {drawn_sql("conv_id * 100 + probe_id", "kept", 20)} > 0),
f AS (SELECT a.conv_id, a.probe_id, CASE WHEN b.conv_id IS NULL THEN 'PROBE_RESULT_UNAVAILABLE' WHEN a.kind <> b.kind THEN 'PROBE_KIND_MISMATCH' WHEN a.digest_only THEN 'DIGEST_ONLY_NOT_REPRODUCIBLE' WHEN a.output <> b.output THEN 'PROBE_OUTPUT_MISMATCH' ELSE 'PROBE_OUTPUT_EXACT' END AS finding FROM a LEFT JOIN b USING (conv_id, probe_id))"""


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, own_key = F.col("conv_id") * 100 + F.col("turn"), F.col("conv_id") * 100 + F.col("probe_id")
    own = table(spark, sf_dir, "conversations").where("role is not null").groupBy("conv_id", "turn").agg(F.max(F.coalesce("text", F.lit(""))).alias("output"))
    own = own.select("conv_id", F.col("turn").alias("probe_id"), one_of(key, "kind", "ENCODE", "DECODE", "RENDER").alias("kind"), (drawn(key, "digest", 25) == 0).alias("digest_only"), "output")
    other = own.where(drawn(own_key, "kept", 20) > 0).select("conv_id", "probe_id", F.when(drawn(own_key, "kinds", 30) == 0, "OTHER").otherwise(F.col("kind")).alias("kind"), "digest_only", F.concat("output", F.when(drawn(own_key, "output", 20) == 0, "?").otherwise("")).alias("output"))
    return parity.probes(own, other, "conv_id")


@query(f"WITH {_PROBES} SELECT conv_id, probe_id, finding FROM f")
def probe_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of probes by kind, reproducibility and output."""
    return _probes(spark, sf_dir)


@query(f"""WITH {_PROBES}, s AS (SELECT conv_id, count(*) FILTER (finding IN ('PROBE_RESULT_UNAVAILABLE', 'PROBE_KIND_MISMATCH', 'PROBE_OUTPUT_MISMATCH')) AS n_mismatches, bool_or(finding = 'DIGEST_ONLY_NOT_REPRODUCIBLE') AS d FROM f GROUP BY 1)
SELECT conv_id, n_mismatches, CASE WHEN n_mismatches > 0 THEN 'MISMATCH_FOR_DECLARED_PROBES' WHEN d THEN 'DIGEST_ONLY_NOT_REPRODUCIBLE' ELSE 'EXACT_FOR_DECLARED_PROBES' END AS status FROM s""")
def probe_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A status for each conversation's probes."""
    return parity.probe_statuses(_probes(spark, sf_dir), "conv_id")


_DIMENSIONS = ("FINAL_OUTPUT_BYTES", "TOKEN_IDS", "SELECTED_LOGIT_SAMPLES", "ERROR_CLASS")
_BACKENDS = f"""q AS (SELECT l_orderkey AS k, l_linenumber AS probe_id, {one_of_sql("l_linenumber", "dimension", *_DIMENSIONS)} AS dimension, l_orderkey % 4 = 0 AND {drawn_sql("l_orderkey * 10 + l_linenumber", "stochastic", 2)} = 0 AS stochastic FROM lineitem GROUP BY 1, 2),
r AS (SELECT k, probe_id, dimension, b, CASE WHEN k % 4 < 3 AND {drawn_sql("(k * 10 + probe_id) * 10 + b", "digest", 40)} = 0 THEN b ELSE 0 END AS digest, CASE WHEN {drawn_sql("(k * 10 + probe_id) * 10 + b", "digest", 40)} = 0 THEN 0.001 * (k % 3) * b ELSE 0 END AS value, {drawn_sql("(k * 10 + probe_id) * 10 + b", "failed", 300)} = 0 AS failed FROM q, (VALUES (0), (1), (2)) v(b) WHERE {drawn_sql("(k * 10 + probe_id) * 10 + b", "kept", 200)} > 0)"""


@query(f"""WITH {_BACKENDS}, h AS (SELECT k, probe_id, count(DISTINCT b) AS n, bool_or(failed) AS failed, count(DISTINCT digest) AS kinds, max(value) - min(value) AS spread FROM r GROUP BY 1, 2),
f AS (SELECT q.k, CASE WHEN coalesce(n, 0) < CASE WHEN q.k % 20 = 0 THEN 1 ELSE 3 END THEN 'RESULT_MISSING' WHEN failed AND dimension <> 'ERROR_CLASS' THEN 'ERROR' WHEN kinds <= 1 THEN 'EXACT' WHEN dimension = 'SELECTED_LOGIT_SAMPLES' THEN CASE WHEN spread <= 0.0025 THEN 'WITHIN' ELSE 'OUTSIDE' END WHEN stochastic THEN 'STOCHASTIC' ELSE 'MISMATCH' END AS x FROM q LEFT JOIN h USING (k, probe_id))
SELECT k, count(*) AS n_findings, CASE WHEN k % 20 = 0 THEN 'INSUFFICIENT_EVIDENCE' WHEN bool_or(x IN ('RESULT_MISSING', 'ERROR', 'OUTSIDE', 'MISMATCH')) THEN 'MISMATCH_FOR_DECLARED_PROBES' WHEN bool_or(x = 'STOCHASTIC') THEN 'STOCHASTIC_RESULTS_NOT_DIRECTLY_COMPARABLE' WHEN bool_or(x = 'WITHIN') THEN 'WITHIN_EXPLICIT_NUMERICAL_POLICY_FOR_DECLARED_PROBES' ELSE 'EXACT_FOR_DECLARED_PROBES' END AS status FROM f GROUP BY 1""")
def backend_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three backends on the same probes: exact, within a tolerance, stochastic, or different."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("probe_id")).distinct()
    stochastic = (F.col("k") % 4 == 0) & (drawn(F.col("k") * 10 + F.col("probe_id"), "stochastic", 2) == 0)
    asked = lines.select("k", "probe_id", one_of(F.col("probe_id"), "dimension", *_DIMENSIONS).alias("dimension"), stochastic.alias("stochastic"))
    rows = asked.withColumn("b", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    key = (F.col("k") * 10 + F.col("probe_id")) * 10 + F.col("b")
    off = drawn(key, "digest", 40) == 0
    results = rows.where(drawn(key, "kept", 200) > 0).select(
        "k", "probe_id", "dimension", F.col("b").alias("backend"), F.when((F.col("k") % 4 < 3) & off, F.col("b")).otherwise(0).alias("digest"), F.when(off, (F.col("k") % 3) * F.col("b") * 0.001).otherwise(0.0).alias("value"), (drawn(key, "failed", 300) == 0).alias("failed"),
    )
    return parity.backends(results, asked, "k", F.when(F.col("k") % 20 == 0, 1).otherwise(3), 0.0025)


_PAIRS = """v AS (SELECT vec_id, CASE WHEN vec_id % 50 = 7 THEN list_transform(embedding, lambda x: 0.0::DOUBLE) ELSE list_transform(embedding, lambda x: round(x::DOUBLE, 3)) END AS a FROM embeddings),
q AS (SELECT vec_id, a, CASE WHEN vec_id % 9 = 4 THEN a ELSE list_transform(a, lambda x: round(x, 1)) END AS b FROM v), u AS (SELECT vec_id, unnest(a) AS a, unnest(b) AS b FROM q)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = F.transform("embedding", lambda x: F.round(x.cast("double"), 3))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 50 == 7, F.transform("embedding", lambda x: F.lit(0.0))).otherwise(near).alias("a"))
    return rows.withColumn("b", F.when(F.col("vec_id") % 9 == 4, F.col("a")).otherwise(F.transform("a", lambda x: F.round(x, 1))))


@query(f"""WITH {_PAIRS}, s AS (SELECT vec_id, count(*) AS n, count(*) FILTER (a = b) AS n_exact, max(abs(b - a)) AS max_error, avg(abs(b - a)) AS mean_error, avg((b - a) * (b - a)) AS mse, sum(a * a) AS aa, sum(b * b) AS bb, sum(a * b) AS ab, sum((b - a) * (b - a)) AS ee, avg(b - a) AS bias FROM u GROUP BY 1)
SELECT vec_id, n, n_exact, round(max_error, 6) AS max_error, round(mean_error, 6) AS mean_error, round(mse, 6) AS mse, round(sqrt(mse), 6) AS rmse, round(sqrt(aa), 6) AS source_l2, round(sqrt(ee), 6) AS error_l2, CASE WHEN aa > 0 THEN round(sqrt(ee / aa), 6) END AS relative_l2,
CASE WHEN aa = 0 THEN 'UNDEFINED_ZERO_REFERENCE_NORM' WHEN n = n_exact THEN 'EXACT' ELSE 'AVAILABLE' END AS relative_state, round(ab, 6) AS dot, CASE WHEN aa > 0 AND bb > 0 THEN CASE WHEN n = n_exact THEN 1.0 ELSE round(ab / sqrt(aa * bb), 6) END END AS cosine,
CASE WHEN aa = 0 OR bb = 0 THEN 'UNDEFINED_ZERO_VECTOR' WHEN n = n_exact THEN 'EXACT' ELSE 'AVAILABLE' END AS cosine_state, round(bias, 6) + 0.0 AS bias FROM s""")
def quant_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics of pairs of vectors, with the states of those that are undefined."""
    found = numeric.metrics(F.col("a"), F.col("b"))
    plain = {"n", "n_exact", "relative_state", "cosine_state"}
    return _pairs(spark, sf_dir).select("vec_id", *((c if name in plain else F.round(c, 6) + 0.0).alias(name) for name, c in found.items()))


@query(f"""WITH {_PAIRS}, d AS (SELECT vec_id, (round(a * 1000))::BIGINT AS a, (round(b * 1000))::BIGINT AS b FROM u), s AS (SELECT vec_id, max(abs(b - a)) AS m, sum((b - a) * (b - a)) AS ee, sum(a * b) AS ab FROM d GROUP BY 1)
SELECT vec_id, regexp_replace(regexp_replace((m::DECIMAL(20, 3) / 1000)::DECIMAL(20, 3)::VARCHAR, '0+$', ''), '\\.$', '') AS max_error, regexp_replace(regexp_replace((ee::DECIMAL(20, 6) / 1000000)::DECIMAL(20, 6)::VARCHAR, '0+$', ''), '\\.$', '') AS error_squares, regexp_replace(regexp_replace((ab::DECIMAL(20, 6) / 1000000)::DECIMAL(20, 6)::VARCHAR, '0+$', ''), '\\.$', '') AS dot FROM s""")
def quant_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics in decimal arithmetic: those whose decimals end."""
    said = lambda c: F.transform(c, lambda x: F.format_number(x, 3))
    rows = _pairs(spark, sf_dir).select("vec_id", said("a").alias("a"), said("b").alias("b"))
    return numeric.exact_metrics(rows, "a", "b").select("vec_id", "max_error", "error_squares", "dot")


_FOLD = "list_reduce(list_concat([0::BIGINT], list_transform(generate_series(0, 15), lambda j: ('0x' || substr(h, (j * 4 + 1)::INT, 4))::BIGINT)), lambda acc, x: (acc * 65536 + x) % n)"


@query(f"""WITH t AS (SELECT s_suppkey AS k, (s_suppkey * 37 % 400)::BIGINT AS n, (s_suppkey * 11 % 30)::BIGINT AS w FROM supplier), p AS (SELECT k, n, least(w, n) AS w, unnest(generate_series(0, greatest(1024, least(w, n) * 128) - 1)) AS i FROM t WHERE n > 0 AND w > 0 AND w < n),
h AS (SELECT k, n, w, i, sha256('seed:' || k || ':' || i) AS h FROM p), x AS (SELECT k, w, {_FOLD} AS idx, i FROM h), f AS (SELECT k, w, idx, min(i) AS i FROM x GROUP BY 1, 2, 3)
SELECT k, idx AS "index" FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY i) AS r FROM f) WHERE r <= w UNION ALL SELECT k, unnest(generate_series(0, n - 1)) FROM t WHERE n > 0 AND w >= n""")
def counter_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct indices of each population, drawn by digests of a counter; sampling is the operator's own limit."""
    key = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(key.alias("k"), (key * 37 % 400).alias("population"), (key * 11 % 30).alias("wanted"))
    return numeric.samples(rows, "k", F.concat(F.lit("seed:"), F.col("k").cast("string"), F.lit(":")))


_STATES = ("EXACT", "EVALUATED", "SAMPLED", "INSUFFICIENT_COVERAGE", "NOT_SUPPORTED", "INVALID")


@query(f"""WITH s AS (SELECT label, vec_id % 10 AS part, list(DISTINCT CASE WHEN vec_id % 10 < 3 THEN 'EXACT' WHEN {drawn_sql("vec_id", "rare", 12)} > 0 THEN 'EVALUATED' ELSE {one_of_sql("vec_id", "state", *_STATES)} END) AS l FROM embeddings GROUP BY 1, 2)
SELECT label, part, CASE WHEN list_contains(l, 'INVALID') THEN 'INVALID' WHEN list_contains(l, 'INSUFFICIENT_COVERAGE') THEN 'INSUFFICIENT_COVERAGE' WHEN list_contains(l, 'NOT_SUPPORTED') THEN 'NOT_SUPPORTED' WHEN part = 9 OR list_contains(l, 'SAMPLED') THEN 'SAMPLED' WHEN l = ['EXACT'] THEN 'EXACT' ELSE 'EVALUATED' END AS status FROM s""")
def numeric_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of all measurements of a group."""
    key = F.col("vec_id")
    state = F.when(key % 10 < 3, "EXACT").when(drawn(key, "rare", 12) > 0, "EVALUATED").otherwise(one_of(key, "state", *_STATES))
    sums = table(spark, sf_dir, "embeddings").groupBy("label", (key % 10).alias("part")).agg(F.collect_set(state).alias("states"))
    return sums.select("label", "part", numeric.numeric_rollup(F.col("states"), F.col("part") == 9).alias("status"))


@query(f"""WITH r AS (SELECT label, CASE WHEN label % 4 = 0 THEN 'PASSED' ELSE {one_of_sql("vec_id", "requirement", *["PASSED"] * 60, "PENDING")} END AS s, label % 4 = 2 AND {drawn_sql("vec_id", "failed", 30)} = 0 AS bad FROM embeddings)
SELECT label, count(*) FILTER (bad) AS n_failed, count(*) FILTER (NOT bad AND s = 'PENDING') AS n_pending, CASE WHEN count(*) FILTER (bad) > 0 THEN 'DOES_NOT_CONFORM' WHEN count(*) FILTER (s = 'PENDING') > 0 THEN 'INDETERMINATE' ELSE 'CONFORMS' END AS status FROM r GROUP BY 1""")
def quant_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a group conforms to all requirements of its policy."""
    key, label = F.col("vec_id"), F.col("label")
    state = F.when((label % 4 == 2) & (drawn(key, "failed", 30) == 0), "FAILED").when(label % 4 == 0, "PASSED").otherwise(one_of(key, "requirement", *["PASSED"] * 60, "PENDING"))
    return numeric.policy_result(table(spark, sf_dir, "embeddings").select("label", state.alias("state")), "label")
