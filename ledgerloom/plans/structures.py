"""Queries that compare two structures: each part is a tensor, whose type, shape and size a second cohort has changed here and there."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import rollups, splits, structures
from ledgerloom.plans.catalogue import query, table
from ledgerloom.plans.drawn import drawn, drawn_sql, one_of, one_of_sql

_TYPES = ("F32", "Q8_0", "Q4_K", "Q6_K", "IQ1_M")
_BASE = f"""b AS (SELECT p_partkey AS k, 'blk.' || (p_partkey % 93) || '.' || replace(p_name, ' ', '_') || '.' || p_partkey AS name, {one_of_sql("p_partkey", "type", *_TYPES)} AS type, CASE WHEN p_size = 13 THEN '<unclassified>' ELSE split_part(p_name, ' ', 2) END AS family,
[p_size * 32, 64, 1 + p_partkey % 3] AS physical, round(p_retailprice * 100)::BIGINT AS size FROM part),
c AS (SELECT k, name, CASE WHEN {drawn_sql("k", "retyped", 3)} = 0 THEN {one_of_sql("k", "to", *_TYPES, "Q9")} ELSE type END AS type, family, CASE {drawn_sql("k", "reshaped", 30)} WHEN 0 THEN list_reverse(physical) WHEN 1 THEN physical[1:2] WHEN 2 THEN []::INT[] ELSE physical END AS physical,
size + CASE WHEN {drawn_sql("k", "resized", 4)} = 0 THEN 100 ELSE 0 END AS size FROM b WHERE {drawn_sql("k", "lost", 50)} > 0 UNION ALL SELECT k, name || '.extra', type, family, physical, size FROM b WHERE {drawn_sql("k", "more", 60)} = 0)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    key = F.col("p_partkey")
    name = F.concat(F.lit("blk."), (key % 93).cast("string"), F.lit("."), F.translate("p_name", " ", "_"), F.lit("."), key.cast("string"))
    base = table(spark, sf_dir, "part").select(
        key.alias("k"), name.alias("name"), one_of(key, "type", *_TYPES).alias("type"), F.when(F.col("p_size") == 13, "<unclassified>").otherwise(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("family"),
        F.array((F.col("p_size") * 32).cast("long"), F.lit(64).cast("long"), (key % 3 + 1).cast("long")).alias("physical"), F.round(F.col("p_retailprice") * 100).cast("long").alias("size"),
    )
    k, shape = F.col("k"), drawn(F.col("k"), "reshaped", 30)
    kept = base.where(drawn(k, "lost", 50) > 0).select(
        "k", "name", F.when(drawn(k, "retyped", 3) == 0, one_of(k, "to", *_TYPES, "Q9")).otherwise(F.col("type")).alias("type"), "family",
        F.when(shape == 0, F.reverse("physical")).when(shape == 1, F.slice("physical", 1, 2)).when(shape == 2, F.array().cast("array<bigint>")).otherwise(F.col("physical")).alias("physical"),
        (F.col("size") + F.when(drawn(k, "resized", 4) == 0, 100).otherwise(0)).alias("size"),
    )
    return base, kept.union(base.where(drawn(k, "more", 60) == 0).withColumn("name", F.concat("name", F.lit(".extra"))))


@query(f"WITH {_BASE}, d AS (SELECT 'missing' AS side, name FROM b WHERE name NOT IN (SELECT name FROM c) UNION ALL SELECT 'unexpected', name FROM c WHERE name NOT IN (SELECT name FROM b)) SELECT side, count(*) AS n, array_to_string(list_sort(list(name))[1:8], ',') AS examples FROM d GROUP BY 1")
def set_diff_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that one side lacks, with the smallest eight of each."""
    return structures.set_difference(*_sides(spark, sf_dir), "name", 8)


@query(f"""WITH {_BASE}, x AS (SELECT b.name, array_to_string(b.physical, 'x') AS source, array_to_string(c.physical, 'x') AS target FROM b JOIN c USING (name) WHERE b.physical <> c.physical)
SELECT source, target, count(*) AS n, array_to_string(list_sort(list(name))[1:4], ',') AS examples FROM x GROUP BY 1, 2""")
def shape_transition_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How shapes changed, counted by change."""
    said = lambda df: df.withColumn("shape", F.array_join(F.col("physical").cast("array<string>"), "x"))
    base, candidate = _sides(spark, sf_dir)
    return structures.changed_groups(said(base), said(candidate), "name", "shape", 4)


_RULES = (("F32", "Q8_0", "*"), ("F32", "Q8_0", "blk.1*"), ("Q8_0", "Q4_K", "blk.[0-4]*.small_*"), ("Q4_K", "Q4_K", "*"), ("Q6_K", "Q6_K", "*_ring.*"), ("Q8_0", "Q8_0", "blk.??.*"), ("F32", "F32", "*[02468]"), ("IQ1_M", "IQ1_M", "blk.[!5]*"))


@query(f"""WITH {_BASE}, r(s, t, selector) AS (VALUES {", ".join(str(r) for r in _RULES)}), x AS (SELECT name, b.type AS source_type, c.type AS target_type FROM b JOIN c USING (name)),
m AS (SELECT name, source_type, target_type, coalesce((SELECT string_agg(DISTINCT selector, '|' ORDER BY selector) FROM r WHERE s = source_type AND t = target_type AND name GLOB selector), '') AS selectors FROM x)
SELECT source_type, target_type, selectors, selectors <> '' AS accepted, count(*) AS n, array_to_string(list_sort(list(name))[1:4], ',') AS examples FROM m GROUP BY 1, 2, 3""")
def type_transition_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of type that rules for types and names accept, by the selectors that match, and those that none does."""
    return structures.type_transitions(*_sides(spark, sf_dir), _RULES, "name", "type", 4)


_ALLOWED, _FAMILY_ALLOWED = ("Q8_0", "Q4_K", "Q6_K"), {"widget": ("IQ1_M",), "bolt": ("IQ1_M", "Q4_K")}


@query(f"""WITH {_BASE}, x AS (SELECT b.family, b.type AS l, c.type AS r, b.k % 5 = 0 AS sensitive, CASE b.family WHEN 'widget' THEN ['IQ1_M'] WHEN 'bolt' THEN ['IQ1_M', 'Q4_K'] ELSE [] END AS own FROM b JOIN c USING (name)),
s AS (SELECT *, CASE WHEN family = '<unclassified>' THEN 'INCOMPARABLE' WHEN sensitive THEN CASE WHEN l = 'F32' AND r = 'F32' THEN 'KEPT_UNQUANTIZED' ELSE 'UNSUPPORTED' END WHEN l = r THEN 'UNCHANGED' WHEN r = 'F32' THEN 'UNEXPECTED_UNQUANTIZED'
WHEN list_contains(own, r) OR r IN ('Q8_0', 'Q4_K', 'Q6_K') THEN 'QUANTIZATION_FAMILY_CHANGED' ELSE 'UNSUPPORTED' END AS state FROM x)
SELECT family, l AS source_type, r AS target_type, state, state IN ('KEPT_UNQUANTIZED', 'UNCHANGED', 'QUANTIZATION_FAMILY_CHANGED') AS allowed,
CASE WHEN state = 'INCOMPARABLE' THEN 'classified_family_required' WHEN sensitive THEN 'sensitive_f32_unchanged' WHEN state = 'UNCHANGED' THEN 'quantized_matrix_unchanged' WHEN state = 'UNEXPECTED_UNQUANTIZED' THEN 'quantized_matrix_change_only' WHEN state = 'UNSUPPORTED' THEN 'known_quantized_target_type'
WHEN list_contains(own, r) THEN 'family_target_type_allowlist:' || family ELSE 'family_aware_quantized_matrix_change' END AS rule, count(*) AS n FROM s GROUP BY ALL""")
def type_transition_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each change of type means, counted by family."""
    base, candidate = _sides(spark, sf_dir)
    both = base.select("name", "k", "family", F.col("type").alias("l")).join(candidate.select("name", F.col("family").alias("c_family"), F.col("type").alias("r")), "name")
    state = structures.transition_state(F.col("family"), F.col("c_family"), F.col("k") % 5 == 0, F.col("l"), F.col("r"), _ALLOWED, _FAMILY_ALLOWED)
    return both.withColumn("x", state).groupBy("family", F.col("l").alias("source_type"), F.col("r").alias("target_type"), "x.state", "x.allowed", "x.rule").agg(F.count("*").alias("n"))


_NORMAL = "list_reverse_sort(list_filter({x}, lambda d: d > 1))"


@query(f"""WITH {_BASE}, x AS (SELECT b.physical AS p, c.physical AS q, {_NORMAL.format(x="b.physical")} AS n, {_NORMAL.format(x="c.physical")} AS m FROM b JOIN c USING (name)),
y AS (SELECT CASE WHEN len(n) = 0 OR len(m) = 0 THEN 'UNAVAILABLE' WHEN n = m AND p = q THEN 'PHYSICAL_EQUAL' WHEN n = m THEN 'PHYSICAL_DIFFERENT_LOGICAL_EQUAL' ELSE 'INCOMPATIBLE' END AS class FROM x) SELECT class, count(*) AS n FROM y GROUP BY 1""")
def shape_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes that agree physically, only when normalised (ones dropped, largest first), or not."""
    base, candidate = _sides(spark, sf_dir)
    normal = lambda c: F.sort_array(F.filter(c, lambda d: d > 1), asc=False)
    both = base.select("name", F.col("physical").alias("p")).join(candidate.select("name", F.col("physical").alias("q")), "name")
    return both.select(structures.shape_class(F.col("p"), F.col("q"), normal("p"), normal("q")).alias("class")).groupBy("class").agg(F.count("*").alias("n"))


@query(f"""WITH {_BASE}, s AS (SELECT family, sum(x) AS bb, sum(y) AS cb FROM (SELECT family, size AS x, 0 AS y FROM b UNION ALL SELECT family, 0, size FROM c) GROUP BY GROUPING SETS ((family), ())), t AS (SELECT family, bb::BIGINT AS bb, cb::BIGINT AS cb, CASE WHEN bb = 0 THEN 1 ELSE bb END::BIGINT AS d FROM s)
SELECT family, bb AS baseline_bytes, cb AS candidate_bytes, (cb // gcd(cb, d))::BIGINT AS numerator, (d // gcd(cb, d))::BIGINT AS denominator FROM t""")
def encoded_size_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of both sides by family and in all, and their exact ratio."""
    return structures.encoded_sizes(*_sides(spark, sf_dir), "family", "size")


_META_RULES = {"general.file_type": "ignore", "general.name": "allow", "model.block_count": "require_equal", "model.context": "warn"}
_NAMED = ("general.architecture", "general.file_type", "general.name", "model.block_count", "model.context", "split.count")
_META = f"""m AS (SELECT CASE WHEN n_nationkey < 6 THEN {list(_NAMED)}[n_nationkey + 1] ELSE 'extra.' || n_nationkey END AS key, n_regionkey AS v, n_nationkey AS k FROM nation),
s AS (SELECT key, v, k FROM m WHERE k % 8 <> 7), t AS (SELECT key, v + CASE WHEN k % 3 <> 2 THEN 1 ELSE 0 END AS v, k FROM m WHERE k % 9 <> 8)"""


def _metadata(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("n_nationkey")
    named = F.try_element_at(F.array(*map(F.lit, _NAMED)), k + 1)
    rows = table(spark, sf_dir, "nation").select(F.coalesce(named, F.concat(F.lit("extra."), k.cast("string"))).alias("key"), F.col("n_regionkey").alias("value"), k.alias("k"))
    return rows.where("k % 8 <> 7").drop("k"), rows.where("k % 9 <> 8").select("key", (F.col("value") + F.when(F.col("k") % 3 != 2, 1).otherwise(0)).alias("value"))


_RULED = """SELECT coalesce(s.key, t.key) AS key, CASE coalesce(s.key, t.key) WHEN 'general.file_type' THEN 'ignored' WHEN 'general.name' THEN 'allowed' WHEN 'model.block_count' THEN 'failure' WHEN 'model.context' THEN 'warning' ELSE 'warning' END AS outcome
FROM s FULL JOIN t ON s.key = t.key WHERE coalesce(s.key, t.key) <> 'general.architecture' AND (s.key IS NULL OR t.key IS NULL OR s.v IS DISTINCT FROM t.v)"""


@query(f"WITH {_META} {_RULED}")
def metadata_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that differ, by the action of their rule."""
    return structures.ruled_metadata(*_metadata(spark, sf_dir), _META_RULES, "warn", ["general.architecture"])


@query(f"WITH {_META}, r AS ({_RULED}) SELECT count(*) FILTER (outcome = 'allowed') AS n_allowed, count(*) FILTER (outcome = 'warning') AS n_warnings, count(*) FILTER (outcome = 'failure') AS n_failures, count(*) FILTER (outcome = 'ignored') AS n_ignored, CASE WHEN bool_or(outcome = 'failure') THEN 'FAIL' WHEN bool_or(outcome = 'warning') THEN 'WARN' ELSE 'PASS' END AS status FROM r")
def metadata_rule_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structures.metadata_verdict(structures.ruled_metadata(*_metadata(spark, sf_dir), _META_RULES, "warn", ["general.architecture"]))


@query(f"""WITH {_META}, j AS (SELECT coalesce(s.key, t.key) AS key, s.key AS sk, t.key AS tk, s.v AS sv, t.v AS tv FROM s FULL JOIN t ON s.key = t.key),
g AS (SELECT *, CASE WHEN key IN ('general.architecture', 'model.block_count') THEN 'required_equal' WHEN key = 'general.file_type' THEN 'allowed_quantization_specific' WHEN key = 'general.name' THEN 'allowed_variant_specific' WHEN key LIKE 'split.%' THEN 'allowed_repository_specific' ELSE 'informational' END AS category FROM j)
SELECT key, category, CASE WHEN sk IS NULL THEN 'MISSING_BASELINE' WHEN tk IS NULL THEN 'MISSING_CANDIDATE' WHEN sv = tv THEN 'EQUAL' WHEN category = 'required_equal' THEN 'DIFFERENT_UNEXPECTED' WHEN category = 'informational' THEN 'INFORMATIONAL' ELSE 'DIFFERENT_ALLOWED' END AS status FROM g""")
def metadata_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A status for each key of two headers, by the key's category."""
    key = F.col("key")
    category = F.when(key.isin("general.architecture", "model.block_count"), "required_equal").when(key == "general.file_type", "allowed_quantization_specific").when(key == "general.name", "allowed_variant_specific").when(key.startswith("split."), "allowed_repository_specific").otherwise("informational")
    s, t = (x.withColumnRenamed("value", "digest") for x in _metadata(spark, sf_dir))
    return structures.metadata_statuses(s, t, category)


@query("""WITH l AS (SELECT l_suppkey AS k, l_returnflag || l_linestatus AS family, count(*) AS n, list_sort(list(DISTINCT l_linenumber)) AS layers, max(l_quantity)::BIGINT AS shape FROM lineitem WHERE NOT (l_suppkey % 6 = 5 AND l_returnflag = 'R') GROUP BY 1, 2),
r AS (SELECT l_suppkey AS k, l_returnflag || l_linestatus AS family, count(*) + CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE 1 END AS n, list_sort(list(DISTINCT l_linenumber)) AS layers, max(l_quantity)::BIGINT + l_suppkey % 2 AS shape FROM lineitem GROUP BY 1, 2),
j AS (SELECT coalesce(l.k, r.k) AS k, l.k IS NOT NULL AND r.k IS NOT NULL AS both_, l.n = r.n AND l.layers = r.layers AS cov, l.shape = r.shape AS shp FROM l FULL JOIN r ON l.k = r.k AND l.family = r.family)
SELECT k AS scope, bool_and(both_) AS family_set_equal, bool_and(both_ AND cov) AS coverage_equal, bool_and(both_ AND shp) AS shapes_equal FROM j GROUP BY 1""")
def ontology_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of two ontologies of each supplier: their set, coverage and shapes."""
    rows = table(spark, sf_dir, "lineitem").withColumn("family", F.concat("l_returnflag", "l_linestatus"))
    sums = lambda df: df.groupBy(F.col("l_suppkey").alias("scope"), "family").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("l_linenumber")).alias("layers"), F.max("l_quantity").cast("long").alias("shape"))
    right = sums(rows).withColumn("n", F.col("n") + F.when(F.col("scope") % 3 == 0, 0).otherwise(1)).withColumn("shape", F.col("shape") + F.col("scope") % 2)
    return structures.ontology_equality(sums(rows.where("not (l_suppkey % 6 = 5 and l_returnflag = 'R')")), right, "scope", "family", "n", "layers", "shape")


_CONTROLS = ("identity", "metadata", "shapes", "types", "mapping", "validation", "spans", "ontology")
_PROFILES = {"strict": (_CONTROLS, ()), "structural": (("identity", "metadata", "shapes"), ("types", "mapping")), "lenient": (("identity",), ("shapes", "unknown_control")), "open": ((), ("identity",))}


@query(f"""WITH ctl AS (SELECT user_id, {one_of_sql("event_id", "control", *_CONTROLS)} AS control, bool_and({drawn_sql("event_id", "ok", 25)} > 0) AS ok FROM events GROUP BY 1, 2), u AS (SELECT DISTINCT user_id FROM ctl),
p(profile, control, required) AS (VALUES {", ".join(f"('{p}', '{c}', {r})" for p, (need, warn) in _PROFILES.items() for cs, r in ((need, "true"), (warn, "false")) for c in cs)}),
j AS (SELECT u.user_id, p.profile, p.control, required, coalesce(ok, false) AS ok FROM u, p LEFT JOIN ctl ON ctl.user_id = u.user_id AND ctl.control = p.control)
SELECT user_id, profile, coalesce(string_agg(control, ',' ORDER BY control) FILTER (required AND NOT ok), '') AS failed, count(*) FILTER (NOT required AND NOT ok) AS n_warnings,
CASE WHEN bool_or(required AND NOT ok) THEN 'NOT_SATISFIED' WHEN bool_or(NOT required AND NOT ok) THEN 'SATISFIED_WITH_WARNINGS' ELSE 'SATISFIED' END AS outcome FROM j GROUP BY 1, 2""")
def comparison_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Controls of each comparison under four profiles."""
    key = F.col("event_id")
    controls = table(spark, sf_dir, "events").groupBy("user_id", one_of(key, "control", *_CONTROLS).alias("control")).agg(F.bool_and(drawn(key, "ok", 25) > 0).alias("ok"))
    return structures.profile_results(controls, _PROFILES, "user_id")


_STAGES = ("source", "inventory", "mapping", "provenance", "payload")
_STATUSES = ("PASS", "PASS", "PASS", "AVAILABLE", "WARN", "UNAVAILABLE", "NOT_CHECKED", "FAIL")
_ACCEPTANCE = {
    "strict": {s: "REQUIRED_PASS" for s in _STAGES},
    "checked": {"source": "REQUIRED_PASS", "inventory": "REQUIRED_CHECKED", "mapping": "REQUIRED_CHECKED", "provenance": "ALLOWED_UNAVAILABLE", "payload": "NOT_REQUIRED"},
    "lenient": {"source": "REQUIRED_CHECKED", "inventory": "ALLOWED_WARN", "mapping": "ALLOWED_UNAVAILABLE", "provenance": "ALLOWED_WARN", "payload": "NOT_REQUIRED"},
}
_STAGE_ROWS = f"st AS (SELECT c_custkey, stage, [{', '.join(f'{chr(39)}{s}{chr(39)}' for s in _STATUSES)}][{drawn_sql('c_custkey || stage', 'stage', len(_STATUSES))} + 1] AS status FROM customer, (VALUES {', '.join(f'({chr(39)}{s}{chr(39)})' for s in _STAGES)}) v(stage))"


def _stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.array(*map(F.lit, _STAGES))).alias("stage"))
    return rows.withColumn("status", one_of(F.concat(F.col("c_custkey").cast("string"), F.col("stage")), "stage", *_STATUSES))


@query(f"""WITH {_STAGE_ROWS}, rq(profile, stage, q) AS (VALUES {", ".join(f"('{p}', '{s}', '{r}')" for p, own in _ACCEPTANCE.items() for s, r in own.items())}),
d AS (SELECT c_custkey, profile, CASE q WHEN 'REQUIRED_PASS' THEN status = 'PASS' WHEN 'REQUIRED_CHECKED' THEN status IN ('PASS', 'AVAILABLE') WHEN 'ALLOWED_UNAVAILABLE' THEN status IN ('PASS', 'AVAILABLE', 'WARN', 'UNAVAILABLE') WHEN 'ALLOWED_WARN' THEN status <> 'FAIL' ELSE true END AS ok,
CASE q WHEN 'ALLOWED_UNAVAILABLE' THEN status IN ('WARN', 'UNAVAILABLE') WHEN 'ALLOWED_WARN' THEN status IN ('WARN', 'UNAVAILABLE', 'NOT_CHECKED') ELSE false END AS warn FROM st JOIN rq USING (stage))
SELECT c_custkey, profile, count(*) FILTER (NOT ok) AS n_failed, count(*) FILTER (warn) AS n_warnings, CASE WHEN bool_or(NOT ok) THEN 'NOT_SATISFIED' WHEN bool_or(warn) THEN 'SATISFIED_WITH_WARNINGS' ELSE 'SATISFIED' END AS outcome FROM d GROUP BY 1, 2""")
def acceptance_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stages of evidence under three profiles of requirements."""
    return structures.acceptance(_stages(spark, sf_dir), _ACCEPTANCE, "c_custkey")


_USAGE = {"personal": (("source",), (), "REVIEW_REQUIRED"), "enterprise": (("source", "inventory"), ("payload", "provenance"), "NOT_SUITABLE"), "regulated": (_STAGES, (), "NOT_SUITABLE")}


@query(f"""WITH {_STAGE_ROWS}, n(profile, stage, need) AS (VALUES {", ".join(f"('{p}', '{s}', {r})" for p, (need, review, _) in _USAGE.items() for ss, r in ((need, "true"), (review, "false")) for s in ss)}), l(profile, lack) AS (VALUES {", ".join(f"('{p}', '{x[2]}')" for p, x in _USAGE.items())}),
u AS (SELECT c_custkey, profile, string_agg(stage, ',' ORDER BY stage) FILTER (need AND status <> 'PASS') AS unmet, bool_or(NOT need AND status <> 'PASS') AS review FROM st JOIN n USING (stage) GROUP BY 1, 2)
SELECT c_custkey, profile, coalesce(unmet, '') AS unmet, CASE WHEN unmet IS NOT NULL THEN lack WHEN review THEN 'REVIEW_REQUIRED' ELSE 'SUITABLE_WITH_LIMITATIONS' END AS outcome FROM u JOIN l USING (profile)""")
def usage_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each subject may be used for."""
    return structures.usage(_stages(spark, sf_dir), _USAGE, "c_custkey")


_LIFECYCLE = {"basic": (("view",), ()), "commerce": (("view", "purchase"), ("refund", "error")), "full": (("view", "click", "purchase", "refund", "error"), ()), "either": ((), ("purchase", "refund"))}


@query(f"""WITH h AS (SELECT user_id, list(DISTINCT CASE WHEN {drawn_sql("event_id", "rare", 20)} = 0 THEN event_type ELSE 'other' END) AS l FROM events GROUP BY 1), p(profile, need, anyof) AS (VALUES {", ".join(f"('{p}', {list(need)}::VARCHAR[], {list(some)}::VARCHAR[])" for p, (need, some) in _LIFECYCLE.items())}),
m AS (SELECT user_id, profile, list_sort(list_concat(list_filter(need, lambda x: NOT list_contains(l, x)), CASE WHEN len(anyof) > 0 AND NOT list_has_any(anyof, l) THEN anyof ELSE [] END)) AS missing FROM h, p)
SELECT user_id, profile, array_to_string(missing, ',') AS missing, CASE WHEN len(missing) > 0 THEN 'INCOMPLETE' ELSE 'COMPLETE' END AS status FROM m""")
def lifecycle_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of events that each profile needs, with groups of which one is enough."""
    kind = F.when(drawn(F.col("event_id"), "rare", 20) == 0, F.col("event_type")).otherwise("other")
    return structures.required_events(table(spark, sf_dir, "events").select("user_id", kind.alias("event_type")), _LIFECYCLE, "user_id", "event_type")


_TRAITS = {"F32": (1, 4), "Q8_0": (32, 34), "Q4_K": (256, 144), "Q6_K": (256, 210)}
_SPAN_ROWS = f"""t AS (SELECT CASE WHEN l_suppkey % 9 = 0 THEN l_suppkey + 1 ELSE l_suppkey END AS shard, l_orderkey || '.' || l_linenumber || '.' || l_partkey AS name, {one_of_sql("l_orderkey * 10 + l_linenumber", "dtype", "F32", "Q8_0", "Q4_K", "Q6_K", "X1")} AS type,
CASE l_partkey % 40 WHEN 0 THEN [0, 4] WHEN 1 THEN [4294967296, 4294967296, 4] ELSE [256 * l_linenumber + CASE WHEN l_partkey % 11 = 0 THEN 1 ELSE 0 END, l_quantity::BIGINT] END AS dims, (l_orderkey % 5000) * 4096 AS off FROM lineitem)"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber").cast("long") * 256 + F.when(F.col("l_partkey") % 11 == 0, 1).otherwise(0)
    big = F.lit(4294967296)
    dims = F.when(F.col("l_partkey") % 40 == 0, F.array(F.lit(0).cast("long"), F.lit(4).cast("long"))).when(F.col("l_partkey") % 40 == 1, F.array(big, big, F.lit(4).cast("long"))).otherwise(F.array(n, F.col("l_quantity").cast("long")))
    shard = F.when(F.col("l_suppkey") % 9 == 0, F.col("l_suppkey") + 1).otherwise(F.col("l_suppkey"))  # every ninth shard has no tensors
    rows = table(spark, sf_dir, "lineitem").select(
        shard.alias("shard"), F.concat_ws(".", "l_orderkey", "l_linenumber", "l_partkey").alias("name"), one_of(F.col("l_orderkey") * 10 + F.col("l_linenumber"), "dtype", *_TRAITS, "X1").alias("type"),
        dims.alias("dims"), (F.col("l_orderkey") % 5000 * 4096).alias("offset"), F.lit(1000).cast("long").alias("payload_start"), F.lit(20_000_000).cast("long").alias("file_size"),
    )
    return splits.spans(rows, _TRAITS)


_SPANNED = _SPAN_ROWS + """, r AS (SELECT *, 1000 + off AS first, CASE type WHEN 'F32' THEN 1 WHEN 'Q8_0' THEN 32 WHEN 'Q4_K' THEN 256 WHEN 'Q6_K' THEN 256 END AS be, CASE type WHEN 'F32' THEN 4 WHEN 'Q8_0' THEN 34 WHEN 'Q4_K' THEN 144 WHEN 'Q6_K' THEN 210 END AS bb FROM t),
z AS (SELECT *, (dims[1] // be)::HUGEINT * bb::HUGEINT * (CASE WHEN len(dims) > 1 THEN dims[2] ELSE 1 END)::HUGEINT AS two, CASE WHEN len(dims) > 2 THEN dims[3] ELSE 1 END AS third FROM r),
y AS (SELECT *, CASE WHEN two > 18446744073709551615 OR two * third > 18446744073709551615 THEN NULL ELSE two * third END AS n FROM z),
x AS (SELECT *, first + n AS last, CASE WHEN list_min(dims) <= 0 THEN 'invalid' WHEN first > 20000000 THEN 'invalid' WHEN be IS NULL THEN 'unsupported' WHEN dims[1] % be <> 0 THEN 'invalid' WHEN n IS NULL OR first + n > 18446744073709551615 THEN 'overflow' WHEN n = 0 THEN 'invalid' WHEN first + n <= 20000000 THEN 'bounded' ELSE 'invalid' END AS span FROM y)"""


@query(f"WITH {_SPANNED} SELECT shard, name, type, off AS offset_, span, CASE WHEN span IN ('bounded') THEN last::VARCHAR END AS last FROM x")
def payload_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes that each tensor takes in its shard, in checked 64-bit arithmetic."""
    return _spans(spark, sf_dir).select("shard", "name", "type", F.col("offset").alias("offset_"), "span", F.when(F.col("span") == "bounded", F.col("last").cast("string")).alias("last"))


@query(f"""WITH {_SPANNED}, o AS (SELECT shard, first < lag(last) OVER (PARTITION BY shard ORDER BY first, last, name) AS overlap FROM x WHERE span = 'bounded')
SELECT s_suppkey AS shard, (SELECT count(*) FROM x WHERE shard = s_suppkey) AS n_tensors, (SELECT count(*) FROM o WHERE shard = s_suppkey AND overlap) AS n_overlaps,
CASE WHEN NOT EXISTS (SELECT 1 FROM x WHERE shard = s_suppkey) THEN 'no_tensors' WHEN EXISTS (SELECT 1 FROM x WHERE shard = s_suppkey AND span IN ('invalid', 'overflow')) THEN 'invalid' WHEN EXISTS (SELECT 1 FROM x WHERE shard = s_suppkey AND span = 'unsupported') THEN 'unsupported' ELSE 'bounded' END AS result FROM supplier""")
def shard_span_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps and the worst span of each shard."""
    return splits.shard_results(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("shard")), _spans(spark, sf_dir), "shard")


@query("""WITH t AS (SELECT l_suppkey AS scope, l_partkey % 500 AS name, l_linenumber, l_returnflag FROM lineitem)
SELECT scope, name, count(*) AS n, CASE WHEN count(DISTINCT (l_linenumber, l_returnflag)) = 1 THEN 'exact' ELSE 'conflict' END AS kind FROM t GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that several shards have: the same descriptor, or a conflict."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("scope"), (F.col("l_partkey") % 500).alias("name"), "l_linenumber", "l_returnflag")
    return splits.duplicate_names(rows, "scope", "l_linenumber", "l_returnflag")


_SPLIT_RULES = {"A": "REQUIRED_PRESENT_ALL", "N": "REQUIRED_EQUAL", "R": "PRIMARY_ONLY", "Z": "REQUIRED_EQUAL"}


@query("""WITH s AS (SELECT DISTINCT l_suppkey AS split, l_linenumber AS shard FROM lineitem), z AS (SELECT split, count(*) AS n_all, min(shard) AS p FROM s GROUP BY 1),
m AS (SELECT l_suppkey AS split, l_linenumber AS shard, l_returnflag AS key, l_linestatus AS v FROM lineitem WHERE l_partkey % 3 = 0 AND NOT (l_returnflag = 'R' AND l_linenumber > 1 AND l_suppkey % 2 = 0) AND NOT (l_returnflag = 'N' AND l_linestatus = 'O' AND l_suppkey % 4 = 1)),
r(key, rule) AS (VALUES ('A', 'REQUIRED_PRESENT_ALL'), ('N', 'REQUIRED_EQUAL'), ('R', 'PRIMARY_ONLY'), ('Z', 'REQUIRED_EQUAL')),
j AS (SELECT z.split, r.key, rule, n_all, p, count(DISTINCT m.shard) AS n_shards, count(DISTINCT m.v) AS n_values, coalesce(bool_or(m.shard <> p), false) AS elsewhere FROM z CROSS JOIN r LEFT JOIN m ON m.split = z.split AND m.key = r.key GROUP BY 1, 2, 3, 4, 5)
SELECT split, key, rule, n_shards, n_values, CASE rule WHEN 'REQUIRED_PRESENT_ALL' THEN n_shards = n_all WHEN 'REQUIRED_EQUAL' THEN n_shards > 0 AND n_values = 1 ELSE NOT elsewhere END AS ok FROM j""")
def split_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata that all shards of a split have to have, to agree on, or to leave to the first."""
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "split").withColumnRenamed("l_linenumber", "shard")
    kept = lines.where("l_partkey % 3 = 0 and not (l_returnflag = 'R' and shard > 1 and split % 2 = 0) and not (l_returnflag = 'N' and l_linestatus = 'O' and split % 4 = 1)")
    return splits.metadata_consistency(kept.select("split", "shard", F.col("l_returnflag").alias("key"), F.col("l_linestatus").alias("value")), lines, _SPLIT_RULES, "split", "shard")


@query("""WITH x AS (SELECT 'dir/order' || l_orderkey AS stem, l_linenumber::BIGINT AS number, (CASE WHEN l_orderkey % 50 = 7 AND l_linenumber = 1 THEN 3 ELSE max(l_linenumber) OVER (PARTITION BY l_orderkey) - CASE WHEN l_orderkey % 30 = 3 THEN 1 ELSE 0 END END)::BIGINT AS cnt FROM lineitem WHERE l_linenumber < 9),
d AS (SELECT stem, max(cnt) AS declared, count(*) AS n_files, count(DISTINCT cnt) AS n_counts FROM x GROUP BY 1), n AS (SELECT stem, number, count(*) AS c FROM x GROUP BY 1, 2),
s AS (SELECT stem, declared, n_files, n_counts, declared - count(*) FILTER (number BETWEEN 1 AND declared) AS n_missing, count(*) FILTER (c > 1) AS n_duplicate, count(*) FILTER (number NOT BETWEEN 1 AND declared) AS n_stray FROM d JOIN n USING (stem) GROUP BY 1, 2, 3, 4)
SELECT stem, declared, n_files, n_missing, n_duplicate, n_counts, n_stray, n_missing = 0 AND n_stray = 0 AS contiguous, n_missing = 0 AND n_stray = 0 AND n_duplicate = 0 AND n_counts = 1 AS complete FROM s""")
def split_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered files by stem: declared counts that differ, numbers that lack, repeat or lie outside."""
    top = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("top"))
    declared = F.when((F.col("l_orderkey") % 50 == 7) & (F.col("l_linenumber") == 1), 3).otherwise(F.col("top") - F.when(F.col("l_orderkey") % 30 == 3, 1).otherwise(0))
    name = F.format_string("dir/order%d-%05d-of-%05d.gguf", "l_orderkey", "l_linenumber", declared)
    return splits.split_sets(table(spark, sf_dir, "lineitem").where("l_linenumber < 9").join(top, "l_orderkey").select(name.alias("name")), "name")


@query(f"""WITH {_BASE}, {_META}, ruled AS ({_RULED}), r(s_, t_, selector) AS (VALUES {", ".join(str(r) for r in _RULES)}), x AS (SELECT name, b.type AS st, c.type AS tt, b.physical AS p, c.physical AS q FROM b JOIN c USING (name)),
f(ordinal, rule, n_failed, n_warned) AS (SELECT 1, 'DIFF-001', (SELECT count(*) FROM s FULL JOIN t ON s.key = t.key WHERE coalesce(s.key, t.key) = 'general.architecture' AND s.v IS DISTINCT FROM t.v), 0 UNION ALL SELECT 2, 'DIFF-002', (SELECT count(*) FROM b WHERE name NOT IN (SELECT name FROM c)) + (SELECT count(*) FROM c WHERE name NOT IN (SELECT name FROM b)), 0
UNION ALL SELECT 3, 'DIFF-003', (SELECT count(*) FROM x WHERE p <> q), 0 UNION ALL SELECT 4, 'DIFF-004', (SELECT count(*) FROM x WHERE NOT EXISTS (SELECT 1 FROM r WHERE s_ = st AND t_ = tt AND name GLOB selector)), 0 UNION ALL SELECT 5, 'DIFF-005', (SELECT count(*) FROM ruled WHERE outcome = 'failure'), (SELECT count(*) FROM ruled WHERE outcome = 'warning'))
SELECT ordinal, rule, n_failed, n_warned, CASE WHEN n_failed > 0 THEN 'FAIL' WHEN n_warned > 0 THEN 'WARN' ELSE 'PASS' END AS status FROM f""")
def inventory_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five findings on two inventories: architecture, names, shapes, types and metadata."""
    base, candidate = _sides(spark, sf_dir)
    meta, other = _metadata(spark, sf_dir)
    is_ = F.col("key") == "general.architecture"
    architecture = meta.where(is_).join(other.where(is_).withColumnRenamed("value", "other"), "key", "full_outer")
    names = structures.set_difference(base, candidate, "name", 0)
    alone = names.select(F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("k"))
    both = base.select("name", F.col("physical").alias("p")).join(candidate.select("name", F.col("physical").alias("q")), "name")
    kinds = structures.type_transitions(base, candidate, _RULES, "name", "type", 0).select("accepted", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("k"))
    ruled = structures.ruled_metadata(meta, other, _META_RULES, "warn", ["general.architecture"])
    parts = [
        ("DIFF-001", architecture, ~F.col("value").eqNullSafe(F.col("other")), None), ("DIFF-002", alone, F.lit(True), None), ("DIFF-003", both, F.col("p") != F.col("q"), None), ("DIFF-004", kinds, ~F.col("accepted"), None),
        ("DIFF-005", ruled, F.col("outcome") == "failure", F.col("outcome") == "warning"),
    ]
    return rollups.rule_findings(parts)


@query(f"""WITH {_BASE}, r(s, t, selector) AS (VALUES {", ".join(str(r) for r in _RULES)}), g AS (SELECT name, split_part(name, '.', 2) AS grp, type, physical, size, k FROM b), h AS (SELECT name, CASE WHEN k % 211 = 8 THEN 'x' ELSE split_part(name, '.', 2) END AS grp, type, physical, size FROM c UNION ALL SELECT name, split_part(name, '.', 2), type, physical, size FROM c WHERE k % 397 = 20),
s1 AS (SELECT name, count(*) AS n, min(grp) AS grp, min(type) AS type, min(physical) AS physical, min(size) AS size FROM g GROUP BY 1), t1 AS (SELECT name, count(*) AS n, min(grp) AS grp, min(type) AS type, min(physical) AS physical, min(size) AS size FROM h GROUP BY 1),
x AS (SELECT coalesce(s1.grp, t1.grp) AS grp, s1.name AS sn, t1.name AS tn, s1.n AS s_n, t1.n AS t_n, s1.type AS st, t1.type AS tt, s1.physical AS sp, t1.physical AS tp, s1.size AS sz, t1.size AS tz, EXISTS (SELECT 1 FROM r WHERE s = s1.type AND t = t1.type AND s1.name GLOB selector) AS ruled FROM s1 FULL JOIN t1 ON s1.name = t1.name),
z AS (SELECT grp, count(*) AS n, count(*) FILTER (tn IS NULL) AS n_missing, count(*) FILTER (sn IS NULL) AS n_unexpected, count(*) FILTER (sn IS NOT NULL AND tn IS NOT NULL AND sp <> tp) AS n_shape, count(*) FILTER (sn IS NOT NULL AND tn IS NOT NULL AND NOT ruled) AS n_rejected, count(*) FILTER (st <> tt) AS n_changed, count(*) FILTER (sz <> tz) AS n_size, count(*) FILTER (tz > sz) AS n_grown, bool_or(s_n > 1 OR t_n > 1) AS twice FROM x GROUP BY 1)
SELECT * EXCLUDE (twice), CASE WHEN twice THEN 'INCOMPARABLE' WHEN n_missing + n_unexpected + n_shape + n_rejected > 0 THEN 'DIFFERENT' WHEN n_changed > 0 THEN 'EQUIVALENCE_WITH_QUANTIZATION_DIFFERENCES' WHEN n_size > 0 THEN 'EQUIVALENCE_WITH_LIMITATIONS' ELSE 'EQUIVALENCE' END AS result FROM z""")
def layer_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layers of two inventories: identities, shapes, types and sizes compared, and the result that follows from these."""
    base, candidate = _sides(spark, sf_dir)
    layer = F.split_part("name", F.lit("."), F.lit(2))
    moved = candidate.withColumn("grp", F.when(F.col("k") % 211 == 8, "x").otherwise(layer)).unionByName(candidate.where("k % 397 = 20").withColumn("grp", layer))
    return structures.compared_by_group(base.withColumn("grp", layer), moved, _RULES, "grp", "name")
