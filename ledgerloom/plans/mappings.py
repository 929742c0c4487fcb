"""Queries over inventories and mappings: each line names a member of a layer; orders are the targets that lines are grouped into."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import mappings, rollups
from ledgerloom.operators.compare import worked_out
from ledgerloom.operators.written import written
from ledgerloom.plans import catalogue
from ledgerloom.plans.catalogue import query, table
from ledgerloom.plans.drawn import drawn, drawn_sql, one_of, one_of_sql

_FULL, _LINEAR = ("q_a", "kv_a", "kv_b"), ("a_log", "dt_bias", "conv")
_SHARED, _DENSE = ("down", "gate", "up"), ("down_proj", "gate_proj", "up_proj")
_KEY = "l_orderkey * 10 + l_linenumber"
_NAMES = f"""raw AS (SELECT l_suppkey % 93 AS l, {_KEY} AS k, l_partkey AS p, {drawn_sql(_KEY, "name", 10)} AS d, {drawn_sql(_KEY, "odd", 200)} AS odd, {drawn_sql(_KEY, "pick", 3)} + 1 AS pick FROM lineitem),
nm AS (SELECT k, CASE WHEN d < 4 AND l > 0 THEN 'm.layers.' || l || '.moe.experts.' || CASE WHEN l = 7 AND odd = 1 THEN 9 ELSE p % 4 END || '.w' || pick || '.weight'
WHEN d = 4 AND l > 0 THEN 'm.layers.' || l || '.moe.shared_experts.' || CASE WHEN odd = 1 AND l % 10 = 3 THEN 'extra' ELSE {list(_SHARED)}[pick] END WHEN d IN (4, 5) AND (l = 0 OR (l = 50 AND odd < 20)) THEN 'm.layers.' || l || '.mlp.' || {list(_DENSE)}[pick]
WHEN d IN (6, 7) THEN 'm.layers.' || l || '.self_attn.' || CASE WHEN (l % 4 = 3) <> (odd = 2 AND l % 9 = 1) THEN {list(_FULL)}[pick] ELSE {list(_LINEAR)}[pick] END WHEN d = 8 THEN 'm.layers.' || l || '.attn_res.' || ['q', 'k', 'v'][pick] WHEN odd < 40 THEN 'other.' || p % 50 || '.x' ELSE 'm.norm' END AS name FROM raw)"""
_RULES = (
    ("expert", r"^m\.layers\.(\d+)\.moe\.experts\.(\d+)\.(w[123])\.weight$", {"layer": 1, "expert": 2, "component": 3}),
    ("dense", r"^m\.layers\.(\d+)\.mlp\.(gate_proj|up_proj|down_proj)$", {"layer": 1, "component": 2}),
    ("shared", r"^m\.layers\.(\d+)\.moe\.shared_experts\.(\w+)$", {"layer": 1, "component": 2}),
    ("attention", r"^m\.layers\.(\d+)\.self_attn\.(\w+)$", {"layer": 1, "component": 2}),
    ("layer_residual", r"^m\.layers\.(\d+)\.attn_res\.(\w+)$", {"layer": 1, "component": 2}),
    ("model", r"^m\.(\w+)$", {"component": 1}),
)


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 93).alias("l"), key.alias("k"), F.col("l_partkey").alias("p"))
    rows = worked_out(lines, d=drawn(F.col("k"), "name", 10), odd=drawn(F.col("k"), "odd", 200), pick=drawn(F.col("k"), "pick", 3) + 1)
    layer, odd, d, n = F.concat(F.lit("m.layers."), F.col("l").cast("string")), F.col("odd"), F.col("d"), F.col("l")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), F.col("pick"))
    expert = F.when((n == 7) & (odd == 1), 9).otherwise(F.col("p") % 4).cast("string")
    name = (
        F.when((d < 4) & (n > 0), F.concat(layer, F.lit(".moe.experts."), expert, F.lit(".w"), F.col("pick").cast("string"), F.lit(".weight")))
        .when((d == 4) & (n > 0), F.concat(layer, F.lit(".moe.shared_experts."), F.when((odd == 1) & (n % 10 == 3), "extra").otherwise(pick(*_SHARED))))
        .when(d.isin(4, 5) & ((n == 0) | ((n == 50) & (odd < 20))), F.concat(layer, F.lit(".mlp."), pick(*_DENSE)))
        .when(d.isin(6, 7), F.concat(layer, F.lit(".self_attn."), F.when((n % 4 == 3) != ((odd == 2) & (n % 9 == 1)), pick(*_FULL)).otherwise(pick(*_LINEAR))))
        .when(d == 8, F.concat(layer, F.lit(".attn_res."), pick("q", "k", "v"))).when(odd < 40, F.concat(F.lit("other."), (F.col("p") % 50).cast("string"), F.lit(".x"))).otherwise("m.norm")
    )
    return rows.select("k", name.alias("name"))


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, n, class, layer, expert, component) of distinct names, as a written table: the rules read it many times."""
    distinct = written(_names(spark, sf_dir).groupBy("name").agg(F.count("*").alias("n")), "names")
    return mappings.classified(distinct, "name", _RULES, {"layer": "int", "expert": "int", "component": "string"})


_CLASSIFIED = _NAMES + """, un AS (SELECT name, count(*) AS n FROM nm GROUP BY 1), pt AS (SELECT name, n, string_split(name, '.') AS s FROM un),
inv AS (SELECT name, n, CASE WHEN s[4] = 'moe' AND s[5] = 'experts' THEN 'expert' WHEN s[4] = 'mlp' THEN 'dense' WHEN s[4] = 'moe' THEN 'shared' WHEN s[4] = 'self_attn' THEN 'attention' WHEN s[4] = 'attn_res' THEN 'layer_residual' WHEN s[1] = 'm' THEN 'model' ELSE 'unclassified' END AS class,
CASE WHEN s[2] = 'layers' THEN s[3]::INT END AS layer, CASE WHEN s[5] = 'experts' THEN s[6]::INT END AS expert, CASE WHEN s[5] = 'experts' THEN s[7] WHEN s[4] = 'moe' THEN s[6] WHEN s[2] = 'layers' THEN s[5] WHEN s[1] = 'm' THEN s[2] END AS component FROM pt)"""


@query(f"WITH {_CLASSIFIED} SELECT name, n, class, layer, expert, component FROM inv")
def inventory_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule of each name, with the layer, expert and component that it captures."""
    return _inventory(spark, sf_dir)


_ALL = lambda c, xs: " AND ".join(f"list_contains({c}, '{x}')" for x in xs)
_ANY = lambda c, xs: f"list_has_any({c}, {list(xs)})"
_LAYERS = f"""la AS (SELECT layer, coalesce(list(component) FILTER (class = 'attention'), []) AS at_, coalesce(list(component) FILTER (class = 'dense'), []) AS de, count(*) FILTER (class IN ('expert', 'shared')) AS moe, count(*) FILTER (class = 'expert') AS ex FROM inv WHERE layer IS NOT NULL GROUP BY 1),
lk AS (SELECT layer, CASE WHEN {_ANY("at_", _FULL)} AND {_ANY("at_", _LINEAR)} THEN 'CONFLICT' WHEN {_ALL("at_", _FULL)} THEN 'FULL' WHEN {_ALL("at_", _LINEAR)} THEN 'LINEAR' WHEN len(at_) = 0 THEN 'NONE' ELSE 'UNKNOWN' END AS attention,
CASE WHEN len(de) > 0 AND moe > 0 THEN 'CONFLICT' WHEN {_ALL("de", _DENSE)} THEN 'DENSE' WHEN ex > 0 THEN 'MOE' ELSE 'UNKNOWN' END AS ffn, CASE WHEN {_ANY("at_", _FULL)} AND {_ANY("at_", _LINEAR)} THEN 'BOTH' WHEN {_ANY("at_", _FULL)} THEN 'FULL' WHEN {_ANY("at_", _LINEAR)} THEN 'LINEAR' ELSE 'NONE' END AS evidence FROM la)"""


def _layers(inventory: DataFrame) -> DataFrame:
    of = lambda c: F.collect_set(F.when(F.col("class") == c, F.col("component")))
    sums = inventory.where("layer is not null").groupBy("layer").agg(of("attention").alias("at"), of("dense").alias("de"), F.count_if(F.col("class").isin("expert", "shared")).alias("moe"), F.count_if(F.col("class") == "expert").alias("ex"))
    families = {"FULL": _FULL, "LINEAR": _LINEAR}
    dense = F.size(F.array_except(F.array(*map(F.lit, _DENSE)), "de")) == 0
    ffn = F.when((F.size("de") > 0) & (F.col("moe") > 0), "CONFLICT").when(dense, "DENSE").when(F.col("ex") > 0, "MOE").otherwise("UNKNOWN")
    return sums.select("layer", mappings.marker_kind(F.col("at"), families).alias("attention"), ffn.alias("ffn"), mappings.evidence_kind(F.col("at"), families).alias("evidence"))


@query(f"WITH {_CLASSIFIED}, {_LAYERS} SELECT layer, attention, ffn, evidence FROM lk")
def layer_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of attention and feed-forward part of each layer, by whole sets of markers and by any."""
    return _layers(_inventory(spark, sf_dir))


@query(f"""WITH {_CLASSIFIED}, s AS (SELECT layer, list_sort(list(DISTINCT expert)) AS members FROM inv WHERE class = 'expert' GROUP BY 1)
SELECT array_to_string(members, ',') AS members, count(*) AS n_groups, members[1] AS first, members[-1] AS last, members[-1] - members[1] + 1 = len(members) AS contiguous FROM s GROUP BY s.members""")
def expert_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers by the set of their experts."""
    sets = mappings.set_groups(_inventory(spark, sf_dir).where("class = 'expert'"), "layer", "expert")
    return sets.withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


_SHARED_SQL = f"""sh AS (SELECT layer, list(DISTINCT component) AS held FROM inv WHERE class = 'shared' GROUP BY 1), xp AS (SELECT unnest(generate_series(1, 92))::INT AS layer),
sc AS (SELECT coalesce(xp.layer, sh.layer) AS layer, CASE WHEN xp.layer IS NULL THEN [] ELSE list_filter({list(_SHARED)}, lambda c: NOT list_contains(coalesce(held, []), c)) END AS lacks, list_filter(coalesce(held, []), lambda c: xp.layer IS NULL OR NOT list_contains({list(_SHARED)}, c)) AS more FROM xp FULL JOIN sh ON sh.layer = xp.layer)"""


def _shared(inventory: DataFrame) -> DataFrame:
    expected = inventory.sparkSession.range(1, 93).select(F.col("id").cast("int").alias("layer"), F.array(*map(F.lit, _SHARED)).alias("components"))
    return mappings.component_coverage(inventory.where("class = 'shared'"), expected, "layer", "component")


@query(f"WITH {_CLASSIFIED}, {_SHARED_SQL} SELECT layer, array_to_string(list_sort(lacks), ',') AS missing, array_to_string(list_sort(more), ',') AS unexpected FROM sc")
def shared_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components that each layer has to have, and those beyond."""
    return _shared(_inventory(spark, sf_dir))


@query(f"""WITH {_CLASSIFIED}, {_LAYERS}, {_SHARED_SQL}, es AS (SELECT layer, list_sort(list(DISTINCT expert)) AS m FROM inv WHERE class = 'expert' GROUP BY 1), ec AS (SELECT layer, expert, count(DISTINCT component) AS c FROM inv WHERE class = 'expert' GROUP BY 1, 2), rs AS (SELECT layer, count(DISTINCT component) AS c FROM inv WHERE class = 'layer_residual' GROUP BY 1),
f(ordinal, rule, n_bad) AS (SELECT 1, 'LAYER-001', count(*) FILTER (ffn <> 'DENSE') FROM lk WHERE layer = 0 UNION ALL SELECT 2, 'LAYER-002', count(*) FILTER (ffn <> 'MOE') FROM lk WHERE layer > 0 UNION ALL SELECT 3, 'ATTN-001', count(*) FILTER (attention <> 'LINEAR' AND attention <> 'FULL') FROM lk
UNION ALL SELECT 4, 'MOE-001', count(DISTINCT m) - 1 FROM es UNION ALL SELECT 5, 'MOE-002', count(*) FILTER (len(lacks) + len(more) > 0) FROM sc UNION ALL SELECT 6, 'MOE-003', count(*) FILTER (c <> 3) FROM ec
UNION ALL SELECT 7, 'ATTNRES-001', count(*) FILTER (c <> 3) FROM rs UNION ALL SELECT 8, 'ATTNRES-002', count(*) FILTER (component <> 'norm') FROM inv WHERE class = 'model' UNION ALL SELECT 9, 'TENSOR-001', count(*) FILTER (n > 1) FROM inv UNION ALL SELECT 10, 'TENSOR-002', count(*) FILTER (class = 'unclassified') FROM inv)
SELECT ordinal, rule, n_bad, CASE WHEN n_bad = 0 THEN 'PASS' WHEN rule IN ('TENSOR-001', 'TENSOR-002') THEN 'WARN' ELSE 'FAIL' END AS status FROM f""")
def inventory_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rules over one inventory, a finding each."""
    inventory = _inventory(spark, sf_dir)
    layers, shared = _layers(inventory), _shared(inventory)
    sets = mappings.set_groups(inventory.where("class = 'expert'"), "layer", "expert")
    largest = sets.agg(F.count("*").alias("n"))
    experts = inventory.where("class = 'expert'").groupBy("layer", "expert").agg(F.countDistinct("component").alias("c"))
    residual = inventory.where("class = 'layer_residual'").groupBy("layer").agg(F.countDistinct("component").alias("c"))
    others = largest.select(F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    parts = [
        ("LAYER-001", layers.where("layer = 0"), F.col("ffn") != "DENSE"), ("LAYER-002", layers.where("layer > 0"), F.col("ffn") != "MOE"), ("ATTN-001", layers, ~F.col("attention").isin("LINEAR", "FULL")), ("MOE-001", others, F.col("k") > 1),
        ("MOE-002", shared, (F.col("missing") != "") | (F.col("unexpected") != "")), ("MOE-003", experts, F.col("c") != 3), ("ATTNRES-001", residual, F.col("c") != 3), ("ATTNRES-002", inventory.where("class = 'model'"), F.col("component") != "norm"),
        ("TENSOR-001", inventory, F.col("n") > 1), ("TENSOR-002", inventory, F.col("class") == "unclassified"),
    ]
    return mappings.findings(parts, warns=("TENSOR-001", "TENSOR-002"))


_BINDING_RULES = (("line", "line.{layer}.A", "seg.{layer}.0", "A", 1, 9), ("flag", "line.{layer}.R", "seg.{layer}.1", "R", 0, 6), ("open", "line.{layer}.N", "seg.{layer}.2", "A", 1, 3), ("one", "line.1.A", "seg.1.0", "A", None, None), ("none", "absent", "seg.2.0", "A", None, None))
_ENTITIES = """src AS (SELECT CASE WHEN l_linenumber = 4 THEN 'gap.' ELSE 'line.' END || l_linenumber || '.' || l_returnflag AS identity, l_returnflag AS kind FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_linenumber, l_returnflag ORDER BY l_orderkey, l_partkey, l_suppkey) <= CASE WHEN l_linenumber = 5 THEN 2 ELSE 1 END),
tgt AS (SELECT CASE WHEN c_custkey % 8 = 6 THEN 'gap.' ELSE 'seg.' END || (c_custkey % 8) || '.' || (c_custkey % 3) AS identity FROM customer QUALIFY row_number() OVER (PARTITION BY c_custkey % 8, c_custkey % 3 ORDER BY c_custkey) <= CASE WHEN c_custkey % 8 = 3 THEN 2 ELSE 1 END)"""


@query(f"""WITH {_ENTITIES}, r(rule_id, s, t, kind, lo, hi) AS (VALUES {", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in _BINDING_RULES)}),
x AS (SELECT rule_id, kind, s, t, unnest(CASE WHEN lo IS NULL THEN [NULL] ELSE generate_series(lo, hi) END)::INT AS layer FROM r), b AS (SELECT rule_id, layer, CASE WHEN layer IS NULL THEN rule_id ELSE rule_id || '[' || layer || ']' END AS binding, replace(s, '{{layer}}', coalesce(layer, 0)::VARCHAR) AS source, replace(t, '{{layer}}', coalesce(layer, 0)::VARCHAR) AS target, kind FROM x),
n AS (SELECT b.*, (SELECT count(*) FROM src WHERE src.identity = b.source AND src.kind = b.kind) AS n_source, (SELECT count(*) FROM src WHERE src.identity = b.source) AS n_any, (SELECT count(*) FROM tgt WHERE tgt.identity = b.target) AS n_target FROM b)
SELECT binding, rule_id, layer, n_source, n_target, n_any > 0 AND n_source = 0 AS kind_mismatch, CASE WHEN n_source = 0 THEN 'ZERO_SOURCE' WHEN n_source > 1 THEN 'MULTIPLE_SOURCE' WHEN n_target = 0 THEN 'ZERO_TARGET' WHEN n_target > 1 THEN 'MULTIPLE_TARGET' ELSE 'MAPPED' END AS status FROM n""")
def mapping_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over layers against both sides: none, one or several matches, and kinds that do not fit."""
    rules = spark.createDataFrame(list(_BINDING_RULES), "rule_id string, source string, target string, kind string, lo int, hi int")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_linenumber", "l_returnflag").agg(F.count("*").alias("n"))
    copies = lambda twice: F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("n"), F.when(twice, 2).otherwise(1))))
    named = lambda there, name, *parts: F.concat_ws(".", F.when(there, name).otherwise("gap"), *parts).alias("identity")
    line = F.col("l_linenumber")
    sources = lines.select(named(line != 4, "line", "l_linenumber", "l_returnflag"), F.col("l_returnflag").alias("kind"), copies(line == 5)).drop("col")
    segments = table(spark, sf_dir, "customer").groupBy((F.col("c_custkey") % 8).alias("a"), (F.col("c_custkey") % 3).alias("b")).agg(F.count("*").alias("n"))
    targets = segments.select(named(F.col("a") != 6, "seg", "a", "b"), copies(F.col("a") == 3)).drop("col")
    return mappings.resolved(mappings.bindings(rules), sources, targets).drop("source", "target")


@query(f"""WITH s AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_linestatus = 'O'), t AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'O'), ig AS (SELECT k FROM s WHERE {drawn_sql("k", "ignored", 9)} = 0),
a AS (SELECT 'source' AS side, CASE WHEN k IN (SELECT k FROM t) THEN 'mapped' WHEN k IN (SELECT k FROM ig) THEN 'ignored' ELSE 'unmapped' END AS state, k FROM s UNION ALL SELECT 'target', CASE WHEN k IN (SELECT k FROM s) THEN 'mapped' ELSE 'unmapped' END, k FROM t)
SELECT side, state, count(*) AS n, array_to_string(list_sort(list(k))[1:5], ',') AS examples FROM a GROUP BY 1, 2""")
def mapping_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of sources and of targets: orders with open lines against open orders."""
    sources = table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("k")).distinct()
    targets = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("k"))
    mapped = sources.join(targets, "k", "left_semi")
    return mappings.coverage(sources, mapped, sources.where(drawn(F.col("k"), "ignored", 9) == 0), "k", "source", 5).union(mappings.coverage(targets, mapped, targets.limit(0), "k", "target", 5))


@query("""WITH m AS (SELECT CASE WHEN l_partkey % 9 > 0 THEN l_orderkey ELSE -1 - l_orderkey END AS l_orderkey, count(*) AS n_members, count(DISTINCT l_linestatus) AS n_kinds, count(DISTINCT l_quantity > 49) AS n_shapes FROM lineitem GROUP BY 1), t AS (SELECT o_orderkey, o_custkey % 6 + 1 AS n FROM orders WHERE o_orderstatus <> 'P')
SELECT coalesce(l_orderkey, o_orderkey) AS l_orderkey, coalesce(n_members, 0) AS n_members, coalesce(n_kinds, 0) AS n_kinds, coalesce(n_shapes, 0) AS n_shapes,
CASE WHEN o_orderkey IS NULL THEN 'TARGET_MISSING' WHEN l_orderkey IS NULL THEN 'SOURCE_MISSING' WHEN n_members <> n THEN 'CARDINALITY' WHEN n_kinds > 1 THEN 'KIND_CONFLICT' WHEN n_shapes > 1 THEN 'SHAPE_CONFLICT' ELSE 'MAPPED' END AS status FROM m FULL JOIN t ON l_orderkey = o_orderkey""")
def grouped_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many lines for one order: how many, of one kind and shape, and both sides there."""
    of = F.when(F.col("l_partkey") % 9 > 0, F.col("l_orderkey")).otherwise(-1 - F.col("l_orderkey"))  # the others are of no order
    members = table(spark, sf_dir, "lineitem").select(of.alias("l_orderkey"), "l_linestatus", (F.col("l_quantity") > 49).alias("big"))
    targets = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").withColumnRenamed("o_orderkey", "l_orderkey")
    return mappings.grouped(members, targets, "l_orderkey", F.col("o_custkey") % 6 + 1, "l_linestatus", "big")


@query(f"""WITH x AS (SELECT unnest(['source_physical', 'source_logical', 'target_physical', 'mapping_result', 'source_group']) AS domain, unnest([l_orderkey || '.' || l_linenumber || '.' || l_partkey, CASE WHEN l_returnflag = 'N' THEN l_orderkey || '.' || l_linenumber END, 't' || l_partkey || '.' || l_suppkey, l_orderkey || '.' || l_partkey, CASE WHEN {drawn_sql(_KEY, "group", 50)} = 0 THEN 'g' || l_orderkey END]) AS claim FROM lineitem),
r AS (SELECT domain, claim FROM x WHERE claim IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1) SELECT domain, count(*) AS n, array_to_string(list_sort(list(claim))[1:8], ',') AS examples FROM r GROUP BY 1""")
def assignment_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that are claimed more than once, in five domains."""
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    line = F.concat_ws(".", "l_orderkey", "l_linenumber")
    domains = {
        "source_physical": F.concat_ws(".", "l_orderkey", "l_linenumber", "l_partkey"), "source_logical": F.when(F.col("l_returnflag") == "N", line), "target_physical": F.concat(F.lit("t"), F.concat_ws(".", "l_partkey", "l_suppkey")),
        "mapping_result": F.concat_ws(".", "l_orderkey", "l_partkey"), "source_group": F.when(drawn(key, "group", 50) == 0, F.concat(F.lit("g"), F.col("l_orderkey").cast("string"))),
    }
    return mappings.claims(table(spark, sf_dir, "lineitem"), domains, 8)


@query(f"""WITH p AS (SELECT p_partkey AS k, CASE WHEN p_size > 10 THEN p_size END AS layer, [p_size, 64] AS shape, p_brand AS module, p_type AS component, {one_of_sql("p_partkey", "relation", "identical", "reversed")} AS relation FROM part),
x AS (SELECT p.*, CASE WHEN {drawn_sql("k", "layer", 20)} = 0 THEN 99 ELSE layer END AS t_layer, CASE WHEN (relation = 'reversed') <> ({drawn_sql("k", "shape", 20)} = 0) THEN [64, shape[1]] ELSE shape END AS t_shape, module AS t_module, CASE WHEN {drawn_sql("k", "component", 20)} = 0 THEN 'other' ELSE component END AS t_component FROM p)
SELECT k, layer IS NOT DISTINCT FROM t_layer AS layer_ok, CASE WHEN relation = 'reversed' THEN list_reverse(shape) ELSE shape END = t_shape AS shape_ok, module = t_module AND component = t_component AS parameter_ok FROM x""")
def mapping_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose layers, shapes and parameters a mapping has to keep."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k.alias("k"), F.when(F.col("p_size") > 10, F.col("p_size")).alias("layer"), F.array(F.col("p_size").cast("long"), F.lit(64).cast("long")).alias("shape"), F.col("p_brand").alias("module"), F.col("p_type").alias("component"), one_of(k, "relation", "identical", "reversed").alias("relation"))
    key = F.col("k")
    turned = (F.col("relation") == "reversed") != (drawn(key, "shape", 20) == 0)
    pairs = rows.withColumn("t_layer", F.when(drawn(key, "layer", 20) == 0, 99).otherwise(F.col("layer"))).withColumn("t_shape", F.when(turned, F.reverse("shape")).otherwise(F.col("shape"))).withColumn("t_module", F.col("module")).withColumn("t_component", F.when(drawn(key, "component", 20) == 0, "other").otherwise(F.col("component")))
    return mappings.relation_findings(pairs, ("layer", "t_layer"), ("shape", "t_shape"), "relation", (["module", "component"], ["t_module", "t_component"])).select("k", "layer_ok", "shape_ok", "parameter_ok")


@query(f"""WITH r AS (SELECT p_brand AS rule, p_type AS kind, {drawn_sql("p_brand", "sources", 3)} + CASE WHEN {drawn_sql("p_partkey", "differs", 200)} = 0 THEN 1 ELSE 0 END AS n_sources FROM part WHERE {drawn_sql("p_brand", "emitted", 7)} > 0),
p AS (SELECT DISTINCT p_brand AS rule, {drawn_sql("p_brand", "sources", 3)} AS n_sources FROM part WHERE {drawn_sql("p_brand", "ruled", 7)} > 0)
SELECT coalesce(r.rule, p.rule) AS rule, count(r.rule) AS n_results, CASE WHEN bool_or(p.rule IS NULL) THEN 'UNKNOWN_RULE' WHEN count(r.rule) = 0 THEN 'NO_RESULTS' WHEN bool_or(r.n_sources <> p.n_sources) THEN 'DIFFERS' ELSE 'CONFORMS' END AS status FROM r FULL JOIN p ON r.rule = p.rule GROUP BY 1""")
def mapping_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results against the policy's rules: unknown, without results, different, or as ruled."""
    brand = F.col("p_brand")
    rows = table(spark, sf_dir, "part")
    results = rows.where(drawn(brand, "emitted", 7) > 0).select(brand.alias("rule"), (drawn(brand, "sources", 3) + F.when(drawn(F.col("p_partkey"), "differs", 200) == 0, 1).otherwise(0)).alias("n_sources"))
    policy = rows.where(drawn(brand, "ruled", 7) > 0).select(brand.alias("rule"), drawn(brand, "sources", 3).alias("n_sources")).distinct()
    return mappings.policy_conformance(results, policy, "rule", "n_sources")


@query(f"""WITH a AS (SELECT c_custkey AS rule, x AS alternative, c_custkey * 7 + x * 11 AS tensor, {drawn_sql("c_custkey * 3 + x", "trusted", 3)} > 0 AS trusted FROM customer, (VALUES (0), (1), (2)) v(x)), t AS (SELECT p_partkey % 9000 AS tensor, count(*) AS n FROM part WHERE p_partkey % 5 > 1 GROUP BY 1),
g AS (SELECT rule, alternative, trusted AND coalesce(n = 1, false) AS good FROM a LEFT JOIN t USING (tensor))
SELECT rule, count(*) FILTER (good) AS n_satisfied, CASE WHEN count(*) FILTER (good) = 1 THEN min(alternative) FILTER (good) END AS chosen, CASE count(*) FILTER (good) WHEN 0 THEN 'UNREALIZED' WHEN 1 THEN 'REALIZED' ELSE 'AMBIGUOUS' END AS status FROM g GROUP BY 1""")
def mapping_realizations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alternatives of which exactly one has to be satisfied."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("rule"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("alternative"))
    alternatives = rows.select("rule", "alternative", (F.col("rule") * 7 + F.col("alternative") * 11).alias("tensor"), (drawn(F.col("rule") * 3 + F.col("alternative"), "trusted", 3) > 0).alias("trusted"))
    return mappings.realizations(alternatives, table(spark, sf_dir, "part").where("p_partkey % 5 > 1").select((F.col("p_partkey") % 9000).alias("tensor")), "rule", "tensor")


@query(f"""WITH src AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_linestatus = 'O'), tgt AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'O'), {catalogue.ORACLE_SQL["mapping_relations"].removeprefix("WITH ").split("SELECT k, layer IS NOT")[0].rstrip()},
a AS (SELECT c_custkey AS rule, y AS alternative, c_custkey * 7 + y * 11 AS tensor, {drawn_sql("c_custkey * 3 + y", "trusted", 3)} > 0 AS trusted FROM customer, (VALUES (0), (1), (2)) v(y)), pt AS (SELECT p_partkey % 9000 AS tensor, count(*) AS n FROM part WHERE p_partkey % 5 > 1 GROUP BY 1), g AS (SELECT rule, count(*) FILTER (trusted AND coalesce(n = 1, false)) AS good FROM a LEFT JOIN pt USING (tensor) GROUP BY 1),
f(ordinal, rule, n_failed, n_warned) AS (SELECT 1, 'MAP-001', (SELECT count(*) FROM src WHERE k NOT IN (SELECT k FROM tgt)), 0 UNION ALL SELECT 2, 'MAP-002', (SELECT count(*) FROM tgt WHERE k NOT IN (SELECT k FROM src)), 0
UNION ALL SELECT 3, 'MAP-003', (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey HAVING count(*) > 1)), 0 UNION ALL SELECT 4, 'MAP-004', (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(*) > 1)), 0
UNION ALL SELECT 5, 'MAP-005', (SELECT count(*) FROM x WHERE layer IS DISTINCT FROM t_layer), 0 UNION ALL SELECT 6, 'MAP-006', (SELECT count(*) FROM x WHERE CASE WHEN relation = 'reversed' THEN list_reverse(shape) ELSE shape END <> t_shape), 0 UNION ALL SELECT 7, 'MAP-007', (SELECT count(*) FROM x WHERE module <> t_module OR component <> t_component), 0
UNION ALL SELECT 8, 'MAP-008', (SELECT count(*) FROM g WHERE good <> 1), 0 UNION ALL SELECT 9, 'MAP-009', 0, (SELECT count(*) FROM region))
SELECT ordinal, rule, n_failed, n_warned, CASE WHEN n_failed > 0 THEN 'FAIL' WHEN n_warned > 0 THEN 'WARN' ELSE 'PASS' END AS status FROM f""")
def mapping_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine findings on a mapping: coverage of both sides, claims, layers, shapes, parameters, ties, and provenance, which without lineage always warns."""
    lines = table(spark, sf_dir, "lineitem")
    sources = lines.where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("k")).distinct()
    targets = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("k"))
    relations, ties = mapping_relations(spark, sf_dir), mapping_realizations(spark, sf_dir)
    twice = lambda *c: lines.groupBy(*c).agg(F.count("*").alias("n"))
    parts = [
        ("MAP-001", sources.join(targets, "k", "left_anti"), F.lit(True), None), ("MAP-002", targets.join(sources, "k", "left_anti"), F.lit(True), None), ("MAP-003", twice("l_orderkey", "l_linenumber", "l_partkey"), F.col("n") > 1, None),
        ("MAP-004", twice("l_partkey", "l_suppkey"), F.col("n") > 1, None), ("MAP-005", relations, ~F.col("layer_ok"), None), ("MAP-006", relations, ~F.col("shape_ok"), None), ("MAP-007", relations, ~F.col("parameter_ok"), None),
        ("MAP-008", ties, F.col("status") != "REALIZED", None), ("MAP-009", table(spark, sf_dir, "region"), F.lit(False), F.lit(True)),
    ]
    return rollups.rule_findings(parts)
