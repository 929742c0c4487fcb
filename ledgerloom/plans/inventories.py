"""Queries over whole inventories: orders are the layers of a schedule, their lines the sources, orders and their copies the targets; names against thousands of rules; what was known at thousands of cutoffs."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import accounting, asof, rule_index, views
from ledgerloom.plans.catalogue import query, table
from ledgerloom.plans.drawn import drawn, drawn_sql

_RULES = (
    ("packed", "F", "o{layer}.{member}", ["t{layer}"], 1, None, "PACKED_GROUP_MEMBER", "PACKED_TARGET", None),
    ("direct", "O", "o{layer}.1", ["t{layer}"], 1, 1, "DIRECTLY_MAPPED", "DIRECTLY_REALIZED", ["N", "R"]),
    ("split", "P", "o{layer}.{member}", ["t{layer}", "u{layer}"], 1, 1, "LOGICAL_REALIZATION_SOURCE", "LOGICAL_REALIZATION_TARGET", None),
    ("fused", "P", "o{layer}.{member}", ["v{layer}"], 2, 3, "FUSED_SOURCE", "FUSED_TARGET", ["A", "N", "R"]),
    ("auxiliary", "1-URGENT", "o{layer}.{member}", None, 4, 7, "SOURCE_ONLY_AUXILIARY", None, None),
    ("residual", "2-HIGH", "o{layer}.7", ["t{layer}"], 1, 1, "DIRECTLY_MAPPED", "DIRECTLY_REALIZED", None),
    ("metadata", "3-MEDIUM", None, ["v{layer}"], 1, 1, None, "METADATA_REALIZED", None),
)
_ACCOUNTS = f"""inv AS (SELECT 'source' AS side, 'o' || l_orderkey || '.' || l_linenumber AS name, l_returnflag AS type FROM lineitem UNION ALL SELECT 'target', 't' || o_orderkey, NULL FROM orders UNION ALL SELECT 'target', 'u' || o_orderkey, NULL FROM orders WHERE {drawn_sql("o_orderkey", "copied", 5)} > 0
UNION ALL SELECT 'target', 'v' || o_orderkey, NULL FROM orders WHERE o_orderpriority = '3-MEDIUM' OR o_orderstatus = 'P'),
sch AS (SELECT o_orderkey AS layer, o_orderstatus AS kind, {drawn_sql("o_orderkey", "members", 3)} + 1 AS members FROM orders UNION ALL SELECT o_orderkey, o_orderpriority, 0 FROM orders),
c AS (SELECT 'packed' AS rule_id, layer, 'source' AS side, 'o' || layer || '.' || unnest(range(1, members + 1)) AS name, 'PACKED_GROUP_MEMBER' AS state, NULL AS types FROM sch WHERE kind = 'F' UNION ALL SELECT 'packed', layer, 'target', 't' || layer, 'PACKED_TARGET', NULL FROM sch WHERE kind = 'F'
UNION ALL SELECT 'direct', layer, 'source', 'o' || layer || '.1', 'DIRECTLY_MAPPED', ['N', 'R'] FROM sch WHERE kind = 'O' UNION ALL SELECT 'direct', layer, 'target', 't' || layer, 'DIRECTLY_REALIZED', NULL FROM sch WHERE kind = 'O'
UNION ALL SELECT 'split', layer, 'source', 'o' || layer || '.1', 'LOGICAL_REALIZATION_SOURCE', NULL FROM sch WHERE kind = 'P' UNION ALL SELECT 'split', layer, 'target', unnest(['t' || layer, 'u' || layer]), 'LOGICAL_REALIZATION_TARGET', NULL FROM sch WHERE kind = 'P'
UNION ALL SELECT 'fused', layer, 'source', 'o' || layer || '.' || unnest([2, 3]), 'FUSED_SOURCE', NULL FROM sch WHERE kind = 'P' UNION ALL SELECT 'fused', layer, 'target', 'v' || layer, 'FUSED_TARGET', NULL FROM sch WHERE kind = 'P'
UNION ALL SELECT 'auxiliary', layer, 'source', 'o' || layer || '.' || unnest([4, 5, 6, 7]), 'SOURCE_ONLY_AUXILIARY', NULL FROM sch WHERE kind = '1-URGENT'
UNION ALL SELECT 'residual', layer, 'source', 'o' || layer || '.7', 'DIRECTLY_MAPPED', NULL FROM sch WHERE kind = '2-HIGH' UNION ALL SELECT 'residual', layer, 'target', 't' || layer, 'DIRECTLY_REALIZED', NULL FROM sch WHERE kind = '2-HIGH' UNION ALL SELECT 'metadata', layer, 'target', 'v' || layer, 'METADATA_REALIZED', NULL FROM sch WHERE kind = '3-MEDIUM'),
th AS (SELECT side, name, count(*) AS n_there, list(DISTINCT type) AS own FROM inv GROUP BY ALL),
j AS (SELECT c.*, n_there, count(*) OVER (PARTITION BY c.side, c.name) AS n_claims, CASE WHEN n_there IS NULL THEN 0 WHEN n_there > 1 THEN 1 WHEN count(*) OVER (PARTITION BY c.side, c.name) > 1 THEN 2 WHEN c.side = 'source' AND types IS NOT NULL AND NOT list_has_all(types, own) THEN 3 ELSE 4 END AS rank FROM c LEFT JOIN th USING (side, name)),
g AS (SELECT rule_id, layer, ['MISSING', 'AMBIGUOUS', 'CONFLICT', 'TYPE', 'MAPPED'][min(rank) + 1] AS status, count(*) AS n FROM j GROUP BY 1, 2)"""


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders, key = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"), F.col("o_orderkey")
    sources = lines.select(F.lit("source").alias("side"), F.concat(F.lit("o"), F.concat_ws(".", "l_orderkey", "l_linenumber")).alias("name"), F.col("l_returnflag").alias("type"))
    held = {"t": F.lit(True), "u": drawn(key, "copied", 5) > 0, "v": (F.col("o_orderpriority") == "3-MEDIUM") | (F.col("o_orderstatus") == "P")}
    names = F.explode(F.array_compact(F.array(*(F.when(there, F.concat(F.lit(letter), key.cast("string"))) for letter, there in held.items()))))
    return sources.unionByName(orders.select(F.lit("target").alias("side"), names.alias("name"), F.lit(None).cast("string").alias("type")))


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    kinds = F.explode(F.array(F.struct(F.col("o_orderstatus").alias("kind"), (drawn(F.col("o_orderkey"), "members", 3) + 1).alias("members")), F.struct(F.col("o_orderpriority").alias("kind"), F.lit(0).alias("members"))))
    schedule = orders.select(F.col("o_orderkey").alias("layer"), kinds.alias("x")).select("layer", "x.*")
    inventory = _inventory(spark, sf_dir)
    claimed = accounting.claims(spark.createDataFrame(list(_RULES), accounting.RULES), schedule)
    return accounting.judged(claimed, inventory), inventory


@query(f"""WITH {_ACCOUNTS}, e AS (SELECT side, name, count(*) AS n, max(n_there) AS n_there, max(state) AS given, max(status) AS status FROM j JOIN g USING (rule_id, layer) GROUP BY 1, 2)
SELECT inv.side, CASE WHEN e.n IS NULL THEN 'UNCLAIMED' WHEN e.n > 1 THEN 'CONFLICT' WHEN n_there > 1 THEN 'AMBIGUOUS' WHEN status <> 'MAPPED' THEN 'GROUP_FAILED' ELSE given END AS state, count(*) AS n, sum(count(*)) OVER (PARTITION BY inv.side)::BIGINT AS n_side FROM inv LEFT JOIN e USING (side, name) GROUP BY 1, 2""")
def inventory_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sources and targets are in each state; the states of a side sum to its inventory."""
    return accounting.state_counts(*_judged(spark, sf_dir))


@query(f"WITH {_ACCOUNTS} SELECT rule_id, status, count(*) AS n_groups, sum(n)::BIGINT AS n_claims FROM g GROUP BY 1, 2")
def accounted_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of each rule by what became of them."""
    groups = _judged(spark, sf_dir)[0].groupBy("rule_id", "layer").agg(F.first("status").alias("status"), F.count("*").alias("n"))
    return groups.groupBy("rule_id", "status").agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_claims"))


@query(f"WITH {_ACCOUNTS} SELECT side, name, string_agg(rule_id || '[' || layer || ']', ',' ORDER BY rule_id || '[' || layer || ']') AS rules FROM j WHERE n_claims > 1 GROUP BY 1, 2")
def accounting_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that several rules claim, with the rules."""
    return accounting.conflicts(_judged(spark, sf_dir)[0])


_GLOBS = """r AS (SELECT p_partkey AS rule, p_size AS rank, CASE p_partkey % 6 WHEN 0 THEN 'line.' || p_partkey || '.*' WHEN 1 THEN '*.' || (p_partkey % 97) || '.3' WHEN 2 THEN 'l?ne.' || p_partkey || '.[0-4]*' WHEN 3 THEN '*.' || p_partkey || '.*.[!1-3]' WHEN 4 THEN 'none-' || p_partkey || '*' ELSE '?i*.' || p_partkey || '?*' END AS pat FROM part),
n AS (SELECT DISTINCT 'line.' || l_partkey || '.' || l_suppkey || '.' || l_linenumber AS name FROM lineitem)"""


@query(f"WITH {_GLOBS}, f AS (SELECT name, arg_min(rule, rank::BIGINT * 1000000000 + rule) AS rule FROM n JOIN r ON name GLOB pat GROUP BY 1) SELECT n.name, rule FROM n LEFT JOIN f USING (name)")
def first_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of as many rules as there are parts whose glob is the whole name of a line."""
    k = F.col("p_partkey")
    said = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in x))
    forms = [said("line.", k, ".*"), said("*.", k % 97, ".3"), said("l?ne.", k, ".[0-4]*"), said("*.", k, ".*.[!1-3]"), said("none-", k, "*"), said("?i*.", k, "?*")]
    rules = table(spark, sf_dir, "part").select(k.alias("rule"), F.col("p_size").alias("rank"), F.element_at(F.array(*forms), (k % 6 + 1).cast("int")).alias("glob"))
    names = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("line."), F.concat_ws(".", "l_partkey", "l_suppkey", "l_linenumber")).alias("name"))
    return rule_index.first_matches(names, rules, "name", "rule", "rank", "glob")


@query(f"""WITH f AS (SELECT event_id, user_id, event_type, greatest(ts, ts + to_hours({drawn_sql("event_id", "supplied", 120)} - 24)) AS known FROM events WHERE {drawn_sql("event_id", "recorded", 15)} > 0),
c AS (SELECT event_id AS cutoff_id, user_id, CASE WHEN {drawn_sql("event_id", "asked", 40)} > 0 THEN ts + to_hours({drawn_sql("event_id", "cutoff", 96)}) END AS cutoff FROM events),
u AS (SELECT user_id, known, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, sum(count(*)) OVER (PARTITION BY user_id ORDER BY known) AS n FROM f GROUP BY 1, 2)
SELECT cutoff_id, c.user_id, cutoff, coalesce(n, 0)::BIGINT AS n_known, event_id, event_type FROM c ASOF LEFT JOIN u ON c.user_id = u.user_id AND c.cutoff >= u.known""")
def known_at_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each event a cutoff of its own: how many events of its user were known by then on both time axes, and the last of them."""
    events, key = table(spark, sf_dir, "events"), F.col("event_id")
    later = lambda salt, n, less=0: F.col("ts") + F.make_interval(hours=drawn(key, salt, n) - less)
    facts = events.select("event_id", "user_id", "event_type", asof.known_from(F.col("ts"), F.when(drawn(key, "recorded", 15) > 0, later("supplied", 120, 24))).alias("known"))
    cutoffs = events.select(key.alias("cutoff_id"), "user_id", F.when(drawn(key, "asked", 40) > 0, later("cutoff", 96)).alias("cutoff"))
    return asof.known_at(facts, cutoffs, "user_id", "known", "event_id", "cutoff", "cutoff_id", ["event_type"])


_VIEW = """t AS (SELECT 'n' || p_partkey AS name, CASE WHEN p_partkey % 71 = 9 THEN NULL WHEN p_partkey % 53 = 7 THEN p_partkey - 1 ELSE p_partkey END AS identity, p_size AS shape, p_type AS type FROM part WHERE p_partkey % 61 <> 4),
ties AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN p_partkey + 10000000 ELSE p_partkey + 3 END AS logical, p_partkey AS physical FROM part WHERE p_size % 10 = 1),
u AS (SELECT logical AS a, physical AS b FROM ties UNION SELECT physical, logical FROM ties), w AS (WITH RECURSIVE w AS (SELECT a AS origin, b AS node FROM u UNION SELECT w.origin, u.b FROM w JOIN u ON u.a = w.node) SELECT * FROM w), cl AS (SELECT origin AS identity, least(origin, min(node)) AS entity FROM w GROUP BY origin),
n AS (SELECT identity, count(*) AS n FROM t WHERE identity IS NOT NULL GROUP BY 1), ph AS (SELECT t.identity, name, 'PHYSICAL' AS kind, coalesce(entity, t.identity) AS entity, t.identity AS backed_by, shape, type, n FROM t LEFT JOIN n USING (identity) LEFT JOIN cl USING (identity)),
bk AS (SELECT * FROM ph WHERE identity IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity ORDER BY identity, name) = 1), lo AS (SELECT cl.identity, cl.identity::VARCHAR AS name, 'LOGICAL' AS kind, cl.entity, bk.identity AS backed_by, bk.shape, bk.type, bk.n FROM cl LEFT JOIN bk ON bk.entity = cl.entity WHERE cl.identity NOT IN (SELECT identity FROM n)),
v AS (SELECT identity, name, kind, entity, backed_by, shape, type, CASE WHEN identity IS NULL THEN 'UNCLASSIFIED' WHEN backed_by IS NULL THEN 'UNBACKED' WHEN n > 1 THEN 'DUPLICATE_IDENTITY' ELSE 'OK' END AS state FROM (SELECT * FROM ph UNION ALL SELECT * FROM lo))"""


def _view(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, parts = F.col("p_partkey"), table(spark, sf_dir, "part")
    identity = F.when(k % 71 == 9, None).when(k % 53 == 7, k - 1).otherwise(k)
    tensors = parts.where("p_partkey % 61 <> 4").select(F.concat(F.lit("n"), k.cast("string")).alias("name"), identity.alias("identity"), F.col("p_size").alias("shape"), F.col("p_type").alias("type"))
    ties = parts.where("p_size % 10 = 1").select(F.when(k % 2 == 0, k + 10_000_000).otherwise(k + 3).alias("logical"), k.alias("physical"))
    return views.semantic_view(tensors, ties)


@query(f"WITH {_VIEW} SELECT * FROM v")
def semantic_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as stored and as tied entities, with what backs each."""
    return _view(spark, sf_dir)


@query(f"""WITH {_VIEW}, tg AS (SELECT DISTINCT l_partkey AS i FROM lineitem WHERE l_partkey % 3 > 0), rz AS (SELECT DISTINCT CASE WHEN l_partkey % 2 = 0 THEN l_partkey + 10000000 ELSE l_partkey END AS i FROM lineitem),
o AS (SELECT DISTINCT entity, identity, kind FROM v WHERE identity IS NOT NULL), s AS (SELECT entity, count(*) FILTER (kind = 'PHYSICAL') AS n_stored, count(*) FILTER (kind = 'LOGICAL') AS n_logical, count(tg.i) AS n_targets, count(rz.i) FILTER (tg.i IS NULL) AS n_virtual FROM o LEFT JOIN tg ON tg.i = identity LEFT JOIN rz ON rz.i = identity GROUP BY 1)
SELECT *, CASE WHEN n_targets > greatest(n_stored, 1) THEN 'AMBIGUOUS' WHEN n_targets > 0 THEN 'COVERED' WHEN n_virtual > 0 THEN 'VIRTUAL' ELSE 'UNCOVERED' END AS state FROM s""")
def entity_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by what stands for them among the lines: stored, added by realization, or nothing."""
    lines, k = table(spark, sf_dir, "lineitem"), F.col("l_partkey")
    realized = lines.select(F.when(k % 2 == 0, k + 10_000_000).otherwise(k).alias("identity"))
    return views.entity_coverage(_view(spark, sf_dir), lines.where("l_partkey % 3 > 0").select(k.alias("identity")), realized)
