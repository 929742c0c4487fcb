"""Queries that assess: multisets, ordered tables, numbered sets, snapshots, delegation, separation, gates and streams."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import values
from ledgerloom.operators import assess, components, graphs
from ledgerloom.operators import compare as cmp
from ledgerloom.operators.written import ranked, written
from ledgerloom.plans.catalogue import query, table
from ledgerloom.streaming import claims


@query("""WITH c AS (SELECT o_orderpriority, year(o_orderdate) AS y, count(*) FILTER (o_orderstatus = 'F') AS n_left, count(*) FILTER (o_orderstatus = 'O') AS n_right FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2)
SELECT *, CASE WHEN n_left = 0 THEN 'UNEXPECTED' WHEN n_right = 0 THEN 'MISSING' WHEN n_left = n_right THEN 'EQUAL' ELSE 'COUNT_DIFFERS' END AS status FROM c""")
def multiset_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed orders against open ones, as multisets of priority and year."""
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", F.year("o_orderdate").cast("long").alias("y"), "o_orderstatus")
    return assess.multisets(rows.where("o_orderstatus = 'F'"), rows.where("o_orderstatus = 'O'"), "o_orderpriority", "y")


@query("""WITH l AS (SELECT l_orderkey, CASE WHEN bool_and(l_linestatus = 'F') THEN 'F' WHEN bool_and(l_linestatus = 'O') THEN 'O' ELSE 'P' END AS derived FROM lineitem GROUP BY 1)
SELECT o_orderstatus, coalesce(derived, 'NONE') AS derived, count(*) AS n FROM orders LEFT JOIN l ON o_orderkey = l_orderkey GROUP BY 1, 2""")
def status_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared status against the one that an order's lines give, counted by pair."""
    all_of = lambda s: F.bool_and(F.col("l_linestatus") == s)
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(cmp.ladder([("F", all_of("F")), ("O", all_of("O"))], "P").alias("derived"))
    both = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return both.groupBy("o_orderstatus", F.coalesce("derived", F.lit("NONE")).alias("derived")).agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT 'order' || l_orderkey AS base, l_linenumber::BIGINT AS number, max(l_linenumber) OVER (PARTITION BY l_orderkey)::BIGINT AS total FROM lineitem),
s AS (SELECT base, total, count(*) AS n, count(DISTINCT number) AS n_present, min(number) AS lo FROM x GROUP BY 1, 2)
SELECT base, total, n_present, total - n_present AS n_missing, CASE WHEN lo < 1 THEN 'INVALID' WHEN n > n_present THEN 'DUPLICATE' WHEN n_present < total THEN 'INCOMPLETE' ELSE 'COMPLETE' END AS status FROM s""")
def split_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of numbered names, parsed back from the names."""
    total = F.max("l_linenumber").over(Window.partitionBy("l_orderkey"))
    name = F.format_string("order%d-%05d-of-%05d", "l_orderkey", "l_linenumber", total)
    return assess.numbered_sets(table(spark, sf_dir, "lineitem").select(name.alias("name")), "name")


@query("""WITH c AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 100)
SELECT l_partkey, any_value(c.n) AS n, array_to_string(list_sort(list(DISTINCT l_orderkey))[1:3], ',') AS examples FROM lineitem JOIN c USING (l_partkey) GROUP BY 1""")
def frequent_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: the 100 parts with most lines, each with its three smallest orders."""
    return assess.frequent(table(spark, sf_dir, "lineitem"), "l_partkey", "l_orderkey", 100, 3)


@query("""WITH e AS (SELECT user_id, ts, event_id, json_extract_string(props, '$.k') AS k FROM events)
SELECT user_id, arg_min(coalesce(k, ''), (ts, event_id)) AS first_k, arg_max(coalesce(k, ''), (ts, event_id)) AS last_k,
CASE WHEN count(*) = 1 THEN 'INSUFFICIENT' WHEN arg_min(coalesce(k, ''), (ts, event_id)) = arg_max(coalesce(k, ''), (ts, event_id)) THEN 'EQUAL' ELSE 'CHANGED' END AS status FROM e GROUP BY 1""")
def metadata_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of a subject's first record against that of its last; metadata_rules and metadata_categories have the whole of it."""
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("k"))
    ends = rows.groupBy("user_id").agg(F.min_by("k", F.struct("ts", "event_id")).alias("first_k"), F.max_by("k", F.struct("ts", "event_id")).alias("last_k"), F.count("*").alias("n"))
    return ends.select("user_id", "first_k", "last_k", cmp.ladder([("INSUFFICIENT", F.col("n") == 1), ("EQUAL", F.col("first_k") == F.col("last_k"))], "CHANGED").alias("status"))


_CENTS = "round(l_extendedprice * 100)::BIGINT"


@query(f"""WITH s AS (SELECT l_orderkey, l_linenumber, sum({_CENTS}) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, {_CENTS}, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING)::BIGINT AS "end", {_CENTS} AS size FROM lineitem)
SELECT l_orderkey, l_linenumber, "end" - size AS "start", "end", CASE WHEN o_orderkey IS NULL THEN 'UNAVAILABLE' WHEN size <= 0 THEN 'INVALID' WHEN "end" <= round(o_totalprice * 100)::BIGINT THEN 'BOUNDED' ELSE 'OUT_OF_BOUNDS' END AS status FROM s LEFT JOIN orders ON o_orderkey = l_orderkey""")
def span_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans laid end to end against the length that their container declares."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("size"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "size", "l_partkey", "l_suppkey").rowsBetween(Window.unboundedPreceding, 0)
    spans = rows.withColumn("end", F.sum("size").over(order)).withColumn("start", F.col("end") - F.col("size"))
    whole = table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("length"))
    rungs = [("UNAVAILABLE", F.col("o_orderkey").isNull()), ("INVALID", F.col("size") <= 0), ("BOUNDED", F.col("end") <= F.col("length"))]
    return spans.join(whole, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("l_orderkey", "l_linenumber", "start", "end", cmp.ladder(rungs, "OUT_OF_BOUNDS").alias("status"))


_AT = {"before": "2024-01-02 00:00:00", "after": "2024-01-04 00:00:00"}


@query(f"""WITH s AS (SELECT user_id, arg_max(event_type, (ts, event_id)) FILTER (ts <= TIMESTAMP '{_AT["before"]}') AS before, arg_max(event_type, (ts, event_id)) FILTER (ts <= TIMESTAMP '{_AT["after"]}') AS after FROM events GROUP BY 1)
SELECT *, CASE WHEN after IS NULL THEN 'MISSING' WHEN before = after THEN 'UNCHANGED' WHEN after = 'refund' THEN 'REVOKED' WHEN after = 'error' THEN 'DENIED' WHEN before IN ('refund', 'error') THEN 'RESTORED' ELSE 'STRENGTHENED' END AS transition FROM s""")
def snapshot_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each subject's state at two cutoffs, and what happened between them; snapshot_changes has the whole of it."""
    cutoffs = {name: F.lit(at).cast("timestamp") for name, at in _AT.items()}
    states = assess.states_at(table(spark, sf_dir, "events"), "user_id", "ts", "event_type", cutoffs, "event_id")
    rungs = [("MISSING", F.col("after").isNull()), ("UNCHANGED", F.col("before") == F.col("after")), ("REVOKED", F.col("after") == "refund"), ("DENIED", F.col("after") == "error"), ("RESTORED", F.col("before").isin("refund", "error"))]
    return states.withColumn("transition", cmp.ladder(rungs, "STRENGTHENED"))


@query("SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS epoch, count(*) AS n, CASE WHEN count(*) < 2 THEN 'INSUFFICIENT' WHEN bool_or(event_type = 'error') THEN 'UNRESOLVED' WHEN count(DISTINCT event_type) = 1 THEN 'SAME' ELSE 'REBOUND' END AS status FROM events GROUP BY 1, 2")
def resolution_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a name resolves alike through a day; resolution_ladder has the whole of it."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("epoch")).agg(F.count("*").alias("n"), F.bool_or(F.col("event_type") == "error").alias("failed"), F.countDistinct("event_type").alias("kinds"))
    return rows.select("user_id", "epoch", "n", cmp.ladder([("INSUFFICIENT", F.col("n") < 2), ("UNRESOLVED", F.col("failed")), ("SAME", F.col("kinds") == 1)], "REBOUND").alias("status"))


_RANKS = """WITH w AS (SELECT role, unnest(string_split_regex(lower(text), '[^a-z]+')) AS token FROM conversations WHERE role IN ('user', 'assistant')),
c AS (SELECT role, token, count(*) AS n FROM w WHERE token <> '' GROUP BY 1, 2), r AS (SELECT role, token, row_number() OVER (PARTITION BY role ORDER BY n DESC, token)::INT AS rank FROM c),
a AS (SELECT rank, token FROM r WHERE role = 'user'), b AS (SELECT rank, token FROM r WHERE role = 'assistant')"""


@query(_RANKS + """SELECT coalesce(a.rank, b.rank) AS rank, a.token AS expected, b.token AS found, CASE WHEN a.rank IS NULL THEN 'EXTRA' WHEN b.rank IS NULL THEN 'MISSING' WHEN a.token = b.token THEN 'MATCH' WHEN a.token IN (SELECT token FROM b) THEN 'ORDER' ELSE 'OPERAND' END AS status FROM a FULL JOIN b ON a.rank = b.rank""")
def merge_order_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ordered tables, compared rank by rank; ranks are those of words by count."""
    words = table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')").select("role", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("token"))
    counts = words.where("token <> ''").groupBy("role", "token").agg(F.count("*").alias("n"))
    ranks = ranked(counts, ["role"], [F.desc("n"), F.col("token")], "rank").withColumn("rank", F.col("rank").cast("int"))
    return assess.ranked_tables(ranks.where("role = 'user'"), ranks.where("role = 'assistant'"), "rank", "token")


_SUCCESSORS = "SELECT s_suppkey AS src, s_suppkey * 2 % (SELECT count(*) FROM supplier) AS dst FROM supplier"


@query(f"WITH RECURSIVE e AS ({_SUCCESSORS}), w AS (SELECT src AS origin, dst AS node FROM e UNION SELECT w.origin, e.dst FROM w JOIN e ON e.src = w.node) SELECT DISTINCT node FROM w WHERE node IN (SELECT origin FROM w WHERE origin = node)")
def acyclic_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that no topological order can place: chains of successors that lead into rings."""
    suppliers = table(spark, sf_dir, "supplier")
    edges = suppliers.select(F.col("s_suppkey").alias("src"), (F.col("s_suppkey") * 2 % suppliers.agg(F.count("*")).scalar()).alias("dst"))
    return components.unplaceable(edges)


@query(f"""WITH RECURSIVE e AS ({_SUCCESSORS} UNION SELECT s_suppkey, s_suppkey - 3 FROM supplier WHERE s_suppkey % 11 = 5), w AS (SELECT src AS origin, dst AS node FROM e UNION SELECT w.origin, e.dst FROM w JOIN e ON e.src = w.node),
n AS (SELECT src AS node FROM e UNION SELECT dst FROM e) SELECT node, least(node, coalesce((SELECT min(x.node) FROM w x JOIN w y ON x.node = y.origin AND y.node = x.origin WHERE x.origin = n.node), node)) AS component, EXISTS (SELECT 1 FROM w WHERE origin = n.node AND w.node = n.node) AS ring FROM n""")
def dependency_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongly connected component of each node, by its least node, and whether it is a ring."""
    suppliers = table(spark, sf_dir, "supplier")
    forward = suppliers.select(F.col("s_suppkey").alias("src"), (F.col("s_suppkey") * 2 % suppliers.agg(F.count("*")).scalar()).alias("dst"))
    back = suppliers.where("s_suppkey % 11 = 5").select("s_suppkey", F.col("s_suppkey") - 3)
    found = written(components.components(forward.union(back)), "components")
    least = found.groupBy("component").agg(F.min("node").alias("least"))
    return found.join(least, "component").select("node", F.col("least").alias("component"), "ring")


_DELEGATIONS = "SELECT 's' || s_suppkey AS child, 'n' || s_nationkey AS parent, s_acctbal >= 0 AS valid FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, true FROM nation"


@query(f"""WITH d AS ({_DELEGATIONS}), good AS (SELECT x.child, y.parent, x.valid FROM d x JOIN d y ON x.parent = y.child WHERE y.parent IN ('r1', 'r2') AND x.child LIKE 's%')
SELECT 's' || s_suppkey AS node, CASE WHEN valid THEN 2 END::INT AS depth, CASE WHEN valid THEN good.parent END AS root, CASE WHEN valid THEN 'TRUSTED' WHEN good.child IS NOT NULL THEN 'OUT_OF_SCOPE' ELSE 'NO_ROOT' END AS status FROM supplier LEFT JOIN good ON good.child = 's' || s_suppkey""")
def trust_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest trusted root of each signer over delegations within their scope."""
    named = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    suppliers = table(spark, sf_dir, "supplier")
    own = suppliers.select(named("s", "s_suppkey").alias("child"), named("n", "s_nationkey").alias("parent"), (F.col("s_acctbal") >= 0).alias("valid"))
    upper = table(spark, sf_dir, "nation").select(named("n", "n_nationkey"), named("r", "n_regionkey"), F.lit(True))
    return graphs.trust_paths(own.union(upper), own.select(F.col("child").alias("node")), spark.createDataFrame([("r1",), ("r2",)], "node string"))


@query("""WITH a AS (SELECT l_orderkey, s_nationkey FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey)
SELECT o_orderkey, count(a.l_orderkey) AS n_approvals, count(*) FILTER (s_nationkey = c_nationkey) AS n_same,
CASE WHEN count(*) FILTER (s_nationkey = c_nationkey) > 0 THEN 'VIOLATED' WHEN bool_or(a.l_orderkey IS NOT NULL AND (s_nationkey IS NULL OR c_nationkey IS NULL)) THEN 'NOT_IDENTIFIED' WHEN count(a.l_orderkey) = 0 THEN 'NOT_EVALUATED' ELSE 'SATISFIED' END AS status
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN a ON a.l_orderkey = o_orderkey GROUP BY 1""")
def separation_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that a supplier of the customer's own nation approves; duty_separation has the whole of it."""
    requests = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_nationkey")
    approvals = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left").select(F.col("l_orderkey").alias("o_orderkey"), "s_nationkey")
    return assess.separation(requests, approvals, "o_orderkey", "c_nationkey", "s_nationkey")


@query("""SELECT coalesce(source, '') AS source, count(*) AS n, count(l.doc_id) AS n_evaluated, count(*) FILTER (toxic = 1) AS n_blocking,
CASE WHEN count(*) FILTER (toxic = 1) > 0 THEN 'DENIED' WHEN count(l.doc_id) < count(*) THEN 'ALLOWED_WITH_CONDITIONS' ELSE 'ALLOWED' END AS decision FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""")
def promotion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a source may be promoted: blockers deny, members without evidence set conditions."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("label_id"), "toxic")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source")).join(labels, F.col("doc_id") == F.col("label_id"), "left")
    counts = rows.groupBy("source").agg(F.count("*").alias("n"), F.count("label_id").alias("n_evaluated"), F.count_if(F.col("toxic") == 1).alias("n_blocking"))
    return counts.withColumn("decision", cmp.ladder([("DENIED", F.col("n_blocking") > 0), ("ALLOWED_WITH_CONDITIONS", F.col("n_evaluated") < F.col("n"))], "ALLOWED"))


@query("SELECT vec_id, label, round(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))), 4) AS peak, CASE WHEN round(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))), 4) <= coalesce(CASE vec_id WHEN 7 THEN 0.1 END, CASE label WHEN 0 THEN 0.3 WHEN 1 THEN 0.25 END, 0.35) THEN 'CONFORMS' ELSE 'DOES_NOT_CONFORM' END AS status FROM embeddings")
def quant_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds by vector, else by label, else the default; quant_requirements has the whole of it."""
    peak = F.round(F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double")))), 4)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", peak.alias("peak"))
    limits = [F.when(F.col("vec_id") == 7, 0.1), F.when(F.col("label") == 0, 0.3).when(F.col("label") == 1, 0.25), F.lit(0.35)]
    return rows.withColumn("status", F.when(assess.within(F.col("peak"), limits), "CONFORMS").otherwise("DOES_NOT_CONFORM"))


@query("""WITH a AS (SELECT conv_id, turn // 2 AS probe, sha256(string_agg(coalesce(text, ''), chr(10) ORDER BY coalesce(text, ''))) AS digest FROM conversations WHERE role = 'user' GROUP BY 1, 2),
b AS (SELECT conv_id, turn // 2 AS probe, sha256(string_agg(coalesce(text, ''), chr(10) ORDER BY coalesce(text, ''))) AS digest FROM conversations WHERE role = 'assistant' GROUP BY 1, 2)
SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.probe, b.probe) AS probe, CASE WHEN b.digest IS NULL THEN 'MISSING' WHEN a.digest IS NULL THEN 'UNEXPECTED' WHEN a.digest <> b.digest THEN 'OUTPUT_MISMATCH' ELSE '' END AS findings
FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.probe = b.probe""")
def probe_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results of two backends for the same probes; probe_findings and probe_status have the whole of it."""
    rows = table(spark, sf_dir, "conversations").select("role", F.struct("conv_id", F.floor(F.col("turn") / 2).alias("probe")).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    side = lambda role: rows.where(F.col("role") == role).groupBy("key").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("text")), "\n"), 256).alias("digest"))
    found = cmp.compare(side("user"), side("assistant"), "key", {"digest": "OUTPUT_MISMATCH"})
    return found.select("key.conv_id", "key.probe", F.array_join("findings", ",").alias("findings"))


@query("SELECT user_id, count(*) AS n, count(*) FILTER (NOT json_exists(props, '$.k')) AS n_absent, count(*) FILTER (json_exists(props, '$.k') AND json_extract_string(props, '$.k') IS NULL) AS n_null FROM events GROUP BY 1")
def field_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that are absent, as against fields that are null."""
    rows = table(spark, sf_dir, "events").select("user_id", values.presence(F.col("props"), "k").alias("p"))
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("p") == "ABSENT").alias("n_absent"), F.count_if(F.col("p") == "NULL").alias("n_null"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    return claims.file_stream(spark, path, spark.read.parquet(path).schema)


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each subject's kinds of claims, from a stream of the events."""
    return claims.drain(claims.first_claims(_events(spark, sf_dir), "user_id", "event_type"), graphs.fresh_folder(spark, "first-claims"))


@query("""WITH w AS (SELECT date_trunc('hour', ts) AS s, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT s::TIMESTAMP AS "start", (s + INTERVAL 1 HOUR)::TIMESTAMP AS "end", event_type, n FROM w WHERE s + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_window_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by hour of a stream, for the hours that have closed."""
    stream = _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = claims.drain(claims.window_census(stream, "ts", "event_type", "1 hour", "10 minutes"), graphs.fresh_folder(spark, "window-census"))
    return rows.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n")
