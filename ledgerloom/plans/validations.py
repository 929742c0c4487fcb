"""Queries that take the results of other queries together: stages of a validation, and whole policies."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators import stages, thresholds
from ledgerloom.operators.written import fresh_folder, written
from ledgerloom.plans import assessments, parity, structures
from ledgerloom.plans.catalogue import ORACLE_SQL, query, table
from ledgerloom.plans.drawn import drawn, drawn_sql
from ledgerloom.streaming import ledgers

_STAGES = ("TENSORS", "OVERLAPS", "NAMES", "METADATA", "TRUST", "PROFILE", "ACCEPTANCE", "RUNTIME", "RELEASE")
_NEEDS = (("OVERLAPS", "TENSORS"), ("NAMES", "TENSORS"), ("METADATA", "NAMES"), ("PROFILE", "OVERLAPS"), ("PROFILE", "METADATA"), ("PROFILE", "TRUST"), ("ACCEPTANCE", "PROFILE"), ("RUNTIME", "TRUST"), ("RELEASE", "ACCEPTANCE"), ("RELEASE", "RUNTIME"))
_RANKS = "['FAIL', 'UNAVAILABLE', 'NOT_CHECKED', 'WARN', 'PASS']"
_OWN = f"""sp AS ({ORACLE_SQL["shard_span_rollup"]}), du AS ({ORACLE_SQL["duplicate_tensors"]}), me AS ({ORACLE_SQL["split_metadata"]}), tr AS ({ORACLE_SQL["trust_path"]}),
own AS (SELECT shard AS s, 'TENSORS' AS stage, CASE result WHEN 'bounded' THEN 'PASS' WHEN 'unsupported' THEN 'WARN' WHEN 'invalid' THEN 'FAIL' ELSE 'UNAVAILABLE' END AS status FROM sp UNION ALL SELECT shard, 'OVERLAPS', CASE WHEN n_overlaps > 0 THEN 'FAIL' ELSE 'PASS' END FROM sp
UNION ALL SELECT scope, 'NAMES', CASE WHEN bool_or(kind = 'conflict') THEN 'WARN' ELSE 'PASS' END FROM du GROUP BY 1 UNION ALL SELECT split, 'METADATA', CASE WHEN bool_and(ok) THEN 'PASS' WHEN bool_and(ok) FILTER (rule <> 'PRIMARY_ONLY' AND key <> 'Z') THEN 'WARN' ELSE 'FAIL' END FROM me GROUP BY 1
UNION ALL SELECT substr(node, 2)::BIGINT, 'TRUST', CASE status WHEN 'TRUSTED' THEN 'PASS' WHEN 'OUT_OF_SCOPE' THEN 'WARN' ELSE 'UNAVAILABLE' END FROM tr UNION ALL SELECT s_suppkey, unnest(['PROFILE', 'ACCEPTANCE', 'RELEASE']), 'PASS' FROM supplier),
needs(stage, needs) AS (VALUES {", ".join(map(str, _NEEDS))}), cl AS (WITH RECURSIVE c AS (SELECT * FROM needs UNION SELECT c.stage, n.needs FROM c JOIN needs n ON n.stage = c.needs) SELECT * FROM c UNION SELECT stage, stage FROM (SELECT unnest({list(_STAGES)}) AS stage)),
r AS (SELECT s_suppkey AS s, cl.stage, cl.needs, list_position({_RANKS}, coalesce(status, 'NOT_CHECKED')) AS k FROM supplier CROSS JOIN cl LEFT JOIN own ON own.s = s_suppkey AND own.stage = cl.needs),
b AS (SELECT s AS s_suppkey, stage, {_RANKS}[max(k) FILTER (stage = needs)] AS own, {_RANKS}[min(k)] AS status, CASE WHEN min(k) < max(k) FILTER (stage = needs) THEN arg_min(needs, k::VARCHAR || needs) END AS held_by FROM r GROUP BY 1, 2)"""


def _stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of every supplier as a shard, by what the queries on spans, names, metadata and trust found."""
    spans = written(structures.shard_span_rollup(spark, sf_dir), "spans")
    said = lambda rows, key, stage, status: rows.select(key.cast("long").alias("s_suppkey"), F.lit(stage).alias("stage"), status.alias("status"))
    tensors = F.when(F.col("result") == "bounded", "PASS").when(F.col("result") == "unsupported", "WARN").when(F.col("result") == "invalid", "FAIL").otherwise("UNAVAILABLE")
    names = structures.duplicate_tensors(spark, sf_dir).groupBy("scope").agg(F.bool_or(F.col("kind") == "conflict").alias("bad"))
    metadata = structures.split_metadata(spark, sf_dir).groupBy("split").agg(F.bool_and("ok").alias("all"), F.bool_and(F.when((F.col("rule") != "PRIMARY_ONLY") & (F.col("key") != "Z"), F.col("ok"))).alias("most"))
    trust = assessments.trust_path(spark, sf_dir)
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey")
    own = [
        said(spans, F.col("shard"), "TENSORS", tensors), said(spans, F.col("shard"), "OVERLAPS", F.when(F.col("n_overlaps") > 0, "FAIL").otherwise("PASS")), said(names, F.col("scope"), "NAMES", F.when(F.col("bad"), "WARN").otherwise("PASS")),
        said(metadata, F.col("split"), "METADATA", F.when(F.col("all"), "PASS").when(F.col("most"), "WARN").otherwise("FAIL")), said(trust, F.substring("node", 2, 20), "TRUST", F.when(F.col("status") == "TRUSTED", "PASS").when(F.col("status") == "OUT_OF_SCOPE", "WARN").otherwise("UNAVAILABLE")),
        *(said(suppliers, F.col("s_suppkey"), stage, F.lit("PASS")) for stage in ("PROFILE", "ACCEPTANCE", "RELEASE")),
    ]
    every = own[0]
    for part in own[1:]:
        every = every.unionByName(part)
    needs = spark.createDataFrame(list(_NEEDS), "stage string, needs string")
    return stages.bounded(every, needs, suppliers, spark.createDataFrame([(s,) for s in _STAGES], "stage string"), "s_suppkey")


@query(f"WITH {_OWN} SELECT s_suppkey, stage, own, status, held_by FROM b")
def validation_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage of each supplier, bounded by the stages it depends on, and the stage that holds it."""
    return _stages(spark, sf_dir)


@query(f"WITH {_OWN} SELECT s_suppkey, count(*) FILTER (status = 'PASS') AS n_pass, count(held_by) AS n_held, arg_min(stage, list_position({_RANKS}, status)::VARCHAR || stage) AS weakest, max(status) FILTER (stage = 'RELEASE') AS overall FROM b GROUP BY 1")
def trust_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each supplier's validation came."""
    return stages.summaries(_stages(spark, sf_dir), "s_suppkey", "RELEASE")


#: Kind, level, key, sense, bound, allowed texts, required.
_LIMITS = (
    ("maximum_absolute_error", "default", None, "max", 0.35, None, True), ("maximum_absolute_error", "label", "0", "max", 0.3, None, True), ("maximum_absolute_error", "label", "1", "max", 0.25, None, True), ("maximum_absolute_error", "family", "3", "max", 0.4, None, True), ("maximum_absolute_error", "tensor", "7", "max", 0.1, None, True),
    ("mean_absolute_error", "default", None, "max", 0.12, None, True), ("mean_absolute_error", "family", "5", "max", 0.02, None, True), ("mean_squared_error", "default", None, "max", 0.03, None, True), ("root_mean_squared_error", "default", None, "max", 0.15, None, True), ("root_mean_squared_error", "label", "2", "max", 0.1, None, True),
    ("relative_l2", "default", None, "max", 1.2, None, True), ("relative_l2", "tensor", "21", "max", 0.5, None, True), ("error_l2", "default", None, "max", 1.5, None, True), ("source_l2", "default", None, "min", 0.5, None, True), ("bias", "default", None, "max", 0.02, None, True), ("bias", "label", "4", "max", 0.0, None, True),
    ("cosine", "default", None, "min", 0.2, None, True), ("cosine", "label", "3", "min", 0.5, None, True), ("cosine", "family", "2", "min", 0.1, None, True), ("exact_share", "family", "4", "min", 0.5, None, True), ("elements", "default", None, "min", 1.0, None, True), ("elements", "label", "6", "min", 65.0, None, True),
    ("relative_state", "default", None, "in", None, ["AVAILABLE", "EXACT"], True), ("cosine_state", "default", None, "in", None, ["AVAILABLE"], True), ("cosine_state", "family", "1", "in", None, ["AVAILABLE", "EXACT"], True), ("sampling_gap", "label", "5", "max", 0.1, None, False), ("payload_identity", "label", "8", "in", None, ["EXACT"], True),
)
_OBSERVED = {
    "maximum_absolute_error": "max_error", "mean_absolute_error": "mean_error", "mean_squared_error": "mse", "root_mean_squared_error": "rmse", "relative_l2": "relative_l2", "error_l2": "error_l2", "source_l2": "source_l2", "bias": "abs(bias)", "cosine": "cosine", "exact_share": "n_exact / n", "elements": "n",
}
_SQL_LIST = lambda v: "NULL" if v is None else str(v) if isinstance(v, list) else f"'{v}'" if isinstance(v, str) else str(v).lower()
_POLICY = f"""q AS ({ORACLE_SQL["quant_fidelity"]}), e AS (SELECT q.*, label, q.vec_id % 9 AS family FROM q JOIN embeddings USING (vec_id)), l(kind, level, key, sense, bound, allowed, required) AS (VALUES {", ".join("(" + ", ".join(map(_SQL_LIST, r)) + ")" for r in _LIMITS)}),
f AS (SELECT vec_id, label, kind, level, sense, bound, allowed, required FROM e JOIN l ON CASE level WHEN 'default' THEN true WHEN 'label' THEN key = label::VARCHAR WHEN 'family' THEN key = family::VARCHAR ELSE key = vec_id::VARCHAR END QUALIFY row_number() OVER (PARTITION BY vec_id, kind ORDER BY list_position(['tensor', 'family', 'label', 'default'], level)) = 1),
o AS ({" UNION ALL ".join(f"SELECT vec_id, '{kind}' AS kind, ({x})::DOUBLE AS value, NULL AS text FROM e" for kind, x in _OBSERVED.items())} UNION ALL SELECT vec_id, 'relative_state', NULL, relative_state FROM e UNION ALL SELECT vec_id, 'cosine_state', NULL, cosine_state FROM e),
x AS (SELECT f.vec_id, label, f.kind, level, CASE WHEN (CASE WHEN sense = 'in' THEN text IS NULL ELSE value IS NULL END) THEN CASE WHEN required THEN 'NOT_EVALUATED' ELSE 'NOT_APPLICABLE' END WHEN CASE sense WHEN 'max' THEN value <= bound WHEN 'min' THEN value >= bound ELSE list_contains(allowed, text) END THEN 'SATISFIED' ELSE 'FAILED' END AS outcome FROM f LEFT JOIN o ON o.vec_id = f.vec_id AND o.kind = f.kind)"""


def _policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    measured = written(parity.quant_fidelity(spark, sf_dir).join(labels, "vec_id"), "measured")
    rules = spark.createDataFrame(list(_LIMITS), thresholds.RULES)
    levels = [("tensor", F.col("vec_id")), ("family", F.col("vec_id") % 9), ("label", F.col("label")), ("default", None)]
    numbers = [F.struct(F.lit(kind).alias("kind"), F.expr(x).cast("double").alias("value"), F.lit(None).cast("string").alias("text")) for kind, x in _OBSERVED.items()]
    texts = [F.struct(F.lit(c).alias("kind"), F.lit(None).cast("double").alias("value"), F.col(c).alias("text")) for c in ("relative_state", "cosine_state")]
    observed = measured.select("vec_id", F.explode(F.array(*numbers, *texts)).alias("x")).select("vec_id", "x.*")
    return thresholds.outcomes(thresholds.effective(measured, "vec_id", rules, levels), observed, "vec_id")


@query(f"WITH {_POLICY} SELECT vec_id, kind, level, outcome FROM x")
def fidelity_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every requirement of a policy for every vector, by the most specific of its thresholds."""
    return _policy(spark, sf_dir).drop("observed")


@query(f"WITH {_POLICY} SELECT vec_id, count(*) FILTER (outcome = 'SATISFIED') AS n_satisfied, count(*) FILTER (outcome = 'FAILED') AS n_failed, count(*) FILTER (outcome = 'NOT_EVALUATED') AS n_open, count(*) FILTER (outcome = 'NOT_APPLICABLE') AS n_not_applicable, CASE WHEN count(*) FILTER (outcome = 'FAILED') > 0 THEN 'DOES_NOT_CONFORM' WHEN count(*) FILTER (outcome = 'NOT_EVALUATED') > 0 THEN 'INDETERMINATE' ELSE 'CONFORMS' END AS status FROM x GROUP BY 1")
def fidelity_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each vector conforms to the whole policy."""
    return thresholds.conformance(_policy(spark, sf_dir), "vec_id")


_ENTRIES = f"""e AS (SELECT user_id::VARCHAR AS chain, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type || ':' || event_id AS entry, event_id FROM events),
k AS (SELECT chain, seq, entry FROM e WHERE {drawn_sql("event_id", "lost", 60)} > 0)"""


@query(f"""WITH RECURSIVE {_ENTRIES}, a AS (SELECT chain, seq, sha256('|' || entry) AS head FROM k WHERE seq = 1 UNION ALL SELECT k.chain, k.seq, sha256(a.head || '|' || entry) FROM a JOIN k ON k.chain = a.chain AND k.seq = a.seq + 1)
SELECT chain, seq, 'APPENDED' AS outcome, head FROM a""")
def stream_ledger_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledgers of users' events that come in two parts and out of order; a ledger ends at its first lost entry."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("seq", F.row_number().over(order).cast("long")).where(drawn(F.col("event_id"), "lost", 60) > 0)
    entries = rows.select(F.col("user_id").cast("string").alias("chain"), "seq", F.concat_ws(":", "event_type", "event_id").alias("entry"), (drawn(F.col("event_id"), "late", 3) == 0).alias("late"))
    source, folder = fresh_folder(spark, "ledger-entries"), fresh_folder(spark, "ledger-appends")
    for late in (True, False):  # the second run starts from what the first one left
        entries.where(F.col("late") == late).drop("late").write.mode("append").parquet(source)
        found = ledgers.drained(spark, source, "chain string, seq long, entry string", folder)
    return found
