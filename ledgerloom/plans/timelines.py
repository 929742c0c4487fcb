"""Queries over histories: each user's events are a timeline; what the tables lack is drawn from digests of keys."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators import timelines
from ledgerloom.plans.catalogue import query, table
from ledgerloom.plans.drawn import drawn, drawn_sql, one_of, one_of_sql

_HISTORY = f"""h AS (SELECT user_id, event_id, day(ts)::INT AS epoch, hour(ts)::INT AS seq, sha256(event_type) AS digest, CASE WHEN event_id % 3 > 0 AND {drawn_sql("user_id", "linked", 3)} > 0 THEN event_id - 1 - {drawn_sql("event_id", "back", 2)} * 150 END AS pred
FROM events WHERE {drawn_sql("user_id", "clean", 3)} > 0 OR {drawn_sql("event_id", "thin", 40)} = 0)"""


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, event_id, epoch, seq, digest, pred); a third of the users has few events."""
    rows = table(spark, sf_dir, "events").where((drawn(F.col("user_id"), "clean", 3) > 0) | (drawn(F.col("event_id"), "thin", 40) == 0))
    pred = F.when((F.col("event_id") % 3 > 0) & (drawn(F.col("user_id"), "linked", 3) > 0), F.col("event_id") - 1 - drawn(F.col("event_id"), "back", 2) * 150)
    return rows.select("user_id", "event_id", F.dayofmonth("ts").alias("epoch"), F.hour("ts").alias("seq"), F.sha2("event_type", 256).alias("digest"), pred.alias("pred"))


_FORKS = f"""{_HISTORY}, f AS (SELECT user_id, 'CONFLICT_DETECTED' AS outcome, concat_ws('/', epoch, seq) AS at, count(DISTINCT event_id) AS n_events FROM h GROUP BY user_id, epoch, seq HAVING count(DISTINCT digest) > 1
UNION ALL SELECT user_id, 'FORK_DETECTED', pred::VARCHAR, count(DISTINCT event_id) FROM h WHERE pred IS NOT NULL GROUP BY user_id, pred HAVING count(DISTINCT event_id) > 1)"""


@query(f"WITH {_FORKS} SELECT * FROM f")
def timeline_fork_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both kinds of forks: several contents at one place, several successors of one event."""
    return timelines.forks(_history(spark, sf_dir), ["user_id"], ["epoch", "seq"], "event_id", "pred", "digest")


_RANGES = f"r AS (SELECT DISTINCT user_id, CASE WHEN {drawn_sql('user_id', 'empty', 2)} = 0 THEN 30 ELSE {drawn_sql('user_id', 'from', 4)} END AS a, 20 + {drawn_sql('user_id', 'to', 5)} AS b FROM events)"


@query(f"""WITH {_FORKS}, {_RANGES}, want AS (SELECT user_id, unnest(generate_series(a, b)) AS seq FROM r),
m AS (SELECT user_id, count(*) AS n FROM want WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.user_id = want.user_id AND h.seq = want.seq) GROUP BY 1)
SELECT r.user_id, (SELECT count(*) FROM h WHERE h.user_id = r.user_id) AS n_events, (SELECT count(*) FROM f WHERE f.user_id = r.user_id) AS n_forks, coalesce(m.n, 0) AS n_missing,
CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.user_id = r.user_id) THEN 'FORKED' WHEN m.n > 0 THEN 'MISSING_PREDECESSOR' ELSE 'COMPLETE_FOR_DECLARED_RANGE' END AS completeness FROM r LEFT JOIN m USING (user_id)""")
def timeline_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forked, with gaps in its declared range, or complete."""
    rows, key = _history(spark, sf_dir), F.col("user_id")
    ranges = table(spark, sf_dir, "events").select("user_id").distinct().select("user_id", F.when(drawn(key, "empty", 2) == 0, 30).otherwise(drawn(key, "from", 4)).alias("start"), (drawn(key, "to", 5) + 20).alias("end"))
    return timelines.timelines(rows, ranges, timelines.forks(rows, ["user_id"], ["epoch", "seq"], "event_id", "pred", "digest"), "user_id", "seq")


@query("""WITH o AS (SELECT user_id AS observer, event_type AS namespace, day(ts)::INT AS epoch, (hour(ts) // 6)::INT AS seq, event_id AS obs, CASE WHEN event_id % 2 = 0 THEN event_id // 900 END AS pred FROM events)
SELECT observer, namespace, epoch, 'CONFLICT_DETECTED' AS outcome, seq::VARCHAR AS at, count(DISTINCT obs) AS n_events FROM o GROUP BY observer, namespace, epoch, seq HAVING count(DISTINCT obs) > 1
UNION ALL SELECT observer, namespace, epoch, 'FORK_DETECTED', pred::VARCHAR, count(DISTINCT obs) FROM o WHERE pred IS NOT NULL GROUP BY observer, namespace, epoch, pred HAVING count(DISTINCT obs) > 1""")
def observation_forks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forks of observers' chains, of which each is one namespace and epoch."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("observer"), F.col("event_type").alias("namespace"), F.dayofmonth("ts").alias("epoch"), F.floor(F.hour("ts") / 6).cast("int").alias("seq"), F.col("event_id").alias("obs"), F.when(F.col("event_id") % 2 == 0, F.floor(F.col("event_id") / 900)).alias("pred"))
    return timelines.forks(rows, ["observer", "namespace", "epoch"], ["seq"], "obs", "pred")


_CUTOFF = "2024-01-03T00:00:00Z"


@query(f"""WITH t AS (SELECT event_id, CASE {drawn_sql("event_id", "when", 12)} WHEN 0 THEN 'NOT_RECORDED' WHEN 1 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS available,
CASE {drawn_sql("event_id", "effect", 12)} WHEN 0 THEN 'NOT_RECORDED' ELSE strftime(ts + to_days({drawn_sql("event_id", "later", 3)}), '%Y-%m-%dT%H:%M:%SZ') END AS effective FROM events)
SELECT event_id, CASE WHEN available = 'NOT_RECORDED' THEN 'AVAILABILITY_NOT_RECORDED' WHEN effective = 'NOT_RECORDED' OR len(available) <> 20 OR len(effective) <> 20 THEN 'INVALID' WHEN available > '{_CUTOFF}' THEN 'NOT_KNOWN_AS_OF_CUTOFF'
WHEN effective > '{_CUTOFF}' THEN 'KNOWN_FUTURE_EFFECTIVE_AS_OF_CUTOFF' ELSE 'KNOWN_EFFECTIVE_AS_OF_CUTOFF' END AS state FROM t""")
def knowledge_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was known of each event at a cutoff, and whether it had taken effect."""
    key, form = F.col("event_id"), "yyyy-MM-dd'T'HH:mm:ss'Z'"
    available = F.when(drawn(key, "when", 12) == 0, "NOT_RECORDED").when(drawn(key, "when", 12) == 1, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", form))
    effective = F.when(drawn(key, "effect", 12) == 0, "NOT_RECORDED").otherwise(F.date_format(F.col("ts") + F.make_interval(days=drawn(key, "later", 3)), form))
    return table(spark, sf_dir, "events").select("event_id", timelines.knowledge(available, effective, _CUTOFF).alias("state"))


_RECEIPTS = f"""x AS (SELECT user_id, day(ts)::INT AS epoch, user_id * 100 + day(ts) AS name, user_id * 100 + day(ts) + CASE WHEN {drawn_sql("event_id", "asked", 50)} = 0 THEN 1 ELSE 0 END AS requested,
CASE WHEN {drawn_sql("event_id", "hidden", 40)} > 0 THEN CASE WHEN user_id % 3 = 0 THEN 'fixed' ELSE event_type END END AS resolved, CASE WHEN {drawn_sql("event_id", "method", 60)} = 0 THEN 'b' ELSE 'a' END AS method, event_type = 'signup' AND user_id % 2 = 0 AS redirected
FROM events WHERE {drawn_sql("event_id", "kept", 3)} = 0)"""


@query(f"""WITH {_RECEIPTS} SELECT name, count(*) AS n, CASE WHEN count(*) < 2 THEN 'INSUFFICIENT_OBSERVATIONS' WHEN count(*) FILTER (requested <> name) > 0 THEN 'REQUESTED_IDENTIFIER_CHANGED' WHEN count(resolved) < count(*) THEN 'RESOLVED_IDENTITY_NOT_DISCLOSED'
WHEN min(method) <> max(method) THEN 'OBSERVATION_WINDOWS_NOT_COMPARABLE' WHEN min(resolved) = max(resolved) THEN 'SAME_RESOLVED_IDENTITY_FOR_SUPPLIED_OBSERVATIONS' WHEN max(redirected) THEN 'REDIRECT_TARGET_CHANGED_FOR_SUPPLIED_OBSERVATIONS'
ELSE 'ALIAS_REBOUND_FOR_SUPPLIED_OBSERVATIONS' END AS status FROM x GROUP BY 1""")
def resolution_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven rungs of how a name resolved in the receipts of a day."""
    key, name = F.col("event_id"), F.col("user_id") * 100 + F.dayofmonth("ts")
    rows = table(spark, sf_dir, "events").where(drawn(key, "kept", 3) == 0).select(
        name.alias("name"), (name + F.when(drawn(key, "asked", 50) == 0, 1).otherwise(0)).alias("requested"),
        F.when(drawn(key, "hidden", 40) > 0, F.when(F.col("user_id") % 3 == 0, "fixed").otherwise(F.col("event_type"))).alias("resolved"),
        F.when(drawn(key, "method", 60) == 0, "b").otherwise("a").alias("method"), ((F.col("event_type") == "signup") & (F.col("user_id") % 2 == 0)).alias("redirected"),
    )
    return timelines.resolutions(rows, "name", "requested", "resolved", ["method"], "redirected")


_ROLES = ("ARTIFACT_IDENTITY", "ARTIFACT_SET", "ATTESTATION", "CUSTODY", "TRUST", "AUTHORITY", "SECURITY", "GOVERNANCE", "APPROVAL", "DEPLOYMENT", "RUNTIME", "CONTINUITY")
_OVER = ("FRESHNESS", "REVOCATION", "PAYLOAD_INTEGRITY", "EXTERNAL_REVIEW")
_OVER_STATES = ("SATISFIED", "BROKEN", "REVOKED", "DENIED", "WITHDRAWN", "STALE", "UNKNOWN", "SATISFIED")
_AT = {"early": "2024-01-10 00:00:00", "late": "2024-01-25 00:00:00"}


def _states_sql(name: str) -> str:
    """Common table expressions that end in ``name`` (user_id, dimension, state), the states of all dimensions at a cutoff, from a table of roles."""
    mapped = ", ".join(f"('{d}', '{r}', '{a}', '{b}')" for d, r, a, b in timelines.DIMENSIONS)
    plain = ", ".join(f"('{d}')" for d in timelines.UNCHECKED)
    return f"""{name}_e AS (SELECT * FROM events WHERE ts <= TIMESTAMP '{_AT[name]}'),
{name}_r AS (SELECT DISTINCT user_id, {one_of_sql("event_id", "role", *_ROLES)} AS role FROM {name}_e),
{name}_o AS (SELECT user_id, {one_of_sql("event_id", "over", *_OVER)} AS dimension, arg_max({one_of_sql("event_id", "state", *_OVER_STATES)}, (ts, event_id)) AS state FROM {name}_e WHERE {drawn_sql("event_id", "overrides", 90)} = 0 GROUP BY 1, 2),
{name}_u AS (SELECT DISTINCT user_id FROM events),
{name}_b AS (SELECT user_id, d.dimension, CASE WHEN EXISTS (SELECT 1 FROM {name}_r r WHERE r.user_id = u.user_id AND r.role = d.role) THEN d.yes ELSE d.no END AS state FROM {name}_u u, (VALUES {mapped}) d(dimension, role, yes, no)
 UNION ALL SELECT user_id, d, 'NOT_CHECKED' FROM {name}_u, (VALUES {plain}) p(d) UNION ALL SELECT user_id, 'FRESHNESS', 'SATISFIED' FROM {name}_u UNION ALL SELECT user_id, 'REVOCATION', CASE WHEN user_id % 2 = 0 THEN 'SATISFIED' ELSE 'NOT_EVALUATED' END FROM {name}_u),
{name} AS (SELECT b.user_id, b.dimension, coalesce(o.state, b.state) AS state FROM {name}_b b LEFT JOIN {name}_o o USING (user_id, dimension) UNION ALL SELECT user_id, dimension, state FROM {name}_o o WHERE dimension = 'EXTERNAL_REVIEW')"""


def _states(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    events, key = table(spark, sf_dir, "events"), F.col("event_id")
    seen = events.where(F.col("ts") <= F.lit(_AT[name]).cast("timestamp"))
    evidence = seen.select("user_id", one_of(key, "role", *_ROLES).alias("role"))
    over = seen.where(drawn(key, "overrides", 90) == 0).groupBy("user_id", one_of(key, "over", *_OVER).alias("dimension")).agg(F.max_by(one_of(key, "state", *_OVER_STATES), F.struct("ts", "event_id")).alias("state"))
    subjects = events.select("user_id").distinct().withColumn("no_revocations", F.col("user_id") % 2 == 0)
    return timelines.dimension_states(evidence, subjects, over, "user_id")


@query(f"WITH {_states_sql('late')} SELECT user_id, dimension, state FROM late")
def snapshot_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each subject's state by dimension, from roles of evidence known at a cutoff, and overrides."""
    return _states(spark, sf_dir, "late")


def _overall_sql(source: str) -> str:
    has = lambda *names: "count(*) FILTER (state IN (" + ", ".join(f"'{n}'" for n in names) + ")) > 0"
    return f"""SELECT user_id, count(*) FILTER (state IN ('MISSING', 'UNAVAILABLE', 'NOT_CHECKED', 'NOT_EVALUATED', 'STALE', 'REVOKED', 'WITHDRAWN', 'BROKEN')) AS n_gaps, CASE WHEN {has("BROKEN")} THEN 'BROKEN' WHEN {has("REVOKED")} THEN 'REVOKED'
WHEN {has("DENIED", "WITHDRAWN")} THEN 'DENIED' WHEN {has("STALE")} THEN 'STALE' WHEN {has("MISSING", "UNKNOWN")} THEN 'REVIEW_REQUIRED' WHEN {has("SATISFIED_WITH_LIMITATIONS", "PARTIAL", "NOT_CHECKED", "NOT_EVALUATED")} THEN 'TRUSTED_WITH_LIMITATIONS'
ELSE 'TRUSTED_FOR_SCOPED_USE' END AS overall FROM {source} GROUP BY 1"""


@query(f"WITH {_states_sql('late')} {_overall_sql('late')}")
def snapshot_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps and overall state of each subject's snapshot."""
    return timelines.snapshots(_states(spark, sf_dir, "late"), "user_id")


@query(f"""WITH {_states_sql('early')}, {_states_sql('late')}, so AS ({_overall_sql('early')}), sn AS ({_overall_sql('late')}),
c AS (SELECT e.user_id, e.state IS DISTINCT FROM l.state AS changed, l.state AS now FROM early e LEFT JOIN late l USING (user_id, dimension)),
s AS (SELECT user_id, count(*) FILTER (changed) AS n_changed, count(*) FILTER (NOT changed) AS n_unchanged, count(*) FILTER (changed AND now = 'REVOKED') AS r, count(*) FILTER (changed AND now = 'WITHDRAWN') AS w, count(*) FILTER (changed AND now = 'STALE') AS t FROM c GROUP BY 1)
SELECT s.user_id, n_changed, n_unchanged, CASE WHEN s.user_id % 13 = 0 THEN 'POLICY_RECLASSIFIED' WHEN n_changed = 0 THEN 'UNCHANGED' WHEN r > 0 THEN 'REVOKED' WHEN w > 0 THEN 'WITHDRAWN' WHEN t > 0 THEN 'STALE'
WHEN so.overall IN ('DENIED', 'STALE', 'REVOKED') AND sn.overall IN ('TRUSTED_WITH_LIMITATIONS', 'TRUSTED_FOR_SCOPED_USE') THEN 'RESTORED_WITH_NEW_EVIDENCE' WHEN sn.overall = 'DENIED' THEN 'DENIED' WHEN sn.overall = 'REVIEW_REQUIRED' THEN 'LIMITED' ELSE 'STRENGTHENED' END AS outcome
FROM s JOIN so USING (user_id) JOIN sn USING (user_id)""")
def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What happened to each subject between two snapshots."""
    policies = table(spark, sf_dir, "events").select("user_id").distinct().withColumn("changed_policy", F.col("user_id") % 13 == 0)
    return timelines.transitions(_states(spark, sf_dir, "early"), _states(spark, sf_dir, "late"), policies, "user_id")


def _shifted(days: Column, when: Column) -> Column:
    return F.when(when, F.col("o_orderdate") + F.make_interval(days=days))


_WINDOWS = f"""w AS (SELECT o_custkey, CASE WHEN {drawn_sql("o_orderkey", "opens", 4)} > 0 THEN o_orderdate + to_days({drawn_sql("o_orderkey", "from", 90)}) END AS a, CASE WHEN {drawn_sql("o_orderkey", "ends", 4)} > 0 THEN o_orderdate + to_days(2000 + {drawn_sql("o_orderkey", "to", 2000)}) END AS b,
CASE WHEN o_custkey % 11 > 0 THEN TIMESTAMP '1998-01-01 00:00:00' END AS now FROM orders WHERE o_custkey % 7 = 0 OR {drawn_sql("o_orderkey", "few", 10)} = 0)"""


@query(f"""WITH {_WINDOWS}, s AS (SELECT o_custkey, CASE WHEN now IS NULL THEN 'NOT_EVALUATED' WHEN now < a THEN 'NOT_YET_VALID' WHEN now > b THEN 'EXPIRED' ELSE 'VALID' END AS s FROM w),
g AS (SELECT o_custkey, list(s) AS l FROM s GROUP BY 1)
SELECT c_custkey, coalesce(len(l), 0) AS n_windows, CASE WHEN l IS NULL THEN 'UNAVAILABLE' WHEN list_contains(l, 'EXPIRED') THEN 'EXPIRED' WHEN list_contains(l, 'NOT_YET_VALID') THEN 'NOT_YET_VALID' WHEN list_contains(l, 'NOT_EVALUATED') THEN 'NOT_EVALUATED' ELSE 'VALID' END AS status FROM customer LEFT JOIN g ON o_custkey = c_custkey""")
def expiration_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several validity windows of one object, the worst first."""
    key = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").where((F.col("o_custkey") % 7 == 0) | (drawn(key, "few", 10) == 0))
    now = F.when(F.col("o_custkey") % 11 > 0, F.lit("1998-01-01 00:00:00").cast("timestamp"))
    state = timelines.expiration(_shifted(drawn(key, "from", 90), drawn(key, "opens", 4) > 0), _shifted(drawn(key, "to", 2000) + 2000, drawn(key, "ends", 4) > 0), now)
    own = orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.collect_set(state).alias("states"))
    both = table(spark, sf_dir, "customer").join(own, F.col("o_custkey") == F.col("c_custkey"), "left")
    return both.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_windows"), timelines.combined_expiration(F.coalesce("states", F.array().cast("array<string>"))).alias("status"))


_REASONS = ("KEY_COMPROMISE", "SUPERSEDED", "WITHDRAWN", "KEY_COMPROMISE")


@query(f"""WITH r AS (SELECT s_nationkey AS target, {one_of_sql("s_suppkey", "reason", *_REASONS)} AS reason, CASE WHEN {drawn_sql("s_suppkey", "timed", 2)} = 0 THEN TIMESTAMP '2024-01-01 00:00:00' + to_days({drawn_sql("s_suppkey", "day", 60)}) END AS since, s_suppkey % 5 > 0 AS accepted FROM supplier WHERE {drawn_sql("s_suppkey", "revoked", 4)} = 0),
s AS (SELECT *, CASE WHEN since IS NULL THEN 'NOW' WHEN target % 6 = 0 THEN 'UNKNOWN' WHEN since > TIMESTAMP '2024-02-01 00:00:00' THEN 'LATER' ELSE 'NOW' END AS state FROM r WHERE accepted)
SELECT n_nationkey, count(state) FILTER (state <> 'LATER') AS n_applicable, CASE WHEN count(state) FILTER (state <> 'LATER') = 0 THEN 'NOT_REVOKED' WHEN bool_or(state = 'UNKNOWN') THEN 'NOT_EVALUATED' WHEN bool_or(state <> 'LATER' AND reason = 'SUPERSEDED') THEN 'SUPERSEDED'
WHEN bool_or(state <> 'LATER' AND reason = 'WITHDRAWN') THEN 'WITHDRAWN' ELSE 'REVOKED' END AS status FROM nation LEFT JOIN s ON target = n_nationkey GROUP BY 1""")
def revocation_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each target is revoked at a time, and for which reason."""
    key, nation = F.col("s_suppkey"), F.col("n_nationkey")
    at = F.when(drawn(key, "timed", 2) == 0, F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(days=drawn(key, "day", 60)))
    records = table(spark, sf_dir, "supplier").where(drawn(key, "revoked", 4) == 0).select(F.col("s_nationkey").alias("n_nationkey"), one_of(key, "reason", *_REASONS).alias("reason"), at.alias("effective_at"), (key % 5 > 0).alias("accepted"))
    now = F.when(nation % 6 > 0, F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return timelines.revocations(records, table(spark, sf_dir, "nation").select("n_nationkey"), ["n_nationkey"], now, F.col("accepted"))


_RENEWALS = f"""k AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events),
x AS (SELECT user_id, event_id, user_id || ':' || CASE WHEN user_id % 5 = 0 AND k = 2 THEN 1 ELSE k END AS prev, user_id || ':' || CASE WHEN user_id % 4 = 0 AND k = n THEN 1 ELSE k + 1 END AS next FROM k)"""


@query(f"""WITH RECURSIVE {_RENEWALS}, b AS (SELECT user_id, count(*) AS n, count(DISTINCT prev) < count(*) AS branching FROM x GROUP BY 1),
w AS (SELECT user_id, prev AS origin, next AS node FROM x JOIN b USING (user_id) WHERE NOT branching UNION SELECT w.user_id, w.origin, x.next FROM w JOIN x ON x.prev = w.node)
SELECT user_id, n, CASE WHEN branching THEN 'BRANCHING' WHEN EXISTS (SELECT 1 FROM w WHERE w.user_id = b.user_id AND w.node = w.origin) THEN 'CYCLE' ELSE 'VALID' END AS status FROM b""")
def renewal_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renewals of observations: chains that branch, run in rings, or are valid."""
    own = Window.partitionBy("user_id")
    rows = table(spark, sf_dir, "events").withColumn("k", F.row_number().over(own.orderBy("ts", "event_id"))).withColumn("n", F.count("*").over(own))
    named = lambda k: F.concat_ws(":", "user_id", k)
    previous = F.when((F.col("user_id") % 5 == 0) & (F.col("k") == 2), 1).otherwise(F.col("k"))
    after = F.when((F.col("user_id") % 4 == 0) & (F.col("k") == F.col("n")), 1).otherwise(F.col("k") + 1)
    return timelines.renewals(rows.select("user_id", F.col("event_id").alias("renewal_id"), named(previous).alias("previous"), named(after).alias("new")), "user_id")


_REQUIRED = ("snapshot", "timeline", "policy-set")


@query(f"""WITH m AS (SELECT user_id, list(DISTINCT {one_of_sql("user_id || coalesce(event_type, '')", "schema", "snapshot", "timeline", "policy-set", "other")}) AS l FROM events GROUP BY 1)
SELECT user_id, len(l) AS n_schemas, CASE WHEN user_id % 17 = 0 THEN 'FORKED_HISTORY' WHEN user_id % 11 = 0 THEN 'PARTIAL' WHEN NOT (list_contains(l, 'snapshot') AND list_contains(l, 'timeline') AND list_contains(l, 'policy-set')) THEN 'MISSING_REQUIRED_MEMBER'
WHEN user_id % 7 = 0 THEN 'PARTIAL' WHEN user_id % 3 = 0 THEN 'COMPLETE_WITH_LIMITATIONS' ELSE 'COMPLETE_FOR_PURPOSE' END AS state FROM m""")
def bundle_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each subject's bundle has the members that its purpose needs."""
    user = F.col("user_id")
    key = F.concat(user.cast("string"), F.coalesce("event_type", F.lit("")))
    members = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(one_of(key, "schema", *_REQUIRED, "other")).alias("schemas"))
    state = timelines.bundle_state(F.col("schemas"), user % 17 == 0, user % 11 == 0, user % 7 == 0, user % 3 == 0, _REQUIRED)
    return members.select("user_id", F.size("schemas").cast("long").alias("n_schemas"), state.alias("state"))


_CUSTODY = f"""c AS (SELECT user_id, row_number() OVER w AS k, event_type = 'purchase' AS transforms, count(*) FILTER (event_type = 'purchase') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v, {drawn_sql("event_id", "break", 300)} AS broken FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
t AS (SELECT user_id, k, transforms, 's' || user_id || '.' || (v - transforms::INT + CASE WHEN broken = 0 THEN 1 ELSE 0 END) AS i, CASE WHEN transforms OR broken = 1 THEN 's' || user_id || '.' || CASE WHEN broken = 2 THEN v - 1 ELSE v END END AS o FROM c)"""


@query(f"""WITH RECURSIVE {_CUSTODY}, f AS (SELECT user_id, 0::BIGINT AS k, 's' || user_id || '.0' AS cur, false AS fault FROM (SELECT DISTINCT user_id FROM t)
UNION ALL SELECT t.user_id, t.k, CASE WHEN t.transforms AND t.o IS NOT NULL THEN t.o ELSE f.cur END, CASE WHEN t.transforms THEN NOT (t.i = f.cur AND t.o IS NOT NULL AND t.o <> f.cur) ELSE t.o IS NOT NULL OR t.i <> f.cur END FROM f JOIN t ON t.user_id = f.user_id AND t.k = f.k + 1)
SELECT user_id, max(k) AS n, count(*) FILTER (fault) AS n_violations, CASE WHEN bool_or(fault) THEN 'DIVERGED' ELSE 'CONTINUOUS' END AS status FROM f GROUP BY 1""")
def custody_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of custody whose subject changes only where it is transformed."""
    order, key = Window.partitionBy("user_id").orderBy("ts", "event_id"), F.col("event_id")
    transforms = F.col("event_type") == "purchase"
    rows = table(spark, sf_dir, "events").withColumn("k", F.row_number().over(order)).withColumn("transforms", transforms)
    rows = rows.withColumn("v", F.count_if("transforms").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("broken", drawn(key, "break", 300))
    version = lambda v: F.concat(F.lit("s"), F.col("user_id").cast("string"), F.lit("."), v.cast("string"))
    inputs = F.array(version(F.col("v") - F.col("transforms").cast("int") + F.when(F.col("broken") == 0, 1).otherwise(0)))
    output = F.when(F.col("transforms") | (F.col("broken") == 1), version(F.when(F.col("broken") == 2, F.col("v") - 1).otherwise(F.col("v"))))
    chain = rows.select("user_id", "k", "transforms", version(F.lit(0)).alias("start"), inputs.alias("inputs"), F.array_compact(F.array(output)).alias("outputs"))
    return timelines.subject_continuity(chain, "user_id", "k", "start")
