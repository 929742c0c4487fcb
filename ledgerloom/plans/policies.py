"""Queries over evidence and approvals: users' events are evidence, orders are requests, lines are approvals by suppliers."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import policies
from ledgerloom.plans.catalogue import query, table
from ledgerloom.plans.drawn import drawn, drawn_sql, one_of, one_of_sql

#: Requirements of one policy: id, category, schemas, statuses, signatures, freshness in seconds, optional, reviewable, allowed with limitations, severity, verification modes, signers' roles, strength, custody, lifecycle events.
_MODES = ("FULL", "LINKED")
_REQUIREMENTS = (
    ("r1", "view", ("s1", "s2"), ("TRUSTED",), 2, 86_400 * 20, False, False, False, "BLOCKING", _MODES, (), None, None, ()),
    ("r2", "click", (), (), 1, None, False, True, True, "WARNING", ("FULL",), (), None, None, ()),
    ("r3", "purchase", ("s1",), ("TRUSTED", "UNKNOWN"), 0, None, True, False, False, "BLOCKING", _MODES, ("OWNER",), None, None, ()),
    ("r4", "refund", (), ("TRUSTED",), 3, None, False, True, False, "WARNING", _MODES, (), "STRONG", None, ()),
    ("r5", "error", (), (), 1, 86_400 * 29, True, True, True, "WARNING", _MODES, (), None, "VALID", ()),
    ("r6", "future", (), (), 1, None, True, False, False, "BLOCKING", _MODES, (), None, None, ()),
    ("r7", "view", (), (), 1, None, False, True, False, "WARNING", _MODES, (), None, None, ("BUILT", "SIGNED")),
    ("r8", "signup", (), (), 1, None, False, True, True, "WARNING", _MODES, ("OWNER", "REVIEWER"), "STRONG", "VALID", ("SIGNED",)),
    ("r9", "signup", (), (), 1, None, True, True, True, "WARNING", (), (), None, None, ()),
)
_EVIDENCE_MODES = ("FULL",) * 6 + ("LINKED", "DECLARED")
_SCHEMAS, _TRUST = ("s1", "s1", "s2", "s3"), ("TRUSTED",) * 40 + ("UNKNOWN",) * 10 + ("BROKEN", "REVOKED")
_EVIDENCE = f"""e AS (SELECT user_id, event_type AS category, {one_of_sql("event_id", "schema", *_SCHEMAS)} AS schema, CASE WHEN user_id % 3 = 0 THEN 'TRUSTED' ELSE {one_of_sql("event_id", "trust", *_TRUST)} END AS status, user_id % 3 = 0 OR {drawn_sql("event_id", "there", 60)} > 0 AS available,
{drawn_sql("event_id", "exempt", 150)} = 0 AS exempts, event_type <> 'refund' OR user_id % 5 > 0 AS produced, CASE WHEN user_id % 7 > 0 OR {drawn_sql("event_id", "timed", 20)} > 0 THEN ts END AS observed_at, {drawn_sql("event_id", "limited", 30)} = 0 AS limited,
{one_of_sql("event_id", "mode", *_EVIDENCE_MODES)} AS mode, [['OWNER', 'REVIEWER'], ['OWNER'], NULL, ['REVIEWER', 'OWNER', 'X'], ['OWNER']][{drawn_sql("event_id", "roles", 5)} + 1] AS roles, {one_of_sql("event_id", "strength", "STRONG", "STRONG", "WEAK", None)} AS strength, {one_of_sql("event_id", "custody", "VALID", "VALID", "BROKEN", None)} AS custody,
[['BUILT', 'SIGNED'], ['SIGNED'], [], ['SIGNED', 'BUILT', 'RELEASED']][{drawn_sql("event_id", "lifecycle", 4)} + 1] AS lifecycle
FROM events WHERE {drawn_sql("event_id || event_type", "kept", 4)} = 0 OR user_id % 4 > 0), u AS (SELECT DISTINCT user_id, CASE WHEN user_id % 9 > 0 THEN TIMESTAMP '2024-01-31 00:00:00' END AS evaluated_at, user_id % 2 = 0 AS needs_time FROM events)"""


def _texts(*values: str) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    return table(spark, sf_dir, "events").select("user_id").distinct().select("user_id", F.when(user % 9 > 0, F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")).alias("evaluated_at"), (user % 2 == 0).alias("needs_time"))


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, user = F.col("event_id"), F.col("user_id")
    rows = table(spark, sf_dir, "events").where((drawn(F.concat(key.cast("string"), "event_type"), "kept", 4) == 0) | (user % 4 > 0))
    evidence = rows.select(
        "user_id", F.col("event_type").alias("category"), one_of(key, "schema", *_SCHEMAS).alias("schema"), F.when(user % 3 == 0, "TRUSTED").otherwise(one_of(key, "trust", *_TRUST)).alias("status"),
        ((user % 3 == 0) | (drawn(key, "there", 60) > 0)).alias("available"), (drawn(key, "exempt", 150) == 0).alias("exempts"), ((F.col("event_type") != "refund") | (user % 5 > 0)).alias("produced"),
        F.when((user % 7 > 0) | (drawn(key, "timed", 20) > 0), F.col("ts")).alias("observed_at"), (drawn(key, "limited", 30) == 0).alias("limited"), one_of(key, "mode", *_EVIDENCE_MODES).alias("mode"), F.element_at(F.array(_texts("OWNER", "REVIEWER"), _texts("OWNER"), F.lit(None).cast("array<string>"), _texts("REVIEWER", "OWNER", "X"), _texts("OWNER")), drawn(key, "roles", 5) + 1).alias("roles"),
        one_of(key, "strength", "STRONG", "STRONG", "WEAK", None).alias("strength"), one_of(key, "custody", "VALID", "VALID", "BROKEN", None).alias("custody"), F.element_at(F.array(_texts("BUILT", "SIGNED"), _texts("SIGNED"), _texts(), _texts("SIGNED", "BUILT", "RELEASED")), drawn(key, "lifecycle", 4) + 1).alias("lifecycle"),
    )
    return policies.requirement_outcomes(_REQUIREMENTS, evidence, _subjects(spark, sf_dir), "user_id", ["future"])


def _value(v: object) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else str(v) if isinstance(v, int) else f"{list(v)}::VARCHAR[]"


_OUTCOME_SQL = f"""r(id, category, schemas, statuses, sigs, fresh, opt, rev, lim, sev, modes, q_roles, q_strength, q_custody, q_events) AS (VALUES {", ".join("(" + ", ".join(map(_value, r)) + ")" for r in _REQUIREMENTS)}),
m AS (SELECT u.user_id, u.evaluated_at, r.*, e.user_id IS NOT NULL AS here, e.* EXCLUDE (user_id, category), e.user_id IS NOT NULL AND (len(schemas) = 0 OR list_contains(schemas, schema)) AND (len(statuses) = 0 OR list_contains(statuses, status)) AND list_contains(modes, mode) AND list_has_all(coalesce(roles, []), q_roles) AND (q_strength IS NULL OR coalesce(strength = q_strength, false)) AND (q_custody IS NULL OR coalesce(custody = q_custody, false)) AND list_has_all(lifecycle, q_events) AS ok FROM u CROSS JOIN r LEFT JOIN e ON e.user_id = u.user_id AND e.category = r.category),
g AS (SELECT user_id, id, any_value(evaluated_at) AS at_, any_value(category) AS category, any_value(sigs) AS sigs, any_value(fresh) AS fresh, any_value(opt) AS opt, any_value(rev) AS rev, any_value(lim) AS lim, any_value(sev) AS sev, count(*) FILTER (here) AS n, count(*) FILTER (ok) AS n_ok, bool_or(exempts) AS ex, bool_or(produced) AS pr, bool_and(available) AS av,
 bool_or(status = 'BROKEN') AS br, bool_or(status IN ('INVALID', 'REVOKED', 'EXPIRED')) AS iv, bool_or(ok AND observed_at IS NULL) AS tl, bool_or(ok AND epoch(evaluated_at) - floor(epoch(observed_at)) > fresh) AS old, bool_or(ok AND limited) AS li FROM m GROUP BY 1, 2),
o AS (SELECT *, CASE WHEN n > 0 AND ex THEN 'NOT_APPLICABLE' WHEN n = 0 AND opt THEN 'NOT_CHECKED' WHEN n = 0 THEN 'MISSING' WHEN category = 'future' OR NOT pr OR NOT av THEN 'UNAVAILABLE' WHEN br THEN 'BROKEN' WHEN iv OR n_ok = 0 OR sigs > n_ok THEN 'INVALID'
 WHEN fresh IS NOT NULL THEN CASE WHEN at_ IS NULL OR tl THEN 'NOT_EVALUATED' WHEN old THEN 'STALE' ELSE 'SATISFIED' END WHEN li THEN 'SATISFIED_WITH_LIMITATIONS' ELSE 'SATISFIED' END AS outcome FROM g),
q AS (SELECT *, NOT opt AND NOT (outcome = 'SATISFIED_WITH_LIMITATIONS' AND lim) AND outcome NOT IN ('SATISFIED', 'NOT_APPLICABLE') AND (sev = 'BLOCKING' OR NOT rev) AS blocking FROM o)"""


@query(f"WITH {_EVIDENCE}, {_OUTCOME_SQL} SELECT user_id, id AS requirement_id, n_ok AS n_accepted, outcome, blocking FROM q")
def requirement_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each requirement of a policy for each subject."""
    return _outcomes(spark, sf_dir).drop("reviewable", "optional")


@query(f"""WITH {_EVIDENCE}, {_OUTCOME_SQL}, s AS (SELECT user_id, count(*) FILTER (blocking) AS n_blocking, count(*) FILTER (outcome NOT IN ('SATISFIED', 'SATISFIED_WITH_LIMITATIONS', 'NOT_APPLICABLE')) AS n_missing, bool_or(outcome = 'BROKEN') AS br, bool_or(outcome = 'NOT_EVALUATED' AND NOT opt) AS ne,
bool_or(rev AND outcome NOT IN ('SATISFIED', 'NOT_APPLICABLE')) AS rv, bool_or(outcome IN ('SATISFIED_WITH_LIMITATIONS', 'NOT_CHECKED')) AS li FROM q GROUP BY 1)
SELECT user_id, n_blocking, n_missing, CASE WHEN needs_time AND evaluated_at IS NULL THEN 'NOT_EVALUATED' WHEN br THEN 'EVIDENCE_BROKEN' WHEN n_blocking > 0 THEN 'DENY' WHEN ne THEN 'NOT_EVALUATED' WHEN rv THEN 'REVIEW_REQUIRED' WHEN li THEN 'ALLOW_WITH_LIMITATIONS' ELSE 'ALLOW' END AS decision FROM u JOIN s USING (user_id)""")
def policy_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a policy decides for each subject."""
    return policies.decisions(_outcomes(spark, sf_dir), _subjects(spark, sf_dir), "user_id")


_VOTES = ("APPROVED",) * 6 + ("APPROVED_WITH_CONDITIONS", "ABSTAINED", "DENIED")
_ROLE = ("REVIEWER", "SECURITY", "OWNER", "VISITOR")
_APPROVALS = f"""rq AS (SELECT o_orderkey AS q, o_custkey % 13 > 0 AS policy_matches, 'zone/' || o_custkey % 20 || '/o' || o_orderkey AS locator FROM orders),
ap AS (SELECT l_orderkey AS q, l_linenumber AS id, {one_of_sql("l_orderkey * 10 + l_linenumber", "role", *_ROLE)} AS role, l_suppkey AS signer, l_suppkey % 60 AS key, s_nationkey AS root, {drawn_sql("l_orderkey * 10 + l_linenumber", "trusted", 9)} > 0 AS trusted, {drawn_sql("l_orderkey * 10 + l_linenumber", "bound", 9)} > 0 AS bound,
{drawn_sql("l_orderkey * 10 + l_linenumber", "signed", 9)} > 0 AS signed, l_shipdate < TIMESTAMP '2001-01-01' AS in_time, {one_of_sql("l_orderkey * 10 + l_linenumber", "vote", *_VOTES)} AS vote FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_orderkey % 17 > 0),
rj AS (SELECT l_orderkey AS q, {one_of_sql("l_orderkey * 10 + l_linenumber", "role", *_ROLE)} AS role, l_suppkey AS signer, true AS trusted, {drawn_sql("l_orderkey * 10 + l_linenumber", "bound", 9)} > 0 AS bound FROM lineitem WHERE l_orderkey % 17 > 0 AND l_partkey % 23 = 0),
sg AS (SELECT s_suppkey AS signer, ['REVIEWER', 'SECURITY', 'OWNER', 'VISITOR'][x] AS role, CASE WHEN s_suppkey % 3 = 0 THEN 'zone/1*' ELSE '*' END AS scope FROM supplier, (VALUES (1), (2), (3), (4)) v(x) WHERE (s_suppkey + x) % 4 > 0)"""


def _approvals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    lines = table(spark, sf_dir, "lineitem").where("l_orderkey % 17 > 0")
    suppliers = table(spark, sf_dir, "supplier")
    requests = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("q"), (F.col("o_custkey") % 13 > 0).alias("policy_matches"), F.concat(F.lit("zone/"), (F.col("o_custkey") % 20).cast("string"), F.lit("/o"), F.col("o_orderkey").cast("string")).alias("locator"))
    role, bound = one_of(key, "role", *_ROLE).alias("role"), (drawn(key, "bound", 9) > 0).alias("bound")
    approvals = lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_orderkey").alias("q"), F.col("l_linenumber").alias("approval_id"), role, F.col("l_suppkey").alias("signer"), (F.col("l_suppkey") % 60).alias("key"), F.col("s_nationkey").alias("root"),
        (drawn(key, "trusted", 9) > 0).alias("trusted"), bound, (drawn(key, "signed", 9) > 0).alias("signed"), (F.col("l_shipdate") < F.lit("2001-01-01").cast("timestamp_ntz")).alias("in_time"), one_of(key, "vote", *_VOTES).alias("vote"),
    )
    rejections = lines.where("l_partkey % 23 = 0").select(F.col("l_orderkey").alias("q"), role, F.col("l_suppkey").alias("signer"), F.lit(True).alias("trusted"), bound)
    given = suppliers.select("s_suppkey", F.posexplode(F.array(*map(F.lit, _ROLE))).alias("x", "role")).where((F.col("s_suppkey") + F.col("x") + 1) % 4 > 0)
    return requests, approvals, rejections, given.select(F.col("s_suppkey").alias("signer"), "role", F.when(F.col("s_suppkey") % 3 == 0, "zone/1*").otherwise("*").alias("scope"))


@query(f"""WITH {_APPROVALS}, ok AS (SELECT a.*, policy_matches FROM ap a JOIN rq USING (q) WHERE policy_matches AND trusted AND bound AND role <> 'VISITOR' AND EXISTS (SELECT 1 FROM sg WHERE sg.signer = a.signer AND sg.role = a.role AND locator GLOB sg.scope) AND ((vote IN ('APPROVED', 'APPROVED_WITH_CONDITIONS') AND signed AND in_time))),
no AS (SELECT DISTINCT q FROM rj JOIN rq USING (q) WHERE policy_matches AND bound AND role <> 'VISITOR' AND EXISTS (SELECT 1 FROM sg WHERE sg.signer = rj.signer AND sg.role = rj.role AND locator GLOB sg.scope)),
c AS (SELECT q, count(DISTINCT id) AS n, count(DISTINCT signer) AS s, count(DISTINCT key) AS k, count(DISTINCT root) AS r, bool_or(role = 'SECURITY') AS sec FROM ok GROUP BY 1)
SELECT rq.q AS o_orderkey, coalesce(n, 0) AS n_counted, coalesce(s, 0) AS n_signers, coalesce(k, 0) AS n_keys, coalesce(r, 0) AS n_roots, CASE WHEN NOT policy_matches THEN 'INVALID' WHEN no.q IS NOT NULL THEN 'BLOCKED_BY_REJECTION' WHEN n >= 2 AND s >= 2 AND k >= 2 AND r >= 2 AND sec THEN 'SATISFIED' WHEN n > 0 THEN 'PARTIAL' ELSE 'NOT_SATISFIED' END AS outcome
FROM rq LEFT JOIN c USING (q) LEFT JOIN no ON no.q = rq.q""")
def quorum_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approvals that count, by role, scope, signature and time, against a quorum that a rejection blocks."""
    out = policies.quorums(*_approvals(spark, sf_dir), "q", roles=_ROLE[:3], required=["SECURITY"], least=(2, 2, 2, 2), conditional=True, abstentions=False, rejection_blocks=True)
    return out.withColumnRenamed("q", "o_orderkey")


@query(f"""WITH {_APPROVALS}, ask AS (SELECT o_orderkey AS q, o_custkey % 100 AS signer, o_custkey % 60 AS key FROM orders), ro(signer, role) AS (SELECT s_suppkey, 'TRANSFORMER' FROM supplier WHERE s_suppkey % 29 = 0 UNION ALL SELECT s_suppkey, 'PROMOTER' FROM supplier WHERE s_suppkey % 31 = 0),
j AS (SELECT ask.q, ap.signer = ask.signer AS v1, ap.key = ask.key AS v2, EXISTS (SELECT 1 FROM ro WHERE ro.signer = ap.signer AND role = 'TRANSFORMER') AS v3, EXISTS (SELECT 1 FROM ro WHERE ro.signer = ap.signer AND role = 'PROMOTER') AS v4, ap.signer, ap.key, ap.root, ap.trusted FROM ask JOIN ap USING (q)),
s AS (SELECT q, count(*) AS n, concat_ws(',', CASE WHEN count(*) > 1 AND count(root) = count(*) AND count(DISTINCT root) < count(*) THEN 'DELEGATES_SHARE_TRUST_ROOT' END, CASE WHEN count(*) > 1 AND count(DISTINCT key) < count(*) THEN 'NOT_DISTINCT_KEY' END, CASE WHEN count(*) > 1 AND count(DISTINCT signer) < count(*) THEN 'NOT_DISTINCT_SIGNER' END,
 CASE WHEN bool_or(v4) THEN 'PROMOTER_IS_APPROVER' END, CASE WHEN bool_or(v1) THEN 'REQUESTER_IS_APPROVER' END, CASE WHEN bool_or(v2) THEN 'REQUESTER_KEY_IS_APPROVER_KEY' END, CASE WHEN bool_or(v3) THEN 'TRANSFORMER_IS_APPROVER' END) AS v, bool_or(NOT trusted) AS unsure FROM j GROUP BY 1)
SELECT ask.q AS o_orderkey, coalesce(n, 0) AS n_approvals, coalesce(v, '') AS violations, CASE WHEN v <> '' THEN 'VIOLATED' WHEN n IS NULL THEN 'NOT_EVALUATED' WHEN unsure THEN 'INSUFFICIENT_IDENTITY_EVIDENCE' ELSE 'SATISFIED' END AS outcome FROM ask LEFT JOIN s USING (q)""")
def duty_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven ways in which requesters, approvers and their roles are not apart."""
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("signer"))
    roles = suppliers.where("signer % 29 = 0").withColumn("role", F.lit("TRANSFORMER")).union(suppliers.where("signer % 31 = 0").withColumn("role", F.lit("PROMOTER")))
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("q"), (F.col("o_custkey") % 100).alias("signer"), (F.col("o_custkey") % 60).alias("key"))
    return policies.duty_separation(asked, _approvals(spark, sf_dir)[1].select("q", "signer", "key", "root", "trusted"), roles, "q").withColumnRenamed("q", "o_orderkey")


_CATEGORIES, _SEVERITIES, _STATES = ("SECRET", "SCRIPT", "PATH", "LINK"), ("LOW", "LOW", "MEDIUM", "HIGH", "UNKNOWN"), ("OPEN",) * 3 + ("FALSE_POSITIVE",) * 9 + ("MITIGATED", "ACCEPTED_RISK")
_FINDINGS = f"""fi AS (SELECT user_id, {one_of_sql("event_id", "category", *_CATEGORIES)} AS category, {one_of_sql("event_id", "severity", *_SEVERITIES)} AS severity, {one_of_sql("event_id", "confidence", *policies.CONFIDENCE)} AS confidence, {one_of_sql("event_id", "status", *_STATES)} AS status FROM events WHERE {drawn_sql("event_id", "finding", 25)} = 0),
bu AS (SELECT DISTINCT user_id, {drawn_sql("user_id", "reserved", 20)} = 0 AS reserved, {drawn_sql("user_id", "errors", 4)} AS errors, {drawn_sql("user_id", "scanner", 12)} > 0 AS scanner_accepted, {drawn_sql("user_id", "signature", 12)} > 0 AS signature_ok, {drawn_sql("user_id", "fresh", 15)} = 0 AS freshness_asked,
{one_of_sql("user_id", "coverage", "COMPLETE", "COMPLETE", "PARTIAL", "INCOMPLETE")} AS coverage, {drawn_sql("user_id", "methods", 10)} > 0 AS methods_ok, {drawn_sql("user_id", "personal", 4)} = 0 AS personal FROM events)"""


@query(f"""WITH {_FINDINGS}, s AS (SELECT user_id, count(*) AS n_active, count(*) FILTER ((category = 'SECRET' OR severity = 'HIGH') AND confidence IN ('MEDIUM', 'HIGH', 'CONFIRMED')) AS n_blocking, bool_or(severity = 'UNKNOWN' OR confidence = 'UNKNOWN') AS vague, bool_or(status = 'ACCEPTED_RISK') AS risk FROM fi WHERE status IN ('OPEN', 'ACCEPTED_RISK') GROUP BY 1)
SELECT user_id, coalesce(n_active, 0) AS n_active, coalesce(n_blocking, 0) AS n_blocking, CASE WHEN reserved THEN 'FAIL' WHEN n_blocking > 0 THEN 'FAIL' WHEN errors > 2 THEN 'FAIL' WHEN NOT scanner_accepted THEN 'SCANNER_UNTRUSTED' WHEN NOT signature_ok THEN 'SCANNER_UNTRUSTED' WHEN freshness_asked THEN 'NOT_EVALUATED'
WHEN coverage = 'INCOMPLETE' THEN 'COVERAGE_INCOMPLETE' WHEN NOT methods_ok THEN 'NOT_EVALUATED' WHEN vague THEN 'REVIEW_REQUIRED' WHEN risk THEN 'PASS_WITH_LIMITATIONS' WHEN n_active > 0 THEN 'REVIEW_REQUIRED' WHEN coverage <> 'COMPLETE' OR personal THEN 'PASS_WITH_LIMITATIONS' ELSE 'PASS' END AS verdict FROM bu LEFT JOIN s USING (user_id)""")
def security_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of a security policy on findings and coverage."""
    key, user, events = F.col("event_id"), F.col("user_id"), table(spark, sf_dir, "events")
    findings = events.where(drawn(key, "finding", 25) == 0).select("user_id", *(one_of(key, c, *v).alias(c) for c, v in (("category", _CATEGORIES), ("severity", _SEVERITIES), ("confidence", policies.CONFIDENCE), ("status", _STATES))))
    bundles = events.select("user_id").distinct().select(
        "user_id", (drawn(user, "reserved", 20) == 0).alias("reserved"), drawn(user, "errors", 4).alias("errors"), (drawn(user, "scanner", 12) > 0).alias("scanner_accepted"), (drawn(user, "signature", 12) > 0).alias("signature_ok"),
        (drawn(user, "fresh", 15) == 0).alias("freshness_asked"), one_of(user, "coverage", "COMPLETE", "COMPLETE", "PARTIAL", "INCOMPLETE").alias("coverage"), (drawn(user, "methods", 10) > 0).alias("methods_ok"), (drawn(user, "personal", 4) == 0).alias("personal"),
    )
    return policies.security_verdicts(bundles, findings, "user_id", categories=["SECRET"], severities=["HIGH"], confidence="MEDIUM", most_errors=2, unknown="REVIEW", accepted_risk="ALLOW_WITH_LIMITATIONS", coverage="FAIL", complete=False)


_MEMBER_ROLES, _METHODS = ("PRIMARY", "COMPANION", "COMPANION", "RUNTIME_GENERATED"), ("LOADED_BYTES", "LOADED_BYTES", "MANIFEST_IDENTITY")
_MEMBERS = f"""ex AS (SELECT l_orderkey AS scope, l_linenumber AS name, {one_of_sql("l_orderkey * 10 + l_linenumber", "role", *_MEMBER_ROLES)} AS role, min(l_partkey) AS digest, min(l_suppkey) AS provenance FROM lineitem GROUP BY 1, 2),
ob AS (SELECT scope, name, CASE WHEN {drawn_sql("scope * 10 + name", "dark", 30)} > 0 THEN digest + CASE WHEN {drawn_sql("scope * 10 + name", "drift", 40)} = 0 THEN 1 ELSE 0 END END AS digest, provenance + CASE WHEN {drawn_sql("scope * 10 + name", "made", 20)} = 0 THEN 1 ELSE 0 END AS provenance,
{one_of_sql("scope * 10 + name", "method", *_METHODS)} AS method FROM ex WHERE {drawn_sql("scope * 10 + name", "seen", 20)} > 0)"""
_MEMBER_SQL = """r AS (SELECT ex.scope, ex.name, role, CASE WHEN ob.digest IS NULL THEN 'UNOBSERVED' WHEN role = 'RUNTIME_GENERATED' AND ex.provenance <> ob.provenance THEN 'MISMATCH' WHEN role <> 'RUNTIME_GENERATED' AND ex.digest <> ob.digest THEN 'MISMATCH' WHEN method = 'MANIFEST_IDENTITY' THEN 'IDENTITY_PROXY_MATCH' ELSE 'FULL_CONTINUITY' END AS result
FROM ex LEFT JOIN ob ON ob.scope = ex.scope AND ob.name = ex.name)"""


def _members(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    key = F.col("scope") * 10 + F.col("name")
    expected = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("scope"), F.col("l_linenumber").alias("name")).agg(F.min("l_partkey").alias("digest"), F.min("l_suppkey").alias("provenance")).withColumn("role", one_of(key, "role", *_MEMBER_ROLES))
    observed = expected.where(drawn(key, "seen", 20) > 0).select(
        "scope", "name", F.when(drawn(key, "dark", 30) > 0, F.col("digest") + F.when(drawn(key, "drift", 40) == 0, 1).otherwise(0)).alias("digest"),
        (F.col("provenance") + F.when(drawn(key, "made", 20) == 0, 1).otherwise(0)).alias("provenance"), one_of(key, "method", *_METHODS).alias("method"),
    )
    return expected, observed


@query(f"WITH {_MEMBERS}, {_MEMBER_SQL} SELECT scope, name, result, CASE WHEN result = 'MISMATCH' THEN CASE role WHEN 'PRIMARY' THEN 'PRIMARY_ARTIFACT_DIGEST_DRIFT' WHEN 'RUNTIME_GENERATED' THEN 'UNKNOWN_RUNTIME_COMPONENT' ELSE 'COMPANION_ARTIFACT_DRIFT' END END AS drift FROM r")
def runtime_member_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of a deployment against what was seen running."""
    return policies.member_continuity(*_members(spark, sf_dir), "scope", "name")


_FACTS = {"broken": 40, "replayed": 40, "observer_unauthorized": 30, "deployment_unauthorized": 30, "observer_untrusted": 30, "deployment_unproven": 30, "coverage_incomplete": 30, "stale": 30, "security_limited": 30, "reserved": 30, "unsigned": 30, "weak": 30, "not_separate": 30, "uncorroborated": 30, "self_observed": 3}


@query(f"""WITH {_MEMBERS}, {_MEMBER_SQL}, s AS (SELECT scope, bool_or(result = 'MISMATCH') AS drift, bool_and(result = 'UNOBSERVED') AS none_, bool_or(result = 'IDENTITY_PROXY_MATCH') AS proxy, bool_or(result = 'UNOBSERVED' AND role = 'COMPANION') AS opt FROM r GROUP BY 1)
SELECT scope, CASE WHEN {drawn_sql("scope", "broken", 40)} = 0 THEN 'BROKEN' WHEN {drawn_sql("scope", "replayed", 40)} = 0 THEN 'REPLAY_REJECTED' WHEN drift THEN 'DRIFT_DETECTED' WHEN {drawn_sql("scope", "observer_unauthorized", 30)} = 0 THEN 'UNAUTHORIZED' WHEN {drawn_sql("scope", "deployment_unauthorized", 30)} = 0 THEN 'UNVERIFIED'
WHEN {drawn_sql("scope", "observer_untrusted", 30)} = 0 THEN 'UNTRUSTED' WHEN {drawn_sql("scope", "deployment_unproven", 30)} = 0 THEN 'UNVERIFIED' WHEN {drawn_sql("scope", "coverage_incomplete", 30)} = 0 THEN 'COVERAGE_INCOMPLETE' WHEN {drawn_sql("scope", "stale", 30)} = 0 THEN 'STALE' WHEN none_ THEN 'NOT_OBSERVED'
WHEN {drawn_sql("scope", "security_limited", 30)} = 0 OR {drawn_sql("scope", "reserved", 30)} = 0 THEN 'NOT_EVALUATED' WHEN {drawn_sql("scope", "unsigned", 30)} = 0 THEN 'UNTRUSTED' WHEN {drawn_sql("scope", "weak", 30)} = 0 THEN 'PARTIAL' WHEN {drawn_sql("scope", "not_separate", 30)} = 0 THEN 'UNAUTHORIZED'
WHEN {drawn_sql("scope", "uncorroborated", 30)} = 0 THEN 'PARTIAL' WHEN proxy THEN 'IDENTITY_PROXY_MATCH' WHEN opt THEN 'PARTIAL' WHEN {drawn_sql("scope", "self_observed", 3)} = 0 THEN 'PASS_WITH_LIMITATIONS' ELSE 'PASS' END AS verdict FROM s""")
def runtime_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on each deployment, by its members and nineteen rungs."""
    expected, observed = _members(spark, sf_dir)
    results = policies.member_continuity(expected, observed, "scope", "name").join(expected.select("scope", "name", "role"), ["scope", "name"])
    is_ = lambda r: F.col("result") == r
    sums = results.groupBy("scope").agg(F.bool_or(is_("MISMATCH")).alias("drift"), F.bool_and(is_("UNOBSERVED")).alias("not_observed"), F.bool_or(is_("IDENTITY_PROXY_MATCH")).alias("proxy"), F.bool_or(is_("UNOBSERVED") & (F.col("role") == "COMPANION")).alias("optional_unobserved"))
    facts = {name: drawn(F.col("scope"), name, n) == 0 for name, n in _FACTS.items()} | {c: F.col(c) for c in ("drift", "not_observed", "proxy", "optional_unobserved")}
    return sums.select("scope", policies.continuity_verdict(facts).alias("verdict"))


_SIGNED = {"invalid": 30, "revoked": 30, "superseded": 30, "withdrawn": 30, "expired": 20, "early": 20, "expiry_open": 20, "revocation_open": 20, "unknown_key": 4, "unknown_identity": 4}
_SIGNED_SAYS = {"invalid": "INVALID", "revoked": "REVOKED", "superseded": "SUPERSEDED", "withdrawn": "WITHDRAWN", "expired": "EXPIRED", "early": "NOT_YET_VALID", "expiry_open": "EXPIRATION_NOT_EVALUATED", "revocation_open": "REVOCATION_NOT_EVALUATED"}


@query(f"""WITH s AS (SELECT l_orderkey AS k, count(*) FILTER ({drawn_sql("l_orderkey * 10 + l_linenumber", "valid", 2)} = 0) AS n_accepted FROM lineitem GROUP BY 1)
SELECT k AS l_orderkey, n_accepted, CASE {" ".join(f"WHEN {drawn_sql('k', name, _SIGNED[name])} = 0 THEN '{says}'" for name, says in _SIGNED_SAYS.items())} WHEN n_accepted >= 2 THEN 'TRUSTED_SIGNATURE_WITH_LIMITATIONS' WHEN {drawn_sql("k", "unknown_key", 4)} = 0 THEN 'UNKNOWN_KEY' WHEN {drawn_sql("k", "unknown_identity", 4)} = 0 THEN 'UNKNOWN_IDENTITY' ELSE 'PARTIALLY_TRUSTED' END AS status FROM s""")
def signed_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects by their signatures, whose validity is a given column."""
    valid = drawn(F.col("l_orderkey") * 10 + F.col("l_linenumber"), "valid", 2) == 0
    sums = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(valid).alias("n_accepted"))
    facts = {name: drawn(F.col("l_orderkey"), name, n) == 0 for name, n in _SIGNED.items()} | {"enough": F.col("n_accepted") >= 2}
    return sums.select("l_orderkey", "n_accepted", policies.signed_object_status(facts).alias("status"))


@query("""WITH c AS (SELECT s_suppkey AS k, s_nationkey AS p, list(DISTINCT l_returnflag) FILTER (l_quantity > 49 AND s_suppkey % 3 > 0) AS mine FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2),
p AS (SELECT n_nationkey AS p, CASE n_nationkey % 4 WHEN 0 THEN [] WHEN 1 THEN ['A'] WHEN 2 THEN ['A', 'R'] ELSE ['A', 'N', 'R'] END AS theirs FROM nation)
SELECT k AS s_suppkey, CASE WHEN len(theirs) = 0 THEN true WHEN coalesce(len(mine), 0) = 0 THEN false ELSE list_has_all(theirs, mine) END AS within FROM c JOIN p USING (p)""")
def delegation_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delegations that grant nothing beyond what their parent may: empty parents are unconstrained."""
    flags = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.collect_set(F.when((F.col("l_quantity") > 49) & (F.col("l_suppkey") % 3 > 0), F.col("l_returnflag"))).alias("mine"))
    texts = lambda *xs: F.array(*map(F.lit, xs)).cast("array<string>")
    nation = F.col("s_nationkey") % 4
    theirs = F.when(nation == 0, texts()).when(nation == 1, texts("A")).when(nation == 2, texts("A", "R")).otherwise(texts("A", "N", "R"))
    both = table(spark, sf_dir, "supplier").join(flags, F.col("s_suppkey") == F.col("l_suppkey"), "left").join(table(spark, sf_dir, "nation").select(F.col("n_nationkey")), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
    return both.select("s_suppkey", policies.within_scope(F.coalesce("mine", texts()), theirs).alias("within"))
