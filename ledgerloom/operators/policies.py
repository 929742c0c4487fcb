"""Evidence against requirements, approvals against quorums, findings against security policies, members against what runs."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.compare import ladder


REQUIREMENT = (
    "requirement_id string, category string, schemas array<string>, statuses array<string>, min_signatures int, freshness bigint, optional boolean, reviewable boolean, allow_limited boolean, severity string, "
    "modes array<string>, roles array<string>, strength string, custody string, lifecycle array<string>"
)


def requirement_outcomes(requirements: Sequence[tuple], evidence: DataFrame, subjects: DataFrame, subject: str, reserved: Sequence[str]) -> DataFrame:
    """(subject, requirement_id, n_accepted, outcome, blocking, reviewable, optional) of every requirement for every subject (subject, evaluated_at).

    Requirements are rows of ``REQUIREMENT``. Of schemas and statuses an empty array
    accepts all; of verification modes only those that are named are accepted; all
    of ``roles`` have to be among a signer's and all of ``lifecycle`` among the
    events that evidence covers; a null freshness, strength or custody asks for
    none. Evidence has (subject, category, schema, status, available, exempts,
    produced, observed_at, limited, mode, roles, strength, custody, lifecycle). ``exempts`` marks
    policy evidence that a requirement does not apply, ``produced`` what a strict
    adapter made; categories that need none carry true. A policy's requirements
    ride along with each subject as one array.
    """
    names = [c.split()[0] for c in REQUIREMENT.split(", ")]
    kinds = [c.split()[1] for c in REQUIREMENT.split(", ")]
    literal = lambda v, kind: (F.array(*map(F.lit, v)) if isinstance(v, (list, tuple)) else F.lit(v)).cast(kind)
    listed = F.array(*(F.struct(*(literal(v, kind).alias(f"r_{c}") for v, c, kind in zip(r, names, kinds, strict=True))) for r in requirements))
    asked = subjects.select(subject, "evaluated_at", F.explode(listed).alias("x")).select(subject, "evaluated_at", "x.*")
    own = asked.join(evidence, (asked[subject] == evidence[subject]) & (F.col("r_category") == F.col("category"))).select(asked["*"], *(evidence[c] for c in evidence.columns if c != subject))
    fits = (F.size("r_schemas") == 0) | F.array_contains("r_schemas", F.col("schema"))
    held = lambda asked, there: F.size(F.array_except(asked, F.coalesce(there, F.array().cast("array<string>")))) == 0
    equal = lambda c: F.col(f"r_{c}").isNull() | F.col(f"r_{c}").eqNullSafe(F.col(c))
    conditions = {
        "status": (F.size("r_statuses") == 0) | F.array_contains("r_statuses", F.col("status")), "mode": F.array_contains("r_modes", F.col("mode")), "roles": held(F.col("r_roles"), F.col("roles")),
        "strength": equal("strength"), "custody": equal("custody"), "lifecycle": held(F.col("r_lifecycle"), F.col("lifecycle")),
    }
    accepted = F.coalesce(fits, F.lit(False))
    for condition in conditions.values():
        accepted = accepted & F.coalesce(condition, F.lit(False))
    age = F.unix_timestamp("evaluated_at") - F.unix_timestamp("observed_at")
    any_of = lambda c, name: F.coalesce(F.bool_or(c), F.lit(False)).alias(name)
    sums = own.groupBy(subject, "r_requirement_id").agg(
        F.count("*").alias("n"), F.count_if(accepted).alias("n_accepted"), any_of(F.col("exempts"), "exempt"), any_of(F.col("produced"), "made"), any_of(~F.col("available"), "gone"), any_of(F.col("status") == "BROKEN", "broken"),
        any_of(F.col("status").isin("INVALID", "REVOKED", "EXPIRED"), "invalid"), any_of(accepted & F.col("observed_at").isNull(), "timeless"), any_of(accepted & (age > F.col("r_freshness")), "old"), any_of(accepted & F.col("limited"), "limited"),
    )
    both = asked.join(sums, [subject, "r_requirement_id"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n", "n_accepted")})
    fresh = F.col("r_freshness").isNotNull()
    rungs = [
        ("NOT_APPLICABLE", F.col("exempt")), ("NOT_CHECKED", (F.col("n") == 0) & F.col("r_optional")), ("MISSING", F.col("n") == 0), ("UNAVAILABLE", F.col("r_category").isin(*reserved) | ~F.col("made")), ("UNAVAILABLE", F.col("gone")),
        ("BROKEN", F.col("broken")), ("INVALID", F.col("invalid") | (F.col("n_accepted") == 0) | (F.col("r_min_signatures") > F.col("n_accepted"))), ("NOT_EVALUATED", fresh & (F.col("evaluated_at").isNull() | F.col("timeless"))),
        ("STALE", fresh & F.col("old")), ("SATISFIED", fresh), ("SATISFIED_WITH_LIMITATIONS", F.col("limited")),
    ]
    out = both.withColumn("outcome", ladder(rungs, "SATISFIED"))
    settled = F.col("outcome").isin("SATISFIED", "NOT_APPLICABLE") | ((F.col("outcome") == "SATISFIED_WITH_LIMITATIONS") & F.col("r_allow_limited"))
    blocking = ~F.col("r_optional") & ~settled & ((F.col("r_severity") == "BLOCKING") | ~F.col("r_reviewable"))
    return out.select(subject, F.col("r_requirement_id").alias("requirement_id"), "n_accepted", "outcome", blocking.alias("blocking"), F.col("r_reviewable").alias("reviewable"), F.col("r_optional").alias("optional"))


def decisions(outcomes: DataFrame, subjects: DataFrame, subject: str) -> DataFrame:
    """(subject, n_blocking, n_missing, decision) of subjects (subject, needs_time, evaluated_at) from the outcomes of their requirements."""
    o = F.col("outcome")
    any_of = lambda c, name: F.bool_or(c).alias(name)
    sums = outcomes.groupBy(subject).agg(
        F.count_if("blocking").alias("n_blocking"), F.count_if(~o.isin("SATISFIED", "SATISFIED_WITH_LIMITATIONS", "NOT_APPLICABLE")).alias("n_missing"), any_of(o == "BROKEN", "broken"),
        any_of((o == "NOT_EVALUATED") & ~F.col("optional"), "open"), any_of(F.col("reviewable") & ~o.isin("SATISFIED", "NOT_APPLICABLE"), "review"), any_of(o.isin("SATISFIED_WITH_LIMITATIONS", "NOT_CHECKED"), "limited"),
    )
    rungs = [
        ("NOT_EVALUATED", F.col("needs_time") & F.col("evaluated_at").isNull()), ("EVIDENCE_BROKEN", F.col("broken")), ("DENY", F.col("n_blocking") > 0), ("NOT_EVALUATED", F.col("open")),
        ("REVIEW_REQUIRED", F.col("review")), ("ALLOW_WITH_LIMITATIONS", F.col("limited")),
    ]
    return subjects.join(sums, subject).select(subject, "n_blocking", "n_missing", ladder(rungs, "ALLOW").alias("decision"))


def quorums(requests: DataFrame, approvals: DataFrame, rejections: DataFrame, assignments: DataFrame, request: str, *, roles: Sequence[str], required: Sequence[str], least: tuple[int, int, int, int], conditional: bool, abstentions: bool, rejection_blocks: bool) -> DataFrame:
    """(request, n_counted, n_signers, n_keys, n_roots, outcome).

    Requests have (request, policy_matches, locator); approvals (request,
    approval_id, role, signer, key, root, trusted, bound, signed, in_time, vote)
    and rejections (request, role, signer, trusted, bound) are of one request;
    assignments (signer, role, scope) hold where the glob ``scope`` matches the
    request's locator. ``least`` are the numbers of approvals, signers, keys and
    roots. An approval counts once, however often it is listed.
    """
    assigned = assignments.select(F.col("signer").alias("a_signer"), F.col("role").alias("a_role"), "scope").distinct()
    facts = requests.select(F.col(request).alias("asked_of"), "policy_matches", "locator")

    def held(rows: DataFrame) -> DataFrame:
        own = rows.join(facts, F.col(request) == F.col("asked_of")).where(F.col("policy_matches") & F.col("trusted") & F.col("bound") & F.col("role").isin(*roles))
        on = (F.col("signer") == F.col("a_signer")) & (F.col("role") == F.col("a_role")) & F.rlike(F.col("locator"), F.col("pattern"))
        return own.join(assigned.withColumn("pattern", glob_column(F.col("scope"))), on, "left_semi")

    votes = ["APPROVED", *(["APPROVED_WITH_CONDITIONS"] if conditional else [])]
    counts = (F.col("vote").isin(*votes) & F.col("signed") & F.col("in_time")) | (F.lit(abstentions) & (F.col("vote") == "ABSTAINED"))
    valid = held(approvals).where(counts).groupBy(request).agg(F.countDistinct("approval_id").alias("n_counted"), F.countDistinct("signer").alias("n_signers"), F.countDistinct("key").alias("n_keys"), F.countDistinct("root").alias("n_roots"), F.collect_set("role").alias("held_roles"))
    against = held(rejections).groupBy(request).agg(F.lit(True).alias("rejected"))
    given = approvals.select(request).union(rejections.select(request)).distinct().withColumn("given", F.lit(True))
    anyone = not assigned.isEmpty()
    both = requests.join(valid, request, "left").join(against, request, "left").join(given, request, "left")
    both = both.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_counted", "n_signers", "n_keys", "n_roots")})
    met = F.size(F.array_except(F.array(*map(F.lit, required)).cast("array<string>"), F.coalesce("held_roles", F.array().cast("array<string>")))) == 0
    for c, n in zip(("n_counted", "n_signers", "n_keys", "n_roots"), least, strict=True):
        met = met & (F.col(c) >= n)
    rungs = [
        ("INVALID", ~F.col("policy_matches")), ("NOT_EVALUATED", F.lit(not anyone) & F.coalesce("given", F.lit(False))), ("BLOCKED_BY_REJECTION", F.coalesce("rejected", F.lit(False)) & F.lit(rejection_blocks)),
        ("SATISFIED", met), ("PARTIAL", F.col("n_counted") > 0),
    ]
    return both.select(request, "n_counted", "n_signers", "n_keys", "n_roots", ladder(rungs, "NOT_SATISFIED").alias("outcome"))


def glob_column(glob: Column) -> Column:
    """``glob_pattern`` of a column of globs that use ``*`` and ``?`` only."""
    escaped = F.regexp_replace(glob, r"([^A-Za-z0-9_ *?])", r"\\$1")
    return F.concat(F.lit(r"(?s)\A"), F.replace(F.replace(escaped, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit(r"\z"))


def duty_separation(requests: DataFrame, approvals: DataFrame, assignments: DataFrame, request: str) -> DataFrame:
    """(request, n_approvals, violations, outcome): requests (request, signer, key), approvals (request, signer, key, root, trusted), assignments (signer, role).

    Violations: the requester or the requester's key approves; an approver
    transforms or promotes; two approvals share a signer, key or root. Approvers
    are counted by request before roles meet them.
    """
    roles = assignments.groupBy(F.col("signer").alias("r_signer")).agg(F.collect_set("role").alias("roles"))
    asker = requests.select(request, F.col("signer").alias("asker"), F.col("key").alias("asker_key"))
    own = approvals.join(asker, request).join(roles, F.col("signer") == F.col("r_signer"), "left")
    any_of = lambda c, name: F.coalesce(F.bool_or(c), F.lit(False)).alias(name)
    known = lambda c: (F.count(c) == F.count("*")) & (F.count("*") > 1) & (F.countDistinct(c) < F.count("*"))
    sums = own.groupBy(request).agg(
        F.count("*").alias("n_approvals"), any_of(F.col("signer") == F.col("asker"), "REQUESTER_IS_APPROVER"), any_of(F.col("key") == F.col("asker_key"), "REQUESTER_KEY_IS_APPROVER_KEY"),
        any_of(F.array_contains("roles", "TRANSFORMER"), "TRANSFORMER_IS_APPROVER"), any_of(F.array_contains("roles", "PROMOTER"), "PROMOTER_IS_APPROVER"), known("signer").alias("NOT_DISTINCT_SIGNER"), known("key").alias("NOT_DISTINCT_KEY"),
        known("root").alias("DELEGATES_SHARE_TRUST_ROOT"), any_of(~F.col("trusted") | F.col("signer").isNull() | F.col("key").isNull(), "unsure"),
    )
    names = ["DELEGATES_SHARE_TRUST_ROOT", "NOT_DISTINCT_KEY", "NOT_DISTINCT_SIGNER", "PROMOTER_IS_APPROVER", "REQUESTER_IS_APPROVER", "REQUESTER_KEY_IS_APPROVER_KEY", "TRANSFORMER_IS_APPROVER"]
    both = requests.select(request).join(sums, request, "left").withColumn("n_approvals", F.coalesce("n_approvals", F.lit(0)))
    violations = F.array_join(F.array_compact(F.array(*(F.when(F.col(n), n) for n in names))), ",")
    rungs = [("VIOLATED", F.col("violations") != ""), ("NOT_EVALUATED", F.col("n_approvals") == 0), ("INSUFFICIENT_IDENTITY_EVIDENCE", F.col("unsure"))]
    return both.withColumn("violations", violations).select(request, "n_approvals", "violations", ladder(rungs, "SATISFIED").alias("outcome"))


#: The order of confidences.
CONFIDENCE = ("UNKNOWN", "LOW", "MEDIUM", "HIGH", "CONFIRMED")


def security_verdicts(bundles: DataFrame, findings: DataFrame, subject: str, *, categories: Sequence[str], severities: Sequence[str], confidence: str, most_errors: int, unknown: str, accepted_risk: str, coverage: str, complete: bool) -> DataFrame:
    """(subject, n_active, n_blocking, verdict) of bundles (subject, reserved, errors, scanner_accepted, signature_ok, freshness_asked, coverage, methods_ok, personal).

    Findings (subject, category, severity, confidence, status) that are false
    positives, mitigated or not applicable do not count; one blocks by its
    category or severity if it is confident enough. ``unknown``,
    ``accepted_risk`` and ``coverage`` say what such findings or gaps lead to:
    ALLOW_WITH_LIMITATIONS, REVIEW or FAIL. ``complete`` asks for full coverage.
    """
    rank = F.array_position(F.array(*map(F.lit, CONFIDENCE)), F.col("confidence"))
    active = findings.where(~F.col("status").isin("FALSE_POSITIVE", "MITIGATED", "NOT_APPLICABLE"))
    blocks = (F.col("category").isin(*categories) | F.col("severity").isin(*severities)) & (rank >= CONFIDENCE.index(confidence) + 1)
    sums = active.groupBy(subject).agg(F.count("*").alias("n_active"), F.count_if(blocks).alias("n_blocking"), F.bool_or((F.col("severity") == "UNKNOWN") | (F.col("confidence") == "UNKNOWN")).alias("vague"), F.bool_or(F.col("status") == "ACCEPTED_RISK").alias("risk"))
    both = bundles.join(sums, subject, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_active", "n_blocking")})
    gap = ~F.col("coverage").isin("COMPLETE") if complete else ~F.col("coverage").isin("COMPLETE", "PARTIAL")
    leads = {"ALLOW_WITH_LIMITATIONS": "PASS_WITH_LIMITATIONS", "REVIEW": "REVIEW_REQUIRED"}
    allowed = coverage == "ALLOW_WITH_LIMITATIONS"
    rungs = [
        ("FAIL", F.col("reserved") | (F.col("n_blocking") > 0) | (F.col("errors") > most_errors)), ("SCANNER_UNTRUSTED", ~F.col("scanner_accepted") | ~F.col("signature_ok")), ("NOT_EVALUATED", F.col("freshness_asked")),
        *([] if allowed else [("REVIEW_REQUIRED" if coverage == "REVIEW" else "COVERAGE_INCOMPLETE", gap)]), ("NOT_EVALUATED", ~F.col("methods_ok")), (leads.get(unknown, "FAIL"), F.col("vague")),
        (leads.get(accepted_risk, "FAIL"), F.col("risk")), ("REVIEW_REQUIRED", F.col("n_active") > 0), *([("PASS_WITH_LIMITATIONS", gap)] if allowed else []), ("PASS_WITH_LIMITATIONS", (F.col("coverage") != "COMPLETE") | F.col("personal")),
    ]
    return both.select(subject, "n_active", "n_blocking", ladder(rungs, "PASS").alias("verdict"))


#: Methods that see a stand-in for the bytes, not the bytes.
PROXIES = ("CONTAINER_IMAGE_PROXY", "REGISTRY_REFERENCE_IDENTITY", "MANIFEST_IDENTITY", "CONFIGURATION_PROXY", "DECLARED_IDENTITY")


def member_continuity(expected: DataFrame, observed: DataFrame, scope: str, name: str) -> DataFrame:
    """(scope, name, result, drift) of expected members (scope, name, role, digest, provenance) against observed ones (scope, name, digest, provenance, method).

    Members that are made at run time are held by their provenance, others by
    their digest; what was not seen is UNOBSERVED and no drift.
    """
    o = observed.select(scope, name, F.col("digest").alias("o_digest"), F.col("provenance").alias("o_provenance"), "method")
    both = expected.join(o, [scope, name], "left")
    generated = F.col("role") == "RUNTIME_GENERATED"
    differs = F.when(generated, ~F.col("provenance").eqNullSafe(F.col("o_provenance"))).otherwise(~F.col("digest").eqNullSafe(F.col("o_digest")))
    result = ladder([("UNOBSERVED", F.col("o_digest").isNull()), ("MISMATCH", differs), ("IDENTITY_PROXY_MATCH", F.col("method").isin(*PROXIES))], "FULL_CONTINUITY")
    drift = F.when(F.col("result") == "MISMATCH", ladder([("PRIMARY_ARTIFACT_DIGEST_DRIFT", F.col("role") == "PRIMARY"), ("UNKNOWN_RUNTIME_COMPONENT", generated)], "COMPANION_ARTIFACT_DRIFT"))
    return both.withColumn("result", result).select(scope, name, "result", drift.alias("drift"))


def continuity_verdict(facts: dict[str, Column]) -> Column:
    """The verdict on a running deployment: the first of these facts that holds, in this order."""
    order = [
        ("BROKEN", "broken"), ("REPLAY_REJECTED", "replayed"), ("DRIFT_DETECTED", "drift"), ("UNAUTHORIZED", "observer_unauthorized"), ("UNVERIFIED", "deployment_unauthorized"), ("UNTRUSTED", "observer_untrusted"),
        ("UNVERIFIED", "deployment_unproven"), ("COVERAGE_INCOMPLETE", "coverage_incomplete"), ("STALE", "stale"), ("NOT_OBSERVED", "not_observed"), ("NOT_EVALUATED", "security_limited"), ("NOT_EVALUATED", "reserved"),
        ("UNTRUSTED", "unsigned"), ("PARTIAL", "weak"), ("UNAUTHORIZED", "not_separate"), ("PARTIAL", "uncorroborated"), ("IDENTITY_PROXY_MATCH", "proxy"), ("PARTIAL", "optional_unobserved"), ("PASS_WITH_LIMITATIONS", "self_observed"),
    ]
    return ladder([(status, facts[name]) for status, name in order if name in facts], "PASS")


def signed_object_status(facts: dict[str, Column]) -> Column:
    """The status of a signed object: what is wrong with it first, then enough accepted signatures, then what is unknown."""
    order = [
        ("INVALID", "invalid"), ("REVOKED", "revoked"), ("SUPERSEDED", "superseded"), ("WITHDRAWN", "withdrawn"), ("EXPIRED", "expired"), ("NOT_YET_VALID", "early"), ("EXPIRATION_NOT_EVALUATED", "expiry_open"),
        ("REVOCATION_NOT_EVALUATED", "revocation_open"), ("TRUSTED_SIGNATURE_WITH_LIMITATIONS", "enough"), ("UNKNOWN_KEY", "unknown_key"), ("UNKNOWN_IDENTITY", "unknown_identity"),
    ]
    return ladder([(status, facts[name]) for status, name in order if name in facts], "PARTIALLY_TRUSTED")


def within_scope(child: Column, parent: Column) -> Column:
    """Whether a list of constraints grants nothing beyond its parent's: an empty parent is unconstrained, an empty child of a constrained parent is not within."""
    return (F.size(parent) == 0) | ((F.size(child) > 0) & (F.size(F.array_except(child, parent)) == 0))

