"""Histories of many subjects at once: forks, gaps, what was known when, expiry, revocation, renewals, snapshots."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.compare import ladder
from ledgerloom.operators.components import ring_members

#: The form of a recorded time.
UTC_TIME = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z\z"


def forks(events: DataFrame, chain: Sequence[str], place: Sequence[str], event: str, predecessor: str, digest: str | None = None) -> DataFrame:
    """(chain, outcome, at, n_events): CONFLICT_DETECTED where a place of a chain has several contents, FORK_DETECTED where an event has several successors.

    ``at`` is the place, its parts joined by ``/``, or the predecessor. Without
    ``digest`` the event's own id is its content.
    """
    at = F.concat_ws("/", *(F.col(c).cast("string") for c in place)) if place else F.lit("")
    same = events.groupBy(*chain, at.alias("at")).agg(F.countDistinct(digest or event).alias("contents"), F.countDistinct(event).alias("n_events")).where("contents > 1")
    split = events.where(F.col(predecessor).isNotNull()).groupBy(*chain, F.col(predecessor).cast("string").alias("at")).agg(F.countDistinct(event).alias("n_events")).where("n_events > 1")
    rows = lambda df, outcome: df.select(*chain, F.lit(outcome).alias("outcome"), "at", "n_events")
    return rows(same, "CONFLICT_DETECTED").union(rows(split, "FORK_DETECTED"))


def timelines(events: DataFrame, ranges: DataFrame, found: DataFrame, subject: str, sequence: str) -> DataFrame:
    """(subject, n_events, n_forks, n_missing, completeness) of ranges (subject, start, end), with ``found`` the forks of the same events.

    Gaps count sequence numbers whatever their epoch, and only inside the declared range.
    """
    own = events.join(ranges, subject).groupBy(subject).agg(F.count("*").alias("n_events"), F.countDistinct(F.when(F.col(sequence).between(F.col("start"), F.col("end")), F.col(sequence))).alias("held"))
    both = ranges.join(own, subject, "left").join(found.groupBy(subject).agg(F.count("*").alias("n_forks")), subject, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_events", "held", "n_forks")})
    missing = F.greatest(F.lit(0), F.col("end") - F.col("start") + 1) - F.col("held")
    rungs = [("FORKED", F.col("n_forks") > 0), ("MISSING_PREDECESSOR", F.col("n_missing") > 0)]
    return both.withColumn("n_missing", missing).select(subject, "n_events", "n_forks", "n_missing", ladder(rungs, "COMPLETE_FOR_DECLARED_RANGE").alias("completeness"))


def knowledge(available: Column, effective: Column, cutoff: str) -> Column:
    """Which of five states a fact is in at a cutoff; times are compared as text, since their form is fixed."""
    formed = available.rlike(UTC_TIME) & effective.rlike(UTC_TIME) & F.lit(cutoff).rlike(UTC_TIME)
    rungs = [
        ("AVAILABILITY_NOT_RECORDED", available == "NOT_RECORDED"), ("INVALID", (effective == "NOT_RECORDED") | ~F.coalesce(formed, F.lit(False))),
        ("NOT_KNOWN_AS_OF_CUTOFF", available > cutoff), ("KNOWN_FUTURE_EFFECTIVE_AS_OF_CUTOFF", effective > cutoff),
    ]
    return ladder(rungs, "KNOWN_EFFECTIVE_AS_OF_CUTOFF")


def resolutions(receipts: DataFrame, name: str, requested: str, resolved: str, method: Sequence[str], redirected: str) -> DataFrame:
    """(name, n, status): whether a name resolves alike in all receipts that were supplied for it."""
    sums = receipts.groupBy(name).agg(
        F.count("*").alias("n"), F.bool_or(~F.col(requested).eqNullSafe(F.col(name))).alias("other"), F.bool_or(F.col(resolved).isNull()).alias("hidden"),
        F.countDistinct(F.struct(*method)).alias("methods"), F.countDistinct(resolved).alias("kinds"), F.bool_or(redirected).alias("redirected"),
    )
    rungs = [
        ("INSUFFICIENT_OBSERVATIONS", F.col("n") < 2), ("REQUESTED_IDENTIFIER_CHANGED", F.col("other")), ("RESOLVED_IDENTITY_NOT_DISCLOSED", F.col("hidden")), ("OBSERVATION_WINDOWS_NOT_COMPARABLE", F.col("methods") > 1),
        ("SAME_RESOLVED_IDENTITY_FOR_SUPPLIED_OBSERVATIONS", F.col("kinds") == 1), ("REDIRECT_TARGET_CHANGED_FOR_SUPPLIED_OBSERVATIONS", F.coalesce("redirected", F.lit(False))),
    ]
    return sums.select(name, "n", ladder(rungs, "ALIAS_REBOUND_FOR_SUPPLIED_OBSERVATIONS").alias("status"))


#: Which role of evidence settles a dimension, its state with it, and its state without it.
DIMENSIONS = (
    ("ARTIFACT_IDENTITY", "ARTIFACT_IDENTITY", "SATISFIED", "MISSING"), ("ARTIFACT_SET_COMPLETENESS", "ARTIFACT_SET", "SATISFIED", "PARTIAL"), ("SOURCE_PROVENANCE", "ATTESTATION", "SATISFIED_WITH_LIMITATIONS", "MISSING"),
    ("CUSTODY_INTEGRITY", "CUSTODY", "SATISFIED", "MISSING"), ("SIGNATURE_TRUST", "TRUST", "SATISFIED", "NOT_EVALUATED"), ("SIGNER_AUTHORITY", "AUTHORITY", "SATISFIED", "NOT_EVALUATED"),
    ("SECURITY_EVIDENCE", "SECURITY", "SATISFIED_WITH_LIMITATIONS", "MISSING"), ("GOVERNANCE_DECISION", "GOVERNANCE", "SATISFIED", "MISSING"), ("APPROVAL", "APPROVAL", "SATISFIED", "MISSING"),
    ("DEPLOYMENT_EVIDENCE", "DEPLOYMENT", "SATISFIED_WITH_LIMITATIONS", "MISSING"), ("RUNTIME_OBSERVATION", "RUNTIME", "SATISFIED_WITH_LIMITATIONS", "MISSING"), ("RUNTIME_CONTINUITY", "CONTINUITY", "SATISFIED_WITH_LIMITATIONS", "NOT_EVALUATED"),
)
UNCHECKED = ("PAYLOAD_INTEGRITY", "TOKENIZER_PARITY", "QUANTIZATION_FIDELITY", "NUMERICAL_PARITY", "BEHAVIORAL_SAFETY")


def dimension_states(evidence: DataFrame, subjects: DataFrame, overrides: DataFrame, subject: str) -> DataFrame:
    """(subject, dimension, state): what the roles of available evidence (subject, role) settle; an override (subject, dimension, state) goes before.

    Subjects have (subject, no_revocations). A dimension that only overrides know is added.
    """
    roles = evidence.groupBy(subject).agg(F.collect_set("role").alias("roles"))
    held = lambda role: F.coalesce(F.array_contains("roles", role), F.lit(False))
    states = [(name, F.when(held(role), there).otherwise(without)) for name, role, there, without in DIMENSIONS] + [(name, F.lit("NOT_CHECKED")) for name in UNCHECKED]
    states += [("REVOCATION", F.when(F.col("no_revocations"), "SATISFIED").otherwise("NOT_EVALUATED")), ("FRESHNESS", F.lit("SATISFIED"))]
    listed = F.array(*(F.struct(F.lit(name).alias("dimension"), state.alias("state")) for name, state in states))
    base = subjects.join(roles, subject, "left").select(subject, F.explode(listed).alias("x")).select(subject, "x.dimension", "x.state")
    over = overrides.select(subject, "dimension", F.col("state").alias("over"))
    return base.join(over, [subject, "dimension"], "full_outer").select(subject, "dimension", F.coalesce("over", "state").alias("state"))


def overall_state(states: Column) -> Column:
    """The state of a snapshot from the set of its dimensions' states."""
    has = lambda *names: F.arrays_overlap(states, F.array(*map(F.lit, names)))
    rungs = [
        ("BROKEN", has("BROKEN")), ("REVOKED", has("REVOKED")), ("DENIED", has("DENIED", "WITHDRAWN")), ("STALE", has("STALE")), ("REVIEW_REQUIRED", has("MISSING", "UNKNOWN")),
        ("TRUSTED_WITH_LIMITATIONS", has("SATISFIED_WITH_LIMITATIONS", "PARTIAL", "NOT_CHECKED", "NOT_EVALUATED")),
    ]
    return ladder(rungs, "TRUSTED_FOR_SCOPED_USE")


def snapshots(states: DataFrame, subject: str) -> DataFrame:
    """(subject, n_gaps, overall)."""
    gaps = F.col("state").isin("MISSING", "UNAVAILABLE", "NOT_CHECKED", "NOT_EVALUATED", "STALE", "REVOKED", "WITHDRAWN", "BROKEN")
    return states.groupBy(subject).agg(F.count_if(gaps).alias("n_gaps"), overall_state(F.collect_set("state")).alias("overall"))


def transitions(old: DataFrame, new: DataFrame, policies: DataFrame, subject: str) -> DataFrame:
    """(subject, n_changed, n_unchanged, outcome) between the states of two snapshots; policies (subject, changed_policy) outrank what changed.

    Only dimensions of the old snapshot are compared.
    """
    both = old.join(new.select(subject, "dimension", F.col("state").alias("now")), [subject, "dimension"], "left")
    changed = ~F.col("state").eqNullSafe(F.col("now"))
    to = lambda name: F.coalesce(F.bool_or(changed & (F.col("now") == name)), F.lit(False)).alias(name)
    sums = both.groupBy(subject).agg(F.count_if(changed).alias("n_changed"), F.count_if(~changed).alias("n_unchanged"), *map(to, ("REVOKED", "WITHDRAWN", "STALE")))
    overall = snapshots(old, subject).select(subject, F.col("overall").alias("before")).join(snapshots(new, subject).select(subject, F.col("overall").alias("after")), subject)
    joined = sums.join(overall, subject).join(policies, subject)
    rungs = [
        ("POLICY_RECLASSIFIED", F.col("changed_policy")), ("UNCHANGED", F.col("n_changed") == 0), ("REVOKED", F.col("REVOKED")), ("WITHDRAWN", F.col("WITHDRAWN")), ("STALE", F.col("STALE")),
        ("RESTORED_WITH_NEW_EVIDENCE", F.col("before").isin("DENIED", "STALE", "REVOKED") & F.col("after").isin("TRUSTED_WITH_LIMITATIONS", "TRUSTED_FOR_SCOPED_USE")), ("DENIED", F.col("after") == "DENIED"),
        ("LIMITED", F.col("after") == "REVIEW_REQUIRED"),
    ]
    return joined.select(subject, "n_changed", "n_unchanged", ladder(rungs, "STRENGTHENED").alias("outcome"))


def expiration(not_before: Column, not_after: Column, now: Column) -> Column:
    """The state of one window; a bound that is null is open."""
    rungs = [("NOT_EVALUATED", now.isNull()), ("NOT_YET_VALID", F.coalesce(now < not_before, F.lit(False))), ("EXPIRED", F.coalesce(now > not_after, F.lit(False)))]
    return ladder(rungs, "VALID")


def combined_expiration(states: Column) -> Column:
    """The state of several windows from the set of theirs."""
    return ladder([("UNAVAILABLE", F.size(states) == 0), *((s, F.array_contains(states, s)) for s in ("INVALID", "EXPIRED", "NOT_YET_VALID", "NOT_EVALUATED"))], "VALID")


def revocations(records: DataFrame, targets: DataFrame, key: Sequence[str], now: Column, accepted: Column) -> DataFrame:
    """(key, n_applicable, status) of targets (key) under records (key, reason, effective_at).

    A record that takes effect later revokes nothing yet; one with a time is not
    evaluated where there is no time of evaluation. Records that the policy does
    not accept do not apply.
    """
    later = F.when(F.col("effective_at").isNull(), "NOW").when(now.isNull(), "UNKNOWN").when(now < F.col("effective_at"), "LATER").otherwise("NOW")
    counted = accepted & (later != "LATER")
    own = records.groupBy(*key).agg(
        F.count_if(counted).alias("n_applicable"), F.bool_or(counted & (later == "UNKNOWN")).alias("unknown"),
        *(F.bool_or(counted & (F.col("reason") == reason)).alias(reason) for reason in ("SUPERSEDED", "WITHDRAWN")),
    )
    both = targets.join(own, list(key), "left").withColumn("n_applicable", F.coalesce("n_applicable", F.lit(0)))
    rungs = [("NOT_REVOKED", F.col("n_applicable") == 0), ("NOT_EVALUATED", F.col("unknown")), ("SUPERSEDED", F.col("SUPERSEDED")), ("WITHDRAWN", F.col("WITHDRAWN"))]
    return both.select(*key, "n_applicable", ladder(rungs, "REVOKED").alias("status"))


def renewals(records: DataFrame, chain: str) -> DataFrame:
    """(chain, n, status) of renewal records (chain, renewal_id, previous, new): BRANCHING, CYCLE or VALID.

    Observations are of one chain each. Cycles are looked for only where nothing
    branches, so each observation has one successor at most.
    """
    own = records.groupBy(chain).agg(F.count("*").alias("n"), ((F.countDistinct("renewal_id") < F.count("*")) | (F.countDistinct("previous") < F.count("*"))).alias("branching"))
    straight = records.join(own.where("not branching").select(chain), chain, "left_semi")
    follows = straight.select(F.col("previous").alias("node"), F.col("new").alias("next"))
    rings = ring_members(follows).withColumnRenamed("node", "previous")
    cyclic = straight.join(rings, "previous", "left_semi").select(chain, F.lit(True).alias("cyclic")).distinct()
    rungs = [("BRANCHING", F.col("branching")), ("CYCLE", F.coalesce("cyclic", F.lit(False)))]
    return own.join(cyclic, chain, "left").select(chain, "n", ladder(rungs, "VALID").alias("status"))


def bundle_state(schemas: Column, timelines_forked: Column, timelines_incomplete: Column, regulatory: Column, exclusions: Column, required: Sequence[str]) -> Column:
    """Whether a bundle of evidence is complete for its purpose, by the set of its members' schemas."""
    lacking = F.size(F.array_except(F.array(*map(F.lit, required)), schemas)) > 0
    rungs = [("FORKED_HISTORY", timelines_forked), ("PARTIAL", timelines_incomplete), ("MISSING_REQUIRED_MEMBER", lacking), ("PARTIAL", regulatory), ("COMPLETE_WITH_LIMITATIONS", exclusions)]
    return ladder(rungs, "COMPLETE_FOR_PURPOSE")


def subject_continuity(events: DataFrame, chain: str, sequence: str, start: str) -> DataFrame:
    """(chain, n, n_violations, status): whether a chain's events stay with its subject.

    The subject is the chain's ``start`` at first and changes only at a
    transformation: one input, which is the subject, and one output, which is
    another. Any other event has no outputs and no inputs but the subject.
    ``events`` have (chain, sequence, start, transforms, inputs, outputs).
    """
    before = Window.partitionBy(chain).orderBy(sequence).rowsBetween(Window.unboundedPreceding, -1)
    handed = F.when(F.col("transforms") & (F.size("outputs") == 1), F.element_at("outputs", 1))
    current = F.coalesce(F.last(handed, ignorenulls=True).over(before), F.col(start))
    turned = (F.size("inputs") == 1) & (F.size("outputs") == 1) & F.coalesce(F.element_at("inputs", 1) == F.col("current"), F.lit(False)) & F.coalesce(F.element_at("outputs", 1) != F.col("current"), F.lit(False))
    kept = (F.size("outputs") == 0) & F.forall("inputs", lambda x: x == F.col("current"))
    checked = events.withColumn("current", current).withColumn("fault", ~F.when(F.col("transforms"), turned).otherwise(kept))
    out = checked.groupBy(chain).agg(F.count("*").alias("n"), F.count_if("fault").alias("n_violations"))
    return out.withColumn("status", F.when(F.col("n_violations") > 0, "DIVERGED").otherwise("CONTINUOUS"))


def span_states(rows: DataFrame, key: str, states: Mapping[str, Column], otherwise: str) -> DataFrame:
    """(key, status): the first of ``states`` that any row of a key is in."""
    sums = rows.groupBy(key).agg(*(F.bool_or(condition).alias(name) for name, condition in states.items()))
    return sums.select(key, ladder([(name, F.col(name)) for name in states], otherwise).alias("status"))


def freshness_transitions(facts: DataFrame, subject: str, at: str, previous: tuple[str, int], new: tuple[str, int]) -> DataFrame:
    """(subject, previous, new, changed) of subjects under two contexts, each a time and for how many seconds evidence stays fresh.

    A state is TIME_UNKNOWN where no fact of a subject has a time, NOT_YET where all
    are later than the context, else FRESH or STALE by the last one before it. One
    aggregation does both contexts; a null subject is one like any other.
    """
    now = {name: F.lit(time).cast("timestamp") for name, (time, _) in (("previous", previous), ("new", new))}
    last = {f"last_{name}": F.max(F.when(F.col(at).cast("timestamp") <= t, F.unix_micros(F.col(at).cast("timestamp")))) for name, t in now.items()}
    sums = facts.groupBy(subject).agg(F.count(at).alias("n_times"), *(c.alias(n) for n, c in last.items()))
    state = lambda name, seconds: ladder([("TIME_UNKNOWN", F.col("n_times") == 0), ("NOT_YET", F.col(f"last_{name}").isNull()), ("FRESH", F.unix_micros(now[name]) - F.col(f"last_{name}") <= seconds * 1_000_000)], "STALE")
    both = sums.select(subject, state("previous", previous[1]).alias("previous"), state("new", new[1]).alias("new"))
    return both.withColumn("changed", F.col("previous") != F.col("new"))
