"""Attestations and provenance: what evidence links, what continues, how strong it is; twelve findings on a conversion and its lineage."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.compare import ladder, worked_out

#: Strengths of provenance, the weakest first.
STRENGTHS = ("NO_PROVENANCE", "DECLARED_PROVENANCE", "LOCATOR_PROVENANCE", "EVIDENCE_LINKED_PROVENANCE", "EXECUTION_LINKED_PROVENANCE", "ARTIFACT_SPECIFIC_PROVENANCE", "BROKEN_PROVENANCE")


def linkage(references: Column) -> Column:
    """How an array of references (mode, included) links evidence."""
    full = F.forall(references, lambda r: (r["mode"] == "FULL") & r["included"])
    digests = F.forall(references, lambda r: r["mode"] == "DIGEST_ONLY")
    return ladder([("UNAVAILABLE", F.size(references) == 0), ("FULLY_VERIFIED", full), ("DIGEST_LINKED", digests)], "PARTIAL")


def continuity(kind: Column, inputs: Column, outputs: Column, subject: Column) -> Column:
    """Whether artifacts (id, content, set_digest) go through an attested step unbroken.

    A transfer keeps each; an acquisition has one of each with a stable digest;
    anything else makes its subject, the first output, out of other inputs.
    """
    first = lambda xs, f: F.try_element_at(xs, F.lit(1))[f]
    pairs = F.forall(F.zip_with(inputs, outputs, lambda a, b: a["id"].eqNullSafe(b["id"])), lambda x: x)
    one = (F.size(inputs) == 1) & (F.size(outputs) == 1)
    stable = F.coalesce(first(inputs, "content") == first(outputs, "content"), F.lit(False)) | F.coalesce(first(inputs, "set_digest") == first(outputs, "set_digest"), F.lit(False))
    return (
        F.when(kind == "TRANSFER", F.when((F.size(inputs) == F.size(outputs)) & pairs, "VALID").otherwise("DIVERGED"))
        .when(kind == "ACQUISITION", F.when(~one, "INVALID").when(stable, "VALID").otherwise("INCOMPLETE"))
        .when((F.size(inputs) == 0) | (F.size(outputs) == 0), "INVALID")
        .when(first(outputs, "id") != subject, "DIVERGED").when(F.exists(inputs, lambda x: x["id"] == subject), "DIVERGED").otherwise("VALID")
    )


def execution(origin: Column, succeeded: Column, linked: Column, same: Sequence[tuple[Column, Column]]) -> Column:
    """NOT_APPLICABLE unless an execution is claimed, FAILED if it did not succeed, UNMET if its evidence or any declared field differs from the record, else VERIFIED."""
    alike = linked == "FULLY_VERIFIED"
    for declared, recorded in same:
        alike = alike & declared.eqNullSafe(recorded)
    return ladder([("NOT_APPLICABLE", origin != "VERIFIED_EXECUTION_RECORD"), ("FAILED", ~F.coalesce(succeeded, F.lit(False))), ("UNMET", ~alike)], "VERIFIED")


def authenticity(origin: Column, linked: Column, executed: Column, observed: Column) -> Column:
    """How authentic an assertion is by its origin; UNMET where the origin requires what is not there."""
    full = linked == "FULLY_VERIFIED"
    return (
        F.when(origin == "USER_DECLARED", "DECLARED").when(origin == "SYSTEM_OBSERVED", F.when(observed, "SYSTEM_OBSERVED").otherwise("UNMET"))
        .when(origin == "DERIVED_FROM_VERIFIED_EVIDENCE", F.when(full, "EVIDENCE_LINKED").otherwise("UNMET")).when(origin == "VERIFIED_EXECUTION_RECORD", F.when(executed == "VERIFIED", "EXECUTION_VERIFIED").otherwise("UNMET"))
        .when(origin == "IMPORTED_ATTESTATION", F.when(full, "EVIDENCE_LINKED").otherwise("UNVERIFIED")).otherwise("UNMET")
    )


def strength(authentic: Column, executed: Column, continues: Column, n_outputs: Column, located: Column) -> Column:
    rungs = [
        ("BROKEN_PROVENANCE", continues.isin("DIVERGED", "INVALID")), ("DECLARED_PROVENANCE", authentic == "DECLARED"), ("EVIDENCE_LINKED_PROVENANCE", authentic == "EVIDENCE_LINKED"),
        ("ARTIFACT_SPECIFIC_PROVENANCE", (executed == "VERIFIED") & (continues == "VALID") & (n_outputs > 0)), ("EXECUTION_LINKED_PROVENANCE", executed == "VERIFIED"), ("LOCATOR_PROVENANCE", located),
    ]
    return ladder(rungs, "NO_PROVENANCE")


def summary(attestations: DataFrame, subject: str) -> DataFrame:
    """(subject, kind states, strength) of attestations (subject, kind, authenticity, strength): a kind is as good as its best attestation, the strength is the highest."""
    best = lambda kind: ladder([(s, F.coalesce(F.bool_or((F.col("kind") == kind) & (F.col("authenticity") == a)), F.lit(False))) for s, a in (("EXECUTION_VERIFIED", "EXECUTION_VERIFIED"), ("EVIDENCE_LINKED", "EVIDENCE_LINKED"), ("DECLARED", "DECLARED"))], "UNAVAILABLE")
    rank = F.array_position(F.array(*map(F.lit, STRENGTHS)), F.col("strength"))
    kinds = ("ACQUISITION", "TRANSFER", "TRANSFORMATION", "QUANTIZATION")
    out = attestations.groupBy(subject).agg(*(best(k).alias(k.lower()) for k in kinds), F.max(rank).cast("int").alias("top"))
    return out.select(subject, *(k.lower() for k in kinds), F.coalesce(F.try_element_at(F.array(*map(F.lit, STRENGTHS)), F.greatest(F.lit(1), "top")), F.lit("NO_PROVENANCE")).alias("strength"))


#: What a report on gaps asks for, and from which strength on it is there.
GAPS = ("ACQUISITION", "TRANSFER", "TRANSFORMATION", "QUANTIZATION", "EXECUTION", "LOCATOR", "PROVENANCE")


def gaps(attestations: DataFrame, subjects: DataFrame, subject: str) -> DataFrame:
    """(subject, kind, status, n_attestations, linked) of every kind of ``GAPS`` for every one of ``subjects``: UNAVAILABLE without an attestation, DECLARED by unverified ones alone, else AVAILABLE.

    A kind of attestation is available if its evidence is linked or its execution
    verified; an execution, a locator and a provenance of an artifact are those of
    any attestation. A subject without attestations lacks all; what an attestation is
    not about says nothing.
    """
    verified = F.col("authenticity").isin("EXECUTION_VERIFIED", "EVIDENCE_LINKED")
    said = lambda kind, there, good: F.when(there, F.struct(F.lit(kind).alias("gap"), good.alias("good")) if isinstance(kind, str) else F.struct(kind.alias("gap"), good.alias("good")))
    listed = F.array_compact(F.array(
        said(F.col("kind"), F.col("kind").isin(*GAPS), verified), said("EXECUTION", F.col("execution") != "NOT_APPLICABLE", F.col("authenticity") == "EXECUTION_VERIFIED"),
        said("LOCATOR", F.lit(True), F.coalesce("located", F.lit(False))), said("PROVENANCE", F.col("continuity") == "VALID", verified),
    ))
    held = attestations.select(subject, F.explode(listed).alias("x")).groupBy(subject, "x.gap").agg(F.count("*").alias("n_attestations"), F.count_if("x.good").alias("linked"))
    asked = subjects.select(subject).distinct().select(subject, F.explode(F.array(*map(F.lit, GAPS))).alias("gap"))
    both = asked.join(held, [subject, "gap"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_attestations", "linked")})
    return both.select(subject, F.col("gap").alias("kind"), ladder([("AVAILABLE", F.col("linked") > 0), ("DECLARED", F.col("n_attestations") > 0)], "UNAVAILABLE").alias("status"), "n_attestations", "linked")


def conversion_findings(conversions: DataFrame, artifacts: DataFrame, key: str, equalities: Mapping[str, Sequence[tuple[str, str]]]) -> DataFrame:
    """(key, rule, status) for each of twelve rules on conversions.

    Conversions have (key, conflict, pinned, full_digests, tool_conflict,
    tool_pinned, executable, n_arguments, output_named, success, exit_code,
    consistent) and the columns that ``equalities`` compares for the rules 003,
    004, 005, 010 and 011; artifacts (key, side, done, declared, size, digest,
    seen_size, seen_digest) are those of either side, ``declared`` if the process
    names their role, with null for what was not seen. The last rule sums up the
    lineage.
    """
    seen = F.col("seen_digest").isNotNull()
    off = seen & (~F.col("size").eqNullSafe(F.col("seen_size")) | ~F.col("digest").eqNullSafe(F.col("seen_digest")))
    of = lambda side, c: F.coalesce(F.bool_or((F.col("side") == side) & c), F.lit(False))
    sums = artifacts.groupBy(F.col(key).alias("of_key")).agg(
        of("source", off).alias("source_off"), of("source", ~seen).alias("source_open"), of("target", off).alias("target_off"), of("target", ~seen).alias("target_open"), of("target", F.col("done")).alias("any_done"),
        of("target", ~F.col("done")).alias("any_open"), of("target", ~F.col("declared")).alias("undeclared"),
    )
    both = conversions.join(sums, F.col(key) == F.col("of_key"), "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("source_off", "source_open", "target_off", "target_open", "any_done", "any_open", "undeclared")})
    three = lambda fail, ok: F.when(fail, "FAIL").when(ok, "PASS").otherwise("WARN")
    two = lambda bad: F.when(bad, "FAIL").otherwise("PASS")

    def differs(rule: str) -> Column:
        out = F.lit(False)
        for a, b in equalities.get(rule, ()):
            out = out | ~F.col(a).eqNullSafe(F.col(b))
        return out

    contradictory = (F.col("success") != (F.col("exit_code") == 0)) | (~F.col("success") & F.col("any_done")) | (F.col("success") & F.col("any_open")) | F.col("undeclared")
    statuses = {
        "PROV-001": three(F.col("conflict"), F.col("pinned") | F.col("full_digests")), "PROV-002": three(F.col("source_off"), ~F.col("source_open")), "PROV-003": two(differs("PROV-003")), "PROV-004": two(differs("PROV-004")), "PROV-005": two(differs("PROV-005")),
        "PROV-006": three(F.col("tool_conflict"), F.col("tool_pinned")), "PROV-007": two(~F.col("executable") | (F.col("n_arguments") == 0) | ~F.col("output_named")), "PROV-008": two(contradictory),
        "PROV-009": three(F.col("target_off"), ~F.col("target_open")), "PROV-010": two(differs("PROV-010")), "PROV-011": two(differs("PROV-011") | ~F.col("consistent") | F.col("undeclared")),
    }
    wide = both.select(key, "success", *(c.alias(name) for name, c in statuses.items()))
    failed = F.exists(F.array(*(F.col(f"`{r}`") for r in statuses)), lambda s: s == "FAIL")
    exact = F.col("success")
    for r in ("PROV-001", "PROV-003", "PROV-005", "PROV-006", "PROV-009", "PROV-010"):
        exact = exact & (F.col(f"`{r}`") == "PASS")
    wide = wide.withColumn("PROV-012", three(failed, exact))
    return wide.select(key, F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(f"`{r}`").alias("status")) for r in (*statuses, "PROV-012")))).alias("x")).select(key, "x.rule", "x.status")


def segments(attestations: DataFrame, key: str, record: Sequence[str], event_type: str, concepts: str, profile: str, profiles: Mapping[str, tuple[Sequence[str], Sequence[str]]]) -> DataFrame:
    """(key, chain_id, event_digest, ledger_digest, missing, status) of the segment of custody that each attestation begins.

    A segment has one event, the attestation's, without a predecessor: its digest is
    that of the canonical record of ``record``, the chain and the event's type; the
    ledger's digest is that of chain, event, profile and status. A profile names the
    event types and the evidence concepts that it needs; ``missing`` has those that the
    attestation lacks, as type:name and concept:name in order. The status is INTACT,
    INCOMPLETE, or UNKNOWN_PROFILE where no profile has that name. Null concepts are none.
    """
    canonical = lambda **c: F.to_json(F.struct(*(v.alias(n) for n, v in sorted(c.items()))), {"ignoreNullFields": "false"})
    wants = None
    for name, (types, held) in profiles.items():
        listed = [F.struct(F.lit(f"type:{t}").alias("want"), F.coalesce(F.col(event_type) == t, F.lit(False)).alias("there")) for t in types]
        listed += [F.struct(F.lit(f"concept:{c}").alias("want"), F.coalesce(F.array_contains(concepts, c), F.lit(False)).alias("there")) for c in held]
        lacks = F.transform(F.filter(F.array(*listed), lambda w: ~w["there"]), lambda w: w["want"]) if listed else F.array().cast("array<string>")
        wants = F.when(F.col(profile) == name, F.array_sort(lacks)) if wants is None else wants.when(F.col(profile) == name, F.array_sort(lacks))
    chain = F.concat(F.lit("custody_segment_"), F.left(F.sha2(canonical(**{c: F.col(c) for c in record}), 256), F.lit(32)))
    begun = worked_out(attestations, seg_missing=wants, seg_chain=chain)
    status = F.when(F.col("seg_missing").isNull(), "UNKNOWN_PROFILE").when(F.size("seg_missing") > 0, "INCOMPLETE").otherwise("INTACT")
    event = F.sha2(canonical(**{c: F.col(c) for c in record}, chain_id=F.col("seg_chain"), event_type=F.col(event_type), previous=F.lit(None).cast("string"), sequence=F.lit(0)), 256)
    known = worked_out(begun, seg_status=status, seg_event=event)
    ledger = F.sha2(canonical(chain_id=F.col("seg_chain"), latest=F.col("seg_event"), profile=F.col(profile), status=F.col("seg_status")), 256)
    return known.select(key, F.col("seg_chain").alias("chain_id"), F.col("seg_event").alias("event_digest"), ledger.alias("ledger_digest"), F.col("seg_missing").alias("missing"), F.col("seg_status").alias("status"))
