"""Comparison of two structures by name: sets, shapes, types under policies, metadata under rules, encoded sizes, and profiles over the outcome."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.values import greatest_common_divisor
from ledgerloom.operators.compare import glob_pattern, ladder
from ledgerloom.operators.evidence import examples


def set_difference(source: DataFrame, target: DataFrame, name: str, cap: int) -> DataFrame:
    """(side, n, examples) for the sides ``missing`` (not in the target) and ``unexpected``; a side without any has no row. Null names are none."""
    tagged = source.select(name, F.lit(1).alias("s"), F.lit(0).alias("t")).union(target.select(name, F.lit(0), F.lit(1))).where(F.col(name).isNotNull())
    alone = tagged.groupBy(name).agg(F.max("s").alias("s"), F.max("t").alias("t")).where("s <> t")
    return examples(alone.select(F.when(F.col("s") == 1, "missing").otherwise("unexpected").alias("side"), name), "side", name, cap)


def changed_groups(source: DataFrame, target: DataFrame, name: str, value: str, cap: int) -> DataFrame:
    """(source, target, n, examples): how the values of names that both sides have changed, with the smallest names of each change."""
    both = source.select(name, F.col(value).alias("source")).join(target.select(name, F.col(value).alias("target")), name)
    changed = both.where(~F.col("source").eqNullSafe(F.col("target"))).select(F.struct("source", "target").alias("change"), name)
    return examples(changed, "change", name, cap).select("change.source", "change.target", "n", "examples")


def type_transitions(source: DataFrame, target: DataFrame, rules: Sequence[tuple[str, str, str]], name: str, kind: str, cap: int) -> DataFrame:
    """(source_type, target_type, selectors, accepted, n, examples) of names that both sides have, under rules (source type, target type, glob of names).

    All selectors that match are given, in order and joined by ``|``; a name that
    none matches is rejected. Rules meet the rows by their types; the glob is
    what is left to test. An unchanged type needs a rule, too.
    """
    spark = source.sparkSession
    listed = spark.createDataFrame([(*r, glob_pattern(r[2])) for r in rules], "r_source string, r_target string, selector string, pattern string")
    both = source.select(name, F.col(kind).alias("source_type")).join(target.select(name, F.col(kind).alias("target_type")), name)
    ruled = both.join(listed, (F.col("source_type") == F.col("r_source")) & (F.col("target_type") == F.col("r_target")) & F.rlike(name, F.col("pattern")), "left")
    matched = ruled.groupBy(name, "source_type", "target_type").agg(F.array_join(F.array_sort(F.collect_set("selector")), "|").alias("selectors"))
    groups = examples(matched.select(F.struct("source_type", "target_type", "selectors").alias("transition"), name), "transition", name, cap)
    return groups.select("transition.*", (F.col("transition.selectors") != "").alias("accepted"), "n", "examples")


def compared_by_group(source: DataFrame, target: DataFrame, rules: Sequence[tuple[str, str, str]], group: str, name: str) -> DataFrame:
    """(group, n, n_missing, n_unexpected, n_shape, n_rejected, n_changed, n_size, n_grown, result) of two inventories (name, group, type, physical, size), group by group.

    Identities, shapes, types under rules and sizes are each compared by name, and
    the result follows from what these found: equivalent, with or without other
    types, where nothing lacks, no shape differs and every change of type is ruled;
    else DIFFERENT, or INCOMPARABLE where a name is twice on a side. A name's group is
    the source's, or the target's if it has no other.
    """
    listed = source.sparkSession.createDataFrame([(*r, glob_pattern(r[2])) for r in rules], "r_source string, r_target string, selector string, pattern string")
    side = lambda df, letter: df.groupBy(name).agg(F.count("*").alias(f"{letter}_n"), *(F.min(c).alias(f"{letter}_{c}") for c in (group, "type", "physical", "size"))).withColumnRenamed(name, f"{letter}_name")
    both = side(source, "s").join(side(target, "t"), F.col("s_name") == F.col("t_name"), "full_outer")
    pairs = both.where("s_name IS NOT NULL AND t_name IS NOT NULL").select("s_name", "s_type", "t_type")
    ruled = pairs.join(listed, (F.col("s_type") == F.col("r_source")) & (F.col("t_type") == F.col("r_target")) & F.rlike("s_name", F.col("pattern"))).select(F.col("s_name").alias("ruled")).distinct()
    told = both.join(ruled, F.col("s_name") == F.col("ruled"), "left")
    here = F.col("s_name").isNotNull() & F.col("t_name").isNotNull()
    off = lambda c: here & ~F.col(f"s_{c}").eqNullSafe(F.col(f"t_{c}"))
    sums = told.groupBy(F.coalesce(f"s_{group}", f"t_{group}").alias(group)).agg(
        F.count("*").alias("n"), F.count_if(F.col("t_name").isNull()).alias("n_missing"), F.count_if(F.col("s_name").isNull()).alias("n_unexpected"), F.count_if(off("physical")).alias("n_shape"), F.count_if(here & F.col("ruled").isNull()).alias("n_rejected"),
        F.count_if(off("type")).alias("n_changed"), F.count_if(off("size")).alias("n_size"), F.count_if(here & (F.col("t_size") > F.col("s_size"))).alias("n_grown"), F.bool_or((F.col("s_n") > 1) | (F.col("t_n") > 1)).alias("twice"),
    )
    agrees = (F.col("n_missing") + F.col("n_unexpected") == 0) & (F.col("n_shape") == 0) & (F.col("n_rejected") == 0)
    rungs = [("INCOMPARABLE", F.coalesce("twice", F.lit(False))), ("EQUIVALENCE_WITH_QUANTIZATION_DIFFERENCES", agrees & (F.col("n_changed") > 0)), ("EQUIVALENCE_WITH_LIMITATIONS", agrees & (F.col("n_size") > 0)), ("EQUIVALENCE", agrees)]
    return sums.withColumn("result", ladder(rungs, "DIFFERENT")).drop("twice")


def ruled_metadata(source: DataFrame, target: DataFrame, rules: Mapping[str, str], otherwise: str, skipped: Sequence[str] = ()) -> DataFrame:
    """(key, outcome) of keys (key, value) that differ: ignored, allowed, warning or failure, by the key's own rule or else by ``otherwise`` (warn, fail or ignore)."""
    s, t = source.select("key", F.col("value").alias("s_value"), F.lit(True).alias("s_has")), target.select("key", F.col("value").alias("t_value"), F.lit(True).alias("t_has"))
    both = s.join(t, "key", "full_outer").where(~F.col("key").isin(*skipped) if skipped else F.lit(True))
    differs = both.where(~(F.col("s_has").eqNullSafe(F.col("t_has")) & F.col("s_value").eqNullSafe(F.col("t_value"))))
    action = F.create_map(*(F.lit(x) for pair in rules.items() for x in pair))[F.col("key")] if rules else F.lit(None).cast("string")
    rungs = [("ignored", action == "ignore"), ("allowed", action == "allow"), ("failure", action == "require_equal"), ("warning", action == "warn")]
    return differs.select("key", ladder(rungs, {"warn": "warning", "fail": "failure"}.get(otherwise, "ignored")).alias("outcome"))


def metadata_verdict(outcomes: DataFrame) -> DataFrame:
    """(n_allowed, n_warnings, n_failures, n_ignored, status) of all keys that differ."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    counts = outcomes.agg(n("allowed").alias("n_allowed"), n("warning").alias("n_warnings"), n("failure").alias("n_failures"), n("ignored").alias("n_ignored"))
    return counts.withColumn("status", ladder([("FAIL", F.col("n_failures") > 0), ("WARN", F.col("n_warnings") > 0)], "PASS"))


def metadata_statuses(baseline: DataFrame, candidate: DataFrame, category: Column) -> DataFrame:
    """(key, category, status) of all keys (key, digest); differences are unexpected, informational or allowed by category."""
    both = baseline.select("key", F.col("digest").alias("b_digest"), F.lit(True).alias("b")).join(candidate.select("key", F.col("digest").alias("c_digest"), F.lit(True).alias("c")), "key", "full_outer").withColumn("category", category)
    rungs = [
        ("MISSING_BASELINE", F.col("b").isNull()), ("MISSING_CANDIDATE", F.col("c").isNull()), ("EQUAL", F.col("b_digest").eqNullSafe(F.col("c_digest"))),
        ("DIFFERENT_UNEXPECTED", F.col("category") == "required_equal"), ("INFORMATIONAL", F.col("category") == "informational"),
    ]
    return both.select("key", "category", ladder(rungs, "DIFFERENT_ALLOWED").alias("status"))


def shape_class(left_physical: Column, right_physical: Column, left: Column, right: Column) -> Column:
    """How two shapes agree: physically, only when normalised, or not."""
    unknown = (F.size(left) <= 0) | (F.size(right) <= 0) | left.isNull() | right.isNull()
    return ladder([("UNAVAILABLE", unknown), ("PHYSICAL_EQUAL", (left == right) & (left_physical == right_physical)), ("PHYSICAL_DIFFERENT_LOGICAL_EQUAL", left == right)], "INCOMPATIBLE")


def transition_state(family: Column, candidate_family: Column, sensitive: Column, left: Column, right: Column, allowed: Sequence[str], family_allowed: Mapping[str, Sequence[str]]) -> Column:
    """A struct (state, allowed, rule): what a change of type means under a policy of quantised types, some allowed for one family only."""
    own = F.create_map(*(x for f, types in family_allowed.items() for x in (F.lit(f), F.array(*map(F.lit, types)))))[candidate_family] if family_allowed else F.lit(None).cast("array<string>")
    in_family = F.coalesce(F.array_contains(own, right), F.lit(False))
    made = lambda state, ok, rule: F.struct(F.lit(state).alias("state"), F.lit(ok).alias("allowed"), (rule if isinstance(rule, Column) else F.lit(rule)).alias("rule"))
    return (
        F.when((family == "<unclassified>") | (candidate_family == "<unclassified>"), made("INCOMPARABLE", False, "classified_family_required"))
        .when(sensitive & (left == "F32") & (right == "F32"), made("KEPT_UNQUANTIZED", True, "sensitive_f32_unchanged"))
        .when(sensitive, made("UNSUPPORTED", False, "sensitive_f32_unchanged"))
        .when(left == right, made("UNCHANGED", True, "quantized_matrix_unchanged"))
        .when(right == "F32", made("UNEXPECTED_UNQUANTIZED", False, "quantized_matrix_change_only"))
        .when(~right.isin(*allowed) & ~in_family, made("UNSUPPORTED", False, "known_quantized_target_type"))
        .when(in_family, made("QUANTIZATION_FAMILY_CHANGED", True, F.concat(F.lit("family_target_type_allowlist:"), candidate_family)))
        .otherwise(made("QUANTIZATION_FAMILY_CHANGED", True, "family_aware_quantized_matrix_change"))
    )


def encoded_sizes(baseline: DataFrame, candidate: DataFrame, family: str, size: str) -> DataFrame:
    """(family, baseline_bytes, candidate_bytes, numerator, denominator): sums by family and, with a null family, of all, with the ratio in lowest terms; a baseline of 0 counts as 1."""
    tagged = baseline.select(family, F.coalesce(size, F.lit(0)).alias("b"), F.lit(0).alias("c")).union(candidate.select(family, F.lit(0), F.coalesce(size, F.lit(0))))
    sums = tagged.groupBy(family).agg(F.sum("b").cast("long").alias("baseline_bytes"), F.sum("c").cast("long").alias("candidate_bytes"))
    whole = sums.agg(F.lit(None).cast("string").alias(family), F.coalesce(F.sum("baseline_bytes"), F.lit(0)).alias("baseline_bytes"), F.coalesce(F.sum("candidate_bytes"), F.lit(0)).alias("candidate_bytes"))
    below = F.when(F.col("baseline_bytes") == 0, F.lit(1).cast("long")).otherwise(F.col("baseline_bytes"))
    ratio = sums.union(whole).withColumn("below", below).withColumn("g", greatest_common_divisor(F.col("candidate_bytes"), F.col("below")))
    return ratio.select(family, "baseline_bytes", "candidate_bytes", F.expr("candidate_bytes div g").alias("numerator"), F.expr("below div g").alias("denominator"))


def ontology_equality(left: DataFrame, right: DataFrame, key: str, family: str, count: str, layers: str, shape: str) -> DataFrame:
    """(key, family_set_equal, coverage_equal, shapes_equal): families of two ontologies of each key; the others are judged only where the sets are equal."""
    l_ = left.select(key, family, *(F.col(c).alias(f"l_{c}") for c in (count, layers, shape)), F.lit(True).alias("l_has"))
    r_ = right.select(key, family, *(F.col(c).alias(f"r_{c}") for c in (count, layers, shape)), F.lit(True).alias("r_has"))
    both = l_.join(r_, [key, family], "full_outer")
    same = lambda *c: F.bool_and(F.col(f"l_{c[0]}").eqNullSafe(F.col(f"r_{c[0]}")) if len(c) == 1 else F.col(f"l_{c[0]}").eqNullSafe(F.col(f"r_{c[0]}")) & F.col(f"l_{c[1]}").eqNullSafe(F.col(f"r_{c[1]}")))
    sums = both.groupBy(key).agg(F.bool_and(F.col("l_has").isNotNull() & F.col("r_has").isNotNull()).alias("family_set_equal"), same(count, layers).alias("coverage"), same(shape).alias("shapes"))
    return sums.select(key, "family_set_equal", (F.col("family_set_equal") & F.col("coverage")).alias("coverage_equal"), (F.col("family_set_equal") & F.col("shapes")).alias("shapes_equal"))


def profile_results(controls: DataFrame, profiles: Mapping[str, tuple[Sequence[str], Sequence[str]]], subject: str) -> DataFrame:
    """(subject, profile, failed, n_warnings, outcome): controls (subject, control, ok) under profiles (required, warning); a control that is not there counts as false."""
    good = controls.groupBy(subject).agg(F.collect_set(F.when(F.col("ok"), F.col("control"))).alias("good"))
    texts = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    asked = F.explode(F.array(*(F.struct(F.lit(p).alias("profile"), texts(need).alias("need"), texts(warn).alias("warn")) for p, (need, warn) in profiles.items())))
    own = good.select(subject, "good", asked.alias("x")).withColumn("failed", F.array_sort(F.array_except("x.need", "good"))).withColumn("n_warnings", F.size(F.array_except("x.warn", "good")).cast("long"))
    outcome = ladder([("NOT_SATISFIED", F.size("failed") > 0), ("SATISFIED_WITH_WARNINGS", F.col("n_warnings") > 0)], "SATISFIED")
    return own.select(subject, "x.profile", F.array_join("failed", ",").alias("failed"), "n_warnings", outcome.alias("outcome"))


#: By requirement, the statuses of a stage that satisfy it, and those of them that warn.
ACCEPTANCE = {
    "REQUIRED_PASS": (("PASS",), ()),
    "REQUIRED_CHECKED": (("PASS", "AVAILABLE"), ()),
    "ALLOWED_UNAVAILABLE": (("PASS", "AVAILABLE", "WARN", "UNAVAILABLE"), ("WARN", "UNAVAILABLE")),
    "ALLOWED_WARN": (("PASS", "AVAILABLE", "WARN", "UNAVAILABLE", "NOT_CHECKED"), ("WARN", "UNAVAILABLE", "NOT_CHECKED")),
    "NOT_REQUIRED": (("PASS", "AVAILABLE", "WARN", "UNAVAILABLE", "NOT_CHECKED", "FAIL"), ()),
}


def acceptance(stages: DataFrame, requirements: Mapping[str, Mapping[str, str]], subject: str) -> DataFrame:
    """(subject, profile, n_failed, n_warnings, outcome): stages (subject, stage, status) under each profile's requirement of a stage. One row of a stage meets one requirement a profile, so nothing multiplies."""
    table = [(p, s, list(ACCEPTANCE[r][0]), list(ACCEPTANCE[r][1])) for p, own in requirements.items() for s, r in own.items()]
    asked = F.explode(F.array(*(F.struct(F.lit(p).alias("profile"), F.lit(s).alias("stage"), F.array(*map(F.lit, ok)).alias("ok"), F.array(*map(F.lit, warn)).cast("array<string>").alias("warn")) for p, s, ok, warn in table)))
    held = stages.groupBy(subject).agg(F.map_from_entries(F.collect_list(F.struct("stage", "status"))).alias("held"))
    own = held.select(subject, "held", asked.alias("x")).withColumn("status", F.coalesce(F.col("held")[F.col("x.stage")], F.lit("NOT_CHECKED")))
    sums = own.groupBy(subject, "x.profile").agg(F.count_if(~F.array_contains("x.ok", F.col("status"))).alias("n_failed"), F.count_if(F.array_contains("x.warn", F.col("status"))).alias("n_warnings"))
    return sums.withColumn("outcome", ladder([("NOT_SATISFIED", F.col("n_failed") > 0), ("SATISFIED_WITH_WARNINGS", F.col("n_warnings") > 0)], "SATISFIED"))


def required_events(observed: DataFrame, profiles: Mapping[str, tuple[Sequence[str], Sequence[str]]], subject: str, kind: str) -> DataFrame:
    """(subject, profile, missing, status): kinds that each profile (required, any of) lacks; a group of which none is there is missing as a whole."""
    held = observed.groupBy(subject).agg(F.collect_set(kind).alias("held"))
    texts = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    asked = F.explode(F.array(*(F.struct(F.lit(p).alias("profile"), texts(need).alias("need"), texts(some).alias("some")) for p, (need, some) in profiles.items())))
    own = held.select(subject, "held", asked.alias("x"))
    none = (F.size("x.some") > 0) & ~F.arrays_overlap("x.some", "held")
    missing = F.array_sort(F.concat(F.array_except("x.need", "held"), F.when(none, F.col("x.some")).otherwise(F.array().cast("array<string>"))))
    return own.withColumn("missing", missing).select(subject, "x.profile", F.array_join("missing", ",").alias("missing"), F.when(F.size("missing") > 0, "INCOMPLETE").otherwise("COMPLETE").alias("status"))


def usage(statuses: DataFrame, profiles: Mapping[str, tuple[Sequence[str], Sequence[str], str]], subject: str) -> DataFrame:
    """(subject, profile, unmet, outcome): statuses (subject, stage, status) under profiles (required stages, review stages, outcome where one is unmet)."""
    passed = statuses.groupBy(subject).agg(F.collect_set(F.when(F.col("status") == "PASS", F.col("stage"))).alias("passed"))
    texts = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    asked = F.explode(F.array(*(F.struct(F.lit(p).alias("profile"), texts(need).alias("need"), texts(review).alias("review"), F.lit(lack).alias("lack")) for p, (need, review, lack) in profiles.items())))
    own = passed.select(subject, "passed", asked.alias("x"))
    unmet, open_ = F.array_sort(F.array_except("x.need", "passed")), F.size(F.array_except("x.review", "passed")) > 0
    outcome = F.when(F.size(unmet) > 0, F.col("x.lack")).when(open_, "REVIEW_REQUIRED").otherwise("SUITABLE_WITH_LIMITATIONS")
    return own.select(subject, "x.profile", F.array_join(unmet, ",").alias("unmet"), outcome.alias("outcome"))
