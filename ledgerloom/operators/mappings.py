"""Inventories of named members: ordered classification with captures, groups of many to one, coverage and claims in both directions."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.compare import ladder
from ledgerloom.operators.evidence import examples


def classified(names: DataFrame, name: str, rules: Sequence[tuple[str, str, Mapping[str, int]]], captures: Mapping[str, str]) -> DataFrame:
    """``names`` with ``class``, the first rule (class, pattern, capture: group) that is found, or ``unclassified``, and the ``captures`` (name: type) of that rule, null where it has none."""
    found = lambda p: F.coalesce(F.col(name).rlike(p), F.lit(False))
    kind = ladder([(k, found(p)) for k, p, _ in rules], "unclassified")
    out = names.withColumn("class", kind)
    for capture, cast in captures.items():
        value = F.lit(None).cast("string")
        for k, p, groups in reversed(rules):
            if capture in groups:
                value = F.when(F.col("class") == k, F.regexp_extract(name, p, groups[capture])).otherwise(value)
        out = out.withColumn(capture, F.nullif(value, F.lit("")).cast(cast))
    return out


def marker_kind(markers: Column, families: Mapping[str, Sequence[str]]) -> Column:
    """The family whose whole set of markers is there: CONFLICT where several families have any, UNKNOWN where one has a part, NONE where none has any."""
    own = {k: F.array(*map(F.lit, m)) for k, m in families.items()}
    seen = sum((F.arrays_overlap(markers, m).cast("int") for m in own.values()), F.lit(0))
    whole = [(k, F.size(F.array_except(m, markers)) == 0) for k, m in own.items()]
    return ladder([("NONE", seen == 0), ("CONFLICT", seen > 1), *whole], "UNKNOWN")


def evidence_kind(markers: Column, families: Mapping[str, Sequence[str]]) -> Column:
    """The family of which any marker is there; BOTH where several have, NONE where none has."""
    any_of = {k: F.arrays_overlap(markers, F.array(*map(F.lit, m))) for k, m in families.items()}
    seen = sum((x.cast("int") for x in any_of.values()), F.lit(0))
    return ladder([("NONE", seen == 0), ("BOTH", seen > 1), *any_of.items()], "NONE")


def set_groups(members: DataFrame, group: str, member: str) -> DataFrame:
    """(members, n_groups, first, last, contiguous): groups by the set of their members; one row means unanimity."""
    sets = members.groupBy(group).agg(F.array_sort(F.collect_set(member)).alias("members"))
    out = sets.groupBy("members").agg(F.count("*").alias("n_groups"))
    first, last = F.element_at("members", 1), F.element_at("members", -1)
    return out.select("members", "n_groups", first.alias("first"), last.alias("last"), (last - first + 1 == F.size("members")).alias("contiguous"))


def component_coverage(observed: DataFrame, expected: DataFrame, group: str, component: str) -> DataFrame:
    """(group, missing, unexpected): components of each expected group (group, components) that lack, and those that are there beyond; a group that was not expected has only the latter."""
    held = observed.groupBy(group).agg(F.collect_set(component).alias("held"))
    both = expected.join(held, group, "full_outer").withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("components", "held")})
    said = lambda x: F.array_join(F.array_sort(x), ",")
    return both.select(group, said(F.array_except("components", "held")).alias("missing"), said(F.array_except("held", "components")).alias("unexpected"))


def findings(parts: Sequence[tuple[str, DataFrame, Column]], warns: Sequence[str] = ()) -> DataFrame:
    """(ordinal, rule, n_bad, status): one row a rule over its table, by the condition of a bad row; rules of ``warns`` warn instead of failing."""
    rows = None
    for k, (rule, df, bad) in enumerate(parts):
        n = df.agg(F.count_if(bad).alias("n_bad"))
        own = n.select(F.lit(k + 1).alias("ordinal"), F.lit(rule).alias("rule"), "n_bad", F.when(F.col("n_bad") == 0, "PASS").otherwise("WARN" if rule in warns else "FAIL").alias("status"))
        rows = own if rows is None else rows.union(own)
    return rows


def bindings(rules: DataFrame) -> DataFrame:
    """(rule_id, layer, binding, source, target, kind): rules (rule_id, source, target, kind, lo, hi) expanded over their layers; ``{layer}`` is replaced in both patterns. A rule without a range is one binding."""
    layers = F.when(F.col("lo").isNull(), F.array(F.lit(None).cast("int"))).otherwise(F.sequence("lo", "hi"))
    own = rules.withColumn("layer", F.explode(layers))
    fill = lambda c: F.when(F.col("layer").isNull(), F.col(c)).otherwise(F.replace(F.col(c), F.lit("{layer}"), F.col("layer").cast("string")))
    return own.select("rule_id", "layer", F.when(F.col("layer").isNull(), F.col("rule_id")).otherwise(F.concat("rule_id", F.lit("["), F.col("layer").cast("string"), F.lit("]"))).alias("binding"), fill("source").alias("source"), fill("target").alias("target"), "kind")


def resolved(bound: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(binding, rule_id, layer, n_source, n_target, kind_mismatch, status, source, target) of bindings against sources (identity, kind) and targets (identity).

    MAPPED has one match on either side; the others are ZERO or MULTIPLE, the
    source first. Entities are counted by identity before they meet a binding.
    """
    s = sources.groupBy("identity", "kind").agg(F.count("*").alias("n")).groupBy("identity").agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("by_kind"))
    t = targets.groupBy(F.col("identity").alias("t_identity")).agg(F.count("*").alias("n_target"))
    both = bound.join(s, F.col("source") == F.col("identity"), "left").join(t, F.col("target") == F.col("t_identity"), "left")
    n = F.coalesce(F.col("by_kind")[F.col("kind")], F.lit(0))
    both = both.withColumn("n_source", n).withColumn("n_target", F.coalesce("n_target", F.lit(0))).withColumn("kind_mismatch", F.col("by_kind").isNotNull() & (n == 0))
    rungs = [("ZERO_SOURCE", F.col("n_source") == 0), ("MULTIPLE_SOURCE", F.col("n_source") > 1), ("ZERO_TARGET", F.col("n_target") == 0), ("MULTIPLE_TARGET", F.col("n_target") > 1)]
    return both.select("binding", "rule_id", "layer", "n_source", "n_target", "kind_mismatch", ladder(rungs, "MAPPED").alias("status"), "source", "target")


def coverage(entities: DataFrame, mapped: DataFrame, ignored: DataFrame, key: str, side: str, cap: int) -> DataFrame:
    """(side, state, n, examples): entities of one side by mapped, ignored or unmapped; what is mapped is not counted as ignored."""
    m, i = mapped.select(F.col(key).alias("m")).distinct(), ignored.select(F.col(key).alias("i")).distinct()
    both = entities.select(key).distinct().join(m, F.col(key) == F.col("m"), "left").join(i, F.col(key) == F.col("i"), "left")
    state = ladder([("mapped", F.col("m").isNotNull()), ("ignored", F.col("i").isNotNull())], "unmapped")
    return examples(both.select(state.alias("state"), key), "state", key, cap).select(F.lit(side).alias("side"), "state", "n", "examples")


def grouped(members: DataFrame, targets: DataFrame, group: str, expected: Column, kind: str, shape: str) -> DataFrame:
    """(group, n_members, n_kinds, n_shapes, status): many members for one target each: how many there are against ``expected`` (of the target's columns), whether their kinds and shapes agree, and whether the target is there."""
    own = members.groupBy(group).agg(F.count("*").alias("n_members"), F.countDistinct(kind).alias("n_kinds"), F.countDistinct(shape).alias("n_shapes"))
    at = targets.select(F.col(group).alias("target"), expected.alias("n_expected"))
    both = own.join(at, F.col(group) == F.col("target"), "full_outer").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_members", "n_kinds", "n_shapes")})
    rungs = [
        ("TARGET_MISSING", F.col("target").isNull()), ("SOURCE_MISSING", F.col("n_members") == 0), ("CARDINALITY", F.col("n_members") != F.col("n_expected")), ("KIND_CONFLICT", F.col("n_kinds") > 1), ("SHAPE_CONFLICT", F.col("n_shapes") > 1),
    ]
    return both.select(F.coalesce(group, "target").alias(group), "n_members", "n_kinds", "n_shapes", ladder(rungs, "MAPPED").alias("status"))


def claims(rows: DataFrame, domains: Mapping[str, Column], cap: int) -> DataFrame:
    """(domain, n, examples): names that are claimed more than once in each domain; a null makes no claim. One pass over the rows for all domains; a domain without repeats has no row."""
    listed = F.array_compact(F.array(*(F.when(c.isNotNull(), F.struct(F.lit(d).alias("domain"), c.cast("string").alias("claim"))) for d, c in domains.items())))
    repeated = rows.select(F.explode(listed).alias("x")).groupBy("x.domain", "x.claim").agg(F.count("*").alias("c")).where("c > 1")
    return examples(repeated.select("domain", "claim"), "domain", "claim", cap)


def relation_findings(pairs: DataFrame, layers: tuple[str, str], shapes: tuple[str, str], relation: str, parameters: tuple[Sequence[str], Sequence[str]]) -> DataFrame:
    """``pairs`` with (layer_ok, shape_ok, parameter_ok): layers alike (null-safe), shapes identical or reversed as ``relation`` says, parameters all alike."""
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    shape = F.when(F.col(relation) == "reversed", F.reverse(shapes[0])).otherwise(F.col(shapes[0]))
    alike = F.lit(True)
    for a, b in zip(*parameters, strict=True):
        alike = alike & same(a, b)
    return pairs.withColumn("layer_ok", same(*layers)).withColumn("shape_ok", shape.eqNullSafe(F.col(shapes[1]))).withColumn("parameter_ok", alike)


def policy_conformance(results: DataFrame, policy: DataFrame, rule: str, *fields: str) -> DataFrame:
    """(rule, n_results, status) of every rule of either side: UNKNOWN_RULE, NO_RESULTS, DIFFERS or CONFORMS on ``fields``."""
    p = policy.select(F.col(rule).alias("p_rule"), *(F.col(c).alias(f"p_{c}") for c in fields))
    both = results.join(p, F.col(rule) == F.col("p_rule"), "full_outer")
    same = F.lit(True)
    for c in fields:
        same = same & F.col(c).eqNullSafe(F.col(f"p_{c}"))
    sums = both.groupBy(F.coalesce(rule, "p_rule").alias(rule)).agg(F.count(F.col(rule)).alias("n_results"), F.bool_or(F.col("p_rule").isNull()).alias("unknown"), F.bool_and(same).alias("same"))
    return sums.select(rule, "n_results", ladder([("UNKNOWN_RULE", F.col("unknown")), ("NO_RESULTS", F.col("n_results") == 0), ("DIFFERS", ~F.col("same"))], "CONFORMS").alias("status"))


def realizations(alternatives: DataFrame, tensors: DataFrame, rule: str, tensor: str) -> DataFrame:
    """(rule, n_satisfied, chosen, status) of alternatives (rule, alternative, tensor, trusted): one is satisfied if its tensor is there exactly once and its evidence is trusted; exactly one has to be."""
    counts = tensors.groupBy(F.col(tensor).alias("t")).agg(F.count("*").alias("n_there"))
    own = alternatives.join(counts, F.col(tensor) == F.col("t"), "left").withColumn("good", F.col("trusted") & F.coalesce(F.col("n_there") == 1, F.lit(False)))
    sums = own.groupBy(rule).agg(F.count_if("good").alias("n_satisfied"), F.min(F.when(F.col("good"), F.col("alternative"))).alias("first"))
    return sums.select(rule, "n_satisfied", F.when(F.col("n_satisfied") == 1, F.col("first")).alias("chosen"), ladder([("UNREALIZED", F.col("n_satisfied") == 0), ("AMBIGUOUS", F.col("n_satisfied") > 1)], "REALIZED").alias("status"))
