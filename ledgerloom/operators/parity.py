"""Parity of tokenizers, configurations and backends: keyed and positional comparison with the findings and statuses of each dimension."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.compare import gated, ladder


def ambiguity(vocabulary: DataFrame, side: str, token: str, id_: str) -> DataFrame:
    """(side, n_records, n_tokens, n_ids, top, comparable): a vocabulary with a token or an id twice can't be compared both ways."""
    sums = vocabulary.groupBy(side).agg(F.count("*").alias("n_records"), F.countDistinct(token).alias("n_tokens"), F.countDistinct(id_).alias("n_ids"), (F.max(id_) + 1).alias("top"))
    return sums.withColumn("comparable", (F.col("n_records") == F.col("n_tokens")) & (F.col("n_records") == F.col("n_ids")))


def cardinality(basis: str, n_base: Column, n_added: Column) -> Column:
    """The number of entries by a declared basis, over the columns of ``ambiguity``; null where the basis is not known."""
    known = {"RECORD_COUNT": F.col("n_records"), "DISTINCT_TOKEN_COUNT": F.col("n_tokens"), "DISTINCT_ID_COUNT": F.col("n_ids"), "MAX_ID_PLUS_ONE": F.col("top"), "BASE_VOCABULARY_COUNT": n_base, "TOTAL_WITH_ADDED_TOKENS": n_base + n_added}
    return known[basis].cast("long")


def size_rule(declared: Column, observed: Column) -> Column:
    """Whether a declared vocabulary size, null unless it is an integer, is the observed one."""
    return ladder([("REQUIRED_INPUT_MISSING", declared.isNull()), ("NOT_EVALUATED", observed.isNull()), ("CONSISTENT_FOR_DECLARED_RULE", declared == observed)], "INCONSISTENT_FOR_DECLARED_RULE")


def tokens_to_ids(reference: DataFrame, candidate: DataFrame, token: str, id_: str) -> DataFrame:
    """(token, finding) of every token of either side; one row NOT_COMPARABLE where a side has a token or an id twice, or a null one."""
    r, c = reference.select(F.col(token).alias("r_token"), F.col(id_).alias("r_id")), candidate.select(F.col(token).alias("c_token"), F.col(id_).alias("c_id"))
    both = r.join(c, F.col("r_token") == F.col("c_token"), "full_outer")
    rungs = [("EXTRA_CANDIDATE_TOKEN", F.col("r_token").isNull()), ("TOKEN_MISSING_FROM_CANDIDATE", F.col("c_token").isNull()), ("TOKEN_ID_MISMATCH", F.col("r_id") != F.col("c_id"))]
    out = both.select(F.coalesce("r_token", "c_token").alias(token), ladder(rungs, "TOKEN_TO_ID_MATCH").alias("finding"))
    return gated(out, [reference, candidate], [token, id_], "finding")


def ids_to_tokens(reference: DataFrame, candidate: DataFrame, token: str, id_: str) -> DataFrame:
    """(n_compared, n_mismatches, status): the other way round; an id that one side lacks is a mismatch; NOT_COMPARABLE where a side has a token or an id twice, or a null one."""
    r, c = reference.select(F.col(token).alias("r_token"), F.col(id_).alias("r_id")), candidate.select(F.col(token).alias("c_token"), F.col(id_).alias("c_id"))
    both = r.join(c, F.col("r_id") == F.col("c_id"), "full_outer")
    sums = both.agg(F.count("*").alias("n_compared"), F.count_if(~F.col("r_token").eqNullSafe(F.col("c_token"))).alias("n_mismatches"))
    return gated(sums.withColumn("status", F.when(F.col("n_mismatches") > 0, "MISMATCH").otherwise("OBSERVED")), [reference, candidate], [token, id_], "status")


def keyed_properties(reference: DataFrame, candidate: DataFrame, keys: Sequence[str], fields: Sequence[str], one_sided: str, differs: str, match: str) -> DataFrame:
    """(keys, finding, changed) of every key of either side, with the names of the fields that differ; null and false are not the same."""
    r = reference.select(F.struct(*keys).alias("r_key"), *(F.col(c).alias(f"r_{c}") for c in fields))
    c = candidate.select(F.struct(*keys).alias("c_key"), *(F.col(x).alias(f"c_{x}") for x in fields))
    both = r.join(c, F.col("r_key") == F.col("c_key"), "full_outer").withColumn("key", F.coalesce("r_key", "c_key"))
    neither = F.col("r_key").isNotNull() & F.col("c_key").isNotNull()
    changed = F.when(neither, F.array_join(F.array_compact(F.array(*(F.when(~F.col(f"r_{x}").eqNullSafe(F.col(f"c_{x}")), x) for x in fields))), ",")).otherwise("")
    return both.withColumn("changed", changed).select(*(F.col("key")[k].alias(k) for k in keys), ladder([(one_sided, ~neither), (differs, F.col("changed") != "")], match).alias("finding"), "changed")


def pipelines(reference: DataFrame, candidate: DataFrame, scope: str) -> DataFrame:
    """(scope, place, finding) of components (scope, place, position, kind, type, parameters, opaque) by their place in the list."""
    r = reference.select(F.struct(scope, "place").alias("r_key"), *(F.col(c).alias(f"r_{c}") for c in ("position", "kind", "type", "parameters", "opaque")))
    c = candidate.select(F.struct(scope, "place").alias("c_key"), *(F.col(x).alias(f"c_{x}") for x in ("position", "kind", "type", "parameters", "opaque")))
    both = r.join(c, F.col("r_key") == F.col("c_key"), "full_outer").withColumn("key", F.coalesce("r_key", "c_key"))
    off = lambda x: ~F.col(f"r_{x}").eqNullSafe(F.col(f"c_{x}"))
    rungs = [
        ("COMPONENT_EXTRA", F.col("r_key").isNull()), ("COMPONENT_MISSING", F.col("c_key").isNull()), ("COMPONENT_ORDER_MISMATCH", off("position")), ("COMPONENT_TYPE_MISMATCH", off("kind") | off("type")),
        ("COMPONENT_PARAMETER_MISMATCH", off("parameters")), ("OPAQUE_COMPONENT_PRESENT", F.col("r_opaque") | F.col("c_opaque")),
    ]
    return both.select(F.col("key")[scope].alias(scope), F.col("key")["place"].alias("place"), ladder(rungs, "PIPELINE_STRUCTURE_MATCH").alias("finding"))


def template_findings(left_language: Column, right_language: Column, left_digest: Column, right_digest: Column) -> Column:
    """The findings on two templates, joined by commas; none was rendered."""
    language = F.when(~left_language.eqNullSafe(right_language), "TEMPLATE_LANGUAGE_MISMATCH")
    content = F.when(left_digest.eqNullSafe(right_digest), "TEMPLATE_EXACT_CONTENT_MATCH").otherwise("TEMPLATE_CONTENT_MISMATCH")
    return F.concat_ws(",", language, content, F.lit("TEMPLATE_PRESENT_NOT_EXECUTED"))


def configurations(fields: DataFrame, subject: str, required: Sequence[str], aliases: Mapping[str, str], allowed: Sequence[str]) -> DataFrame:
    """(subject, n_compared, n_mismatches, status) of pairs of configurations.

    ``fields`` has (subject, side, path, presence, type, value, raw, canonical),
    sides ``reference`` and ``candidate``, with the digests of the whole
    configurations on each row. A required field that a side lacks is a mismatch;
    so is one that differs, unless its transformation is allowed. ``aliases`` name
    the candidate's path.
    """
    side = lambda s: F.map_from_entries(F.collect_list(F.when(F.col("side") == s, F.struct("path", F.struct("presence", "type", "value").alias("x")))))
    digest = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    asked = sorted(set(required))
    own = fields.where(F.col("path").isin(*asked, *aliases.values())) if asked else fields
    sums = own.groupBy(subject).agg(side("reference").alias("r"), side("candidate").alias("c"))
    wholes = fields.groupBy(subject).agg(*(digest(s, c).alias(f"{s}_{c}") for s in ("reference", "candidate") for c in ("raw", "canonical")))
    states = F.array(*(F.struct(F.col("r")[p].alias("left"), F.col("c")[aliases.get(p, p)].alias("right"), F.lit(p in allowed).alias("may")) for p in asked))
    both = wholes.join(sums, subject, "left")
    lacks = lambda x: x["left"].isNull() | x["right"].isNull()
    bad = lambda x: lacks(x) | (~x["left"].eqNullSafe(x["right"]) & ~x["may"])
    n = lambda f: F.size(F.filter(states, f)).cast("long") if asked else F.lit(0).cast("long")
    out = both.withColumn("n_compared", n(lambda x: ~lacks(x))).withColumn("n_mismatches", n(bad))
    rungs = [
        ("INCOMPLETE_CONFIGURATION_EVIDENCE", F.lit(not asked)), ("FIELD_MISMATCH", F.col("n_mismatches") > 0), ("EXACT_RAW_BYTES_FOR_SCOPE", F.col("reference_raw") == F.col("candidate_raw")),
        ("CANONICAL_JSON_EQUAL_FOR_SCOPE", F.col("reference_canonical") == F.col("candidate_canonical")),
    ]
    return out.select(subject, "n_compared", "n_mismatches", ladder(rungs, "FIELD_PARITY_FOR_DECLARED_SCOPE").alias("status"))


def probes(reference: DataFrame, candidate: DataFrame, scope: str) -> DataFrame:
    """(scope, probe_id, finding) of results (scope, probe_id, kind, digest_only, output)."""
    r = reference.select(F.struct(scope, "probe_id").alias("r_key"), *(F.col(c).alias(f"r_{c}") for c in ("kind", "digest_only", "output")))
    c = candidate.select(F.struct(scope, "probe_id").alias("c_key"), *(F.col(x).alias(f"c_{x}") for x in ("kind", "digest_only", "output")))
    both = r.join(c, F.col("r_key") == F.col("c_key"), "full_outer").withColumn("key", F.coalesce("r_key", "c_key"))
    rungs = [
        ("PROBE_RESULT_UNAVAILABLE", F.col("r_key").isNull() | F.col("c_key").isNull()), ("PROBE_KIND_MISMATCH", F.col("r_kind") != F.col("c_kind")), ("DIGEST_ONLY_NOT_REPRODUCIBLE", F.col("r_digest_only") | F.col("c_digest_only")),
        ("PROBE_OUTPUT_MISMATCH", ~F.col("r_output").eqNullSafe(F.col("c_output"))),
    ]
    return both.select(F.col("key")[scope].alias(scope), F.col("key")["probe_id"].alias("probe_id"), ladder(rungs, "PROBE_OUTPUT_EXACT").alias("finding"))


def probe_statuses(findings: DataFrame, scope: str) -> DataFrame:
    """(scope, n_mismatches, status): mismatches before results that can't be reproduced, before exactness."""
    bad = F.col("finding").isin("PROBE_RESULT_UNAVAILABLE", "PROBE_KIND_MISMATCH", "PROBE_OUTPUT_MISMATCH")
    sums = findings.groupBy(scope).agg(F.count_if(bad).alias("n_mismatches"), F.bool_or(F.col("finding") == "DIGEST_ONLY_NOT_REPRODUCIBLE").alias("digest"))
    return sums.select(scope, "n_mismatches", ladder([("MISMATCH_FOR_DECLARED_PROBES", F.col("n_mismatches") > 0), ("DIGEST_ONLY_NOT_REPRODUCIBLE", F.col("digest"))], "EXACT_FOR_DECLARED_PROBES").alias("status"))


def backends(results: DataFrame, probes_: DataFrame, scope: str, n_backends: Column, tolerance: float) -> DataFrame:
    """(scope, n_findings, status) of results (scope, backend, probe_id, dimension, digest, value, failed) for probes (scope, probe_id, dimension, stochastic).

    A probe that a backend has no result for is a mismatch, and so is a failed
    one but in the dimension ERROR_CLASS. SELECTED_LOGIT_SAMPLES that differ are
    held against ``tolerance`` by the largest absolute difference of ``value``;
    other differences of declared stochastic probes are kept apart.
    """
    held = results.groupBy(scope, "probe_id", "dimension").agg(
        F.countDistinct("backend").alias("n_have"), F.bool_or("failed").alias("failed"), F.countDistinct("digest").alias("kinds"), (F.max("value") - F.min("value")).alias("spread"),
    )
    both = probes_.join(held, [scope, "probe_id", "dimension"], "left").withColumn("n_backends", n_backends)
    logits = F.col("dimension") == "SELECTED_LOGIT_SAMPLES"
    rungs = [
        ("RESULT_MISSING", F.coalesce("n_have", F.lit(0)) < F.col("n_backends")), ("ERROR_RESULT_NOT_COMPARABLE_AS_SUCCESS", F.col("failed") & (F.col("dimension") != "ERROR_CLASS")), ("EXACT_FOR_DIMENSION", F.col("kinds") <= 1),
        ("WITHIN_TOLERANCE", logits & (F.col("spread") <= tolerance)), ("OUTSIDE_TOLERANCE", logits), ("STOCHASTIC_DIFFERENCE", F.col("stochastic")),
    ]
    found = both.withColumn("finding", ladder(rungs, "MISMATCH_FOR_DIMENSION"))
    has = lambda *names: F.bool_or(F.col("finding").isin(*names))
    sums = found.groupBy(scope).agg(
        F.count("*").alias("n_findings"), F.max("n_backends").alias("most"), has("RESULT_MISSING", "ERROR_RESULT_NOT_COMPARABLE_AS_SUCCESS", "OUTSIDE_TOLERANCE", "MISMATCH_FOR_DIMENSION").alias("bad"),
        has("STOCHASTIC_DIFFERENCE").alias("stochastic"), has("WITHIN_TOLERANCE").alias("near"),
    )
    order = [
        ("INSUFFICIENT_EVIDENCE", F.col("most") < 2), ("MISMATCH_FOR_DECLARED_PROBES", F.col("bad")), ("STOCHASTIC_RESULTS_NOT_DIRECTLY_COMPARABLE", F.col("stochastic")), ("WITHIN_EXPLICIT_NUMERICAL_POLICY_FOR_DECLARED_PROBES", F.col("near")),
    ]
    return sums.select(scope, "n_findings", ladder(order, "EXACT_FOR_DECLARED_PROBES").alias("status"))
