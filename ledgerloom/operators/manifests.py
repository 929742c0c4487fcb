"""Manifests of many scopes at once: findings for each path, and a status for each scope by ordered rungs.

Members have (scope, path, size, digest, role, kind); a scope's own facts are
columns of a table of scopes, one row each. Rungs are in the order in which they
take precedence. Paths are unique within a scope and side.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.compare import ladder

_FIELDS = {"size": "SIZE", "digest": "CONTENT_DIGEST", "role": "ROLE", "kind": "TYPE"}
#: Findings that make a manifest mismatch.
BAD = ("PATH_MISSING", "PATH_EXTRA", "SIZE_MISMATCH", "CONTENT_DIGEST_MISMATCH", "ROLE_MISMATCH", "TYPE_MISMATCH")


def _both(expected: DataFrame, observed: DataFrame, fields: dict[str, str]) -> DataFrame:
    e = expected.select(F.col("scope").alias("e_scope"), F.col("path").alias("e_path"), *(F.col(c).alias(f"e_{c}") for c in fields))
    o = observed.select(F.col("scope").alias("o_scope"), F.col("path").alias("o_path"), *(F.col(c).alias(f"o_{c}") for c in fields))
    both = e.join(o, (F.col("e_scope") == F.col("o_scope")) & (F.col("e_path") == F.col("o_path")), "full_outer")
    return both.withColumn("scope", F.coalesce("e_scope", "o_scope")).withColumn("path", F.coalesce("e_path", "o_path"))


def path_findings(expected: DataFrame, observed: DataFrame, scopes: DataFrame) -> DataFrame:
    """(scope, path, findings) for scopes (scope, complete): a path that was not expected is extra only where the expectation covers the whole file set."""
    pair = lambda c, name: F.when(F.col(f"e_{c}").eqNullSafe(F.col(f"o_{c}")), f"{name}_MATCH").otherwise(f"{name}_MISMATCH")
    found = (
        F.when(F.col("e_path").isNull(), F.array(F.when(F.col("complete"), "PATH_EXTRA").otherwise("PATH_OUTSIDE_EXPECTATION_SCOPE")))
        .when(F.col("o_path").isNull(), F.array(F.lit("PATH_MISSING")))
        .otherwise(F.array(F.lit("PATH_MATCH"), *(pair(c, name) for c, name in _FIELDS.items())))
    )
    return _both(expected, observed, _FIELDS).join(scopes.select("scope", "complete"), "scope").select("scope", "path", found.alias("findings"))


def manifest_statuses(findings: DataFrame, scopes: DataFrame) -> DataFrame:
    """(scope, n_matching, n_missing, n_extra, n_outside, status) of scopes (scope, materialization, compatible, completion).

    A rung before the comparison leaves the counts at 0. A scope without any
    path matches.
    """
    has = lambda name: F.array_contains("findings", name)
    counts = findings.groupBy("scope").agg(
        F.count_if(F.forall("findings", lambda x: x.endswith("_MATCH"))).alias("matching"), F.count_if(has("PATH_MISSING")).alias("missing"), F.count_if(has("PATH_EXTRA")).alias("extra"),
        F.count_if(has("PATH_OUTSIDE_EXPECTATION_SCOPE")).alias("outside"), F.bool_or(F.arrays_overlap("findings", F.array(*map(F.lit, BAD)))).alias("bad"),
    )
    early = [
        ("DIGEST_REFERENCE_ONLY", F.col("materialization") == "DIGEST_REFERENCE_ONLY"), ("EXPECTATION_UNAVAILABLE", F.col("materialization") == "EXPECTATION_UNAVAILABLE"),
        ("INVALID_EXPECTATION", F.col("materialization") == "EXPECTATION_INVALID"), ("INCOMPATIBLE_SCOPE", ~F.col("compatible")), ("LIMIT_EXCEEDED", F.col("completion") == "LIMIT_EXCEEDED"),
        ("INCOMPLETE_OBSERVATION", F.col("completion") != "COMPLETE_FOR_DECLARED_LOCAL_SCOPE"),
    ]
    status = ladder([*early, ("MISMATCH", F.coalesce("bad", F.lit(False)))], "EXACT_MATCH_FOR_EXPECTATION_SCOPE")
    compared = F.col("status").isin("MISMATCH", "EXACT_MATCH_FOR_EXPECTATION_SCOPE")
    both = scopes.join(counts, "scope", "left").withColumn("status", status)
    return both.select("scope", *(F.when(compared, F.coalesce(c, F.lit(0))).otherwise(0).alias(f"n_{c}") for c in ("matching", "missing", "extra", "outside")), "status")


def evidence_outcome(compared: Column, status: Column, complete: Column, authorized: Column, policy_scope_differs: Column) -> Column:
    """What a manifest proves; a policy of another scope makes it INVALID whatever the comparison says."""
    exact = status == "EXACT_MATCH_FOR_EXPECTATION_SCOPE"
    same = [(s, status == s) for s in ("MISMATCH", "DIGEST_REFERENCE_ONLY", "EXPECTATION_UNAVAILABLE", "LIMIT_EXCEEDED")]
    rungs = [
        ("INVALID", F.coalesce(policy_scope_differs, F.lit(False))), ("OBSERVED", ~compared), ("MATCHES_AUTHORIZED_COMPLETE_EXPECTATION", exact & complete & authorized), ("MATCHES_COMPLETE_EXPECTATION", exact & complete),
        ("MATCHES_EXPECTATION_SCOPE", exact), *same, ("INCOMPLETE", status == "INCOMPLETE_OBSERVATION"),
    ]
    return ladder(rungs, "NOT_COMPARABLE")


def remote_findings(remote: DataFrame, local: DataFrame, scopes: DataFrame, roles: dict[str, str]) -> DataFrame:
    """(scope, path, findings, mismatch, comparable) of remote members (scope, path, size, digest, role), whose size and digest may be unknown, against local ones.

    ``roles`` are the local roles that remote ones stand for; a role that is not
    among them is a finding, but no mismatch of the scope.
    """
    local_role = F.create_map(*(F.lit(x) for pair in roles.items() for x in pair))[F.col("e_role")]
    neither = F.col("e_path").isNotNull() & F.col("o_path").isNotNull()
    size = F.when(F.col("e_size").isNull(), None).when(F.col("e_size") == F.col("o_size"), "SIZE_MATCH").otherwise("SIZE_MISMATCH")
    role = F.when(local_role.eqNullSafe(F.col("o_role")), "ROLE_MATCH").otherwise("ROLE_MISMATCH")
    digest = F.when(F.col("e_digest").isNull(), "DIGEST_NOT_COMPARABLE").when(F.col("e_digest") == F.col("o_digest"), "DIGEST_MATCH").otherwise("DIGEST_MISMATCH")
    alone = F.when(F.col("e_path").isNull(), F.when(F.col("complete"), "PATH_EXTRA_LOCAL").otherwise("PATH_OUTSIDE_EXPECTATION_SCOPE")).otherwise("PATH_MISSING_LOCAL")
    found = F.when(neither, F.array_compact(F.array(F.lit("PATH_MATCH"), size, role, digest))).otherwise(F.array(alone))
    bad = F.arrays_overlap("findings", F.array(*map(F.lit, ("PATH_EXTRA_LOCAL", "PATH_MISSING_LOCAL", "SIZE_MISMATCH", "DIGEST_MISMATCH"))))
    both = _both(remote, local, {"size": "", "digest": "", "role": ""}).join(scopes.select("scope", "complete"), "scope").withColumn("findings", found)
    role_differs = neither & local_role.isNotNull() & (local_role != F.col("o_role"))
    return both.select("scope", "path", "findings", (bad | role_differs).alias("mismatch"), (neither & F.col("e_digest").isNotNull()).alias("comparable"), F.col("e_path").isNotNull().alias("expected"))


def reconciliation_statuses(findings: DataFrame, scopes: DataFrame) -> DataFrame:
    """(scope, n_expected, n_comparable, status) of scopes (scope, listing_complete, local_complete, immutable, authority), where authority is null if none was asked."""
    counts = findings.groupBy("scope").agg(F.count_if("expected").alias("n_expected"), F.count_if("comparable").alias("n_comparable"), F.bool_or("mismatch").alias("mismatch"))
    both = scopes.join(counts, "scope", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_expected", "n_comparable")})
    rungs = [
        ("INCOMPLETE_REMOTE_EVIDENCE", ~F.col("listing_complete")), ("INCOMPLETE_LOCAL_OBSERVATION", ~F.col("local_complete")), ("MUTABLE_OR_UNRESOLVED_REVISION", ~F.col("immutable")),
        ("MISMATCH", F.coalesce("mismatch", F.lit(False))), ("MEMBER_SET_MATCH_DIGESTS_UNAVAILABLE", F.col("n_comparable") == 0), ("METADATA_MATCH_ONLY", F.col("n_comparable") != F.col("n_expected")),
        ("EXPECTATION_UNAUTHORIZED", F.coalesce(F.col("authority") != "AUTHORIZED_PUBLISHER", F.lit(False))),
    ]
    return both.select("scope", "n_expected", "n_comparable", ladder(rungs, "EXACT_MATCH_FOR_RECONCILIATION_SCOPE").alias("status"))


def topologies(indexes: DataFrame) -> DataFrame:
    """(scope, n_keys, n_shards, n_conflicts, status) of the union of a scope's indexes (scope, key, shard): a key in several shards is a conflict."""
    keys = indexes.groupBy("scope", "key").agg(F.countDistinct("shard").alias("n"), F.collect_set("shard").alias("shards"))
    out = keys.groupBy("scope").agg(F.count("*").alias("n_keys"), F.count_if(F.col("n") > 1).alias("n_conflicts"))
    shards = indexes.select("scope", "shard").distinct().groupBy("scope").agg(F.count("shard").alias("n_shards"))
    return out.join(shards, "scope").select("scope", "n_keys", "n_shards", "n_conflicts", F.when(F.col("n_conflicts") > 0, "CONFLICTING_INDEXES").otherwise("EXPLICIT_INDEX").alias("status"))


def completeness(required: DataFrame, remote: DataFrame, local: DataFrame, scopes: DataFrame) -> DataFrame:
    """(scope, n_required, n_missing_remote, n_missing_local, digests, bytes, status): required members (scope, path, companion) against remote ones (scope, path, digest) and, where ``has_local``, local ones.

    Scopes have (scope, topology, has_local).
    """
    r = remote.select("scope", "path", F.lit(True).alias("at_remote"), F.col("digest").alias("remote_digest"))
    h = local.select("scope", "path", F.lit(True).alias("at_home"), F.col("digest").alias("home_digest"))
    members = required.join(r, ["scope", "path"], "left").join(h, ["scope", "path"], "left")
    away, out, known = F.col("at_remote").isNull(), F.col("at_home").isNull(), F.col("remote_digest").isNotNull()
    counts = members.groupBy("scope").agg(
        F.count("*").alias("n_required"), F.count_if(away).alias("n_missing_remote"), F.count_if(out).alias("missing_home"), F.bool_or(away & ~F.col("companion")).alias("shard_lost"),
        F.count_if(known).alias("n_known"), F.count_if(known & F.coalesce(F.col("remote_digest") == F.col("home_digest"), F.lit(False))).alias("n_alike"),
    )
    both = scopes.join(counts, "scope", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_required", "n_missing_remote", "missing_home", "n_known", "n_alike")})
    missing_local = F.when(F.col("has_local"), F.col("missing_home")).otherwise(0)
    rungs = [
        *((s, F.col("topology") == s) for s in ("LIMIT_EXCEEDED", "CONFLICTING_INDEXES", "HEURISTIC_ONLY", "TOPOLOGY_UNAVAILABLE")), ("INDEX_REFERENCES_MISSING_MEMBER", F.coalesce("shard_lost", F.lit(False))),
        ("INCOMPLETE_REMOTE_MEMBERS", F.col("n_missing_remote") > 0), ("INCOMPLETE_LOCAL_MEMBERS", F.col("n_missing_local") > 0),
    ]
    digests = ladder([("ALL_REQUIRED_MEMBERS", F.col("n_known") == F.col("n_required")), ("PARTIAL", F.col("n_known") > 0)], "NONE")
    alike = ladder([("NOT_EVALUATED", ~F.col("has_local")), ("ALL_COMPARABLE_MATCH", (F.col("n_known") > 0) & (F.col("n_alike") == F.col("n_known")))], "MISMATCH_OR_INCOMPLETE")
    return both.withColumn("n_missing_local", missing_local).select("scope", "n_required", "n_missing_remote", "n_missing_local", digests.alias("digests"), alike.alias("bytes"), ladder(rungs, "COMPLETE_FOR_EXPLICIT_TOPOLOGY_SCOPE").alias("status"))


def index_findings(index: DataFrame, files: DataFrame) -> DataFrame:
    """(scope, n_files, n_missing, n_undeclared, n_size, n_digest, n_repeated_content, n_repeated_ids, total_matches, verified): an index (scope, path, size, digest, id) against the files of its folder."""
    both = _both(index, files, {"size": "", "digest": ""})
    neither = F.col("e_path").isNotNull() & F.col("o_path").isNotNull()
    counts = both.groupBy("scope").agg(
        F.count("e_path").alias("n_files"), F.count_if(F.col("o_path").isNull()).alias("n_missing"), F.count_if(F.col("e_path").isNull()).alias("n_undeclared"),
        F.count_if(neither & ~F.col("e_size").eqNullSafe(F.col("o_size"))).alias("n_size"), F.count_if(neither & ~F.col("e_digest").eqNullSafe(F.col("o_digest"))).alias("n_digest"),
        F.sum("e_size").eqNullSafe(F.sum("o_size")).alias("total_matches"),
    )
    own = index.groupBy("scope").agg((F.count("*") - F.countDistinct("digest")).alias("n_repeated_content"), (F.count("*") - F.countDistinct("id")).alias("n_repeated_ids"))
    faults = ["n_missing", "n_undeclared", "n_size", "n_digest", "n_repeated_content", "n_repeated_ids"]
    joined = counts.join(own, "scope", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_repeated_content", "n_repeated_ids")})
    clean = F.col("total_matches")
    for c in faults:
        clean = clean & (F.col(c) == 0)
    return joined.select("scope", "n_files", *faults, "total_matches", clean.alias("verified"))
