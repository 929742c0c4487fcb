"""Queries over manifests: each supplier's lines are the members of a scope, some of them perturbed."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import manifests
from ledgerloom.plans.catalogue import query, table
from ledgerloom.plans.drawn import drawn, drawn_sql, one_of, one_of_sql

_PATH = "l_orderkey::VARCHAR || '-' || l_linenumber || '-' || l_partkey"
_LINES = f"""lines AS (SELECT l_suppkey AS scope, {_PATH} AS path, min(round(l_extendedprice * 100)::BIGINT) AS size, count(*) AS copies FROM lineitem GROUP BY 1, 2),
members AS (SELECT scope, path, size, sha256(path || ':' || size) AS digest, {one_of_sql("path", "role", "WEIGHTS", "CONFIG", "TOKENIZER")} AS role, 'REGULAR' AS kind,
            {drawn_sql("scope", "touched", 3)} = 0 AS touched, {drawn_sql("path", "touch", 40)} AS touch FROM lines)"""


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scope, path, size, digest, role, kind, touched, touch): a third of the scopes are touched, and there some paths are."""
    path = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("scope"), path.alias("path")).agg(F.min(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("size"))
    return lines.select(
        "scope", "path", "size", F.sha2(F.concat_ws(":", "path", "size"), 256).alias("digest"), one_of(F.col("path"), "role", "WEIGHTS", "CONFIG", "TOKENIZER").alias("role"), F.lit("REGULAR").alias("kind"),
        (drawn(F.col("scope"), "touched", 3) == 0).alias("touched"), drawn(F.col("path"), "touch", 40).alias("touch"),
    )


_EXPECTED = "expected AS (SELECT scope, path, size, digest, role, kind FROM members WHERE NOT (touched AND touch = 1))"
_OBSERVED = """observed AS (SELECT scope, path, size + CASE WHEN touched AND touch = 2 THEN 1 ELSE 0 END AS size, digest || CASE WHEN touched AND touch IN (2, 3) THEN '!' ELSE '' END AS digest,
            CASE WHEN touched AND touch = 4 THEN 'OTHER' ELSE role END AS role, CASE WHEN touched AND touch = 5 THEN 'LINK' ELSE kind END AS kind FROM members WHERE NOT (touched AND touch = 0))"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    members = _members(spark, sf_dir)
    hit = lambda *k: F.col("touched") & F.col("touch").isin(*k)
    observed = members.where(~hit(0)).select(
        "scope", "path", (F.col("size") + F.when(hit(2), 1).otherwise(0)).alias("size"), F.concat("digest", F.when(hit(2, 3), "!").otherwise("")).alias("digest"),
        F.when(hit(4), "OTHER").otherwise(F.col("role")).alias("role"), F.when(hit(5), "LINK").otherwise(F.col("kind")).alias("kind"),
    )
    return members.where(~hit(1)).drop("touched", "touch"), observed


_MATERIALIZATION = ("AVAILABLE",) * 9 + ("DIGEST_REFERENCE_ONLY", "EXPECTATION_UNAVAILABLE", "EXPECTATION_INVALID")
_COMPLETION = ("COMPLETE_FOR_DECLARED_LOCAL_SCOPE",) * 9 + ("LIMIT_EXCEEDED", "INCOMPLETE")
_SCOPES = f"""scopes AS (SELECT s_suppkey AS scope, {drawn_sql("s_suppkey", "complete", 3)} > 0 AS complete, {one_of_sql("s_suppkey", "materialization", *_MATERIALIZATION)} AS materialization,
           {drawn_sql("s_suppkey", "compatible", 9)} > 0 AS compatible, {one_of_sql("s_suppkey", "completion", *_COMPLETION)} AS completion FROM supplier)"""


def _scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.alias("scope"), (drawn(key, "complete", 3) > 0).alias("complete"), one_of(key, "materialization", *_MATERIALIZATION).alias("materialization"),
        (drawn(key, "compatible", 9) > 0).alias("compatible"), one_of(key, "completion", *_COMPLETION).alias("completion"),
    )


_COMPARED = f"""WITH {_LINES}, {_EXPECTED}, {_OBSERVED}, {_SCOPES},
f AS (SELECT coalesce(e.scope, o.scope) AS scope, coalesce(e.path, o.path) AS path, e.path IS NULL AS extra, o.path IS NULL AS missing, e.size IS DISTINCT FROM o.size AS d_size, e.digest IS DISTINCT FROM o.digest AS d_digest,
      e.role IS DISTINCT FROM o.role AS d_role, e.kind IS DISTINCT FROM o.kind AS d_kind FROM expected e FULL JOIN observed o ON e.scope = o.scope AND e.path = o.path)"""


@query(_COMPARED + """ SELECT f.scope, path, CASE WHEN extra THEN CASE WHEN complete THEN 'PATH_EXTRA' ELSE 'PATH_OUTSIDE_EXPECTATION_SCOPE' END WHEN missing THEN 'PATH_MISSING'
ELSE 'PATH_MATCH,SIZE_' || CASE WHEN d_size THEN 'MISMATCH' ELSE 'MATCH' END || ',CONTENT_DIGEST_' || CASE WHEN d_digest THEN 'MISMATCH' ELSE 'MATCH' END || ',ROLE_' || CASE WHEN d_role THEN 'MISMATCH' ELSE 'MATCH' END
|| ',TYPE_' || CASE WHEN d_kind THEN 'MISMATCH' ELSE 'MATCH' END END AS findings FROM f JOIN scopes USING (scope)""")
def manifest_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five kinds of findings for each path of either side."""
    found = manifests.path_findings(*_sides(spark, sf_dir), _scopes(spark, sf_dir))
    return found.select("scope", "path", F.array_join("findings", ",").alias("findings"))


_STATUSES = _COMPARED + """, c AS (SELECT scope, count(*) FILTER (NOT (extra OR missing OR d_size OR d_digest OR d_role OR d_kind)) AS m, count(*) FILTER (missing) AS l, count(*) FILTER (extra) AS x,
     count(*) FILTER (NOT extra AND (missing OR d_size OR d_digest OR d_role OR d_kind)) AS bad FROM f GROUP BY 1),
s AS (SELECT s.*, coalesce(m, 0) AS m, coalesce(l, 0) AS l, coalesce(x, 0) AS x, CASE materialization WHEN 'DIGEST_REFERENCE_ONLY' THEN 'DIGEST_REFERENCE_ONLY' WHEN 'EXPECTATION_UNAVAILABLE' THEN 'EXPECTATION_UNAVAILABLE' WHEN 'EXPECTATION_INVALID' THEN 'INVALID_EXPECTATION'
      ELSE CASE WHEN NOT compatible THEN 'INCOMPATIBLE_SCOPE' WHEN completion = 'LIMIT_EXCEEDED' THEN 'LIMIT_EXCEEDED' WHEN completion <> 'COMPLETE_FOR_DECLARED_LOCAL_SCOPE' THEN 'INCOMPLETE_OBSERVATION'
      WHEN coalesce(bad, 0) > 0 OR (complete AND coalesce(x, 0) > 0) THEN 'MISMATCH' ELSE 'EXACT_MATCH_FOR_EXPECTATION_SCOPE' END END AS status FROM scopes s LEFT JOIN c USING (scope)),
r AS (SELECT *, status IN ('MISMATCH', 'EXACT_MATCH_FOR_EXPECTATION_SCOPE') AS done FROM s)"""


@query(_STATUSES + " SELECT scope, CASE WHEN done THEN m ELSE 0 END AS n_matching, CASE WHEN done THEN l ELSE 0 END AS n_missing, CASE WHEN done AND complete THEN x ELSE 0 END AS n_extra, CASE WHEN done AND NOT complete THEN x ELSE 0 END AS n_outside, status FROM r")
def manifest_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A status for each scope."""
    scopes = _scopes(spark, sf_dir)
    return manifests.manifest_statuses(manifests.path_findings(*_sides(spark, sf_dir), scopes), scopes)


@query(_STATUSES + f""" SELECT scope, status, CASE WHEN {drawn_sql("scope", "policy", 12)} = 0 THEN 'INVALID' WHEN {drawn_sql("scope", "compared", 12)} = 0 THEN 'OBSERVED'
WHEN status = 'EXACT_MATCH_FOR_EXPECTATION_SCOPE' THEN CASE WHEN NOT complete THEN 'MATCHES_EXPECTATION_SCOPE' WHEN {drawn_sql("scope", "publisher", 2)} = 0 THEN 'MATCHES_AUTHORIZED_COMPLETE_EXPECTATION' ELSE 'MATCHES_COMPLETE_EXPECTATION' END
WHEN status IN ('INVALID_EXPECTATION', 'INCOMPATIBLE_SCOPE') THEN 'NOT_COMPARABLE' WHEN status = 'INCOMPLETE_OBSERVATION' THEN 'INCOMPLETE' ELSE status END AS outcome FROM r""")
def manifest_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each scope's comparison proves, by policy and publisher."""
    scopes = _scopes(spark, sf_dir)
    statuses = manifests.manifest_statuses(manifests.path_findings(*_sides(spark, sf_dir), scopes), scopes).join(scopes.select("scope", "complete"), "scope")
    key = F.col("scope")
    outcome = manifests.evidence_outcome(drawn(key, "compared", 12) > 0, F.col("status"), F.col("complete"), drawn(key, "publisher", 2) == 0, drawn(key, "policy", 12) == 0)
    return statuses.select("scope", "status", outcome.alias("outcome"))


_ROLES = {"WEIGHTS": "WEIGHTS", "CONFIG": "CONFIG"}
_REMOTE = f"""WITH {_LINES}, {_OBSERVED}, {_SCOPES},
remote AS (SELECT scope, path, CASE WHEN {drawn_sql("path", "sized", 5)} > 0 THEN size END AS size, CASE WHEN {drawn_sql("scope", "digests", 4)} = 0 OR ({drawn_sql("scope", "digests", 4)} = 1 AND {drawn_sql("path", "digested", 9)} = 0) THEN NULL ELSE digest END AS digest, role FROM members WHERE NOT (touched AND touch = 1)),
f AS (SELECT coalesce(r.scope, o.scope) AS scope, coalesce(r.path, o.path) AS path, r.path IS NOT NULL AS here, o.path IS NOT NULL AS there, r.size AS rs, o.size AS os, r.digest AS rd, o.digest AS od, r.role AS rr, o.role AS orr FROM remote r FULL JOIN observed o ON r.scope = o.scope AND r.path = o.path),
g AS (SELECT f.*, complete, CASE WHEN NOT here THEN complete WHEN NOT there THEN true ELSE coalesce(rs <> os, false) OR coalesce(rd <> od, false) OR (rr IN ('WEIGHTS', 'CONFIG') AND rr <> orr) END AS mismatch FROM f JOIN scopes USING (scope))"""
_RECONCILED = f"listing_complete AS (SELECT s_suppkey AS scope, {drawn_sql('s_suppkey', 'listing', 8)} > 0 AS listing_complete, {drawn_sql('s_suppkey', 'local', 8)} > 0 AS local_complete, {drawn_sql('s_suppkey', 'immutable', 8)} > 0 AS immutable, {one_of_sql('s_suppkey', 'authority', None, 'AUTHORIZED_PUBLISHER', 'UNKNOWN')} AS authority FROM supplier)"


def _remote(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, path, scope = _members(spark, sf_dir), F.col("path"), F.col("scope")
    hidden = (drawn(scope, "digests", 4) == 0) | ((drawn(scope, "digests", 4) == 1) & (drawn(path, "digested", 9) == 0))
    return members.where(~(F.col("touched") & (F.col("touch") == 1))).select("scope", "path", F.when(drawn(path, "sized", 5) > 0, F.col("size")).alias("size"), F.when(~hidden, F.col("digest")).alias("digest"), "role")


@query(_REMOTE + """ SELECT scope, path, CASE WHEN NOT here THEN CASE WHEN complete THEN 'PATH_EXTRA_LOCAL' ELSE 'PATH_OUTSIDE_EXPECTATION_SCOPE' END WHEN NOT there THEN 'PATH_MISSING_LOCAL'
ELSE concat_ws(',', 'PATH_MATCH', CASE WHEN rs = os THEN 'SIZE_MATCH' WHEN rs <> os THEN 'SIZE_MISMATCH' END, CASE WHEN rr IN ('WEIGHTS', 'CONFIG') AND rr = orr THEN 'ROLE_MATCH' ELSE 'ROLE_MISMATCH' END,
CASE WHEN rd IS NULL THEN 'DIGEST_NOT_COMPARABLE' WHEN rd = od THEN 'DIGEST_MATCH' ELSE 'DIGEST_MISMATCH' END) END AS findings, mismatch FROM g""")
def reconcile_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remote members, whose sizes and digests may be unknown, against local files."""
    found = manifests.remote_findings(_remote(spark, sf_dir), _sides(spark, sf_dir)[1], _scopes(spark, sf_dir), _ROLES)
    return found.select("scope", "path", F.array_join("findings", ",").alias("findings"), "mismatch")


@query(_REMOTE + f", {_RECONCILED}, " + """c AS (SELECT scope, count(*) FILTER (here) AS n_expected, count(*) FILTER (here AND there AND rd IS NOT NULL) AS n_comparable, bool_or(mismatch) AS bad FROM g GROUP BY 1)
SELECT l.scope, coalesce(n_expected, 0) AS n_expected, coalesce(n_comparable, 0) AS n_comparable, CASE WHEN NOT listing_complete THEN 'INCOMPLETE_REMOTE_EVIDENCE' WHEN NOT local_complete THEN 'INCOMPLETE_LOCAL_OBSERVATION' WHEN NOT immutable THEN 'MUTABLE_OR_UNRESOLVED_REVISION'
WHEN coalesce(bad, false) THEN 'MISMATCH' WHEN coalesce(n_comparable, 0) = 0 THEN 'MEMBER_SET_MATCH_DIGESTS_UNAVAILABLE' WHEN n_comparable < n_expected THEN 'METADATA_MATCH_ONLY' WHEN authority <> 'AUTHORIZED_PUBLISHER' THEN 'EXPECTATION_UNAUTHORIZED'
ELSE 'EXACT_MATCH_FOR_RECONCILIATION_SCOPE' END AS status FROM listing_complete l LEFT JOIN c USING (scope)""")
def reconcile_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A status for each scope's remote listing against its local files."""
    scopes, key = _scopes(spark, sf_dir), F.col("scope")
    found = manifests.remote_findings(_remote(spark, sf_dir), _sides(spark, sf_dir)[1], scopes, _ROLES)
    facts = scopes.select("scope", *((drawn(key, salt, 8) > 0).alias(name) for salt, name in (("listing", "listing_complete"), ("local", "local_complete"), ("immutable", "immutable"))), one_of(key, "authority", None, "AUTHORIZED_PUBLISHER", "UNKNOWN").alias("authority"))
    return manifests.reconciliation_statuses(found, facts)


_INDEXES = "indexes AS (SELECT l_suppkey AS scope, l_partkey AS key, l_partkey % 7 + CASE WHEN l_suppkey % 10 = 3 AND l_orderkey % 97 = 0 THEN 1 ELSE 0 END AS shard FROM lineitem)"


@query(f"WITH {_INDEXES}, k AS (SELECT scope, key, count(DISTINCT shard) AS n FROM indexes GROUP BY 1, 2) SELECT scope, count(*) AS n_keys, (SELECT count(DISTINCT shard) FROM indexes i WHERE i.scope = k.scope) AS n_shards, count(*) FILTER (n > 1) AS n_conflicts, CASE WHEN max(n) > 1 THEN 'CONFLICTING_INDEXES' ELSE 'EXPLICIT_INDEX' END AS status FROM k GROUP BY 1")
def shard_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexes of where each key lies, put together: keys that lie in several shards."""
    moved = F.when((F.col("l_suppkey") % 10 == 3) & (F.col("l_orderkey") % 97 == 0), 1).otherwise(0)
    return manifests.topologies(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("scope"), F.col("l_partkey").alias("key"), (F.col("l_partkey") % 7 + moved).alias("shard")))


_TOPOLOGY = ("EXPLICIT_INDEX",) * 8 + ("LIMIT_EXCEEDED", "CONFLICTING_INDEXES", "HEURISTIC_ONLY", "TOPOLOGY_UNAVAILABLE")


@query(f"""WITH {_LINES}, {_OBSERVED}, required AS (SELECT scope, path, {drawn_sql("path", "companion", 10)} = 0 AS companion FROM members),
remote AS (SELECT scope, path, CASE WHEN {drawn_sql("scope", "digests", 4)} > 0 THEN digest END AS digest FROM members WHERE NOT (touched AND touch = 1 AND ({drawn_sql("scope", "shards", 2)} = 0 OR {drawn_sql("path", "companion", 10)} = 0))),
m AS (SELECT q.*, r.path IS NULL AS away, o.path IS NULL AS gone, r.digest AS rd, o.digest AS od FROM required q LEFT JOIN remote r USING (scope, path) LEFT JOIN observed o USING (scope, path)),
c AS (SELECT scope, count(*) AS q, count(*) FILTER (away) AS away, count(*) FILTER (gone) AS gone, bool_or(away AND NOT companion) AS lost, count(rd) AS known, count(*) FILTER (rd = od) AS alike FROM m GROUP BY 1),
t AS (SELECT s_suppkey AS scope, {one_of_sql("s_suppkey", "topology", *_TOPOLOGY)} AS topology, {drawn_sql("s_suppkey", "home", 4)} > 0 AS has_local FROM supplier)
SELECT scope, coalesce(q, 0) AS n_required, coalesce(away, 0) AS n_missing_remote, CASE WHEN has_local THEN coalesce(gone, 0) ELSE 0 END AS n_missing_local,
CASE WHEN coalesce(known, 0) = coalesce(q, 0) THEN 'ALL_REQUIRED_MEMBERS' WHEN known > 0 THEN 'PARTIAL' ELSE 'NONE' END AS digests,
CASE WHEN NOT has_local THEN 'NOT_EVALUATED' WHEN known > 0 AND known = alike THEN 'ALL_COMPARABLE_MATCH' ELSE 'MISMATCH_OR_INCOMPLETE' END AS bytes,
CASE WHEN topology <> 'EXPLICIT_INDEX' THEN topology WHEN lost THEN 'INDEX_REFERENCES_MISSING_MEMBER' WHEN away > 0 THEN 'INCOMPLETE_REMOTE_MEMBERS' WHEN has_local AND gone > 0 THEN 'INCOMPLETE_LOCAL_MEMBERS' ELSE 'COMPLETE_FOR_EXPLICIT_TOPOLOGY_SCOPE' END AS status FROM t LEFT JOIN c USING (scope)""")
def shard_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required shards and companions, remotely and locally."""
    members, key, path = _members(spark, sf_dir), F.col("scope"), F.col("path")
    companion = drawn(path, "companion", 10) == 0
    away = F.col("touched") & (F.col("touch") == 1) & ((drawn(key, "shards", 2) == 0) | companion)
    remote = members.where(~away).select("scope", "path", F.when(drawn(key, "digests", 4) > 0, F.col("digest")).alias("digest"))
    scopes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("scope"), one_of(F.col("s_suppkey"), "topology", *_TOPOLOGY).alias("topology"), (drawn(F.col("s_suppkey"), "home", 4) > 0).alias("has_local"))
    return manifests.completeness(members.select("scope", "path", companion.alias("companion")), remote, _sides(spark, sf_dir)[1], scopes)


@query(f"""WITH {_LINES}, {_EXPECTED}, {_OBSERVED}, i AS (SELECT *, {drawn_sql("path", "id", 100000)} AS id FROM expected),
f AS (SELECT coalesce(i.scope, o.scope) AS scope, i.path AS ip, o.path AS op, i.size AS s1, o.size AS s2, i.digest AS d1, o.digest AS d2 FROM i FULL JOIN observed o ON i.scope = o.scope AND i.path = o.path),
c AS (SELECT scope, count(ip) AS n_files, count(*) FILTER (op IS NULL) AS n_missing, count(*) FILTER (ip IS NULL) AS n_undeclared, count(*) FILTER (s1 <> s2) AS n_size, count(*) FILTER (d1 <> d2) AS n_digest, sum(s1) IS NOT DISTINCT FROM sum(s2) AS total_matches FROM f GROUP BY 1),
u AS (SELECT scope, count(*) - count(DISTINCT digest) AS n_repeated_content, count(*) - count(DISTINCT id) AS n_repeated_ids FROM i GROUP BY 1)
SELECT scope, n_files, n_missing, n_undeclared, n_size, n_digest, coalesce(n_repeated_content, 0) AS n_repeated_content, coalesce(n_repeated_ids, 0) AS n_repeated_ids, total_matches,
total_matches AND n_missing + n_undeclared + n_size + n_digest + coalesce(n_repeated_content, 0) + coalesce(n_repeated_ids, 0) = 0 AS verified FROM c LEFT JOIN u USING (scope)""")
def artifact_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of files against their folder: the same files, sizes, digests and total, no content or id twice."""
    expected, observed = _sides(spark, sf_dir)
    return manifests.index_findings(expected.withColumn("id", drawn(F.col("path"), "id", 100000)), observed)
