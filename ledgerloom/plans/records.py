"""Queries over records under contracts and what is audited, hinted and linked: texts of documents as fields of records, orders as configurations, lines as shards."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import attestations, audits, numeric, records, texts, timelines
from ledgerloom.operators.compare import worked_out
from ledgerloom.plans.catalogue import query, table
from ledgerloom.plans.drawn import drawn, drawn_sql, one_of, one_of_sql

_BYTES, _DEPTH = 6000, 3
_NAMES = ("license", "repository", "revision")
_REVISIONS = ('"r1"', "null", '"main"', '"r2"', '""', "7", '"file:r"')
_LICENSES = ('"mit"', '"apache"', "null", '"mit"', '"/etc/license"', "true")
_ENDS = (*["}"] * 8, ', "revision": "r9"}', ', "size": 1, "n": 2}', "", "} {}", ', "deep": [[[1]]]}', '}, {"a": 1')
_OPEN = lambda t: f"length(replace(replace({t}, '}}', ''), ']', '')) - length(replace(replace({t}, '{{', ''), '[', ''))"
_BOUNDED = f"""r AS (SELECT doc_id, '{{"repository": "' || replace(replace(replace(text, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n') || '", "revision": ' || {one_of_sql("doc_id", "revision", *_REVISIONS)} || ', "license": ' || {one_of_sql("doc_id", "license", *_LICENSES)} || {one_of_sql("doc_id", "end", *_ENDS)} AS t FROM documents),
b AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(t, '\\\\.', '', 'g'), '"[^"]*"', '', 'g'), '[^][{{}}]', '', 'g') AS br FROM r),
s AS (SELECT doc_id, t, CASE WHEN t IS NULL THEN 'UNAVAILABLE' WHEN octet_length(encode(t)) > {_BYTES} THEN 'TOO_LARGE' WHEN list_max(list_transform(range(1, length(br) + 1), lambda i: {_OPEN("br[1:i]")})) > {_DEPTH} THEN 'TOO_DEEP' WHEN NOT json_valid(t) THEN 'BROKEN' WHEN len(json_keys(t)) > len(list_distinct(json_keys(t))) THEN 'BROKEN' WHEN json_type(t) <> 'OBJECT' THEN 'NO_OBJECT' ELSE 'READ' END AS read FROM b)"""


def _sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.replace(F.replace(F.replace("text", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    key = F.col("doc_id")
    parts = [F.lit('{"repository": "'), said, F.lit('", "revision": '), one_of(key, "revision", *_REVISIONS), F.lit(', "license": '), one_of(key, "license", *_LICENSES), one_of(key, "end", *_ENDS)]
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(*parts).alias("record"))


@query(f"WITH {_BOUNDED} SELECT doc_id, read AS status, CASE WHEN read = 'READ' THEN len(json_keys(t)) END::BIGINT AS n_names FROM s")
def bounded_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether records that hold whole documents can be read within bounds of bytes and depth."""
    found = records.bounded(_sidecars(spark, sf_dir), "doc_id", "record", _BYTES, _DEPTH)
    return found.select("doc_id", "status", F.size(F.map_keys("fields")).cast("long").alias("n_names"))


@query(f"""WITH {_BOUNDED}, k AS (SELECT doc_id, t, unnest(CASE WHEN read = 'READ' THEN list_sort(json_keys(t)) END) AS name FROM s WHERE read = 'READ'), v AS (SELECT doc_id, name, json_type(t, '$.' || name) AS kind, json_extract_string(t, '$.' || name) AS value FROM k),
f AS (SELECT doc_id, list(name ORDER BY name) FILTER (name NOT IN {_NAMES}) AS other, list(name ORDER BY name) FILTER (name IN {_NAMES} AND kind <> 'NULL' AND (kind <> 'VARCHAR' OR value = '')) AS blank, list(name ORDER BY name) FILTER (name IN {_NAMES} AND kind = 'VARCHAR' AND regexp_matches(value, '^(/|file:)')) AS rooted FROM v GROUP BY 1)
SELECT doc_id, CASE WHEN read <> 'READ' THEN read WHEN other IS NOT NULL THEN 'UNSUPPORTED_NAMES' WHEN blank IS NOT NULL THEN 'NO_TEXT' WHEN rooted IS NOT NULL THEN 'ABSOLUTE_PATH' ELSE 'AVAILABLE' END AS status, array_to_string(coalesce(other, blank, rooted, []), ',') AS faults,
CASE WHEN coalesce(other, blank, rooted) IS NULL AND read = 'READ' THEN json_extract_string(t, '$.revision') END AS revision, CASE WHEN coalesce(other, blank, rooted) IS NULL AND read = 'READ' THEN length(json_extract_string(t, '$.repository')) END::BIGINT AS n_repository FROM s LEFT JOIN f USING (doc_id)""")
def provenance_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provenance that comes beside an artifact: a closed set of names, each a text that is no absolute path."""
    found = records.sidecars(_sidecars(spark, sf_dir), "doc_id", "record", _NAMES, _BYTES, _DEPTH)
    return found.select("doc_id", "status", F.array_join("faults", ",").alias("faults"), "revision", F.char_length("repository").cast("long").alias("n_repository"))


_CONTRACT = {"architectures": "texts", "model_type": "text", "tied": "flag", "hidden": "count", "heads": "count", "vocabulary": "count"}
_CONFIGS = f"""c AS (SELECT o_orderkey AS k, '{{"architectures": ' || {one_of_sql("o_orderkey", "made", '["A", "ForLM"]', '["ForLM"]', '["ForLM", "B"]', '["ForLM"]', '["C"]', "[]", '["ForLM", ""]', '"ForLM"')} || ', "model_type": "' || lower(o_orderstatus) || '", "hidden": ' || (o_custkey * 8) || ', "heads": ' || ({drawn_sql("o_orderkey", "heads", 7)} - 1) || ', "vocabulary": ' || CASE WHEN o_orderkey % 23 = 5 THEN o_totalprice::VARCHAR ELSE (o_orderkey + 1)::VARCHAR END || CASE WHEN o_orderkey % 29 = 3 THEN '' ELSE ', "tied": ' || {one_of_sql("o_orderkey", "tied", *["true", "false"] * 5, '"true"', "0")} END || '}}' AS t FROM orders)"""


def _type_sql(name: str, kind: str) -> str:
    path = f"t, '$.{name}'"
    own = {"text": f"json_type({path}) = 'VARCHAR' AND json_extract_string({path}) <> ''", "count": f"json_type({path}) IN ('UBIGINT', 'BIGINT') AND json_extract_string({path})::DOUBLE > 0", "flag": f"json_type({path}) = 'BOOLEAN'"}
    listed = f"json_type({path}) = 'ARRAY' AND json_array_length({path}) > 0 AND NOT list_contains(json_extract_string(t, '$.{name}[*]'), '')"
    return f"CASE WHEN NOT coalesce({own.get(kind, listed)}, false) THEN 'TYPE:{name}' END"


@query(f"""WITH {_CONFIGS}, w AS (SELECT k, t, concat_ws(',', {", ".join(_type_sql(n, kind) for n, kind in _CONTRACT.items())}) AS wrong FROM c),
l AS (SELECT *, CASE WHEN wrong <> '' THEN wrong ELSE concat_ws(',', CASE WHEN NOT list_contains(json_extract_string(t, '$.architectures[*]'), 'ForLM') THEN 'FAMILY:architectures' END, CASE WHEN json_extract_string(t, '$.model_type') <> 'o' THEN 'FAMILY:model_type' END, CASE WHEN json_extract_string(t, '$.hidden')::BIGINT % json_extract_string(t, '$.heads')::BIGINT <> 0 THEN 'DIVIDES:heads:hidden' END) END AS findings FROM w)
SELECT k, CASE WHEN findings = '' THEN 'VALID' ELSE 'INVALID' END AS status, findings, CASE WHEN NOT contains(wrong, 'TYPE:heads') THEN json_extract_string(t, '$.heads')::BIGINT END AS heads, CASE WHEN NOT contains(wrong, 'TYPE:tied') THEN json_extract_string(t, '$.tied')::BOOLEAN END AS tied FROM l""")
def typed_configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configurations under a contract of types, a family, and counts that divide others."""
    k, orders = F.col("o_orderkey"), table(spark, sf_dir, "orders")
    made = one_of(k, "made", '["A", "ForLM"]', '["ForLM"]', '["ForLM", "B"]', '["ForLM"]', '["C"]', "[]", '["ForLM", ""]', '"ForLM"')
    size = F.when(k % 23 == 5, F.col("o_totalprice").cast("string")).otherwise((k + 1).cast("string"))
    tied = F.when(k % 29 == 3, "").otherwise(F.concat(F.lit(', "tied": '), one_of(k, "tied", *["true", "false"] * 5, '"true"', "0")))
    text = F.concat(F.lit('{"architectures": '), made, F.lit(', "model_type": "'), F.lower("o_orderstatus"), F.lit('", "hidden": '), (F.col("o_custkey") * 8).cast("string"), F.lit(', "heads": '), (drawn(k, "heads", 7) - 1).cast("string"), F.lit(', "vocabulary": '), size, tied, F.lit("}"))
    found = records.configurations(orders.select(k.alias("k"), text.alias("t")), "k", "t", _CONTRACT, [("architectures", "ForLM"), ("model_type", "o")], [("heads", "hidden")], 65_536, 8)
    return found.select("k", "status", F.array_join("findings", ",").alias("findings"), "heads", "tied")


@query(f"""WITH d AS (SELECT doc_id, coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || doc_id AS path, octet_length(encode(coalesce(text, '')))::BIGINT AS size, md5(coalesce(text, '')) AS digest FROM documents),
b AS (SELECT path, size, digest FROM d WHERE {drawn_sql("doc_id", "in_baseline", 9)} > 0), i AS (SELECT path, size, digest FROM d WHERE {drawn_sql("doc_id", "in_index", 4)} = 0 UNION ALL SELECT path, size + 1, digest FROM d WHERE {drawn_sql("doc_id", "again", 20)} = 0), c AS (SELECT path, CASE WHEN {drawn_sql("doc_id", "edited", 12)} = 0 THEN size + 1 ELSE size END AS size, digest FROM d WHERE {drawn_sql("doc_id", "still", 15)} > 0),
j AS (SELECT path, b.size AS bs, b.digest AS bd, n, own_s, own_d, c.size AS cs, c.digest AS cd FROM b FULL JOIN (SELECT path, count(DISTINCT (size, digest)) AS n, min(size) AS own_s, min(digest) AS own_d FROM i GROUP BY 1) USING (path) FULL JOIN c USING (path)),
o AS (SELECT *, CASE WHEN bs IS NOT NULL AND (regexp_matches(path, '^src[0-2]/') OR n IS NOT NULL) THEN 'BASELINE' WHEN bs IS NOT NULL THEN 'EXCLUDED' WHEN n IS NOT NULL THEN 'DECLARED' ELSE 'ADDED' END AS origin FROM j)
SELECT path, origin, CASE WHEN origin = 'EXCLUDED' THEN origin WHEN bs IS NULL AND n > 1 THEN 'CONFLICT' WHEN origin = 'ADDED' THEN origin WHEN cs IS NULL THEN 'MISSING' WHEN cs = coalesce(bs, own_s) AND cd = coalesce(bd, own_d) THEN 'UNCHANGED' ELSE 'CHANGED' END AS state, CASE WHEN origin = 'EXCLUDED' THEN CASE WHEN contains(path, '/en/') THEN 'ENGLISH' WHEN contains(path, 'none') THEN 'UNNAMED' ELSE 'OTHER' END END AS reason FROM o""")
def path_preservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every path of a baseline, of indexes and of now: unchanged, changed, missing, added, in conflict or excluded with a reason."""
    key, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), key.cast("string"))
    d = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.octet_length(text).cast("long").alias("size"), F.md5(text).alias("digest"))
    row = ("path", "size", "digest")
    declared = d.where(drawn(key, "in_index", 4) == 0).select(*row).union(d.where(drawn(key, "again", 20) == 0).select("path", F.col("size") + 1, "digest"))
    current = d.where(drawn(key, "still", 15) > 0).select("path", (F.col("size") + F.when(drawn(key, "edited", 12) == 0, 1).otherwise(0)).alias("size"), "digest")
    return audits.preserved(d.where(drawn(key, "in_baseline", 9) > 0).select(*row), declared, current, F.col("path").rlike("^src[0-2]/"), [("ENGLISH", "/en/"), ("UNNAMED", "none")])


@query(f"""WITH m AS (SELECT CASE WHEN page_id % 3 = 0 THEN 'queries' ELSE regexp_extract(url, '([a-z]+)([?#].*)?$', 1) || page_id % 50 END AS scope, regexp_replace(CASE WHEN page_id % 3 = 0 AND page_id % 2 = 0 THEN url ELSE regexp_replace(url, '^[a-z]+://[^/]*/', '') END, '[?#].*$', '') || {one_of_sql("page_id", "ending", ".safetensors", ".bin", ".gguf", ".txt", ".ckpt", "")} AS path FROM pages),
h AS (SELECT DISTINCT scope, path FROM m WHERE regexp_matches(path, '\\.(safetensors|bin|gguf|ckpt)$')), n AS (SELECT *, count(*) OVER (PARTITION BY scope, lower(path)) > 1 OR contains(path, ':') OR path LIKE '/%' OR contains(path, '//') OR EXISTS (SELECT 1 FROM h o WHERE o.scope = h.scope AND starts_with(o.path, h.path || '/')) AS bad FROM h)
SELECT scope, path, 'FILENAME_HEURISTIC' AS source, CASE WHEN sum(bad::INT) OVER (PARTITION BY scope) > 0 THEN 'REJECTED' ELSE 'HEURISTIC_ONLY' END AS status, count(*) OVER (PARTITION BY scope) AS n_hints, (sum(bad::INT) OVER (PARTITION BY scope))::BIGINT AS n_faults FROM n""")
def shard_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members whose names look like shards, as hints that no index backs; those of a scope with paths that are not portable are rejected."""
    k, url = F.col("page_id"), F.col("url")
    scope = F.when(k % 3 == 0, "queries").otherwise(F.concat(F.regexp_extract(url, "([a-z]+)([?#].*)?$", 1), (k % 50).cast("string")))
    whole = F.when((k % 3 == 0) & (k % 2 == 0), url).otherwise(F.regexp_replace(url, "^[a-z]+://[^/]*/", ""))
    path = F.concat(F.regexp_replace(whole, "[?#].*$", ""), one_of(k, "ending", ".safetensors", ".bin", ".gguf", ".txt", ".ckpt", ""))
    return audits.hints(table(spark, sf_dir, "pages").select(scope.alias("scope"), path.alias("path")), "scope", "path", r"\.(?:safetensors|bin|gguf|ckpt)$")


@query(f"""WITH s AS (SELECT l_orderkey AS k, 'part-' || l_linenumber AS path, l_quantity AS n, l_partkey AS size, md5(l_partkey || ':' || l_suppkey) AS inventory FROM lineitem), u AS (SELECT k, path, max(n) AS n, max(size) AS size, max(inventory) AS inventory FROM s GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, path) = 1 AS prime FROM u),
w AS (SELECT o_orderkey AS k, {drawn_sql("o_orderkey", "split", 25)} > 0 AS intact, o_custkey AS repository, o_orderstatus AS policy FROM orders WHERE {drawn_sql("o_orderkey", "known", 30)} > 0), top AS (SELECT * FROM p WHERE prime),
h AS (SELECT o_orderkey AS k, CASE WHEN {drawn_sql("o_orderkey", "other", 6)} = 0 THEN 'part-' || ({drawn_sql("o_orderkey", "which", 9)} + 1) ELSE top.path END AS path, {drawn_sql("o_orderkey", "header", 25)} > 0 AS intact, CASE WHEN {drawn_sql("o_orderkey", "repo", 15)} = 0 THEN -1 ELSE o_custkey END AS repository, CASE WHEN {drawn_sql("o_orderkey", "policy", 15)} > 0 THEN o_orderstatus END AS policy,
top.size + CASE WHEN {drawn_sql("o_orderkey", "size", 15)} = 0 THEN 1 ELSE 0 END AS size, CASE WHEN {drawn_sql("o_orderkey", "digest", 15)} = 0 THEN 'x' ELSE top.inventory END AS inventory FROM orders LEFT JOIN top ON top.k = o_orderkey)
SELECT h.k, h.path, CASE WHEN w.k IS NULL THEN 'SPLIT_UNKNOWN' WHEN NOT w.intact THEN 'SPLIT_BROKEN' WHEN NOT h.intact THEN 'HEADER_BROKEN' WHEN p.path IS NULL THEN 'NOT_IN_SPLIT' WHEN NOT prime THEN 'NOT_PRIMARY' WHEN d <> '' THEN 'MISMATCH' ELSE 'LINKED' END AS status, CASE WHEN prime THEN d ELSE '' END AS mismatches
FROM h LEFT JOIN w USING (k) LEFT JOIN p ON p.k = h.k AND p.path = h.path, LATERAL (SELECT concat_ws(',', CASE WHEN h.inventory IS DISTINCT FROM p.inventory THEN 'inventory' END, CASE WHEN h.repository IS DISTINCT FROM w.repository THEN 'repository' END, CASE WHEN h.size IS DISTINCT FROM p.size THEN 'size' END, CASE WHEN h.policy IS DISTINCT FROM w.policy THEN 'policy' END) AS d)""")
def header_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the header that metadata was read from is that of the shard with the most metadata, and agrees with it and with its split."""
    lines, orders, k = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"), F.col("o_orderkey")
    inventory = F.md5(F.concat_ws(":", "l_partkey", "l_suppkey"))
    shards = lines.groupBy(F.col("l_orderkey").alias("k"), F.concat(F.lit("part-"), F.col("l_linenumber").cast("string")).alias("path")).agg(F.max("l_quantity").alias("n_metadata"), F.max("l_partkey").alias("size"), F.max(inventory).alias("inventory"))
    splits = orders.where(drawn(k, "known", 30) > 0).select(k.alias("k"), (drawn(k, "split", 25) > 0).alias("intact"), F.col("o_custkey").alias("repository"), F.col("o_orderstatus").alias("policy"))
    first = shards.groupBy("k").agg(F.min_by(F.struct("path", "size", "inventory"), F.struct(-F.col("n_metadata"), F.col("path"))).alias("top"))
    both = orders.join(first, k == F.col("k"), "left")
    path = F.when(drawn(k, "other", 6) == 0, F.concat(F.lit("part-"), (drawn(k, "which", 9) + 1).cast("string"))).otherwise(F.col("top.path"))
    headers = both.select(
        k.alias("k"), path.alias("path"), (drawn(k, "header", 25) > 0).alias("intact"), F.when(drawn(k, "repo", 15) == 0, -1).otherwise(F.col("o_custkey")).alias("repository"),
        F.when(drawn(k, "policy", 15) > 0, F.col("o_orderstatus")).alias("policy"), (F.col("top.size") + F.when(drawn(k, "size", 15) == 0, 1).otherwise(0)).alias("size"), F.when(drawn(k, "digest", 15) == 0, "x").otherwise(F.col("top.inventory")).alias("inventory"),
    )
    found = audits.linked(headers, splits, shards, "k", [("inventory", "shards"), ("repository", "splits"), ("size", "shards"), ("policy", "splits")])
    return found.withColumn("mismatches", F.coalesce(F.array_join("mismatches", ","), F.lit("")))


_PROFILES = {"evidence": ([], ["artifact"]), "purchase": (["purchase"], ["artifact", "signature"]), "view": (["view"], [])}


@query(f"""WITH a AS (SELECT event_id, user_id, event_type, {one_of_sql("event_id", "profile", "evidence", "purchase", "view", "evidence", "none")} AS profile, [CASE WHEN {drawn_sql("event_id", "artifact", 5)} > 0 THEN 'artifact' END, CASE WHEN {drawn_sql("event_id", "signature", 3)} > 0 THEN 'signature' END] AS held FROM events),
c AS (SELECT *, 'custody_segment_' || left(sha256('{{"event_id":' || event_id || ',"user_id":' || coalesce(user_id::VARCHAR, 'null') || '}}'), 32) AS chain_id, CASE WHEN profile <> 'none' THEN coalesce(array_to_string(list_sort(CASE profile WHEN 'evidence' THEN [CASE WHEN NOT list_contains(held, 'artifact') THEN 'concept:artifact' END] WHEN 'purchase' THEN [CASE WHEN NOT list_contains(held, 'artifact') THEN 'concept:artifact' END, CASE WHEN NOT list_contains(held, 'signature') THEN 'concept:signature' END, CASE WHEN event_type IS DISTINCT FROM 'purchase' THEN 'type:purchase' END]
WHEN 'view' THEN [CASE WHEN event_type IS DISTINCT FROM 'view' THEN 'type:view' END] END), ','), '') END AS missing FROM a),
e AS (SELECT *, CASE WHEN missing IS NULL THEN 'UNKNOWN_PROFILE' WHEN missing <> '' THEN 'INCOMPLETE' ELSE 'INTACT' END AS status, sha256('{{"chain_id":"' || chain_id || '","event_id":' || event_id || ',"event_type":' || coalesce('"' || event_type || '"', 'null') || ',"previous":null,"sequence":0,"user_id":' || coalesce(user_id::VARCHAR, 'null') || '}}') AS event_digest FROM c)
SELECT event_id, chain_id, event_digest, sha256('{{"chain_id":"' || chain_id || '","latest":"' || event_digest || '","profile":"' || profile || '","status":"' || status || '"}}') AS ledger_digest, missing, status FROM e""")
def attestation_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segment of custody that each attestation begins, and what its profile lacks."""
    key = F.col("event_id")
    held = F.array_compact(F.array(F.when(drawn(key, "artifact", 5) > 0, "artifact"), F.when(drawn(key, "signature", 3) > 0, "signature")))
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", one_of(key, "profile", "evidence", "purchase", "view", "evidence", "none").alias("profile"), held.alias("held"))
    return attestations.segments(rows, "event_id", ["event_id", "user_id"], "event_type", "held", "profile", _PROFILES).withColumn("missing", F.array_join("missing", ","))


@query(f"""WITH f AS (SELECT user_id, CASE WHEN user_id % 11 > 0 AND {drawn_sql("event_id", "dated", 8)} > 0 AND (user_id % 5 > 0 OR ts > TIMESTAMP '2024-01-20 00:00:00') THEN ts END AS t FROM events), g AS (SELECT user_id, count(t) AS n, max(t) FILTER (t <= TIMESTAMP '2024-01-10 00:00:00') AS p, max(t) FILTER (t <= TIMESTAMP '2024-02-05 00:00:00') AS q FROM f GROUP BY 1),
s AS (SELECT user_id, CASE WHEN n = 0 THEN 'TIME_UNKNOWN' WHEN p IS NULL THEN 'NOT_YET' WHEN epoch_us(TIMESTAMP '2024-01-10 00:00:00') - epoch_us(p) <= 86400000000 THEN 'FRESH' ELSE 'STALE' END AS previous, CASE WHEN n = 0 THEN 'TIME_UNKNOWN' WHEN q IS NULL THEN 'NOT_YET' WHEN epoch_us(TIMESTAMP '2024-02-05 00:00:00') - epoch_us(q) <= 518400000000 THEN 'FRESH' ELSE 'STALE' END AS new FROM g) SELECT *, previous <> new AS changed FROM s""")
def freshness_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How fresh the evidence about each user is under two contexts; some have no time, some are known later only."""
    user = F.col("user_id")
    there = (user % 11 > 0) & (drawn(F.col("event_id"), "dated", 8) > 0) & ((user % 5 > 0) | (F.col("ts") > F.lit("2024-01-20").cast("timestamp_ntz")))
    facts = table(spark, sf_dir, "events").select("user_id", F.when(there, F.col("ts")).alias("at"))
    return timelines.freshness_transitions(facts, "user_id", "at", ("2024-01-10 00:00:00", 86_400), ("2024-02-05 00:00:00", 518_400))


_FORMS = f"""f AS (SELECT DISTINCT unnest([strftime(l_shipdate, '%Y-%m-') || lpad(({drawn_sql("l_orderkey", "day", 33)})::VARCHAR, 2, '0') || 'T' || lpad(({drawn_sql("l_partkey", "hour", 26)})::VARCHAR, 2, '0') || ':00:00Z', {one_of_sql("l_partkey", "sign", "", "-", "+", "0", "1e")} || floor(l_extendedprice)::INTEGER || {one_of_sql("l_suppkey", "tail", "", ".50", "e-3", ".", "E12")}, l_quantity::INTEGER || ' in /' || {one_of_sql("l_orderkey", "root", "home", "data", "etc", "usr")} || '/' || l_suppkey]) AS t FROM lineitem
UNION SELECT unnest(string_split(regexp_replace(coalesce(text, ''), '\\n', ' ', 'g'), ' ')) FROM documents)"""


@query(f"""WITH {_FORMS} SELECT t, regexp_full_match(t, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}Z') AND try_strptime(t, '%Y-%m-%dT%H:%M:%SZ') IS NOT NULL AS is_utc, regexp_full_match(t, '-?(0|[1-9][0-9]*)(\\.[0-9]+)?([eE][+-]?[0-9]{{1,4}})?') AND length(ltrim(regexp_replace(regexp_replace(t, '[eE].*$', ''), '[^0-9]', '', 'g'), '0')) <= 100 AS is_decimal,
regexp_matches(t, '(^|[\\s"''=:])(/(home|root|etc|usr|var|tmp)/|[A-Za-z]:\\\\)|Bearer\\s|Authorization:|-----BEGIN [A-Z ]*PRIVATE KEY|(password|secret|token)\\s*[:=]') AS is_unsafe FROM f""")
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates and prices of lines, written in many forms, and the words of all documents: which are times, decimals or unsafe to show."""
    lines, part, order, supp = table(spark, sf_dir, "lineitem"), F.col("l_partkey"), F.col("l_orderkey"), F.col("l_suppkey")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    time = F.concat(F.date_format("l_shipdate", "yyyy-MM-"), two(drawn(order, "day", 33)), F.lit("T"), two(drawn(part, "hour", 26)), F.lit(":00:00Z"))
    price = F.concat(one_of(part, "sign", "", "-", "+", "0", "1e"), F.floor("l_extendedprice").cast("int").cast("string"), one_of(supp, "tail", "", ".50", "e-3", ".", "E12"))
    place = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" in /"), one_of(order, "root", "home", "data", "etc", "usr"), F.lit("/"), supp.cast("string"))
    words = table(spark, sf_dir, "documents").select(F.explode(F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "\n", " "), " ")).alias("t"))
    rows = lines.select(F.explode(F.array(time, price, place)).alias("t")).union(words).distinct()
    return worked_out(rows, is_utc=texts.utc(F.col("t")), is_decimal=numeric.decimal_grammar(F.col("t")), is_unsafe=texts.unsafe(F.col("t")))
