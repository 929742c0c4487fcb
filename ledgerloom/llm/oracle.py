"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from ledgerloom.llm import secrets
from ledgerloom.llm.mixing import WORD

OP2 = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256, length(coalesce(text, '')) AS n FROM documents),
k AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER w AS place
      FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM k
"""


def _apportion(name: str, rows: str, within: str, key: str, weight: str, seats: str) -> str:
    """Common table expressions that end in ``name``: ``rows`` with ``won``, by ranking every quotient that any party could win with."""
    return f"""
{name}_asked AS (SELECT {within} AS w, {key} AS k, {seats} AS seats, {weight} / (2 * unnest(generate_series(0, {seats})) + 1) AS quotient FROM {rows} WHERE {weight} > 0),
{name}_ranked AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY quotient DESC, k NULLS LAST) AS rank FROM {name}_asked),
{name}_won AS (SELECT w, k, count(*) AS won FROM {name}_ranked WHERE rank <= seats GROUP BY 1, 2),
{name} AS (SELECT r.*, coalesce(x.won, 0) AS won FROM {rows} r LEFT JOIN {name}_won x ON r.{within} IS NOT DISTINCT FROM x.w AND r.{key} IS NOT DISTINCT FROM x.k)"""


OP7 = rf"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_rows FROM sized GROUP BY source),
s1 AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, (3 * source_size)::DOUBLE AS cap FROM s0),
s2 AS (SELECT *, cap / weight AS ratio FROM s1),
s3 AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
       / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2),
s4 AS (SELECT *, max(CASE WHEN level <= ratio THEN level END) OVER () AS common FROM s3),
s5 AS (SELECT source, source_size, n_rows, round(least(cap, common * weight), 6) AS target, 0 AS a, round((sum(source_size) OVER ())::DOUBLE / 8)::BIGINT AS blocks FROM s4),
{_apportion("s6", "s5", "a", "source", "target", "blocks")},
d1 AS (SELECT d.*, s.source_size, s.target, s.won AS source_seats, md5('0:' || coalesce(d.doc_id::VARCHAR, 'null')) AS key, ceil(s.n_rows / 1024)::BIGINT AS n_shards
       FROM sized d JOIN s6 s ON d.source IS NOT DISTINCT FROM s.source),
d2 AS (SELECT *, ('0x' || substr(key, 1, 8))::BIGINT % n_shards AS shard FROM d1),
h1 AS (SELECT source, shard, sum(size)::DOUBLE AS shard_size, first(source_seats) AS source_seats FROM d2 GROUP BY 1, 2),
{_apportion("h2", "h1", "source", "shard", "shard_size", "source_seats")},
d3 AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source, shard ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d2),
d4 AS (SELECT d.*, h.shard_size::BIGINT AS shard_size, least(h.won * 8, 3 * h.shard_size::BIGINT)::BIGINT AS words
       FROM d3 d JOIN h2 h ON d.source IS NOT DISTINCT FROM h.source AND d.shard = h.shard)
SELECT doc_id, size, source_size, target,
       CASE WHEN shard_size = 0 THEN 0 ELSE (words // shard_size) * size + greatest(0, least(size, words % shard_size - start)) END::BIGINT AS taken FROM d4
"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Every pair of texts that share a shingle, and all that links reach: for small tables.
OP8 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i+4], ' '))) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * n_both >= 75 * (x.n + y.n - n_both)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY 1)
SELECT c.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id
"""


#: Profiles of all documents that are not held out.
OP6 = r"""
WITH crc AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(generate_series(1, len(doc_id::VARCHAR)), lambda i: ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, z: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)), 4294967295) % 4 = 2 AS held_out FROM documents),
t AS (SELECT d.doc_id, lang, held_out, '_' || trim(regexp_replace(lower(text), '[^\p{L}]+', '_', 'g'), '_') || '_' AS t FROM documents d JOIN crc USING (doc_id) WHERE text IS NOT NULL AND regexp_matches(text, '\p{L}')),
g AS (SELECT doc_id, lang, held_out, unnest(list_concat(list_filter(list_transform(generate_series(1, len(t)), lambda i: substr(t, i::INT, 1)), lambda x: x <> '_'), list_transform(generate_series(1, len(t) - 1), lambda i: substr(t, i::INT, 2)), list_transform(generate_series(1, len(t) - 2), lambda i: substr(t, i::INT, 3)))) AS g FROM t),
c AS (SELECT doc_id, lang, held_out, g, count(*) AS n FROM g GROUP BY ALL),
p AS (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, len(g), g) - 1 AS place FROM c WHERE lang IS NOT NULL AND NOT held_out GROUP BY lang, g QUALIFY place < 400),
o AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, len(g), g) - 1 AS place FROM c QUALIFY place < 400),
s AS (SELECT doc_id, count(*) AS m FROM o GROUP BY 1), l AS (SELECT DISTINCT lang FROM p),
gain AS (SELECT doc_id, p.lang, sum(400 - abs(p.place - o.place))::BIGINT AS gain FROM o JOIN p USING (g) GROUP BY 1, 2),
far AS (SELECT s.doc_id, l.lang, (400 * m - coalesce(gain, 0))::DOUBLE / (400 * m)::DOUBLE AS far FROM s CROSS JOIN l LEFT JOIN gain ON gain.doc_id = s.doc_id AND gain.lang = l.lang),
r AS (SELECT doc_id, arg_min(lang, (far, lang)) AS best, min(far) AS f1, list_sort(list(far))[2] AS f2 FROM far GROUP BY 1)
SELECT d.doc_id, held_out, coalesce(best, 'und') AS lang_pred, CASE WHEN best IS NULL THEN 0.0 WHEN f2 IS NULL THEN 1.0 WHEN f2 = 0 THEN 0.0 ELSE (f2 - f1) / f2 END AS score, coalesce(1 - f1, 0.0) AS nearness FROM documents d JOIN crc USING (doc_id) LEFT JOIN r USING (doc_id)
"""


def _op10() -> str:
    parts = []
    for k, r in enumerate((*secrets.BASE, *secrets.MORE)):
        p = r.pattern.replace("'", "''")
        parts.append(f"""SELECT d.doc_id, {k} AS rank, '{r.kind}' AS kind, m.i AS i, whole, confirm, pieces FROM (SELECT doc_id, regexp_extract_all(t, '{p}', 0) AS whole,
          regexp_extract_all(t, '{p}', {r.group}) AS confirm, string_split_regex(t, '{p}') AS pieces FROM t) d, unnest(generate_series(1, len(whole))) AS m(i)
          WHERE len(confirm[m.i]) >= {r.least}""")
    rows = " UNION ALL ".join(parts)
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
hits AS ({rows}),
spans AS (SELECT doc_id, rank, kind, (coalesce(list_sum(list_transform(pieces[1:i], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(whole[1:i-1], lambda x: len(x))), 0))::BIGINT AS s, len(whole[i]) AS n FROM hits),
said AS (SELECT *, kind || ':' || s || ':' || (s + n) AS said FROM spans),
g AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
      string_agg(said, ',' ORDER BY s, rank) FILTER (rank < 3) AS base, string_agg(said, ',' ORDER BY s, rank) AS spans FROM said GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN g ON t.doc_id = g.doc_id
"""


OP10 = _op10()


OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT row, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
l AS (SELECT lang, term, count(*) AS lang_count FROM t GROUP BY 1, 2 HAVING count(DISTINCT row) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN l USING (lang, term) GROUP BY 1, 2, 3),
v AS (SELECT lang, count(*) AS v, sum(lang_count) AS lang_total FROM l GROUP BY 1),
g AS (SELECT lang, source, coalesce(max(v), 0) AS v, max(lang_total) AS lang_total, coalesce(sum(n), 0) AS total
      FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) LEFT JOIN v USING (lang) GROUP BY 1, 2),
s AS (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (total + v) AS p,
             1 + (1000000000::HUGEINT * (lang_count + 1)) // (lang_total + v) AS q FROM g JOIN l USING (lang) LEFT JOIN c USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM s a JOIN s b USING (lang, term) WHERE a.source <> b.source GROUP BY 1, 2, 3),
valued AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
           FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
           UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM s WHERE n > 0 AND p > q),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM valued)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""

OP11 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, list_inner_product(a.v, b.v)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY rank <= 10
"""
