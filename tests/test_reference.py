"""Every reference query against its SQL, and the kernels on small edge cases."""

import hashlib
import json
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import values
from ledgerloom.operators import assess, compare, components, evidence, graphs, paths, sequences
from ledgerloom.operators import attestations, manifests, mappings, numeric, parity, policies, splits, structures, texts, timelines, written
from ledgerloom.plans import assessments, catalogue  # noqa: F401
from ledgerloom.plans import attestations as _a, manifests as _b, mappings as _c, parity as _d, policies as _e, rollups as _i, sources as _f, structures as _g, timelines as _h, inventories as _j, records as _k, validations as _l  # noqa: E401, F401
from ledgerloom.sources import files, model_files
from ledgerloom.streaming import claims

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return f"{v:.6g}" if isinstance(v, float) and not math.isnan(v) else str(v)


def test_every_query_has_sql():
    assert sorted(catalogue.QUERIES) == sorted(catalogue.ORACLE_SQL) and len(catalogue.QUERIES) > 130


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    found = duck.execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert ours == sorted(tuple(plain(v) for v in r) for r in found.fetchall())


def test_compare_nulls_and_single_sides(spark):
    schema = "k int, a string"
    e = spark.createDataFrame([(1, None), (2, "x"), (3, "x"), (4, None)], schema)
    o = spark.createDataFrame([(1, None), (2, "y"), (5, "x"), (4, "z")], schema)
    found = {r.k: r.findings for r in compare.compare(e, o, "k", {"a": "A"}).collect()}
    assert found == {1: [], 2: ["A"], 3: ["MISSING"], 4: ["A"], 5: ["UNEXPECTED"]}
    assert compare.compare(e.limit(0), o.limit(0), "k", {"a": "A"}).count() == 0


def test_overlap_variants_differ(spark):
    spans = spark.createDataFrame([(1, 0, 100), (1, 10, 20), (1, 30, 40), (1, 120, 130)], "g int, s int, e int")
    rows = sequences.overlaps(spans, "g", "s", "e").orderBy("s").collect()
    assert [r.adjacent_overlap for r in rows] == [False, True, False, False]
    assert [r.running_overlap for r in rows] == [False, True, True, False]
    assert [r.gap for r in rows] == [0, 0, 0, 20]


def test_reach_ends_in_cycles_and_fails_beyond_its_levels(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.level) for r in graphs.reach(edges, start).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    with pytest.raises(ValueError, match="LIMIT_EXCEEDED"):
        graphs.reach(edges, start, most_levels=1)


def test_examples_are_capped_and_counts_are_not(spark):
    rows = spark.range(100).select(F.lit("g").alias("g"), F.col("id"))
    assert [tuple(r) for r in evidence.examples(rows, "g", "id", 3).collect()] == [("g", 100, "0,1,2")]


def test_unplaceable_nodes_are_those_behind_rings(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("x", "y")], "src string, dst string")
    assert {r.node for r in components.unplaceable(edges).collect()} == {"b", "c", "d"}
    assert components.unplaceable(edges.where("src in ('a', 'x')")).count() == 0


def test_trust_paths_prefer_scope_then_nearness(spark):
    rows = [("s", "m", True), ("m", "r", True), ("t", "m", False), ("u", "v", True), ("v", "u", True), ("r", "r2", True)]
    delegations = spark.createDataFrame(rows, "child string, parent string, valid boolean")
    subjects = spark.createDataFrame([(x,) for x in "stur"], "node string")
    roots = spark.createDataFrame([("r",), ("r2",)], "node string")
    found = {r.node: (r.depth, r.root, r.status) for r in graphs.trust_paths(delegations, subjects, roots).collect()}
    assert found == {"s": (2, "r", "TRUSTED"), "t": (None, None, "OUT_OF_SCOPE"), "u": (None, None, "NO_ROOT"), "r": (0, "r", "TRUSTED")}


def test_ranked_tables(spark):
    a = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (3, "d")], "rank int, item string")
    b = spark.createDataFrame([(0, "a"), (1, "c"), (2, "x")], "rank int, item string")
    assert {r["rank"]: r.status for r in assess.ranked_tables(a, b, "rank", "item").collect()} == {0: "MATCH", 1: "OPERAND", 2: "ORDER", 3: "MISSING"}
    assert {r["rank"]: r.status for r in assess.ranked_tables(b, a, "rank", "item").collect()}[3] == "EXTRA"


def test_numbered_sets(spark):
    names = ["a-00001-of-00002", "a-00002-of-00002", "b-00002-of-00002", "c-00003-of-00002", "d-00001-of-00001", "d-00001-of-00001", "plain", None]
    rows = assess.numbered_sets(spark.createDataFrame([(n,) for n in names], "name string"), "name").collect()
    assert {r.base: (r.n_missing, r.status) for r in rows} == {"a": (0, "COMPLETE"), "b": (1, "INCOMPLETE"), "c": (1, "INVALID"), "d": (0, "DUPLICATE")}


def test_separation_with_unknown_parties(spark):
    asked = spark.createDataFrame([(1, 5), (2, 5), (3, None), (4, 5)], "k int, who int")
    given = spark.createDataFrame([(1, 5), (1, None), (2, 6), (3, 6)], "k int, by int")
    found = {r.k: (r.n_approvals, r.n_same, r.status) for r in assess.separation(asked, given, "k", "who", "by").collect()}
    assert found == {1: (2, 1, "VIOLATED"), 2: (1, 0, "SATISFIED"), 3: (1, 0, "NOT_IDENTIFIED"), 4: (0, 0, "NOT_EVALUATED")}


def test_values(spark):
    row = spark.range(1).select(
        values.greatest_common_divisor(F.lit(84), F.lit(36)).alias("g"), values.presence(F.lit('{"a": null, "b": 1}'), "a").alias("a"), values.presence(F.lit('{"b": 1}'), "a").alias("none"),
        values.presence(F.lit('{"b": 1}'), "b").alias("b"), values.redacted(F.lit("secret"), 2).alias("r"),
        (values.domain_digest("d", F.lit("ab"), F.lit("c")) == values.domain_digest("d", F.lit("a"), F.lit("bc"))).alias("same"),
    ).first()
    assert (row.g, row.a, row.none, row.b, row.r, row.same) == (12, "NULL", "ABSENT", "VALUE", "se…+4", False)


def _tensor_file(path, tensors, payload):
    head = json.dumps(tensors).encode()
    path.write_bytes(len(head).to_bytes(8, "little") + head + payload)


def test_tensor_headers_are_checked_without_payloads(spark, tmp_path):
    t = lambda dtype, shape, a, b: {"dtype": dtype, "shape": shape, "data_offsets": [a, b]}
    _tensor_file(tmp_path / "a b.safetensors", {"__metadata__": {"x": "y"}, "w": t("F32", [2, 2], 0, 16), "v": t("U8", [4], 16, 20)}, bytes(20))
    _tensor_file(tmp_path / "bad.safetensors", {"x": t("F16", [3], 0, 4), "y": t("U8", [4], 2, 6), "z": t("Q9", [1], 6, 7), "far": t("U8", [9], 7, 16)}, bytes(8))
    (tmp_path / "short.safetensors").write_bytes(b"abc")
    (tmp_path / "junk.safetensors").write_bytes((4).to_bytes(8, "little") + b"nope")
    tensors = files.checked_tensors(files.tensor_headers(spark, str(tmp_path)))
    found = {(r.path.rsplit("/", 1)[1], r.name): r.status for r in tensors.collect()}
    found = {(k[0].replace("%20", " "), k[1]): v for k, v in found.items()}
    assert found == {
        ("a b.safetensors", "w"): "OK", ("a b.safetensors", "v"): "OK", ("bad.safetensors", "x"): "SIZE_MISMATCH", ("bad.safetensors", "y"): "OVERLAP",
        ("bad.safetensors", "z"): "UNKNOWN_TYPE", ("bad.safetensors", "far"): "OUT_OF_BOUNDS", ("short.safetensors", None): "TRUNCATED", ("junk.safetensors", None): "INVALID_HEADER",
    }
    (tmp_path / "index.json").write_text(json.dumps({"weight_map": {"x": "bad.safetensors", "y": "other.safetensors", "q": "bad.safetensors"}}))
    checked = files.indexed_tensors(files.shard_index(spark, str(tmp_path / "index.json")), tensors.where("path like '%bad%'"))
    assert {r.name: r.status for r in checked.collect()} == {"x": "OK", "y": "WRONG_SHARD", "q": "MISSING", "z": "UNDECLARED", "far": "UNDECLARED"}


def test_repeated_keys_overflow_and_trailing_bytes(spark, tmp_path):
    t = lambda dtype, shape, a, b: {"dtype": dtype, "shape": shape, "data_offsets": [a, b]}
    _tensor_file(tmp_path / "big.safetensors", {"w": t("F64", [2**40, 2**40], 0, 8), "v": t("U8", [2**31, 2**31, 0], 8, 8), "odd": t("U8", [2**53 + 1], 8, 8 + 2**53)}, bytes(20))
    tensors = files.tensor_headers(spark, str(tmp_path))
    assert {r.name: r.status for r in files.checked_tensors(tensors).collect()} == {"w": "OVERFLOW", "v": "OK", "odd": "SIZE_MISMATCH"}
    _tensor_file(tmp_path / "tail.safetensors", {"w": t("U8", [4], 0, 4)}, bytes(9))
    tail = files.tensor_headers(spark, str(tmp_path), "tail*")
    assert [r.gap for r in files.trailing_gaps(tail).collect()] == [5]
    assert files.total_size(tail, F.lit(4)).first().agrees and not files.total_size(tail, F.lit(5)).first().agrees
    index = spark.createDataFrame([("w", "tail.safetensors"), ("x", "gone.safetensors")], "name string, shard string")
    assert tuple(files.checkpoint_layout(files.listing(spark, str(tmp_path)), index).first()) == ("SHARDED", 2, 1, 1)
    for name, read in (("v.json", files.vocabulary), ("i.json", files.shard_index)):
        (tmp_path / name).write_text('{"a": 0, "b": 1, "a": 2}' if name == "v.json" else '{"weight_map": {"a": "x", "a": "y"}}')
        with pytest.raises(Exception, match="REPEATED_KEY"):
            read(spark, str(tmp_path / name)).collect()


def test_raw_records_and_their_contract(spark, tmp_path):
    good = {"name": "n", "dtype": "F32", "shape": [], "shard": "s", "header_len": 0, "offsets": [0, 0]}
    wrong = [good | {"more": 1}, {k: v for k, v in good.items() if k != "dtype"}, good | {"shape": [True]}, good | {"shape": [-1]}, good | {"name": ""}, good | {"header_len": True}, good | {"offsets": [2, 1]}, good | {"offsets": [0]}, good | {"offsets": "x"}, 5, None]
    for name, text in {"a": json.dumps([good, *wrong]), "b": json.dumps(good), "c": "[]", "d": "[{", "e": json.dumps([good]) + " x"}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}.json").write_text(text)
    found = {n: [(r.place, r.fault) for r in files.raw_records(spark, str(tmp_path / n)).orderBy("place").collect()] for n in "abcde"}
    assert [f for _, f in found["a"]] == [None, "FIELDS", "FIELDS", "TYPE", "TYPE", "TYPE", "TYPE", "OFFSETS", "OFFSETS", "TYPE", "FIELDS", "NOT_STRICT_JSON"]
    assert found["b"] == found["d"] == found["e"] == [(None, "NOT_AN_ARRAY")] and found["c"] == []


def _pair(key, code, body):
    return len(key).to_bytes(8, "little") + key.encode() + code.to_bytes(4, "little") + body


def test_model_headers(spark, tmp_path):
    s = lambda x: len(x.encode()).to_bytes(8, "little") + x.encode()
    u32, u64 = (lambda x: x.to_bytes(4, "little")), (lambda x: x.to_bytes(8, "little"))
    pairs = [_pair("general.name", 8, s("é")), _pair("general.alignment", 4, u32(64)), _pair("flags", 9, u32(7) + u64(2) + b"\x01\x00"), _pair("tokens", 9, u32(8) + u64(3) + s("a") + s("b") + s("c"))]
    tensor = s("blk.3.w") + u32(2) + u64(2**64 - 1) + u64(3) + u32(12) + u64(2**63)
    body = b"GGUF" + u32(3) + u64(2) + u64(4) + b"".join(pairs) + tensor + s("norm") + u32(0) + u32(0) + u64(0)
    (tmp_path / "m.gguf").write_bytes(body + bytes(200))
    (tmp_path / "cut.gguf").write_bytes(body[:60])
    (tmp_path / "other.gguf").write_bytes(b"GGML" + bytes(30))
    rows = model_files.model_headers(spark, str(tmp_path), shown=2).collect()
    own = {r.name: r for r in rows if r.path.endswith("m.gguf")}
    assert (own["general.name"].value, own["flags"].value, own["flags"].array_type, own["tokens"].value, own["tokens"].array_length) == ("é", "true,false", "bool", None, 3)
    assert own["tokens"].value_sha256 == hashlib.sha256(s("a") + s("b") + s("c")).hexdigest()
    assert [int(d) for d in own["blk.3.w"].dims] == [2**64 - 1, 3] and int(own["blk.3.w"].offset) == 2**63 and own["norm"].payload_start == -(-len(body) // 64) * 64
    assert {r.path.rsplit("/", 1)[1]: r.error for r in rows if r.kind == "error"} == {"cut.gguf": "TRUNCATED", "other.gguf": "INVALID_MAGIC"}
    found = {r.path.rsplit("/", 1)[1]: r for r in model_files.header_summary(model_files.model_headers(spark, str(tmp_path))).collect()}
    assert (found["m.gguf"].n_metadata, found["m.gguf"].n_tensors, found["m.gguf"].n_layers) == (4, 2, 1)
    assert [r.error for r in model_files.model_headers(spark, str(tmp_path), "m*", most_bytes=50).collect()] == ["LIMIT_EXCEEDED"]


def test_globs_match_as_file_names_do(spark):
    import fnmatch

    names = ["ECO", "ECO\n", "ECO\nX", "abc", "bbc", "b.c", "a[b", "a-b", "aXb", "]x", "", "\\x", "a^b", "é"]
    globs = ["ECO", "ECO*", "[ab]*", "[!a]*", "a[b", "a[-x]b", "a?b", "[]]x", "*", "\\*", "[^b]*", "?", "a[a-z]*"]
    table = spark.createDataFrame([(n,) for n in names], "n string")
    for g in globs:
        want = sorted(n for n in names if fnmatch.fnmatchcase(n, g))
        assert sorted(r.n for r in table.where(F.col("n").rlike(compare.glob_pattern(g))).collect()) == want, g


def test_ranks_dealt_by_ranges(spark):
    rows = spark.createDataFrame([(None if k % 5 == 0 else k % 3, (k * 7919) % 1000) for k in range(1000)], "g int, x int")
    got = {(r.g, r.x): r.place for r in written.ranked(rows, ["g"], [F.desc("x")]).collect()}
    want = {}
    for r in sorted(rows.collect(), key=lambda r: -r.x):
        want[r.g, r.x] = 1 + sum(k[0] == r.g for k in want)
    assert got == want and written.ranked(rows.limit(0), ["g"], [F.desc("x")]).count() == 0


def test_rings_of_successors(spark):
    rows = [(1, 2), (2, 3), (3, 1), (4, 1), (5, 6), (6, None), (7, 7), (8, 9)]
    assert sorted(r.node for r in components.ring_members(spark.createDataFrame(rows, "node int, next int")).collect()) == [1, 2, 3, 7]
    assert components.ring_members(spark.createDataFrame([], "node int, next int")).count() == 0


def states(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_rungs_take_precedence_in_order(spark):
    dims = lambda *s: (list(s),)
    rows = [dims("BROKEN", "REVOKED"), dims("REVOKED", "DENIED"), dims("WITHDRAWN", "STALE"), dims("STALE", "MISSING"), dims("UNKNOWN", "PARTIAL"), dims("NOT_CHECKED", "SATISFIED"), dims("SATISFIED")]
    want = ["BROKEN", "REVOKED", "DENIED", "STALE", "REVIEW_REQUIRED", "TRUSTED_WITH_LIMITATIONS", "TRUSTED_FOR_SCOPED_USE"]
    assert states(spark, timelines.overall_state(F.col("s")), rows, "s array<string>") == want
    rows = [dims(), dims("VALID", "INVALID", "EXPIRED"), dims("EXPIRED", "NOT_YET_VALID"), dims("NOT_YET_VALID", "NOT_EVALUATED"), dims("NOT_EVALUATED", "VALID"), dims("VALID")]
    assert states(spark, timelines.combined_expiration(F.col("s")), rows, "s array<string>") == ["UNAVAILABLE", "INVALID", "EXPIRED", "NOT_YET_VALID", "NOT_EVALUATED", "VALID"]
    cut = "2024-01-02T00:00:00Z"
    rows = [("NOT_RECORDED", "NOT_RECORDED"), (cut, "NOT_RECORDED"), ("2024-01-02", cut), ("2024-01-02T00:00:01Z", cut), (cut, "2024-01-02T00:00:01Z"), (cut, cut), (cut + "\n", cut)]
    want = ["AVAILABILITY_NOT_RECORDED", "INVALID", "INVALID", "NOT_KNOWN_AS_OF_CUTOFF", "KNOWN_FUTURE_EFFECTIVE_AS_OF_CUTOFF", "KNOWN_EFFECTIVE_AS_OF_CUTOFF", "INVALID"]
    assert states(spark, timelines.knowledge(F.col("a"), F.col("e"), cut), rows, "a string, e string") == want
    exact = "EXACT_MATCH_FOR_EXPECTATION_SCOPE"
    rows = [(True, exact, True, True, True), (False, exact, True, True, False), (True, exact, True, True, None), (True, exact, True, False, False), (True, exact, False, True, False), (True, "MISMATCH", True, True, False), (True, "INCOMPLETE_OBSERVATION", True, True, False), (True, "INCOMPATIBLE_SCOPE", True, True, False)]
    want = ["INVALID", "OBSERVED", "MATCHES_AUTHORIZED_COMPLETE_EXPECTATION", "MATCHES_COMPLETE_EXPECTATION", "MATCHES_EXPECTATION_SCOPE", "MISMATCH", "INCOMPLETE", "NOT_COMPARABLE"]
    assert states(spark, manifests.evidence_outcome(*(F.col(c) for c in "abcde")), rows, "a boolean, b string, c boolean, d boolean, e boolean") == want
    families = {"X": ("a", "b"), "Y": ("c",)}
    rows = [dims(), dims("a", "c"), dims("a", "b", "z"), dims("a"), dims("c")]
    assert states(spark, mappings.marker_kind(F.col("s"), families), rows, "s array<string>") == ["NONE", "CONFLICT", "X", "UNKNOWN", "Y"]
    assert states(spark, mappings.evidence_kind(F.col("s"), families), rows, "s array<string>") == ["NONE", "BOTH", "X", "X", "Y"]
    rows = [([], ["a"]), (["a"], []), (["a"], ["a", "b"]), (["c"], ["a"]), ([], [])]
    assert states(spark, policies.within_scope(F.col("c"), F.col("p")), rows, "c array<string>, p array<string>") == [False, True, True, False, True]
    rows = [dims(), dims("INVALID", "EXACT"), dims("INSUFFICIENT_COVERAGE", "NOT_SUPPORTED"), dims("NOT_SUPPORTED", "EXACT"), dims("SAMPLED", "EXACT"), dims("EXACT"), dims("EXACT", "EVALUATED")]
    assert states(spark, numeric.numeric_rollup(F.col("s"), F.lit(False)), rows, "s array<string>") == ["VALUES_UNAVAILABLE", "INVALID", "INSUFFICIENT_COVERAGE", "NOT_SUPPORTED", "SAMPLED", "EXACT", "EVALUATED"]
    facts = [c.split()[0] for c in "broken b, replayed b, drift b, proxy b, optional_unobserved b, self_observed b".split(", ")]
    rows = [tuple(k >= n for k in range(6)) for n in range(7)]
    want = ["BROKEN", "REPLAY_REJECTED", "DRIFT_DETECTED", "IDENTITY_PROXY_MATCH", "PARTIAL", "PASS_WITH_LIMITATIONS", "PASS"]
    assert states(spark, policies.continuity_verdict({n: F.col(n) for n in facts}), rows, ", ".join(f"{n} boolean" for n in facts)) == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_every_rung_of_the_queries_is_reached(spark, duck):
    """The larger tables, by SQL alone: a rung that no row reaches would prove nothing."""
    big = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{big}/{t}.parquet'")
    least = {
        ("manifest_ladder", "status"): 7, ("manifest_evidence", "outcome"): 8, ("reconcile_status", "status"): 6, ("shard_completeness", "status"): 6, ("timeline_completeness", "completeness"): 3, ("knowledge_states", "state"): 5, ("resolution_ladder", "status"): 7,
        ("snapshot_overall", "overall"): 4, ("snapshot_changes", "outcome"): 5, ("expiration_states", "status"): 4, ("renewal_chains", "status"): 3, ("bundle_completeness", "state"): 5, ("type_transition_states", "state"): 6, ("shape_classes", "class"): 4, ("requirement_eval", "outcome"): 9,
        ("policy_decisions", "decision"): 4, ("quorum_eval", "outcome"): 5, ("duty_separation", "outcome"): 4, ("security_eval", "verdict"): 7, ("runtime_member_continuity", "result"): 4, ("runtime_continuity", "verdict"): 13, ("signed_objects", "status"): 12, ("mapping_resolution", "status"): 5, ("grouped_mapping", "status"): 6,
        ("configuration_parity", "status"): 4, ("probe_status", "status"): 3, ("backend_compare", "status"): 5, ("payload_spans", "span"): 4, ("shard_span_rollup", "result"): 2, ("attestation_states", "strength"): 7, ("acceptance_profiles", "outcome"): 3, ("usage_profiles", "outcome"): 3, ("source_records", "fault"): 4,
        ("bounded_records", "status"): 4, ("provenance_sidecars", "status"): 7, ("typed_configurations", "status"): 2, ("path_preservation", "state"): 6, ("shard_hints", "status"): 2, ("header_linkage", "status"): 7, ("attestation_segments", "status"): 3,
    }
    reached = {k: len(con.execute(f"SELECT DISTINCT {k[1]} FROM ({catalogue.ORACLE_SQL[k[0]]}) AS q WHERE {k[1]} IS NOT NULL").fetchall()) for k in least}
    assert {k: n for k, n in reached.items() if n < least[k]} == {}


def test_exact_metrics_equal_plain_decimals(spark):
    from decimal import Decimal

    rows = [(1, ["1", "0.1", "-2"], ["1", "0.3", "-2.5"]), (2, ["0", "0"], ["1", "2"]), (3, ["1.50"], ["1.5"]), (4, [], []), (5, ["1"], ["1", "2"]), (6, ["x"], ["1"]), (7, None, ["1"]), (8, ["NaN"], ["1"])]
    got = {r.k: r for r in numeric.exact_metrics(spark.createDataFrame(rows, "k int, a array<string>, b array<string>"), "a", "b").collect()}
    assert (got[1].max_error, got[1].error_squares, got[1].dot, got[1].mean_error) == ("0.5", "0.29", "6.03", str(Decimal("0.7") / 3)[:2] + "2" + "3" * 49)
    assert got[2].cosine is None and got[3].cosine == "1" and got[3].max_error == "0" and got[4].mse is got[5].mse is got[6].mse is got[7].mse is got[8].mse is None
    shapes = spark.createDataFrame([([2**32, 2**32],), ([2**32, 2**31],), ([],), ([2**62, 0],)], "d array<bigint>")
    assert [r[0] for r in shapes.select(splits.checked_product(F.col("d"))).collect()] == [None, Decimal(2**63), Decimal(1), Decimal(0)]
    found = spark.createDataFrame([("1",), ("-0.5e-3",), ("01",), ("1.",), ("NaN",), (None,), ("1" * 101,)], "x string").select(numeric.decimal_grammar(F.col("x")))
    assert [r[0] for r in found.collect()] == [True, True, False, False, False, False, False]


def test_counter_samples_are_those_of_the_rule(spark):
    rows = [("a", 1000, 20), ("b", 5, 9), ("c", 0, 3), ("d", 7, 0), ("e", 10, 9), ("f", 2 * 10**9, 3)]
    got = {}
    for r in numeric.samples(spark.createDataFrame(rows, "k string, population long, wanted long"), "k", F.concat("k", F.lit("/"))).collect():
        got.setdefault(r.k, set()).add(r["index"])
    for k, n, w in rows[:5]:
        chosen, counter = set(), 0
        while len(chosen) < min(n, w):
            chosen.add(int(hashlib.sha256(f"{k}/{counter}".encode()).hexdigest(), 16) % n)
            counter += 1
        assert got.get(k, set()) == (set(range(n)) if 0 < n <= w else chosen)
    assert "f" not in got


def test_texts(spark):
    rows = [(1, 'A\nos.system ( "x") and OS.SYSTEM(1) é X-Amz-Key'), (2, ""), (3, None)]
    got = [(r.k, r.offset, r.length, r.category, r.excerpt) for r in texts.scanned(spark.createDataFrame(rows, "k int, t string"), "k", "t").orderBy("offset").collect()]
    assert got == [(1, 2, 11, "SHELL_EXECUTION_PATTERN", "os.system ("), (1, 23, 10, "SHELL_EXECUTION_PATTERN", "os.system("), (1, 38, 9, "SIGNED_URL_PATTERN", "<redacted:9>")]
    faults = {"a/b": None, "": "EMPTY", "e\u0301": "NOT_COMPOSED", "/a": "ROOTED", "c:/x": "DRIVE", "a//b": "EMPTY_PART", "a/": "EMPTY_PART", "a/.": "DOTS", "../a": "DOTS", "...x/a": None, "b ": "BLURRED_END", "x./a": "BLURRED_END", "x/NUL.txt": "RESERVED", "nul": "RESERVED", "nully": None, "con .x": None, "d/a:b": "COLON", "a\x07": "CONTROL", "a\n": "CONTROL", "a" * 2000: "TOO_LONG", "a" * 256: "LONG_PART", "\ufffe": "NO_CHARACTER", "\U0010ffff": "NO_CHARACTER", "ab://y": "SCHEME", "a\\b": "BACKSLASH"}
    got = {r.p: r.fault for r in paths.judged(spark.createDataFrame([(p,) for p in faults], "p string"), "p").collect()}
    assert got == faults
    assert {r.folded for r in paths.judged(spark.createDataFrame([("Stra\u00dfe",), ("A",), (None,)], "p string"), "p").collect()} == {"strasse", "a", None}
    times = [("2024-02-29T00:00:00Z", True), ("2023-02-29T00:00:00Z", False), ("2024-01-01 00:00:00", False), (None, False)]
    assert [r[0] for r in spark.createDataFrame(times, "t string, w boolean").select(texts.utc(F.col("t"))).collect()] == [w for _, w in times]
    shown = spark.createDataFrame([("a\u202eb\x00",)], "t string").select(texts.escaped(F.col("t"))).first()[0]
    assert shown == "a\\u202eb\\u0000"


def test_attested_steps(spark):
    a = lambda i, c=None, s=None: (i, c, s)
    rows = [("TRANSFER", [a(1)], [a(1)]), ("TRANSFER", [a(1)], [a(2)]), ("ACQUISITION", [a(1, 5)], [a(2, 5)]), ("ACQUISITION", [a(1, 5)], [a(2, 6)]), ("ACQUISITION", [a(1)], []), ("OTHER", [a(1)], [a(9)]), ("OTHER", [a(9)], [a(9)]), ("OTHER", [a(1)], [a(2)]), ("OTHER", [], [a(9)])]
    kind = "array<struct<id:int,content:int,set_digest:string>>"
    got = states(spark, attestations.continuity(F.col("k"), F.col("i"), F.col("o"), F.lit(9)), rows, f"k string, i {kind}, o {kind}")
    assert got == ["VALID", "DIVERGED", "VALID", "INCOMPLETE", "INVALID", "VALID", "DIVERGED", "DIVERGED", "INVALID"]


def test_structures_of_empty_and_null_sides(spark):
    none = spark.createDataFrame([], "name string, type string")
    some = spark.createDataFrame([("a", "F32"), (None, "F32")], "name string, type string")
    assert structures.set_difference(none, none, "name", 3).count() == 0
    assert [tuple(r) for r in structures.set_difference(some, none, "name", 3).collect()] == [("missing", 1, "a")]
    assert parity.ids_to_tokens(none.withColumn("id", F.lit(1)), none.withColumn("id", F.lit(1)), "name", "id").first().n_compared == 0


def test_manifest_vocabulary_and_merges(spark, tmp_path):
    (tmp_path / "v.json").write_text('{"a": 0, "b": 1}')
    (tmp_path / "m.txt").write_text("#version: 0.2\na b\n\nthree words here\nab c\u2028x  y\n", newline="")
    rows = files.file_manifest(spark, str(tmp_path)).collect()
    assert {(r.size, r.sha256) for r in rows} == {((p := tmp_path / n).stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for n in ("v.json", "m.txt")}
    assert {tuple(r) for r in files.vocabulary(spark, str(tmp_path / "v.json")).collect()} == {("a", 0), ("b", 1)}
    assert [tuple(r) for r in files.merge_rules(spark, str(tmp_path / "m.txt")).orderBy("rank").collect()] == [(0, "a", "b"), (1, "ab", "c"), (2, "x", "y")]


def test_streams_go_on_where_they_ended(spark, tmp_path):
    part = lambda k: spark.createDataFrame([(1, "a"), (1, "a"), (k, "b")], "u int, t string").coalesce(1)
    part(2).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: claims.drain(claims.first_claims(claims.file_stream(spark, f"{tmp_path}/in", part(2).schema), "u", "t"), f"{tmp_path}/out")
    assert sorted(tuple(r) for r in run().collect()) == [(1, "a"), (2, "b")]
    part(3).write.mode("append").parquet(f"{tmp_path}/in")
    assert sorted(tuple(r) for r in run().collect()) == [(1, "a"), (2, "b"), (3, "b")]


def test_chain_heads_stream(spark):
    rows = [(k % 3 or None, k // 3, None if k == 7 else f"e{k}é") for k in range(60)]
    df = sequences.chain_heads(spark.createDataFrame(rows, "g long, k int, e string"), "g", "k", "e")
    want = {}
    for g, _, e in sorted(rows, key=lambda x: (x[0] or 0, x[1])):
        n, head = want.get(g, (0, ""))
        want[g] = n + 1, None if e is None or head is None else hashlib.sha256(f"{head}|{e}".encode()).hexdigest()
    assert {r.g: (r.n, r.head) for r in df.collect()} == want
    assert sequences.chain_heads(spark.createDataFrame([], "g long, k int, e string"), "g", "k", "e").count() == 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan  # no value that holds a whole group
