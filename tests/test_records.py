"""Records under contracts, audits of paths, hints, linkage, segments and freshness, on awkward rows."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import attestations, audits, records, texts, timelines


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("text", ['{"a":1}', " [1, 2] ", '"]["', "null", "1.5", '{"a":"}\\""}', "{} x", "{} {}", "1],[2", "1, 2", "", " ", '{"a":NaN}', '{"a":1,"a":2}', '{"a":1', "]", '"\\\\"', '{"a":[{"b":"\\\\\\"]"}]}'])
def test_whole_json_is_what_a_strict_parser_takes(spark, text):
    def strict(pairs):
        if len(dict(pairs)) < len(pairs):
            raise ValueError
        return dict(pairs)

    def never(name):
        raise ValueError(name)

    try:
        json.loads(text, object_pairs_hook=strict, parse_constant=never)
        fine = True
    except ValueError:
        fine = False
    assert table(spark, [(text,)], "t string").select(texts.whole_json(F.col("t")).isNotNull()).first()[0] == fine


def test_bounds_of_reading(spark):
    deep = "[" * 5000 + "]" * 5000
    rows = [(1, None), (2, ""), (3, "{}"), (4, '{"a": {"b": 1}}'), (5, '{"a": {"b": {"c": 1}}}'), (6, "[1]"), (7, '{"a": "é"}'), (8, '{"a": "éééééééééééééééé"}'), (9, "null"), (3, "{}"), (None, "{}"), (10, '{"a": "[[[["}')]
    got = records.bounded(table(spark, rows, "k long, status string"), "k", "status", 24, 2)
    assert sorted((r.k or 0, r.status) for r in got.collect()) == [(0, "READ"), (1, "UNAVAILABLE"), (2, "BROKEN"), (3, "READ"), (3, "READ"), (4, "READ"), (5, "TOO_DEEP"), (6, "NO_OBJECT"), (7, "READ"), (8, "TOO_LARGE"), (9, "NO_OBJECT"), (10, "READ")]
    assert records.bounded(table(spark, [(1, deep)], "k long, t string"), "k", "t", 10**6, 32).first().status == "TOO_DEEP"
    assert records.bounded(table(spark, [], "k long, t string"), "k", "t", 10, 2).count() == 0


def test_sidecars(spark):
    texts_ = ['{"a": "x", "b": null}', "{}", '{"a": "x", "z": 1, "c": 2}', '{"a": "", "b": 3}', '{"a": "/x", "b": "file:y"}', '{"a": "", "z": 1}', "[]", None]
    got = records.sidecars(table(spark, list(enumerate(texts_)), "k long, t string"), "k", "t", ["a", "b"], 100, 4).orderBy("k").collect()
    assert [(r.status, r.faults) for r in got] == [("AVAILABLE", []), ("AVAILABLE", []), ("UNSUPPORTED_NAMES", ["c", "z"]), ("NO_TEXT", ["a", "b"]), ("ABSOLUTE_PATH", ["a", "b"]), ("UNSUPPORTED_NAMES", ["z"]), ("NO_OBJECT", []), ("UNAVAILABLE", [])]
    assert [r.a for r in got] == ["x"] + [None] * 7


def test_configurations(spark):
    good = {"made": ["M"], "kind": "m", "tied": False, "size": 12, "heads": 4}
    changes = [{}, {"heads": 5}, {"kind": "n"}, {"made": ["N", "O"]}, {"tied": 0}, {"heads": 0}, {"heads": True}, {"heads": "4"}, {"heads": 4.5}, {"made": []}, {"made": ["M", ""]}, {"made": ["M", 1]}, {"kind": ""}, {"size": 2**70}, {"tied": None}]
    rows = [(k, json.dumps(good | c)) for k, c in enumerate(changes)] + [(90, "{"), (91, json.dumps({"kind": "m"}))]
    contract = {"made": "texts", "kind": "text", "tied": "flag", "size": "count", "heads": "count"}
    got = {r.k: r for r in records.configurations(table(spark, rows, "k long, t string"), "k", "t", contract, [("made", "M"), ("kind", "m")], [("heads", "size")], 1000, 4).collect()}
    found = ["", "DIVIDES:heads:size", "FAMILY:kind", "FAMILY:made", "TYPE:tied", *["TYPE:heads"] * 4, *["TYPE:made"] * 3, "TYPE:kind", "TYPE:size", "TYPE:tied"]
    assert [",".join(got[k].findings) for k in range(len(changes))] == found
    assert [got[k].status for k in (0, 1, 90)] == ["VALID", "INVALID", "BROKEN"] and got[0].made == ["M"] and got[0].heads == 4 and got[7].heads is None
    assert got[91].findings == ["TYPE:made", "TYPE:tied", "TYPE:size", "TYPE:heads"] and got[91].kind == "m"


def test_preserved_paths(spark):
    schema = "path string, size long, digest string"
    base = [("r/a", 1, "x"), ("r/b", 1, "x"), ("r/c", 1, "x"), ("o/d", 1, "x"), ("o/e", 1, "x"), ("r/f", None, None), ("r/g", 1, "x"), ("r/g", 2, "x"), ("r/a", 1, "x"), ("s/t.tmp", 1, "x")]
    declared = [("o/d", 9, "y"), ("i/1", 1, "x"), ("i/2", 1, "x"), ("i/2", 2, "x"), ("i/3", 1, "x"), ("i/3", 1, "x"), ("i/4", 1, "x")]
    now = [("r/a", 1, "x"), ("r/b", 1, "y"), ("o/d", 1, "x"), ("r/f", None, None), ("i/1", 1, "x"), ("i/2", 1, "x"), ("i/3", 2, "x"), ("n", 1, "x"), ("r/g", 1, "x"), ("o/e", 5, "z")]
    t = [table(spark, rows, schema) for rows in (base, declared, now)]
    got = {r.path: (r.origin, r.state, r.reason) for r in audits.preserved(*t, F.col("path").startswith("r/"), [("TEMPORARY", r"\.tmp$")]).collect()}
    assert got == {
        "r/a": ("BASELINE", "UNCHANGED", None), "r/b": ("BASELINE", "CHANGED", None), "r/c": ("BASELINE", "MISSING", None), "o/d": ("BASELINE", "UNCHANGED", None), "o/e": ("EXCLUDED", "EXCLUDED", "OTHER"), "s/t.tmp": ("EXCLUDED", "EXCLUDED", "TEMPORARY"),
        "r/f": ("BASELINE", "UNCHANGED", None), "r/g": ("BASELINE", "CONFLICT", None), "i/1": ("DECLARED", "UNCHANGED", None), "i/2": ("DECLARED", "CONFLICT", None), "i/3": ("DECLARED", "CHANGED", None), "i/4": ("DECLARED", "MISSING", None), "n": ("ADDED", "ADDED", None),
    }
    empty = table(spark, [], schema)
    assert audits.preserved(empty, empty, empty, F.lit(True), []).count() == 0
    assert audits.preserved(table(spark, [(None, 1, "x")], schema), empty, empty, F.lit(True), []).first().state == "CONFLICT"


def test_hints(spark):
    rows = [("a", "x.bin"), ("a", "x.bin"), ("a", "y.gguf"), ("a", "read.me"), ("b", "X.bin"), ("b", "x.bin"), ("c", "../z.bin"), (None, "n.bin"), ("d", None)]
    got = audits.hints(table(spark, rows, "s string, p string"), "s", "p", r"\.(?:bin|gguf)$").collect()
    assert sorted((r.s or "", r.p, r.status, r.n_hints, r.n_faults) for r in got) == [("", "n.bin", "HEURISTIC_ONLY", 1, 0), ("a", "x.bin", "HEURISTIC_ONLY", 2, 0), ("a", "y.gguf", "HEURISTIC_ONLY", 2, 0), ("b", "X.bin", "REJECTED", 2, 2), ("b", "x.bin", "REJECTED", 2, 2), ("c", "../z.bin", "REJECTED", 1, 1)]


def test_linkage(spark):
    shards = table(spark, [("s", "b", 5, 10), ("s", "a", 5, 20), ("s", "c", 1, 30), ("t", "a", None, 1), ("u", "a", 1, 1)], "split string, path string, n_metadata long, size long")
    splits = table(spark, [("s", True, "r"), ("t", True, "r"), ("u", False, "r"), ("v", None, "r")], "split string, intact boolean, repo string")
    heads = [("s", "a", True, "r", 20, "LINKED", ""), ("s", "a", True, "q", 21, "MISMATCH", "repo,size"), ("s", "a", True, None, None, "MISMATCH", "repo,size"), ("s", "b", True, "r", 10, "NOT_PRIMARY", ""), ("s", "z", True, "r", 10, "NOT_IN_SPLIT", ""), ("s", None, True, "r", 10, "NOT_IN_SPLIT", "")]
    heads += [("s", "a", False, "r", 20, "HEADER_BROKEN", ""), ("s", "a", None, "r", 20, "HEADER_BROKEN", ""), ("t", "a", True, "r", 1, "LINKED", ""), ("u", "a", True, "r", 1, "SPLIT_BROKEN", ""), ("v", "a", True, "r", 1, "SPLIT_BROKEN", ""), ("w", "a", True, "r", 1, "SPLIT_UNKNOWN", ""), (None, "a", True, "r", 1, "SPLIT_UNKNOWN", "")]
    schema = "split string, path string, intact boolean, repo string, size long"
    for *head, status, mismatches in heads:
        got = audits.linked(table(spark, [tuple(head)], schema), splits, shards, "split", [("repo", "splits"), ("size", "shards")]).collect()
        assert [(r.status, ",".join(r.mismatches or [])) for r in got] == [(status, mismatches)]


def test_segments(spark):
    rows = [(1, "made", ["file"], "whole"), (2, "made", [], "whole"), (3, None, None, "whole"), (4, "seen", ["file"], "any"), (5, "made", ["file"], "other"), (6, "made", ["file"], None)]
    profiles = {"whole": (["made"], ["file"]), "any": ([], [])}
    run = lambda r: {x.k: x for x in attestations.segments(table(spark, r, "k long, kind string, held array<string>, profile string"), "k", ["k", "kind"], "kind", "held", "profile", profiles).collect()}
    got = run(rows)
    assert [got[k].status for k in range(1, 7)] == ["INTACT", "INCOMPLETE", "INCOMPLETE", "INTACT", "UNKNOWN_PROFILE", "UNKNOWN_PROFILE"]
    assert [got[k].missing for k in range(1, 6)] == [[], ["concept:file"], ["concept:file", "type:made"], [], None]
    assert run(rows) == got and len({x.chain_id for x in got.values()}) == len({x.ledger_digest for x in got.values()}) == 6
    assert run([]) == {}


def test_freshness_under_two_contexts(spark):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-03 00:00:00"), ("b", "2024-01-03 00:00:00"), ("c", None), ("d", "2024-02-01 00:00:00"), ("e", "2024-01-01 23:59:00"), (None, "2024-01-01 00:00:00")]
    facts = table(spark, rows, "s string, t string").withColumn("t", F.col("t").cast("timestamp"))
    got = {r.s: (r.previous, r.new, r.changed) for r in timelines.freshness_transitions(facts, "s", "t", ("2024-01-02 00:00:00", 3600), ("2024-01-04 00:00:00", 86_400)).collect()}
    assert got == {"a": ("STALE", "FRESH", True), "b": ("NOT_YET", "FRESH", True), "c": ("TIME_UNKNOWN", "TIME_UNKNOWN", False), "d": ("NOT_YET", "NOT_YET", False), "e": ("FRESH", "STALE", True), None: ("STALE", "STALE", False)}
