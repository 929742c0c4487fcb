"""Components, point-in-time joins, rule indexes, accounting, formats, archives, stages, thresholds and ledgers on awkward rows and against plain Python."""

import fnmatch
import hashlib
import json
import random
import stat
import struct
import zipfile
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from ledgerloom.operators import accounting, asof, assess, components, parity, rule_index, stages, texts, thresholds, views
from ledgerloom.sources import archives, formats
from ledgerloom.streaming import ledgers


@pytest.fixture
def sides(spark, tmp_path):
    """The rows of a query and those of its SQL over tables of their own, sorted."""

    def both(name, **tables):
        con = duckdb.connect()
        for table, rows in tables.items():
            rows.coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
            con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        found = __spark_entry__.queries()[name](spark, str(tmp_path))
        want = con.sql(f"SELECT {', '.join(found.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
        return sorted(map(tuple, found.collect()), key=repr), sorted(want, key=repr)

    return both


def reached(edges):
    out = {}
    for x in {n for e in edges for n in e}:
        seen, todo = set(), [x]
        while todo:
            for a, b in edges:
                if a == (y := todo[-1]) and b not in seen:
                    seen.add(b)
                    todo.insert(0, b)
            todo.remove(y)
        out[x] = seen
    return out


def test_a_chain_of_ten_thousand_takes_few_rounds(spark):
    rounds = components.Rounds()
    found = components.components(spark.range(10_000).selectExpr("id AS src", "id + 1 AS dst"), rounds)
    assert found.count() == 10_001 and found.where("ring").count() == 0
    assert rounds.doublings + rounds.contractions + rounds.colourings <= 20


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_mutual_reach(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(14), r.randrange(14)) for _ in range((10, 16, 40)[seed])] + [(k, k + 1) for k in range(20, 26)] + [(26, 3), (50, 50), (60, 61), (61, 62), (62, 60)]
    table = spark.createDataFrame([*edges, edges[0], (None, 1), (1, None)], "src long, dst long")
    reach, found = reached(edges), {r.node: r for r in components.components(table).collect()}
    assert set(found) == set(reach)
    for x in reach:
        assert {y for y in reach if found[y].component == found[x].component} == {x} | {y for y in reach if y in reach[x] and x in reach[y]}
        assert found[x].ring == (x in reach[x])
    after = {y for x in reach if x in reach[x] for y in reach[x]}
    assert {r.node for r in components.unplaceable(table).collect()} == after


def test_a_graph_without_edges(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert components.components(none).count() == 0 and components.unplaceable(none).count() == 0


def test_what_is_known_at_cutoffs(spark):
    r = random.Random(4)
    facts = [(k, r.choice(["a", "b", None]), r.choice([None, *range(40)]), r.choice([None, *range(40)]), f"v{k}") for k in range(200)]
    facts += [(900 + k, "hot", 5, 7, "same") for k in range(300)]
    cutoffs = [(k, r.choice(["a", "b", None, "hot", "none"]), r.choice([None, *range(45)])) for k in range(150)]
    known = spark.createDataFrame(facts, "id long, s string, seen int, given int, v string").withColumn("at", asof.known_from(F.col("seen"), F.col("given")))
    got = {x.cut: x for x in asof.known_at(known, spark.createDataFrame(cutoffs, "cut long, s string, by int"), "s", "at", "id", "by", "cut", ["v"]).collect()}
    assert len(got) == 150
    for cut, s, by in cutoffs:
        own = sorted((max(seen, given), i, v) for i, of, seen, given, v in facts if of == s and None not in (seen, given) and by is not None and max(seen, given) <= by)
        assert (got[cut].n_known, got[cut].id, got[cut].v) == ((len(own), own[-1][1], own[-1][2]) if own else (0, None, None))
    assert asof.known_at(known.limit(0), spark.createDataFrame([(1, "a", 3)], "cut long, s string, by int"), "s", "at", "id", "by", "cut").first().n_known == 0


def test_first_rules_equal_trying_all(spark):
    r = random.Random(6)
    names = ["".join(r.choices("ab.[]", k=r.randint(0, 7))) for _ in range(150)] + ["layer.10.weight", "layer.1.bias", "é.weight", None]
    globs = ["".join(r.choices(["a", "b", ".", "*", "?", "[ab]", "[!a]", "a."], k=r.randint(1, 5))) for _ in range(150)] + ["layer.*.weight", "*.bias", "*", "?.weight", "nothing", "*ayer.1*"]
    rules = [(k, r.randrange(20), g) for k, g in enumerate(globs)] + [(999, 0, None)]
    got = {x.name: x.rule for x in rule_index.first_matches(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(rules, "rule long, rank int, pat string"), "name", "rule", "rank", "pat").collect()}
    for n in set(names):
        own = [(rank, k) for k, rank, g in rules if n is not None and g is not None and fnmatch.fnmatchcase(n, g)]
        assert got[n] == (min(own)[1] if own else None), n


def test_rules_of_numbers_are_filed_apart(spark):
    globs = [form.format(k) for k in range(100_000, 100_900) for form in ("*.{}.*.[!1-3]", "?i*.{}?*", "l?ne.{}.[0-4]*", "[xl]*?{}.*")]
    index = rule_index.indexed(spark.createDataFrame([(k, 1, g) for k, g in enumerate(globs)], "rule long, rank int, pat string"), "pat")
    assert index.groupBy("kind", "length", "piece").count().agg(F.max("count")).first()[0] <= 2


def test_first_rules_of_words_equal_trying_all(spark):
    r = random.Random(8)
    numbers = [str(r.choice([r.randrange(10), r.randrange(1000), 10**30 + r.randrange(9)])) for _ in range(60)]
    names = [r.choice(["line", "Line", "é", ""]) + r.choice(".-]") + r.choice(numbers) + r.choice(["", ".", "]", "é"]) + r.choice(numbers) for _ in range(300)] + ["]a", "a]b", "[a]", "!]", "", None]
    forms = ("*.{}.*", "?i*.{}?*", "*{}", "{}*", "*.{}", "l?ne.{}[0-4]*", "*[]a]{}*", "[!]]*{}.?*", "*]{}", "*é{}", "*[{}]", "*n?.{}")
    globs = [f.format(n) for f in forms for n in r.sample(numbers, 12)] + ["[]a]*", "[!]a]*", "*[!]", "[]", "**", "", "[[]a*"]
    rules = [(k, r.randrange(5), g) for k, g in enumerate(globs * 2)] + [(999, None, "*.7*")]
    got = {x.name: x.rule for x in rule_index.first_matches(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(rules, "rule long, rank int, pat string"), "name", "rule", "rank", "pat").collect()}
    assert len(got) == len(set(names))
    for n in set(names):
        own = [(-1 if rank is None else rank, k) for k, rank, g in rules if n is not None and fnmatch.fnmatchcase(n, g)]
        assert got[n] == (min(own)[1] if own else None), n


def test_every_entity_is_in_one_state(spark):
    rules = [("many", "F", "s{layer}.{member}", ["t{layer}"], 1, None, "MEMBER", "PACKED", ["A"]), ("one", "O", "s{layer}.1", ["t{layer}", "u{layer}"], 1, 1, "DIRECT", "REALIZED", None), ("aux", "F", "s{layer}.9", None, 1, 1, "AUX", None, None)]
    schedule = [(1, "F", 2), (2, "F", 3), (3, "O", 0), (4, "O", 0), (4, "F", 1), (5, "F", 1), (6, "O", 0)]
    inventory = [("source", n, t) for n, t in [("s1.1", "A"), ("s1.2", "A"), ("s1.9", "B"), ("s2.1", "A"), ("s2.2", "A"), ("s3.1", "Z"), ("s4.1", "A"), ("s5.1", "B"), ("s6.1", "A"), ("s6.1", "A"), ("other", "A"), ("s2.9", None)]]
    inventory += [("target", n, None) for n in ("t1", "t2", "t3", "u3", "t4", "u4", "t5", "t6", "u6", "v")]
    table = spark.createDataFrame(inventory, "side string, name string, type string")
    judged = accounting.judged(accounting.claims(spark.createDataFrame(rules, accounting.RULES), spark.createDataFrame(schedule, "layer long, kind string, members int")), table)
    got = sorted((r.side, r.name, r.state) for r in accounting.states(judged, table).collect())
    want = {"s1.1": "MEMBER", "s1.2": "MEMBER", "s1.9": "AUX", "s2.1": "GROUP_FAILED", "s2.2": "GROUP_FAILED", "s3.1": "DIRECT", "s4.1": "CONFLICT", "s5.1": "GROUP_FAILED", "s6.1": "AMBIGUOUS", "other": "UNCLAIMED", "s2.9": "AUX", "t1": "PACKED", "t2": "GROUP_FAILED", "t3": "REALIZED", "u3": "REALIZED", "t4": "CONFLICT", "u4": "GROUP_FAILED", "t5": "GROUP_FAILED", "t6": "GROUP_FAILED", "u6": "GROUP_FAILED", "v": "UNCLAIMED"}
    assert got == sorted((side, name, want[name]) for side, name, _ in inventory)
    assert {(r.name, r.rules) for r in accounting.conflicts(judged).collect()} == {("s4.1", "many[4],one[4]"), ("t4", "many[4],one[4]")}


def test_layers_are_claimed_where_they_lie(spark):
    rules = [("a", "F", "s{layer}.{member}", ["t{layer}"], 1, None, "MEMBER", "PACKED", None), ("b", "O", "s{layer}.1", ["t{layer}"], 1, 1, "DIRECT", "REALIZED", None)]
    schedule = spark.createDataFrame([(1, "F", 2), (2, "O", 0)], "layer long, kind string, members int")
    claimed = accounting.claims(spark.createDataFrame(rules, accounting.RULES), schedule)
    assert claimed.count() == 5
    assert "Exchange hashpartitioning" not in claimed._jdf.queryExecution().executedPlan().toString()  # else all layers of a kind are one task's


def test_states_are_counted_without_their_names(spark):
    r = random.Random(3)
    names = lambda side, letter, n: [(side, f"{letter}{r.randrange(40)}" + (f".{r.randrange(4)}" if side == "source" else ""), r.choice(["A", "B", None])) for _ in range(n)] + [(side, None, "A")]
    table = spark.createDataFrame(names("source", "s", 90) + names("target", "t", 30) + [("other", "x", None)], "side string, name string, type string")
    rules = [("many", "F", "s{layer}.{member}", ["t{layer}"], 1, None, "MEMBER", "PACKED", ["A"]), ("one", "O", "s{layer}.1", ["t{layer}"], 1, 1, "DIRECT", "REALIZED", None), ("aux", "P", "s{layer}.2", None, 1, 1, "CONFLICT", None, None)]
    schedule = [(k, kind, r.randrange(4)) for k in range(40) for kind in r.sample("FOP", r.randrange(3))]
    judged = accounting.judged(accounting.claims(spark.createDataFrame(rules, accounting.RULES), spark.createDataFrame(schedule, "layer long, kind string, members int")), table)
    listed = Counter((x.side, x.state) for x in accounting.states(judged, table).collect())
    whole = Counter(x.side for x in table.collect())
    assert {(x.side, x.state): (x.n, x.n_side) for x in accounting.state_counts(judged, table).collect()} == {(side, state): (n, whole[side]) for (side, state), n in listed.items()}
    assert len(listed) >= 9


def safetensors(header, payload=b""):
    body = header if isinstance(header, bytes) else json.dumps(header).encode()
    return struct.pack("<Q", len(body)) + body + payload


def test_formats_push_filters_and_name_what_is_broken(spark, tmp_path):
    tensor = lambda a, b: {"dtype": "F32", "shape": [(b - a) // 4], "data_offsets": [a, b]}
    (tmp_path / "a.safetensors").write_bytes(safetensors({"x": tensor(0, 8), "y": tensor(8, 12)}, b"0" * 12))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.safetensors").write_bytes(safetensors({"z": tensor(0, 4)}, b"0" * 4))
    (tmp_path / "c.safetensors").write_bytes(b"\xff" * 4)
    (tmp_path / "d.safetensors").write_bytes(safetensors(b"no json"))
    (tmp_path / "m.index.json").write_text('{"weight_map": {"x": "a", "y": "a"}}')
    (tmp_path / "n.index.json").write_text('{"weight_map": {"x": "a", "x": "b"}}')
    (tmp_path / "o.index.json").write_text("{}")
    formats.register(spark)
    read = lambda f: spark.read.format(f).load(str(tmp_path))
    assert {(r.name, r.error) for r in read("tensor_headers").collect()} == {("x", None), ("y", None), ("z", None), (None, "TRUNCATED"), (None, "INVALID_HEADER")}
    one = read("tensor_headers").where((F.col("name") == "y") & F.col("path").startswith(f"file:{tmp_path}/a"))
    assert [(r.name, r.start, r.end) for r in one.collect()] == [("y", 8, 12)]
    assert {(r.name, r.shard, r.error) for r in read("shard_indexes").collect()} == {("x", "a", None), ("y", "a", None), (None, None, "REPEATED_KEY"), (None, None, "NO_WEIGHT_MAP")}
    assert read("model_headers").count() == 0


def test_archive_directories(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("fine/é.txt", "hello")
        z.writestr("../up", "x")
        z.writestr("/root", "x")
        z.writestr("zeros", b"\0" * 1_000_000)
        link = zipfile.ZipInfo("link")
        link.external_attr = (stat.S_IFLNK | 0o777) << 16
        z.writestr(link, "/etc/passwd")
        with pytest.warns(UserWarning):
            z.writestr("fine/é.txt", "again")
        z.comment = b"a comment"
    whole = (tmp_path / "a.zip").read_bytes()
    locked = bytearray(whole)
    at = whole.rfind(b"PK\x01\x02", 0, whole.rfind(b"PK\x01\x02"))
    locked[at + 8] |= 1
    (tmp_path / "b.zip").write_bytes(locked)
    (tmp_path / "c.zip").write_bytes(b"not an archive")
    (tmp_path / "d.zip").write_bytes(whole[:40] + whole[whole.rfind(b"PK\x05\x06") :])
    end = whole.rfind(b"PK\x05\x06")
    n, size, begin = struct.unpack("<HII", whole[end + 10 : end + 20])
    record = b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, begin)
    locator = b"PK\x06\x07" + struct.pack("<IQI", 0, end, 1)
    (tmp_path / "e.zip").write_bytes(whole[:end] + record + locator + b"PK\x05\x06" + b"\0" * 4 + b"\xff" * 12 + b"\0\0")
    formats.register(spark)
    found = archives.entry_findings(spark.read.format("archive_entries").load(str(tmp_path))).collect()
    of = lambda letter: [(r.name, r.finding) for r in sorted(found, key=lambda r: r.place or 0) if r.path.endswith(f"{letter}.zip")]
    want = [("fine/é.txt", "REPEATED"), ("../up", "TRAVERSAL"), ("/root", "ABSOLUTE"), ("zeros", "RATIO"), ("link", "LINK"), ("fine/é.txt", "REPEATED")]
    assert of("a") == want and of("e") == want
    assert of("b") == [*want[:4], ("link", "LINK"), want[5]]
    assert {r.name for r in found if r.path.endswith("b.zip") and r.encrypted} == {"link"}
    assert of("c") == [(None, "NO_DIRECTORY")] and of("d") == [(None, "TRUNCATED")]
    sizes = {r.name: r.size for r in found if r.path.endswith("a.zip")}
    assert sizes["zeros"] == 1_000_000


def test_json_leaves_at_any_depth(spark):
    deep = "[" * 40 + "1" + "]" * 40
    rows = [(1, '{"a": {"b_\\u0069d": ["x", {"c": null}]}, "t": true}'), (2, "{broken"), (3, '{"k": 1, "k": 2}'), (4, deep), (5, None), (6, "7")]
    got = sorted(((r.key, r.name, r.value) for r in texts.json_leaves(spark.createDataFrame(rows, "d int, t string"), "d", "t").collect()), key=repr)
    assert got == sorted([(1, "b_id", "x"), (1, "c", None), (1, "t", "true"), (2, "!", None), (3, "!", None), (4, "!", None), (5, "!", None), (6, "", "7")], key=repr)


def test_stages_are_bounded_by_what_they_need(spark):
    own = spark.createDataFrame([(1, "a", "PASS"), (1, "b", "PASS"), (1, "c", "WARN"), (2, "a", "FAIL"), (2, "b", "PASS"), (2, "c", "odd"), (None, "a", "PASS")], "s int, stage string, status string")
    needs = spark.createDataFrame([("b", "a"), ("c", "b")], "stage string, needs string")
    listed = spark.createDataFrame([("a",), ("b",), ("c",)], "stage string")
    got = {(r.s, r.stage): (r.own, r.status, r.held_by) for r in stages.bounded(own, needs, spark.createDataFrame([(1,), (2,), (3,)], "s int"), listed, "s").collect()}
    assert got == {(1, "a"): ("PASS", "PASS", None), (1, "b"): ("PASS", "PASS", None), (1, "c"): ("WARN", "WARN", None), (2, "a"): ("FAIL", "FAIL", None), (2, "b"): ("PASS", "FAIL", "a"), (2, "c"): ("UNAVAILABLE", "FAIL", "a"), **{(3, x): ("NOT_CHECKED", "NOT_CHECKED", None) for x in "abc"}}
    with pytest.raises(ValueError, match="CYCLE"):
        stages.closure(spark.createDataFrame([("a", "b"), ("b", "a")], "stage string, needs string"))


def test_the_most_specific_threshold_holds(spark):
    rules = [("e", "default", None, "max", 0.5, None, True), ("e", "label", "1", "max", 0.3, None, True), ("e", "label", "1", "max", 0.2, None, True), ("e", "tensor", "7", "max", 0.9, None, True), ("t", "label", "1", "in", None, ["ok"], False), ("u", "default", None, "min", 1.0, None, True)]
    entities = spark.createDataFrame([(5, 0), (6, 1), (7, 1), (8, None)], "v int, label int")
    levels = [("tensor", F.col("v")), ("label", F.col("label")), ("default", None)]
    observed = spark.createDataFrame([(5, "e", 0.4, None), (6, "e", 0.25, None), (7, "e", 0.8, None), (8, "e", 0.6, None), (6, "t", None, "bad"), (5, "u", 1.0, None)], "v int, kind string, value double, text string")
    got = {(r.v, r.kind): (r.level, r.outcome) for r in thresholds.outcomes(thresholds.effective(entities, "v", spark.createDataFrame(rules, thresholds.RULES), levels), observed, "v").collect()}
    assert got == {(5, "e"): ("default", "SATISFIED"), (6, "e"): ("label", "FAILED"), (7, "e"): ("tensor", "SATISFIED"), (8, "e"): ("default", "FAILED"), (6, "t"): ("label", "FAILED"), (7, "t"): ("label", "NOT_APPLICABLE"), (5, "u"): ("default", "SATISFIED"), **{(v, "u"): ("default", "NOT_EVALUATED") for v in (6, 7, 8)}}


def test_ledgers_go_on_after_a_restart(spark, tmp_path):
    schema = "chain string, seq long, entry string"

    def run(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        return {(r.chain, r.seq, r.outcome): r["head"] for r in ledgers.drained(spark, f"{tmp_path}/in", schema, f"{tmp_path}/out").collect()}

    head = lambda *entries: __import__("functools").reduce(lambda h, e: hashlib.sha256(f"{h}|{e}".encode()).hexdigest(), entries, "")
    assert run(("a", 3, "z"), ("a", 1, "x"), ("b", 2, "q"), (None, 1, "n"), ("b", None, "n")) == {("a", 1, "APPENDED"): head("x")}
    got = run(("a", 2, "y"), ("b", 2, "other"), ("b", 2, "q"))
    assert got == {("a", 1, "APPENDED"): head("x"), ("a", 2, "APPENDED"): head("x", "y"), ("a", 3, "APPENDED"): head("x", "y", "z"), ("b", 2, "CONFLICT"): None, ("b", 2, "REPEATED"): None}
    got = run(("a", 1, "x"), ("b", 1, None))
    assert got[("a", 1, "CLOSED")] is None and got[("b", 2, "APPENDED")] == head("", "q")


def test_tied_identities_are_one_entity(spark):
    tensors = spark.createDataFrame([("a", 1, 5, "F"), ("b", 2, 6, "F"), ("b2", 2, 7, "G"), ("c", None, 8, "F"), ("d", 9, 1, "F")], "name string, identity long, shape int, type string")
    ties = spark.createDataFrame([(10, 1), (11, 10), (12, 2), (20, 21), (None, 1)], "logical long, physical long")
    view = views.semantic_view(tensors, ties)
    got = {(r.name, r.kind): (r.identity, r.entity, r.backed_by, r.shape, r.state) for r in view.collect()}
    assert got == {
        ("a", "PHYSICAL"): (1, 1, 1, 5, "OK"), ("b", "PHYSICAL"): (2, 2, 2, 6, "DUPLICATE_IDENTITY"), ("b2", "PHYSICAL"): (2, 2, 2, 7, "DUPLICATE_IDENTITY"), ("c", "PHYSICAL"): (None, None, None, 8, "UNCLASSIFIED"), ("d", "PHYSICAL"): (9, 9, 9, 1, "OK"),
        ("10", "LOGICAL"): (10, 1, 1, 5, "OK"), ("11", "LOGICAL"): (11, 1, 1, 5, "OK"), ("12", "LOGICAL"): (12, 2, 2, 6, "DUPLICATE_IDENTITY"), ("20", "LOGICAL"): (20, 20, None, None, "UNBACKED"), ("21", "LOGICAL"): (21, 20, None, None, "UNBACKED"),
    }
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "identity long")
    covered = {r.entity: (r.n_targets, r.n_virtual, r.state) for r in views.entity_coverage(view, ids(1, 10, 9, None), ids(12, 12, 1)).collect()}
    assert covered == {1: (2, 0, "AMBIGUOUS"), 2: (0, 1, "VIRTUAL"), 9: (1, 0, "COVERED"), 20: (0, 0, "UNCOVERED")}


def test_tables_with_repeats_are_not_compared(spark):
    table = lambda *rows: spark.createDataFrame(list(rows), "rank int, item string")
    good, twice, null = table((0, "a"), (1, "b")), table((0, "a"), (1, "a")), table((0, "a"), (1, None))
    assert {r.status for r in assess.ranked_tables(good, good, "rank", "item").collect()} == {"MATCH"}
    for other in (twice, null):
        for pair in ((good, other), (other, good)):
            assert [tuple(r) for r in assess.ranked_tables(*pair, "rank", "item").collect()] == [(None, None, None, "NOT_COMPARABLE")]
            assert [tuple(r) for r in parity.tokens_to_ids(*pair, "item", "rank").collect()] == [(None, "NOT_COMPARABLE")]
            assert [tuple(r) for r in parity.ids_to_tokens(*pair, "item", "rank").collect()] == [(None, None, "NOT_COMPARABLE")]


def test_other_letters_end_a_word_as_in_sql(spark, sides):
    said = ["the noñ", "the ñot", "the no_", "the not", "then é no", "the nó", "the no9", "claimé", "_claim", "the claim\nnoé the claim", "Bearer x", None]
    turns = spark.createDataFrame([(k, turn, "user", text) for k, text in enumerate(said) for turn in (0, 1)], "conv_id long, turn long, role string, text string")
    got, want = sides("publication_lint", conversations=turns, nation=spark.range(9).selectExpr("int(id) AS n_nationkey"))
    assert got == want and {x for _, x in got} >= {"BOAST", "FORBIDDEN:the "}


def test_archives_of_any_number_of_entries(spark, sides):
    keys = spark.range(66_000).selectExpr("id * 128 AS k").union(spark.range(200).selectExpr("id * 128 + 1")).union(spark.range(300).selectExpr("id * 128 + 2"))  # a count beyond 16 bits, and bytes of 128 and more
    got, want = sides("archive_entries", customer=keys.selectExpr("k AS c_custkey", "int(k % 25) AS c_nationkey", "'SEGMENT' AS c_mktsegment"))
    assert len(got) == 66_500 and got == want
