"""Each operator on nulls, empty texts, ties, repeated rows, empty tables and extra columns, and against brute force."""

import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import avi, html_seed, html_text, jpeg, langid, pii, queries, secrets
from ledgerloom.llm.exact_dedup import DigestIndex, deduplicate
from ledgerloom.llm.minhash import near_duplicates
from ledgerloom.llm.mixing import apportion, capped, mix, mixed_documents
from ledgerloom.llm.packing import cut, pack, schedule
from ledgerloom.llm.scratch import fresh_path, stored
from ledgerloom.llm.substring_dedup import repeated_passages, text_units, without_passages

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, row string"


def words(seed, n):
    r = random.Random(seed)
    return " ".join(f"w{r.randint(0, 10**6)}" for _ in range(n))


ROWS = [
    (1, words(1, 60), "en", "a", 9, 1, "x"), (2, words(1, 60) + " more", "en", "a", 9, 1, "x"), (3, None, None, None, None, 1, None), (4, "", "en", "b", 0, 1, "x"),
    (5, " \t\n", "en", "b", 3, 1, "x"), (6, "one two", "de", "b", 7, 1, "x"), (6, "one two", "de", "b", 7, 1, "x"), (None, "only", None, "a", 4, 1, "x"), (8, words(8, 20000), "en", "a", 1, 1, "x"),
    (9, "onetwo", "de", None, 6, 1, "x"), (10, words(1, 60), "en", "c", 9, 1, "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return stored(spark.createDataFrame(ROWS, SCHEMA).coalesce(2), "test-docs")


@pytest.fixture(scope="module")
def none(spark):
    return stored(spark.createDataFrame([], SCHEMA), "test-none")


def test_packing_places_every_id_once(docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = pack(docs, path).collect()
    expected = sorted((i, c) for i, t, *_ in ROWS for c in [len(library.encode(t or "", add_special_tokens=False).ids) + 1] for i in [-1 if i is None else i])
    whole = {}
    for r in sorted(rows, key=lambda r: (-1 if r.doc_id is None else r.doc_id, r.start)):
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length and r.length > 0
        whole.setdefault((-1 if r.doc_id is None else r.doc_id, r.doc_tokens), []).append(r)
    assert sorted(whole) == sorted(set(expected))
    assert sum(r.length for r in rows) == sum(n for _, n in expected)
    ids = b"".join(r.ids for r in whole[8, next(n for i, n in expected if i == 8)])
    assert np.frombuffer(ids, "<u4").tolist() == [*library.encode(ROWS[8][1], add_special_tokens=False).ids, 2]
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert pack(none, path).count() == 0


def rounds_one_by_one(plan, n_queues):
    """(queue, position) of every token, in the order in which queues send them."""
    order, sent = [], [0] * n_queues
    for phase in plan.phases:
        assert sent == phase.sent
        for j in range(1, phase.rounds + 1):
            for q, take in enumerate(phase.take):
                upto = phase.sent[q] + take * j // phase.rounds
                order += [(q, x) for x in range(sent[q], upto)]
                sent[q] = upto
    return order


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 90), min_size=1, max_size=9), st.sampled_from([4, 7, 16]), st.booleans(), st.integers(0, 99))
def test_packing_in_closed_form_equals_rounds_one_by_one(totals, window, weighted, seed):
    r = random.Random(seed)
    plan = schedule(totals, window, [r.choice([0, 1, 2, 5]) for _ in totals] if weighted else None)
    order = rounds_one_by_one(plan, len(totals))
    assert sorted(order) == [(q, x) for q, n in enumerate(totals) for x in range(n)]
    runs = [(q, a, min(n, a + 11) - a) for q, n in enumerate(totals) for a in range(0, n, 11)]
    queue, first, length = (np.array([x[k] for x in runs], np.int64) for k in range(3))
    starts, full = [*plan.tail_starts()], sum(totals) // window
    placed = {}
    for run, lo, n, sequence, offset in zip(*(x.tolist() for x in cut(plan, queue, first, length)), strict=True):
        begin = sequence * window if sequence < full else starts[sequence - full]
        placed |= {begin + offset + k: (int(queue[run]), lo + k) for k in range(n)}
    assert [placed[k] for k in range(len(order))] == order


def test_windows_hold_target_weights_until_a_queue_is_dry():
    totals, weights, window = [9000, 50000, 20000], [3, 1, 1], 1000
    order = rounds_one_by_one(schedule(totals, window, weights), 3)
    for at in range(0, 15000 - window, window):
        held = [sum(q == k for q, _ in order[at : at + window]) for k in range(3)]
        assert all(abs(h - t) <= 2 for h, t in zip(held, (600, 200, 200), strict=True))
    held = [sum(q == k for q, _ in order[20000:30000]) for k in range(3)]
    assert held[0] == 0 and abs(held[1] - held[2]) <= 20


def test_packing_by_weights_and_of_many_sources(spark):
    rows = [(k, words(k, 30), f"s{k % 90}") for k in range(300)]
    table = stored(spark.createDataFrame(rows, "doc_id long, text string, source string"), "many-sources")
    path = public_tokenizers.path("word_bpe_49k.json")
    for weights in (None, {"s1": 2.0, "s2": 1.0}):
        pieces = pack(table, path, window=256, weights=weights).collect()
        assert len({(p.doc_id, p.start) for p in pieces}) == len(pieces) and {p.source for p in pieces} == {f"s{k}" for k in range(90)}
        ends = sorted((p.sequence_id, p.offset, p.length) for p in pieces)
        assert all(b == (a[1] + a[2] if a[0] == s else 0) for a, (s, b, _) in zip(ends, ends[1:], strict=False))
    early = [p for p in pieces if p.sequence_id < 3]
    tokens = {s: sum(p.length for p in early if p.source == s) for s in ("s1", "s2")}
    assert sum(tokens.values()) == 3 * 256 and abs(tokens["s1"] - 512) < 16


def test_exact_dedup_and_its_index(spark, docs, none):
    index = DigestIndex("digest_test", fresh_path(spark, "digest-test"))
    rows = deduplicate(docs, index).collect()
    assert len(rows) == len(ROWS)
    of = {r.doc_id: r for r in rows}
    assert (of[1].keep_id, of[10].keep_id, of[10].kept, of[1].kept) == (1, 1, False, True)
    assert of[9].keep_id == 6 and sum(r.kept for r in rows if r.doc_id == 6) == 1
    assert of[5].keep_id == 5 and of[3].group_size == 3
    assert of[3].text_sha256 == hashlib.sha256(b"").hexdigest()
    again = deduplicate(docs, index).collect()
    assert sorted(again, key=str) == sorted(rows, key=str)
    later = deduplicate(docs, index, batch="second").collect()
    assert not any(r.kept for r in later) and {r.doc_id: r.keep_id for r in later}[10] == 1
    assert deduplicate(none, index, batch="third").count() == 0
    session = spark.newSession()  # another session knows the index by its path only
    other = DigestIndex("digest_test_elsewhere", index.path)
    moved = session.createDataFrame([(77, words(1, 60)), (78, "new")], "doc_id long, text string")
    assert {r.doc_id: (r.keep_id, r.kept) for r in deduplicate(moved, other, batch="fourth").collect()} == {77: (1, False), 78: (78, True)}
    entries = other.entries(session)
    assert "Exchange" not in entries._jdf.queryExecution().executedPlan().toString()
    twice = session.table(other.table).where("keep_id = 78").withColumn("batch", F.lit("fifth")).withColumn("keep_id", F.lit(79).cast("long"))
    other.append(stored(twice, "twice"), other.open(session))  # two batches bring a digest at the same time
    session.catalog.refreshTable(other.table)
    assert other.entries(session).where("keep_id >= 78").collect()[0].keep_id == 79 and deduplicate(moved, other, batch="sixth").count() == 2
    copy = other.compacted(session, "digest_test_compact", fresh_path(session, "digest-compact"))
    assert sorted(copy.entries(session).collect()) == sorted(other.entries(session).collect())
    assert session.table(copy.table).count() == session.table(other.table).count() - 1


def test_repeated_passages(spark, none):
    shared = words(99, 80)
    texts = [(1, f"{words(1, 50)} {shared} {words(2, 30)}"), (2, f"{words(3, 40)}\n{shared}"), (3, words(4, 200)), (4, None), (5, "")]
    table = stored(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), "passages")
    found = repeated_passages(table).collect()
    assert {r.doc_id for r in found} == {2} and sum(r.n_words for r in found) >= 50 and all(r.kept_in == [1] for r in found)
    assert all(texts[1][1][r.start : r.end] in shared for r in found)
    kept = {r.doc_id: r.text for r in without_passages(table, repeated_passages(table)).collect()}
    assert kept[1] == texts[0][1] and len(kept[2]) < len(texts[1][1]) and kept[4] is None and kept[5] == ""
    assert repeated_passages(none).count() == 0


def test_every_repeated_line_goes(spark):
    short, long = "Licensed under the terms of use", words(77, 15)
    texts = [(1, f"{words(1, 50)}\n{short}\n{long}\n{words(2, 9)}"), (2, f"{short}\n{words(3, 40)}\n{long}\n{short}"), (3, f"{words(4, 30)} {short} {words(5, 30)}"), (4, f"{words(6, 5)}\nx\n\nX\n{words(7, 5)}")]
    table = stored(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), "lines")
    found = repeated_passages(table)
    gone = {(r.doc_id, texts[r.doc_id - 1][1][r.start : r.end], r.n_words) for r in found.collect()}
    assert gone == {(2, short, 6), (2, f"{long}\n{short}", 21), (4, "X", 1)}
    kept = {r.doc_id: r.text.split() for r in without_passages(table, found).collect()}
    assert kept[2] == texts[1][1].split("\n")[1].split() and kept[1] == texts[0][1].split() and kept[3] == texts[2][1].split()


def brute_passages(rows, least_words):
    """(row, start, end) of what goes, by one pass over all units in order of rank."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    seen, gone = {}, {k: set() for k in order}
    cut_up = {k: [*(x.tolist() for x in parts[:-2]), list(zip(*(x.tolist() for x in parts[-2:]), strict=True))] for k in order for parts in [text_units(rows[k][1])]}
    first = {}
    for k in order:
        no, upto, *_, digest = cut_up[k]
        for i in sorted(range(len(no)), key=lambda i: (no[i], upto[i])):
            first.setdefault(digest[i], (k, no[i], upto[i]))
            seen[digest[i]] = seen.get(digest[i], 0) + 1
    out = set()
    for k in order:
        no, upto, _, start, end, n_words, line, digest = cut_up[k]
        where = {}
        repeated = [i for i in range(len(no)) if seen[digest[i]] > 1 and first[digest[i]] != (k, no[i], upto[i])]
        parts = sorted((no[i], i) for i in repeated if no[i] == upto[i])
        run = []
        for n, i in [*parts, (None, None)]:
            if run and (n is None or n != run[-1][0] + 1):
                if sum(n_words[j] for _, j in run) >= least_words:
                    gone[k] |= {m for m, _ in run}
                run = []
            if n is not None:
                run.append((n, i))
        for i in repeated:
            if line[i]:
                gone[k] |= set(range(no[i], upto[i] + 1))
        for i in range(len(no)):
            if no[i] == upto[i]:
                where[no[i]] = start[i], end[i]
        island = []
        for n in [*sorted(gone[k]), None]:
            if island and (n is None or n != island[-1] + 1):
                out.add((k, where[island[0]][0], where[island[-1]][1]))
                island = []
            if n is not None:
                island.append(n)
    return out


@pytest.mark.parametrize("least_words", [1, 20])
def test_passages_equal_brute_force(spark, least_words):
    r = random.Random(least_words)
    lines = [words(800 + k, n) for k, n in enumerate([1, 2, 3, 9, 40, 90])]
    rows = []
    for k in range(60):
        parts = [r.choice([words(5000 + 7 * k + j, r.randint(0, 12)), r.choice(lines), f"{words(9000 + 7 * k + j, 2)} {r.choice(lines)}"]) for j in range(r.randint(0, 6))]
        rows.append((r.choice([None, k, k, k // 2]), r.choice(["\n", "\n\n", "\r\n"]).join(parts)))
    rows += [(70, rows[3][1]), (70, rows[3][1]), (None, None), (None, ""), (71, "\n\n"), (72, " ".join([lines[4], *["w"] * 30000, lines[4]])), (73, lines[0]), (73, lines[0])]
    schema = "doc_id long, text string, row string, start long, doc string"
    table = stored(spark.createDataFrame([(*x, "r", 1, "d") for x in rows], schema).coalesce(1), "brute-passages")
    found = repeated_passages(table, least_words=least_words)
    assert {(x.row, x.start, x.end) for x in found.collect()} == brute_passages(rows, least_words)
    cut_texts = without_passages(table, found).collect()
    assert len(cut_texts) == len(rows) and cut_texts[0].row == "r"
    spans = {}
    for k, a, b in sorted(brute_passages(rows, least_words), reverse=True):
        spans.setdefault(k, []).append((a, b))
    want = []
    for k, (doc_id, text) in enumerate(rows):
        for a, b in spans.get(k, []):
            text = text[:a] + text[b:]
        want.append((doc_id, text))
    assert sorted(((x.doc_id, x.text) for x in cut_texts), key=str) == sorted(want, key=str)


def test_pages_of_any_size_and_repeated_rows(spark):
    model = html_text.learn(200)
    long = "<html><body><nav><a href='/'>Home</a></nav><article>" + "".join(f"<p>Paragraph {k} of the long article is here.</p>" for k in range(8000)) + "</article><footer>End</footer>"
    deep = "<div>" * 2000 + "<p>text</p>" + "</div>" * 2000
    pages = [(1, "u", long, 1), (1, "u", long, 1), (None, None, deep, 2), (2, "v", "<article><p>a\u00a0 b &lt;c&gt; &#x1F600;</p></article>", 3)]
    rows = html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string, n_chars int").select("page_id", "url", "html", F.col("n_chars").alias("text")), model).collect()
    assert len(rows) == 4 and [r.text.count("Paragraph") for r in rows if r.page_id == 1] == [8000, 8000]
    assert next(r.text for r in rows if r.page_id == 2) in ("a b <c> \U0001f600", "")


def test_html_extraction_on_held_out_seed_pages_and_edges(spark):
    model = html_text.learn()
    pages = html_seed.seed_pages(150, seed=11)
    forest = html_text.Forest()
    for h in pages:
        forest.add(h)
    keep = html_text.decode(forest, model.log_odds(html_text.features(forest)))
    runs = np.array(forest.run_node)
    assert (keep[runs] == np.array(forest.marked)[runs]).mean() > 0.99
    parent = np.array(forest.parent)
    assert (keep <= keep[parent]).all()
    page = '<html><body><nav><a href="/">Home</a></nav><article><h1>A &amp; B</h1><p>x&nbsp; y<br>z<script>no</script><p>Be.</article><div class="comments"><p>I agree with this</p></div><footer>c</footer>'
    rows = spark.createDataFrame([(1, "u", page, "old"), (2, None, None, "old"), (3, "u", "", "old"), (4, "u", "<" * 500 + "<p" * 500, "old")], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.main_text(rows, model).collect()}
    assert got[1] == ("A & B\n\nx y z\n\nBe.", 17) and got[2] == ("", 0) and got[3] == ("", 0) and 4 in got
    assert html_text.main_text(rows.limit(0), model).count() == 0


def test_code_in_pages_is_no_markup():
    model = html_text.learn(200)
    pages = html_seed.seed_pages(20, seed=12)
    codes = ["<script>for(var i=0;i<n;i++){f(i)}</script>", "<SCRIPT>if(a<b)c('<!--')</Script >", "<style>a{content:'<x'}</style>", "<textarea>a <b c='</textarea>", "<head><title>a <b</title><script>i<n</script></head>", "<svg><script>i<n</script></svg>"]
    for code in codes:
        forests = []
        for added in ("", code):
            forest = html_text.Forest()
            forest.add(f"<html><body>{added}<article><p>Main</p></article></body></html>")
            forests.append((forest.tag, forest.run_text))
        assert forests[0] == forests[1] and "Main" in forests[1][1]
    scripts = [p.replace("<p", codes[0] + "<p", 1) for p in pages]
    assert sum("<script" in p for p in scripts) > 10 and html_text.texts(scripts, model) == html_text.texts(pages, model)


@settings(max_examples=40, deadline=None)
@given(st.binary(min_size=1, max_size=3000))
def test_avi_round_trip(data):
    payload = data.ljust(-(-len(data) // 64) * 64, b"\0") * 3
    stored_form = avi.write_avi(payload)
    assert avi.read_payload(stored_form) == payload
    assert avi.read_payload(stored_form[: stored_form.index(b"idx1")]) == payload  # without its index


def test_frames_of_other_writers_and_shots(monkeypatch):
    samples = np.random.default_rng(0).integers(0, 256, (4, 64), dtype=np.uint8)
    frame = jpeg.encode_samples(samples)
    monkeypatch.setattr(jpeg, "_constant", lambda table: 0)
    assert (jpeg.luminance(frame).reshape(4, 8, 64, 8) == samples[:, None, :, None]).all()
    dark, light = np.full((8, 8), 10, np.uint8), np.full((8, 8), 200, np.uint8)
    clips = avi.shots(iter([dark] * 5 + [light] * 3), 0.04)
    assert [(c[1], c[2], c[3], c[4]) for c in clips] == [(0, 4, 0.0, 0.2), (5, 7, 0.2, 0.32)]
    assert avi.clips_of(None) == avi.clips_of(b"") == avi.clips_of(b"RIFF....AVI ") == []


def test_media_columns(docs, none):
    rows = {r.media_id: r for r in avi.features(avi.stored_texts(docs)).collect()}
    assert rows[3].payload_bytes == 64 and rows[3].payload_sha256 == hashlib.sha256(bytes(64)).hexdigest() and rows[1].media_sha256 == rows[10].media_sha256
    assert avi.features(avi.stored_texts(none)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_language_on_held_out_documents(spark, docs, none):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    profiles = stored(langid.learn(table.where(~langid.held_out(F.col("doc_id")))), "test-profiles")
    right = langid.predict(table, profiles).where(langid.held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    assert right.where("lang = lang_pred").count() >= 0.95 * right.count() > 0
    got = langid.predict(docs, profiles)
    assert got.columns == [*docs.columns, "lang_pred", "score", "nearness"]
    assert {r.doc_id: r.lang_pred for r in got.collect()}[3] == "und" and got.where("text = ''").first().score == 0
    assert langid.predict(none, profiles).count() == 0 and langid.predict(docs, profiles.limit(0)).where("lang_pred <> 'und'").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aé b_1,", max_size=12), max_size=30), st.integers(3, 9))
def test_language_counts_do_not_depend_on_slices(parts, width):
    text = "".join(parts)
    langid._SLICE = 10**6
    whole = langid.ngram_counts(text)
    langid._SLICE = width
    cut_up = langid.ngram_counts(text)
    langid._SLICE = 10**6
    stream = "_" + "".join(c if c.isalpha() else "_" for c in text.lower()) + "_"
    stream = re.sub("_+", "_", stream)
    plain = {}
    for n in (1, 2, 3):
        for k in range(len(stream) - n + 1):
            if stream[k : k + n] != "_":
                code = int("".join(f"{ord(c):021b}" for c in stream[k : k + n]), 2)
                plain[code] = plain.get(code, 0) + 1
    for grams, counts in (whole, cut_up):
        assert dict(zip(grams.tolist(), counts.tolist(), strict=True)) == plain


def test_languages_against_plain_ranks(spark):
    r = random.Random(8)
    pools = {f"l{k}": ["".join(r.choice("abcdefgh"[k % 5 : k % 5 + 4]) for _ in range(r.randint(1, 5))) for _ in range(12)] for k in range(7)}
    rows = [(None if k % 9 == 0 else k, " ".join(r.choices(pool, k=25)), lang) for lang, pool in pools.items() for k in range(6)]
    rows += [(500, "zz zz", "l0"), (501, "ab ba", "l9"), (502, "ab ba", "l8"), (503, "...", "l1"), (504, None, "l1")]
    table = stored(spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1), "plain-langs")

    def ranks(counts, size):
        return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size]]

    def grams(text):
        return dict(zip(*(x.tolist() for x in langid.ngram_counts(text)), strict=True))

    totals = {}
    for _, text, lang in rows:
        for g, n in grams(text).items() if text else ():
            own = totals.setdefault(lang, {})
            own[g] = own.get(g, 0) + n
    size = 30
    profiles = {lang: ranks(own, size) for lang, own in totals.items()}
    learned = stored(langid.learn(table, size=size), "plain-profiles")
    held = {}
    for p in learned.orderBy("place").collect():
        held.setdefault(p.lang, []).append(p.gram)
    assert held == profiles and len(held) == 9
    for got in langid.predict(table, learned, size=size).collect():
        own = ranks(grams(got.text), size) if got.text else []
        if not [g for g in own if g != ord("_")] or not any(c.isalpha() for c in got.text):
            assert (got.lang_pred, got.score) == ("und", 0)
            continue
        far = {lang: sum(abs(profile.index(g) - k) if g in profile else size for k, g in enumerate(own)) for lang, profile in profiles.items()}
        best, second = sorted(far, key=lambda x: (far[x], x))[:2]
        assert got.lang_pred == best and abs(got.score - ((far[second] - far[best]) / far[second] if far[second] else 0)) < 1e-9
    assert {x.doc_id: x.lang_pred for x in langid.predict(table, learned, size=size).collect()}[501] == "l8"  # a tie with l9


def test_mixing_reaches_targets(docs, none):
    rows = mix(docs).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.taken <= 3 * r.size for r in rows)
    total = sum(r["size"] for r in rows)
    assert abs(sum({(r.source_size, r.target): r.target for r in rows}.values()) - total) < 1e-3
    assert abs(sum(r.taken for r in rows) - total) < 0.05 * total + 100
    assert mix(none).count() == 0


def test_seats_equal_a_plain_ranking_of_quotients(spark):
    r = random.Random(2)
    rows = [(g, k, float(r.choice([0, 1, 1, 2, 5, 7, 7, 30])), seats) for g, seats, n in (("a", 7, 5), ("b", 40, 9), (None, 3, 4), ("d", 0, 3), ("e", 5, 6)) for k in [*range(n - 1), None]]
    rows = [(g, k, 3.0 if g == "e" else w, seats) for g, k, w, seats in rows]  # ties only
    table = stored(spark.createDataFrame(rows, "g string, k int, w double, seats long"), "parties")
    got = {(x.g, x.k): x.won for x in apportion(table, ["g"], "k", "w", "seats").collect()}
    for g in {x[0] for x in rows}:
        own = [(k, w) for x, k, w, _ in rows if x == g]
        seats = next(x[3] for x in rows if x[0] == g)
        order = sorted(((-w / (2 * i + 1), k is None, k or 0, i, k) for k, w in own for i in range(seats) if w > 0))[:seats]
        assert {k: got[g, k] for k, _ in own} == {k: sum(x[4] == k for x in order) for k, _ in own}
    assert apportion(table.limit(0), ["g"], "k", "w", "seats").count() == 0


def test_targets_stop_at_their_cap(spark):
    sizes = {"a": 1000, "b": 10, "c": 400, None: 5}
    table = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, rows long")
    got = {x.source: x.target for x in capped(table, (5, 2, 1), 3).collect()}
    weights, total = {"a": 5, "b": 2, "c": 1, None: 5}, sum(sizes.values())
    want, left = {}, dict(weights)
    while True:  # share again and again until none is above its cap
        rest = total - sum(want.values())
        over = {s for s in left if rest * left[s] / sum(left.values()) > 3 * sizes[s]}
        if not over:
            want |= {s: rest * w / sum(left.values()) for s, w in left.items()}
            break
        want |= {s: 3 * sizes[s] for s in over}
        left = {s: w for s, w in left.items() if s not in over}
    assert {s: round(t, 6) for s, t in want.items()} == got


def test_a_mix_is_written_as_it_was_taken(docs):
    mixture = mix(docs)
    taken = {}
    for x in mixture.collect():
        taken[x.doc_id] = taken.get(x.doc_id, 0) + x.taken
    made = {}
    for x in mixed_documents(docs, mixture).collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", x.text))
        assert n > 0 and words_of(ROWS, x.doc_id)[:n] == re.findall(r"[^\x20\x09-\x0D]+", x.text)
        made[x.doc_id] = made.get(x.doc_id, 0) + n
    assert {k: n for k, n in taken.items() if n} == made


def words_of(rows, doc_id):
    return re.findall(r"[^\x20\x09-\x0D]+", next(t for i, t, *_ in rows if i == doc_id) or "")


def brute_components(texts, percent=75):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        n = min(5, len(w))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set())
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and root[a] != root[b]:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    return [(len(s), r) for s, r in zip(sets, root, strict=True)]


def test_near_duplicates_equal_brute_force(spark, none):
    r, texts = random.Random(5), [None, "", " ", "one", "one", "One\ttwo"]
    passage = words(500, 40).split()
    for k in range(12):
        base = words(k, r.choice([8, 30, 120])).split()
        for _ in range(8):
            copy = list(base)
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(len(copy))] = f"z{r.random()}"
            texts.append(" ".join(copy))
        texts += [" ".join(passage + words(900 + k * 3 + j, r.randint(2, 30)).split()) for j in range(3)]
    table = stored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "near")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_duplicates(table, short=4).collect()}
    assert [got[k] for k in range(len(texts))] == brute_components(texts)
    assert near_duplicates(none).count() == 0


def test_near_duplicates_whose_values_are_all_in_long_lists(spark):
    r, texts = random.Random(3), []
    pool = [words(700 + k, 12) for k in range(24)]
    for _ in range(60):
        base = sorted(r.sample(range(24), 14))
        other = sorted([*r.sample(base, 13), r.choice([k for k in range(24) if k not in base])])
        texts += [" ".join(pool[k] for k in chosen) for chosen in (base, other)]
    table = stored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "near-long")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_duplicates(table).collect()}
    want = brute_components(texts)
    assert len({c for _, c in want}) > 5 and [got[k] for k in range(len(texts))] == want


def test_near_duplicates_of_repeated_and_null_rows(docs):
    rows = near_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    assert {r.doc_id: r.component_id for r in rows}[2] == 1 and sum(r.stays for r in rows if r.component_id == 6) == 1


def test_near_duplicates_where_a_thousand_doc_ids_are_null(spark):
    base = words(3, 60).split()
    texts = [" ".join([*base[:k % 50], f"z{k}", *base[k % 50 :]]) for k in range(1000)] + [words(4000 + k, 30) for k in range(20)]
    table = stored(spark.createDataFrame([(None if k < 1000 else 7, t) for k, t in enumerate(texts)], "doc_id long, text string"), "null-ids")
    rows = near_duplicates(table).collect()
    assert len(rows) == 1020 and sum(r.stays for r in rows) == 21 and sum(r.doc_id is None and r.component_id is None for r in rows) == 1000
    folder = stored(table, "beside").inputFiles()[0].split("/ledgerloom/")[0].replace("file:", "")
    left = {name.rsplit("-", 1)[0] for name in os.listdir(f"{folder}/ledgerloom")}
    assert "owners" in left and not left & {"signatures", "sets", "postings", "blocks", "parents"}


def plain_base(t):
    out = []
    for k, p in enumerate([r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
            if k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 2 and 12 <= len(d) <= 19 and luhn or k == 3 and 9 <= len(d) <= 15:
                out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda s: (s[0], s[2]))


@settings(max_examples=1500, deadline=None)
@given(st.text("0123456789..@@++ab- ()\n%é", max_size=70))
def test_base_spans_equal_plain_patterns(text):
    assert pii.base_spans(text) == plain_base(text)


def test_personal_data(spark, docs, none):
    text = "mail me: a.b@x.example.com or +1 (377) 555-0271, call (212) 555-0199, card 4111 1111 1111 1111"
    table = spark.createDataFrame([(1, text), (2, None), (3, "")] + [(k, f"phone (212) 555-{k:04d} now") for k in range(10, 60)], "doc_id long, text string")
    got = {r.doc_id: [s.kind for s in r.spans] for r in pii.personal_data(table).collect()}
    assert [k for k in got[1] if k in ("email", "card")] == ["email", "card"] and got[1].count("phone") == 2 and got[2] == got[3] == []
    assert pii.personal_data(none).count() == 0 and pii.personal_data(docs).count() == len(ROWS)


def test_reliabilities_and_classifier_are_learned():
    r = np.random.default_rng(4)
    truth = r.random(6000) < 0.3
    right = [0.95, 0.8, 0.7, 0.5, 0.6]  # the fourth labeler knows nothing
    votes = np.zeros(len(truth), np.int64)
    for k, share in enumerate(right):
        said = np.where(r.random(len(truth)) < share, truth, ~truth)
        votes += np.where(r.random(len(truth)) < 0.15, 1, 2 * said) * 3**k
    kind = np.zeros(len(truth), np.int64)
    found = pii.estimate(kind, votes, np.ones(len(truth)))
    trust = [found.given[k, 1, 2] / (found.given[k, 1, 0] + found.given[k, 1, 2]) for k in range(5)]
    assert all(abs(t - share) < 0.06 for t, share in zip(trust, right, strict=True)) and abs(found.prior[0] - 0.3) < 0.04
    p = found.posterior(kind, votes)
    majority = sum((votes // 3**k % 3).astype(int) - 1 for k in range(5)) > 0
    assert ((p > 0.5) == truth).mean() > (majority == truth).mean() + 0.05
    code = np.where(truth, 1, 0)  # a feature that tells the classes apart
    weights = pii.train(kind, code, p, np.ones(len(truth)))
    assert weights[-1][1] - weights[-1][0] > 2
    turned = pii.train(kind, code, 1 - p, np.ones(len(truth)))
    assert turned[-1][1] - turned[-1][0] < -2


def test_secret_ledger_scans_a_blob_once(spark, docs, none):
    path = fresh_path(spark, "test-ledger")
    table = stored(spark.createDataFrame([(1, "token = 'abcdef12'"), (2, "token = 'abcdef12'"), (3, None), (4, "AKIA" + "A" * 16)], "doc_id long, text string"), "secrets")
    for _ in range(2):
        got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secrets.scan_incrementally(table, path).collect()}
        assert got == {1: [("assign", 0, 17)], 2: [("assign", 0, 17)], 3: [], 4: [("access", 0, 20)]}
    assert spark.read.parquet(path).count() == 3
    spark.read.parquet(path).coalesce(1).write.mode("append").parquet(path)  # two runs at the same time
    assert sorted(r.doc_id for r in secrets.scan_incrementally(table, path).collect()) == [1, 2, 3, 4]
    longer = (secrets.Rule("assign", secrets.BASE[0].pattern, 9, 2), *secrets.BASE[1:])
    assert secrets.version_of(longer) != secrets.version_of(secrets.BASE)
    assert {r.doc_id: len(r.spans) for r in secrets.scan_incrementally(table, path, longer).collect()} == {1: 0, 2: 0, 3: 0, 4: 1}
    assert secrets.scan_incrementally(none, path).count() == 0 and secrets.scan_incrementally(docs, path).count() == len(ROWS)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in found.description]
    ours = sorted(str([r[c] for c in columns]) for r in queries.QUERIES[name](spark, SF).collect())
    assert ours == sorted(str(list(r)) for r in found.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_pipeline_stages_against_plain_python(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps, kept = dict(pipeline.STAGES), {}
    for name, stage in pipeline.STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, SF), "test-stage")
        assert docs.columns == before.columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.text for r in before.collect()}
    after, before = kept["language_id"]
    assert set(after) == {i for i, t in before.items() if any(c.isalpha() for c in t or "")}
    foreign = [(10**6 + k, t, None, None, 1) for k, t in enumerate(["привет как дела сегодня хорошо", "xqzk vvrt qqpl zzkw jjxq wwqz kkvv", "The of and in to that. "])]
    more = stored(spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame(foreign, "doc_id long, text string, lang string, source string, n_chars long")), "test-foreign")
    assert {r.doc_id for r in steps["language_id"](spark, more, SF).collect()} == set(after) | {10**6 + 2}
    after, before = kept["exact_dedup"]
    squeeze = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
    assert len(after) == len({squeeze(t) for t in before.values()}) == len({squeeze(t) for t in after.values()})
    after, before = kept["near_dedup"]
    ids = sorted(before)
    assert sorted(after) == sorted({ids[c] for _, c in brute_components([before[i] for i in ids])})
    assert steps["packing"](spark, docs, SF).agg(F.sum("length")).first()[0] > 0
