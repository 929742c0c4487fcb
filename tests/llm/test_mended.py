"""Pages with elements that don't end, choices over small trees, foreign media, shared state, and clashing columns."""

import itertools
import re
import threading

import numpy as np
import pytest

import corpus_pipeline
from ledgerloom.llm import avi, html_seed, html_text, substring_dedup
from ledgerloom.llm.scratch import discarding, small_batches, stored


@pytest.fixture(scope="module")
def model():
    return html_text.learn(200)


def test_pages_without_the_end_of_their_head(model):
    pages = html_seed.seed_pages(20, seed=12)
    whole = html_text.texts(pages, model)
    assert sum(map(bool, whole)) > 15
    without = [re.sub(r"</head>\s*", "", p) for p in pages]
    assert html_text.texts(without, model) == whole
    both = [re.sub(r"</head>\s*(<body[^>]*>)?", "", p) for p in pages]
    assert sum(x == y for x, y in zip(html_text.texts(both, model), whole, strict=True)) >= 18  # a body's own words are features


@pytest.mark.parametrize("opened", ["<button>Menu", "<video src=a.mp4>", "<select><option>A", "<noscript>", "<template>", "<object>", "<audio>", "<canvas>", "<svg><g>"])
@pytest.mark.parametrize("around", ["<nav>{}</nav>", "<div class=menu>{}</div>", "{}"])
def test_elements_without_an_end_leave_the_article(model, opened, around):
    paragraphs = "".join(f"<p>Sentence {k} of the article, and it goes on, with words and more.</p>" for k in range(6))
    page = f"<html><head><title>x</title><meta charset=utf-8></head><body>{around.format(opened)}<article><h1>Title here</h1>{paragraphs}</article><footer>c</footer></body></html>"
    forest = html_text.Forest()
    forest.add(page)
    assert any("Sentence 3" in t for t in forest.run_text)
    assert "Sentence 3 of the article" in html_text.texts([page], model)[0]


def runs(html):
    forest = html_text.Forest()
    forest.add(html)
    return forest.run_text


def test_what_a_head_and_skipped_elements_hold():
    assert runs("<head><title>x</title><script src='a'/>let a = 1</script><p>one</p>") == ["one"]
    assert runs("<head><link rel=a><template><p>hidden</p></template></head><p>one") == ["one"]
    assert runs("<head>\n text ends it <p>one") == ["text ends it", "one"]
    assert runs("<head><meta a></head><header>top</header>") == ["top"]
    assert runs("<p>a</p><button>x<button>y</button><p>b") == ["a", "b"]
    assert runs("<object><object><p>x</p></object><p>y</p></object><p>b") == ["b"]
    assert runs("<svg><title/><g></svg><p>b") == ["b"]
    assert runs("<noscript><div><p>x</div></noscript><p>b") == ["b"]
    assert runs("<div><select><option>x</div><p>b") == ["b"]
    assert runs("<video><p>b<div>c" + "<video>" * 3000 + "d") == ["b", "cd"]


def test_decoding_is_the_best_of_all_choices():
    r = np.random.default_rng(4)
    for _ in range(60):
        n = int(r.integers(1, 9))
        forest = html_text.Forest()
        forest.parent = [0, *(int(r.integers(0, k)) for k in range(1, n))]
        forest.tag = [0] * n
        odds = r.normal(0, 2, n)
        yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
        worth = lambda keep: sum(yes[k] if keep[k] else no[k] for k in range(1, n))  # noqa: E731  the page itself is kept
        able = [(True, *c) for c in itertools.product([False, True], repeat=n - 1) if all(not c[k - 1] or ((True, *c)[forest.parent[k]]) for k in range(1, n))]
        found = html_text.decode(forest, odds)
        assert tuple(found) in able and np.isclose(worth(found), max(map(worth, able)))


def test_media_that_are_missing_or_foreign(spark):
    good = avi.write_avi(b"x" * 64)
    rows = [(1, 1, None), (2, 2, b""), (3, 3, b"RIFF\x10\0\0\0AVI nonsense"), (4, 4, good[:-40]), (5, 64, good), (None, 64, good), (5, 64, good)]
    media = spark.createDataFrame([(i, n, None if b is None else bytearray(b)) for i, n, b in rows], "media_id long, n_bytes long, avi binary")
    got = avi.features(media).collect()
    assert len(got) == 7 and [r.payload_bytes for r in got if r.media_id in (1, 2, 3)] == [None] * 3
    assert [r.media_bytes for r in got][:3] == [None, 0, len(rows[2][2])]
    assert all(r.payload_bytes == 64 or r.media_id == 4 for r in got if r.media_id not in (1, 2, 3))
    assert avi.features(media.limit(0)).count() == 0
    assert avi.timed_clips(media).select("media_id").distinct().count() >= 2


def test_batches_hold_a_megabyte_at_least(spark):
    docs = stored(spark.createDataFrame([(1, "a text", "en", "s")], "doc_id long, text string, lang string, source string"), "batch-docs")
    for made in (avi.features(avi.stored_texts(docs)), html_text.main_text(docs.selectExpr("doc_id page_id", "'u' url", "text html"), html_text.learn(50)), substring_dedup.repeated_passages(docs)):
        made.count()
        small_batches(spark)
        assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) >= 1 << 20


def test_operators_in_two_threads_keep_each_others_tables(spark):
    begun, ended, found = threading.Event(), threading.Event(), []

    def first():
        with discarding(spark):
            table = stored(spark.range(5), "first")
            begun.set()
            ended.wait(60)
            found.append(table.count())

    def second():
        begun.wait(60)
        with discarding(spark):
            stored(spark.range(3), "second")
        ended.set()

    threads = [threading.Thread(target=f) for f in (first, second)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert found == [5]


def test_language_stage_keeps_columns_of_any_name(spark):
    text = "the words of a text that goes on and on for a while in one language "
    rows = [(k, text * 3 + str(k), "en" if k % 2 else None, "s", 5.5, "mine", -1.0, "d") for k in range(40)] + [(99, None, None, "s", 1.0, "a", 2.0, "d"), (98, "12 34", "en", "s", 1.0, "a", 2.0, "d")]
    docs = stored(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, lang_pred string, nearness double, doc string"), "clashes")
    got = corpus_pipeline.language_id(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == sorted((i, t, "en", *rest) for i, t, _, *rest in rows[:40])


def test_digests_have_two_lanes():
    a, b = (substring_dedup.text_units(t) for t in ("one two three four", "one two three five"))
    assert len(a) == 9 and a[7][0] != b[7][0] and a[8][0] != b[8][0]
    assert substring_dedup.text_units("ONE two  three four")[8][0] == a[8][0]
