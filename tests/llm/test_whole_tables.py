"""Language profiles and the bound of the pipeline's language stage come from all rows, however many a language has."""

import zlib
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import langid
from ledgerloom.llm.scratch import stored

WORDS = "the words of a text that goes on and on for a while in one language"


def test_profiles_are_learned_from_every_row(spark):
    n = 9000
    rows = [(k, chr(0x4E00 + k), "zh") for k in range(n)] + [(n, None, "zh"), (n + 1, "x", None), (n + 2, "", "zh"), (n + 3, "y", "rare")]
    learned = langid.learn(stored(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "many-rows"), size=10 * n)
    assert {r["lang"]: r["count"] for r in learned.groupBy("lang").count().collect()} == {"zh": 4 * n, "rare": 4}
    assert learned.where("lang = 'zh'").agg(F.max("place")).first()[0] == 4 * n


def test_counts_do_not_depend_on_what_is_held_at_a_time():
    texts = [(f"l{k % 3}", chr(0x4E00 + k % 40) * (k % 5) + " ab" * (k % 4)) for k in range(300)]
    batches = [pd.DataFrame(texts[k : k + 70], columns=["lang", "text"]) for k in range(0, 300, 70)]
    plain = Counter()
    for lang, text in texts:
        for g, n in zip(*(x.tolist() for x in langid.ngram_counts(text)), strict=True):
            plain[lang, g] += n
    for most in (1, 50, 1 << 20):
        got, rows = Counter(), 0
        for part in langid.language_counts(iter(batches), most):
            rows += len(part)
            for lang, g, n in zip(part["lang"], part["gram"].tolist(), part["n"].tolist(), strict=True):
                got[lang, g] += n
        assert got == plain and (rows == len(plain)) == (most > 50)


def held(k):
    return zlib.crc32(str(k).encode()) % 4 == 2


def far_rows(n, n_far):
    """Labelled rows, of which ``n_far`` that are held out are the less near the more they have of another script."""
    out = [k for k in range(n) if held(k)]
    foreign = {k: " ".join(chr(0x0430 + j) * 3 for j in range(2 + i)) for i, k in enumerate(out[:: len(out) // n_far][:n_far])}
    return [(k, f"{WORDS} {foreign.get(k, '')}", "en") for k in range(n)]


def bounds(docs, profiles, **options):
    return {r["lang"]: r["bound"] for r in langid.least_nearness(docs, profiles, **options).collect()}


def test_a_bound_is_the_percentile_of_every_held_out_row(spark):
    rows = far_rows(12000, 28) + [(12000 + k, "ab ba", "aa") for k in range(40)]
    docs = stored(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "far-rows")
    out = docs.where(langid.held_out(F.col("doc_id")))
    profiles = stored(langid.learn(docs.where(~langid.held_out(F.col("doc_id")))), "far-profiles")
    found = langid.predict(out, profiles).collect()
    reached = sorted(r["nearness"] for r in found if r["lang_pred"] == "en")
    place = 0.001 * (len(reached) - 1)
    low = int(place)
    whole = {"en": reached[low] + (place - low) * (reached[low + 1] - reached[low]), "aa": min(r["nearness"] for r in found if r["lang_pred"] == "aa")}
    assert len(reached) > 2900 and len(set(reached[:5])) == 5
    for share in (0.5, 1.0):
        got = bounds(out, profiles, share=share)
        assert got.keys() == whole.keys() and all(abs(got[lang] - share * whole[lang]) < 1e-12 for lang in whole)
    one = out.where(F.col("doc_id") == out.first()["doc_id"])
    assert bounds(one, profiles, share=1.0) == {"en": langid.predict(one, profiles).first()["nearness"]}
    assert bounds(out.where("lang is null"), profiles) == {} == bounds(out, profiles.limit(0))


def test_a_rare_language_is_not_held_to_the_nearness_of_others(spark):
    n = 12000
    rare = [k for k in range(n, n + 90) if not held(k)][:38] + [k for k in range(n, n + 90) if held(k)][:2]
    chars = [[chr(0x4E00 + (7 * k + j * j * (k % 5 + 1)) % 900) for j in range(60)] for k in range(40)]
    rows = [(k, f"{WORDS} {k}", "en") for k in range(n)] + [(k, "".join(c), "zh") for k, c in zip(rare, chars, strict=True)]
    docs = stored(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "rare-rows")
    out = langid.held_out(F.col("doc_id"))
    profiles = stored(langid.learn(docs.where(~out)), "rare-profiles")
    nearness = {r["doc_id"]: r["nearness"] for r in langid.predict(docs, profiles).collect()}
    assert max(nearness[k] for k in rare) < 0.5 * min(nearness[k] for k in range(n))
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert kept == {*range(n), *rare}


def test_the_language_stage_knows_what_any_row_teaches(spark):
    n = 9000
    taught = [k for k in range(n) if not held(k)]
    rows = [(k, chr(0x4E00 + k), "zh") for k in range(n)] + [(n + k, "abc", "aa") for k in range(9)]
    rows += [(n + 100 + k, chr(0x4E00 + k), None) for k in taught[:300]]
    docs = stored(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "stage-rows")
    found = {r["doc_id"]: r["lang"] for r in corpus_pipeline.language_id(spark, docs, "").where(F.col("doc_id") >= n + 100).collect()}
    assert found == {n + 100 + k: "zh" for k in taught[:300]}
