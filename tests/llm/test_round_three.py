"""Hard negatives, best-fit packing and the divergence audit on awkward rows and against brute force."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import divergence as audit
from ledgerloom.llm import negatives, repacking
from ledgerloom.llm.divergence import divergence
from ledgerloom.llm.negatives import hard_negatives
from ledgerloom.llm.repacking import best_fit, exchange, least_bins, pack_best_fit
from ledgerloom.llm.scratch import stored
from ledgerloom.llm.tokens import ByteTokenizer

EMBEDDINGS = "vec_id long, embedding array<float>, label int, row long, score string"


def mined(rows, positives=5, negatives=10):
    """The contract, row by row: anchors are kept apart by their place."""
    used = [(k, i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v])
            for k, (i, v, label, *_) in enumerate(rows) if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, i, label, v in used:
        if i is None or i % 100:
            continue
        scored = sorted(((sum(x * y for x, y in zip(v, w, strict=False)), j, m) for b, j, m, w in used if b != a), key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        for score, j in [(s, j) for s, j, m in scored if m == label][:positives]:
            fits = [(s, b) for s, b, m in scored if m != label and 30 * score <= 100 * s <= 90 * score][:negatives]
            out += [(i, j, rank, b, score, s) for rank, (s, b) in enumerate(fits, 1)]
    return sorted(out, key=repr)


def vectors(seed, n, dim=6, labels=3):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    return [(k * 25, [c + r.gauss(0, 0.4) for c in r.choice(centres)], r.randrange(labels), k, "x") for k in range(n)]


def test_hard_negatives_equal_brute_force(spark):
    rows = vectors(1, 700)
    rows += [(100, rows[4][1], 1, 9, "x"), (100, rows[4][1], 1, 9, "x"), (None, rows[8][1], 0, 9, None), (None, rows[8][1], 1, 9, None)]
    rows += [(200000, None, 1, 1, ""), (200100, [1.0, None, 0.0], 1, 1, ""), (200200, [math.nan] * 6, 1, 1, ""), (200300, [math.inf] * 6, 1, 1, ""), (200400, [0.5] * 6, None, 1, ""), (200500, [], 1, 1, ""), (200600, [1.0], 1, 1, ""), (200700, [3.0] * 6, 2, 1, "")]
    rows += [(300000 + k, [2.0, 1.0, 0.0, 0.0, 0.0, 0.0], 1 + k % 2, 1, "") for k in range(150)]
    table = stored(spark.createDataFrame(rows, EMBEDDINGS).repartition(3), "test-vectors")
    assert sorted(map(tuple, hard_negatives(table, cell=16, chunk=5).collect()), key=repr) == mined(rows)


def test_hard_negatives_of_an_empty_table_and_of_one_label(spark):
    none = stored(spark.createDataFrame([], EMBEDDINGS), "test-no-vectors")
    assert hard_negatives(none).count() == 0
    one = stored(spark.createDataFrame([(100 * k, [1.0, float(k)], 4, 0, "") for k in range(1, 9)], EMBEDDINGS), "test-one-label")
    rows = [(100 * k, [1.0, float(k)], 4) for k in range(1, 9)]
    assert sorted(map(tuple, hard_negatives(one).collect()), key=repr) == mined(rows)


def test_search_scans_less_than_everything(spark):
    """Far groups of vectors: a certified search leaves most rings alone."""
    r = random.Random(3)
    rows = [(k, [20.0 * math.cos(g) + r.gauss(0, 0.1), 20.0 * math.sin(g) + r.gauss(0, 0.1)], k % 4, 0, "") for k in range(20000) for g in [k % 40 / 40 * 2 * math.pi]]
    table = stored(spark.createDataFrame(rows, EMBEDDINGS), "test-rings")
    own = stored(negatives.integer_vectors(table), "v")
    index = negatives.fit(own)
    keys = stored(negatives.keyed(own, index), "k")
    query = keys.where("vec_id = 100").toPandas()
    packed = negatives._packed(query)

    class Row:
        n, rows, labels, vectors = 1, packed["rows"], packed["labels"], packed["vectors"]
        lo, hi, there = (np.array([[x]], np.int64).tobytes() for x in (-(2**60), 2**60, 100))

    needed = negatives._Queries(Row, index).needed(index, 2)
    occupied = {(k["pivot"], k["ring"]): k["n"] for k in keys.groupBy("pivot", "ring").agg(F.count("*").alias("n")).collect()}
    assert sum(n for k, n in occupied.items() if needed[k]) < 0.5 * sum(occupied.values())


def fewest(lengths, capacity):
    """Bins of an optimal packing, by trying all."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def put(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(bins)
            return
        for j in {b: j for j, b in enumerate(bins)}.values():
            if bins[j] + lengths[k] <= capacity:
                put(k + 1, [*bins[:j], bins[j] + lengths[k], *bins[j + 1 :]])
        put(k + 1, [*bins, lengths[k]])

    put(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_bounds_hold_and_best_fit_is_a_packing(lengths):
    lengths = np.array(lengths, np.int64)
    bins, offsets, made = best_fit(lengths, 20)
    assert set(bins.tolist()) == set(range(made))
    for b in range(made):
        at = 0
        for k in sorted(np.flatnonzero(bins == b), key=lambda k: offsets[k]):
            assert offsets[k] == at
            at += lengths[k]
        assert at <= 20
    optimum = fewest(lengths.tolist(), 20) if len(lengths) else 0
    assert least_bins(lengths, 20) <= optimum <= made


def test_bounds_see_more_than_the_sum():
    assert least_bins(np.array([600] * 5), 1024) == 5
    assert least_bins(np.array([400] * 6), 1024) == 3
    assert least_bins(np.array([], np.int64), 1024) == 0


def test_exchange_saves_bins_and_keeps_every_piece(spark):
    r = random.Random(5)
    rows = [(k, r.randint(1, 63)) for k in range(3000)]
    items = stored(spark.createDataFrame(rows, "key long, length long"), "items")
    alone = exchange(items, 64, part=40, together=1).toPandas()
    together = exchange(items, 64, part=40).toPandas()
    for placed in (alone, together):
        assert sorted(zip(placed["key"], placed["length"], strict=True)) == rows
        for _, rows_of in placed.groupby(["pool", "bin"]):
            own = rows_of.sort_values("offset")
            assert own["offset"].tolist() == [0, *np.cumsum(own["length"])[:-1]] and own["length"].sum() <= 64
    count = lambda x: len(x.groupby(["pool", "bin"]))
    assert least_bins(np.array([n for _, n in rows]), 64) <= count(together) <= count(alone)


DOCS = "doc_id long, text string, key string, piece int"


def test_best_fit_packing_places_every_id_once(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    r = random.Random(2)
    texts = [None, "", " ", "one two\n\nthree", "x" * 30000, "wörter und 漢字 <|endoftext|> it's\x1c 12", *(" ".join(f"w{r.randint(0, 99)}" for _ in range(r.randint(1, 900))) for _ in range(60))]
    rows = [(k, t, "k", 1) for k, t in enumerate(texts)] + [(3, texts[3], "k", 1), (None, "null id", None, None)]
    table = stored(spark.createDataFrame(rows, DOCS), "test-best-fit")
    found = pack_best_fit(table, path).collect()
    ids = {t: [*library.encode(t or "", add_special_tokens=False).ids, 2] for t in texts + ["null id"]}
    whole, sequences = defaultdict(list), defaultdict(list)
    for x in found:
        assert zlib.crc32(x.ids) == x.ids_crc32 and len(x.ids) == 4 * x.length
        whole[x.doc_id].append(x)
        sequences[x.sequence_id].append((x.offset, x.length))
    assert Counter(x.doc_id for x in found if x.piece == 0) == Counter(i for i, *_ in rows)
    for i, t, *_ in rows:
        own = sorted(whole[i], key=lambda x: x.start)
        if i != 3:
            assert [x.piece for x in own] == list(range(len(own)))
            assert np.frombuffer(b"".join(x.ids for x in own), "<u4").tolist() == ids[t]
            assert all(x.length == 1024 for x in own[1:]) and [x.start for x in own] == [0, *np.cumsum([x.length for x in own])[:-1]]
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= least_bins(np.array([x.length for x in found]), 1024) + 1
    assert pack_best_fit(table.limit(0), path).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(" \n\t\r\x85\xa0 ab'sSltre1é½漢,._-\x1c<|>"), max_size=20))
def test_byte_tokens_equal_the_library(text):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert np.frombuffer(ByteTokenizer(path)(text), "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def audited(rows, most=200):
    """The contract in exact integers."""
    import re

    unit, docs = 10**9, [(lang or "", source or "", [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]) for _, text, lang, source, *_ in rows]
    out = []
    for lang in {x[0] for x in docs}:
        own = [x for x in docs if x[0] == lang]
        within, whole, groups = Counter(), Counter(), defaultdict(Counter)
        for _, source, terms in own:
            within.update(set(terms))
            whole.update(terms)
            groups[source].update(terms)
        kept = sorted(t for t in within if within[t] >= 3)
        shares = lambda counts: {t: 1 + unit * (counts[t] + 1) // (sum(counts[x] for x in kept) + len(kept)) for t in kept}
        q, p = shares(whole), {s: shares(c) for s, c in groups.items()}
        for s in groups:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in groups if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, valued in (("pair", sorted(pairs)), ("term", sorted(terms)[:most])):
                out += [(lang, s, part, item, -v, k) for k, (v, _, item) in enumerate(valued, 1)]
    return sorted(out)


AUDIT = "doc_id long, text string, lang string, source string, term string, value int"


@pytest.mark.parametrize("block", [256, 2])
def test_divergence_equals_brute_force(spark, block):
    r = random.Random(7)
    pool = ["Über", "straße", "a", "B", "b", "the", "THE", "漢字", "x1y", "éÉ", *(f"t{chr(97 + k)}" for k in range(24))]
    rows = [(k, " ".join(r.choices(pool, weights=range(1, len(pool) + 1), k=r.randint(0, 40))), r.choice(["en", "de", None]), r.choice(["s1", "s2", "S3", None, "z"]), "x", 1) for k in range(120)]
    rows += [(200, None, "fr", "a", None, None), (201, "", "fr", "b", None, None), (202, "only here", "fr", None, None, None), (203, "one", "it", "alone", "", 0), (1, rows[1][1], rows[1][2], rows[1][3], "x", 1), (None, "the " * 5000, "en", "s1", "x", 1)]
    table = stored(spark.createDataFrame(rows, AUDIT).repartition(3), "test-audit")
    for most in (200, 3):
        assert sorted(map(tuple, divergence(table, most_terms=most, block=block).collect())) == audited(rows, most)
    assert divergence(table.limit(0)).count() == 0


def test_counts_over_63_bits_of_billionths_are_exact(spark):
    table = spark.createDataFrame([(3 * 10**15, 10**16, 12345)], "c long, n long, v long")
    assert table.select(audit._share("c", "n", "v")).first()[0] == 1 + 10**9 * (3 * 10**15 + 1) // (10**16 + 12345)
    assert repacking.MOST_POOLED < 2**24  # a bin's number has 24 bits
