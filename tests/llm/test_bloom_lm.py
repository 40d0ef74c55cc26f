"""The language model against exact counts."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from waybill.llm import bloom_lm
from waybill.llm.queries import QUERIES


def exact(texts, train):
    """(tokens, known, base, model) per text, with exact counts."""
    tokens = [(t or "").encode().lower().split() + [b" end"] for t in texts]
    c, pairs = Counter(), Counter()
    for words, learn in zip(tokens, train):
        if learn:
            c.update(words)
            pairs.update(zip([b" start", *words[:-1]], words))
    n, v, after = sum(c.values()), len(c), Counter(h for h, _ in pairs)
    before = Counter(c) | Counter({b" start": c[b" end"]})
    n1, n2 = (sum(x == k for x in pairs.values()) for k in (1, 2))
    d = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    out = []
    for words in tokens:
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words)
        model = 0.0
        for h, w in zip([b" start", *words[:-1]], words):
            p = (c[w] + 1) / (n + v + 1)
            model += math.log10((max(pairs[h, w] - d, 0) + d * after[h] * p) / before[h] if after[h] else p)
        out.append((len(words), sum(c[w] > 0 for w in words), base, model))
    return out, n


def test_query(spark, small_dir, rows):
    got = QUERIES["op3_bloom_lm"](spark, small_dir).toPandas().set_index("doc_id")
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in rows.doc_id]
    want, n = exact(rows.text, [not h for h in held])
    gap = []
    for i, h, (tokens, known, base, model) in zip(rows.doc_id, held, want):
        r = got.loc[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (h, tokens, known, n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        gap.append(abs(r.score - model) / tokens)
    assert np.mean(gap) < 0.06  # what quantised counts and false positives cost
    out = got[got.held_out]
    assert out.score.sum() > out.base_score.sum()


def test_segments_give_the_same(spark, docs):
    learn = F.col("doc_id") % 3 != 0
    one = bloom_lm.score_documents(docs, learn, part_bytes=50_000).toPandas().sort_values("id")
    many = bloom_lm.score_documents(
        docs, learn, part_bytes=50_000, segment_bytes=20_000, head_rows=50
    ).toPandas().sort_values("id")
    assert np.array_equal(one.score.to_numpy(), many.score.to_numpy())
    assert np.allclose(one.base_score, many.base_score, rtol=1e-12) and (one.n_known.to_numpy() == many.n_known.to_numpy()).all()


def test_segments_hold_every_part_once(spark, monkeypatch):
    rows = [(kind, part, bytes(1 + (part * 7 + kind) % 90)) for kind in (0, 1) for part in range(50)]
    parts = spark.createDataFrame(rows, "kind int, part int, bits binary")
    for block in (1 << 16, 16):
        monkeypatch.setattr(bloom_lm, "BLOCK_PARTS", block)
        segments = list(bloom_lm._segments(parts, 300))
        assert sorted(p for s in segments for p in s) == [(k, p) for k, p, _ in rows]
        for s in segments:
            ends = sorted((start, start + n) for start, n in s.values())
            assert ends[0][0] == 0 and ends[-1][1] <= 300
            assert all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
        assert len(segments) < 30
    assert list(bloom_lm._segments(parts.filter("false"), 300)) == [{}]


def test_filter_levels():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**64, 20_000, dtype=np.uint64)
    levels = rng.integers(1, 9, 20_000).astype(np.uint8)
    bits = bloom_lm.part_bits(keys, levels)
    f = bloom_lm.Filter(1, 0, {(0, 0): (0, len(bits))}, bytearray(bits))
    got = f.levels(keys, np.zeros(20_000, np.int32))
    assert (got >= levels).all() and (got == levels).mean() > 0.95
    other = f.levels(rng.integers(0, 2**64, 20_000, dtype=np.uint64), np.zeros(20_000, np.int32))
    assert (other > 0).mean() < 0.03
    assert bloom_lm.levels_of(np.array([0, 1, 2, 3, 4, 5, 6, 8, 9, 12, 13])).tolist() == [0, 1, 2, 2, 3, 3, 3, 4, 4, 4, 4]
    assert bloom_lm.levels_of(np.array([10**15])).max() < bloom_lm.FINE_LEVEL


def test_word_codes():
    small = np.arange(129)
    for up in (False, True):
        assert (bloom_lm.values_of(bloom_lm.codes_of(small, up)) == small).all()
    large = np.r_[np.arange(129, 5000), 2**40 - 1, 2**40, 2**53 + 1, 10**15]
    low, high = (bloom_lm.values_of(bloom_lm.codes_of(large, up)) for up in (False, True))
    assert (low <= large).all() and (high >= large).all() and (high <= low * 65 / 64).all()
    rng = np.random.default_rng(2)
    words = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    c = (10 ** rng.uniform(0, 9, 5000)).astype(np.int64)
    codes = [
        bloom_lm.codes_of(c), bloom_lm.codes_of(np.maximum(c // rng.integers(1, 50, 5000), 1)),
        bloom_lm.codes_of((c * rng.uniform(0.8, 1.3, 5000)).astype(int) + 1, up=True),
    ]
    bits = bloom_lm.word_bits(words, *codes)
    f = bloom_lm.Filter(1, 0, {(0, 0): (0, len(bits))}, bytearray(bits))
    got = f.codes(words, np.zeros(5000, np.int32))
    assert (got == np.stack(codes)).mean() > 0.9
    assert (f.codes(~words, np.zeros(5000, np.int32)) > 0).mean() < 0.03


def test_masses_behind_every_word(rows):
    """The numbers of all histories of a table, as the filter keeps them, add up to nearly 1."""
    pairs = Counter()
    for text in rows.text:
        words = [b"", *(text or "").encode().lower().split(), b"end"]
        pairs.update(zip(words, words[1:]))
    n = np.array(list(pairs.values()))
    before, of = np.unique([h for h, _ in pairs], return_inverse=True)
    after, to = np.unique([w for _, w in pairs], return_inverse=True)
    d = (n == 1).sum() / ((n == 1).sum() + 2 * (n == 2).sum())
    kept = bloom_lm.counts_of()[bloom_lm.levels_of(n)]
    s, t, c = np.bincount(of, kept).astype(int), np.bincount(of), np.bincount(to, n).astype(int)
    s, t, c = bloom_lm.codes_of(s, up=True), bloom_lm.codes_of(t), bloom_lm.codes_of(c)
    s, t, c = bloom_lm.values_of(s), bloom_lm.values_of(t), bloom_lm.values_of(c)
    places = c.sum() + len(after) + 1
    seen = np.bincount(of, bloom_lm.probabilities(kept, s[of], t[of], c[to], places, d))
    backed = np.bincount(of, bloom_lm.probabilities(0 * kept, s[of], t[of], c[to], places, d))
    single = d * t / np.maximum(s, t)  # all words, and one place for the unknown
    mass = seen - backed + single
    assert mass.max() <= 1 + 1e-9 and mass.min() > 0.95 and mass.mean() > 0.98


def test_texts_have_probabilities(spark, monkeypatch):
    """Of all texts of up to six words, known or not, the probabilities add up to about 1.

    The filter is wide, as a single pair too many shows with so few of them.
    """
    monkeypatch.setattr(bloom_lm, "BITS_PER_ENTRY", 100)
    monkeypatch.setattr(bloom_lm, "WORD_BITS_PER_ENTRY", 100)
    train = ["a b", "a", "b a a", "", "c a b", "a c", "b"] * 3
    texts = [" ".join(t) for n in range(7) for t in itertools.product("abcx", repeat=n)]
    docs = spark.createDataFrame(list(enumerate(train + texts)), "doc_id bigint, text string")
    got = bloom_lm.score_documents(docs, F.col("doc_id") < len(train)).toPandas().set_index("id").score.sort_index()
    total = (10 ** got.loc[len(train) :]).sum()
    assert 0.9 < total < 1.001


def test_edges(spark, edge_docs, no_docs, edge_texts):
    got = bloom_lm.score_documents(edge_docs, F.lit(True)).toPandas()
    assert len(got) == len(edge_texts) and got.n_tokens.min() == 1 and got.score.notna().all()
    want, n = exact([t[1] for t in edge_texts], [True] * len(edge_texts))
    assert sorted(got.n_tokens) == sorted(t for t, *_ in want) and set(got.train_tokens) == {n}
    assert sorted(got.base_score.round(6)) == sorted(round(b, 6) for _, _, b, _ in want)
    none = bloom_lm.score_documents(edge_docs, F.lit(False)).toPandas()
    assert (none.score == 0).all() and (none.base_score == 0).all() and (none.n_known == 0).all()
    assert bloom_lm.score_documents(no_docs, F.lit(True)).count() == 0


def test_a_hot_word_is_spread_over_all_parts(spark, monkeypatch):
    texts = [" ".join(f"hot w{i}x{j}" for j in range(100)) for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    sizes, segments = {}, bloom_lm._segments

    def spied(parts, most):
        sizes.update({r["part"]: len(r["bits"]) for r in parts.filter(F.col("kind") == bloom_lm.PAIRS).collect()})
        return segments(parts, most)

    monkeypatch.setattr(bloom_lm, "_segments", spied)
    got = bloom_lm.score_documents(docs, F.lit(True), part_bytes=2_000).toPandas().sort_values("id")
    assert len(sizes) > 80 and max(sizes.values()) < sum(sizes.values()) / 50
    want, _ = exact(texts, [True] * len(texts))
    assert np.mean(np.abs(got.score.to_numpy() - [w[3] for w in want]) / got.n_tokens) < 0.1
