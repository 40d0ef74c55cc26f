"""Repeated passages against a plain count of all windows."""

import re
from collections import Counter

import numpy as np
import pytest

from waybill.llm import substring


def brute(texts, window):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g), spans(gone)))
    return out


def spans(gone):
    edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(int)))
    return [(int(a), int(b) - 1) for a, b in zip(edge[0::2], edge[1::2])]


def rows_of(df):
    return [
        (r["id"], r["n_words"], r["n_removed"], r["kept"], [tuple(x) for x in r["removed"]]) for r in df.collect()
    ]


def by_id(r):
    return (r[0] is None, r[0] or 0, r[1:3])


def check(spark, texts, window, **sizes):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sorted(rows_of(substring.remove_repeats(df, window=window, **sizes)), key=by_id)
    assert got == [(i, *row) for i, row in enumerate(brute(texts, window))]


@pytest.mark.parametrize("window, first", [(1, 10), (2, 1), (7, 2), (35, 10), (35, 35)])
def test_lengths_at_most_double(window, first):
    steps = substring.lengths(window, first)
    assert steps[-1] == window and steps[0] <= max(first, 1)
    assert all(a < b <= 2 * a for a, b in zip(steps, steps[1:]))


@pytest.mark.parametrize("window", [1, 3, 7])
def test_few_words_many_repeats(spark, window):
    rng = np.random.default_rng(window)
    texts = [" ".join(rng.choice(list("abcd"), int(n))) for n in rng.integers(0, 40, 120)]
    check(spark, texts, window, first=2, slice_bytes=200, bucket_bytes=900, part_size=50)


def test_planted_passages(spark):
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 5000, n)]
    passage, long_one = word(35), word(60)
    texts = [" ".join(word(80)) for _ in range(40)]
    texts += [" ".join(word(9) + passage + word(5)) for _ in range(3)]  # exactly one window
    texts += [" ".join(word(9) + passage[:34] + word(5)) for _ in range(3)]  # one word short
    texts += ["\n\t".join(word(3) + long_one + word(2) + long_one)]  # twice in one document, other blanks
    texts += [" ".join(long_one).replace("w", "W", 1)]  # another first word
    texts += [" ".join(["same"] * 36), " ".join(["lone"] * 35)]  # overlaps itself; has one window only
    texts += [texts[0]] * 50  # a large group of copies
    check(spark, texts, 35, slice_bytes=3000, bucket_bytes=9000, part_size=400)
    check(spark, texts, 35)


def test_collisions_of_short_keys_only_keep_more():
    # as if all keys of the inner levels collided
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(list("abcdef"), int(n))) for n in rng.integers(0, 60, 60)]
    data, ends = substring.words.joined([t.encode() for t in texts])
    s = substring.Slice(data.tobytes(), ends)
    alive = substring._survivors(s, [], [2, 4, 7], 1)
    loose = substring._survivors(s, [{0: b"\xff" * 10_000}, {0: b"\xff" * 10_000}], [2, 4, 7], 1)
    assert alive.sum() > loose.sum() and (loose == s.fitting(7)).all()


def test_edges(edge_docs, edge_texts, no_docs):
    texts = [t[1] for t in edge_texts]
    for window in (1, 5, 35):
        want = [(t[0], *row) for t, row in zip(edge_texts, brute(texts, window))]
        assert sorted(rows_of(substring.remove_repeats(edge_docs, window=window, slice_bytes=1000)), key=by_id) == sorted(want, key=by_id)
    assert substring.remove_repeats(no_docs).count() == 0
    with pytest.raises(ValueError):
        substring.remove_repeats(no_docs, window=0)


def test_text_is_not_moved_between_levels(spark, docs):
    for bucket in (20_000, 50_000, 10**9):
        plan = substring.remove_repeats(docs, slice_bytes=5000, bucket_bytes=bucket)._jdf.queryExecution().executedPlan().toString()
        side = plan.split("ShuffledHashJoin")[-1]
        assert "Bucketed: true" in plan and side.index("FileScan") < side.index("Exchange")
