"""The audit against plain arithmetic on Python numbers."""

import re
from collections import Counter, defaultdict

import numpy as np

from waybill.llm import divergence


def brute(rows, min_docs=3, top=200):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = [
            "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
            for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
        ]
        groups[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        mine = {s: c for (x, s), c in groups.items() if x == lang}

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: shares(c) for s, c in mine.items()}
        whole = shares(sum(mine.values(), Counter()))

        def excess(a, b):
            return (a - b) ** 2 // b

        for s in mine:
            pairs = [(sum(excess(p[s][t], p[o][t]) for t in kept), o) for o in mine if o != s]
            terms = [(excess(p[s][t], whole[t]), t) for t in kept if mine[s][t] > 0 and p[s][t] > whole[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(found[:most])]
    return sorted(out)


def rows_of(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def test_many_sources_in_blocks(spark):
    rng = np.random.default_rng(3)
    words = [f"t{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    rows = [
        (" ".join(rng.choice(words, int(rng.integers(0, 30)))), "xy"[i % 2], f"s{int(rng.integers(0, 12)) if i % 3 else 0}")
        for i in range(300)
    ]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(4)
    want = brute(rows, top=5)
    assert rows_of(divergence.audit(df, top=5)) == want
    for sizes in ({"groups": 1, "terms": 40}, {"groups": 5, "terms": 1}, {"held": 1}):
        assert rows_of(divergence.audit(df, top=5, **sizes)) == want


def test_share_is_exact():
    counts = [0, 1, 7, 10**6, 9 * 10**14]
    totals = [1, 3, 10**9 + 7, 9 * 10**14 + 5, 9 * 10**14 + 1]
    for c in counts:
        for t in totals:
            if c < t:
                got = divergence._share(np.array([c]), np.array([t]))
                assert got.tolist() == [1 + 10**9 * (c + 1) // t]


def test_share_and_excess_in_sql(spark):
    rows = [(0, 1), (9 * 10**14, 9 * 10**14 + 1), (5, 10**9 + 7), (10**17, 10**18)]
    df = spark.createDataFrame(rows, "c long, t long")
    got = df.select("c", "t", divergence._share_column("c", "t").alias("p")).withColumn("f", divergence._excess_column("p", "2L")).collect()
    for r in got:
        assert r["p"] == 1 + 10**9 * (r["c"] + 1) // r["t"] and r["f"] == (r["p"] - 2) ** 2 // 2


def test_edges(edge_docs, edge_texts, no_docs):
    rows = [t[1:] for t in edge_texts]
    for least in (1, 2, 3):
        assert rows_of(divergence.audit(edge_docs, min_docs=least, groups=1, terms=7)) == brute(rows, least)
    assert divergence.audit(no_docs).count() == 0


def test_languages_that_keep_nothing(spark):
    rows = [("a b", "x", "one"), ("c", "x", "two"), (None, "x", "three"), ("", "y", "one"), (None, None, None)]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    got = rows_of(divergence.audit(df))
    assert got == brute(rows) and len(got) == 6 and all(r[4] == 0 for r in got)
