"""Language ID and quality on held-out documents, and the parts they are made of."""

import math
import zlib

import numpy as np
import pytest

from waybill.llm import samples, string_kernel, subword, words
from waybill.llm.queries import QUERIES


@pytest.fixture(scope="module")
def mid_dir(sf_dir):
    return sf_dir


def test_language_query(spark, mid_dir):
    docs = spark.read.parquet(f"{mid_dir}/documents.parquet").toPandas().set_index("doc_id")
    got = QUERIES["op4_string_kernel"](spark, mid_dir).toPandas().set_index("doc_id")
    assert set(got.columns) == {"lang_pred", "score", "held_out"} and len(got) == len(docs)
    held = np.array([zlib.crc32(str(i).encode()) % 3 == 1 for i in got.index])
    assert (got.held_out == held).all() and got.score.between(0, 1).all()
    known = got.join(docs[docs.lang.notna()], how="inner")
    right = known.lang == known.lang_pred
    assert known.held_out.sum() > 200 and right[known.held_out].mean() > 0.97 and right.mean() > 0.97


def test_kernel_values_are_those_of_the_landmarks():
    texts = [b"the cat sat on the mat", b"le chat est sur le tapis", b"a dog and the cat", b"un chien et le chat"]
    model = string_kernel.fit(texts, ["en", "fr", "en", "fr"], landmarks=4, ridge=1e-6)
    x = string_kernel.presence(texts, model.columns)
    n = np.sqrt(x.sum(axis=1))
    kernel = (x @ x.T) / np.outer(n, n)
    assert np.allclose(np.diag(kernel), 1) and (np.linalg.eigvalsh(kernel) > -1e-6).all()
    values = model.values(texts)
    assert (values.argmax(axis=1) == [0, 1, 0, 1]).all() and values[0, 0] > 0.9
    room = np.zeros(3 * string_kernel.SPACE, bool)
    string_kernel.present(b"ab", room)
    assert room.sum() == 3


def _grams(text):
    """N-grams of code points as a set of strings."""
    t = "".join(c if "a" <= c <= "z" or ord(c) > 127 else " " for c in text.decode().lower())
    return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}


def test_kernel_nystroem_and_ridge_against_sets():
    rng = np.random.default_rng(1)
    alphabets = {"a": "abcde ", "b": "cdefg ", "c": "жзий е", "d": "東京都市"}
    labels = [name for name in alphabets for _ in range(9)]
    texts = ["".join(rng.choice(list(alphabets[x]), 30)).encode() for x in labels]
    texts[3] = texts[3].upper()
    model = string_kernel.fit(texts, labels, landmarks=8, ridge=0.05)
    marks = [i for r in range(2) for i in range(r, 36, 9)]  # labels in turns
    space = set().union(*(_grams(texts[i]) for i in marks))

    def kernel(x, y):
        a, b = _grams(x) & space, _grams(y) & space
        return len(a & b) / (max(len(a), 1) * max(len(b), 1)) ** 0.5

    k_mm = np.array([[kernel(texts[i], texts[j]) for j in marks] for i in marks])
    values, vectors = np.linalg.eigh(k_mm)
    kept = values > 1e-6 * values.max()
    root = vectors[:, kept] / np.sqrt(values[kept])
    probes = texts + ["abz жзи 京都".encode(), b"", b"123"]
    phi = np.array([[kernel(x, texts[j]) for j in marks] for x in probes]) @ root
    # ridge with an intercept that is not shrunk; all labels have equally many texts
    x = np.c_[phi[:36], np.ones(36)]
    penalty = 0.05 * 36 / 100 * np.eye(x.shape[1])
    penalty[-1, -1] = 0
    names = sorted(alphabets)
    y = np.where(np.array(labels)[:, None] == np.array(names), 1.0, -1.0)
    want = np.c_[phi, np.ones(len(probes))] @ np.linalg.solve(x.T @ x + penalty, x.T @ y)
    assert np.allclose(model.values(probes), want, atol=2e-3)


def test_every_language_has_a_landmark():
    names = [f"l{i:03d}" for i in range(200)]
    texts = [f"{chr(0x4E00 + 3 * i)}{chr(0x4E01 + 3 * i)} {chr(0x4E02 + 3 * i)}".encode() for i in range(200)]
    model = string_kernel.fit(texts, names, landmarks=160)
    assert [model.labels[i] for i in model.values(texts).argmax(axis=1)] == names


def test_long_texts_are_learned_from(spark):
    short = [(i, " ".join(f"the quick stone {i} of {j}" for j in range(20)), "en") for i in range(20)]
    long_ones = [(100 + i, " ".join(f"le renard brun {i} et {j}" for j in range(1500)), "fr") for i in range(20)]
    docs = spark.createDataFrame(short + long_ones, "doc_id long, text string, lang string")
    model = string_kernel.train(docs)
    got = string_kernel.predict(docs, model, ["lang"]).collect()
    assert model.labels == ("en", "fr") and all(r["lang"] == r["lang_pred"] for r in got)
    bad = " ".join(f"zz{j % 50} spam" for j in range(4000))
    good = " ".join(f"a plain sentence {j}" for j in range(150))
    docs = spark.createDataFrame([(i, bad if i % 2 else good) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(40)], "doc_id long, quality int")
    scores = subword.score(docs, subword.train(docs, labels), ["doc_id"]).collect()
    assert len(bad) > 35_000 and all((r["score"] > 0.7) == (r["doc_id"] % 2 == 0) and (r["score"] < 0.3) == (r["doc_id"] % 2 == 1) for r in scores)


def test_repeated_ids_keep_their_own_labels(spark):
    rows = [(i, "the cat and the dog of the house", "en") for i in range(5)] + [(i, "le chat et le chien de la maison", "fr") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = string_kernel.predict(docs, string_kernel.train(docs), ["lang"]).collect()
    assert len(got) == 10 and all(r["lang"] == r["lang_pred"] and r["score"] > 0.8 for r in got)


def test_sample_is_bounded_and_no_label_is_lost(spark):
    rows = [(i, "x" * (1 + i % 50), "big" if i >= 5 else f"rare{i}") for i in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    args = docs, "doc_id", subword.F.col("lang"), "text"
    got = samples.own_label_sample(*args, per_label=300, most=1000)
    n = got.column("label").to_pylist()
    assert 200 < n.count("big") < 400 and {f"rare{i}" for i in range(5)} < set(n)
    assert got.equals(samples.own_label_sample(docs.repartition(11), *args[1:], per_label=300, most=1000))
    short = samples.own_label_sample(*args, per_label=300, most=1000, most_bytes=600)
    assert 1 <= short.column("label").to_pylist().count("big") < 30 and len(set(short.column("label").to_pylist())) == 6
    assert samples.shares([("a", 10, 1), ("b", 10_000, 1)], 300, 200, 10**9) == {"a": 1.0, "b": 0.019}


def test_language_edges(spark, edge_docs, no_docs):
    model = string_kernel.train(edge_docs)
    got = string_kernel.predict(edge_docs, model, ["doc_id", "text"], names=("lang_pred", "s")).collect()
    assert len(got) == edge_docs.count()
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["s"] <= 1
    nothing = string_kernel.train(no_docs)
    assert nothing is None
    assert {r["lang_pred"] for r in string_kernel.predict(edge_docs, nothing, ["doc_id"]).collect()} == {"und"}
    assert string_kernel.predict(no_docs, model, no_docs.columns, names=("l", "s")).count() == 0


def test_quality_query(spark, mid_dir):
    labels = spark.read.parquet(f"{mid_dir}/labels.parquet").toPandas().set_index("doc_id")
    got = QUERIES["op7_subword"](spark, mid_dir).toPandas().set_index("doc_id")
    held = np.array([zlib.crc32(str(i).encode()) % 4 == 2 for i in got.index])
    assert (got.held_out == held).all() and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.7)).all()
    known = got.join(labels, how="inner")
    known = known[known.held_out]
    assert (known.predicted == known.quality).mean() > 0.95


def _slow_features(text):
    data, out = text + b" ", []
    for n in (3, 4):
        out += [data[i : i + n] for i in range(len(data) - n + 1)]
    split = text.split()
    return len(out) + len(split) + sum(a == b for a, b in zip(split, split[1:]))


def test_features():
    texts = [b"a b  b b\tc", b"", b"x", b"the the cat"]
    f = subword.Features.of(texts)
    n = sum(np.bincount(o, minlength=4) for o in f.owner)
    assert n.tolist() == [_slow_features(t) for t in texts]
    alone = [np.sort(np.concatenate(subword.Features.of([t]).buckets)) for t in texts]
    for i in range(4):
        mine = np.sort(np.concatenate([b[o == i] for b, o in zip(f.buckets, f.owner)]))
        assert np.array_equal(mine, alone[i])
    ones = np.ones(subword.BUCKETS)
    assert np.allclose(f.means(ones), n / (n + subword.NEUTRAL))


def test_training_and_score_against_plain_loops(monkeypatch):
    monkeypatch.setattr(subword, "BUCKETS", 300)
    monkeypatch.setattr(subword, "DIM", 3)
    of = subword.Features.of
    monkeypatch.setattr(subword.Features, "of", classmethod(lambda cls, texts: of(texts, 300)))
    texts = [b"good plain words", b"bad bad spam", b"", b"more good words here", b"spam spam and spam", b"x"]
    labels = [1, 0, 1, 1, 0, 0]
    shares = (2, 5)
    model = subword.fit(texts, labels, shares, epochs=3, rate=0.4, seed=5)
    rng = np.random.default_rng(5)
    vectors = rng.uniform(-1 / 3, 1 / 3, (300, 3)).tolist()
    layer, bias = [[0.0, 0.0] for _ in range(3)], [0.0, 0.0]
    features = [np.concatenate(of([t], 300).buckets).tolist() for t in texts]

    def average(ids):
        return [sum(vectors[b][d] for b in ids) / (len(ids) + subword.NEUTRAL) for d in range(3)]

    def softmax(v):
        e = [math.exp(sum(v[d] * layer[d][c] for d in range(3)) + bias[c]) for c in (0, 1)]
        return [x / sum(e) for x in e]

    step = 0
    for _ in range(3):
        for i in rng.permutation(6):
            ids, text = features[i], average(features[i])
            error = [p - (labels[i] == c) for c, p in enumerate(softmax(text))]
            now = 0.4 * (1 - step / 18) * shares[labels[i]] / 7 * 6 / labels.count(labels[i])
            part = {b: ids.count(b) / (len(ids) + subword.NEUTRAL) for b in ids}
            scale = min(1 / max(sum(x * x for x in part.values()), 1e-12), 1000.0) if part else 0
            old = [row[:] for row in layer]
            for b, x in part.items():
                for d in range(3):
                    vectors[b][d] -= x * now * scale * sum(old[d][c] * error[c] for c in (0, 1))
            for c in (0, 1):
                for d in range(3):
                    layer[d][c] -= now * text[d] * error[c]
                bias[c] -= now * 0.1 * error[c]
            step += 1
    odds, base = model.folded()
    z = of(texts, 300).means(odds) + base
    assert np.allclose(1 / (1 + np.exp(-z)), [softmax(average(f))[1] for f in features], atol=1e-9)


def test_word_hashes():
    texts = [b"one two", b"", b" two  one ", b"\xc3\xa9t\xc3\xa9 one", b"x" * 3_000_000 + b" two"]
    data, ends = words.joined(texts)
    start, end = words.spans(data)
    found = [data[a:b].tobytes() for a, b in zip(start, end)]
    assert found == [w for t in texts for w in t.split()]
    h = words.hashes(data, start, end)
    assert len(set(zip(found, h.tolist()))) == len(set(found)) == len(set(h.tolist()))


def test_quality_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, None), (None, 1), (8, 1), (99, 0)], "doc_id bigint, quality int")
    model = subword.train(edge_docs, labels)
    got = subword.score(edge_docs, model, ["doc_id"], name="s").collect()
    assert len(got) == edge_docs.count() and all(0 <= r["s"] <= 1 for r in got)
    assert subword.train(no_docs, labels) is None
    assert {r["s"] for r in subword.score(edge_docs, None, ["doc_id"], name="s").collect()} == {0.5}
    assert subword.score(no_docs, model, no_docs.columns, name="s").count() == 0
    one_class = subword.train(edge_docs, labels.filter("quality = 1"))
    assert subword.score(edge_docs, one_class, ["doc_id"]).count() == edge_docs.count()


def test_labels_of_other_documents_change_nothing(spark, edge_docs):
    known = [(1, 1), (3, 0), (7, 1), (8, 1)]
    given = edge_docs.filter("doc_id <> 8")
    models = [
        subword.train(given, spark.createDataFrame(known[:3] + more, "doc_id bigint, quality int"))
        for more in ([], known[3:], [(8, 0)] * 3 + [(99, 0)] * 20)
    ]
    for other in models[1:]:
        assert np.array_equal(models[0].vectors, other.vectors) and np.array_equal(models[0].bias, other.bias)
