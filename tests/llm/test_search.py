"""Collision counting against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from waybill.llm import collision_search
from waybill.llm.queries import QUERIES


def brute(ids, x, queries, k):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        s = unit @ unit[np.flatnonzero(ids == q)[0]]
        s[ids == q] = -9
        out[q] = [(int(ids[i]), s[i]) for i in np.lexsort((ids, -s))[:k] if s[i] > -9]
    return out


def test_query_recall(spark, small_dir):
    table = spark.read.parquet(f"{small_dir}/embeddings.parquet").toPandas()
    ids, x = table.vec_id.to_numpy(), np.array(table.embedding.tolist(), np.float64)
    want = brute(ids, x, [int(i) for i in ids if i % 50 == 0], 5)
    got = QUERIES["op2_collision_search"](spark, small_dir).toPandas()
    assert set(got.query_id) == set(want) and (got.groupby("query_id").size() == 5).all()
    hits = [len(set(g.vec_id) & {i for i, _ in want[q]}) for q, g in got.groupby("query_id")]
    assert np.mean(hits) / 5 >= 0.9


@pytest.mark.parametrize("shard_rows, wave", [(4096, 8192), (100, 7)])
def test_recall_over_shards_and_waves(spark, shard_rows, wave):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 24)) + 2 * rng.normal(size=(6, 24))[rng.integers(0, 6, 1500)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = collision_search.nearest(
        df, df.filter(F.col("vec_id") % 50 == 0), 5, shard_rows=shard_rows, wave=wave
    ).toPandas().sort_values(["query_id", "rank"])
    want = brute(np.arange(1500), x, range(0, 1500, 50), 5)
    hits = 0
    for q, g in got.groupby("query_id"):
        assert list(g["rank"]) == [1, 2, 3, 4, 5] and (np.diff(g.score) <= 0).all()
        hits += len(set(g.vec_id) & {i for i, _ in want[q]})
    assert hits >= 0.9 * 5 * 30


def _shard(ids, x, n=128):
    row = collision_search._index_row(x.shape[1], ids, x, n, 29).to_pylist()[0]
    return (
        ids, x, np.frombuffer(row["norms"]), np.frombuffer(row["values"], np.float32).reshape(n, -1),
        np.frombuffer(row["order"], np.uint16).reshape(n, -1),
    )


def test_widened_windows_count_each_collision_once():
    rng = np.random.default_rng(4)
    values = np.sort(rng.normal(size=(16, 300)), axis=1)
    order = np.argsort(rng.random((16, 300)), axis=1).astype(np.uint16)
    counts, low, high = np.zeros(300, int), np.full(16, 150), np.full(16, 150)
    for half in (0.1, 0.4, 1.0, 3.0):
        a, b = (np.array([np.searchsorted(v, x) for v in values]) for x in (-half, half))
        a, b = np.minimum(a, low), np.maximum(b, high)
        counts += collision_search._walked(order, [(a, low), (high, b)])
        low, high = a, b
        assert (counts == collision_search._walked(order, [(low, high)])).all()


@pytest.mark.parametrize("known", [False, True])
def test_few_vectors_are_verified(known):
    rng = np.random.default_rng(5)
    x = 0.5 * rng.normal(size=(8000, 64)) + rng.normal(size=(100, 64))[rng.integers(0, 100, 8000)]
    ids, at = np.arange(8000), np.arange(0, 8000, 50)
    want = brute(ids, x, at, 5)
    unit = x[at] / np.linalg.norm(x[at], axis=1, keepdims=True)
    bound = np.array([(2 - 2 * want[q][-1][1]) ** 0.5 * 1.05 if known else np.inf for q in at])
    best = collision_search._Best(at, 5)
    n = sum(
        collision_search.search_shard(x[at], unit, bound, _shard(ids[i : i + 4000], x[i : i + 4000]), best, 128, 29)
        for i in (0, 4000)
    )
    assert n < 0.1 * len(at) * len(ids)
    hits = sum(len({i for _, i in f} & {i for i, _ in want[q]}) for q, f in zip(at, best.found))
    assert hits >= 0.9 * 5 * len(at)


def test_bounds_hold_k_vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vec array<double>")
    sample = spark.sparkContext.broadcast(collision_search._sample(df, 400, 100, 29))
    ids, unit = sample.value[8]
    assert 40 < len(ids) < 200
    got = df.mapInArrow(
        lambda b: collision_search._bound_batches(b, sample, 5), "id long, vec array<double>, bound double"
    ).collect()
    for r in got:
        score = unit @ (x[r.id] / np.linalg.norm(x[r.id]))
        kth = np.sort(score[ids != r.id])[-10]
        assert r.bound == pytest.approx((2 - 2 * kth) ** 0.5, abs=1e-5) and r.bound > (2 - 2 * kth) ** 0.5


def test_edges(spark):
    rows = [
        (0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [3.0, 0.0]), (3, [0.0, 1.0]), (4, [-1.0, 0.0]), (5, [0.0, 0.0]), (6, None),
        (7, [1.0, None]), (8, [float("nan"), 1.0]), (9, [float("inf"), 1.0]), (None, [1.0, 0.0]), (10, [1.0, 1.0, 1.0]), (11, []),
        (2, [3.0, 0.0]), (12, [1e200, 1e200]),
    ]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id bigint, embedding array<double>, rank int, score double")
    got = collision_search.nearest(df, df, 3).collect()
    of = lambda q: [(r["vec_id"], round(r["score"], 9)) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q]
    assert of(0) == [(1, 1.0), (2, 1.0), (2, 1.0)]  # ties to the smaller id; a repeated row counts twice
    assert of(4) == [(3, 0.0), (12, -0.707106781), (0, -1.0)]
    assert {s for _, s in of(12)} == {0.707106781}
    assert {r["query_id"] for r in got} == {0, 1, 2, 3, 4, 12}
    few = collision_search.nearest(df.filter("vec_id < 2"), df.filter("vec_id = 0"), 5).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in few] == [(0, 1, 1)]
    assert collision_search.nearest(df.filter("false"), df.filter("false")).count() == 0
    assert collision_search.nearest(df, df.filter("false")).count() == 0
