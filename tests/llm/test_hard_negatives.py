"""Hard negatives against scores of all rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from waybill.llm import hard_negatives
from waybill.llm.hard_negatives import Anchors, Tree, Vectors, walk

SCHEMA = "vec_id long, embedding array<double>, label int, score double, row long"


def brute(rows, is_anchor, positives=5, negatives=3, low=50, high=95):
    usable = [
        (i, [math.floor(256 * x) for x in v], y) for i, v, y in rows
        if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for a, va, ya in usable:
        if not is_anchor(a):
            continue
        met = [(-sum(x * y for x, y in zip(va, v)), i, y) for i, v, y in usable if len(v) == len(va)]
        first = sorted((s, i) for s, i, y in met if y == ya and i != a)[:positives]
        for ps, p in first:
            fit = sorted((s, i) for s, i, y in met if y != ya and low * -ps <= 100 * -s <= high * -ps)[:negatives]
            out += [(a, p, k + 1, i, -ps, -s) for k, (s, i) in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, anchors="id % 5 = 0", **sizes):
    df = spark.createDataFrame([(*r, 0.5, 7) for r in rows], SCHEMA).repartition(4)
    got = hard_negatives.mine(df, F.expr(anchors), **sizes)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert got.columns == names
    return sorted(tuple(r) for r in got.collect())


def clusters(n, dim, spread, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((8, dim))
    points = centres[rng.integers(0, 8, n)] + spread * rng.standard_normal((n, dim))
    return [(i, points[i].tolist(), int(rng.integers(0, 3))) for i in range(n)]


@pytest.mark.parametrize("spread, sizes", [
    (0.05, {}), (0.05, {"wave": 9, "block": 37}), (1.0, {"block": 16, "tasks": 3}), (0.0, {"block": 50}),
])
def test_all_rows(spark, spread, sizes):
    rows = clusters(300, 6, spread, 4)
    assert mined(spark, rows, **sizes) == brute(rows, lambda i: i % 5 == 0)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = clusters(60, 3, 0.3, 1) + [
        (100, None, 1), (105, [1.0, None, 2.0], 1), (110, [nan, 1.0, 1.0], 1), (115, [inf, 1.0, 1.0], 1), (None, [1.0, 1.0, 1.0], 1),
        (120, [1.0, 2.0, 3.0], None), (125, [0.0, 0.0, 0.0], 1), (130, [], 1), (131, [], 1), (132, [], 2), (135, [1.0, 1.0], 9),
        (140, [1.0, 2.0, 3.0, 4.0], 1), (141, [1.0, 2.0, 3.0, 4.0], 1), (142, [0.7, 1.0, 1.5, 2.0], 2),
        (145, [-1.0, -1.0, -1.0], 2), (150, [1e6, 1e6, -1e6], 1), (151, [9e5, 1e6, -1e6], 1), (152, [6e5, 8e5, -7e5], 2),
    ]
    rows += [(200, [0.5, 0.5, 0.5], 1)] * 2 + [(201, [0.5, 0.5, 0.5], 1)] * 3 + [(202, [0.3, 0.4, 0.4], 2)] * 2  # repeated rows
    assert mined(spark, rows, block=13) == brute(rows, lambda i: i % 5 == 0)
    assert mined(spark, rows, "false") == []
    assert mined(spark, []) == []


def test_scores_beyond_exact_doubles():
    a = np.array([[1 << 30, (1 << 30) + 1, 3]])
    some = Vectors(np.array([[(1 << 30) + 1, 1 << 30, 1], [5, 1, 1]]))
    got = some.scores(np.arange(2), Anchors(np.zeros(1), np.zeros(1), ["x"], a), 0)
    assert got.tolist() == [2 * (1 << 30) * ((1 << 30) + 1) + 3, 5 * (1 << 30) + (1 << 30) + 1 + 3]


def test_tree_is_least():
    points = np.random.default_rng(2).integers(-50, 50, (40, 3)).astype(float)
    tree = Tree(points)
    assert sorted(tree.order.tolist()) == list(range(40))
    place = {n: i for i, n in enumerate(tree.order.tolist())}
    for n in range(1, 40):
        assert place[int(tree.parent[n])] < place[n]
        assert np.isclose(tree.edge[n], np.linalg.norm(points[n] - points[tree.parent[n]]))
    edges = sorted((np.linalg.norm(points[i] - points[j]), i, j) for i in range(40) for j in range(i))
    root, total = list(range(40)), 0.0
    for d, i, j in edges:  # Kruskal
        if root[i] != root[j]:
            total += d
            old = root[i]
            root = [root[j] if r == old else r for r in root]
    assert np.isclose(tree.edge.sum(), total)


def test_bounds_hold_and_spare_work():
    rows = clusters(2000, 16, 0.02, 9)
    whole = np.array([[math.floor(256 * x) for x in v] for _, v, _ in rows])
    anchors, some = Anchors(np.arange(60), np.arange(60), ["x"] * 60, whole[:60]), Vectors(whole)
    exact = whole @ whole[:60].T

    def wanted(node, low, high, root):
        assert (low <= exact[:, node]).all() and (exact[:, node] <= high).all()
        fifth = np.sort(exact[:, node])[-5]
        at = np.arange(2000) if root else np.flatnonzero(high >= fifth)

        def take(at, scores):
            assert (scores == exact[at, node]).all() and (scores >= fifth).sum() >= 5

        return at, take

    assert walk(anchors, some, wanted) < 0.4 * exact.size
