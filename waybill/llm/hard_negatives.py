"""Hard negatives of anchors, with bounds along a spanning tree of the anchors.

Scores are inner products of whole-number vectors. For a candidate x and two anchors a, b, the scores differ by at most
|a - b| * |x|. So the anchors of a wave are joined by a spanning tree of least total edge length; a candidate block is
scored in full at the root, and at every other anchor the score, or the bounds, at the parent, plus or minus edge length times
candidate norm, bound the score. Only candidates whose bounds overlap the wanted window are scored; the others carry
their bounds down the tree.

A wave takes two passes of the candidates. The first finds each anchor's positives: the window begins at the worst of the best
found so far. The second finds negatives: each positive's score gives a window of negative scores, which narrows as
better negatives are found. A task goes through its candidates block by block and hands on the best of each
anchor only, so what is shuffled is anchors times tasks, however many the candidates.

Every anchor meets every candidate, through bounds or in full: anchors are broadcast in waves of a fixed number.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waybill.llm.common import stored

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # hundredths of a positive's score between which a negative's score lies
WAVE = 2048  # anchors that are broadcast at a time
BLOCK = 4096  # candidates that go down the tree at once
EXACT = 1 << 53  # a product of norms below this keeps sums in doubles exact
SLACK = 1e-9  # relative, for rounding in bounds
POSITIVE = "anchor long, id long, score long"
NEGATIVE = "anchor long, positive int, id long, score long"


def usable(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, label: Column | None = None) -> DataFrame:
    """``id``, ``label`` and ``vec`` of the rows with all three, all components finite."""
    finite = F.forall("vec", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    named = vectors.select(
        F.col(id_col).cast("long").alias("id"), (F.col(label_col) if label is None else label).cast("string").alias("label"),
        F.col(vec_col).cast("array<double>").alias("vec"),
    )
    return named.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & finite)


def whole(vec: str = "vec", scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, as a long."""
    return F.transform(vec, lambda x: F.floor(x * scale))


# ---- the tree

class Tree:
    """A spanning tree of least total length over some vectors, in an order with parents ahead of children."""

    def __init__(self, vectors: np.ndarray):
        n = len(vectors)
        self.order = np.zeros(n, np.int64)
        self.parent = np.full(n, -1, np.int64)
        self.edge = np.zeros(n)
        best, via = np.full(n, np.inf), np.full(n, -1)
        outside = np.ones(n, bool)
        node = 0
        grown = []
        for _ in range(n):
            outside[node] = False
            grown.append(node)
            d = vectors - vectors[node]
            far = np.sqrt(np.einsum("ij,ij->i", d, d))
            nearer = outside & (far < best)
            best[nearer], via[nearer] = far[nearer], node
            rest = np.flatnonzero(outside)
            if len(rest):
                node = int(rest[np.argmin(best[rest])])
                self.parent[node], self.edge[node] = via[node], best[node]
        # depth first, so that few nodes wait for children
        children: dict[int, list[int]] = {}
        for node in grown[1:]:
            children.setdefault(int(self.parent[node]), []).append(node)
        self.n_children = np.array([len(children.get(i, ())) for i in range(n)], np.int64)
        stack, order = [0] if n else [], []
        while stack:
            node = stack.pop()
            order.append(node)
            stack += children.get(node, [])
        self.order = np.array(order, np.int64)


class Vectors:
    """Whole-number vectors of one length, also as doubles, with their norms."""

    def __init__(self, whole: np.ndarray):
        self.whole, self.rows = whole, whole.astype(np.float64)
        self.norms = np.sqrt((self.rows * self.rows).sum(axis=1))

    def scores(self, at: np.ndarray, other: Vectors, node: int) -> np.ndarray:
        """Exact inner products of some rows with a row of other vectors, as 64-bit numbers."""
        if not len(at) or other.norms[node] * self.norms[at].max() < EXACT / 2:
            return (self.rows[at] @ other.rows[node]).astype(np.int64)
        mine = other.whole[node].tolist()
        return np.array([sum(x * y for x, y in zip(row, mine)) for row in self.whole[at].tolist()], np.int64)


class Anchors(Vectors):
    """The anchors of one wave and length of vector: numbers, labels as codes, vectors, tree."""

    def __init__(self, numbers: np.ndarray, ids: np.ndarray, labels: list[str], whole: np.ndarray):
        super().__init__(whole)
        self.numbers, self.ids = numbers, ids
        self.codes = {label: i for i, label in enumerate(sorted(set(labels)))}
        self.labels = np.array([self.codes[label] for label in labels], np.int64)
        self.tree = Tree(self.rows)


def walk(anchors: Anchors, some: Vectors, wanted) -> int:
    """Go down the tree with a block of candidates; gives the number of scores computed.

    ``wanted(node, low, high, root)`` names the candidates (places) to score, given bounds of all scores, and a
    function that takes places and scores.
    """
    norms = some.norms
    tree, waiting, n_scored = anchors.tree, {}, 0
    for node in tree.order.tolist():
        parent = int(tree.parent[node])
        if parent < 0:
            limit = norms * anchors.norms[node] * (1 + SLACK) + 1
            low, high = -limit, limit
        else:
            centre, radius, left = waiting[parent]
            if left == 1:
                del waiting[parent]
            else:
                waiting[parent] = centre, radius, left - 1
            reach = radius + tree.edge[node] * norms
            reach += np.abs(centre) * SLACK + reach * SLACK
            low, high = centre - reach, centre + reach
        at, take = wanted(node, low, high, parent < 0)
        scores = some.scores(at, anchors, node)
        n_scored += len(at)
        take(at, scores)
        if tree.n_children[node]:
            centre, radius = (low + high) / 2, (high - low) / 2
            centre[at], radius[at] = scores, 0.0
            waiting[node] = centre, radius, int(tree.n_children[node])
    return n_scored


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= least)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))][:k]


class Held:
    """The best few (score, id) of each of many lists."""

    def __init__(self, n: int, k: int):
        self.k, self.n = k, np.zeros(n, np.int64)
        self.score, self.id = np.zeros((n, k), np.int64), np.zeros((n, k), np.int64)

    def least(self, i: int) -> float:
        """What a score must reach to get into list i."""
        return float(self.score[i, self.k - 1]) if self.n[i] == self.k else -np.inf

    def offer(self, i: int, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(score):
            return
        n = self.n[i]
        score, ids = np.r_[self.score[i, :n], score], np.r_[self.id[i, :n], ids]
        at = best(score, ids, self.k)
        self.n[i] = len(at)
        self.score[i, : len(at)], self.id[i, : len(at)] = score[at], ids[at]


def blocks_of(batches: Iterator[pa.RecordBatch], size: int):
    """Candidates as blocks of one vector length: length, ids, labels, vectors."""
    held: dict[int, list] = {}

    def block(dim, parts):
        ids, labels, rows = (np.concatenate(p) for p in zip(*parts))
        return dim, ids, labels, Vectors(rows)

    for batch in batches:
        dims = np.array(batch.column("vec").value_lengths(), np.int64)
        for dim in np.unique(dims).tolist():
            mine = batch.filter(pa.array(dims == dim))
            rows = mine.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(mine.num_rows, dim)
            labels = np.array(mine.column("label").to_pylist(), object)
            held.setdefault(dim, []).append((mine.column("id").to_numpy(), labels, rows))
            if sum(len(p[0]) for p in held[dim]) >= size:
                yield block(dim, held.pop(dim))
    for dim, parts in held.items():
        yield block(dim, parts)


def _positive_batches(batches: Iterator[pa.RecordBatch], wave, k: int, size: int):
    """Each anchor's best rows of its own label, of a task's candidates."""
    found = {dim: Held(len(a.numbers), k) for dim, a in wave.value.items()}
    for dim, ids, labels, some in blocks_of(batches, size):
        if dim not in found:
            continue
        anchors, mine = wave.value[dim], found[dim]
        codes = np.array([anchors.codes.get(label, -1) for label in labels], np.int64)

        def wanted(node, low, high, root):
            alike = (codes == anchors.labels[node]) & (ids != anchors.ids[node])
            at = np.arange(len(ids)) if root else np.flatnonzero(alike & (high >= mine.least(node)))

            def take(at, scores):
                good = alike[at]
                mine.offer(node, scores[good], ids[at][good])

            return at, take

        walk(anchors, some, wanted)
    for dim, held in found.items():
        for a in range(held.k):
            some = np.flatnonzero(held.n > a)
            yield pa.RecordBatch.from_arrays(
                [pa.array(wave.value[dim].numbers[some]), pa.array(held.id[some, a]), pa.array(held.score[some, a])],
                names=["anchor", "id", "score"],
            )


def _negative_batches(batches: Iterator[pa.RecordBatch], wave, windows, k: int, size: int):
    """The best rows of another label in the window of each anchor's positives, of a task's candidates."""
    found = {dim: Held(windows.value[dim][0].size, k) for dim in wave.value}
    for dim, ids, labels, some in blocks_of(batches, size):
        if dim not in found:
            continue
        anchors, mine, (lows, highs) = wave.value[dim], found[dim], windows.value[dim]
        codes = np.array([anchors.codes.get(label, -1) for label in labels], np.int64)
        each = lows.shape[1]

        def wanted(node, low, high, root):
            unlike = codes != anchors.labels[node]
            if root:
                at = np.arange(len(ids))
            else:
                floor = [max(lo, mine.least(node * each + i)) for i, lo in enumerate(lows[node].tolist())]
                open_ = [i for i, (lo, hi) in enumerate(zip(floor, highs[node].tolist())) if lo <= hi]
                if open_:
                    at = np.flatnonzero(unlike & (high >= min(floor[i] for i in open_)) & (low <= highs[node, open_].max()))
                else:
                    at = np.zeros(0, np.int64)

            def take(at, scores):
                good = unlike[at]
                scores, names = scores[good], ids[at][good]
                for i, (lo, hi) in enumerate(zip(lows[node].tolist(), highs[node].tolist())):
                    if lo <= hi:
                        fit = (scores >= max(lo, mine.least(node * each + i))) & (scores <= hi)
                        mine.offer(node * each + i, scores[fit], names[fit])

            return at, take

        walk(anchors, some, wanted)
    for dim, held in found.items():
        each = windows.value[dim][0].shape[1]
        for a in range(held.k):
            some = np.flatnonzero(held.n > a)
            yield pa.RecordBatch.from_arrays([
                pa.array(wave.value[dim].numbers[some // each]), pa.array((some % each + 1).astype(np.int32)),
                pa.array(held.id[some, a]), pa.array(held.score[some, a]),
            ], names=["anchor", "positive", "id", "score"])


def window_of(positive: np.ndarray, low: int = LOW, high: int = HIGH) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest whole score s with low * positive <= 100 * s <= high * positive."""
    return -((-low * positive) // 100), high * positive // 100


def _ranked(found: DataFrame, keys: list[str], k: int, name: str) -> DataFrame:
    """The k best of each list of all tasks, numbered from 1."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("id"))
    return found.withColumn(name, F.row_number().over(order)).filter(F.col(name) <= k)


def mine(
    vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    scale: int = SCALE, wave: int = WAVE, block: int = BLOCK, tasks: int | None = None,
) -> DataFrame:
    """For each anchor and each of its positives, negatives whose score lies in a share of the positive's.

    ``anchors`` says which rows are anchors, over the columns ``id``, ``label`` and ``vec``; ``label`` may
    replace the label column. Components become floor(scale * x); a score is the inner product, higher ones come first, ties by
    smaller id. An anchor's positives are its best ``positives`` other rows of its label (all, if fewer); of
    the rows of other labels with low * positive <= 100 * score <= high * positive the best ``negatives`` are given:
    ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    Rows without id, label or vector, or with a component that is null or not finite, take no part. Vectors of different
    lengths never meet; empty ones score 0. Rows that are repeated each count; rows with an anchor's id are not
    among its positives; an anchor that is repeated gives its rows each time. Scores must fit a long. An empty table, or one without
    anchors, gives an empty result. Other columns are not read.
    """
    spark = vectors.sparkSession
    named = usable(vectors, id_col, vec_col, label_col, label).withColumn("vec", whole("vec", scale))
    # numbered as they are written, so that rows of one id stay apart
    tasks = tasks or 2 * spark.sparkContext.defaultParallelism  # files, however many the candidates
    numbered = stored(named.repartition(tasks).withColumn("row", F.monotonically_increasing_id()), "vectors")
    heads = numbered.filter(anchors)
    n_waves = -(-heads.count() // wave)
    candidates = numbered.select("id", "label", "vec")
    out = None
    for w in range(n_waves):
        mine_ = heads.filter(F.pmod(F.xxhash64("row"), F.lit(n_waves)) == w).orderBy("row").toArrow()  # about ``wave`` rows
        groups = _groups(mine_)
        sent = spark.sparkContext.broadcast(groups)
        found = candidates.mapInArrow(partial(_positive_batches, wave=sent, k=positives, size=block), POSITIVE)
        first = stored(_ranked(found, ["anchor"], positives, "positive"), "positives")
        limits = spark.sparkContext.broadcast(_windows(groups, first.toArrow(), positives, low, high))
        against = candidates.mapInArrow(
            partial(_negative_batches, wave=sent, windows=limits, k=negatives, size=block), NEGATIVE
        )
        last = _ranked(against, ["anchor", "positive"], negatives, "rank")
        named_heads = spark.createDataFrame(pa.table({"anchor": mine_.column("row"), "anchor_id": mine_.column("id")}))
        wave_rows = stored(
            last.withColumnsRenamed({"id": "negative_id", "score": "negative_score"})
            .join(first.withColumnsRenamed({"id": "positive_id", "score": "positive_score"}), ["anchor", "positive"])
            .join(named_heads, "anchor")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"),
            "negatives",
        )
        out = wave_rows if out is None else out.unionByName(wave_rows)
        sent.unpersist()
        limits.unpersist()
    if out is None:
        kinds = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return spark.createDataFrame([], kinds)
    return out


def _groups(rows: pa.Table) -> dict[int, Anchors]:
    """The anchors of a wave by length of vector."""
    by_dim: dict[int, list[dict]] = {}
    for r in rows.to_pylist():
        by_dim.setdefault(len(r["vec"]), []).append(r)
    return {
        dim: Anchors(
            np.array([r["row"] for r in some], np.int64), np.array([r["id"] for r in some], np.int64),
            [r["label"] for r in some], np.array([r["vec"] for r in some], np.int64).reshape(len(some), dim),
        )
        for dim, some in by_dim.items()
    }


def _windows(groups: dict[int, Anchors], positives: pa.Table, k: int, low: int, high: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Windows of negative scores, anchors times positives; an empty one where there is no positive."""
    score = {(r["anchor"], r["positive"]): r["score"] for r in positives.to_pylist()}
    out = {}
    for dim, anchors in groups.items():
        lows, highs = np.ones((len(anchors.numbers), k), np.int64), np.zeros((len(anchors.numbers), k), np.int64)
        for i, number in enumerate(anchors.numbers.tolist()):
            for j in range(k):
                if (number, j + 1) in score:
                    lows[i, j], highs[i, j] = (int(x) for x in window_of(score[number, j + 1], low, high))
        out[dim] = lows, highs
    return out
