"""Approximate nearest neighbours by collision counting.

Every vector is scaled to length one and projected on ``PROJECTIONS`` random directions. The index
holds, for each projection, the sorted array of its values, and the place of each vector in it; it is cut into
shards of at most ``SHARD_ROWS`` vectors. A query opens a window around its own value in every
sorted array. The windows' half width is a fixed multiple of a radius, and virtual rehashing
widens all of them by raising the radius: the collisions counted so far are kept, and only the two ends
by which a window grew are walked. A vector whose value lies in at least ``threshold`` of
the windows has collided often enough and is verified with the exact cosine.
The search of a shard ends when the k-th best distance found is within the radius; a vector at
the radius then has missed the threshold with a probability of about ``MISS``. If the radius has
reached every possible distance and less than k are found, all others of the shard are verified.

Each query carries a bound, the distance of its 2k-th best among ``BOUND_ROWS`` vectors of the index. No
shard's windows grow beyond it, and a shard gives nothing that is further away. Should less than k of these
vectors be found, the query is searched again without a bound.

Every query meets every shard; queries are broadcast in waves of a fixed number.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waybill.llm.common import stored

PROJECTIONS = 128
SHARD_ROWS = 4096
HALF_WIDTH = 1.645  # of a window, per radius: nine of ten projections collide at the radius
MISS = 0.1
FIRST_RADIUS, GROWTH = 0.5, 1.1
BOUND_ROWS = 2048  # vectors that bound the distances of the queries
BLOCK = 1024  # queries that are searched together
WAVE = 8192  # queries that are broadcast at a time
SEED = 29
INDEX = pa.schema([
    ("dim", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("norms", pa.binary()),
    ("values", pa.binary()), ("order", pa.binary()),
])
INDEX_COLUMNS = "dim int, ids binary, vectors binary, norms binary, values binary, order binary"


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id`` and ``vec`` of the rows with an id and a finite vector that is not zero."""
    finite = F.forall("vec", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")
    ).filter(F.col("id").isNotNull() & finite & F.exists("vec", lambda x: x != 0))


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    """Vectors of one length, scaled by a power of two so that squares stay finite."""
    rows = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1))[1][:, None])


def directions(dim: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, n))


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def _index_row(dim: int, ids: np.ndarray, rows: np.ndarray, n: int, seed: int) -> pa.RecordBatch:
    norms = _lengths(rows)
    values = ((rows / norms[:, None]) @ directions(dim, n, seed)).T.astype(np.float32)
    order = np.argsort(values, axis=1)
    values = np.take_along_axis(values, order, 1)
    parts = [ids.astype(np.int64), rows, norms, np.ascontiguousarray(values), order.astype(np.uint16)]
    columns = [pa.array([dim], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)]
    return pa.RecordBatch.from_arrays(columns, schema=INDEX)


def _by_dim(batch: pa.RecordBatch, *more: str) -> Iterator[tuple]:
    """Length, ids, vectors, and more columns of the rows of each length."""
    dims = np.array(batch.column("vec").value_lengths())
    for dim in np.unique(dims):
        mine = batch.filter(pa.array(dims == dim))
        columns = (mine.column(name).to_numpy() for name in more)
        yield int(dim), mine.column("id").to_numpy(), _matrix(mine.column("vec"), int(dim)), *columns


def _index_batches(batches: Iterator[pa.RecordBatch], n: int, shard_rows: int, seed: int):
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for dim, ids, rows in _by_dim(batch) if batch.num_rows else ():
            if dim in held:
                ids, rows = np.r_[held[dim][0], ids], np.r_[held[dim][1], rows]
            while len(ids) >= shard_rows:
                yield _index_row(dim, ids[:shard_rows], rows[:shard_rows], n, seed)
                ids, rows = ids[shard_rows:], rows[shard_rows:]
            held[dim] = ids, rows
    for dim, (ids, rows) in held.items():
        if len(ids):
            yield _index_row(dim, ids, rows, n, seed)


def build_index(
    vectors: DataFrame, n_rows: int, projections: int = PROJECTIONS, shard_rows: int = SHARD_ROWS, seed: int = SEED
) -> DataFrame:
    """The index of ``usable`` vectors, all of them, written to the shared folder."""
    if shard_rows > 1 << 16:
        raise ValueError("places in a shard have 16 bits")
    dealt = vectors.repartition(max(1, -(-n_rows * 5 // (shard_rows * 4))), F.xxhash64("id", "vec"))
    return stored(
        dealt.mapInArrow(partial(_index_batches, n=projections, shard_rows=shard_rows, seed=seed), INDEX_COLUMNS),
        "index",
    )


def threshold(projections: int, half_width: float = HALF_WIDTH, miss: float = MISS) -> int:
    """Collisions that a vector at the radius reaches but for a probability of ``miss``."""
    p = 2 * NormalDist().cdf(half_width) - 1
    return int(projections * p + NormalDist().inv_cdf(miss) * (projections * p * (1 - p)) ** 0.5)


class _Best:
    """The k best of each query so far, by score, then smaller id."""

    def __init__(self, ids: np.ndarray, k: int):
        self.own, self.k = ids, k
        self.found: list[list[tuple[float, int]]] = [[] for _ in ids]

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(self.found[q]) == self.k:
            better = scores >= -self.found[q][-1][0]
            ids, scores = ids[better], scores[better]
        if len(ids) > self.k:
            top = np.lexsort((ids, -scores))[: self.k + int((ids == self.own[q]).sum())]
            ids, scores = ids[top], scores[top]
        new = [(-s, i) for s, i in zip(scores.tolist(), ids.tolist()) if i != self.own[q]]
        if new:
            self.found[q] = sorted(self.found[q] + new)[: self.k]

    def distance(self, q: int) -> float:
        """Of the k-th best, between vectors of length one."""
        if len(self.found[q]) < self.k:
            return float("inf")
        return max(0.0, 2 + 2 * self.found[q][-1][0]) ** 0.5


def _walked(order: np.ndarray, spans: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """How often each vector is met on one span (from, to) or more of every sorted array."""
    met = [row[x:y] for start, end in spans for row, x, y in zip(order, start.tolist(), end.tolist()) if x < y]
    return np.bincount(np.concatenate(met), minlength=order.shape[1]) if met else np.zeros(order.shape[1], np.int64)


def search_shard(
    queries: np.ndarray, unit: np.ndarray, bound: np.ndarray, shard, best: _Best, projections: int, seed: int
) -> int:
    """Add a shard's neighbours of all queries to ``best``; the number of vectors verified."""
    ids, rows, norms, values, order = shard
    lengths = _lengths(queries)
    projected = (unit @ directions(rows.shape[1], projections, seed)).astype(np.float32)
    least = threshold(projections)
    verified = np.zeros((len(queries), len(ids)), bool)
    collisions = np.zeros((len(queries), len(ids)), np.int16)
    low = np.zeros((len(queries), projections), np.int64)
    high = low.copy()
    nothing, everything = np.zeros(projections, np.int64), np.full(projections, len(ids))

    def verify(q: int, at: np.ndarray) -> None:
        verified[q, at] = True
        best.add(q, ids[at], (rows[at] * queries[q]).sum(axis=1) / (norms[at] * lengths[q]))

    def reach(q: int) -> float:
        return min(best.distance(q), bound[q], 2.0)  # no two vectors are further apart

    active, opened = np.arange(len(queries)), False
    # where k neighbours are known to be within a distance, windows open at it and don't widen beyond
    radius = np.array([reach(q) if reach(q) < 2.0 else FIRST_RADIUS for q in active])
    while len(active):
        r = np.array([min(radius[q], reach(q)) for q in active])
        half = (HALF_WIDTH * r).astype(np.float32)
        mine = projected[active]
        new_low = np.stack([np.searchsorted(v, mine[:, j] - half) for j, v in enumerate(values)], 1)
        new_high = np.stack([np.searchsorted(v, mine[:, j] + half, "right") for j, v in enumerate(values)], 1)
        left = []
        for i, q in enumerate(active):
            # a reach that fell since the last round doesn't narrow a window
            a = np.minimum(new_low[i], low[q]) if opened else new_low[i]
            b = np.maximum(new_high[i], high[q]) if opened else new_high[i]
            if opened:
                collisions[q] += _walked(order, [(a, low[q]), (high[q], b)]).astype(np.int16)
            elif 2 * (b - a).sum() <= projections * len(ids):
                collisions[q] = _walked(order, [(a, b)])
            else:  # of a window that opens on most of the array, what lies outside is walked
                collisions[q] = projections - _walked(order, [(nothing, a), (b, everything)])
            low[q], high[q] = a, b
            at = np.flatnonzero((collisions[q] >= least) & ~verified[q])
            if len(at):
                verify(q, at)
            if reach(q) > r[i]:
                left.append(q)
            elif r[i] >= 2.0 and len(best.found[q]) < best.k:
                verify(q, np.flatnonzero(~verified[q]))
        active, opened = np.array(left, int), True
        radius *= GROWTH
    return int(verified.sum())


def _search_batches(batches: Iterator[pa.RecordBatch], wave, k: int, projections: int, seed: int):
    queries = wave.value
    best = {dim: _Best(ids, k) for dim, (ids, _, _) in queries.items()}
    for batch in batches:
        for row in batch.to_pylist():
            dim = row["dim"]
            if dim not in queries:
                continue
            ids = np.frombuffer(row["ids"], np.int64)
            shard = (
                ids, np.frombuffer(row["vectors"]).reshape(-1, dim), np.frombuffer(row["norms"]),
                np.frombuffer(row["values"], np.float32).reshape(-1, len(ids)),
                np.frombuffer(row["order"], np.uint16).reshape(-1, len(ids)),
            )
            _, vectors, bound = queries[dim]
            for at in range(0, len(vectors), BLOCK):
                part, mine = vectors[at : at + BLOCK], slice(at, at + BLOCK)
                block = _Best(best[dim].own[mine], k)
                block.found = best[dim].found[mine]
                search_shard(part, part / _lengths(part)[:, None], bound[mine], shard, block, projections, seed)
                best[dim].found[mine] = block.found
    for dim, b in best.items():
        near = queries[dim][2]
        rows = [
            (int(q), i, -s) for q, found, most in zip(b.own, b.found, near) for s, i in found
            if max(0.0, 2 + 2 * s) ** 0.5 <= most
        ]
        if rows:
            q, i, s = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())],
                names=["query_id", "vec_id", "score"],
            )


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / _lengths(rows)[:, None]


def _bound_batches(batches: Iterator[pa.RecordBatch], sample, k: int):
    """Queries with the distance within which 2k vectors of the sample lie, a little above it for rounding."""
    for batch in batches:
        for dim, ids, rows in _by_dim(batch) if batch.num_rows else ():
            bound = np.full(len(ids), np.inf)
            if dim in sample.value:
                others, unit = sample.value[dim]
                for at in range(0, len(ids), BLOCK) if len(others) > 2 * k else ():
                    score = _unit(rows[at : at + BLOCK]) @ unit.T
                    score[ids[at : at + BLOCK, None] == others] = -np.inf
                    kth = np.partition(score, -2 * k, axis=1)[:, -2 * k]
                    bound[at : at + BLOCK] = np.where(
                        np.isfinite(kth), np.sqrt(np.maximum(0, 2 - 2 * kth)) + 1e-6, np.inf
                    )
            vectors = pa.ListArray.from_arrays(np.arange(0, rows.size + 1, dim, dtype=np.int32), rows.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(ids), vectors, pa.array(bound)], names=["id", "vec", "bound"])


def _sample(good: DataFrame, n_rows: int, rows: int, seed: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and unit vectors of about ``rows`` rows, chosen by a hash."""
    place = F.pmod(F.xxhash64("id", "vec", F.lit(seed)), F.lit(max(1, n_rows // rows)))
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in good.filter(place == 0).limit(2 * rows).toArrow().to_batches():
        for dim, ids, x in _by_dim(batch) if batch.num_rows else ():
            old = out.get(dim)
            out[dim] = (np.r_[old[0], ids], np.r_[old[1], _unit(x)]) if old else (ids, _unit(x))
    return out


def _hits(index: DataFrame, asked: DataFrame, k: int, projections: int, wave: int, seed: int) -> DataFrame:
    """``query_id``, ``vec_id``, ``score``: what the tasks found, up to k of each task and query."""
    spark = index.sparkSession
    n_waves = max(1, -(-asked.count() // wave))
    found = []
    for w in range(n_waves):
        mine = asked.filter(F.pmod(F.xxhash64("id"), F.lit(n_waves)) == w).toArrow()  # about ``wave`` rows
        parts = {}
        for batch in mine.to_batches():
            for dim, ids, rows, bound in _by_dim(batch, "bound") if batch.num_rows else ():
                new = ids, rows, bound
                parts[dim] = tuple(np.concatenate(p) for p in zip(parts[dim], new)) if dim in parts else new
        step = partial(
            _search_batches, wave=spark.sparkContext.broadcast(parts), k=k, projections=projections, seed=seed
        )
        hits = index.mapInArrow(step, "query_id long, vec_id long, score double")
        found.append(stored(hits, "hits") if n_waves > 1 else hits)
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
    projections: int = PROJECTIONS, shard_rows: int = SHARD_ROWS, wave: int = WAVE, seed: int = SEED,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the k nearest found of every query by cosine.

    Vectors without an id, null, zero, or with null or non-finite components take no part, as
    vectors or queries. Vectors are compared with those of their own length. Rows with the
    query's id are its own and never an answer. A repeated vector row can be an answer more
    than once; a repeated query id is answered once, for its smallest vector. Ties go to the
    smaller id. A query without any other vector has no row.
    """
    spark = vectors.sparkSession
    good = usable(vectors, id_col, vec_col)
    n_rows = good.count()
    index = build_index(good, n_rows, projections, shard_rows, seed)
    sample = spark.sparkContext.broadcast(_sample(good, n_rows, BOUND_ROWS, seed))
    asked = usable(queries, id_col, vec_col).groupBy("id").agg(F.min("vec").alias("vec"))
    bounded = partial(_bound_batches, sample=sample, k=k)
    asked = stored(asked.mapInArrow(bounded, "id long, vec array<double>, bound double"), "queries")
    every = stored(_hits(index, asked, k, projections, wave, seed), "hits")
    found = every.groupBy("query_id").count().filter(F.col("count") >= k).select(F.col("query_id").alias("id"))
    short = stored(
        asked.filter("bound < double('inf')").join(found, "id", "left_anti").withColumn("bound", F.lit(float("inf"))),
        "short",
    )
    if not short.isEmpty():
        again = _hits(index, short, k, projections, wave, seed)
        every = every.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(again)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
