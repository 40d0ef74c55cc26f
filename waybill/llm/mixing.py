"""Mixing sources to target weights by min-cost flow.

Documents may belong to several sources. They are aggregated by their membership
pattern (the set of their sources), so the flow has an arc for each pattern and not
for each document: from the start to a pattern one arc per repetition, each
with the pattern's words as capacity and a cost that rises with the repetition
(convex), from a pattern to each of its sources, and from a source to the end its
quota. The routed words of a pattern become whole passes over its documents and a
rest, for which documents are drawn in a seeded order.

Only the pattern table reaches the driver. It is checked against ``MAX_PATTERNS``
before; a corpus with more patterns is refused with an error, never cut.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.llm.common import free_name, stored, text_bytes
from waybill.operators.running import running_total

MAX_PATTERNS = 100_000
MAX_REPEATS = 3
BUCKET_ROWS = 1024  # documents of a pattern that are expected in one bucket of the seeded order
SEARCHED = 256  # documents that are decided anew together, where single exchanges leave a gap
SUMS = 16_384  # sums kept in that search
NO_END = (1 << 62) - 1
SEED = 17


def _size_batches(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        sizes = [len(t.as_py().split()) for t in batch.column("text")]  # bytes: the six ASCII blanks
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(sizes, pa.int64())], names=["id", "place", "pattern", "size"]
        )


def document_sizes(docs: DataFrame, id_col: str, text_col: str, members: Column, place: Column) -> DataFrame:
    """``id``, ``place``, ``pattern`` (its sources as JSON, sorted, null last) and ``size`` in words."""
    pattern = F.to_json(F.array_sort(F.array_distinct(members)))
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(
        F.col(id_col).alias("id"), place.alias("place"), pattern.alias("pattern"), text_bytes(text_col).alias("text")
    ).mapInArrow(_size_batches, f"id {kind}, place long, pattern string, size long")


@dataclass(frozen=True)
class Pattern:
    key: str
    sources: tuple
    size: int
    n_docs: int


def read_patterns(sizes: DataFrame, most: int = MAX_PATTERNS) -> list[Pattern]:
    """The membership patterns, at most ``most`` of them."""
    rows = (
        sizes.groupBy("pattern").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        .limit(most + 1).collect()
    )
    if len(rows) > most:
        raise ValueError(f"more than {most} membership patterns; group the sources first")
    return sorted(
        (Pattern(r["pattern"], tuple(json.loads(r["pattern"])), r["size"], r["n"]) for r in rows),
        key=lambda p: p.key,
    )


def source_sizes(patterns: Sequence[Pattern]) -> dict:
    """Words per source in code point order, null last."""
    sizes: dict = {}
    for p in patterns:
        for s in p.sources:
            sizes[s] = sizes.get(s, 0) + p.size
    return {s: sizes[s] for s in sorted(sizes, key=lambda s: (s is None, s or ""))}


def cyclic_weights(sources: Sequence, cycle: Sequence[float] = (1, 2, 3)) -> dict:
    return {s: cycle[i % len(cycle)] for i, s in enumerate(sources)}


def targets(sizes: dict, weights: dict, total: float, max_repeats: int = MAX_REPEATS) -> dict:
    """Shares of ``total`` by weight, none above ``max_repeats`` times its source's size.

    What a full source can't take is shared again among the others by weight.
    """
    fixed: dict = {}
    while True:
        open_ = [s for s in sizes if s not in fixed]
        rest, weight = total - sum(fixed.values()), sum(weights[s] for s in open_)
        share = {s: rest * weights[s] / weight if weight else 0.0 for s in open_}
        full = [s for s in open_ if share[s] > max_repeats * sizes[s]]
        if not full:
            return {s: float(fixed.get(s, share.get(s, 0.0))) for s in sizes}
        fixed |= {s: float(max_repeats * sizes[s]) for s in full}


class _Network:
    """Integer max-flow by level graphs, with capacities that may be raised between runs."""

    def __init__(self, n: int):
        self.arcs: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[int] = []

    def add(self, a: int, b: int, room: int) -> int:
        for x, y, r in ((a, b, room), (b, a, 0)):
            self.arcs[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
        return len(self.to) - 2

    def augment(self, start: int, end: int) -> None:
        while True:
            level = [-1] * len(self.arcs)
            level[start] = 0
            queue = deque([start])
            while queue:
                x = queue.popleft()
                for k in self.arcs[x]:
                    if self.room[k] and level[self.to[k]] < 0:
                        level[self.to[k]] = level[x] + 1
                        queue.append(self.to[k])
            if level[end] < 0:
                return
            at = [0] * len(self.arcs)
            path: list[int] = []
            x = start
            while True:
                if x == end:
                    push = min(self.room[k] for k in path)
                    for k in path:
                        self.room[k] -= push
                        self.room[k ^ 1] += push
                    path, x = [], start
                elif at[x] < len(self.arcs[x]):
                    k = self.arcs[x][at[x]]
                    if self.room[k] and level[self.to[k]] == level[x] + 1:
                        path.append(k)
                        x = self.to[k]
                    else:
                        at[x] += 1
                elif path:
                    x = self.to[path.pop() ^ 1]
                    at[x] += 1
                else:
                    break


def route(patterns: Sequence[Pattern], quotas: dict, max_repeats: int = MAX_REPEATS) -> dict[tuple, int]:
    """Words routed from each pattern to each source: (pattern key, source) to words.

    The cost of a word is the number of earlier passes over its pattern. A path's cost is
    that of its first arc, so successive shortest paths fill the first passes of all
    patterns, rerouting where needed, before any second pass, and so on: for each
    pass the capacities are opened and the flow is raised to its maximum.
    """
    names = list(quotas)
    place = {s: 1 + len(patterns) + i for i, s in enumerate(names)}
    end = 1 + len(patterns) + len(names)
    net = _Network(end + 1)
    first = [net.add(0, 1 + i, 0) for i in range(len(patterns))]
    routes = {
        (p.key, s): net.add(1 + i, place[s], max_repeats * p.size)
        for i, p in enumerate(patterns) for s in p.sources
    }
    for s in names:
        net.add(place[s], end, round(quotas[s]))
    for _ in range(max_repeats):
        for arc, p in zip(first, patterns):
            net.room[arc] += p.size
        net.augment(0, end)
    return {key: net.room[arc ^ 1] for key, arc in routes.items()}


def _nearest_sum(size: np.ndarray, goal: int, keep: int = SUMS) -> np.ndarray:
    """Documents whose sizes add up near the goal.

    Sums are built up document by document. Of more than ``keep`` sums one is kept in each of ``keep`` equal
    intervals; with fewer the result is the nearest of all.
    """
    top = goal + int(size.max(initial=0))
    sums, steps = np.zeros(1, np.int64), []
    for words in size:
        more = np.flatnonzero(sums + words <= top)
        every = np.r_[sums, sums[more] + words]
        origin, took = np.r_[np.arange(len(sums)), more], np.r_[np.zeros(len(sums), bool), np.ones(len(more), bool)]
        order = np.argsort(every, kind="stable")
        every = every[order]
        cell = every if len(every) <= keep else (every / (top + 1) * keep).astype(np.int64)
        first = np.r_[True, cell[1:] != cell[:-1]]
        sums, chosen = every[first], order[first]
        steps.append((origin[chosen], took[chosen]))
    at = int(np.abs(sums - goal).argmin())
    taken = np.zeros(len(size), bool)
    for i in range(len(size) - 1, -1, -1):
        taken[i] = steps[i][1][at]
        at = int(steps[i][0][at])
    return taken


def _exchanged(size: np.ndarray, taken: np.ndarray, left: int) -> int:
    """Add one document, or exchange one for a taken one, while that brings the words nearer; what is left then."""
    while left:
        free = np.flatnonzero(~taken & (size > 0))
        free = free[np.argsort(size[free], kind="stable")]
        out, out_size = np.flatnonzero(taken), np.r_[size[taken], 0]
        if not len(free):
            break
        wanted = left + out_size
        place = np.searchsorted(size[free], wanted)
        near = np.stack([np.clip(place - 1, 0, len(free) - 1), np.clip(place, 0, len(free) - 1)])
        gap = np.abs(wanted - size[free][near])
        side, best = np.unravel_index(gap.argmin(), gap.shape)
        if gap[side, best] >= abs(left):
            break
        new = free[near[side, best]]
        left = int(wanted[best] - size[new])
        taken[new] = True
        if best < len(out):
            taken[out[best]] = False
    return left


def _fill(rows: pd.DataFrame) -> pd.DataFrame:
    """Documents for a pattern's rest out of the bucket in which it ends: in seeded order, each that still fits.

    Then single documents are added or exchanged while that brings the words nearer, also for documents of later buckets,
    which are here with one document of each size (``later``). If that leaves a gap that later documents fit into, the
    bucket's documents are taken as they fit, and the gap goes on to the next buckets. If none fits, some documents are decided
    anew together. Gives the rows taken, and a row of the pattern with what is left and whether it is done.
    """
    rows = rows.sort_values(["later", "place", "row"], kind="stable")
    size, later, goal = rows["size"].to_numpy(), rows["later"].to_numpy(), int(rows["left"].iloc[0])
    fits, left = np.zeros(len(size), bool), goal
    for i in np.flatnonzero(~later):
        fits[i] = 0 < size[i] <= left
        left -= size[i] * fits[i]
    taken = fits.copy()
    gap = _exchanged(size, taken, int(left))
    done = gap == 0 or not (size[later] <= left).any()
    if not done:
        taken, gap = fits, int(left)
    elif gap:
        by_nearness = np.flatnonzero(later)[np.argsort(np.abs(size[later] - abs(gap)), kind="stable")]
        here = np.flatnonzero(~later & (size > 0))
        again = np.r_[here[-(SEARCHED * 3 // 4) :], by_nearness[: SEARCHED // 4]]
        kept = taken.copy()
        kept[again] = False
        other = kept.copy()
        other[again] = _nearest_sum(size[again], max(goal - int(size[kept].sum()), 0))
        if abs(goal - int(size[other].sum())) < abs(gap):
            taken, gap = other, goal - int(size[other].sum())
    chosen = rows["row"].to_numpy()[taken].tolist()
    return pd.DataFrame({
        "pattern": rows["pattern"].iloc[0], "row": pd.array([*chosen, None], "Int64"), "left": gap, "done": done,
    })


def select(sizes: DataFrame, patterns: Sequence[Pattern], flow: dict[str, int]) -> DataFrame:
    """``id``, ``pattern``, ``size`` and ``copies``: how often the mix takes each document.

    Every document is taken as often as its pattern's flow goes over the pattern whole.
    For the rest, documents are ordered by a seeded hash of the id: whole buckets of that order are taken while they
    fit, and the bucket where it ends is filled document by document. What is left then goes on to the buckets behind, for their
    documents that still fit, in rounds until each pattern is done; most are after one. A pattern's task sees one bucket,
    and one later document of each size, whose number the sum of the sizes bounds.
    """
    spark = sizes.sparkSession
    plan = [
        (p.key, *(divmod(flow.get(p.key, 0), p.size) if p.size else (0, 0)), 1 + p.n_docs // BUCKET_ROWS)
        for p in patterns
    ]
    plan = spark.createDataFrame(plan, "pattern string, passes long, rest long, n_buckets long")
    # at most MAX_PATTERNS short rows
    placed = (
        sizes.join(F.broadcast(plan), "pattern")
        .withColumn("bucket", F.pmod("place", "n_buckets"))
    )
    # per pattern: the bucket behind which it goes on, the largest size that fits, the words left
    state = plan.filter("rest > 0").select(
        "pattern", F.lit(-1).cast("long").alias("after"), F.lit(NO_END).alias("most"), F.col("rest").alias("left")
    )
    taken = ranges = None
    while True:
        ahead = placed.join(F.broadcast(state), "pattern").filter("bucket > after AND size > 0").select(
            "pattern", "bucket", "place", "row", "size", "left", "most"
        )
        fitting = F.when(F.col("size") <= F.col("most"), F.col("size")).otherwise(0)
        sums = ahead.groupBy("pattern", "bucket").agg(F.sum(fitting).alias("bucket_size"), F.first("left").alias("left"))
        running = running_total(sums, ["pattern"], "bucket", "bucket_size", 4096, "through")
        before = F.struct("bucket", (F.col("left") - F.col("through") + F.col("bucket_size")).alias("left"))
        ends = stored(running.groupBy("pattern").agg(
            F.min(F.when(F.col("through") > F.col("left"), before)).alias("end"),
            (F.first("left") - F.max("through")).alias("rest"),
        ).select(
            "pattern", F.coalesce("end.bucket", F.lit(NO_END)).alias("end"), F.coalesce("end.left", "rest").alias("left")
        ), "ends")
        cut = ahead.drop("left").join(F.broadcast(ends), "pattern")
        here = cut.filter("bucket = end AND size <= most").select("pattern", "place", "row", "size", "left", F.lit(False).alias("later"))
        later = cut.filter("bucket > end OR size > most").groupBy("pattern", "size").agg(
            F.min(F.struct("place", "row")).alias("f"), F.first("left").alias("left")
        ).select("pattern", "f.place", "f.row", "size", "left", F.lit(True).alias("later"))
        filled = stored(
            here.unionByName(later).groupBy("pattern").applyInPandas(_fill, "pattern string, row long, left long, done boolean"), "filled"
        )
        rows = filled.filter("row IS NOT NULL").select("row", F.lit(1).alias("chosen"))
        whole = state.join(ends.select("pattern", "end"), "pattern", "left").select(
            "pattern", "after", F.coalesce("end", F.lit(NO_END)).alias("end"), "most"
        )
        taken, ranges = (rows, whole) if taken is None else (taken.unionByName(rows), ranges.unionByName(whole))
        state = stored(filled.filter("row IS NULL AND NOT done").drop("row", "done").join(ends.select("pattern", "end"), "pattern").select(
            "pattern", F.col("end").alias("after"), F.col("left").alias("most"), "left"
        ), "state")
        if state.isEmpty():
            break
    # a short array for each of at most MAX_PATTERNS patterns
    spans = F.broadcast(ranges.groupBy("pattern").agg(F.collect_list(F.struct("after", "end", "most")).alias("spans")))
    inside = F.exists("spans", lambda r: (F.col("bucket") > r["after"]) & (F.col("bucket") < r["end"]) & (F.col("size") <= r["most"]))
    extra = (F.coalesce(inside, F.lit(False)) & (F.col("size") > 0)) | F.col("chosen").isNotNull()
    return placed.join(spans, "pattern", "left").join(taken, "row", "left").select(
        "id", "pattern", "size", (F.col("passes") + extra.cast("int")).cast("int").alias("copies")
    )


def take(docs: DataFrame, members: Column, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, the others left out.

    Rows are told apart by a number given as they are written, so repeated and null ids do no harm.
    """
    row, copies, copy = (free_name(docs.columns, name) for name in ("_row", "_copies", "_copy"))
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    taken, _ = mix(rows, members, row, text_col, order_col=id_col, **options)
    wanted = taken.filter("copies > 0").select(F.col("id").alias(row), F.col("copies").alias(copies))
    repeated = rows.join(wanted, row).withColumn(copy, F.explode(F.sequence(F.lit(1), copies)))
    return repeated.select(*[f"`{c}`" for c in docs.columns])


def mix(
    docs: DataFrame, members: Column, id_col: str = "doc_id", text_col: str = "text", weights=cyclic_weights,
    share: float = 1.0, max_repeats: int = MAX_REPEATS, seed: int = SEED, max_patterns: int = MAX_PATTERNS, order_col: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Take documents so that each source's words come near its target.

    ``members`` is an array column with the sources of a document; ``weights`` maps the list of
    sources (code point order, null last) to a weight each; ``share`` is the size of the
    mix in parts of all words. The seeded order hashes ``order_col``, which is the id if not given.

    Returns the documents (``id``, ``pattern``, ``size``, ``copies``) and the sources
    (``source``, ``pattern`` of documents in it alone, ``source_size``, ``target``, ``routed``).
    Null text has size 0, and documents of size 0 are never drawn for a rest. A null source is a
    source of its own. Rows with one id stand at one place of the seeded order and keep their order
    by size. Without documents both results are empty.
    """
    place = F.xxhash64(F.lit(seed), order_col or id_col)
    numbered = document_sizes(docs, id_col, text_col, members, place).withColumn("row", F.monotonically_increasing_id())
    sizes = stored(numbered, "sizes")
    patterns = read_patterns(sizes, max_patterns)
    by_source = source_sizes(patterns)
    wanted = targets(
        by_source, weights(list(by_source)), share * sum(p.size for p in patterns), max_repeats
    )
    words = route(patterns, wanted, max_repeats)
    flow: dict[str, int] = {}
    routed: dict = {}
    for (key, source), n in words.items():
        flow[key] = flow.get(key, 0) + n
        routed[source] = routed.get(source, 0) + n
    alone = {p.sources[0]: p.key for p in patterns if len(p.sources) == 1}
    sources = docs.sparkSession.createDataFrame(
        [(s, alone.get(s), n, wanted[s], routed.get(s, 0)) for s, n in by_source.items()],
        "source string, pattern string, source_size long, target double, routed long",
    )
    return select(sizes, patterns, flow), sources
