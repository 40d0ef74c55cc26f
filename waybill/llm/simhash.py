"""SimHash near-duplicates: 64-bit fingerprints, linked through BK-trees.

The fingerprints are cut into ``max_bits + 2`` pieces. Two that differ in at most
``max_bits`` bits agree in two pieces at least, so every pair of pieces is a shard
key, and linked fingerprints share a shard. In each shard a BK-tree is grown: the
children of a node are keyed by their Hamming distance to it, and a search with
radius r at distance d from a node follows only the edges d-r to d+r. Trees of many
shards are grown and searched together as numpy arrays.

A shard with more than ``max_shard`` fingerprints is split by the same rule on
its remaining bits; then a shard has at most 2^16 fingerprints for two bits. The
trees travel with the shards in a shuffle and are not broadcast, as all trees together
grow with the corpus and have no bound.

Groups are found over distinct fingerprints by alternating large-star and
small-star steps, each written to the shared folder; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.llm.common import free_name, stored, text_bytes

SHINGLE = 3
MAX_BITS = 2
SEED = 42
MAX_SHARD = 4096
FINGERPRINTS = pa.schema([("id", pa.int64()), ("fp", pa.int64())])


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a UTF-8 text as an unsigned number; 0 without words."""
    words = text.lower().split()  # of bytes: A-Z, and the six ASCII blanks
    if not words:
        return 0
    if len(words) <= shingle:
        shingles, n = [b" ".join(words)], 1
    else:
        n = len(words) - shingle + 1
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65_000):
        part = hashes[at : at + 65_000].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], shingle: int, seed: int):
    for batch in batches:
        found = [fingerprint(text.as_py(), shingle, seed) for text in batch.column("text")]
        fps = pa.array(np.array(found, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("id"), fps], schema=FINGERPRINTS)


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    shingle: int = SHINGLE, seed: int = SEED,
) -> DataFrame:
    """``id`` and signed 64-bit ``fp`` of every document. Null text counts as empty (0)."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"))
    return texts.mapInArrow(partial(_fingerprint_batches, shingle=shingle, seed=seed), "id long, fp long")


def cuts(bits: list[int], pieces: int) -> list[list[int]]:
    """Bit positions in nearly equal pieces."""
    return [list(map(int, part)) for part in np.array_split(np.array(bits), pieces)]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def shard_masks(bits: list[int], max_bits: int) -> list[tuple[int, list[int]]]:
    """For each pair of pieces: the mask of its bits, and the bits outside."""
    pieces = cuts(bits, max_bits + 2)
    out = []
    for pair in combinations(range(len(pieces)), 2):
        inside = [b for i in pair for b in pieces[i]]
        out.append((_mask(inside), [b for b in bits if b not in inside]))
    return out


def _key(fp: Column, kind: int, mask: int) -> Column:
    """Shards meet under a hash of the masked bits. If two different shards get the
    same hash they are searched as one, which changes nothing."""
    return F.xxhash64(F.lit(kind), fp.bitwiseAND(F.lit(mask)))


def shards(distinct: DataFrame, max_bits: int, max_shard: int) -> DataFrame:
    """``shard`` and ``fp``: each fingerprint under all its shard keys, large shards split."""
    level = shard_masks(list(range(64)), max_bits)
    fp = F.col("fp")
    keyed = distinct.select(
        "fp",
        F.explode(F.array(*[
            F.struct(F.lit(i).alias("pair"), _key(fp, i, mask).alias("shard"))
            for i, (mask, _) in enumerate(level)
        ])).alias("k"),
    ).select("fp", "k.pair", "k.shard")
    large = keyed.groupBy("shard").count().filter(F.col("count") > max_shard).select(
        F.col("shard"), F.lit(True).alias("large")
    )
    marked = keyed.join(large, "shard", "left")
    finer = F.lit(None).cast("array<bigint>")
    for i, (mask, rest) in enumerate(level):
        keys = [
            _key(fp, 1000 * (i + 1) + j, mask | sub)
            for j, (sub, _) in enumerate(shard_masks(rest, max_bits))
        ]
        finer = F.when(F.col("pair") == i, F.array(*keys)).otherwise(finer)
    return marked.select(
        F.explode(F.when(F.col("large"), finer).otherwise(F.array("shard"))).alias("shard"), "fp"
    )


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


class Forest:
    """BK-trees of many shards at once. ``shard`` is sorted; fingerprints of a shard are distinct.

    Node i is fingerprint i. ``key`` holds parent * 65 + distance, sorted, with ``child`` beside it.
    """

    def __init__(self, shard: np.ndarray, fp: np.ndarray):
        self.fp = fp
        starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        self.root = np.repeat(starts, np.diff(np.r_[starts, len(fp)]))
        keys, children = [], []
        # all rows below a node, level by level; the first of each edge becomes the child
        rows = np.setdiff1d(np.arange(len(fp)), starts, assume_unique=True)
        above = self.root[rows]
        while len(rows):
            edge = above * 65 + _popcount(fp[rows] ^ fp[above])
            order = np.argsort(edge, kind="stable")
            rows, edge = rows[order], edge[order]
            new = np.r_[True, edge[1:] != edge[:-1]]
            keys.append(edge[new])
            children.append(rows[new])
            above = rows[new][np.cumsum(new) - 1]
            rows, above = rows[~new], above[~new]
        key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        child = np.concatenate(children) if children else np.zeros(0, np.int64)
        order = np.argsort(key)
        self.key, self.child = key[order], child[order]

    def near(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, node) of a shard within the radius; queries are positions of fingerprints."""
        q, node = queries, self.root[queries]
        found_q, found_n = [], []
        while len(q):
            d = _popcount(self.fp[q] ^ self.fp[node])
            hit = (d <= radius) & (q != node)
            found_q.append(q[hit])
            found_n.append(node[hit])
            first = np.searchsorted(self.key, node * 65 + np.maximum(d - radius, 0))
            last = np.searchsorted(self.key, node * 65 + np.minimum(d + radius, 64), "right")
            n = last - first
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            q, node = np.repeat(q, n), self.child[np.repeat(first, n) + offset]
        return np.concatenate(found_q), np.concatenate(found_n)


def star_links(shard: np.ndarray, fp: np.ndarray, radius: int, at_once: int = 2_000_000):
    """Links of the groups inside each shard: (fingerprint, smallest of its group), as arrays."""
    if not len(fp):
        return fp, fp
    order = np.lexsort((fp, shard))
    shard, fp = shard[order], fp[order]
    forest = Forest(shard, fp)
    size = np.bincount(forest.root, minlength=len(fp))[forest.root]
    several = np.flatnonzero(size > 1)
    block = np.cumsum(size[several]) // at_once
    label = np.arange(len(fp))
    for queries in np.split(several, np.flatnonzero(np.diff(block)) + 1) if len(several) else []:
        a, b = forest.near(queries, radius)
        while len(a):  # merge groups; rows of a shard are sorted, so the smallest position leads
            la, lb = label[a], label[b]
            split = la != lb
            if not split.any():
                break
            np.minimum.at(label, np.maximum(la, lb)[split], np.minimum(la, lb)[split])
            while (label[label] != label).any():
                label = label[label]
            a, b = a[split], b[split]
    linked = np.flatnonzero(label != np.arange(len(fp)))
    return fp[linked], fp[label[linked]]


def _link_batches(batches: Iterator[pa.RecordBatch], radius: int, rows: int = 250_000):
    """Batches arrive sorted by shard; some whole shards are linked at a time."""
    held: list[pa.Table] = []

    def linked(tables):
        t = pa.concat_tables(tables)
        fps = t.column("fp").to_numpy().astype(np.int64, copy=False).view(np.uint64)
        a, b = star_links(t.column("shard").to_numpy(), fps, radius)
        return pa.RecordBatch.from_arrays(
            [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["fp", "to"]
        )

    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        if sum(h.num_rows for h in held) >= rows:
            last = held[-1].column("shard")[-1].as_py()
            shard = t.column("shard").to_numpy()
            n = int(np.argmax(shard != last)) if (shard != last).any() else len(shard)
            held.append(t.slice(0, n))
            t = t.slice(n)
            if t.num_rows:
                yield linked(held)
                held = []
        if t.num_rows:
            held.append(t)
    if held:
        yield linked(held)


def fingerprint_links(distinct: DataFrame, max_bits: int, max_shard: int = MAX_SHARD) -> DataFrame:
    """Links ``fp`` to ``to`` that connect all fingerprints within ``max_bits`` bits of each other."""
    dealt = shards(distinct, max_bits, max_shard).repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(partial(_link_batches, radius=max_bits), "fp long, to long")


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Join every larger neighbour of a vertex to the smallest of its neighbourhood."""
    near = _both(edges)
    least = near.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return near.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Join a vertex and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def groups(links: DataFrame) -> DataFrame:
    """``a`` and the smallest vertex ``b`` of its group, for every linked vertex but the smallest."""
    def state(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()

    edges = stored(links.select(F.col("fp").alias("a"), F.col("to").alias("b")).distinct(), "links")
    before = None
    while (now := state(edges)) != before and now[0]:
        before = now
        edges = stored(_small_star(_large_star(edges)), "stars")
    return edges


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
    max_bits: int = MAX_BITS, seed: int = SEED, max_shard: int = MAX_SHARD,
) -> DataFrame:
    """``id``, ``fp`` and ``component`` (smallest id of the group) of every document.

    Null texts count as empty; all texts without words share fingerprint 0 and are one
    group. Rows with the same id are kept and grouped by their own texts. A null id is
    kept, and is the component only where a group has no other id. An empty table
    gives an empty result; other columns are not read.
    """
    prints = stored(fingerprints(docs, id_col, text_col, shingle, seed), "prints")
    firsts = stored(prints.groupBy("fp").agg(F.min("id").alias("first")), "firsts")
    stars = groups(fingerprint_links(firsts.select("fp"), max_bits, max_shard))
    member = stars.select(F.col("a").alias("fp"), F.col("b").alias("root")).unionByName(
        stars.select(F.col("b").alias("fp"), F.col("b").alias("root")).distinct()
    )
    placed = firsts.join(member, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    leads = placed.groupBy("root").agg(F.min("first").alias("component"))
    by_print = placed.join(leads, "root").select("fp", "component")
    return prints.join(by_print, "fp").select("id", "fp", "component")


def deduplicate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
    max_bits: int = MAX_BITS, seed: int = SEED,
) -> DataFrame:
    """The documents with one row of each group: that with the smallest id, null ids last.

    Rows are told apart by a number given as they are written, so repeated and null ids do no harm.
    """
    row = free_name(docs.columns, "_row")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = near_duplicates(rows, row, text_col, shingle, max_bits, seed).select(F.col("id").alias("_r"), "component")
    named = rows.select(F.col(row).alias("_r"), F.col(id_col).isNull().alias("_without"), F.col(id_col).alias("_name"))
    keep = (
        found.join(named, "_r").groupBy("component").agg(F.min(F.struct("_without", "_name", "_r")).alias("_first"))
        .select(F.col("_first._r").alias(row))
    )
    return rows.join(keep, row, "left_semi").select(*[f"`{c}`" for c in docs.columns])


def hex_print(fp: str = "fp") -> Column:
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")
