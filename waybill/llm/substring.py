"""Removal of repeated passages by level-wise doubling.

A window is a run of consecutive words of one document. Windows of a short length are counted first; only
places where a window was found again are extended to twice that length, and so on up to the wanted length,
until no candidates survive: a long window that is repeated starts and ends with repeated halves.

Documents are packed into slices of about ``SLICE`` bytes, which are written once, bucketed by slice, so that every
level joins them with what is known of them without moving a text again. At each level a slice names every distinct window
hash once, cut into parts by range of the hash, four bytes each (twelve at the last level). Hashes found in
two slices come back as one bit each, in the order in which the slice had named them. So copies inside a slice, however
many, travel as one; a window that is everywhere costs one entry a slice; no part holds more than
about ``PART`` entries, whatever the corpus size. Short keys may collide at the inner levels, which only lets a
candidate live on; the last level tells windows apart by 32 and 64 more bits beside the part.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import partial
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.llm import words
from waybill.llm.common import stored, text_bytes
from waybill.sources.scratch import new_folder

WINDOW = 35  # words
FIRST = 10  # words, at most, of the first level's windows
SLICE = 2 << 20  # bytes of text
BUCKET = 32 << 20  # bytes of text in a bucket of slices
PART = 4_000_000  # window hashes in a part
STEP = 0xD1342543DE82EF95  # odd
SLICES = "slice long, ids array<long>, data binary, ends array<long>, n_words long"
BLOCKS = "slice long, part int, own boolean, keys binary, more binary"
FOUND = "slice long, part int, bits binary"
RESULT = "id long, n_words long, n_removed long, removed array<struct<first:long,last:long>>, kept string"


def lengths(window: int, first: int = FIRST) -> list[int]:
    """Window lengths, ascending; each is at most twice the one before, the last is ``window``."""
    out = [window]
    while out[0] > max(1, first):
        out.insert(0, -(-out[0] // 2))
    return out


# ---- slices

def _slice_batches(batches: Iterator[pa.RecordBatch], size: int):
    """Rows of a task in slices; a text is never cut."""
    task, n = TaskContext.get().partitionId(), 0
    ids: list[int | None] = []
    texts: list[bytes] = []
    held = 0

    def packed():
        data, ends = words.joined(texts)
        count = len(words.spans(data)[0])
        row = [(task << 32) + n], [ids], [data.tobytes()], [ends], [count]
        types = pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()), pa.int64()
        names = ["slice", "ids", "data", "ends", "n_words"]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names=names)

    for batch in batches:
        for id_, text in zip(batch.column("id").to_pylist(), batch.column("text")):
            text = text.as_py()
            if texts and held + len(text) > size:
                yield packed()
                ids, texts, held, n = [], [], 0, n + 1
            ids.append(id_)
            texts.append(text)
            held += len(text)
    if texts:
        yield packed()


def _bucketed(df: DataFrame, key: str, n: int, name: str) -> DataFrame:
    """Write a frame to the shared folder in ``n`` buckets by ``key`` and read it back; no catalog entry stays."""
    spark, table = df.sparkSession, f"waybill_{name}_{uuid.uuid4().hex}"
    writer = df.repartition(n, key).write.bucketBy(n, key).option("compression", "zstd")
    writer.option("path", new_folder(spark, name)).saveAsTable(table)
    read = spark.table(table)
    read.schema  # resolved while the entry is there; its files are external and stay
    spark.sql(f"DROP TABLE {table}")
    return read


def slices(docs: DataFrame, id_col: str, text_col: str, size: int = SLICE, bucket: int = BUCKET) -> tuple[DataFrame, int]:
    """All documents in slices, bucketed by ``slice``, and the number of buckets."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // bucket) or 1
    return _bucketed(texts.mapInArrow(partial(_slice_batches, size=size), SLICES), "slice", n, "slices"), n


# ---- windows of one slice

class Slice:
    """The words of a slice as hashes, with running sums that give the hash of any window."""

    def __init__(self, data: bytes, ends: np.ndarray):
        text = np.frombuffer(data, np.uint8)
        start, end = words.spans(text)
        word = words.hashes(text, start, end)
        edges = np.searchsorted(start, ends)  # past the last word of each document
        self.first = np.r_[0, edges[:-1]]
        self.n = len(start)
        self.stop = np.repeat(edges, np.diff(np.r_[0, edges]))
        self.power = words._powers(STEP, self.n)
        self.inverse = words._powers(pow(STEP, -1, 1 << 64), self.n)
        self.word, self.length = word, (end - start).astype(np.uint64)
        self.sums = self._summed(word)

    def _summed(self, values: np.ndarray) -> np.ndarray:
        return np.r_[np.uint64(0), np.cumsum(values * self.power)]

    def _windows(self, sums: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
        return words.mixed((sums[at + length] - sums[at]) * self.inverse[at])

    def fitting(self, length: int) -> np.ndarray:
        """Whether a window of this length starts at a place and ends inside the document."""
        return np.arange(self.n) + length <= self.stop

    def distinct(self, at: np.ndarray, length: int, exact: bool):
        """The distinct windows at some places, in order: hash, second hash (or None), number of places,
        and the row of each place."""
        one = self._windows(self.sums, at, length)
        if not exact:
            hash_, row, n = np.unique(one, return_inverse=True, return_counts=True)
            return hash_, None, n, row
        two = self._windows(self._summed(words.mixed(self.word ^ (self.length * np.uint64(STEP)))), at, length)
        order = np.lexsort((two, one))
        a, b = one[order], two[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]
        row = np.empty(len(a), np.int64)
        row[order] = np.cumsum(new) - 1
        return a[new], b[new], np.bincount(row), row


def part_of(hash_: np.ndarray, n_parts: int) -> np.ndarray:
    """Part of each hash, never decreasing with it."""
    return (((hash_ >> np.uint64(32)) * np.uint64(n_parts)) >> np.uint64(32)).astype(np.int64)


def _survivors(s: Slice, found: list[dict[int, bytes]], steps: list[int], n_parts: int) -> np.ndarray:
    """Places whose windows are repeated at all levels done so far, given the bits of each of these levels."""
    alive = s.fitting(steps[0])
    for level, bits in enumerate(found):
        at = np.flatnonzero(alive)
        hash_, _, n, row = s.distinct(at, steps[level], level == len(steps) - 1)
        again = n > 1
        cut = np.searchsorted(part_of(hash_, n_parts), np.arange(n_parts + 1))
        for part, b in bits.items():
            lo, hi = cut[part], cut[part + 1]
            again[lo:hi] |= np.unpackbits(np.frombuffer(b, np.uint8), count=hi - lo).astype(bool)
        repeated = np.zeros(s.n, bool)
        repeated[at[again[row]]] = True
        if level + 1 == len(steps):
            return repeated
        more = steps[level + 1] - steps[level]
        alive = s.fitting(steps[level + 1])
        alive &= repeated & np.r_[repeated[more:], np.zeros(min(more, s.n), bool)]
    return alive


def _history(rows: pa.Scalar, levels: int) -> list[dict[int, bytes]]:
    out: list[dict[int, bytes]] = [{} for _ in range(levels)]
    for r in rows.as_py() or ():
        out[r["level"]][r["part"]] = r["bits"]
    return out


def _known(batch: pa.RecordBatch, steps: list[int], levels: int, n_parts: int):
    """Each slice of a batch with the places that survived the levels done."""
    for row in range(batch.num_rows):
        ends = np.array(batch.column("ends")[row].as_py(), np.int64)
        s = Slice(batch.column("data")[row].as_py(), ends)
        found = _history(batch.column("found")[row], levels) if levels else []
        yield row, s, _survivors(s, found, steps, n_parts)


def _block_batches(batches: Iterator[pa.RecordBatch], steps: list[int], level: int, n_parts: int):
    """Window hashes of the level's candidates, a row per slice and part."""
    exact = level == len(steps) - 1
    for batch in batches:
        for row, s, alive in _known(batch, steps, level, n_parts):
            hash_, two, n, _ = s.distinct(np.flatnonzero(alive), steps[level], exact)
            parts = part_of(hash_, n_parts)
            first = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]][: len(parts)])
            if not len(first):
                continue
            last = np.r_[first[1:], len(parts)]
            low = hash_.astype(np.uint32)
            m = len(first)
            yield pa.RecordBatch.from_arrays([
                pa.array([batch.column("slice")[row].as_py()] * m, pa.int64()), pa.array(parts[first], pa.int32()),
                pa.array(np.maximum.reduceat(n, first) > 1),
                pa.array([low[a:b].tobytes() for a, b in zip(first, last)], pa.binary()),
                pa.array([two[a:b].tobytes() if exact else None for a, b in zip(first, last)], pa.binary()),
            ], names=["slice", "part", "own", "keys", "more"])


def _shared(blocks: pa.Table) -> pa.Table:
    """Of all blocks of a part: a bit per key, set where another block has it too.

    Blocks without such a key come back only if a window is repeated inside their slice.
    """
    keys = [np.frombuffer(k, np.uint32) for k in blocks.column("keys").to_pylist()]
    low = np.concatenate(keys)
    if blocks.column("more")[0].is_valid:
        two = np.concatenate([np.frombuffer(k, np.uint64) for k in blocks.column("more").to_pylist()])
        order = np.lexsort((two, low))
        same = (low[order][1:] == low[order][:-1]) & (two[order][1:] == two[order][:-1])
    else:
        order = np.argsort(low)
        same = low[order][1:] == low[order][:-1]
    again = np.zeros(len(low), bool)
    again[order] = np.r_[same, False] | np.r_[False, same]
    ends = np.cumsum([len(k) for k in keys])
    flags = np.split(again, ends[:-1])
    keep = [i for i, (f, own) in enumerate(zip(flags, blocks.column("own").to_pylist())) if own or f.any()]
    some = blocks.select(["slice", "part"]).take(pa.array(keep, pa.int64()))
    return some.append_column("bits", pa.array([np.packbits(flags[i]).tobytes() for i in keep], pa.binary()))


def _with_found(cut: DataFrame, n: int, found: DataFrame | None) -> DataFrame:
    """Slices with the bits of all levels done. The slices are in ``n`` buckets; only the bits are shuffled, to match them."""
    if found is None:
        return cut.withColumn("found", F.lit(None).cast("array<struct<level:int,part:int,bits:binary>>"))
    gathered = found.repartition(n, "slice").groupBy("slice").agg(F.collect_list(F.struct("level", "part", "bits")).alias("found"))
    return cut.join(gathered.hint("shuffle_hash"), "slice", "left")


def _result_batches(batches: Iterator[pa.RecordBatch], steps: list[int], levels: int, n_parts: int):
    done = levels == len(steps)
    for batch in batches:
        for row, s, alive in _known(batch, steps, levels if done else 0, n_parts):
            covered = np.zeros(s.n + 1, np.int64)
            if done:
                at = np.flatnonzero(alive)
                np.add.at(covered, at, 1)
                np.subtract.at(covered, at + steps[-1], 1)
            gone = np.cumsum(covered[: s.n]) > 0
            data, ends = batch.column("data")[row].as_py(), batch.column("ends")[row].as_py()
            n_words, n_removed, spans, kept, begin = [], [], [], [], 0
            edges = np.r_[s.first, s.n]
            for i, end in enumerate(ends):
                mine = gone[edges[i] : edges[i + 1]]
                text = data[begin:end].split()
                edge = np.flatnonzero(np.diff(np.r_[False, mine, False].astype(np.int8)))
                spans.append([{"first": a, "last": b} for a, b in zip(edge[0::2].tolist(), (edge[1::2] - 1).tolist())])
                kept.append(b" ".join(compress(text, (~mine).tolist()) if len(edge) else text))
                n_words.append(len(text))
                n_removed.append(int(mine.sum()))
                begin = end
            yield pa.RecordBatch.from_arrays([
                batch.column("ids")[row].values, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                pa.array(kept, pa.binary()).cast(pa.string()),
            ], names=["id", "n_words", "n_removed", "removed", "kept"])


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, first: int = FIRST,
    slice_bytes: int = SLICE, bucket_bytes: int = BUCKET, part_size: int = PART,
) -> DataFrame:
    """Every document without the words of windows that also start anywhere else, in any document or its own.

    Gives ``id``, ``n_words``, ``n_removed``, ``removed`` (spans of removed words, from 0, both ends included)
    and ``kept``, the words that stay, joined by one blank. Windows are judged on the input.

    Null texts count as empty; texts without words or shorter than a window lose nothing. Rows with one id, or none,
    are documents of their own, so a row that is repeated loses its windows as any copy does. An empty table gives an
    empty result. Other columns are not read.
    """
    if window < 1:
        raise ValueError("a window has one word at least")
    steps = lengths(window, first)
    cut, n_buckets = slices(docs, id_col, text_col, slice_bytes, bucket_bytes)
    total = cut.agg(F.sum("n_words")).first()[0] or 0
    n_parts = max(1, -(-total // part_size))
    found, levels = None, 0
    for level in range(len(steps)):
        named = _with_found(cut, n_buckets, found).mapInArrow(
            partial(_block_batches, steps=steps, level=level, n_parts=n_parts), BLOCKS
        )
        # a task for each part, however many there are
        bits = stored(named.repartition(n_parts, "part").groupBy("part").applyInArrow(_shared, FOUND).withColumn("level", F.lit(level)), f"level{level}")
        if bits.isEmpty():  # no candidate survives
            break
        found, levels = bits if found is None else found.unionByName(bits), level + 1
    last = partial(_result_batches, steps=steps, levels=levels, n_parts=n_parts)
    return _with_found(cut, n_buckets, found).mapInArrow(last, RESULT)
