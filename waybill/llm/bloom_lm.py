"""Language-model scoring with a log-frequency Bloom filter.

Counts of word pairs are quantised on a logarithmic scale. A key with level q is put into the filter
as (key, 1) to (key, q); its level is read back by probing 1, 2, ... until a probe fails. Three numbers
of a word (its count, its distinct followers, the sum of its pairs) have a finer scale: the octave of the
count is read back in the same way, each of the ``FINE_BITS`` bits that divide the octave by one probe more,
and the other two numbers as what differs from the count, which is nothing for most words.
The model is a pair model with absolute discounting, whose numbers all come from such probes:

    P(w | h) = (max(c(h, w) - D, 0) + D * T(h) * P(w)) / S(h),   P(w) = (c(w) + 1) / (N + V + 1)

with T(h) the distinct followers of h, S(h) the sum of c(h, w) over them, D = n1 / (n1 + 2 n2) from all
pairs seen once and twice, and P(w | h) = P(w) for an unseen h. A text's first word has a start mark as h,
and an end mark is its last token.

S and N are sums of quantised counts; T is rounded down and S up. So the probabilities behind any h add up to
no more than 1, and to no less than 0.96, but for what a Bloom filter adds: a pair that is not in it is taken
for one that came once with a probability of about a hundredth.

The filter is made of parts. Keys are dealt to parts by hash, the followers of a word over the more
parts the more often it comes; a task makes the bits of whole parts, and no bits are merged. Its size grows with the corpus, so it is broadcast in
segments of ``SEGMENT_BYTES`` at most: a pass over the texts probes one segment and keeps the levels
found so far, seven bytes a token, most of them zero until the last segments; the last pass adds up the logarithms. Nothing is pruned.

The exact add-one score of single words, given beside it, takes frequent words from a broadcast
table of at most ``HEAD_ROWS`` counts, and joins the counts of the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.llm import words
from waybill.llm.common import pieces_of, short_batches, stored, text_bytes
from waybill.llm.words import mixed
from waybill.sources.scratch import new_folder, remove

HEAD_ROWS = 1 << 19
SEGMENT_BYTES = 128 << 20
BITS_PER_ENTRY = 10
PROBES = 4  # bits of a key, all in one 64-bit word
WORD_BITS_PER_ENTRY = 12
BASE = 2  # the ratio of one level's counts to the next
FINE_BITS = 6  # the octave of a word's number is cut in 2^FINE_BITS steps
STEPS = (1 << FINE_BITS) - 1
FINE_LEVEL = 128  # levels from here on stand for these bits
PART_BYTES = 3 << 20  # bytes of text whose pairs are in one part
BLOCK_PARTS = 1 << 16  # parts whose sizes the driver holds together
WORD_PARTS = 16  # parts whose words a task holds together
SALTS = 16  # a word's followers are spread over so many parts, those of a hot word over more
TOKEN_BYTES = 6  # of text to a token; a word with more tokens than a part has bytes for is hot
COUNT_BYTES, SCORE_BYTES = 2 << 20, 1 << 19  # text that is looked at together
COUNT_ROWS, SCORE_ROWS = 500, 200  # texts that a task is handed at a time
# the hashes of the marks; a word's is one of 2^64
START, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
COUNT, FOLLOWERS, SUM_ABOVE, SUM_BELOW = 1, 2, 3, 4  # kinds of single-word keys
PAIRS, WORDS = 0, 1  # kinds of parts


def thresholds(base: float = BASE, largest: float = 2.0**62) -> np.ndarray:
    """The smallest count of each level: whole numbers, then growing by ``base``."""
    out = [1]
    while out[-1] < largest and len(out) < 255:
        out.append(max(out[-1] + 1, int(out[-1] * base)))
    return np.array(out, np.float64)


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(thresholds(), counts, "right").astype(np.uint8)


def counts_of() -> np.ndarray:
    """The count that stands for each level: the geometric middle of its counts, whole; 0 for level 0."""
    low = thresholds()
    return np.r_[0.0, np.rint(np.sqrt(low[:-1] * (low[1:] - 1))), low[-1]]


def codes_of(values: np.ndarray, up: bool = False) -> np.ndarray:
    """Octave (from 1) and step of whole numbers, rounded down or up, in one number; 0 for 0."""
    values = values.astype(np.int64)
    octave = np.frexp(values.astype(np.float64))[1].astype(np.int64)
    octave -= values < np.left_shift(1, np.maximum(octave - 1, 0))  # a float next to a power of two
    exponent = np.maximum(octave - 1, 0)
    step = np.where(
        exponent > FINE_BITS, values >> np.maximum(exponent - FINE_BITS, 0), values << np.maximum(FINE_BITS - exponent, 0)
    ) - (1 << FINE_BITS)
    code = np.where(values > 0, (octave << FINE_BITS) + step, 0)
    return code + (up & (values_of(code) < values))


def values_of(codes: np.ndarray) -> np.ndarray:
    """The smallest number of each code."""
    exponent, step = (codes >> FINE_BITS) - 1, codes & (1 << FINE_BITS) - 1
    return np.where(codes > 0, np.ldexp(1.0 + step / (1 << FINE_BITS), exponent), 0.0)


def _odd(n: int, factor: int) -> np.uint64:
    """n times an odd factor, modulo 2^64."""
    return np.uint64(n * factor & 0xFFFFFFFFFFFFFFFF)


def _below(x: np.ndarray, n) -> np.ndarray:
    """Scrambled values dealt evenly to 0 .. n-1 by their high bits."""
    return ((x >> np.uint64(32)) * np.uint64(n) if np.isscalar(n) else (x >> np.uint64(32)) * n) >> np.uint64(32)


def pair_keys(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Keys of pairs; of the second word 32 bits take part."""
    return mixed(h + mixed((w & np.uint64(0xFFFFFFFF)) + np.uint64(3)))


def pair_parts(h: np.ndarray, w: np.ndarray, n_parts: int, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    word, salts = hot
    n = np.full(len(h), SALTS, np.uint64)
    if len(word):
        at = np.minimum(np.searchsorted(word, h), len(word) - 1)
        n = np.where(word[at] == h, salts[at], n)
    salt = w % n + np.uint64(1)
    return _below(mixed(h ^ (salt << np.uint64(58) | salt >> np.uint64(6))), n_parts).astype(np.int32)


def word_keys(w: np.ndarray, kind: int) -> np.ndarray:
    return mixed(w + _odd(kind, 0xD1B54A32D192ED03))


def word_parts(w: np.ndarray, n_parts: int) -> np.ndarray:
    return _below(mixed(w ^ np.uint64(0x5851F42D4C957F2D)), n_parts).astype(np.int32)


def _probe(keys: np.ndarray, level: int, size) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit word of a part in which a key at a level has its bits, and these bits."""
    x = mixed(keys + _odd(level, 0x2545F4914F6CDD1D))
    bits = np.zeros(len(x), np.uint64)
    for i in range(PROBES):
        bits |= np.uint64(1) << (x >> np.uint64(6 * i) & np.uint64(63))
    return _below(x, size), bits


def _filled(entries: list[tuple[int, np.ndarray]], per_entry: int) -> bytes:
    """Bits of one part: keys at levels."""
    size = 1 + per_entry * sum(len(keys) for _, keys in entries) // 64
    held = np.zeros(size, np.uint64)
    for level, keys in entries:
        at, bits = _probe(keys, level, size)
        np.bitwise_or.at(held, at, bits)
    return held.tobytes()


def _at_levels(keys: np.ndarray, levels: np.ndarray) -> list[tuple[int, np.ndarray]]:
    return [(level, keys[levels >= level]) for level in range(1, int(levels.max(initial=0)) + 1)]


def part_bits(keys: np.ndarray, levels: np.ndarray) -> bytes:
    """The bits of one part with all its keys at all their levels."""
    return _filled(_at_levels(keys, levels), BITS_PER_ENTRY)


def word_bits(word: np.ndarray, count: np.ndarray, followers: np.ndarray, pair_sum: np.ndarray) -> bytes:
    """The bits of one part of words with the codes of their numbers; followers are no more than the count."""
    octave, step = count >> FINE_BITS, count & STEPS
    above = (pair_sum >> FINE_BITS) - octave
    entries = []
    for kind, levels, fine in (
        (COUNT, octave, step),
        (FOLLOWERS, octave - (followers >> FINE_BITS), followers & STEPS ^ step),
        (SUM_ABOVE, above, pair_sum & STEPS ^ step),
        (SUM_BELOW, -above, 0 * step),
    ):
        keys = word_keys(word, kind)
        entries += _at_levels(keys, levels)
        entries += [(FINE_LEVEL + i, keys[(fine >> i & 1) > 0]) for i in range(FINE_BITS)]
    return _filled(entries, WORD_BITS_PER_ENTRY)


class Filter:
    """Parts side by side; a part that is not here answers level 0."""

    def __init__(self, n_parts: int, kind: int, places: dict[tuple[int, int], tuple[int, int]], held: bytearray):
        self.size = np.zeros(n_parts, np.uint64)
        self.start = np.zeros(n_parts, np.uint64)
        for (k, part), (start, n) in places.items():
            if k == kind:
                self.size[part], self.start[part] = n // 8, start // 8
        self.held = np.frombuffer(held, np.uint64)

    def levels(self, keys: np.ndarray, parts: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.uint8)
        size, start = self.size[parts], self.start[parts]
        active = np.flatnonzero(size)
        level = 0
        while len(active) and level < 255:
            level += 1
            at, bits = _probe(keys[active], level, size[active])
            found = self.held[(at + start[active]).astype(np.int64)]
            active = active[(found & bits) == bits]
            out[active] = level
        return out

    def _steps(self, keys: np.ndarray, parts: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        size, start = self.size[parts], self.start[parts]
        for i in range(FINE_BITS):
            at, bits = _probe(keys, FINE_LEVEL + i, size)
            found = self.held[(at + start).astype(np.int64)]
            out |= ((found & bits) == bits).astype(np.int64) << i
        return out

    def codes(self, word: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """The codes of words' counts, followers and sums, in three rows; 0 for words that are not here."""
        out = np.zeros((3, len(word)), np.uint16)
        level = self.levels(word_keys(word, COUNT), parts)
        here = np.flatnonzero(level)
        word, parts, octave = word[here], parts[here], level[here].astype(np.int64)
        step = self._steps(word_keys(word, COUNT), parts)
        fewer, above, below = (
            self.levels(word_keys(word, kind), parts).astype(np.int64) for kind in (FOLLOWERS, SUM_ABOVE, SUM_BELOW)
        )
        out[0, here] = (octave << FINE_BITS) + step
        for row, other, kind in ((1, octave - fewer, FOLLOWERS), (2, octave + above - below, SUM_ABOVE)):
            fine = step ^ self._steps(word_keys(word, kind), parts)
            out[row, here] = (np.maximum(other, 1) << FINE_BITS) + fine
        return out


@dataclass
class Tokens:
    """The tokens of some texts: hash of each, of the one before it, its text, and each text's number."""

    word: np.ndarray
    before: np.ndarray
    doc: np.ndarray
    n: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Tokens:
        data, ends = words.joined([t.lower() for t in texts])  # of bytes: A-Z
        start, end = words.spans(data)
        doc = np.searchsorted(ends, start, "right")
        n = np.bincount(doc, minlength=len(texts)) + 1
        last = np.cumsum(n) - 1
        word = np.full(n.sum(), END, np.uint64)
        word[np.arange(len(start)) + doc] = words.hashes(data, start, end)
        before = np.r_[START, word[:-1]][: len(word)]
        before[last[:-1] + 1] = START
        return cls(word, before, np.repeat(np.arange(len(texts)), n), n)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One place of each distinct pair, the pair's number at each token, and its count."""
        _, first, at, n = np.unique(
            mixed(self.before) + self.word, return_index=True, return_inverse=True, return_counts=True
        )
        return first, at, n


PACKED_COLUMNS = "kind int, part int, keys binary, runs binary, seconds binary, counts binary"


def _packed(kind: int, part: np.ndarray, key: np.ndarray, second: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """A row per part: its distinct keys, how many entries each has, and the entries in order of their keys."""
    order = np.argsort(key)
    by_part = part.astype(np.uint16) if part.max(initial=0) < 1 << 16 else part
    order = order[np.argsort(by_part[order], kind="stable")]
    part, key, second, n = part[order], key[order], second[order], n[order]
    new = np.r_[True, (part[1:] != part[:-1]) | (key[1:] != key[:-1])]
    first = np.flatnonzero(new)
    runs = np.diff(np.r_[first, len(key)]).astype(np.uint32)
    cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
    at = np.searchsorted(first, cut)
    spans, entries = list(zip(at[:-1], at[1:])), list(zip(cut[:-1], cut[1:]))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([kind] * len(spans), pa.int32()), pa.array(part[cut[:-1]].astype(np.int32)),
            pa.array([key[first[x:y]].tobytes() for x, y in spans], pa.binary()),
            pa.array([runs[x:y].tobytes() for x, y in spans], pa.binary()),
            pa.array([second[x:y].astype(np.uint32).tobytes() for x, y in entries], pa.binary()),
            pa.array([n[x:y].astype(np.uint32).tobytes() for x, y in entries], pa.binary()),
        ],
        names=["kind", "part", "keys", "runs", "seconds", "counts"],
    )


def _hot_batches(batches: Iterator[pa.RecordBatch], n_parts: int):
    """Counts of first words in each slice of texts, without those that are rare in it.

    What is left out of a word's count is less than half of what makes it hot.
    """
    for whole in batches:
        for batch in pieces_of(whole, "text", COUNT_BYTES):
            texts = batch.column("text").to_pylist()
            word, n = np.unique(Tokens.of(texts).before, return_counts=True)
            kept = 2 * TOKEN_BYTES * n_parts * n >= sum(map(len, texts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(word[kept].view(np.int64)), pa.array(n[kept].astype(np.int64))], names=["word", "n"]
            )


def hot_words(learn: DataFrame, n_parts: int, part_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """First words with more tokens than a part holds: hashes, sorted, and how many salts each has.

    All followers of a word under one salt are then a SALTS-th of a part at most. There are at most
    about three such words for each part.
    """
    if n_parts == 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    limit = max(part_bytes // TOKEN_BYTES, 2)
    counts = learn.mapInArrow(partial(_hot_batches, n_parts=n_parts), "word long, n long")
    hot = counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= limit // 2).toArrow()
    word, n = hot.column("word").to_numpy().view(np.uint64), hot.column("n").to_numpy()
    order = np.argsort(word)
    return word[order], (SALTS * (1 + (n[order] + limit // 2) // limit)).astype(np.uint64)


def _count_batches(batches: Iterator[pa.RecordBatch], n_parts: int, hot):
    """Counts of words and pairs in each slice of texts, packed by part."""
    for whole in batches:
        for batch in pieces_of(whole, "text", COUNT_BYTES):
            t = Tokens.of(batch.column("text").to_pylist())
            word, n = np.unique(t.word, return_counts=True)
            yield _packed(WORDS, word_parts(word, n_parts), word, np.zeros(len(word), np.uint32), n)
            first, _, n = t.pairs()
            h, w = t.before[first], t.word[first]
            yield _packed(PAIRS, pair_parts(h, w, n_parts, hot.value), h, w & np.uint64(0xFFFFFFFF), n)


PART_SCHEMA = pa.schema([
    ("kind", pa.int32()), ("part", pa.int32()), ("bits", pa.binary()), ("n1", pa.int64()),
    ("n2", pa.int64()), ("word", pa.int64()), ("c", pa.int64()), ("t", pa.int64()), ("s", pa.int64()),
])
PART_COLUMNS = "kind int, part int, bits binary, n1 long, n2 long, word long, c long, t long, s long"


def _part_row(kind: int, part: int, bits: bytes, **numbers: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"kind": kind, "part": part, "bits": bits, **numbers}], schema=PART_SCHEMA)


def _word_rows(kind: int, word: np.ndarray, **values: np.ndarray) -> pa.RecordBatch:
    given = {"kind": np.full(len(word), kind, np.int32), "word": word.view(np.int64), **values}
    columns = [pa.array(given[f.name]) if f.name in given else pa.nulls(len(word), f.type) for f in PART_SCHEMA]
    return pa.RecordBatch.from_arrays(columns, schema=PART_SCHEMA)


def _column(tables: list[pa.RecordBatch], name: str) -> np.ndarray:
    return np.concatenate([t.column(name).to_numpy() for t in tables])


def _part_batches(batches: Iterator[pa.RecordBatch]):
    """Rows sorted by part in, one whole part looked at at a time.

    Of words: their counts. Of pairs: the bits, and each first word's followers in the part and the sum of
    its quantised pairs.
    """
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["kind"], row["part"]) != (held[0]["kind"], held[0]["part"]):
                yield from _whole_part(held)
                held = []
            held.append(row)
    if held:
        yield from _whole_part(held)


def _whole_part(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    def joined(name, kind_of):
        return np.frombuffer(b"".join(r[name] for r in rows), kind_of)

    key = np.repeat(joined("keys", np.uint64), joined("runs", np.uint32))
    second, n = joined("seconds", np.uint32), joined("counts", np.uint32).astype(np.int64)
    entry = mixed(key) + second
    order = np.argsort(entry)
    entry = entry[order]
    first = np.flatnonzero(np.r_[True, entry[1:] != entry[:-1]])
    n = np.add.reduceat(n[order], first)
    key, second = key[order[first]], second[order[first]]
    if rows[0]["kind"] == WORDS:
        yield _word_rows(WORDS, key, c=n)
        return
    once, twice = int((n == 1).sum()), int((n == 2).sum())
    levels = levels_of(n)
    bits = part_bits(pair_keys(key, second.astype(np.uint64)), levels)
    yield _part_row(PAIRS, rows[0]["part"], bits, n1=once, n2=twice)
    word, of_word, followers = np.unique(key, return_inverse=True, return_counts=True)
    sums = np.bincount(of_word, counts_of()[levels], len(word))
    yield _word_rows(PAIRS, word, t=followers, s=sums.astype(np.int64))


def _dealt_batches(batches: Iterator[pa.RecordBatch], n_parts: int):
    for batch in batches:
        part = word_parts(batch.column("word").to_numpy().view(np.uint64), n_parts)
        yield batch.append_column("part", pa.array(part))


def _word_part_batches(batches: Iterator[pa.RecordBatch]):
    """Whole parts of words in; their bits out, with the sum of the rounded counts."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    word, c, t, s, part = (_column(held, name) for name in ("word", "c", "t", "s", "part"))
    t, s = codes_of(t), codes_of(s, up=True)
    counted, c = c > 0, codes_of(c)
    # the start mark is no token; as a history it stands for its pairs. The end mark is no history
    c, t, s = np.where(counted, c, s), np.where(t > 0, t, c), np.where(s > 0, s, c)
    word = word.view(np.uint64)
    order = np.argsort(part, kind="stable")
    for mine in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        bits = word_bits(word[mine], c[mine], t[mine], s[mine])
        whole = int(values_of(c[mine])[counted[mine]].sum())
        yield _part_row(WORDS, int(part[mine[0]]), bits, c=whole)


def _head(unigrams: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent words' hashes, sorted, and their counts: whole levels, ``rows`` at most."""
    step = F.floor(F.log2("c") * 16).cast("int")
    sizes = sorted(unigrams.groupBy(step.alias("s")).count().collect(), reverse=True)
    least, n = None, 0
    for s, k in sizes:
        n += k
        if n > rows:
            break
        least = s
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    head = unigrams.filter(step >= least).toArrow()
    word = head.column("word").to_numpy().view(np.uint64)
    order = np.argsort(word)
    return word[order], head.column("c").to_numpy()[order]


def probabilities(
    pair: np.ndarray, pair_sum: np.ndarray, followers: np.ndarray, count: np.ndarray, places: float, discount: float
) -> np.ndarray:
    """P(w | h) from the numbers of the pair, of h (``pair_sum``, ``followers``) and of w (``count``)."""
    single = (count + 1) / places
    seen = (pair_sum > 0) & (followers > 0)
    whole = np.where(seen, np.maximum(pair_sum, followers), 1.0)
    mass = np.maximum(np.minimum(pair, whole) - discount, 0)
    return np.where(seen, (mass + discount * followers * single) / whole, single)


def _in_bytes(levels: np.ndarray) -> bytes:
    """Of a text's tokens: the pairs' levels, one byte each, then the words' codes."""
    return levels[0].astype(np.uint8).tobytes() + levels[1:].tobytes()


def _unpacked(held: bytes, n: int) -> np.ndarray:
    pairs, codes = np.frombuffer(held, np.uint8, n), np.frombuffer(held, np.uint16, offset=n)
    return np.concatenate([pairs.astype(np.uint16)[None], codes.reshape(3, n)])


def _score_batches(batches: Iterator[pa.RecordBatch], shared, head, last: bool):
    """Probe one segment. The last pass gives scores, the others text and levels."""
    n_parts, total, rounded_total, n_words, discount, places, held, hot = shared.value
    pair_filter = Filter(n_parts, PAIRS, places, held)
    word_filter = Filter(n_parts, WORDS, places, held)
    head_word, head_c = head.value
    counts = counts_of()
    for whole in batches:
        for batch in pieces_of(whole, "text", SCORE_BYTES):
            t = Tokens.of(batch.column("text").to_pylist())
            first, at, _ = t.pairs()
            word, of_word = np.unique(np.r_[START, t.word], return_inverse=True)
            start, of_word = of_word[0], of_word[1:]
            of_before = np.r_[start, of_word[:-1]][: len(of_word)]
            of_before[t.before == START] = start
            h, w = t.before[first], t.word[first]
            in_part = word_parts(word, n_parts)
            c, f, s = word_filter.codes(word, in_part)
            pair = pair_filter.levels(pair_keys(h, w), pair_parts(h, w, n_parts, hot)).astype(np.uint16)
            levels = np.stack([pair[at], s[of_before], f[of_before], c[of_word]])
            held = batch.column("levels").to_pylist()
            if held and held[0] is not None:
                levels = np.maximum(levels, np.concatenate([_unpacked(x, n) for x, n in zip(held, t.n)], axis=1))
            ends = np.cumsum(t.n)
            if not last:
                codes = [_in_bytes(levels[:, b - n : b]) for b, n in zip(ends, t.n)]
                yield batch.set_column(2, "levels", pa.array(codes, pa.binary()))
                continue
            s_h, t_h, c_w = (values_of(x.astype(np.int64)) for x in levels[1:])
            p = probabilities(counts[levels[0]], s_h, t_h, c_w, rounded_total + n_words + 1, discount)
            score = np.bincount(t.doc, np.log10(np.minimum(p, 1.0)), batch.num_rows)
            # exact single-word counts
            place = np.minimum(np.searchsorted(head_word, word), max(len(head_word) - 1, 0))
            in_head = head_word[place] == word if len(head_word) else np.zeros(len(word), bool)
            log_c = np.where(in_head, np.log10(head_c[place] + 1.0) if len(head_c) else 0.0, 0.0)
            known = np.bincount(t.doc, in_head[of_word], batch.num_rows).astype(np.int64)
            base = np.bincount(t.doc, log_c[of_word], batch.num_rows)
            rare = np.flatnonzero(~in_head[of_word])
            rare_pairs, rare_n = np.unique((t.doc[rare] << 32) | of_word[rare], return_counts=True)
            offsets = np.searchsorted(rare_pairs >> 32, np.arange(batch.num_rows + 1)).astype(np.int32)

            def lists(values):
                return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))

            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"), pa.array(t.n), pa.array(score), pa.array(base), pa.array(known),
                    lists(word[rare_pairs & 0xFFFFFFFF].view(np.int64)), lists(rare_n.astype(np.int64)),
                ],
                names=["id", "n_tokens", "score", "head_base", "head_known", "rare", "rare_n"],
            )


def _segments(parts: DataFrame, most: int) -> Iterator[dict[tuple[int, int], tuple[int, int]]]:
    """Parts in groups of ``most`` bytes at most (a part alone may be no larger): start and size of each.

    One group at least. The driver looks at ``BLOCK_PARTS`` parts of each kind at a time.
    """
    largest = parts.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0]
    segment: dict = {}
    held = 0
    for first in range(0, largest + 1, BLOCK_PARTS):
        block = parts.filter(F.col("part").between(first, first + BLOCK_PARTS - 1))
        for kind, part, n in sorted(block.select("kind", "part", F.length("bits")).collect()):
            if held + n > most and segment:
                yield segment
                segment, held = {}, 0
            segment[kind, part] = (held, n)
            held += n
    yield segment


def _read_segment(parts: DataFrame, places: dict[tuple[int, int], tuple[int, int]]) -> bytearray:
    """The bits of a segment, fetched a file at a time into one buffer."""
    held = bytearray(sum(n for _, n in places.values()))
    wanted = parts.sparkSession.createDataFrame(list(places) or [(-1, -1)], "kind int, part int")
    for row in parts.join(F.broadcast(wanted), ["kind", "part"]).select("kind", "part", "bits").toLocalIterator():
        start, n = places[row.kind, row.part]
        held[start : start + n] = row.bits
    return held


def score_documents(
    docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text",
    head_rows: int = HEAD_ROWS, segment_bytes: int = SEGMENT_BYTES, part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Learn from the rows where ``training`` holds, score all rows.

    Returns ``id``, ``n_tokens`` (words and the end mark), ``n_known`` (tokens seen in training),
    ``train_tokens``, ``base_score`` (add-one, single words) and ``score`` (the model), both log10 of
    the whole text. Null text counts as empty: its one token is the end mark. Each row gives a
    row, repeated ones and null ids too. Without training rows all counts are 0 and both scores are
    those of unseen words. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    learn = docs.filter(training).select(text_bytes(text_col).alias("text"))
    n_parts = 1 + learn.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // part_bytes
    with short_batches(spark, COUNT_ROWS):
        hot = spark.sparkContext.broadcast(hot_words(learn, n_parts, part_bytes))  # 16 bytes a row
    counts = learn.mapInArrow(partial(_count_batches, n_parts=n_parts, hot=hot), PACKED_COLUMNS)
    with short_batches(spark, COUNT_ROWS):
        # as many tasks as parts need, however large the corpus; a task holds one part at a time
        by_part = counts.repartition(n_parts, "kind", "part").sortWithinPartitions("kind", "part")
        counted = stored(by_part.mapInArrow(_part_batches, PART_COLUMNS), "counts")
    unigrams = counted.filter("c IS NOT NULL").select("word", "c")
    followers = counted.filter("t IS NOT NULL").groupBy("word").agg(F.sum("t").alias("t"), F.sum("s").alias("s"))
    total, n_words = unigrams.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    words = unigrams.join(followers, "word", "full").select(
        "word", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("c", "t", "s")]
    )
    dealt = words.mapInArrow(partial(_dealt_batches, n_parts=n_parts), "word long, c long, t long, s long, part int")
    n_word_tasks = 1 + n_parts // WORD_PARTS
    word_parts_ = stored(dealt.repartition(n_word_tasks, "part").mapInArrow(_word_part_batches, PART_COLUMNS), "word-parts")
    rounded_total = word_parts_.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    parts = counted.select(word_parts_.columns).unionByName(word_parts_).filter("bits IS NOT NULL").select("kind", "part", "bits")
    n1, n2 = counted.agg(F.coalesce(F.sum("n1"), F.lit(0)), F.coalesce(F.sum("n2"), F.lit(0))).first()
    discount = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5

    head = spark.sparkContext.broadcast(_head(unigrams, head_rows))  # 16 bytes a row
    texts = docs.select(
        F.col(id_col).alias("id"), text_bytes(text_col).alias("text"), F.lit(None).cast("binary").alias("levels"),
    )
    columns, copy = f"id {kind}, text binary, levels binary", None
    segments = _segments(parts, segment_bytes)
    places, last = next(segments), False
    while not last:
        following = next(segments, None)
        last = following is None
        shared = spark.sparkContext.broadcast(
            (n_parts, total, rounded_total, n_words, discount, places, _read_segment(parts, places), hot.value)
        )
        step = partial(_score_batches, shared=shared, head=head, last=last)
        if not last:
            with short_batches(spark, SCORE_ROWS):
                path = new_folder(spark, "levels")
                texts.mapInArrow(step, columns).write.parquet(path)
            texts = spark.read.schema(columns).parquet(path)
            shared.destroy()
            if copy:
                remove(spark, copy)  # the new copy has all that was found
            copy, places = path, following
    scores = texts.mapInArrow(
        step,
        f"id {kind}, n_tokens long, score double, head_base double, head_known long, "
        "rare array<bigint>, rare_n array<bigint>",
    )
    with short_batches(spark, SCORE_ROWS):
        scored = stored(scores.withColumn("row", F.monotonically_increasing_id()), "scored")
    # all that follows reads what was written
    if copy:
        remove(spark, copy)
    shared.destroy()
    head.destroy()
    rare = (
        scored.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("r"))
        .select("row", F.col("r.rare").alias("word"), F.col("r.rare_n").alias("n"))
        .join(unigrams, "word").groupBy("row")
        .agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("base"), F.sum("n").alias("known"))
    )
    zero = F.lit(0)
    return scored.join(rare, "row", "left").select(
        "id", "n_tokens", (F.col("head_known") + F.coalesce("known", zero)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (
            F.col("head_base") + F.coalesce("base", zero)
            - F.col("n_tokens") * F.log10(F.lit(float(total + n_words + 1)))
        ).alias("base_score"),
        "score",
    )
