"""BPE encoding and decoding by batched merge rounds.

The symbols of all new pre-tokens of a slice of documents lie in one flat array. In each
round every pre-token merges its pair of lowest rank, wherever it occurs in it from left to right,
found by binary search over the sorted pair keys. A pre-token without a known pair is done.
Merging all places of the lowest pair at once is right, as a pair that a merge creates
always has a higher rank than that merge.

A round looks at all symbols of the pre-tokens that are not done, so a pre-token of many bytes goes another way: the
places of its pairs wait by rank, and behind a merge only the places beside it are looked up again.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.llm.pretokens import Vocabulary

CACHE_ROWS = 3 << 17  # encoded pre-tokens that a task remembers
LONGEST = 64  # bytes of a pre-token that is remembered
ROUNDS_UPTO = 1024  # bytes of a pre-token that takes part in rounds
SLICE_CHARS = 1_000_000  # characters of documents whose new pre-tokens are merged together
NONE = np.int64(1) << 40


def byte_symbols() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary: printable Latin-1
    characters for themselves, the others in order from code point 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


@dataclass(frozen=True)
class Merges:
    """A vocabulary as arrays."""

    width: int
    first: np.ndarray  # id of each byte
    keys: np.ndarray  # left * width + right, sorted
    rank: np.ndarray
    result: np.ndarray
    tokens: tuple[bytes, ...]  # what each id stands for

    def parts(self) -> tuple:
        return self.width, self.first, self.keys, self.rank, self.result, self.tokens

    @classmethod
    def load(cls, vocabulary: Vocabulary) -> Merges:
        model = json.loads(vocabulary.text)["model"]
        ids, to_byte = model["vocab"], byte_symbols()
        width = max([*ids.values(), *vocabulary.specials().values()]) + 1
        first = np.zeros(256, np.int64)
        for char, byte in to_byte.items():
            first[byte] = ids[char]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([ids[a] * width + ids[b] for a, b in pairs], np.int64)
        result = np.array([ids[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        tokens = [b""] * width
        for token, i in ids.items():
            tokens[i] = bytes(to_byte[c] for c in token)
        for token, i in vocabulary.specials().items():
            tokens[i] = token.encode()
        return cls(width, first, keys[order], order.astype(np.int64), result[order], tuple(tokens))


def _ranks(left: np.ndarray, right: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Rank (NONE if there is no merge) and result of pairs."""
    key = left * merges.width + right
    place = np.minimum(np.searchsorted(merges.keys, key), len(merges.keys) - 1)
    return np.where(merges.keys[place] == key, merges.rank[place], NONE), merges.result[place]


def _every_second(at: np.ndarray, touches: np.ndarray) -> np.ndarray:
    """Of places in order, in runs that touch (``touches``: the next place is the one behind), every second."""
    index = np.arange(len(at))
    run_start = np.maximum.accumulate(np.where(np.r_[True, ~touches], index, 0))
    return at[(index - run_start) % 2 == 0]


def merge_long(piece: bytes, merges: Merges) -> np.ndarray:
    """The ids of one piece, in time that grows with its merges and not with merges times length.

    Symbols are a linked list over the bytes' places. Places wait under the rank of the pair that begins there; the lowest
    rank is taken with all its places, and the pairs on both sides of a merge get new ranks.
    """
    n = len(piece)
    symbol = merges.first[np.frombuffer(piece, np.uint8)]
    after, ahead = np.arange(1, n + 2), np.arange(-1, n)  # place n is the end
    symbol = np.append(symbol, 0)
    rank, result = np.full(n + 1, NONE), np.zeros(n + 1, np.int64)
    waiting: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def look_up(places: np.ndarray) -> None:
        places = places[after[places] < n]
        if not len(places):
            return
        rank[places], result[places] = _ranks(symbol[places], symbol[after[places]], merges)
        places = places[rank[places] < NONE]
        places = places[np.argsort(rank[places], kind="stable")]
        cuts = np.flatnonzero(np.diff(rank[places])) + 1
        for group in np.split(places, cuts) if len(places) else ():
            r = int(rank[group[0]])
            if r not in waiting:
                waiting[r] = []
                heapq.heappush(heap, r)
            waiting[r].append(group)

    look_up(np.arange(max(n - 1, 0)))
    while heap:
        r = heapq.heappop(heap)
        at = np.concatenate(waiting.pop(r))
        at = np.unique(at[rank[at] == r])  # others were merged or have another pair by now
        if not len(at):
            continue
        at = _every_second(at, after[at[:-1]] == at[1:])
        gone = after[at]
        symbol[at] = result[at]
        rank[at] = rank[gone] = NONE
        after[at] = after[gone]
        ahead[after[gone]] = at
        # the pair that ended in a merged symbol, and the one that begins with it
        beside = np.r_[at, ahead[at]]
        beside = np.unique(beside[beside >= 0])
        rank[beside] = NONE
        look_up(beside)
    out, place = [], 0
    while place < n:
        out.append(place)
        place = int(after[place])
    return symbol[out]


def encode_pieces(pieces: list[bytes], merges: Merges) -> list[np.ndarray]:
    """The ids of each piece."""
    short = merge_rounds([p if len(p) <= ROUNDS_UPTO else b"" for p in pieces], merges)
    return [merge_long(p, merges) if len(p) > ROUNDS_UPTO else ids for p, ids in zip(pieces, short)]


def merge_rounds(pieces: list[bytes], merges: Merges) -> list[np.ndarray]:
    """The ids of each piece."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    symbols = merges.first[np.frombuffer(b"".join(pieces), np.uint8)]
    word = np.repeat(np.arange(len(pieces)), sizes)
    done: list[np.ndarray] = [np.zeros(0, np.int64)] * len(pieces)
    while len(symbols):
        key = symbols[:-1] * merges.width + symbols[1:]
        place = np.minimum(np.searchsorted(merges.keys, key), len(merges.keys) - 1)
        known = (merges.keys[place] == key) & (word[:-1] == word[1:])
        rank = np.append(np.where(known, merges.rank[place], NONE), NONE)
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        lowest = np.minimum.reduceat(rank, starts)
        n = np.diff(np.r_[starts, len(word)])
        ended = lowest == NONE
        for i in np.flatnonzero(ended):
            done[word[starts[i]]] = symbols[starts[i] : starts[i] + n[i]]
        best = np.repeat(lowest, n)
        at = np.flatnonzero((rank == best) & (rank < NONE))
        # of places that touch, as in a run of one symbol, every second is merged
        new_run = np.r_[True, np.diff(at) != 1] if len(at) else np.zeros(0, bool)
        run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - run_start) % 2 == 0]
        symbols[at] = merges.result[place[at]]
        keep = ~np.repeat(ended, n)
        keep[at + 1] = False
        symbols, word = symbols[keep], word[keep]
    return done


class Encoder:
    """Encodes texts; keeps the ids of pre-tokens it has met, up to a bound."""

    def __init__(self, vocabulary: Vocabulary, merges: Merges, most: int = CACHE_ROWS):
        self.split, self.merges, self.most = vocabulary.splitter(), merges, most
        self.specials = {s: np.uint32(i).tobytes() for s, i in vocabulary.specials().items()}
        self.known: dict[str, bytes] = dict(self.specials)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.split(t) for t in texts]
        new = list({p for pieces in split for p in pieces if p not in self.known})
        if new:
            found = encode_pieces([p.encode() for p in new], self.merges)
            self.known.update((p, ids.astype("<u4").tobytes()) for p, ids in zip(new, found))
        get = self.known.__getitem__
        out = [b"".join(map(get, pieces)) for pieces in split]
        if len(self.known) > self.most:
            self.known = dict(self.specials)
        elif new:
            for p in new:
                if len(p) > LONGEST:
                    del self.known[p]
        return out


def decode(ids: bytes, merges: Merges) -> str:
    """The text of ids; bytes that are no UTF-8 become replacement characters."""
    get = merges.tokens.__getitem__
    return b"".join(map(get, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str]]]:
    ids, texts = batch.column("id"), batch.column("text").to_pylist()
    first, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t)
        if chars >= SLICE_CHARS or i == len(texts) - 1:
            yield ids.slice(first, i + 1 - first), texts[first : i + 1]
            first, chars = i + 1, 0


def _encode_batches(batches: Iterator[pa.RecordBatch], vocabulary, merges):
    encoder = Encoder(Vocabulary(*vocabulary.value), Merges(*merges.value))
    for batch in batches:
        for ids, texts in _slices(batch):
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(encoder.encode(texts), pa.binary())], names=["id", "ids"]
            )


def _digest_batches(batches: Iterator[pa.RecordBatch], vocabulary, merges):
    encoder = Encoder(Vocabulary(*vocabulary.value), Merges(*merges.value))

    def sha(x: bytes) -> str:
        return hashlib.sha256(x).hexdigest()

    for batch in batches:
        for ids, texts in _slices(batch):
            codes = encoder.encode(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array([len(c) // 4 for c in codes], pa.int64()),
                    pa.array([sha(c) for c in codes]),
                    pa.array([sha(decode(c, encoder.merges).encode()) for c in codes]),
                ],
                names=["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _run(docs: DataFrame, path: str, id_col: str, text_col: str, step, columns: str) -> DataFrame:
    context = docs.sparkSession.sparkContext
    loaded = Vocabulary.load(path)
    # the file and its arrays: 4 MB
    shared = {
        "vocabulary": context.broadcast((loaded.text, loaded.special)),
        "merges": context.broadcast(Merges.load(loaded).parts()),
    }
    kind = docs.schema[id_col].dataType.simpleString()
    return _texts(docs, id_col, text_col).mapInArrow(partial(step, **shared), f"id {kind}, {columns}")


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``ids`` (little-endian unsigned 32-bit integers in a binary) of every document.

    Null text counts as empty and has no ids. Each row gives a row, repeated ones and null ids too.
    An empty table gives an empty result; other columns are not read.
    """
    return _run(docs, path, id_col, text_col, _encode_batches, "ids binary")


def _decode_batches(batches: Iterator[pa.RecordBatch], merges):
    loaded = Merges(*merges.value)
    for batch in batches:
        texts = [None if c is None else decode(c, loaded) for c in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])


def decode_documents(encoded: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """``id`` and ``text`` from ``ids``; null ids give null text."""
    merges = encoded.sparkSession.sparkContext.broadcast(Merges.load(Vocabulary.load(path)).parts())
    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(
        partial(_decode_batches, merges=merges), f"id {kind}, text string"
    )


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, then decode: ``id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of every document.

    Digests are lower-case hex, of the ids as little-endian 32-bit integers and of the decoded
    text in UTF-8. Rules for null and empty as in ``encode_documents``.
    """
    return _run(
        docs, path, id_col, text_col, _digest_batches,
        "n_tokens long, ids_sha256 string, decoded_sha256 string",
    )
