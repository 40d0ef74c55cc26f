"""Token counts by a two-tier lookup on the map side.

The first tier is a table of frequent pre-tokens and the number of tokens of each, broadcast
as two buffers of bounded size. The second is a cache in each task, for pre-tokens that are
not in the table: they are encoded once and remembered. Pre-tokens are never shuffled but
for the making of the table, which a bounded sample of documents decides; the table
affects speed alone, as a miss is encoded exactly.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.llm.pretokens import Vocabulary

FREQUENT = 1 << 17  # rows of the first tier, 20 bytes each on average
SAMPLE_ROWS = 20_000  # documents that decide which pre-tokens are in the first tier
CACHE_ROWS = 3 << 17  # entries of a task's cache
LONGEST = 255  # characters of a pre-token that either tier keeps
SEPARATOR = b"\xff"  # in no UTF-8 text


def _count_batches(batches: Iterator[pa.RecordBatch], vocabulary):
    split = Vocabulary(*vocabulary.value).splitter()
    for batch in batches:
        seen: Counter = Counter()
        for text in batch.column("text"):
            seen.update(p for p in split(text.as_py()) if len(p) <= LONGEST)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())],
            names=["piece", "n"],
        )


def frequent_pieces(texts: DataFrame, vocabulary, rows: int, sample_rows: int) -> list[str]:
    """The most frequent pre-tokens of about ``sample_rows`` documents, at most ``rows``."""
    n = texts.count()
    if n > sample_rows:
        texts = texts.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(sample_rows / n * (1 << 30)))
    counted = texts.mapInArrow(partial(_count_batches, vocabulary=vocabulary), "piece string, n long")
    top = (
        counted.groupBy("piece").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "piece").limit(rows).select("piece").toArrow()
    )
    return top.column("piece").to_pylist()


class Lengths(dict):
    """Tokens per pre-token: the first tier, and what a task has encoded since."""

    def __init__(self, pieces: bytes, lengths: np.ndarray, vocabulary: Vocabulary, most: int):
        names = pieces.decode("utf-8", "surrogateescape").split("\udcff") if pieces else []
        super().__init__(zip(names, lengths.tolist()))
        self |= {s: 1 for s in vocabulary.specials()}
        self.encode = vocabulary.tokenizer().encode
        self.most, self.fixed = most + len(self), len(self)

    def __missing__(self, piece: str) -> int:
        n = len(self.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= LONGEST:
            if len(self) >= self.most:  # forget what the task has learned, keep the first tier
                for key in list(self)[self.fixed :]:
                    del self[key]
            self[piece] = n
        return n


def _length_batches(batches: Iterator[pa.RecordBatch], vocabulary, table, most: int):
    pieces, lengths = table.value
    loaded = Vocabulary(*vocabulary.value)
    known = Lengths(pieces, lengths, loaded, most)
    split, get = loaded.splitter(), known.__getitem__
    for batch in batches:
        n = [sum(map(get, split(text.as_py()))) for text in batch.column("text")]
        bytes_ = [len(text.as_buffer()) if text.is_valid else 0 for text in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(bytes_, pa.int64()), pa.array(n, pa.int64())],
            names=["id", "n_bytes", "n_tokens"],
        )


def token_counts(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
    frequent: int = FREQUENT, sample_rows: int = SAMPLE_ROWS, cache_rows: int = CACHE_ROWS,
) -> DataFrame:
    """``id``, ``n_bytes`` (UTF-8) and ``n_tokens`` of every document, as the library counts them.

    Null text counts as empty: no bytes, no tokens. Each row gives a row, repeated ones and null
    ids too. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    loaded = Vocabulary.load(path)
    vocabulary = spark.sparkContext.broadcast((loaded.text, loaded.special))  # the file's text, 1.5 MB
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pieces = frequent_pieces(texts, vocabulary, frequent, sample_rows)
    encode = loaded.tokenizer().encode_batch
    lengths = np.array([len(e.ids) for e in encode(pieces, add_special_tokens=False)], np.uint32)
    # at most ``frequent`` pieces of LONGEST characters
    table = spark.sparkContext.broadcast((SEPARATOR.join(p.encode() for p in pieces), lengths))
    return texts.mapInArrow(
        partial(_length_batches, vocabulary=vocabulary, table=table, most=cache_rows),
        f"id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long",
    )
