"""Quality classifier with supervised subword embeddings.

The features of a text are its words, a mark for each word that equals the one before it, and its
character 3- and 4-grams (of UTF-8 bytes, blanks included, over the whole text), hashed into buckets.
Each bucket has a learned vector. A text is the average of its features' vectors, together with
``NEUTRAL`` zero vectors that keep the averages of short texts small; a softmax layer gives the classes.
Vectors and layer are trained together by stochastic gradient descent in numpy, on a bounded
sample in which the classes weigh as much as among all labels of the documents given.
For scoring, each bucket's vector is multiplied with the layer once: a feature then adds one
number per class to the average, which is the same model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.llm import words
from waybill.llm.common import keeping, pieces_of
from waybill.llm.samples import labelled_sample

BUCKETS = 1 << 17
DIM = 16
EPOCHS = 6
RATE = 0.5
NEUTRAL = 64
SEED = 7
SLICE_BYTES = 2 << 20


@dataclass
class Features:
    """Bucket of every feature and the text it belongs to, by kind of feature. Bucket 0 marks repeated words."""

    buckets: list[np.ndarray]
    owner: list[np.ndarray]
    n_texts: int

    @classmethod
    def of(cls, texts: list[bytes], buckets: int = BUCKETS) -> Features:
        # a blank ends each text, so no word runs into the next one
        data, ends = words.joined(texts)
        text_of = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(np.r_[0, ends]))
        out, owner = [], []
        start, end = words.spans(data)
        value = words.hashes(data, start, end)
        out.append((1 + (value >> np.uint64(32)) % np.uint64(buckets - 1)).astype(np.int32))
        owner.append(text_of[start])
        again = 1 + np.flatnonzero((value[1:] == value[:-1]) & (owner[0][1:] == owner[0][:-1]))
        out.append(np.zeros(len(again), np.int32))
        owner.append(owner[0][again])
        wide = data.astype(np.uint32)
        for n in (3, 4):
            gram = wide[: max(len(wide) - n + 1, 0)].copy()
            for k in range(1, n):
                gram |= wide[k : len(wide) - n + 1 + k] << np.uint32(8 * k)
            whole = text_of[: len(gram)] == text_of[n - 1 :][: len(gram)]
            mixed = (gram + np.uint32(n)) * np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x85EBCA77)
            out.append((1 + (mixed >> np.uint32(8)) % np.uint32(buckets - 1)).astype(np.int32)[whole])
            owner.append(text_of[: len(gram)][whole])
        return cls(out, owner, len(texts))

    def means(self, number: np.ndarray) -> np.ndarray:
        """The mean of ``number[bucket]`` over each text's features and NEUTRAL zeros."""
        total, n = np.zeros(self.n_texts), np.zeros(self.n_texts)
        for b, o in zip(self.buckets, self.owner):
            total += np.bincount(o, number[b], self.n_texts)
            n += np.bincount(o, minlength=self.n_texts)
        return total / (n + NEUTRAL)


@dataclass(frozen=True)
class Model:
    vectors: np.ndarray
    layer: np.ndarray
    bias: np.ndarray

    def folded(self) -> tuple[np.ndarray, float]:
        """Log odds that a feature adds to class 1, and those without features."""
        return self.vectors @ (self.layer[:, 1] - self.layer[:, 0]), float(self.bias[1] - self.bias[0])


def fit(
    texts: list[bytes], labels: list[int], shares: tuple[float, float] = (1, 1),
    epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED,
) -> Model | None:
    """Train on texts with labels 0 and 1; None without texts. ``shares``: what the classes weigh in all."""
    if not texts:
        return None
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    layer, bias = np.zeros((DIM, 2)), np.zeros(2)
    rows = []
    for text in texts:
        f = Features.of([text])
        ids, n = np.unique(np.concatenate(f.buckets), return_counts=True)
        rows.append((ids, n / (n.sum() + NEUTRAL)))
    labels_ = np.asarray(labels)
    weight = np.array(shares) / sum(shares) * len(labels_) / np.maximum(np.bincount(labels_, minlength=2), 1)
    steps, step = epochs * len(texts), 0
    for _ in range(epochs):
        for i in rng.permutation(len(texts)):
            ids, share = rows[i]
            text = share @ vectors[ids]
            z = text @ layer + bias
            p = np.exp(z - z.max())
            error = p / p.sum() - (np.arange(2) == labels_[i])
            now = rate * (1 - step / steps) * weight[labels_[i]]
            # a feature's share of a text is small: its vector moves by the share over the text's sum of squares
            scale = 1 / max(float(share @ share), 1e-12) if len(ids) else 0.0
            vectors[ids] -= np.outer(share * (now * min(scale, 1000.0)), layer @ error)
            layer -= now * np.outer(text, error)
            bias -= now * 0.1 * error
            step += 1
    return Model(vectors, layer, bias)


def _score_batches(batches: Iterator[pa.RecordBatch], shared, name: str):
    odds, bias = shared.value
    for whole in batches:
        for batch in pieces_of(whole, whole.schema.names[-1], SLICE_BYTES):
            z = Features.of(batch.columns[-1].to_pylist()).means(odds) + bias
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))],
                names=[*batch.schema.names[:-1], name],
            )


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> Model | None:
    """Fit on a bounded sample (see ``labelled_sample``) of the documents that ``labels`` marks 0 or 1."""
    known = labels.select(id_col, F.col(label_col).cast("int").alias(label_col)).filter(F.col(label_col).isin(0, 1))
    sample, n = labelled_sample(docs, known, id_col, label_col, text_col)
    shares = n.get(0, 0), n.get(1, 0)
    return fit(sample.column("text").to_pylist(), sample.column("label").to_pylist(), shares)


def score(
    docs: DataFrame, model: Model | None, keep: list[str], text_col: str = "text", name: str = "score"
) -> DataFrame:
    """The columns ``keep`` with the score (0 to 1, that of class 1) of every text as ``name``; only the text is looked at.

    Null text counts as empty. A text without features has the score of the bias alone. Where nothing was
    learned every score is 0.5. Each row gives a row, repeated ones and null ids too. ``name`` must not be
    a kept column's.
    """
    folded = model.folded() if model else (np.zeros(BUCKETS), 0.0)
    shared = docs.sparkSession.sparkContext.broadcast(folded)  # BUCKETS numbers: 1 MB
    rows, columns = keeping(docs, keep, text_col)
    return rows.mapInArrow(partial(_score_batches, shared=shared, name=name), columns + f"`{name}` double")
