"""Language ID by string kernels.

The kernel of two texts is the number of distinct character n-grams that both hold, for n from 1 to 3
together (a blended spectrum of presence), over the geometric mean of their own numbers.
A bounded sample gives the landmarks, and the n-grams of the landmarks are the kernel's space. Kernel values
with the landmarks, turned by the inverse root of the landmarks' own kernel matrix, are the
Nyström features; a ridge regression per language against the rest is fitted on them. All
this is linear in the presence vector, so the products with the landmarks are folded into one
matrix, and a batch of texts is scored by a single matrix product.

Characters are code points without case. All ASCII but the letters is one separator; every other character
stands for itself. N-grams are hashed into ``SPACE`` columns for each n, where two may share a column.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.llm.common import keeping
from waybill.llm.samples import own_label_sample

PER_LABEL = 400
MOST = 4000  # training texts in all
LANDMARKS = 160  # one for each language at least
RIDGE = 1e-2
SPACE = 1 << 18  # columns of the n-grams of one length
BATCH = 64  # texts of one matrix product
UNKNOWN = "und"


def characters(text: bytes) -> np.ndarray:
    """The code points of a text without case; ASCII other than letters is 0."""
    points = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    ascii_other = (points < 97) | ((points > 122) & (points < 128))
    return np.where(ascii_other, 0, points).astype(np.uint64)


def present(text: bytes, room: np.ndarray) -> None:
    """Mark the n-grams of a text in ``room``, an array of 3 * SPACE flags."""
    gram = one = characters(text)
    for n in range(3):
        if n:
            gram = (gram[:-1] << np.uint64(21)) | one[n:]
        mixed = gram * np.uint64(0x9E3779B97F4A7C15)
        room[n * SPACE + ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(46)).astype(np.int64)] = True


def presence(texts: list[bytes], columns: np.ndarray) -> np.ndarray:
    """Which of the n-grams ``columns`` each text holds, as a matrix of 0 and 1."""
    room = np.zeros(3 * SPACE, bool)
    out = np.empty((len(texts), len(columns)), np.float32)
    for i, text in enumerate(texts):
        room[:] = False
        present(text, room)
        out[i] = room[columns]
    return out


@dataclass(frozen=True)
class Model:
    labels: tuple[str, ...]
    columns: np.ndarray
    weights: np.ndarray  # n-grams by labels
    bias: np.ndarray

    def values(self, texts: list[bytes]) -> np.ndarray:
        """The regression value of each text and label, about -1 to 1."""
        x = presence(texts, self.columns)
        n = np.maximum(x.sum(axis=1), 1)
        return (x @ self.weights) / np.sqrt(n)[:, None] + self.bias


def fit(texts: list[bytes], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """One-versus-rest kernel ridge regression on Nyström features; None without texts."""
    if not texts:
        return None
    names = sorted(set(labels))
    by_name = {name: [i for i, x in enumerate(labels) if x == name] for name in names}
    turns = [i for r in range(max(map(len, by_name.values()))) for name in names for i in by_name[name][r : r + 1]]
    marks = turns[: max(landmarks, len(names))]  # the sample's order is that of a hash
    room = np.zeros(3 * SPACE, bool)
    for i in marks:
        present(texts[i], room)
    columns = np.flatnonzero(room)

    def scaled(some: list[bytes]) -> np.ndarray:
        x = presence(some, columns)
        return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))

    mark_rows = scaled([texts[i] for i in marks])
    values, vectors = np.linalg.eigh((mark_rows @ mark_rows.T).astype(np.float64))
    kept = values > 1e-6 * values.max(initial=1e-6)
    turn = vectors[:, kept] / np.sqrt(values[kept])
    features = np.concatenate([
        scaled(texts[a : a + BATCH]) @ mark_rows.T for a in range(0, len(texts), BATCH)
    ]).astype(np.float64) @ turn
    target = np.where(np.array(labels)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    # each label weighs the same
    weight = np.array([1 / len(by_name[x]) for x in labels])[:, None] * len(texts) / len(names)
    mean, goal = (features * weight).mean(axis=0), (target * weight).mean(axis=0)
    centred = features - mean
    gram = centred.T @ (centred * weight) + ridge * len(texts) * np.eye(features.shape[1]) / 100
    solved = np.linalg.solve(gram, centred.T @ ((target - goal) * weight))
    weights = (mark_rows.T.astype(np.float64) @ (turn @ solved)).astype(np.float32)
    return Model(tuple(names), columns, weights, (goal - mean @ solved).astype(np.float32))


def has_letter(text: bytes) -> bool:
    return bool(re.search(rb"[A-Za-z]", text)) or any(c.isalpha() for c in text.decode())


def _predict_batches(batches: Iterator[pa.RecordBatch], shared, names: tuple[str, str]):
    model = Model(*shared.value) if shared.value else None
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        for at in range(0, len(texts), BATCH):
            part = texts[at : at + BATCH]
            label, score = [UNKNOWN] * len(part), np.zeros(len(part))
            if model:
                values = model.values(part)
                best = values.argmax(axis=1)
                for i, text in enumerate(part):
                    if has_letter(text):
                        label[i] = model.labels[best[i]]
                        score[i] = min(1.0, max(0.0, (float(values[i, best[i]]) + 1) / 2))
            kept = batch.columns[:-1]
            yield pa.RecordBatch.from_arrays(
                [*(c.slice(at, len(part)) for c in kept), pa.array(label), pa.array(score)],
                names=[*batch.schema.names[:-1], *names],
            )


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    per_label: int = PER_LABEL, most: int = MOST,
) -> Model | None:
    """Fit on a bounded sample of ``docs`` (see ``samples``): about ``per_label`` texts of each language, ``most`` in all."""
    sample = own_label_sample(docs, id_col, F.col(lang_col).cast("string"), text_col, per_label, most)
    return fit(sample.column("text").to_pylist(), sample.column("label").to_pylist())


def predict(
    docs: DataFrame, model: Model | None, keep: list[str], text_col: str = "text",
    names: tuple[str, str] = ("lang_pred", "score"),
) -> DataFrame:
    """The columns ``keep`` with the language and the score (0 to 1) of every text, as ``names``; only the text is looked at.

    A null text, or one without a letter, is ``und`` with score 0, as is every text where nothing
    was learned. Each row gives a row, repeated ones and null ids too. ``names`` must not be kept columns'.
    """
    parts = (model.labels, model.columns, model.weights, model.bias) if model else None
    shared = docs.sparkSession.sparkContext.broadcast(parts)  # n-grams of the landmarks by languages: 3 * SPACE rows at most
    rows, columns = keeping(docs, keep, text_col)
    step = partial(_predict_batches, shared=shared, names=names)
    return rows.mapInArrow(step, columns + f"`{names[0]}` string, `{names[1]}` double")
