"""Bounded samples of labelled documents, for fitting classifiers.

A sample is all rows whose hash lies below a bound of their label. The bounds come from one aggregate of rows and bytes by
label, so no task ranks the rows of a label, and a row's chance does not depend on the length of its text.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PER_LABEL = 1500  # documents of a label, about
MOST = 6000  # documents of all labels together, about
MOST_BYTES = 64 << 20  # of all texts together, about
UNIT = 1 << 53


def shares(counts: Iterable[tuple[object, int, int]], per_label: int, most: int, most_bytes: int) -> dict[object, float]:
    """The share of each label's rows to take, given its rows and bytes.

    Labels with few rows leave what they don't use to the others.
    """
    rows = sorted(counts, key=lambda r: r[1])
    left, out = most, {}
    for i, (label, n, size) in enumerate(rows):
        quota = min(n, per_label, left / (len(rows) - i))
        left -= quota
        out[label] = min(1.0, quota / n, most_bytes / len(rows) / max(size, 1))
    return out


def drawn(rows: DataFrame, per_label: int, most: int, most_bytes: int) -> tuple[DataFrame, dict[object, int]]:
    """Of rows with ``label``, ``draw`` (a hash) and ``n_bytes``, those in the sample; and the rows of each label.

    Every label has its row with the smallest hash, whatever its share. Labels are few: a row for each comes to the driver.
    """
    stats = rows.groupBy("label").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("size"), F.min("draw").alias("first")).collect()
    share = shares([(r["label"], r["n"], r["size"]) for r in stats], per_label, most, most_bytes)
    kind = rows.schema["label"].dataType.simpleString()
    bounds = rows.sparkSession.createDataFrame(
        [(r["label"], share[r["label"]], r["first"]) for r in stats], f"label {kind}, _share double, _first long"
    )
    unit = F.pmod("draw", F.lit(UNIT)) / UNIT
    kept = rows.join(F.broadcast(bounds), "label").filter((unit < F.col("_share")) | (F.col("draw") == F.col("_first")))
    return kept.drop("_share", "_first"), {r["label"]: r["n"] for r in stats}


def _fetched(rows: DataFrame, most: int, n_labels: int) -> pa.Table:
    """Label and text of a sample in a fixed order. Rows that are equal in all share one hash, so a sample might hold
    many of them; twice the wanted number is the end."""
    return rows.orderBy("draw", "label", "text").limit(2 * most + n_labels).select(
        "label", F.col("text").cast("binary").alias("text")
    ).toArrow()


def own_label_sample(
    docs: DataFrame, key: str, label: Column, text: str, per_label: int = PER_LABEL, most: int = MOST, most_bytes: int = MOST_BYTES
) -> pa.Table:
    """``label`` and ``text`` (bytes) of a bounded sample of documents that carry their label, in a fixed order.

    Rows without label or text are not learned from. Every row has its own label and hash (of key and text), repeated keys too.
    """
    rows = docs.select(
        label.alias("label"), F.xxhash64(key, text).alias("draw"), F.octet_length(text).alias("n_bytes"), F.col(text).alias("text")
    ).filter("label IS NOT NULL AND text IS NOT NULL")
    kept, n = drawn(rows, per_label, most, most_bytes)
    return _fetched(kept, most, len(n))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, key: str, label: str, text: str,
    per_label: int = PER_LABEL, most: int = MOST, most_bytes: int = MOST_BYTES,
) -> tuple[pa.Table, dict[object, int]]:
    """``label`` and ``text`` (bytes) of a bounded sample, in a fixed order; and how many documents have each label.

    ``labels`` has the key and label of some documents; rows without key, label or text are not learned from. A
    document with several labels, or a key with several documents, counts with each. Keys and lengths alone are joined
    first; texts are fetched for the sample only.
    """
    named = labels.select(F.col(key).alias("key"), F.col(label).alias("label")).filter("label IS NOT NULL").distinct()
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text IS NOT NULL")
    sizes = texts.select("key", F.octet_length("text").alias("n_bytes"))
    kept, n = drawn(named.join(sizes, "key").withColumn("draw", F.xxhash64("key")), per_label, most, most_bytes)
    chosen = kept.select("key", "label", "draw").distinct()
    return _fetched(texts.join(F.broadcast(chosen), "key"), most, len(n)), n  # about ``most`` short rows
