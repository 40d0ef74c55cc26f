"""What several operators share: tables, text batches, splits by checksum, stored steps."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.sources.scratch import new_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, k: int) -> Column:
    """crc32 of a column as text, modulo k; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % k


def held_out(column: str, k: int, r: int) -> Column:
    """Whether the remainder is r. A null id is not held out."""
    return F.coalesce(remainder(column, k) == r, F.lit(False))


def text_bytes(column: str = "text") -> Column:
    """A text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def free_name(columns: list[str], name: str) -> str:
    """The name, or one with more underscores if there is such a column."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def keeping(docs: DataFrame, keep: list[str], text_col: str) -> tuple[DataFrame, str]:
    """Columns to keep, with the text's bytes behind them as the last one; and the kept ones' schema."""
    kept = docs.select(*[f"`{c}`" for c in keep])
    columns = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema)
    last = free_name(keep, "_bytes")
    return docs.select(*[f"`{c}`" for c in keep], text_bytes(text_col).alias(last)), columns


@contextmanager
def short_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run inside hand tasks at most so many rows at a time: a batch of long texts is large
    in the JVM, on its way, and in Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: computed once, free of its lineage.

    Lost executors cost nothing then: the files are not on their disks.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pieces_of(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of a binary column each, one row at least.

    A row is never cut: a long text is a slice of its own.
    """
    ends = np.r_[0, np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))]
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + most, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last
