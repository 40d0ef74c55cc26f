"""Log text scans. Each gives ``value`` (the line) and ``file_path``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _with_path(df: DataFrame) -> DataFrame:
    return df.select("value", F.col("_metadata.file_path").alias("file_path"))


def scan_log_tree(spark: SparkSession, root: str, file_filter: str | None = None) -> DataFrame:
    """All lines of all files below ``root``, at any depth.

    Any Hadoop URI works. Small files are packed into tasks by the scan itself
    (``spark.sql.files.maxPartitionBytes`` and ``openCostInBytes``), so no
    repartition follows. Partition-like folder names add no columns.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    if file_filter:
        reader = reader.option("pathGlobFilter", file_filter)
    return _with_path(reader.text(root))


def scan_log_glob(spark: SparkSession, *patterns: str) -> DataFrame:
    """Lines of the files that match the given path patterns."""
    return _with_path(spark.read.text(list(patterns)))


def scan_log_blocks(spark: SparkSession, root: str) -> DataFrame:
    """Tree scan that keeps line order: adds ``block_start`` and ``line_order``.

    Spark cuts a file into blocks and reads each block front to back in one
    task. ``line_order`` grows within a block, ``block_start`` orders the blocks
    of a file, so the two give the order of a file's lines without reading any
    file as a whole.
    """
    return (
        spark.read.option("recursiveFileLookup", "true").text(root)
        .select(
            "value",
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_block_start").alias("block_start"),
            F.monotonically_increasing_id().alias("line_order"),
        )
    )
