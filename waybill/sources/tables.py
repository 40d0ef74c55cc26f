"""Parquet, CSV, range and SQL sources."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.sources.sinks import CSV


def scan_parquet_many(spark: SparkSession, paths: Sequence[str], base: str | None = None) -> DataFrame:
    """One frame over several Parquet paths; ``base`` keeps partition columns."""
    reader = spark.read.option("basePath", base) if base else spark.read
    return reader.parquet(*paths)


def scan_parquet_glob(spark: SparkSession, pattern: str, base: str | None = None) -> DataFrame:
    """Parquet files that match a path pattern."""
    return scan_parquet_many(spark, [pattern], base)


def month_paths(
    root: str, year: int, months: Iterable[int], template: str = "yyyy={year}/mm={month:02d}"
) -> list[str]:
    """The path of each month of a year below ``root``."""
    return [f"{root}/{template.format(year=year, month=m)}" for m in months]


def scan_month_range(spark: SparkSession, root: str, year: int, months: Iterable[int]) -> DataFrame:
    """The given months of a ``yyyy=/mm=`` Parquet layout, other files untouched."""
    return scan_parquet_many(spark, month_paths(root, year, months), root)


def scan_csv(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """CSV with a header and a declared schema, so ids keep their leading zeros.

    A quoted empty field is an empty string, an unquoted one is null; no text is taken for null. Text that may hold
    line breaks needs ``multi_line``, which reads each file in one task.
    """
    # an unquoted empty field turns into the null mark, which must be no text of the file
    mark = uuid.uuid4().hex
    return spark.read.schema(schema).options(multiLine=multi_line, nullValue=mark, **CSV).csv(path)


def number_range(spark: SparkSession, n: int) -> DataFrame:
    """``id`` from 0 to n-1, made in parallel on the executors."""
    return spark.range(n)


def numbers_between(bounds: DataFrame) -> DataFrame:
    """``id``: the whole numbers from ``low`` to ``high`` of each row, both included."""
    return bounds.select(F.explode(F.sequence("low", "high")).alias("id"))


def even_doubled(df: DataFrame, column: str) -> DataFrame:
    """Twice every even value of a column."""
    c = F.col(column)
    return df.filter(c % 2 == 0).select((c * 2).alias("doubled"))


def count_by_sql(df: DataFrame) -> DataFrame:
    """Register a view, under a name of its own, and count it with SQL text.

    The plan is resolved at once, so the view is dropped again.
    """
    view = f"counted_{uuid.uuid4().hex}"
    df.createTempView(view)
    try:
        return df.sparkSession.sql("SELECT count(*) AS total FROM IDENTIFIER(:view)", args={"view": view})
    finally:
        df.sparkSession.catalog.dropTempView(view)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per named frame, all in one query."""
    counts = [
        df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in tables.items()
    ]
    return _union(counts)


def schema_rows(df: DataFrame) -> DataFrame:
    """Schema as rows (position, name, type) with the non-null count of each column."""
    fields = df.schema.fields
    counts = df.agg(*[F.count(F.col(f"`{f.name}`")).alias(f"c{i}") for i, f in enumerate(fields)])
    described = F.array(*[
        F.struct(
            F.lit(i + 1).alias("position"),
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"),
            F.col(f"c{i}").alias("n_values"),
        )
        for i, f in enumerate(fields)
    ])
    return counts.select(F.inline(described))


def source_health(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """One row per named Parquet path: readable or not, rows, columns, error class.

    A path that cannot be read gives a row with the error condition Spark names
    (``PATH_NOT_FOUND``) instead of an exception.
    """
    checks = []
    for name, path in paths.items():
        try:
            df = spark.read.parquet(path)
        except (PySparkException, Py4JJavaError, OSError) as e:  # what Spark or the file system reports
            condition = e.getCondition() if isinstance(e, PySparkException) else None
            bad = "source string, ok boolean, n_rows bigint, n_columns int, error_class string"
            checks.append(
                spark.createDataFrame([(name, False, None, None, condition or type(e).__name__)], bad)
            )
        else:
            checks.append(
                df.agg(F.count("*").alias("n_rows")).select(
                    F.lit(name).alias("source"),
                    F.lit(True).alias("ok"),
                    "n_rows",
                    F.lit(len(df.columns)).alias("n_columns"),
                    F.lit(None).cast("string").alias("error_class"),
                )
            )
    return _union(checks)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
