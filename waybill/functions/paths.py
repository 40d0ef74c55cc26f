"""Column expressions that read identifiers out of file paths.

``.../application_<cluster>_<number>/container_<cluster>_<number>_<attempt>_<no>.log``

All identifiers stay strings: application numbers have leading zeros.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The identifier grammar.
APPLICATION = r"(application_\d+_\d+)"
CLUSTER = r"application_(\d+)_\d+"
APP_NUMBER = r"application_\d+_(\d+)"
CONTAINER = r"(container_\d+_\d+_\d+_\d+)"
MASTER_NO = "000001"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def application_id(path: Column | str = "file_path") -> Column:
    return F.regexp_extract(_col(path), APPLICATION, 1)


def cluster_id(application: Column | str = "application_id") -> Column:
    return F.regexp_extract(_col(application), CLUSTER, 1)


def app_number(application: Column | str = "application_id") -> Column:
    return F.regexp_extract(_col(application), APP_NUMBER, 1)


def container_id(path: Column | str = "file_path") -> Column:
    return F.regexp_extract(_col(path), CONTAINER, 1)


def container_role(container: Column | str = "container_id") -> Column:
    """Container 000001 runs the application master, the others executors."""
    c = _col(container)
    return (
        F.when(c == "", F.lit(""))
        .when(F.substring_index(c, "_", -1) == MASTER_NO, F.lit("application_master"))
        .otherwise(F.lit("executor"))
    )


def cluster_start_time(cluster: Column | str = "cluster_id") -> Column:
    """Cluster ids are epoch milliseconds of the resource manager's start (UTC)."""
    millis = _col(cluster).try_cast("bigint")
    return F.timestamp_add(
        "MILLISECOND", millis, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    )


def with_application_ids(df, path: str = "file_path"):
    """Add ``application_id``, ``cluster_id`` and ``app_number``."""
    app = application_id(path)
    return df.select(
        "*",
        app.alias("application_id"),
    ).select(
        "*",
        cluster_id().alias("cluster_id"),
        app_number().alias("app_number"),
    )
