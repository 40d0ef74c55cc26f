"""Where tables that outlive one query are written.

On a cluster this is the shared folder named by ``spark.checkpoint.dir``. A
folder of this machine is used in local mode only, when that setting is absent.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: tempfile.TemporaryDirectory | None = None


def _root(spark: SparkSession) -> str:
    global _local
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        if _local is None:
            _local = tempfile.TemporaryDirectory(prefix="waybill-")
        root = _local.name
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh, not yet existing folder for one written table."""
    return f"{_root(spark)}/waybill-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Compute a frame now, as Parquet in the shared folder, and read it back."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a folder that ``new_folder`` named, once its table is no longer needed.

    Other paths are refused. True if it was there.
    """
    if not path.startswith(f"{_root(spark)}/waybill-"):
        raise ValueError(f"{path} is not a folder for written tables")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Compute a frame now and keep it in the shared folder, free of its lineage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_root(df.sparkSession))
    return df.checkpoint()
