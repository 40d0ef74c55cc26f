"""Files of a tree by what their names and the listing tell; no file is opened."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_file_metadata(spark: SparkSession, root: str, file_filter: str | None = None) -> DataFrame:
    """``file_path``, ``length`` (bytes) and ``modified_at`` of every file below ``root``, empty files included.

    Any Hadoop URI works. The rows come from the listing that a scan makes anyway: the content column of the file
    source is never asked for, so nothing is read. A scan leaves out empty files; their names stand in the
    listing and are added here, with length 0 and no time. Names that begin with ``_`` or ``.`` are hidden, as in every scan.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if file_filter:
        reader = reader.option("pathGlobFilter", file_filter)
    files = reader.load(root)
    known = files.select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_size").alias("length"),
        F.col("_metadata.file_modification_time").alias("modified_at"),
    )
    return _listed(files).join(known, "file_path", "left").select(
        "file_path", F.coalesce("length", F.lit(0)).alias("length"), "modified_at"
    )


def _listed(files: DataFrame) -> DataFrame:
    """Names of all files of a scan; they go from the listing into the plan inside the JVM."""
    spark = files.sparkSession
    jvm = spark._jvm
    names = jvm.scala.jdk.javaapi.CollectionConverters.asJava(jvm.scala.Predef.genericWrapArray(files._jdf.inputFiles()))
    listed = spark._jsparkSession.createDataset(names, jvm.org.apache.spark.sql.Encoders.STRING())
    # as a scan spells a path: no empty host
    return DataFrame(listed.toDF(), spark).select(F.regexp_replace("value", "^([^:/]+):///", "$1:/").alias("file_path"))


def create_empty(spark: SparkSession, path: str) -> None:
    """Make an empty file, as a program does that has opened its log and said nothing."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target).close()
