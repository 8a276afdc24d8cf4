"""Tables that are written to the folder that driver and executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own where it is unset on a local master (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="quaymark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def file_of(spark: SparkSession, path: str) -> tuple:
    """A path and its file system, as Hadoop sees them."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/quaymark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Have `path` deleted when the driver's JVM ends, whether or not the session was stopped before."""
    p, fs = file_of(spark, path)
    fs.deleteOnExit(p)


def keep(df: DataFrame, name: str, compression: str = "snappy", by: str | None = None) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it again: cuts the lineage, survives lost executors.

    The files go when the driver ends, or with `discard`.  `by`: a column by whose values the files are divided (see `discard_part`).
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=compression, partitionBy=by)
    delete_at_end(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out
