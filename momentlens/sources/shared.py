"""Tables between the steps of an operator, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; where the session names none, a temporary one of a local session (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: set it to a folder that the driver and all executors share")
    return (found or "file://" + tempfile.mkdtemp(prefix="momentlens-")).rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder of its own in the shared folder, removed with all it holds when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = there.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(there)
    files.deleteOnExit(there)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read again: lineage ends there, and a lost executor loses nothing."""
    path = f"{new_folder(df.sparkSession, name)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
