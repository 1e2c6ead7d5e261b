"""The folder that the driver and all executors share, and tables stored in it."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, local mode (one process, as in tests) gets a temporary folder, and a cluster an error: executors would write
    to disks of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="palimpsest-"))
        found = spark.sparkContext.getCheckpointDir()
    return found if "://" in found else f"file://{found}" if found.startswith("/") else found


def fresh_dir(spark: SparkSession, name: str = "table") -> str:
    """A new path in the shared folder, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended already
        return


def stored(df: DataFrame, name: str = "table", *by: str) -> DataFrame:
    """df written as a table in the shared folder (in folders `by` columns, if given) and read back: lineage ends there, and a table used twice is computed once."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
