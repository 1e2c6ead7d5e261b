"""How queries are registered and tables read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task where each becomes a file or text many times its size.
SPREAD_ROWS = 2_000


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by a hash of their keys into tasks of about `SPREAD_ROWS`: a scan cuts tasks by bytes on disk, and a table of a few megabytes would be one, whatever is made of its rows."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(cores, -(-rows.count() // SPREAD_ROWS)), *map(F.col, keys))


def registry() -> tuple[dict, dict, Callable]:
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    oracle: dict[str, str] = {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracle[f.__name__] = sql
            return f

        return add

    return queries, oracle, query
