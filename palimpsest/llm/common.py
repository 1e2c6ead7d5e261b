"""Shared helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import fresh_dir, shared_dir, stored

__all__ = ["REST", "WHITE", "fresh_dir", "materialise", "null_safe_key", "pack_rest", "shared_dir", "split_copies", "table", "text_of", "unpack_rest"]

#: The bytes a contract calls white space: [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, so a lost executor costs
    no recomputation and a table used twice is computed once."""
    return stored(df, name)


def split_copies(df: DataFrame, key: str, most: int) -> DataFrame:
    """df with other values of `key`, a hash of a row's content, for rows of which more than `most` share it: each row its own.

    Such rows are equal in all that matters, so it makes no difference which of them gets which value; the values are the same in every run. Rows
    are counted by key and by the partition in which they are stored, and numbered inside these, so that no task gets a whole group."""
    repeated = materialise(df.groupBy(key).agg(F.count("*").alias("__copies")).where(F.col("__copies") > most).select(key), "repeated-keys")
    if repeated.isEmpty():
        return df
    stored = materialise(df.join(repeated, key, "left_semi").withColumn("__part", F.spark_partition_id()), "repeated-rows")
    counts = stored.groupBy(key, "__part").agg(F.count("*").alias("__n"))
    before = counts.select(key, "__part", (F.sum("__n").over(Window.partitionBy(key).orderBy("__part")) - F.col("__n")).alias("__before"))
    nth = F.col("__before") + F.row_number().over(Window.partitionBy(key, "__part").orderBy("__part"))
    own = stored.join(before, [key, "__part"]).withColumn("__nth", nth).withColumn(key, F.when(F.col("__nth") == 1, F.col(key)).otherwise(F.xxhash64(F.lit(31), key, "__nth")))
    return df.join(repeated, key, "left_anti").select(*df.columns).unionByName(own.select(*df.columns))


REST = "__rest"


def pack_rest(df: DataFrame, *keep: str) -> DataFrame:
    """The columns in `keep`, and all others as one struct named `REST`, so that no name of theirs can clash."""
    rest = [c for c in df.columns if c not in keep]
    fields = [F.col(_quoted(c)).alias(f"c{i}") for i, c in enumerate(rest)] or [F.lit(None).cast("int").alias("none")]
    return df.select(*keep, F.struct(*fields).alias(REST))


def unpack_rest(columns: list[str], *keep: str, instead: dict[str, Column] | None = None) -> list[Column]:
    """What selects `columns`, in their order, from a table made by `pack_rest`; `instead` has new values by name."""
    place = {c: f"{REST}.c{i}" for i, c in enumerate(c for c in columns if c not in keep)}
    return [(instead or {}).get(c, F.col(place.get(c, c))).alias(c) for c in columns]


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_of(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def null_safe_key(name: str) -> Column:
    """A never-null string that differs for null and every string; null sorts last."""
    return F.when(F.col(name).isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), F.col(name).cast("string")))
