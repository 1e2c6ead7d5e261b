"""Relational steps: first per group, nesting, merges, deletes, checkpoints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import shared


def first_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per group, the first in order. Spark puts a group limit before the shuffle, so each task sends one row a group."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def nest(parents: DataFrame, children: DataFrame, key: str, fields: list[str], name: str) -> DataFrame:
    """Left join with the children of each parent as a sorted array of structs (empty where there are none)."""
    lists = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    return parents.join(lists, key, "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new whose key is not in old are appended; of several with one key, one is."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new replaces old by key: an anti-join and a union, one shuffle of each side."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def delete_cascade(tables: dict[str, DataFrame], root: str, gone: DataFrame, links: list[tuple[str, str, str]]) -> dict[str, DataFrame]:
    """Delete rows of root, and rows of children whose parent went: links are (parent, child, key), parents first."""
    lost = {root: gone}
    out = dict(tables)
    for parent, child, key in links:
        lost[child] = tables[child].join(lost[parent].select(key).distinct(), key, "left_semi")
    for name, rows in lost.items():
        keys = rows.columns if name == root else tables[name].columns
        if name == root:
            out[name] = tables[name].join(rows, keys, "left_anti")
        else:
            parent, key = next((p, k) for p, c, k in links if c == name)
            out[name] = tables[name].join(lost[parent].select(key).distinct(), key, "left_anti")
    return out


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """df stored in ranges of the order, with the range's number, __range: a run of equal leading columns, however long, is as many ranges as it needs."""
    return shared.stored(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranges")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add the place of each row in order, from 0 (ties in any order).

    Rows are dealt into ranges of the order, stored with the range's number, and numbered inside it; what comes before a range is
    a sum over one row a range.
    """
    dealt = _ranged(df, order)
    counts = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    before = counts.select("__range", (F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    placed = dealt.withColumn("__place", place).join(F.broadcast(before), "__range")
    return placed.select(*df.columns, (F.col("__before") + F.col("__place")).alias(name))


def running_total(df: DataFrame, value: str, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Add the sum of a column over a key's rows up to each, in order (null is nothing). A key with a third of all rows is many ranges: sums inside them, and over one row a key and
    range before them."""
    dealt = _ranged(df, [*keys, *order])
    sums = dealt.groupBy(*keys, "__range").agg(F.sum(value).alias("__sum"))
    upto = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    base = shared.stored(sums.select(*keys, "__range", F.sum("__sum").over(upto).alias("__base")), "range-sums")
    inside = F.sum(value).over(Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    on = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in [*keys, "__range"]]
    met = dealt.withColumn("__inside", inside).alias("x").join(base.alias("y"), reduce(lambda a, b: a & b, on), "left")
    return met.select(*[F.col(f"x.`{c}`") for c in df.columns], F.coalesce(F.col("__base") + F.col("__inside"), F.col("__inside"), F.col("__base")).alias(name))


def last_known(df: DataFrame, value: Column, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Add the last value that isn't null among a key's rows up to each, in order; ranges as in `running_total`."""
    dealt = _ranged(df.withColumn(name, value), [*keys, *order])
    own = Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lasts = dealt.where(F.col(name).isNotNull()).groupBy(*keys, "__range").agg(F.max_by(name, F.struct(*order)).alias("__last"))
    every = dealt.select(*keys, "__range").distinct().join(lasts, [*keys, "__range"], "left")
    upto = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = shared.stored(every.select(*keys, "__range", F.last("__last", ignorenulls=True).over(upto).alias("__carried")), "range-lasts")
    met = dealt.withColumn("__inside", F.last(name, ignorenulls=True).over(own)).join(carried, [*keys, "__range"], "left")
    return met.select(*df.columns, F.coalesce("__inside", "__carried").alias(name))


def line_digests(df: DataFrame, keys: list[str], line: str, separator: str = "\n") -> DataFrame:
    """keys, sha256, lines: the hash of each key's lines in UTF-8 order, with a separator between them. A task streams the sorted lines through the hash, so a key's
    lines are never one value; a hash is sequential, so they are one task."""
    fields = [df.schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField("sha256", T.StringType()), T.StructField("lines", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, made, n = None, hashlib.sha256(), 0
        for batch in batches:
            for *key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != current:
                    if n:
                        yield pa.RecordBatch.from_pydict(dict(zip(arrow.names, ([x] for x in (*current, made.hexdigest(), n)), strict=True)), schema=arrow)
                    current, made, n = key, hashlib.sha256(), 0
                made.update(((separator if n else "") + text).encode())
                n += 1
        if n:
            yield pa.RecordBatch.from_pydict(dict(zip(arrow.names, ([x] for x in (*current, made.hexdigest(), n)), strict=True)), schema=arrow)

    dealt = df.where(F.col(line).isNotNull()).select(*keys, F.col(line).alias("__line")).repartition(*keys).sortWithinPartitions(*keys, "__line")
    return dealt.mapInArrow(run, schema)


def batches(df: DataFrame, size: int, order: list[str]) -> DataFrame:
    """Add batch: rows numbered in order, `size` a batch (ties in any order)."""
    return numbered(df, order, "__number").withColumn("batch", F.floor(F.col("__number") / size).cast("int")).drop("__number")


def content_digest(df: DataFrame) -> str:
    """A digest of the rows, whatever their order and partitions, copies counted: number, and sums of two hashes of each. Sums are merged as counts are. Names and types
    are part of it; columns in another order are not."""
    names = sorted(df.columns)
    plain = [F.to_json(F.struct(F.col(f"`{c}`").alias("c"))) if "map<" in dict(df.dtypes)[c] else F.col(f"`{c}`") for c in names]
    # A hash passes over nulls; which columns are null is hashed with the rest.
    nulls = F.concat_ws("", *[F.col(f"`{c}`").isNull().cast("int").cast("string") for c in names])
    sums = [F.coalesce(F.sum(F.xxhash64(F.lit(seed), nulls, *plain).cast("decimal(20,0)")), F.lit(0)).cast("string").alias(f"s{seed}") for seed in (1, 2)]
    told = df.agg(F.count("*").cast("string").alias("n"), *sums).first()
    shape = ",".join(f"{n}:{t}" for n, t in sorted(df.dtypes))
    return hashlib.sha256("|".join([shape, *told]).encode()).hexdigest()[:32]


def checkpointed(spark: SparkSession, folder: str, stage: str, inputs: str | DataFrame | list[DataFrame], make) -> DataFrame:
    """The stage's table for these inputs: read if it is there, else made and written. The path is stage / hash of inputs; inputs are the tables themselves, by their content
    (`content_digest`), or a name that stands for them."""
    name = inputs if isinstance(inputs, str) else "|".join(content_digest(df) for df in ([inputs] if isinstance(inputs, DataFrame) else inputs))
    path = f"{folder}/{stage}/{hashlib.sha256(name.encode()).hexdigest()[:16]}"
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def validate(df: DataFrame, column: str, schema: str, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined) rows of a JSON column: `parsed` by the schema, and `errors`, the names of the rules that do not
    hold; text that is no JSON of the schema has the error "unreadable". A rule that is null doesn't hold."""
    made = df.withColumn("parsed", F.from_json(F.col(column), f"{schema}, __corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"}))
    unreadable = F.col("parsed").isNull() | F.col("parsed.__corrupt").isNotNull()
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules.items()]))
    judged = made.withColumn("errors", F.when(unreadable, F.array(F.lit("unreadable"))).otherwise(broken))
    return judged.where(F.size("errors") == 0).drop("errors"), judged.where(F.size("errors") > 0).drop("parsed")


def first_listed(df: DataFrame, by: list[str], item: str, order: list[Column | str], most: int, name: str) -> DataFrame:
    """by, and the first `most` items in order as an array: no more than these of a group ever meet."""
    numbered = df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= most)
    return numbered.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", item))), lambda x: x[item]).alias(name))
