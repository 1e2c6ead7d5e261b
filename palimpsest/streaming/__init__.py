"""Progress events as streams: latest state, idempotent enqueue, windows.

`drain` runs a streaming DataFrame over all that its source holds and returns what it put out as a table in the shared folder
(spark.checkpoint.dir; no row passes through the driver), so that a stream can be used as a query; a service starts the same DataFrame with its own sink and trigger.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import fresh_dir


def events_stream(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    """The event table as a file stream, its time as an instant."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


#: State stores that timers and typed state need.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drain(stream: DataFrame, mode: str, keys: list[str] | None = None, path: str | None = None, typed_state: bool = False) -> DataFrame:
    """Run the stream over what its source holds now, and give what it has put out.

    append: the rows of all batches; complete: those of the last one; update: the last row of each of `keys`. Every batch is a folder named by its number, so that
    a batch that is run again replaces its own rows. With a `path` a later call goes on where this one stopped.
    """
    spark = stream.sparkSession
    path = path or fresh_dir(spark, "drained")

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")

    start = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}/progress").outputMode(mode).trigger(availableNow=True)
    with state_store(spark, ROCKS if typed_state else None):
        query = start.start()
    query.awaitTermination()
    return drained(spark, path, stream.schema, mode, keys)


def drained(spark: SparkSession, path: str, schema: T.StructType, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """What `drain` has put out at a path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rows")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{path}/rows")
    if mode == "complete":
        return rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch").select(schema.names)  # one row
    if mode == "update":
        others = [c for c in schema.names if c not in keys]
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("__last"))
        return last.select(*keys, "__last.*").select(schema.names)
    return rows.select(schema.names)


@contextmanager
def state_store(spark: SparkSession, provider: str | None):
    """The state store of streams that are started inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    if provider:
        spark.conf.set(name, provider)
    try:
        yield
    finally:
        if provider:
            spark.conf.set(name, before)


def merge_table(stream: DataFrame, keys: list[str], first: dict[str, Column], again: dict[str, str], path: str | None = None) -> DataFrame:
    """A table with a row for each of `keys`, brought up to date by each batch: `first` reduces a batch, and `again` names, by column, the function (max, min or sum) that joins
    it with what is there. The stream holds no state: that is the table, one row a key.

    The table has a version for each batch, made from the one before: a batch that is run again makes the same version again. The two last ones are kept. Late events count as others
    do; where the newest event wins (the greatest struct of its time and what it says), an older one that comes late changes nothing.
    """
    spark = stream.sparkSession
    path = path or fresh_dir(spark, "merged")
    shape = stream.groupBy(*keys).agg(*[c.alias(n) for n, c in first.items()]).schema
    files = spark._jvm.org.apache.hadoop.fs
    store = files.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def merge(rows: DataFrame, batch: int) -> None:
        new = rows.groupBy(*keys).agg(*[c.alias(n) for n, c in first.items()])
        old = files.Path(f"{path}/version={batch - 1}/_SUCCESS")
        if store.exists(old):
            both = spark.read.schema(shape).parquet(f"{path}/version={batch - 1}").unionByName(new)
            new = both.groupBy(*keys).agg(*[getattr(F, again[n])(n).alias(n) for n in first])
        new.write.mode("overwrite").parquet(f"{path}/version={batch}")
        store.delete(files.Path(f"{path}/version={batch - 2}"), True)

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}/progress").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    versions = [int(s.getPath().getName().split("=")[1]) for s in store.globStatus(files.Path(f"{path}/version=*"))]
    return spark.read.schema(shape).parquet(f"{path}/version={max(versions)}") if versions else spark.createDataFrame([], shape)


def parse_events(lines: DataFrame, schema: T.StructType | str, most: int = 7900) -> DataFrame:
    """Payloads cut at `most` characters and parsed; those that do not parse are dropped."""
    fields = f"{schema}, __corrupt string" if isinstance(schema, str) else T.StructType([*schema.fields, T.StructField("__corrupt", T.StringType())])
    read = F.from_json(F.left("value", F.lit(most)), fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"})
    parsed = lines.select(read.alias("e")).where("e is not null and e.__corrupt is null").select("e.*")
    return parsed.drop("__corrupt")


def first_only(events: DataFrame, key: list[str], at: str, late: str = "31 days") -> DataFrame:
    """Events whose key was not seen within the lateness; state is dropped behind the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def tumbling(events: DataFrame, at: str, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Groups by window (column w). Put out in append mode, a window is a row once the watermark has passed its end, and its state goes; in update mode it is
    a row in each batch that changes it. An event behind the watermark is in no window."""
    window = F.window(at, width, slide) if slide else F.window(at, width)
    return events.withWatermark(at, late).groupBy(window.alias("w"))


def sessions(events: DataFrame, at: str, gap: str, key: str, late: str = "1 hour") -> DataFrame:
    """Groups by session (column w) and key. In append mode a session is put out, and its state goes, once the watermark is a gap behind its last event."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key)


def follow(stream: DataFrame, job: Column, terminal: Column, order: list[str]) -> DataFrame:
    """The events of one job in order up to its first terminal one. The stream is filtered before anything is kept; what arrives late
    behind the terminal event is left out."""
    kept = drain(stream.where(job), "append")
    end = kept.where(terminal).agg(F.min(F.struct(*order)).alias("__end"))  # one row
    return kept.join(F.broadcast(end), F.col("__end").isNull() | (F.struct(*order) <= F.col("__end"))).drop("__end")
