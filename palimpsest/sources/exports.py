"""Exports: ordered documents as files, in three formats, behind the owner's check, published when all are written.

`export_lines` gives the blocks of each document with their places; `write_documents` writes one file for each. The writer is a data source
("documents"): a task streams its documents, in order, into drafts; its commit message names them, and only the driver's commit, after every task, gives them their
names. A job that fails leaves no document, and a task that runs again leaves a draft that nobody names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions import rules
from ..functions.text import escape_html, label, slug
from ..operators.reports import TSV_HEADER, card_text, html_article, tsv_line

#: Format -> ending of its files.
FORMATS = {"markdown": "md", "tsv": "tsv", "html": "html"}
SCHEMA = "name string, section long, place long, block string"


@dataclass
class _Written(WriterCommitMessage):
    drafts: list[tuple[str, str]]


class _DocumentWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder, self.run = folder, uuid.uuid4().hex

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.folder if "://" in self.folder else f"file://{self.folder}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, base = self._store()
        store.create_dir(f"{base}/_drafts-{self.run}", recursive=True)
        drafts: list[tuple[str, str]] = []
        name = out = None
        for batch in iterator:
            for own, block in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if own != name:
                    if out:
                        out.close()
                    draft = f"{base}/_drafts-{self.run}/{uuid.uuid4().hex}"
                    drafts.append((own, draft))
                    name, out = own, store.open_output_stream(draft)
                out.write(block.encode() + b"\n")
        if out:
            out.close()
        return _Written(drafts)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """One move a document."""
        store, base = self._store()
        for message in messages:
            for name, draft in message.drafts if message else ():
                store.move(draft, f"{base}/{name}")
        self._sweep(store, base)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, base = self._store()
        self._sweep(store, base)

    def _sweep(self, store: fs.FileSystem, base: str) -> None:
        if store.get_file_info(f"{base}/_drafts-{self.run}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/_drafts-{self.run}")


class DocumentSink(DataSource):
    """df.write.format("documents").mode("append").save(folder): rows of SCHEMA, all rows of a name in one partition and in order; one file a name."""

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _DocumentWriter(self.options["path"])


def write_documents(blocks: DataFrame, folder: str) -> None:
    """One file for each name of (name, section, place, block), its blocks in the order of section and place."""
    spark = blocks.sparkSession
    spark.dataSource.register(DocumentSink)
    order = ["name", "section", "place"]
    ranged = blocks.select("name", F.col("section").cast("long").alias("section"), F.col("place").cast("long").alias("place"), "block").repartition("name").sortWithinPartitions(*order)
    ranged.write.format("documents").mode("append").save(folder)


def owned(sets: DataFrame, user: str) -> DataFrame:
    """The sets that a user may export: others give nothing, as if they weren't there."""
    return sets.where(F.col("owner") == user)


def export_lines(items: DataFrame, sets: DataFrame, user: str, kind: str) -> DataFrame:
    """name, section, place, block of the user's sets in a format; name is the file's, from the set's title.

    sets: set_id, title, owner; items: set_id, position, category, level, stem, answer, tags. Sets without items are a document without any; items without a set of the user's go.
    """
    if kind not in FORMATS:
        raise ValueError(f"no such format: {kind}")
    file = F.concat(slug(F.col("title")), F.lit("." + FORMATS[kind]))
    own = owned(sets, user).select("set_id", "title", file.alias("name"))
    mine = items.join(own, "set_id")
    return {"markdown": _markdown, "tsv": _tsv, "html": _html}[kind](mine, own)


def _rows(df: DataFrame, section: Column | int, place: Column | int, block: Column) -> DataFrame:
    number = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("long")
    return df.select("name", number(section).alias("section"), number(place).alias("place"), block.alias("block"))


def _markdown(items: DataFrame, sets: DataFrame) -> DataFrame:
    """The title; then, by category in the order of first appearance, a heading and the items, numbered in it. Numbers are of one set's rows."""
    firsts = items.groupBy("name", "category").agg(F.min("position").alias("first"))
    sections = firsts.withColumn("section", F.row_number().over(Window.partitionBy("name").orderBy("first", "category")))
    numbered = items.withColumn("number", F.row_number().over(Window.partitionBy("name", "category").orderBy("position"))).join(sections, ["name", "category"])
    item = F.concat(F.lit("### "), F.col("number").cast("string"), F.lit(". "), F.col("stem"), F.lit("\n\n"), F.col("answer"), F.lit("\n\n---"))
    heads = _rows(sections, F.col("section"), 0, F.concat(F.lit("## "), label(rules.CATEGORIES, F.col("category"))))
    return _rows(sets, 0, 0, F.concat(F.lit("# "), F.col("title"))).unionByName(heads).unionByName(_rows(numbered, F.col("section"), F.col("number"), item))


def _tsv(items: DataFrame, sets: DataFrame) -> DataFrame:
    heads = [_rows(sets, 0, i, F.lit(line)) for i, line in enumerate(TSV_HEADER)]
    out = _rows(items, 1, F.col("position"), tsv_line(F.col("stem"), card_text(F.col("answer")), F.col("tags")))
    for h in heads:
        out = out.unionByName(h)
    return out


def _html(items: DataFrame, sets: DataFrame) -> DataFrame:
    head = F.concat(F.lit('<!doctype html><html><head><meta charset="utf-8"><title>'), escape_html(F.col("title")), F.lit("</title></head><body><h1>"), escape_html(F.col("title")), F.lit("</h1>"))
    number = F.row_number().over(Window.partitionBy("name").orderBy("position"))
    meta = F.concat_ws(" · ", label(rules.CATEGORIES, F.col("category")), "level")
    articles = items.withColumn("number", number)
    return _rows(sets, 0, 0, head).unionByName(_rows(articles, 1, F.col("number"), html_article(F.col("number"), meta, F.col("stem"), F.col("answer")))).unionByName(_rows(sets, 2, 0, F.lit("</body></html>")))


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """name, n (from 1), line of the documents in a folder."""
    files = spark.read.text(folder, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"), F.regexp_replace("value", r"\n\z", "").alias("value"))
    return files.select("name", F.posexplode(F.split("value", "\n", -1)).alias("n", "line")).withColumn("n", F.col("n") + 1)
