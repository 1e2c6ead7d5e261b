"""The corpus pipeline: toxicity, line dedup, near duplicates, mixing, packing, each over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Each
result is written as Parquet in the shared folder and read again as the next stage's docs, so a lost executor costs no
more than the stage that runs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import materialise, table
from palimpsest.llm.lines import dedup_lines
from palimpsest.llm.mixing import mix_documents
from palimpsest.llm.packing import pack_documents
from palimpsest.llm.similar import drop_near_duplicates
from palimpsest.llm.toxicity import THRESHOLD, fit, keep_below

CAPACITY = 2048


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold. The classifier learns from the labels of documents that are not held out."""
    return keep_below(docs, fit(docs, table(spark, sf_dir, "labels")), THRESHOLD)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that a smaller doc_id holds; n_chars follows the text."""
    kept = dedup_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each class of similar texts."""
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mix_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), CAPACITY)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: SQL can't express the classifier or hashes of these stages; tests/llm/test_pipeline.py has brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
