"""Exports and evaluation gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import escape_html, label


def markdown_lines(items: DataFrame, category: str, order: list[str], stem: str, answer: str) -> DataFrame:
    """category_no, item_no, line: headings by category in order of first appearance, items numbered inside them.

    The report is a table with one row per block of text, so that writing it as text needs no driver: `write.text` after
    a range partitioning by (category_no, item_no).
    """
    seen = items.withColumn("__at", F.struct(*order))
    firsts = seen.groupBy(category).agg(F.min("__at").alias("__first")).withColumn("category_no", F.row_number().over(Window.orderBy("__first")))
    numbered = seen.withColumn("item_no", F.row_number().over(Window.partitionBy(category).orderBy(*order))).join(firsts, category)
    item = F.concat(F.lit("### "), F.col("item_no").cast("string"), F.lit(". "), F.col(stem), F.lit("\n\n"), F.col(answer), F.lit("\n\n---"))
    heads = firsts.select("category_no", F.lit(0).alias("item_no"), F.concat(F.lit("## "), label(rules.CATEGORIES, F.col(category))).alias("line"))
    return heads.unionByName(numbered.select("category_no", "item_no", item.alias("line")))


def card_text(text: Column) -> Column:
    """Escaped, on one line: a tab is a space, a newline a break."""
    return F.replace(F.replace(escape_html(text), F.lit("\t"), F.lit(" ")), F.lit("\n"), F.lit("<br>"))


TSV_HEADER = ("#separator:tab", "#html:true", "#tags column:3")


def tsv_line(stem: Column, back: Column, tags: Column) -> Column:
    return F.concat_ws("\t", card_text(stem), back, tags)


def tsv_table(cards: DataFrame, line: str) -> DataFrame:
    """row, line: the header's lines, then the cards' (all of one row number, to be written in the order of their lines)."""
    top = cards.sparkSession.createDataFrame(list(enumerate(TSV_HEADER)), "row int, line string")
    return top.unionByName(cards.select(F.lit(len(TSV_HEADER)).alias("row"), F.col(line).alias("line")))


def html_article(number: Column, meta: Column, stem: Column, answer: Column) -> Column:
    return F.concat(F.lit('<article><div class="meta">'), escape_html(meta), F.lit("</div><h3>"), number.cast("string"), F.lit(". "), escape_html(stem), F.lit("</h3><p>"), F.replace(escape_html(answer), F.lit("\n"), F.lit("<br>")), F.lit("</p></article>"))


def write_lines(df: DataFrame, line: str, order: list[str], path: str) -> None:
    """One text file per range of the order; file names sort as the lines do."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(line).write.mode("overwrite").text(path)


def ratio_gate(name: str, good: Column, least: float, empty: float) -> list[Column]:
    """score and passed of a share of rows; `empty` is the score of no rows."""
    score = F.coalesce(F.round(F.count_if(good) / F.nullif(F.count(F.lit(1)), F.lit(0)), 3), F.lit(empty))
    return [F.lit(name).alias("metric"), score.alias("score"), (score >= least).alias("passed")]


def mean_gate(name: str, value: Column, least: float) -> list[Column]:
    score = F.coalesce(F.round(F.avg(value), 3), F.lit(0.0))
    return [F.lit(name).alias("metric"), score.alias("score"), (score >= least).alias("passed")]


def cost_regression(current: Column, before: Column, most: float = 0.20) -> Column:
    """Passed: no baseline, or an increase of at most 20 %."""
    return F.when(before.isNull() | (before <= 0), F.lit(True)).otherwise((current - before) / before <= most)


def first_question_gate(p95_ms: Column, most: float = 45_000) -> Column:
    return p95_ms < most


def markdown_table(df: DataFrame, columns: list[str], heads: list[str]) -> DataFrame:
    """row, line: a table's head, its rule, and its rows (all row 2, to be written in the order of their lines)."""
    spark = df.sparkSession
    top = spark.createDataFrame([(0, "| " + " | ".join(heads) + " |"), (1, "|" + "---|" * len(heads))], "row int, line string")
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in columns]), F.lit(" |"))
    return top.unionByName(df.select(F.lit(2).alias("row"), cells.alias("line")))
