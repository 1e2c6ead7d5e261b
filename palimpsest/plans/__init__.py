"""Generation plans: categories and levels as a small table, for one repository or for each of many."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules

#: What the facts of a repository can say that changes a plan.
CONDITIONS = ("trivial", "no_tables", "no_routes", "no_tests", "no_devops")


def plan_each(repos: DataFrame, key: str = "repo") -> DataFrame:
    """key, seq, category, level, count, persona: the tasks of each repository's pack. repos: key and the conditions, booleans (null is false).

    The plan's rows are one literal, exploded in each repository's row; numbers and turns are windows over its few tasks.
    """
    base = F.array(*[
        F.struct(F.lit(i).alias("cat"), F.lit(name).alias("category"), (F.when(F.coalesce(F.col(condition), F.lit(False)), other).otherwise(usual) if condition else F.lit(usual)).alias("n"))
        for i, (name, usual, other, condition) in enumerate(rules.PLAN_COUNTS)
    ])
    rows = repos.select(key, F.explode(base).alias("b")).select(key, "b.*")
    one, two = F.floor(F.col("n") * 0.2 + 0.5), F.floor(F.col("n") * 0.45 + 0.5)
    half = F.col("category") == "walkthrough"
    levels = F.array(
        F.struct(F.lit("L1").alias("level"), F.when(half, F.ceil(F.col("n") * 0.5)).otherwise(one).cast("int").alias("count")),
        F.struct(F.lit("L2").alias("level"), F.when(half, F.floor(F.col("n") * 0.5)).otherwise(two).cast("int").alias("count")),
        F.struct(F.lit("L3").alias("level"), F.when(half, 0).otherwise(F.col("n") - one - two).cast("int").alias("count")),
    )
    tasks = rows.select(key, "cat", "category", F.explode(levels).alias("l")).select(key, "cat", "category", "l.level", "l.count").where("count > 0")
    order = Window.partitionBy(key).orderBy("cat", "level")
    turn = F.sum(F.when(F.col("level") != "L3", 1).otherwise(0)).over(order) - 1
    persona = F.when(F.col("level") == "L3", "bar-raiser").otherwise(F.element_at(F.array(*map(F.lit, rules.PERSONAS)), (turn % 3 + 1).cast("int")))
    return tasks.select(key, (F.row_number().over(order) - 1).alias("seq"), "category", "level", F.least("count", F.lit(8)).alias("count"), persona.alias("persona"))


def fan_out(spark: SparkSession, **conditions: bool) -> DataFrame:
    """seq, category, level, count, persona: the tasks of one pack, under the `CONDITIONS` given."""
    one = spark.range(1).select("id", *[F.lit(bool(conditions.get(c))).alias(c) for c in CONDITIONS])
    return plan_each(one, "id").drop("id")
