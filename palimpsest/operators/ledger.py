"""Token costs: rates joined by tier, unknown prices null, budgets as running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from .tables import running_total


def rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(rules.RATES), "tier string, rate_in double, rate_out double, rate_cached double")


def cost_cents(tokens_in: Column, cached: Column, out: Column) -> Column:
    """From the rates of a joined row; null without a rate."""
    return (F.greatest(F.lit(0), tokens_in - cached) * F.col("rate_in") + cached * F.col("rate_cached") + out * F.col("rate_out")) / 1e6


def with_model(usage: DataFrame, specs: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """Add the model of each row's tier: that of specs (tier, model), or of chosen (tier, model), which overrides the name only."""
    named = usage.join(specs.select("tier", F.col("model").alias("__usual")), "tier", "left")
    if chosen is None:
        return named.withColumnRenamed("__usual", "model")
    own = chosen.select("tier", F.col("model").alias("__chosen"))
    return named.join(own, "tier", "left").withColumn("model", F.when(F.col("__usual").isNotNull(), F.coalesce("__chosen", "__usual"))).drop("__usual", "__chosen")


def priced_by_model(usage: DataFrame, model_rates: DataFrame, cols: tuple[str, str, str] = ("tokens_in", "cached", "tokens_out")) -> DataFrame:
    """Add cents from rates by model (model, rate_in, rate_out, rate_cached). A model that is not in the table, or has no rates
    there, costs null, never zero."""
    kept = usage.columns
    return usage.join(model_rates, "model", "left").withColumn("cents", cost_cents(*(F.col(c) for c in cols))).select(*kept, "cents")


def priced(usage: DataFrame, tier: str = "tier", cols: tuple[str, str, str] = ("tokens_in", "cached", "tokens_out")) -> DataFrame:
    """Add cents. The rate table has a handful of fixed rows, so it is broadcast."""
    table = F.broadcast(rates(usage.sparkSession).withColumnRenamed("tier", tier))
    kept = usage.columns
    return usage.join(table, tier, "left").withColumn("cents", cost_cents(*(F.col(c) for c in cols))).select(*kept, "cents")


def totals(usage: DataFrame, by: list[str]) -> DataFrame:
    """Sums by group; spend counts priced rows only, and the unpriced tiers are named."""
    out = priced(usage).groupBy(*by).agg(
        F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("cached").alias("cached"), F.round(F.coalesce(F.sum("cents"), F.lit(0.0)), 6).alias("cents"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("cents").isNull(), F.col("tier")))), ",").alias("unpriced"),
    )
    return out


def first_over_budget(usage: DataFrame, job: str, order: list[str], budget: float) -> DataFrame:
    """Per job, the first row at or over the budget: the call before which the run stops."""
    spent = running_total(priced(usage).withColumn("__cents", F.coalesce("cents", F.lit(0.0))), "__cents", [job], order, "spent").drop("__cents")
    over = spent.withColumn("spent", F.round("spent", 6)).where(F.col("spent") >= budget)
    first = over.groupBy(job).agg(F.min_by(F.struct(*over.columns), F.struct(*order)).alias("__first"))
    return first.select("__first.*")


def estimate(files: Column, size: Column, questions: Column, fast=("fast",), frontier=("frontier",), balanced=("balanced",)) -> dict[str, Column]:
    """Cents by stage from the fixed shape of a run; a tier without a rate gives null."""
    known = {t: (i, o, c) for t, i, o, c in rules.RATES}

    def price(tier: str, tokens_in: Column, out: Column, cached: Column) -> Column:
        if tier not in known:
            return F.lit(None).cast("double")
        i, o, c = known[tier]
        return (F.greatest(F.lit(0.0), tokens_in - cached) * i + cached * c + out * o) / 1e6

    none = F.lit(0.0)
    rollup = files * 70
    made = 10 * (rollup * 0.25 + 3000)
    return {
        "summaries": price(fast[0], F.ceil(size / 3.6).cast("double"), files * 60, none),
        "dossier": price(frontier[0], rollup + 4000, F.lit(6000), none),
        "questions": price(balanced[0], made, questions * 700, made * 0.7),
        "verification": price(balanced[0], questions * 2500, questions * 250, none),
    }
