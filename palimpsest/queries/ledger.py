"""Costs, budgets, progress."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules, text
from ..functions.vectors import clamp
from ..operators import ledger
from .base import read, registry

QUERIES, ORACLE_SQL, query = registry()
TIERS = ("frontier", "balanced", "fast", "hosted", "local")
_USAGE_SQL = """u AS (SELECT event_id, user_id, ['frontier', 'balanced', 'fast', 'hosted', 'local'][event_id % 5 + 1] AS tier, CAST(floor(value * 100) AS BIGINT) + 1000 AS tokens_in, CAST(floor(value * 10) AS BIGINT) AS tokens_out, CAST(floor(value * 30) AS BIGINT) AS cached FROM events),
rates AS (SELECT * FROM (VALUES ('frontier', 500.0::DOUBLE, 2500.0::DOUBLE, 50.0::DOUBLE), ('balanced', 300.0, 1500.0, 30.0), ('fast', 100.0, 500.0, 10.0), ('local', 0.0, 0.0, 0.0)) AS t(tier, i, o, c)),
p AS (SELECT u.*, (greatest(0, tokens_in - cached) * i + cached * c + tokens_out * o) / 1e6 AS cents FROM u LEFT JOIN rates USING (tier))"""


def usage(spark, d):
    tier = F.element_at(F.array(*map(F.lit, TIERS)), (F.col("event_id") % 5 + 1).cast("int"))
    whole = lambda n: F.floor(F.col("value") * n).cast("long")
    return read(spark, d, "events").select("event_id", "user_id", tier.alias("tier"), (whole(100) + 1000).alias("tokens_in"), whole(10).alias("tokens_out"), whole(30).alias("cached"))


@query(f"""WITH {_USAGE_SQL} SELECT user_id, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, sum(cached)::BIGINT AS cached, round(coalesce(sum(cents), 0), 6) AS cents,
coalesce(list_aggregate(list_sort(list_distinct(list(tier) FILTER (WHERE cents IS NULL))), 'string_agg', ','), '') AS unpriced FROM p GROUP BY user_id""")
def usage_ledger(spark, d):
    """MTH-8, JOI-8, AGG-8, SRC-9, UDF-6, T-11."""
    return ledger.totals(usage(spark, d), ["user_id"])


@query(f"""WITH {_USAGE_SQL}, s AS (SELECT user_id, event_id, round(sum(coalesce(cents, 0)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS spent FROM p)
SELECT user_id, event_id, spent FROM s WHERE spent >= 40 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1""")
def budget_stop(spark, d):
    """STM-6, WIN-5."""
    return ledger.first_over_budget(usage(spark, d), "user_id", ["event_id"], 40.0).select("user_id", "event_id", "spent")


@query("""WITH s AS (SELECT source, count(*) AS f, sum(n_chars)::DOUBLE AS b FROM documents GROUP BY source)
SELECT source, round(ceil(b / 3.6) * 100 / 1e6 + f * 60 * 500 / 1e6, 6) AS summaries, round((f * 70 + 4000) * 500 / 1e6 + 6000 * 2500 / 1e6, 6) AS dossier,
round((0.3 * 10 * (f * 70 * 0.25 + 3000) * 300 + 0.7 * 10 * (f * 70 * 0.25 + 3000) * 30 + 95 * 700 * 1500) / 1e6, 6) AS questions, round((95 * 2500 * 300 + 95 * 250 * 1500) / 1e6, 6) AS verification, NULL::DOUBLE AS unpriced FROM s""")
def estimate_run(spark, d):
    """MTH-9."""
    s = read(spark, d, "documents").groupBy("source").agg(F.count("*").alias("f"), F.sum("n_chars").cast("double").alias("b"))
    parts = ledger.estimate(F.col("f"), F.col("b"), F.lit(95))
    none = ledger.estimate(F.col("f"), F.col("b"), F.lit(95), frontier=("hosted",))["dossier"]
    return s.select("source", *[F.round(c, 6).alias(n) for n, c in parts.items()], none.alias("unpriced"))


@query("""WITH w AS (SELECT * FROM (VALUES (0, 'acquire', 0.06), (1, 'collect', 0.05), (2, 'facts', 0.03), (3, 'map', 0.40), (4, 'dossier', 0.15), (5, 'questions', 0.20), (6, 'verify', 0.11)) AS t(i, stage, w)),
b AS (SELECT i, stage, w, coalesce(sum(w) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w)
SELECT event_id, stage, round(CAST(before AS DOUBLE) + CAST(w AS DOUBLE) * greatest(0, least(1, value / 100)), 6) AS progress FROM events JOIN b ON i = event_id % 7""")
def stage_progress(spark, d):
    """MTH-6, MTH-10, WIN-8: seven fixed stages, broadcast."""
    rows = [(i, s, w) for i, (s, w) in enumerate(rules.STAGE_WEIGHTS)]
    stages = spark.createDataFrame(rows, "i int, stage string, w double")
    before = F.coalesce(F.sum("w").over(Window.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    done = F.round(F.col("before") + F.col("w") * clamp(F.col("value") / 100, 0.0, 1.0), 6)
    return read(spark, d, "events").join(F.broadcast(stages.withColumn("before", before)), F.col("event_id") % 7 == F.col("i")).select("event_id", "stage", done.alias("progress"))


@query("""SELECT event_id, CASE WHEN v < 1.0 / 24 THEN CAST(round(v * 1440) AS BIGINT) || 'm' WHEN v < 1 THEN CAST(round(v * 24) AS BIGINT) || 'h' WHEN v < 30 THEN CAST(round(v) AS BIGINT) || 'd' WHEN v < 365 THEN CAST(round(v / 30) AS BIGINT) || 'mo' ELSE printf('%.1f', v / 365) || 'y' END AS said
FROM (SELECT event_id, (event_id % 977 + 0.3) / 1.7 AS v FROM events)""")
def interval_labels(spark, d):
    """STR-18."""
    return read(spark, d, "events").select("event_id", text.interval_text((F.col("event_id") % 977 + 0.3) / 1.7).alias("said"))
