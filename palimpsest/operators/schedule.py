"""Spaced repetition: review histories folded in order, one card at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def retrievability(days: Column, stability: Column) -> Column:
    return F.when(stability <= 0, 0.0).otherwise(F.pow(1 + (19.0 / 81.0) * days / stability, F.lit(-0.5)))


#: One review: (state, r) -> state. First stabilities 0.4, 1.2, 3.2, 15.7; ease 0.8, 1, 1.3; the clamps.
_STEP = """
(s, r) -> named_struct(
  'difficulty', least(greatest(s.difficulty + 0.9D * (3 - r.rating), 1D), 10D),
  'stability', least(greatest(
     CASE WHEN s.reps = 0 THEN element_at(array(0.4D, 1.2D, 3.2D, 15.7D), r.rating)
          WHEN r.rating = 1 THEN greatest(0.4D, s.stability * 0.35D)
          ELSE s.stability * (1D + 1.6D
             * (1D - CASE WHEN s.stability <= 0 THEN 0D ELSE power(1D + (19D / 81D) * greatest(0D, (r.at - s.last_at) / 86400000000D) / s.stability, -0.5D) END)
             * (11D - least(greatest(s.difficulty + 0.9D * (3 - r.rating), 1D), 10D)) / 10D
             * element_at(array(1D, 0.8D, 1D, 1.3D), r.rating)) END, 0.1D), 1825D),
  'reps', s.reps + 1,
  'lapses', s.lapses + if(r.rating = 1, 1, 0),
  'last_at', r.at,
  'last_rating', r.rating)
"""


def replay(reviews: DataFrame, card: str, at: str, rating: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """card, difficulty, stability, reps, lapses, interval_days, due_at after all reviews of the card.

    Each card's reviews travel to one task as (time, tie, rating), a few bytes each, and are folded there in order.
    """
    row = F.struct(F.unix_micros(F.col(at).cast("timestamp")).alias("at"), *[F.col(t) for t in ties], F.col(rating).cast("int").alias("rating"))
    history = reviews.groupBy(card).agg(F.array_sort(F.collect_list(row)).alias("h"))
    start = "named_struct('difficulty', 5.4D, 'stability', 0D, 'reps', 0, 'lapses', 0, 'last_at', 0L, 'last_rating', 0)"
    state = history.select(card, F.expr(f"aggregate(h, {start}, {_STEP})").alias("s"))
    days = F.least(F.greatest(F.col("s.stability"), F.when(F.col("s.last_rating") == 1, 0.007).otherwise(1.0)), F.lit(730.0))
    return state.select(card, F.col("s.difficulty").alias("difficulty"), F.col("s.stability").alias("stability"), F.col("s.reps").alias("reps"), F.col("s.lapses").alias("lapses"), days.alias("interval_days"), F.timestamp_micros((F.col("s.last_at") + days * DAY_US).cast("long")).alias("due_at"))


def due(cards: DataFrame, now: Column, due_at: str = "due_at", most: int = 40, ties: tuple[str, ...] = ()) -> DataFrame:
    return cards.where(F.col(due_at) <= now).orderBy(due_at, *ties).limit(most)
