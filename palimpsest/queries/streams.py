"""Streams over the event table, drained to a table. Windows are beyond the reference's own steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import streaming
from ..streaming import stateful
from .base import read, registry

QUERIES, ORACLE_SQL, query = registry()


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(event_id) AS event_id, count(*) AS n FROM events GROUP BY user_id")
def stream_latest_state(spark, d):
    """STM-4: each batch is merged into the table of states."""
    first = {"last": F.max(F.struct("ts", "event_id", "event_type")), "event_id": F.max("event_id"), "n": F.count("*")}
    table = streaming.merge_table(streaming.events_stream(spark, d), ["user_id"], first, {"last": "max", "event_id": "max", "n": "sum"})
    return table.select("user_id", F.col("last.event_type").alias("event_type"), "event_id", "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark, d):
    """STM-7, SRC-8: one row a user and type, whichever comes first."""
    e = streaming.events_stream(spark, d).select("user_id", "event_type", "ts")
    return streaming.drain(streaming.first_only(e, ["user_id", "event_type"], "ts", "60 days"), "append").select("user_id", "event_type")


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, d):
    """Windows in update mode: the last row of each, open ones too; the state of closed ones is gone."""
    e = streaming.events_stream(spark, d).withWatermark("ts", "1 hour")
    out = e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return streaming.drain(out, "update", ["w", "event_type"]).select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")


@query("""SELECT s AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 6 HOUR]) AS s FROM events) GROUP BY 1""")
def stream_sliding(spark, d):
    out = streaming.tumbling(streaming.events_stream(spark, d), "ts", "12 hours", "6 hours").agg(F.count("*").alias("n"))
    return streaming.drain(out, "update", ["w"]).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def stream_session(spark, d):
    out = streaming.sessions(streaming.events_stream(spark, d), "ts", "6 hours", "user_id").agg(F.count("*").alias("n"))
    return streaming.drain(out, "complete").select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("""SELECT date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1 HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_closed_windows(spark, d):
    """Windows in append mode: each once, when the watermark has passed its end and its state is dropped."""
    out = streaming.tumbling(streaming.events_stream(spark, d), "ts", "1 day").agg(F.count("*").alias("n"))
    return streaming.drain(out, "append").select(F.col("w.start").cast("timestamp_ntz").alias("day"), "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_closed_sessions(spark, d):
    """Sessions in append mode: each once, when it can't go on any more."""
    out = streaming.sessions(streaming.events_stream(spark, d), "ts", "6 hours", "user_id").agg(F.count("*").alias("n"))
    return streaming.drain(out, "append").select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


KIND_SQL = "CASE event_type WHEN 'click' THEN 'start' WHEN 'error' THEN 'fail' WHEN 'purchase' THEN 'done' ELSE 'submit' END"


@query(f"""WITH RECURSIVE e AS (SELECT user_id // 10 AS job, epoch_us(ts) AS tm, {KIND_SQL} AS kind, row_number() OVER (PARTITION BY user_id // 10 ORDER BY ts, event_id) AS n FROM events
UNION ALL SELECT user_id // 10, (SELECT epoch_us(max(ts)) - 3600000000 FROM events), 'end', count(*) + 1 FROM events GROUP BY 1),
f AS (SELECT job, 0::BIGINT AS n, 'none' AS status, 0 AS tries, NULL::BIGINT AS due, []::STRUCT(w BIGINT, state VARCHAR, tries INT)[] AS made FROM (SELECT DISTINCT job FROM e) UNION ALL
SELECT job, n, CASE WHEN k = 'submit' AND s2 = 'none' THEN 'created' WHEN k = 'start' AND s2 = 'created' THEN 'active' WHEN k = 'fail' AND s2 = 'active' THEN CASE WHEN t1 < 1 THEN 'retry' ELSE 'none' END WHEN k = 'done' AND s2 = 'active' THEN 'none' ELSE s2 END,
CASE WHEN k = 'submit' AND s2 = 'none' THEN 0 WHEN k = 'fail' AND s2 = 'active' AND t1 < 1 THEN t1 + 1 ELSE t1 END,
CASE WHEN k = 'start' AND s2 = 'created' THEN tm + 2700000000 WHEN k = 'fail' AND s2 = 'active' THEN CASE WHEN t1 < 1 THEN tm + 30000000 END WHEN k = 'done' AND s2 = 'active' THEN NULL ELSE d2 END,
list_filter(list_concat(o2, [CASE WHEN k = 'submit' AND s2 = 'none' THEN {{'w': tm, 'state': 'created', 'tries': 0}} WHEN k = 'start' AND s2 = 'created' THEN {{'w': tm, 'state': 'active', 'tries': t1}}
WHEN k = 'fail' AND s2 = 'active' THEN {{'w': tm, 'state': CASE WHEN t1 < 1 THEN 'retry' ELSE 'failed' END, 'tries': CASE WHEN t1 < 1 THEN t1 + 1 ELSE t1 END}} WHEN k = 'done' AND s2 = 'active' THEN {{'w': tm, 'state': 'completed', 'tries': t1}} END]), lambda x: x IS NOT NULL)
FROM (SELECT *, CASE WHEN s1 = 'retry' AND d1 <= tm THEN 'created' ELSE s1 END AS s2, CASE WHEN s1 = 'retry' AND d1 <= tm THEN NULL ELSE d1 END AS d2, list_concat(o1, [CASE WHEN s1 = 'retry' AND d1 <= tm THEN {{'w': d1, 'state': 'created', 'tries': t1}} END]) AS o2
FROM (SELECT e.job, e.n, e.tm, e.kind AS k, CASE WHEN x THEN CASE WHEN tries < 1 THEN 'retry' ELSE 'none' END ELSE status END AS s1, CASE WHEN x AND tries < 1 THEN tries + 1 ELSE tries END AS t1, CASE WHEN x THEN CASE WHEN tries < 1 THEN due + 30000000 END ELSE due END AS d1,
[CASE WHEN x THEN {{'w': due, 'state': 'expired', 'tries': tries}} END, CASE WHEN x THEN {{'w': due, 'state': CASE WHEN tries < 1 THEN 'retry' ELSE 'failed' END, 'tries': CASE WHEN tries < 1 THEN tries + 1 ELSE tries END}} END] AS o1
FROM (SELECT *, coalesce(status = 'active' AND due <= (SELECT tm FROM e WHERE e.job = f.job AND e.n = f.n + 1), false) AS x FROM f) f JOIN e ON e.job = f.job AND e.n = f.n + 1)))
SELECT job, make_timestamp(m.w) AS at, m.state AS state, m.tries AS tries FROM (SELECT job, unnest(made) AS m FROM f)""")
def stream_queue(spark, d):
    """STM-8, SRC-8: jobs with one retry after 30 seconds and expiry after 45 minutes, by timers; each transition is a row."""
    events = streaming.events_stream(spark, d).selectExpr("user_id DIV 10 AS job", "event_id", "ts AS at", f"{KIND_SQL} AS kind")
    return streaming.drain(stateful.job_transitions(events), "append", typed_state=True).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("""WITH c AS (SELECT min(event_id) + (max(event_id) - min(event_id)) // 2 AS cut FROM events), s AS (SELECT user_id, max(event_id) AS event_id FROM events, c WHERE event_id <= cut GROUP BY user_id),
t AS (SELECT e.user_id, e.event_id, e.event_type, min(CASE WHEN e.event_type = 'purchase' THEN e.event_id END) OVER (PARTITION BY e.user_id) AS last FROM events e, c WHERE e.event_id > c.cut)
SELECT user_id, event_id, 'state' AS event_type FROM s UNION ALL SELECT user_id, event_id, event_type FROM t WHERE last IS NULL OR event_id <= last""")
def stream_replay_tail(spark, d):
    """STM-2, STM-3: each key's state up to a position, then what the stream has beyond it, told once and closed by the first purchase. The stream reads the whole table: the
    operator's initial state knows what has been told."""
    e = read(spark, d, "events")
    first, last = e.agg(F.min("event_id"), F.max("event_id")).first()
    cut = F.lit(None if first is None else first + (last - first) // 2).cast("long")
    state = e.where(F.col("event_id") <= cut).groupBy("user_id").agg(F.max("event_id").alias("position"))
    known = e.select("user_id").distinct().join(state, "user_id", "left").select("user_id", F.coalesce("position", cut).alias("position"), F.lit(False).alias("ended"))
    events = streaming.events_stream(spark, d).select("user_id", "event_id", "event_type", "ts")
    tail = stateful.live_tail(events, known, "user_id", "event_id", "ts", F.col("event_type") == "purchase")
    live = streaming.drain(tail, "append", typed_state=True).select("user_id", "event_id", "event_type")
    return state.select("user_id", F.col("position").alias("event_id"), F.lit("state").alias("event_type")).unionByName(live)


@query("""WITH c AS (SELECT min(event_id) + (max(event_id) - min(event_id)) // 2 AS cut FROM events)
SELECT user_id, event_type, event_id FROM events, c WHERE event_id > cut UNION ALL SELECT user_id, arg_max(event_type, (ts, event_id)), max(event_id) FROM events, c WHERE event_id <= cut GROUP BY user_id""")
def stream_replay(spark, d):
    """STM-3: a late subscriber reads each key's state up to a position, the middle of the event_ids, then every later event."""
    e = read(spark, d, "events")
    first, last = e.agg(F.min("event_id"), F.max("event_id")).first()
    cut = F.lit(None if first is None else first + (last - first) // 2).cast("long")
    now = e.where(F.col("event_id") <= cut).groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.max("event_id").alias("event_id"))
    tail = streaming.drain(streaming.events_stream(spark, d).where(F.col("event_id") > cut).select("user_id", "event_type", "event_id"), "append")
    return now.unionByName(tail)
