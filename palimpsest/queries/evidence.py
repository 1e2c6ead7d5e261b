"""Citations, verdicts, de-dup, rank, schedules, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..functions.vectors import jaccard
from ..operators import evidence, reports, schedule, tables, vector_index
from ..plans import CONDITIONS, fan_out, plan_each
from ..shared import stored
from .base import read, registry

QUERIES, ORACLE_SQL, query = registry()


def _spans(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderdate").alias("a"), F.expr("o_orderdate + interval 30 days").alias("b"))
    li = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber", F.col("l_shipdate").alias("c"), F.expr("l_shipdate + interval 7 days").alias("e"))
    return o, li


@query("""SELECT o_orderkey AS key, count(*) AS n, min(l_shipdate) AS first, max(l_shipdate + INTERVAL 7 DAY) AS last FROM orders JOIN lineitem ON o_orderkey = l_orderkey
AND o_orderdate <= l_shipdate + INTERVAL 7 DAY AND o_orderdate + INTERVAL 30 DAY >= l_shipdate GROUP BY 1""")
def citation_resolve(spark, d):
    """JOI-4: an order's month against the week of each of its lines."""
    o, li = _spans(spark, d)
    met = evidence.overlap_join(o, li, ["key"], ("a", "b"), ("c", "e"))
    return met.groupBy(o["key"]).agg(F.count("*").alias("n"), F.min("c").alias("first"), F.max("e").alias("last"))


@query("""WITH six AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) <= 6)
SELECT o_orderkey AS key FROM orders WHERE EXISTS (SELECT 1 FROM six WHERE l_orderkey = o_orderkey AND o_orderdate <= l_shipdate + INTERVAL 7 DAY AND o_orderdate + INTERVAL 30 DAY >= l_shipdate)""")
def citation_first_six(spark, d):
    """JOI-5, SRT-10, FLT-15: kept if one of the first six resolves."""
    from pyspark.sql import Window

    o = _spans(spark, d)[0]
    six = read(spark, d, "lineitem").withColumn("i", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))).where("i <= 6")
    li = six.select(F.col("l_orderkey").alias("key"), F.col("l_shipdate").alias("c"), F.expr("l_shipdate + interval 7 days").alias("e"))
    return evidence.overlap_join(o, li, ["key"], ("a", "b"), ("c", "e"), "left_semi").select("key")


_PATH = "CASE WHEN {0} % 3 = 0 THEN 0 ELSE {0} % 40 + 1 END"


@query(f"""WITH c AS (SELECT {_PATH.format('o_orderkey')} AS path, o_orderkey AS id, o_orderkey * 10 - o_custkey % 40 AS a, o_orderkey * 10 + o_custkey % 25 AS b FROM orders),
k AS (SELECT {_PATH.format('l_orderkey')} AS path, l_orderkey * 10 + l_linenumber AS a, l_orderkey * 10 + l_linenumber + l_partkey % 12 AS b FROM lineitem)
SELECT id, count(*) AS n, min(k.a) AS first, max(k.b) AS last FROM c JOIN k ON c.path = k.path AND c.a <= k.b AND c.b >= k.a GROUP BY id""")
def citation_hot_path(spark, d):
    """JOI-4: citations against chunks where one path has a third of all rows, cut into bins."""
    c = read(spark, d, "orders").selectExpr(f"{_PATH.format('o_orderkey')} AS path", "o_orderkey AS id", "o_orderkey * 10 - o_custkey % 40 AS a", "o_orderkey * 10 + o_custkey % 25 AS b")
    k = read(spark, d, "lineitem").selectExpr(f"{_PATH.format('l_orderkey')} AS path", "l_orderkey * 10 + l_linenumber AS c", "l_orderkey * 10 + l_linenumber + l_partkey % 12 AS e")
    met = evidence.binned_overlap_join(c, k, ["path"], ("a", "b"), ("c", "e"))
    return met.groupBy("id").agg(F.count("*").alias("n"), F.min("c").alias("first"), F.max("e").alias("last"))


@query("""WITH v AS (SELECT d.doc_id, round(0.4 + 0.06 * (d.doc_id % 10), 2) AS g, quality = 1 AS supported, CASE WHEN toxic = 0 THEN 'c' END AS corrected FROM documents d JOIN labels USING (doc_id))
SELECT CASE WHEN g < 0.5 OR (NOT supported AND corrected IS NULL) THEN 'unsupported' ELSE 'kept' END AS status, count(*) AS n, round(avg(g), 6) AS mean FROM v GROUP BY 1""")
def groundedness_gate(spark, d):
    """FLT-11, AGG-16."""
    rows = read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels"), "doc_id").withColumn("g", F.round(0.4 + 0.06 * (F.col("doc_id") % 10), 2))
    status = evidence.verdict(F.col("g"), F.col("quality") == 1, F.when(F.col("toxic") == 0, F.lit("c")))
    return rows.groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.round(F.avg("g"), 6).alias("mean"))


@query("""WITH RECURSIVE e AS (SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
f(n, kept) AS (SELECT 0::BIGINT, []::STRUCT(i BIGINT, v DOUBLE[])[] UNION ALL
SELECT e.n, CASE WHEN len(list_filter(f.kept, lambda k: list_dot_product(k.v, e.v) > 0.4)) > 0 THEN f.kept ELSE list_append(f.kept, {'i': e.vec_id, 'v': e.v}) END FROM f JOIN e ON e.n = f.n + 1)
SELECT unnest(list_transform(kept, lambda k: k.i)) AS vec_id FROM f WHERE n = (SELECT max(n) FROM e)""")
def semantic_dedupe(spark, d):
    """PIP-6."""
    return evidence.greedy_dedupe(read(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", ["vec_id"], 0.4).select("vec_id")


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.4")
def near_dup_pairs(spark, d):
    """JOI-10."""
    return vector_index.near_pairs(read(spark, d, "embeddings"), "vec_id", "embedding", 0.4)


@query("""WITH g AS (SELECT min(vec_id) AS vec_id, embedding::DOUBLE[] AS v, count(*) AS n FROM (SELECT vec_id, list_transform(embedding[1:4], lambda x: round(x::DOUBLE, 1)) AS embedding FROM embeddings) GROUP BY embedding)
SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.v, b.v), 6) AS similarity, a.n AS copies_a, b.n AS copies_b FROM g a JOIN g b ON a.vec_id < b.vec_id WHERE list_dot_product(a.v, b.v) > 0.085""")
def near_dup_nodes(spark, d):
    """JOI-10 over vectors cut to four rounded numbers: equal ones are one node with its number of copies, and pairs are of nodes."""
    coarse = read(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 4), lambda x: F.round(x.cast("double"), 1)).alias("embedding"))
    nodes = stored(vector_index.collapse_equal(coarse, "vec_id", "embedding", []), "nodes")
    found = vector_index.near_nodes(nodes, "vec_id", "embedding", 0.085)
    for side in ("a", "b"):
        found = found.join(nodes.select(F.col("vec_id").alias(side), F.col("copies").alias(f"copies_{side}")), side)
    return found.select("a", "b", "similarity", "copies_a", "copies_b")


@query("""WITH w AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\W+'), lambda x: x <> '')) AS w FROM (SELECT item_id, regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g') AS text FROM benchmark)),
p AS (SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) AS j FROM w a JOIN w b ON a.item_id < b.item_id),
n AS (SELECT count(*) AS n FROM w) SELECT count(*) FILTER (WHERE j > 0.2) AS pairs, round(count(*) FILTER (WHERE j > 0.2) / greatest(any_value(n) * (any_value(n) - 1) / 2, 1), 4) AS rate,
round(count(*) FILTER (WHERE j > 0.2) / greatest(any_value(n) * (any_value(n) - 1) / 2, 1), 4) < 0.03 AS passed FROM p, n""")
def jaccard_pairs(spark, d):
    """JOI-9, AGG-13, SET-2: all pairs of a short list of items."""
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", " ")
    w = read(spark, d, "benchmark").select("item_id", F.array_distinct(F.filter(F.split(F.lower(plain), r"\W+"), lambda x: x != "")).alias("w"))
    a, b = w.alias("a"), w.alias("b")
    j = a.join(b, F.col("a.item_id") < F.col("b.item_id")).select(jaccard(F.col("a.w"), F.col("b.w")).alias("j"))
    n = w.agg(F.count("*").alias("n"))
    rate = F.round(F.col("pairs") / F.greatest(F.col("n") * (F.col("n") - 1) / 2, F.lit(1)), 4)
    return j.agg(F.count_if(F.col("j") > 0.2).alias("pairs")).join(n, how="cross").select("pairs", rate.alias("rate"), (rate < 0.03).alias("passed"))


@query("""WITH b AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'), t AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS paths, count(*) FILTER (WHERE l_returnflag = 'R') AS claims FROM lineitem GROUP BY 1)
SELECT o_orderkey, CAST(round(0.5 + 0.01 * (o_orderkey % 37) + CASE WHEN b.c_custkey IS NOT NULL THEN 0.30 ELSE 0.0 END + CASE WHEN o_orderstatus = 'P' THEN 0.12 ELSE 0.0 END
+ CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0.18 WHEN o_orderpriority = '3-MEDIUM' THEN 0.10 ELSE 0.0 END + least(0.25, 0.05 * claims) + least(0.08, 0.04 * (paths - 1)), 4) AS DOUBLE) AS rank
FROM orders JOIN t ON o_orderkey = l_orderkey LEFT JOIN b ON o_custkey = c_custkey""")
def rank_score(spark, d):
    """PIP-7, JOI-12, MTH-12."""
    hot = read(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("hot"))
    t = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_distinct("l_suppkey").alias("paths"), F.count_if(F.col("l_returnflag") == "R").alias("claims"))
    rows = read(spark, d, "orders").join(t, "o_orderkey").join(hot, "o_custkey", "left")
    level = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "L3").when(F.col("o_orderpriority") == "3-MEDIUM", "L2").otherwise("L1")
    score = evidence.rank_score(0.5 + 0.01 * (F.col("o_orderkey") % 37), F.coalesce("hot", F.lit(False)), F.col("o_orderstatus") == "P", level, F.col("claims"), F.col("paths"))
    return rows.select("o_orderkey", score.alias("rank"))


@query("""SELECT event_id, round(value, 1) AS rank, row_number() OVER (ORDER BY round(value, 1) DESC, event_id) - 1 AS place FROM events""")
def rank_order(spark, d):
    """SRT-4: rows in the order of their rank, the highest first, with the place of each in the whole."""
    rows = read(spark, d, "events").select("event_id", F.round("value", 1).alias("rank")).withColumn("__down", -F.col("rank"))
    return tables.numbered(rows, ["__down", "event_id"], "place").drop("__down")


@query("""WITH c AS (SELECT unnest([{'i': 0, 'c': 'walkthrough', 'n': 6}, {'i': 1, 'c': 'architecture', 'n': 10}, {'i': 2, 'c': 'language', 'n': 8}, {'i': 3, 'c': 'data-modeling', 'n': 8}, {'i': 4, 'c': 'api-design', 'n': 8}, {'i': 5, 'c': 'performance', 'n': 8},
{'i': 6, 'c': 'security', 'n': 7}, {'i': 7, 'c': 'testing', 'n': 6}, {'i': 8, 'c': 'devops', 'n': 6}, {'i': 9, 'c': 'debugging', 'n': 7}, {'i': 10, 'c': 'scaling', 'n': 8}, {'i': 11, 'c': 'tradeoffs', 'n': 8}, {'i': 12, 'c': 'behavioral', 'n': 5}]) AS x),
s AS (SELECT x.i, x.c, x.n, floor(x.n * 0.2 + 0.5) AS a, floor(x.n * 0.45 + 0.5) AS b FROM c),
l AS (SELECT i, c, 'L1' AS l, CASE WHEN c = 'walkthrough' THEN ceil(n / 2) ELSE a END AS k FROM s UNION ALL SELECT i, c, 'L2', CASE WHEN c = 'walkthrough' THEN floor(n / 2) ELSE b END FROM s UNION ALL SELECT i, c, 'L3', CASE WHEN c = 'walkthrough' THEN 0 ELSE n - a - b END FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY i, l) - 1 AS seq, CAST(sum(CASE WHEN l <> 'L3' THEN 1 ELSE 0 END) OVER (ORDER BY i, l) - 1 AS BIGINT) AS t FROM l WHERE k > 0)
SELECT CAST(seq AS INT) AS seq, c AS category, l AS level, CAST(least(k, 8) AS INT) AS count, CASE WHEN l = 'L3' THEN 'bar-raiser' ELSE ['hiring-manager', 'tech-lead', 'peer'][t % 3 + 1] END AS persona FROM o""")
def plan_fanout(spark, d):
    """PIP-8, WIN-9, UDF-7."""
    return fan_out(spark)


_PLAN_SQL = ", ".join(f"({i}, '{name}', {usual}, {other if other is not None else usual}, '{condition or '-'}')" for i, (name, usual, other, condition) in enumerate(rules.PLAN_COUNTS))
_FLAGS = ("count(*) < 45", "count_if(doc_id % 40 = 3) = 0", "max(n_chars) < 9000", "count_if(doc_id % 8 = 7) < 5", "count_if(lang = 'es') < 6")


@query(f"""WITH r AS (SELECT source AS repo, {', '.join(f'{sql} AS {name}' for sql, name in zip(_FLAGS, CONDITIONS, strict=True))} FROM documents GROUP BY source), b AS (SELECT * FROM (VALUES {_PLAN_SQL}) AS t(i, c, usual, other, cond)),
p AS (SELECT repo, i, c, CASE WHEN {' OR '.join(f"(cond = '{name}' AND {name})" for name in CONDITIONS)} THEN other ELSE usual END AS n FROM r, b),
s AS (SELECT *, CAST(CASE WHEN c = 'walkthrough' THEN ceil(n / 2) ELSE floor(n * 0.2 + 0.5) END AS INT) AS one, CAST(CASE WHEN c = 'walkthrough' THEN floor(n / 2) ELSE floor(n * 0.45 + 0.5) END AS INT) AS two FROM p),
l AS (SELECT repo, i, c, 'L1' AS l, one AS k FROM s UNION ALL SELECT repo, i, c, 'L2', two FROM s UNION ALL SELECT repo, i, c, 'L3', CASE WHEN c = 'walkthrough' THEN 0 ELSE n - one - two END FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY i, l) - 1 AS seq, CAST(sum(CASE WHEN l <> 'L3' THEN 1 ELSE 0 END) OVER (PARTITION BY repo ORDER BY i, l) - 1 AS BIGINT) AS t FROM l WHERE k > 0)
SELECT repo, CAST(seq AS INT) AS seq, c AS category, l AS level, CAST(least(k, 8) AS INT) AS count, CASE WHEN l = 'L3' THEN 'bar-raiser' ELSE ['hiring-manager', 'tech-lead', 'peer'][t % 3 + 1] END AS persona FROM o""")
def plan_sources(spark, d):
    """PIP-8, WIN-9, UDF-7: the plan of each source's pack, by what its documents say."""
    told = read(spark, d, "documents").groupBy(F.col("source").alias("repo")).agg(*[F.expr(sql).alias(name) for sql, name in zip(_FLAGS, CONDITIONS, strict=True)])
    return plan_each(told)


@query("""WITH RECURSIVE r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, epoch_us(ts) AS at, CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 4 ELSE 3 END AS g FROM events),
f AS (SELECT user_id, 0::BIGINT AS n, 5.4::DOUBLE AS d, 0::DOUBLE AS s, 0 AS lapses, 0::BIGINT AS at, 0 AS g FROM (SELECT DISTINCT user_id FROM events) UNION ALL
SELECT r.user_id, r.n, least(greatest(f.d + 0.9 * (3 - r.g), 1), 10), least(greatest(CASE WHEN f.n = 0 THEN [0.4, 1.2, 3.2, 15.7][r.g] WHEN r.g = 1 THEN greatest(0.4, f.s * 0.35) ELSE f.s * (1 + 1.6 * (1 - CASE WHEN f.s <= 0 THEN 0
ELSE power(1 + (19.0::DOUBLE / 81.0::DOUBLE) * greatest(0, (r.at - f.at) / 86400000000.0::DOUBLE) / f.s, -0.5) END) * (11 - least(greatest(f.d + 0.9 * (3 - r.g), 1), 10)) / 10 * [1, 0.8, 1, 1.3][r.g]) END, 0.1), 1825),
f.lapses + CASE WHEN r.g = 1 THEN 1 ELSE 0 END, r.at, r.g FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1),
z AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1)
SELECT user_id, round(d, 6)::DOUBLE AS difficulty, round(s, 6)::DOUBLE AS stability, n::INT AS reps, lapses, round(least(greatest(s, CASE WHEN g = 1 THEN 0.007 ELSE 1 END), 730), 6)::DOUBLE AS interval_days FROM z""")
def srs_fold(spark, d):
    """PIP-9, MTH-7, DTE-1."""
    e = read(spark, d, "events").select("user_id", "ts", "event_id", F.expr("CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 4 ELSE 3 END").alias("rating"))
    cards = schedule.replay(e, "user_id", "ts", "rating", ties=("event_id",))
    return cards.select("user_id", *[F.round(c, 6).alias(c) for c in ("difficulty", "stability")], "reps", "lapses", F.round("interval_days", 6).alias("interval_days"))


@query("""SELECT 'validity' AS metric, round(count(*) FILTER (WHERE quality = 1) / count(*), 3) AS score, round(count(*) FILTER (WHERE quality = 1) / count(*), 3) >= 1.0 AS passed FROM labels
UNION ALL SELECT 'groundedness', round(avg(0.8 + 0.01 * (doc_id % 20)), 3), round(avg(0.8 + 0.01 * (doc_id % 20)), 3) >= 0.85 FROM labels
UNION ALL SELECT 'coverage', count(DISTINCT source)::DOUBLE, count(DISTINCT source) >= 10 FROM documents""")
def eval_metrics(spark, d):
    """AGG-9, AGG-10, AGG-11."""
    labels = read(spark, d, "labels")
    coverage = read(spark, d, "documents").agg(F.lit("coverage").alias("metric"), F.count_distinct("source").cast("double").alias("score"), (F.count_distinct("source") >= 10).alias("passed"))
    mean = F.col("doc_id") % 20 * 0.01 + 0.8
    return labels.agg(*reports.ratio_gate("validity", F.col("quality") == 1, 1.0, 1.0)).unionByName(labels.agg(*reports.mean_gate("groundedness", mean, 0.85))).unionByName(coverage)


@query("""SELECT event_type, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.95), 6) < 45 AS passed, CASE WHEN avg(value) FILTER (WHERE user_id < 75) IS NULL THEN true ELSE (avg(value) - avg(value) FILTER (WHERE user_id < 75)) / avg(value) FILTER (WHERE user_id < 75) <= 0.2 END AS cost_ok FROM events GROUP BY event_type""")
def p95_gate(spark, d):
    """AGG-14, AGG-15."""
    p95 = F.round(F.percentile("value", F.lit(0.95)), 6)
    cost = reports.cost_regression(F.avg("value"), F.avg(F.when(F.col("user_id") < 75, F.col("value"))))
    return read(spark, d, "events").groupBy("event_type").agg(p95.alias("p95"), reports.first_question_gate(p95, 45).alias("passed"), cost.alias("cost_ok"))


@query("""WITH m AS (SELECT conv_id, role, turn, CASE conv_id % 3 WHEN 0 THEN 6 WHEN 1 THEN 14 ELSE 24 END AS turns FROM conversations)
SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS answered, greatest(0, any_value(turns) - count(*) FILTER (WHERE role = 'user')) AS remaining,
CAST(least(floor(count(*) FILTER (WHERE role = 'user') / any_value(turns)::DOUBLE * 5), 4) AS BIGINT) AS beat FROM m GROUP BY conv_id""")
def interview_turns(spark, d):
    """Answers, turns left and five beats, in one aggregate. The operator is in `interview_context`."""
    turns = F.expr("CASE conv_id % 3 WHEN 0 THEN 6 WHEN 1 THEN 14 ELSE 24 END")
    n = F.count_if(F.col("role") == "user")
    m = read(spark, d, "conversations").withColumn("turns", turns)
    return m.groupBy("conv_id").agg(n.alias("answered"), F.greatest(F.lit(0), F.max("turns") - n).alias("remaining"), F.least(F.floor(n / F.max("turns") * 5), F.lit(4)).cast("long").alias("beat"))


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS seq, length(text) AS n FROM conversations")
def transcript(spark, d):
    """WIN-10, SRT-9."""
    from pyspark.sql import Window

    seq = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role")) - 1
    return read(spark, d, "conversations").select("conv_id", "turn", "role", seq.cast("long").alias("seq"), F.length("text").cast("long").alias("n"))
