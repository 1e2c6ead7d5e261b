"""Joins, windows, sorts, sets and table changes over the star schema."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import tables
from ..sources import running
from .base import read, registry

QUERIES, ORACLE_SQL, query = registry()


@query("SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderpriority")
def facet_counts(spark, d):
    """AGG-5, AGG-6."""
    return read(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE ('all' = 'all' OR o_orderstatus = 'all') AND o_orderpriority = '1-URGENT' ORDER BY o_orderkey LIMIT 40")
def facet_filter(spark, d, status="all", priority="1-URGENT"):
    """FLT-12, SRT-10."""
    o = read(spark, d, "orders")
    for column, value in (("o_orderstatus", status), ("o_orderpriority", priority)):
        o = o if value == "all" else o.where(F.col(column) == value)
    return o.select("o_orderkey", "o_orderstatus", "o_orderpriority").orderBy("o_orderkey").limit(40)


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def latest_per_group(spark, d):
    """WIN-3, JOI-14."""
    return tables.first_per_group(read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).drop("o_orderdate")


@query("SELECT c_custkey, c_name, count(o_orderkey) AS n_orders, count(*) AS n_rows FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name")
def left_join_counts(spark, d):
    """JOI-2."""
    c, o = read(spark, d, "customer").select("c_custkey", "c_name"), read(spark, d, "orders").select("o_custkey", "o_orderkey")
    return c.join(o, c.c_custkey == o.o_custkey, "left").groupBy("c_custkey", "c_name").agg(F.count("o_orderkey").alias("n_orders"), F.count("*").alias("n_rows"))


@query("""SELECT o_orderkey, count(l_linenumber) AS n_lines, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey), '') AS lines
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def nest_children(spark, d):
    """JOI-3, AGG-19."""
    o = read(spark, d, "orders").select("o_orderkey")
    lines = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    nested = tables.nest(o, lines, "o_orderkey", ["l_linenumber", "l_partkey"], "parts")
    text = F.array_join(F.transform("parts", lambda p: F.concat_ws(":", p["l_linenumber"].cast("string"), p["l_partkey"].cast("string"))), ",")
    return nested.select("o_orderkey", F.size("parts").cast("long").alias("n_lines"), text.alias("lines"))


@query("SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND s_acctbal > 0")
def ownership_chain(spark, d):
    """JOI-11, FLT-6. Small dimensions: the planner broadcasts them by their files' sizes."""
    s, n, r = (read(spark, d, t) for t in ("supplier", "nation", "region"))
    return s.where("s_acctbal > 0").join(n, s.s_nationkey == n.n_nationkey).join(r.where("r_name = 'ASIA'"), n.n_regionkey == r.r_regionkey).select("s_suppkey", "n_name", "r_name")


@query("SELECT o_orderkey, o_orderdate, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate <= TIMESTAMP '1996-06-01' ORDER BY o_orderdate, o_orderkey LIMIT 40")
def due_queue(spark, d, now="1996-06-01"):
    """FLT-7, JOI-1, SRT-7, SRT-8."""
    o, c = read(spark, d, "orders"), read(spark, d, "customer").select("c_custkey", "c_name")
    return o.where(F.col("o_orderdate") <= F.lit(now).cast("timestamp_ntz")).join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "o_orderdate", "c_name").orderBy("o_orderdate", "o_orderkey").limit(40)


@query("SELECT DISTINCT p_brand, CASE p_brand WHEN 'Brand#11' THEN 'One' WHEN 'Brand#12' THEN 'Two' WHEN 'Brand#21' THEN 'Three' END AS label FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#21')")
def framework_lookup(spark, d):
    """A fixed dictionary of three entries, broadcast. Frameworks by dependency are `framework_facts`."""
    names = spark.createDataFrame([("brand#11", "One"), ("brand#12", "Two"), ("brand#21", "Three")], "key string, label string")
    p = read(spark, d, "part").select("p_brand")
    return p.join(F.broadcast(names), F.lower("p_brand") == F.col("key")).select("p_brand", "label").distinct()


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 49 AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def in_batches(spark, d):
    """FLT-8: an IN list as a semi-join."""
    wanted = read(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return read(spark, d, "lineitem").where("l_quantity >= 49").join(wanted, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("""SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 10 <> 3 UNION ALL SELECT o_orderkey, o_custkey, round(o_totalprice * 2, 2) AS o_totalprice FROM orders WHERE o_orderkey % 10 = 3""")
def upsert_merge(spark, d):
    """DML-2, DML-3: rows whose key ends in 3 come again with twice the price."""
    old = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    new = old.where("o_orderkey % 10 = 3").withColumn("o_totalprice", F.round(F.col("o_totalprice") * 2, 2))
    return tables.upsert(old, new, ["o_orderkey"])


@query("SELECT o_orderkey, o_custkey, 0 AS fresh FROM orders WHERE o_custkey % 2 = 0 UNION ALL SELECT o_orderkey, o_custkey, 1 AS fresh FROM orders WHERE o_custkey % 2 = 1 AND o_custkey % 3 = 0")
def insert_ignore(spark, d):
    """DML-1, DML-5, JOI-6, SET-4."""
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    old = o.where("o_custkey % 2 = 0").withColumn("fresh", F.lit(0))
    return tables.insert_ignore(old, o.where("o_custkey % 2 = 0 OR o_custkey % 3 = 0").withColumn("fresh", F.lit(1)), ["o_orderkey"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING')")
def cascade_delete(spark, d):
    """DML-4: customers of a segment go, their orders and lines with them."""
    c, o, li = read(spark, d, "customer").withColumnRenamed("c_custkey", "custkey"), read(spark, d, "orders").withColumnRenamed("o_custkey", "custkey").withColumnRenamed("o_orderkey", "orderkey"), read(spark, d, "lineitem").withColumnRenamed("l_orderkey", "orderkey")
    left = tables.delete_cascade({"customer": c.select("custkey", "c_mktsegment"), "orders": o.select("orderkey", "custkey"), "lineitem": li.select("orderkey", "l_linenumber")}, "customer", c.where("c_mktsegment = 'BUILDING'").select("custkey", "c_mktsegment"), [("customer", "orders", "custkey"), ("orders", "lineitem", "orderkey")])
    return left["lineitem"].select(F.col("orderkey").alias("l_orderkey"), "l_linenumber")


@query("""SELECT o_custkey, o_orderkey, n, gap_days, round(share, 6) AS share FROM (SELECT o_custkey, o_orderkey, row_number() OVER w - 1 AS n,
date_diff('day', o_orderdate, lead(o_orderdate) OVER w) AS gap_days, o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey) AS share FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))""")
def window_ordinals(spark, d):
    """WIN-4, WIN-6, WIN-7, WIN-10."""
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    share = F.round(F.col("o_totalprice") / F.sum("o_totalprice").over(W.partitionBy("o_custkey")), 6)
    return o.select("o_custkey", "o_orderkey", (F.row_number().over(w) - 1).cast("long").alias("n"), F.datediff(F.lead("o_orderdate").over(w), "o_orderdate").cast("long").alias("gap_days"), share.alias("share"))


@query("""SELECT o_custkey, o_orderkey, running FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM (SELECT o_custkey, o_orderkey, running FROM
(SELECT o_custkey, o_orderkey, sum(1000 + o_orderkey % 977) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM orders) WHERE running > 10000)) WHERE n = 1""")
def first_breach(spark, d):
    """WIN-5: the first row with which a running sum passes a cap."""
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", (1000 + F.col("o_orderkey") % 977).alias("v"))
    over = running(o, "v", ["o_orderkey"], "running", ["o_custkey"]).where("running > 10000").select("o_custkey", "o_orderkey", "running")
    return tables.first_per_group(over, ["o_custkey"], [F.col("o_orderkey")])


@query("SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 96 AS INT) AS batch FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'")
def batching(spark, d):
    """SRT-12."""
    return tables.batches(read(spark, d, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'").select("o_orderkey"), 96, ["o_orderkey"])


@query("SELECT list_aggregate(list_sort(list_distinct(list(lower(p_brand)))), 'string_agg', ',') AS vocabulary FROM (SELECT p_brand FROM part UNION ALL SELECT p_type FROM part)")
def vocabulary_union(spark, d):
    """SET-5, SET-1, SET-3, SRT-6: a vocabulary is a distinct of a union; one row of it."""
    p = read(spark, d, "part")
    words = p.select(F.lower("p_brand").alias("w")).unionByName(p.select(F.lower("p_type").alias("w"))).distinct()
    return words.agg(F.array_join(F.array_sort(F.collect_list("w")), ",").alias("vocabulary"))


@query("SELECT p_partkey, p_name FROM part ORDER BY lower(p_name), p_name, p_partkey LIMIT 50")
def locale_sort(spark, d):
    """SRT-5: names in collation order; for letters without accents, case decides last."""
    return read(spark, d, "part").select("p_partkey", "p_name").orderBy(F.collate("p_name", "UNICODE"), "p_partkey").limit(50)
