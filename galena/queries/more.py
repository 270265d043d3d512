"""Expansion of hits by neighbours and parents, promotions, eligibility of remembered sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galena.operators import context, lifecycle
from galena.operators import ranking as R
from galena.registry import query
from galena.sources.tables import table


@query("""WITH s AS (SELECT o_custkey AS query, o_orderkey AS document, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders),
n AS (SELECT query, document, 3 + o AS chunk_index, place * 100 + CASE WHEN o = 0 THEN 0 ELSE 2 + o END AS position FROM s CROSS JOIN (SELECT unnest([-1, 0, 1]) AS o) WHERE place <= 5)
SELECT query, document, chunk_index, min(position) AS position FROM n WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = document AND l.l_linenumber = chunk_index) GROUP BY 1, 2, 3""")
def neighbour_expansion(spark: SparkSession, d: str) -> DataFrame:
    seeds = R.ranked(table(spark, d, "orders").select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("document"), "o_totalprice"), ["query"], [F.desc("o_totalprice"), F.col("document")], "place").withColumn("chunk_index", F.lit(3))
    chunks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document"), F.col("l_linenumber").alias("chunk_index"))
    out = context.neighbours(seeds, chunks)
    return out.select("query", "document", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("position").cast("long").alias("position"))


@query("""WITH k AS (SELECT DISTINCT l_orderkey AS document, l_linenumber AS chunk_index, l_linenumber % 2 AS parent_index FROM lineitem WHERE l_linenumber >= 2),
h AS (SELECT o_custkey AS query, l_orderkey AS document, l_linenumber AS chunk_index, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber) AS place FROM (SELECT DISTINCT o_custkey, l_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey)),
u AS (SELECT h.*, k.parent_index, coalesce(k.parent_index, h.chunk_index) AS shown FROM h LEFT JOIN k USING (document, chunk_index)),
o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY place) AS position FROM (SELECT *, row_number() OVER (PARTITION BY query, document, shown ORDER BY place) AS r FROM u) WHERE r = 1)
SELECT query, document, shown AS chunk_index, position FROM o WHERE parent_index IS NULL OR position <= 8""")
def parent_expansion(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document"), F.col("l_linenumber").alias("chunk_index")).distinct()
    kids = lines.filter("chunk_index >= 2").withColumn("parent_index", F.col("chunk_index") % 2).withColumn("role", F.lit("CHILD"))
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("document"))
    hits = R.ranked(orders.join(lines, "document"), ["query"], [F.col("document"), F.col("chunk_index")], "place")
    out = context.parents(hits, kids)
    return out.select("query", "document", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("position").cast("long").alias("position"))


@query("""SELECT o_custkey, bool_and(EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag <> 'R')) AS eligible FROM orders o GROUP BY o_custkey""")
def source_eligibility(spark: SparkSession, d: str) -> DataFrame:
    live = table(spark, d, "lineitem").filter("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("live", F.lit(True))
    return table(spark, d, "orders").join(live, "o_orderkey", "left").groupBy("o_custkey").agg(F.bool_and(F.coalesce("live", F.lit(False))).alias("eligible"))


@query("""SELECT query, hit FROM (SELECT c_custkey AS query, o_orderkey AS hit FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'P'
UNION ALL SELECT c_custkey, c_nationkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P'))""")
def empty_fallback(spark: SparkSession, d: str) -> DataFrame:
    customers, orders = table(spark, d, "customer"), table(spark, d, "orders")
    first = orders.filter("o_orderstatus = 'P'").join(customers.select(F.col("c_custkey").alias("o_custkey")), "o_custkey").select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("hit"))
    return R.empty_fallback(first, customers.select(F.col("c_custkey").alias("query"), F.col("c_nationkey").cast("long").alias("hit")), "query")


@query("""SELECT event_id, least(300.0, 5.0 * power(2.0, event_id % 9)) AS seconds FROM events""")
def retry_backoff(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", lifecycle.backoff_seconds(F.col("event_id") % 9 + 1).alias("seconds"))
