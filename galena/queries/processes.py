"""Graph upkeep, learning and policy gates, and lifecycle jobs. Events stand in for learning events
and observations, order lines for the edges between parts that are bought together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galena.operators import aggregates as A
from galena.operators import graph as G
from galena.operators import learning, lifecycle
from galena.queries.relational import _LIFECYCLE, lifecycle_standin
from galena.registry import query
from galena.sources.tables import parts_for, table

_PAIRS = """pairs AS (SELECT least(a.l_partkey, b.l_partkey) AS u, greatest(a.l_partkey, b.l_partkey) AS v, count(*) AS support, count(DISTINCT a.l_orderkey) AS queries,
  count(*) FILTER (WHERE a.l_returnflag = 'A') AS citations, CAST(date_diff('day', max(a.l_shipdate), TIMESTAMP '1999-01-01') AS BIGINT) AS age
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2)"""


def bought_together(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of parts over whole orders. An order's lines of a part are one row before they meet, and rows are dealt to as many
    tasks as the table's size calls for, so that no task grows with it."""
    lines = table(spark, d, "lineitem")
    cited = F.count_if(F.col("l_returnflag") == "A")
    own = lines.filter("l_orderkey is not null and l_partkey is not null").select("l_orderkey", "l_partkey", "l_returnflag", "l_shipdate")
    own = own.repartition(parts_for(lines), "l_orderkey").groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("n"), cited.alias("cited"), F.max("l_shipdate").alias("last"))
    a = own.select("l_orderkey", F.col("l_partkey").alias("u"), F.col("n").alias("nu"), "cited", "last")
    b = own.select("l_orderkey", F.col("l_partkey").alias("v"), F.col("n").alias("nv"))
    met = a.join(b.hint("merge"), "l_orderkey").filter("u < v").select("u", "v", (F.col("nu") * F.col("nv")).alias("support"), (F.col("cited") * F.col("nv")).alias("citations"), "last")
    age = F.datediff(F.lit("1999-01-01").cast("date"), F.max("last").cast("date")).cast("long")
    pairs = met.repartition(parts_for(lines, 4), "u", "v").groupBy("u", "v")
    return pairs.agg(F.sum("support").alias("support"), F.count("*").alias("queries"), F.sum("citations").alias("citations"), age.alias("age"))


@query(f"WITH {_PAIRS} SELECT u, v, support, queries, citations, age FROM pairs")
def pair_mining(spark: SparkSession, d: str) -> DataFrame:
    return bought_together(spark, d)


@query("""WITH f AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS n FROM lineitem GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n, l_partkey) AS r FROM f QUALIFY r <= 4)
SELECT a.l_partkey AS u, b.l_partkey AS v, count(*) AS requests FROM k a JOIN k b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2""")
def bounded_pairs(spark: SparkSession, d: str) -> DataFrame:
    """How many orders hold two parts among their first four."""
    pairs = G.context_pairs(table(spark, d, "lineitem"), "l_orderkey", "l_partkey", [F.col("l_linenumber")], 4)
    return pairs.groupBy("u", "v").agg(F.count("*").alias("requests"))


_SCORED = f"""{_PAIRS}, scored AS (SELECT *, greatest(0, least(1, (0.45 * (1 - exp(-support / 5.0)) + 0.20 * (1 - exp(-citations / 5.0)) + 0.35 * 0.8) * power(0.5, (age % 60) / 30.0))) AS w FROM pairs)"""


@query(f"""WITH {_SCORED} SELECT u, v, round(w, 6) AS weight, CASE WHEN round(w, 6) >= 0.35 AND queries >= 2 THEN 'WARM' WHEN age % 60 >= 30 THEN 'DECAYED' ELSE 'CANDIDATE' END AS band FROM scored""")
def edge_score_band(spark: SparkSession, d: str) -> DataFrame:
    age = F.col("age") % 60
    weight = F.round(G.association_score(F.col("support"), F.col("citations"), F.lit(0.8), age), 6)
    return bought_together(spark, d).select("u", "v", weight.alias("weight"), G.next_band(F.lit("CANDIDATE"), weight, F.col("queries"), F.col("citations"), age).alias("band"))


@query("""WITH e AS (SELECT event_id, user_id, event_id % 4 AS b, value / 500.0 AS w, event_id % 6 AS q, event_id % 2 AS c, event_id % 45 AS age FROM events)
SELECT event_id, CASE WHEN b = 0 THEN CASE WHEN w >= 0.35 AND q >= 2 THEN 'WARM' WHEN age >= 30 THEN 'DECAYED' ELSE 'CANDIDATE' END
  WHEN b = 1 THEN CASE WHEN w >= 0.65 AND q >= 4 AND c >= 1 THEN 'HOT' WHEN w < 0.2 THEN 'CANDIDATE' ELSE 'WARM' END
  WHEN b = 2 THEN CASE WHEN w < 0.5 THEN 'WARM' ELSE 'HOT' END ELSE 'DECAYED' END AS band FROM e""")
def edge_fsm(spark: SparkSession, d: str) -> DataFrame:
    bands = F.array(*map(F.lit, ("CANDIDATE", "WARM", "HOT", "DECAYED")))
    band = F.element_at(bands, (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", G.next_band(band, F.col("value") / 500.0, F.col("event_id") % 6, F.col("event_id") % 2, F.col("event_id") % 45).alias("band"))


@query(f"""WITH {_PAIRS}, edges AS (SELECT u AS src, v AS tgt, support FROM pairs UNION ALL SELECT v, u, support FROM pairs)
SELECT src, count(*) AS degree, sum(support) AS support FROM edges GROUP BY src""")
def symmetric_edges(spark: SparkSession, d: str) -> DataFrame:
    both = G.symmetric(bought_together(spark, d).select("u", "v", "support"))
    return both.groupBy(F.col("u").alias("src")).agg(F.count("*").alias("degree"), F.sum("support").alias("support"))


@query()
def graph_maintenance(spark: SparkSession, d: str) -> DataFrame:
    both = G.symmetric(bought_together(spark, d)).withColumnsRenamed({"u": "src", "v": "tgt", "age": "age_days"})
    edges = both.withColumns({"age_days": F.col("age_days") % 60, "likeness": F.lit(0.8), "band": F.lit("CANDIDATE")})
    edges = edges.repartition(parts_for(table(spark, d, "lineitem"), 8), "src")
    return G.maintained(edges).select("src", "tgt", "band", F.round("weight", 6).alias("weight"))


@query(f"""WITH {_SCORED}, edges AS (SELECT u AS src, v AS tgt, round(w, 6) AS w FROM scored UNION ALL SELECT v, u, round(w, 6) FROM scored), hot AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, tgt) AS r FROM edges WHERE w >= 0.5) WHERE r <= 4),
warm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, tgt) AS r FROM edges WHERE w >= 0.3 AND w < 0.5) WHERE r <= 2),
seeds AS (SELECT s_suppkey AS query, s_suppkey AS node FROM supplier),
reached AS (SELECT query, tgt, w AS c FROM seeds JOIN hot ON node = src UNION ALL SELECT query, tgt, w * 0.7 FROM seeds JOIN warm ON node = src)
SELECT query, tgt, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, tgt) AS r FROM (
  SELECT query, tgt, 1 - product(1 - c) AS score FROM reached WHERE tgt <> query GROUP BY 1, 2)) WHERE r <= 12""")
def graph_expansion(spark: SparkSession, d: str) -> DataFrame:
    weight = F.round(G.association_score(F.col("support"), F.col("citations"), F.lit(0.8), F.col("age") % 60), 6)
    edges = G.symmetric(bought_together(spark, d).select("u", "v", weight.alias("weight"))).withColumnsRenamed({"u": "src", "v": "tgt"})
    edges = edges.withColumn("band", F.when(F.col("weight") >= 0.5, "HOT").otherwise("WARM"))
    seeds = table(spark, d, "supplier").select(F.col("s_suppkey").alias("query"), F.col("s_suppkey").alias("node"), F.lit(1.0).alias("strength"))
    return G.expansions(seeds, edges).select("query", "tgt", F.round("score", 6).alias("score"))


@query("""WITH c AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY cited DESC, fused DESC, l_partkey) AS r FROM (
  SELECT l_orderkey, l_partkey, bool_or(l_returnflag = 'A') AS cited, max(l_quantity) AS fused FROM lineitem GROUP BY 1, 2)),
p AS (SELECT a.l_orderkey AS request, a.l_partkey AS u, b.l_partkey AS v, a.cited AND b.cited AS twice, a.fused + b.fused AS score FROM c a JOIN c b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey WHERE a.r <= 8 AND b.r <= 8 AND (a.cited OR b.cited))
SELECT request, u, v FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY twice DESC, score DESC, u, v) AS r FROM p) WHERE r <= 32""")
def co_citation(spark: SparkSession, d: str) -> DataFrame:
    context = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("request"), F.col("l_partkey").alias("chunk")).agg(F.bool_or(F.col("l_returnflag") == "A").alias("cited"), F.max("l_quantity").alias("fused"))
    return G.co_citations(context).select("request", "u", "v")


@query("""SELECT event_type AS query_class, lane, count(*) AS samples, round(avg(CASE WHEN c > 0 THEN 1.0 ELSE 0.0 END), 6) AS cited, round(avg(CASE WHEN s > 0 THEN 1.0 ELSE 0.0 END), 6) AS selected FROM (
  SELECT event_type, 'LEXICAL' AS lane, event_id % 5 AS c, event_id % 3 AS s FROM events UNION ALL SELECT event_type, 'CONCEPT', CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END, 0 FROM events) GROUP BY 1, 2""")
def router_support(spark: SparkSession, d: str) -> DataFrame:
    return learning.lane_support(_samples(spark, d)).select("query_class", "lane", "samples", F.round("cited", 6).alias("cited"), F.round("selected", 6).alias("selected"))


def _samples(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    lanes = lambda a, b: F.create_map(F.lit("LEXICAL"), a, F.lit("CONCEPT"), b)
    return table(spark, d, "events").select(F.col("event_type").alias("query_class"), i.alias("id"), lanes(i % 5, F.when(i % 50 == 0, 1).otherwise(0).cast("long")).alias("cited"), lanes(i % 3, F.lit(0).cast("long")).alias("selected"))


@query("""WITH s AS (SELECT event_type AS query_class, count(*) AS samples, avg(CASE WHEN event_id % 50 = 0 THEN 1.0 ELSE 0.0 END) AS cited FROM events GROUP BY 1),
c AS (SELECT query_class, count(*) AS n_sources, max(n) / sum(n) AS share FROM (SELECT event_type AS query_class, user_id, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1)
SELECT query_class, lane, CASE lane WHEN 'LEXICAL' THEN true ELSE cited >= 0.03 OR NOT (samples >= 50 AND n_sources >= 3 AND share <= 0.6) END AS keep
FROM s JOIN c USING (query_class) CROSS JOIN (SELECT unnest(['LEXICAL', 'CONCEPT']) AS lane)""")
def router_policy(spark: SparkSession, d: str) -> DataFrame:
    sources = table(spark, d, "events").groupBy(F.col("event_type").alias("query_class"), F.col("user_id").alias("source")).agg(F.count("*").alias("n"))
    return learning.router_policy(learning.lane_support(_samples(spark, d)), sources)


@query("""WITH o AS (SELECT event_id % 3 > 0 AS changed, user_id % 7 AS source, 4 AS t, CASE WHEN event_id % 200 = 0 THEN 3 ELSE 4 END AS f, 8 AS tc, CASE WHEN event_id % 20 = 0 THEN 7 ELSE 8 END AS fc, event_type = 'error' AND event_id % 9 = 0 AS failed, value * 10 AS latency FROM events),
s AS (SELECT count(*) FILTER (WHERE changed) AS samples, count(DISTINCT source) FILTER (WHERE changed) AS sources, sum(f) FILTER (WHERE changed) / sum(t) FILTER (WHERE changed) AS document_recall,
  sum(fc) FILTER (WHERE changed) / sum(tc) FILTER (WHERE changed) AS chunk_recall, avg(CASE WHEN failed THEN 1.0 ELSE 0.0 END) FILTER (WHERE changed) AS failure_rate, quantile_cont(latency, 0.95) FILTER (WHERE changed) AS p95 FROM o)
SELECT samples, sources, round(document_recall, 6) AS document_recall, round(chunk_recall, 6) AS chunk_recall, round(failure_rate, 6) AS failure_rate, round(p95, 6) AS p95,
  samples >= 100 AND sources >= 3 AND document_recall >= 0.99 AND chunk_recall >= 0.95 AND failure_rate <= 0.02 AND p95 <= 15000 AS passed FROM s""")
def shadow_gate(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    rows = table(spark, d, "events").select((i % 3 > 0).alias("changed"), (F.col("user_id") % 7).alias("source"), F.lit(4).alias("target_documents"), F.when(i % 200 == 0, 3).otherwise(4).alias("found_documents"), F.lit(8).alias("target_chunks"), F.when(i % 20 == 0, 7).otherwise(8).alias("found_chunks"), ((F.col("event_type") == "error") & (i % 9 == 0)).alias("failed"), (F.col("value") * 10).alias("latency"))
    out = learning.shadow_gate(rows)
    return out.select("samples", "sources", *[F.round(c, 6).alias(c) for c in ("document_recall", "chunk_recall", "failure_rate", "p95")], "passed")


@query("""WITH o AS (SELECT CASE WHEN user_id % 5 = 0 THEN 'CANARY' ELSE 'CONTROL' END AS cohort, event_type = 'purchase' AS g, event_type = 'error' AS u, value > 480 AS c, event_type = 'view' AS dg, value AS l FROM events),
s AS (SELECT count(*) FILTER (WHERE cohort = 'CANARY') AS canary, count(*) FILTER (WHERE cohort = 'CONTROL') AS control,
  avg(g::INT) FILTER (WHERE cohort = 'CONTROL') - avg(g::INT) FILTER (WHERE cohort = 'CANARY') AS grounded_drop, avg(u::INT) FILTER (WHERE cohort = 'CANARY') - avg(u::INT) FILTER (WHERE cohort = 'CONTROL') AS unavailable_rise,
  avg(c::INT) FILTER (WHERE cohort = 'CANARY') AS critical_rate, avg(dg::INT) FILTER (WHERE cohort = 'CANARY') - avg(dg::INT) FILTER (WHERE cohort = 'CONTROL') AS degraded_rise,
  quantile_cont(l, 0.95) FILTER (WHERE cohort = 'CANARY') / quantile_cont(l, 0.95) FILTER (WHERE cohort = 'CONTROL') - 1 AS p95_rise FROM o)
SELECT canary, control, round(grounded_drop, 6) AS grounded_drop, round(unavailable_rise, 6) AS unavailable_rise, round(critical_rate, 6) AS critical_rate, round(degraded_rise, 6) AS degraded_rise, round(p95_rise, 6) AS p95_rise,
  canary >= 100 AND control >= 300 AND grounded_drop <= 0.03 AND unavailable_rise <= 0.01 AND critical_rate <= 0.01 AND degraded_rise <= 0.05 AND p95_rise <= 0.2 AS passed FROM s""")
def canary_gate(spark: SparkSession, d: str) -> DataFrame:
    cohort = F.when(F.col("user_id") % 5 == 0, "CANARY").otherwise("CONTROL")
    rows = table(spark, d, "events").select(cohort.alias("cohort"), (F.col("event_type") == "purchase").alias("grounded"), (F.col("event_type") == "error").alias("unavailable"), (F.col("value") > 480).alias("critical"), (F.col("event_type") == "view").alias("degraded"), F.col("value").alias("latency"))
    out = learning.canary_gate(rows)
    return out.select("canary", "control", *[F.round(c, 6).alias(c) for c in ("grounded_drop", "unavailable_rise", "critical_rate", "degraded_rise", "p95_rise")], "passed")


@query("""SELECT event_id, CASE event_id % 6 WHEN 3 THEN 'APPROVED' WHEN 4 THEN 'SUPERSEDED' WHEN 5 THEN 'REJECTED' ELSE CASE WHEN value < 50 THEN 'REJECTED' WHEN event_id % 6 = 0 THEN 'SHADOW' WHEN event_id % 6 = 1 THEN 'CANARY' ELSE 'APPROVED' END END AS stage FROM events""")
def policy_promotion(spark: SparkSession, d: str) -> DataFrame:
    stages = F.array(*map(F.lit, ("CANDIDATE", "SHADOW", "CANARY", "APPROVED", "SUPERSEDED", "REJECTED")))
    stage = F.element_at(stages, (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", learning.next_stage(stage, F.col("value") >= 50).alias("stage"))


@query("""WITH b AS (SELECT event_type, user_id % 10 AS slice, round(avg(value), 6) AS before FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2), c AS (SELECT event_type, user_id % 10 AS slice, round(avg(value), 6) AS after FROM events WHERE event_id % 2 = 1 AND user_id % 10 < 9 GROUP BY 1, 2)
SELECT event_type, slice, before, after, CASE WHEN after IS NULL THEN 'MISSING' WHEN after < 40 THEN 'LOW' WHEN before - after > 10 THEN 'DROP' ELSE 'OK' END AS verdict FROM b FULL JOIN c USING (event_type, slice)""")
def baseline_compare(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").withColumn("slice", F.col("user_id") % 10)
    mean = lambda part: part.groupBy("event_type", "slice").agg(F.round(F.avg("value"), 6).alias("mean"))
    return learning.baseline_differences(mean(rows.filter("event_id % 2 = 0")), mean(rows.filter("event_id % 2 = 1 and slice < 9")), ["event_type", "slice"], "mean", 10, 40)


@query("""SELECT vec_id, round((0.5 * (label / 10.0) + 0.2 * (1.0 / (1 + vec_id % 5)) + 0.3 * (vec_id % 3) / 2.0) / 1.0, 9) AS utility FROM embeddings""")
def utility_score(spark: SparkSession, d: str) -> DataFrame:
    parts = [(F.col("label") / 10.0, 0.5), (1.0 / (1 + F.col("vec_id") % 5), 0.2), ((F.col("vec_id") % 3) / 2.0, 0.3)]
    return table(spark, d, "embeddings").select("vec_id", F.round(A.weighted_utility(parts), 9).alias("utility"))


@query()
def leader_clusters(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("scope"), F.col("vec_id").alias("id"), F.col("vec_id").alias("seq"), F.col("embedding").alias("vector"))
    return learning.leader_clusters(rows, "scope")


@query("SELECT CAST(label AS BIGINT) AS scope, vec_id AS id, true AS inside FROM embeddings")
def split_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Every row's cluster by folds of at most 200 rows; its leader is of its scope, and does not come behind it."""
    rows = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("scope"), F.col("vec_id").alias("id"), F.col("vec_id").alias("seq"), F.col("embedding").alias("vector"))
    found = learning.split_clusters(rows, "scope", 200)
    leaders = rows.select(F.col("id").alias("cluster"), F.col("scope").alias("own"))
    return found.join(leaders, "cluster", "left").select("scope", "id", F.coalesce((F.col("own") == F.col("scope")) & (F.col("cluster") <= F.col("id")), F.lit(False)).alias("inside"))


_C = "c AS (SELECT label, list(x ORDER BY dim) AS centroid, max(n) AS support FROM (SELECT label, dim, avg(x) AS x, count(*) AS n FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings) GROUP BY 1, 2) GROUP BY 1)"


@query(f"""WITH {_C} SELECT vec_id AS query, c.label AS cluster, round(list_cosine_similarity(embedding::DOUBLE[], centroid), 6) AS likeness FROM embeddings e JOIN c ON e.label = c.label
WHERE round(list_cosine_similarity(embedding::DOUBLE[], centroid), 6) >= 0.3""")
def memory_lookup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    memory = A.centroids(rows, "label", "embedding").select(F.col("label").alias("cluster"), F.array("label").alias("scope"), "centroid", "support")
    queries = rows.select(F.col("vec_id").alias("query"), F.array("label").alias("required"), F.col("embedding").alias("vector"))
    return learning.remembered(memory, queries, least=0.3).select("query", "cluster", "likeness")


@query(f"""WITH {_LIFECYCLE} SELECT l.document_id FROM lifecycle l WHERE retention_status = 'ACTIVE' AND expires_at <= TIMESTAMP '1999-01-01'
AND NOT EXISTS (SELECT 1 FROM lifecycle a WHERE a.document_id = l.document_id AND a.lifecycle_status = 'INGESTING') ORDER BY expires_at, document_id LIMIT 200""")
def retention_claims(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = lifecycle_standin(spark, d)
    active = rows.filter("lifecycle_status = 'INGESTING'")
    return lifecycle.retention_claims(rows, active, F.lit("1999-01-01").cast("timestamp_ntz"), 200).select("document_id")


@query("""SELECT o_orderkey AS document_id FROM orders o WHERE o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1997-12-31 23:00:00'
AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_shipdate > TIMESTAMP '1998-01-01')""")
def stale_ingestion(spark: SparkSession, d: str) -> DataFrame:
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), F.when(F.col("o_orderstatus") == "P", "INGESTING").otherwise("READY").alias("status"), F.col("o_orderdate").alias("started_at"))
    leases = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_shipdate").alias("lease_until"))
    return lifecycle.stale_ingestions(jobs, leases, F.lit("1998-01-01").cast("timestamp_ntz"), 3600).select("document_id")


@query(f"""WITH {_LIFECYCLE}, g AS (SELECT l_orderkey AS document_id, l_linenumber AS generation, CASE min(l_returnflag) WHEN 'R' THEN 'RETIRING' WHEN 'A' THEN 'RETIRED' ELSE 'PUBLISHED' END AS s, max(l_shipdate) AS u FROM lineitem GROUP BY 1, 2)
SELECT document_id, generation FROM g WHERE (s = 'RETIRING' OR (s = 'RETIRED' AND u < TIMESTAMP '1997-01-01' - INTERVAL 300 SECOND))
AND NOT EXISTS (SELECT 1 FROM published p WHERE p.document_id = g.document_id AND p.published_generation = g.generation)""")
def orphan_generations(spark: SparkSession, d: str) -> DataFrame:
    from galena.operators.eligibility import published

    rows, generations = lifecycle_standin(spark, d)
    live = published(rows, generations, F.lit("2000-01-01").cast("timestamp_ntz"))
    flag = F.min("l_returnflag")
    made = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("generation")).agg(F.when(flag == "R", "RETIRING").when(flag == "A", "RETIRED").otherwise("PUBLISHED").alias("generation_status"), F.max("l_shipdate").alias("updated_at"))
    return lifecycle.orphan_generations(made, live, F.lit("1997-01-01").cast("timestamp_ntz"), 300).select("document_id", "generation")


@query("""WITH c AS (SELECT o_orderkey AS document_id, 2 + o_orderkey % 3 AS generation, CASE WHEN o_orderkey % 11 = 0 THEN 'FAILED' WHEN o_orderkey % 7 = 0 THEN 'PUBLISHED' ELSE 'STAGING' END AS status FROM orders),
l AS (SELECT l_orderkey AS document_id, max(l_linenumber) AS live FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)
SELECT document_id, generation, CASE WHEN status = 'PUBLISHED' THEN 'ALREADY_PUBLISHED' WHEN status <> 'STAGING' THEN 'INVALID' WHEN live > generation THEN 'SUPERSEDED' WHEN live IS NOT NULL THEN 'PUBLISHED_AND_RETIRED_PREVIOUS' ELSE 'PUBLISHED' END AS outcome FROM c LEFT JOIN l USING (document_id)""")
def publication_outcomes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    candidates = table(spark, d, "orders").select(k.alias("document_id"), (2 + k % 3).alias("generation"), F.when(k % 11 == 0, "FAILED").when(k % 7 == 0, "PUBLISHED").otherwise("STAGING").alias("status"))
    _, generations = lifecycle_standin(spark, d)
    return lifecycle.publication_outcomes(candidates, generations)


@query("""SELECT key, seq, CASE WHEN n = 1 THEN 'CLAIMED' WHEN fingerprint <> owner THEN 'CONFLICT' WHEN arrived >= ready THEN 'REPLAY' ELSE 'RETRY_LATER' END AS decision FROM (
  SELECT *, row_number() OVER w AS n, first_value(fingerprint) OVER w AS owner, first_value(done_at) OVER w AS ready FROM (
  SELECT user_id AS key, event_id AS seq, CASE WHEN event_type = 'error' THEN 'b' ELSE 'a' END AS fingerprint, CAST(epoch(ts) AS BIGINT) AS arrived, CAST(epoch(ts) AS BIGINT) + 86400 AS done_at FROM events) WINDOW w AS (PARTITION BY key ORDER BY arrived, seq))""")
def idempotent_ingest(spark: SparkSession, d: str) -> DataFrame:
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    requests = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "b").otherwise("a").alias("fingerprint"), at.alias("at"), (at + 86400).alias("done_at"))
    return lifecycle.claim_decisions(requests)


@query("""SELECT lifecycle_status, retention_status, count(*) AS n, count(*) FILTER (WHERE expires_at IS NOT NULL) AS expiring, coalesce(count(*) FILTER (WHERE expires_at < TIMESTAMP '1999-06-01'), 0) AS overdue FROM (
  SELECT CASE WHEN o_orderstatus = 'P' THEN 'INGESTING' ELSE 'READY' END AS lifecycle_status, CASE WHEN o_orderpriority LIKE '5%' THEN 'EXPIRED' ELSE 'ACTIVE' END AS retention_status, CASE WHEN o_totalprice > 100000 THEN o_orderdate + INTERVAL 900 DAY END AS expires_at FROM orders) GROUP BY 1, 2""")
def retention_economics(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = lifecycle_standin(spark, d)
    late = F.col("expires_at") < F.lit("1999-06-01").cast("timestamp_ntz")
    return rows.groupBy("lifecycle_status", "retention_status").agg(F.count("*").alias("n"), F.count("expires_at").alias("expiring"), F.count(F.when(late, 1)).alias("overdue"))


@query("""SELECT quality, toxic, lang, count(*) AS n, round(avg(n_chars), 6) AS mean_chars FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2, 3""")
def labelled_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").groupBy("quality", "toxic", "lang").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))
