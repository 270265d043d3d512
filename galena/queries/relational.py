"""Relational idioms of the retrieval store over the star tables: lookups, upserts, joins,
aggregates, windows. Orders stand in for documents, their lines for chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galena.operators import aggregates as A
from galena.operators import ranking as R
from galena.registry import query
from galena.sources import tables as S
from galena.sources.tables import parts_for, table

AS_OF = "2024-01-20 00:00:00"


@query("""SELECT o.o_orderkey AS ordinal, l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_quantity
FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey""")
def key_lookup_ordinal(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderkey").alias("ordinal"))
    return S.key_lookup(keys, table(spark, d, "lineitem"), ["l_orderkey"], "ordinal").select("ordinal", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  count(*) OVER w AS n_near, sum(l_quantity) OVER w AS quantity_near
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)""")
def adjacent_scan(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber").rangeBetween(-1, 1)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.count("*").over(w).alias("n_near"), F.sum("l_quantity").over(w).alias("quantity_near"))


@query("""SELECT event_id, user_id, event_type FROM events
WHERE ts > TIMESTAMP '2024-01-15 00:00:00' OR (ts = TIMESTAMP '2024-01-15 00:00:00' AND event_id > 0)
ORDER BY ts, event_id LIMIT 100""")
def keyset_scan(spark: SparkSession, d: str) -> DataFrame:
    return S.keyset_page(table(spark, d, "events"), {"ts": "2024-01-15 00:00:00", "event_id": 0}, 100).select("event_id", "user_id", "event_type")


@query("""SELECT l_orderkey AS document, year(l_shipdate) AS generation, l_linenumber AS chunk_index, row_number() OVER (PARTITION BY l_orderkey, year(l_shipdate) ORDER BY l_linenumber) AS ordinal
FROM lineitem JOIN (SELECT l_orderkey AS o, max(year(l_shipdate)) AS g FROM lineitem GROUP BY 1) ON o = l_orderkey AND g = year(l_shipdate)""")
def generation_scan(spark: SparkSession, d: str) -> DataFrame:
    """Orders are documents, the years of their lines generations: the lines of the newest one, in order."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document"), F.year("l_shipdate").cast("long").alias("generation"), F.col("l_linenumber").alias("chunk_index"))
    newest = lines.groupBy("document").agg(F.max("generation").alias("generation"))
    out = S.generation_scan(lines, newest, [F.col("chunk_index")])
    return out.select("document", "generation", "chunk_index", F.col("ordinal").cast("long").alias("ordinal"))


@query("""SELECT user_id, event_type, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def upsert_latest_wins(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    old = F.col("ts") < F.lit(AS_OF).cast("timestamp_ntz")
    order = [F.desc("ts"), F.desc("event_id")]
    keys = ["user_id", "event_type"]
    return S.upsert(S.latest(events.filter(old), keys, order), events.filter(~old), keys, order).select("user_id", "event_type", "event_id", "value")


@query("""WITH stored AS (SELECT DISTINCT user_id, event_type FROM events WHERE ts < TIMESTAMP '2024-01-05 00:00:00'),
new AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00')
SELECT user_id, event_type, event_id FROM (
  SELECT n.*, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM new n
  WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.user_id = n.user_id AND s.event_type = n.event_type)) WHERE r = 1""")
def insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    old = F.col("ts") < F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")
    return S.insert_ignore(events.filter(old), events.filter(~old), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


@query("""SELECT l_linenumber AS generation, count(*) AS n, sum(l_quantity) AS quantity FROM (
  SELECT l_linenumber, l_quantity FROM lineitem UNION ALL SELECT 99, l_quantity FROM lineitem WHERE l_linenumber = 1) GROUP BY l_linenumber""")
def clone_generation(spark: SparkSession, d: str) -> DataFrame:
    out = S.clone_generation(table(spark, d, "lineitem").select("l_linenumber", "l_quantity"), "l_linenumber", 1, 99)
    return out.groupBy(F.col("l_linenumber").alias("generation")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("""SELECT l_orderkey, count(*) AS n FROM lineitem l
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus = 'P') GROUP BY l_orderkey""")
def delete_by_document(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return S.without(table(spark, d, "lineitem"), gone, ["l_orderkey"]).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("""SELECT strftime(date_trunc('month', ts), '%Y-%m') AS month, count(*) AS n, date_trunc('month', ts) < TIMESTAMP '2024-01-01' AS droppable
FROM events GROUP BY date_trunc('month', ts)""")
def audit_partitions(spark: SparkSession, d: str) -> DataFrame:
    month = F.date_trunc("month", F.col("ts").cast("timestamp"))
    return table(spark, d, "events").groupBy(month.alias("m")).agg(F.count("*").alias("n")).select(F.date_format("m", "yyyy-MM").alias("month"), "n", (F.col("m") < F.lit("2024-01-01").cast("timestamp")).alias("droppable"))


_LIFECYCLE = """lifecycle AS (SELECT o_orderkey AS document_id, c_nationkey AS access_level,
  CASE WHEN o_orderstatus = 'P' THEN 'INGESTING' ELSE 'READY' END AS lifecycle_status,
  CASE WHEN o_orderpriority LIKE '5%' THEN 'EXPIRED' ELSE 'ACTIVE' END AS retention_status,
  CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 2 END AS published_generation,
  CASE WHEN o_totalprice > 100000 THEN o_orderdate + INTERVAL 900 DAY END AS expires_at
  FROM orders JOIN customer ON o_custkey = c_custkey),
generations AS (SELECT DISTINCT l_orderkey AS document_id, l_linenumber AS generation,
  CASE WHEN l_returnflag = 'R' THEN 'RETIRED' ELSE 'PUBLISHED' END AS generation_status FROM lineitem),
published AS (SELECT * FROM lifecycle l WHERE lifecycle_status = 'READY' AND retention_status = 'ACTIVE'
  AND published_generation IS NOT NULL AND (expires_at IS NULL OR expires_at > TIMESTAMP '2000-01-01 00:00:00')
  AND EXISTS (SELECT 1 FROM generations g WHERE g.document_id = l.document_id AND g.generation = l.published_generation AND g.generation_status = 'PUBLISHED'))"""


def lifecycle_standin(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Lifecycle and generation tables that are derived from orders and their lines."""
    orders = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    status = F.col("o_orderstatus")
    lifecycle = orders.select(
        F.col("o_orderkey").alias("document_id"), F.col("c_nationkey").alias("access_level"),
        F.when(status == "P", "INGESTING").otherwise("READY").alias("lifecycle_status"),
        F.when(F.col("o_orderpriority").startswith("5"), "EXPIRED").otherwise("ACTIVE").alias("retention_status"),
        F.when(status == "F", 1).when(status == "O", 2).alias("published_generation"),
        F.when(F.col("o_totalprice") > 100000, F.expr("o_orderdate + INTERVAL 900 DAY")).alias("expires_at"))
    generations = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("generation"), F.when(F.col("l_returnflag") == "R", "RETIRED").otherwise("PUBLISHED").alias("generation_status")).distinct()
    return lifecycle, generations


@query(f"WITH {_LIFECYCLE} SELECT document_id, access_level, published_generation FROM published")
def published_eligibility(spark: SparkSession, d: str) -> DataFrame:
    from galena.operators.eligibility import published

    lifecycle, generations = lifecycle_standin(spark, d)
    return published(lifecycle, generations, F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")).select("document_id", "access_level", "published_generation")


@query(f"""WITH {_LIFECYCLE} SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, p.access_level FROM lineitem l
JOIN published p ON l.l_orderkey = p.document_id AND l.l_linenumber = p.published_generation WHERE p.access_level IN (1, 3, 5, 7, 11)""")
def acl_route(spark: SparkSession, d: str) -> DataFrame:
    from galena.operators.eligibility import published, routed

    lifecycle, generations = lifecycle_standin(spark, d)
    docs = routed(published(lifecycle, generations, F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")), [1, 3, 5, 7, 11])
    docs = docs.select(F.col("document_id").alias("l_orderkey"), F.col("published_generation").alias("l_linenumber"), "access_level")
    return table(spark, d, "lineitem").join(docs, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "access_level")


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O')
AND o_orderdate <= TIMESTAMP '1997-06-01' AND o_orderdate + INTERVAL 1000 DAY >= TIMESTAMP '1997-06-01'""")
def temporal_filter(spark: SparkSession, d: str) -> DataFrame:
    from galena.operators.eligibility import in_force

    status = F.when(F.col("o_orderstatus") == "F", "ACTIVE").when(F.col("o_orderstatus") == "O", "EFFECTIVE").otherwise("DRAFT")
    rows = table(spark, d, "orders").select("o_orderkey", F.create_map(F.lit("status"), status, F.lit("effectiveFrom"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("effectiveTo"), F.date_format(F.expr("o_orderdate + INTERVAL 1000 DAY"), "yyyy-MM-dd")).alias("metadata"))
    return rows.filter(in_force(F.col("metadata"), F.lit("1997-06-01").cast("date"))).select("o_orderkey")


@query("""SELECT p_partkey, p_name = 'x' AS exact, starts_with(p_type, 'S') AS prefix, contains(p_name, '_') AS partial, contains(p_name, '%') AS literal FROM part""")
def string_match(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", (F.col("p_name") == "x").alias("exact"), F.col("p_type").startswith("S").alias("prefix"), F.col("p_name").contains("_").alias("partial"), F.col("p_name").contains("%").alias("literal"))


@query("""WITH t AS (SELECT p_partkey, list_distinct(string_split(lower(p_type), ' ')) AS concepts FROM part)
SELECT p_partkey, len(list_intersect(concepts, ['steel', 'brass', 'promo', 'small']))::BIGINT AS n_shared,
  len(list_intersect(concepts, ['steel', 'brass', 'promo', 'small'])) / 4.0::DOUBLE AS score FROM t
WHERE len(list_intersect(concepts, ['steel', 'brass', 'promo', 'small'])) > 0""")
def array_overlap(spark: SparkSession, d: str) -> DataFrame:
    wanted = F.array(*map(F.lit, ("steel", "brass", "promo", "small")))
    rows = table(spark, d, "part").select("p_partkey", F.array_distinct(F.split(F.lower("p_type"), " ")).alias("concepts"))
    shared = F.size(F.array_intersect("concepts", wanted))
    return rows.filter(F.arrays_overlap("concepts", wanted)).select("p_partkey", shared.cast("long").alias("n_shared"), (shared / F.lit(4.0)).alias("score"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, len(json_keys(props))::BIGINT AS n_keys FROM events""")
def metadata_clean(spark: SparkSession, d: str) -> DataFrame:
    from galena.operators.eligibility import clean_metadata

    kept = clean_metadata(F.from_json("props", "map<string,string>"))
    return table(spark, d, "events").select("event_id", F.try_element_at(kept, F.lit("k")).cast("long").alias("k"), F.size(kept).cast("long").alias("n_keys"))


@query("""SELECT a.l_orderkey, least(a.l_partkey, b.l_partkey) AS u, greatest(a.l_partkey, b.l_partkey) AS v, count(*) AS n
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY ALL""")
def canonical_pairs(spark: SparkSession, d: str) -> DataFrame:
    from galena.operators.graph import canonical_pairs as pairs

    lines = table(spark, d, "lineitem")
    return pairs(lines.select("l_orderkey", "l_partkey").repartition(parts_for(lines), "l_orderkey"), ["l_orderkey"], "l_partkey")


@query("""SELECT count(*) FILTER (WHERE o_orderstatus IS DISTINCT FROM nullif(o_orderpriority, '1-URGENT')) AS n_different,
  count(*) FILTER (WHERE nullif(o_orderpriority, '1-URGENT') IS NOT DISTINCT FROM NULL) AS n_null FROM orders""")
def is_distinct_from(spark: SparkSession, d: str) -> DataFrame:
    other = F.nullif(F.col("o_orderpriority"), F.lit("1-URGENT"))
    return table(spark, d, "orders").agg(F.count(F.when(~F.col("o_orderstatus").eqNullSafe(other), 1)).alias("n_different"), F.count(F.when(other.eqNullSafe(F.lit(None)), 1)).alias("n_null"))


@query("""SELECT c_custkey, c_nationkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')""")
def semi_join(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(wanted, "c_custkey", "left_semi").select("c_custkey", "c_nationkey")


@query("""SELECT c_custkey, c_nationkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)""")
def anti_join(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(gone, "c_custkey", "left_anti").select("c_custkey", "c_nationkey")


@query("""SELECT c_custkey, coalesce(n, 0) AS n_orders, n IS NULL AS missing FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def left_join_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "customer").join(counts, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.col("n").isNull().alias("missing"))


@query("""SELECT s_suppkey, round(s_acctbal - a.mean, 6) AS above FROM supplier CROSS JOIN (SELECT avg(s_acctbal) AS mean FROM supplier) a""")
def cross_join_aggregate(spark: SparkSession, d: str) -> DataFrame:
    supplier = table(spark, d, "supplier")
    mean = supplier.agg(F.avg("s_acctbal").alias("mean"))  # one row
    return supplier.crossJoin(F.broadcast(mean)).select("s_suppkey", F.round(F.col("s_acctbal") - F.col("mean"), 6).alias("above"))


@query("""SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3""")
def lateral_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.top_k(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_LIFECYCLE}, edge AS (SELECT l_orderkey AS src, l_partkey AS tgt, l_quantity / 50.0 AS weight FROM lineitem)
SELECT e.src, e.tgt, count(*) AS n, round(max(e.weight), 6) AS weight FROM edge e JOIN published s ON e.src = s.document_id
JOIN generations gs ON gs.document_id = s.document_id AND gs.generation = s.published_generation
JOIN published t ON e.tgt = t.document_id JOIN generations gt ON gt.document_id = t.document_id AND gt.generation = t.published_generation
WHERE s.access_level = t.access_level AND gs.generation_status = 'PUBLISHED' AND gt.generation_status = 'PUBLISHED' GROUP BY e.src, e.tgt""")
def four_way_edge_join(spark: SparkSession, d: str) -> DataFrame:
    from galena.operators.eligibility import published
    from galena.operators.graph import live_edges

    lifecycle, generations = lifecycle_standin(spark, d)
    edges = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("tgt"), (F.col("l_quantity") / 50.0).alias("weight"))
    live = live_edges(edges, published(lifecycle, generations, F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")), generations)
    return live.groupBy("src", "tgt").agg(F.count("*").alias("n"), F.round(F.max("weight"), 6).alias("weight"))


@query("""SELECT o_orderkey, CASE WHEN n IS NULL THEN o_orderstatus WHEN late > n / 2 THEN 'LATE' ELSE 'SEEN' END AS status
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS late FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def update_from(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("late"))
    status = F.when(F.col("n").isNull(), F.col("o_orderstatus")).when(F.col("late") > F.col("n") / 2, "LATE").otherwise("SEEN")
    return table(spark, d, "orders").join(lines, "o_orderkey", "left").select("o_orderkey", status.alias("status"))


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 100) AS n_large, coalesce(round(sum(value) FILTER (WHERE value > 100), 4), 0) AS sum_large,
  round(avg(value) FILTER (WHERE user_id < 50), 6) AS avg_low, count(DISTINCT user_id) FILTER (WHERE value > 100) AS users_large, bool_or(value > 400) AS any_huge
FROM events GROUP BY event_type""")
def filtered_aggregates(spark: SparkSession, d: str) -> DataFrame:
    large = F.col("value") > 100
    return table(spark, d, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.count(F.when(large, 1)).alias("n_large"), F.coalesce(F.round(F.sum(F.when(large, F.col("value"))), 4), F.lit(0.0)).alias("sum_large"),
        F.round(F.avg(F.when(F.col("user_id") < 50, F.col("value"))), 6).alias("avg_low"), F.count_distinct(F.when(large, F.col("user_id"))).alias("users_large"), F.bool_or(F.col("value") > 400).alias("any_huge"))


@query("""SELECT event_type, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_disc(value, 0.95), 6) AS p95_rank, round(median(value), 6) AS middle FROM events GROUP BY event_type""")
def percentiles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.round(A.percentile_continuous(F.col("value"), 0.95), 6).alias("p95"), F.round(A.percentile_nearest_rank("value", 0.95), 6).alias("p95_rank"), F.round(F.median("value"), 6).alias("middle"))


@query("""SELECT o_orderpriority, CAST(epoch(TIMESTAMP '2000-01-01') - epoch(min(o_orderdate)) AS BIGINT) AS oldest_seconds, max(o_orderdate) >= TIMESTAMP '1998-01-01' AS fresh FROM orders GROUP BY 1""")
def epoch_age(spark: SparkSession, d: str) -> DataFrame:
    seconds = F.unix_timestamp(F.lit("2000-01-01").cast("timestamp")) - F.unix_timestamp(F.min("o_orderdate").cast("timestamp"))
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(seconds.alias("oldest_seconds"), (F.max("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).alias("fresh"))


@query("""SELECT user_id, round(1 - product(1 - least(value, 490.0) / 500.0), 9) AS chance FROM events GROUP BY user_id""")
def noisy_or(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.round(A.noisy_or(F.least("value", F.lit(490.0)) / 500.0), 9).alias("chance"))


@query("""SELECT event_type, count(DISTINCT user_id % 256) AS support, count(*) AS n FROM events GROUP BY event_type""")
def sketch_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(A.distinct_sketch(F.col("user_id")).alias("support"), F.count("*").alias("n"))


@query("""SELECT event_type, count(*) FILTER (WHERE r = 1) AS supports, round(sum(value) FILTER (WHERE r = 1), 4) AS first_value FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type, user_id % 256 ORDER BY ts, event_id) AS r FROM events) GROUP BY event_type""")
def gated_counters(spark: SparkSession, d: str) -> DataFrame:
    rows = A.first_per_bucket(table(spark, d, "events").withColumn("b", F.col("user_id") % 256), ["event_type"], "b", ["ts", "event_id"])
    return rows.groupBy("event_type").agg(F.count(F.when(F.col("grows"), 1)).alias("supports"), F.round(F.sum(F.when(F.col("grows"), F.col("value"))), 4).alias("first_value"))


@query("""SELECT user_id, CASE max(CASE WHEN value >= 300 THEN 3 WHEN value >= 150 THEN 2 WHEN value >= 10 THEN 1 ELSE 0 END)
  WHEN 3 THEN 'HOT' WHEN 2 THEN 'WARM' WHEN 1 THEN 'CANDIDATE' ELSE 'DECAYED' END AS band, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen, greatest(max(value), 1.0) AS weight FROM events GROUP BY user_id""")
def band_lattice_merge(spark: SparkSession, d: str) -> DataFrame:
    from galena.operators.graph import band_name, band_rank

    band = F.when(F.col("value") >= 300, "HOT").when(F.col("value") >= 150, "WARM").when(F.col("value") >= 10, "CANDIDATE").otherwise("DECAYED")
    return table(spark, d, "events").groupBy("user_id").agg(band_name(F.max(band_rank(band))).alias("band"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_seen"), F.greatest(F.max("value"), F.lit(1.0)).alias("weight"))


@query("""SELECT CASE WHEN user_id % 20 = 0 THEN 'CANARY' ELSE 'CONTROL' END AS cohort, count(*) AS n, round(avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END), 9) AS grounded,
  round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 9) AS critical, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1""")
def cohort_rates(spark: SparkSession, d: str) -> DataFrame:
    cohort = F.when(F.col("user_id") % 20 == 0, "CANARY").otherwise("CONTROL")
    return table(spark, d, "events").groupBy(cohort.alias("cohort")).agg(F.count("*").alias("n"), F.round(A.share(F.col("event_type") == "purchase"), 9).alias("grounded"), F.round(A.share(F.col("event_type") == "error"), 9).alias("critical"), F.round(A.percentile_continuous(F.col("value"), 0.95), 6).alias("p95"))


@query("""WITH s AS (SELECT CASE WHEN user_id % 10 = 0 THEN NULL ELSE user_id END AS source, count(*) AS n FROM events GROUP BY 1),
m AS (SELECT quantile_cont(n, 0.5) AS middle FROM s WHERE source IS NOT NULL)
SELECT round(max(n) FILTER (WHERE source IS NOT NULL) / sum(n), 9) AS max_share, count(*) FILTER (WHERE source IS NOT NULL) AS n_sources,
  round(coalesce(sum(n) FILTER (WHERE source IS NULL), 0) / sum(n), 9) AS unknown_share,
  round(count(*) FILTER (WHERE source IS NOT NULL AND n > 4 * middle) / count(*) FILTER (WHERE source IS NOT NULL), 9) AS outlier_rate FROM s, m""")
def source_concentration(spark: SparkSession, d: str) -> DataFrame:
    source = F.when(F.col("user_id") % 10 != 0, F.col("user_id"))
    out = A.concentration(table(spark, d, "events"), source)
    return out.select(*[F.round(c, 9).alias(c) if c != "n_sources" else F.col(c) for c in out.columns])


@query("""SELECT label, dim, round(avg(x), 6) AS mean, count(*) AS support FROM (
  SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) GROUP BY label, dim""")
def centroids(spark: SparkSession, d: str) -> DataFrame:
    out = A.centroids(table(spark, d, "embeddings"), "label", "embedding")
    return out.select("label", "support", F.posexplode("centroid").alias("dim", "x")).select("label", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("mean"), "support")


@query("""SELECT l_suppkey, successes, trials, CASE WHEN trials > 0 THEN round((p + 3.8416 / (2 * trials) - 1.96 * sqrt(p * (1 - p) / trials + 3.8416 / (4.0 * trials * trials))) / (1 + 3.8416 / trials), 9) ELSE 0 END AS bound
FROM (SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'N') AS successes, count(*) AS trials, count(*) FILTER (WHERE l_returnflag = 'N')::DOUBLE / count(*) AS p FROM lineitem GROUP BY 1)""")
def wilson_calibration(spark: SparkSession, d: str) -> DataFrame:
    rates = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count(F.when(F.col("l_returnflag") == "N", 1)).alias("successes"), F.count("*").alias("trials"))
    return rates.withColumn("bound", F.round(A.wilson_lower_bound(F.col("successes"), F.col("trials")), 9))


@query("""SELECT coalesce(o_orderkey, l_orderkey) AS document_id, coalesce(e, 0) AS expected, coalesce(s, 0) AS stored
FROM (SELECT o_orderkey, 1 + o_orderkey % 7 AS e FROM orders) FULL JOIN (SELECT l_orderkey, count(*) AS s FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE coalesce(e, 0) <> coalesce(s, 0)""")
def count_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    from galena.operators.lifecycle import count_differences

    expected = table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), (1 + F.col("o_orderkey") % 7).alias("expected"))
    stored = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("document_id")).agg(F.count("*").alias("stored"))
    return count_differences(expected, stored, "document_id")


@query("""SELECT o_custkey, len(list(o_orderkey))::BIGINT AS n, list_aggregate(list_sort(list(o_orderkey)), 'string_agg', ',') AS docs FROM orders GROUP BY o_custkey""")
def grouped_collect(spark: SparkSession, d: str) -> DataFrame:
    docs = F.array_sort(F.collect_list("o_orderkey"))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.array_join(docs.cast("array<string>"), ",").alias("docs"))


@query("""SELECT l_suppkey AS src, count(DISTINCT l_partkey) AS degree FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1""")
def degree_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").filter("l_returnflag <> 'R'").groupBy(F.col("l_suppkey").alias("src")).agg(F.count_distinct("l_partkey").alias("degree"))


@query("""SELECT l_suppkey AS src, l_partkey, l_orderkey, l_linenumber, band, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, band ORDER BY l_quantity DESC, l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rank FROM (
  SELECT *, CASE l_returnflag WHEN 'A' THEN 'HOT' WHEN 'R' THEN 'WARM' ELSE 'CANDIDATE' END AS band FROM lineitem)) WHERE rank > CASE band WHEN 'CANDIDATE' THEN 16 ELSE 8 END""")
def band_quota_overflow(spark: SparkSession, d: str) -> DataFrame:
    from galena.operators.graph import band_quota

    band = F.when(F.col("l_returnflag") == "A", "HOT").when(F.col("l_returnflag") == "R", "WARM").otherwise("CANDIDATE")
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), "l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", band.alias("band"))
    order = [F.desc("l_quantity"), F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]
    return R.overflow(rows, ["src", "band"], order, band_quota(F.col("band"))).select("src", "l_partkey", "l_orderkey", "l_linenumber", "band", F.col("rank").cast("long").alias("rank"))


@query("""SELECT DISTINCT ON (user_id, event_type) user_id, event_type, event_id FROM events
ORDER BY user_id, event_type, CASE WHEN value > 300 THEN 0 WHEN value > 100 THEN 1 ELSE 2 END, ts, event_id""")
def distinct_on_priority(spark: SparkSession, d: str) -> DataFrame:
    priority = F.when(F.col("value") > 300, 0).when(F.col("value") > 100, 1).otherwise(2)
    return S.latest(table(spark, d, "events"), ["user_id", "event_type"], [priority, F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "event_id")


@query("""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r > 4""")
def offset_trim(spark: SparkSession, d: str) -> DataFrame:
    return R.overflow(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], F.lit(4)).select("user_id", "event_id")


@query("""SELECT user_id, bucket, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id, bucket ORDER BY ts, event_id) AS rank FROM (
  SELECT *, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS bucket FROM events)) WHERE rank <= 2""")
def time_bucket_cap(spark: SparkSession, d: str) -> DataFrame:
    return R.time_bucket_cap(table(spark, d, "events"), "user_id", "ts", 86400, 2, ["event_id"]).select("user_id", "bucket", "event_id", F.col("rank").cast("long").alias("rank"))


@query("""SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 500) GROUP BY event_type""")
def recent_window(spark: SparkSession, d: str) -> DataFrame:
    recent = table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(500)
    return recent.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN o_totalprice END DESC NULLS LAST, CASE WHEN o_orderstatus = 'O' THEN o_totalprice END ASC NULLS FIRST, o_orderkey) AS place FROM orders""")
def nulls_ordering(spark: SparkSession, d: str) -> DataFrame:
    f, o = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")), F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))
    out = R.ranked(table(spark, d, "orders"), ["o_custkey"], [f.desc_nulls_last(), o.asc_nulls_first(), F.col("o_orderkey")], "place")
    return out.select("o_orderkey", F.col("place").cast("long").alias("place"))


@query("""SELECT o_custkey, list_sort(list_filter(a, lambda x: NOT list_contains(b, x))) AS only_f, list_sort(list_filter(a, lambda x: list_contains(b, x))) AS both FROM (
  SELECT o_custkey, list_distinct(list(o_orderpriority) FILTER (WHERE o_orderstatus = 'F')) AS a, coalesce(list_distinct(list(o_orderpriority) FILTER (WHERE o_orderstatus = 'O')), []) AS b FROM orders GROUP BY 1) WHERE a IS NOT NULL""")
def lane_set_operations(spark: SparkSession, d: str) -> DataFrame:
    sets = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))).alias("a"), F.collect_set(F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority"))).alias("b"))
    return sets.filter(F.size("a") > 0).select("o_custkey", F.array_sort(F.array_except("a", "b")).alias("only_f"), F.array_sort(F.array_intersect("a", "b")).alias("both"))


@query("""SELECT user_id, event_type, min(event_id) AS first_event FROM events GROUP BY user_id, event_type""")
def insertion_order_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_event"))
