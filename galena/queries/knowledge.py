"""Discovery of edges, the learning loop, grounding, plans and concepts, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galena.functions import grounding, identifiers
from galena.operators import concepts, discovery, learning
from galena.operators import ranking as R
from galena.operators import retrieval as L
from galena.operators.graph import mutual_confidence
from galena.plans import lanes, planner
from galena.queries.search import _FUSED, _KNN, _V, WEIGHTS, _vectors, lane_hits
from galena.registry import query
from galena.sources.embedders import HashingEmbedder, embedded
from galena.sources.shared import stored
from galena.sources.tables import spread, table


@query(f"""WITH {_V}, near AS (SELECT query, hit, score, own FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, hit) AS r FROM (
  SELECT q.id AS query, v.id AS hit, round(list_cosine_similarity(q.e, v.e), 6) AS score, q.label = v.label AS own FROM v q JOIN v ON q.id % 50 = 0)) WHERE r <= 9)
SELECT query, hit, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, hit) AS rank FROM near WHERE query <> hit AND own AND score >= 0.05 AND score < 0.98 AND hit % 20 < 16 QUALIFY rank <= 4""")
def semantic_links(spark: SparkSession, d: str) -> DataFrame:
    rows = _vectors(spark, d)
    near = L.vector_lane(rows.filter("hit % 50 = 0").withColumnRenamed("hit", "query"), rows, 9)
    labels = rows.select("hit", "label")
    near = near.join(labels, "hit").join(labels.select(F.col("hit").alias("query"), F.col("label").alias("own")), "query").withColumn("alike", F.col("own") == F.col("label"))
    degrees = rows.select("hit", (F.col("hit") % 20).alias("degree"))
    return discovery.semantic_links(near, degrees, least=0.05).withColumn("rank", F.col("rank").cast("long"))


_MUTUAL = f"""{_KNN}, m AS (SELECT a.query AS u, a.hit AS v, round(greatest(0, least(1, least(a.score, b.score) * (0.85 + 0.15 * (1 - (greatest(a.rank, b.rank) - 1) / 8.0)))), 9) AS c
FROM near a JOIN near b ON a.query = b.hit AND a.hit = b.query AND a.query < a.hit)"""


def mutual_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = L.mutual(L.nearest_in_scope(_vectors(spark, d), "label", 8))
    return pairs.select("u", "v", F.round(mutual_confidence(F.col("forward"), F.col("backward"), F.col("worst"), 8), 9).alias("confidence"))


@query(f"""WITH {_MUTUAL}, stored AS (SELECT u, v, c, CASE WHEN v % 3 = 0 THEN 'ACTIVE' ELSE 'CANDIDATE' END AS state FROM m WHERE u % 2 = 0), good AS (SELECT * FROM m WHERE v % 5 <> 0 AND c >= 0.2),
new AS (SELECT u, v, c FROM good g WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.u = g.u AND s.v = g.v) QUALIFY row_number() OVER (PARTITION BY u ORDER BY c DESC, v) <= 3),
now AS (SELECT g.u, g.v, g.c FROM good g JOIN stored s ON s.u = g.u AND s.v = g.v UNION ALL SELECT * FROM new)
SELECT u, v, coalesce(now.c, stored.c) AS confidence, CASE WHEN now.c IS NULL THEN 'STALE' WHEN now.c >= 0.3 OR (state = 'ACTIVE' AND now.c >= 0.25) THEN 'ACTIVE' ELSE 'CANDIDATE' END AS state FROM stored FULL JOIN now USING (u, v)""")
def dream_candidates(spark: SparkSession, d: str) -> DataFrame:
    pairs = mutual_pairs(spark, d)
    stored = pairs.filter("u % 2 = 0").withColumn("state", F.when(F.col("v") % 3 == 0, "ACTIVE").otherwise("CANDIDATE"))
    return discovery.observed(stored, pairs.filter("v % 5 <> 0"), candidate=0.2, activate=0.3, retain=0.25)


@query(f"""WITH {_MUTUAL}, ends AS (SELECT u, v, c, u AS node FROM m UNION ALL SELECT u, v, c, v FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY c DESC, u, v) AS r FROM ends)
SELECT u, v, c AS confidence FROM r GROUP BY u, v, c HAVING max(r) <= 3""")
def prior_degree(spark: SparkSession, d: str) -> DataFrame:
    return discovery.within_degree(mutual_pairs(spark, d), 3)


@query("""SELECT o_custkey % 8 AS shard, o_orderkey AS unit, round(sum(o_totalprice) OVER (PARTITION BY o_custkey % 8 ORDER BY o_orderkey), 2) AS spent FROM orders WHERE o_orderstatus <> 'F' QUALIFY round(sum(o_totalprice) OVER (PARTITION BY o_custkey % 8 ORDER BY o_orderkey), 2) <= 5000000""")
def dream_units(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    units = orders.select((F.col("o_custkey") % 8).alias("shard"), F.col("o_orderkey").alias("unit"), F.col("o_totalprice").alias("cost"))
    done = orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("unit"))
    return discovery.next_units(units, done, 5_000_000.004).select("shard", "unit", F.round("spent", 2).alias("spent"))


@query("""SELECT l_suppkey AS src, l_partkey AS tgt, count(*) AS shown, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM lineitem c WHERE c.l_orderkey = l.l_orderkey AND c.l_partkey = l.l_partkey AND c.l_returnflag = 'A')) AS cited FROM lineitem l GROUP BY 1, 2""")
def edge_utility(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    shown = lines.select(F.col("l_orderkey").alias("query"), F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("tgt"))
    cited = lines.filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("query"), F.col("l_partkey").alias("tgt"))
    return discovery.edge_utility(shown, cited)


@query("""SELECT user_id AS job, event_type AS owner FROM events WHERE ts + to_seconds(CAST(floor(value * 1000) AS INT)) > TIMESTAMP '2024-01-20' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")
def live_leases(spark: SparkSession, d: str) -> DataFrame:
    until = F.col("ts") + F.make_dt_interval(secs=F.floor(F.col("value") * 1000).cast("int"))
    leases = table(spark, d, "events").select(F.col("user_id").alias("job"), F.col("event_type").alias("owner"), F.col("event_id").alias("fence"), until.alias("until"))
    return discovery.lease_holder(leases, F.lit("2024-01-20").cast("timestamp_ntz"))


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id % 100 = 0))
SELECT user_id AS request, event_type AS query_class, CASE WHEN event_id % 10 = 0 THEN 0 ELSE event_id % 30 END AS retrieved, CASE WHEN event_id % 10 = 0 THEN 0 ELSE event_id % 7 END AS selected, CASE WHEN event_id % 10 = 0 THEN 0 ELSE event_id % 3 END AS cited FROM n WHERE r = 1""")
def learning_events(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    i = F.col("event_id")
    trace = F.to_json(F.struct((i % 30).alias("retrieved"), (i % 7).alias("selected"), (i % 3).alias("cited"), F.create_map(F.lit("LEXICAL"), i % 5).alias("lanes")))
    requests = events.select(F.col("user_id").alias("request"), i.alias("seq"), F.col("event_type").alias("query_class"), F.when(i % 10 == 0, "{").otherwise(trace).alias("trace"))
    stored = events.filter("event_id % 100 = 0").select(F.col("user_id").alias("request"))
    out = learning.recorded(stored, requests)
    return out.select("request", "query_class", *[F.col(c).cast("long").alias(c) for c in ("retrieved", "selected", "cited")])


@query("""WITH t AS (SELECT DISTINCT l_orderkey AS q, l_suppkey AS d, l_partkey AS c FROM lineitem WHERE l_returnflag = 'R'), h AS (SELECT DISTINCT l_orderkey AS q, l_suppkey AS d, l_partkey AS c FROM lineitem WHERE l_quantity > 10)
SELECT q AS query, count(*) AS target_chunks, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM h WHERE h.q = t.q AND h.d = t.d AND h.c = t.c)) AS found_chunks, count(DISTINCT d) AS target_documents, count(DISTINCT CASE WHEN EXISTS (SELECT 1 FROM h WHERE h.q = t.q AND h.d = t.d) THEN d END) AS found_documents, q % 2 = 0 AS changed FROM t GROUP BY q""")
def shadow_retention(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query"), F.col("l_suppkey").alias("document"), F.col("l_partkey").alias("chunk"), "l_returnflag", "l_quantity")
    changed = lines.select("query").distinct().withColumn("changed", F.col("query") % 2 == 0)
    return learning.shadow_observations(lines.filter("l_returnflag = 'R'"), lines.filter("l_quantity > 10"), changed)


@query("""WITH f AS (SELECT event_id % 500 AS request, user_id AS source, event_type AS reason, event_id AS seq FROM events QUALIFY row_number() OVER (PARTITION BY event_id % 500 ORDER BY event_id) = 1)
SELECT request, source, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY seq, request) > 5 THEN 'CAPPED' WHEN reason = 'error' THEN 'SPECIFIC' WHEN reason = 'view' THEN 'GENERAL' ELSE 'WEAK' END AS trust FROM f""")
def feedback_trust(spark: SparkSession, d: str) -> DataFrame:
    reason = F.when(F.col("event_type") == "error", " outdated ").when(F.col("event_type") == "view", "HELPFUL").otherwise(F.col("event_type"))
    rows = table(spark, d, "events").select((F.col("event_id") % 500).alias("request"), F.col("user_id").alias("source"), reason.alias("reason"), F.col("event_id").alias("seq"))
    return learning.feedback(rows).select("request", "source", "trust")


@query(f"""WITH {_FUSED} SELECT 'PRODUCED' AS stage, lane, count(*) AS n FROM hits GROUP BY lane UNION ALL SELECT 'SELECTED', lane, count(*) FROM hits JOIN fused USING (query, hit) WHERE place <= 5 GROUP BY lane
UNION ALL SELECT 'CITED', lane, count(*) FROM hits JOIN fused USING (query, hit) WHERE place = 1 GROUP BY lane""")
def stage_attribution(spark: SparkSession, d: str) -> DataFrame:
    hits = stored(lane_hits(spark, d), "hits")  # used twice
    places = L.fused(hits, WEIGHTS).select("query", "hit", "place")
    placed = hits.join(places, ["query", "hit"], "left")
    return learning.attribution(placed, {"PRODUCED": F.lit(True), "SELECTED": F.col("place") <= 5, "CITED": F.col("place") == 1})


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 3 = 0 THEN 'UNGROUNDED' ELSE 'GROUNDED' END AS status, 2 AS sentences, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS missing,
  CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS mismatched FROM orders""")
def answer_grounding(spark: SparkSession, d: str) -> DataFrame:
    """Answers whose numbers, dates and citations are right or wrong by the order's key."""
    k = F.col("o_orderkey")
    number = F.concat((k % 900 + 1).cast("string"), F.lit(" mg"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    answer = F.concat(F.lit("Take at least "), number, F.lit(" from "), day, F.lit(" on. [SOURCE 1] It helps."), F.when(k % 5 == 0, " [SOURCE 9]").otherwise(" [SOURCE 2]"))
    first = F.when(k % 3 == 0, F.concat(day, F.lit(": at least "), number)).otherwise(F.concat(F.lit("At least "), number, F.lit(", since "), day))
    rows = table(spark, d, "orders").select("o_orderkey", grounding.verdict(answer, F.lit("en"), F.array(first, F.lit("It helps."))).alias("v"))
    return rows.select("o_orderkey", "v.status", "v.sentences", "v.missing", "v.mismatched")


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'REJECTED' WHEN event_id % 4 = 1 THEN 'INSUFFICIENT' WHEN event_id % 4 = 2 THEN 'INSUFFICIENT' ELSE 'GROUNDED' END AS verdict FROM events""")
def entailment_verdicts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 4
    labels = F.when(k == 0, F.array(F.lit("SUPPORTED"), F.lit("CONTRADICTED"))).when(k == 1, F.array(F.lit("SUPPORTED"), F.lit("NEUTRAL"))).when(k == 2, F.array().cast("array<string>")).otherwise(F.array(F.lit("SUPPORTED")))
    return table(spark, d, "events").select("event_id", grounding.entailment_verdict(labels).alias("verdict"))


@query("""WITH p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN ['IDENTIFIER', 'VECTOR', 'LEXICAL', 'REFERENCE'] ELSE ['VECTOR', 'LEXICAL', 'REFERENCE'] END AS lanes FROM orders), l AS (SELECT o_orderkey, unnest(lanes) AS lane FROM p),
h AS (SELECT o_orderkey, lane, CASE lane WHEN 'IDENTIFIER' THEN o_orderkey % 3 WHEN 'VECTOR' THEN o_orderkey % 5 WHEN 'LEXICAL' THEN o_orderkey % 7 ELSE 1 END AS n FROM l),
s AS (SELECT *, max(CASE WHEN lane = 'IDENTIFIER' THEN n END) OVER (PARTITION BY o_orderkey) AS by_id, sum(CASE WHEN lane <> 'REFERENCE' THEN n ELSE 0 END) OVER (PARTITION BY o_orderkey) AS before FROM h)
SELECT o_orderkey, lane, CASE WHEN lane <> 'IDENTIFIER' AND by_id = 0 THEN 'SKIPPED_DEPENDENCY' WHEN lane = 'REFERENCE' AND before = 0 THEN 'SKIPPED_DEPENDENCY' WHEN n = 0 THEN 'EMPTY' ELSE 'SUCCESS' END AS status FROM s""")
def lane_outcomes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    base = F.array(*map(F.lit, ("VECTOR", "LEXICAL", "REFERENCE")))
    plans = table(spark, d, "orders").select("o_orderkey", F.lit("GENERIC").alias("kind"), F.when(k % 2 == 0, F.concat(F.array(F.lit("IDENTIFIER")), base)).otherwise(base).alias("lanes"))
    lane = F.col("lane")
    number = F.when(lane == "IDENTIFIER", k % 3).when(lane == "VECTOR", k % 5).when(lane == "LEXICAL", k % 7).otherwise(1)
    hits = plans.select("o_orderkey", F.explode("lanes").alias("lane")).withColumn("n", number.cast("int")).filter("n > 0").select("o_orderkey", "lane", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    return planner.step_outcomes(plans, hits, "o_orderkey")


@query("""SELECT query, hit FROM (SELECT n_nationkey AS query, p_partkey AS hit, row_number() OVER (PARTITION BY n_nationkey ORDER BY p_partkey) AS r FROM nation JOIN part ON p_size = n_nationkey) WHERE r <= 10""")
def identifier_lane(spark: SparkSession, d: str) -> DataFrame:
    """Parts are documents that name an order by their size; nations ask for an order by their key."""
    made = lambda c: identifiers.extracted(F.concat(F.lit("order no. A-"), c.cast("string"), F.lit("/7")))
    postings = table(spark, d, "part").select(F.col("p_partkey").alias("hit"), F.explode(made(F.col("p_size"))).alias("x")).select("hit", "x.type", "x.normalized")
    plans = table(spark, d, "nation").select(F.col("n_nationkey").alias("query"), made(F.col("n_nationkey")).alias("identifiers"))
    return lanes.identifier_lane(plans, postings).select("query", "hit")


_TYPES = "t AS (SELECT p_partkey AS hit, list_distinct(string_split(lower(p_type), ' ')) AS cs FROM part), q AS (SELECT s_suppkey AS query, ['steel', 'promo', 'nothing', 'small'][1:(s_suppkey % 4 + 1)] AS cs FROM supplier)"


@query(f"""WITH {_TYPES} SELECT query, hit, len(list_intersect(q.cs, t.cs)) / len(q.cs) AS score FROM q JOIN t ON len(list_intersect(q.cs, t.cs)) > 0 QUALIFY row_number() OVER (PARTITION BY query ORDER BY len(list_intersect(q.cs, t.cs)) / len(q.cs) DESC, hit) <= 4""")
def concept_lane(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "part").select(F.col("p_partkey").alias("hit"), F.array_distinct(F.split(F.lower("p_type"), " ")).alias("concepts"))
    named = F.slice(F.array(*map(F.lit, ("steel", "promo", "nothing", "small"))), F.lit(1), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return concepts.concept_lane(table(spark, d, "supplier").select(F.col("s_suppkey").alias("query"), named.alias("concepts")), docs).select("query", "hit", "score")


@query("""WITH w AS (SELECT p_partkey, string_split(lower(p_type), ' ') AS ws FROM part), m AS (SELECT p_partkey, 'metal' AS c, 1.0 AS weight FROM w WHERE list_contains(ws, 'steel') OR list_contains(ws, 'brass')
  UNION ALL SELECT p_partkey, 'offer', 1.0 FROM w WHERE list_contains(ws, 'promo') UNION ALL SELECT p_partkey, 'offer.steel', 2.0 FROM w WHERE contains(' ' || array_to_string(ws, ' ') || ' ', ' promo steel '))
SELECT p_partkey, list(c ORDER BY weight DESC, c) AS concepts FROM m GROUP BY 1""")
def concept_annotation(spark: SparkSession, d: str) -> DataFrame:
    surfaces = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(c).alias("concept"), F.lit("en").alias("language"), F.lit(p).alias("phrase")) for c, p in (("metal", "steel"), ("metal", "brass"), ("offer", "Promo"), ("offer.steel", "promo steel"))])))
    rows = table(spark, d, "part").select("p_partkey", F.lit("en").alias("language"), F.lower("p_type").alias("t"))
    found = concepts.matched(rows, F.broadcast(surfaces), "p_partkey", "t").filter("mode = 'EXACT'")
    return concepts.annotated(found, "p_partkey")


@query("""SELECT n_nationkey AS query, CASE n_nationkey % 3 WHEN 0 THEN 'de' WHEN 1 THEN 'fr' ELSE 'unknown' END AS language, CASE n_nationkey % 3 WHEN 0 THEN ['dose', 'term'] WHEN 1 THEN ['term'] ELSE [] END AS concepts FROM nation""")
def query_analysis(spark: SparkSession, d: str) -> DataFrame:
    named = (("dose", "de", "dosis"), ("term", "de", "frist"), ("dose", "fr", "posologie"), ("term", "fr", "frist"), ("dose", "es", "dosis"))
    surfaces = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(c).alias("concept"), F.lit(la).alias("language"), F.lit(p).alias("phrase")) for c, la, p in named])))
    k = F.col("n_nationkey")
    texts = F.when(k % 3 == 0, "Dosis und Frist").when(k % 3 == 1, "Frist").otherwise("nichts davon")
    return concepts.analysed(table(spark, d, "nation").select(k.alias("query"), texts.alias("text"), F.lit("unknown").alias("language")), surfaces).select("query", "language", "concepts")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'LEGAL' WHEN 1 THEN 'MEDICAL' WHEN 2 THEN 'TECHNICAL' ELSE 'GENERAL' END AS industry, CASE o_orderkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 2 END AS level FROM orders""")
def industry_profiles(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    body = F.when(k == 0, "This contract is made pursuant to the agreement; the patient server").when(k == 1, "Dosage for patients under therapy by contract").when(k == 2, "server configuration of the API").otherwise("plain words")
    line = F.when(k == 0, F.concat(F.lit("Article "), F.col("o_orderkey"))).when(k == 1, "Warnings and notes").when(k == 2, "2.1 Start").otherwise("Article 5")
    rows = table(spark, d, "orders").select("o_orderkey", concepts.industry(body).alias("industry"), line.alias("line"))
    return rows.select("o_orderkey", "industry", concepts.heading_level(F.col("line"), F.col("industry")).alias("level"))


@query("""SELECT n_nationkey, 'ARTICLE' AS type, CAST(n AS VARCHAR) AS value FROM nation, (SELECT unnest(range(3, 6)) AS n) UNION ALL SELECT n_nationkey, 'ARTICLE', CAST(n_nationkey + 1 AS VARCHAR) FROM nation WHERE n_nationkey + 1 NOT IN (3, 4, 5)
UNION ALL SELECT n_nationkey, 'CHAPTER', '120' FROM nation UNION ALL SELECT n_nationkey, 'TABLE', CAST(n_nationkey AS VARCHAR) FROM nation UNION ALL SELECT n_nationkey, 'APPENDIX', 'B' FROM nation
UNION ALL SELECT n_nationkey, 'RFC', 'RFC ' || (2000 + n_nationkey) FROM nation UNION ALL SELECT n_nationkey, 'LAW', 'Regulation (EU) 2016/679' FROM nation""")
def outside_references(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    body = F.concat(F.lit("第三至五条和第"), k + 1, F.lit("条，第一百二十章; Table "), k, F.lit(", Annex B; RFC"), k + 2000, F.lit(" and Regulation (EU) 2016/679."))
    found = F.concat(identifiers.chinese_references(body), identifiers.named_objects(body), identifiers.external_references(body))
    return table(spark, d, "nation").select("n_nationkey", F.explode(found).alias("x")).select("n_nationkey", "x.type", "x.value")


#: Concepts that turns and documents of these tables hold, by their phrases in two languages.
_TOPICS = (("thing", "en", "things"), ("part.of", "en", "of the"), ("inside", "en", "in the"), ("part.of", "de", "von der"), ("inside", "de", "in der"), ("part.of", "fr", "de la"), ("inside", "fr", "dans le"), ("part.of", "es", "de la"))


def _topics(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*[F.struct(*map(F.lit, t)) for t in _TOPICS]))).toDF("concept", "language", "phrase")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "conversations")).filter("role = 'user'").select(F.struct("conv_id", "turn").alias("query"), "text")


@query()
def planned_search(spark: SparkSession, d: str) -> DataFrame:
    """Every part of every user turn over documents, by the lexical, vector and concept lanes that its plan has."""
    docs = spread(table(spark, d, "documents")).select(F.col("doc_id").alias("hit"), "text", "lang")
    embedder, topics = HashingEmbedder(), F.broadcast(_topics(spark))
    held = concepts.annotated(concepts.matched(docs.select("hit", F.col("lang").alias("language"), "text"), topics, "hit", "text"), "hit")
    index = lanes.Index(docs.select("hit", "text"), concepts=held, surfaces=topics, vectors=embedded(docs.select("hit", "text"), embedder), embedder=embedder)
    plans = planner.planned(_asked(spark, d), "query", "text", topics)
    return lanes.searched(plans, index, 5).select("query.conv_id", "query.turn", "part", "lane", "hit", "rank")


_WORDS = r"' ' || trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) || ' '"


@query(f"""WITH t AS (SELECT conv_id, turn, {_WORDS} AS w FROM conversations WHERE role = 'user'),
m AS (SELECT conv_id, turn, contains(w, ' of the ') AS a, contains(w, ' in the ') AS b, contains(w, ' things ') AS c, contains(w, ' thing ') OR contains(w, ' things ') AS l FROM t)
SELECT conv_id, turn, CASE WHEN NOT (a OR b OR l) THEN 'GENERIC' WHEN (a OR b OR c) AND NOT (l AND NOT c) THEN 'CONCEPTUAL_EXACT' ELSE 'CONCEPTUAL_FUZZY' END AS kind FROM m""")
def concept_plans(spark: SparkSession, d: str) -> DataFrame:
    """The class of each user turn as a whole, by the English concepts that it holds word by word or by its lemmas.
    Turns are taken as English, so that the class rests on the concepts alone."""
    english = F.broadcast(_topics(spark).filter("language = 'en'"))
    turns = _asked(spark, d).select("query", "text", F.lit("en").alias("language"))
    found = concepts.analysed(turns, english)
    kind = planner.query_class(F.lit(False), F.lit(True), F.col("confidence"), F.col("exact"))
    return found.select("query.conv_id", "query.turn", kind.alias("kind"))


@query()
def hyde_hits(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items stand in for the passages that a model wrote."""
    docs = spread(table(spark, d, "documents")).select(F.col("doc_id").alias("hit"), "text")
    embedder = HashingEmbedder()
    index = lanes.Index(docs, vectors=embedded(docs, embedder), embedder=embedder)
    return lanes.hyde_lane(table(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text"), index)


@query("""WITH b AS (SELECT o_custkey AS query, o_orderkey AS hit, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders QUALIFY place <= 8),
g AS (SELECT DISTINCT o_custkey AS query, l_partkey AS hit FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 45), n AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY hit) AS r FROM g WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.query = g.query AND b.hit = g.hit))
SELECT query, hit, place FROM b UNION ALL SELECT n.query, n.hit, coalesce(m, 0) + r FROM n LEFT JOIN (SELECT query, max(place) AS m FROM b GROUP BY 1) USING (query) WHERE r <= 2""")
def graph_online_expansion(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    base = R.top_k(orders.select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("hit"), "o_totalprice"), ["query"], [F.desc("o_totalprice"), F.col("hit")], 8, "place").select("query", "hit", "place")
    lines = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("hit"))
    reached = orders.join(lines, "o_orderkey").select(F.col("o_custkey").alias("query"), "hit").distinct().withColumn("score", F.lit(1.0))
    return R.appended(base, reached, 2).select("query", "hit", F.col("place").cast("long").alias("place"))
