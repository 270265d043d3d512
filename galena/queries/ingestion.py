"""Ingestion over documents and over records made from orders and their lines: canonical records,
units, the reference graph, vectors, queues, and the jobs that keep stored rows right."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galena.functions import hashing, text, vectors
from galena.operators import chunking, eligibility, ingest, learning, lifecycle, references
from galena.queries.relational import _LIFECYCLE, lifecycle_standin
from galena.registry import query
from galena.sources import tables as S
from galena.sources.embedders import HashingEmbedder, embedded
from galena.sources.shared import shared_path
from galena.sources.tables import spread, table
from galena.streaming import ingestion as stream_ingestion


def _block(kind: str, text: Column, level: int | None = None) -> Column:
    return F.struct(F.lit(kind).alias("type"), F.lit(level).cast("int").alias("level"), text.alias("text"), F.lit(1).alias("page"))


def order_records(spark: SparkSession, d: str) -> DataFrame:
    """(json): an order as a record; its priority and its lines are headings, each line is a paragraph. Orders
    in progress have no access level, and are not accepted."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))).alias("ls"))
    rows = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    body = F.transform("ls", lambda x: _block("PARAGRAPH", F.concat(F.lit("Part "), x["l_partkey"].cast("string"), F.lit(" from "), x["l_suppkey"].cast("string"), F.lit(" "))))
    blocks = F.concat(F.array(_block("HEADING", F.col("o_orderpriority"), 1), _block("HEADING", F.lit("Lines"), 2)), body, F.array(_block("PARAGRAPH", F.lit("  ")), _block("HEADING", F.lit("End"), 1), _block("LIST_ITEM", F.col("o_orderstatus"))))
    level = F.when(F.col("o_orderstatus") == "P", 0).otherwise(F.col("o_custkey") % 16 + 1).cast("long")
    record = F.struct(F.lit(1).alias("version"), F.col("o_orderkey").cast("string").alias("documentId"), F.col("o_orderpriority").alias("title"), F.lit("en").alias("language"), F.lit("GENERAL").alias("domain"), level.alias("accessLevel"), F.create_map(F.lit("status"), F.col("o_orderstatus")).alias("metadata"), blocks.alias("blocks"))
    return rows.select("o_orderkey", F.to_json(record).alias("json"))


@query("""WITH l AS (SELECT l_orderkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n, count(*) OVER (PARTITION BY l_orderkey) AS c FROM lineitem),
o AS (SELECT DISTINCT o_orderkey, o_orderpriority, o_orderstatus, c FROM orders JOIN l ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P')
SELECT CAST(o_orderkey AS VARCHAR) AS document, 0 AS position, 'HEADING' AS kind, o_orderpriority AS section_path, o_orderpriority AS text FROM o
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 1, 'HEADING', o_orderpriority || ' > Lines', 'Lines' FROM o
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), n + 1, 'PARAGRAPH', o_orderpriority || ' > Lines', 'Part ' || l_partkey || ' from ' || l_suppkey FROM o JOIN l ON l_orderkey = o_orderkey
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), c + 3, 'HEADING', 'End', 'End' FROM o UNION ALL SELECT CAST(o_orderkey AS VARCHAR), c + 4, 'LIST_ITEM', 'End', o_orderstatus FROM o""")
def canonical_units(spark: SparkSession, d: str) -> DataFrame:
    read = ingest.canonical(order_records(spark, d), "json").filter("problem IS NULL")
    return ingest.canonical_units(read).select("document", F.col("position").cast("long").alias("position"), "kind", "section_path", "text")


@query("""SELECT o_orderkey, CASE o_orderkey % 7 WHEN 1 THEN 'UNREADABLE' WHEN 2 THEN 'NO_ID' WHEN 3 THEN 'VERSION' WHEN 4 THEN 'ACCESS' WHEN 5 THEN 'NO_TEXT' WHEN 6 THEN 'BLOCK_TYPE' END AS problem FROM orders""")
def canonical_problems(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 7
    block = F.struct(F.when(k == 6, "IMAGE").otherwise("PARAGRAPH").alias("type"), F.when(k == 5, " ").otherwise("x").alias("text"))
    record = F.struct(F.when(k == 3, 2).otherwise(1).alias("version"), F.when(k == 2, " ").otherwise("d").alias("documentId"), F.when(k == 4, 0).otherwise(1).alias("accessLevel"), F.array(block).alias("blocks"))
    rows = table(spark, d, "orders").select("o_orderkey", F.when(k == 1, "{").otherwise(F.to_json(record)).alias("json"))
    return ingest.canonical(rows, "json").select("o_orderkey", "problem")


def _part(value: str) -> str:
    return f"strlen({value}) || ':' || {value}"


@query(f"""SELECT doc_id, sha256({_part('CAST(doc_id AS VARCHAR)')} || {_part('source')} || {_part('lang')} || '7:GENERAL' || '1:4' || '1:a' || {_part('lang')} || '1:b' || {_part('source')} || '|9:PARAGRAPH0:' || {_part('text')} || '1:1') AS digest FROM documents""")
def canonical_document_hash(spark: SparkSession, d: str) -> DataFrame:
    block = F.struct(F.lit("PARAGRAPH").alias("type"), F.lit(None).cast("int").alias("level"), F.col("text"), F.lit(1).alias("page"))
    doc = F.struct(F.col("doc_id").cast("string").alias("documentId"), F.col("source").alias("title"), F.col("lang").alias("language"), F.lit("GENERAL").alias("domain"), F.lit(4).alias("accessLevel"), F.create_map(F.lit("b"), F.col("source"), F.lit("a"), F.col("lang")).alias("metadata"), F.array(block).alias("blocks"))
    return spread(table(spark, d, "documents")).select("doc_id", doc.alias("doc")).select("doc_id", ingest.canonical_hash(F.col("doc")).alias("digest"))


def line_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of orders: each declares its own article and refers to others, to a table and to a standard."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document"), F.col("l_linenumber").cast("long").alias("chunk")).distinct()
    n = F.col("chunk")
    body = F.concat(F.lit("Article "), n, F.lit("\nsee article "), n % 3 + 1, F.lit(", Section IV, table "), n % 2 + 1, F.lit(" and ISO "), n + 9000, F.lit("; 第十二条至此。"))
    return lines.withColumn("text", body)


_LINES = "c AS (SELECT DISTINCT l_orderkey AS document, CAST(l_linenumber AS BIGINT) AS chunk FROM lineitem)"


@query(f"""WITH {_LINES} SELECT document, chunk, type, value, scope FROM (
  SELECT document, chunk, 'ARTICLE' AS type, CAST(chunk % 3 + 1 AS VARCHAR) AS value, 'DOCUMENT' AS scope FROM c WHERE chunk % 3 + 1 <> chunk UNION ALL SELECT document, chunk, 'SECTION', '4', 'DOCUMENT' FROM c
  UNION ALL SELECT document, chunk, 'TABLE', CAST(chunk % 2 + 1 AS VARCHAR), 'DOCUMENT' FROM c UNION ALL SELECT document, chunk, 'STANDARD', 'ISO ' || (chunk + 9000), 'EXTERNAL' FROM c
  UNION ALL SELECT document, chunk, 'ARTICLE', '12', 'DOCUMENT' FROM c WHERE chunk <> 12)""")
def reference_edges(spark: SparkSession, d: str) -> DataFrame:
    return references.edges(line_chunks(spark, d))


@query(f"""WITH {_LINES}, s AS (SELECT o_custkey AS query, document, chunk, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey, chunk) AS place FROM orders JOIN c ON document = o_orderkey QUALIFY place <= 3),
t AS (SELECT s.query, s.document, a.chunk, min(s.place) AS place FROM s JOIN c a ON a.document = s.document AND ((a.chunk = s.chunk % 3 + 1 AND a.chunk <> s.chunk) OR (a.chunk = 12 AND s.chunk <> 12))
  WHERE NOT EXISTS (SELECT 1 FROM s x WHERE x.query = s.query AND x.document = a.document AND x.chunk = a.chunk) GROUP BY 1, 2, 3)
SELECT query, document, chunk, row_number() OVER (PARTITION BY query ORDER BY place, document, chunk) AS rank FROM t QUALIFY rank <= 20""")
def reference_lane(spark: SparkSession, d: str) -> DataFrame:
    from galena.operators.ranking import top_k

    chunks = line_chunks(spark, d)
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("document"), "o_totalprice")
    seeds = top_k(orders.join(chunks.select("document", "chunk"), "document"), ["query"], [F.desc("o_totalprice"), F.col("document"), F.col("chunk")], 3, "place")
    out = references.reference_lane(seeds.select("query", "document", "chunk", "place"), references.edges(chunks), references.anchors(chunks))
    return out.select("query", "document", "chunk", F.col("rank").cast("long").alias("rank"))


@query()
def document_units(spark: SparkSession, d: str) -> DataFrame:
    return chunking.document_units(spread(table(spark, d, "documents")))


_RULES = """CASE WHEN regexp_matches(t, '\\bdos(e|age|is)\\b') THEN 'DOSAGE' WHEN regexp_matches(t, '\\bexcept\\b|\\bunless\\b') THEN 'EXCEPTION' WHEN regexp_matches(t, 'must not') THEN 'PROHIBITION' WHEN regexp_matches(t, '\\bshall\\b') THEN 'OBLIGATION' ELSE 'PARAGRAPH' END"""
_RULED = """lines AS (SELECT l_orderkey AS document, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS position,
  CASE l_partkey % 5 WHEN 0 THEN 'the buyer shall pay' WHEN 1 THEN 'unless agreed otherwise' WHEN 2 THEN 'one must not resell' WHEN 3 THEN 'the dose is ' || l_linenumber ELSE 'goods are shipped' END AS t,
  CASE WHEN l_linenumber < 4 THEN 'A' ELSE 'B' END AS section_path FROM lineitem)"""


def ruled_units(spark: SparkSession, d: str) -> DataFrame:
    """Units of orders whose sentences are rules, exceptions and medical facts, by the part."""
    from galena.operators.ranking import ranked

    k, n = F.col("l_partkey") % 5, F.col("l_linenumber")
    body = F.when(k == 0, "the buyer shall pay").when(k == 1, "unless agreed otherwise").when(k == 2, "one must not resell").when(k == 3, F.concat(F.lit("the dose is "), n)).otherwise("goods are shipped")
    rows = ranked(table(spark, d, "lineitem"), ["l_orderkey"], [n, F.col("l_partkey"), F.col("l_suppkey")], "position")
    out = rows.select(F.col("l_orderkey").alias("document"), F.col("position").cast("long").alias("position"), body.alias("text"), F.when(n < 4, "A").otherwise("B").alias("section_path"))
    return out.withColumn("kind", chunking.unit_class(F.col("text"), F.lit("MEDICAL")))


@query(f"WITH {_RULED} SELECT document, position, {_RULES} AS kind FROM lines")
def unit_classes(spark: SparkSession, d: str) -> DataFrame:
    return ruled_units(spark, d).select("document", "position", "kind")


@query(f"""WITH {_RULED}, k AS (SELECT *, {_RULES} AS kind FROM lines),
n AS (SELECT *, lead(kind) OVER w AS nk, lead(t) OVER w AS nt, lead(section_path) OVER w AS ns, lag(kind) OVER w AS pk, lag(section_path) OVER w AS ps FROM k WINDOW w AS (PARTITION BY document ORDER BY position))
SELECT document, position, kind, CASE WHEN nk = 'EXCEPTION' AND ns = section_path AND kind IN ('OBLIGATION', 'PROHIBITION', 'PARAGRAPH') THEN t || chr(10) || nt ELSE t END AS text,
  (coalesce(nk = 'EXCEPTION' AND ns = section_path, false) AND kind IN ('OBLIGATION', 'PROHIBITION', 'PARAGRAPH')) OR kind = 'DOSAGE' AS atomic FROM n
WHERE NOT coalesce(kind = 'EXCEPTION' AND ps = section_path AND pk IN ('OBLIGATION', 'PROHIBITION', 'PARAGRAPH'), false)""")
def atomic_units(spark: SparkSession, d: str) -> DataFrame:
    return chunking.protected(ruled_units(spark, d), "document").select("document", "position", "kind", "text", "atomic")


def _submitted(spark: SparkSession, d: str) -> DataFrame:
    return _as_submitted(spread(table(spark, d, "documents")))


def _as_submitted(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("string").alias("document"), F.col("source").alias("title"), F.col("lang").alias("language"), F.lit("GENERAL").alias("domain"), (F.col("doc_id") % 4 + 1).alias("access_level"), "text")


@query("SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(1 AS BIGINT) AS generation, doc_id % 4 + 1 AS access_level, CASE WHEN text IS NULL OR trim(text, chr(9) || chr(10) || chr(13) || ' ') = '' THEN 'FAILED' ELSE 'PUBLISHED' END AS generation_status FROM documents")
def ingest_generations(spark: SparkSession, d: str) -> DataFrame:
    return ingest.ingested(_submitted(spark, d), HashingEmbedder()).generations.select("document_id", "generation", "access_level", "generation_status")


@query("SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(1 AS BIGINT) AS generation, doc_id % 4 + 1 AS access_level, CASE WHEN text IS NULL OR trim(text, chr(9) || chr(10) || chr(13) || ' ') = '' THEN 'FAILED' ELSE 'PUBLISHED' END AS generation_status FROM documents")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The same from a stream of the documents' part files, two files a batch."""
    folder = shared_path(spark, "stream-ingest")
    stream_ingestion.run(_as_submitted(stream_ingestion.parquet_stream(spark, d, "documents", 2)), folder, HashingEmbedder())
    return stream_ingestion.current(spark, folder).select("document_id", "generation", "access_level", "generation_status")


@query()
def ingest_vectors(spark: SparkSession, d: str) -> DataFrame:
    return ingest.ingested(_submitted(spark, d), HashingEmbedder()).vectors.select("document", "chunk", "vector_id", "content", "vector")


@query("""WITH f AS (SELECT user_id AS key, md5(event_type) AS fingerprint, event_id AS seq FROM events), n AS (SELECT *, row_number() OVER w AS n, first_value(fingerprint) OVER w AS owner FROM f WINDOW w AS (PARTITION BY key ORDER BY seq)),
room AS (SELECT key FROM n WHERE n = 1 ORDER BY seq LIMIT 100)
SELECT key, seq, CASE WHEN n > 1 AND fingerprint <> owner THEN 'CONFLICT' WHEN key NOT IN (SELECT key FROM room) THEN 'BUSY' WHEN n > 1 THEN 'REPLAY' ELSE 'ACCEPTED' END AS status FROM n""")
def async_admission(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("user_id").alias("key"), F.md5("event_type").alias("fingerprint"), F.col("event_id").alias("seq"))
    return ingest.admitted(rows, 100)


@query("""SELECT event_id AS job, CASE WHEN event_type NOT IN ('view', 'error') OR event_id % 7 >= 5 THEN 'FAIL' WHEN ts + to_seconds(CAST(least(300, 5 * power(2, event_id % 7 - 1)) AS INT)) <= TIMESTAMP '2024-01-15' THEN 'RUN' ELSE 'RETRY' END AS decision FROM events""")
def job_retries(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.when(F.col("event_type") == "view", "TIMEOUT").when(F.col("event_type") == "error", "UNAVAILABLE").otherwise("INVALID")
    jobs = table(spark, d, "events").select(F.col("event_id").alias("job"), kinds.alias("error"), (F.col("event_id") % 7).alias("attempt"), F.col("ts").alias("failed_at"))
    return lifecycle.retried(jobs, F.lit("2024-01-15").cast("timestamp_ntz")).select("job", "decision")


@query("""WITH stored AS (SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE NOT (l_orderkey % 10 = 3 AND l_linenumber = 1) UNION ALL SELECT -1, 1, 1),
source AS (SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem) SELECT l_orderkey, count(*) AS n, sum(l_partkey) AS parts FROM source GROUP BY 1""")
def generation_repair(spark: SparkSession, d: str) -> DataFrame:
    source = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    lost = source.filter(~((F.col("l_orderkey") % 10 == 3) & (F.col("l_linenumber") == 1)))
    stray = spark.range(1).select(F.lit(-1).cast("long").alias("l_orderkey"), F.lit(1).cast("long").alias("l_partkey"), F.lit(1).cast("int").alias("l_linenumber"))
    return lifecycle.repaired(lost.unionByName(stray), source, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("l_partkey").alias("parts"))


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS d, l_linenumber AS c FROM lineitem), g AS (SELECT d, count(*) AS expected, count(*) FILTER (WHERE NOT (d % 5 = 1 AND c = 2) AND NOT (d % 5 = 2 AND c = 1)) AS good FROM s GROUP BY d)
SELECT d AS document_id, expected, good, CASE WHEN d % 7 = 0 THEN 'FENCED' WHEN good < expected THEN 'STAGING' ELSE 'CUTOVER' END AS step FROM g""")
def reembedding_steps(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.lit(1).alias("generation"), F.col("l_linenumber").alias("chunk")).distinct()
    k = F.col("document_id") % 5
    staged = chunks.filter(~((k == 1) & (F.col("chunk") == 2))).select("document_id", "chunk", F.when((k == 2) & (F.col("chunk") == 1), 32).otherwise(64).alias("size"))
    current = chunks.select("document_id", F.when(F.col("document_id") % 7 == 0, 2).otherwise(1).alias("generation")).distinct()
    return lifecycle.reembedding(chunks, staged, current, 64).select("document_id", "expected", "good", "step")


@query("""SELECT event_id AS job FROM events WHERE event_id % 6 = 0 OR (event_id % 2 = 0 AND ts + INTERVAL 300 SECOND <= TIMESTAMP '2024-01-15 02:00:00')
OR (event_id % 6 IN (1, 3, 5) AND ts < CASE WHEN (event_id % 5) * 3600 <= 7200 THEN TIMESTAMP '2024-01-15' + to_seconds(CAST((event_id % 5) * 3600 AS INT)) ELSE TIMESTAMP '2024-01-14' + to_seconds(CAST((event_id % 5) * 3600 AS INT)) END)""")
def scheduled_jobs(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    jobs = table(spark, d, "events").select(i.alias("job"), F.when(i % 6 != 0, F.col("ts")).alias("last_run"), F.when(i % 2 == 0, 300).cast("int").alias("every_seconds"), F.when(i % 2 == 1, (i % 5) * 3600).cast("int").alias("at_second"))
    return lifecycle.due_jobs(jobs, F.lit("2024-01-15 02:00:00").cast("timestamp_ntz")).select("job")


@query("""WITH RECURSIVE u AS (SELECT user_id AS name, event_id AS seq, event_id % 3 AS expected, event_type AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
f AS (SELECT DISTINCT name, CAST(0 AS BIGINT) AS n, 'start' AS value, CAST(0 AS BIGINT) AS version FROM u
  UNION ALL SELECT f.name, u.n, CASE WHEN u.expected = f.version THEN u.value ELSE f.value END, CASE WHEN u.expected = f.version THEN f.version + 1 ELSE f.version END FROM f JOIN u ON u.name = f.name AND u.n = f.n + 1)
SELECT name, arg_max(value, n) AS value, max(version) AS version FROM f GROUP BY name""")
def parameter_writes(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    values = events.select(F.col("user_id").alias("name"), F.lit("start").alias("value"), F.lit(0).cast("long").alias("version")).distinct()
    updates = events.select(F.col("user_id").alias("name"), F.col("event_id").alias("seq"), (F.col("event_id") % 3).alias("expected"), F.col("event_type").alias("value"))
    return lifecycle.compared_and_set(values, updates)


@query("SELECT lang, doc_id % 4 + 1 AS access_level, count(*) AS n, sum(length(text)) AS chars FROM documents WHERE lang IN ('de', 'fr') GROUP BY 1, 2")
def partitioned_store(spark: SparkSession, d: str) -> DataFrame:
    """Documents written by language and access level; the read prunes to two languages."""
    path = shared_path(spark, "provisioned")
    S.write_partitioned(table(spark, d, "documents").withColumn("access_level", F.col("doc_id") % 4 + 1), path, ["lang", "access_level"])
    rows = spark.read.parquet(path).filter(F.col("lang").isin("de", "fr"))
    return rows.groupBy("lang", F.col("access_level").cast("long").alias("access_level")).agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("chars"))


@query("SELECT strftime(ts, '%Y-%m') AS month, count(*) AS n, max(event_id) AS newest FROM events GROUP BY 1")
def audit_append(spark: SparkSession, d: str) -> DataFrame:
    """Events appended in two writes to a log that is partitioned by month."""
    path = shared_path(spark, "audit")
    rows = table(spark, d, "events").withColumn("month", F.date_format("ts", "yyyy-MM"))
    for part in (rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1")):
        S.append_partitioned(part, path, ["month"])
    return spark.read.schema(rows.schema).parquet(path).groupBy("month").agg(F.count("*").alias("n"), F.max("event_id").alias("newest"))


@query("SELECT count(*) AS n FROM embeddings")
def verified_store(spark: SparkSession, d: str) -> DataFrame:
    """Vectors written to a store and read back; a count that differs would be an error."""
    path = shared_path(spark, "vectors")
    rows = table(spark, d, "embeddings")
    rows.write.parquet(path)
    return S.verified_count(spark.read.parquet(path), rows.count())


@query("""SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)""")
def scope_and_language(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("document_id"), F.col("o_orderpriority").alias("language"))
    scope = table(spark, d, "customer").filter("c_nationkey < 5").select(F.col("c_custkey").alias("document_id"))
    narrow = eligibility.in_language(eligibility.scoped(rows, scope), "1-URGENT")
    return eligibility.in_language(eligibility.scoped(narrow, None), None).select("o_orderkey")


@query(f"""WITH {_LIFECYCLE} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN published ON l_orderkey = document_id AND l_linenumber = published_generation AND l_suppkey % 25 = access_level
WHERE l_partkey > 0 AND l_partkey % 10 <> 0 AND EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 5)""")
def context_revalidation(spark: SparkSession, d: str) -> DataFrame:
    """Hits that are routable, of published generations at their access level, and still projected."""
    rows, generations = lifecycle_standin(spark, d)
    live = eligibility.published(rows, generations, F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"))
    hits = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("generation"), (F.col("l_suppkey") % 25).alias("access_level"), F.when(F.col("l_partkey") % 10 == 0, " ").otherwise(F.col("l_partkey").cast("string")).alias("chunk_id"))
    valid = hits.filter(eligibility.routable(F.col("access_level") + 1, F.col("document_id").cast("string"), F.col("generation"), F.col("chunk_id")))
    projected = table(spark, d, "part").filter("p_size > 5").select(F.col("p_partkey").cast("string").alias("chunk_id"))
    return eligibility.revalidated(valid, live, projected).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("""SELECT p_partkey, contains(' ' || lower(regexp_replace(p_type, '[^A-Za-z]+', ' ', 'g')) || ' ', ' steel ') AS steel, contains(' ' || lower(p_type) || ' ', ' stee ') AS cut, least(8, len(list_distinct(list_filter(string_split(lower(p_name || ' ' || p_type), ' '), lambda x: length(x) >= 3)))) AS termed FROM part""")
def phrase_containment(spark: SparkSession, d: str) -> DataFrame:
    have = text.lexical(F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", text.contains_phrase(have, F.lit("steel")).alias("steel"), text.contains_phrase(have, F.lit("stee")).alias("cut"), F.size(text.search_terms(F.concat_ws(" ", "p_name", "p_type"))).cast("long").alias("termed"))


@query("""SELECT o_orderkey, list_aggregate(list_distinct(list_filter([regexp_replace(lower(x), '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g') for x in string_split(o_orderpriority || ' ' || o_orderstatus || ' (urgent!) ' || 'ab', ' ')], lambda t: length(t) >= 3)), 'count') AS n FROM orders""")
def search_terms(spark: SparkSession, d: str) -> DataFrame:
    terms = text.search_terms(F.concat("o_orderpriority", F.lit(" "), "o_orderstatus", F.lit(" (urgent!) "), F.lit("ab")))
    return table(spark, d, "orders").select("o_orderkey", F.size(terms).cast("long").alias("n"))


@query("""SELECT doc_id, md5('Document: ' || source || chr(10) || 'Domain: GENERAL' || chr(10) || 'Language: ' || lang || chr(10) || 'Section: ' || chr(10) || chr(10) || rtrim(text, ' ')) AS digest FROM documents""")
def embedding_header(spark: SparkSession, d: str) -> DataFrame:
    made = text.embedding_text(F.col("source"), F.lit("GENERAL"), F.col("lang"), F.lit(None).cast("string"), F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(made).alias("digest"))


@query("SELECT vec_id, vec_id % 4 NOT IN (1, 2, 3) AS valid FROM embeddings")
def vector_validation(spark: SparkSession, d: str) -> DataFrame:
    k, e = F.col("vec_id") % 4, F.col("embedding")
    made = F.when(k == 1, F.slice(e, 1, 63)).when(k == 2, F.transform(e, lambda x: F.lit(float("nan")).cast("float"))).when(k == 3, F.transform(e, lambda x: F.lit(float("inf")).cast("float"))).otherwise(e)
    return table(spark, d, "embeddings").select("vec_id", vectors.valid(made, 64).alias("valid"))


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'unknown' WHEN 3 THEN 'pt' WHEN 4 THEN 'kk' ELSE 'unknown' END AS code FROM orders""")
def language_codes(spark: SparkSession, d: str) -> DataFrame:
    from galena.functions.language import language_code

    tags = F.array(*map(F.lit, (" EN-us", "German", "xx", "pt_BR", "kaz", "")))
    return table(spark, d, "orders").select("o_orderkey", language_code(F.element_at(tags, (F.col("o_orderkey") % 6 + 1).cast("int"))).alias("code"))


@query("""SELECT event_id, sha256(strlen('a') || ':a' || strlen(event_type) || ':' || event_type || strlen('b') || ':b' || strlen(CAST(user_id AS VARCHAR)) || ':' || user_id) AS fingerprint FROM events""")
def settings_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    settings = F.create_map(F.lit("b"), F.col("user_id").cast("string"), F.lit("a"), F.col("event_type"))
    return table(spark, d, "events").select("event_id", learning.settings_fingerprint(settings).alias("fingerprint"))


_SECRET = "0123456789abcdef0123456789abcdef"
_INNER, _OUTER = ("'" + "".join(f"\\x{b ^ pad:02X}" for b in _SECRET.encode().ljust(64, b"\0")) + "'::BLOB" for pad in (0x36, 0x5C))


@query(f"""WITH f AS (SELECT doc_id, sha256({_OUTER} || unhex(sha256({_INNER} || encode(coalesce(text, ''))))) AS fingerprint FROM documents)
SELECT doc_id, fingerprint, CAST(CAST('0x' || fingerprint[1:4] AS INT) % 256 AS BIGINT) AS bucket FROM f""")
def keyed_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Keyed fingerprints of the texts, and their buckets of the sketch."""
    fingerprint = hashing.keyed_fingerprint(_SECRET)
    rows = table(spark, d, "documents").select("doc_id", fingerprint(F.coalesce("text", F.lit(""))).alias("fingerprint"))
    return rows.withColumn("bucket", hashing.sketch_bucket(F.col("fingerprint")).cast("long"))


@query()
def embedded_documents(spark: SparkSession, d: str) -> DataFrame:
    return embedded(spread(table(spark, d, "documents")).select("doc_id", "text"), HashingEmbedder()).select("doc_id", "vector")


