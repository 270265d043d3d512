"""Streams over events, retrieval plans and answers over conversations, concepts in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galena.functions import morphology
from galena.operators import concepts
from galena.plans import ask, planner
from galena.registry import query
from galena.sources.tables import spread, table
from galena.streaming import events as E


@query("""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def stream_window_counts(spark: SparkSession, d: str) -> DataFrame:
    out = E.finished(spark, E.window_counts(E.events(spark, d)), "complete", "windows")
    return out.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH s AS (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events),
g AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM g GROUP BY user_id, k""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    out = E.finished(spark, E.sessions(E.events(spark, d)), "complete", "sessions")
    return out.select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return E.finished(spark, E.first_seen(E.events(spark, d, "60 days"), ["user_id", "event_type"]), "append", "dedupe")


@query()
def query_decompose(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").filter("role = 'user'")
    return turns.select("conv_id", "turn", F.posexplode(planner.parts(F.col("text"))).alias("part", "text"))


@query("""SELECT o_orderkey, kind, lanes FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'IDENTIFIER_SEMANTIC' WHEN 1 THEN 'GENERIC' ELSE 'ANALYSIS_UNAVAILABLE' END AS kind,
  CASE o_orderkey % 3 WHEN 0 THEN ['IDENTIFIER', 'VECTOR', 'LEXICAL', 'CONCEPT', 'REFERENCE'] WHEN 1 THEN ['VECTOR', 'LEXICAL', 'REFERENCE'] ELSE ['VECTOR', 'LEXICAL', 'CONCEPT', 'REFERENCE'] END AS lanes FROM orders)""")
def plan_lanes(spark: SparkSession, d: str) -> DataFrame:
    made = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("What does order № 7"), F.col("o_orderkey"), F.lit(" say?"))).when(F.col("o_orderkey") % 3 == 1, "Where is it").otherwise("12 34")
    return planner.planned(table(spark, d, "orders").select("o_orderkey", made.alias("q")), "o_orderkey", "q").filter("part = 0").select("o_orderkey", "kind", "lanes")


@query()
def ask_answers(spark: SparkSession, d: str) -> DataFrame:
    questions = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("hit"), F.col("source").alias("document"), "text")
    return ask.answered(questions, docs)


_SURFACES = [("license.mit", "mit license"), ("license.apache", "apache license"), ("license.gpl", "general public license")]


@query(r"""WITH t AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS t FROM documents)
SELECT doc_id, 'license.mit' AS concept, 'EXACT' AS mode FROM t WHERE contains(t, ' mit license ') UNION ALL SELECT doc_id, 'license.apache', 'EXACT' FROM t WHERE contains(t, ' apache license ')
UNION ALL SELECT doc_id, 'license.gpl', 'EXACT' FROM t WHERE contains(t, ' general public license ')""")
def concept_match(spark: SparkSession, d: str) -> DataFrame:
    surfaces = spark.createDataFrame([(c, "en", p) for c, p in _SURFACES], "concept string, language string, phrase string")
    docs = spread(table(spark, d, "documents")).select("doc_id", "text", F.lit("en").alias("language"))
    return concepts.matched(docs, F.broadcast(surfaces), "doc_id", "text").select("doc_id", "concept", "mode")


@query(r"""WITH t AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS t FROM documents)
SELECT doc_id, 'LEGAL' AS domain, round((CASE WHEN contains(t, ' license ') THEN 1 + 7 / 32.0 + 1.5 ELSE 0 END + CASE WHEN contains(t, ' general public license ') THEN 1 + 22 / 32.0 ELSE 0 END)::DOUBLE, 6) AS score FROM t WHERE contains(t, ' license ')""")
def domain_route(spark: SparkSession, d: str) -> DataFrame:
    anchors = spark.createDataFrame([("LEGAL", "license", True), ("LEGAL", "general public license", False)], "domain string, phrase string, is_name boolean")
    return concepts.routed(table(spark, d, "documents"), F.broadcast(anchors), "doc_id", "text")


@query(r"""SELECT p_partkey, CASE WHEN length(w) <= 3 THEN w WHEN regexp_matches(w, 'ies$') AND length(w) > 4 THEN regexp_replace(w, 'ies$', 'y') WHEN regexp_matches(w, '(ss|x|z|ch|sh)es$') THEN regexp_replace(w, 'es$', '')
  WHEN regexp_matches(w, 's$') AND NOT regexp_matches(w, '(ss|us|is)$') THEN regexp_replace(w, 's$', '') WHEN regexp_matches(w, 'ied$') THEN regexp_replace(w, 'ied$', 'y')
  WHEN regexp_matches(w, 'ing$') AND length(w) > 5 THEN regexp_replace(w, 'ing$', '') WHEN regexp_matches(w, 'ed$') AND length(w) > 4 THEN regexp_replace(w, 'ed$', '') ELSE w END AS lemma
FROM (SELECT p_partkey, lower(string_split(p_type, ' ')[1]) AS w FROM part)""")
def lemma(spark: SparkSession, d: str) -> DataFrame:
    word = F.lower(F.split("p_type", " ")[0])
    return table(spark, d, "part").select("p_partkey", morphology.english_lemma(word).alias("lemma"))


_CASES = " ".join(f"WHEN '{code}' THEN regexp_replace(w, '^(.{{{{4,}}}}?)({'|'.join(suffixes)})$', '\\1')" for code, suffixes in morphology.SUFFIXES.items())
_CASES = _CASES.replace("{{", "{").replace("}}", "}")


@query(rf"""WITH w AS (SELECT doc_id, lang, unnest(list_distinct(string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')[1:5])) AS w FROM documents WHERE lang <> 'en'),
a AS (SELECT doc_id, CASE lang WHEN 'de' THEN 'tr' WHEN 'es' THEN 'pt' WHEN 'fr' THEN 'it' END AS lang, w FROM w UNION ALL SELECT * FROM w)
SELECT doc_id, lang, w AS word, CASE lang {_CASES} ELSE w END AS stem FROM a WHERE w <> ''""")
def stem_words(spark: SparkSession, d: str) -> DataFrame:
    """The first words of each document, stemmed in its language and in another one."""
    from galena.functions import text

    words = F.array_distinct(F.slice(F.split(text.lexical(F.col("text")), " "), 1, 5))
    own = table(spark, d, "documents").filter("lang <> 'en'").select("doc_id", "lang", F.explode(words).alias("word")).filter("word <> ''")
    other = F.when(F.col("lang") == "de", "tr").when(F.col("lang") == "es", "pt").when(F.col("lang") == "fr", "it")
    both = own.withColumn("lang", other).unionByName(own)
    return both.withColumn("stem", morphology.stem(F.col("word"), F.col("lang")))
