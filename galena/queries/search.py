"""Lanes, fusion, rerank, context and quality over benchmark items and documents, and the vector
lanes over embeddings. A benchmark item is a query; the documents that hold its text are its truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from galena.functions import grounding
from galena.operators import chunking, context, nearest
from galena.operators import ranking as R
from galena.operators import retrieval as L
from galena.operators.graph import mutual_confidence
from galena.registry import query
from galena.sources.shared import stored
from galena.sources.tables import spread, table

_T = r"list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: x <> ''))"
_G = f"list_distinct(flatten(list_transform({_T}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
_LEXICAL = f"""q AS (SELECT item_id AS query, len({_T}) AS n, unnest({_T}) AS t FROM benchmark), p AS (SELECT doc_id AS hit, unnest({_T}) AS t FROM documents),
lexical AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, hit) AS rank FROM (
  SELECT query, hit, count(*) / max(n) AS score FROM q JOIN p USING (t) GROUP BY query, hit)) WHERE rank <= 10)"""
_FUSED = f"""{_LEXICAL}, qg AS (SELECT item_id AS query, {_G} AS g FROM benchmark), dg AS (SELECT doc_id AS hit, {_G} AS g FROM documents),
grams AS (SELECT query, hit, row_number() OVER (PARTITION BY query ORDER BY s / (len(qg.g) + len(dg.g) - s) DESC, hit) AS rank FROM (
  SELECT query, hit, count(*) AS s FROM (SELECT query, unnest(g) AS t FROM qg) JOIN (SELECT hit, unnest(g) AS t FROM dg) USING (t) GROUP BY query, hit) JOIN qg USING (query) JOIN dg USING (hit) QUALIFY rank <= 10),
hits AS (SELECT query, 'LEXICAL' AS lane, hit, rank FROM lexical UNION ALL SELECT query, 'TRIGRAM', hit, rank FROM grams),
fused AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY tier, score DESC, hit) AS place FROM (SELECT query, hit, 2 AS tier, count(DISTINCT lane) AS lanes,
  round(sum((CASE WHEN lane = 'LEXICAL' THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END) / (60 + rank)), 9) AS score FROM hits GROUP BY query, hit))"""


WEIGHTS = {"LEXICAL": 1.0, "TRIGRAM": 0.8}


def lexical_hits(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text")
    return L.lexical_lane(queries, spread(table(spark, d, "documents").select(F.col("doc_id").alias("hit"), "text")), k)


def lane_hits(spark: SparkSession, d: str) -> DataFrame:
    """(query, lane, hit, rank) of the lexical and the trigram lane over all documents."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), "text")
    docs = spread(table(spark, d, "documents").select(F.col("doc_id").alias("hit"), "text"))
    return L.lexical_and_trigram_lanes(items, docs, 10).select("query", "lane", "hit", "rank")


def fused_hits(spark: SparkSession, d: str) -> DataFrame:
    """Both lanes, fused."""
    return L.fused(lane_hits(spark, d), WEIGHTS)


@query(f"WITH {_LEXICAL} SELECT query, hit, round(score, 6) AS score, rank FROM lexical")
def lexical_topk(spark: SparkSession, d: str) -> DataFrame:
    return lexical_hits(spark, d).select("query", "hit", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_IN = "CASE item_id % 4 WHEN 0 THEN NULL WHEN 1 THEN ['source:src' || item_id % 7] WHEN 2 THEN ['source:src' || item_id % 5, 'lang:de'] ELSE ['lang:en', 'source:none'] END"


@query(f"""WITH q AS (SELECT item_id AS query, {_IN} AS scopes, len({_T}) AS n, unnest({_T}) AS t FROM benchmark), p AS (SELECT doc_id AS hit, ['source:' || source, 'lang:' || lang] AS within, unnest({_T}) AS t FROM documents)
SELECT query, hit, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, hit) AS rank FROM (
  SELECT query, hit, count(*) / max(n) AS score FROM q JOIN p USING (t) WHERE scopes IS NULL OR list_has_any(scopes, within) GROUP BY query, hit)) WHERE rank <= 10""")
def scoped_search(spark: SparkSession, d: str) -> DataFrame:
    """Items asked of all documents, of one source, of a source or a language, or of a language: the ten best among these."""
    k = F.col("item_id")
    source = lambda n: F.concat(F.lit("source:src"), (k % n).cast("string"))
    scopes = F.when(k % 4 == 1, F.array(source(7))).when(k % 4 == 2, F.array(source(5), F.lit("lang:de"))).when(k % 4 == 3, F.array(F.lit("lang:en"), F.lit("source:none")))
    items = table(spark, d, "benchmark").select(k.alias("query"), "text", scopes.alias("scopes"))
    within = F.array_compact(F.array(F.concat(F.lit("source:"), "source"), F.concat(F.lit("lang:"), "lang")))
    docs = spread(table(spark, d, "documents").select(F.col("doc_id").alias("hit"), "text", within.alias("scopes")))
    found = L.lexical_lane(items, docs, 10)
    return found.select("query", "hit", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_FUSED} SELECT query, hit, tier, lanes, score, place FROM fused WHERE place <= 5")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    out = fused_hits(spark, d).filter("place <= 5")
    return out.select("query", "hit", F.col("tier").cast("long").alias("tier"), "lanes", "score", F.col("place").cast("long").alias("place"))


@query(f"""WITH {_FUSED}, r AS (SELECT f.*, 1.0 - abs(hit % 7 - query % 7) / 7.0 AS semantic, max(score) OVER (PARTITION BY query) AS top FROM fused f)
SELECT query, hit, place, round(greatest(-1, least(1, semantic * 0.85 + score / top * 0.15)), 9) AS rerank FROM r""")
def rerank_blend(spark: SparkSession, d: str) -> DataFrame:
    semantic = 1.0 - F.abs(F.col("hit") % 7 - F.col("query") % 7) / 7.0
    out = L.reranked(fused_hits(spark, d).withColumn("semantic", semantic), "semantic")
    return out.select("query", "hit", F.col("place").cast("long").alias("place"), "rerank")


_TRUTH = "truth AS (SELECT item_id AS query, doc_id AS hit FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
_QUALITY = """quality AS (SELECT t.query, count(f.hit) / max(t.n) AS recall, coalesce(max(1 / f.rank), 0) AS mrr,
  coalesce(sum(1 / log2(f.rank + 1)), 0) / max(list_sum(list_transform(range(1, least(t.n, 10) + 1), lambda i: 1 / log2(i + 1)))) AS ndcg
  FROM (SELECT *, count(*) OVER (PARTITION BY query) AS n FROM truth) t LEFT JOIN lexical f ON f.query = t.query AND f.hit = t.hit GROUP BY t.query)"""


def truth(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold an item's text: candidates share all of its tokens, then the text is looked for."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("wanted"))
    docs = spread(table(spark, d, "documents").select(F.col("doc_id").alias("hit"), "text"))
    full = L.lexical_lane(items.withColumnRenamed("wanted", "text"), docs, None, 1.0).select("query", "hit")
    return full.join(items, "query").join(docs, "hit").filter(F.contains("text", F.col("wanted"))).select("query", "hit")


@query(f"WITH {_LEXICAL}, {_TRUTH}, {_QUALITY} SELECT query, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg FROM quality")
def recall_mrr_ndcg(spark: SparkSession, d: str) -> DataFrame:
    out = L.retrieval_quality(lexical_hits(spark, d), truth(spark, d), 10)
    return out.select("query", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")])


@query(f"""WITH {_LEXICAL}, {_TRUTH}, {_QUALITY} SELECT query % 4 AS slice, CASE WHEN length(b.text) > 200 THEN 'LONG' ELSE 'SHORT' END AS kind, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg
FROM quality JOIN benchmark b ON b.item_id = query GROUP BY GROUPING SETS ((), (slice), (kind))""")
def quality_slices(spark: SparkSession, d: str) -> DataFrame:
    scored = L.retrieval_quality(lexical_hits(spark, d), truth(spark, d), 10)
    kind = F.when(F.char_length("text") > 200, "LONG").otherwise("SHORT")
    rows = scored.join(table(spark, d, "benchmark").select(F.col("item_id").alias("query"), kind.alias("kind")), "query").withColumn("slice", F.col("query") % 4)
    return rows.groupingSets([[], ["slice"], ["kind"]], "slice", "kind").agg(F.count("*").alias("n"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("ndcg"), 6).alias("ndcg"))


@query(f"WITH {_FUSED} SELECT query, CASE WHEN count(*) >= 2 AND max(lanes) >= 2 THEN 'STRONG' WHEN count(*) >= 2 OR max(lanes) >= 2 THEN 'ADEQUATE' ELSE 'WEAK' END AS quality FROM fused GROUP BY query")
def evidence_quality(spark: SparkSession, d: str) -> DataFrame:
    return L.evidence_quality(fused_hits(spark, d))


@query(f"""WITH {_FUSED}, c AS (SELECT f.*, source, row_number() OVER (PARTITION BY query, source ORDER BY place) AS r FROM fused f JOIN documents ON doc_id = hit)
SELECT query, hit FROM c WHERE r <= 1""")
def section_diversity(spark: SparkSession, d: str) -> DataFrame:
    hits = fused_hits(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("hit"), "source"), "hit")
    return R.diversity_cap(hits, "query", ["source"], "tier", "place", 1).select("query", "hit")


def _context_hits(spark: SparkSession, d: str) -> DataFrame:
    from galena.functions.tokens import token_estimate

    docs = table(spark, d, "documents").select(F.col("doc_id").alias("hit"), F.col("source").alias("document"), "text")
    hits = fused_hits(spark, d).join(docs, "hit").withColumn("lane", F.lit("LEXICAL"))
    return hits.withColumn("tokens", token_estimate(F.col("text")))  # of the hits alone


@query()
def context_budget(spark: SparkSession, d: str) -> DataFrame:
    return context.budgeted(_context_hits(spark, d), tokens=2500)


@query()
def select_backfill(spark: SparkSession, d: str) -> DataFrame:
    eligible = table(spark, d, "documents").filter("source <> 'src0'").select(F.col("doc_id").alias("hit"))
    hits = stored(_context_hits(spark, d), "hits")  # used four times
    return context.backfilled(hits, eligible, tokens=2500)


@query()
def context_envelope(spark: SparkSession, d: str) -> DataFrame:
    hits = stored(_context_hits(spark, d), "hits")  # used twice
    chosen = context.budgeted(hits, tokens=2500)
    return context.envelope(chosen.join(hits.select("query", "hit", "document", "text"), ["query", "hit"]))


_V = "v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings)"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("hit"), F.col("embedding").alias("vector"), F.col("label").cast("long").alias("label"))


def _vector_queries(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).filter("hit % 50 = 0").withColumnRenamed("hit", "query")


@query(f"""WITH {_V} SELECT query, hit, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, hit) AS rank FROM (
  SELECT q.id AS query, v.id AS hit, round(list_cosine_similarity(q.e, v.e), 6) AS score FROM v q JOIN v ON q.id % 50 = 0)) WHERE rank <= 5""")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return L.vector_lane(_vector_queries(spark, d), _vectors(spark, d), 5).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {_V} SELECT query, hit, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, hit) AS rank FROM (
  SELECT q.id AS query, v.id AS hit, round(list_cosine_similarity(q.e, v.e), 6) AS score FROM v q JOIN v ON q.id % 50 = 0 AND q.label = v.label)) WHERE rank <= 5 AND score >= 0.1""")
def vector_topk_scoped(spark: SparkSession, d: str) -> DataFrame:
    return L.vector_lane(_vector_queries(spark, d), _vectors(spark, d), 5, 0.1, "label").select("query", "hit", "score")


@query(f"""WITH {_V}, pairs AS (SELECT q.id AS query, v.id AS hit, round(list_cosine_similarity(q.e, v.e), 6) AS score, q.label = v.label AS own FROM v q JOIN v ON q.id % 50 = 0),
local AS (SELECT query, hit, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, hit) AS r FROM pairs WHERE own) WHERE r <= 5 AND score >= 0.65),
wide AS (SELECT query, hit, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, hit) AS r FROM pairs) WHERE r <= 5)
SELECT query, hit, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY own, score DESC, hit) AS r FROM (
  SELECT query, hit, max(score) AS score, min(own) AS own FROM (SELECT *, 0 AS own FROM local UNION ALL SELECT *, 1 FROM wide) GROUP BY query, hit)) WHERE r <= 5""")
def vector_language_fallback(spark: SparkSession, d: str) -> DataFrame:
    local = L.vector_lane(_vector_queries(spark, d), _vectors(spark, d), 5, 0.65, "label").withColumn("own", F.lit(0))
    wide = L.vector_lane(_vector_queries(spark, d), _vectors(spark, d), 5).withColumn("own", F.lit(1))
    once = local.unionByName(wide).groupBy("query", "hit").agg(F.max("score").alias("score"), F.min("own").alias("own"))
    return R.top_k(once, ["query"], [F.col("own"), F.desc("score"), F.col("hit")], 5).select("query", "hit", "score")


_KNN = f"""{_V}, near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, hit) AS rank FROM (
  SELECT a.id AS query, b.id AS hit, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a JOIN v b ON a.label = b.label AND a.id <> b.id)) WHERE rank <= 8)"""


@query(f"WITH {_KNN} SELECT query, hit, score, rank FROM near")
def knn_graph(spark: SparkSession, d: str) -> DataFrame:
    return L.nearest_in_scope(_vectors(spark, d), "label", 8).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {_KNN} SELECT a.query AS u, a.hit AS v, round(greatest(0, least(1, least(a.score, b.score) * (0.85 + 0.15 * (1 - (greatest(a.rank, b.rank) - 1) / 8.0)))), 9) AS confidence
FROM near a JOIN near b ON a.query = b.hit AND a.hit = b.query AND a.query < a.hit""")
def mutual_knn(spark: SparkSession, d: str) -> DataFrame:
    pairs = L.mutual(L.nearest_in_scope(_vectors(spark, d), "label", 8))
    return pairs.select("u", "v", F.round(mutual_confidence(F.col("forward"), F.col("backward"), F.col("worst"), 8), 9).alias("confidence"))


def _enough(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query, wanted, enough): how many hits a query should have, and whether 95 of 100 of all are found."""
    per_query = nearest.recall(found, exact)
    total = per_query.agg((F.sum("found") >= 0.95 * F.sum("wanted")).alias("enough"))
    return per_query.crossJoin(total).select("query", "wanted", "enough")  # one row


@query(f"WITH {_V} SELECT id AS query, least(5, (SELECT count(*) FROM v)) AS wanted, true AS enough FROM v WHERE id % 50 = 0")
def ann_topk(spark: SparkSession, d: str) -> DataFrame:
    """What the inverted file finds of the exact five nearest, in as many cells as its sample calls for."""
    rows = _vectors(spark, d)
    middle, probes = nearest.fitted(rows, 5)
    return _enough(nearest.ann_lane(_vector_queries(spark, d), rows, middle, 5, probes), L.vector_lane(_vector_queries(spark, d), rows, 5))


@query(f"WITH {_V}, s AS (SELECT label, count(*) - 1 AS n FROM v GROUP BY 1) SELECT id AS query, least(8, n) AS wanted, true AS enough FROM v JOIN s USING (label) WHERE n > 0")
def ann_graph(spark: SparkSession, d: str) -> DataFrame:
    """What the inverted file finds of the eight nearest others of every row within its label."""
    rows = _vectors(spark, d)
    middle, probes = nearest.fitted(rows, 8)
    return _enough(nearest.ann_neighbours(rows, middle, 8, probes, "label"), L.nearest_in_scope(rows, "label", 8))


@query()
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunked(spread(table(spark, d, "documents")))


@query()
def page_blocks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.posexplode(chunking.page_blocks(F.col("html"))).alias("position", "b")).select("page_id", "position", "b.kind", "b.text")


_MARK = "'[SOURCE ' || {} || ']'"
_MARKS = " || ' and ' || ".join(_MARK.format(x) for x in ("o_orderkey % 6", "o_custkey % 5"))


@query(f"""SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_filter([CAST(o_orderkey % 6 AS INT), CAST(o_custkey % 5 AS INT)], lambda x: x BETWEEN 1 AND 3))), ',') AS found, len(list_distinct(list_filter([o_orderkey % 6, o_custkey % 5], lambda x: x BETWEEN 1 AND 3))) AS n,
  trim(list_reduce(list_prepend('See ' || {_MARKS} || '.', list_transform(list_filter(list_distinct([o_orderkey % 6, o_custkey % 5]), lambda x: x NOT BETWEEN 1 AND 3), lambda x: {_MARK.format('x')})), lambda t, m: replace(t, m, ''))) AS clean FROM orders""")
def citations(spark: SparkSession, d: str) -> DataFrame:
    mark = lambda c: F.concat(F.lit("[SOURCE "), c.cast("string"), F.lit("]"))
    answer = F.concat(F.lit("See "), mark(F.col("o_orderkey") % 6), F.lit(" and "), mark(F.col("o_custkey") % 5), F.lit("."))
    cited = grounding.citations(answer, F.lit(3))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(F.array_sort(cited), ",").alias("found"), F.size(cited).cast("long").alias("n"), grounding.without_invalid_citations(answer, F.lit(3)).alias("clean"))


@query("""SELECT o_orderkey, o_orderkey % 900 + 1 <> 7 OR o_orderkey % 3 <> 0 AS supported, false AS reversed, o_orderkey % 3 <> 0 AS partly FROM orders""")
def grounding_verdict(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    first, second = F.concat((k % 900 + 1).cast("string"), F.lit(" mg")), F.lit("1,250.5 USD")
    claim = F.concat(F.lit("Take "), first, F.lit(" for "), second)
    evidence = F.concat(F.lit("A dose of "), F.when((k % 900 == 6) & (k % 3 == 0), "8 mg").otherwise(first), F.lit(" costs 7 EUR less, that is "), second)
    turned = F.concat(second, F.lit(" then "), first)
    part = F.when(k % 3 == 0, second).otherwise(F.concat(first, F.lit(" for "), second))
    rows = table(spark, d, "orders").select("o_orderkey", *[grounding.numeric_claims(t, F.lit("en")).alias(n) for n, t in (("c", claim), ("e", evidence), ("t", turned), ("p", part))])
    return rows.select("o_orderkey", *[grounding.in_order(F.col("c"), F.col(n)).alias(a) for n, a in (("e", "supported"), ("t", "reversed"), ("p", "partly"))])


_MERGED = """b AS (SELECT o_custkey AS query, o_orderkey AS hit, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders QUALIFY r <= 12),
e AS (SELECT o_custkey AS query, o_orderkey AS hit, o_orderkey AS position FROM orders WHERE o_orderpriority = '1-URGENT')"""


def _merged_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A customer's dearest orders, and the urgent ones."""
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("hit"), "o_totalprice", "o_orderpriority")
    base = R.top_k(orders, ["query"], [F.desc("o_totalprice"), F.col("hit")], 12, "position").select("query", "hit", "position")
    return base, orders.filter("o_orderpriority = '1-URGENT'").select("query", "hit", F.col("hit").alias("position"))


@query(f"""WITH {_MERGED}, h AS (SELECT DISTINCT query FROM e),
own AS (SELECT b.query, hit, CASE WHEN r <= CASE WHEN h.query IS NULL THEN 8 ELSE 6 END THEN r ELSE r + 8 END AS o, 0 AS l FROM b LEFT JOIN h ON h.query = b.query),
more AS (SELECT query, hit, 6 + row_number() OVER (PARTITION BY query ORDER BY position, hit) AS o, 1 AS l FROM e WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.query = e.query AND own.hit = e.hit AND o <= 6) QUALIFY row_number() OVER (PARTITION BY query ORDER BY position, hit) <= 2),
u AS (SELECT * FROM (SELECT * FROM own UNION ALL SELECT * FROM more) QUALIFY row_number() OVER (PARTITION BY query, hit ORDER BY o, l) = 1)
SELECT query, hit, row_number() OVER (PARTITION BY query ORDER BY o, l, hit) AS slot FROM u QUALIFY slot <= 8""")
def reserved_slots(spark: SparkSession, d: str) -> DataFrame:
    base, extra = _merged_inputs(spark, d)
    return R.reserved_merge(base, extra, "query", "hit", "position", 8).select("query", "hit", F.col("slot").cast("long").alias("slot"))


@query(f"""WITH {_MERGED}, new AS (SELECT query, hit, row_number() OVER (PARTITION BY query ORDER BY position, hit) AS r FROM e WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.query = e.query AND b.hit = e.hit) QUALIFY r <= 2),
u AS (SELECT query, hit, CASE WHEN r <= 4 THEN r * 10 ELSE r * 10 + 100 END AS o FROM b UNION ALL SELECT query, hit, 40 + r FROM new)
SELECT query, hit, row_number() OVER (PARTITION BY query ORDER BY o, hit) AS slot FROM u QUALIFY slot <= 8""")
def competitive_admission(spark: SparkSession, d: str) -> DataFrame:
    base, extra = _merged_inputs(spark, d)
    return R.interleaved(base, extra, "query", "hit", "position", 4, 8).select("query", "hit", F.col("slot").cast("long").alias("slot"))
