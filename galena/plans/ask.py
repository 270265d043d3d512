"""The whole way from questions to cited answers that their sources bear out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.functions import grounding, text
from galena.operators import context, retrieval
from galena.plans import planner
from galena.plans.lanes import Index, searched
from galena.sources.batches import bounded_batches
from galena.sources.shared import stored


def extractive(chosen: DataFrame) -> DataFrame:
    """(query, answer): the first sentence of the best source (query, slot, text), with its citation."""
    first = F.regexp_extract("text", r"(?s)^(.*?[.!?])(\s|$)", 1)
    return chosen.filter("slot = 1").select("query", F.concat(F.when(first != "", first).otherwise(F.substring("text", 1, 200)), F.lit(" [SOURCE 1]")).alias("answer"))


def answered(questions: DataFrame, documents: DataFrame, id_col: str = "query", k: int = 10, index: Index | None = None, answers: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """(query, status, answer, sources, sentences, missing, mismatched) for questions (query, text) over
    documents (hit, document, text).

    Every part of a question is searched by the lanes of its plan, the hits of all parts and lanes are fused,
    and a bounded context is chosen. `answers` (query, answer) are a model's, with citations [SOURCE n] of the context's
    slots; without them the answer is extractive. Every answer is verified against the sources that it cites,
    sentence by sentence: status is GROUNDED only if each sentence has a valid citation and its quantities and dates
    stand in one of its sources in order. `labels` (query, labels) are an entailment model's for the sentences: a
    contradiction makes the answer REJECTED, and one that is not supported INSUFFICIENT. Of an answer that is not
    GROUNDED the fallback of the question's language is shown; INSUFFICIENT is also the status where nothing
    was found. The index has more lanes to search; without one the lexical lane is searched."""
    spark = questions.sparkSession
    plans = planner.planned(questions, id_col, "text", index.surfaces if index else None).withColumnRenamed(id_col, "query")
    whole = plans.filter("part = 0").select("query", "language")
    found = stored(searched(plans, index or Index(documents.select("hit", "text")), k), "found")
    # A hit counts under its lane of most authority, so that the share of the graph is bounded.
    lane = F.min_by("lane", retrieval.tier(F.col("lane")))
    hits = retrieval.fused(found).join(found.groupBy("query", "hit").agg(lane.alias("lane")), ["query", "hit"])
    hits = hits.join(documents.select("hit", "document", "text"), "hit").withColumn("tokens", text.token_estimate(F.col("text")))  # of the hits alone
    hits = stored(hits, "hits")
    chosen = stored(context.budgeted(hits).join(hits.select("query", "hit", "text"), ["query", "hit"]), "context")
    given = answers.select("query", "answer") if answers is not None else extractive(chosen)
    # At most as many sources as the context's bound meet in a row.
    sources = chosen.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "text"))), lambda s: s["text"]).alias("texts"))
    rows = whole.join(sources, "query", "left").join(given, "query", "left")
    if labels is not None:
        rows = rows.join(labels.select("query", "labels"), "query", "left")
    bounded_batches(spark)
    none = F.array().cast("array<string>")
    rows = rows.withColumn("texts", F.coalesce("texts", none)).withColumn("clean", grounding.without_invalid_citations(F.col("answer"), F.size("texts")))
    rows = rows.withColumn("v", grounding.verdict(F.col("clean"), F.col("language"), F.col("texts")))
    status = F.when(F.col("answer").isNull() | (F.size("texts") == 0), "INSUFFICIENT").when(F.col("v.status") != "GROUNDED", "UNGROUNDED")
    if labels is not None:
        status = status.otherwise(grounding.entailment_verdict(F.coalesce("labels", none)))
    else:
        status = status.otherwise("GROUNDED")
    rows = rows.withColumn("status", status)
    shown = F.when(F.col("status") == "GROUNDED", F.col("clean")).otherwise(grounding.fallback_message(F.col("language")))
    return rows.select("query", "status", shown.alias("answer"), F.size("texts").alias("sources"), *[F.coalesce(f"v.{c}", F.lit(0)).alias(c) for c in ("sentences", "missing", "mismatched")])
