"""The context of an answer: a bounded, diverse choice of hits, and its envelope."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chunks of a context, chunks of one document, chunks from the graph, estimated tokens.
CHUNKS, PER_DOCUMENT, FROM_GRAPH, TOKENS = 10, 4, 2, 6000


def budgeted(hits: DataFrame, chunks: int = CHUNKS, per_document: int = PER_DOCUMENT, from_graph: int = FROM_GRAPH, tokens: int = TOKENS) -> DataFrame:
    """Greedy choice per query in order of place; a hit that breaks a limit is skipped, not the end.

    hits: query, place, document, hit, lane, tokens. Returns query, hit, slot. Lists are cut to a
    bounded length by the lanes before this, so a query's group is small.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("place", "ascending"), ("hit", "ascending")]).to_pylist()
        used, documents, graph, kept = 0, {}, 0, []
        for r in rows:
            if len(kept) >= chunks:
                break
            if documents.get(r["document"], 0) >= per_document or used + r["tokens"] > tokens or (r["lane"] == "GRAPH" and graph >= from_graph):
                continue
            used += r["tokens"]
            documents[r["document"]] = documents.get(r["document"], 0) + 1
            graph += r["lane"] == "GRAPH"
            kept.append(r)
        return pa.table({"query": pa.array([r["query"] for r in kept], table.schema.field("query").type), "hit": pa.array([r["hit"] for r in kept], table.schema.field("hit").type), "slot": pa.array(range(1, len(kept) + 1), pa.int32())})

    source = hits.select("query", "place", "document", "hit", "lane", "tokens")
    types = dict(source.dtypes)
    return source.groupBy("query").applyInArrow(run, f"query {types['query']}, hit {types['hit']}, slot int")


def backfilled(hits: DataFrame, eligible: DataFrame, **limits: int) -> DataFrame:
    """Choose, drop what is no longer eligible, and choose once more among what is left."""
    first = budgeted(hits, **limits)
    good = first.join(eligible.select("hit"), "hit", "left_semi").select("query", "hit")
    rest = hits.join(first.select("query", "hit"), ["query", "hit"], "left_anti").join(eligible.select("hit"), "hit", "left_semi")
    kept = hits.join(good, ["query", "hit"], "left_semi").withColumn("place", F.col("place") - 1_000_000)
    return budgeted(kept.unionByName(rest), **limits)


def envelope(context: DataFrame) -> DataFrame:
    """(query, context): JSON of the numbered sources of each query, from query, slot, document, hit, text."""
    source = F.struct(F.col("slot").alias("source"), F.col("document").alias("documentId"), F.col("hit").alias("chunkId"), "text")
    return context.groupBy("query").agg(F.to_json(F.array_sort(F.collect_list(source))).alias("context"))


def neighbours(seeds: DataFrame, chunks: DataFrame, radius: int = 1, most: int = 5) -> DataFrame:
    """Seeds with the chunks around them, each behind its seed, once: query, document, chunk_index, position."""
    first = seeds.filter(F.col("place") <= most)
    near = first.withColumn("o", F.explode(F.sequence(F.lit(-radius), F.lit(radius))))
    near = near.select("query", "document", (F.col("chunk_index") + F.col("o")).alias("chunk_index"), (F.col("place") * 100 + F.when(F.col("o") == 0, 0).otherwise(F.lit(radius) + F.col("o") + 1)).alias("position"))
    there = near.join(chunks.select("document", "chunk_index"), ["document", "chunk_index"], "left_semi")
    return there.groupBy("query", "document", "chunk_index").agg(F.min("position").alias("position"))


def parents(hits: DataFrame, chunks: DataFrame, most: int = 8) -> DataFrame:
    """Hits whose child chunk is replaced by its parent, each parent once by its first child."""
    from galena.operators.ranking import ranked

    kids = chunks.filter("role = 'CHILD'").select("document", "chunk_index", "parent_index")
    up = hits.join(kids, ["document", "chunk_index"], "left").withColumn("shown", F.coalesce("parent_index", "chunk_index"))
    once = ranked(up, ["query", "document", "shown"], [F.col("place")], "_r").filter("_r = 1")
    return ranked(once, ["query"], [F.col("place")], "position").filter((F.col("parent_index").isNull()) | (F.col("position") <= most)).select("query", "document", F.col("shown").alias("chunk_index"), "position")
