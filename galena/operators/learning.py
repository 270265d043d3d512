"""Query memory, router policies and their gates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from galena.operators.ranking import time_bucket_cap
from galena.sources.shared import stored

#: Likeness that joins a cluster, weight that a centroid stops at.
LIKENESS, WEIGHT = 0.86, 32


def leader_clusters(rows: DataFrame, scope: str) -> DataFrame:
    """Online leader clustering in order of `seq` within each scope: (scope, id, cluster), the cluster
    being the id that opened it. A row joins the nearest centroid that is like enough.

    The fold depends on order, so a scope is one group; scopes are the unit of work. Vectors without a
    direction are in no cluster."""
    from galena.operators.retrieval import directed, unit

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("seq", "ascending"), ("id", "ascending")])
        vectors = unit(rows["vector"].combine_chunks())
        centres, weights, names, out = [], [], [], []
        for i, v in zip(rows["id"].to_pylist(), vectors, strict=True):
            if centres:
                all_centres = np.array(centres)
                likeness = all_centres @ v / np.linalg.norm(all_centres, axis=1)
                best = int(likeness.argmax())
                if likeness[best] >= LIKENESS:
                    w = min(weights[best], WEIGHT)
                    centres[best] = (centres[best] * w + v) / (w + 1)
                    weights[best] += 1
                    out.append(names[best])
                    continue
            centres.append(v)
            weights.append(1)
            names.append(i)
            out.append(i)
        return pa.table({scope: rows[scope], "id": rows["id"], "cluster": pa.array(out, rows.schema.field("id").type)})

    types = dict(rows.dtypes)
    return rows.select(scope, "id", "seq", "vector").filter(directed(F.col("vector"))).groupBy(scope).applyInArrow(run, f"{scope} {types[scope]}, id {types['id']}, cluster {types['id']}")


def split_clusters(rows: DataFrame, scope: str, most: int = 5000, cells: int | None = None) -> DataFrame:
    """Leader clustering for scopes of any size: (scope, id, cluster), the cluster being the id that opened it.

    Equal vectors are one row. Vectors are dealt to the cells of an inverted file, and cells of more than `most` rows
    are dealt further by hash, so that no task folds more than about `most` rows; each folds in order of `seq`. The
    leaders found then join: each points to the leader before it, in order, that is nearest and like enough among all of
    its scope, and pointers are followed to their end. Centroids move inside a fold only, so that clusters can differ from
    those of one fold over the scope where rows lie between two leaders. Rows without a scope are a scope of their own."""
    from galena.operators import nearest
    from galena.operators.retrieval import directed

    # A struct of a null is equal to another one, where a null is not.
    kept = rows.select(F.struct(F.col(scope).alias("s")).alias("scope"), "id", "seq", "vector").filter(directed(F.col("vector")))
    same = kept.groupBy("scope", "vector").agg(F.min(F.struct("seq", "id")).alias("f")).select("scope", "vector", F.col("f.seq").alias("seq"), F.col("f.id").alias("id"))
    same = stored(same, "distinct")
    middle, _ = nearest.fitted(same.select(F.col("id").alias("hit"), "vector"), 1, cells)
    placed = stored(nearest.in_cells(same, middle).select("scope", "id", "seq", "vector", F.get("cells", F.lit(0)).alias("cell")), "cells")
    sizes = placed.groupBy("scope", "cell").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    dealt = placed.join(sizes, ["scope", "cell"]).withColumn("part", F.struct("scope", "cell", F.pmod(F.xxhash64("id"), F.col("parts").cast("long")).alias("lot")))
    folded = stored(leader_clusters(dealt.select("part", "id", "seq", "vector"), "part").select("id", "cluster"), "folded")
    leaders = placed.join(folded.filter("id = cluster").select("id"), "id", "left_semi").select("scope", F.col("id").alias("hit"), "seq", "vector")
    leaders = stored(leaders, "leaders")
    block = max(1, nearest.BLOCK_NUMBERS // (middle.shape[1] if len(middle) else 1))
    points = stored(nearest.nearest_earlier(leaders, "scope", LIKENESS, block).select(F.col("query").alias("id"), F.col("hit").alias("to")), "points")
    while True:
        # Pointers lead to earlier leaders, so that they end; each round halves the way.
        further = points.join(points.select(F.col("id").alias("to"), F.col("to").alias("next")), "to", "left")
        moved = stored(further.select("id", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "points")
        points = moved.select("id", "to")
        if moved.filter("moved").isEmpty():
            break
    roots = folded.join(points.select(F.col("id").alias("cluster"), "to"), "cluster", "left").select("id", F.coalesce("to", "cluster").alias("cluster"))
    firsts = same.join(roots, "id").select("scope", "vector", "cluster")
    return kept.join(firsts, ["scope", "vector"]).select(F.col("scope.s").alias(scope), "id", "cluster")


def router_samples(events: DataFrame, window_seconds: int, cap: int) -> DataFrame:
    """Samples with at most `cap` of a source in each span of time."""
    return time_bucket_cap(events, "source", "ts", window_seconds, cap, ["id"])


def lane_support(samples: DataFrame) -> DataFrame:
    """(query_class, lane, samples, cited, selected): shares of samples in which a lane contributed.

    samples: query_class, id, and maps cited and selected from lane to count."""
    sizes = samples.groupBy("query_class").agg(F.count("*").alias("samples"))
    each = samples.select("query_class", "id", F.explode(F.map_entries(F.map_zip_with("cited", "selected", lambda k, a, b: F.struct(F.coalesce(a, F.lit(0)).alias("c"), F.coalesce(b, F.lit(0)).alias("s"))))).alias("e"))
    sums = each.groupBy("query_class", F.col("e.key").alias("lane")).agg(F.count(F.when(F.col("e.value.c") > 0, 1)).alias("c"), F.count(F.when(F.col("e.value.s") > 0, 1)).alias("s"))
    return sums.join(sizes, "query_class").select("query_class", "lane", "samples", (F.col("c") / F.col("samples")).alias("cited"), (F.col("s") / F.col("samples")).alias("selected"))


MANDATORY = ("VECTOR", "REFERENCE", "IDENTIFIER")


def router_policy(support: DataFrame, sources: DataFrame, least_queries: int = 50, least_sources: int = 3, most_share: float = 0.60) -> DataFrame:
    """(query_class, lane, keep): optional lanes stay if they were cited in .03 or selected in .10 of
    the samples; classes with too few queries or sources keep all lanes.

    sources: query_class, source, n."""
    by_class = sources.groupBy("query_class").agg(F.count("*").alias("n_sources"), (F.max("n") / F.sum("n")).alias("max_share"))
    safe = (F.col("samples") >= least_queries) & (F.col("n_sources") >= least_sources) & (F.col("max_share") <= most_share)
    used = (F.col("cited") >= 0.03) | (F.col("selected") >= 0.10)
    return support.join(by_class, "query_class").select("query_class", "lane", (F.col("lane").isin(*MANDATORY) | used | ~safe).alias("keep"))


def shadow_gate(observations: DataFrame) -> DataFrame:
    """One row: sums of shadow runs and whether they pass. A run that changed nothing is not counted."""
    changed = F.col("changed")
    out = observations.agg(
        F.count(F.when(changed, 1)).alias("samples"), F.count_distinct(F.when(changed, F.col("source"))).alias("sources"),
        (F.sum(F.when(changed, F.col("found_documents"))) / F.sum(F.when(changed, F.col("target_documents")))).alias("document_recall"),
        (F.sum(F.when(changed, F.col("found_chunks"))) / F.sum(F.when(changed, F.col("target_chunks")))).alias("chunk_recall"),
        F.avg(F.when(changed, F.col("failed").cast("double"))).alias("failure_rate"), F.percentile(F.when(changed, F.col("latency")), F.lit(0.95)).alias("p95"))
    good = (F.col("samples") >= 100) & (F.col("sources") >= 3) & (F.col("document_recall") >= 0.99) & (F.col("chunk_recall") >= 0.95) & (F.col("failure_rate") <= 0.02) & (F.col("p95") <= 15_000)
    return out.withColumn("passed", good)


def canary_gate(observations: DataFrame) -> DataFrame:
    """One row: canary against control, and whether the canary may go on."""

    def of(cohort: str, condition: str) -> Column:
        return F.avg(F.when(F.col("cohort") == cohort, F.expr(condition).cast("double")))

    def p95(cohort: str) -> Column:
        return F.percentile(F.when(F.col("cohort") == cohort, F.col("latency")), F.lit(0.95))

    out = observations.agg(
        F.count(F.when(F.col("cohort") == "CANARY", 1)).alias("canary"), F.count(F.when(F.col("cohort") == "CONTROL", 1)).alias("control"),
        (of("CONTROL", "grounded") - of("CANARY", "grounded")).alias("grounded_drop"), (of("CANARY", "unavailable") - of("CONTROL", "unavailable")).alias("unavailable_rise"),
        of("CANARY", "critical").alias("critical_rate"), (of("CANARY", "degraded") - of("CONTROL", "degraded")).alias("degraded_rise"), (p95("CANARY") / p95("CONTROL") - 1).alias("p95_rise"))
    good = (F.col("canary") >= 100) & (F.col("control") >= 300) & (F.col("grounded_drop") <= 0.03) & (F.col("unavailable_rise") <= 0.01) & (F.col("critical_rate") <= 0.01) & (F.col("degraded_rise") <= 0.05) & (F.col("p95_rise") <= 0.20)
    return out.withColumn("passed", good)


def next_stage(stage: Column, passed: Column) -> Column:
    """Promotion of a policy: a failed gate rejects it, an approved one is never moved on."""
    return F.when(stage.isin("APPROVED", "SUPERSEDED", "REJECTED"), stage).when(~passed, "REJECTED").when(stage == "CANDIDATE", "SHADOW").when(stage == "SHADOW", "CANARY").when(stage == "CANARY", "APPROVED").otherwise(stage)


def baseline_differences(baseline: DataFrame, candidate: DataFrame, keys: list[str], metric: str, most_drop: float, least: float) -> DataFrame:
    """Slices of two runs side by side, and what is wrong with each (a missing slice, a low value, a drop)."""
    both = baseline.select(*keys, F.col(metric).alias("before")).join(candidate.select(*keys, F.col(metric).alias("after")), keys, "full")
    verdict = F.when(F.col("after").isNull(), "MISSING").when(F.col("after") < least, "LOW").when(F.col("before") - F.col("after") > most_drop, "DROP").otherwise("OK")
    return both.withColumn("verdict", verdict)


def remembered(memory: DataFrame, queries: DataFrame, k: int = 2, least: float = LIKENESS) -> DataFrame:
    """Clusters (cluster, scope, centroid, support) that serve a query (query, required, vector): the
    scope holds all that is required, and the likeness is enough; by likeness, then support."""
    from galena.functions.vectors import cosine
    from galena.operators.ranking import top_k

    # Candidates share a scope element, which is what a query requires first; a query that requires
    # nothing meets every cluster, under a mark that each scope has.
    mark = F.lit("\u0000")
    kind = queries.schema["required"].dataType.elementType
    q = queries.withColumn("first", F.coalesce(F.try_element_at("required", F.lit(1)).cast("string"), mark))
    m = memory.withColumn("first", F.explode(F.array_append(F.array_distinct(F.transform("scope", lambda x: x.cast("string"))), mark)))
    m = m.withColumn("scope", F.col("scope").cast(T.ArrayType(kind)))
    pairs = q.join(m, "first").filter(F.size(F.array_except("required", "scope")) == 0)
    scored = pairs.withColumn("likeness", F.round(cosine(F.col("vector"), F.col("centroid")), 6)).filter(F.col("likeness") >= least)
    return top_k(scored, ["query"], [F.desc("likeness"), F.desc("support"), F.col("cluster")], k).select("query", "cluster", "likeness", "support", "rank")


# Reasons of feedback with the trust in what they say.
FEEDBACK = {"WRONG_SOURCE": "SPECIFIC", "OUTDATED": "SPECIFIC", "MISSING_CITATION": "SPECIFIC", "HELPFUL": "GENERAL", "NOT_HELPFUL": "GENERAL", "OTHER": "WEAK"}


def recorded(stored: DataFrame, requests: DataFrame) -> DataFrame:
    """Learning events to append: one of each request (request, seq, query_class, trace) that is not stored;
    the counts come from the trace (JSON). A trace that cannot be read counts nothing."""
    from galena.sources.tables import insert_ignore

    trace = F.from_json("trace", "retrieved int, selected int, cited int, lanes map<string,int>")
    new = insert_ignore(stored, requests, ["request"], [F.col("seq")]).withColumn("_t", trace)
    counts = [F.coalesce(F.col(f"_t.{c}"), F.lit(0)).alias(c) for c in ("retrieved", "selected", "cited")]
    return new.select("request", "query_class", *counts, F.coalesce(F.map_keys("_t.lanes"), F.array().cast("array<string>")).alias("lanes"))


def shadow_observations(cited: DataFrame, candidate: DataFrame, changed: DataFrame) -> DataFrame:
    """What a candidate plan would have kept of the cited chunks (query, document, chunk): its hits are
    candidate (query, document, chunk), and changed (query, changed) says whether its plan differs."""
    goal = cited.select("query", "document", "chunk").distinct()
    hits = candidate.select("query", "document", "chunk").distinct()
    chunk = goal.join(hits.withColumn("_c", F.lit(1)), ["query", "document", "chunk"], "left").groupBy("query").agg(F.count("*").alias("target_chunks"), F.count("_c").alias("found_chunks"))
    document = goal.select("query", "document").distinct().join(hits.select("query", "document").distinct().withColumn("_d", F.lit(1)), ["query", "document"], "left").groupBy("query").agg(F.count("*").alias("target_documents"), F.count("_d").alias("found_documents"))
    return chunk.join(document, "query").join(changed, "query")


def feedback(rows: DataFrame, cap: int = 5) -> DataFrame:
    """(request, source, reason, trust): the first feedback of each request (request, source, reason,
    seq), and of a source the first `cap` that count; what is beyond has the trust CAPPED."""
    from galena.sources.tables import latest

    first = latest(rows, ["request"], [F.col("seq")])
    known = F.create_map(*[F.lit(x) for pair in FEEDBACK.items() for x in pair])
    trust = F.coalesce(F.try_element_at(known, F.upper(F.trim("reason"))), F.lit("WEAK"))
    number = F.row_number().over(Window.partitionBy("source").orderBy("seq", "request"))
    return first.withColumn("_n", number).select("request", "source", "reason", F.when(F.col("_n") <= cap, trust).otherwise("CAPPED").alias("trust"))


def settings_fingerprint(settings: Column) -> Column:
    """SHA-256 of a map of settings in order of their names, each name and value behind its length."""
    entries = F.array_sort(F.map_entries(settings))
    part = lambda c: F.concat(F.octet_length(F.coalesce(c, F.lit(""))).cast("string"), F.lit(":"), F.coalesce(c, F.lit("")))
    return F.sha2(F.array_join(F.transform(entries, lambda e: F.concat(part(e["key"]), part(e["value"]))), ""), 256)


def attribution(hits: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """(stage, lane, n): how many hits (query, lane, hit, ...) of each lane reach each stage, by the condition
    of the stage. All stages are counted in one pass."""
    sums = hits.groupBy("lane").agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in stages.items()])
    listed = F.array(*[F.struct(F.lit(name).alias("stage"), F.col(name).alias("n")) for name in stages])
    return sums.select("lane", F.explode(listed).alias("x")).select("x.stage", "lane", "x.n")
