"""Edges that nobody has used yet: links of new chunks, mutual neighbours found by nightly work, and
the work's own bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galena.operators.ranking import ranked

#: Likeness of a link and above which a neighbour is a copy; links of a new chunk; degree of a node.
LINK, COPY, LINKS, DEGREE = 0.5, 0.98, 4, 16
#: Confidence that makes a candidate, activates it, and keeps it active; new ones of a source.
CANDIDATE, ACTIVATE, RETAIN, NEW_PER_SOURCE = 0.86, 0.94, 0.90, 3


def semantic_links(neighbours: DataFrame, degrees: DataFrame, least: float = LINK, copy: float = COPY, links: int = LINKS, degree: int = DEGREE) -> DataFrame:
    """(query, hit, score, rank): links of new chunks to their neighbours (query, hit, score, alike).

    Neighbours of another language (alike false), copies, and the chunk itself are rejected, as are
    nodes (degrees: hit, degree) that have as many links as they may have."""
    good = neighbours.filter((F.col("query") != F.col("hit")) & F.col("alike") & (F.col("score") >= least) & (F.col("score") < copy))
    free = good.join(degrees, "hit", "left").filter(F.coalesce("degree", F.lit(0)) < degree)
    return ranked(free, ["query"], [F.desc("score"), F.col("hit")]).filter(F.col("rank") <= links).select("query", "hit", "score", "rank")


def observed(stored: DataFrame, found: DataFrame, candidate: float = CANDIDATE, activate: float = ACTIVATE, retain: float = RETAIN, per_source: int = NEW_PER_SOURCE) -> DataFrame:
    """(u, v, confidence, state) after a round: stored (u, v, confidence, state) meets found (u, v,
    confidence).

    A found pair is ACTIVE from `activate` on, stays so from `retain` on, and is else a CANDIDATE; one
    that was not found again is STALE. Of new pairs a source adds its `per_source` surest."""
    good = found.filter(F.col("confidence") >= candidate)
    keys = stored.select("u", "v")
    new = ranked(good.join(keys, ["u", "v"], "left_anti"), ["u"], [F.desc("confidence"), F.col("v")]).filter(F.col("rank") <= per_source).drop("rank")
    again = good.join(keys, ["u", "v"], "left_semi").unionByName(new).withColumnRenamed("confidence", "now")
    both = stored.join(again, ["u", "v"], "full")
    state = F.when(F.col("now").isNull(), "STALE").when((F.col("now") >= activate) | (F.col("state").eqNullSafe("ACTIVE") & (F.col("now") >= retain)), "ACTIVE").otherwise("CANDIDATE")
    return both.select("u", "v", F.coalesce("now", "confidence").alias("confidence"), state.alias("state"))


def within_degree(pairs: DataFrame, degree: int = DEGREE) -> DataFrame:
    """(u, v, confidence): active pairs that are among the surest `degree` of both their ends; the others
    are retired."""
    ends = pairs.select("u", "v", "confidence", F.explode(F.array("u", "v")).alias("node"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("confidence"), "u", "v"))
    both = ends.withColumn("_r", rank).groupBy("u", "v", "confidence").agg(F.max("_r").alias("_worst"))
    return both.filter(F.col("_worst") <= degree).drop("_worst")


def next_units(units: DataFrame, done: DataFrame, budget: float) -> DataFrame:
    """Units of work (shard, unit, cost) that a round takes up: those without a checkpoint in done (unit),
    each shard in order of unit, while its costs are within the budget."""
    rest = units.join(done.select("unit").distinct(), "unit", "left_anti")
    spent = F.sum("cost").over(Window.partitionBy("shard").orderBy("unit"))
    return rest.withColumn("spent", spent).filter(F.col("spent") <= budget)


def edge_utility(shown: DataFrame, cited: DataFrame) -> DataFrame:
    """(src, tgt, shown, cited): how often an edge brought a chunk (query, src, tgt), and how often the
    answer cited it (query, tgt)."""
    marks = cited.select("query", "tgt").distinct().withColumn("_c", F.lit(1))
    return shown.join(marks, ["query", "tgt"], "left").groupBy("src", "tgt").agg(F.count("*").alias("shown"), F.count("_c").alias("cited"))


def lease_holder(leases: DataFrame, as_of: Column) -> DataFrame:
    """(job, owner): the live lease of each job (job, owner, fence, until), the one of the latest fence."""
    live = leases.filter(F.col("until") > as_of)
    return live.groupBy("job").agg(F.max_by("owner", F.struct("fence", "owner")).alias("owner"))
