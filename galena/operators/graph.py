"""The association graph: edges, bands, upkeep, and its growth from co-citation and likeness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galena.operators.ranking import top_k

#: Bands from weakest to strongest, and how many edges of each a node keeps.
BANDS = ("DECAYED", "CANDIDATE", "WARM", "HOT")
QUOTAS = {"HOT": 8, "WARM": 8, "CANDIDATE": 16}


def band_rank(band: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, BANDS)), band).cast("int") - 1


def band_name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, BANDS)), rank.cast("int") + 1)


def band_quota(band: Column) -> Column:
    out = F.lit(0)
    for name, quota in QUOTAS.items():
        out = F.when(band == name, quota).otherwise(out)
    return out


def canonical_pairs(rows: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """(by, u, v, n) with u < v of the keys that share a group: never a self-pair, never across groups. n is how often rows of
    both meet; rows of a key are one before they do, so that no pair is made twice. Rows stay dealt as they come, if by groups."""
    once = rows.groupBy(*by, key).agg(F.count("*").alias("n"))
    left = once.select(*by, F.col(key).alias("u"), F.col("n").alias("_m"))
    right = once.select(*by, F.col(key).alias("v"), "n")
    return left.join(right.hint("merge"), list(by)).filter("u < v").select(*by, "u", "v", (F.col("_m") * F.col("n")).alias("n"))


def live_edges(edges: DataFrame, published: DataFrame, generations: DataFrame) -> DataFrame:
    """Edges whose ends are both published, of one access level."""
    rows = generations.filter("generation_status = 'PUBLISHED'").select("document_id", F.col("generation").alias("published_generation"))
    ends = published.join(rows, ["document_id", "published_generation"], "left_semi").select("document_id", "access_level")
    source = ends.select(F.col("document_id").alias("src"), F.col("access_level").alias("a"))
    target = ends.select(F.col("document_id").alias("tgt"), F.col("access_level").alias("b"))
    return edges.join(source, "src").join(target, "tgt").filter("a = b").select(*edges.columns)


def saturating(count: Column, scale: float) -> Column:
    return -F.expm1(-count / F.lit(scale))


def association_score(support: Column, citations: Column, likeness: Column, age_days: Column, scale: float = 5.0, half_life: float = 30.0) -> Column:
    """Weights .45, .20 and .35 of saturated use, saturated citations and likeness, halved every
    `half_life` days, within 0 and 1."""
    fresh = F.pow(F.lit(0.5), age_days / half_life)
    raw = (0.45 * saturating(support, scale) + 0.20 * saturating(citations, scale) + 0.35 * likeness) * fresh
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def next_band(band: Column, weight: Column, queries: Column, citations: Column, age_days: Column) -> Column:
    """The band after one round of upkeep."""
    return (
        F.when((band == "CANDIDATE") & (weight >= 0.35) & (queries >= 2), "WARM")
        .when((band == "CANDIDATE") & (age_days >= 30), "DECAYED")
        .when((band == "WARM") & (weight >= 0.65) & (queries >= 4) & (citations >= 1), "HOT")
        .when((band == "WARM") & (weight < 0.20), "CANDIDATE")
        .when((band == "HOT") & (weight < 0.50), "WARM")
        .otherwise(band)
    )


def symmetric(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Each edge in both directions, so that both rows change or neither; edges are computed once."""
    rest = [c for c in edges.columns if c not in (u, v)]
    ends = F.array(F.struct(F.col(u).alias("a"), F.col(v).alias("b")), F.struct(F.col(v).alias("a"), F.col(u).alias("b")))
    return edges.select(F.explode(ends).alias("_ends"), *rest).select(F.col("_ends.a").alias(u), F.col("_ends.b").alias(v), *rest)


def maintained(edges: DataFrame, by: Sequence[str] = ("src",), purge_days: int = 14) -> DataFrame:
    """Score, move bands, evict beyond quotas, and purge what has long decayed."""
    scored = edges.withColumn("weight", association_score(F.col("support"), F.col("citations"), F.col("likeness"), F.col("age_days")))
    moved = scored.withColumn("band", next_band(F.col("band"), F.col("weight"), F.col("queries"), F.col("citations"), F.col("age_days")))
    alive = moved.filter((F.col("band") != "DECAYED") | (F.col("age_days") < 30 + purge_days))
    order = Window.partitionBy(*by, "band").orderBy(F.desc("weight"), F.desc("queries"), F.desc("citations"), F.col("tgt"))
    rank = F.row_number().over(order)
    return alive.withColumn("_r", rank).filter((F.col("band") == "DECAYED") | (F.col("_r") <= band_quota(F.col("band")))).drop("_r")


def mutual_confidence(forward: Column, backward: Column, worst_rank: Column, k: int) -> Column:
    """min(forward, backward) * (.85 + .15 * (1 - (worst rank - 1) / k)), within 0 and 1."""
    raw = F.least(forward, backward) * (0.85 + 0.15 * (1 - (worst_rank - 1) / F.lit(float(k))))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def expansions(seeds: DataFrame, edges: DataFrame, limit: int = 12) -> DataFrame:
    """One hop from seeds (query, node, strength): of each seed four HOT edges of at least .50, in
    full, and two WARM of at least .30, at .70; targets by noisy-or of what reaches them."""
    rules = ((("HOT",), 0.50, 1.0, 4), (("WARM",), 0.30, 0.70, 2))
    reached = None
    for bands, least, factor, count in rules:
        part = edges.filter(F.col("band").isin(*bands) & (F.col("weight") >= least))
        part = top_k(part, ["src"], [F.desc("weight"), F.col("tgt")], count)
        hit = seeds.join(part, seeds["node"] == part["src"]).select("query", "tgt", (F.col("strength") * F.col("weight") * factor).alias("c"))
        reached = hit if reached is None else reached.unionByName(hit)
    found = reached.join(seeds.select("query", F.col("node").alias("tgt")), ["query", "tgt"], "left_anti")
    scored = found.groupBy("query", "tgt").agg((1 - F.product(1 - F.col("c"))).alias("score"))
    return top_k(scored, ["query"], [F.desc("score"), F.col("tgt")], limit)


def co_citations(context: DataFrame, limit: int = 32) -> DataFrame:
    """Pairs of a request's context (request, chunk, cited, fused) with a cited end: both cited
    first, then the greater sum of scores."""
    first = top_k(context, ["request"], [F.desc("cited"), F.desc("fused"), F.col("chunk")], 8).drop("rank")
    left = first.select("request", F.col("chunk").alias("u"), F.col("cited").alias("cu"), F.col("fused").alias("fu"))
    right = first.select("request", F.col("chunk").alias("v"), F.col("cited").alias("cv"), F.col("fused").alias("fv"))
    pairs = left.join(right, "request").filter("u < v and (cu or cv)")
    return top_k(pairs.withColumn("score", F.col("fu") + F.col("fv")), ["request"], [F.desc(F.col("cu") & F.col("cv")), F.desc("score"), F.col("u"), F.col("v")], limit).select("request", "u", "v", "rank")


def context_pairs(rows: DataFrame, request: str, item: str, order: list[Column], most: int = 8) -> DataFrame:
    """(request, u, v), u < v: the pairs of the first `most` distinct items of each request.

    A request is cut to its first items before it moves, so that one of any length costs what the bound allows: at
    most most * (most - 1) / 2 pairs, made inside its row and not by a join. Null items are left out."""
    first = rows.filter(F.col(item).isNotNull()).withColumn("_at", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    once = first.groupBy(request, item).agg(F.min("_at").alias("_at"))
    kept = top_k(once, [request], [F.col("_at"), F.col(item)], most)
    lists = kept.groupBy(request).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    pairs = F.flatten(F.transform("_items", lambda u, i: F.transform(F.filter("_items", lambda v, j: j > i), lambda v: F.struct(u.alias("u"), v.alias("v")))))
    return lists.select(request, F.explode(pairs).alias("p")).select(request, "p.u", "p.v")
