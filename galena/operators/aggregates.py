"""Aggregations of the retrieval and learning processes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def share(condition: Column) -> Column:
    """Share of rows that meet a condition."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def percentile_continuous(value: Column, p: float) -> Column:
    return F.percentile(value, F.lit(p))


def percentile_nearest_rank(value: str, p: float, condition: str = "true") -> Column:
    """The value at rank ceil(p * n)."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value}) FILTER (WHERE {condition})").cast("double")


def noisy_or(confidence: Column) -> Column:
    """1 - product(1 - c); a certain cause makes the result certain."""
    return F.lit(1.0) - F.product(F.lit(1.0) - confidence)


def reciprocal_rank(rank: Column, weight: Column | float = 1.0, k: int = 60) -> Column:
    return (weight if isinstance(weight, Column) else F.lit(weight)) / (F.lit(float(k)) + rank)


def distinct_sketch(bucket: Column) -> Column:
    """Number of buckets of a 256-bit sketch that are set."""
    return F.count_distinct(F.pmod(bucket, F.lit(256)))


def first_per_bucket(rows: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str]) -> DataFrame:
    """Marks each row that sets a new bucket of its key's sketch (`grows`), in order of arrival."""
    by = Window.partitionBy(*keys, bucket).orderBy(*order)
    return rows.withColumn("grows", F.row_number().over(by) == 1)


def wilson_lower_bound(successes: Column, trials: Column, z: float = 1.96) -> Column:
    """Lower end of the Wilson interval of a rate; 0 without trials."""
    n = trials.cast("double")
    p = successes / n
    spread = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(trials > 0, (p + z * z / (2 * n) - spread) / (1 + z * z / n)).otherwise(0.0)


def weighted_utility(parts: Sequence[tuple[Column, float]]) -> Column:
    total = sum(w for _, w in parts)
    out = F.lit(0.0)
    for value, w in parts:
        out = out + value * w
    return out / total


def centroids(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, centroid, support): the mean of each key's vectors, by dimension."""
    each = rows.select(key, F.posexplode(vector).alias("dim", "x"))
    means = each.groupBy(key, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("centroid"), F.max("n").alias("support"))


def concentration(rows: DataFrame, source: Column) -> DataFrame:
    """One row: how far few sources dominate. Null sources are unknown; an outlier has more than four times the median."""
    by_source = rows.groupBy(source.alias("source")).agg(F.count("*").alias("n"))
    known = F.col("source").isNotNull()
    middle = by_source.filter(known).agg(F.percentile("n", F.lit(0.5)).alias("middle"))
    joined = by_source.crossJoin(F.broadcast(middle))
    total = F.sum("n")
    return joined.agg(
        (F.max(F.when(known, F.col("n"))) / total).alias("max_share"),
        F.count(F.when(known, 1)).alias("n_sources"),
        (F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)) / total).alias("unknown_share"),
        (F.count(F.when(known & (F.col("n") > 4 * F.col("middle")), 1)) / F.count(F.when(known, 1))).alias("outlier_rate"),
    )
