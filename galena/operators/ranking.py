"""Windows, dedupe, quotas, limits and ordered merges. Every order ends in a unique key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranked(rows: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_k(rows: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k of each group; Spark cuts groups before it shuffles them."""
    return ranked(rows, by, order, name).filter(F.col(name) <= k)


def overflow(rows: DataFrame, by: Sequence[str], order: Sequence[Column], quota: Column) -> DataFrame:
    """The rows beyond their group's quota."""
    return ranked(rows, by, order).filter(F.col("rank") > quota)


def time_bucket_cap(rows: DataFrame, source: str, ts: str, seconds: int, cap: int, ties: Sequence[str]) -> DataFrame:
    """At most `cap` rows of a source in each span of time, in order of arrival."""
    bucket = F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / seconds)
    return ranked(rows.withColumn("bucket", bucket), [source, "bucket"], [F.col(ts), *map(F.col, ties)]).filter(F.col("rank") <= cap)


def diversity_cap(hits: DataFrame, query: str, section: Sequence[str], tier: str, position: str, cap: int) -> DataFrame:
    """At most `cap` hits of a section; authority hits and hits without a section always stay, but
    are counted."""
    counted = ranked(hits, [query, *section], [F.col(position)])
    free = (F.col(tier) == 0) | F.col(section[-1]).isNull()
    return counted.filter(free | (F.col("rank") <= cap)).drop("rank")


def reserved_merge(base: DataFrame, extra: DataFrame, query: str, key: str, position: str, limit: int) -> DataFrame:
    """First-wins merge: extra hits hold min(2, limit // 4) slots behind the base's prefix, and
    what is left goes to the rest of the base."""
    slots = min(2, limit // 4)
    has_extra = extra.select(query).distinct().withColumn("_has", F.lit(True))
    first = ranked(base, [query], [F.col(position), F.col(key)], "_r").join(has_extra, query, "left")
    prefix = F.when(F.col("_has"), limit - slots).otherwise(limit)
    own = first.select(query, key, F.when(F.col("_r") <= prefix, F.col("_r")).otherwise(F.col("_r") + limit).alias("_o"), F.lit(0).alias("_l"))
    more = top_k(extra.join(own.filter(F.col("_o") <= limit - slots), [query, key], "left_anti"), [query], [F.col(position), F.col(key)], slots, "_r")
    more = more.select(query, key, (F.col("_r") + (limit - slots)).alias("_o"), F.lit(1).alias("_l"))
    once = ranked(own.unionByName(more), [query, key], [F.col("_o"), F.col("_l")], "_n").filter("_n = 1")
    return top_k(once, [query], [F.col("_o"), F.col("_l"), F.col(key)], limit, "slot").select(query, key, "slot")


def empty_fallback(first: DataFrame, second: DataFrame, query: str) -> DataFrame:
    """The second result for those queries that the first leaves empty."""
    return first.unionByName(second.join(first.select(query).distinct(), query, "left_anti"))


def interleaved(base: DataFrame, promoted: DataFrame, query: str, key: str, position: str, protected: int, limit: int) -> DataFrame:
    """Promoted hits that the base lacks go behind its protected prefix; at most two."""
    new = top_k(promoted.join(base.select(query, key), [query, key], "left_anti"), [query], [F.col(position), F.col(key)], 2, "_r")
    own = ranked(base, [query], [F.col(position), F.col(key)], "_r")
    own = own.select(query, key, F.when(F.col("_r") <= protected, F.col("_r") * 10).otherwise(F.col("_r") * 10 + 100).alias("_o"))
    both = own.unionByName(new.select(query, key, (F.lit(protected * 10) + F.col("_r")).alias("_o")))
    return top_k(both, [query], [F.col("_o"), F.col(key)], limit, "slot").select(query, key, "slot")


def appended(base: DataFrame, reached: DataFrame, most: int) -> DataFrame:
    """The base (query, hit, place) and behind it at most `most` reached hits (query, hit, score) that it lacks,
    by score."""
    new = top_k(reached.join(base.select("query", "hit"), ["query", "hit"], "left_anti"), ["query"], [F.desc("score"), F.col("hit")], most, "_r")
    last = base.groupBy("query").agg(F.max("place").alias("_last"))
    more = new.join(last, "query", "left").select("query", "hit", (F.coalesce("_last", F.lit(0)) + F.col("_r")).alias("place"))
    return base.select("query", "hit", "place").unionByName(more)
