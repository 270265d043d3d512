"""Sources and sinks: Parquet tables, key lookups, keyset pages, upserts and partition rewrites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Rows of a scan below this size are dealt to all cores before work that is done row by row.
SPREAD_BYTES = 1 << 28


def spread(rows: DataFrame) -> DataFrame:
    """The rows, dealt evenly if there are few bytes: a small table is often one row group, which one
    task would read and work on alone. Large tables have row groups enough and do not move."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism) if size < SPREAD_BYTES else rows


#: Bytes of a stored table that one task gets where its rows are dealt by a key.
PART_BYTES = 1 << 24


def parts_for(rows: DataFrame, times: int = 1) -> int:
    """Into how many tasks a table's rows are dealt by a key, so that a task's share does not grow with the table; `times` says
    how much larger than the table the work on it is. At least one for each core."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-size * times // PART_BYTES))


def key_lookup(keys: DataFrame, rows: DataFrame, on: Sequence[str], ordinal: str) -> DataFrame:
    """Rows of the keys, each with its key's ordinal: the order of the request, whatever the join does."""
    return keys.select(*on, ordinal).join(rows, list(on))


def keyset_page(rows: DataFrame, after: dict[str, object], limit: int) -> DataFrame:
    """The next `limit` rows behind a watermark, ordered by its columns."""
    order = list(after)
    mark = F.struct(*[F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in after.items()])
    return rows.filter(F.struct(*order) > mark).orderBy(*order).limit(limit)


def generation_scan(rows: DataFrame, wanted: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The rows of the wanted (document, generation), each with its ordinal within its generation."""
    met = rows.join(wanted.select("document", "generation").distinct(), ["document", "generation"], "left_semi")
    return met.withColumn("ordinal", F.row_number().over(Window.partitionBy("document", "generation").orderBy(*order)))


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in the order (upsert: the latest wins)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def upsert(stored: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The table after new rows have replaced stored ones with their key."""
    newest = latest(new, keys, order)
    return stored.join(newest.select(*keys), list(keys), "left_anti").unionByName(newest)


def insert_ignore(stored: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The rows to append: the first of each key that is not stored."""
    return latest(new.join(stored.select(*keys).distinct(), list(keys), "left_anti"), keys, order)


def clone_generation(rows: DataFrame, column: str, source: int, target: int) -> DataFrame:
    """The table with a copy of one generation under another number."""
    return rows.unionByName(rows.filter(F.col(column) == source).withColumn(column, F.lit(target).cast(rows.schema[column].dataType)))


def without(rows: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The table without the rows of some keys (null keys match)."""
    condition = F.lit(True)
    for k in keys:
        condition = condition & rows[k].eqNullSafe(gone[k])
    return rows.join(gone, condition, "left_anti")


def write_partitioned(rows: DataFrame, path: str, by: Sequence[str]) -> None:
    """Overwrite only the partitions that the rows are in."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_partitioned(rows: DataFrame, path: str, by: Sequence[str]) -> None:
    """Append rows to a log; earlier rows are never rewritten."""
    rows.write.mode("append").partitionBy(*by).parquet(path)


def verified_count(rows: DataFrame, expected: int) -> DataFrame:
    """The rows, or an error at run time if their number differs."""
    found = rows.agg(F.count("*").alias("n"))
    return found.select(F.when(F.col("n") == expected, F.col("n")).otherwise(F.raise_error(F.lit("row count differs"))).alias("n"))
