"""Predicates that every read goes through: publication, access, validity in time, metadata."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses of metadata that are in force.
IN_FORCE = ("ACTIVE", "CURRENT", "EFFECTIVE")


def published(lifecycle: DataFrame, generations: DataFrame, as_of: Column) -> DataFrame:
    """Documents that may be read at a time: ready, retained, not expired, and with a published
    row for their published generation."""
    alive = lifecycle.filter((F.col("lifecycle_status") == "READY") & (F.col("retention_status") == "ACTIVE") & F.col("published_generation").isNotNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > as_of)))
    rows = generations.filter("generation_status = 'PUBLISHED'").select("document_id", F.col("generation").alias("published_generation"))
    return alive.join(rows, ["document_id", "published_generation"], "left_semi")


def access_levels(levels: Iterable[int]) -> list[int]:
    """The distinct levels in order; none, or one that is not positive, is an error."""
    found = sorted(set(levels))
    if not found or found[0] <= 0:
        raise ValueError("access levels must be positive, and there must be one")
    return found


def routed(rows: DataFrame, levels: Iterable[int], column: str = "access_level") -> DataFrame:
    """Rows of the access levels. The predicate reaches the scan and prunes partitions."""
    return rows.filter(F.col(column).isin(access_levels(levels)))


def scoped(rows: DataFrame, documents: DataFrame | None, column: str = "document_id") -> DataFrame:
    """Rows of some documents; without a scope, all."""
    return rows if documents is None else rows.join(documents.select(column).distinct(), column, "left_semi")


def in_language(rows: DataFrame, language: str | None, column: str = "language") -> DataFrame:
    return rows if language is None else rows.filter(F.col(column) == language)


def parsed_date(value: Column) -> Column:
    """A date, or the UTC date of an instant; else null."""
    return F.coalesce(F.try_to_date(value, "yyyy-MM-dd"), F.to_date(F.try_to_timestamp(value)))


def in_force(metadata: Column, as_of: Column) -> Column:
    """Whether metadata allows a row at a date: a status that is given must be in force, dates that
    are given must parse, the first is at most and the last at least the date."""

    def given(key: str) -> Column:
        return F.map_contains_key(metadata, key)

    def value(key: str) -> Column:
        return F.try_element_at(metadata, F.lit(key))

    status = ~given("status") | F.coalesce(F.upper(F.trim(value("status"))).isin(*IN_FORCE), F.lit(False))
    start = ~given("effectiveFrom") | F.coalesce(parsed_date(value("effectiveFrom")) <= as_of, F.lit(False))
    end = ~given("effectiveTo") | F.coalesce(parsed_date(value("effectiveTo")) >= as_of, F.lit(False))
    return status & start & end


def clean_metadata(metadata: Column) -> Column:
    """Without null values and without null or blank keys."""
    return F.map_filter(metadata, lambda k, v: v.isNotNull() & (F.trim(k) != ""))


def routable(access: Column, document: Column, generation: Column, chunk: Column) -> Column:
    """Whether a hit names a chunk that can be fetched."""
    return F.coalesce((access > 0) & (generation > 0) & (F.trim(document) != "") & (F.trim(chunk) != ""), F.lit(False))


def revalidated(hits: DataFrame, published: DataFrame, projected: DataFrame) -> DataFrame:
    """Hits (access_level, document_id, generation, chunk_id) right before their use: their generation must be
    the one published at their access level, and their chunk must still be projected (chunk_id)."""
    live = published.select("access_level", "document_id", F.col("published_generation").alias("generation"))
    return hits.join(live, ["access_level", "document_id", "generation"], "left_semi").join(projected.select("chunk_id"), "chunk_id", "left_semi")
