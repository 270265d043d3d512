"""Lexicons and catalogs from files: concept surfaces, domain anchors and heading rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SURFACES = "concept string, language string, phrase string"
ANCHORS = "domain string, phrase string, is_name boolean"


def _loaded(spark: SparkSession, path: str, schema: str, needed: list[str]) -> DataFrame:
    """Rows of JSON lines; a line without one of the needed fields is an error, a repeated row counts once."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    whole = F.lit(True)
    for c in needed:
        whole = whole & F.coalesce(F.trim(c) != "", F.lit(False))
    checked = rows.select(*[F.when(whole, F.col(c)).otherwise(F.raise_error(F.lit(f"a line of {path} lacks a field"))).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
    return checked.distinct()


def surfaces(spark: SparkSession, path: str) -> DataFrame:
    """Concepts with the phrases that name them in a language."""
    return _loaded(spark, path, SURFACES, ["concept", "language", "phrase"])


def anchors(spark: SparkSession, path: str) -> DataFrame:
    """Domains with the phrases that point to them; is_name marks the domain's own name."""
    return _loaded(spark, path, ANCHORS, ["domain", "phrase"]).withColumn("is_name", F.coalesce("is_name", F.lit(False)))
