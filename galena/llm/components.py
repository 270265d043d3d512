"""Connected components of links, by alternating star contractions (union-find over tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.llm.common import stored


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v, least): the least of u and its neighbours. A sum by key, stored before it is
    joined, so that Spark can split the links of a node that has very many."""
    least = stored(edges.groupBy("u").agg(F.min("v").alias("w")), "least")
    return edges.join(least.hint("merge"), "u").select("u", "v", F.least("u", "w").alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _with_least(down)
    moved = near.select(F.col("v").alias("u"), F.col("least").alias("v")).union(near.select("u", F.col("least").alias("v")))
    return moved.filter("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())


def components(links: DataFrame) -> DataFrame:
    """Component of every linked node: (node, component), the component being its least node.

    links has the columns u and v of one orderable type; direction, repeats and self-links do
    not matter, rows with a null end are ignored. A node in no link is not returned; no links
    give an empty table. Each round is written to the shared folder, rounds grow as the
    logarithm of the links' longest path, and only two sums come to the driver.
    """
    edges = stored(links.filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = _mark(edges)
    while mark[0]:
        edges = stored(_small_star(_large_star(edges)), "stars")
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
