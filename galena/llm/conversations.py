"""Chat formatting: cumulative snapshots collapse before conversations are rendered.

A log often keeps a conversation once after every turn. Each turn extends a rolling digest of
the turns before it; a conversation whose last digest is an inner digest of another one is a
prefix of it. Anti-joins leave the conversations that no other extends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _turn_digest(role: Column, text: Column) -> Column:
    """Digest of a turn; the role's length in front keeps role and text apart."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    return F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)


def prefix_digests(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turns, chain): rolling digests of a conversation's first one, two, ... turns.

    Turns are ordered by turn, then by their digest. Texts are digested before they meet, so a
    conversation gathers 64 characters a turn.
    """
    digests = turns.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), _turn_digest(F.col(role_col), F.col(text_col)).alias("d"))
    ordered = digests.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("turn", "d"))).alias("ds"))
    chain = F.aggregate("ds", F.array().cast("array<string>"), lambda acc, x: F.concat(acc, F.array(F.sha2(F.concat(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")), x["d"]), 256))))
    return ordered.select("conv", F.size("ds").alias("turns"), chain.alias("chain"))


def maximal(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turns): conversations that are no proper prefix of another one; of equal ones the
    least id stays."""
    chains = prefix_digests(turns, conv_col, turn_col, role_col, text_col)
    last = chains.select("conv", "turns", F.element_at("chain", -1).alias("digest"))
    inner = chains.filter("turns > 1").select(F.explode(F.slice("chain", F.lit(1), F.col("turns") - 1)).alias("digest")).distinct()
    equal = last.groupBy("digest").agg(F.min("conv").alias("conv"), F.first("turns").alias("turns"))
    return equal.join(inner, "digest", "left_anti").select("conv", "turns")


def formatted(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Render the maximal conversations: conv_col, n_turns, rendered.

    A turn is rendered as ``<|role|>`` and a line break, its text and a line break; the turns
    follow one another in order of turn. Turns that share a number are ordered by digest. Null
    roles and texts count as empty, null turns come first, rows without a conversation are left
    out, a repeated turn row is a turn of its own. An empty table gives an empty table; other
    columns are not read.
    """
    kept = maximal(turns, conv_col, turn_col, role_col, text_col)
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv"), F.struct(F.col(turn_col).alias("turn"), _turn_digest(F.col(role_col), F.col(text_col)).alias("d"), F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n")).alias("r")).alias("t"))
    parts = rows.join(kept, "conv").groupBy("conv").agg(F.array_sort(F.collect_list("t")).alias("ts"), F.first("turns").alias("n"))
    return parts.select(F.col("conv").alias(conv_col), F.col("n").cast("long").alias("n_turns"), F.array_join(F.transform("ts", lambda t: t["r"]), "").alias("rendered"))


#: DuckDB. Turns in the tables have numbers that are unique in a conversation.
FORMATTED_SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
so_far AS (
  SELECT conv_id, turn,
    string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '' ORDER BY turn)
      OVER (PARTITION BY conv_id ORDER BY turn) AS prefix,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS from_end
  FROM turns),
last AS (SELECT prefix, min(conv_id) AS conv_id FROM so_far WHERE from_end = 1 GROUP BY prefix),
kept AS (
  SELECT conv_id FROM last
  WHERE NOT EXISTS (SELECT 1 FROM so_far s WHERE s.from_end > 1 AND s.prefix = last.prefix))
SELECT conv_id, count(*) AS n_turns,
  string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY turn) AS rendered
FROM turns JOIN kept USING (conv_id) GROUP BY conv_id
"""
