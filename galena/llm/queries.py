"""The queries opN_<name>: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galena.llm import bpe, conversations, cuckoo, decontamination, fingerprints, langid, licenses, minhash, quality, repair, suffixes, timeparts, toxicity
from galena.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprinted(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.removed(table(spark, sf_dir, "documents"), passages=suffixes.PASSAGE)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passage_words")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.formatted(table(spark, sf_dir, "conversations"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("found")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuckoo.duplicates(table(spark, sf_dir, "documents"))


def click_moment(ts: Column, click_id: Column) -> Column:
    """Where a click lies: of 128 kinds by its id, 16 moved back by up to 25 years, 16 to the Monday before."""
    ts, k = ts.cast("timestamp_ntz"), F.crc32(click_id.cast("string")) % 128
    days = ((k + 6) * (k + 6) * (k + 6)).cast("int")
    monday = F.date_sub(ts.cast("date"), F.weekday(ts.cast("date"))).cast("timestamp_ntz")
    return F.when(k < 16, ts - F.make_dt_interval(days)).when(k > 111, monday).otherwise(ts)


def op12_time_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = table(spark, sf_dir, "clicks")
    known = F.col("arrived_at").cast("timestamp_ntz") < F.lit("2024-05-01 00:00:00").cast("timestamp_ntz")
    return timeparts.rewritten(clicks, click_moment(F.col("ts"), F.col("click_id")), ["arrived_at", "click_id"], known, "click_id", 1 + clicks.count() // 500)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digests(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_toxicity": op2_toxicity,
    "op3_fingerprints": op3_fingerprints,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_minhash": op6_minhash,
    "op7_conversations": op7_conversations,
    "op8_language": op8_language,
    "op9_licenses": op9_licenses,
    "op10_quality": op10_quality,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_time_partitions": op12_time_partitions,
    "op13_conversation_repair": op13_conversation_repair,
}
SQL: dict[str, str] = {"op7_conversations": conversations.FORMATTED_SQL, "op11_exact_dedup": cuckoo.DUPLICATES_SQL, "op13_conversation_repair": repair.DIGESTS_SQL}
