"""Streams over a table of many part files, and over none."""

import pytest
from pyspark.sql import functions as F

from galena.operators import ingest
from galena.queries import flows
from galena.sources.embedders import HashingEmbedder
from galena.streaming import ingestion


def test_streams_read_a_directory_of_part_files(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").repartition(20).write.parquet(f"{tmp_path}/events.parquet")
    for query in (flows.stream_window_counts, flows.stream_sessions, flows.stream_dedupe):
        rows = sorted(query(spark, sf).collect())
        assert rows and sorted(query(spark, str(tmp_path)).collect()) == rows


def test_a_stream_without_files_is_an_error(spark, tmp_path):
    (tmp_path / "events.parquet").mkdir()
    with pytest.raises(FileNotFoundError):
        flows.stream_dedupe(spark, str(tmp_path))


COLUMNS = "document string, title string, language string, domain string, access_level long, text string"


def document(name, text):
    return (name, "T", "en", "GENERAL", 1, text)


class Failing(HashingEmbedder):
    """Fails on one text while a file is there."""

    def __init__(self, flag):
        super().__init__(8)
        self.flag = str(flag)

    def embed(self, texts):
        import os

        if os.path.exists(self.flag) and any("broken" in t for t in texts):
            raise RuntimeError("no embedding")
        return super().embed(texts)


def test_a_stream_of_documents_restarts_and_equals_the_batches(spark, tmp_path):
    source, folder, flag = tmp_path / "docs", f"file://{tmp_path}/out", tmp_path / "flag"
    batches = [[document("a", "one"), document("a", "one"), document("b", "x y")], [document("a", "two"), document("b", "x y"), document("c", "broken text")], [document("a", "one"), document("c", "later"), document("d", None)]]

    def arrive(k):
        spark.createDataFrame(batches[k], COLUMNS).coalesce(1).write.mode("append").parquet(f"file://{source}")

    stream = lambda: spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(f"file://{source}")
    arrive(0)
    ingestion.run(stream(), folder, Failing(flag))
    arrive(1)
    flag.write_text("")
    with pytest.raises(Exception, match="no embedding"):
        ingestion.run(stream(), folder, Failing(flag))
    seen = lambda: sorted((r["document"], r["generation"], r["text"]) for r in ingestion.read(spark, folder, "chunks").collect())
    assert seen() == [("a", 1, "one"), ("b", 1, "x y")]  # what the failed batch wrote is not seen
    flag.unlink()
    ingestion.run(stream(), folder, Failing(flag))
    arrive(2)
    ingestion.run(stream(), folder, Failing(flag))
    ingestion.run(stream(), folder, Failing(flag))  # nothing new
    assert seen() == [("a", 1, "one"), ("a", 2, "two"), ("b", 1, "x y"), ("c", 1, "broken text"), ("c", 2, "later")]
    claims = sorted((r["batch"], r["document"], r["status"], r["requests"]) for r in ingestion.read(spark, folder, "claims").collect())
    assert claims == [(0, "a", "CURRENT", 2), (0, "b", "CURRENT", 1), (1, "a", "CURRENT", 1), (1, "b", "REPLAY", 1), (1, "c", "CURRENT", 1), (2, "a", "REPLAY", 1), (2, "c", "CURRENT", 1), (2, "d", "CURRENT", 1)]
    now = sorted((r["document_id"], r["generation"], r["generation_status"]) for r in ingestion.current(spark, folder).collect())
    assert now == [("a", 1, "SUPERSEDED"), ("a", 2, "PUBLISHED"), ("b", 1, "PUBLISHED"), ("c", 1, "SUPERSEDED"), ("c", 2, "PUBLISHED"), ("d", 1, "FAILED")]
    whole = spark.createDataFrame([(*r, k) for k, b in enumerate(batches) for r in b], COLUMNS + ", seq long")
    made = ingest.ingested(whole, HashingEmbedder(8))
    same = lambda df, *cs: sorted(map(str, df.select(*cs).collect()))
    assert same(made.generations, "document_id", "generation", "generation_status") == same(ingestion.current(spark, folder), "document_id", "generation", "generation_status")
    assert same(made.vectors.withColumn("v", F.hash("vector")), "vector_id", "v") == same(ingestion.read(spark, folder, "vectors").withColumn("v", F.hash("vector")), "vector_id", "v")
