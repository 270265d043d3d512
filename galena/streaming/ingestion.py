"""Ingestion of a stream of documents: each batch claims contents, and is published as a whole.

The tables of a batch go to folders of its number. Its generations are written last; what has none is not
read. A batch that runs again, as after a failure, sees only the batches before it and replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galena.operators import ingest
from galena.sources.embedders import Embedder


def parquet_stream(spark: SparkSession, folder: str, name: str, files: int | None = None) -> DataFrame:
    """A table, one file or a directory of part files, as a stream of at most so many files a batch."""
    place = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(place).schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(place)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def _there(spark: SparkSession, place: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of all published batches, with its number as `batch`."""
    done = spark.read.parquet(f"{folder}/generations").select("batch").distinct()
    return spark.read.parquet(f"{folder}/{name}").join(done, "batch", "left_semi")


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The generations of all published batches: of a document the newest is as its batch left it, the others
    are SUPERSEDED."""
    rows = spark.read.parquet(f"{folder}/generations")
    newest = F.max("generation").over(Window.partitionBy("document_id"))
    return rows.withColumn("generation_status", F.when(F.col("generation") < newest, "SUPERSEDED").otherwise(F.col("generation_status")))


def batch_writer(folder: str, embedder: Embedder, surfaces: DataFrame | None = None) -> Callable[[DataFrame, int], None]:
    """What a stream does with each batch of documents (document, title, language, domain, access_level, text).

    Contents that an earlier batch holds under the document are replays: they are claimed, but not stored again."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = None
        if _there(spark, f"{folder}/generations"):
            before = spark.read.parquet(f"{folder}/generations").filter(F.col("batch") < number)
            known = before.select("document_id", "generation", "fingerprint")
        def keep(name: str, rows: DataFrame) -> DataFrame:
            place = f"{folder}/{name}/batch={number}"
            rows.write.mode("overwrite").parquet(place)
            return spark.read.schema(rows.schema).parquet(place)

        ingest.ingested(batch, embedder, known, surfaces, keep)

    return write


def run(stream: DataFrame, folder: str, embedder: Embedder, surfaces: DataFrame | None = None) -> None:
    """Ingest all that is there, from where the folder's checkpoint stands."""
    writer = stream.writeStream.foreachBatch(batch_writer(folder, embedder, surfaces)).option("checkpointLocation", f"{folder}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
