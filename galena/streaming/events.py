"""Event streams: windows, sessions, dedupe and idempotent ingestion under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galena.sources.shared import shared_path

SCHEMA = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def events(spark: SparkSession, folder: str, delay: str = "10 minutes") -> DataFrame:
    """The folder's events, one file or a directory of part files, as a stream with a watermark on
    their time. Without any file it is an error. Part files are in no order of time, so all that
    are there go into one batch: a later batch would lose rows behind the watermark."""
    place = f"{folder}/events.parquet"
    if not spark.read.schema(SCHEMA).parquet(place).inputFiles():
        raise FileNotFoundError(f"{place} holds no file")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    reader = spark.readStream.schema(SCHEMA)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        raw = reader.parquet(place)
    else:
        raw = reader.option("pathGlobFilter", "events.parquet").parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def window_counts(stream: DataFrame, size: str = "1 day", slide: str | None = None) -> DataFrame:
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return stream.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(stream: DataFrame, gap: str = "6 hours") -> DataFrame:
    return stream.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def first_seen(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Keys once, however often they arrive within the watermark."""
    return stream.dropDuplicatesWithinWatermark(keys).select(*keys)


def finished(spark: SparkSession, stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream over all that is there and read its result.

    Each batch goes to a folder of its own in the shared folder, named by its number, so that a
    batch that runs again replaces itself. In complete mode the last batch is the result."""
    path = shared_path(spark, name)
    done: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        done.append(number)

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    if not done:
        return spark.createDataFrame([], stream.schema)
    wanted = done[-1:] if mode == "complete" else sorted(set(done))
    return spark.read.schema(stream.schema).parquet(*[f"{path}/batch={n}" for n in wanted])
