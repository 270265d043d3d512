"""What the operators share: table access, the learning fold, tables in the shared folder."""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galena.sources import batches
from galena.sources.batches import bounded_batches as small_batches
from galena.sources.shared import shared_path

#: Rows whose crc32(id as text) leaves this remainder modulo FOLDS are never learned from.
FOLDS, HELD_OUT = 4, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for rows kept from learning; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts its lineage.

    The copy survives lost executors. Shuffle files of what led to it are of no more use; the
    driver's garbage is collected so that Spark removes them now and not at some later time.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.galena_path = path
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return out


def discard(*tables: DataFrame) -> None:
    """Remove the files of stored tables that no unfinished DataFrame reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.galena_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_LIBC = ctypes.CDLL(None)


def released() -> None:
    """Give back memory at the start of a task: a worker is one process for many tasks, and what the
    models and caches of earlier ones took would stay with it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def slices(texts: Iterator[pa.RecordBatch], at: int, size: int = batches.CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that column `at` holds about `size` bytes, in a task that has given back memory before."""
    released()
    return batches.slices(texts, at, size)


def joined_sha256(df: DataFrame, key: str, order: list[str], separator: str) -> DataFrame:
    """(key, n, flagged, sha256): for each key the SHA-256, in lowercase hex, of its strings `piece` in order
    with a separator between them, how many there are, and for how many the column `flag` is true.

    The pieces of a key are sorted into one task, which digests them as they stream by: however many there
    are, it holds one batch. A null key is a key; pieces must not be null, a null flag is not true."""
    comma = separator.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, n, flagged = None, None, 0, 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([key, pa.array([n], pa.int64()), pa.array([flagged], pa.int64()), pa.array([digest.hexdigest()])], names=["key", "n", "flagged", "sha256"])

        for batch in batches:
            keys, pieces, flags = batch.column(0), batch.column(1), pc.fill_null(batch.column(2), False)
            rows = batch.num_rows
            if not rows:
                continue
            before = keys.slice(0, 1) if digest is None else key
            last = pa.concat_arrays([before, keys.slice(0, rows - 1)])
            new = pc.or_(pc.fill_null(pc.not_equal(keys, last), False), pc.xor(pc.is_null(keys), pc.is_null(last))).to_numpy(zero_copy_only=False)
            cuts = [0, *(c for c in np.flatnonzero(new).tolist() if c), rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if digest is None or new[a]:
                    if digest is not None:
                        yield done()
                    key, digest, n, flagged = keys.slice(a, 1), hashlib.sha256(), 0, 0
                text = comma.join(pieces.slice(a, b - a).cast(pa.binary()).to_pylist())
                digest.update(comma + text if n else text)
                n += b - a
                flagged += pc.sum(flags.slice(a, b - a)).as_py()
        if digest is not None:
            yield done()

    flag = F.col("flag") if "flag" in df.columns else F.lit(False)
    kind = df.schema[key].dataType.simpleString()
    small_batches(df.sparkSession)
    dealt = df.select(F.col(key).alias("key"), "piece", flag.alias("flag"), *order).repartition("key").sortWithinPartitions("key", *order)
    return dealt.select("key", "piece", "flag").mapInArrow(run, f"key {kind}, n long, flagged long, sha256 string").withColumnRenamed("key", key)
