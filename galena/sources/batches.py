"""Bounds on what goes to Python workers at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Bytes of a batch that goes to a Python worker, and of texts that one works on at once.
BATCH_BYTES, CHUNK_BYTES = 8 << 20, 1 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by BATCH_BYTES, unless it bounds them lower: this changes the
    session's setting. Rows hold whole texts, and the task, its worker and the results hold a batch at once."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(name).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def slices(batches: Iterator[pa.RecordBatch], at: int, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that column `at` holds about `size` bytes; one value may hold more."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // size
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)
