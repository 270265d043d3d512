"""What the classifiers share: the labelled sample, and batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.llm.common import held_out, slices, small_batches, stored

#: At most so many labelled rows are learned from; they are those of least hash.
SAMPLE_ROWS = 20_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, bound: int = SAMPLE_ROWS) -> DataFrame:
    """(text, y, lot) of at most `bound` labelled documents outside the held-out fold.

    y is 0 or 1, lot 0 to 999 by a hash of the id. Null ids and labels are left out; of several
    labels of an id the greatest counts. The chosen ids are broadcast, as `bound` limits them.
    """
    chosen = labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(id_col)))
    chosen = chosen.groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label) > 0).cast("int")).alias("y"))
    chosen = chosen.withColumn("mark", F.xxhash64("id")).orderBy("mark", "id").limit(bound)
    texts = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    return stored(texts.join(F.broadcast(chosen), "id").select("text", "y", F.pmod("mark", F.lit(1000)).cast("int").alias("lot")), "sample")


def scored(df: DataFrame, id_col: str, text_col: str, score, fields: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row's id and `keep` beside what score(list of texts) returns: a list of arrays, one for
    each of the fields. Nulls count as empty texts; rows are independent."""
    kept = (id_col, *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            made = score([x or "" for x in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *map(pa.array, made)], names=[*codes, *names])

    small_batches(df.sparkSession)
    names = [f.split()[0] for f in fields.split(", ")]
    codes = [f"k{i}" for i in range(len(kept))]
    source = df.select(df[text_col].cast("string").alias("t"), *[df[c].alias(k) for c, k in zip(kept, codes, strict=True)])
    schema = [f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[1:]]
    return source.mapInArrow(run, ", ".join([*schema, fields])).withColumnsRenamed(dict(zip(codes, kept, strict=True)))
