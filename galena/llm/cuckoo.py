"""Exact duplicates by a cuckoo-filter index that digests are inserted into and deleted from.

The digests of texts are dealt to shards by hash. A shard has a cuckoo filter, buckets of SLOTS fingers
of 16 bits each, and its keys lie in a log of stored tables: how often each digest and id came and went.
A digest that the filter doesn't hold is new for certain. One that it seems to hold is looked up among the
stored keys of its shard. A digest leaves the filter with its last live row. Where fingers find no
place, the filter is built again from the stored keys with twice the buckets.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from galena.llm.common import stored
from galena.llm.rolling import mixed

#: Fingers of a bucket, share of them that a new filter fills, moves after which it counts as full.
SLOTS, LOAD, MOVES = 4, 0.85, 200
#: Keys of a shard when an index is made; shards for each shuffle partition at least.
KEYS, SPREAD = 65_536, 8
#: White space that texts may differ in.
SPACE = r"[\x20\x09-\x0D]+"


class Cuckoo:
    """A filter of 2**bits buckets. Digests are rows of 32 bytes."""

    def __init__(self, bits: int, slots: bytes | None = None):
        self.bits = bits
        self.table = np.zeros((1 << bits, SLOTS), np.uint16) if slots is None else np.frombuffer(slots, np.uint16).reshape(-1, SLOTS).copy()

    @staticmethod
    def bits_for(keys: int) -> int:
        return max(0, int(np.ceil(np.log2(max(keys, 1) / (SLOTS * LOAD)))))

    def places(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingers (never 0, which marks a free slot) and first buckets."""
        words = digests.view("<u8").reshape(-1, 4)
        fingers = np.maximum(words[:, 1] & np.uint64(0xFFFF), np.uint64(1)).astype(np.uint16)
        return fingers, (words[:, 2] & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def other(self, fingers: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        """The other bucket of a finger; that of the other one is the first again."""
        return buckets ^ (mixed(fingers.astype(np.uint64)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def holds(self, digests: np.ndarray) -> np.ndarray:
        fingers, first = self.places(digests)
        second = self.other(fingers, first)
        return (self.table[first] == fingers[:, None]).any(axis=1) | (self.table[second] == fingers[:, None]).any(axis=1)

    def insert(self, digests: np.ndarray) -> bool:
        """False if some finger found no place: then the table has lost one and must be built again."""
        fingers, at = self.places(digests)
        rng = np.random.default_rng(len(digests))
        for move in range(MOVES):
            if not len(fingers):
                return True
            order = np.argsort(at, kind="stable")
            fingers, at = fingers[order], at[order]
            first = np.searchsorted(at, at)
            rank = np.arange(len(at)) - first
            free = self.table[at] == 0
            room = free.sum(axis=1)
            put = rank < room
            slot = np.argsort(~free, axis=1, kind="stable")
            self.table[at[put], slot[put, np.minimum(rank[put], SLOTS - 1)]] = fingers[put]
            if move:  # both buckets are full: the first one in line takes the place of a finger
                moved = np.flatnonzero(rank == room)
                out = rng.integers(0, SLOTS, len(moved))
                taken = self.table[at[moved], out].copy()
                self.table[at[moved], out] = fingers[moved]
                fingers[moved] = taken
            fingers, at = fingers[~put], at[~put]
            at = self.other(fingers, at)
        return not len(fingers)

    def delete(self, digests: np.ndarray) -> None:
        """Takes one finger away for each digest, which must have been inserted."""
        fingers, first = self.places(digests)
        second = self.other(fingers, first)
        while len(fingers):
            # One digest at a time of those that share finger and buckets.
            _, chosen = np.unique(np.stack([fingers, np.minimum(first, second), np.maximum(first, second)]), axis=1, return_index=True)
            now = chosen
            for bucket in (first, second):
                same = self.table[bucket[now]] == fingers[now, None]
                found = same.any(axis=1)
                self.table[bucket[now[found]], same[found].argmax(axis=1)] = 0
                now = now[~found]
            rest = np.ones(len(fingers), bool)
            rest[chosen] = False
            fingers, first, second = fingers[rest], first[rest], second[rest]

    @classmethod
    def built(cls, digests: np.ndarray, bits: int = 0) -> Cuckoo:
        """Of digests that differ, doubled until all have a place."""
        bits = max(bits, cls.bits_for(len(digests)))
        while not (made := cls(bits)).insert(digests):
            bits += 1
        return made


def _digests(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table["digest"].to_pylist()), np.uint8).reshape(-1, 32)


@dataclass(frozen=True)
class Index:
    """filters: (shard, bits, slots). log: tables (shard, digest, id, row, n), of which n sums up to the
    live rows of an id. The stored tables are never changed: insert and delete return another index."""

    spark: SparkSession
    shards: int
    filters: DataFrame | None = None
    log: list[DataFrame] = field(default_factory=list)

    def sharded(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(self.shards)).cast("int"))

    def keys(self) -> DataFrame:
        """(shard, digest, id, row, n) of all live ids; row tells rows of one id apart."""
        out = self.log[0]
        for more in self.log[1:]:
            out = out.unionByName(more)
        return out.groupBy("shard", "digest", "id", "row").agg(F.sum("n").alias("n")).filter("n > 0")

    def classes(self) -> DataFrame:
        """(digest, first, n): the row that stays of each live digest, and how many are live."""
        return self.keys().groupBy("shard", "digest").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"), F.sum("n").alias("n")).drop("shard")

    def probed(self, digests: DataFrame) -> DataFrame:
        """(shard, digest, seen) of distinct digests: false is certain, true is to be verified."""
        if self.filters is None:
            return digests.select("shard", "digest", F.lit(False).alias("seen"))

        def run(held: pa.Table, asked: pa.Table) -> pa.Table:
            seen = np.zeros(asked.num_rows, bool)
            if held.num_rows and asked.num_rows:
                seen = Cuckoo(held["bits"][0].as_py(), held["slots"][0].as_py()).holds(_digests(asked))
            return asked.select(["shard", "digest"]).append_column("seen", pa.array(seen))

        return self.filters.groupBy("shard").cogroup(digests.select("shard", "digest").groupBy("shard")).applyInArrow(run, "shard int, digest binary, seen boolean")

    def confirmed(self, probed: DataFrame) -> DataFrame:
        """(shard, digest): those that were seen and are among the stored keys."""
        hits = probed.filter("seen").select("shard", "digest")
        return hits.hint("merge").join(self.keys().select("shard", "digest"), ["shard", "digest"], "left_semi") if self.log else hits.limit(0)

    def _changed(self, digests: DataFrame, delete: bool) -> DataFrame:
        """Filters after the digests (shard, digest) came or went; slots is null where some found no place."""

        def run(held: pa.Table, changes: pa.Table) -> pa.Table:
            shard = (held if held.num_rows else changes)["shard"][0].as_py()
            some = _digests(changes)
            made = Cuckoo(held["bits"][0].as_py(), held["slots"][0].as_py()) if held.num_rows else Cuckoo(Cuckoo.bits_for(len(some)))
            fits = made.delete(some) is None if delete else made.insert(some)
            return pa.table({"shard": pa.array([shard], pa.int32()), "bits": pa.array([made.bits], pa.int32()), "slots": pa.array([made.table.tobytes() if fits else None], pa.binary())})

        held = self.filters if self.filters is not None else self.spark.createDataFrame([], "shard int, bits int, slots binary")
        return held.groupBy("shard").cogroup(digests.select("shard", "digest").groupBy("shard")).applyInArrow(run, "shard int, bits int, slots binary")

    def _resized(self, filters: DataFrame) -> DataFrame:
        """The filters, those without slots built from the stored keys with twice the buckets."""
        full = filters.filter("slots is null").select("shard", "bits")
        if full.isEmpty():
            return filters

        def run(table: pa.Table) -> pa.Table:
            made = Cuckoo.built(_digests(table), table["bits"][0].as_py() + 1)
            return pa.table({"shard": table["shard"].slice(0, 1).combine_chunks(), "bits": pa.array([made.bits], pa.int32()), "slots": pa.array([made.table.tobytes()], pa.binary())})

        keys = self.keys().select("shard", "digest").distinct().join(full, "shard")
        again = keys.groupBy("shard").applyInArrow(run, "shard int, bits int, slots binary")
        return stored(filters.filter("slots is not null").unionByName(again), "resized")

    def insert(self, rows: DataFrame) -> Index:
        """With the rows (digest, id, row): digests that are not live yet enter the filter."""
        rows = self.sharded(rows)
        probed = stored(self.probed(rows.select("shard", "digest").distinct()), "probed")
        known = stored(self.confirmed(probed), "known")
        wrong = probed.filter("seen").select("shard", "digest").hint("merge").join(known, ["shard", "digest"], "left_anti")
        fresh = probed.filter("not seen").select("shard", "digest").unionByName(wrong)
        entry = stored(rows.groupBy("shard", "digest", "id", "row").agg(F.count("*").alias("n")), "keys")
        after = replace(self, log=[*self.log, entry])
        return replace(after, filters=after._resized(stored(self._changed(fresh, False), "filters")))

    def delete(self, rows: DataFrame) -> Index:
        """Without the rows (digest, id, row). Rows that are not live are left out of account; digests of
        which no row is left leave the filter."""
        asked = self.sharded(rows).groupBy("shard", "digest", "id", "row").agg(F.count("*").alias("m"))
        if not self.log:
            return self
        same = [F.col(f"k.{c}").eqNullSafe(F.col(f"a.{c}")) for c in ("shard", "digest", "id", "row")]
        gone = self.keys().alias("k").hint("merge").join(asked.alias("a"), same).select("k.shard", "k.digest", "k.id", "k.row", (-F.least("n", "m")).alias("n"))
        gone = stored(gone, "gone")
        after = replace(self, log=[*self.log, gone])
        touched = gone.select("shard", "digest").distinct()
        dead = touched.hint("merge").join(after.keys().select("shard", "digest"), ["shard", "digest"], "left_anti")
        return replace(after, filters=stored(after._changed(dead, True), "filters"))


def empty(spark: SparkSession, rows: int) -> Index:
    """An index for about so many rows; it takes more, as its filters grow."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return Index(spark, max(SPREAD * partitions, -(-rows // KEYS)))


def digest(text: Column) -> Column:
    """SHA-256 of a text in UTF-8 whose white space is one space each; null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, " "), 256))


def duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", blocks: int = 2) -> DataFrame:
    """Group rows whose texts are equal but for the amount and kind of white space.

    Returns a row per row of df: id_col, keep_id (the least id of its group), group_size (its rows), kept
    and text_sha256. Exactly one row of a group is kept: of rows that share the least id one of them, and
    of a group that has only null ids one of those, with a null keep_id. Null texts count as empty.
    Other columns are not read; an empty table gives an empty table.

    The rows come into the index in `blocks`, so that all but the first are looked up among those before.
    Digests travel, texts do not.
    """
    spark = df.sparkSession
    rows = df.select(df[id_col].alias("id"), digest(df[text_col]).alias("digest")).withColumn("row", F.monotonically_increasing_id())
    rows = stored(rows, "digests")
    index = empty(spark, rows.count())
    for block in range(blocks):
        index = index.insert(rows.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).select("digest", "id", "row"))
    classes = stored(index.classes(), "classes")
    out = rows.hint("merge").join(classes, "digest")
    return out.select(F.col("id").alias(id_col), F.col("first.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("first.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


DUPLICATES_SQL = r"""
with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
select doc_id, min(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size,
    row_number() over (partition by text_sha256 order by doc_id nulls last) = 1 as kept, text_sha256
from t
"""
