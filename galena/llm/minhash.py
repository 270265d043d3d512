"""MinHash near-duplicates: SuperMinHash signatures, banding, exact confirmation, components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galena.llm.common import released, small_batches, stored
from galena.llm.components import components
from galena.llm.rolling import Rolling, mixed

#: Words of a shingle; links have PART * intersection >= SHARE * union.
WORDS, PART, SHARE = 5, 100, 75
#: BANDS bands of ROWS slots: a pair at the threshold meets in none with odds of (1 - .75**5)**50, about one in a million.
BANDS, ROWS = 50, 5
SLOTS = BANDS * ROWS
#: A bit of each slot, in words, and how many may differ: pairs at the threshold differ in 31 of
#: 250, with a deviation of 5, so that more than 60 has odds of less than one in ten million.
BITS, DIFFERENT = tuple(f"b{i}" for i in range(-(-SLOTS // 64))), 60
#: Turns of confirming bands against one lead each; once bands hold so few members that are apart, pairs follow.
LEADS, FEW = 4, 4
#: Bands of more open members are confirmed in blocks of so many members.
LARGE, BLOCK = 64, 256
#: Bytes of text worked on at once: each shingle takes 2 * SLOTS bytes meanwhile.
CHUNK_BYTES = 1 << 17
_EMPTY = np.uint64((1 << 64) - 1)


def shingles(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of the texts, sorted within each text, and their bounds."""
    split = [t.lower().split() for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    data = np.frombuffer(b" ".join(w for ws in split for w in ws), np.uint8)
    bounds = np.zeros(len(texts) + 1, np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.uint64), bounds
    lengths = np.fromiter((len(w) for ws in split for w in ws), np.int64, total)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    first = np.cumsum(counts) - counts
    # The last word of the shingle that starts at each word; short texts have one shingle.
    many = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    of = np.repeat(np.arange(len(texts)), many)
    begin = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + first[of]
    last = begin + np.minimum(words, counts[of]) - 1
    hashes = Rolling(data).of(starts[begin], ends[last])
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    bounds[1:] = np.cumsum(np.bincount(of[new], minlength=len(texts)))
    return hashes[new], bounds


def signatures(hashes: np.ndarray, bounds: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash: in round j each element offers j plus a fraction to the j-th slot of its own
    permutation. Offers of later rounds are larger, so a set stops once its slots are filled."""
    sets = len(bounds) - 1
    out = np.full((sets, slots), _EMPTY, np.uint64)
    flat = out.reshape(-1)
    of = np.repeat(np.arange(sets), np.diff(bounds))
    live = hashes
    order = np.broadcast_to(np.arange(slots, dtype=np.uint16), (len(live), slots)).copy()
    for j in range(slots):
        if not len(live):
            break
        drawn = mixed(live + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        at = j + ((drawn & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
        rows = np.arange(len(live))
        slot = order[rows, at]
        order[rows, at] = order[:, j]
        np.minimum.at(flat, of * slots + slot, np.uint64(j << 56) | (drawn >> np.uint64(8)))
        open_sets = (out == _EMPTY).any(axis=1) if j < 3 or j % 4 == 3 else None
        if open_sets is not None and not open_sets[of].all():
            stay = open_sets[of]
            live, of, order = live[stay], of[stay], order[stay]
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A key for each band; different bands never share keys but by chance."""
    rows = signature.reshape(len(signature), bands, -1)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), rows.shape[:2]).copy()
    for r in range(rows.shape[2]):
        key = mixed(key ^ rows[:, :, r]) + np.uint64(r)
    return key


def low_bits(signature: np.ndarray) -> np.ndarray:
    """One bit of each slot, in words of 64."""
    width = -(-signature.shape[1] // 64) * 64
    bits = np.zeros((len(signature), width), np.uint8)
    bits[:, : signature.shape[1]] = signature & np.uint64(1)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of a batch in runs of about CHUNK_BYTES, with each run's first row."""
    run, first, size = [], 0, 0
    for i in range(batch.num_rows):
        run.append(batch.column(column)[i].as_buffer().to_pybytes() if batch.column(column)[i].is_valid else b"")
        size += len(run[-1])
        if size >= CHUNK_BYTES:
            yield first, run
            run, first, size = [], i + 1, 0
    if run:
        yield first, run


def sketch(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles (size of its set), set_id (a digest of the whole set), keys (of its
    bands), b0, b1, ... (a bit of each slot). A text without words, or null, has no shingles, and null set_id and keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        for batch in batches:
            for first, texts in _texts(batch, 1):
                hashes, bounds = shingles(texts)
                sizes = np.diff(bounds)
                signed = signatures(hashes, bounds)
                keys, bits = band_keys(signed).astype(np.int64), low_bits(signed).astype(np.int64)
                filled = sizes > 0
                digests = [hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(bounds, bounds[1:], strict=False)]
                ends = np.concatenate([[0], np.cumsum(filled * BANDS)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[filled].reshape(-1)), mask=pa.array(~filled))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists, *map(pa.array, bits.T)], names=["id", "n_shingles", "set_id", "keys", *BITS])

    source = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("t"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, n_shingles long, set_id binary, keys array<long>, " + ", ".join(f"{b} long" for b in BITS))


def _sets(df: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The whole shingle sets of the wanted ids, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        for batch in batches:
            for first, texts in _texts(batch, 1):
                hashes, bounds = shingles(texts)
                packed = [hashes[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(packed, pa.binary())], names=["id", "set"])

    source = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("t")).hint("merge").join(wanted, "id", "left_semi")
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, set binary")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) whose whole shingle sets are similar enough."""
    kind = sets.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        for batch in batches:
            good = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(y) else 0
                good.append(both > 0 and PART * both >= SHARE * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    left, right = sets.select(F.col("id").alias("u"), F.col("set").alias("a")), sets.select(F.col("id").alias("v"), F.col("set").alias("b"))
    return pairs.hint("merge").join(left, "u").hint("merge").join(right, "v").select("u", "v", "a", "b").mapInArrow(run, f"u {kind}, v {kind}")


def _confirmed_in_blocks(open_bands: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) between members of large bands that are in different groups.

    A band is cut into blocks by hash, and every two blocks meet in one task of bounded size. A
    member's set travels once for each block that it meets, not once for each pair, and only
    links come out."""
    kind = sets.schema["id"].dataType.simpleString()
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = open_bands.select("key", "id", "g", *BITS, blocks.alias("blocks")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int"))
    dealt = dealt.hint("merge").join(sets, "id")
    columns = ["id", "g", *BITS, "set"]
    left = dealt.select("key", F.col("own").alias("i"), F.explode(F.sequence(F.col("own"), F.col("blocks") - 1)).alias("j"), F.lit(0).alias("side"), *columns)
    right = dealt.select("key", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"), *columns)

    def run(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        ids, groups = table["id"].to_pylist(), table["g"].to_pylist()
        bits = np.stack([table[b].to_numpy() for b in BITS], axis=1).view(np.uint64)
        packed = [np.frombuffer(x, np.uint64) for x in table["set"].to_pylist()]
        sizes = np.array([len(x) for x in packed])
        diagonal = table["i"][0].as_py() == table["j"][0].as_py()
        b = np.flatnonzero(side == 1)
        u, v = [], []
        for x in np.flatnonzero(side == 0):
            likely = b[np.bitwise_count(bits[b] ^ bits[x]).sum(axis=1) <= DIFFERENT]
            likely = likely[PART * np.minimum(sizes[likely], sizes[x]) >= SHARE * np.maximum(sizes[likely], sizes[x])]
            likely = [y for y in likely.tolist() if groups[x] != groups[y] and (not diagonal or ids[x] < ids[y])]
            if not likely:
                continue
            every = np.concatenate([packed[y] for y in likely])
            at = np.minimum(np.searchsorted(packed[x], every), sizes[x] - 1)
            both = np.add.reduceat((packed[x][at] == every).astype(np.int64), np.concatenate([[0], np.cumsum(sizes[likely])[:-1]]))
            for y in np.array(likely)[PART * both >= SHARE * (sizes[x] + sizes[likely] - both)].tolist():
                u.append(ids[x])
                v.append(ids[y])
        kinds = table.schema.field("id").type
        return pa.table({"u": pa.array(u, kinds), "v": pa.array(v, kinds)})

    return left.union(right).groupBy("key", "i", "j").applyInArrow(run, f"u {kind}, v {kind}")


def _linked(classes: DataFrame, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Groups (node, component) of the classes (id, keys of bands).

    Each band has a lead: the member that meets most others in all its bands, as the original of
    a family of copies does. Members of other groups are confirmed against the lead, which then
    leaves the band; leads of the next turn come from other groups. Once a turn finds nothing,
    or bands hold few members, what is still apart is confirmed pair by pair, in large
    bands block by block. Pairs whose signatures differ too much are left out before they are made.
    """
    members = classes.select("id", F.explode("keys").alias("key"))
    # Sums by key are stored before they are joined: only then can Spark split a very frequent key.
    # Joins that grow with the corpus are planned as merge joins; Spark may broadcast a side whose
    # stored size it knows to be below its limit.
    shared = stored(members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    met = stored(members.hint("merge").join(shared, "key"), "bands")
    weight = met.groupBy("id").agg(F.sum("n").alias("w"))
    bits = stored(classes.join(weight, "id").select("id", "w", *BITS), "bits")
    sets = stored(_sets(df, bits.select("id"), id_col, text_col), "sets")
    kind = met.schema["id"].dataType
    band = met.join(bits, "id").select("key", "id", "w", *BITS, F.col("id").alias("g"), F.lit(None).cast(kind).alias("led"))
    links, groups, found_any = None, None, True

    def near(left: Column, right: Column) -> Column:
        return sum((F.bit_count(left[b].bitwiseXOR(right[b])) for b in BITS), F.lit(0)) <= DIFFERENT

    for turn in range(LEADS + 1):
        order = F.struct((~F.col("g").eqNullSafe(F.col("led"))).alias("new"), "w", "id", "g", F.struct(*BITS).alias("bits"))
        leads = band.groupBy("key").agg(F.min("g").alias("a"), F.max("g").alias("b"), F.max(order).alias("lead"), F.count("*").alias("n")).filter("a <> b")
        leads = stored(leads.select("key", "lead", "n"), "leads")
        open_bands = stored(band.join(leads, "key").withColumn("bits", F.struct(*BITS)), "open")
        size = open_bands.agg(F.count("*").alias("rows"), F.sum("n").alias("pairs")).first()
        if not size["rows"]:
            break
        last = turn == LEADS or not found_any or size["pairs"] <= FEW * size["rows"]
        if last:
            small = open_bands.filter(F.col("n") <= LARGE)
            other = small.select("key", F.col("id").alias("v"), F.col("g").alias("h"), F.col("bits").alias("other"))
            pairs = small.join(other, (small["key"] == other["key"]) & (F.col("id") < F.col("v")) & (F.col("g") != F.col("h")) & near(F.col("bits"), F.col("other"))).select(F.col("id").alias("u"), "v")
        else:
            apart = (F.col("id") != F.col("lead.id")) & (F.col("g") != F.col("lead.g")) & near(F.col("bits"), F.col("lead.bits"))
            pairs = open_bands.filter(apart).select(F.col("lead.id").alias("u"), F.col("id").alias("v"))
        found = confirmed(pairs.distinct(), sets)
        if last:
            found = found.union(_confirmed_in_blocks(open_bands.filter(F.col("n") > LARGE), sets))
        found = stored(found, "confirmed")
        found_any = not found.isEmpty()
        links = found if links is None else links.union(found)
        if found_any or groups is None:
            groups = stored(components(links), "groups")
        if last:
            break
        now = groups.select(F.col("node").alias("id"), "component")
        rest = open_bands.filter("id <> lead.id").select("key", "id", "w", *BITS, F.col("lead.id").alias("lead")).join(now, "id", "left")
        led = now.select(F.col("id").alias("lead"), F.col("component").alias("lead_now"))
        band = rest.join(led, "lead", "left").select("key", "id", "w", *BITS, F.coalesce("component", "id").alias("g"), F.coalesce("lead_now", "lead").alias("led"))
    if groups is None:
        groups = classes.sparkSession.createDataFrame([], f"node {dict(classes.dtypes)['id']}, component {dict(classes.dtypes)['id']}")
    return groups


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group documents whose word-shingle sets are similar enough, directly or through others.

    Returns a row per row of df: id_col, n_shingles, component_id (the least id of its group)
    and kept (true for that least id). Texts that are null or have no words are linked with
    nothing. Ids should be unique: rows that share one are linked by their texts alone. A row with
    a null id has a null component_id and is kept. Other columns of df are not read; an empty table gives an empty table.

    Rows with equal sets are one class. Classes meet in bands, where _linked() confirms links
    until no unconfirmed one could join two groups; a band of copies is not expanded into pairs.
    """
    small_batches(df.sparkSession)
    sketched = stored(sketch(df, id_col, text_col), "sketch")
    nodes = sketched.filter("id is not null and set_id is not null")
    classes = nodes.groupBy("set_id").agg(F.min(F.struct("id", "keys", *BITS)).alias("c")).select("set_id", "c.*")
    groups = _linked(classes, df, id_col, text_col)
    by_class = classes.select("set_id", "id").join(groups.withColumnRenamed("node", "id"), "id", "left")
    by_set = stored(by_class.select("set_id", F.coalesce("component", "id").alias("component_id")), "by_set")
    out = sketched.select("id", "n_shingles", "set_id").hint("merge").join(by_set, "set_id", "left")
    out = out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, of which one stays for each group.

    Of rows that repeat an id (null included) and a text exactly one stays. Rows that share an id but not their text
    are documents of their own: each stays if its group keeps that id."""
    stay = near_duplicates(docs, id_col, text_col).filter("kept").select(F.col(id_col).alias("galena_kept_id")).distinct()
    kept = docs.join(stay, docs[id_col].eqNullSafe(stay["galena_kept_id"]), "left_semi")
    # Only rows that do repeat are gathered by id and text; copies meet in the tasks that read them first.
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    marked = kept.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("mark"))
    again = stored(marked.groupBy("id", "mark").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("id").alias("galena_kept_id"), F.col("mark").alias("galena_kept_mark")), "again")
    if again.isEmpty():
        return kept
    same = kept[id_col].eqNullSafe(again["galena_kept_id"]) & (F.xxhash64(text) == again["galena_kept_mark"])
    return kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates([id_col, text_col]))
