"""Suffix-array dedup: order suffixes only as deep as the threshold, most significant digit first.

Suffixes are of bytes or of words, as the caller chooses. Two suffixes that agree on `depth`
symbols are in one group of a suffix array that is sorted to that depth. Four digits stand for the
depth, and each pass splits the groups of the pass before and drops suffixes that are alone:

1. the anchor: the least hash among all `anchor`-symbol strings inside the first `depth` symbols.
   Neighbouring suffixes mostly share it, so a run of suffixes travels as one row;
2. the run: all bytes that the run's suffixes see. Runs that are equal are whole repeats;
3. the bin: the bytes common to BIN neighbouring suffixes of a run, and the few beside them;
4. the suffix itself: of those few bytes the ones that are its own.

Anchors are told apart by a polynomial hash of 64 bits, runs and bins by that and by 64 bits of a
hash of another family over their bytes, and suffixes by their own bytes as well. Equal suffixes have
equal digits, so every repeat is found; strings that differ are taken for repeats only where both
hashes collide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.llm.common import discard, slices, small_batches, stored
from galena.llm.rolling import Rolling

#: Bytes of the strings whose repeats go (below 2**16), and their share that an anchor has;
#: words of a passage; suffixes of a bin.
DEPTH, ANCHOR, PASSAGE, BIN = 400, 0.32, 50, 16
#: Suffixes that are worked on at once; longer texts are taken in overlapping blocks.
BLOCK = 1 << 19
_PLACE = np.uint64((1 << 24) - 1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

Unit = str  # "bytes" or "words"
WIDTH = {"bytes": 1, "words": 8}


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text (what stands between white space) begin and end, in bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[np.frombuffer(data, np.uint8)]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def symbols(data: bytes, unit: Unit) -> np.ndarray:
    """A text as its bytes, or as the hashes of its words."""
    if unit == "bytes":
        return np.frombuffer(data, np.uint8)
    starts, ends = word_bounds(data)
    return Rolling(np.frombuffer(data, np.uint8)).of(starts, ends)


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values)
    padded = np.full(-(-n // width) * width, ~np.uint64(0))
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def runs(listed: np.ndarray, depth: int, anchor: int) -> Iterator[np.ndarray]:
    """Runs of suffixes with one anchor, a block at a time: columns anchor hash, run hash, first
    suffix, number of suffixes, distance from the first suffix to the anchor."""
    last = len(listed) - depth + 1
    width = listed.itemsize
    for at in range(0, max(last, 0), BLOCK):
        part = listed[at : at + min(BLOCK, last - at) + depth - 1]
        hashes = Rolling(part).windows(anchor)
        least = _sliding_least((hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64), depth - anchor + 1)
        place = (least & _PLACE).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
        many = np.diff(np.concatenate([first, [len(place)]]))
        spot = place[first]
        view, digest = part.tobytes(), xxhash.xxh3_64_intdigest
        bounds = zip((first * width).tolist(), ((first + many - 1 + depth) * width).tolist(), strict=True)
        whole = np.fromiter((digest(view[a:b]) for a, b in bounds), np.uint64, len(first))
        yield np.stack([hashes[spot].astype(np.int64), whole.astype(np.int64), first + at, many, spot - first])


def _documents(df: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...]) -> DataFrame:
    """id, body, mark and what is kept; id and mark name a text: rows that share both are equal."""
    more = [df[c].alias(f"k{i}") for i, c in enumerate(keep)]
    return df.select(df[id_col].alias("id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("body"), *more).withColumn("mark", F.xxhash64("body"))


def _runs_table(docs: DataFrame, depth: int, anchor: int, unit: Unit) -> DataFrame:
    """(id, mark, a, s, at): anchor and run hashes, and the run's place in one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            rows, found = [], []
            for i, body in enumerate(batch.column(2).cast(pa.binary())):
                for a, s, first, many, off in runs(symbols(body.as_py(), unit), depth, anchor):
                    rows.append(np.full(len(a), i))
                    found.append(np.stack([a, s, first << 32 | many << 16 | off]))
            if found:
                at, made = pa.array(np.concatenate(rows)), np.concatenate(found, axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *map(pa.array, made)], names=["id", "mark", "a", "s", "at"])

    # A word and the white space behind it have two bytes at least.
    source = docs.filter(F.octet_length("body") >= (depth if unit == "bytes" else 2 * depth - 1)).select("id", "mark", "body")
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, mark long, a long, s long, at long")


def bins(listed: np.ndarray, depth: int, a: np.ndarray, alone: np.ndarray, at: np.ndarray) -> tuple:
    """Of a text's runs the bins: anchor, hash, alone, place, low, high, left, right."""
    first, many, off = at >> 32, at >> 16 & 0xFFFF, at & 0xFFFF
    near, far = off - many + 1, off
    kinds = far // BIN - near // BIN + 1
    of = np.repeat(np.arange(len(a)), kinds)
    number = np.arange(len(of)) - np.repeat(np.cumsum(kinds) - kinds, kinds) + (near // BIN)[of]
    low, high = np.maximum(near[of] - number * BIN, 0), np.minimum(far[of] - number * BIN, BIN - 1)
    place = first[of] + far[of] - number * BIN
    width, view, digest = listed.itemsize, listed.tobytes(), xxhash.xxh3_64_intdigest
    ends = place + depth - BIN + 1
    bounds = list(zip((place * width).tolist(), (ends * width).tolist(), strict=True))
    key = np.fromiter((digest(view[p:e], n) for (p, e), n in zip(bounds, number.tolist(), strict=True)), np.uint64, len(of))
    left = [view[p - h : p] for (p, _), h in zip(bounds, (high * width).tolist(), strict=True)]
    right = [view[e : e + r] for (_, e), r in zip(bounds, ((BIN - 1 - low) * width).tolist(), strict=True)]
    return a[of], key.astype(np.int64), alone[of], place, low, high, left, right


def _bins_table(docs: DataFrame, open_runs: DataFrame, depth: int, unit: Unit) -> DataFrame:
    """Bins of the runs that share only their anchor. a and bin are hashes of the anchor and of the
    symbols that all the bin's suffixes share; left and right are those beside, of which the suffix
    that starts j before the shared ones has j and BIN - 1 - j. low and high are the least and
    greatest j, and place is the start of the suffix with j = 0."""
    kinds = [("a", pa.int64()), ("bin", pa.int64()), ("alone", pa.bool_()), ("place", pa.int32()), ("low", pa.int32()), ("high", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            rows, found, left, right = [], [], [], []
            for i, body in enumerate(batch.column(2).cast(pa.binary())):
                listed = batch.column(3)[i].values
                a, n, at = (listed.field(k).to_numpy(zero_copy_only=False) for k in ("a", "n", "at"))
                *made, before, behind = bins(symbols(body.as_py(), unit), depth, a, n == 1, at)
                rows.append(np.full(len(before), i))
                found.append(made)
                left += before
                right += behind
            if found:
                row = pa.array(np.concatenate(rows))
                columns = [pa.array(np.concatenate(c)).cast(k) for c, (_, k) in zip(zip(*found, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), *columns, pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["id", "mark", *(k for k, _ in kinds), "left", "right"])

    lists = open_runs.groupBy("id", "mark").agg(F.collect_list(F.struct("a", "n", "at")).alias("runs"))
    lists = lists.select(F.col("id").alias("i"), F.col("mark").alias("m"), "runs")
    # Rows that repeat an id and a text give bins twice, but none of their runs is alone.
    source = docs.join(lists, F.col("id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m"))).select("id", "mark", "body", "runs")
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, mark long, a long, bin long, alone boolean, place int, low int, high int, left binary, right binary")


def repeats(docs: DataFrame, depth: int, anchor: int, unit: Unit) -> DataFrame:
    """(id, mark, start, end): stretches, in symbols, of the texts `docs` (id, mark, body) that are
    covered by repeated strings of `depth` symbols. Every step is stored, and let go once it is used up."""
    all_runs = stored(_runs_table(docs, depth, anchor, unit), "runs")
    # First pass: anchors that are found once only are dropped. Sums by key are stored before they
    # are joined: only then can Spark split the rows of a very frequent key.
    anchors = stored(all_runs.groupBy("a").agg(F.count("*").alias("c")).filter("c > 1").select("a"), "anchors")
    met = stored(all_runs.join(anchors, "a", "left_semi"), "met")
    discard(all_runs, anchors)
    # Second: equal runs are whole repeats; where an anchor has several runs, their bins go on.
    distinct = met.groupBy("a", "s").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("id", "mark", "at")])
    distinct = stored(distinct, "distinct")
    first, many = F.shiftright("at", 32), F.shiftright("at", 16).bitwiseAND(0xFFFF)
    whole = met.join(distinct.filter("n > 1").select("a", "s"), ["a", "s"], "left_semi")
    whole = stored(whole.select("id", "mark", first.cast("int").alias("start"), (first + many + (depth - 1)).cast("int").alias("end")), "whole")
    discard(met)
    several = stored(distinct.groupBy("a").agg(F.count("*").alias("d")).filter("d > 1").select("a"), "several")
    open_runs = stored(distinct.join(several, "a", "left_semi").select("id", "mark", "a", "n", "at"), "open_runs")
    discard(distinct, several)
    # Third: equal bins are repeats of all their suffixes; where shared bytes have several bins, the suffixes go on.
    made = stored(_bins_table(docs, open_runs, depth, unit), "bins")
    discard(open_runs)
    by_bin = ["a", "bin", "low", "high", "left", "right"]
    kinds = stored(made.groupBy(*by_bin).agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("id", "mark", "place", "alone")]), "kinds")
    equal = made.filter("alone").join(kinds.filter("n > 1").select(*by_bin), by_bin, "left_semi")
    equal = stored(equal.select("id", "mark", (F.col("place") - F.col("high")).alias("start"), (F.col("place") - F.col("low") + depth).alias("end")), "equal")
    discard(made)
    # Fourth: the suffixes themselves, told apart by the bytes beside the shared ones.
    mixed_bins = stored(kinds.groupBy("a", "bin").agg(F.count("*").alias("d")).filter("d > 1").select("a", "bin"), "mixed")
    # Stored before they expand: else the sums below would stay where the join has put a bin.
    open_kinds = stored(kinds.join(mixed_bins, ["a", "bin"], "left_semi"), "open_kinds")
    discard(kinds, mixed_bins)
    single = open_kinds.withColumn("j", F.explode(F.sequence("low", "high")))
    before, behind = F.col("j") * WIDTH[unit], (BIN - 1 - F.col("j")) * WIDTH[unit]
    own = F.concat(F.substring("left", F.octet_length("left") - before + 1, before), F.substring("right", F.lit(1), behind))
    single = single.select("id", "mark", "a", "bin", "j", own.alias("own"), (F.col("alone") & (F.col("n") == 1)).alias("alone"), (F.col("place") - F.col("j")).alias("start"))
    twice = stored(single.groupBy("a", "bin", "j", "own").agg(F.count("*").alias("c")).filter("c > 1").select("a", "bin", "j", "own"), "twice")
    edges = single.filter("alone").join(twice, ["a", "bin", "j", "own"], "left_semi").select("id", "mark", "start", (F.col("start") + depth).alias("end"))
    edges = stored(edges, "edges")
    discard(open_kinds, twice)
    return whole.union(equal).union(edges)


def united(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of which the given ones are parts, by rising start."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    return starts[new], ends[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(ends) - 1]])]


def removed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, anchor: int | None = None, keep: tuple[str, ...] = (), unit: Unit = "bytes", passages: int | None = None) -> DataFrame:
    """Remove every byte inside a string of `depth` symbols that also starts anywhere else.

    Texts are taken as UTF-8, null as empty; matches never cross texts, and strings are judged on
    the input. Symbols are bytes or, with unit "words", what stands between white space; between
    removed words the white space goes as well. Returns id_col, n_bytes, n_removed, n_spans
    (maximal removed runs), kept (binary, the bytes left), spans (array of start and end, bytes)
    and the columns `keep`. With `passages`, there is also n_passage_words: how many words are in a
    string of so many words that also starts anywhere else. Rows that repeat an id and a text
    are repeats of one another. Other columns are not read; an empty table gives an empty table.
    """
    least = lambda size: max(1, round(size * ANCHOR))
    anchor = anchor or least(depth)
    if not BIN < depth < 1 << 16 or anchor > depth or (passages is not None and not BIN < passages < 1 << 16):
        raise ValueError(f"a depth must be within {BIN + 1} and 65535, and the anchor no longer than it")
    small_batches(df.sparkSession)
    docs = _documents(df, id_col, text_col, keep)
    more = [f"k{i}" for i in range(len(keep))]
    found = F.lit(None).cast("array<struct<start:int,end:int>>")
    pairs = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    rows = []
    if passages is not None:
        rows.append(repeats(docs, passages, least(passages), "words").select("id", "mark", F.lit(1).alias("kind"), pairs.alias("p")))
    rows.append(repeats(docs, depth, anchor, unit).select("id", "mark", F.lit(0).alias("kind"), pairs.alias("p")))
    listed = rows[0].union(rows[1]) if len(rows) > 1 else rows[0]
    by_text = listed.groupBy("id", "mark").agg(*[F.collect_set(F.when(F.col("kind") == k, F.col("p"))).alias(n) for k, n in enumerate(("spans", "passages"))])
    by_text = stored(by_text.select(F.col("id").alias("i"), F.col("mark").alias("m"), "spans", "passages"), "spans")
    joined = docs.join(by_text, F.col("id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m")), "left").select("id", "body", F.coalesce("spans", found).alias("spans"), F.coalesce("passages", found).alias("passages"), *more)

    def stretches(listed: pa.StructArray | None) -> tuple[np.ndarray, np.ndarray]:
        if listed is None:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return united(*(listed.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in slices(batches, 1):
            sizes, gone, kept, listed, words = [], [], [], [], []
            for body, spans, passage in zip(batch.column(1).cast(pa.binary()), batch.column(2), batch.column(3), strict=True):
                data = body.as_py()
                a, b = stretches(spans.values if spans.is_valid else None)
                if unit == "words" and len(a):
                    starts, ends = word_bounds(data)
                    a, b = starts[a], ends[b - 1]
                a, b = a.tolist(), b.tolist()
                left = b"".join(data[i:j] for i, j in zip([0, *b], [*a, len(data)], strict=True))
                sizes.append(len(data))
                gone.append(len(data) - len(left))
                kept.append(left)
                listed.append([{"start": i, "end": j} for i, j in zip(a, b, strict=True)])
                if passages is not None:
                    c, d = stretches(passage.values if passage.is_valid else None)
                    words.append(int((d - c).sum()))
            also = [pa.array(words, pa.int64())] if passages is not None else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(list(map(len, listed)), pa.int64()), pa.array(kept, pa.binary()), pa.array(listed, span), *also, *batch.columns[4:]], names=["id", "n_bytes", "n_removed", "n_spans", "kept", "spans", *["n_passage_words"] * len(also), *more])

    schema = [f"id {joined.schema['id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:int,end:int>>", *["n_passage_words long"] * (passages is not None), *[f"{k} {joined.schema[k].dataType.simpleString()}" for k in more]]
    return joined.mapInArrow(cut, ", ".join(schema)).withColumnsRenamed({"id": id_col, **dict(zip(more, keep, strict=True))})


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = PASSAGE, unit: Unit = "words") -> DataFrame:
    """All documents with all their columns; texts without their repeated passages. A code point that
    was cut apart becomes U+FFFD; a null text stays null."""
    rest = tuple(c for c in docs.columns if c != id_col and c != text_col)
    was = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.struct(F.col(text_col).isNull().alias("null"), *[F.col(c).alias(f"c{n}") for n, c in enumerate(rest)]).alias("rest"))
    out = removed(was, "i", "t", depth, keep=("rest",), unit=unit)
    text = F.when(~F.col("rest.null"), F.make_valid_utf8(F.col("kept").cast("string")))
    return out.select(F.col("i").alias(id_col), text.alias(text_col), *[F.col(f"rest.c{n}").alias(c) for n, c in enumerate(rest)]).select(*docs.columns)
