"""Byte-level BPE encoding and decoding.

Pre-tokenisation needs no regular expression. Each code point gets a class; the classes are
generators of a small monoid of functions on the states of a splitting automaton. An
associative scan over blocks of the text yields the state before every code point, and state
and class together say whether a token piece starts there. The pieces are merged by rank
through a cache, and the byte offset of every token is retained.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.llm.common import slices, small_batches

#: Pieces that a worker remembers, longest such piece.
CACHE_PIECES, CACHE_PIECE_BYTES = 1 << 18, 256

# The code points of the White_Space property, and the suffixes that the public
# pattern splits off behind an apostrophe.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SUFFIX_1 = "sdmt"
SUFFIX_2 = ("ll", "ve", "re")

# Kinds of code points, then the classes that also hold what follows.
LETTER, NUMBER, OTHER, SPACE, BLANK = range(5)
C_LETTER, C_NUMBER, C_OTHER, C_SHORT, C_LONG, C_SPACE_LAST, C_BLANK_LAST, C_BLANK_MID = range(8)
CLASSES = 8
#: States: a piece has just ended; inside letters, numbers, others; behind a space that joins
#: what follows; inside white space; one and two letters of a suffix to come.
FRESH, IN_LETTER, IN_NUMBER, IN_OTHER, IN_PREFIX, IN_BLANK, ONE_LEFT, TWO_LEFT = range(8)
STATES = 8


def _step(state: int, kind: int) -> tuple[int, bool]:
    """The state behind a code point of this class, and whether a piece starts at it."""
    if state == TWO_LEFT:
        return ONE_LEFT, False
    if state == ONE_LEFT:
        return FRESH, False
    if kind == C_LETTER:
        return IN_LETTER, state not in (IN_LETTER, IN_PREFIX)
    if kind == C_NUMBER:
        return IN_NUMBER, state not in (IN_NUMBER, IN_PREFIX)
    if kind in (C_OTHER, C_SHORT, C_LONG):
        if state in (IN_OTHER, IN_PREFIX) or kind == C_OTHER:
            return IN_OTHER, state not in (IN_OTHER, IN_PREFIX)
        return (ONE_LEFT if kind == C_SHORT else TWO_LEFT), True
    if kind == C_SPACE_LAST:
        return IN_PREFIX, True
    if kind == C_BLANK_LAST:
        return FRESH, True
    return IN_BLANK, state != IN_BLANK


@lru_cache(maxsize=1)
def _automaton() -> dict[str, np.ndarray]:
    """Tables of the automaton: a class from CLASSES on is one at the start of a document."""
    delta = np.zeros((STATES, 2 * CLASSES), np.uint8)
    starts = np.zeros((STATES, 2 * CLASSES), bool)
    for kind in range(CLASSES):
        for state in range(STATES):
            delta[state, kind], starts[state, kind] = _step(state, kind)
            delta[state, kind + CLASSES], starts[state, kind + CLASSES] = _step(FRESH, kind)
    identity = tuple(range(STATES))
    ids, todo = {identity: 0}, [identity]
    for f in todo:  # grows while it is read: all functions that sequences of classes make
        for kind in range(2 * CLASSES):
            g = tuple(int(delta[s, kind]) for s in f)
            if g not in ids:
                ids[g] = len(ids)
                todo.append(g)
    maps = np.array(todo, np.uint8)
    key = {f: i for f, i in ids.items()}
    by_class = np.array([[key[tuple(int(delta[s, k]) for s in f)] for k in range(2 * CLASSES)] for f in todo], np.int32)
    both = np.array([[key[tuple(int(g[s]) for s in f)] for g in maps] for f in maps], np.int32)
    return {"delta": delta.ravel(), "starts": starts.ravel(), "maps": maps, "by_class": by_class.ravel(), "both": both}


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """The kind of every code point."""
    major = {"L": LETTER, "N": NUMBER}
    kinds = np.fromiter((major.get(unicodedata.category(chr(i))[0], OTHER) for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    kinds[WHITE_SPACE] = BLANK
    kinds[0x20] = SPACE
    return kinds


def _classes(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Classes of the code points of some documents; first: index of each document's first."""
    kinds = _kinds()[points]
    n = len(points)
    blank = kinds >= SPACE
    opens = np.zeros(n + 1, bool)  # a document starts here, or all end
    opens[first] = True
    opens[n] = True
    followed = np.zeros(n, bool)
    followed[:-1] = ~blank[1:]
    followed &= ~opens[1:]
    out = kinds.copy()
    out[blank] = np.where(followed[blank], np.where(kinds[blank] == SPACE, C_SPACE_LAST, C_BLANK_LAST), C_BLANK_MID)
    at = np.flatnonzero(points == ord("'"))
    at = at[at + 1 < n]
    at = at[~opens[at + 1]]
    if len(at):
        one = np.isin(points[at + 1], [ord(c) for c in SUFFIX_1])
        out[at[one]] = C_SHORT
        at = at[at + 2 < n]
        at = at[~opens[at + 2]]
        for a, b in SUFFIX_2:
            out[at[(points[at + 1] == ord(a)) & (points[at + 2] == ord(b))]] = C_LONG
    out[first] += CLASSES
    return out


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Indices of the code points at which pieces start.

    points: code points of the documents one behind another; first: where each non-empty
    document starts. Blocks are folded into one function each, the functions are scanned by
    doubling, and a second sweep runs all blocks from their own start states.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    t = _automaton()
    kinds = _classes(points, first)
    width = max(16, int(n**0.5) // 4)
    rows = -(-n // width)
    padded = np.zeros(rows * width, np.int32)
    padded[:n] = kinds
    columns = np.ascontiguousarray(padded.reshape(rows, width).T)
    made = np.zeros(rows, np.int32)
    for column in columns:
        made = t["by_class"].take(made * (2 * CLASSES) + column)
    shift = 1
    while shift < rows:  # inclusive scan of the blocks' functions
        made[shift:] = t["both"][made[:-shift], made[shift:]]
        shift *= 2
    state = np.zeros(rows, np.int32)
    state[1:] = t["maps"][made[:-1], FRESH]
    starts = np.empty((width, rows), bool)
    for j, column in enumerate(columns):
        at = state * (2 * CLASSES) + column
        starts[j] = t["starts"].take(at)
        state = t["delta"].take(at).astype(np.int32)
    return np.flatnonzero(starts.T.ravel()[:n])


class Vocabulary:
    """Ranks of a byte-level vocabulary, with a bounded memory of merged pieces."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.cache = _Cache(self)
        last = max(ranks.values())
        tokens = [b""] * (last + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(x) for x in tokens], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def merge(self, piece: bytes) -> bytes:
        """Packed ids of a piece: the pair of least rank is merged first, leftmost on ties."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return whole.to_bytes(4, "little")
        n = len(piece)
        end = list(range(1, n + 1))  # of the part that starts here
        before = list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or (j := end[i]) >= n or end[j] != stop:
                continue
            alive[j] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        return b"".join(ranks[piece[i : end[i]]].to_bytes(4, "little") for i in range(n) if alive[i])

    def encode(self, data: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the documents data[bounds[i]:bounds[i+1]], and each one's number of ids."""
        points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
        if not len(points):
            return np.zeros(0, np.uint32), np.zeros(len(bounds) - 1, np.int64)
        raw = np.frombuffer(data, np.uint8)
        at_byte = np.flatnonzero((raw & 0xC0) != 0x80)
        filled = bounds[:-1][np.diff(bounds) > 0]
        starts = at_byte[piece_starts(points, np.searchsorted(at_byte, filled))]
        cuts = [*starts.tolist(), len(data)]
        packed = [self.cache[data[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]
        ids = np.frombuffer(b"".join(packed), np.uint32)
        many = np.concatenate([[0], np.cumsum(np.fromiter(map(len, packed), np.int64, len(packed)) >> 2)])
        return ids, np.diff(many[np.searchsorted(starts, bounds)])

    def decode(self, ids: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
        """The bytes of the ids. starts: where each one's bytes begin, if that is known."""
        lengths = self.lengths[ids]
        if starts is None:
            starts = np.cumsum(lengths) - lengths
        total = int(starts[-1] + lengths[-1]) if len(ids) else 0
        return self.flat[np.repeat(self.offsets[ids] - starts, lengths) + np.arange(total)]


class _Cache(dict):
    def __init__(self, owner: Vocabulary):
        super().__init__()
        self.owner = owner

    def __missing__(self, piece: bytes) -> bytes:
        got = self.owner.merge(piece)
        if len(piece) <= CACHE_PIECE_BYTES:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = got
        return got


def read_ranks(path: str) -> bytes:
    """The rank file's content, which tasks get by broadcast; it has a fixed size."""
    with open(path, "rb") as file:
        return file.read()


@lru_cache(maxsize=2)
def vocabulary(content: bytes) -> Vocabulary:
    """A worker's tables for a rank file, made once."""
    return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a})


def _buffers(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """Values one behind another, nulls empty, and their bounds."""
    values = [x or b"" for x in column.cast(pa.binary()).to_pylist()]
    return b"".join(values), np.concatenate([[0], np.cumsum([len(x) for x in values], dtype=np.int64)]).astype(np.int64)


def _binary(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])


def encode(df: DataFrame, ranks_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encode every whole text.

    Returns the columns `keep` and n_tokens (long), ids and offsets (binary: unsigned 32-bit
    integers, least byte first; offsets are each token's first byte in its text). Null and
    empty texts have no tokens. Rows are independent, so repeated rows and ids are encoded
    each; other columns of df are not read. An empty table gives an empty table.
    """
    small_batches(df.sparkSession)
    content = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(content.value)
        for batch in slices(batches, width):
            data, bounds = _buffers(batch.column(width))
            ids, counts = words.encode(data, bounds)
            ends = np.cumsum(words.lengths[ids])
            starts = ends - words.lengths[ids] - np.repeat(bounds[:-1], counts)
            made = [pa.array(counts, pa.int64()), _binary(ids, counts * 4), _binary(starts.astype(np.uint32), counts * 4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *made], names=[*names, "n_tokens", "ids", "offsets"])

    names = [f"k{i}" for i in range(width)]
    source = df.select(*[df[c].alias(a) for c, a in zip(keep, names, strict=True)], df[text_col].cast("string").alias("t"))
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:width]]
    out = source.mapInArrow(run, ", ".join([*fields, "n_tokens long, ids binary, offsets binary"]))
    return out.withColumnsRenamed(dict(zip(names, keep, strict=True)))


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",), offsets_col: str | None = None) -> DataFrame:
    """Decode packed ids: returns the columns `keep` and decoded (binary); null ids give no bytes.

    Offsets as encode returns them place each token's bytes; without them they follow one another."""
    small_batches(df.sparkSession)
    content = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    width = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(content.value)
        for batch in slices(batches, width):
            data, bounds = _buffers(batch.column(width))
            ids, first = np.frombuffer(data, np.uint32), bounds >> 2
            ends = np.concatenate([[0], np.cumsum(words.lengths[ids])])
            sizes = np.diff(ends[first])
            starts = None
            if offsets_col is not None:
                offsets = np.frombuffer(_buffers(batch.column(width + 1))[0], np.uint32)
                if len(offsets) != len(ids):
                    raise ValueError("ids and offsets differ in number")
                starts = offsets.astype(np.int64) + np.repeat(np.cumsum(sizes) - sizes, np.diff(first))
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], _binary(words.decode(ids, starts), sizes)], names=[*names, "decoded"])

    names = [f"k{i}" for i in range(width)]
    source = df.select(*[df[c].alias(a) for c, a in zip(keep, names, strict=True)], df[ids_col].alias("t"), *([df[offsets_col].alias("o")] if offsets_col else []))
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:width]]
    return source.mapInArrow(run, ", ".join([*fields, "decoded binary"])).withColumnsRenamed(dict(zip(names, keep, strict=True)))


def unpacked(packed: bytes) -> list[int]:
    """Ids or offsets as a list."""
    return np.frombuffer(packed, np.uint32).tolist()


def digests(df: DataFrame, ranks_path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per document: its number of ids, and SHA-256 of the packed ids and of what they decode to."""
    ids = encode(df, ranks_path, text_col, (id_col,))
    both = decode(ids, ranks_path, "ids", (id_col, "n_tokens", "ids"), "offsets")
    return both.select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
