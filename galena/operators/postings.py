"""The term lane: texts scored against queries by shared terms, with scopes and early stops.

Rows never move and no pair is made of a term that many texts hold. The queries are broadcast, and each
task keeps the k best texts of every query. Once a query has k texts in a task, a text needs as many of its
terms as the worst of them; one that misses all of the query's rarest terms, as many as can be missed
and some more, holds as many as these are more. Only those rarest terms have postings, so that frequent terms are seldom
looked at. What is rare is what the task has met least, or without k what the fewest queries have, which only decides how
much is skipped. Few queries of few terms have no postings: all their terms are counted for many texts at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.operators.ranking import ranked, top_k
from galena.sources.batches import bounded_batches, slices

#: Bytes of query texts that are broadcast at once; texts, and pairs of these and queries, that are scored before the best are cut.
BROADCAST_TEXT, SLICE, PAIRS = 16 << 20, 256, 1 << 18
#: Of the terms that a text needs, the share that it must hold among a query's rarest ones before all are looked at.
FIRST = 0.15
#: Queries times their distinct terms, and the larger of both, up to which all are counted for every text.
CELLS, SIDE = 1 << 22, 1 << 14

#: A text's terms: any values, or an array of distinct numbers in rising order.
Terms = Callable[[str], Iterable]


def share(shared: np.ndarray, nq: np.ndarray, nr: np.ndarray) -> np.ndarray:
    """The share of a query's terms."""
    return shared / nq


def _set(terms: Iterable) -> set:
    return terms if isinstance(terms, set) else set(terms.tolist() if isinstance(terms, np.ndarray) else terms)


class Best:
    """The k best texts of every query among those that have been scored.

    score(shared, query's terms, text's terms) must not exceed the share of the query's terms."""

    def __init__(self, queries: list[Iterable], k: int | None, score, least: float, scopes: list[list[str] | None] | None = None):
        self.k, self.score, self.least = k, score, least
        found = [list(_set(q)) if isinstance(q, np.ndarray) else list(dict.fromkeys(q)) for q in queries]
        self.vocabulary: dict[str, int] = {}
        self.flat = np.array([self.vocabulary.setdefault(t, len(self.vocabulary)) for q in found for t in q], np.int64)
        self.sizes = np.array([len(q) for q in found], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.owner = np.repeat(np.arange(len(found)), self.sizes)
        self.free = np.array([s is None for s in scopes or [None] * len(found)], bool)
        self.by_scope: dict[str, list[int]] = {}
        for i, own in enumerate(scopes or []):
            for s in own or []:
                self.by_scope.setdefault(s, []).append(i)
        # Without k what is needed never rises, so that one index serves all tasks.
        self.asked = None if k is not None else np.bincount(self.flat, minlength=len(self.vocabulary))
        self.begin()

    def begin(self) -> None:
        self.met = np.zeros(len(self.vocabulary), np.int64) if self.asked is None else self.asked.copy()
        self.held = np.zeros(len(self.vocabulary), bool)
        self.needed = np.full(len(self.sizes), self.least)
        self.best: tuple | None = None
        self.waiting: list[tuple] = []
        self.count = 0
        self.texts, self.rebuild, self.weighed = 0, SLICE, 0
        # While hits come in rising order, an equal score behind the k best does not count.
        self.rising, self.last = True, None
        self.full = np.zeros(len(self.sizes), bool)
        if self.asked is None or not hasattr(self, "bounds"):
            self._index()

    def __getstate__(self) -> dict:
        """Without what a task begins anew."""
        return {k: v for k, v in self.__dict__.items() if k not in ("score", "met", "held", "needed", "best", "waiting", "full", *(("direct", "first", "bar", "queries", "bounds") if self.asked is None else ()))}

    def _index(self) -> None:
        """Postings of each query's rarest terms: some more than a text of enough score can miss, which
        then holds as many of these (`first`). Queries that would cost more this way, as these terms are frequent too, have postings of all terms, which count directly."""
        share = self.needed * self.sizes
        least = np.maximum(1, np.where(self.full & self.rising, np.floor(share + 1e-9) + 1, np.ceil(share - 1e-9))).astype(np.int64)
        order = np.lexsort((self.met[self.flat], self.owner))
        place = np.arange(len(order)) - self.starts[self.owner]
        self.first = np.maximum(1, (FIRST * least).astype(np.int64))
        keep = place < (self.sizes - least + self.first)[self.owner]
        often = self.met[self.flat[order]]
        cost = lambda which: np.bincount(self.owner[which], often[which], len(self.sizes))
        # One term in common is often a chance, and all of the query's are looked at; more seldom are.
        self.direct = cost(keep) * np.where(self.first > 1, 3, 1 + self.sizes) >= cost(np.ones(len(order), bool))
        self.bar = np.where(self.direct, 1, self.first)
        keep |= self.direct[self.owner]
        terms, queries = self.flat[order][keep], self.owner[keep]
        by_term = np.argsort(terms, kind="stable")
        self.queries = queries[by_term]
        self.bounds = np.searchsorted(terms[by_term], np.arange(len(self.vocabulary) + 1))

    def _shared(self, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Queries that may score enough, and how many of their terms are among the ids."""
        met = [self.queries[self.bounds[i] : self.bounds[i + 1]] for i in ids]
        met = np.concatenate(met) if met else np.zeros(0, np.int64)
        self.weighed += len(met)
        if 8 * len(met) > len(self.sizes):
            counts = np.bincount(met, minlength=len(self.sizes))
            queries = np.flatnonzero(counts >= self.bar)
            counts = counts[queries]
        else:
            queries, counts = np.unique(met, return_counts=True)
            enough = counts >= self.bar[queries]
            queries, counts = queries[enough], counts[enough]
        look = np.flatnonzero(~self.direct[queries])
        if len(look):
            sizes = self.sizes[queries[look]]
            ends = np.cumsum(sizes)
            self.weighed += int(ends[-1])
            self.held[ids] = True
            counts[look] = np.add.reduceat(self.held[self.flat[np.arange(ends[-1]) + np.repeat(self.starts[queries[look]] - ends + sizes, sizes)]].astype(np.int64), ends - sizes)
            self.held[ids] = False
        return queries, counts

    def _follows(self, hits: pa.Array) -> bool:
        """Whether all hits are behind those before; only then equal scores can be left out."""
        if not (pa.types.is_integer(hits.type) or pa.types.is_string(hits.type)) or hits.null_count or not len(hits):
            return False
        ends = pc.min_max(hits)
        after = self.last is None or ends["min"].as_py() > self.last
        self.last = ends["max"].as_py()
        return after

    def _met(self, texts: list[Iterable], scopes: list[list[str] | None] | None) -> Iterator[tuple[np.ndarray, ...]]:
        """(text, query, shared terms, the text's terms) of pairs that may meet and score enough, for a text at a time."""
        for i, found in enumerate(texts):
            found = _set(found)
            ids = [j for j in map(self.vocabulary.get, found) if j is not None]
            self.met[ids] += 1
            q, n = self._shared(ids)
            if not self.free.all() and len(q):
                may = self.free[q] | np.isin(q, self._named(scopes, i))
                q, n = q[may], n[may]
            yield np.full(len(q), i), q, n, np.full(len(q), len(found))

    def _named(self, scopes: list[list[str] | None] | None, i: int) -> list[int]:
        """The queries that a text's scopes name."""
        return [j for s in (scopes[i] if scopes and scopes[i] else []) for j in self.by_scope.get(s, ())]

    def weigh(self, texts: list[Iterable], hits: pa.Array, scopes: list[list[str] | None] | None = None) -> tuple:
        """(query, hit, score) of the texts that score enough; they are kept if k is given."""
        found = self.offer(texts, hits, scopes)
        return self.cut() if self.k is not None else found

    def offer(self, texts: list[Iterable], hits: pa.Array, scopes: list[list[str] | None] | None = None) -> tuple | None:
        """The same, but what is kept waits until it is cut to the k best of every query."""
        if self.k is not None and self.rising and not self._follows(hits):
            self.rising = False
            self._index()
        waiting, count = [], 0
        for row, q, n, size in self._met(texts, scopes):
            value = self.score(n, self.sizes[q], size).astype(np.float64)
            good = value >= self.needed[q]
            if self.k is not None and self.rising:
                good &= ~(self.full[q] & (value == self.needed[q]))
            waiting.append((q[good].astype(np.int32), row[good].astype(np.int32), value[good]))
            count += len(waiting[-1][0])
            if self.k is not None and self.count + count >= self._most():
                self._keep(waiting, hits)
                waiting, count = [], 0
        if self.k is None:
            query, row, value = _joined(waiting)
            return query, hits.take(pa.array(row)), value
        self._keep(waiting, hits)
        self.texts += len(texts)
        if self.texts >= self.rebuild:
            self.rebuild *= 2
            self.cut()
            self._index()
        return None

    def _most(self) -> int:
        """Pairs that wait at most: a cut sorts the best of all queries."""
        return max(PAIRS, len(self.sizes))

    def _keep(self, waiting: list[tuple], hits: pa.Array) -> None:
        query, row, value = _joined(waiting)
        if len(query):
            self.waiting.append((query, hits.take(pa.array(row)), value))
            self.count += len(query)
        if self.count >= self._most():
            self.cut()

    def cut(self) -> tuple | None:
        """Cut the best so far and what waits to the k best of every query."""
        if self.waiting:
            parts = ([self.best] if self.best is not None else []) + self.waiting
            self.best = self._cut(np.concatenate([x[0] for x in parts]), pa.concat_arrays([x[1] for x in parts]), np.concatenate([x[2] for x in parts]))
            self.waiting, self.count = [], 0
        return self.best

    def _cut(self, query: np.ndarray, hit: pa.Array, value: np.ndarray) -> tuple:
        names = hit.to_numpy(zero_copy_only=False)
        place = names if pa.types.is_integer(hit.type) and not hit.null_count else np.argsort(np.argsort(names, kind="stable"), kind="stable")
        order = np.lexsort((place, -value, query))
        starts = np.flatnonzero(np.diff(query[order], prepend=-1))
        number = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
        last = order[number == self.k - 1]
        self.needed[query[last]] = np.maximum(self.needed[query[last]], value[last])
        self.full[query[last]] = True
        keep = order[number < self.k]
        return query[keep], hit.take(pa.array(keep)), value[keep]


class Dense(Best):
    """Best for few queries of few terms: these are counted for many texts at once, by a product of matrices.

    A text costs what the queries' cells cost, whatever it holds; while these are few, that is less than its look at postings."""

    def __getstate__(self) -> dict:
        return {k: v for k, v in super().__getstate__().items() if k not in ("asks", "numbers", "places")}

    def _index(self) -> None:
        if hasattr(self, "asks"):
            return
        self.asks = np.zeros((len(self.vocabulary), len(self.sizes)), np.float32)
        self.asks[self.flat, self.owner] = 1
        if all(isinstance(t, int) for t in self.vocabulary):
            numbers = np.array(list(self.vocabulary), np.int64)
            self.places = np.argsort(numbers)
            self.numbers = numbers[self.places]

    def _held(self, texts: list[Iterable]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term) of the vocabulary's terms in texts, and how many terms these have."""
        if all(isinstance(t, np.ndarray) for t in texts):
            sizes, found = np.array([len(t) for t in texts], np.int64), np.concatenate(texts)
            at = np.minimum(np.searchsorted(self.numbers, found), len(self.numbers) - 1)
            met = self.numbers[at] == found
            return np.repeat(np.arange(len(texts)), sizes)[met], self.places[at[met]], sizes
        texts, known = [_set(t) for t in texts], set(self.vocabulary)
        met = [[self.vocabulary[t] for t in known & own] for own in texts]
        return np.repeat(np.arange(len(texts)), [len(m) for m in met]), np.array([j for m in met for j in m], np.int64), np.array([len(t) for t in texts], np.int64)

    def _met(self, texts: list[Iterable], scopes: list[list[str] | None] | None) -> Iterator[tuple[np.ndarray, ...]]:
        if not self.vocabulary:
            return
        step = max(1, PAIRS // max(self.asks.shape))
        for at in range(0, len(texts), step):
            row, term, sizes = self._held(texts[at : at + step])
            have = np.zeros((len(sizes), len(self.vocabulary)), np.float32)
            have[row, term] = 1
            shared = have @ self.asks  # whole numbers, exact in single precision
            if not self.free.all():
                for i in range(len(sizes)):
                    may = self.free.copy()
                    may[self._named(scopes, at + i)] = True
                    shared[i, ~may] = 0
            row, q = np.nonzero(shared)
            yield row + at, q, shared[row, q].astype(np.int64), sizes[row]


def _best(queries: list[Iterable], *more) -> Best:
    """The cheaper way for these queries."""
    sides = len(queries), len(set().union(*map(_set, queries)))
    return (Dense if sides[0] * sides[1] <= CELLS and max(sides) <= SIDE else Best)(queries, *more)


def _joined(parts: list[tuple]) -> tuple[np.ndarray, ...]:
    none = (np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0))
    return tuple(np.concatenate(x) for x in zip(none, *parts, strict=True))


def term_lane(queries: DataFrame, rows: DataFrame, k: int | None, terms: Terms, score=share, least: float = 0.0) -> DataFrame:
    """(query, hit, score, rank): texts (hit, text) scored against queries (query, text) by their shared terms.

    If both have a column `scopes` (array of strings), a query with scopes is answered only by texts that share
    one, and its k best are the best among those; a null of scopes does not restrict, an empty array matches
    nothing. Without k, all texts of at least the score `least`. Ties end in the hit. Null texts have no terms.
    Queries beyond BROADCAST_TEXT go in blocks of that size, each of which reads the rows again."""
    out = _hits(queries, rows, k, [(terms, score)], least).drop("lane")
    if k is None:
        return ranked(out, ["query"], [F.desc("score"), F.col("hit")])
    return top_k(out, ["query"], [F.desc("score"), F.col("hit")], k)


def term_lanes(queries: DataFrame, rows: DataFrame, k: int, lanes: dict[str, tuple[Terms, Callable]], least: float = 0.0) -> DataFrame:
    """(lane, query, hit, score, rank): `term_lane` by several kinds of terms, each with its score, in one reading of the rows."""
    out = _hits(queries, rows, k, list(lanes.values()), least)
    named = out.withColumn("lane", F.element_at(F.array(*[F.lit(n) for n in lanes]), F.col("lane") + 1))
    return top_k(named, ["lane", "query"], [F.desc("score"), F.col("hit")], k)


def _hits(queries: DataFrame, rows: DataFrame, k: int | None, lanes: list[tuple[Terms, Callable]], least: float) -> DataFrame:
    """(lane's number, query, hit, score): what each task keeps."""
    spark, kinds = rows.sparkSession, [d.schema[c].dataType.simpleString() for d, c in ((queries, "query"), (rows, "hit"))]
    schema = f"lane int, query {kinds[0]}, hit {kinds[1]}, score double"
    scoped = "scopes" in queries.columns
    own = lambda df: [F.col("scopes") if "scopes" in df.columns else F.array().cast("array<string>").alias("scopes")] * scoped
    wanted = queries.select("query", F.coalesce("text", F.lit("")).alias("text"), *own(queries))
    size = wanted.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"]
    blocks = -(-(size or 0) // BROADCAST_TEXT)
    out = spark.createDataFrame([], schema)
    bounded_batches(spark)
    source = rows.select("hit", F.coalesce("text", F.lit("")).alias("text"), *own(rows))
    for b in range(blocks):
        part = (wanted if blocks == 1 else wanted.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b)).toArrow()
        texts, scopes = part["text"].to_pylist(), part["scopes"].to_pylist() if scoped else None
        best = [_best([terms(t) for t in texts], k, score, least, scopes) for terms, score in lanes]
        held = spark.sparkContext.broadcast((part["query"].combine_chunks(), best))
        one_block = source.mapInArrow(_scored(held, lanes, scoped), schema)
        out = one_block if not b else out.unionByName(one_block)
    return out


def _scored(held, lanes: list[tuple[Terms, Callable]], scoped: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, best = held.value
        for own, (_, score) in zip(best, lanes, strict=True):
            own.score = score
            own.begin()
        k, queries = best[0].k, len(best[0].sizes)
        named = lambda i, x: pa.RecordBatch.from_arrays([pa.array(np.full(len(x[0]), i, np.int32)), names.take(pa.array(x[0])), x[1], pa.array(x[2])], names=["lane", "query", "hit", "score"])
        for batch in slices(batches, 1):
            step = SLICE if k is not None else max(1, min(SLICE, PAIRS // max(1, queries)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                texts = zip(*([terms(t) for terms, _ in lanes] for t in part.column(1).to_pylist()), strict=True)
                scopes = part.column(2).to_pylist() if scoped else None
                for i, found in enumerate(texts):
                    now = best[i].offer(list(found), part.column(0), scopes)
                    if k is None:
                        yield named(i, now)
        for i, own in enumerate(best):
            if own.cut() is not None:
                yield named(i, own.best)

    return run
