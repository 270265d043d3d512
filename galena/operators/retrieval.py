"""Retrieval lanes, their fusion, rerank and quality measures.

A lane returns hits (query, hit, score). Ties end in the hit's id, so every list is total.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galena.operators.postings import share, term_lane, term_lanes
from galena.operators.ranking import ranked, top_k
from galena.sources.shared import stored

#: Weight constant of reciprocal-rank fusion, and tiers of authority by lane (the least counts).
FUSION_K = 60
TIERS = {"IDENTIFIER": 0, "VECTOR": 2, "HYDE_VECTOR": 2, "LEXICAL": 2, "TRIGRAM": 2, "CONCEPT": 2, "REFERENCE": 3, "GRAPH": 4}
#: Queries of this many numbers are broadcast; more are dealt in blocks.
BROADCAST_NUMBERS = 4_000_000
#: Pairs of queries and rows whose likeness is worked out at once, pairs that are confirmed at once, rows offered at once.
TILE, PAIRS, ROWS = 1 << 21, 1 << 16, 4096


#: Characters of a text whose trigrams are made at once.
PIECE = 1 << 16


@lru_cache(maxsize=1)
def _of_words() -> np.ndarray:
    """For every code point, whether words are made of it: letters and digits of any script."""
    return np.array([chr(c).isalnum() for c in range(sys.maxunicode + 1)])


@lru_cache(maxsize=1)  # several lanes read one text after another
def _letters(text: str) -> np.ndarray:
    """The code points of a text in lower case, with a blank for each that is of no word."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_of_words()[codes], codes, np.uint32(32))


def words_of(text: str) -> set[str]:
    """The distinct lexical words of a text."""
    return set(_letters(text).tobytes().decode("utf-32-le").split())


def _distinct(numbers: np.ndarray) -> np.ndarray:
    numbers.sort()
    new = np.ones(len(numbers), bool)
    np.not_equal(numbers[1:], numbers[:-1], out=new[1:])
    return numbers[new]


def trigram_numbers(text: str) -> np.ndarray:
    """The distinct trigrams of its words, each padded by two blanks in front and one behind, in rising order. A trigram is a
    number: its three code points of 21 bits."""
    letters = _letters(text)
    codes = np.full(len(letters) + 2, 32, np.uint32)
    codes[1:-1] = letters
    pieces = []
    for at in range(0, len(letters), PIECE):
        piece = codes[at : at + PIECE + 2].astype(np.int64)
        here = piece[1:-1]
        of_word = here != 32
        made = (piece[:-2] << 42 | here << 21 | piece[2:])[of_word]
        starts = here[of_word & (piece[:-2] == 32)] | 32 << 42 | 32 << 21
        pieces.append(_distinct(np.concatenate([made, starts])))
    return pieces[0] if len(pieces) == 1 else _distinct(np.concatenate([np.zeros(0, np.int64), *pieces]))


def trigrams_of(text: str) -> set[int]:
    return set(trigram_numbers(text).tolist())


def jaccard(shared: np.ndarray, nq: np.ndarray, nr: np.ndarray) -> np.ndarray:
    return shared / (nq + nr - shared)


def lexical_and_trigram_lanes(queries: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """(lane, query, hit, score, rank) of `lexical_lane` and `similar_by_trigrams`, for which the documents are read once."""
    return term_lanes(queries, documents, k, {"LEXICAL": (words_of, share), "TRIGRAM": (trigram_numbers, jaccard)})


def similar_by_trigrams(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(query, hit, score, rank): texts (hit, text) by shared trigrams among all of both."""
    return term_lane(queries, rows, k, trigram_numbers, jaccard)


def by_word_similarity(queries: DataFrame, rows: DataFrame, k: int, least: float = 0.0) -> DataFrame:
    """(query, hit, score, rank): texts by the share of a query's trigrams that they hold."""
    return term_lane(queries, rows, k, trigram_numbers, least=least)


def lexical_lane(queries: DataFrame, documents: DataFrame, k: int | None, least: float = 0.0) -> DataFrame:
    """Documents (hit, text) by the share of a query's distinct tokens that they hold: (query, hit,
    score, rank). Without k, all of at least the score `least`."""
    return term_lane(queries, documents, k, words_of, least=least)


def overlapping(rows: DataFrame, key: str, tokens: str, least: int, share: float) -> DataFrame:
    """(a, b, n, overlap) of rows that share at least `least` tokens and this share of the smaller set.

    Rows of equal sets are one, named by the least key. Each set is a query of the term lane that all larger sets answer, in
    blocks: sets move once, pairs of candidates never, and a task holds a block. The time is that of comparing all sets."""
    sets = rows.select(key, F.array_sort(F.array_distinct(tokens)).alias("ts")).groupBy("ts").agg(F.min(key).alias("id")).filter(F.size("ts") >= least)
    sets = stored(sets.select(F.struct("id", F.size("ts").alias("size")).alias("set"), F.array_join("ts", "\u0000").alias("text")), "sets")
    queries, hits = (sets.select(F.col("set").alias(name), "text") for name in ("query", "hit"))
    found = term_lane(queries, hits, None, lambda t: t.split("\u0000"), lambda n, nq, nr: np.where((n >= least) & (nq <= nr), n / nq, 0.0), share)
    a, b = F.col("query"), F.col("hit")
    once = found.select("query", "hit", "score").filter((a["size"] < b["size"]) | (a["id"] < b["id"]))
    return once.select(F.least(a["id"], b["id"]).alias("a"), F.greatest(a["id"], b["id"]).alias("b"), F.round(F.col("score") * a["size"]).cast("long").alias("n"), F.col("score").alias("overlap"))


def matched_all(query_tokens: Column, tokens: Column) -> Column:
    return F.size(F.array_except(query_tokens, tokens)) == 0


def directed(vector: Column) -> Column:
    """Whether a vector has a direction: numbers that are all finite, and one that is not zero. Rows
    without are no queries and no hits."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(vectors: pa.ListArray) -> np.ndarray:
    """Vectors of one length as rows of length one, from their flat numbers."""
    rows = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def vector_lane(queries: DataFrame, rows: DataFrame, k: int, threshold: float = -2.0, scope: str | None = None) -> DataFrame:
    """Exact cosine search: (query, hit, score, rank).

    With a scope column, a query is answered only by rows of its scope, and its k best are the best among
    those. Scopes are values, or arrays of strings of which one must be shared; a query whose array is null is
    not restricted, and other nulls match nothing.

    Rows never move: each task keeps its k best for every query, and these are
    ranked. Queries are broadcast while they are few; beyond that they go in blocks of that size.
    Vectors without a direction match nothing, nor do those of another length than most queries have.
    """
    queries = queries.filter(directed(F.col("vector"))).withColumn("_d", F.size("vector"))
    schema = f"query {queries.schema['query'].dataType.simpleString()}, hit {rows.schema['hit'].dataType.simpleString()}, score double"
    lengths = queries.groupBy("_d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("_d")).first()
    if lengths is None:
        return rows.sparkSession.createDataFrame([], f"{schema}, rank int")
    length, number = lengths["_d"], lengths["n"]
    queries, rows = queries.filter(F.col("_d") == length), rows.filter((F.size("vector") == length) & directed(F.col("vector")))
    blocks = -(-number // max(1, BROADCAST_NUMBERS // length))
    out = None
    for b in range(blocks):
        part = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b)
        chosen = part.select("query", "vector", *([scope] if scope else [])).toArrow()
        if not chosen.num_rows:
            continue
        held = rows.sparkSession.sparkContext.broadcast((chosen["query"].combine_chunks(), unit(chosen["vector"].combine_chunks()), Scopes(chosen[scope]) if scope else None))
        found = rows.select("hit", "vector", *([scope] if scope else [])).mapInArrow(_nearest(held, k, threshold), schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return rows.sparkSession.createDataFrame([], f"{schema}, rank int")
    return top_k(out, ["query"], [F.desc("score"), F.col("hit")], k)


class Scopes:
    """Which queries a row may answer, by the values of a column."""

    def __init__(self, column: pa.ChunkedArray):
        self.listed = pa.types.is_list(column.type)
        values = column.to_pylist()
        self.free = np.array([self.listed and v is None for v in values], bool)
        self.queries: dict = {}
        for i, own in enumerate(values):
            for v in (own or []) if self.listed else [] if own is None else [own]:
                self.queries.setdefault(v, []).append(i)
        self.queries = {v: np.unique(own) for v, own in self.queries.items()}

    def masks(self, column: pa.Array):
        """A function of some queries: for each of them and each row, whether they may meet."""
        at = column.value_parent_indices() if self.listed else pa.array(range(len(column)))
        places: dict = {}
        for row, v in zip(at.to_pylist(), (column.flatten() if self.listed else column).to_pylist(), strict=True):
            if v in self.queries:
                places.setdefault(v, []).append(row)

        def of(queries: np.ndarray) -> np.ndarray:
            out = np.repeat(self.free[queries][:, None], len(column), axis=1)
            for v, own in places.items():
                named = np.searchsorted(queries, np.array(self.queries[v]))
                named = named[(named < len(queries)) & (queries[np.minimum(named, len(queries) - 1)] == self.queries[v])]
                out[np.ix_(named, own)] = True
            return out

        return of


class Nearest:
    """The k best rows of every query among those offered, in memory that the queries bound.

    Likeness is worked out in single precision for TILE pairs at once. A pair whose likeness can reach its
    query's worst of k, the error of single precision allowed for, is worked out again in double."""

    def __init__(self, wanted: np.ndarray, k: int, threshold: float):
        self.wanted, self.k, self.threshold = wanted, k, max(threshold, -2.0)
        self.short = wanted.astype(np.float32)
        # A sum of d products of unit vectors errs by d units in the last place at most; scores are rounded to six places.
        self.margin = (wanted.shape[1] + 4) * 2.0**-23 + 1e-6
        self.begin()

    def begin(self) -> None:
        self.floor = np.full(len(self.wanted), self.threshold)
        self.full = np.zeros(len(self.wanted), bool)
        self.best: tuple | None = None
        self.waiting: list[tuple] = []
        self.count = 0

    def offer(self, queries: np.ndarray, have: np.ndarray, hits: pa.Array, may=None) -> None:
        """Rows (unit vectors and their names) for some queries; may(queries) tells which pairs may meet."""
        short = have.astype(np.float32)
        size = max(1, TILE // max(1, len(have)))
        for at in range(0, len(queries), size):
            own = queries[at : at + size]
            score = self.short[own] @ short.T
            if may is not None:
                score[~may(own)] = -9.0
            least = self.floor[own] - self.margin
            new = np.flatnonzero(~self.full[own])
            if len(new) and len(have) > self.k:
                kth = np.partition(score[new], len(have) - self.k, axis=1)[:, len(have) - self.k]
                least[new] = np.maximum(least[new], kth - 2 * self.margin)
            q, h = np.nonzero(score >= least[:, None])
            for a in range(0, len(q), PAIRS):
                self._confirm(own[q[a : a + PAIRS]], have, h[a : a + PAIRS], hits)

    def _confirm(self, query: np.ndarray, have: np.ndarray, row: np.ndarray, hits: pa.Array) -> None:
        value = np.round(np.einsum("ij,ij->i", self.wanted[query], have[row]), 6)
        good = value >= self.floor[query]
        self.waiting.append((query[good], hits.take(pa.array(row[good])), value[good]))
        self.count += int(good.sum())
        if self.count >= max(4 * PAIRS, len(self.wanted)):
            self.cut()

    def cut(self) -> None:
        """Keep the k best of each query, of equals the first by name."""
        if not self.waiting:
            return
        parts = ([self.best] if self.best is not None else []) + self.waiting
        query, value = (np.concatenate([x[i] for x in parts]) for i in (0, 2))
        hit = pa.concat_arrays([x[1] for x in parts])
        place = np.argsort(np.argsort(hit.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
        order = np.lexsort((place, -value, query))
        starts = np.flatnonzero(np.diff(query[order], prepend=-1))
        number = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
        last = order[number == self.k - 1]
        self.floor[query[last]] = np.maximum(self.floor[query[last]], value[last])
        self.full[query[last]] = True
        keep = order[number < self.k]
        self.best, self.waiting, self.count = (query[keep], hit.take(pa.array(keep)), value[keep]), [], 0


def firsts(vectors: np.ndarray, ids: pa.Array, k: int, others: pa.Array | None = None) -> np.ndarray:
    """Places of the rows without those that k rows of the same vector (and the same of `others`) come before by name."""
    keys = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * vectors.itemsize))).ravel()
    group = np.unique(keys, return_inverse=True)[1]
    if others is not None:
        found: dict = {}
        group = np.array([found.setdefault((g, str(o)), len(found)) for g, o in zip(group.tolist(), others.to_pylist(), strict=True)], np.int64)
    if not len(group) or group.max() + 1 == len(group):
        return np.arange(len(group))
    order = np.lexsort((np.argsort(np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable"), kind="stable"), group))
    starts = np.flatnonzero(np.diff(group[order], prepend=-1))
    number = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return np.sort(order[number < k])


def _nearest(held, k: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, wanted, scopes = held.value
        best = Nearest(wanted, k, threshold)
        every = np.arange(len(names))
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                have = unit(batch.column(1))
                some = firsts(have, batch.column(0), k, batch.column(2) if scopes is not None else None)
                part = batch.take(pa.array(some)) if len(some) < batch.num_rows else batch
                best.offer(every, have[some], part.column(0), scopes.masks(part.column(2)) if scopes is not None else None)
                best.cut()
        if best.best is not None:
            query, hit, score = best.best
            for at in range(0, len(query), PAIRS):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(query[at : at + PAIRS])), hit.slice(at, PAIRS), pa.array(score[at : at + PAIRS])], names=["query", "hit", "score"])

    return run


def nearest_in_scope(rows: DataFrame, scope: str, k: int, block: int = 2048) -> DataFrame:
    """The k nearest others of every row within its scope: (query, hit, score, rank).

    A scope is cut into blocks by hash, and every two blocks of a scope meet in one task, so that
    a large scope is spread over tasks of bounded size. Vectors without a direction are left out."""
    rows = rows.filter(directed(F.col("vector")))
    sizes = rows.groupBy(scope).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block)).cast("int").alias("blocks"))
    dealt = rows.join(sizes, scope).withColumn("own", F.pmod(F.xxhash64("hit"), F.col("blocks").cast("long")).cast("int"))
    left = dealt.select(scope, "hit", "vector", F.lit(0).alias("side"), F.col("own").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    right = dealt.select(scope, "hit", "vector", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.col("own").alias("j"))

    def run(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        ids, vectors = table["hit"].to_numpy(), unit(table["vector"].combine_chunks())
        a, b = side == 0, side == 1
        score = np.round(vectors[a] @ vectors[b].T, 6)
        score[ids[a][:, None] == ids[b][None, :]] = -9.0
        order = np.lexsort((np.broadcast_to(ids[b], score.shape), -score), axis=1)[:, :k]
        at = np.repeat(np.arange(len(score)), order.shape[1])
        best = score[at, order.ravel()]
        good = best > -2
        return pa.table({"query": ids[a][at[good]], "hit": ids[b][order.ravel()[good]], "score": best[good]})

    kind = rows.schema["hit"].dataType.simpleString()
    found = left.union(right).groupBy(scope, "i", "j").applyInArrow(run, f"query {kind}, hit {kind}, score double")
    return top_k(found, ["query"], [F.desc("score"), F.col("hit")], k)


def mutual(neighbours: DataFrame) -> DataFrame:
    """(u, v, forward, backward, worst) of pairs that are among each other's neighbours, u < v."""
    back = neighbours.select(F.col("query").alias("hit"), F.col("hit").alias("query"), F.col("score").alias("backward"), F.col("rank").alias("back_rank"))
    both = neighbours.join(back, ["query", "hit"]).filter("query < hit")
    return both.select(F.col("query").alias("u"), F.col("hit").alias("v"), F.col("score").alias("forward"), "backward", F.greatest("rank", "back_rank").alias("worst"))


def tier(lane: Column) -> Column:
    """The tier of authority of a lane; the least counts."""
    out = F.lit(4)
    for name, t in TIERS.items():
        out = F.when(lane == name, t).otherwise(out)
    return out


def fused(hits: DataFrame, weights: dict[str, float] | None = None, k: int = FUSION_K) -> DataFrame:
    """Reciprocal-rank fusion of lanes (query, lane, hit, rank): (query, hit, tier, score, lanes,
    place). The tier of authority comes before the score."""
    weight = F.lit(1.0)
    for lane, w in (weights or {}).items():
        weight = F.when(F.col("lane") == lane, w).otherwise(weight)
    out = hits.groupBy("query", "hit").agg(F.min(tier(F.col("lane"))).alias("tier"), F.round(F.sum(weight / (k + F.col("rank"))), 9).alias("score"), F.count_distinct("lane").alias("lanes"))
    return ranked(out, ["query"], [F.col("tier"), F.desc("score"), F.col("hit")], "place")


def reranked(hits: DataFrame, semantic: str, first: int = 20, weight: float = 0.15) -> DataFrame:
    """Re-sorts the first hits of each query by semantic score blended with the fused one; the rest follow unchanged."""
    from pyspark.sql.window import Window

    top = F.max("score").over(Window.partitionBy("query"))
    blend = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(semantic) * (1 - weight) + F.col("score") / top * weight))
    scored = hits.withColumn("rerank", F.when(F.col("place") <= first, F.round(blend, 9)))
    return ranked(scored, ["query"], [F.col("rerank").isNull(), F.when(F.col("rerank").isNotNull(), F.col("tier")), F.desc("rerank"), F.col("place"), F.col("hit")], "final")


def retrieval_quality(ranked_hits: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Per query of truth (query, hit): recall, mrr and ndcg at k of (query, hit, rank)."""
    good = ranked_hits.filter(F.col("rank") <= k).join(truth.select("query", "hit").distinct(), ["query", "hit"])
    sums = good.groupBy("query").agg(F.count("*").alias("found"), F.max(1 / F.col("rank")).alias("rr"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    sizes = truth.select("query", "hit").distinct().groupBy("query").agg(F.count("*").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + 1))
    out = sizes.join(sums, "query", "left")
    return out.select("query", (F.coalesce("found", F.lit(0)) / F.col("n")).alias("recall"), F.coalesce("rr", F.lit(0.0)).alias("mrr"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"))


def evidence_quality(hits: DataFrame) -> DataFrame:
    """STRONG, ADEQUATE or WEAK evidence of each query from (query, hit, tier, lanes)."""
    sums = hits.groupBy("query").agg(F.min("tier").alias("tier"), F.count("*").alias("n"), F.max("lanes").alias("channels"), F.count_distinct("hit").alias("docs"))
    strong = (F.col("tier") == 0) | ((F.col("n") >= 2) & (F.col("channels") >= 2) & (F.col("docs") >= 2))
    return sums.select("query", F.when(strong, "STRONG").when((F.col("n") >= 2) | (F.col("channels") >= 2), "ADEQUATE").otherwise("WEAK").alias("quality"))
