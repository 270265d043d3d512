"""Approximate nearest neighbours by an inverted file: cells around centres that a bounded sample gave.

Every vector belongs to the cell of its nearest centre. A query looks into the cells of its nearest centres,
and what it finds there is scored exactly. Searching for a set of queries moves no rows. For the neighbours
of all rows, a row travels once to its own cell and once to each cell that it looks into.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.operators.ranking import top_k
from galena.operators.retrieval import BROADCAST_NUMBERS, PAIRS, TILE, Nearest, directed, firsts, unit
from galena.sources.batches import bounded_batches

#: Vectors that centres are learned from, rounds of learning, queries or rows that meet in a task at once.
SAMPLE, ROUNDS, BLOCK = 20_000, 12, 4096
#: Numbers of the vectors of a block of rows that meet all others of their scope.
BLOCK_NUMBERS = 1 << 20
#: Share of the nearest that is to be found.
RECALL = 0.98


def sampled(rows: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Unit vectors of the `sample` rows (hit, vector) of least hash: at most that many come to the driver. Vectors
    without a direction, or of another length than most of the sample have, are left out."""
    good = rows.filter(directed(F.col("vector"))).select("vector", F.xxhash64("hit").alias("mark"))
    table = good.orderBy("mark", F.xxhash64("vector")).limit(sample).select("vector").toArrow()
    if not table.num_rows:
        return np.zeros((0, 0))
    lengths = [len(v) for v in table["vector"]]
    length = max(sorted(set(lengths)), key=lengths.count)
    return unit(table.filter(pa.array([n == length for n in lengths]))["vector"].combine_chunks())


def centres(have: np.ndarray, cells: int) -> np.ndarray:
    """Unit centres of at most `cells` cells, and of a quarter as many as there are sampled vectors."""
    if not len(have):
        return have
    number = max(1, min(cells, len(have) // 4, BROADCAST_NUMBERS // have.shape[1]))
    now = have[np.random.default_rng(7).choice(len(have), number, replace=False)]
    for _ in range(ROUNDS):
        own = np.argmax(have @ now.T, axis=1)
        sums = np.zeros_like(now)
        np.add.at(sums, own, have)
        empty = np.bincount(own, minlength=number) == 0
        # An empty cell starts again from the vectors that fit theirs worst.
        sums[empty] = have[np.argsort(np.einsum("ij,ij->i", have, now[own]), kind="stable")[: int(empty.sum())]]
        sizes = np.linalg.norm(sums, axis=1, keepdims=True)
        now = np.where(sizes > 0, sums / np.maximum(sizes, 1e-300), now)
    return now


def probes_for(have: np.ndarray, middle: np.ndarray, k: int, target: float = RECALL, queries: int = 1000) -> int:
    """How many cells a query has to look into to find the share `target` of its k nearest: what the first of the
    sampled vectors need among all of these. Neighbours in a sample are farther away than in the whole table, and so
    are their cells. Vectors without clusters need many cells, whatever the centres."""
    if len(have) < 2:
        return 1
    asked = have[:queries]
    score = asked @ have.T
    score[np.arange(len(asked)), np.arange(len(asked))] = -9.0
    near = np.argsort(-score, axis=1, kind="stable")[:, : min(k, len(have) - 1)]
    own = np.argmax(have @ middle.T, axis=1)
    rank = np.argsort(np.argsort(-(asked @ middle.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(rank, own[near], axis=1).ravel()) + 1
    return int(needed[min(len(needed) - 1, math.ceil(target * len(needed)) - 1)])


def fitted(rows: DataFrame, k: int, cells: int | None = None, target: float = RECALL) -> tuple[np.ndarray, int]:
    """Centres, as many as the root of the number of rows unless `cells` says how many, and the cells to look into."""
    have = sampled(rows)
    middle = centres(have, cells or max(1, math.isqrt(rows.count())))
    return middle, probes_for(have, middle, k, target)


def in_cells(rows: DataFrame, middle: np.ndarray, probes: int = 1) -> DataFrame:
    """Rows (their columns, among them vector) with the numbers of their `probes` nearest cells, nearest first. Rows
    whose vector has no direction or another length than the centres are left out."""
    rows = rows.filter((F.size("vector") == (middle.shape[1] if len(middle) else -1)) & directed(F.col("vector")))
    at, names, held = rows.columns.index("vector"), rows.columns, rows.sparkSession.sparkContext.broadcast(middle)
    bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, TILE // max(1, len(held.value)))
        for whole in batches:
            for a in range(0, whole.num_rows, step):
                batch = whole.slice(a, step)
                near = unit(batch.column(at)) @ held.value.T
                order = (np.argmax(near, axis=1)[:, None] if probes == 1 else np.argsort(-near, axis=1, kind="stable")[:, :probes]).astype(np.int32)
                bounds = np.arange(0, order.size + 1, order.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(bounds), pa.array(order.ravel()))], names=[*names, "cells"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, cells array<int>")


def ann_lane(queries: DataFrame, rows: DataFrame, middle: np.ndarray, k: int, probes: int = 8, threshold: float = -2.0) -> DataFrame:
    """(query, hit, score, rank): of the rows in a query's `probes` nearest cells the k most similar.

    rows may have a column `cells` already (an index that in_cells() made and a table keeps); otherwise it is made
    here. Rows never move: a task scores each of its rows against the queries that look into its cell, and keeps the k best
    of each. Queries go in blocks of BROADCAST_NUMBERS numbers, each of which reads the rows again."""
    spark = rows.sparkSession
    placed = rows if "cells" in rows.columns else in_cells(rows.select("hit", "vector"), middle)
    asked = in_cells(queries.select("query", "vector"), middle, probes)
    schema = f"query {queries.schema['query'].dataType.simpleString()}, hit {rows.schema['hit'].dataType.simpleString()}, score double"
    number = queries.count() if len(middle) else 0
    # A query's numbers are its vector's and its cells.
    blocks = -(-number // max(1, BROADCAST_NUMBERS // (middle.shape[1] + min(probes, len(middle)) if len(middle) else 1)))
    out = spark.createDataFrame([], schema)
    for b in range(blocks):
        chosen = (asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b)).toArrow()
        if not chosen.num_rows:
            continue
        cells = chosen["cells"].combine_chunks()
        at, owner = cells.flatten().to_numpy(), cells.value_parent_indices().to_numpy().astype(np.int32)
        order = np.argsort(at, kind="stable")
        found, starts = np.unique(at[order], return_index=True)
        by_cell = dict(zip(found.tolist(), np.split(owner[order], starts[1:]), strict=True))
        held = spark.sparkContext.broadcast((chosen["query"].combine_chunks(), unit(chosen["vector"].combine_chunks()), by_cell))
        # Cells that no query looks into are left out where the rows are read.
        some = placed.filter(F.get("cells", F.lit(0)).isin(*by_cell)) if len(by_cell) <= 1000 else placed
        found = some.select("hit", "vector", F.get("cells", F.lit(0)).alias("cell")).mapInArrow(_in_batch(held, k, threshold), schema)
        out = found if not b else out.unionByName(found)
    return top_k(out, ["query"], [F.desc("score"), F.col("hit")], k)


def _best(wanted: np.ndarray, have: np.ndarray, ids: pa.Array, own: list | None, k: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries and rows, and scores, of the k best rows of each query; a query's own row is none."""
    score = np.round(wanted @ have.T, 6)
    place = np.argsort(np.argsort(ids.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
    if own is not None:
        there = {h: i for i, h in enumerate(ids.to_pylist())}
        for q, h in enumerate(own):
            if h in there:
                score[q, there[h]] = -9.0
    order = np.lexsort((np.broadcast_to(place, score.shape), -score), axis=1)[:, :k]
    q = np.repeat(np.arange(len(wanted)), order.shape[1])
    best = score[q, order.ravel()]
    good = best >= max(threshold, -2.0)
    return q[good], order.ravel()[good], best[good]


def _in_batch(held, k: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, wanted, by_cell = held.value
        best = Nearest(wanted, k, threshold)
        for whole in batches:
            cells = whole.column(2).to_numpy(zero_copy_only=False)
            for c in np.unique(cells).tolist():
                queries = by_cell.get(c)
                if queries is None:
                    continue
                part = whole.filter(pa.array(cells == c))
                have = unit(part.column(1))
                some = firsts(have, part.column(0), k)
                best.offer(queries, have[some], part.column(0).take(pa.array(some)))
            best.cut()
        if best.best is not None:
            query, hit, score = best.best
            for at in range(0, len(query), PAIRS):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(query[at : at + PAIRS])), hit.slice(at, PAIRS), pa.array(score[at : at + PAIRS])], names=["query", "hit", "score"])

    return run


def ann_neighbours(rows: DataFrame, middle: np.ndarray, k: int, probes: int = 8, scope: str | None = None, threshold: float = -2.0) -> DataFrame:
    """(query, hit, score, rank): of every row the k most similar others in its `probes` nearest cells, of its
    scope if one is named, of at least the score `threshold`; a null scope has no neighbours.

    1 + probes copies of a row travel. A cell of more than BLOCK rows, or looked into by more, is cut into blocks by
    hash, and every two blocks meet in one task, so that no task grows; copies then grow with the blocks of that cell."""
    scopes = [scope] if scope else []
    placed = in_cells(rows.select("hit", "vector", *scopes).filter(F.col(scope).isNotNull() if scope else F.lit(True)), middle, probes)
    each = placed.select("hit", "vector", *scopes, F.posexplode("cells").alias("probe", "cell"))
    keys = ["cell", *scopes]
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int")
    sizes = each.groupBy(*keys).agg(blocks(F.count_if(F.col("probe") == 0)).alias("own"), blocks(F.count("*")).alias("looks"))
    cut = sizes.filter("own > 1 or looks > 1")
    # Few cells are cut, and only these meet the rows; a sum of a bounded number of cells and scopes is small.
    dealt = each.join(cut, keys, "left").withColumns({"own": F.coalesce("own", F.lit(1)), "looks": F.coalesce("looks", F.lit(1))})
    deal = lambda n: F.pmod(F.xxhash64("hit"), F.col(n).cast("long")).cast("int")
    left = dealt.select(*keys, "hit", "vector", F.lit(0).alias("side"), deal("looks").alias("i"), F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("j"))
    right = dealt.filter("probe = 0").select(*keys, "hit", "vector", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("looks") - 1)).alias("i"), deal("own").alias("j"))
    kind = rows.schema["hit"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        a, b = (table.filter(pa.array(side == s)) for s in (0, 1))
        ids = table.schema.field("hit").type
        if not a.num_rows or not b.num_rows:
            return pa.table({"query": pa.array([], ids), "hit": pa.array([], ids), "score": pa.array([], pa.float64())})
        q, h, score = _best(unit(a["vector"].combine_chunks()), unit(b["vector"].combine_chunks()), b["hit"].combine_chunks(), a["hit"].to_pylist(), k, threshold)
        return pa.table({"query": a["hit"].take(pa.array(q)), "hit": b["hit"].take(pa.array(h)), "score": pa.array(score)})

    found = left.union(right).groupBy(*keys, "i", "j").applyInArrow(run, f"query {kind}, hit {kind}, score double")
    return top_k(found, ["query"], [F.desc("score"), F.col("hit")], k)


def nearest_earlier(rows: DataFrame, scope: str, threshold: float = -2.0, block: int = BLOCK) -> DataFrame:
    """(query, hit, score): of every row (hit, seq, vector) the most similar of all rows of its scope that come before it by
    (seq, hit), of at least the score `threshold`; of equals the first. Rows without such a one are left out.

    Exact: a scope is cut into blocks of about `block` rows by hash, and every two blocks meet once, in one task that bounds its
    memory by TILE pairs. A row travels once for each block of its scope. All vectors have a direction and one length."""
    sizes = rows.groupBy(scope).agg(F.ceil(F.count("*") / block).cast("int").alias("n"))
    dealt = rows.select(scope, "hit", "seq", "vector").join(sizes, scope).withColumn("own", F.pmod(F.xxhash64("hit"), F.col("n").cast("long")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    met = met.select(scope, "hit", "seq", "vector", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    kinds = dict(rows.dtypes)

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[("seq", "ascending"), ("hit", "ascending")], null_placement="at_start"))
        have, own = unit(table["vector"].combine_chunks()), table["own"].to_numpy()
        query, hit, score = [], [], []
        sides = [np.flatnonzero(own == b) for b in np.unique(own)]
        if table.num_rows and table["i"][0] != table["j"][0]:
            pairs = [(sides[0], sides[1]), (sides[1], sides[0])] if len(sides) == 2 else []
        else:
            pairs = [(one, one) for one in sides]
        for a, b in pairs:
            step = max(1, TILE // len(b))
            for at in range(0, len(a), step):
                some = a[at : at + step]
                likeness = np.round(have[some] @ have[b].T, 6)
                likeness[b[None, :] >= some[:, None]] = -9.0
                best = np.argmax(likeness, axis=1)
                value = likeness[np.arange(len(some)), best]
                good = value >= max(threshold, -2.0)
                query.append(some[good])
                hit.append(b[best[good]])
                score.append(value[good])
        none = [np.zeros(0, np.int64)]
        query, hit = (pa.array(np.concatenate(none + x)) for x in (query, hit))
        return pa.table({"query": table["hit"].take(query), "hit": table["hit"].take(hit), "seq": table["seq"].take(hit), "score": pa.array(np.concatenate([np.zeros(0), *score]))})

    found = met.groupBy(scope, "i", "j").applyInArrow(run, f"query {kinds['hit']}, hit {kinds['hit']}, seq {kinds['seq']}, score double")
    first = found.groupBy("query").agg(F.min(F.struct((-F.col("score")).alias("s"), "seq", "hit")).alias("b"))
    return first.select("query", "b.hit", (-F.col("b.s")).alias("score"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query, wanted, found): how many of a query's exact hits were found."""
    same = exact.select("query", "hit").join(found.select("query", "hit", F.lit(1).alias("there")), ["query", "hit"], "left")
    return same.groupBy("query").agg(F.count("*").alias("wanted"), F.count("there").alias("found"))
