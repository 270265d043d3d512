"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

The lexicon is learned: words and word beginnings that toxic documents of the labelled sample
hold far more often than others. Features of the sample's rows use a lexicon that was counted
without their third of the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.llm.common import held_out, slices, small_batches
from galena.llm.learning import SAMPLE_ROWS, labelled_sample, scored

#: Parts that the sample is counted in, least share and log odds of a lexicon entry, entries kept.
PARTS, LEAST_ROWS, LEAST_SHARE, LEAST_ODDS, ENTRIES = 3, 3, 0.004, 2.0, 4000
BEGINNINGS = (4, 5, 6)
TREES, DEPTH, BINS, RATE, RIDGE = 80, 3, 32, 0.15, 4.0
NEAR, THRESHOLD, CACHE = 5, 0.3, 1 << 17

# Second-person words of the languages served, and signs that stand for letters.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine euch ihr sie tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros".split())
LOOKALIKES = str.maketrans("013457@$!|", "oieastasil")

FEATURES = ("log_words", "hits", "hit_density", "hit_weight", "kinds_of_hits", "begins", "begin_density", "begin_weight", "hits_near_second_person", "second_person", "capitals", "shouted", "exclamations", "punctuation", "obfuscated", "obfuscated_hits", "digits")


def _core(token: str) -> str:
    """The token without signs at its ends, in lower case."""
    a, b = 0, len(token)
    while a < b and not token[a].isalnum():
        a += 1
    while b > a and not token[b - 1].isalnum():
        b -= 1
    return token[a:b].lower()


def _plain(core: str) -> str:
    """What an obfuscated word stands for: lookalikes put back, signs and long runs taken out."""
    out: list[str] = []
    for c in core.translate(LOOKALIKES):
        if c.isalpha() and out[-2:] != [c, c]:
            out.append(c)
    return "".join(out)


def terms(text: str) -> set[str]:
    """Distinct words of a text, and their beginnings with a mark in front."""
    words = {w for t in set(text.split()) if (w := _core(t))}
    return words | {f"^{w[:n]}" for w in words for n in BEGINNINGS if len(w) > n}


def _counted(sample: DataFrame) -> DataFrame:
    """(term, part, toxic, other): documents of the sample that hold the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            found: dict[tuple[str, int], list[int]] = {}
            for text, y, lot in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for term in terms(text):
                    found.setdefault((term, lot % PARTS), [0, 0])[1 - y] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.int32()), *[pa.array([v[i] for v in found.values()], pa.int64()) for i in (0, 1)]], names=["term", "part", "toxic", "other"])

    return sample.select("text", "y", "lot").mapInArrow(run, "term string, part int, toxic long, other long").groupBy("term", "part").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def lexicons(sample: DataFrame) -> list[dict[str, float]]:
    """Term weights (log odds): for each part one that is counted without it, then one of all."""
    sizes = {(r["part"], r["y"]): r["count"] for r in sample.groupBy((F.col("lot") % PARTS).alias("part"), "y").count().collect()}
    counted = _counted(sample)
    wide = counted.groupBy("term").agg(*[F.sum(F.when(F.col("part") == p, F.col(k)).otherwise(0)).alias(f"{k}{p}") for p in range(PARTS) for k in ("toxic", "other")])
    total = {k: sum((F.col(f"{k}{p}") for p in range(PARTS)), F.lit(0)) for k in ("toxic", "other")}
    toxic, other = (sum(v for (_, y), v in sizes.items() if y == k) for k in (1, 0))
    odds = F.log((total["toxic"] + 0.5) / (toxic + 1)) - F.log((total["other"] + 0.5) / (other + 1))
    # Entries are few: their number is bounded before they come to the driver.
    best = wide.withColumn("odds", odds).filter((total["toxic"] >= max(LEAST_ROWS, LEAST_SHARE * toxic)) & (F.col("odds") >= LEAST_ODDS / 2)).orderBy(F.desc(total["toxic"] * F.col("odds")), "term").limit(ENTRIES).collect()
    out: list[dict[str, float]] = []
    for left in [*range(PARTS), None]:
        parts = [p for p in range(PARTS) if p != left]
        t, o = (sum(sizes.get((p, y), 0) for p in parts) for y in (1, 0))
        one: dict[str, float] = {}
        for r in best:
            a, b = (sum(r[f"{k}{p}"] for p in parts) for k in ("toxic", "other"))
            weight = float(np.log((a + 0.5) / (t + 1)) - np.log((b + 0.5) / (o + 1)))
            if a >= max(LEAST_ROWS - 1, LEAST_SHARE * t) and weight >= LEAST_ODDS:
                one[r["term"]] = weight
        out.append(one)
    return out


class Features:
    """Dense features of texts under a lexicon; what a token adds is remembered."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, 13), np.float32)

    def _row(self, token: str) -> tuple[float, ...]:
        core = _core(token)
        weight = self.lexicon.get(core, 0.0)
        begin = max([self.lexicon.get("^" + core[:n], 0.0) for n in BEGINNINGS if len(core) > n], default=0.0)
        if token.isalpha():  # most tokens
            capitals = 0 if token == core else sum(map(str.isupper, token))
            return (len(token), capitals, 0, 0, 0, float(len(token) > 2 and capitals == len(token)), 0.0, 0.0, float(weight > 0), weight, float(begin > 0), begin, float(core in SECOND_PERSON))
        letters = sum(map(str.isalpha, token))
        capitals = sum(map(str.isupper, token))
        digits = sum(map(str.isdigit, token))
        mixed = not core.isalpha() and any(map(str.isalpha, core)) and "'" not in core and "-" not in core
        plain = _plain(core) if mixed else core
        hidden = mixed and plain != core and plain in self.lexicon
        return (letters, capitals, digits, len(token) - letters - digits, token.count("!"), float(letters > 2 and capitals == letters), float(mixed), float(hidden), float(weight > 0), weight, float(begin > 0), begin, float(core in SECOND_PERSON))

    def ids(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
        except KeyError:
            if len(known) > CACHE:
                self._forget()
                known = self.known
            for token in tokens:
                if token not in known:
                    at = known[token] = len(known)
                    if at == len(self.table):
                        self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                    self.table[at] = self._row(token)
            return np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))

    def of(self, text: str) -> np.ndarray:
        tokens = text.split()
        n = len(tokens)
        if not n:
            return np.zeros(len(FEATURES), np.float32)
        ids = self.ids(tokens)
        rows = self.table[ids]
        letters, capitals, digits, signs, loud, shouted, mixed, hidden, hits, weight, begins, begin_weight, second = rows.sum(axis=0)
        any_hit = (rows[:, 8] + rows[:, 10]) > 0
        near = 0.0
        if second and any_hit.any():
            seen = np.concatenate([[0], np.cumsum(rows[:, 12])])
            at = np.flatnonzero(any_hit)
            near = float((seen[np.minimum(at + NEAR + 1, n)] > seen[np.maximum(at - NEAR, 0)]).sum())
        kinds = len(np.unique(ids[any_hit]))
        length = max(len(text), 1)
        return np.array([np.log1p(n), hits, hits / n, weight / n, kinds, begins, begins / n, begin_weight / n, near, second / n, capitals / max(letters, 1), shouted / n, loud / length, signs / length, mixed / n, hidden, digits / length], np.float32)


@dataclass
class Trees:
    """Boosted trees of one depth on binned features, and a rising curve from margin to chance."""

    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    start: float = 0.0
    curve: tuple[np.ndarray, np.ndarray] | None = None

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(self.edges)], axis=1).astype(np.int64)

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = self._binned(x)
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        chance = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        self.start = float(np.log(chance / (1 - chance)))
        self.edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for i in range(x.shape[1])]
        # Rare features are zero nearly everywhere; their edges come from the other values.
        for i in range(x.shape[1]):
            if len(self.edges[i]) < 3 and (x[:, i] > 0).any():
                self.edges[i] = np.unique(np.concatenate([[0.0], np.quantile(x[x[:, i] > 0, i], np.linspace(0, 1, BINS // 2)[:-1])]))
        if len(np.unique(y)) < 2:
            return self
        binned = self._binned(x)
        flat = binned + np.arange(x.shape[1]) * (BINS + 1)
        margin = np.full(len(y), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
            feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, BINS + 1)
            node = np.zeros(len(y), np.int64)
            for level in range(DEPTH):
                low = 2**level - 1
                size = x.shape[1] * (BINS + 1)
                at = ((node - low)[:, None] * size + flat).ravel()
                g, h = (np.bincount(at, np.repeat(v, x.shape[1]), 2**level * size).reshape(2**level, x.shape[1], BINS + 1).cumsum(axis=2) for v in (grad, hess))
                gl, hl, gt, ht = g[:, :, :-1], h[:, :, :-1], g[:, :, -1:], h[:, :, -1:]
                gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
                best = gain.reshape(2**level, -1).argmax(axis=1)
                feature[low : 2 * low + 1], cut[low : 2 * low + 1] = best // BINS, best % BINS
                node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > cut[node])
            leaf = node - (2**DEPTH - 1)
            value = RATE * np.bincount(leaf, grad, 2**DEPTH) / (np.bincount(leaf, hess, 2**DEPTH) + RIDGE)
            self.trees.append((feature, cut, value))
            margin += value[leaf]
        return self

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Trees:
        """Isotonic regression (pool adjacent violators) of the labels on the margins."""
        if len(y) < 20 or len(np.unique(y)) < 2:
            return self
        margin = self.margin(x)
        order = np.argsort(margin, kind="stable")
        blocks: list[list[float]] = []  # sum of labels, rows, sum of margins
        for m, v in zip(margin[order], y[order], strict=True):
            blocks.append([float(v), 1.0, float(m)])
            while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
        self.curve = (np.array([b[2] / b[1] for b in blocks]), np.array([(b[0] + 0.05) / (b[1] + 0.1) for b in blocks]))
        return self

    def chance(self, x: np.ndarray) -> np.ndarray:
        """Calibrated chances; a fiftieth comes from the margin itself, which keeps their order."""
        margin = self.margin(x)
        plain = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        return plain if self.curve is None else np.clip(0.98 * np.interp(margin, *self.curve) + 0.02 * plain, 0, 1)


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Trees
    _features: Features | None = None

    def score(self, texts: list[str]) -> list[np.ndarray]:
        if self._features is None:
            self._features = Features(self.lexicon)
        x = np.stack([self._features.of(t) for t in texts]) if texts else np.zeros((0, len(FEATURES)), np.float32)
        return [self.trees.chance(x).astype(np.float64)]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", bound: int = SAMPLE_ROWS) -> Model:
    """Learn from at most `bound` labelled rows. Without labels of both kinds the score is their share, or 0.5."""
    small_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, id_col, text_col, bound)
    by_part = lexicons(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [Features(x) for x in by_part[:PARTS]]
        for batch in slices(batches, 0):
            texts, lots = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            x = [made[lot % PARTS].of(t).tolist() for t, lot in zip(texts, lots, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float32())), batch.column(1), batch.column(2)], names=["x", "y", "lot"])

    rows = sample.select("text", "y", "lot").mapInArrow(run, "x array<float>, y int, lot int").orderBy("lot", "y", "x").toPandas()
    x = np.array(rows["x"].tolist(), np.float32).reshape(-1, len(FEATURES))
    y, lots = rows["y"].to_numpy(np.float64), rows["lot"].to_numpy()
    rest = lots % 4 == 3
    trees = Trees().fit(x[~rest], y[~rest]).calibrate(x[rest], y[rest])
    return Model(by_part[-1], trees)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Score every whole text: id_col, held_out, score (0 to 1), predicted (1 from `threshold` on).

    Null and empty texts are scored as texts without words. Rows are scored each, also those that
    repeat an id; a null id is in no fold. Only id_col and text_col of docs, and id_col and toxic
    of labels, are read. Empty docs give an empty table; empty labels give 0.5 throughout.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, "toxic", id_col, text_col))
    out = scored(docs, id_col, text_col, lambda texts: model.value.score(texts), "score double")
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that score below the threshold; texts are not shuffled."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, "toxic", id_col, text_col))
    whole = docs.select(F.col(text_col).alias("t"), F.struct(*docs.columns).alias("row"))
    out = scored(whole, "row", "t", lambda texts: model.value.score(texts), "score double")
    return out.filter(F.col("score") < threshold).select("row.*")
