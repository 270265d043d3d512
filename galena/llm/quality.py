"""Quality classifier: random-indexing word vectors pooled per document, then a small network.

Every unit (a word, or the signs at a word's end) has a sparse ternary index vector. Its context
vector is the sum of the index vectors of its neighbours over all documents. The units that the
labelled sample holds most often have vectors of their own; all others share those of hash
buckets. A document is the mean and the spread of its units' vectors; a two-layer network scores
it, and its chances are calibrated by a temperature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.llm.common import held_out, slices, small_batches
from galena.llm.learning import SAMPLE_ROWS, labelled_sample, scored

#: Units with own vectors, hash buckets of all others, dimensions, non-zero places of an index
#: vector, neighbours on each side.
OWN, BUCKETS, DIMS, PLACES, REACH = 1 << 14, 1 << 13, 32, 4, 2
ROWS = OWN + BUCKETS
HIDDEN, EPOCHS, BATCH, STEP, DECAY, SEED = 32, 60, 128, 3e-3, 1e-4, 7
THRESHOLD, CACHE, UNITS_AT_ONCE = 0.7, 1 << 18, 1 << 18


def index_vectors() -> np.ndarray:
    """The ternary index vector of each row of the table, from a fixed random stream."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((ROWS, DIMS), np.int16)
    for row in out:
        at = rng.permutation(DIMS)[:PLACES]
        row[at] = (1, 1, -1, -1)
    return out


def split_token(token: str) -> tuple[str, str]:
    """A token's word and the signs behind it, marked. Words in capitals are units of their own."""
    b = len(token)
    while b and not token[b - 1].isalnum():
        b -= 1
    word, signs = token[:b], token[b:]
    return word if len(word) > 1 and word.isupper() else word.lower(), f"~{signs}" if signs else ""


class Units:
    """Rows of the units of texts. own: the units with rows of their own, in order."""

    def __init__(self, own: list[str]) -> None:
        self.known: dict[str, int] = {}
        self.own = {u: i for i, u in enumerate(own)}

    def _row(self, unit: str) -> int:
        if not unit:
            return -1
        at = self.own.get(unit)
        return OWN + xxhash.xxh64_intdigest(unit.encode()) % BUCKETS if at is None else at

    def _code(self, token: str) -> int:
        first, second = map(self._row, split_token(token))
        return (first + 1) * (ROWS + 1) + second + 1

    def of(self, text: str) -> np.ndarray:
        tokens = text.split()
        try:
            codes = np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))
        except KeyError:
            if len(self.known) > CACHE:
                self.known.clear()
            for token in tokens:
                if token not in self.known:
                    self.known[token] = self._code(token)
            codes = np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))
        both = np.stack([codes // (ROWS + 1), codes % (ROWS + 1)], axis=1).ravel() - 1
        return both[both >= 0]


def _neighbour_sums(units: np.ndarray, breaks: np.ndarray, index: np.ndarray, out: np.ndarray) -> None:
    """Add to out the index vectors of each unit's neighbours; breaks end the texts."""
    vectors = index[units]
    text = np.repeat(np.arange(len(breaks)), np.diff(np.concatenate([[0], breaks])))
    total = np.zeros((len(units), DIMS), np.int16)
    for d in range(1, REACH + 1):
        same = (text[d:] == text[:-d])[:, None]
        total[d:] += vectors[:-d] * same
        total[:-d] += vectors[d:] * same
    for k in range(DIMS):
        out[:, k] += np.bincount(units, total[:, k], ROWS)


def frequent_units(sample: DataFrame) -> list[str]:
    """The OWN units that most texts of the sample hold; ties by the unit. Units of one text are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            found: dict[str, int] = {}
            for text in batch.column(0).to_pylist():
                for unit in {u for token in set(text.split()) for u in split_token(token) if u}:
                    found[unit] = found.get(unit, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["unit", "n"])

    counted = sample.select("text").mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    return [r["unit"] for r in counted.filter("n > 1").orderBy(F.desc("n"), "unit").limit(OWN).collect()]


def context_sums(docs: DataFrame, own: list[str], text_col: str = "text") -> np.ndarray:
    """Context vectors of all units over all documents: a table of ROWS rows, whatever the input."""
    shared = docs.sparkSession.sparkContext.broadcast(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, index, out = Units(shared.value), index_vectors(), np.zeros((ROWS, DIMS))
        for batch in slices(batches, 0):
            held: list[np.ndarray] = []
            size = 0
            for text in [*batch.column(0).to_pylist(), None]:
                if text is not None:
                    held.append(units.of(text))
                    size += len(held[-1])
                if held and (text is None or size >= UNITS_AT_ONCE):
                    _neighbour_sums(np.concatenate(held), np.cumsum([len(x) for x in held]), index, out)
                    held, size = [], 0
        used = np.flatnonzero(out.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *[pa.array(out[used, k].astype(np.int64)) for k in range(DIMS)]], names=["bucket", *sums])

    sums = [f"s{k}" for k in range(DIMS)]
    source = docs.filter(F.col(text_col).isNotNull()).select(F.col(text_col).cast("string"))
    parts = source.mapInArrow(run, "bucket int, " + ", ".join(f"{s} long" for s in sums))
    rows = parts.groupBy("bucket").agg(*[F.sum(s).alias(s) for s in sums]).toPandas()
    table = np.zeros((ROWS, DIMS))
    table[rows["bucket"].to_numpy(np.int64)] = rows[sums].to_numpy(np.float64)
    return table


def word_vectors(contexts: np.ndarray) -> np.ndarray:
    """Unit vectors: contexts without their common direction, beside each row's own index vector."""
    centred = contexts - contexts.sum(axis=0) / max(1.0, np.abs(contexts).sum()) * np.abs(contexts).sum(axis=1, keepdims=True)
    size = np.linalg.norm(centred, axis=1, keepdims=True)
    return np.concatenate([centred / np.maximum(size, 1.0), index_vectors() / PLACES**0.5], axis=1).astype(np.float32)


def pooled(units: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the units' vectors, and the logarithm of their number."""
    n = len(units)
    if not n:
        return np.zeros(4 * DIMS + 1, np.float32)
    counts = np.bincount(units, minlength=0)
    used = np.flatnonzero(counts)
    share = (counts[used] / n).astype(np.float32)
    rows = vectors[used]
    mean = share @ rows
    return np.concatenate([mean, np.sqrt(np.maximum(share @ rows**2 - mean**2, 0)), [np.log1p(n)]]).astype(np.float32)


@dataclass
class Network:
    """Two layers, fitted by Adam; inputs are standardised, chances divided by a temperature."""

    shift: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    temperature: float = 1.0
    constant: float | None = None

    def logit(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.weights
        return np.maximum((x - self.shift) / self.scale @ w1 + b1, 0) @ w2 + b2[0]

    def chance(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, rest: np.ndarray) -> Network:
    """Fit on the rows outside `rest`; the temperature is the best of a grid on those inside."""
    rng = np.random.default_rng(SEED)
    wide = x.shape[1]
    fit_x, fit_y = x[~rest], y[~rest]
    if len(np.unique(fit_y)) < 2:
        return Network(np.zeros(wide), np.ones(wide), [], constant=float(y.mean()) if len(y) else 0.5)
    net = Network(fit_x.mean(axis=0), fit_x.std(axis=0) + 1e-3, [rng.normal(0, wide**-0.5, (wide, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)])
    z = (fit_x - net.shift) / net.scale
    first, second = [np.zeros_like(w) for w in net.weights], [np.zeros_like(w) for w in net.weights]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(z))
        for at in range(0, len(z), BATCH):
            rows = order[at : at + BATCH]
            w1, b1, w2, b2 = net.weights
            inner = z[rows] @ w1 + b1
            hidden = np.maximum(inner, 0)
            wrong = (1 / (1 + np.exp(-np.clip(hidden @ w2 + b2[0], -40, 40))) - fit_y[rows]) / len(rows)
            back = np.outer(wrong, w2) * (inner > 0)
            grads = [z[rows].T @ back + DECAY * w1, back.sum(axis=0), hidden.T @ wrong + DECAY * w2, np.array([wrong.sum()])]
            step += 1
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                net.weights[k] = net.weights[k] - STEP * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    if rest.sum() >= 20:
        logit, truth = net.logit(x[rest]), y[rest]
        losses = [(float(np.mean(np.logaddexp(0, logit / t) - truth * logit / t)), t) for t in np.geomspace(0.25, 8, 41)]
        net.temperature = min(losses)[1]
    return net


@dataclass
class Model:
    own: list[str]
    vectors: np.ndarray
    network: Network
    _units: Units | None = None

    def score(self, texts: list[str]) -> list[np.ndarray]:
        if self._units is None:
            self._units = Units(self.own)
        x = np.stack([pooled(self._units.of(t), self.vectors) for t in texts]) if texts else np.zeros((0, 4 * DIMS + 1))
        return [self.network.chance(x).astype(np.float64)]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", bound: int = SAMPLE_ROWS) -> Model:
    """Word vectors from all texts (their labels play no part), the network from at most `bound` labelled rows."""
    small_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, id_col, text_col, bound)
    own = frequent_units(sample)
    vectors = word_vectors(context_sums(docs, own, text_col))
    shared = docs.sparkSession.sparkContext.broadcast((own, vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, table = shared.value
        units = Units(listed)
        for batch in slices(batches, 0):
            x = [pooled(units.of(t), table) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float32())), batch.column(1), batch.column(2)], names=["x", "y", "lot"])

    rows = sample.select("text", "y", "lot").mapInArrow(run, "x array<float>, y int, lot int").orderBy("lot", "y", "x").toPandas()
    x = np.stack(rows["x"].tolist()).astype(np.float64) if len(rows) else np.zeros((0, 4 * DIMS + 1))
    return Model(own, vectors, train(x, rows["y"].to_numpy(np.float64), rows["lot"].to_numpy() % 5 == 4))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Score every whole text: id_col, held_out, score (0 to 1), predicted (1 from `threshold` on).

    Null and empty texts are scored as texts without units. Rows are scored each, also those that
    repeat an id; a null id is in no fold. Only id_col and text_col of docs, and id_col and quality
    of labels, are read. Empty docs give an empty table; without labels of both kinds every score
    is the labels' mean, or 0.5.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, "quality", id_col, text_col))
    out = scored(docs, id_col, text_col, lambda texts: model.value.score(texts), "score double")
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
