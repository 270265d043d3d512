"""Language identification by interpolated Kneser-Ney models of characters, one per language.

The models of all languages lie in sorted arrays of n-gram hashes, with a column for each
language. Characters are predicted inside words, so a word's log chances are found once and
remembered. A text gets the language of least cross-entropy per character.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galena.llm.common import held_out, small_batches, stored
from galena.llm.learning import scored
from galena.llm.rolling import mixed

#: Characters of an n-gram, discount, documents of a language that are learned from, letters known
#: to exist, share of calibration texts that a language's limit rejects.
ORDER, DISCOUNT, SAMPLE_PER_LANGUAGE, LETTERS, REJECTED = 5, 0.75, 1500, 4096, 0.001
#: One in so many sampled documents of a language with at least so many is kept for calibration;
#: languages up to whose number their shares are broadcast; scales of scores that are tried.
APART, LEAST_APART, BROADCAST_LANGUAGES, SCALES = 5, 50, 10_000, tuple(2.0 ** (k / 4) for k in range(-16, 25))
CACHE = 1 << 19
# What counts as a word's sign but is no letter: numbers that are no decimal digits.
_NUMBERS = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if c.isnumeric() and unicodedata.category(c) in ("No", "Nl"))
_WORD, _LETTERS = re.compile(r"[^\W\d_]+"), re.compile(rf"[^\W\d_{''.join(sorted(_NUMBERS))}]+")


def words(text: str) -> list[str]:
    """Runs of letters, in lower case. The exact pattern is slow and used where such numbers occur."""
    text = text.lower()
    plain = text.isascii() or _NUMBERS.isdisjoint(text)
    return (_WORD if plain else _LETTERS).findall(text)


def _laid_out(listed: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Padded code points of the words, the place of each character, and its word."""
    pad = "\x00" * (order - 1)
    data = np.frombuffer("".join(f"{pad}{w}\x01" for w in listed).encode("utf-32-le"), np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(listed)), np.fromiter(map(len, listed), np.int64, len(listed)) + 1)
    return data, np.arange(len(of)) + (of + 1) * (order - 1), of


def _grams(listed: list[str], order: int = ORDER) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the n-grams (n = 1 to order) that end at each character of the words, a word's
    end included, and the word of each character. Contexts never leave the word."""
    data, at, of = _laid_out(listed, order)
    out = [mixed(data[at] + np.uint64(1))]
    for n in range(1, order):
        out.append(mixed(out[-1] * np.uint64(0x9E3779B97F4A7C15) + data[at - n] + np.uint64(n)))
    return out, of


def _contexts(listed: list[str], order: int = ORDER) -> list[np.ndarray]:
    """Hashes of the contexts (1 to order - 1 characters) before each character of the words."""
    data, at, _ = _laid_out(listed, order)
    out, key = [], np.full(len(at), 0x5851F42D4C957F2D, np.uint64)
    for n in range(1, order):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + data[at - n] + np.uint64(n))
        out.append(key)
    return out


@dataclass
class Models:
    """For each n: sorted n-gram hashes with discounted shares, sorted context hashes with the
    weight that is left to the shorter context; a column for each language."""

    languages: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    limits: np.ndarray | None = None
    scale: float = 1.0

    def __post_init__(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.languages)), np.float32)

    def log_chances(self, listed: list[str]) -> np.ndarray:
        """Log chance of each word under each language."""
        grams, of = _grams(listed)
        contexts = _contexts(listed)
        chance = np.full((len(of), len(self.languages)), 1.0 / LETTERS, np.float32)
        for n in range(ORDER):
            if n == 0:
                left = np.broadcast_to(self.contexts[0][1][0], chance.shape)
            else:
                left = _looked_up(self.contexts[n], contexts[n - 1], 1.0)
            chance = _looked_up(self.grams[n], grams[n], 0.0) + left * chance
        return np.add.reduceat(np.log(chance), np.flatnonzero(np.diff(of, prepend=-1)), axis=0)

    def entropies(self, text: str) -> tuple[np.ndarray, int]:
        """Nats per character under each language, and the number of characters (0: no letter)."""
        listed = words(text)
        if not listed:
            return np.zeros(len(self.languages)), 0
        known = self.known
        try:
            ids = np.fromiter(map(known.__getitem__, listed), np.int64, len(listed))
        except KeyError:
            if len(known) > CACHE:
                known.clear()
            new = list(dict.fromkeys(w for w in listed if w not in known))
            at = len(known)
            known.update(zip(new, range(at, at + len(new)), strict=True))
            while len(self.table) < len(known):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[at : len(known)] = self.log_chances(new)
            ids = np.fromiter(map(known.__getitem__, listed), np.int64, len(listed))
        size = sum(map(len, listed)) + len(listed)
        return -self.table[ids].sum(axis=0, dtype=np.float64) / size, size

    def score(self, texts: list[str]) -> list:
        """Language, score (share of the best language's calibrated weight), and whether its
        cross-entropy is beyond the language's limit; `und` where a text has no letter."""
        named: list[str] = []
        score, beyond = np.zeros(len(texts)), np.zeros(len(texts), bool)
        for i, text in enumerate(texts):
            entropy, size = self.entropies(text)
            if not size or not self.languages:
                named.append("und")
                beyond[i] = True
                continue
            best = int(entropy.argmin())
            named.append(self.languages[best])
            score[i] = 1 / np.exp(-(entropy - entropy[best]) * self.scale * np.sqrt(size)).sum()
            beyond[i] = self.limits is not None and entropy[best] > self.limits[best]
        return [named, score, beyond]


def _looked_up(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, otherwise: float) -> np.ndarray:
    have, values = table
    if not len(have):
        return np.full((len(keys), values.shape[1]), otherwise, np.float32)
    at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
    return np.where((have[at] == keys)[:, None], values[at], np.float32(otherwise))


def build(counts: dict[str, dict[str, int]]) -> Models:
    """Interpolated Kneser-Ney models from the word counts of each language."""
    languages = sorted(counts)
    grams: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(ORDER)]
    contexts: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(ORDER)]
    for language in languages:
        listed = sorted(counts[language])
        if not listed:
            for n in range(ORDER):
                grams[n].append((np.zeros(0, np.uint64), np.zeros(0)))
                contexts[n].append((np.zeros(0, np.uint64), np.zeros(0)))
            continue
        number = np.array([counts[language][w] for w in listed], np.float64)
        hashes, of = _grams(listed)
        before = [np.zeros(len(of), np.uint64), *_contexts(listed)]
        weight = number[of]
        for n in range(ORDER):
            keys, first, at = np.unique(hashes[n], return_index=True, return_inverse=True)
            if n == ORDER - 1:
                count = np.bincount(at, weight)
            else:  # in how many longer n-grams it is found
                longer, one = np.unique(hashes[n + 1], return_index=True)
                count = np.bincount(at[one], minlength=len(keys)).astype(np.float64)
            heads, where = np.unique(before[n][first], return_inverse=True)
            total = np.bincount(where, count)
            kinds = np.bincount(where)
            grams[n].append((keys, np.maximum(count - DISCOUNT, 0) / total[where]))
            contexts[n].append((heads, np.minimum(DISCOUNT * kinds / total, 1.0)))
    merged = []
    for tables, otherwise in ((grams, 0.0), (contexts, 1.0)):
        rows = []
        for by_language in tables:
            keys = np.unique(np.concatenate([k for k, _ in by_language])) if by_language else np.zeros(0, np.uint64)
            values = np.full((len(keys), len(languages)), otherwise, np.float32)
            for j, (k, v) in enumerate(by_language):
                values[np.searchsorted(keys, k), j] = v
            rows.append((keys, values))
        merged.append(rows)
    return Models(languages, *merged)


def calibrated(models: Models, found: list[tuple[str, int, list[float]]]) -> Models:
    """Set limits and scale from texts that the counts do not hold: each one's language, number of
    characters and entropies. The scale makes the scores of the right languages likeliest."""
    limits = np.full(len(models.languages), np.inf)
    if found:
        right = np.array([models.languages.index(x) for x, _, _ in found])
        entropy = np.array([e for _, _, e in found])
        for j in range(len(limits)):
            if (right == j).any():
                limits[j] = np.quantile(entropy[right == j, j], 1 - REJECTED)
        beyond = (entropy - entropy.min(axis=1, keepdims=True)) * np.sqrt([n for _, n, _ in found])[:, None]
        rows = np.arange(len(right))
        chance = [-(beyond[rows, right] * s + np.log(np.exp(-beyond * s).sum(axis=1))).mean() for s in SCALES]
        models.scale = SCALES[int(np.argmax(chance))]
    models.limits = limits
    return models


def fit(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", bound: int = SAMPLE_PER_LANGUAGE) -> Models:
    """Learn from about `bound` documents of each language outside the held-out fold, chosen by a
    hash of the id. Word counts are summed on the executors, and the counts and the calibration
    texts' entropies come to the driver: as much as `bound` documents of every language give."""
    small_batches(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    known = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    # A share of each language by hash: texts are left out where they are read, and none is shuffled.
    mark = F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")))
    share = known.groupBy("lang").agg(F.count("*").alias("n")).select("lang", "n", (F.least(F.lit(1.0), F.lit(float(bound)) / F.col("n")) * 1_000_000).alias("cut"))
    share = stored(share, "shares")
    few = share.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES
    chosen = known.join(F.broadcast(share) if few else share.hint("merge"), "lang").filter(F.pmod(mark, F.lit(1_000_000)) < F.col("cut"))
    apart = (F.least("n", F.lit(bound)) >= LEAST_APART) & (F.pmod(F.xxhash64(mark), F.lit(APART)) == 0)
    sample = stored(chosen.select("text", "lang", apart.alias("apart")), "languages")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, str], int] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in words(text):
                    found[lang, w] = found.get((lang, w), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"])

    learned = sample.filter("not apart").select("text", "lang")
    counts: dict[str, dict[str, int]] = {r["lang"]: {} for r in learned.select("lang").distinct().collect()}
    for r in learned.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["lang"]][r["word"]] = r["n"]
    models = build(counts)
    if not models.languages:
        return models
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            got = [(lang, n, e.tolist()) for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for e, n in [model.entropies(text)] if n and lang in model.languages]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.list_(pa.float64()))], names=["lang", "n", "entropies"])

    measured = sample.filter("apart").select("text", "lang").mapInArrow(measure, "lang string, n long, entropies array<double>").orderBy("lang", "n", "entropies")
    out = calibrated(models, [tuple(r) for r in measured.collect()])
    shared.unpersist()
    return out


def languages(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The language of every whole text: id_col, held_out, lang_pred, score (0 to 1), rejected.

    lang_pred is `und`, with score 0, where a text is null or has no letter, or where no language
    could be learned. rejected marks those, and texts whose cross-entropy is beyond what nearly
    all calibration texts of the language have. Rows are judged each, also those that repeat an id.
    Other columns are not read; an empty table gives an empty table.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, lang_col, id_col, text_col))
    out = scored(docs, id_col, text_col, lambda texts: model.value.score(texts), "lang_pred string, score double, rejected boolean")
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score", "rejected")
