"""Token estimates from classes of code points, one table for column functions and for chunking."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Classes, and what a code point of each weighs, in hundredths of a token.
SPACE, IDEOGRAPH, CYRILLIC_GREEK, WORD, SYMBOL, OTHER = range(6)
WEIGHTS = np.array([5, 100, 38, 30, 100, 45], np.int64)
#: A margin of a twentieth, as estimate = ceil(hundredths * 105 / 10000); code points at once.
MARGIN, WHOLE, AT_ONCE = 105, 10_000, 1 << 20


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point: ASCII white space, scripts by the names of the letters."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    out[0x10000:] = SYMBOL
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))
        if kind == "So":
            out[c] = SYMBOL
        elif kind[0] == "L" or kind in ("Nd", "Nl"):
            script = unicodedata.name(chr(c), "").split(" ", 1)[0]
            if script in ("CJK", "HIRAGANA", "KATAKANA", "HANGUL"):
                out[c] = IDEOGRAPH
            elif kind != "Nl":
                out[c] = CYRILLIC_GREEK if script in ("CYRILLIC", "GREEK") else WORD
    out[[9, 10, 11, 12, 13, 32]] = SPACE
    return out


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def sums(text: str) -> np.ndarray:
    """Hundredths of tokens before each code point of a text, and after the last."""
    out = np.zeros(len(text) + 1, np.int64)
    np.cumsum(WEIGHTS[classes()[points(text)]], out=out[1:])
    return out


def tokens(hundredths: int) -> int:
    return max(1, -(-hundredths * MARGIN // WHOLE))


def estimate(text: str) -> int:
    """Estimated model tokens: weighted code points and the margin, at least 1; blank texts 0."""
    found = classes()[points(text)]
    return tokens(int(WEIGHTS[found].sum())) if (found != SPACE).any() else 0


def _runs(texts: list[str]) -> Iterator[list[str]]:
    run: list[str] = []
    size = 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= AT_ONCE:
            yield run
            run, size = [], 0
    if run:
        yield run


def estimates(texts: list[str]) -> np.ndarray:
    """The estimate of each text."""
    table, out = classes(), []
    for run in _runs(texts):
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in run])])
        found = table[points("".join(run))]
        weighed, filled = (np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[bounds] for x in (WEIGHTS[found], found != SPACE))
        out.append(np.where(np.diff(filled) > 0, np.maximum(1, -(-np.diff(weighed) * MARGIN // WHOLE)), 0))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


@F.pandas_udf(T.LongType())
def token_estimate(text: pd.Series) -> pd.Series:
    """The estimate as a column function; null for a null text."""
    filled = text.notna()
    out = pd.Series(estimates(text.fillna("").tolist()), index=text.index, dtype="Int64")
    return out.where(filled)
