"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galena.functions.tokens import token_estimate  # noqa: F401


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition, which Spark's own functions lack."""
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normalized(text: Column) -> Column:
    """Line breaks as LF, runs of blanks as one, at most one empty line, no white space around."""
    breaks = F.regexp_replace(text, r"\r\n?", "\n")
    return strip(F.regexp_replace(F.regexp_replace(breaks, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def lexical(text: Column) -> Column:
    """Lower-case letters and digits with one space between their runs."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(lexical(text), " "), "")


def contains_phrase(text: Column, phrase: Column) -> Column:
    """Whether a lexical text holds a lexical phrase of whole words."""
    space = F.lit(" ")
    return F.contains(F.concat(space, text, space), F.concat(space, phrase, space)) & (phrase != "")


def token_upper_bound(text: Column) -> Column:
    """A byte-level tokenizer makes no more tokens than there are bytes."""
    return F.octet_length(text)


def search_terms(text: Column, most: int = 8) -> Column:
    """Distinct lower-case terms of three letters or more without punctuation at their ends."""
    parts = F.transform(F.split(F.lower(text), r"\s+"), lambda t: F.regexp_replace(t, r"^\p{Punct}+|\p{Punct}+$", ""))
    return F.slice(F.array_distinct(F.filter(parts, lambda t: F.char_length(t) >= 3)), 1, most)


def embedding_text(title: Column, domain: Column, language: Column, section: Column, text: Column) -> Column:
    return F.trim(F.concat(F.lit("Document: "), title, F.lit("\nDomain: "), domain, F.lit("\nLanguage: "), language, F.lit("\nSection: "), F.coalesce(section, F.lit("")), F.lit("\n\n"), text))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the words, each padded by two blanks in front and one behind."""
    words = F.array_distinct(tokens(text))
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams among all trigrams of two trigram sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def word_similarity(query: Column, text: Column) -> Column:
    """Share of the query's trigrams that the text holds."""
    return F.when(F.size(query) > 0, F.size(F.array_intersect(query, text)) / F.size(query)).otherwise(0.0)
