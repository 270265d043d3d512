"""Citations and numeric claims of answers, and whether the evidence bears them."""

from __future__ import annotations

import re
from datetime import date

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galena.functions.quantities import POLICIES, parsed, shown

CITATION = r"\[SOURCE (\d+)\]"


def citations(answer: Column, sources: Column) -> Column:
    """Distinct valid source numbers (1 to `sources`) in order."""
    found = F.transform(F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1)), lambda n: n.try_cast("int"))
    return F.array_distinct(F.filter(found, lambda n: n.isNotNull() & (n >= 1) & (n <= sources)))


def without_invalid_citations(answer: Column, sources: Column) -> Column:
    numbers = F.array_distinct(F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1)))
    bad = F.filter(numbers, lambda n: n.try_cast("int").isNull() | (n.try_cast("int") < 1) | (n.try_cast("int") > sources))
    return F.trim(F.aggregate(bad, answer, lambda acc, n: F.replace(acc, F.concat(F.lit("[SOURCE "), n, F.lit("]")), F.lit(""))))


def quantities(text: str, language: str) -> list[tuple[str | None, str]]:
    """(value, unit) of a text's quantities in order, in base units; the value is null where it is ambiguous."""
    return [(shown(value), unit) for _, value, unit, _ in parsed(text or "", language)]


_CLAIMS = T.ArrayType(T.StructType([T.StructField("value", T.StringType()), T.StructField("unit", T.StringType())]))


@F.pandas_udf(_CLAIMS)
def numeric_claims(text: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([quantities(t, lang) for t, lang in zip(text, language, strict=True)])


def in_order(claims: Column, evidence: Column) -> Column:
    """Whether all claims stand in the evidence in their order; an ambiguous claim never does."""
    whole = F.forall(claims, lambda c: c["value"].isNotNull())
    step = F.aggregate(evidence, F.lit(0), lambda at, e: at + F.when(F.try_element_at(claims, at + 1).eqNullSafe(e), 1).otherwise(0))
    return whole & (step == F.size(claims))


# What is said where no answer is possible, by language.
FALLBACKS = {"en": "No sufficient information was found.", "ru": "Достаточной информации не найдено.", "kk": "Жеткілікті ақпарат табылмады.", "de": "Es wurden keine ausreichenden Informationen gefunden.", "fr": "Aucune information suffisante n'a été trouvée.", "es": "No se encontró información suficiente."}


def fallback_message(language: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in FALLBACKS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, language), F.lit(FALLBACKS["en"]))


# Words that make a number a bound, and names of months.
ROLES = {"MIN": ("at least", "minimum", "not less than", "mindestens", "au moins", "al menos", "не менее", "минимум"), "MAX": ("at most", "maximum", "no more than", "not exceed", "höchstens", "au plus", "como máximo", "не более", "максимум")}
#: Code points before a number in which a word of its role is looked for.
REACH = 48
_ISO_DATE = re.compile(r"\b(\d{4})-(\d{2})-(\d{2})\b")
_MARKED_DATE = re.compile(r"\b(\d{1,2})([./])(\d{1,2})\2(\d{4})\b")
_SENTENCE = re.compile(r"[^.!?…]+(?:[.!?…](?!\s|$)[^.!?…]*)*[.!?…]*\s*(?:\[SOURCE \d+\]\s*)*")
_CITED = re.compile(r"\[SOURCE (\d+)\]")


def _role(text: str, start: int) -> str:
    """The role whose word stands nearest before a place."""
    before = text[max(0, start - REACH) : start].lower()
    found = {role: max(before.rfind(w) for w in words) for role, words in ROLES.items()}
    best = max(found, key=found.get)
    return best if found[best] >= 0 else ""


def dates(text: str, language: str) -> list[tuple[int, int, str | None]]:
    """(start, end, date) of a text's dates. The month comes first only with slashes in English; a date
    that does not exist, or that could be read both ways in an unknown language, is null."""
    out: list[tuple[int, int, str | None]] = []

    def valid(y: int, m: int, d: int) -> str | None:
        try:
            return date(y, m, d).isoformat()
        except ValueError:
            return None

    out.extend((m.start(), m.end(), valid(int(m[1]), int(m[2]), int(m[3]))) for m in _ISO_DATE.finditer(text))
    for m in _MARKED_DATE.finditer(text):
        a, b, year = int(m[1]), int(m[3]), int(m[4])
        if language not in POLICIES and a != b and a <= 12 and b <= 12:
            out.append((m.start(), m.end(), None))
        else:
            month_first = (m[2] == "/" and language == "en") or (language not in POLICIES and b > 12)
            out.append((m.start(), m.end(), valid(year, a, b) if month_first else valid(year, b, a)))
    return sorted(out)


def claims(text: str | None, language: str) -> list[tuple[str | None, str, str]]:
    """(value, unit, role) of a text's quantities and dates, in order: values in base units, MIN or MAX for the
    ends of a range and behind words that say so; a date's unit is `date`. Marks of citations are no claims."""
    plain = _CITED.sub(lambda m: " " * len(m[0]), text or "")
    found = [(a, value, "date", "") for a, _, value in dates(plain, language)]
    masked = plain
    for a, b, _ in dates(plain, language):
        masked = masked[:a] + " " * (b - a) + masked[b:]
    found += [(at, shown(value), unit, bound) for at, value, unit, bound in parsed(masked, language)]
    return [(value, unit, bound or _role(plain, at)) for at, value, unit, bound in sorted(found, key=lambda x: x[0])]


def follows(wanted: list, there: list) -> bool:
    """Whether all of `wanted` stand in `there` in their order; an ambiguous claim never does."""
    rest = iter(there)
    return all(w[0] is not None and any(w == t for t in rest) for w in wanted)


def verified(answer: str, language: str, sources: list[str]) -> tuple[str, int, int, int]:
    """(status, sentences, missing, mismatched) of an answer: every sentence with words needs a valid
    citation, and its numbers must stand, in order, in one source that it cites."""
    bodies = [claims(s, language) for s in sources]
    number = missing = wrong = 0
    for m in _SENTENCE.finditer(answer or ""):
        plain = _CITED.sub("", m[0])
        if not any(c.isalnum() for c in plain):
            continue
        number += 1
        cited = {int(n) for n in _CITED.findall(m[0])} & set(range(1, len(sources) + 1))
        wanted = claims(plain, language)
        if not cited:
            missing += 1
        elif wanted and not any(follows(wanted, bodies[n - 1]) for n in cited):
            wrong += 1
    return ("GROUNDED" if number and not missing and not wrong else "UNGROUNDED"), number, missing, wrong


_VERDICT = T.StructType([T.StructField("status", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in ("sentences", "missing", "mismatched")]])


@F.pandas_udf(_VERDICT)
def verdict(answer: pd.Series, language: pd.Series, sources: pd.Series) -> pd.DataFrame:
    """`verified` as a column function; sources is an array of texts."""
    rows = [verified(a, lang or "", [] if s is None else [x or "" for x in s]) for a, lang, s in zip(answer, language, sources, strict=True)]
    return pd.DataFrame(rows, columns=[f.name for f in _VERDICT.fields])


def entailment_verdict(labels: Column) -> Column:
    """What an entailment model's labels of the sentences mean: one contradiction rejects the answer, and
    all must be supported."""
    return F.when(F.exists(labels, lambda x: x == "CONTRADICTED"), "REJECTED").when((F.size(labels) > 0) & F.forall(labels, lambda x: x == "SUPPORTED"), "GROUNDED").otherwise("INSUFFICIENT")
