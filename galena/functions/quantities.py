"""Quantities in text: signed numbers under a language's marks, in units that convert into one another.

A quantity is a value in the base unit of its dimension. Units of no known dimension are dimensions of
their own, so that five of one thing are never five of another.
"""

from __future__ import annotations

import re
from decimal import Decimal, InvalidOperation

#: Decimal mark and group marks by language.
_DOT, _COMMA, _COMMA_SPACE = (".", ","), (",", "."), (",", "   ")
POLICIES = {"en": _DOT, "zh": _DOT, "de": _COMMA, "es": _COMMA, "pt": _COMMA, "it": _COMMA, "tr": _COMMA, "el": _COMMA, "kk": _COMMA_SPACE, "ru": _COMMA_SPACE, "fr": _COMMA_SPACE}

#: Powers of ten of the prefixes of metric symbols.
PREFIXES = {"n": -9, "µ": -6, "μ": -6, "u": -6, "m": -3, "c": -2, "d": -1, "": 0, "k": 3}
#: Metric symbols: the base unit of their dimension, and how many of it one has.
METRIC = {"g": ("mg", "1000"), "l": ("ml", "1000"), "m": ("m", "1"), "s": ("s", "1"), "W": ("W", "1"), "Wh": ("Wh", "1"), "V": ("V", "1"), "A": ("A", "1"), "Hz": ("Hz", "1"), "J": ("J", "1")}
# Names of units by base unit and factor, and of currencies.
NAMES = {
    ("mg", "0.001"): "mcg мкг 微克",
    ("mg", "1"): "milligram мг 毫克",
    ("mg", "1000"): "gram gramm gramme gramo г грамм 克",
    ("mg", "1000000"): "kilo kilogram kilogramm kilogramo кг килограмм 千克 公斤",
    ("mg", "1000000000"): "t tonne ton т тонна тонн 吨",
    ("mg", "28349.523125"): "oz ounce",
    ("mg", "453592.37"): "lb lbs pound",
    ("ml", "1"): "cc millilitre milliliter мл 毫升",
    ("ml", "1000"): "litre liter litro л литр литров 升",
    ("m", "1"): "metre meter metro mètre м метр метров 米",
    ("m", "0.01"): "см 厘米",
    ("m", "0.001"): "мм 毫米",
    ("m", "1000"): "kilometre kilometer kilómetro kilomètre км 千米 公里",
    ("m", "0.0254"): "inch inches",
    ("m", "0.3048"): "ft foot feet",
    ("m", "0.9144"): "yard",
    ("m", "1609.344"): "mile mi",
    ("s", "1"): "sec second sekunde sekunden segundo seconde сек секунда секунды секунд 秒",
    ("s", "60"): "min minute minuten minuto мин минута минуты минут 分钟",
    ("s", "3600"): "h hr hour stunde stunden hora heure ч час часа часов 小时",
    ("s", "86400"): "day tag tage tagen día dia jour день дня дней күн 天",
    ("s", "604800"): "week woche wochen semana semaine неделя недели недель апта 周",
    ("month", "1"): "month monat monate monaten mes meses mois месяц месяца месяцев ай 个月",
    ("month", "12"): "year jahr jahre jahren año an год года лет жыл 年",
    ("%", "1"): "% percent prozent pourcent процент процента процентов",
    ("%", "0.1"): "‰",
    ("°", "1"): "° degree grad grado degré градус градуса градусов",
    ("°C", "1"): "°c celsius",
    ("°F", "1"): "°f fahrenheit",
    ("USD", "1"): "$ usd dollar",
    ("EUR", "1"): "€ eur euro",
    ("GBP", "1"): "£ gbp",
    ("JPY", "1"): "¥ jpy yen",
    ("CHF", "1"): "chf",
    ("CNY", "1"): "cny rmb yuan",
    ("KZT", "1"): "₸ kzt тенге",
    ("RUB", "1"): "₽ rub рубль рубля рублей",
    ("INR", "1"): "₹ inr",
    ("TRY", "1"): "₺ try",
}
# Words behind a number that are no unit of it.
NO_UNITS = frozenset("a about above after all also and any are as at be because before below but by can does during each every for from had has have he her his how if in into is it its least less many may more most must no not now of off on once one only or other our out over per she should since so some still such than that the their them then there these they this those through to too under until up upon was we were what when where which while who will with would you your und oder der die das den dem des ein eine für mit von zu auf bei et ou le la les de du des un une pour avec dans sur y o el los las por con para en e или и в на с из до за по от не".split())


def _units() -> dict[str, tuple[str, Decimal]]:
    out = {p + s: (base, Decimal(n).scaleb(power)) for s, (base, n) in METRIC.items() for p, power in PREFIXES.items()}
    for (base, n), names in NAMES.items():
        for name in names.split():
            out[name] = base, Decimal(n)
    return out


UNITS = _units()
_SIGNS = "".join(sorted({n for n in UNITS if len(n) == 1 and not n.isalnum()} - {"%", "‰", "°"}))
_MARK = "[.,   ]"
_NUMBER = rf"\d+(?:{_MARK}?\d+)*"
_QUANTITY = re.compile(rf"(?<![\w])(?:(?P<before>[{_SIGNS}]|\b[A-Z]{{3}}\b(?=\s?\d))\s?)?(?P<sign>(?<![\w.,)])[-+−])?(?P<before2>[{_SIGNS}])?(?P<number>{_NUMBER})(?:\s?(?P<unit>[%‰{_SIGNS}]|°(?:\s?[CFcf]\b)?|[^\W\d_]+(?:/[^\W\d_]+)?))?")
_BETWEEN = re.compile(r"\s?(?:[-–—]|to|bis|до)\s?")


def number(raw: str, language: str) -> Decimal | None:
    """The value under the language's marks; null if they are used otherwise."""
    policy = POLICIES.get(language)
    if policy is None:
        return Decimal(raw) if raw.isdigit() else None
    decimal, groups = policy
    whole, _, part = raw.partition(decimal)
    if decimal in part or (part and not part.isdigit()):
        return None
    pieces = re.split(r"[" + re.escape(groups) + "  ]", whole)
    if not all(p.isdigit() for p in pieces) or (len(pieces) > 1 and (any(len(p) != 3 for p in pieces[1:]) or not 1 <= len(pieces[0]) <= 3)):
        return None
    try:
        return Decimal("".join(pieces) + (f".{part}" if part else ""))
    except InvalidOperation:
        return None


def unit(word: str | None) -> tuple[str, Decimal]:
    """Base unit and factor of a word behind a number. A word that is no unit counts as a thing of its own,
    without a plural s; a word that joins sentences counts as none."""
    if not word:
        return "", Decimal(1)
    word = word.replace(" ", "")
    low = word.lower()
    for name in (word, low, low.removesuffix("es"), low.removesuffix("s")):
        if name in UNITS:
            return UNITS[name]
    if "/" in low:
        (top, a), (bottom, b) = unit(word.split("/")[0]), unit(word.split("/")[1])
        return f"{top}/{bottom}", a / b
    if low in NO_UNITS:
        return "", Decimal(1)
    return (low[:-1] if len(low) > 3 and low.endswith("s") and not low.endswith("ss") else low), Decimal(1)


def parsed(text: str, language: str) -> list[tuple[int, Decimal | None, str, str]]:
    """(place, value, unit, bound) of a text's quantities, in order. The value is in the base unit, and null
    where its marks are ambiguous or a unit stands on both sides and these differ. Both ends of a range
    have its unit; their bound is MIN and MAX, else empty."""
    found = [*_QUANTITY.finditer(text)]
    units = [m["unit"] for m in found]
    bounds = [""] * len(found)
    for i in range(len(found) - 2, -1, -1):
        a, b = found[i], found[i + 1]
        gap = text[a.end("number") : b.start("number")]
        if _BETWEEN.fullmatch(gap):
            units[i], bounds[i], bounds[i + 1] = units[i + 1], "MIN", "MAX"
    out = []
    for m, word, bound in zip(found, units, bounds, strict=True):
        value, (base, factor) = number(m["number"], language), unit(word)
        before = m["before2"] or m["before"]
        if before:
            other, more = unit(before)
            known = before in UNITS or before.lower() in UNITS
            if known and (not base or word.lower() not in UNITS):
                base, factor = other, more
            elif known and other != base:
                value = None
        if value is not None:
            value = value * factor * (-1 if m["sign"] in ("-", "−") else 1)
        out.append((m.start("number"), value, base, bound))
    return out


def shown(value: Decimal | None) -> str | None:
    """A value as plain digits without trailing zeros."""
    if value is None:
        return None
    text = format(value.normalize(), "f")
    return "0" if text in ("-0", "0") else text
