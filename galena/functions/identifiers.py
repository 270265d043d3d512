"""Business identifiers and cross references in text."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The words of each type of identifier.
TYPES = {
    "CONTRACT_NUMBER": "договор(?:а|у|ом|е|ы|ов)?|contract",
    "ORDER_NUMBER": "заказ(?:а|у|ом|е|ы|ов)?|order",
    "INVOICE_NUMBER": "сч[её]т|invoice",
    "APPLICATION_NUMBER": "заявк(?:а|и)|application",
    "CASE_NUMBER": "дел(?:о|а|у|ом|е)|case",
    "DOCUMENT_NUMBER": "документ(?:а|у|ом|е|ы|ов)?|document",
}
# What a text holds, cases folded, wherever the words of TYPES, REFERENCES and NAMED_OBJECTS can fit; as it stands, for EXTERNAL.
TYPE_STEMS = {"CONTRACT_NUMBER": "договор contract", "ORDER_NUMBER": "заказ order", "INVOICE_NUMBER": "счет счёт invoice", "APPLICATION_NUMBER": "заявк application", "CASE_NUMBER": "дел case", "DOCUMENT_NUMBER": "документ document"}
REFERENCE_STEMS = {"ARTICLE": "artic art. artik artíc artig madde стат ст. бап άρθρ", "CLAUSE": "clause", "PARAGRAPH": "paragraphe apartado comm fikra пункт п. тармақ παράγραφο", "SUBPARAGRAPH": "тармақша", "SECTION": "sec abschnitt seç sezion bölüm раздел ενότητ", "CHAPTER": "chapter kapitel chapitre capítulo capitol глав κεφάλαι", "PART": "part teil част kisim μέρ"}
OBJECT_STEMS = {"APPENDIX": "appendix annex anhang anlage anexo allegato приложени", "TABLE": "tabl tabel таблиц", "FIGURE": "figur fig. abbildung рисун"}
EXTERNAL_STEMS = {"STANDARD": "ISO IEC EN DIN ГОСТ", "RFC": "RFC", "LAW": "Regulation Directive"}
#: Signs that patterns take for another one's lower case, though their own is not.
_FOLDS = {"İ": "i"} | {c: x for c in map(chr, range(0x80, 0x3000)) if (x := c.upper().lower()) != c.lower() and len(c.upper()) == len(x) == 1}
#: Bits of a text's marks: the kinds of patterns that it can hold words of, UNIT for a rule of its class.
MARKS = {kind: 1 << i for i, kind in enumerate([*TYPE_STEMS, *REFERENCE_STEMS, *OBJECT_STEMS, *EXTERNAL_STEMS, "CHINESE", "UNIT"])}
_FOLDED = [(MARKS[kind], stems.split()) for group in (TYPE_STEMS, REFERENCE_STEMS, OBJECT_STEMS) for kind, stems in group.items()]
_AS_IT_STANDS = [(MARKS[kind], stems.split()) for kind, stems in (EXTERNAL_STEMS | {"CHINESE": "第"}).items()]
_TRANSLATED = str.maketrans(_FOLDS)
_VALUE = r"[\p{L}0-9][\p{L}0-9./_-]{1,499}"


def _pattern(words: str) -> str:
    """A type's word, then a number sign, a mark, or a value that holds a digit; one group, the value."""
    return rf"(?iu)(?:{words})\s*(?:(?:№|no\.?|number)\s*[:#-]?\s*|[:#-]\s*|(?=[\p{{L}}0-9./_-]*\d))({_VALUE})(?![\p{{L}}0-9./_-])"


def identifier(raw: Column) -> Column:
    """Upper case, № as #, no white space and no other signs; empty if too long."""
    text = F.regexp_replace(F.regexp_replace(F.upper(F.trim(raw)), "№", "#"), r"\s+", "")
    return F.when(F.char_length(text) > 500, "").otherwise(F.regexp_replace(text, r"[^\p{L}\p{N}./_#-]", ""))


def _typed(kind: str):
    return lambda v: F.struct(F.lit(kind).alias("type"), v.alias("raw"), identifier(v).alias("normalized"))


def marks(text: str) -> int:
    """The marks of a text. Functions that get them look for no words, and leave out the patterns that they rule out."""
    folded = text if text.isascii() or not any(c in text for c in _FOLDS) else text.translate(_TRANSLATED)
    low, out = folded.lower(), 0
    for where, listed in ((low, _FOLDED), (text, _AS_IT_STANDS)):
        for bit, stems in listed:
            for stem in stems:
                if stem in where:
                    out |= bit
                    break
    return out


def marked(column: Column | None, kinds: Iterable[str]) -> Column | None:
    """Whether marks have one of the kinds."""
    return None if column is None else column.bitwiseAND(F.lit(sum(MARKS[k] for k in kinds))) != 0


def _with_folded(text: Column, made: Callable[[Column | None], Column], marks: Column | None = None) -> Column:
    """made() of the text with cases folded as patterns fold them, which is computed once, if there are no marks."""
    if marks is not None:
        return made(None)
    return F.transform(F.array(F.lower(F.translate(text, "".join(_FOLDS), "".join(_FOLDS.values())))), made)[0]


def _where(text: Column | None, stems: str | None, raw: Column, some: Column | None = None) -> Column:
    """The strings that a pattern finds; it is not run where the text holds none of the stems, or `some` says so. Null for a
    null text."""
    if stems is None:
        return raw
    if some is None:
        some = F.lit(False)
        for stem in stems.split():
            some = some | F.contains(text, F.lit(stem))
    return F.when(~some, F.array().cast("array<string>")).otherwise(raw)


def extracted(text: Column, types: dict[str, str] = TYPES, marks: Column | None = None) -> Column:
    """array<struct(type, raw, normalized)> of all identifiers, by type; types has a pattern of the words of each."""

    def made(folded: Column) -> Column:
        found = []
        for kind, words in types.items():
            raw = _where(folded, TYPE_STEMS[kind] if TYPES.get(kind) == words else None, F.regexp_extract_all(text, F.lit(_pattern(words)), F.lit(1)), marked(marks, [kind] if kind in MARKS else []))
            found.append(F.transform(F.transform(raw, lambda v: F.regexp_replace(v, r"[.,;:!?]+$", "")), _typed(kind)))
        return F.filter(F.concat(*found), lambda x: x["normalized"] != "")

    return _with_folded(text, made, marks)


def without_identifiers(text: Column, types: dict[str, str] = TYPES) -> Column:
    """What a query means besides the identifiers that it names."""
    return F.trim(F.aggregate(extracted(text, types), text, lambda acc, x: F.replace(acc, x["raw"], F.lit(""))))


def matched(postings: DataFrame, wanted: DataFrame, mode: str) -> DataFrame:
    """Postings (type, normalized, ...) of wanted values (query, type, value): EXACT, PREFIX or
    PARTIAL; signs in a value stand for themselves."""
    value, have = F.col("value"), F.col("normalized")
    test = {"EXACT": have == value, "PREFIX": have.startswith(value), "PARTIAL": have.contains(value)}[mode]
    kinds = wanted.withColumnRenamed("type", "wanted_type")
    return postings.join(kinds, (F.col("type") == F.col("wanted_type")) & test).drop("wanted_type")


# Words of references; those of the last group also take roman numerals.
REFERENCES = {
    "ARTICLE": "articles?|art\\.|artikel|artículos?|artigos?|articol[oi]|madde|стат(?:ья|ьи|ье|ью|ьёй|ьей)|ст\\.|бап|άρθρ[οα]",
    "CLAUSE": "clauses?",
    "PARAGRAPH": "paragraphe|apartados?|comma|commi|fıkra|пункт(?:а|е|у|ы|ов)?|п\\.|тармақ|παράγραφο[ςι]",
    "SUBPARAGRAPH": "тармақша",
    "SECTION": "sections?|sec\\.|abschnitt|sección|secciones|secção|secções|seção|seções|sezion[ei]|bölüm|раздел(?:а|е|у|ы|ов)?|ενότητες|ενότητα",
    "CHAPTER": "chapters?|kapitel|chapitre|capítulos?|capitol[oi]|глав[аыеу]|κεφάλαι[οα]",
    "PART": "parts?|teil|partie|част[ьи]|kısım|μέρος|μέρη",
}
ROMAN_TYPES = ("SECTION", "CHAPTER", "PART")


def _numbers(values: dict[str, int]) -> Column:
    """A map of fixed signs, as one expression: streams build these columns for each batch."""
    return F.expr(f"map({', '.join(f"'{sign}', {n}" for sign, n in values.items())})")


def roman(text: Column) -> Column:
    """The value of a roman numeral, null if it is none up to 3999."""
    valid = F.upper(text).rlike("^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$") & (text != "")
    digits = F.transform(F.split(F.upper(text), ""), lambda c: F.try_element_at(_numbers(dict(zip("IVXLCDM", (1, 5, 10, 50, 100, 500, 1000), strict=True))), c))
    total = F.aggregate(digits, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last")), lambda acc, v: F.struct((acc["sum"] + v - F.when(acc["last"] < v, 2 * acc["last"]).otherwise(0)).alias("sum"), v.alias("last")))
    return F.when(valid, total["sum"])


def _reference(kind: str):
    def made(v: Column) -> Column:
        arabic = F.regexp_replace(v, r"(^|\.)0+(?=\d)", "$1")
        return F.struct(F.lit(kind).alias("type"), F.when(v.rlike("^[0-9.]+$"), arabic).otherwise(roman(v).cast("string")).alias("value"))

    return made


def _by_words(text: Column, pattern: Callable[[str, str], str], marks: Column | None) -> Column:
    """Distinct references that patterns of the words of REFERENCES and a number find."""

    def made(folded: Column) -> Column:
        found = []
        for kind, words in REFERENCES.items():
            number = r"\d+(?:\.\d+)*" + (r"|[IVXLCDMivxlcdm]+(?![\p{L}\p{N}])" if kind in ROMAN_TYPES else "")
            raw = F.regexp_extract_all(text, F.lit(pattern(words, number)), F.lit(1))
            found.append(F.transform(_where(folded, REFERENCE_STEMS[kind], raw, marked(marks, [kind])), _reference(kind)))
        return F.array_distinct(F.filter(F.concat(*found), lambda x: x["value"].isNotNull()))

    return _with_folded(text, made, marks)


def references(text: Column, marks: Column | None = None) -> Column:
    """Distinct array<struct(type, value)> of typed references; dotted parts lose leading zeros."""
    return _by_words(text, lambda words, number: rf"(?iu)(?<![\p{{L}}\p{{N}}])(?:{words})\s*({number})", marks)


# Digits and units of Chinese numerals, and the words of Chinese references.
CHINESE_DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
CHINESE_UNITS = {"十": 10, "百": 100, "千": 1000}
CHINESE_REFERENCES = {"条": "ARTICLE", "款": "CLAUSE", "项": "SUBPARAGRAPH", "节": "SECTION", "章": "CHAPTER", "编": "PART"}
# Objects that are named in a text by a number or a letter, and kinds of outside sources.
NAMED_OBJECTS = {"APPENDIX": "appendix|annex|anhang|anlage|annexe|anexo|allegato|приложени[еяю]", "TABLE": "table|tabelle|tableau|tabla|tabella|таблиц[аеуы]", "FIGURE": "figure|fig\\.|abbildung|figura|рисун(?:ок|ке|ка)"}
EXTERNAL = {"STANDARD": r"(?:ISO(?:/IEC)?|IEC|EN|DIN|ГОСТ)(?: Р)? ?\d+(?:[-.:]\d+)*", "RFC": r"RFC ?\d+", "LAW": r"(?:Regulation|Directive) \(?(?:EU|EC)\)? ?(?:No\.? ?)?\d+/\d+"}


def chinese_number(text: Column) -> Column:
    """The value of a Chinese numeral below ten thousand, or of digits; null for anything else."""
    known = {**CHINESE_DIGITS, **CHINESE_UNITS}
    values = _numbers(known)
    signs = F.split(text, "")

    def step(acc: Column, sign: Column) -> Column:
        v = F.try_element_at(values, sign)
        unit = sign.isin(*CHINESE_UNITS)
        total = F.when(unit, acc["total"] + F.when(acc["last"] == 0, 1).otherwise(acc["last"]) * v).otherwise(acc["total"])
        return F.struct(total.alias("total"), F.when(unit, 0).otherwise(v).alias("last"))

    folded = F.aggregate(signs, F.struct(F.lit(0).alias("total"), F.lit(0).alias("last")), step)
    return F.when(text.rlike("^[0-9]+$"), text.cast("int")).when(text.rlike(f"^[{''.join(known)}]+$"), folded["total"] + folded["last"])


def chinese_references(text: Column, marks: Column | None = None) -> Column:
    """Distinct array<struct(type, value)> of references such as 第三条 and of ranges such as 第三至五条."""
    number = f"[0-9{''.join(CHINESE_DIGITS)}{''.join(CHINESE_UNITS)}]+"
    found, some = [], marked(marks, ["CHINESE"])
    for word, kind in CHINESE_REFERENCES.items():
        one = _where(text, "第", F.regexp_extract_all(text, F.lit(f"第({number}){word}"), F.lit(1)), some)
        wide = _where(text, "第", F.regexp_extract_all(text, F.lit(f"第({number}[至到]第?{number}){word}"), F.lit(1)), some)
        ends = F.transform(wide, lambda w: F.transform(F.split(w, "[至到]第?"), lambda x: chinese_number(x)))
        spread = F.flatten(F.transform(F.filter(ends, lambda e: (e[0] <= e[1]) & (e[1] - e[0] < 100)), lambda e: F.sequence(e[0], e[1])))
        values = F.concat(F.transform(one, lambda x: chinese_number(x)), spread)
        found.append(_typed_values(values, kind))
    return F.array_distinct(F.concat(*found))


def _typed_values(values: Column, kind: str) -> Column:
    return F.transform(F.filter(values, lambda v: v.isNotNull()), lambda v: F.struct(F.lit(kind).alias("type"), v.cast("string").alias("value")))


def named_objects(text: Column, marks: Column | None = None) -> Column:
    """Distinct array<struct(type, value)> of appendices, tables and figures that a text names."""

    def made(folded: Column) -> Column:
        found = []
        for kind, words in NAMED_OBJECTS.items():
            raw = F.regexp_extract_all(text, F.lit(rf"(?iu)(?<![\p{{L}}\p{{N}}])(?:{words})\s*(?:№|no\.)?\s*(\d+(?:\.\d+)*|[A-Z](?![\p{{L}}\p{{N}}]))"), F.lit(1))
            found.append(_typed_values(F.transform(_where(folded, OBJECT_STEMS[kind], raw, marked(marks, [kind])), lambda v: F.upper(v)), kind))
        return F.array_distinct(F.concat(*found))

    return _with_folded(text, made, marks)


def external_references(text: Column, marks: Column | None = None) -> Column:
    """Distinct array<struct(type, value)> of standards, requests for comments and laws; one blank
    stands between their words."""
    found = []
    for kind, pattern in EXTERNAL.items():
        raw = _where(text, EXTERNAL_STEMS[kind], F.regexp_extract_all(text, F.lit(rf"(?<![\p{{L}}\p{{N}}])({pattern})(?![\p{{L}}\p{{N}}])"), F.lit(1)), marked(marks, [kind]))
        found.append(_typed_values(F.transform(raw, lambda v: F.regexp_replace(v, r"(?<=\p{L}) ?(?=\d)", " ")), kind))
    return F.array_distinct(F.concat(*found))


def declared(text: Column, marks: Column | None = None) -> Column:
    """Distinct array<struct(type, value)> that a text declares: references that open a line, behind
    heading marks at most. They are anchors, and no references of the text itself."""
    return _by_words(text, lambda words, number: rf"(?ium)^[ \t#]*(?:{words})\s*({number})", marks)
