"""Benchmark decontamination by template canonicalisation.

Numbers, units and names become typed placeholders, so that a question keeps its template when
its parameters change. Each window is read twice, in neither case with regard to line breaks:
with names as placeholders, and with names as lower-cased words, so that a copy in another case
is found as well. Windows of canonical words are joined by hash; hits on one diagonal are a passage, and the passage counts if its slots were filled consistently: a value of the item
stands for one value in the document throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galena.llm.common import stored

#: Words of a window; hits on neighbouring diagonals that make a passage (six windows of eight
#: words span thirteen); width of a band of diagonals; least share of consistent slots.
WINDOW, HITS, BAND, CONSISTENT = 8, 6, 4, 0.75
#: Literal words without which a window with names as placeholders says nothing, an item shorter than
#: a window matches nothing, and a longer item matches only with equal raw words.
LITERALS = 2
#: Benchmark windows up to this number are broadcast (some 16 MB); more are joined by shuffling.
BROADCAST_WINDOWS = 1_000_000

# Units that are slots behind a number.
UNITS = "kg g mg lb lbs oz km m cm mm mi mile miles meter meters metre metres feet foot ft inch inches hour hours h minute minutes min second seconds s day days week weeks month months year years dollar dollars euro euros cent cents pound pounds liter liters litre litres l ml percent degree degrees mph kmh"
# Words that open sentences and are no names.
OPENERS = "a after all also although an and any are as at because before both but by can could did do does each every few find first for from given had has have he her here his how however i if in is it its last let many more most my next no not now of on one or our she since so some that the their then there these they this those though to two under until was we were what when where which while who whose why will with would you your"

_NUMBER, _NAME, _UNIT = "\u0001", "\u0002", "\u0003"
_BREAK = r"[^\p{L}\p{N}\x01-\x03]+"


def _joined_numbers(text: Column) -> Column:
    """The text with one word for each number: no marks inside it, no letters right behind it."""
    plain = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x01-\x03]", " ")
    return F.regexp_replace(F.regexp_replace(plain, r"(?<=\p{Nd})[.,'](?=\p{Nd})", ""), r"(?<=\p{Nd})(?=\p{L})|(?<=\p{L})(?=\p{Nd})", " ")


def _split(text: Column) -> Column:
    """Words in lower case. They are split before, as lowering can add signs that are no letters."""
    return F.transform(F.array_remove(F.split(text, _BREAK), ""), lambda w: F.lower(w))


def raw_words(text: Column) -> Column:
    """The words of a text, lower-cased; a number is one word."""
    return _split(_joined_numbers(text))


_NAMES = rf"(?=\p{{Lu}})(?!(?i:{OPENERS.replace(' ', '|')})(?![\p{{L}}\p{{M}}]))(?:(?<=[\p{{Ll}},;] )\p{{Lu}}\p{{L}}*|(?<![\p{{L}}\p{{M}}\p{{N}}])\p{{Lu}}(?:\p{{Ll}}\p{{L}}*)?(?!\p{{L}}))"


def canonical_words(text: Column) -> Column:
    """As many words, where placeholders stand for numbers and units behind them, and a mark
    opens names: capitalised words but for OPENERS, and words in capitals only if they follow a
    lower-case letter or a comma."""
    out = F.regexp_replace(_joined_numbers(text), r"[\s\p{Z}&&[^ ]][\s\p{Z}]*| [\s\p{Z}]+", " ")
    out = F.regexp_replace(out, r"\p{Nd}+", _NUMBER)
    out = F.regexp_replace(out, rf"(?<={_NUMBER}[ -])(?i:{UNITS.replace(' ', '|')})(?![\p{{L}}\p{{N}}])", _UNIT)
    return _split(F.regexp_replace(out, _NAMES, _NAME + "$0"))


def _stands(word: Column) -> Column:
    """Whether a placeholder can stand for the word."""
    return word.isin(_NUMBER, _UNIT) | word.startswith(_NAME)


def _held(df: DataFrame, **columns: Column) -> DataFrame:
    """The rows with columns that are computed once, and not once for each use."""
    for name, column in columns.items():
        df = df.select(*[c for c in df.columns if c != name], F.explode(F.array(column)).alias(name))
    return df


def _windows(df: DataFrame, name: str, size: int) -> DataFrame:
    """The rows with hashes of all windows of `size` in place of an array of hashes."""
    last, width = F.size(name) - size + 1, 1
    df = df.withColumn("_last", F.greatest(last, F.lit(0)))
    while width < size:
        step = min(width, size - width)
        df = _held(df, **{name: F.zip_with(name, F.slice(name, step + 1, F.size(name)), lambda a, b: F.xxhash64(a, b))})
        width += step
    return df.withColumn(name, F.slice(name, 1, "_last")).drop("_last")


def passages(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, hits: int = HITS) -> DataFrame:
    """Benchmark passages in documents, one row for a document and item.

    Returns id_col, item_col, n_hits (windows met, at most those of the item), coverage (their
    share of the item's windows), first_word (where the passage starts), n_slots (item slots under
    the passage), changed (of them filled with other values) and consistent (share of the item's
    slot values that stand for one value throughout; 1 without slots). A passage has at least
    `hits` windows on neighbouring diagonals, or all windows of a shorter item, and CONSISTENT
    slots. Items shorter than a window are one window of their own length and need equal raw words;
    those with fewer than LITERALS words besides numbers, units and names (the first word counts as
    no name), such as '42 km', match nothing. Null texts count as empty and match nothing. Rows that share an id are one document; null ids are left out.
    """
    items = benchmark.filter(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), canonical_words(F.col(item_text_col)).alias("cw"), raw_words(F.col(item_text_col)).alias("rw")).filter(F.size("cw") > 0)
    literals = F.size(F.filter("cw", lambda w: ~_stands(w))) + F.get("cw", F.lit(0)).startswith(_NAME).cast("int")
    items = items.withColumn("size", F.least(F.size("cw"), F.lit(window))).withColumn("few", literals < LITERALS).filter((F.col("size") == window) | ~F.col("few"))
    # At most `window` different sizes come to the driver.
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())
    if not sizes:
        sizes = [window]

    def all_windows(df: DataFrame, keys: list[str], only: bool) -> DataFrame:
        parts = []
        for s in sizes:
            part = df.filter(F.col("size") == s) if only else df
            if s < window:
                part = _windows(_held(part.select(*keys, "rw"), h=F.transform("rw", lambda w: F.xxhash64(w))).drop("rw"), "h", s)
                parts.append(part.select(*keys, F.posexplode("h").alias("at", "h")).withColumn("h", F.xxhash64(F.lit(s), "h")))
                continue
            part = _held(part.select(*keys, "cw"), plain=F.transform("cw", lambda w: F.xxhash64(F.ltrim(w, F.lit(_NAME)))), slots=F.transform("cw", lambda w: F.xxhash64(F.when(w.startswith(_NAME), _NAME).otherwise(w))))
            part = _windows(_windows(part, "plain", s), "slots", s).select(*keys, *(["cw"] if only else []), F.posexplode(F.arrays_zip("plain", "slots")).alias("at", "w"))
            one = F.col("w.plain") == F.col("w.slots")
            if only:
                one = one | (F.size(F.filter(F.slice("cw", F.col("at") + 1, s), lambda w: ~_stands(w))) < LITERALS)
            part = part.select(*keys, "at", F.explode(F.when(one, F.array("w.plain")).otherwise(F.array("w.plain", "w.slots"))).alias("h"))
            parts.append(part.withColumn("h", F.xxhash64(F.lit(s), "h")))
        out = parts[0]
        for part in parts[1:]:
            out = out.union(part)
        return out

    wanted = all_windows(items, ["item"], True).select("item", F.col("at").alias("there"), "h")
    if wanted.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS:
        wanted = F.broadcast(wanted)
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), canonical_words(F.col(text_col)).alias("cw"), raw_words(F.col(text_col)).alias("rw"))
    if len(sizes) > 1:  # else the words would be read once for each size
        rows = stored(rows, "canonical")
    met = all_windows(rows, ["id", "mark"], False).join(wanted, "h")
    lines = met.groupBy("id", "mark", "item", (F.col("at") - F.col("there")).alias("diagonal")).agg(F.collect_set("there").alias("there"), F.min("at").alias("first"))
    # A band and the next one are one passage, so that diagonals on both sides of an edge meet.
    band = F.floor(F.col("diagonal") / BAND)
    banded = lines.select("*", F.explode(F.array(band, band - 1)).alias("band"))
    keys = ["id", "mark", "item", "band", "n", "first"]
    found = banded.groupBy(*keys[:4]).agg(F.size(F.array_distinct(F.flatten(F.collect_list("there")))).alias("n"), F.min("first").alias("first"), F.collect_list(F.struct("diagonal", "there")).alias("lines"))
    slots = F.filter(F.sequence(F.lit(0), F.size("cw") - 1), lambda t: _stands(F.element_at("cw", t + 1)))
    known = items.select("item", "rw", (F.size("cw") - F.col("size") + 1).alias("n_windows"), "size", "few", slots.alias("slots"))
    keys = [*keys, "n_windows", "few"]
    enough = found.join(known, "item").filter(F.col("n") >= F.least(F.lit(hits), F.col("n_windows")))
    # Each slot is read through the diagonal of a window that covers it; of several, the one with most windows.
    line = enough.select(*keys, "rw", "slots", "size", F.explode("lines").alias("line"))
    covered = F.flatten(F.transform("line.there", lambda b: F.sequence(b, b + F.col("size") - 1)))
    read = line.select(*keys, "rw", F.struct(F.size("line.there").alias("n"), (-F.col("line.diagonal")).alias("minus")).alias("line"), F.explode_outer(F.array_intersect("slots", covered)).alias("t"))
    read = read.select(*keys, "t", F.get("rw", F.col("t")).alias("a"), "line").groupBy(*keys, "t", "a").agg(F.max("line").alias("line"))
    read = stored(read.select(*keys, "a", (F.col("t") - F.col("line.minus")).alias("at")), "decontamination")
    # The words of a document are split once, and only the wanted ones go on.
    needed = read.filter("at IS NOT NULL").groupBy("id", "mark").agg(F.collect_set("at").alias("at"))
    bodies = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("body")).join(needed, ["id", "mark"])
    words = _held(bodies, dw=raw_words(F.col("body"))).select("id", "mark", F.explode(F.transform("at", lambda i: F.struct(i.alias("at"), F.get("dw", i.cast("int")).alias("b")))).alias("w"))
    words = words.groupBy("id", "mark", "w.at").agg(F.first("w.b").alias("b"))
    some = F.col("at").isNotNull()
    judged = read.join(words, ["id", "mark", "at"], "left").groupBy(*keys).agg(F.count("at").alias("n_slots"), F.count_if(some & ~F.col("a").eqNullSafe(F.col("b"))).alias("changed"), F.size(F.collect_set("a")).alias("values"), F.size(F.collect_set(F.when(some, F.struct("a", "b")))).alias("pairs"))
    judged = judged.filter(~F.col("few") | (F.col("changed") == 0)).select("id", "item", F.col("n").cast("long").alias("n_hits"), (F.col("n") / F.col("n_windows")).alias("coverage"), F.col("first").cast("long").alias("first_word"), "n_slots", "changed", F.when(F.col("pairs") > 0, F.col("values") / F.col("pairs")).otherwise(1.0).alias("consistent"))
    # Every passage is judged; the best of those that count stands for the document and item.
    out = ["n_hits", "coverage", "first_word", "n_slots", "changed", "consistent"]
    one = judged.filter(F.col("consistent") >= CONSISTENT).groupBy("id", "item").agg(F.max_by(F.struct(*out), F.struct("n_hits", "consistent", -F.col("first_word"), "n_slots", -F.col("changed"))).alias("p"))
    return one.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "p.*")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without any benchmark passage, with all their columns; null ids stay."""
    return docs.join(passages(docs, benchmark, id_col, text_col, **options).select(id_col).distinct(), id_col, "left_anti")
