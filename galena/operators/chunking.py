"""Documents to units, units to chunks. Every function works inside one document, so that no
document moves: they run as maps over batches. Positions in a text are looked up in one array of
token sums and one of boundary ranks, so that no stretch is estimated twice."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galena.functions import identifiers
from galena.functions import tokens as T
from galena.sources.batches import bounded_batches, slices

#: Estimated tokens of a chunk: least, aimed at, where a new unit opens a new chunk, never more; of a child.
LEAST, TARGET, SOFT, HARD = 250, 550, 650, 900
CHILD_LEAST, CHILD_TARGET, CHILD_MOST = 250, 275, 300
_HEADING = re.compile(r"^(#{1,6})\s+(.+)$")
_ITEM = re.compile(r"^(\d+[.)]|[-*•])\s+")
# Abbreviations behind which no sentence ends.
ABBREVIATIONS = frozenset("mr mrs dr prof no art sec fig e.g i.e etc vs approx st ст п г др см bzw z.b usw ca nr abs p.ej sr sra".split())
_END = re.compile(r"[.!?…。！？]+[\"'»”)\]]*(?=\s|$)|[。！？]")
#: Ranks of boundaries: behind a line break, a sentence, a clause, a comma, white space; elsewhere 0.
STRUCTURE, SENTENCE, CLAUSE, COMMA, BLANK = 5, 4, 3, 2, 1
_MARKS = {STRUCTURE: "\n", SENTENCE: ".!?…。！？", CLAUSE: ";:；：", COMMA: ",，、"}


def sentences(text: str, start: int = 0, end: int | None = None) -> list[tuple[int, int]]:
    """Where the sentences of text[start:end] begin and end. None ends in a decimal number, behind
    an abbreviation, an initial, an address, or a word with two dots or more."""
    end = len(text) if end is None else end
    out, at = [], start
    for m in _END.finditer(text, start, end):
        if m[0] == ".":
            word = last_word(text[max(at, m.start() - 80) : m.start()]).lower().lstrip("(\"'«“[")
            if word in ABBREVIATIONS or (len(word) == 1 and word.isalpha()) or "://" in word or "@" in word or word.count(".") > 1:
                continue
        out.append((at, m.end()))
        at = m.end()
    out.append((at, end))
    return [s for a, b in out for s in [trimmed(text, a, b)] if s[0] < s[1]]


def last_word(text: str) -> str:
    """What stands behind a text's last white space; a line break at its end does not count."""
    text = text.removesuffix("\n")
    return text.rsplit(None, 1)[-1] if text and not text[-1].isspace() else ""


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """A stretch without white space at its ends."""
    while start < end and text[start].isspace():
        start += 1
    while end > start and text[end - 1].isspace():
        end -= 1
    return start, end


@lru_cache
def _marks() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the rank of a mark (0: none), and whether it counts only before white space."""
    rank, narrow = np.zeros(0x110000, np.uint8), np.zeros(0x110000, bool)
    for r in (COMMA, CLAUSE, SENTENCE):
        rank[T.points(_MARKS[r])] = r
    narrow[T.points(".!?…:,")] = True
    return rank, narrow


def boundary_ranks(text: str) -> np.ndarray:
    """The rank of cutting before each code point of a text, and behind the last. A sentence mark
    counts before white space, and by itself where it is a wide one."""
    point = T.points(text)
    blank = T.classes()[point] == T.SPACE
    out = np.zeros(len(point) + 1, np.uint8)
    out[1:][blank] = BLANK
    out[:-1][blank] = BLANK
    ranks, narrow = (of[point] for of in _marks())
    np.copyto(out[1:], ranks, where=ranks > 0)
    open_mark = np.zeros(len(point), bool)
    open_mark[:-1] = narrow[:-1] & ~blank[1:]
    out[1:][open_mark] = 0
    out[1:][point == 10] = STRUCTURE
    return out


def best_boundary(ranks: np.ndarray, least: int, most: int) -> int:
    """The first place of the best rank within [least, most]; most where there is none."""
    inside = ranks[least : most + 1]
    at = int(inside.argmax()) if len(inside) else 0
    return least + at if len(inside) and inside[at] else most


@dataclass
class Measured:
    """A text with its token sums and boundary ranks."""

    text: str

    #: Stretches that are not cut unless they are longer than HARD.
    whole: tuple[tuple[int, int], ...] = ()

    def __post_init__(self) -> None:
        self.sums = T.sums(self.text)
        self._ranks: np.ndarray | None = None
        self.free = np.ones(len(self.text) + 1, bool) if self.whole else None
        for a, b in self.whole:
            if self.tokens(a, b) <= HARD:
                self.free[a + 1 : b] = False

    @property
    def ranks(self) -> np.ndarray:
        if self._ranks is None:
            self._ranks = boundary_ranks(self.text)
        return self._ranks

    def tokens(self, start: int, end: int) -> int:
        return T.tokens(int(self.sums[end] - self.sums[start])) if end > start else 0

    def _longest(self, start: int, budget: int) -> int:
        """The end of the longest stretch from start on that has at most `budget` tokens."""
        return max(start + 1, int(np.searchsorted(self.sums, self.sums[start] + budget * T.WHOLE // T.MARGIN, "right")) - 1)

    def split(self, start: int, end: int, budget: int, least: int | None = None) -> list[tuple[int, int]]:
        """Pieces of at most `budget` tokens: each is the largest that fits, cut at the best boundary
        behind its first `least` tokens (five sixths of the budget)."""
        least = budget * 5 // 6 if least is None else least
        out = []
        while self.tokens(start, end) > budget:
            most = self._longest(start, budget)
            cut = self._cut(start, min(self._longest(start, least) + 1, most), most, end)
            if cut >= end:
                break
            out.append(trimmed(self.text, start, cut))
            start = trimmed(self.text, cut, end)[0]
        out.append((start, end))
        return [s for s in out if s[0] < s[1]]

    def _cut(self, start: int, least: int, most: int, end: int) -> int:
        """The best boundary within [least, most] that is in no whole stretch; else the nearest place before
        that is in none, else the end of the stretch that begins where the piece does."""
        if self.free is None:
            return best_boundary(self.ranks, least, most)
        places = np.flatnonzero(self.free[least : most + 1]) + least
        if len(places) == most + 1 - least:
            return best_boundary(self.ranks, least, most)
        if len(places):
            return int(places[self.ranks[places].argmax()])
        before = np.flatnonzero(self.free[start + 1 : least])
        if len(before):
            return start + 1 + int(before[-1])
        behind = np.flatnonzero(self.free[most + 1 : end])
        return most + 1 + int(behind[0]) if len(behind) else end

    def halves(self, start: int, end: int, target: int, most: int, least: int) -> list[tuple[int, int]] | None:
        """Two pieces of at most `most` tokens, near the target, long enough and cut at a good
        boundary; null if there is no such cut."""
        # Sums rise, so that the places where both pieces can fit are one stretch; a code point more at each end is no harm.
        room = most * T.WHOLE // T.MARGIN + 1
        first = max(start + 1, int(np.searchsorted(self.sums, self.sums[end] - room)) - 1)
        places = np.arange(first, min(end, int(np.searchsorted(self.sums, self.sums[start] + room, "right")) + 1))
        if not len(places):
            return None
        left, right = ((self.sums[places] - self.sums[start]) * T.MARGIN / T.WHOLE, (self.sums[end] - self.sums[places]) * T.MARGIN / T.WHOLE)
        fits = (left <= most) & (right <= most) & (True if self.free is None else self.free[places])
        if not fits.any():
            return None
        short = np.maximum(least - left, 0) + np.maximum(least - right, 0)
        cost = np.abs(left - target) + np.abs(right - target) + 20 * short + 30 * (STRUCTURE - self.ranks[places].astype(np.int64))
        # Of equal costs the more even pieces, then the first.
        cost = np.where(fits, np.round(cost, 6), np.inf)
        best = np.flatnonzero(cost == cost.min())
        cut = int(places[best[np.abs(left - right)[best].argmin()]])
        return [s for s in (trimmed(self.text, start, cut), trimmed(self.text, cut, end)) if s[0] < s[1]]

    def children(self, target: int = CHILD_TARGET, most: int = CHILD_MOST, least: int = CHILD_LEAST) -> list[tuple[int, int]]:
        """The text in pieces of at most `most` tokens: two balanced ones if they suffice."""
        whole = trimmed(self.text, 0, len(self.text))
        if self.tokens(*whole) <= 2 * most and (two := self.halves(*whole, target, most, least)):
            return two
        return self.split(*whole, most, target)


def units(text: str) -> list[tuple[str, str, int, int]]:
    """(section path, kind, start, end): headings make the path, numbered lines are list items, other
    lines are cut into sentences."""
    stack: list[tuple[int, str]] = []
    path, out = "", []
    for line in re.finditer(r"[^\n]+", text):
        start, end = trimmed(text, line.start(), line.end())
        if start == end:
            continue
        first = text[start]
        if first == "#" and end - start < 220 and (m := _HEADING.match(text[start:end])):
            level = len(m[1])
            stack = [x for x in stack if x[0] < level] + [(level, m[2].strip())]
            path = " > ".join(t for _, t in stack)
            out.append((path, "HEADING", end - len(m[2]), end))
        elif (first.isdigit() or first in "-*•") and _ITEM.match(text[start : start + 20]):
            out.append((path, "LIST_ITEM", start, end))
        else:
            out.extend((path, "PARAGRAPH", a, b) for a, b in sentences(text, start, end))
    return out


def grouped(measured: Measured, found: list[tuple[str, str, int, int]]) -> list[tuple[str, list[tuple[int, int]]]]:
    """(section path, stretches) of chunks: units join until the chunk is near its aim; a new section
    opens a new chunk once the last is long enough; none exceeds HARD. A blank joins two units."""
    out: list[tuple[str, list[tuple[int, int]]]] = []
    held: list[tuple[int, int]] = []
    size, path, hard = 0, "", HARD * T.WHOLE // T.MARGIN
    least, soft, target = (x * T.WHOLE // T.MARGIN for x in (LEAST, SOFT, TARGET))
    sums = measured.sums
    for section, _, start, end in found:
        pieces = [(start, end)] if sums[end] - sums[start] <= hard else measured.split(start, end, HARD)
        for a, b in pieces:
            n = int(sums[b] - sums[a])
            full = size + 5 + n > hard or (size >= least and (section != path or size + 5 + n > soft)) or size >= target
            if held and full:
                out.append((path, held))
                held, size = [], 0
            if not held:
                path = section
            size += n + 5 * bool(held)
            held.append((a, b))
    if held:
        out.append((path, held))
    return out


def atomic_spans(text: str, found: list[tuple[str, str, int, int]], domain: str | None) -> list[tuple[int, int]]:
    """The stretches of a text's units that stay whole: an exception with the unit right before it in its section,
    which it restricts, and, in medicine, facts."""
    out, last = [], ("", "", 0, 0)
    if domain != "MEDICAL":
        low = text.lower()
        if not any(begin in low for begin in _EXCEPTION_BEGINS) or not _EXCEPTION.search(low):
            return out
    for section, kind, a, b in found:
        name = unit_name(text[a:b], domain) if kind == "PARAGRAPH" or kind == "LIST_ITEM" else kind
        if name == "EXCEPTION" and last[1] in EXCEPTED and last[0] == section:
            out.append((last[2], b))
        elif name in MEDICAL_FACTS:
            out.append((a, b))
        last = section, name, a, b
    return out


def joined_units(found: list[tuple[str, str, int, int]], whole: list[tuple[int, int]]) -> list[tuple[str, str, int, int]]:
    """The units, those that a stretch spans joined to one, so that they come into one chunk."""
    starts, out = dict(whole), []
    for section, kind, a, b in found:
        if out and b <= out[-1][3]:
            continue
        out.append((section, kind, a, starts.get(a, b)))
    return out


def chunks(text: str, domain: str | None = None) -> list[tuple[int, int | None, str, str, str, int]]:
    """(index, parent, role, section path, text, tokens): parents that are long have children, whose
    indices follow all parents'. Atomic stretches (see atomic_spans) are cut only where they are longer than HARD; a
    child that holds one may be longer than CHILD_MOST."""
    found = units(text)
    whole = atomic_spans(text, found, domain)
    measured = Measured(text, tuple(whole))
    parents, spans = [], []
    for path, held in grouped(measured, joined_units(found, whole)):
        parents.append((path, " ".join(text[a:b] for a, b in held)))
        at, inside = 0, []
        for a, b in held:
            inside += [(at + x - a, at + y - a) for x, y in whole if a <= x and y <= b] if whole else []
            at += b - a + 1
        spans.append(tuple(inside))
    sizes = [T.estimate(t) for _, t in parents]
    out = [(k, None, "PARENT" if n > CHILD_MOST else "STANDALONE", p, t, n) for k, ((p, t), n) in enumerate(zip(parents, sizes, strict=True))]
    for k, ((p, t), n) in enumerate(zip(parents, sizes, strict=True)):
        if n > CHILD_MOST:
            body = Measured(t, spans[k])
            for a, b in body.children():
                out.append((len(out), k, "CHILD", p, t[a:b], body.tokens(a, b)))
    return out


def chunked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain_col: str | None = None, marked: bool = False) -> DataFrame:
    """Parents and children: id_col, chunk_index, parent_index, role, section_path, text, chunk_id,
    tokens, and, if marked, marks (see `marks`). Children follow their parents' greatest index. Null texts have no chunk. Exceptions are not cut from what
    they restrict, nor, where domain_col says MEDICAL, facts in two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            at, rows = [], []
            for i, (body, domain) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                made = chunks(body or "", domain)
                rows.extend(made)
                at.extend([i] * len(made))
            if rows:
                cols = list(zip(*rows, strict=True))
                ids = ["c2_" + hashlib.sha256(f"{len(p.encode())}:{p}{len(t.encode())}:{t}".encode()).hexdigest() for p, t in zip(cols[3], cols[4], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2]), pa.array(cols[3]), pa.array(cols[4]), pa.array(ids), pa.array(cols[5], pa.int32()), *[pa.array(map(marks, cols[4]), pa.int32())] * marked], names=["id", "chunk_index", "parent_index", "role", "section_path", "text", "chunk_id", "tokens", *["marks"] * marked])

    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"), (F.col(domain_col) if domain_col else F.lit(None)).cast("string").alias("d"))
    out = source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, chunk_index int, parent_index int, role string, section_path string, text string, chunk_id string, tokens int{', marks int' * marked}")
    return out.withColumnRenamed("id", id_col)


def document_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, position, section_path, kind, text): the units of each document in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            rows = [(i, k, path, kind, body[a:b]) for i, body in enumerate(batch.column(1).to_pylist()) if body for k, (path, kind, a, b) in enumerate(units(body))]
            if rows:
                at, k, path, kind, text = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(k, pa.int32()), pa.array(path), pa.array(kind), pa.array(text)], names=["id", "position", "section_path", "kind", "text"])

    bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, position int, section_path string, kind string, text string").withColumnRenamed("id", id_col)


#: Kinds of units that an exception right behind them belongs to, and kinds that are never split.
EXCEPTED = ("RULE", "OBLIGATION", "PROHIBITION", "RIGHT", "PARAGRAPH")
MEDICAL_FACTS = ("CONTRAINDICATION", "DOSAGE", "INTERACTION", "MONITORING", "INDICATION")


def protected(units: DataFrame, key: str) -> DataFrame:
    """Units (key, position, section_path, kind, text) where an exception is merged with the unit that it
    restricts, by a line break; atomic marks those and medical facts, which stay whole.

    An exception restricts nothing itself, so no unit is in two pairs, and windows suffice."""
    by = Window.partitionBy(key).orderBy("position")

    def joins(a: str, b: str, section: Column, other: Column) -> Column:
        return F.coalesce(F.col(a).isin(*EXCEPTED) & (F.col(b) == "EXCEPTION") & section.eqNullSafe(other), F.lit(False))

    near = units.withColumns({"_nk": F.lead("kind").over(by), "_nt": F.lead("text").over(by), "_ns": F.lead("section_path").over(by), "_pk": F.lag("kind").over(by), "_ps": F.lag("section_path").over(by)})
    takes, goes = joins("kind", "_nk", F.col("section_path"), F.col("_ns")), joins("_pk", "kind", F.col("section_path"), F.col("_ps"))
    rows = near.withColumns({"_takes": takes, "_goes": goes}).filter(~F.col("_goes"))
    text = F.when(F.col("_takes"), F.concat("text", F.lit("\n"), "_nt")).otherwise(F.col("text"))
    return rows.select(key, "position", "section_path", "kind", text.alias("text"), (F.col("_takes") | F.col("kind").isin(*MEDICAL_FACTS)).alias("atomic"))


def page_blocks(html: Column) -> Column:
    """array<struct(kind, text)> of a page's headings, paragraphs and list items, in order."""
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)(<(h[1-6]|p|li)\b[^>]*>.*?</\2>)"), F.lit(1))

    def made(b: Column) -> Column:
        tag = F.lower(F.regexp_extract(b, r"(?i)^<(h[1-6]|p|li)", 1))
        plain = F.regexp_replace(F.regexp_replace(b, r"(?s)<[^>]*>", " "), r"\s+", " ")
        return F.struct(F.when(tag.startswith("h"), "HEADING").when(tag == "li", "LIST_ITEM").otherwise("PARAGRAPH").alias("kind"), F.trim(plain).alias("text"))

    return F.filter(F.transform(blocks, made), lambda x: x["text"] != "")


# Phrases that class a unit, the first that fits; the first five hold in medicine only.
UNIT_RULES = (
    ("CONTRAINDICATION", True, "contraindicat|kontraindik|contre-indiqu|противопоказ"),
    ("DOSAGE", True, r"\bdos(e|age|is)\b|\bdosierung|posologie|дозиров"),
    ("INTERACTION", True, "interact|wechselwirk|взаимодейств"),
    ("MONITORING", True, "monitor|überwach|surveillance|контролир"),
    ("INDICATION", True, "indicated for|indication|angezeigt|показан"),
    ("EXCEPTION", False, r"\bexcept\b|\bunless\b|außer|sauf|salvo|за исключением"),
    ("PROHIBITION", False, r"must not|may not|prohibit|verboten|interdit|prohíb|запрещ"),
    ("OBLIGATION", False, r"\bmust\b|\bshall\b|\bmuss\b|\bdoit\b|\bdebe\b|обязан|должен"),
    ("RIGHT", False, r"\bmay\b|entitled|\bdarf\b|\bpeut\b|\bpuede\b|вправе"),
    ("DEADLINE", False, r"within \d+|deadline|\bfrist\b|\bdélai\b|\bplazo\b|\bсрок\b"),
)


def _begins(rule: str) -> list[str]:
    """What the phrases of a rule begin with; a bar in brackets is in a phrase."""
    phrases, depth = [""], 0
    for sign in rule.replace(r"\b", ""):
        depth += (sign == "(") - (sign == ")")
        phrases = [*phrases, ""] if sign == "|" and not depth else [*phrases[:-1], phrases[-1] + sign]
    return [re.split(r"[()\\]", phrase)[0] for phrase in phrases]


def _holds(low: Column, rule: str) -> Column:
    """Whether a rule fits a lower-case text; it is only tried where the text holds what one of its phrases begins with."""
    some = F.lit(False)
    for begin in _begins(rule):
        some = some | F.contains(low, F.lit(begin))
    return some & low.rlike(rule)


def unit_class(text: Column, domain: Column, marks: Column | None = None) -> Column:
    if marks is not None:
        return F.when(identifiers.marked(marks, ["UNIT"]), unit_class(text, domain)).otherwise("PARAGRAPH")

    def made(low: Column) -> Column:
        out = F.lit("PARAGRAPH")
        for name, medical, rule in reversed(UNIT_RULES):
            out = F.when((domain == "MEDICAL") & _holds(low, rule) if medical else _holds(low, rule), name).otherwise(out)
        return out

    return F.transform(F.array(F.lower(text)), made)[0]


_EXCEPTION = re.compile(next(rule for name, _, rule in UNIT_RULES if name == "EXCEPTION"))
_EXCEPTION_BEGINS = tuple(_begins(_EXCEPTION.pattern))
_RULES = tuple((name, medical, re.compile(rule)) for name, medical, rule in UNIT_RULES)


def unit_name(text: str, domain: str | None) -> str:
    """The class of one unit, as unit_class() has it."""
    low = text.lower()
    return next((name for name, medical, rule in _RULES if (domain == "MEDICAL" or not medical) and rule.search(low)), "PARAGRAPH")


_RULE_BEGINS = tuple(dict.fromkeys(begin for _, _, rule in UNIT_RULES for begin in _begins(rule)))


def marks(text: str) -> int:
    """The marks of a text: what identifiers and references can be in it, and whether a rule of unit_class() can fit."""
    low = text.lower()
    return identifiers.marks(text) | (identifiers.MARKS["UNIT"] if any(begin in low for begin in _RULE_BEGINS) else 0)
