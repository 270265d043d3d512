"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A digest goes to one cell of each third of a sketch; a cell holds a count and the exclusive ors
of its digests and of their checks. Sketches of two versions subtract cell by cell: what both
hold cancels, and peeling cells that hold one digest recovers the digests that differ. The
returned fingerprints are the sketches that are subtracted first. Where they do not peel, the pair
is tried again with larger sketches, of which a fingerprint is the folded form: cells of a third
are counted in powers of two.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galena.llm.common import stored

#: Cells of the fingerprint (3 times a power of two), and how often its cells are searched, a third
#: at a time. A larger sketch has so many cells for each digest of the pair, rounded up to 3 times a
#: power of two: it is so empty that one search of each third nearly always peels it. Cells that are
#: zero are not held. A sketch that fails is made so much larger, up to a limit that only an error
#: could reach.
CELLS, SEARCHES, SPARE, GROWTH, LARGEST = 48, 12, 32, 16, 3 << 55
#: Code points of a paragraph's pieces at most; documents that one task orders; limit on the number
#: of id ranges; digests of larger sketches that one task peels.
PIECE, RANGE_ROWS, RANGES, TASK_DIGESTS = 240, 1000, 1 << 16, 100_000
#: Texts of fewer code points have smaller pieces as well: half a text need not hold a paragraph.
SHORT = 2 * PIECE


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where the value is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def digests(text: Column) -> Column:
    """Distinct digests of a text's paragraphs: lines, of which long ones are cut behind the last
    sentence within PIECE code points, or there. The pieces joined are the text.

    A text of fewer than SHORT code points also has digests of its pieces of two even sizes, an eighth of
    its length to a quarter and half of that, as powers of two: a text and a version of at least half its
    length have one of the sizes in common."""
    pieces = F.regexp_extract_all(text, F.lit(rf"[^\n]{{0,{PIECE - 1}}}[.!?][\t ]*\n*|[^\n]{{1,{PIECE}}}\n*|\n+"), F.lit(0))
    whole = F.transform(pieces, lambda p: F.xxhash64(p))
    n = F.char_length(text)
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(n, F.lit(4)) / 4))).cast("int")
    even = lambda p: F.transform(F.sequence(F.lit(0), F.floor((n - 1) / p).cast("int")), lambda i: F.xxhash64(F.substring(text, i * p + 1, p), p))
    small = F.flatten(F.transform(F.array(step, F.greatest(F.lit(1), (step / 2).cast("int"))), even))
    return F.array_distinct(F.when((n > 0) & (n < SHORT), F.concat(whole, small)).otherwise(whole))


def _cell(digest: Column, third: int, cells: int | Column) -> Column:
    """The digest's cell in a third; folding a sketch keeps the cell's place modulo the size."""
    size = F.lit(cells // 3).cast("long") if isinstance(cells, int) else (cells / 3).cast("long")
    return third * size + F.pmod(F.xxhash64(digest, F.lit(third)), size)


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(99))


def _placed(digest: Column, n: Column) -> Column:
    places = [_cell(digest, t, CELLS).cast("int").alias(f"p{t}") for t in range(3)]
    return F.struct(n.alias("n"), digest.alias("d"), _check(digest).alias("c"), *places)


def _there(placed: Column, i: Column) -> Column:
    return (placed["p0"] == i) | (placed["p1"] == i) | (placed["p2"] == i)


def _added(listed: Column, start: Column) -> Column:
    """The cell `start` with placed digests added."""
    n = F.aggregate(listed, start["n"], lambda acc, x: acc + x["n"])
    d = F.aggregate(listed, start["d"], lambda acc, x: acc.bitwiseXOR(x["d"]))
    c = F.aggregate(listed, start["c"], lambda acc, x: acc.bitwiseXOR(x["c"]))
    return F.struct(n.alias("n"), d.alias("d"), c.alias("c"))


def _zero() -> Column:
    return F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("c"))


def sketch(listed: Column) -> Column:
    """The CELLS cells of some digests: count, digests and checks."""
    one = F.lit(1).cast("long")
    cells = lambda ps: F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda i: _added(F.filter(ps, lambda p: _there(p, i)), _zero()))
    return _bound(F.transform(listed, lambda d: _placed(d, one)), cells)


def written(cells: Column) -> Column:
    """A sketch as text: of each cell the count, digests and checks in base 16."""
    return F.array_join(F.transform(cells, lambda x: F.concat_ws(".", F.hex(x["n"]), F.hex(x["d"]), F.hex(x["c"]))), "-")


def less(left: Column, right: Column) -> Column:
    """A sketch less another one, cell by cell."""
    return F.zip_with(left, right, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["d"].bitwiseXOR(y["d"]).alias("d"), x["c"].bitwiseXOR(y["c"]).alias("c")))


def _filled(x: Column) -> Column:
    return (x["n"] != 0) | (x["d"] != 0) | (x["c"] != 0)


def peeled_row(cells: Column) -> Column:
    """Peel a subtracted fingerprint: peeled (whether nothing is left), l and r (recovered digests
    that only the left or the right sketch holds)."""
    third = CELLS // 3

    def search(state: Column, k: Column) -> Column:
        pure = F.filter(F.slice(state["cells"], (k % 3) * third + 1, third), lambda x: (F.abs(x["n"]) == 1) & (x["c"] == _check(x["d"])))

        def taken(ps: Column) -> Column:
            rest = F.transform(state["cells"], lambda x, i: _bound(F.filter(ps, lambda p: _there(p, i)), lambda hit: F.when(F.size(hit) == 0, x).otherwise(_added(hit, x))))
            right = F.size(F.filter(ps, lambda p: p["n"] > 0))  # taking n away undoes the sign
            return F.when(F.size(ps) == 0, state).otherwise(F.struct(rest.alias("cells"), (state["l"] + F.size(ps) - right).alias("l"), (state["r"] + right).alias("r")))

        return _bound(F.transform(pure, lambda x: _placed(x["d"], -x["n"])), taken)

    start = F.struct(cells.alias("cells"), F.lit(0).alias("l"), F.lit(0).alias("r"))
    end = lambda s: F.struct((F.size(F.filter(s["cells"], _filled)) == 0).alias("peeled"), s["l"].cast("long").alias("l"), s["r"].cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(SEARCHES - 1)), start, search, end)


def subtracted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Cells (keys, size, cell, n, d, c) of a's sketch less b's, of the row's size, without zeros."""
    one = F.lit(1).cast("long")
    signed = F.concat(F.transform("a", lambda d: F.struct(d.alias("d"), one.alias("n"))), F.transform("b", lambda d: F.struct(d.alias("d"), (-one).alias("n"))))
    each = rows.select(*keys, "size", F.explode(signed).alias("x")).select(*keys, "size", "x.d", "x.n")
    cells = each.select(*keys, "size", "d", "n", _check(F.col("d")).alias("c"), F.explode(F.array(*[_cell(F.col("d"), t, F.col("size")) for t in range(3)])).alias("cell"))
    cells = cells.groupBy(*keys, "size", "cell").agg(F.sum("n").alias("n"), F.bit_xor("d").alias("d"), F.bit_xor("c").alias("c"))
    return cells.filter("n <> 0 or d <> 0 or c <> 0")


def peeled(cells: DataFrame, keys: list[str], searches: int = 3, recovered: bool = False) -> DataFrame:
    """Peel subtracted sketches of any size. cells: keys, size, cell, n, d, c.

    Returns keys, size, l and r (numbers of recovered digests), left_over (cells that did not
    peel), and with `recovered` the digests themselves. Every search of a third is one expansion and
    one sum by key; where cells are partitioned by the keys, none moves rows.
    """
    by = [*keys, "size", "cell", "digest"]
    now = cells.withColumns({"digest": F.lit(0).cast("long"), "l": F.lit(0).cast("long"), "r": F.lit(0).cast("long")})
    for k in range(searches):
        third = k % 3
        low = F.col("size") / 3 * third
        pure = (F.col("cell") >= low) & (F.col("cell") < low + F.col("size") / 3) & (F.abs("n") == 1) & (F.col("c") == _check(F.col("d")))
        zero = F.lit(0).cast("long")
        row = lambda cell, n, d, c, digest, left, right: F.struct(cell.alias("cell"), n.alias("n"), d.alias("d"), c.alias("c"), digest.alias("digest"), left.alias("l"), right.alias("r"))
        others = [row(_cell(F.col("d"), t, F.col("size")), -F.col("n"), F.col("d"), F.col("c"), zero, zero, zero) for t in range(3) if t != third]
        out = row(F.lit(-1).cast("long"), zero, zero, zero, F.col("d") if recovered else zero, (F.col("n") > 0).cast("long"), (F.col("n") < 0).cast("long"))
        same = row(F.col("cell"), F.col("n"), F.col("d"), F.col("c"), F.col("digest"), F.col("l"), F.col("r"))
        spread = now.select(*keys, "size", F.explode(F.when(pure, F.array(*others, out)).otherwise(F.array(same))).alias("x")).select(*keys, "size", "x.*")
        now = spread.groupBy(*by).agg(F.sum("n").alias("n"), F.bit_xor("d").alias("d"), F.bit_xor("c").alias("c"), F.sum("l").alias("l"), F.sum("r").alias("r"))
        now = now.filter("n <> 0 or d <> 0 or c <> 0 or l <> 0 or r <> 0")
    sums = [F.sum("l").alias("l"), F.sum("r").alias("r"), F.sum((F.col("cell") >= 0).cast("long")).alias("left_over")]
    if recovered:
        sums.append(F.collect_list(F.when(F.col("cell") < 0, F.col("digest"))).alias("digests"))
    return now.groupBy(*keys, "size").agg(*sums)


def differences(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, l, r) of the pairs (keys, a, b: digests) by larger sketches; a pair without any
    difference is not returned.

    The first sketch of a pair has SPARE cells for each of its digests. Pairs that do not peel are
    carried on with larger ones; each try is stored. Keys are dealt out before digests expand.
    """
    many = F.size("a") + F.size("b")
    size = (3 * F.pow(F.lit(2.0), F.ceil(F.log2(many * (SPARE / 3) + 1)))).cast("long")
    now, tried = pairs.select(*keys, "a", "b", size.alias("size")), []
    while total := now.agg(F.sum(many).alias("n")).first()["n"]:
        dealt = now.repartition(math.ceil(total / TASK_DIGESTS), *keys)
        tried.append(stored(peeled(subtracted(dealt, keys), keys), "peeled"))
        failed = tried[-1].filter("left_over > 0").select(*keys, (F.col("size") * GROWTH).alias("size"))
        if not failed.filter(F.col("size") > LARGEST).isEmpty():
            raise RuntimeError("a pair of sketches does not peel at any size")
        now = pairs.join(failed, keys)
    out = [t.filter("left_over = 0").select(*keys, "l", "r") for t in tried]
    for more in out[1:]:
        out[0] = out[0].union(more)
    return out[0] if out else pairs.limit(0).select(*keys, F.lit(0).cast("long").alias("l"), F.lit(0).cast("long").alias("r"))


def _range_of(value: Column, bounds: list) -> tuple[Column, Column]:
    """The number of the range that a value is in, and whether it is the range's least value; bounds are these."""
    if not bounds:
        return F.lit(0), F.lit(False)
    width = max(1, int(len(bounds) ** 0.5))
    head = F.greatest(F.lit(0), F.size(F.filter(F.array(*map(F.lit, bounds[::width])), lambda x: x <= value)) - 1)
    groups = F.array(*[F.array(*map(F.lit, bounds[i : i + width])) for i in range(0, len(bounds), width)])
    inside = F.greatest(F.lit(0), F.size(F.filter(F.get(groups, head), lambda x: x <= value)) - 1)
    return head * width + inside, value == F.get(F.get(groups, head), inside)


def _in_ranges(docs: DataFrame, marks: list, bounds: list) -> DataFrame:
    """Rows with their range, of the texts' hashes for null ids and of ids behind these, and a second copy
    of each range's first rows for the range before, so that every row meets the next one; the very first
    also follow the last."""
    (by_mark, opens_mark), (by_id, opens_id) = _range_of(F.xxhash64("text"), marks), _range_of(F.col("id"), bounds)
    null = F.col("id").isNull()
    rows = docs.withColumn("own", F.when(null, by_mark).otherwise(len(marks) + by_id).cast("int")).withColumn("opens", F.when(null, opens_mark).otherwise(opens_id))
    last = max(len(marks) + len(bounds) - 1, 0)
    none = F.lit(None).cast("int")
    before, behind = F.when(F.col("opens") & (F.col("own") > 0), F.col("own") - 1).otherwise(none), F.when(F.col("opens") & (F.col("own") == 0), F.lit(last)).otherwise(none)
    places = F.array(*[F.struct(part.alias("part"), F.lit(extra).alias("extra")) for extra, part in enumerate((F.col("own"), before, behind))])
    return rows.withColumn("place", F.explode(F.filter(places, lambda p: p["part"].isNotNull()))).select("*", "place.part", "place.extra").drop("place", "own", "opens")


def _bounds(keys: DataFrame, rows: int) -> list:
    """The least keys (column k) of ranges of about RANGE_ROWS rows, RANGES at most."""
    if not rows:
        return []
    dealt = keys.repartitionByRange(min(RANGES, math.ceil(rows / RANGE_ROWS)), "k")
    return sorted({r["low"] for r in dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("low")).collect()})


def edited_versions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame | None:
    """Each text with its edited version and the next text's digests, by one shuffle of the texts.

    Columns id, n_chars, edited_sha256, a, e, n (digests of the text, of the edited and of the next
    one). Null ids come first; rows that share an id are ordered by their texts. Ids are dealt out
    by ranges of about RANGE_ROWS rows, whose bounds come to the driver: RANGES ids at most.
    """
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    count = docs.agg(F.count("*").alias("n"), F.count("id").alias("filled")).first()
    if not count["n"]:
        return None
    marks = _bounds(docs.filter("id is null").select(F.xxhash64("text").alias("k")), count["n"] - count["filled"])
    rows = _in_ranges(docs, marks, _bounds(docs.select(F.col("id").alias("k")).filter("k is not null"), count["filled"])).withColumn("a", digests(F.col("text")))
    order = Window.partitionBy("part").orderBy("extra", F.asc_nulls_first("id"), F.xxhash64("text"), "text")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumns({"after": F.lead("text").over(order), "n": F.lead("a").over(order)}).filter("extra = 0").withColumn("n_chars", F.char_length("text").cast("long"))
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("after", F.lit(1), half))
    rows = rows.withColumn("edited", edited)
    return rows.select("id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "a", digests(F.col("edited")).alias("e"), "n")


def fingerprinted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text.

    The edited text has its last floor(n_chars / 2) code points replaced by as many first ones of
    the next document, or all. Returns id_col, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited and near_next: likeness is the share of common digests among
    all, from the digests that peeling recovers; two texts without any are alike (1). Null texts
    count as empty. Null ids come first, rows that share an id follow one another by text; a
    single row is its own next. Other columns are not read; an empty table gives an empty table.
    Rows are in no order.
    """
    versions = edited_versions(df, id_col, text_col)
    kind = df.select(id_col).dtypes[0][1]
    if versions is None:
        return df.sparkSession.createDataFrame([], f"{id_col} {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    sketches = versions.select("*", *[sketch(F.col(c)).alias(f"s{c}") for c in "aen"])
    tried = sketches.select("*", *[peeled_row(less(F.col("sa"), F.col(f"s{c}"))).alias(f"p{c}") for c in "en"])
    done = F.col("pe.peeled") & F.col("pn.peeled")
    listed = [F.when(~done, F.col(c)).alias(c) for c in "aen"]
    sizes = [F.size(c).cast("long").alias(f"n{c}") for c in "aen"]
    # Cells are stored as numbers, which take half the room of their text.
    rows = stored(tried.select(F.monotonically_increasing_id().alias("uid"), "id", "n_chars", "edited_sha256", "sa", "se", "pe", "pn", *sizes, *listed), "fingerprints")
    failed = F.filter(F.array(*[F.when(~F.col(f"p{c}.peeled"), F.struct(F.lit(c).alias("pair"), F.col(c).alias("b"))) for c in "en"]), lambda x: x.isNotNull())
    pairs = rows.filter(~done).select("uid", "a", F.explode(failed).alias("x")).select("uid", "x.pair", "a", "x.b")
    found = differences(pairs, ["uid", "pair"]).groupBy("uid").agg(*[F.sum(F.when(F.col("pair") == c, F.col(k))).alias(f"{k}{c}") for c in "en" for k in "lr"])

    def near(c: str, left: Column) -> Column:
        common = F.col("na") - left
        union = F.col("na") + F.col(f"n{c}") - common
        return F.when(union > 0, common / union).otherwise(1.0)

    def result(of: DataFrame, larger: bool) -> DataFrame:
        left = {c: F.when(F.col(f"p{c}.peeled"), F.col(f"p{c}.l")).otherwise(F.coalesce(F.col(f"l{c}"), F.lit(0))) if larger else F.col(f"p{c}.l") for c in "en"}
        return of.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", written(F.col("sa")).alias("fingerprint"), written(F.col("se")).alias("edited_fingerprint"), near("e", left["e"]).alias("near_edited"), near("n", left["n"]).alias("near_next"))

    open_rows = rows.filter(~done).drop(*"aen").hint("merge").join(found.hint("merge"), "uid", "left")
    return result(rows.filter(done), False).union(result(open_rows, True))
