"""Adaptive time partitions: a table in files of bounded size, split by time only where it is dense.

Years are the first siblings. A node of more rows than the limit gives way to all its months, days or
hours. Siblings that fit are joined to runs in order of time as long as these fit. ROLLUP counts every
level, a self-join keeps the children of overfull nodes, sequences of the calendar add empty ones, and
aggregate() folds each sorted array of siblings into runs. Rows meet runs by range among siblings.

When a table is laid out again with more rows, files whose leaf, part and rows recur stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from galena.llm.common import joined_sha256, stored
from galena.sources.shared import shared_path

#: Runs, files and sorted stretches are broadcast up to so many rows, and joined by merge beyond.
BROADCAST = 50_000
#: Keeps the codes of the four levels apart; a date as a number is smaller.
LEVEL = 10**12
YEARS, MONTHS, DAYS, HOURS = 0, LEVEL, 2 * LEVEL, 3 * LEVEL
#: The group of rows without a moment.
NO_MOMENT = -1


def _bounded(df: DataFrame) -> DataFrame:
    """A stored table, to be broadcast if it is small enough; its rows are counted from its footers."""
    return F.broadcast(df) if df.count() <= BROADCAST else df.hint("merge")


def _node(y: Column, m: Column, d: Column) -> tuple[Column, Column, Column]:
    """Codes of a year, a month and a day as parents."""
    y, m, d = (c.cast("long") for c in (y, m, d))
    return F.lit(MONTHS) + y, F.lit(DAYS) + y * 100 + m, F.lit(HOURS) + (y * 100 + m) * 100 + d


def hour_counts(rows: DataFrame, moment: Column, **counts: Column) -> DataFrame:
    """(y, m, d, h, and a column for each of counts): how many rows of each hour meet a condition.
    Rows without a moment have a null hour."""
    at = moment.cast("timestamp_ntz")
    return rows.groupBy(F.year(at).alias("y"), F.month(at).alias("m"), F.dayofmonth(at).alias("d"), F.hour(at).alias("h")).agg(*[F.count_if(c).alias(n) for n, c in counts.items()])


def runs(hours: DataFrame, n: str, limit: int) -> DataFrame:
    """(group, first, last, n, leaf) of the leaves: siblings first to last under one parent, with n rows.

    hours has y, m, d, h and a count of rows named n; hours of no rows don't matter. leaf is the path of the
    parents and the run's first and last member, or "null" for rows without a moment. At most one leaf for
    each `limit` rows has more than that: hours, and "null". Each group of siblings has 31 members at
    most, but for the years."""
    some = hours.select("y", "m", "d", "h", F.col(n).cast("long").alias("n")).filter("n > 0")
    in_time = some.filter("y is not null")
    level = F.grouping_id()
    year, month, day = _node(F.col("y"), F.col("m"), F.col("d"))
    # Each node has the code of its parent, its own code as a parent, and its number among its siblings.
    nodes = in_time.rollup("y", "m", "d", "h").agg(F.sum("n").alias("n"), level.alias("level")).filter("level < 15")
    by_level = lambda *of: F.when(F.col("level") == 7, of[0]).when(F.col("level") == 3, of[1]).when(F.col("level") == 1, of[2]).otherwise(of[3])
    nodes = nodes.select(by_level(F.lit(YEARS), year, month, day).alias("group"), by_level(year, month, day, F.lit(None)).alias("code"), by_level(*map(F.col, "ymdh")).alias("member"), "level", "y", "m", "d", "n")
    nodes = stored(nodes, "nodes")
    full = nodes.filter((F.col("n") > limit) & F.col("code").isNotNull()).select("code", "level", "y", "m", "d")
    # All members of the calendar under each overfull node, and the years from the first to the last.
    months, days = F.sequence(F.lit(1), F.lit(12)), F.sequence(F.lit(1), F.dayofmonth(F.last_day(F.make_date("y", "m", F.lit(1)))))
    member = F.when(F.col("level") == 7, months).when(F.col("level") == 3, days).otherwise(F.sequence(F.lit(0), F.lit(23)))
    under = full.select(F.col("code").alias("group"), F.col("level").alias("above"), "y", "m", "d", F.explode(member).alias("member"))
    span = nodes.filter("level = 7").agg(F.min("y").alias("low"), F.max("y").alias("high")).filter("low is not null")
    years = span.select(F.lit(YEARS).cast("long").alias("group"), F.lit(15).cast("long").alias("above"), *[F.lit(None).cast("int").alias(c) for c in "ymd"], F.explode(F.sequence("low", "high")).alias("member"))
    counted = nodes.select("group", "member", "n").join(full.select(F.col("code").alias("group")), "group", "left_semi").union(nodes.filter("level = 7").select("group", "member", "n"))
    siblings = years.unionByName(under).join(counted, ["group", "member"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    sorted_siblings = siblings.groupBy("group", "above", "y", "m", "d").agg(F.array_sort(F.collect_list(F.struct("member", "n"))).alias("siblings"))

    def closed(acc: Column) -> Column:
        return F.when(acc["first"].isNull(), acc["runs"]).otherwise(F.concat(acc["runs"], F.array(F.struct(acc["first"].alias("first"), acc["last"].alias("last"), acc["n"].alias("n")))))

    def step(acc: Column, x: Column) -> Column:
        joins = acc["first"].isNotNull() & (acc["n"] + x["n"] <= limit)
        of = lambda made, first, n: F.struct(made.alias("runs"), first.alias("first"), x["member"].alias("last"), n.alias("n"))
        return F.when(joins, of(acc["runs"], acc["first"], acc["n"] + x["n"])).otherwise(of(closed(acc), x["member"], x["n"]))

    none = F.struct(F.array().cast("array<struct<first:int,last:int,n:bigint>>").alias("runs"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"), F.lit(0).cast("long").alias("n"))
    folded = sorted_siblings.select("group", "above", "y", "m", "d", F.explode(F.aggregate("siblings", none, step, closed)).alias("r"))
    # An overfull member makes a run of its own that nothing joins; it is a leaf only if it is an hour.
    leaves = folded.filter((F.col("r.n") > 0) & ((F.col("r.n") <= limit) | (F.col("above") == 1)))
    two = lambda c: F.format_string("%02d", c)
    four = lambda c: F.format_string("%04d", c)
    width = lambda c: F.when(F.col("above") == 15, four(c)).otherwise(two(c))
    parents = F.when(F.col("above") == 15, "").when(F.col("above") == 7, F.concat(four("y"), F.lit("/"))).when(F.col("above") == 3, F.concat(four("y"), F.lit("/"), two("m"), F.lit("/"))).otherwise(F.concat(four("y"), F.lit("/"), two("m"), F.lit("/"), two("d"), F.lit("/")))
    named = leaves.select("group", "r.first", "r.last", "r.n", F.concat(parents, width(F.col("r.first")), F.lit("-"), width(F.col("r.last"))).alias("leaf"))
    missing = some.filter("y is null").select(F.lit(NO_MOMENT).cast("long").alias("group"), F.lit(0).alias("first"), F.lit(0).alias("last"), "n", F.lit("null").alias("leaf"))
    return named.unionByName(missing)


@dataclass(frozen=True)
class Layout:
    """A table's columns, and names for what is added to them that none of them has."""

    columns: list[str]
    order: list[str]
    limit: int
    prefix: str

    def name(self, what: str) -> str:
        return f"{self.prefix}{what}"

    @property
    def file(self) -> list[str]:
        return [self.name(x) for x in ("group", "first", "part")]


def _layout(df: DataFrame, order: list[str], limit: int) -> Layout:
    prefix = "x_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = f"x{prefix}"
    return Layout(df.columns, order, limit, prefix)


def placed(df: DataFrame, moment: Column, leaves: DataFrame, at: Layout) -> DataFrame:
    """The rows with the group and first member of their leaf, its last member and name, and their part.

    A row belongs to a year, a month, a day and an hour, and to one run among the siblings of one of
    these. Leaves of more rows than the limit are sorted by range over all tasks; a row's place
    is that in its task behind the rows of the tasks before."""
    x = at.name
    when, group, member = x("moment"), x("g"), x("member")
    y, m, d = (f(F.col(when)).cast("long") for f in (F.year, F.month, F.dayofmonth))
    year, month, day = _node(y, m, d)
    sibling = lambda g, of: F.struct(g.cast("long").alias("g"), of.cast("int").alias("member"))
    own = F.when(F.col(when).isNull(), F.array(sibling(F.lit(NO_MOMENT), F.lit(0)))).otherwise(F.array(sibling(F.lit(YEARS), y), sibling(year, m), sibling(month, d), sibling(day, F.hour(when))))
    rows = df.withColumns({when: moment.cast("timestamp_ntz")}).withColumn(x("own"), F.explode(own))
    rows = rows.select(*map(_quoted, at.columns), when, F.col(f"{x('own')}.g").alias(group), F.col(f"{x('own')}.member").alias(member))
    names = {"group": x("group"), "first": x("first"), "last": x("last"), "n": x("n"), "leaf": x("leaf")}
    met = rows.join(_bounded(leaves.withColumnsRenamed(names)), (F.col(group) == F.col(x("group"))) & F.col(member).between(F.col(x("first")), F.col(x("last"))))
    met = met.select(*map(_quoted, at.columns), when, *names.values()).withColumn(x("tie"), row_hash(df, at.columns))
    fits = met.filter(F.col(x("n")) <= at.limit).withColumn(x("part"), F.lit(1).cast("long"))
    by = [x("group"), x("first"), when, *map(_quoted, at.order), x("tie")]
    large = met.filter(F.col(x("n")) > at.limit).repartitionByRange(*by).sortWithinPartitions(*by).withColumn(x("at"), F.monotonically_increasing_id())
    large = stored(large, "sorted")
    task = F.shiftright(x("at"), 33)
    stretches = large.groupBy(x("group"), x("first"), task.alias(x("task"))).agg(F.min(x("at")).alias(x("low")), F.count("*").alias(x("rows")))
    before = F.sum(x("rows")).over(Window.partitionBy(x("group"), x("first")).orderBy(x("task")).rowsBetween(Window.unboundedPreceding, -1))
    stretches = stored(stretches.withColumn(x("before"), F.coalesce(before, F.lit(0))).drop(x("rows")), "stretches")
    ranked = large.withColumn(x("task"), task).join(_bounded(stretches), [x("group"), x("first"), x("task")])
    place = f"({x('at')} - {x('low')} + {x('before')})"
    ranked = ranked.withColumn(x("part"), F.expr(f"{place} div {at.limit} + 1"))
    return fits.unionByName(ranked.select(*map(_quoted, fits.columns)))


def row_hash(df: DataFrame, columns: list[str], seed: int = 0) -> Column:
    """A hash of a row's columns; maps count as their JSON text."""
    kinds = dict(df.dtypes)
    return F.xxhash64(F.lit(seed), *[F.to_json(F.struct(F.col(_quoted(c)))) if "map<" in kinds[c] else F.col(_quoted(c)) for c in columns])


def contents(rows: DataFrame, df: DataFrame, at: Layout) -> DataFrame:
    """(group, first, part, last, leaf, and sums that tell contents apart) of each file of placed rows.
    Sums of two hashes, in halves, don't depend on the rows' order and count repeated rows."""
    sums = []
    for seed in (0, 1):
        h = row_hash(df, at.columns, seed)
        sums += [F.sum(F.shiftright(h, 32)).alias(f"high{seed}"), F.sum(h.bitwiseAND(0xFFFFFFFF)).alias(f"low{seed}")]
    keys = [F.col(at.name(c)).alias(c) for c in ("group", "first", "part", "last", "leaf")]
    return rows.groupBy(*keys).agg(F.count("*").alias("rows"), *sums)


def write(rows: DataFrame, folder: str, at: Layout) -> None:
    """Placed rows as one Parquet file for each leaf and part, in order. A file is written by one task,
    which sorts on disk where memory is short."""
    by = [*at.file, at.name("moment"), *map(_quoted, at.order), at.name("tie")]
    dealt = rows.repartition(*at.file).sortWithinPartitions(*by)
    dealt.select(*map(_quoted, at.columns), *at.file).write.mode("append").partitionBy(*at.file).parquet(folder)


def files(folder: str, df: DataFrame, at: Layout) -> DataFrame:
    """The rows in the folder with their file's group, first, part and path, and their place in it."""
    schema = StructType([StructField(f.name, f.dataType) for f in df.schema.fields] + [StructField(c, LongType()) for c in at.file])
    read = df.sparkSession.read.schema(schema).parquet(folder)
    return read.select("*", F.col("_metadata.file_path").alias(at.name("path")), F.col("_metadata.row_index").alias(at.name("index")))


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def delete(df: DataFrame, paths: list[str]) -> None:
    spark = df.sparkSession
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, False)


def rewritten(df: DataFrame, moment: Column, order: list[str], earlier: Column, id_col: str, limit: int, folder: str | None = None) -> DataFrame:
    """Write the rows for which `earlier` holds, then lay the folder out again for all rows of df.

    Rows go to leaves by `moment` (a column of timestamps, or null), within a leaf by moment, then by the
    columns `order` (nulls first), then by a hash of the row; files have `limit` rows at most. Where all of a
    leaf's part recurs, its file stays; the other files of the first layout are removed once the new ones are
    written. Returns a row for each file: leaf, columns, ids_sha256 (of its ids as text, with commas between; a null
    id is empty), path, part, n_rows, n_new (rows that were not there earlier) and rewritten.

    A null of `earlier` counts as false. Repeated rows all stay. No rows give no files. Other columns of df
    are written as they are, whatever their names.

    Counts by hour, nodes, runs and files are tables; the driver counts them and gets the paths of files
    to remove. Files, and so those paths, are as many as rows / limit, times a small factor.
    """
    spark = df.sparkSession
    folder = folder or shared_path(spark, "time-partitions")
    at = _layout(df, order, limit)
    earlier = F.coalesce(earlier, F.lit(False))
    hours = stored(hour_counts(df, moment, all_rows=F.lit(True), earlier_rows=earlier), "hours")
    # The first layout.
    rows = placed(df.filter(earlier), moment, stored(runs(hours, "earlier_rows", limit), "runs"), at)
    write(rows, folder, at)
    old = stored(contents(rows, df, at), "old")
    x = at.name
    paths = files(folder, df, at).select(*[F.col(x(c)).alias(c) for c in ("group", "first", "part", "path")]).distinct()
    old = stored(old.join(paths, ["group", "first", "part"]), "old-files")
    # The second; what recurs is not written again.
    rows = placed(df, moment, stored(runs(hours, "all_rows", limit), "runs"), at)
    new = stored(contents(rows, df, at), "new")
    stay = stored(old.join(new, new.columns, "left_semi").select("group", "first", "part", "path"), "stay")
    changed = stored(new.join(stay, ["group", "first", "part"], "left_anti").select(*[F.col(c).alias(x(c)) for c in ("group", "first", "part")]), "changed")
    if not changed.isEmpty():
        write(rows.join(_bounded(changed), at.file, "left_semi"), folder, at)
    delete(df, [r["path"] for r in old.join(stay, "path", "left_anti").select("path").toLocalIterator()])
    # What is in the folder now.
    found = files(folder, df, at)
    ids = F.coalesce(F.col(_quoted(id_col)).cast("string"), F.lit(""))
    read = found.select(F.col(x("path")).alias("path"), F.col(x("index")).alias("at"), ids.alias("piece"), (~earlier).alias("flag"))
    digests = joined_sha256(read, "path", ["at"], ",")
    names = found.select(*[F.col(x(c)).alias(c) for c in ("group", "first", "part", "path")]).distinct()
    named = names.join(new.select("group", "first", "part", "leaf"), ["group", "first", "part"])
    out = digests.join(named, "path").join(stay.select("path", F.lit(False).alias("rewritten")), "path", "left")
    return out.select("leaf", F.lit(",".join(df.columns)).alias("columns"), F.col("sha256").alias("ids_sha256"), "path", F.col("part").cast("long").alias("part"), F.col("n").alias("n_rows"), F.col("flagged").alias("n_new"), F.coalesce("rewritten", F.lit(True)).alias("rewritten"))
