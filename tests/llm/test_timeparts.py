"""Time partitions against a plain version that walks the calendar, file by file."""

import calendar
import datetime as dt
import glob
import hashlib
import random
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from galena.llm import timeparts
from galena.llm.queries import click_moment, op12_time_partitions

CUT = dt.datetime(2024, 5, 1)


def leaves(moments, limit):
    """{leaf: indexes} of moments (or None), by recursion."""
    found = {}

    def split(inside, members, path, of, show):
        open_run, total = None, 0

        def close(open_run):
            if open_run:
                ids = [i for _, own in open_run for i in own]
                if ids:
                    found[f"{path}{show(open_run[0][0])}-{show(open_run[-1][0])}"] = ids

        for m in members:
            own = [i for i in inside if of(moments[i]) == m]
            if len(own) > limit:
                close(open_run)
                open_run = None
                if show is years:
                    split(own, range(1, 13), f"{m:04d}/", lambda t: t.month, two)
                elif path.count("/") == 1:
                    last = calendar.monthrange(int(path[:4]), m)[1]
                    split(own, range(1, last + 1), f"{path}{m:02d}/", lambda t: t.day, two)
                elif path.count("/") == 2:
                    split(own, range(24), f"{path}{m:02d}/", lambda t: t.hour, two)
                else:
                    found[f"{path}{m:02d}-{m:02d}"] = own
            elif open_run and total + len(own) <= limit:
                open_run.append((m, own))
                total += len(own)
            else:
                close(open_run)
                open_run, total = [(m, own)], len(own)
        close(open_run)

    years = "{:04d}".format
    two = "{:02d}".format
    timed = [i for i, m in enumerate(moments) if m is not None]
    if timed:
        ys = [moments[i].year for i in timed]
        split(timed, range(min(ys), max(ys) + 1), "", lambda t: t.year, years)
    if len(timed) < len(moments):
        found["null"] = [i for i, m in enumerate(moments) if m is None]
    return found


def laid_out(rows, moment, limit):
    """{(leaf, part): rows in order}, of rows (click_id, ts, arrived_at, value)."""
    out = {}
    low = dt.datetime.min
    for leaf, ids in leaves([moment(r) for r in rows], limit).items():
        own = sorted((rows[i] for i in ids), key=lambda r: (moment(r) or low, r[2] or low, -1 if r[0] is None else r[0]))
        for k in range(0, len(own), limit):
            out[leaf, k // limit + 1] = own[k : k + limit]
    return out


def check(got, rows, moment, limit, columns):
    known = [r for r in rows if r[2] is not None and r[2] < CUT]
    old, new = laid_out(known, moment, limit), laid_out(rows, moment, limit)
    assert {(r["leaf"], r["part"]) for r in got} == set(new)
    same = lambda some: sorted(map(repr, some))
    for r in got:
        own = new[r["leaf"], r["part"]]
        ids = ",".join("" if x[0] is None else str(x[0]) for x in own)
        assert r["n_rows"] == len(own) and r["ids_sha256"] == hashlib.sha256(ids.encode()).hexdigest()
        assert r["n_new"] == sum(x[2] is None or x[2] >= CUT for x in own) and r["columns"] == columns
        stays = (r["leaf"], r["part"]) in old and same(old[r["leaf"], r["part"]]) == same(own)
        assert r["rewritten"] is not stays
        file = pq.ParquetFile(r["path"].removeprefix("file:")).read()
        assert ",".join(file.column_names) == columns
        read = list(zip(*(file[c].to_pylist() for c in ("click_id", "ts", "arrived_at", "value")), strict=True))
        assert same(read) == same(own) and [x[0] for x in read] == [x[0] for x in own]
    folder = got[0]["path"].removeprefix("file:").split("/x")[0]
    on_disk = {f for f in glob.glob(f"{folder}/**/*.parquet", recursive=True)}
    assert on_disk == {"/" + r["path"].removeprefix("file:").lstrip("/") for r in got}
    return old, new


def made(n, seed):
    r = random.Random(seed)
    at = lambda low, days: low + dt.timedelta(microseconds=r.randrange(days * 86_400_000_000))
    rows = []
    for i in range(n):
        kind = r.random()
        if kind < 0.35:  # one hour holds a third of all rows
            ts = dt.datetime(2024, 3, 4, 5) + dt.timedelta(seconds=r.randrange(3))
        elif kind < 0.45:
            ts = None
        elif kind < 0.8:
            ts = at(dt.datetime(2024, 1, 1), 150)
        else:
            ts = at(dt.datetime(1996, 2, 1), 9000)
        arrived = r.choice([None, dt.datetime(2024, 5, 2), dt.datetime(2024, 4, 30, 23, 59, 59, 999999), CUT]) if r.random() < 0.03 else dt.datetime(2024, 2, r.randint(1, 9))
        rows.append((None if r.random() < 0.02 else r.randrange(n), ts, arrived, r.randrange(5)))
    return rows + rows[: n // 10]


@pytest.mark.parametrize("n,limit", [(600, 7), (900, 40)])
def test_rewritten(spark, n, limit):
    rows = made(n, n)
    frame = spark.createDataFrame([(*r, "k", 1, 2, 3, {"a": 1}) for r in rows], "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, value int, x_group string, first int, part int, `leaf.n` int, m map<string,int>").repartition(3)
    known = F.col("arrived_at") < F.lit(CUT).cast("timestamp_ntz")
    got = timeparts.rewritten(frame, F.col("ts"), ["arrived_at", "click_id"], known, "click_id", limit).collect()
    old, new = check(got, rows, lambda r: r[1], limit, ",".join(frame.columns))
    assert any(r["rewritten"] for r in got) and not all(r["rewritten"] for r in got)
    assert max(r["part"] for r in got) > 3 and {"null", *[k for k, _ in new]} == {k for k, _ in new}


def test_no_rows_and_only_nulls(spark):
    none = spark.createDataFrame([], "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, value int")
    known = F.col("arrived_at") < F.lit(CUT).cast("timestamp_ntz")
    assert timeparts.rewritten(none, F.col("ts"), ["arrived_at", "click_id"], known, "click_id", 3).collect() == []
    rows = [(i % 3, None, None, i % 3) for i in range(7)]
    frame = spark.createDataFrame(rows, none.schema)
    check(timeparts.rewritten(frame, F.col("ts"), ["arrived_at", "click_id"], known, "click_id", 3).collect(), rows, lambda r: r[1], 3, "click_id,ts,arrived_at,value")


def moment(r):
    if r[1] is None or r[0] is None:
        return r[1]
    k = zlib.crc32(str(r[0]).encode()) % 128
    if k < 16:
        return r[1] - dt.timedelta(days=(k + 6) ** 3)
    if k > 111:
        return dt.datetime.combine(r[1].date() - dt.timedelta(days=r[1].weekday()), dt.time())
    return r[1]


def test_query_over_its_table_with_late_rows(spark, sf, tmp_path):
    clicks = spark.read.parquet(f"{sf}/clicks.parquet")
    late = F.when(F.col("click_id") % 37 == 5, F.lit("2024-05-03 00:00:00").cast("timestamp_ntz")).otherwise(F.col("arrived_at"))
    clicks.withColumn("arrived_at", late).write.parquet(f"{tmp_path}/clicks.parquet")
    rows = [(r["click_id"], r["ts"], r["arrived_at"], r["value"]) for r in spark.read.parquet(f"{tmp_path}/clicks.parquet").collect()]
    got = op12_time_partitions(spark, f"file://{tmp_path}").collect()
    check(got, rows, moment, 1 + len(rows) // 500, ",".join(clicks.columns))
    assert spark.createDataFrame([(5, dt.datetime(2024, 1, 3, 4), dt.datetime(2024, 1, 3, 4), 1)], "i long, t timestamp_ntz, a timestamp_ntz, v int").select(click_moment(F.col("t"), F.col("i"))).first()[0] == moment((5, dt.datetime(2024, 1, 3, 4)))
