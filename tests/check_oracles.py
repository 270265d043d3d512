"""Compare queries with their SQL: python tests/check_oracles.py [NAME...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def views(folder):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def rows(frame):
    """Rows as sorted tuples of text, columns by name."""

    def show(x):
        if hasattr(x, "tolist"):
            x = x.tolist()
        if isinstance(x, (list, tuple)):
            return [show(y) for y in x]
        if x is None or x != x:
            return "null"
        if isinstance(x, bool) or type(x).__name__ == "bool_":
            return str(bool(x))
        if isinstance(x, float):
            return f"{x:.7g}"
        return f"{x:.7g}" if hasattr(x, "dtype") and x.dtype.kind == "f" else str(x)

    frame = frame[sorted(frame.columns)]
    return sorted(str([show(x) for x in r]) for r in frame.itertuples(index=False, name=None))


def compare(spark, con, name, folder, queries, sql):
    got = queries[name](spark, folder).toArrow().to_pandas(integer_object_nulls=True)
    want = con.sql(sql[name]).to_arrow_table().to_pandas(integer_object_nulls=True)
    assert sorted(got.columns) == sorted(want.columns), (sorted(got.columns), sorted(want.columns))
    a, b = rows(got), rows(want)
    if a != b:
        extra, missing = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
        raise AssertionError(f"{name}: {len(a)} rows, {len(b)} wanted; only here {extra}; only there {missing}")
    return len(a)


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    spark = SparkSession.builder.master(f"local[{os.environ.get('TEST_CPUS', '4')}]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con, queries, sql, bad = views(folder), entry.queries(), entry.oracle_sql(), 0
    for name in sys.argv[1:] or [q for q in queries if q in sql]:
        began = time.time()
        try:
            n = compare(spark, con, name, folder, queries, sql) if name in sql else len(queries[name](spark, folder).collect())
            print("ok ", name, n, round(time.time() - began, 1), "" if name in sql else "no sql", flush=True)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print("BAD", name, str(e)[:700], flush=True)
    print("bad", bad)
