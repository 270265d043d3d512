"""The cuckoo filter and its index against sets, and the groups against a dictionary."""

import hashlib
import random
import re

import numpy as np
import pytest

from galena.llm import cuckoo


def digests(values):
    return np.frombuffer(b"".join(hashlib.sha256(str(v).encode()).digest() for v in values), np.uint8).reshape(-1, 32)


def test_filter_holds_what_is_in_it_and_grows():
    full = cuckoo.Cuckoo(4)
    assert not full.insert(digests(range(100)))  # 64 slots
    made = cuckoo.Cuckoo.built(digests(range(5000)))
    assert made.holds(digests(range(5000))).all() and (made.table > 0).sum() == 5000
    assert made.holds(digests(range(10_000, 30_000))).mean() < 0.01
    made.delete(digests(range(0, 5000, 2)))
    assert (made.table > 0).sum() == 2500 and made.holds(digests(range(1, 5000, 2))).all()
    assert made.holds(digests(range(0, 5000, 2))).mean() < 0.01


def test_filter_with_equal_fingers():
    same = np.repeat(digests([1]), 8, axis=0)
    made = cuckoo.Cuckoo(6)
    assert made.insert(same) and (made.table > 0).sum() == 8
    made.delete(same[:5])
    assert (made.table > 0).sum() == 3 and made.holds(same[:1]).all()
    assert not cuckoo.Cuckoo(6).insert(np.repeat(digests([1]), 9, axis=0))


def frame(spark, pairs):
    return spark.createDataFrame([(bytearray(digests([v]).tobytes()), i, r) for v, i, r in pairs], "digest binary, id long, row long")


def held(index):
    return {bytes(r["digest"]): (r["first"]["id"], r["n"]) for r in index.classes().collect()}


def asked(index, values):
    rows = index.sharded(index.spark.createDataFrame([(bytearray(digests([v]).tobytes()),) for v in values], "digest binary"))
    probed = index.probed(rows)
    sure = {bytes(r["digest"]) for r in probed.collect() if not r["seen"]}
    return sure, {bytes(r["digest"]) for r in index.confirmed(probed).collect()}


def test_index_inserts_deletes_and_resizes(spark, monkeypatch):
    index = cuckoo.Index(spark, 3)
    index = index.insert(frame(spark, [(v, v, v) for v in range(40)]))
    bits = {r["shard"]: r["bits"] for r in index.filters.collect()}
    index = index.insert(frame(spark, [(v, 1000 + v, 1000 + v) for v in range(30, 400)]))
    later = {r["shard"]: r["bits"] for r in index.filters.collect()}
    assert set(later) == set(bits) == {0, 1, 2} and all(later[s] > bits[s] for s in bits)  # overflow
    name = lambda v: digests([v]).tobytes()
    assert held(index) == {name(v): (v if v < 40 else 1000 + v, 2 if 30 <= v < 40 else 1) for v in range(400)}
    slots = sum((np.frombuffer(r["slots"], np.uint16) > 0).sum() for r in index.filters.collect())
    assert slots == 400
    # Digests go with their last row; of 30 to 39 one row is left, and what was never there changes nothing.
    index = index.delete(frame(spark, [(v, v, v) for v in range(20, 40)] + [(5, 77, 77), (5000, 1, 1)]))
    want = {name(v): (v if v < 20 else 1000 + v, 1) for v in range(400) if not 20 <= v < 30}
    assert held(index) == want
    assert sum((np.frombuffer(r["slots"], np.uint16) > 0).sum() for r in index.filters.collect()) == 390
    sure, live = asked(index, range(600))
    assert live == set(want) and not sure & live and len(sure) > 150
    # What has gone can come back.
    index = index.insert(frame(spark, [(25, 9, 9), (25, 8, 8)]))
    assert held(index)[name(25)] == (8, 2)


HARD = [(1, "a  b"), (2, "a\t\nb"), (3, "a b"), (4, "a b "), (5, None), (6, ""), (7, " "), (8, "\x0b\x0c"), (9, "a b"), (3, "a b"), (None, "a b"), (None, "only"), (None, "only"), (10, "é " * 50_000), (11, "é\r" * 50_000), (0, "x"), (12, "x"), (12, "x")]


@pytest.mark.parametrize("blocks", [1, 3])
def test_duplicates(spark, blocks):
    more = [(100 + i, random.Random(i % 37).choice("abc") * (i % 29) + " z") for i in range(300)]
    rows = HARD + more
    frame = spark.createDataFrame([(i, t, "k", 1, b"d", 3) for i, t in rows], "doc_id long, text string, id string, row int, digest binary, first int").repartition(5)
    groups = {}
    for i, t in rows:
        groups.setdefault(hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest(), []).append(i)
    out = cuckoo.duplicates(frame, blocks=blocks).collect()
    assert sorted((str(r["doc_id"]), r["text_sha256"]) for r in out) == sorted((str(i), d) for d, ids in groups.items() for i in ids)
    for d, ids in groups.items():
        mine = [r for r in out if r["text_sha256"] == d]
        least = min((i for i in ids if i is not None), default=None)
        assert {(r["keep_id"], r["group_size"]) for r in mine} == {(least, len(ids))}
        assert [r["doc_id"] for r in mine if r["kept"]] == [least]
    assert cuckoo.duplicates(frame.limit(0)).collect() == []
