"""Repair of conversations against all possible edits, and the registered query against its SQL."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from galena.llm import repair

SPACE = " \t\n\x0b\x0c\r"


def faults(rows):
    """First faults of (turn, role, text) in order."""
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """(cost, audit, lines) by trying everything; more than one insertion costs more than deleting four turns."""
    best = None
    slots = [""] * (len(rows) + 1)
    for where in [None, *range(len(rows) + 1)]:
        before = list(slots)
        if where is not None:
            before[where] = "I"
        for letters in itertools.product("KRD", repeat=len(rows)):
            if any(f in ("blank", "duplicate") and c != "D" for f, c in zip(found, letters, strict=True)):
                continue
            audit = "".join(b + c for b, c in zip(before, [*letters, ""], strict=True))
            free = audit.replace("D", "")
            for names in itertools.product(("user", "assistant"), repeat=sum(c != "K" for c in free)):
                names, lines, at = list(names), [], 0
                for c in audit:
                    if c == "I":
                        lines.append((names.pop(0), ""))
                        continue
                    _, role, text = rows[at]
                    at += 1
                    if c != "D":
                        lines.append((role if c == "K" else names.pop(0), text))
                if not re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in lines)):
                    continue
                cost = sum({"K": 0, "R": 1, "D": 2, "I": 5}[c] for c in audit) + sum(5 for f, c in zip(found, letters, strict=True) if f == "truncated" and c != "D")
                if best is None or (cost, audit) < best[:2]:
                    best = cost, audit, lines
    return best


def expected(rows):
    rows = sorted([(t, r or " " if r is None else r, " " if x is None else x) for t, r, x in rows], key=lambda r: (r[0] is not None, r[0] or 0))
    found = faults(rows)
    cost, audit, lines = cheapest(rows, found)
    turns = {t for t, *_ in rows if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    return {"gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, **{k: found.count(k) for k in ("blank", "duplicate", "truncated")}, "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": audit}, lines


def conversations(n, seed):
    r, out = random.Random(seed), {}
    for c in range(n):
        turns = sorted(r.sample([None, *range(7)], r.randint(1, 4)), key=lambda t: (t is not None, t or 0))
        out[c if c else None] = [(t, r.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]), r.choice(["a.", "b?", "c!\n", "cut", "  \t", "", None, "é。", "a. "])) for t in turns]
    return out


def test_every_repair_is_the_cheapest(spark):
    made = conversations(150, 5)
    frame = spark.createDataFrame([(c, t, r, x, 1, "m", 2) for c, rows in made.items() for t, r, x in rows], "conv_id long, turn long, role string, text string, row int, mark string, place int").repartition(4)
    every = spark.createDataFrame([(c,) for c in [*made, 5000]], "conv_id long")
    out, lines = repair.repaired(frame, every=every)
    got = {r["conv_id"]: r.asDict() for r in out.collect()}
    made_lines = {}
    for r in sorted(lines.collect(), key=lambda r: r["place"]):
        made_lines.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert set(got) == {*made, 5000} and got[5000] == {"conv_id": 5000, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": ""}
    for c, rows in made.items():
        want, repaired = expected(rows)
        assert got[c] == {"conv_id": c, **want}, (rows, got[c], want)
        assert made_lines.get(c, []) == repaired, (rows, got[c])


def test_repeated_rows_ties_and_long_conversations(spark):
    r = random.Random(3)
    long = [(1, t, r.choice(["user", "assistant", "system"]), r.choice(["yes.", f"turn {t}.", f"turn {t}", ""])) for t in range(1500)]
    same = [(2, 0, "user", "a."), (2, 0, "user", "a."), (2, 0, "assistant", "b."), (2, 0, "assistant", "b.")]
    huge = [(3, 0, "user", "word " * 200_000 + "."), (3, 1, "assistant", "no " * 200_000)]
    out, lines = repair.repaired(spark.createDataFrame(long + same + huge, "conv_id long, turn long, role string, text string"))
    got = {x["conv_id"]: x for x in out.collect()}
    # Of rows with one turn, roles come in order of their names.
    want, _ = expected([r[1:] for r in sorted(same)])
    assert got[2].asDict() == {"conv_id": 2, **want} and want["duplicate"] == 2
    assert got[3]["truncated"] == 1 and got[3]["audit"] == "DD" and got[3]["cost"] == 4
    audit = got[1]["audit"]
    assert len(audit.replace("I", "")) == 1500 and got[1]["cost"] >= 2 * audit.count("D")
    roles = "".join(x["role"][0] for x in sorted(lines.filter("conv_id = 1").collect(), key=lambda x: x["place"]))
    assert re.fullmatch("(s?(ua)+)?", roles) and len(roles) == len(audit.replace("D", ""))
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    out, lines = repair.repaired(none)
    assert out.collect() == [] and lines.collect() == [] and repair.digests(none).collect() == []


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        k = zlib.crc32(f"{show(c)}:{show(t)}".encode()) % 20
        role, text = show(role), show(text)
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            out += [(c, t, "user" if k == 4 else role, text)] * (1 + (k == 3))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_digests_equal_sql_and_all_edits(spark, tmp_path, seed):
    made = conversations(120, seed)
    rows = [(c, t, r, x) for c, own in made.items() for t, r, x in own]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in repair.digests(frame).collect()}
    hurt = damaged(rows)
    assert sorted(map(repr, hurt)) == sorted(repr(tuple(r)) for r in repair.damaged(frame).collect())
    frame.coalesce(1).write.parquet(f"{tmp_path}/c")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/c/*.parquet'")
    columns = [c for c in got[1].asDict()]
    sql = {r[0]: r for r in con.execute(f"select {', '.join(columns)} from ({repair.DIGESTS_SQL})").fetchall()}
    assert set(got) == set(sql) == set(made)
    for c in made:
        assert tuple(got[c]) == sql[c]
        own = [r[1:] for r in hurt if r[0] == c]
        if len(own) > 4:
            continue
        want, lines = expected(own)
        want["repaired_sha256"] = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in lines).encode()).hexdigest()
        assert got[c].asDict() == {"conv_id": c, **want}
