"""Decontamination against a plain version that compares every window with every other, over random
documents with planted and re-parameterised items, by broadcast and by shuffle."""

import random

import pytest
from pyspark.sql import functions as F

from galena.llm import decontamination as D

WORDS = "the of a river stone cloud house window paper garden market people sells buys packs every week before after many small red blue".split()
NAMES = "Anna Bob Carl Dora Eve Frank".split()
UNITS = "kg km hours dollars cm".split()


def item(r):
    out = []
    for _ in range(r.choice([2, 5, 7, 8, 12, 25, 40])):
        kind = r.random()
        out.append(str(r.randint(1, 400)) + (" " + r.choice(UNITS) if r.random() < 0.4 else "") if kind < 0.15 else r.choice(NAMES) if kind < 0.25 else r.choice(WORDS) + r.choice(["", "", "", ",", "."]))
    return " ".join(out)


def varied(text, r):
    """The text with other numbers or names, a word more or less, or in another case."""
    words, swap = text.split(" "), {}
    for i, w in enumerate(words):
        if w.isdigit() and r.random() < 0.6:
            words[i] = swap.setdefault(w, str(r.randint(1, 900))) if r.random() < 0.85 else str(r.randint(1, 900))
        elif w in NAMES and r.random() < 0.6:
            words[i] = swap.setdefault(w, r.choice(NAMES))
    if r.random() < 0.5:
        words.insert(r.randrange(len(words) + 1), r.choice(WORDS))
    if r.random() < 0.2 and len(words) > 3:
        words.pop(r.randrange(len(words)))
    out = " ".join(words)
    return out.upper() if r.random() < 0.1 else out.replace(" ", "\n", 3) if r.random() < 0.2 else out


def stands(w):
    return w in ("\u0001", "\u0003") or w.startswith("\u0002")


def readings(words):
    plain = tuple(w.removeprefix("\u0002") for w in words)
    return plain, tuple("\u0002" if w.startswith("\u0002") else w for w in words)


def windows(cw, rw, size, of_item):
    for at in range(len(cw) - size + 1):
        if size < D.WINDOW:
            yield at, {tuple(rw[at : at + size])}
            continue
        plain, slots = readings(cw[at : at + size])
        only = of_item and sum(not stands(w) for w in cw[at : at + size]) < D.LITERALS
        yield at, {plain} if only else {plain, slots}


def judged(doc, wanted):
    """(n_hits, coverage, first_word, n_slots, changed, consistent) of the best passage, or None."""
    (cd, rd), (ci, ri) = doc, wanted
    size = min(len(ci), D.WINDOW)
    few = sum(not stands(w) for w in ci) + (bool(ci) and ci[0].startswith("\u0002")) < D.LITERALS
    if not ci or (size < D.WINDOW and few):
        return None
    lines = {}
    there = list(windows(ci, ri, size, True))
    for at, mine in windows(cd, rd, size, False):
        for b, other in there:
            if mine & other:
                lines.setdefault(at - b, []).append((b, at))
    best = None
    for band in {x for d in lines for x in (d // D.BAND, d // D.BAND - 1)}:
        inside = {d: hits for d, hits in lines.items() if d // D.BAND in (band, band + 1)}
        met = {b for hits in inside.values() for b, _ in hits}
        n_windows = len(ci) - size + 1
        if len(met) < min(D.HITS, n_windows):
            continue
        pairs, values, changed = set(), set(), 0
        slots = [t for t, w in enumerate(ci) if stands(w)]
        read = {}
        for d, hits in inside.items():
            covered = {t for b, _ in hits for t in range(b, b + size)}
            for t in covered & set(slots):
                read[t] = max(read.get(t, (0, 0)), (len({b for b, _ in hits}), -d))
        for t, (_, minus) in read.items():
            a, b = ri[t], rd[t - minus] if t - minus < len(rd) else None
            pairs.add((a, b))
            values.add(a)
            changed += a != b
        consistent = len(values) / len(pairs) if pairs else 1.0
        if (few and changed) or consistent < D.CONSISTENT:
            continue
        first = min(at for hits in inside.values() for _, at in hits)
        one = (len(met), consistent, -first, len(read), -changed)
        if best is None or one > best[0]:
            best = one, (len(met), len(met) / n_windows, first, len(read), changed, consistent)
    return best and best[1]


def words(frame, key):
    return [(r[key], (r["cw"], r["rw"])) for r in frame.select(key, D.canonical_words(F.col("text")).alias("cw"), D.raw_words(F.col("text")).alias("rw")).collect()]


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_passages_equal_the_plain_version(spark, monkeypatch, limit):
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", limit)
    r = random.Random(12)
    items = [(i, item(r)) for i in range(24)] + [(90, None), (91, ""), (None, "nothing of the river stone cloud house at all")]
    rows = []
    for i in range(500):
        text = " ".join(item(r) for _ in range(r.randint(1, 4)))
        for _ in range(r.choice([0, 1, 1, 2])):
            text += " " + varied(r.choice(items[:24])[1], r) + " " + item(r)
        rows.append((i, text))
    rows += [rows[3], rows[3], (7, rows[8][1]), (None, rows[5][1]), (600, None), (601, "")]
    docs = spark.createDataFrame([(*x, "k", 1) for x in rows], "doc_id long, text string, item string, mark int").repartition(4)
    wanted = spark.createDataFrame(items, "item_id long, text string")
    expected = {}
    known = [(i, w) for i, w in words(wanted, "item_id") if i is not None]
    for d, body in words(docs, "doc_id"):
        for i, w in known:
            found = d is not None and judged(body, w)
            if found:
                rank = lambda x: (x[0], x[5], -x[2], x[3], -x[4])
                expected[d, i] = max(expected.get((d, i), found), found, key=rank)
    got = {(r["doc_id"], r["item_id"]): (r["n_hits"], r["coverage"], r["first_word"], r["n_slots"], r["changed"], r["consistent"]) for r in D.passages(docs, wanted).collect()}
    assert set(got) == set(expected) and len(got) > 150
    assert all(got[k] == pytest.approx(expected[k]) for k in got)
