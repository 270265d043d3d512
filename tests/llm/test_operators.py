"""Each operator against a brute-force version, on a table of hard cases: nulls, empty and long
texts, repeated rows, ties, extra columns with clashing names, and no rows at all."""

import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from galena.llm import bpe, conversations, decontamination, fingerprints, langid, licenses, minhash, quality, suffixes, toxicity
from galena.llm.queries import tokenizer_path

rng = random.Random(11)
WORDS = "the of and river stone cloud bright house seven window walked under quiet morning paper letter garden copper silver table".split()


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + ("." if r.random() < 0.1 else "") for _ in range(n))


BASE = prose(300, 1)
HARD = [
    (1, BASE),
    (2, BASE),
    (3, BASE.replace("river", "lake", 1)),
    (4, None),
    (5, ""),
    (6, "one two"),
    (7, "\n \t"),
    (8, "déjà vu 漢字 🙂 'll don't\n\n\n x"),
    (9, "a" * 3000),
    (10, prose(4000, 2)),
    (11, prose(120, 3) + " " + prose(150, 4)),
    (12, prose(90, 5) + " " + prose(150, 4)),
    (13, "Released under the MIT License. See the GNU General Public License."),
    (None, BASE),
    (14, "12 + 5!!"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """The hard cases, with columns that clash with names used inside the operators."""
    rows = [(i, t, "en", "s", "x", 1, 2.0, "h") for i, t in HARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, id string, key int, score double, h string").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_bpe_equals_the_library_and_round_trips(docs, none):
    import tiktoken
    import public_tokenizers as P

    ranks = bpe.vocabulary(bpe.read_ranks(tokenizer_path())).ranks
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = by_id(bpe.encode(docs, tokenizer_path()))
    for i, t in HARD:
        ids = bpe.unpacked(out[i]["ids"])
        assert ids == want.encode_ordinary(t or "") and out[i]["n_tokens"] == len(ids)
        starts = bpe.unpacked(out[i]["offsets"])
        assert all((t or "").encode()[s:].startswith(want.decode_single_token_bytes(k)) for s, k in zip(starts, ids, strict=True))
    digests = by_id(bpe.digests(docs, tokenizer_path()))
    assert all(digests[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() for i, t in HARD)
    assert bpe.digests(none, tokenizer_path()).collect() == []


def test_bpe_decodes_by_offsets(spark):
    frame = spark.createDataFrame([(i, t) for i, t in HARD if t], "doc_id long, text string")
    ids = bpe.encode(frame, tokenizer_path())
    plain, placed = (by_id(bpe.decode(ids, tokenizer_path(), "ids", ("doc_id",), o)) for o in (None, "offsets"))
    assert all(bytes(plain[i]["decoded"]) == bytes(placed[i]["decoded"]) == t.encode() for i, t in HARD if t and i)


def test_bpe_splits_like_the_pattern_on_random_text():
    import public_tokenizers as P
    import regex

    for k in range(300):
        text = "".join(rng.choice("ab'sdmtlvre  \n\t12é!?.漢🙂 ") for _ in range(rng.randint(1, 80)))
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        assert bpe.piece_starts(points, np.array([0])).tolist() == [m.start() for m in regex.finditer(P.PATTERN, text)], k


def shingle_sets():
    out = {}
    for i, t in HARD:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    return out


def test_minhash_finds_all_links(docs, none):
    sets = shingle_sets()
    group = {i: i for i in sets if i is not None}
    for _ in sets:
        for a in group:
            for b in group:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    out = by_id(minhash.near_duplicates(docs))
    for i, s in sets.items():
        assert out[i]["n_shingles"] == len(s)
        assert out[i]["component_id"] == group.get(i) or i is None
        assert out[i]["kept"] == (i is None or group[i] == i)
    assert minhash.near_duplicates(none).collect() == []


def test_minhash_cleaning_keeps_one_of_repeated_rows(spark):
    a, b = prose(80, 71), prose(80, 72)
    rows = [(1, a), (1, a), (1, a), (2, a), (3, b), (4, "a few words"), (4, "a few words"), (4, "other words"), (None, b), (None, b), (5, None), (5, None), (6, ""), (6, "")]
    frame = spark.createDataFrame([(*r, "k", 7) for r in rows], "doc_id long, text string, galena_id string, mark int").repartition(3)
    left = sorted((str(r["doc_id"]), str(r["text"])) for r in minhash.clean(frame).collect())
    assert left == sorted((str(i), str(t)) for i, t in {*rows} - {(2, a)})


def test_minhash_finds_pairs_just_above_the_threshold(spark):
    """Pairs of 0.75 to 0.80: none may be lost."""
    r, rows, linked = random.Random(17), [], 0
    for k in range(150):
        words = [f"w{k}x{r.randrange(10**6)}" for _ in range(r.randint(60, 200))]
        other = list(words)
        while True:
            a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words, other))
            if len(a & b) / len(a | b) <= 0.80:
                break
            at = r.randrange(len(other))
            other[at] = f"n{r.randrange(10**6)}"
        linked += 100 * len(a & b) >= 75 * len(a | b)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        if 100 * len(a & b) < 75 * len(a | b):
            rows[-1] = (2 * k + 1, "nothing alike " + str(k))
    out = by_id(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sum(out[2 * k + 1]["component_id"] == 2 * k for k in range(150)) == linked > 50


def test_superminhash_estimates_likeness():
    a, b = np.arange(1, 1001, dtype=np.uint64), np.arange(251, 1251, dtype=np.uint64)
    from galena.llm.rolling import mixed

    sets = np.concatenate([mixed(a), mixed(b)])
    s = minhash.signatures(sets, np.array([0, 1000, 2000]))
    assert abs((s[0] == s[1]).mean() - 750 / 1250) < 0.12


def repeats(rows, size):
    seen, out = {}, {}
    for _, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - size + 1):
            seen[b[k : k + size]] = seen.get(b[k : k + size], 0) + 1
    for i, t in rows:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if seen[b[k : k + size]] > 1:
                cover[k : k + size] = b"\1" * size
        out[i] = (len(b), sum(cover), bytes(x for x, c in zip(b, cover, strict=True) if not c))
    return out


@pytest.mark.parametrize(("size", "anchor"), [(400, 128), (40, 12)])
def test_suffixes_remove_exactly_the_repeats(docs, none, size, anchor):
    want = repeats(HARD, size)
    out = by_id(suffixes.removed(docs, depth=size, anchor=anchor))
    for i, (n, gone, kept) in want.items():
        assert (out[i]["n_bytes"], out[i]["n_removed"], bytes(out[i]["kept"])) == (n, gone, kept), i
        assert out[i]["n_spans"] == len(out[i]["spans"]) and sum(s["end"] - s["start"] for s in out[i]["spans"]) == gone
    assert suffixes.removed(none).collect() == []


def repeated_words(rows, size):
    """Of each text the words, and which of them are in a repeated string of `size` words."""
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    seen = {}
    for w in split.values():
        for k in range(len(w) - size + 1):
            seen[tuple(w[k : k + size])] = seen.get(tuple(w[k : k + size]), 0) + 1
    return {i: (w, {j for k in range(len(w) - size + 1) if seen[tuple(w[k : k + size])] > 1 for j in range(k, k + size)}) for i, w in split.items()}


def test_suffixes_of_words(spark, docs):
    want = repeated_words(HARD, 50)
    out = by_id(suffixes.removed(docs, passages=50))
    cut = by_id(suffixes.removed(docs, depth=50, unit="words"))
    for i, (w, gone) in want.items():
        assert out[i]["n_passage_words"] == len(gone), i
        assert bytes(cut[i]["kept"]).decode().split() == [x for k, x in enumerate(w) if k not in gone], i
    assert any(g for _, g in want.values()) and suffixes.removed(docs.limit(0), passages=50).collect() == []
    cleaned = suffixes.clean(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == len(HARD)
    assert by_id(cleaned)[4]["text"] is None and by_id(cleaned)[10]["text"] == HARD[9][1] and by_id(cleaned)[1]["key"] == 1


def test_suffixes_of_random_tables(spark):
    """Many chance repeats of every length, against brute force."""
    r = random.Random(5)
    for trial in range(3):
        parts = ["".join(r.choice("ab ") for _ in range(r.randint(5, 90))) for _ in range(12)]
        rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 9)))) for i in range(60)]
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        out, words = by_id(suffixes.removed(frame, depth=30, passages=18)), repeated_words(rows, 18)
        for i, (n, gone, kept) in repeats(rows, 30).items():
            assert (out[i]["n_bytes"], out[i]["n_removed"], bytes(out[i]["kept"])) == (n, gone, kept), (trial, i)
            assert out[i]["n_passage_words"] == len(words[i][1]), (trial, i)


def test_suffixes_of_a_text_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", 700)
    rows = [(1, prose(3000, 8)), (2, prose(200, 9) + prose(400, 8) + prose(200, 10))]
    rows[1] = (2, prose(200, 9) + rows[0][1][5000:9000] + prose(200, 10))
    found = [np.concatenate(list(suffixes.runs(np.frombuffer(t.encode(), np.uint8), 400, 128)), axis=1) for _, t in rows]
    assert all(f[3].sum() == len(t) - 399 and (np.diff(f[2]) == f[3][:-1]).all() for f, (_, t) in zip(found, rows, strict=True))
    out = by_id(suffixes.removed(spark.createDataFrame(rows, "doc_id long, text string")))
    assert all((out[i]["n_removed"], bytes(out[i]["kept"])) == w[1:] for i, w in repeats(rows, 400).items())


def pieces(t):
    out = set(re.findall(r"[^\n]{0,239}[.!?][\t ]*\n*|[^\n]{1,240}\n*|\n+", t))
    if 0 < len(t) < 480:
        step = 1 << (max(len(t), 4) // 4).bit_length() - 1
        out |= {(p, t[i : i + p]) for p in (step, max(1, step // 2)) for i in range(0, len(t), p)}
    return out


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def fingerprints_are_right(rows, out, order):
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = out[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r["near_edited"] - likeness(pieces(t), pieces(edited))) < 1e-9
        assert abs(r["near_next"] - likeness(pieces(t), pieces(after))) < 1e-9


def test_fingerprints_equal_the_sets_they_stand_for(docs, none):
    out = by_id(fingerprints.fingerprinted(docs))
    fingerprints_are_right(HARD, out, sorted(HARD, key=lambda r: (r[0] is not None, r[0] or 0)))
    assert out[1]["fingerprint"] == out[2]["fingerprint"] != out[3]["fingerprint"]
    assert fingerprints.fingerprinted(none).collect() == []


def test_fingerprints_of_text_ids_in_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 4)
    rows = [(f"k{i:02}", prose(30 + i, i)) for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id string, text string").repartition(5)
    fingerprints_are_right(rows, by_id(fingerprints.fingerprinted(frame)), rows)


def test_fingerprints_of_null_ids_in_several_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 4)
    texts = [prose(20 + i, 300 + i) for i in range(21)] + [None, "", "same", "same"]
    frame = spark.createDataFrame([(None, t) for t in texts] + [(i, prose(9, i)) for i in range(9)], "doc_id long, text string").repartition(5)
    marks = {r["text"]: r["m"] for r in frame.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("m")).collect()}
    order = sorted((t or "" for t in texts), key=lambda t: (marks[t], t)) + [prose(9, i) for i in range(9)]
    want = []
    for k, t in enumerate(order):
        after = order[(k + 1) % len(order)]
        want.append((len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()))
    assert sorted((r["n_chars"], r["edited_sha256"]) for r in fingerprints.fingerprinted(frame).collect()) == sorted(want)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 17, 40, 85, 150, 239, 240, 300, 479, 480, 481, 700])
def test_half_a_text_is_seen_at_every_length(spark, n):
    rows = [(i, prose(300, 40 * n + i)[:m]) for i, m in enumerate((n, n, 3 * n, max(1, n // 3)))]
    out = by_id(fingerprints.fingerprinted(spark.createDataFrame(rows, "doc_id long, text string")))
    fingerprints_are_right(rows, out, rows)
    if n >= 40:
        assert all(out[i]["near_edited"] > out[i]["near_next"] for i in range(3))


def cells_of(fingerprint):
    return [tuple(int(x, 16) - (int(x, 16) >> 63 << 64) for x in c.split(".")) for c in fingerprint.split("-")]


def test_likeness_follows_from_the_returned_fingerprints(spark):
    from pyspark.sql import functions as F

    a, b = ". ".join(f"sentence {i} {'x' * 200}" for i in range(20)), ". ".join(f"sentence {i} {'x' * 200}" for i in range(4, 22))
    out = by_id(fingerprints.fingerprinted(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")))
    left = [(n - m, d ^ e, c ^ f) for (n, d, c), (m, e, f) in zip(cells_of(out[1]["fingerprint"]), cells_of(out[2]["fingerprint"]), strict=True)]
    rows = spark.createDataFrame([(left,)], "cells array<struct<n:long,d:long,c:long>>")
    peeled = rows.select(fingerprints.peeled_row(F.col("cells")).alias("p")).first()["p"]
    common = len(pieces(a)) - peeled["l"]
    assert peeled["peeled"] and (peeled["l"], peeled["r"]) == (len(pieces(a) - pieces(b)), len(pieces(b) - pieces(a)))
    assert out[1]["near_next"] == common / (len(pieces(a)) + len(pieces(b)) - common)


def test_peeling_recovers_the_digests(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, 48, [5, 6, 7, 8], [5, 6, 9])], "k int, size long, a array<long>, b array<long>")
    out = fingerprints.peeled(fingerprints.subtracted(rows, ["k"]), ["k"], searches=9, recovered=True).first()
    assert (out["l"], out["r"], out["left_over"]) == (2, 1, 0) and sorted(out["digests"]) == [7, 8, 9]
    row = rows.select(fingerprints.peeled_row(fingerprints.less(fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b")))).alias("p")).first()["p"]
    assert row["peeled"] and (row["l"], row["r"]) == (2, 1)
    # Too small a sketch does not peel, and larger ones follow.
    many = spark.range(1).select(F.lit(1).alias("k"), F.sequence(F.lit(1), F.lit(900)).cast("array<long>").alias("a"), F.sequence(F.lit(1001), F.lit(1800)).cast("array<long>").alias("b"))
    assert not many.select(fingerprints.peeled_row(fingerprints.less(fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b")))).alias("p")).first()["p"]["peeled"]
    found = fingerprints.differences(many, ["k"]).first()
    assert (found["l"], found["r"]) == (900, 800)


def test_larger_sketches_follow_until_they_peel(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(fingerprints, "SPARE", 0)
    many = spark.range(1, 4).select(F.col("id").alias("k"), F.sequence(F.lit(1), F.col("id") * 100).cast("array<long>").alias("a"), F.array().cast("array<long>").alias("b"))
    assert {r["k"]: r["l"] for r in fingerprints.differences(many, ["k"]).collect()} == {1: 100, 2: 200, 3: 300}


def test_licenses_count_every_place(docs, none):
    out = by_id(licenses.scan(docs))
    for i, t in HARD:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [k for p, _ in licenses.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = out[i]
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places), max(places)) if places else (None, None))
    assert out[13]["base_labels"] == "gpl,mit" and out[13]["score"] == 1.0 and out[1]["labels"] == ""
    assert licenses.scan(none).collect() == []


def test_license_texts_are_found_with_words_changed(spark):
    text = "X. Permission is hereby granted, free of charge, to any human person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction."
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["labels"] == "mit" and row["n_base"] == 0 and 0.5 <= row["score"] < 1


BENCH = [(1, "A train leaves Paris at 7 o'clock and travels 300 km in 4 hours. How fast does it go on average?"), (2, "short one"), (3, None), (4, "")]


def test_decontamination_finds_changed_parameters(spark, docs, none):
    items = spark.createDataFrame(BENCH, "item_id long, text string")
    rows = [
        (1, "Intro. " + BENCH[0][1] + " End."),
        (2, "So, a train leaves Rome at 9 o'clock and travels 250 km in 2 hours. How fast does it go on average? Yes."),
        (3, "A train leaves the town and nothing else is alike in this text about other things entirely."),
        (4, "this is a short one indeed"),
        (5, None),
    ]
    out = {(r["doc_id"], r["item_id"]): r for r in decontamination.passages(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert set(out) == {(1, 1), (2, 1), (4, 2)}
    assert out[1, 1]["changed"] == 0 and out[2, 1]["changed"] >= 3 and out[2, 1]["consistent"] == 1.0
    assert decontamination.passages(docs, items).collect() == []
    assert decontamination.passages(none, items).collect() == [] and decontamination.passages(docs, items.limit(0)).collect() == []
    assert decontamination.clean(docs, items).count() == len(HARD)


def leaks(spark, bodies, text):
    docs = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string")
    return {r["doc_id"]: r for r in decontamination.passages(docs, spark.createDataFrame([(1, text)], "item_id long, text string")).collect()}


def test_decontamination_is_independent_of_case_and_line_breaks(spark):
    tom = "Tom has 3 apples. Anna gives him 4 more apples. How many apples does Tom have now?"
    clips = "Natalia sold 48 clips in April to Anna and then half as many clips in May to Bob, Carl and Dora. How many clips in all?"
    same = [clips.replace(" in April", " in\nApril"), clips.lower(), clips.upper(), clips.replace(" ", "\r\n  "), clips.lower().replace("48", "52")]
    assert set(leaks(spark, same, clips)) == set(range(5))
    other = tom.replace("Tom", "Maria").replace("Anna", "Peter").replace("3", "8").replace("4", "9")
    out = leaks(spark, [other, tom.lower(), "The Art Of War And The Craft Of Peace In The Hall Of Kings And Queens By Night"], tom)
    assert set(out) == {0, 1} and out[0]["n_hits"] == 10 and out[0]["changed"] == 5 and out[0]["consistent"] == 1.0


WORKSHEET = "Anna packs 12 red cubes and 30 blue cubes; then she sells 12 cubes at the fair and packs 30 more cubes. How many cubes has Anna packed at the end of the day at the fair?"


def test_decontamination_judges_every_passage_of_an_item(spark):
    mixed = WORKSHEET.replace("12", "{}").replace("30", "{}").replace("Anna", "{}").format("Bob", 5, 6, 7, 8, "Eve")
    out = leaks(spark, [mixed + " " + prose(60, 7) + " " + WORKSHEET, mixed], WORKSHEET)
    assert set(out) == {0} and out[0]["consistent"] == 1.0 and out[0]["changed"] == 0


def test_decontamination_reads_slots_behind_an_added_word(spark):
    out = leaks(spark, [WORKSHEET.replace("sells 12", "then gladly sells 12")], WORKSHEET)
    assert set(out) == {0} and out[0]["changed"] == 0 and out[0]["consistent"] == 1.0


def test_decontamination_by_short_items_needs_equal_words(spark):
    bodies = ["he ran 5 km and had 42 ideas", "they ran 42 km", "walked 42 km today", "Walked 41 km today", " ".join(map(str, range(100, 120))), " ".join(map(str, range(200, 220)))]
    items = spark.createDataFrame([(1, "42"), (2, "42 km"), (3, "walked 42 km today"), (4, bodies[4])], "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.passages(docs, items).collect()} == {(2, 3), (4, 4)}


def test_conversations_keep_the_longest_snapshots(spark):
    chat = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (3, 0, "user", "hi"), (3, 1, "assistant", "yes"), (4, 0, "user", "hi"), (4, 1, "assistant", "no"), (5, 0, None, None), (None, 0, "user", "lost")]
    df = spark.createDataFrame(chat, "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in conversations.formatted(df).collect()}
    assert set(out) == {2, 4, 5} and out[2]["n_turns"] == 2
    assert out[2]["rendered"] == "<|user|>\nhi\n<|assistant|>\nyes\n" and out[5]["rendered"] == "<||>\n\n"
    assert conversations.formatted(df.limit(0)).collect() == []


def test_conversations_with_clashing_columns_and_repeated_turns(spark):
    chat = [(1, 0, "user", "hi", 9, "x"), (1, 0, "user", "hi", 9, "y"), (1, 1, "assistant", "", 9, "z"), (2, None, "user", "n" * 100_000, 9, "x"), (3, 0, "a", "bc", 9, "x"), (4, 0, "ab", "c", 9, "x")]
    frame = spark.createDataFrame(chat, "conv_id long, turn long, role string, text string, conv int, d string")
    out = {r["conv_id"]: r for r in conversations.formatted(frame).collect()}
    assert set(out) == {1, 2, 3, 4} and out[1]["n_turns"] == 3 and out[1]["rendered"].count("hi") == 2
    assert len(out[2]["rendered"]) == 100_000 + len("<|user|>\n\n")


def test_texts_of_megabytes(spark):
    """One text of 1.3 MB beside short ones, in every operator that reads whole texts in Python."""
    long = " ".join(prose(250, 100 + k) + f" mark{k}." for k in range(950))
    rows = [(1, long), (2, "short text"), (3, long[: len(long) // 2] + " tail"), (4, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(long) > 1_300_000
    digests = by_id(bpe.digests(frame, tokenizer_path()))
    assert digests[1]["decoded_sha256"] == hashlib.sha256(long.encode()).hexdigest()
    cut = by_id(suffixes.removed(frame, passages=50))
    assert cut[1]["n_removed"] == len(long) // 2 and cut[3]["n_removed"] == len(long) // 2 and cut[2]["n_removed"] == 0
    assert cut[1]["n_passage_words"] == len(long[: len(long) // 2].rsplit(" ", 1)[0].split()) + (long[len(long) // 2] == " ")
    near = by_id(minhash.near_duplicates(frame))
    assert near[1]["kept"] and near[3]["kept"] and near[1]["n_shingles"] > 100_000
    corpus, labels = made_corpus(spark, 60)
    both = corpus.select("doc_id", "text").withColumn("doc_id", corpus["doc_id"] + 100).union(frame)
    for operator in (toxicity.toxicity, quality.quality):
        scores = by_id(operator(both, labels.withColumn("doc_id", labels["doc_id"] + 100)))
        assert len(scores) == 64 and 0 <= scores[1]["score"] <= 1


def test_cleaning_stages_keep_all_columns(spark):
    corpus, labels = made_corpus(spark, 60)
    clash = corpus.selectExpr("doc_id", "text", "lang", "1 AS score", "2 AS galena_score", "'r' AS row", "3 AS k0", "4 AS id", "5 AS rest")
    kept = toxicity.clean(clash, labels)
    assert kept.columns == clash.columns and {r["doc_id"] for r in kept.collect()} == {i for i in range(60) if i % 5} and kept.first()["rest"] == 5
    assert minhash.clean(clash).columns == clash.columns and suffixes.clean(clash).columns == clash.columns
    assert suffixes.clean(clash).filter("rest = 5 and k0 = 3 and row = 'r'").count() == 60


def made_corpus(spark, n=240):
    rows, labels = [], []
    for i in range(n):
        bad, poor = i % 5 == 0, i % 4 == 0
        text = prose(60, 100 + i)
        if poor:
            text = " ".join(w.upper() + "!!" for w in text.split()[:40]) + " " + "buy buy buy " * 9
        if bad:
            text += " you stupidfool are a nastyclown, you rottenscum."
        rows.append((i, text, "en" if i % 2 else "de"))
        labels.append((i, int(not poor), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def fold(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


@pytest.mark.parametrize(("operator", "label"), [(toxicity.toxicity, "toxic"), (quality.quality, "quality")])
def test_classifiers_on_the_held_out_fold(spark, docs, none, operator, label):
    corpus, labels = made_corpus(spark)
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    out = by_id(operator(corpus, labels))
    assert all(r["held_out"] == fold(i) and 0 <= r["score"] <= 1 for i, r in out.items())
    wrong = [i for i, r in out.items() if fold(i) and r["predicted"] != truth[i]]
    assert len(wrong) <= 0.1 * sum(map(fold, out))
    hard = by_id(operator(docs, labels))
    assert len(hard) == len(HARD) and all(0 <= r["score"] <= 1 for r in hard.values()) and hard[1]["score"] == hard[2]["score"]
    assert operator(none, labels).collect() == []
    assert all(r["score"] == 0.5 for r in operator(docs, labels.limit(0)).collect())


def test_languages(spark, docs, none):
    german = "der die und wasser stein wolke schön haus sieben fenster ging unter ruhig morgen papier brief garten kupfer".split()
    r = random.Random(3)
    rows = [(i, prose(40, i) if i % 2 else " ".join(r.choice(german) for _ in range(40)), "en" if i % 2 else "de") for i in range(80)]
    rows += [(100, None, "en"), (101, "123 !!", "en"), (102, "the bright morning", None)]
    out = by_id(langid.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert all(out[i]["lang_pred"] == lang for i, _, lang in rows[:80])
    assert out[100]["lang_pred"] == out[101]["lang_pred"] == "und" and out[102]["lang_pred"] == "en"
    assert all(r["held_out"] == fold(i) and 0 <= r["score"] <= 1 for i, r in out.items())
    assert len(by_id(langid.languages(docs))) == len(HARD) and langid.languages(none).collect() == []


def test_texts_without_letters_have_no_language(spark):
    rows = [(i, prose(30, i), "en") for i in range(20)] + [(30, "\u00bd \u00b2", None), (31, "\u2167 12", None), (32, "\u4e00 ok", None), (33, "\u2460", "en")]
    out = by_id(langid.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert [out[i]["lang_pred"] for i in (30, 31, 32, 33)] == ["und", "und", "en", "und"] and out[30]["score"] == 0.0
    assert langid.words("a\u00bdb \u2167x 1 d\u00e9j\u00e0") == ["a", "b", "x", "d\u00e9j\u00e0"]


def chance_by_hand(counts, context, c):
    """Interpolated Kneser-Ney from its definition; context: the characters before c, padded."""
    def grams(n):
        if n == langid.ORDER:
            out = {}
            for w, k in counts.items():
                t = "\x00" * (n - 1) + w + "\x01"
                for i in range(n - 1, len(t)):
                    out[t[i - n + 1 : i + 1]] = out.get(t[i - n + 1 : i + 1], 0) + k
            return out
        out = {}
        for g in grams(n + 1):
            out[g[1:]] = out.get(g[1:], 0) + 1
        return out

    p = 1 / langid.LETTERS
    for n in range(1, langid.ORDER + 1):
        here, head = grams(n), context[len(context) - n + 1 :] if n > 1 else ""
        row = {g: k for g, k in here.items() if g[:-1] == head}
        if row:
            total = sum(row.values())
            p = max(row.get(head + c, 0) - langid.DISCOUNT, 0) / total + min(langid.DISCOUNT * len(row) / total, 1) * p
    return p


def test_kneser_ney_equals_its_definition():
    counts = {"abc": 3, "abd": 1, "b": 2, "bab": 5}
    models = langid.build({"x": counts, "y": {"zz": 1}})
    for word in ("abc", "abd", "abe", "b", "cab", "ba"):
        t = "\x00" * (langid.ORDER - 1) + word + "\x01"
        want = np.log([chance_by_hand(counts, t[i - langid.ORDER + 1 : i], t[i]) for i in range(langid.ORDER - 1, len(t))]).sum()
        assert abs(models.log_chances([word])[0, 0] - want) < 1e-4
    head = "\x00" * (langid.ORDER - 2) + "a"
    known = "abcd\x01z\x02"
    total = sum(chance_by_hand(counts, head, c) for c in known) + (langid.LETTERS - len(known)) * chance_by_hand(counts, head, "\x03")
    assert abs(total - 1) < 1e-9


def test_language_scores_are_calibrated_on_other_texts():
    models = langid.build({"x": {"abc": 3}, "y": {"zz": 1}})
    sure = [("x", 9, [1.0, 3.0]), ("y", 9, [3.0, 1.0])] * 5
    unsure = sure + [("x", 9, [3.0, 1.0]), ("y", 9, [1.0, 3.0])] * 3
    assert langid.calibrated(models, sure).scale > langid.calibrated(models, unsure).scale
    assert langid.calibrated(models, []).limits.tolist() == [np.inf, np.inf]


def test_licenses_do_not_depend_on_repeated_rows(spark):
    text = "Permission is hereby granted, free of charge, to any person, and later a copy of this software and associated files. " + prose(30, 3)
    once = licenses.scan(spark.createDataFrame([(1, text), (2, HARD[12][1])], "doc_id long, text string"))
    often = licenses.scan(spark.createDataFrame([(1, text), (2, HARD[12][1])] * 5, "doc_id long, text string"))
    assert once.count() == 2 and often.distinct().count() == 2 and set(once.drop("found").collect()) == set(often.drop("found").collect())


def test_decontamination_keeps_slots_in_step(spark):
    item = "Irem has 3 apples and gives them to Can; then she buys 9 more pears from the old market. How many fruits has she now?"
    plain, dotted = (leaks(spark, [item.replace("Irem", name)], item)[0] for name in ("Iremi", "\u0130rem"))
    assert (dotted["changed"], dotted["n_slots"], dotted["consistent"]) == (plain["changed"], plain["n_slots"], plain["consistent"])


def test_frequent_words_have_own_vectors(spark):
    sample = spark.createDataFrame([("the stone THE", 1), ("the cloud!", 0), ("stone, x", 1)], "text string, y int")
    own = quality.frequent_units(sample)
    assert own == ["stone", "the"]
    units = quality.Units(own).of("the stone!! cloud")
    assert units[:2].tolist() == [1, 0] and (units[2:] >= quality.OWN).all() and len(units) == 4


def test_toxicity_features_by_hand():
    x = dict(zip(toxicity.FEATURES, toxicity.Features({"fool": 2.0, "^scou": 3.0}).of("You FOOL!! a f00l is scoundrel 12 times"), strict=True))
    assert abs(x["log_words"] - np.log1p(8)) < 1e-6
    assert (x["hits"], x["hit_density"], x["hit_weight"]) == (1, 1 / 8, 2 / 8) and (x["begins"], x["begin_weight"]) == (1, 3 / 8)
    assert x["kinds_of_hits"] == 2 and x["hits_near_second_person"] == 2 and x["second_person"] == 1 / 8
    assert x["shouted"] == 1 / 8 and x["obfuscated"] == 1 / 8 and x["obfuscated_hits"] == 1
    assert abs(x["exclamations"] - 2 / 39) < 1e-6 and abs(x["digits"] - 4 / 39) < 1e-6 and abs(x["capitals"] - 5 / 26) < 1e-6


def test_isotonic_curve_rises():
    r = np.random.default_rng(1)
    x = r.normal(size=(400, len(toxicity.FEATURES))).astype(np.float32)
    y = (x[:, 0] + r.normal(size=400) > 0).astype(float)
    trees = toxicity.Trees().fit(x[:300], y[:300]).calibrate(x[300:], y[300:])
    assert (np.diff(trees.curve[1]) >= 0).all()
    assert pd.Series(trees.chance(x)).corr(pd.Series(y)) > 0.4
