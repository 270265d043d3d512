"""Operators on small cases worked by hand, beside the comparison of queries with their SQL."""

import hashlib
import hmac
import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from galena.functions import grounding, hashing, identifiers, text, tokens
from galena.operators import chunking, concepts, context, discovery, graph, ingest, learning, lifecycle, nearest, postings, ranking, references, retrieval
from galena.plans import ask, lanes, planner
from galena.sources import lexicons, tables
from galena.sources.embedders import HashingEmbedder, embedded


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def one(spark, column, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("x")])
    return frame.select(column.alias("out")).first()["out"]


# Texts


def by_hand(t):
    if not t.strip(" \t\n\r\f\v"):
        return 0
    n = sum(5 if c in " \t\n\r\f\v" else 100 if re.match("[一-鿿぀-ヿ가-힣]", c) else 38 if re.match("[Ͱ-ϿЀ-ӿ]", c) and c.isalpha() else 30 if c.isalpha() or c.isdecimal() else 100 if ord(c) > 0xFFFF or unicodedata.category(c) == "So" else 45 for c in t)
    return max(1, -(-n * 105 // 10000))


def test_token_estimates():
    texts = ["", " \n", "a", "Hello, world 12!", "договор № 5", "第三条 规定", "λόγος", "🙂🙂 ok", "x" * 5000]
    assert tokens.estimates(texts).tolist() == [by_hand(t) for t in texts] == [tokens.estimate(t) for t in texts]


def test_token_estimate_column(spark):
    frame = spark.createDataFrame([("a b",), (None,), ("",)], "t string")
    assert [r["n"] for r in frame.select(tokens.token_estimate("t").alias("n")).collect()] == [1, None, 0]


def sentences(t):
    return [t[a:b] for a, b in chunking.sentences(t)]


def test_sentences():
    assert sentences("It costs 3.50 now. See Dr. Smith, J. Doe e.g. here. Go to https://x.org/a.b. Now!  Really?") == ["It costs 3.50 now.", "See Dr. Smith, J. Doe e.g. here.", "Go to https://x.org/a.b. Now!", "Really?"]
    assert sentences('He said "no." Then left.') == ['He said "no."', "Then left."]
    assert sentences("第一条。第二条！") == ["第一条。", "第二条！"] and sentences("  \n ") == []


def test_boundaries():
    t = "ab, cd; ef. gh\nij 3.5"
    ranks = chunking.boundary_ranks(t)
    assert [int(ranks[i]) for i in (0, 1, 3, 7, 11, 15, 17, 20)] == [0, 0, 2, 3, 4, 5, 1, 0]
    assert chunking.best_boundary(ranks, 1, 14) == 11 and chunking.best_boundary(ranks, 1, 2) == 2 and chunking.best_boundary(ranks, 0, 21) == 15


def test_split_covers_the_text_within_the_budget():
    r = random.Random(3)
    for _ in range(40):
        t = " ".join("w" * r.randint(1, 12) + r.choice(["", "", ",", ".", ";"]) for _ in range(r.randint(1, 400)))
        m = chunking.Measured(t)
        pieces = m.split(0, len(t), 40)
        assert all(m.tokens(a, b) <= 40 for a, b in pieces) and "".join(t[a:b] for a, b in pieces).replace(" ", "") == t.replace(" ", "")
        assert all(m.tokens(a, b) >= 30 for a, b in pieces[:-1])


def test_chunks_of_a_document():
    body = "# One\n" + "First sentence here. " * 60 + "\n# Two\n" + "Other words follow; again. " * 400 + "\n1. item"
    out = chunking.chunks(body)
    parents = [c for c in out if c[2] != "CHILD"]
    kids = [c for c in out if c[2] == "CHILD"]
    assert [c[0] for c in out] == list(range(len(out))) and parents[0][3] == "One" and parents[-1][3] == "Two"
    assert all(c[5] <= chunking.HARD for c in parents) and all(c[5] <= chunking.CHILD_MOST for c in kids)
    assert all(c[5] == tokens.estimate(c[4]) for c in out) and {c[1] for c in kids} == {c[0] for c in parents if c[2] == "PARENT"}
    words = lambda s: s.split()
    assert sum((words(c[4]) for c in parents), []) == words(body.replace("# One", "One").replace("# Two", "Two"))
    for p in parents:
        if p[2] == "PARENT":
            assert sum((words(c[4]) for c in kids if c[1] == p[0]), []) == words(p[4])
    assert chunking.chunks("") == [] and chunking.chunks(" \n ") == []


def test_two_balanced_children():
    t = "Alpha beta gamma delta. " * 60
    (a, b) = chunking.Measured(t.strip()).children()
    m = chunking.Measured(t.strip())
    assert abs(m.tokens(*a) - m.tokens(*b)) < 30 and t[a[0] : a[1]].endswith(".")


def test_long_and_odd_texts_are_chunked(spark):
    odd = [(1, None), (2, "x" * 50_000), (3, "\u0000  "), (4, "漢" * 5000), (4, "twice")]
    out = chunking.chunked(spark.createDataFrame(odd, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in out} == {2, 3, 4} and all(r["tokens"] <= chunking.HARD for r in out)
    assert sum(len(r["text"]) for r in out if r["doc_id"] == 2 and r["role"] != "CHILD") == 50_000


def test_exceptions_join_what_they_restrict(spark):
    units = [(1, 0, "A", "OBLIGATION", "pay"), (1, 1, "A", "EXCEPTION", "unless"), (1, 2, "A", "EXCEPTION", "or"), (1, 3, "B", "RIGHT", "may"), (1, 4, "C", "EXCEPTION", "not"), (1, 5, "C", "DOSAGE", "5 mg")]
    out = chunking.protected(spark.createDataFrame(units, "d int, position int, section_path string, kind string, text string"), "d")
    assert [(r["text"], r["atomic"]) for r in out.orderBy("position").collect()] == [("pay\nunless", True), ("or", False), ("may", False), ("not", False), ("5 mg", True)]


def test_references_by_hand(spark):
    t = F.lit("第十二条、第一百零三条和第二至四款；Appendix C, fig. 2.1, ISO/IEC 27001, RFC2616.")
    pairs = lambda c: [(x["type"], x["value"]) for x in one(spark, c)]
    assert pairs(identifiers.chinese_references(t)) == [("ARTICLE", "12"), ("ARTICLE", "103"), ("CLAUSE", "2"), ("CLAUSE", "3"), ("CLAUSE", "4")]
    assert pairs(identifiers.named_objects(t)) == [("APPENDIX", "C"), ("FIGURE", "2.1")]
    assert pairs(identifiers.external_references(t)) == [("STANDARD", "ISO/IEC 27001"), ("RFC", "RFC 2616")]
    assert [one(spark, identifiers.chinese_number(F.lit(x))) for x in ("十", "二十一", "千", "七百零九", "45", "x")] == [10, 21, 1000, 709, 45, None]
    assert pairs(identifiers.declared(F.lit("## Article 5\nsee article 6\n Section IV x"))) == [("ARTICLE", "5"), ("SECTION", "4")]


def test_reference_graph(spark):
    chunks = spark.createDataFrame([("d", "a", "Article 1\nsee article 2 and RFC 9"), ("d", "b", "Article 2\nsee article 1"), ("e", "c", "Article 2")], "document string, chunk string, text string")
    edges, anchors = references.edges(chunks), references.anchors(chunks)
    assert rows(edges.select("chunk", "type", "value")) == [("a", "ARTICLE", "2"), ("a", "RFC", "RFC 9"), ("b", "ARTICLE", "1")]
    seeds = spark.createDataFrame([(7, "d", "a", 1)], "query int, document string, chunk string, place int")
    assert rows(references.reference_lane(seeds, edges, anchors)) == [(7, "d", "b", 1)]
    both = seeds.union(spark.createDataFrame([(7, "d", "b", 2)]))
    assert references.targets(both, edges, anchors).count() == 0


# Retrieval


@pytest.mark.parametrize(("terms", "score"), [("words_of", None), ("trigrams_of", "jaccard")])
def test_term_lanes_equal_brute_force(spark, terms, score, monkeypatch):
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(r.choices(vocabulary, k=r.randint(0, 30)))) for i in range(700)] + [(900, None)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.randint(0, 9)))) for i in range(30)]
    find = getattr(retrieval, terms)
    monkeypatch.setattr(postings, "BROADCAST_TEXT", 200)  # several blocks
    queries, frame = spark.createDataFrame(items, "query long, text string"), spark.createDataFrame(docs, "hit long, text string").repartition(3)
    lane = retrieval.lexical_lane(queries, frame, 5) if score is None else retrieval.similar_by_trigrams(queries, frame, 5)
    want = set()
    for q, t in items:
        mine = find(t)
        scored = []
        for h, body in docs:
            other = find(body or "")
            shared = len(mine & other)
            if shared:
                scored.append((-(shared / len(mine) if score is None else shared / len(mine | other)), h))
        want |= {(q, h, -s, n + 1) for n, (s, h) in enumerate(sorted(scored)[:5])}
    assert {(r["query"], r["hit"], r["score"], r["rank"]) for r in lane.collect()} == want


def test_rare_terms_stop_the_search_early():
    """The same k best as by weighing every shared term, for a fraction of the work, and less for rarer queries."""
    r = random.Random(2)
    texts = [["the", "of", *(f"w{int(r.paretovariate(0.7))}" for _ in range(20))] for _ in range(6000)]
    every = pa.array(range(6000))
    work = {}
    for name, pick in (("rare", lambda: f"w{r.randint(300, 3000)}"), ("frequent", lambda: f"w{r.randint(1, 8)}")):
        queries = [["the", "of", *(pick() for _ in range(6))] for _ in range(20)]
        best = postings.Best(queries, 5, lambda shared, nq, nr: shared / nq, 0.2)
        for at in range(0, 6000, 100):
            best.weigh(texts[at : at + 100], every.slice(at, 100))
        full = sum(len(set(q) & set(t)) for q in queries for t in texts)
        for i, q in enumerate(queries):
            want = sorted((-len(set(q) & set(t)) / len(set(q)), h) for h, t in enumerate(texts))[:5]
            mine = best.best[0] == i
            assert list(zip((-best.best[2][mine]).tolist(), best.best[1].filter(pa.array(mine)).to_pylist(), strict=True)) == want
        work[name] = best.weighed
        assert best.weighed < 0.1 * full
    assert work["rare"] < 0.8 * work["frequent"]


def test_trigrams_are_those_of_padded_words(monkeypatch):
    """As numbers they are those made word by word; pieces, odd letters and empty texts change nothing."""
    r = random.Random(4)
    odd = ["", "  ", "a", "x_y__z", "a\u0000b", "İstanbul ΣΑΣ ﬁ ß", "漢字 テスト", "\U0001f600 \U00020000\U00020001", "² Ⅷ ½ e\u0301te", "ab" * 40 + " c"]
    monkeypatch.setattr(retrieval, "PIECE", 7)
    for text in odd + ["".join(chr(r.choice([32, r.randint(33, 700), r.randint(0x3000, 0x9000)])) for _ in range(60)) for _ in range(200)]:
        words = set(re.findall(r"[^\W_]+", text.lower()))
        assert retrieval.words_of(text) == words
        made = {f"  {w} "[i : i + 3] for w in words for i in range(len(w) + 1)}
        numbers = retrieval.trigram_numbers(text).tolist()
        assert numbers == sorted(ord(a) << 42 | ord(b) << 21 | ord(c) for a, b, c in made)


@pytest.mark.parametrize("side", [postings.SIDE, 0])
def test_lanes_in_one_reading_equal_each_alone(spark, side, monkeypatch):
    """Counting all terms and looking at the rarest find the same, also with scopes, equal scores and no words at all."""
    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(r.choices(vocabulary, k=r.randint(0, n)))
    scope = lambda: r.choice([None, [], ["a"], ["a", "b"]])
    docs, items = [(i, text(25), scope()) for i in range(400)] + [(900, None, ["a"])], [(i, text(8), scope()) for i in range(25)]
    queries, frame = (spark.createDataFrame(x, f"{n} long, text string, scopes array<string>").repartition(2) for x, n in ((items, "query"), (docs, "hit")))
    monkeypatch.setattr(postings, "SIDE", side)
    both = retrieval.lexical_and_trigram_lanes(queries, frame, 4)
    assert both._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow run") == 1
    want = set()
    for lane, find, whole in (("LEXICAL", retrieval.words_of, False), ("TRIGRAM", retrieval.trigrams_of, True)):
        for q, wanted, own in items:
            mine, scored = find(wanted), []
            for h, body, within in docs:
                other = find(body or "")
                if (shared := len(mine & other)) and (own is None or set(own) & set(within or [])):
                    scored.append((-shared / (len(mine | other) if whole else len(mine)), h))
            want |= {(lane, q, h, -s, n + 1) for n, (s, h) in enumerate(sorted(scored)[:4])}
    assert {(x["lane"], x["query"], x["hit"], x["score"], x["rank"]) for x in both.collect()} == want


def test_few_queries_are_counted_without_postings():
    """A text of many terms costs no look at each of them; the k best are those of the postings."""
    r = random.Random(5)
    queries = [[*r.sample(range(300), 60)] for _ in range(50)]
    texts = [np.unique(r.choices(range(900), k=400)) for _ in range(600)]
    every, found = pa.array(range(600)), []
    for kind in (postings._best([np.unique(q) for q in queries], 5, retrieval.jaccard, 0.0), postings.Best(queries, 5, retrieval.jaccard, 0.0)):
        for at in range(0, 600, 100):
            kind.weigh(texts[at : at + 100], every.slice(at, 100))
        found.append((kind.weighed, [x.tolist() for x in (kind.best[0], kind.best[1].to_numpy(), kind.best[2])]))
    assert found[0][1] == found[1][1] and found[0][0] == 0 < found[1][0]


def test_many_queries_of_frequent_terms_wait_in_bounded_memory():
    """What waits to be cut is bounded by pairs, however many queries a text meets."""
    import tracemalloc

    r = random.Random(3)
    queries = [["the", f"w{i % 50}", f"v{i % 7}"] for i in range(20_000)]
    texts = [["the", *(f"w{r.randint(0, 60)}" for _ in range(4)), f"v{r.randint(0, 9)}"] for _ in range(256)]
    best = postings.Best(queries, 2, lambda shared, nq, nr: shared / nq, 0.2)
    tracemalloc.start()
    best.weigh(texts, pa.array(range(256)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 256 * 20_000 * 8
    for i in range(0, 20_000, 1999):
        want = sorted((-len(set(queries[i]) & set(t)) / 3, h) for h, t in enumerate(texts))[:2]
        mine = best.best[0] == i
        assert list(zip((-best.best[2][mine]).tolist(), best.best[1].filter(pa.array(mine)).to_pylist(), strict=True)) == want


def test_scopes_restrict_before_the_cut(spark):
    docs = spark.createDataFrame([(i, "the dose is five", [1.0, 0.01 * i], ["other"]) for i in range(50)] + [(99, "order no. AB-7 has a dose", [0.0, 1.0], ["a", "b"]), (100, "the dose is five", [1.0, 0.0], None)], "hit long, text string, vector array<double>, scopes array<string>").repartition(3)
    asked = spark.createDataFrame([(1, "the dose is five", [1.0, 0.0], ["b"]), (2, "the dose is five", [1.0, 0.0], None), (3, "the dose is five", [1.0, 0.0], ["z"]), (4, "the dose is five", [1.0, 0.0], [])], "query long, text string, vector array<double>, scopes array<string>")
    for lane in (retrieval.lexical_lane(asked, docs, 2), retrieval.vector_lane(asked, docs, 2, scope="scopes")):
        found = {(x["query"], x["hit"]) for x in lane.collect()}
        assert {h for q, h in found if q == 1} == {99} and {q for q, _ in found} == {1, 2}
        assert len([h for q, h in found if q == 2]) == 2
    have = docs.select("hit", F.array(F.lit("c"), F.lit("d")).alias("concepts"), "scopes")
    got = concepts.concept_lane(asked.select("query", F.array(F.lit("c")).alias("concepts"), "scopes"), have, 2)
    assert {(x["query"], x["hit"]) for x in got.collect()} == {(1, 99), (2, 0), (2, 1)}


def clustered(n, seed, length=16):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(12, length)) * 3
    return [(i, (middle[i % 12] + r.normal(size=length)).tolist(), i % 3) for i in range(n)]


def test_inverted_file_finds_the_nearest(spark, monkeypatch):
    data = clustered(900, 3)
    frame = spark.createDataFrame(data + [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [1.0], 1), (2003, data[0][1], 0)], "hit long, vector array<double>, label int").repartition(3)
    middle, probes = nearest.fitted(frame, 5)
    asked = frame.filter("hit % 9 = 0").withColumnRenamed("hit", "query")
    exact = retrieval.vector_lane(asked, frame, 5)
    share = lambda found, of: nearest.recall(found, of).agg(F.sum("found") / F.sum("wanted")).first()[0]
    found = nearest.ann_lane(asked, frame, middle, 5, probes)
    assert probes < len(middle) / 2 and share(found, exact) >= 0.95
    kept = nearest.in_cells(frame.select("hit", "vector"), middle)
    assert sorted(map(tuple, nearest.ann_lane(asked, kept, middle, 5, probes).collect())) == sorted(map(tuple, found.collect()))
    every = nearest.ann_lane(asked, frame, middle, 5, len(middle))
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, exact.collect()))
    # Cells in many blocks give the same; with all cells the result is exact.
    others = retrieval.nearest_in_scope(frame.filter("hit < 2000 or hit = 2003"), "label", 4)
    assert share(nearest.ann_neighbours(frame, middle, 4, probes, "label"), others) >= 0.95
    whole = sorted(map(tuple, nearest.ann_neighbours(frame, middle, 4, len(middle), "label").collect()))
    monkeypatch.setattr(nearest, "BLOCK", 7)
    assert whole == sorted(map(tuple, nearest.ann_neighbours(frame, middle, 4, len(middle), "label").collect())) == sorted(map(tuple, others.collect()))
    none = frame.limit(0)
    middle, probes = nearest.fitted(none, 5)
    assert nearest.ann_lane(asked, none, middle, 5, probes).collect() == [] == nearest.ann_neighbours(none, middle, 5, probes).collect()


def test_many_queries_are_scored_in_bounded_memory():
    """Pairs of queries and rows never stand in memory at once; equal rows, ties and scopes leave the result exact."""
    import tracemalloc

    r = np.random.default_rng(5)
    have = retrieval.unit(pa.array(np.vstack([r.normal(size=(2500, 8)), np.ones((1500, 8))]).tolist()))
    wanted = have[np.arange(0, 4000, 2)].repeat(4, axis=0)
    ids, scopes = pa.array(r.permutation(4000)), pa.array((np.arange(4000) % 3).tolist())
    batches = [pa.RecordBatch.from_arrays([ids.slice(a, 1000), pa.array(have[a : a + 1000].tolist()), scopes.slice(a, 1000)], names=["hit", "vector", "scope"]) for a in range(0, 4000, 1000)]
    own = np.arange(8000) % 3
    held = type("Held", (), {"value": (pa.array(range(8000)), wanted, retrieval.Scopes(pa.chunked_array([own.tolist()])))})
    tracemalloc.start()
    got = pa.Table.from_batches(list(retrieval._nearest(held, 3, 0.1)(iter(batches))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8000 * 1000 * 8  # one batch's matrix of scores in double
    found = {}
    for q, h, s in zip(*(got[c].to_pylist() for c in ("query", "hit", "score")), strict=True):
        found.setdefault(q, []).append((-s, h))
    names = ids.to_numpy()
    for q in range(0, 8000, 97):
        score = np.round(have @ wanted[q], 6)
        want = sorted((-s, h) for s, h, c in zip(score.tolist(), names.tolist(), scopes.to_pylist(), strict=True) if s >= 0.1 and c == own[q])[:3]
        assert [h for _, h in sorted(found.get(q, []))[:3]] == [h for _, h in want]


def test_vectors_of_another_length_match_nothing(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [1.0]), (4, None), (5, [float("nan"), 1.0])], "hit int, vector array<double>")
    asked = rows.withColumnRenamed("hit", "query").union(spark.createDataFrame([(9, [0.5, 0.5])], "query int, vector array<double>"))
    assert {(x["query"], x["hit"]) for x in retrieval.vector_lane(asked, rows, 5).collect()} == {(1, 1), (9, 1)}


def test_all_hits_of_a_least_score(spark):
    queries = spark.createDataFrame([("q", "a b")], "query string, text string")
    docs = spark.createDataFrame([(i, "a b c" if i % 2 else "a") for i in range(600)], "hit long, text string")
    assert retrieval.lexical_lane(queries, docs, None, 1.0).count() == 300


def test_overlap_equals_brute_force(spark):
    r = random.Random(4)
    sets = [(i, [f"t{min(int(r.expovariate(0.2)), 30)}" for _ in range(r.randint(0, 12))]) for i in range(150)]
    sets += [(200, sets[3][1]), (201, sets[3][1])]
    out = retrieval.overlapping(spark.createDataFrame(sets, "k long, ts array<string>"), "k", "ts", 3, 0.66)
    first = {}
    for k, t in sets:
        first.setdefault(frozenset(t), k)
    distinct = [(k, t) for t, k in first.items() if len(t) >= 3]
    want = {(min(a, b), max(a, b)) for a, x in distinct for b, y in distinct if a < b and len(x & y) >= 3 and len(x & y) / min(len(x), len(y)) >= 0.66}
    assert {(r["a"], r["b"]) for r in out.collect()} == want and want


def test_overlap_moves_no_pairs(spark):
    r = random.Random(5)
    sets = [(i, [f"t{min(int(r.expovariate(0.02)), 400)}" for _ in range(r.randint(3, 90))]) for i in range(300)]
    sets += [(1000 + i, t[: len(t) - i % 9]) for i, t in sets]
    out = retrieval.overlapping(spark.createDataFrame(sets, "k long, ts array<string>"), "k", "ts", 3, 0.66)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    first = {}
    for k, t in sets:
        first.setdefault(frozenset(t), k)
    distinct = [(k, t) for t, k in first.items() if len(t) >= 3]
    want = {(a, b, len(x & y), len(x & y) / min(len(x), len(y))) for a, x in distinct for b, y in distinct if a < b and len(x & y) >= 3 and len(x & y) / min(len(x), len(y)) >= 0.66}
    assert {tuple(r) for r in out.select("a", "b", "n", "overlap").collect()} == want and want


def test_vectors_without_direction_match_nothing(spark):
    vectors = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [2.0, 0.1])]
    frame = spark.createDataFrame(vectors, "hit long, vector array<double>")
    out = retrieval.vector_lane(frame.withColumnRenamed("hit", "query"), frame, 5)
    assert {(r["query"], r["hit"]) for r in out.collect()} == {(1, 1), (1, 5), (5, 1), (5, 5)}
    assert rows(retrieval.nearest_in_scope(frame.withColumn("s", F.lit(1)), "s", 3).select("query", "hit")) == [(1, 5), (5, 1)]


def test_budget_and_backfill(spark):
    hits = [(1, p, f"d{p % 3}", p, "LEXICAL", 100) for p in range(1, 13)] + [(2, 1, "d", 50, "GRAPH", 10), (2, 2, "e", 51, "GRAPH", 10), (2, 3, "f", 52, "GRAPH", 10), (2, 4, "g", 53, "LEXICAL", 9000)]
    frame = spark.createDataFrame(hits, "query int, place int, document string, hit int, lane string, tokens int")
    out = {}
    for r in context.budgeted(frame, per_document=2, tokens=550).collect():
        out.setdefault(r["query"], []).append(r["hit"])
    assert sorted(out[1]) == [1, 2, 3, 4, 5] and sorted(out[2]) == [50, 51]
    eligible = spark.createDataFrame([(h,) for h in (2, 3, 7, 8, 9, 10)], "hit int")
    kept = [r["hit"] for r in context.backfilled(frame.filter("query = 1"), eligible, per_document=2, tokens=550).collect()]
    assert sorted(kept) == [2, 3, 7, 8, 9]
    envelope = context.envelope(spark.createDataFrame([(1, 2, "d", 5, "b"), (1, 1, "e", 4, "a")], "query int, slot int, document string, hit int, text string")).first()["context"]
    assert envelope == '[{"source":1,"documentId":"e","chunkId":4,"text":"a"},{"source":2,"documentId":"d","chunkId":5,"text":"b"}]'


def test_questions_are_cut_where_each_clause_asks(spark):
    parts = lambda q: one(spark, planner.parts(F.lit(q)))
    assert parts("What is the dose and when is it due? See art. 5. Why?") == ["What is the dose and when is it due? See art. 5. Why?", "What is the dose", "when is it due?", "See art. 5.", "Why?"]
    assert parts("Bread and butter") == ["Bread and butter"] and parts("  ") == []


def test_lanes_over_all_parts(spark):
    docs = spark.createDataFrame([(1, "the dose is five"), (2, "the term ends in may"), (3, "order no. AB-7 was shipped"), (4, "postponement of deadlines")], "hit long, text string")
    postings = docs.select("hit", F.explode(identifiers.extracted(F.col("text"))).alias("x")).select("hit", "x.type", "x.normalized")
    asked = [("a", "What is the dose? When does the term end?"), ("b", "What about order no. AB-7?"), ("c", "What about order no. ZZ-9?"), ("d", "postponements deadline")]
    plans = planner.planned(spark.createDataFrame(asked, "query string, text string"), "query", "text")
    out = lanes.searched(plans, lanes.Index(docs, identifiers=postings), 3).collect()
    found = {(r["query"], r["lane"], r["hit"]) for r in out}
    assert {("a", "LEXICAL", 1), ("a", "LEXICAL", 2), ("b", "IDENTIFIER", 3), ("d", "LEXICAL", 4)} <= found
    assert not any(q == "c" for q, _, _ in found) and {h for q, _, h in found if q == "b"} == {3}
    answers = {r["query"]: r for r in ask.answered(spark.createDataFrame(asked, "query string, text string"), docs.withColumn("document", F.col("hit"))).collect()}
    assert answers["a"]["status"] == "GROUNDED" and answers["a"]["sources"] >= 2 and answers["a"]["answer"].endswith("[SOURCE 1]")


def test_named_documents_are_found_however_many_others_are_better(spark):
    docs = spark.createDataFrame([(i, "what about the dose of this order") for i in range(40)] + [(99, "Order no. AB-7: nothing else about it")], "hit long, text string")
    held = docs.select("hit", F.explode(identifiers.extracted(F.col("text"))).alias("x")).select("hit", "x.type", "x.normalized")
    plans = planner.planned(spark.createDataFrame([("b", "What about the dose of order no. AB-7?"), ("c", "What about the dose of order no. ZZ-9?"), ("d", "What about the dose?")], "query string, text string"), "query", "text")
    found = {(r["query"], r["lane"], r["hit"]) for r in lanes.searched(plans, lanes.Index(docs, identifiers=held), 3).collect()}
    assert {(q, lane, h) for q, lane, h in found if q != "d"} == {("b", "IDENTIFIER", 99), ("b", "LEXICAL", 99)}
    assert len([h for q, _, h in found if q == "d"]) == 3


def test_lanes_and_types_of_the_caller(spark):
    docs = spark.createDataFrame([(1, "ticket no. T-5 was closed"), (2, "the dose is five")], "hit long, text string")
    types = {**identifiers.TYPES, "TICKET_NUMBER": "ticket"}
    held = docs.select("hit", F.explode(identifiers.extracted(F.col("text"), types)).alias("x")).select("hit", "x.type", "x.normalized")
    asked = spark.createDataFrame([("a", "What about ticket no. T-5?"), ("b", "what is the dose")], "query string, text string")
    plans = planner.planned(asked, "query", "text", types=types, more=["TITLE"])

    def titles(parts, index, k):
        return parts.crossJoin(index.documents.filter("hit = 2")).select("query", "hit", F.lit(1).alias("rank"))

    found = {(r["query"], r["lane"], r["hit"]) for r in lanes.searched(plans, lanes.Index(docs, identifiers=held), 3, {"TITLE": titles}).collect()}
    assert {("a", "IDENTIFIER", 1), ("a", "TITLE", 2), ("b", "TITLE", 2), ("b", "LEXICAL", 2)} <= found and ("a", "LEXICAL", 2) not in found


def test_concepts_decide_the_plan(spark):
    surfaces = spark.createDataFrame([("dose", "en", "daily dose"), ("term", "en", "term of notice")], "concept string, language string, phrase string")
    asked = [("exact", "What is the daily dose?"), ("fuzzy", "Which daily doses are there?"), ("plain", "Where is the house?"), ("only", "order no. AB-7"), ("named", "What is the daily dose in order no. AB-7?"), ("other", "Where is the house in order no. AB-7?"), ("none", "12 34")]
    plans = planner.planned(spark.createDataFrame(asked, "query string, text string"), "query", "text", surfaces).filter("part = 0")
    got = {r["query"]: (r["kind"], "CONCEPT" in r["lanes"], "LEXICAL" in r["lanes"]) for r in plans.collect()}
    assert got["exact"] == ("CONCEPTUAL_EXACT", True, False) and got["fuzzy"] == ("CONCEPTUAL_FUZZY", True, True) and got["plain"] == ("GENERIC", False, True)
    assert got["named"][:2] == ("IDENTIFIER_CONCEPTUAL", True) and got["other"][:2] == ("IDENTIFIER_SEMANTIC", False) and got["none"][0] == "ANALYSIS_UNAVAILABLE"
    assert got["only"][0] == "IDENTIFIER_ONLY" or not got["only"][1]


def test_concept_lane_makes_no_pairs_of_equal_rows(spark):
    """Equal documents count as their first k, equal queries as one: the rows that meet do not grow with either."""
    docs = spark.range(3000).select(F.col("id").alias("hit"), F.array(F.lit("a"), F.when(F.col("id") % 3 == 0, "b").otherwise("c")).alias("concepts"))
    asked = spark.range(2000).select(F.col("id").alias("query"), F.when(F.col("id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("c"), F.lit("none"))).alias("concepts"))
    lane = concepts.concept_lane(asked, docs, 2)
    got = {}
    for r in lane.collect():
        got.setdefault(r["query"], []).append((r["rank"], r["hit"], r["score"]))
    assert len(got) == 2000
    assert all(sorted(v) == ([(1, 0, 1.0), (2, 3, 1.0)] if q % 2 == 0 else [(1, 1, 0.5), (2, 2, 0.5)]) for q, v in got.items())
    assert "Exchange hashpartitioning(c#" not in lane._jdf.queryExecution().executedPlan().toString()


def test_plurals_are_no_verbs_and_function_words_have_no_forms(spark):
    surfaces = spark.createDataFrame([("thing", "en", "things"), ("part", "en", "of the"), ("dose", "en", "daily dose")], "concept string, language string, phrase string")
    asked = [(1, "a thing"), (2, "it thinged and was thinging"), (3, "one of thes"), (4, "daily doses"), (5, "most of theing"), (6, "the things of the day")]
    rows = spark.createDataFrame([(i, "en", t) for i, t in asked], "id int, language string, t string")
    got = {(r["id"], r["concept"], r["mode"]) for r in concepts.matched(rows, surfaces, "id", "t").collect()}
    assert got == {(1, "thing", "LEMMA"), (4, "dose", "LEMMA"), (6, "thing", "EXACT"), (6, "part", "EXACT")}


def test_answers_are_verified_before_they_are_given(spark):
    docs = spark.createDataFrame([(1, "d1", "The daily dose is 5 kg of grain. More follows."), (2, "d2", "The house has seven windows.")], "hit long, document string, text string")
    asked = spark.createDataFrame([("right", "What is the daily dose of grain?"), ("unit", "What is the daily dose of grain?"), ("uncited", "What is the daily dose of grain?"), ("nothing", "zzz qqq"), ("silent", "What is the daily dose of grain?"), ("against", "What is the daily dose of grain?")], "query string, text string")
    answers = spark.createDataFrame([("right", "It is 5000 g. [SOURCE 1]"), ("unit", "It is 5 km. [SOURCE 1]"), ("uncited", "It is 5 kg. [SOURCE 7]"), ("nothing", "It is so. [SOURCE 1]"), ("against", "It is 5 kg. [SOURCE 1]")], "query string, answer string")
    labels = spark.createDataFrame([("right", ["SUPPORTED"]), ("against", ["CONTRADICTED"])], "query string, labels array<string>")
    got = {r["query"]: r for r in ask.answered(asked, docs, answers=answers, labels=labels).collect()}
    assert {q: r["status"] for q, r in got.items()} == {"right": "GROUNDED", "unit": "UNGROUNDED", "uncited": "UNGROUNDED", "nothing": "INSUFFICIENT", "silent": "INSUFFICIENT", "against": "REJECTED"}
    assert got["right"]["answer"] == "It is 5000 g. [SOURCE 1]" and got["unit"]["mismatched"] == 1 and got["uncited"]["missing"] == 1
    assert all(r["answer"] == grounding.FALLBACKS["en"] for q, r in got.items() if q != "right")


def test_remembered_scopes(spark):
    memory = spark.createDataFrame([("m1", ["x", "y"], [1.0, 0.0], 3), ("m2", ["y"], [1.0, 0.1], 9), ("m3", [], [1.0, 0.0], 1)], "cluster string, scope array<string>, centroid array<double>, support int")
    queries = spark.createDataFrame([(1, ["x"], [1.0, 0.0]), (2, [], [1.0, 0.0]), (3, ["z"], [1.0, 0.0])], "query int, required array<string>, vector array<double>")
    out = learning.remembered(memory, queries, k=3)
    assert {(r["query"], r["cluster"]) for r in out.collect()} == {(1, "m1"), (2, "m1"), (2, "m2"), (2, "m3")}


# Grounding


@pytest.mark.parametrize(
    ("claim", "evidence", "holds"),
    [("5 kg", "5 km", False), ("100 GBP", "100 JPY", False), ("-5 degrees", "5 degrees", False), ("1 g", "1000 mg", True), ("5 apples", "5 pears", False), ("7 crates", "7 crate", True), ("$100", "100 USD", True), ("EUR 1.5", "1.5 €", True), ("90 minutes", "1.5 h", True), ("5-10 mg", "from 5 to 10 mg", True), ("5-10 mg", "10-5 mg", False), ("5 mg", "5-10 mg", False), ("−3 °C", "-3 °C", True), ("25 and more", "25 or less", True), ("2 kg/m", "2000 g/m", True), ("$5 EUR", "5 EUR", False), ("A7", "nothing", True)],
)
def test_quantities_convert(claim, evidence, holds):
    assert grounding.follows(grounding.claims(claim, "en"), grounding.claims(evidence, "en")) is holds


def test_claims_and_dates():
    assert grounding.claims("Pay at least 1,250.5 USD by 03/04/2024.", "en") == [("1250.5", "USD", "MIN"), ("2024-03-04", "date", "MIN")]
    assert grounding.claims("höchstens 1.250,5 € am 03.04.2024", "de") == [("1250.5", "USD" if False else "EUR", "MAX"), ("2024-04-03", "date", "MAX")]
    assert grounding.claims("on 03/04/2024", "xx") == [(None, "date", "")] and grounding.claims("31.02.2024", "de") == [(None, "date", "")]
    assert grounding.claims("12,34 mg", "en") == [(None, "mg", "")] and grounding.claims(None, "en") == []


@pytest.mark.parametrize(
    ("answer", "status", "missing", "wrong"),
    [
        ("Take 5 mg. [SOURCE 1] It helps. [SOURCE 2]", "GROUNDED", 0, 0),
        ("Take 5 mg. It helps. [SOURCE 2]", "UNGROUNDED", 1, 0),
        ("Take 6 mg. [SOURCE 1]", "UNGROUNDED", 0, 1),
        ("Take 5 mg. [SOURCE 7]", "UNGROUNDED", 1, 0),
        ("First 5 mg, then 9 ml. [SOURCE 1]", "GROUNDED", 0, 0),
        ("First 9 ml, then 5 mg. [SOURCE 1]", "UNGROUNDED", 0, 1),
        ("First 5 mg, then 9 ml. [SOURCE 2][SOURCE 1]", "GROUNDED", 0, 0),
        ("", "UNGROUNDED", 0, 0),
    ],
)
def test_answers_are_verified_sentence_by_sentence(answer, status, missing, wrong):
    got = grounding.verified(answer, "en", ["Doses: 5 mg and later 9 ml.", "Nothing."])
    assert (got[0], got[2], got[3]) == (status, missing, wrong)


# Ingestion and jobs


def test_ingestion_end_to_end(spark):
    docs = [("a", "T", "en", "MEDICAL", 1, "# Use\nThe dose is 5 mg. See article 3 and order no. AB-1.\n" + "More words follow here. " * 200), ("b", None, "en", "GENERAL", 2, "Article 3\nText."), ("c", "x", "en", "GENERAL", 2, None), ("d", "x", "en", "GENERAL", 2, "same\n"), ("e", "x", "en", "GENERAL", 2, "same\n")]
    frame = spark.createDataFrame(docs, "document string, title string, language string, domain string, access_level long, text string")
    known = spark.createDataFrame([("a", 4)], "document_id string, generation long")
    surfaces = spark.createDataFrame([("med.dose", "en", "dose")], "concept string, language string, phrase string")
    out = ingest.ingested(frame, HashingEmbedder(16), known, surfaces)
    generations = {r["document_id"]: r for r in out.generations.collect()}
    assert {k: (r["generation"], r["generation_status"]) for k, r in generations.items()} == {"a": (5, "PUBLISHED"), "b": (1, "PUBLISHED"), "c": (1, "FAILED"), "d": (1, "PUBLISHED"), "e": (1, "PUBLISHED")}
    chunks, vectors = out.chunks.collect(), out.vectors.collect()
    assert len({r["vector_id"] for r in vectors}) == len(vectors) == sum(r["role"] != "PARENT" for r in chunks) and all(len(r["vector"]) == 16 for r in vectors)
    assert any(r["role"] == "PARENT" for r in chunks) and any(r["concepts"] == ["med.dose"] and r["unit"] == "DOSAGE" for r in chunks if r["document"] == "a")
    assert {(r["document"], r["normalized"]) for r in out.identifiers.collect()} == {("a", "AB-1")}
    assert {(r["document"], r["value"]) for r in out.anchors.collect()} == {("b", "3")} and {r["value"] for r in out.edges.collect()} == {"3"}


def test_repeated_documents_are_one_generation(spark):
    row = lambda document, text, seq: (document, "T", "en", "GENERAL", 1, text, seq)
    docs = [row("a", "one", 3), row("a", "one", 1), row("a", "two", 2), row("b", "x", 5), row("b", "x", 5), row("c", None, 1), row("c", None, 2), row("d", "old", 1), row("d", "new", 2)]
    frame = spark.createDataFrame(docs, "document string, title string, language string, domain string, access_level long, text string, seq long")
    first = ingest.claimed(frame.filter("document = 'd' and text = 'old'"))[1].first()
    known = spark.createDataFrame([("a", 7, None), ("d", 4, first["fingerprint"]), ("d", 5, "other")], "document_id string, generation long, fingerprint string")
    out = ingest.ingested(frame, HashingEmbedder(8), known)
    got = sorted((r["document"], r["generation"], r["requests"], r["status"]) for r in out.claims.collect())
    assert got == [("a", 8, 2, "SUPERSEDED"), ("a", 9, 1, "CURRENT"), ("b", 1, 2, "CURRENT"), ("c", 1, 2, "CURRENT"), ("d", 4, 1, "REPLAY"), ("d", 6, 1, "CURRENT")]
    chunks = sorted((r["document"], r["generation"], r["text"]) for r in out.chunks.collect())
    assert chunks == [("a", 8, "one"), ("a", 9, "two"), ("b", 1, "x"), ("d", 6, "new")]
    assert sorted((r["document_id"], r["generation"], r["generation_status"], r["chunk_count"]) for r in out.generations.collect()) == [("a", 8, "SUPERSEDED", 1), ("a", 9, "PUBLISHED", 1), ("b", 1, "PUBLISHED", 1), ("c", 1, "FAILED", 0), ("d", 6, "PUBLISHED", 1)]
    assert len({r["vector_id"] for r in out.vectors.collect()}) == 4


@pytest.mark.parametrize("seed", range(6))
def test_no_atomic_stretch_is_cut(seed):
    r = random.Random(seed)
    kinds = ["The dosage is {} mg a day with {}.", "Members must pay {} within {}.", "Except {} and {} nobody is free.", "Plain words {} about {}.", "Unless {} holds, {} follows."]
    text = ""
    for _ in range(r.randint(20, 90)):
        words = lambda: " ".join(f"word{r.randrange(99)}" for _ in range(int(r.paretovariate(0.9)) % 260))  # noqa: E731, B023
        text += ("# Head\n" if r.random() < 0.05 else "") + r.choice(kinds).format(words(), words()) + r.choice([" ", "\n"])
    for domain in ("MEDICAL", "LEGAL"):
        found = chunking.units(text)
        whole = chunking.atomic_spans(text, found, domain)
        made = chunking.chunks(text, domain)
        assert whole and "".join("".join(c[4].split()) for c in made if c[2] != "CHILD") == "".join("".join(text[a:b].split()) for _, _, a, b in found)
        parents = {c[1] for c in made if c[2] == "CHILD"}
        shown = [c for c in made if c[2] != "PARENT"]
        for a, b in whole:
            if tokens.estimate(text[a:b]) <= chunking.HARD - 5:
                assert any(text[a:b] in c[4] for c in shown), (domain, text[a:b][:80])
        assert all(c[5] <= chunking.HARD for c in made) and all(k in parents for k, *_ in [c for c in made if c[2] == "PARENT"])
        for k in parents:
            assert "".join("".join(c[4].split()) for c in made if c[1] == k) == "".join(made[k][4].split())


def test_contexts_cost_what_their_bound_allows(spark):
    long = spark.range(100_000).select(F.lit(1).alias("r"), (F.col("id") % 50_000).alias("i"), F.col("id").alias("p"))
    few = spark.createDataFrame([(2, 9, 1), (2, 9, 2), (2, 7, 3), (2, None, 4), (3, 1, 1)], "r int, i long, p long")
    pairs = graph.context_pairs(long.unionByName(few), "r", "i", [F.col("p")], 4)
    assert rows(pairs) == [(1, u, v) for u in range(4) for v in range(u + 1, 4)] + [(2, 7, 9)]


def test_split_clusters_agree_with_one_fold(spark):
    data = clustered(1200, 8)
    frame = spark.createDataFrame([(s, i, i, v) for i, v, s in data] + [(0, 5000 + k, 5000 + k, data[0][1]) for k in range(300)], "scope int, id long, seq long, vector array<double>")
    one = {r["id"]: r["cluster"] for r in learning.leader_clusters(frame, "scope").collect()}
    made = learning.split_clusters(frame, "scope", 60)
    many = {r["id"]: r["cluster"] for r in made.collect()}
    assert set(one) == set(many) and all(many[i] == many[0] for i in many if i >= 5000)
    r, ids = random.Random(1), sorted(one)
    pairs = [r.sample(ids, 2) for _ in range(4000)]
    assert sum((one[a] == one[b]) == (many[a] == many[b]) for a, b in pairs) / len(pairs) > 0.95
    assert all(many[c] == c and c <= i for i, c in many.items())


def test_split_clusters_lose_no_earlier_leader(spark):
    """A leader joins the one before it, however many that come behind it are nearer; rows without a scope are clustered too."""
    turn = lambda degrees: [float(np.cos(np.radians(degrees))), float(np.sin(np.radians(degrees)))]
    data = [(s, 100 * k + i, turn(0 if i == 0 else 29 + 0.1 * i)) for k, s in enumerate((1, None)) for i in range(41)]
    frame = spark.createDataFrame([(s, i, i, v) for s, i, v in data], "scope int, id long, seq long, vector array<double>")
    made = {(r["scope"], r["id"]): r["cluster"] for r in learning.split_clusters(frame, "scope", 1, 1).collect()}
    assert made == {(s, i): 100 * (s is None) for s, i, _ in data}


def test_nearest_earlier_is_exact_in_blocks(spark):
    r = np.random.default_rng(4)
    data = [(i % 2, i, int(r.integers(0, 40)), r.integers(-2, 3, 4).astype(float).tolist()) for i in range(150)]
    data = [x for x in data if any(x[3])]
    frame = spark.createDataFrame(data, "scope int, hit long, seq long, vector array<double>")
    unit = {i: np.array(v) / np.linalg.norm(v) for _, i, _, v in data}
    want = []
    for s, i, q, _ in data:
        found = [(-round(float(unit[i] @ unit[j]), 6), p, j) for t, j, p, _ in data if t == s and (p, j) < (q, i)]
        if found and -min(found)[0] >= 0.5:
            want.append((i, min(found)[2], -min(found)[0]))
    for block in (7, 1000):
        assert sorted(map(tuple, nearest.nearest_earlier(frame, "scope", 0.5, block).collect())) == sorted(want)


def test_embedders_are_checked(spark):
    class Short:
        profile, dimensions = "short", 8

        def embed(self, texts):
            return np.zeros((len(texts), 7))

    with pytest.raises(Exception, match="wrong shape"):
        embedded(spark.createDataFrame([("a",)], "text string"), Short()).collect()
    sizes = embedded(spark.createDataFrame([("a",)] * 3 + [(None,)], "text string"), HashingEmbedder(8)).select(F.size("vector").alias("n")).collect()
    assert [r["n"] for r in sizes] == [8] * 4


def test_headings_hold_until_a_higher_one(spark):
    blocks = [("HEADING", 1, "A"), ("PARAGRAPH", None, "x"), ("HEADING", 2, "B"), ("HEADING", 3, "C"), ("PARAGRAPH", None, "y"), ("HEADING", 2, "D"), ("PARAGRAPH", None, "z"), ("HEADING", 1, "E"), ("PARAGRAPH", None, "w")]
    frame = spark.createDataFrame([(("d", [(*b, 1) for b in blocks]),)], "doc struct<documentId:string,blocks:array<struct<type:string,level:int,text:string,page:int>>>")
    out = [r["section_path"] for r in ingest.canonical_units(frame).filter("kind = 'PARAGRAPH'").orderBy("position").collect()]
    assert out == ["A", "A > B > C", "A > D", "E"]


def test_keyed_fingerprints_equal_the_library(spark):
    secret = "s" * 32
    frame = spark.createDataFrame([("abc",), ("",), (None,)], "t string")
    got = [r["f"] for r in frame.select(hashing.keyed_fingerprint(secret)("t").alias("f")).collect()]
    assert got == [hmac.new(secret.encode(), t.encode(), hashlib.sha256).hexdigest() if t is not None else None for t in ("abc", "", None)]
    with pytest.raises(ValueError, match="32"):
        hashing.keyed_fingerprint("short")


def test_name_uuids_equal_the_library(spark):
    import uuid

    for t in ("", "abc", "déjà"):
        digest = hashlib.md5(t.encode()).digest()
        assert one(spark, hashing.name_uuid(F.lit(t))) == str(uuid.UUID(bytes=digest, version=3))


def test_compare_and_set_by_hand(spark):
    values = spark.createDataFrame([("a", "0", 3), ("b", "0", 1)], "name string, value string, version long")
    updates = spark.createDataFrame([("a", 1, 3, "x"), ("a", 2, 3, "lost"), ("a", 3, 4, "y")], "name string, seq long, expected long, value string")
    assert rows(lifecycle.compared_and_set(values, updates)) == [("a", "y", 5), ("b", "0", 1)]


def test_graph_upkeep_by_hand(spark):
    edges = [("s", f"t{i}", "WARM", 50, 9, 9, 0.9, 1) for i in range(12)] + [("s", "old", "DECAYED", 1, 0, 0, 0.1, 60), ("s", "new", "CANDIDATE", 1, 0, 1, 0.1, 2)]
    frame = spark.createDataFrame(edges, "src string, tgt string, band string, support int, citations int, queries int, likeness double, age_days int")
    out = {r["tgt"]: r["band"] for r in graph.maintained(frame).collect()}
    assert sum(b == "HOT" for b in out.values()) == graph.QUOTAS["HOT"] and "old" not in out and out["new"] == "CANDIDATE"


def test_leader_clusters_by_hand(spark):
    frame = spark.createDataFrame([(1, 1, 1, [1.0, 0.0]), (1, 2, 2, [0.99, 0.05]), (1, 3, 3, [0.0, 1.0]), (2, 4, 1, [1.0, 0.0]), (1, 5, 9, [0.0, 0.0])], "scope int, id int, seq int, vector array<double>")
    assert rows(learning.leader_clusters(frame, "scope")) == [(1, 1, 1), (1, 2, 1), (1, 3, 3), (2, 4, 4)]


def test_observed_candidates_by_hand(spark):
    stored = spark.createDataFrame([(1, 2, 0.95, "ACTIVE"), (1, 3, 0.95, "CANDIDATE"), (1, 4, 0.9, "ACTIVE")], "u int, v int, confidence double, state string")
    found = spark.createDataFrame([(1, 2, 0.91), (1, 3, 0.91), (1, 5, 0.97), (1, 6, 0.5)], "u int, v int, confidence double")
    assert rows(discovery.observed(stored, found)) == [(1, 2, 0.91, "ACTIVE"), (1, 3, 0.91, "CANDIDATE"), (1, 4, 0.9, "STALE"), (1, 5, 0.97, "ACTIVE")]


def test_merges_by_hand(spark):
    base = spark.createDataFrame([(1, h, h) for h in range(1, 11)] + [(2, h, h) for h in range(1, 4)], "query int, hit int, position int")
    extra = spark.createDataFrame([(1, 101, 1), (1, 3, 2), (1, 102, 3), (1, 103, 4)], "query int, hit int, position int")
    order = lambda df, q: [r["hit"] for r in df.filter(F.col("query") == q).orderBy("slot").collect()]
    merged = ranking.reserved_merge(base, extra, "query", "hit", "position", 8)
    assert order(merged, 1) == [1, 2, 3, 4, 5, 6, 101, 102] and order(merged, 2) == [1, 2, 3]
    assert order(ranking.interleaved(base, extra, "query", "hit", "position", 4, 8), 1) == [1, 2, 3, 4, 101, 102, 5, 6]


def test_lexicons_are_loaded_and_checked(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"concept": "c", "language": "en", "phrase": "p q"}\n{"concept": "c", "language": "en", "phrase": "p q"}\n')
    (tmp_path / "bad.json").write_text('{"concept": "c", "language": "en"}\n')
    assert rows(lexicons.surfaces(spark, f"file://{tmp_path}/good.json")) == [("c", "en", "p q")]
    with pytest.raises(Exception, match="lacks a field"):
        lexicons.surfaces(spark, f"file://{tmp_path}/bad.json").collect()


def test_long_surfaces_match(spark):
    surfaces = spark.createDataFrame([("long", "en", "one two three four five six seven")], "concept string, language string, phrase string")
    docs = spark.createDataFrame([(1, "en", "say one two three four five six seven now")], "k int, language string, text string")
    assert concepts.matched(docs, surfaces, "k", "text").first()["concept"] == "long"


def test_spread_and_store(spark, sf):
    assert tables.spread(tables.table(spark, sf, "documents")).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    with pytest.raises(Exception, match="row count differs"):
        tables.verified_count(spark.range(3), 4).collect()


def test_text_normalization(spark):
    assert one(spark, text.normalized(F.lit(" a\r\n\r\n\r\n\r\nb \t c "))) == "a\n\nb c"
    assert one(spark, text.contains_phrase(F.lit("a bc d"), F.lit("bc"))) is True and one(spark, text.contains_phrase(F.lit("a bcd"), F.lit("bc"))) is False


def test_pairs_are_made_once_and_dealt_by_size(spark, sf, monkeypatch):
    from galena.queries import processes
    from galena.sources import tables

    lines = spark.createDataFrame([(1, 5), (1, 5), (1, 7), (2, 7), (1, 7), (1, 9), (None, 5), (None, 6)], "o int, p int")
    assert rows(graph.canonical_pairs(lines, ["o"], "p")) == [(1, 5, 7, 4), (1, 5, 9, 2), (1, 7, 9, 2)]
    monkeypatch.setattr(tables, "PART_BYTES", 10_000)
    many = tables.parts_for(tables.table(spark, sf, "lineitem"))
    plan = processes.bought_together(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert many > 8 and f", {many}), REPARTITION" in plan


def test_a_text_of_many_chunks_is_read_once(spark):
    chunks = spark.range(50).select(F.lit("d").alias("document"), F.col("id").alias("chunk"), F.when(F.col("id") < 49, "Article 1\nsee article 2").alias("text"))
    texts = references.by_text(chunks, identifiers.declared(F.col("text")))
    assert texts.count() == 49 and references.anchors(chunks).count() == 49
    plan = texts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("regexp_extract_all") < plan.index("Aggregate [_text")


def test_lanes_that_are_used_twice_are_run_once(spark, sf):
    from galena.queries import knowledge, search

    for query in (knowledge.stage_attribution, search.context_envelope):
        assert "term_lane" not in (plan := query(spark, sf)._jdf.queryExecution().optimizedPlan().toString()) and plan.count("MapInArrow run") == 0


def test_stems_are_found_wherever_patterns_fit(spark):
    from galena.functions import identifiers

    words = "caſe 12|FİGURA 3|KIſIM IV|fıkra 7|ſection II|ΠΑΡΆΓΡΑΦΟΣ 4|µέρος 5|Заказ № А-1|СЧЁТ 97|Bölüm 2".split("|")
    rows = spark.createDataFrame(list(enumerate(words)) + [(99, None)], "k int, text string")
    body = F.col("text")
    out = rows.select("k", identifiers.extracted(body).alias("a"), F.concat(identifiers.references(body), identifiers.named_objects(body)).alias("b"), identifiers.declared(body).alias("c")).orderBy("k").collect()
    assert [[x["type"] for x in r["a"] or []] for r in out[:10]] == [["CASE_NUMBER"], [], [], [], [], [], [], ["ORDER_NUMBER"], ["INVOICE_NUMBER"], []]
    assert [[x["type"] for x in r["b"]] for r in out[:10]] == [[], ["FIGURE"], ["PART"], ["PARAGRAPH"], ["SECTION"], ["PARAGRAPH"], ["PART"], [], [], ["SECTION"]]
    assert [[x["type"] for x in r["c"]] for r in out[:7]] == [[], [], ["PART"], ["PARAGRAPH"], ["SECTION"], ["PARAGRAPH"], ["PART"]]
    assert out[10]["a"] is None and out[10]["b"] is None and out[10]["c"] is None


def test_texts_are_enriched_only_where_that_is_asked_for(spark):
    from galena.operators import ingest
    from galena.sources.embedders import HashingEmbedder

    docs = spark.createDataFrame([("d", "t", "en", "GENERAL", 1, "See article 3 of contract no. 7.")], "document string, title string, language string, domain string, access_level long, text string")
    made = ingest.ingested(docs, HashingEmbedder())
    plan = made.generations._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and [r["generation_status"] for r in made.generations.collect()] == ["PUBLISHED"]
    assert made.identifiers.count() == 1 and made.chunks.first()["references"][0]["value"] == "3"


def test_long_texts_are_matched_in_proportion(spark):
    import time

    from galena.operators import concepts

    surfaces = spark.createDataFrame([("a", "en", "mit license")], "concept string, language string, phrase string")
    docs = spark.createDataFrame([(1, "en", " ".join(f"w{i}" for i in range(40_000)) + " MIT licenses")], "k long, language string, text string")
    began = time.time()
    assert [(r["concept"], r["mode"]) for r in concepts.matched(docs, surfaces, "k", "text").collect()] == [("a", "LEMMA")]
    assert time.time() - began < 60
    words = F.split("text", " ")
    plan = docs.select(concepts._grams(words, [1, 2], words))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct" not in plan


def test_backfill_searches_once(spark):
    import __spark_entry__
    from pathlib import Path

    folder = "/root/testdata/sf0.001"
    if not Path(folder).exists():
        pytest.skip("no test data")
    out = __spark_entry__.queries()["select_backfill"](spark, folder)
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()


def test_neighbours_of_a_least_score(spark):
    from galena.operators import nearest

    r = np.random.default_rng(3)
    vectors = spark.createDataFrame([(i, [float(x) for x in r.normal(size=4)]) for i in range(120)], "hit long, vector array<double>")
    middle, _ = nearest.fitted(vectors, 1, 4)
    whole = nearest.ann_neighbours(vectors, middle, 5, 2).filter("score >= 0.9").select("query", "hit", "score")
    assert rows(nearest.ann_neighbours(vectors, middle, 5, 2, threshold=0.9).select("query", "hit", "score")) == rows(whole) and whole.count()


def test_phrases_are_inflected_instead_of_texts(spark):
    """Every word is among the sources of its lemma and stem, matches are those of all words' forms, and no text's word gets a form."""
    from galena.functions import morphology

    r, language = random.Random(7), F.col("language")
    ends = ["", "s", "es", "ies", "ied", "ing", "ed", "ss", "us"] + [e for listed in (morphology.FIRST, morphology.SECOND, *morphology.SUFFIXES.values()) for e in listed]
    bases = ["", "a", "t", "ad", "add", "tie", "box", "bus", "plan", "planning", "relat", "nation", "kind", "hopef", "schön", "дом"]
    made = [(la, b + e + t) for la in ("en", "de", "ru", "xx") for b in bases for e in ends for t in ("", "s", "ly", "ing") if b + e + t]
    words = spark.createDataFrame(made, "language string, word string").distinct()
    held = [F.array_contains(morphology.lemma_sources(morphology.english_lemma(F.col("word"))), F.col("word")), F.array_contains(morphology.stem_sources(morphology.stem(F.col("word"), language), language), F.col("word"))]
    assert words.filter(~held[0] | ~held[1]).count() == 0

    some = [w for la, w in made if la == "en" and r.random() < 0.02][:40] + ["the", "of", "thes", "inning"]
    surfaces = [(f"c{i % 5}", r.choice(["en", "de"]), " ".join(r.choices(some, k=r.randint(1, 3)))) for i in range(25)] + [("none", "en", "!"), ("c0", "en", "The Of"), ("c0", "en", "the of"), ("stemmed", "en", "kind relat")]
    texts = [(i, r.choice(["en", "de", None]), " ".join(r.choices(some + [w + "s" for w in some] + [w + "ing" for w in some], k=r.randint(0, 40)))) for i in range(120)] + [(900, "en", None), (901, "en", "some kindness relatly")]
    forms = {}
    every = sorted({w for _, _, t in surfaces + texts for w in (t or "").lower().replace("!", "").split()})
    frame = spark.createDataFrame([(la, w) for la in ("en", "de") for w in every], "language string, word string")
    for m, _ in concepts.MODES:
        forms |= {(m, x["language"], x["word"]): x["f"] for x in frame.withColumn("f", concepts._form(F.col("word"), m, language)).collect()}
    change = lambda w, f: "-" if w == f else "s" if w.endswith("s") else "v"
    want = {}
    for i, la, t in texts:
        have = (t or "").lower().split()
        for c, sl, p in surfaces:
            ws = p.lower().replace("!", "").split()
            for m, confidence in concepts.MODES:
                if sl != la or not ws or (m == "STEM" and len(ws) < 2):
                    continue
                same = lambda a, b: forms[m, la, a] == forms[m, la, b] and not (m == "LEMMA" and change(a, forms[m, la, a]) == "s" and change(b, forms[m, la, b]) == "v")  # noqa: E731, B023
                if any(all(map(same, ws, have[at : at + len(ws)])) for at in range(len(have) - len(ws) + 1)):
                    want[i, c] = max(want.get((i, c), (0.0,)), (confidence, len(ws) * confidence, m))
    docs = spark.createDataFrame(texts, "k int, language string, t string")
    found = concepts.matched(docs, spark.createDataFrame(surfaces, "concept string, language string, phrase string"), "k", "t")
    assert {(x["k"], x["concept"]): (x["confidence"], x["weight"], x["mode"]) for x in found.collect()} == want and len({v[2] for v in want.values()}) == 3
    assert "ies$" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert concepts.matched(docs, spark.createDataFrame([], "concept string, language string, phrase string"), "k", "t").collect() == []


def test_hits_wait_before_they_are_cut(monkeypatch):
    """The best of all queries are not sorted for every slice; equal scores behind them do not wait at all."""
    r, cuts = random.Random(3), []
    cut = postings.Best._cut
    monkeypatch.setattr(postings.Best, "_cut", lambda self, *a: cuts.append(1) or cut(self, *a))
    words = [f"w{i}" for i in range(30)]
    queries, texts = [r.sample(words, 3) for _ in range(50)], [r.sample(words, 12) for _ in range(1024)]
    hits = pa.array(range(1024))
    best = postings.Best(queries, 3, postings.share, 0.2)
    for at in range(0, 1024, 8):
        best.offer(texts[at : at + 8], hits.slice(at, 8))
    waiting = best.count
    best.cut()
    assert len(cuts) <= 4 and waiting <= 50
    for i, q in enumerate(queries):
        mine = best.best[0] == i
        want = sorted((-len({*q} & {*t}) / 3, h) for h, t in enumerate(texts))[:3]
        assert list(zip((-best.best[2][mine]).tolist(), best.best[1].filter(pa.array(mine)).to_pylist(), strict=True)) == want


def test_parts_are_analysed_once(spark):
    surfaces = spark.createDataFrame([("dose", "en", "daily dose")], "concept string, language string, phrase string")
    asked = spark.createDataFrame([(1, "What is the daily dose? Where is it")], "query int, text string")
    plan = planner.planned(asked, "query", "text", surfaces)
    assert "posexplode" not in plan._jdf.queryExecution().optimizedPlan().toString() and plan.count() == 3


def test_marks_rule_nothing_out_that_is_there(spark):
    r = random.Random(5)
    stems = [x for group in (identifiers.TYPE_STEMS, identifiers.REFERENCE_STEMS, identifiers.OBJECT_STEMS, identifiers.EXTERNAL_STEMS) for listed in group.values() for x in listed.split()]
    whole = "article Articles section part clause capítulo kısım KISIM bölüm статья table Annex figure RFC ISO GOST ГОСТ Regulation 第三条 第三至五条 order contract заказ СЧЁТ must shall may unless dose within is".split()
    ends = ["", " 4", " IV", "№ 7", " no. A-1", " (EU) 2016/679", " not", " prohibited", "ı 3", "ς 2", "\n"]
    texts = ["".join(f"{r.choice([x, x.upper(), x.title()])}{r.choice(ends)} " for x in r.choices(stems + whole * 3 + ["plain", "words"], k=r.randint(0, 6))) for _ in range(1500)]
    frame = spark.createDataFrame([(t, chunking.marks(t)) for t in texts], "text string, marks int")
    body, marks, domain = F.col("text"), F.col("marks"), F.lit("MEDICAL")
    both = [(f(body), f(body, marks=marks)) for f in (identifiers.extracted, identifiers.references, identifiers.declared, identifiers.named_objects, identifiers.chinese_references, identifiers.external_references)]
    both.append((chunking.unit_class(body, domain), chunking.unit_class(body, domain, marks)))
    for a, b in both:
        assert frame.filter(~a.eqNullSafe(b)).count() == 0 and frame.select(a.alias("x")).distinct().count() >= 3
    assert frame.filter("marks = 0").count() > 5


def test_kept_tables_are_made_from_those_before(spark, tmp_path):
    docs = spark.createDataFrame([(f"d{i}", "t", "en", "GENERAL", 1, f"Article {i}. See section {i + 1} and table 2. The buyer shall pay order no. A-{i}/7.") for i in range(40)] + [("d1", "t", "en", "GENERAL", 1, "Other"), ("d2", "t", "en", "GENERAL", 1, " ")], "document string, title string, language string, domain string, access_level int, text string")
    docs = docs.unionByName(docs.filter("document = 'd3'"))
    plans = {}

    def keep(name, rows):
        plans[name] = rows._jdf.queryExecution().optimizedPlan().toString()
        rows.write.parquet(f"{tmp_path}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{tmp_path}/{name}")

    lazy, kept = ingest.ingested(docs, HashingEmbedder(8)), ingest.ingested(docs, HashingEmbedder(8), keep=keep)
    show = lambda df: sorted(str([r[c] for c in sorted(df.columns)]) for r in df.collect())
    for name in ("chunks", "identifiers", "anchors", "edges", "vectors", "claims", "generations"):
        assert show(getattr(lazy, name)) == show(getattr(kept, name)) and show(getattr(kept, name)), name
    assert "Join" not in plans["chunks"] and "MapInArrow" not in plans["generations"] + plans["identifiers"] + plans["edges"]


def test_rules_begin_with_their_phrases():
    begins = {name: chunking._begins(rule) for name, _, rule in chunking.UNIT_RULES}
    assert "is" not in {b for listed in begins.values() for b in listed} and all(b for listed in begins.values() for b in listed)
    assert chunking.marks("this is plain and has an age") == 0
