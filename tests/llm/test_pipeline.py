"""The whole pipeline against a brute-force version of its stages, at two sizes."""

import hashlib
import random

import pytest

from galena.llm import toxicity
from galena.llm.queries import tokenizer_path
from tests.llm.test_operators import prose, repeated_words

ITEM = "A farmer packs 12 crates of plums and 30 crates of pears, then sells 7 crates at the market. How many crates are left at the end of the day?"


def tables(spark, folder, n):
    r = random.Random(n)
    shared = prose(70, 999)
    rows, labels = [], []
    for i in range(n):
        text = prose(r.randint(60, 120), 5000 + i)
        if i % 5 == 0:
            text += " you stupidfool are a nastyclown, you rottenscum."
        elif i % 7 == 1:
            text += "\n" + shared + " " + prose(40, 9000 + i)
        elif i % 11 == 2:
            text = prose(30, 7000 + i) + " " + ITEM + " " + prose(30, 8000 + i)
        elif i % 13 == 3:
            text = rows[i - 1][1]
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int("stupidfool" in text)))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "s", 0), (n + 2, "one two", "en", "s", 7), (n + 3, prose(30000, 77), "en", "s", None)]
    rows += [rows[8], rows[8], rows[9], rows[-1]]  # documents that arrive more than once
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return {i: t for i, t, *_ in rows}


@pytest.mark.parametrize("n", [120, 360])
def test_pipeline(spark, tmp_path, n):
    pipeline = pytest.importorskip("corpus_pipeline")
    import public_tokenizers as P
    import tiktoken

    from galena.llm import bpe

    texts = tables(spark, str(tmp_path), n)
    folder = f"file://{tmp_path}"
    scores = toxicity.toxicity(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    left = {r["doc_id"]: texts[r["doc_id"]] for r in scores.filter("predicted = 0").collect()}
    assert not any("stupidfool" in (t or "") for t in left.values()) and len(left) > 0.7 * n
    sets = {}
    for i, t in sorted(left.items()):
        w = (t or "").lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])
    group = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {i: new if g == old else g for i, g in group.items()}
    left = {i: t for i, t in left.items() if group[i] == i}
    repeated = repeated_words(list(left.items()), 50)
    words = {i: [x for k, x in enumerate(w) if k not in gone] for i, (w, gone) in repeated.items()}
    words = {i: w for i, w in words.items() if "plums" not in " ".join(w)}
    vocabulary = bpe.vocabulary(bpe.read_ranks(tokenizer_path()))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    made = pipeline.run(spark, folder).collect()
    out = {r["doc_id"]: r for r in made}
    assert set(out) == set(words) and len(made) == len(out) and {8, 9} <= set(out)
    for i, w in words.items():
        text = library.decode(bpe.unpacked(out[i]["ids"]))
        assert text.split() == w and out[i]["n_tokens"] == len(library.encode_ordinary(text))
        assert out[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        if len(w) == len(repeated[i][0]):
            assert text == (texts[i] or "")


def test_pipeline_on_empty_tables(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, f"file://{tmp_path}").collect() == []
