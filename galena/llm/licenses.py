"""License scans by diagonal voting.

All rolling word k-grams of a text are joined, by hash, with the positions of the k-grams of
license templates. A hit votes for the diagonal on which text and template run in step;
neighbouring diagonals are merged, and the spans that are left are verified word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from galena.llm.common import stored

# Phrases whose every place counts, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Openings of public license texts, with their labels.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc by"),
)

#: Words of the k-grams of phrases and of templates; diagonals that are merged lie so near; least
#: share of a template's k-grams with votes, and of its words within a span.
SHORT, LONG, NEAR, LEAST_VOTES, LEAST_WORDS = 2, 4, 3, 0.5, 0.6
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of digits, letters a to z and code points from 128 on, after A-Z are lowered. (Other
    letters are lowered too, which moves no word and makes no phrase.)"""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), _BREAK), "")


def _grams(hashed: Column, k: int) -> Column:
    """Places and hashes of all k-grams of hashed words, by rising start."""
    last = F.size(hashed) - k
    grams = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(k), *[F.get(hashed, i + j) for j in range(k)]).alias("h")))
    return F.when(last >= 0, grams).otherwise(F.array().cast("array<struct<at:int,h:long>>"))


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _positions(spark: SparkSession) -> DataFrame:
    """(h, template, at): where each k-gram stands in each template. As small as the fixed lists."""
    rows = [F.struct(F.lit(i).alias("template"), F.split(F.lit(t), " ").alias("words")) for i, (t, _) in enumerate((*PHRASES, *TEMPLATES))]
    listed = spark.range(1).select(F.explode(F.array(*rows)).alias("x")).select("x.template", _hashed(F.col("x.words")).alias("hs"))
    both = F.when(F.col("template") < len(PHRASES), _grams(F.col("hs"), SHORT)).otherwise(_grams(F.col("hs"), LONG))
    return listed.select("template", F.explode(both).alias("g")).select("g.h", "template", "g.at")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, template, first, last, votes): merged diagonals, in words; mark tells texts of one id apart.

    All k-grams are made and joined once, and the few hits are stored. Rows that repeat an id and a
    text give each hit once."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), _hashed(words(F.col(text_col))).alias("hs"))
    grams = rows.select("id", "mark", F.explode(F.concat(_grams(F.col("hs"), SHORT), _grams(F.col("hs"), LONG))).alias("g"))
    met = grams.select("id", "mark", F.col("g.at").alias("pos"), "g.h").join(F.broadcast(_positions(docs.sparkSession)), "h")
    hits = stored(met.select("id", "mark", "template", "pos", "at").distinct(), "hits")
    lines = hits.groupBy("id", "mark", "template", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.count("*").alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("end"))
    phrase = F.col("template") < len(PHRASES)
    exact = lines.filter(phrase).select("id", "mark", "template", "first", F.col("end").alias("last"), "votes")
    by_line = Window.partitionBy("id", "mark", "template").orderBy("diagonal")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by_line) > NEAR, F.lit(False)).cast("int")
    merged = lines.filter(~phrase).withColumn("far", far).withColumn("run", F.sum("far").over(by_line)).groupBy("id", "mark", "template", "run").agg(F.min("first").alias("first"), F.max("end").alias("last"), F.sum("votes").alias("votes"))
    return exact.union(merged.select("id", "mark", "template", "first", "last", "votes"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licenses named in every whole text.

    Returns id_col, n_words, n_base (places of PHRASES), first_word and last_word (their least and
    greatest start; null without any), base_labels and labels (distinct, sorted, comma-joined;
    labels also has those of verified TEMPLATES), score (the greatest share of a template that was
    found, 1 for a phrase, else 0) and found (the verified spans). Null texts count as empty. Rows
    are scanned each, also those that repeat an id or a whole row; other columns are not read. An
    empty table gives an empty table.
    """
    texts = [t.split() for t, _ in (*PHRASES, *TEMPLATES)]
    all_words = F.array(*[F.array(*map(F.lit, t)) for t in texts])
    labels = F.array(*[F.lit(x) for _, x in (*PHRASES, *TEMPLATES)])
    sizes = [len(t) - (SHORT if i < len(PHRASES) else LONG) + 1 for i, t in enumerate(texts)]
    share = F.col("votes") / F.element_at(F.array(*map(F.lit, sizes)), F.col("template") + 1)
    likely = spans(docs, id_col, text_col).withColumn("share", F.least(share, F.lit(1.0))).filter(F.col("share") >= F.when(F.col("template") < len(PHRASES), 1.0).otherwise(LEAST_VOTES))
    listed = likely.groupBy("id", "mark").agg(F.collect_list(F.struct("first", "last", "template", "share")).alias("found"))
    listed = listed.select(F.col("id").alias("i"), F.col("mark").alias("m"), "found")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    # Documents with hits grow with the corpus: the same join at every size, never a broadcast.
    rows = rows.hint("merge").join(listed.hint("merge"), F.col("id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m")), "left").select("id", words(F.col("text")).alias("ws"), "found")

    def right(x: Column) -> Column:
        """Whether the words of a span are those of its template."""
        template = F.element_at(all_words, x["template"] + 1)
        k = F.when(x["template"] < len(PHRASES), F.lit(SHORT)).otherwise(F.lit(LONG))
        there = F.slice(F.col("ws"), x["first"] + 1, x["last"] - x["first"] + k)
        same = F.size(F.array_intersect(there, template)) / F.size(F.array_distinct(template))
        return F.when(x["template"] < len(PHRASES), there == template).otherwise(same >= LEAST_WORDS)

    none = F.array().cast("array<struct<first:int,last:int,template:int,share:double>>")
    found = F.when(F.col("found").isNull(), none).otherwise(F.array_sort(F.filter("found", right)))
    rows = rows.select("id", F.size("ws").cast("long").alias("n_words"), found.alias("found"))
    base = F.transform(F.filter("found", lambda x: x["template"] < len(PHRASES)), lambda x: x)

    def named(of: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda x: F.element_at(labels, x["template"] + 1)))), ",")

    starts = F.transform(base, lambda x: x["first"])
    return rows.select(F.col("id").alias(id_col), "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"), named(base).alias("base_labels"), named(F.col("found")).alias("labels"), F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0)).alias("score"), "found")
