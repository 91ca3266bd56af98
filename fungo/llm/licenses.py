"""License notices by exact set-similarity join of text blocks and templates.

A block is a run of consecutive words, whatever the lines are: templates are
put in classes by their number of words, and for a class of up to L words there
is a block of 2 L words at every L-th word, so every run of L words lies whole
in a block. A block matches a template of its class if it holds at least
``threshold`` of the template's distinct words (containment). Words are ordered
by how often they occur in all documents, rare ones first. A block that
matches must hold one of the first ``size - need + 1`` words of the template
(prefix filter), at least ``need`` template words at all (length filter), and
enough words behind the first common one (positional filter); what is left is
verified by intersecting the sets. Templates are a fixed short list, so their
index is broadcast. Base places, where the words of a known phrase stand
consecutively, are found in the word array of documents that hold the word
``license``.

Everything is built-in functions. Null text is empty: no words, no labels,
score 0. Rows with equal ids are judged alike. An empty table gives an empty
result.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fungo.llm.common import ascii_lower, landed, numbered, stored

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 0.9
#: Most words of the templates of each class.
CLASSES = (12, 32)
#: Phrases whose places count, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Customary notices of public licences.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at "
               "http www apache org licenses license 2 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
            "license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
            "following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, BREAK), "")


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def ordered(texts: DataFrame, vocabulary: list[str]) -> list[str]:
    """The template words, rare ones in the corpus first. One row per template word comes back."""
    found = {r.w: r.n for r in texts.select(F.explode(words(F.col("text"))).alias("w"))
             .where(F.col("w").isin(vocabulary)).groupBy("w").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (found.get(w, 0), w))


def places(own: Column) -> Column:
    """(word, label) of each place of a phrase in an array of words."""
    def stands(parts: list[str]):
        return lambda i: reduce(and_, (F.get(own, i + k) == p for k, p in enumerate(parts)))

    def named(label: str):
        return lambda i: F.struct(i.cast("long").alias("word"), F.lit(label).alias("label"))
    starts = F.sequence(F.lit(0), F.size(own) - 1)
    return F.concat(*(F.transform(F.filter(starts, stands(phrase.split())), named(label)) for phrase, label in PHRASES))


def class_of(template: str) -> int:
    return next(i for i, most in enumerate(CLASSES) if len(template.split()) <= most)


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """row_id, doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score, one row per row of docs."""
    spark = docs.sparkSession
    texts = numbered(landed(docs).select("doc_id", ascii_lower(F.coalesce("text", F.lit(""))).alias("text")))
    sets = [sorted(set(t.split())) for _, t in TEMPLATES]
    vocabulary = ordered(texts, sorted(set().union(*sets)))
    rank = {w: i for i, w in enumerate(vocabulary)}
    index = []
    for no, ((label, text), own) in enumerate(zip(TEMPLATES, sets)):
        own = sorted(own, key=rank.__getitem__)
        need = math.ceil(threshold * len(own) - 1e-9)
        index += [(word, no, label, i, need, own, class_of(text)) for i, word in enumerate(own[: len(own) - need + 1])]
    prefix = strings(sorted({row[0] for row in index}))

    def of_class(k: int) -> Column:
        """The template words of each block of a class, rare ones first; blocks without a prefix word of the class are left out."""
        own, first = strings(vocabulary), strings(sorted({row[0] for row in index if row[6] == k}))
        held = F.transform(F.sequence(F.lit(1), F.size("words"), F.lit(CLASSES[k])),
                           lambda i: F.array_intersect(own, F.slice("words", i, 2 * CLASSES[k])))
        return F.transform(F.filter(held, lambda b: F.arrays_overlap(b, first)), lambda b: F.struct(F.lit(k).alias("class"), b.alias("held")))

    blocks = F.concat(*map(of_class, range(len(CLASSES))))
    none = F.array().cast("array<struct<word: bigint, label: string>>")
    base = stored(
        texts.withColumn("words", words(F.col("text"))).select(
            "row_id", "doc_id", F.size("words").cast("long").alias("n_words"),
            F.when(F.array_contains("words", "license"), places(F.col("words"))).otherwise(none).alias("places"),
            F.when(F.arrays_overlap("words", prefix), blocks).alias("blocks")))

    templates = spark.range(1).select(F.explode(F.array(*(
        F.struct(F.lit(w).alias("word"), F.lit(no).alias("template"), F.lit(label).alias("label"), F.lit(i).alias("i"),
                 F.lit(need).alias("need"), strings(own).alias("own"), F.lit(k).alias("class"))
        for w, no, label, i, need, own, k in index))).alias("t")).select("t.*")
    candidates = (
        base.select("row_id", F.explode("blocks").alias("b")).select("row_id", "b.*")
        .select("row_id", "class", "held", F.posexplode("held").alias("j", "word"))
        .join(F.broadcast(templates), ["class", "word"])
        .where("size(held) >= need and 1 + least(size(own) - i, size(held) - j) - 1 >= need"))
    matched = (candidates.withColumn("score", F.size(F.array_intersect("held", "own")) / F.size("own"))
               .where(F.size(F.array_intersect("held", "own")) >= F.col("need"))
               .groupBy("row_id").agg(F.collect_set("label").alias("found"), F.max("score").alias("best")))
    own_labels = F.array_distinct(F.col("places.label"))
    return base.join(matched, "row_id", "left").select(
        "row_id", "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"), F.array_max("places.word").alias("last_word"),
        F.array_join(F.array_sort(own_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(own_labels, F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))


def sql() -> str:
    """The same rows by comparing each block with each template."""
    listed = ", ".join("({}, [{}], '{}', {})".format(no, ", ".join(f"'{w}'" for w in sorted(set(t.split()))), label, CLASSES[class_of(t)])
                       for no, (label, t) in enumerate(TEMPLATES))
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    stands = " union all ".join(
        "select doc_id, i, '{}' as label from n, range(len(w)) as r(i) where {}".format(
            label, " and ".join(f"w[i + {k + 1}] = '{p}'" for k, p in enumerate(phrase.split()))) for phrase, label in PHRASES)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
with n as (select doc_id, translate(coalesce(text, ''), '{upper}', '{lower}') as t, regexp_extract_all(t, '{word}') as w from documents),
p as ({stands}),
b as (select doc_id, count(*) as n_base, min(i) as first_word, max(i) as last_word,
             string_agg(distinct label, ',' order by label) as base_labels from p group by doc_id),
k as (select doc_id, w, own, label, most from n, (values {listed}) as v(no, own, label, most)
      where len(list_intersect(list_distinct(w), own)) >= {THRESHOLD} * len(own) - 1e-9),
h as (select doc_id, own, label, list_distinct(w[i + 1:i + 2 * most]) as ws from k, range(0, len(w), most) as r(i)),
m as (select doc_id, label, len(list_intersect(ws, own)) / len(own) as c from h
      where len(list_intersect(ws, own)) >= {THRESHOLD} * len(own) - 1e-9),
f as (select doc_id, max(c) as best from m group by doc_id),
a as (select doc_id, string_agg(distinct label, ',' order by label) as labels
      from (select doc_id, label from m union all select doc_id, label from p) group by doc_id)
select doc_id, len(w)::bigint as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels,
       coalesce(labels, '') as labels, case when n_base > 0 then 1.0::double else coalesce(best, 0.0)::double end as score
from n left join b using (doc_id) left join f using (doc_id) left join a using (doc_id)"""
