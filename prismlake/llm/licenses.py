"""License scans: a positional index of rare licence words. DataFrame functions only.

One pass over the documents splits the words and keeps, of files that have all
words of some template's mandatory key phrases, the places of the licence
words. Words get their inverse document frequency over all documents; each
template is looked up by the word of its key phrases that has the highest. The
places of that word give the relative positions at which the template may
stand; there its postings are intersected with the places of the file's other
licence words. A template counts where its key phrases stand complete and at
least LEAST of its words are in place.

Every match has all words of the key phrases, so the choice of the word looked
up decides the cost alone: a file's labels do not depend on other files.

Base: places where a phrase's words stand consecutively.

Defined results: null and empty texts have no words, labels or score; rows that
repeat (same id and text) get the same result each; a null id is an id; an empty
table gives an empty result. Only id and text are read, so extra columns cannot
clash. Only A-Z are lower-cased.
"""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: label, notice, mandatory key phrases: fixed values, the standard notices of public licences in words.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        ["permission is hereby granted", "free of charge", "without restriction"],
    ),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "version 2 0"]),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        ["apache license", "except in compliance with the license"],
    ),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["general public license", "version 3"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["general public license", "version 2"]),
    ("gpl", "the terms of the gnu general public license as published by the free software foundation", ["gnu general public license", "free software foundation"]),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        ["free software", "gnu general public license"],
    ),
    ("lgpl", "under the terms of the gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license", ["affero general public license"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc", "4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa", "4 0"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use", "with or without modification"]),
    (
        "bsd",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        ["redistributions of source code must retain", "redistributions in binary form must reproduce"],
    ),
    (
        "bsd-3-clause",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        ["endorse or promote products derived from this software", "specific prior written permission"],
    ),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", ["distribute this software for any purpose"]),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
        ["express or implied warranty", "in no event will the authors be held liable"],
    ),
    ("boost", "distributed under the boost software license version 1 0", ["boost software license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("reserved", "all rights reserved", ["all rights reserved"]),
    ("gpl", "general public license", ["general public license"]),
    ("cc-by", "cc by", ["cc by"]),
]
#: Share of a template's words that must stand in place.
LEAST = 0.6

_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text: maximal runs of ASCII letters and digits and of all other characters beyond ASCII."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SEPARATORS), "")


def needed_places(notice: str, keys: list[str]) -> list[int]:
    """Places in a notice that its key phrases take."""
    own, need = notice.split(), set()
    for key in keys:
        k = key.split()
        at = next(i for i in range(len(own)) if own[i : i + len(k)] == k)
        need |= set(range(at, at + len(k)))
    return sorted(need)


def _all_of(have: str, wanted: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.array_contains(have, w) for w in wanted])


def _places(phrase: list[str]) -> Column:
    """Where a phrase stands in ``words``; the array is searched only if it has all of them."""
    at = lambda i: reduce(lambda a, b: a & b, [F.get("words", i + k) == w for k, w in enumerate(phrase)])
    return F.when(_all_of("here", phrase), F.filter(F.sequence(F.lit(0), F.size("words") - 1), at)).otherwise(F.array().cast("array<int>"))


def vocabulary() -> list[str]:
    return sorted({w for _, notice, _ in TEMPLATES for w in notice.split()})


def scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: doc, version, n_words, the licence words here, places of base phrases, and spots (word, place) of files that may hold a template."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    given = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("version"), words(F.translate(text, _UPPER, _LOWER)).alias("words"))
    known = F.array(*map(F.lit, vocabulary()))
    found = given.select("doc", "version", "words", F.array_intersect("words", known).alias("here"))
    needed = {tuple(sorted({w for key in keys for w in key.split()})) for _, _, keys in TEMPLATES}
    some = reduce(lambda a, b: a | b, [_all_of("here", list(ws)) for ws in sorted(needed)])
    spot = lambda w, i: F.when(F.array_contains(known, w), F.struct(w.alias("word"), i.alias("place")))
    base = [_places(p.split()).alias(f"base{k}") for k, p in enumerate(BASE)]
    spots = F.when(some, F.array_compact(F.transform("words", spot)))
    return materialise(found.select("doc", "version", F.size("words").cast("long").alias("n_words"), "here", *base, spots.alias("spots")), "license-words")


def _tables(spark: SparkSession, idf: dict[str, float]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Looked-up words (word, template, at), postings (word, template, at) and templates (template, label, need, size); the templates bound them."""
    looked, postings, templates = [], [], []
    for t, (label, notice, keys) in enumerate(TEMPLATES):
        own, need = notice.split(), needed_places(notice, keys)
        at = max(need, key=lambda i: (idf[own[i]], -i))
        looked.append((own[at], t, at))
        postings += [(w, t, i) for i, w in enumerate(own)]
        templates.append((t, label, need, len(own)))
    return (
        spark.createDataFrame(looked, "word string, template int, at int"),
        spark.createDataFrame(postings, "word string, template int, at int"),
        spark.createDataFrame(templates, "template int, label string, need array<int>, size int"),
    )


def matches(rows: DataFrame) -> DataFrame:
    """(doc, version, label, share) of the templates that stand in a file."""
    spark = rows.sparkSession
    total = rows.count()
    df = {r["word"]: r["n"] for r in rows.select(F.explode("here").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}  # at most the vocabulary
    idf = {w: log((1 + total) / (1 + df.get(w, 0))) for w in vocabulary()}
    looked, postings, templates = _tables(spark, idf)
    files = rows.where("spots is not null").dropDuplicates(["doc", "version"]).select(F.struct("doc", "version").alias("file"), "spots")
    spots = files.select("file", F.explode("spots").alias("s")).select("file", "s.*")
    shift = (F.col("place") - F.col("at")).alias("shift")
    # where the rarest key word stands, the template may begin
    starts = spots.join(F.broadcast(looked), "word").select("file", "template", shift).groupBy("file").agg(F.collect_set(F.struct("template", "shift")).alias("starts"))
    near = spots.join(F.broadcast(postings), "word").select("file", "template", shift, "at")
    aligned = near.join(starts, "file").where(F.array_contains("starts", F.struct("template", "shift"))).groupBy("file", "template", "shift").agg(F.collect_set("at").alias("got"))
    whole = aligned.join(F.broadcast(templates), "template").where((F.size("got") >= LEAST * F.col("size")) & (F.size(F.array_except("need", "got")) == 0))
    return whole.select("file", "label", F.round(F.size("got") / F.col("size"), 6).alias("share"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rows = scanned(docs, id_col, text_col)
    found = matches(rows).groupBy("file").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    base = [f"base{k}" for k in range(len(BASE))]
    long = lambda c: c.cast("long")
    out = rows.withColumn("file", F.struct("doc", "version")).join(found, "file", "left")
    labels = F.array_compact(F.array(*[F.when(F.size(b) > 0, F.lit(label)) for b, label in zip(base, BASE.values(), strict=True)]))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return out.select(
        F.col("doc").alias(id_col),
        "n_words",
        long(reduce(lambda a, b: a + b, [F.size(b) for b in base])).alias("n_base"),
        long(F.least(*[F.array_min(b) for b in base])).alias("first_word"),
        long(F.greatest(*[F.array_max(b) for b in base])).alias("last_word"),
        joined(labels).alias("base_labels"),
        joined(F.concat(labels, F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size(labels) > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
