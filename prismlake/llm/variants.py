"""Spelling variants by anagram hashing.

Words are letter runs, counted over all documents. A word's anagram key is the
sum of its letters' fifth powers, so words of the same letters share a key and
one changed letter changes it by a known value: a removed letter takes its
power away, an added one adds it, an exchange does both. Each word gives its
own key and, for each of its distinct letters, the key without that letter;
two words whose keys differ by one addition, removal or exchange share one of
these integers. Keys that one row alone has are dropped by a count of integers;
for the others letter order is verified: the letter is taken out at each of its
places, and what is left, with the place, must be equal. Such a group holds at
most one word for each letter of the alphabet, so near words are counted and
the most frequent one is found without making pairs, and neither a hot key nor
a large vocabulary brings an unbounded group into one task.

Sums wrap at 64 bits and keys may collide; letter order decides. What is left
of a word of more than WHOLE letters is compared by its SHA-256.

Defined results: null and empty texts have no words; a null id counts as an
empty one in the corruption test; rows that repeat count again; texts and
words of any length are read whole; an empty table gives an empty result. Only
the id and text columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: One run of so many loses a letter (the deterministic corruption of the contract); None: none does.
CORRUPT = 97
LEAST_LETTERS = 5
LEAST_COUNT = 3
RATIO = 2
#: Words that a task counts before it hands its counts on.
KEEP = 400_000
SALTS = 8
WHOLE = 64
POWER = np.arange(256, dtype=np.int64) ** 5


def words_of(text: str, prefix: str, corrupt: int | None = CORRUPT) -> Counter:
    """Counts of a text's letter runs with A-Z lower-cased; chosen runs lose one letter."""
    found = Counter(RUN.findall(text.encode().lower().decode()))
    if corrupt is None:
        return found
    start, out = zlib.crc32(prefix.encode()), Counter()
    for w, n in found.items():
        h = zlib.crc32(w.encode(), start)
        if h % corrupt == 0:
            at = h % len(w)
            w = w[:at] + w[at + 1 :]
        out[w] += n
    return out


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", corrupt: int | None = CORRUPT) -> DataFrame:
    """(word, n): words of LEAST_LETTERS letters and LEAST_COUNT occurrences."""

    def run(batches):
        total: Counter = Counter()
        frame = lambda: pd.DataFrame({"word": list(total), "n": np.fromiter(total.values(), np.int64, len(total))})
        for pdf in batches:
            for prefix, text in zip(pdf["prefix"], pdf["text"], strict=True):
                for w, n in words_of(text, prefix, corrupt).items():
                    if len(w) >= LEAST_LETTERS:
                        total[w] += n
                if len(total) > KEEP:
                    yield frame()
                    total.clear()
        if total:
            yield frame()

    prefix = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"))
    given = docs.select(prefix.alias("prefix"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    return given.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def anagram_keys(words: DataFrame) -> DataFrame:
    """(word, n, key, size, letter): a word's own key, letter empty, and its keys without one of its letters."""

    def run(batches):
        for pdf in batches:
            rows, keys, sizes, letters = [], [], [], []
            for i, w in enumerate(pdf["word"]):
                codes = np.frombuffer(w.encode("latin-1"), np.uint8)
                key = POWER[codes].sum()
                distinct = np.unique(codes)
                rows += [i] * (len(distinct) + 1)
                keys += [np.array([key]), key - POWER[distinct]]
                sizes += [len(w), *[len(w) - 1] * len(distinct)]
                letters += ["", *distinct.tobytes().decode("latin-1")]
            if rows:
                yield pd.DataFrame({"word": pdf["word"].to_numpy()[rows], "n": pdf["n"].to_numpy()[rows], "key": np.concatenate(keys), "size": sizes, "letter": letters})

    return words.select("word", "n").mapInPandas(run, "word string, n long, key long, size int, letter string")


def _candidates(keys: DataFrame) -> DataFrame:
    """Rows whose key another row has; keys are dealt out SALTS times, so a hot one is no single task."""
    shared = keys.groupBy("key", "size").agg(F.count("*").alias("rows")).where("rows > 1").select("key", "size")
    salted = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return keys.withColumn("salt", F.pmod(F.hash("word"), F.lit(SALTS))).join(salted, ["key", "size", "salt"]).drop("salt")


def _ordered(rows: DataFrame) -> DataFrame:
    """(key, rest, place, word, n): what is left when the row's letter is taken out at each of its places; place -1: the word itself."""
    places = F.when(F.col("letter") == "", F.array(F.lit(-1))).otherwise(F.filter(F.sequence(F.lit(0), F.col("size")), lambda i: F.col("word").substr(i + 1, F.lit(1)) == F.col("letter")))
    at = rows.select("key", "word", "n", "size", F.explode(places).alias("place"))
    rest = F.when(F.col("place") < 0, F.col("word")).otherwise(F.concat(F.col("word").substr(F.lit(1), F.col("place")), F.col("word").substr(F.col("place") + 2, F.col("size"))))
    return at.withColumn("rest", rest).select("key", F.when(F.col("size") > WHOLE, F.sha2("rest", 256)).otherwise(F.col("rest")).alias("rest"), "place", "word", "n")


def _near(ordered: DataFrame) -> DataFrame:
    """(word, near, best): parts of a word's count of near words, and the best of that part as (-n, word)."""
    dealt = ordered.repartition("key", "rest")
    me = F.struct((-F.col("n")).alias("n"), F.col("word"))
    group = Window.partitionBy("key", "rest")
    place = Window.partitionBy("key", "rest", "place")
    # of equal letters in a row the first one stands for all: taking out any of them leaves the same
    dealt = dealt.withColumn("first", (F.col("place") >= 0) & (F.row_number().over(Window.partitionBy("key", "rest", "word").orderBy("place")) == 1))
    dealt = dealt.withColumns(
        {
            "base": F.max(F.when(F.col("place") < 0, me)).over(group),
            "longer": F.sum(F.col("first").cast("long")).over(group),
            "longest": F.min(F.when(F.col("first"), me)).over(group),
            "beside": F.count("*").over(place) - 1,
            "most": F.min(me).over(place),
            "next": F.lead(me).over(place.orderBy(-F.col("n"), "word")),
        }
    )
    exchanged = F.when(F.col("most.word") == F.col("word"), F.col("next")).otherwise(F.col("most"))
    removed = F.when(F.col("first"), F.col("base"))
    own = F.col("place") < 0
    near = F.when(own, F.col("longer")).otherwise(F.col("beside") + removed.isNotNull().cast("long"))
    return dealt.select("word", near.alias("near"), F.when(own, F.col("longest")).otherwise(F.least(exchanged, removed)).alias("best")).where("near > 0")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): pointers doubled until none moves. A form is at least RATIO times as frequent, so chains are short and end."""
    table = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = table.select(F.col("word").alias("root"), F.col("root").alias("to"))
        new = materialise(table.join(onward, "root", "left").select("word", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved")), "roots")
        discard(table)
        if new.where("moved").isEmpty():
            return new.drop("moved")
        table = new.drop("moved")
        table._scratch = new._scratch


def group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", corrupt: int | None = CORRUPT) -> DataFrame:
    """Per word: word, form (its most frequent near word, if frequent enough), root, n, n_near, form_n."""
    words = materialise(vocabulary(docs, id_col, text_col, corrupt), "vocabulary")
    keys = materialise(anagram_keys(words), "anagram-keys")
    parts = _near(_ordered(_candidates(keys)))
    counted = words.withColumns({"near": F.lit(0).cast("long"), "best": F.lit(None).cast("struct<n: long, word: string>")}).unionByName(parts.withColumn("n", F.lit(None).cast("long")))
    found = counted.groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), F.min("best").alias("best"))
    frequent = -F.col("best.n") >= RATIO * F.col("n")
    found = materialise(found.select("word", "n", "n_near", F.when(frequent, F.col("best.word")).alias("form"), F.when(frequent, -F.col("best.n")).alias("form_n")), "near-words")
    roots = _roots(found.where("form is not null"))
    discard(words)
    discard(keys)
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
