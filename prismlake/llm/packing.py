"""Packing: shortest-pack-first over the length histogram.

Token sequences are cut into full pieces and a remainder; only the histogram
of piece lengths (at most ``size`` entries) reaches the driver, where lengths
are placed longest first and packing-pattern counts are updated. Patterns are
then joined back to the pieces by their rank within their length.

Defined results: a null or empty text is the end token alone; rows that repeat
are packed each on their own, also those with a null id, which stays null; an
empty table gives no piece. Only the id and
text columns are read, so extra columns cannot clash.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, partitions

SIZE = 2048
END = 1
VOCABULARY = "byte_bpe_50k"
#: Ranks within a length are counted in blocks of about this many pieces.
BLOCK_ROWS = 200_000


class Encoder:
    """Ids of the public byte-level vocabulary.

    Texts within Latin-1 go through the rank table of the same vocabulary,
    which gives the same ids four times as fast; all others, and those that
    hold one of the file's added tokens, go through the tokenizer file itself,
    whose character classes may be of another Unicode version there.
    """

    def __init__(self, folder: str | None = None, name: str = VOCABULARY):
        import base64
        import os

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        at = (lambda f: os.path.join(folder, f)) if folder else public_tokenizers.path
        with open(at(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(at(f"{name}.json"))
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]

    def _plain(self, text: str) -> bool:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return not any(t in text for t in self.added)

    def ids(self, text: str) -> np.ndarray:
        if self._plain(text):
            ids = self.fast.encode_ordinary(text)
        else:
            ids = self.whole.encode(text, add_special_tokens=False).ids
        return np.array([*ids, END], "<u4")


_encoders: dict = {}


def encoder(folder: str | None = None) -> Encoder:
    """One per Python worker."""
    if folder not in _encoders:
        _encoders[folder] = Encoder(folder)
    return _encoders[folder]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, folder: str | None = None) -> DataFrame:
    """Tokenise whole texts and cut them: full pieces, then the remainder."""

    def cut(batches):
        enc = encoder(folder)
        for pdf in batches:
            out = []
            for key, known, text in zip(pdf["doc_id"], pdf["known"], pdf["text"], strict=True):
                ids = enc.ids(text or "")
                out += [(key, known, s, len(p), zlib.crc32(p.tobytes()), len(ids)) for s in range(0, len(ids), size) for p in (ids[s : s + size],)]
            yield pd.DataFrame(out, columns=["doc_id", "known", "start", "length", "ids_crc32", "doc_tokens"]).astype("int64")

    # ids travel without nulls, which would make them floating-point numbers
    key = F.col(id_col).cast("long")
    given = docs.select(F.coalesce(key, F.lit(0).cast("long")).alias("doc_id"), key.isNotNull().alias("known"), F.col(text_col).cast("string").alias("text"))
    return given.mapInPandas(cut, "doc_id long, known long, start long, length long, ids_crc32 long, doc_tokens long")


def shortest_pack_first(histogram: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns and their counts: (lengths longest first, how many such packs).

    Lengths go longest first; each group of equal pieces joins the shortest
    open packs, which are those with the most room, split where counts differ.
    """
    open_packs: dict[int, list] = defaultdict(list)  # room -> [pattern, count]
    rooms: list[int] = []  # sorted
    done = []

    def put(pattern: tuple, count: int, room: int) -> None:
        if room == 0:
            done.append((pattern, count))
            return
        if not open_packs[room]:
            bisect.insort(rooms, room)
        open_packs[room].append([pattern, count])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if rooms and rooms[-1] >= length:
                room = rooms[-1]
                pattern, count = open_packs[room].pop()
                if not open_packs[room]:
                    rooms.pop()
                take = min(left, count)
                if take < count:
                    put(pattern, count - take, room)
                put((*pattern, length), take, room - length)
            else:
                take = left
                put((length,), take, size - length)
            left -= take
    for packs in open_packs.values():
        done += [(p, c) for p, c in packs]
    return sorted(done, key=lambda x: (x[0], x[1]), reverse=True)


def places(patterns: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """Where the pieces of each length go: from rank ``low`` on, into sequences from ``first`` on at ``offset``."""
    used: dict[int, int] = defaultdict(int)
    first, rows = 0, []
    for pattern, count in patterns:
        at = 0
        for length in pattern:
            rows.append((length, used[length], first, at))
            used[length] += count
            at += length
        first += count
    return pd.DataFrame(rows, columns=["length", "low", "first", "offset"]).astype("int64").sort_values(["length", "low"], ignore_index=True)


def ranked(cut: DataFrame) -> DataFrame:
    """Ranks within each length, counted in blocks so that one frequent length is no single task."""
    n = cut.count()
    blocks = max(partitions(cut.sparkSession), n // BLOCK_ROWS)
    cut = cut.withColumn("block", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(blocks)).cast("int"))
    counts = cut.groupBy("length", "block").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "block", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "block").orderBy("doc_id", "start", "ids_crc32")
    return cut.withColumn("rank", F.row_number().over(within) - 1).join(bases, ["length", "block"]).withColumn("rank", F.col("rank") + F.col("base")).drop("block", "base")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, folder: str | None = None) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    cut = materialise(pieces(docs, id_col, text_col, size, folder), "pieces")
    histogram = {r["length"]: r["rows"] for r in cut.groupBy("length").agg(F.count("*").alias("rows")).collect()}  # at most `size` rows
    where = places(shortest_pack_first(histogram, size))
    length, low = where["length"].to_numpy(), where["low"].to_numpy()
    first, offset = where["first"].to_numpy(), where["offset"].to_numpy()

    def place(batches):
        for pdf in batches:
            at = np.empty(len(pdf), int)
            for n, rows in pdf.groupby("length").indices.items():
                a, b = np.searchsorted(length, [n, n + 1])
                at[rows] = a + np.searchsorted(low[a:b], pdf["rank"].to_numpy()[rows], "right") - 1
            yield pdf.assign(sequence_id=first[at] + pdf["rank"].to_numpy() - low[at], offset=offset[at])[[*OUT, "known"]]

    placed = ranked(cut).mapInPandas(place, ", ".join(f"{c} long" for c in [*OUT, "known"]))
    return placed.withColumn("doc_id", F.when(F.col("known") == 1, F.col("doc_id"))).select(*OUT)


OUT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
