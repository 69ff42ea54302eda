"""MinHash near-dedup with SetSketch registers.

A document's set of word shingles is summed up in registers: exponentially
spaced, truncated minima (the larger register is that of the union, so sketches
merge), whose values agree with a probability near the Jaccard similarity.
Bands of register values give candidates; similarity is estimated jointly by
likelihood from the registers that are larger, smaller and equal; what the
estimate leaves is verified on the full sets (as 64-bit hashes of shingles).
The pairs of a bucket are never made: each member is compared with one pivot
first, with the pivots of its other buckets only where these are not in its
component yet, and members that a pivot is not linked with are compared
further by the few shingles in which they differ from it, in blocks (a family
of size g with u of them takes u * g / BLOCK comparisons of one row with a
block). Documents of equal sets form a class, of which one takes part in the
search.

BANDS x ROWS registers miss a pair of similarity 0.8 with a probability of
(1 - 0.8**ROWS)**BANDS = 3e-6; a pivot's pair whose estimate lies below the
threshold less MARGIN (six standard errors) is not linked.

Defined results: documents without words have an empty set and stay alone;
rows that repeat are in one class; rows of one id and several texts are
documents of their own; a row with a null id is linked like any other, but its
id is never the smallest of a component (null if all are null); an empty table
gives an empty result. Only the id and text columns are read, so extra columns
cannot clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linking
from .common import discard, fresh, materialise

BANDS = 32
ROWS = 5
REGISTERS = BANDS * ROWS
#: Base of the spacing; with 16-bit registers it spans every set size.
BASE = 1.001
RATE = 20.0
LIMIT = 65534
MARGIN = 0.2
#: Members of a family that one task compares at once.
BLOCK = 2048
THRESHOLD = 80  # percent

_rng = np.random.default_rng(20240607)
_MULTIPLY = (_rng.integers(0, 2**63, REGISTERS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _rng.integers(0, 2**63, REGISTERS, dtype=np.uint64)
_PLACE = (_rng.integers(0, 2**63, 16, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def word_list(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased."""
    return (text or "").encode().lower().split()


def shingle_set(text: str | None, width: int) -> set[tuple[bytes, ...]]:
    """The distinct shingles; of fewer words the whole sequence; of none the empty set."""
    words = word_list(text)
    if not words:
        return set()
    if len(words) < width:
        return {tuple(words)}
    return set(zip(*(words[i:] for i in range(width)), strict=False))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Hasher:
    """64-bit hashes of a text's distinct shingles, sorted; words are hashed once per worker batch."""

    def __init__(self, width: int, keep: int = 500_000):
        self.width, self.keep, self.known = width, keep, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = word_list(text)
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > self.keep:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(self.width, len(h))
        n = len(h) - k + 1
        out = np.full(n, k, np.uint64)
        for i in range(k):
            out += h[i : i + n] * _PLACE[i]
        return np.unique(mixed(out))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers of a non-empty set: floor(1 - log_b of the least exponential variate), within 0..LIMIT."""
    low = np.full(REGISTERS, np.uint64(2**64 - 1))
    for at in range(0, len(hashes), 1024):
        h = hashes[None, at : at + 1024]
        low = np.minimum(low, (h * _MULTIPLY[:, None] + _ADD[:, None]).min(1))
    variate = -np.log1p(-(low.astype(float) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(variate) / np.log(BASE)) + 32000, 0, LIMIT).astype("<u2")


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def estimate(larger: np.ndarray, smaller: np.ndarray, na: np.ndarray, nb: np.ndarray, grid: int = 101) -> np.ndarray:
    """Similarity of greatest likelihood, by numbers of larger and smaller registers and the set sizes."""
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, grid)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: np.maximum(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-12)
    more, less = p(u - v * j), p(v - u * j)
    equal = (REGISTERS - larger - smaller)[:, None]
    score = larger[:, None] * np.log(more) + smaller[:, None] * np.log(less) + equal * np.log(np.maximum(1 - more - less, 1e-12))
    return j[np.arange(len(j)), score.argmax(1)]


def _given(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.struct(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("version")).alias("at"), text.alias("text"))


def sketched(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: at (id, version), n (set size), class (two longs; null for an empty set) and registers."""

    def run(batches):
        hasher = Hasher(width)
        for pdf in batches:
            out = []
            for key, unknown, version, text in zip(pdf["id"], pdf["unknown"], pdf["version"], pdf["text"], strict=True):
                h = hasher(text)
                if len(h):
                    d = xxhash.xxh3_128_digest(h.tobytes())
                    out.append((key, unknown, version, len(h), int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), sketch(h).tobytes()))
                else:
                    out.append((key, unknown, version, 0, None, None, None))
            yield pd.DataFrame(out, columns=["id", "unknown", "version", "n", "c1", "c2", "registers"]).astype({"id": "int64", "unknown": bool, "version": "int64", "n": "int64", "c1": "Int64", "c2": "Int64", "registers": object})

    # ids travel without nulls, which would make them floating-point numbers
    given = _given(docs, id_col, text_col).select(F.coalesce("at.id", F.lit(0).cast("long")).alias("id"), F.col("at.id").isNull().alias("unknown"), "at.version", "text")
    found = given.mapInPandas(run, "id long, unknown boolean, version long, n long, c1 long, c2 long, registers binary")
    return found.select(F.struct(F.when(~F.col("unknown"), F.col("id")).alias("id"), "version").alias("at"), "n", "c1", "c2", "registers")


def banded(classes: DataFrame) -> DataFrame:
    """(key, id) for each band of each sketch."""

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            r = np.frombuffer(b"".join(pdf["registers"]), "<u2").reshape(-1, BANDS, ROWS).astype(np.uint64)
            h = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(pdf), 1))
            for i in range(ROWS):
                h = mixed(h * _PLACE[7] + r[:, :, i])
            yield pd.DataFrame({"key": h.view(np.int64).ravel(), "id": np.repeat(pdf["id"].to_numpy(), BANDS)})

    return classes.select("id", "registers").mapInPandas(run, "key long, id long")


def _starred(pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Each member against its family's pivot: pivot, id, n, linked and diff, the hashes that only one of the two sets has.

    A link takes both: a joint estimate no more than MARGIN below the
    threshold, then the full sets.
    """

    def run(batches):
        hasher, last, have = Hasher(width), None, None
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.frombuffer(b"".join(pdf["rp"]), "<u2").reshape(-1, REGISTERS)
            y = np.frombuffer(b"".join(pdf["rx"]), "<u2").reshape(-1, REGISTERS)
            likely = estimate((x > y).sum(1), (x < y).sum(1), pdf["np"].to_numpy(float), pdf["nx"].to_numpy(float)) >= percent / 100 - MARGIN
            out = []
            for pivot, key, tp, tx, maybe in zip(pdf["pivot"], pdf["id"], pdf["tp"], pdf["tx"], likely, strict=True):
                if pivot != last:
                    last, have = pivot, hasher(tp)
                other = hasher(tx)
                diff = np.setxor1d(have, other, assume_unique=True)
                total = len(have) + len(other)
                out.append((pivot, key, len(other), bool(maybe and 100 * (total - len(diff)) >= percent * (total + len(diff))), diff.tobytes()))
            yield pd.DataFrame(out, columns=["pivot", "id", "n", "linked", "diff"])

    return pairs.mapInPandas(run, "pivot long, id long, n long, linked boolean, diff binary")


class Block:
    """Up to BLOCK members of a family, indexed by the hashes in which they differ from its pivot."""

    def __init__(self, ids, sizes, diffs, linked):
        self.ids, self.sizes = np.array(ids), np.array(sizes)
        self.lengths = np.array([len(d) for d in diffs])
        owner = np.repeat(np.arange(len(ids)), self.lengths)
        element = np.concatenate(diffs)
        by = np.argsort(element, kind="stable")
        self.element, self.owner = element[by], owner[by]
        self.at = {k: i for i, k in enumerate(ids)}
        # members linked with the pivot are joined already
        core = next((i for i, x in enumerate(linked) if x), None)
        self.up = [core if x else i for i, x in enumerate(linked)]

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def links(self, key: int, size: int, diff: np.ndarray, percent: int) -> list[tuple[int, int]]:
        """Links of an outer member: one to each part of the block that it joins."""
        lo, hi = np.searchsorted(self.element, diff, "left"), np.searchsorted(self.element, diff, "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        common = np.bincount(self.owner[at], minlength=len(self.ids))
        total = self.sizes + size
        apart = self.lengths + len(diff) - 2 * common
        hits = np.flatnonzero((100 * (total - apart) >= percent * (total + apart)) & (self.ids != key))
        own = self.root(self.at[key]) if key in self.at else None
        out = []
        for i in hits.tolist():
            r = self.root(i)
            if r != own:
                out.append((key, int(self.ids[i])))
                if own is None:
                    own = r
                else:
                    self.up[r] = own
        return out


def _compared(members: DataFrame, percent: int) -> DataFrame:
    """Links among members of one family that its pivot leaves apart.

    Members that the pivot is not linked with are compared with all members,
    block by block; a block has at most about BLOCK members, whatever the
    family's size, and gives at most a spanning forest of links.
    """
    sizes = members.groupBy("pivot").agg(F.count("*").alias("g"), F.sum(F.col("linked").cast("int")).alias("l")).where("g > 1 and l < g")
    sizes = materialise(sizes.select("pivot", F.ceil(F.col("g") / BLOCK).cast("int").alias("blocks")), "families")
    open_ = members.join(sizes, "pivot")
    own = open_.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("outer", F.lit(False))
    outer = open_.where("not linked").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("outer", F.lit(True))

    def run(batches):
        block, here, parts = None, None, None
        for pdf in batches:
            out = []
            for pivot, b, outer, key, n, linked, diff in zip(*(pdf[c] for c in ("pivot", "block", "outer", "id", "n", "linked", "diff")), strict=True):
                if (pivot, b) != here:
                    here, block, parts = (pivot, b), None, ([], [], [], [])
                d = np.frombuffer(diff, "<u8")
                if not outer:
                    for x, v in zip(parts, (key, n, d, linked), strict=True):
                        x.append(v)
                elif parts[0]:
                    block = block or Block(*parts)
                    out += block.links(key, n, d, percent)
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])

    dealt = own.unionByName(outer).select("pivot", "block", "outer", "id", "n", "linked", "diff").repartition("pivot", "block")
    return dealt.sortWithinPartitions("pivot", "block", "outer", "id").mapInPandas(run, "a long, b long")


def _labelled(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: at (id, version), n and label, that of its component (null for an empty set)."""
    rows = materialise(sketched(docs, width, id_col, text_col), "sketches")
    # one row for each class of equal sets, named by its hash: the smallest of its documents
    classes = rows.where("n > 0").groupBy("c1", "c2").agg(F.min("at").alias("at"), F.first("n").alias("n"), F.first("registers").alias("registers")).withColumn("id", F.col("c1"))
    classes = materialise(classes, "classes")
    # the smallest name of each bucket is its pivot; whoever shares a bucket is in one family with its pivot
    bands = materialise(banded(classes), "bands")
    pivots = materialise(bands.groupBy("key").agg(F.min("id").alias("pivot"), F.count("*").alias("rows")).where("rows > 1").drop("rows"), "pivots")
    family = materialise(bands.join(pivots, "key").where("id <> pivot").select("pivot", "id").distinct(), "family")
    ids = materialise(family.select("id").union(family.select("pivot")).distinct(), "ids")
    n = ids.count()
    known = linking.with_ids(classes, ids, "id", rows=n)
    spots = known.select("at", "id")
    text = _given(docs, id_col, text_col).join(F.broadcast(spots) if n <= linking.BROADCAST_ROWS // 3 else spots, "at").dropDuplicates(["id"]).select("id", "text")
    involved = materialise(text.join(known.select("id", "n", "registers"), "id"), "involved")
    side = lambda c, k: involved.select(F.col("id").alias(k), F.col("n").alias(f"n{c}"), F.col("registers").alias(f"r{c}"), F.col("text").alias(f"t{c}"))
    star = lambda pairs: _starred(pairs.join(side("x", "id"), "id").join(side("p", "pivot"), "pivot"), width, percent)
    # each member with one pivot first; then only families that are not in one component
    first = materialise(star(family.groupBy("id").agg(F.min("pivot").alias("pivot"))), "members")
    joined = lambda df: df.where("linked").select(F.col("pivot").alias("a"), F.col("id").alias("b"))
    labels = materialise(linking.connected_components(joined(first)), "near-labels")
    name = lambda k: labels.select(F.col("id").alias(k), F.col("component").alias(f"c{k}"))
    parts = family.join(name("id"), "id", "left").join(name("pivot"), "pivot", "left").where(F.coalesce("cid", "id") != F.coalesce("cpivot", "pivot"))
    open_ = materialise(parts.select("pivot").distinct(), "open-families")
    left = family.join(open_, "pivot", "left_semi").join(first.select("pivot", "id"), ["pivot", "id"], "left_anti")
    members = materialise(star(left).unionByName(first.join(open_, "pivot", "left_semi")), "members")
    links = materialise(joined(first).union(joined(members)).union(_compared(members, percent)).distinct(), "near-links")
    names = materialise(linking.connected_components(links), "near-components")
    labelled = rows.select("at", "n", F.col("c1").alias("id")).join(names, "id", "left").select("at", "n", F.coalesce("component", "id").alias("label"))
    labelled = materialise(labelled, "labelled")
    for t in (rows, classes, bands, pivots, family, ids, involved, first, labels, open_, members, links, names):
        discard(t)
    return labelled


def components(docs: DataFrame, width: int = 5, percent: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable)."""
    rows = _labelled(docs, width, percent, id_col, text_col)
    least = materialise(rows.where("label is not null").groupBy("label").agg(F.min("at.id").alias("least"), F.count("*").alias("rows")).where("rows > 1").drop("rows"), "near-least")
    n = least.count()
    found = rows.join(F.broadcast(least) if n <= linking.BROADCAST_ROWS // 3 else least, "label", "left")
    return found.select("at.id", F.col("n").alias("n_shingles"), F.coalesce("least", "at.id").alias("component_id"))


def filter_documents(docs: DataFrame, width: int = 5, percent: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, that of the smallest id (a null id is the least), with all its columns; of rows that repeat, one."""
    rows = _labelled(docs, width, percent, id_col, text_col)
    stays = rows.where("label is not null").groupBy("label").agg(F.min("at").alias("stays"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    gone = materialise(rows.join(stays, "label").where("at <> stays").select("at").distinct(), "near-copies")
    again = materialise(rows.groupBy("at").agg(F.count("*").alias("rows")).where("rows > 1").select("at"), "repeated-rows")
    key = fresh(docs, "at")
    keyed = docs.withColumn(key, F.struct(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("version")))
    name = lambda df: df.withColumnRenamed("at", key)
    kept = linking.with_ids(keyed, name(gone), key, "left_anti")
    if again.isEmpty():
        return kept.drop(key)
    return linking.with_ids(kept, name(again), key, "left_anti").unionByName(linking.with_ids(kept, name(again), key).dropDuplicates([key])).drop(key)
