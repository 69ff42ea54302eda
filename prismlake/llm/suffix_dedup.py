"""Suffix-array dedup: remove bytes covered by a 50-byte string that starts in an earlier document too.

0. A text equal to that of a smaller document is covered whole; only the first
   of equal texts goes on.
1. Winnowing: every LENGTH-byte window of a document selects one GRAM-byte
   anchor that depends on the window's bytes alone. Equal windows thus select
   equal anchors; anchors seen once in the corpus need no further look. A
   filter of eight bits or more for each shared anchor thins segments out
   before the shuffle (its false positives only cost time). Where it would have
   more than 2 ** MOST_BITS bits, keys go to their range in packs of six bytes
   each, and each document gets the tags of its shared anchors back.
2. The stretch of bytes whose windows select one anchor is a segment. Equal
   segments are counted once, with their smallest document.
3. The distinct segments of an anchor are sorted in shards by induced sorting:
   suffixes are classified, leftmost-smaller substrings sorted recursively, and
   the shard's array induced in linear time; common prefixes, permuted to text
   order, show which windows are equal and hence the smallest document of each.
   An anchor with more than HOT distinct segments (a common passage before
   thousands of continuations) is dealt out by window instead, so that no task
   holds it whole.
4. What lies in windows of smaller documents is joined back and removed.

Defined results: a document with a null id neither loses bytes nor takes any
from others; null and empty texts have no bytes and lose none; texts of
fewer than LENGTH bytes lose none; rows that repeat with one id do not take
from each other; equal texts of larger ids go whole if long enough; an empty
table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

import functools
from contextlib import contextmanager

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, partitions
from .linking import BROADCAST_ROWS, with_ids

LENGTH = 50
GRAM = 20
REACH = LENGTH - GRAM + 1  # grams in a window
LEAST_BITS, MOST_BITS = 20, 28
#: Part of the filter that one row holds, as a power of two of bits.
CHUNK_BITS = 19
#: Text whose keys make one pack; ranges of keys for each shuffle partition, and at most as a power of two; bytes that tell keys of a range apart.
PACK_BYTES = 1 << 24
RANGES, MOST_RANGE_BITS = 4, 16
TAG_BYTES = 5
HOT = 20_000
#: Shards of this size stay in a core's cache while they are sorted.
SHARD_BYTES = 1 << 17
#: Documents are scanned in groups of about this many bytes.
SCAN_BYTES = 1 << 20

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_LOW = np.uint64(0xFFFFFFFF)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _words8(raw: bytes) -> np.ndarray:
    """The 8 bytes from each position on, as numbers."""
    return np.ndarray((max(len(raw) - 7, 0),), "<u8", raw, strides=(1,))


def segments(raw: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of joined documents that end at ``ends``: each segment's anchor key, first window and last window."""
    none = np.empty(0, np.int64)
    if len(raw) < LENGTH:
        return none.view(np.uint64), none, none
    w = _words8(raw)
    n = len(raw) - GRAM + 1
    gram = _mix(w[:n] * _A + w[8 : n + 8] * _B + w[GRAM - 8 : n + GRAM - 8] * _C)
    # the least order wins, the rightmost of equals
    v = (gram & ~_LOW) | (_LOW - np.arange(n, dtype=np.uint64))
    m, width = v, 1
    while width * 2 <= REACH:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    rest = REACH - width
    if rest:
        m = np.minimum(m[:-rest], m[rest:])
    chosen = (_LOW - (m & _LOW)).astype(np.int64)
    windows = len(raw) - LENGTH + 1
    chosen = chosen[:windows]
    first = np.concatenate([[0], ends[:-1]])
    valid = np.zeros(windows + 1, np.int32)
    has = ends - first >= LENGTH
    np.add.at(valid, first[has], 1)
    np.add.at(valid, ends[has] - LENGTH + 1, -1)
    valid = np.cumsum(valid[:-1]) > 0
    cut = np.flatnonzero((chosen[1:] != chosen[:-1]) | (valid[1:] != valid[:-1])) + 1
    lo = np.concatenate([[0], cut])
    hi = np.concatenate([cut - 1, [windows - 1]])
    ok = valid[lo]
    # two documents may touch within one choice: a valid run ends where its document's windows end
    lo, hi = lo[ok], hi[ok]
    return _mix(gram[chosen[lo]] * _B), lo, hi


def _joined(texts: list[bytes]):
    """Groups of documents: (first index, joined bytes, ends)."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= SCAN_BYTES):
            size += len(texts[stop])
            stop += 1
        yield at, b"".join(texts[at:stop]), np.cumsum([len(x) for x in texts[at:stop]])
        at = stop


def _encode(texts) -> list[bytes]:
    return [(t or "").encode() for t in texts]


# ---------------------------------------------------------------- induced sorting


def suffix_array(s: np.ndarray, kinds: int) -> np.ndarray:
    """Suffix array of non-negative numbers below ``kinds`` by induced sorting (an end mark is implied)."""
    s = np.concatenate([np.asarray(s, np.int64) + 1, [0]])
    return _sais(s, kinds + 1)[1:]


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one."""
    n = len(s)
    rising = np.zeros(n, np.int8)
    rising[:-1][s[:-1] < s[1:]] = 1
    rising[:-1][s[:-1] > s[1:]] = -1
    rising[-1] = 1
    # equal neighbours take the type of the next different one
    known = np.where(rising != 0, np.arange(n), n)
    nxt = np.minimum.accumulate(known[::-1])[::-1]
    return rising[nxt] > 0


def _sais(s: np.ndarray, kinds: int) -> np.ndarray:
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    small = _types(s)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = small[1:] & ~small[:-1]
    lms = np.flatnonzero(is_lms)
    sizes = np.bincount(s, minlength=kinds)
    tails = np.cumsum(sizes)
    heads = tails - sizes
    induce = _induce_waves if n > 48 * kinds else _induce_plain
    sa = induce(s, small, lms, heads, tails)
    order = sa[is_lms[sa]]
    # names of the leftmost-smaller substrings, in their order
    size = np.empty(n, np.int64)
    size[lms[:-1]] = np.diff(lms) + 1
    size[lms[-1]] = 1
    a, b = order[:-1], order[1:]
    same = size[a] == size[b]
    live = np.flatnonzero(same)
    k = 0
    while len(live):
        equal = s[a[live] + k] == s[b[live] + k]
        same[live[~equal]] = False
        k += 1
        live = live[equal]
        live = live[size[a[live]] > k]
    names = np.concatenate([[0], np.cumsum(~same)])
    named = np.empty(n, np.int64)
    named[order] = names
    reduced = named[lms]
    if names[-1] + 1 == len(lms):
        ranked = order
    else:
        ranked = lms[_sais(reduced, int(names[-1]) + 1)]
    return induce(s, small, ranked, heads, tails)


def _place(s: np.ndarray, lms: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """Put leftmost-smaller suffixes, in the given order, at the ends of their buckets."""
    sa = np.full(len(s), -1, np.int64)
    c = s[lms]
    by = np.argsort(c, kind="stable")
    c = c[by]
    last = np.searchsorted(c, c, "right")
    sa[tails[c] - (last - np.arange(len(c)))] = lms[by]
    return sa


def _induce_waves(s, small, lms, heads, tails):
    """Bucket by bucket, all suffixes that a stretch of the array induces at once; for small alphabets."""
    sa = _place(s, lms, tails)
    head, kinds = heads.copy(), len(heads)
    s16 = s.astype(np.uint16) if kinds < 65536 else s

    def put(block):
        j = block[block > 0] - 1
        j = j[~small[j]]
        if len(j):
            c = s16[j]
            by = np.argsort(c, kind="stable")
            j, c = j[by], s[j[by]]
            n = np.bincount(c, minlength=kinds)
            before = np.cumsum(n) - n
            sa[head[c] + np.arange(len(c)) - before[c]] = j
            head[:] += n

    full = np.flatnonzero(tails > heads)
    for c in full:
        lo = heads[c]
        while lo < head[c]:
            hi = head[c]
            put(sa[lo:hi])
            lo = hi
        rest = sa[lo : tails[c]]
        put(rest[rest >= 0])
    # the smaller suffixes now anew, from the right
    tail = tails.copy()
    n_small = np.bincount(s[small], minlength=kinds)

    def put_small(block):
        j = block[block > 0] - 1
        j = j[small[j]]
        if len(j):
            c = s16[j]
            by = np.argsort(c, kind="stable")
            j, c = j[by], s[j[by]]
            n = np.bincount(c, minlength=kinds)
            before = np.cumsum(n) - n
            sa[tail[c] - 1 - (np.arange(len(c)) - before[c])] = j
            tail[:] -= n

    sa[0] = len(s) - 1
    for c in full[::-1]:
        hi = tails[c]
        if c == 0:
            break  # the end mark alone
        while hi > tail[c]:
            lo = tail[c]
            put_small(sa[lo:hi][::-1])
            hi = lo
        put_small(sa[heads[c] : tails[c] - n_small[c]][::-1])
    return sa


def _induce_plain(s, small, lms, heads, tails):
    """One suffix at a time; for alphabets about as large as the text.

    ``larger`` and ``smaller`` hold the bucket of the suffix before each one, or
    -1 where that is of the other type; their last entry serves empty places.
    The loops run over the array while it is being filled.
    """
    sa = _place(s, lms, tails).tolist()
    before, kind = np.concatenate([[-1], s[:-1], [-1]]), np.concatenate([[False], small[:-1], [False]])
    larger = np.where(kind, -1, before).tolist()
    smaller = np.where(kind, before, -1).tolist()
    head, tail = heads.tolist(), tails.tolist()
    for j in sa:
        c = larger[j]
        if c >= 0:
            h = head[c]
            sa[h] = j - 1
            head[c] = h + 1
    for j in reversed(sa):
        c = smaller[j]
        if c >= 0:
            h = tail[c] - 1
            sa[h] = j - 1
            tail[c] = h
    sa[0] = len(s) - 1
    return np.array(sa, np.int64)


def repeats(sa: np.ndarray, raw: bytes) -> np.ndarray:
    """Per suffix in text order: whether it shares LENGTH bytes with the suffix before it in the array (permuted prefixes)."""
    w = _words8(raw + bytes(LENGTH + 8))
    before = np.full(len(sa), -1, np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.flatnonzero(before >= 0)
    for k in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        at = at[w[at + k] == w[before[at] + k]]
    out = np.zeros(len(sa), bool)
    out[at] = True
    return out


def least_documents(contents: list[bytes], docs: np.ndarray) -> list[np.ndarray]:
    """Per segment and window: the smallest document among segments that hold the same window."""
    raw = b"".join(contents)
    sizes = np.array([len(c) for c in contents])
    ends = np.cumsum(sizes)
    # an end mark between segments keeps windows apart; it is a code below all bytes
    spaced = np.zeros(len(raw) + len(contents), np.int64)
    at = np.arange(len(raw)) + np.repeat(np.arange(len(contents)), sizes)
    spaced[at] = np.frombuffer(raw, np.uint8).astype(np.int64) + 1
    sa = suffix_array(spaced, 257)
    bytes_ = np.zeros(len(spaced), np.uint8)
    bytes_[at] = np.frombuffer(raw, np.uint8)
    starts = ends - sizes + np.arange(len(contents))
    owner = np.repeat(np.arange(len(contents)), sizes + 1)
    room = starts[owner] + sizes[owner] - np.arange(len(spaced))
    good = room >= LENGTH
    same = repeats(sa, bytes_.tobytes())
    # equal windows stand side by side; suffixes too short for a window never join them
    sa = sa[good[sa]]
    group = np.cumsum(~same[sa])
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    least = np.minimum.reduceat(docs[owner[sa]], edge)
    out = np.empty(len(spaced), np.int64)
    out[sa] = least[np.searchsorted(edge, np.arange(len(sa)), "right") - 1]
    return [out[a : a + n - LENGTH + 1] for a, n in zip(starts, sizes, strict=True)]


def _runs(values: np.ndarray):
    """(first, last, value) of stretches of equal values."""
    cut = np.flatnonzero(values[1:] != values[:-1]) + 1
    lo = np.concatenate([[0], cut])
    return lo, np.concatenate([cut - 1, [len(values) - 1]]), values[lo]


# ---------------------------------------------------------------- Spark stages

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _cleaned(spark: SparkSession):
    """Shuffle files of each query that ends meanwhile go with it; else they stay until the driver collects garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def _written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    with _cleaned(df.sparkSession):
        return materialise(df, name, codec)


def _given(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("version"), text.alias("text"))


def _with_copies(given: DataFrame) -> DataFrame:
    """Adds ``copy``: whether an earlier document has the same whole text (two equal hashes and equal size), long enough to go."""
    sized = given.withColumn("size", F.octet_length("text")).withColumn("second", F.xxhash64(F.lit("second"), "text"))
    equal = _written(sized.groupBy("version", "second", "size").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where((F.col("least") < F.col("most")) & (F.col("size") >= LENGTH)).drop("most"), "equal-texts")
    n = equal.count()
    marked = sized.join(F.broadcast(equal) if n <= BROADCAST_ROWS // 2 else equal, ["version", "second", "size"], "left")
    return marked.select("doc", "version", "text", F.coalesce(F.col("least") < F.col("doc"), F.lit(False)).alias("copy"))


def _shared_anchors(given: DataFrame) -> DataFrame:
    """Keys of the anchors found in two or more rows."""

    def anchors(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            found = []
            for _, raw, ends in _joined(_encode(pdf["text"])):
                key, lo, _ = segments(raw, ends)
                if len(key):
                    doc = np.searchsorted(ends, lo, "right")
                    _, once = np.unique(_mix(key + doc.astype(np.uint64) * _C), return_index=True)  # once for each document
                    found.append(key[once])
            if found:
                key, n = np.unique(np.concatenate(found), return_counts=True)
                yield pd.DataFrame({"key": key.view(np.int64), "n": np.minimum(n, 2).astype(np.int8)})

    keys = given.select("text").mapInPandas(anchors, "key long, n byte")
    return keys.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key")


def _filter_bits(given: DataFrame) -> int:
    """Size of the filter as a power of two; an anchor comes about every REACH / 2 bytes, and a shared one twice or more."""
    with _cleaned(given.sparkSession):
        size = given.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    return max(int(np.ceil(np.log2(8 * (size / REACH + 1)))), LEAST_BITS)


def _filter(shared: DataFrame, bits: int):
    """A broadcast bitmap of the keys."""

    def chunks(batches):
        have: dict[int, np.ndarray] = {}
        for pdf in batches:
            bit = pdf["key"].to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            at = (bit >> np.uint64(CHUNK_BITS)).astype(np.int64)
            for c in np.unique(at):
                part = have.setdefault(int(c), np.zeros(1 << (CHUNK_BITS - 3), np.uint8))
                b = bit[at == c] & np.uint64((1 << CHUNK_BITS) - 1)
                np.bitwise_or.at(part, (b >> np.uint64(3)).astype(np.int64), np.left_shift(1, (b & np.uint64(7)).astype(np.int64)).astype(np.uint8))
        if have:
            yield pd.DataFrame({"chunk": list(have), "bits": [b.tobytes() for b in have.values()]})

    dealt = shared.repartition(F.shiftrightunsigned("key", 64 - bits + CHUNK_BITS))
    bitmap = np.zeros(1 << (bits - 3), np.uint8)
    written = _written(dealt.mapInPandas(chunks, "chunk int, bits binary"), "filter")
    for r in written.toLocalIterator():
        bitmap[r["chunk"] << (CHUNK_BITS - 3) : (r["chunk"] + 1) << (CHUNK_BITS - 3)] |= np.frombuffer(r["bits"], np.uint8)
    discard(written)
    return shared.sparkSession.sparkContext.broadcast(bitmap)


def _range_bits(spark: SparkSession) -> int:
    return min(int(np.ceil(np.log2(RANGES * partitions(spark)))), MOST_RANGE_BITS)


def _tags(key: np.ndarray, range_bits: int) -> np.ndarray:
    """What tells keys of one range apart."""
    return (key >> np.uint64(64 - range_bits - 8 * TAG_BYTES)) & np.uint64((1 << 8 * TAG_BYTES) - 1)


def _packs(given: DataFrame, range_bits: int) -> DataFrame:
    """Keys of anchors by range and pack, a stretch of documents: their tags and the documents' places in the pack. A row of a negative range holds a pack's documents and their versions."""

    def run(batches):
        have: list[list] = [[], [], [], []]
        n, size = 0, 0

        def flush():
            key, owner, ids, versions = (np.concatenate(x) for x in have)
            ids, versions = ids.tobytes(), versions.tobytes()
            # rows that come in another order when a task runs again make other packs
            pack = _content_key(ids + versions)
            part = (key >> np.uint64(64 - range_bits)).astype(np.uint16)
            order = np.argsort(part, kind="stable")
            part, tags, owner = part[order], _tags(key[order], range_bits), owner[order]
            cut = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]]).tolist()
            raw = tags.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :TAG_BYTES]
            rows = [(-1 - pack % (1 << range_bits), pack, ids, versions)]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                step = np.diff(owner[a:b], prepend=0)
                rows.append((int(part[a]), pack, raw[a:b].tobytes(), step.astype(np.uint8 if step.max() < 256 else "<u4").tobytes()))
            return pd.DataFrame(rows, columns=["part", "pack", "tags", "owners"])

        for pdf in batches:
            ids, versions = pdf["doc"].to_numpy(np.int64), pdf["version"].to_numpy(np.int64)
            for at, raw, ends in _joined(_encode(pdf["text"])):
                key, lo, _ = segments(raw, ends)
                if not len(key):
                    continue
                for x, new in zip(have, (key, np.searchsorted(ends, lo, "right") + n, ids[at : at + len(ends)], versions[at : at + len(ends)]), strict=True):
                    x.append(new)
                n, size = n + len(ends), size + len(raw)
                if size >= PACK_BYTES:
                    yield flush()
                    have, n, size = [[], [], [], []], 0, 0
        if size:
            yield flush()

    return given.select("doc", "version", "text").mapInPandas(run, "part int, pack long, tags binary, owners binary")


def _shared_tags(packs: DataFrame) -> DataFrame:
    """Of each pack and range the tags that another document has too (their last four bytes), with their documents' places; rows of documents go through."""

    def several(names, tags, owners):
        n = [len(x) // TAG_BYTES for x in tags]
        ends = np.cumsum(n)
        wide = np.zeros((ends[-1], 8), np.uint8)
        wide[:, :TAG_BYTES] = np.frombuffer(b"".join(tags), np.uint8).reshape(-1, TAG_BYTES)
        tag = wide.view("<u8").ravel()
        place = np.concatenate([np.cumsum(np.frombuffer(x, np.uint8 if len(x) == k else "<u4").astype(np.int64)) for x, k in zip(owners, n, strict=True)])
        owner = (np.repeat(np.arange(len(n)), n) << 32) + place
        order = np.argsort(tag, kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], tag[order[1:]] != tag[order[:-1]]]))
        # rows stand in the order of their owners within one tag
        last = np.concatenate([edge[1:], [len(order)]]) - 1
        found = np.repeat(owner[order[edge]] != owner[order[last]], last - edge + 1)
        found = np.sort(order[found])
        cut = np.searchsorted(found, np.concatenate([[0], ends]))
        for name, a, b in zip(names, cut[:-1], cut[1:], strict=True):
            if a < b:
                yield name, tag[found[a:b]].astype("<u4").tobytes(), place[found[a:b]].astype("<u4").tobytes()

    def run(batches):
        now, have = None, ([], [], [])
        for pdf in batches:
            out = []
            for part, *row in zip(pdf["part"], pdf["pack"], pdf["tags"], pdf["owners"], strict=True):
                if part < 0:
                    out.append((True, *row))
                    continue
                if part != now and have[0]:
                    out += [(False, *r) for r in several(*have)]
                    have = ([], [], [])
                now = part
                for x, new in zip(have, row, strict=True):
                    x.append(new)
            yield pd.DataFrame(out, columns=["names", "pack", "tags", "owners"])
        if have[0]:
            yield pd.DataFrame([(False, *r) for r in several(*have)], columns=["names", "pack", "tags", "owners"])

    return packs.repartition("part").sortWithinPartitions("part").mapInPandas(run, "names boolean, pack long, tags binary, owners binary")


def _by_document(tags: DataFrame) -> DataFrame:
    """The same as one row a document: doc, version and its tags in order."""

    def of(names, tags, owners):
        if names is None:
            raise ValueError("a pack of keys without its documents")
        ids, versions = (np.frombuffer(x, np.int64) for x in names)
        tag, owner = (np.frombuffer(b"".join(x), "<u4") for x in (tags, owners))
        each = np.unique((owner.astype(np.uint64) << np.uint64(32)) | tag)
        owner, tag = (each >> np.uint64(32)).astype(np.int64), each.astype("<u4")
        cut = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1, [len(owner)]]).tolist()
        return [(ids[owner[a]], versions[owner[a]], tag[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def run(batches):
        now, known, have = None, None, ([], [])
        for pdf in batches:
            out = []
            for names, pack, tag, owner in zip(pdf["names"], pdf["pack"], pdf["tags"], pdf["owners"], strict=True):
                if pack != now:
                    if have[0]:
                        out += of(known, *have)
                    now, known, have = pack, None, ([], [])
                if names:
                    known = (tag, owner)
                else:
                    have[0].append(tag)
                    have[1].append(owner)
            yield pd.DataFrame(out, columns=["doc", "version", "tags"])
        if have[0]:
            yield pd.DataFrame(of(known, *have), columns=["doc", "version", "tags"])

    return tags.repartition("pack").sortWithinPartitions("pack", F.desc("names")).mapInPandas(run, "doc long, version long, tags binary")


def _content_key(content: bytes) -> int:
    return xxhash.xxh3_64_intdigest(content) - (1 << 63)


def _occurrences(given: DataFrame, wanted, wanted_columns: tuple[str, ...] = ()) -> DataFrame:
    """Segments of shared anchors: chash (of their bytes), doc, version, start, size, anchor; bytes for the first of a batch only.

    ``wanted(key, place, *columns)`` tells which keys to take, from the places of
    their documents and these columns of the documents. A segment's bytes
    determine its anchor; anchor and hash of the bytes, 128 bits, name it.
    """

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf.sort_values("doc", ignore_index=True)
            ids, versions, sent = pdf["doc"].to_numpy(), pdf["version"].to_numpy(), set()
            for at, raw, ends in _joined(_encode(pdf["text"])):
                key, lo, hi = segments(raw, ends)
                hit = wanted(key, np.searchsorted(ends, lo, "right"), *(pdf[c].iloc[at : at + len(ends)] for c in wanted_columns))
                key, lo, hi = key[hit].view(np.int64), lo[hit], hi[hit] + LENGTH
                if not len(key):
                    continue
                doc = np.searchsorted(ends, lo, "right")
                start = lo - np.concatenate([[0], ends[:-1]])[doc]
                contents = [raw[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
                hashes = [_content_key(c) for c in contents]
                for i, name in enumerate(zip(key.tolist(), hashes, strict=True)):
                    if name in sent:
                        contents[i] = None
                    else:
                        sent.add(name)
                yield pd.DataFrame({"chash": hashes, "doc": ids[doc + at], "version": versions[doc + at], "start": start, "size": hi - lo, "anchor": key, "content": contents})

    return given.select("doc", "version", "text", *wanted_columns).mapInPandas(run, "chash long, doc long, version long, start long, size long, anchor long, content binary")


def _filtered(given: DataFrame, bits: int) -> DataFrame:
    """Occurrences by a filter that all tasks have."""
    keys = _written(_shared_anchors(given), "shared-anchors")
    shared = _filter(keys, bits)
    discard(keys)
    shift, three, seven = np.uint64(64 - bits), np.uint64(3), np.uint64(7)

    def wanted(key, place):
        bit = key >> shift
        return (shared.value[bit >> three] >> (bit & seven).astype(np.uint8)) & 1 > 0

    return _occurrences(given, wanted)


def _tagged(given: DataFrame) -> DataFrame:
    """Occurrences by the tags of each document's shared anchors."""
    bits = _range_bits(given.sparkSession)
    tags = _written(_shared_tags(_packs(given, bits)), "tags")
    # rows that repeat have the same tags
    own = _written(_by_document(tags).dropDuplicates(["doc", "version"]), "tags-of-documents")
    discard(tags)

    def wanted(key, place, tags):
        n = [len(x) // 4 for x in tags]
        known = (np.repeat(np.arange(len(n), dtype=np.uint64), n) << np.uint64(32)) | np.frombuffer(b"".join(tags), "<u4")
        asked = (place.astype(np.uint64) << np.uint64(32)) | _tags(key, bits).astype(np.uint32)
        at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
        return known[at] == asked

    found = _written(_occurrences(given.join(own, ["doc", "version"]), wanted, ("tags",)), "occurrences", "zstd")
    discard(own)
    return found


def _sorted_shards(mixed: DataFrame) -> DataFrame:
    """Runs of windows with their smallest documents, by induced sorting of shards that hold whole anchors."""

    def run(batches):
        have: dict[str, list] = {"anchor": [], "chash": [], "content": [], "doc": []}
        size, last = 0, None

        def flush():
            least = least_documents(have["content"], np.array(have["doc"], np.int64))
            rows = [(a, c, x, y, m) for a, c, v in zip(have["anchor"], have["chash"], least, strict=True) for x, y, m in zip(*map(np.ndarray.tolist, _runs(v)), strict=True)]
            for x in have.values():
                x.clear()
            return pd.DataFrame(rows, columns=["anchor", "chash", "first", "last", "least"])

        for pdf in batches:
            for a, c, content, d in zip(pdf["anchor"], pdf["chash"], pdf["content"], pdf["doc"], strict=True):
                if a == last and c == have["chash"][-1]:
                    continue  # the same segment from another batch; its smallest document came first
                if size >= SHARD_BYTES and a != last:
                    yield flush()
                    size = 0
                last = a
                have["anchor"].append(a)
                have["chash"].append(c)
                have["content"].append(content)
                have["doc"].append(d)
                size += len(content)
        if size:
            yield flush()

    return mixed.select("anchor", "chash", "content", "doc").repartition("anchor").sortWithinPartitions("anchor", "chash", "doc").mapInPandas(run, RUNS)


RUNS = "anchor long, chash long, first long, last long, least long"


def _by_window(hot: DataFrame) -> DataFrame:
    """The same for anchors with very many segments, dealt out by window."""

    def run(batches):
        for pdf in batches:
            rows = [(a, _content_key(c[i : i + LENGTH]), h, i, d) for a, h, c, d in zip(pdf["anchor"], pdf["chash"], pdf["content"], pdf["doc"], strict=True) for i in range(len(c) - LENGTH + 1)]
            yield pd.DataFrame(rows, columns=["anchor", "window", "chash", "first", "doc"]).astype("int64")

    once = hot.groupBy("anchor", "chash").agg(F.min("doc").alias("doc"), F.first("content").alias("content"))
    windows = _written(once.select("anchor", "chash", "content", "doc").mapInPandas(run, "anchor long, window long, chash long, first long, doc long"), "windows")
    least = _written(windows.groupBy("anchor", "window").agg(F.min("doc").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"), "least-windows")
    shared = windows.join(least, ["anchor", "window"]).select("anchor", "chash", "first", F.col("first").alias("last"), "least")
    # a window of one segment may still stand in several documents of that segment
    single = windows.join(least, ["anchor", "window"], "left_anti").select("anchor", "chash", "first", F.col("first").alias("last"), F.col("doc").alias("least"))
    out = _written(shared.unionByName(single), "runs-of-hot")
    discard(windows)
    discard(least)
    return out


def removals(given: DataFrame) -> DataFrame:
    """Per document (doc, version, text) with removed bytes: doc, version and spans, stretches (start, stop) that may overlap."""
    bits = _filter_bits(given)
    found = _written(_filtered(given, bits), "occurrences", "zstd") if bits <= MOST_BITS else _tagged(given)
    kinds = _written(found.groupBy("anchor", "chash").agg(F.min("doc").alias("doc"), F.first("size").alias("size"), F.count("*").alias("n")), "segments")
    per = _written(kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("n").alias("rows")).where("rows > 1").drop("rows"), "anchors")
    # a segment alone with its anchor is equal in all its documents
    alone = kinds.join(per.where("kinds = 1").select("anchor"), "anchor", "left_semi").select("anchor", "chash", F.lit(0).cast("long").alias("first"), (F.col("size") - LENGTH).alias("last"), F.col("doc").alias("least"))
    contents = found.where("content is not null").select("anchor", "chash", "content", "doc")
    # one after the other, so that their shuffles do not stand side by side
    parts = [_written(alone, "runs-of-lone"), _written(_sorted_shards(with_ids(contents, per.where((F.col("kinds") > 1) & (F.col("kinds") <= HOT)).select("anchor"), "anchor")), "runs")]
    hot = per.where(F.col("kinds") > HOT).select("anchor")
    if not hot.isEmpty():
        parts.append(_by_window(with_ids(contents, hot, "anchor")))
    runs = functools.reduce(DataFrame.unionByName, parts)
    hit = found.select("anchor", "chash", "doc", "version", "start").join(runs, ["anchor", "chash"]).where("least < doc")
    spans = hit.select("doc", "version", F.struct((F.col("start") + F.col("first")).alias("start"), (F.col("start") + F.col("last") + LENGTH).alias("stop")).alias("span"))
    out = _written(spans.groupBy("doc", "version").agg(F.collect_list("span").alias("spans")), "removals")
    for t in (found, kinds, per, *parts):
        discard(t)
    return out


def _merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["start"], s["stop"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans and kept, the bytes that are left."""

    def cut(batches):
        for pdf in batches:
            out = []
            for doc, text, spans in zip(pdf["doc"], pdf["text"], pdf["spans"], strict=True):
                raw, at, kept = (text or "").encode(), 0, []
                merged = [] if spans is None else _merged(spans)
                for a, b in merged:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                left = b"".join(kept)
                out.append((doc, len(raw), len(raw) - len(left), len(merged), left))
            yield pd.DataFrame(out, columns=[id_col, "n_bytes", "n_removed", "n_spans", "kept"])

    every = _given(docs, id_col, text_col)
    given = _with_copies(every.where("doc is not null"))
    once = given.where("not copy").select("doc", "version", "text")
    gone = removals(once)
    changed = once.join(gone, ["doc", "version"], "left").select("doc", "text", "spans").mapInPandas(cut, f"{id_col} long, n_bytes long, n_removed long, n_spans long, kept binary")
    size, none = F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long")
    same = every.where("doc is null").select(F.col("doc").alias(id_col), size, none.alias("n_removed"), none.alias("n_spans"), F.col("text").cast("binary").alias("kept"))
    copies = given.where("copy").select(F.col("doc").alias(id_col), size, F.octet_length("text").cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit("").cast("binary").alias("kept"))
    return changed.unionByName(same).unionByName(copies)
