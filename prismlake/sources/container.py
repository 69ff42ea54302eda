"""Self-describing texture containers: a parser and a writer of single files, and their Spark source and sink.

Layout: 12-byte identifier, nine 32-bit numbers, three section entries, a level
index of three 64-bit numbers per level, then the format descriptor, key/value
data, global data and the payload, smallest level first. The parser runs once
per file inside an Arrow batch; all further work is DataFrame expressions.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the format.
IDENTIFIER = b"\xabKTX 20\xbb\r\n\x1a\n"
IDENTIFIER_V1 = b"\xabKTX 11\xbb\r\n\x1a\n"
NONE, BASIS_LZ, ZSTD, ZLIB = 0, 1, 2, 3
MAX_METADATA = 100
MAX_BLOCKS, MAX_SAMPLES = 10, 16

LEVEL = "struct<level:int,byte_offset:bigint,byte_length:bigint,uncompressed_length:bigint,bytes:binary>"
SAMPLE = "struct<bit_offset:int,bit_length:int,channel:int,qualifiers:int,lower:bigint,upper:bigint,positions:array<int>>"
SCHEMA = (
    "path string, status string, version int, vk_format bigint, type_size bigint, width bigint, height bigint, depth bigint, layers bigint, faces bigint, levels bigint, sc_scheme bigint, "
    "dfd_offset bigint, dfd_length bigint, kvd_offset bigint, kvd_length bigint, sgd_offset bigint, sgd_length bigint, "
    "model int, primaries int, transfer int, flags int, "
    f"level_index array<{LEVEL}>, samples array<{SAMPLE}>, metadata array<struct<ordinal:int,key:string,value:binary>>, "
    "dfd_total bigint, dfd_version int, texel_block array<int>, planes array<int>, dfd_issues array<int>, kvd_issues array<int>"
)
NAMES = [x.split()[0] for x in SCHEMA.split(", ")][:22] + ["level_index", "samples", "metadata", "dfd_total", "dfd_version", "texel_block", "planes", "dfd_issues", "kvd_issues"]
INTEGERS = [*NAMES[2:22], "dfd_total", "dfd_version"]


def _metadata(raw: bytes) -> tuple[list[tuple[int, str, bytes]], list[int]]:
    """Entries of u32 size, key, NUL, value, padded to 4, and the ids of rules that the bytes break.

    Reading stops at MAX_METADATA entries and where an entry cannot be told from
    the next. Keys that are not UTF-8 are kept with replacement signs.
    """
    out, issues, at = [], [], 0
    while at < len(raw):
        if len(out) == MAX_METADATA:
            issues.append(7001)
            return out, issues
        if len(raw) - at < 6:
            issues.append(7002)
            return out, issues
        (size,) = struct.unpack_from("<I", raw, at)
        if size < 2:
            issues.append(7004)
            at += 4 + -(-size // 4) * 4
            continue
        if size > len(raw) - at - 4:
            issues.append(7003)
            size = len(raw) - at - 4
        entry = raw[at + 4 : at + 4 + size]
        key, nul, value = entry.partition(b"\0")
        if key.startswith(b"\xef\xbb\xbf"):
            key = key[3:]
            issues.append(7006)
        try:
            key.decode()
        except UnicodeDecodeError:
            issues.append(7007)
        if not nul:
            issues.append(7005)
        out.append((len(out), key.decode("utf-8", "replace"), value))
        padded = -(-size // 4) * 4
        if any(raw[at + 4 + size : at + 4 + padded]):
            issues.append(7011)
        at += 4 + padded
    if at != len(raw):
        issues.append(7008)
    return out, issues


def _descriptor(raw: bytes):
    """Model, primaries, transfer, flags; samples; total size, version, block, planes and broken rules of the first basic block."""
    if len(raw) < 4:
        return (None,) * 4, [], (None, None, None, None, [])
    (total,) = struct.unpack_from("<I", raw)
    issues, basic, samples, rest, at, n = [] if total == len(raw) else [6001], (None,) * 4, [], (None, None, None), 4, 0
    found = False
    while at < len(raw):
        n += 1
        if n > MAX_BLOCKS:
            issues.append(6002)
            break
        if len(raw) - at < 8:
            issues.append(6004)
            break
        kind, version, size = struct.unpack_from("<IHH", raw, at)
        if size < 8:
            issues.append(6006)
        elif size > len(raw) - at:
            issues.append(6007)
        elif kind:
            # further blocks of the same vendor may hold dimensions and planes
            if kind & 0x1FFFF or kind >> 17 not in (0x6001, 0x6002):
                issues.append(6003)
        elif found:
            issues.append(6005)
        else:
            found = n == 1 or size < 24
            if size < 24:
                issues.append(6010)
            elif n == 1:
                if (size - 24) % 16:
                    issues.append(6009)
                stored = (size - 24) // 16
                if stored > MAX_SAMPLES:
                    issues.append(6029)
                basic = tuple(raw[at + 8 : at + 12])
                rest = (version, list(raw[at + 12 : at + 16]), list(raw[at + 16 : at + 24]))
                for k in range(min(stored, MAX_SAMPLES)):
                    offset, length, channel, *positions, lower, upper = struct.unpack_from("<HBB4BII", raw, at + 24 + 16 * k)
                    samples.append((offset, length + 1, channel & 15, channel >> 4, lower, upper, positions))
        at += max(size, 8)
    if not found:
        issues.append(6008)
    return basic, samples, (total, *rest, issues)


def inflate(raw: bytes, scheme: int) -> bytes:
    if scheme == ZSTD:
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    return zlib.decompress(raw) if scheme == ZLIB else raw


def deflate(raw: bytes, scheme: int, level: int | None = None) -> bytes:
    if scheme == ZSTD:
        import zstandard

        return zstandard.ZstdCompressor(level=3 if level is None else level).compress(raw)
    return zlib.compress(raw, 6 if level is None else level) if scheme == ZLIB else raw


def parse(raw: bytes, path: str = "", payload: bool = True, metadata: bool = True, inflated: bool = True) -> tuple:
    """One file to one row of SCHEMA; ``status`` names what is wrong, the fields after it are then null."""
    return parse_ranges(lambda at, n: raw[at : at + n], len(raw), path, payload, metadata, inflated)


def parse_ranges(fetch: Callable[[int, int], bytes], size: int, path: str = "", payload: bool = True, metadata: bool = True, inflated: bool = True) -> tuple:
    """The same by ranges of a file of ``size`` bytes; only what is asked for is fetched."""
    bad = lambda status, version=None: (path, status, version, *[None] * (len(NAMES) - 3))
    head = fetch(0, 80)
    if head[:12] == IDENTIFIER_V1:
        return bad("version 1 file", 1)
    if head[:12] != IDENTIFIER:
        return bad("unknown identifier")
    if len(head) < 80:
        return bad("unexpected end", 2)
    fmt, type_size, w, h, d, layers, faces, levels, scheme = struct.unpack_from("<9I", head, 12)
    dfd_at, dfd_size, kvd_at, kvd_size = struct.unpack_from("<4I", head, 48)
    sgd_at, sgd_size = struct.unpack_from("<2Q", head, 64)
    shown = max(levels, 1)
    if shown > 32 or size < 80 + 24 * shown:
        return bad("unexpected end", 2)
    places, index = fetch(80, 24 * shown), []
    for k in range(shown):
        at, length, full = struct.unpack_from("<3Q", places, 24 * k)
        if at + length > size:
            return bad("unexpected end", 2)
        body = None
        if payload:
            body = fetch(at, length)
            if inflated and scheme in (ZSTD, ZLIB):
                try:
                    body = inflate(body, scheme)
                except Exception:  # whatever the codec raises on damaged data
                    return bad("damaged payload", 2)
                if len(body) != full:
                    return bad("wrong uncompressed length", 2)
        index.append((k, at, length, full, body))
    basic, samples, descriptor = _descriptor(fetch(dfd_at, dfd_size))
    pairs, issues = _metadata(fetch(kvd_at, kvd_size)) if metadata else (None, None)
    return (path, "ok", 2, fmt, type_size, w, h, d, layers, faces, levels, scheme, dfd_at, dfd_size, kvd_at, kvd_size, sgd_at, sgd_size, *basic, index, samples, pairs, *descriptor, issues)


# ------------------------------------------------------------------ for validation

EXAMINED = (
    "path string, file_size bigint, identified boolean, end_stage int, payload_state string, "
    + ", ".join(x for x in SCHEMA.split(", ") if x.split()[0] in ("vk_format", "type_size", "width", "height", "depth", "layers", "faces", "levels", "sc_scheme", "dfd_offset", "dfd_length", "kvd_offset", "kvd_length", "sgd_offset", "sgd_length", "model", "primaries", "transfer", "flags"))
    + f", level_index array<{LEVEL}>, samples array<{SAMPLE}>, metadata array<struct<ordinal:int,key:string,value:binary>>, "
    "dfd_total bigint, dfd_version int, texel_block array<int>, planes array<int>, dfd_issues array<int>, kvd_issues array<int>, global_data binary, paddings array<struct<before:string,at:bigint>>"
)
EXAMINED_NAMES = [x.split()[0] for x in EXAMINED.split(", ")][:24] + ["level_index", "samples", "metadata", "dfd_total", "dfd_version", "texel_block", "planes", "dfd_issues", "kvd_issues", "global_data", "paddings"]
#: Steps of validation, in their order; reading past the end of a file ends it at the step that reads.
STAGES = ["header", "index", "descriptor", "levels", "metadata", "global data", "padding", "loading"]


def gaps(blocks: list[tuple[str, int, int]], start: int) -> list[tuple[str, int, int]]:
    """(name, offset, bytes) of the gap before each block that follows what came before it; misplaced and absent blocks have none."""
    out, at = [], start
    for name, offset, size in blocks:
        if offset and size:
            if offset >= at:
                out.append((name, at, offset - at))
            at = offset + size if offset >= at else max(at, offset + size)
    return out


def examine(fetch: Callable[[int, int], bytes], size: int, path: str = "") -> tuple:
    """One file to one row of EXAMINED: all that validation reads, as far as the file goes. Levels keep their bytes in scheme 4 only."""
    row = dict.fromkeys(EXAMINED_NAMES) | {"path": path, "file_size": size}
    done = lambda **more: tuple((row | more)[c] for c in EXAMINED_NAMES)
    head = fetch(0, 80)
    if len(head) < 80:
        return done(end_stage=0)
    if head[:12] != IDENTIFIER:
        return done(identified=False)
    numbers = struct.unpack_from("<13I2Q", head, 12)
    row |= dict(zip(EXAMINED_NAMES[5:20], numbers, strict=True)) | {"identified": True}
    (dfd_at, dfd_size, kvd_at, kvd_size, sgd_at, sgd_size), scheme, shown = numbers[9:], numbers[8], max(numbers[7], 1)
    ends = [(2, dfd_at, dfd_size), (3, 80, 24 * shown), (4, kvd_at, kvd_size), (5, sgd_at, sgd_size)]
    row["end_stage"] = next((stage for stage, at, n in ends if at and n and at + n > size), None)
    basic, samples, rest = _descriptor(fetch(dfd_at, dfd_size) if dfd_at else b"")
    row |= dict(zip(("model", "primaries", "transfer", "flags"), basic, strict=True)) | {"samples": samples}
    row |= dict(zip(("dfd_total", "dfd_version", "texel_block", "planes", "dfd_issues"), rest, strict=True))
    row["metadata"], row["kvd_issues"] = _metadata(fetch(kvd_at, kvd_size) if kvd_at else b"")
    row["global_data"] = fetch(sgd_at, sgd_size) if sgd_at and sgd_size else None
    if 80 + 24 * shown > size:
        return done(level_index=[])
    places = fetch(80, 24 * shown)
    index = [struct.unpack_from("<3Q", places, 24 * k) for k in range(shown)]
    row["level_index"] = [(k, *x, fetch(x[0], x[1]) if scheme == 4 else None) for k, x in enumerate(index)]
    blocks = [("DFD", dfd_at, dfd_size), ("KVD", kvd_at, kvd_size), ("SGD", sgd_at, sgd_size)]
    found = gaps(blocks + [(f"image level {k}", *index[k][:2]) for k in reversed(range(shown))], 80 + 24 * shown)
    if row["end_stage"] is None and any(at + n > size for _, at, n in found):
        row["end_stage"] = 6
    filled = ((name, at, fetch(at, n)) for name, at, n in found if at + n <= size)
    row["paddings"] = [(name, at + len(raw) - len(raw.lstrip(b"\0"))) for name, at, raw in filled if raw.strip(b"\0")]
    row["payload_state"] = "end" if any(at + n > size for at, n, _ in index) else "ok"
    if row["payload_state"] == "ok" and scheme in (ZSTD, ZLIB):
        for at, n, full in index:
            try:
                if len(inflate(fetch(at, n), scheme)) != full:
                    row["payload_state"] = "wrong length"
            except Exception:  # whatever the codec raises on damaged data
                row["payload_state"] = "damaged"
                break
    return done()


def examined(files: DataFrame) -> DataFrame:
    """(path, content) rows, batch or stream, to rows of EXAMINED."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [examine(lambda at, n, c=c or b"": c[at : at + n], len(c or b""), p) for p, c in zip(pdf["path"], pdf["content"], strict=True)]
            numbers = [x.split()[0] for x in EXAMINED.split(", ")[:24] if x.split()[1] in ("bigint", "int")]
            yield pd.DataFrame(rows, columns=EXAMINED_NAMES).astype({n: "Int64" for n in [*numbers, "dfd_total", "dfd_version"]} | {"identified": "boolean"})

    return files.select("path", "content").mapInPandas(run, EXAMINED)


def read(spark: SparkSession, path: str, payload: bool = True, metadata: bool = True, inflated: bool = True) -> DataFrame:
    """Containers under ``path`` (any store that Spark reads), one row per file."""
    return parsed(spark.read.format("binaryFile").option("pathGlobFilter", "*").load(path), payload, metadata, inflated)


def parsed(files: DataFrame, payload: bool = True, metadata: bool = True, inflated: bool = True) -> DataFrame:
    """(path, content) rows, batch or stream, to rows of SCHEMA."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [parse(c or b"", p, payload, metadata, inflated) for p, c in zip(pdf["path"], pdf["content"], strict=True)]
            yield pd.DataFrame(rows, columns=NAMES).astype({n: "Int64" for n in INTEGERS})

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def levels_of(files: DataFrame) -> DataFrame:
    return files.where("status = 'ok'").select("path", F.explode("level_index").alias("l")).select("path", "l.*")


def metadata_of(files: DataFrame) -> DataFrame:
    return files.where("status = 'ok'").select("path", F.explode("metadata").alias("m")).select("path", "m.*")


def samples_of(files: DataFrame) -> DataFrame:
    return files.where("status = 'ok'").select("path", F.posexplode("samples").alias("sample", "s")).select("path", "sample", "s.*")


# ------------------------------------------------------------------ writing


def _pad(raw: bytes, n: int) -> bytes:
    return raw + bytes(-len(raw) % n)


def basic_descriptor(samples, model: int = 1, primaries: int = 1, transfer: int = 1, flags: int = 0, block=(0, 0, 0, 0), planes=(0,) * 8) -> bytes:
    """A format descriptor with one basic block; ``samples`` as in SAMPLE."""
    size = 24 + 16 * len(samples)
    head = struct.pack("<IIHH4B4B8B", size + 4, 0, 2, size, model, primaries, transfer, flags, *block, *planes)
    return head + b"".join(struct.pack("<HBB4BII", o, n - 1, c | q << 4, *(more[0] if more else (0,) * 4), lo, hi) for o, n, c, q, lo, hi, *more in samples)


def build(
    vk_format: int,
    type_size: int,
    size: tuple[int, int, int],
    level_bytes: list[bytes],
    descriptor: bytes,
    metadata: dict[str, bytes] | None = None,
    layers: int = 0,
    faces: int = 1,
    scheme: int = NONE,
    alignment: int = 4,
    level: int | None = None,
) -> bytes:
    """A container; keys are sorted by code point, unknown reserved keys are refused."""
    from ..operators.validate import KNOWN_KEYS

    metadata = metadata or {}
    if odd := [k for k in metadata if k.lower().startswith("ktx") and k not in KNOWN_KEYS]:
        raise ValueError(f"reserved keys: {odd}")
    pairs = b"".join(struct.pack("<I", len(e)) + _pad(e, 4) for k in sorted(metadata, key=str.encode) for e in (k.encode() + b"\0" + metadata[k],))
    dfd_at = 80 + 24 * len(level_bytes)
    kvd_at = dfd_at + len(descriptor) if pairs else 0
    out = bytearray(dfd_at)
    out += descriptor + pairs
    stored = [deflate(b, scheme, level) for b in level_bytes]
    index = [(0, 0, 0)] * len(stored)
    for k in reversed(range(len(stored))):  # smallest level first
        out += bytes(-len(out) % (alignment if scheme == NONE else 1))
        index[k] = (len(out), len(stored[k]), len(level_bytes[k]))
        out += stored[k]
    out[:80] = IDENTIFIER + struct.pack("<9I4I2Q", vk_format, type_size, *size, layers, faces, len(stored), scheme, dfd_at, len(descriptor), kvd_at, len(pairs), 0, 0)
    for k, entry in enumerate(index):
        struct.pack_into("<3Q", out, 80 + 24 * k, *entry)
    return bytes(out)


@F.pandas_udf(T.BinaryType())
def _deflated(raw: pd.Series, scheme: pd.Series) -> pd.Series:
    return pd.Series([deflate(b, s) for b, s in zip(raw, scheme, strict=True)])


@F.pandas_udf(T.BinaryType())
def _inflated(raw: pd.Series, scheme: pd.Series) -> pd.Series:
    return pd.Series([inflate(b, s) for b, s in zip(raw, scheme, strict=True)])


def deflate_column(raw: Column, scheme: int) -> Column:
    return _deflated(raw, F.lit(scheme))


def inflate_column(raw: Column, scheme: int) -> Column:
    return _inflated(raw, F.lit(scheme))
