"""Version 1 containers: a parser, and the projection of their rows to version 2 columns."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .container import IDENTIFIER_V1

ENDIAN = 0x04030201
SCHEMA = (
    "path string, status string, gl_type bigint, gl_type_size bigint, gl_format bigint, gl_internal_format bigint, gl_base_format bigint, width bigint, height bigint, depth bigint, "
    "layers bigint, faces bigint, levels bigint, metadata array<struct<ordinal:int,key:string,value:binary>>, level_bytes array<binary>"
)
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]

#: Internal formats to version 2 formats; those that are not listed have none (0).
FORMATS = {0x8229: 9, 0x822B: 16, 0x8051: 23, 0x8C41: 29, 0x8058: 37, 0x8C43: 43, 0x822A: 70, 0x822C: 77, 0x805B: 91, 0x881A: 97, 0x8814: 109, 0x8D62: 4, 0x83F0: 131, 0x83F1: 133, 0x83F2: 135, 0x83F3: 137, 0x9274: 147, 0x9278: 151}


def parse(raw: bytes, path: str = "") -> tuple:
    """One file to one row of SCHEMA. Both byte orders are read; rows of a level are padded to 4."""
    bad = lambda status: (path, status, *[None] * (len(NAMES) - 2))
    if raw[:12] != IDENTIFIER_V1:
        return bad("unknown identifier")
    if len(raw) < 64:
        return bad("unexpected end")
    order = "<" if struct.unpack_from("<I", raw, 12)[0] == ENDIAN else ">"
    mark, kind, size, fmt, internal, base, w, h, d, layers, faces, levels, kv = struct.unpack_from(f"{order}13I", raw, 12)
    if mark != ENDIAN:
        return bad("unknown byte order")
    pairs, at, end = [], 64, 64 + kv
    while at + 4 <= end:
        (n,) = struct.unpack_from(f"{order}I", raw, at)
        key, _, value = raw[at + 4 : at + 4 + n].partition(b"\0")
        pairs.append((len(pairs), key.decode("utf-8", "replace"), value))
        at += 4 + -(-n // 4) * 4
    at, out = end, []
    for _ in range(max(levels, 1)):
        if at + 4 > len(raw):
            return bad("unexpected end")
        (n,) = struct.unpack_from(f"{order}I", raw, at)
        # the size of a cube map's level is that of one face
        n *= 6 if faces == 6 and layers == 0 else 1
        body = raw[at + 4 : at + 4 + n]
        if len(body) < n:
            return bad("unexpected end")
        if order == ">" and size in (2, 4):
            body = struct.pack(f"<{n // size}{'H' if size == 2 else 'I'}", *struct.unpack(f">{n // size}{'H' if size == 2 else 'I'}", body))
        out.append(body)
        at += 4 + -(-n // 4) * 4
    return (path, "ok", kind, size, fmt, internal, base, w, h, d, layers, faces, levels, pairs, out)


def parsed(files: DataFrame) -> DataFrame:
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([parse(c or b"", p) for p, c in zip(pdf["path"], pdf["content"], strict=True)], columns=NAMES).astype({n: "Int64" for n in NAMES[2:13]})

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def _orientation(value: Column, dims: Column) -> Column:
    """``S=r,T=d,R=i`` to its letters, as many as there are dimensions."""
    return F.substring(F.array_join(F.transform(F.split(value, ","), lambda p: F.substring_index(p, "=", -1)), ""), 1, dims)


def to_version2(files: DataFrame) -> DataFrame:
    """Version 2 columns and metadata: of the reserved keys only orientation and writer survive."""
    known = F.create_map(*[F.lit(x).cast("bigint") for kv in FORMATS.items() for x in kv])
    dims = F.when(F.col("depth") > 0, 3).when(F.col("height") > 0, 2).otherwise(1)
    kept = F.filter("metadata", lambda m: ~m["key"].startswith("KTX") | m["key"].isin("KTXorientation", "KTXwriter"))

    def converted(m: Column) -> Column:
        letters = F.encode(F.concat(_orientation(F.regexp_replace(F.decode(m["value"], "UTF-8"), "\0", ""), F.col("_dims")), F.lit("\0")), "UTF-8")
        return F.struct(m["key"].alias("key"), F.when(m["key"] == "KTXorientation", letters).otherwise(m["value"]).alias("value"))

    out = files.where("status = 'ok'").withColumn("_dims", dims)
    return out.select(
        "path",
        F.coalesce(known[F.col("gl_internal_format")], F.lit(0)).alias("vk_format"),
        F.greatest("gl_type_size", F.lit(1)).alias("type_size"),
        "width",
        "height",
        "depth",
        "layers",
        "faces",
        "levels",
        F.array_sort(F.transform(kept, converted)).alias("metadata"),
        "level_bytes",
    )
