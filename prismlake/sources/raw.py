"""Raw images: files that hold nothing but the bytes of one image of a stated format and size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import formats
from .either import COLUMNS


def parsed(files: DataFrame, vk_format: int, width: int, height: int, depth: int = 0, layers: int = 0, faces: int = 1) -> DataFrame:
    """(path, content) rows to the columns of ``either``, so that ``either.rewritten`` makes containers of them.

    A file of another size than the format needs keeps its path and a status
    that says so, with null for the rest; a format that is not in the table is
    refused.
    """
    known = {r[0]: r for r in formats.rows() if r[0]}
    if vk_format not in known:
        raise ValueError(f"no format of number {vk_format}")
    _, _, _, bw, bh, size, type_size, *_ = known[vk_format]
    wanted = -(-width // bw) * -(-max(height, 1) // bh) * max(depth, 1) * max(layers, 1) * faces * size
    found = F.coalesce(F.length("content"), F.lit(0))
    fits = found == wanted
    facts = {"version": 2, "vk_format": vk_format, "type_size": type_size, "width": width, "height": height, "depth": depth, "layers": layers, "faces": faces, "levels": 1}
    rows = files.select("path", "content", F.when(fits, "ok").otherwise(F.concat(found.cast("string"), F.lit(f" bytes instead of {wanted}"))).alias("status"))
    kinds = {"version": "int"}
    pairs = F.array().cast("array<struct<key:string,value:binary>>")
    return rows.select(
        "path", "status", *[F.when(F.col("status") == "ok", v).cast(kinds.get(n, "long")).alias(n) for n, v in facts.items()], F.when(F.col("status") == "ok", pairs).alias("metadata"), F.when(F.col("status") == "ok", F.array("content")).alias("level_bytes")
    ).select(COLUMNS)
