"""Containers of both versions in one table, and their rewriting as version 2 files."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import descriptor, formats
from . import container, legacy

COLUMNS = ["path", "status", "version", "vk_format", "type_size", "width", "height", "depth", "layers", "faces", "levels", "metadata", "level_bytes"]


def read(spark: SparkSession, path: str) -> DataFrame:
    """Files under ``path`` by the version that their identifier states."""
    return parsed(spark.read.format("binaryFile").option("pathGlobFilter", "*").load(path))


def parsed(files: DataFrame) -> DataFrame:
    """(path, content) rows to COLUMNS; a file of neither version keeps its status, with null for the rest."""
    old = F.substring("content", 1, 12) == F.lit(container.IDENTIFIER_V1)
    pairs = F.transform("metadata", lambda m: F.struct(m["key"].alias("key"), m["value"].alias("value")))
    two = container.parsed(files.where(~F.coalesce(old, F.lit(False)))).withColumns({"metadata": pairs, "level_bytes": F.transform("level_index", lambda x: x["bytes"])})
    one = legacy.parsed(files.where(old))
    broken = one.where("status <> 'ok'").select("path", "status").withColumn("version", F.lit(1))
    good = legacy.to_version2(one).withColumns({"status": F.lit("ok"), "version": F.lit(1)})
    return two.select(COLUMNS).unionByName(good.select(COLUMNS)).unionByName(broken, allowMissingColumns=True)


def rewritten(rows: DataFrame, scheme: int = container.NONE) -> DataFrame:
    """(path, content): a version 2 file of each row of COLUMNS whose format has a known descriptor; others are left out."""
    known = {r[0]: r for r in formats.rows() if r[0]}

    def build(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                f = known.get(int(r.vk_format))
                model, samples = descriptor.expected(f[1], f[5], f[7]) if f else (0, None)
                if samples is None:
                    continue
                transfer = descriptor.SRGB if f[8] else 1
                block = container.basic_descriptor([(*s,) for s in samples], model=model, transfer=transfer, block=(f[3] - 1, f[4] - 1, 0, 0), planes=(f[5], *[0] * 7))
                pairs = {m["key"]: bytes(m["value"]) for m in (r.metadata if r.metadata is not None else [])}
                size = (int(r.width), int(r.height), int(r.depth))
                out.append((r.path, container.build(int(r.vk_format), int(r.type_size), size, [bytes(b) for b in r.level_bytes], block, pairs, int(r.layers), int(r.faces), scheme)))
            yield pd.DataFrame(out, columns=["path", "content"])

    names = ["path", "vk_format", "type_size", "width", "height", "depth", "layers", "faces", "metadata", "level_bytes"]
    return rows.where("status = 'ok' AND vk_format IS NOT NULL").select(names).mapInPandas(build, "path string, content binary")
