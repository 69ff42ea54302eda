"""Containers deflated anew: levels compressed, the index rebuilt, writer and parameters told."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rewrite import deflation
from . import container

OPTION = {container.ZSTD: "--zstd", container.ZLIB: "--zlib"}


def deflated(files: DataFrame, scheme: int, level: int, tool: str) -> DataFrame:
    """(path, status, content) of (path, content) rows; content is null where a file cannot be read or has a scheme of its own code books."""
    parsed = container.parsed(files, payload=False)
    value = lambda key: F.element_at(F.filter("metadata", lambda m: m["key"] == key), 1)["value"]
    text = lambda key: F.when(F.size(F.filter("metadata", lambda m: m["key"] == key)) > 0, F.regexp_replace(value(key).cast("string"), "\\x00$", ""))
    writer, params = deflation(text("KTXwriter"), text("KTXwriterScParams"), tool, f"{OPTION[scheme]} {level}")
    told = parsed.select("path", "status", "sc_scheme", writer.alias("writer"), params.alias("params"))

    def run(batches):
        for pdf in batches:
            out = []
            for path, status, own, writer, params, raw in zip(*(pdf[c] for c in ("path", "status", "sc_scheme", "writer", "params", "content")), strict=True):
                if status == "ok" and own not in (container.NONE, container.ZSTD, container.ZLIB):
                    status = "other supercompression"
                row = dict(zip(container.NAMES, container.parse(raw or b""), strict=True))
                if status == "ok":
                    status = row["status"]
                content = None
                if status == "ok":
                    pairs = {k: v for _, k, v in row["metadata"]} | {"KTXwriter": writer.encode() + b"\0", "KTXwriterScParams": params.encode() + b"\0"}
                    block = raw[row["dfd_offset"] : row["dfd_offset"] + row["dfd_length"]]
                    size = (row["width"], row["height"], row["depth"])
                    content = container.build(row["vk_format"], row["type_size"], size, [x[4] for x in row["level_index"]], block, pairs, row["layers"], row["faces"], scheme, level=level)
                out.append((path, status, content))
            yield pd.DataFrame(out, columns=["path", "status", "content"])

    both = told.join(files.select("path", "content"), "path")
    return both.mapInPandas(run, "path string, status string, content binary")
