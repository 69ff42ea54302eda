"""Portable any-maps (PBM family): binary grey and colour images, several in one file."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "path string, subimage int, status string, width int, height int, channels int, bits int, max_value int, pixels array<int>"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_HEADER = re.compile(rb"\s*(P[56])\s(?:\s|#[^\n]*\n)*(\d+)\s(?:\s|#[^\n]*\n)*(\d+)\s(?:\s|#[^\n]*\n)*(\d+)\s")


def parse(raw: bytes, path: str = "") -> list[tuple]:
    """One row per image of the file; pixels are row-major and interleaved."""
    out, at = [], 0
    while raw[at:].strip():
        m = _HEADER.match(raw, at)
        if not m:
            out.append((path, len(out), "no image", *[None] * 6))
            break
        w, h, top = (int(x) for x in m.groups()[1:])
        channels = 1 if m[1] == b"P5" else 3
        size = 1 if top < 256 else 2
        at, n = m.end(), w * h * channels * size
        body = raw[at : at + n]
        if len(body) < n or not 0 < top < 65536:
            out.append((path, len(out), "unexpected end", *[None] * 6))
            break
        pixels = list(body) if size == 1 else [a << 8 | b for a, b in zip(body[::2], body[1::2], strict=True)]
        out.append((path, len(out), "ok", w, h, channels, 8 * size, top, pixels))
        at += n
    return out


def parsed(files: DataFrame) -> DataFrame:
    def run(batches):
        for pdf in batches:
            rows = [r for p, c in zip(pdf["path"], pdf["content"], strict=True) for r in parse(c or b"", p)]
            yield pd.DataFrame(rows, columns=NAMES).astype({n: "Int32" for n in NAMES[3:8]})

    return files.select("path", "content").mapInPandas(run, SCHEMA)


def write(pixels: list[int], width: int, height: int, channels: int, top: int = 255) -> bytes:
    head = f"P{5 if channels == 1 else 6}\n{width} {height}\n{top}\n".encode()
    return head + (bytes(pixels) if top < 256 else b"".join(p.to_bytes(2, "big") for p in pixels))
