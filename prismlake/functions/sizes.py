"""Block-rounded image sizes, alignments and mip level counts, as integer columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def long(c: Column) -> Column:
    return c.cast("long")


def ceil_div(a: Column, b: Column) -> Column:
    return long(F.floor((a + b - 1) / b))


def align(x: Column, n: Column) -> Column:
    """x rounded up to a multiple of n."""
    return ceil_div(x, n) * n


def lcm4(n: Column) -> Column:
    """Least common multiple with 4, by the two lowest bits."""
    low = n.bitwiseAND(F.lit(3))
    return long(F.when(low == 0, n).when(low == 2, n * 2).otherwise(n * 4))


def level_count(*dims: Column) -> Column:
    """1 + floor(log2(largest dimension))."""
    most = F.greatest(*dims) if len(dims) > 1 else dims[0]
    return long(F.length(F.bin(F.greatest(most, F.lit(1)))))


def at_level(dim: Column, level: Column) -> Column:
    """A dimension at a mip level, at least 1."""
    return long(F.greatest(F.lit(1), F.expr("1") * F.call_function("shiftright", dim, level.cast("int"))))


def image_bytes(width: Column, height: Column, block_w: Column, block_h: Column, block_bytes: Column) -> Column:
    """Bytes of one image of the given size."""
    return ceil_div(width, block_w) * ceil_div(height, block_h) * block_bytes
