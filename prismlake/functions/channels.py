"""Operations on the channels of a pixel."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import bits, color


def swizzle(rgba: list[Column], pattern: str, one: Column) -> list[Column]:
    """Channels picked by letter; ``0`` and ``1`` are constants. A pattern is four of ``rgba01``."""
    if len(pattern) != 4 or set(pattern) - set("rgba01"):
        raise ValueError(f"no swizzle: {pattern!r}")
    known = {**dict(zip("rgba", rgba, strict=True)), "0": F.lit(0), "1": one}
    return [known[c] for c in pattern]


def expand(channels: list[Column], one: Column) -> list[Column]:
    """To four channels: missing colours are 0, missing alpha is full."""
    return [*channels, *[F.lit(0)] * (3 - len(channels)), *([one] if len(channels) < 4 else [])][:4]


def premultiply(rgb: list[Column], alpha: Column, depth: int, srgb: bool = False) -> list[Column]:
    """Colour codes times alpha; sRGB codes are decoded and encoded again around it."""
    a = bits.unorm_to_float(alpha, depth)
    out = []
    for c in rgb:
        v = bits.unorm_to_float(c, depth)
        v = color.srgb_encode(color.srgb_decode(v) * a) if srgb else v * a
        out.append(bits.float_to_unorm(v, depth))
    return out


def normalize(xyz: list[Column], depth: int) -> list[Column]:
    """Codes read as a vector of components in [-1, 1], scaled to unit length; a zero vector stays."""
    v = [2 * bits.unorm_to_float(c, depth) - 1 for c in xyz]
    size = F.sqrt(sum((c * c for c in v), F.lit(0.0)))
    return [F.when(size == 0, c).otherwise(bits.float_to_unorm((n / size + 1) / 2, depth)) for c, n in zip(xyz, v, strict=True)]


def map_range(v: Column, scale: Column, offset: Column) -> Column:
    """Alpha is not mapped; callers leave it out."""
    return v * scale + offset
