"""Colour: transfer functions, primaries and the full transform, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(v: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(v, F.lit(lo)), F.lit(hi))


def linear(v: Column) -> Column:
    return v


def gamma_decode(v: Column, gamma: float) -> Column:
    return clamp(F.pow(v, F.lit(gamma)))


def gamma_encode(v: Column, gamma: float) -> Column:
    return clamp(F.pow(v, F.lit(1 / gamma)))


def srgb_encode(v: Column) -> Column:
    """Intensity to code value; not clamped."""
    return F.when(v < 0.0031308, 12.92 * v).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)


def srgb_decode(v: Column) -> Column:
    return clamp(F.when(v < 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4))))


# The broadcast curve: a power of GAMMA above the cut-off, a line below that meets it in value.
ITU_CUT, ITU_SLOPE, ITU_GAMMA = 0.018, 4.5, 0.45
#: Offset for which both parts meet: SLOPE * CUT = (1 + e) * CUT**GAMMA - e.
ITU_EXPAND = (ITU_SLOPE * ITU_CUT - ITU_CUT**ITU_GAMMA) / (ITU_CUT**ITU_GAMMA - 1)


def itu_encode(v: Column) -> Column:
    return F.when(v < ITU_CUT, v * ITU_SLOPE).otherwise((1 + ITU_EXPAND) * F.pow(v, F.lit(ITU_GAMMA)) - ITU_EXPAND)


def itu_decode(v: Column) -> Column:
    return clamp(F.when(v < ITU_CUT * ITU_SLOPE, v / ITU_SLOPE).otherwise(F.pow((v + ITU_EXPAND) / (1 + ITU_EXPAND), F.lit(1 / ITU_GAMMA))))


# Perceptual quantiser, fixed values of the published standard (SMPTE ST 2084).
PQ_M1, PQ_M2, PQ_C1, PQ_C2, PQ_C3 = 0.1593017578125, 78.84375, 0.8359375, 18.8515625, 18.6875


def pq_encode(v: Column) -> Column:
    """Intensity (1 is 10000 nits) to code value."""
    y = F.pow(F.greatest(v, F.lit(0.0)), F.lit(PQ_M1))
    return F.pow((PQ_C1 + PQ_C2 * y) / (1 + PQ_C3 * y), F.lit(PQ_M2))


def pq_decode(v: Column) -> Column:
    e = F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / PQ_M2))
    return F.pow(F.greatest(e - PQ_C1, F.lit(0.0)) / (PQ_C2 - PQ_C3 * e), F.lit(1 / PQ_M1))


# Chromaticities (x, y) of red, green, blue and white; fixed values of the published standards.
PRIMARIES = {
    "bt709": ((0.64, 0.33), (0.30, 0.60), (0.15, 0.06), (0.3127, 0.3290)),
    "bt601_ebu": ((0.64, 0.33), (0.29, 0.60), (0.15, 0.06), (0.3127, 0.3290)),
    "bt601_smpte": ((0.63, 0.34), (0.31, 0.595), (0.155, 0.07), (0.3127, 0.3290)),
    "bt2020": ((0.708, 0.292), (0.170, 0.797), (0.131, 0.046), (0.3127, 0.3290)),
    "aces": ((0.7347, 0.2653), (0.0, 1.0), (0.0001, -0.077), (0.32168, 0.33767)),
    "acescc": ((0.713, 0.293), (0.165, 0.830), (0.128, 0.044), (0.32168, 0.33767)),
    "ntsc1953": ((0.67, 0.33), (0.21, 0.71), (0.14, 0.08), (0.310, 0.316)),
    "pal525": ((0.630, 0.340), (0.310, 0.595), (0.155, 0.070), (0.3101, 0.3162)),
    "displayp3": ((0.680, 0.320), (0.265, 0.690), (0.150, 0.060), (0.3127, 0.3290)),
    "adobergb": ((0.64, 0.33), (0.21, 0.71), (0.15, 0.06), (0.3127, 0.3290)),
}


def to_xyz(name: str):
    """3x3 matrix from linear RGB to CIE XYZ, derived from the chromaticities."""
    import numpy as np

    *rgb, white = PRIMARIES[name]
    lift = lambda p: np.array([p[0] / p[1], 1.0, (1 - p[0] - p[1]) / p[1]])
    if any(p[1] == 0 for p in rgb):
        raise ValueError(name)
    columns = np.column_stack([lift(p) for p in rgb])
    return columns * np.linalg.solve(columns, lift(white))


def conversion(source: str, target: str) -> list[list[float]]:
    """Matrix from one set of primaries to another; white keeps its place if both share it."""
    import numpy as np

    return (np.linalg.inv(to_xyz(target)) @ to_xyz(source)).tolist()


def convert_primaries(rgb: list[Column], source: str, target: str) -> list[Column]:
    return [sum((float(m) * c for m, c in zip(row, rgb, strict=True)), F.lit(0.0)) for row in conversion(source, target)]


def transform(rgb: list[Column], decode, encode, source: str, target: str, top: int) -> list[Column]:
    """Decode, convert primaries, encode, round to ``top`` codes and clamp. Alpha is not part of it."""
    linear_ = convert_primaries([decode(c) for c in rgb], source, target)
    return [clamp(F.floor(encode(F.greatest(c, F.lit(0.0))) * top + 0.5), 0.0, float(top)).cast("long") for c in linear_]
