"""Bit depths, packed fields and number formats, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def top(bits: int) -> int:
    return (1 << bits) - 1


def unorm_to_float(v: Column, bits: int) -> Column:
    return v.cast("double") / float(top(bits))


def snorm_to_float(v: Column, bits: int) -> Column:
    return F.greatest(v.cast("double") / float(top(bits - 1)), F.lit(-1.0))


def float_to_unorm(v: Column, bits: int) -> Column:
    """NaN and negative to 0, above 1 to the top code, else rounded half up."""
    return F.when(F.isnan(v) | (v < 0), 0).when(v > 1, top(bits)).otherwise(F.floor(v * top(bits) + 0.5)).cast("long")


def rescale_unorm(v: Column, source: int, target: int) -> Column:
    """More bits: the pattern repeats into the new low bits. Fewer: round by the highest dropped bit, saturating."""
    v = v.cast("long")
    if target == source:
        return v
    if target < source:
        up = F.shiftright(v, source - target) + F.shiftright(v, source - target - 1).bitwiseAND(F.lit(1))
        return F.least(up, F.lit(top(target))).cast("long")
    out, left = F.lit(0).cast("long"), target
    while left > 0:
        left -= source
        out = out.bitwiseOR(F.shiftleft(v, left) if left >= 0 else F.shiftright(v, -left))
    return out


def rescale_uint(v: Column, target: int) -> Column:
    return v.cast("long").bitwiseAND(F.lit(top(target)))


def rescale_sint(v: Column, source: int, target: int) -> Column:
    """Keeps the sign bit and the lowest bits."""
    sign = F.shiftright(v, source - 1).bitwiseAND(F.lit(1))
    return F.shiftleft(sign, target - 1).bitwiseOR(v.cast("long").bitwiseAND(F.lit(top(target - 1)))).cast("long")


def field(v: Column, offset: int, bits: int) -> Column:
    """An unsigned bit field."""
    return F.shiftrightunsigned(v.cast("long"), offset).bitwiseAND(F.lit(top(bits)))


def little_endian(raw: Column, at: Column, size: int) -> Column:
    """The unsigned number of ``size`` bytes (7 at most) at a place of a binary column; null where it ends before."""
    text = F.hex(raw.substr((at + 1).cast("int"), F.lit(size)))
    turned = F.concat(*[F.substring(text, 2 * i + 1, 2) for i in reversed(range(size))])
    return F.when(at + size <= F.length(raw), F.conv(turned, 16, 10).cast("long"))


def little_endian_hex(v: Column, size: int) -> Column:
    """The reverse as hexadecimal text: a number's lowest ``size`` bytes, lowest first."""
    text = F.lpad(F.hex(v.cast("long")), 16, "0")
    return F.concat(*[F.substring(text, 15 - 2 * i, 2) for i in range(size)])


def sign_extend(v: Column, bits: int) -> Column:
    v = v.cast("long")
    return F.shiftright(F.shiftleft(v, 64 - bits), 64 - bits)


def pack(values: list[Column], widths: list[int]) -> Column:
    """Fields from the highest bits down."""
    out, at = F.lit(0).cast("long"), sum(widths)
    for v, w in zip(values, widths, strict=True):
        at -= w
        out = out.bitwiseOR(F.shiftleft(v.cast("long").bitwiseAND(F.lit(top(w))), at))
    return out


def small_float(v: Column, exponent: int, mantissa: int, signed: bool) -> Column:
    """A packed float with an exponent of ``exponent`` bits (half: 5, 10, signed); infinities and NaN come out as such."""
    m = field(v, 0, mantissa).cast("double") / float(1 << mantissa)
    e = field(v, mantissa, exponent)
    bias = (1 << (exponent - 1)) - 1
    x = F.when(e == 0, m * 2.0 ** (1 - bias)).when(e == top(exponent), F.when(m == 0, float("inf")).otherwise(float("nan"))).otherwise((1 + m) * F.pow(F.lit(2.0), (e - bias).cast("double")))
    return F.when(field(v, mantissa + exponent, 1) == 1, -x).otherwise(x) if signed else x


def half_to_float(v: Column) -> Column:
    return small_float(v, 5, 10, True)


def shared_exponent(v: Column) -> list[Column]:
    """Red, green and blue of a 9-9-9 mantissa and 5-bit exponent word."""
    scale = F.pow(F.lit(2.0), (field(v, 27, 5) - 24).cast("double"))
    return [field(v, 9 * i, 9).cast("double") * scale for i in range(3)]


def pack_shared_exponent(rgb: list[Column]) -> Column:
    """The reverse; values are clamped to the largest that fits."""
    most = 511 / 512 * 65536.0
    rgb = [F.least(F.greatest(F.when(F.isnan(c), 0.0).otherwise(c), F.lit(0.0)), F.lit(most)) for c in rgb]
    peak = F.greatest(*rgb)
    e = F.greatest(F.lit(-16.0), F.floor(F.log2(F.greatest(peak, F.lit(1e-12)))).cast("double")) + 16
    full = F.floor(peak / F.pow(F.lit(2.0), e - 24) + 0.5) == 512
    e = F.when(full, e + 1).otherwise(e)
    codes = [F.floor(c / F.pow(F.lit(2.0), e - 24) + 0.5).cast("long") for c in rgb]
    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(c, 9 * i) for i, c in enumerate(codes)] + [F.shiftleft(e.cast("long"), 27)])


def swap_bytes(v: Column, size: int) -> Column:
    """A number of ``size`` bytes with its bytes in reverse order."""
    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(field(v, 8 * i, 8), 8 * (size - 1 - i)) for i in range(size)])
