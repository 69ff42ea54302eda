"""Queries over texels: packing to formats, decoding by layouts, and images from payloads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.bits import little_endian_hex
from ..operators import texels
from .registry import _PIXELS, _pixels, _r6, _t, query


def _le(n: str, size: int) -> str:
    return "(" + " || ".join(f"printf('%02X', (({n}) >> {8 * i}) & 255)" for i in range(size)) + ")"


def _fit(v: str, source: int, target: int) -> str:
    """A code of ``source`` bits with fewer bits: rounded by the highest dropped one."""
    d = source - target
    return f"least((({v}) >> {d}) + ((({v}) >> {d - 1}) & 1), {(1 << target) - 1})"


def _float_code(v: str, exponent: int, mantissa: int, cut: bool = False) -> str:
    """The code of a positive number."""
    bias = (1 << (exponent - 1)) - 1
    e = f"greatest(floor(log2({v})), {1 - bias})"
    return f"CAST((({e}) + {bias - 1}) * {1 << mantissa} + floor(({v}) / pow(2.0, ({e}) - {mantissa}){'' if cut else ' + 0.5'}) AS BIGINT)"


# ------------------------------------------------------------------ packing

_SOURCE = "s AS (SELECT p_partkey, p_partkey * 7 % 256 AS r, (p_partkey * 13 + p_size) % 256 AS g, p_size * 5 % 256 AS b, p_partkey * 3 % 256 AS a FROM part)"
_UNORM = {
    "R8G8B8A8_UNORM": _le("r | (g << 8) | (b << 16) | (a << 24)", 4),
    "B8G8R8_SRGB": _le("b | (g << 8) | (r << 16)", 3),
    "R4G4_UNORM_PACK8": _le(f"({_fit('r', 8, 4)} << 4) | {_fit('g', 8, 4)}", 1),
    "R5G6B5_UNORM_PACK16": _le(f"({_fit('r', 8, 5)} << 11) | ({_fit('g', 8, 6)} << 5) | {_fit('b', 8, 5)}", 2),
    "B5G6R5_UNORM_PACK16": _le(f"({_fit('b', 8, 5)} << 11) | ({_fit('g', 8, 6)} << 5) | {_fit('r', 8, 5)}", 2),
    "R4G4B4A4_UNORM_PACK16": _le(f"({_fit('r', 8, 4)} << 12) | ({_fit('g', 8, 4)} << 8) | ({_fit('b', 8, 4)} << 4) | {_fit('a', 8, 4)}", 2),
    "A1R5G5B5_UNORM_PACK16": _le(f"({_fit('a', 8, 1)} << 15) | ({_fit('r', 8, 5)} << 10) | ({_fit('g', 8, 5)} << 5) | {_fit('b', 8, 5)}", 2),
    "A1B5G5R5_UNORM_PACK16": _le(f"({_fit('a', 8, 1)} << 15) | ({_fit('b', 8, 5)} << 10) | ({_fit('g', 8, 5)} << 5) | {_fit('r', 8, 5)}", 2),
    "A4B4G4R4_UNORM_PACK16": _le(f"({_fit('a', 8, 4)} << 12) | ({_fit('b', 8, 4)} << 8) | ({_fit('g', 8, 4)} << 4) | {_fit('r', 8, 4)}", 2),
    "A2B10G10R10_UNORM_PACK32": _le(f"({_fit('a', 8, 2)} << 30) | (((b << 2) | (b >> 6)) << 20) | (((g << 2) | (g >> 6)) << 10) | ((r << 2) | (r >> 6))", 4),
    "R16G16_UNORM": _le("(r * 257) | ((g * 257) << 16)", 4),
    "R10X6G10X6_UNORM_2PACK16": _le("((r * 257) & 65472) | (((g * 257) & 65472) << 16)", 4),
    "R12X4_UNORM_PACK16": _le("(r * 257) & 65520", 2),
    "A8_UNORM": _le("a", 1),
}


@query("WITH " + _SOURCE + " " + " UNION ALL ".join(f"SELECT p_partkey, '{n}' AS format, {sql} AS texel FROM s" for n, sql in _UNORM.items()))
def pack_texels(spark, sf):
    k, z = F.col("p_partkey"), F.col("p_size")
    rgba = [k * 7 % 256, (k * 13 + z) % 256, z * 5 % 256, k * 3 % 256]
    made = F.array(*[F.struct(F.lit(n).alias("format"), F.hex(texels.packed(rgba, texels.layout(n))).alias("texel")) for n in _UNORM])
    return _t(spark, sf, "part").select("p_partkey", F.explode(made).alias("m")).select("p_partkey", "m.*")


_NUMBERS = """n AS (SELECT p_partkey, p_partkey * 2654435761 % 4294967296 AS u0, (p_partkey * 40503 + p_size) % 65536 AS u1, p_size * 77 AS u2, p_partkey AS u3, p_size * 31 - 700 AS i0, 300 - p_partkey % 611 AS i1,
  CAST(CAST((p_partkey % 997 + 1) / 7.0 * pow(2.0, p_size % 12 - 6) AS FLOAT) AS DOUBLE) AS x, CAST(CAST((p_size + 1) / 3.0 * pow(2.0, p_partkey % 9 - 9) AS FLOAT) AS DOUBLE) AS y, CAST(CAST((p_partkey % 31 + 1) / 5.0 AS FLOAT) AS DOUBLE) AS z FROM part)"""
_E9 = "(greatest(-16, floor(log2(greatest(x, y, z)))) + 16 + CASE WHEN floor(greatest(x, y, z) / pow(2.0, greatest(-16, floor(log2(greatest(x, y, z)))) - 8) + 0.5) = 512 THEN 1 ELSE 0 END)"
_NUMBER_FORMATS = {
    "A2R10G10B10_UINT_PACK32": ("uint", _le("((u3 & 3) << 30) | ((u0 & 1023) << 20) | ((u1 & 1023) << 10) | (u2 & 1023)", 4)),
    "R16G16B16A16_UINT": ("uint", _le("u0 & 65535", 2) + " || " + _le("u1", 2) + " || " + _le("u2 & 65535", 2) + " || " + _le("u3 & 65535", 2)),
    "R32G32_UINT": ("uint", _le("u0", 4) + " || " + _le("u1", 4)),
    "R8G8_SINT": ("sint", _le("i0 & 255", 1) + " || " + _le("i1 & 255", 1)),
    "A2B10G10R10_SINT_PACK32": ("sint", _le("(1 << 30) | ((CASE WHEN i1 < 0 THEN 512 ELSE 0 END | (i1 & 511)) << 10) | (CASE WHEN i0 < 0 THEN 512 ELSE 0 END | (i0 & 511))", 4)),
    "R16G16_SFLOAT": ("float", _le(f"{_float_code('x', 5, 10)} | ({_float_code('y', 5, 10)} << 16)", 4)),
    "R32G32B32_SFLOAT": ("float", " || ".join(_le(_float_code(v, 8, 23), 4) for v in "xyz")),
    "B10G11R11_UFLOAT_PACK32": ("float", _le(f"{_float_code('x', 5, 6, True)} | ({_float_code('y', 5, 6, True)} << 11) | ({_float_code('z', 5, 5, True)} << 22)", 4)),
    "E5B9G9R9_UFLOAT_PACK32": ("float", _le(" | ".join(f"(CAST(floor({v} / pow(2.0, {_E9} - 24) + 0.5) AS BIGINT) << {9 * i})" for i, v in enumerate("xyz")) + f" | (CAST({_E9} AS BIGINT) << 27)", 4)),
}


@query("WITH " + _NUMBERS + " " + " UNION ALL ".join(f"SELECT p_partkey, '{n}' AS format, {sql} AS texel FROM n" for n, (_, sql) in _NUMBER_FORMATS.items()))
def pack_numbers(spark, sf):
    k, z = F.col("p_partkey"), F.col("p_size")
    real = lambda v, e: (v * F.pow(F.lit(2.0), e.cast("double"))).cast("float").cast("double")
    given = {
        "uint": [k * 2654435761 % 4294967296, (k * 40503 + z) % 65536, z * 77, k],
        "sint": [z * 31 - 700, 300 - k % 611, F.lit(0), F.lit(1)],
        "float": [real((k % 997 + 1) / 7.0, z % 12 - 6), real((z + 1) / 3.0, k % 9 - 9), ((k % 31 + 1) / 5.0).cast("float").cast("double")],
    }
    part = _t(spark, sf, "part")
    made = [part.select("p_partkey", F.lit(n).alias("format"), F.hex(texels.packed(given[s], texels.layout(n), s)).alias("texel")) for n, (s, _) in _NUMBER_FORMATS.items()]
    return reduce(lambda a, b: a.unionByName(b), made)


# ------------------------------------------------------------------ decoding

# Words without the codes of infinities in their floats; a made-up descriptor splits red in two.
_WORDS = "w AS (SELECT p_partkey, (p_partkey * 2654435761 + p_size * 97) % 4294967296 AS u, (p_partkey * 40503 + p_size * 65599) % 4294967296 AS v FROM part)"
_SPLIT = [(0, 3, 0, 0, 0, 63), (13, 3, 0, 0, 0, 63), (3, 10, 1, 0, 0, 1023)]


def _bits(u: str, at: int, n: int) -> str:
    return f"(({u} >> {at}) & {(1 << n) - 1})"


def _signed(u: str, at: int, n: int) -> str:
    return f"({_bits(u, at, n)} - CASE WHEN {_bits(u, at + n - 1, 1)} = 1 THEN {1 << n} ELSE 0 END)"


def _snorm(u: str, at: int, n: int) -> str:
    return f"greatest({_signed(u, at, n)} / {float((1 << (n - 1)) - 1)}, -1.0)"


def _small(u: str, at: int, e: int, m: int, signed: bool) -> str:
    bias = (1 << (e - 1)) - 1
    exp, man = _bits(u, at + m, e), _bits(u, at, m)
    plain = f"(CASE WHEN {exp} = 0 THEN {man} * pow(2.0, {1 - bias - m}) ELSE ({(1 << m)} + {man}) * pow(2.0, {exp} - {bias + m}) END)"
    return f"(CASE WHEN {_bits(u, at + e + m, 1)} = 1 THEN -1 ELSE 1 END * {plain})" if signed else plain


_DECODED = {
    "R8G8B8A8_SRGB": [f"{_bits('u', 8 * i, 8)} / 255.0" for i in range(4)],
    "B8G8R8A8_SNORM": [_snorm("u", i, 8) for i in (16, 8, 0, 24)],
    "R5G5B5A1_UNORM_PACK16": [f"{_bits('u', 11, 5)} / 31.0", f"{_bits('u', 6, 5)} / 31.0", f"{_bits('u', 1, 5)} / 31.0", _bits("u", 0, 1)],
    "A2R10G10B10_SNORM_PACK32": [_snorm("u", 20, 10), _snorm("u", 10, 10), _snorm("u", 0, 10), _snorm("u", 30, 2)],
    "A2B10G10R10_UINT_PACK32": [_bits("u", 0, 10), _bits("u", 10, 10), _bits("u", 20, 10), _bits("u", 30, 2)],
    "R16G16_UNORM": [f"{_bits('u', 0, 16)} / 65535.0", f"{_bits('u', 16, 16)} / 65535.0", "0", "1"],
    "R16G16B16A16_SINT": [_signed("u", 0, 16), _signed("u", 16, 16), _signed("v", 0, 16), _signed("v", 16, 16)],
    "R10X6G10X6_UNORM_2PACK16": [f"{_bits('u', 6, 10)} / 1023.0", f"{_bits('u', 22, 10)} / 1023.0", "0", "1"],
    "R16G16_SFIXED5": [f"{_signed('u', 0, 16)} / 32.0", f"{_signed('u', 16, 16)} / 32.0", "0", "1"],
    "R16_SFLOAT": [_small("(u & ~16384)", 0, 5, 10, True), "0", "0", "1"],
    "B10G11R11_UFLOAT_PACK32": [_small("(u & 2080111615)", 0, 5, 6, False), _small("(u & 2080111615)", 11, 5, 6, False), _small("(u & 2080111615)", 22, 5, 5, False), "1"],
    "E5B9G9R9_UFLOAT_PACK32": [f"{_bits('u', 9 * i, 9)} * pow(2.0, {_bits('u', 27, 5)} - 24)" for i in range(3)] + ["1"],
    "D16_UNORM_S8_UINT": [f"{_bits('u', 0, 16)} / 65535.0", _bits("u", 16, 8), "0", "1"],
    "X8_D24_UNORM_PACK32": [f"{_bits('u', 0, 24)} / 16777215.0", "0", "0", "1"],
    "D24_UNORM_S8_UINT": [f"{_bits('u', 8, 24)} / 16777215.0", _bits("u", 0, 8), "0", "1"],
    "split": [f"({_bits('u', 0, 3)} | ({_bits('u', 13, 3)} << 3)) / 63.0", f"{_bits('u', 3, 10)} / 1023.0", "0", "1"],
}
#: Bits cleared so that no float is infinite.
_CLEARED = {"R16_SFLOAT": 16384, "B10G11R11_UFLOAT_PACK32": 4294967295 - 2080111615}


@query("WITH " + _WORDS + " " + " UNION ALL ".join(f"SELECT p_partkey, '{n}' AS format, " + ", ".join(f"round(CAST({x} AS DOUBLE), 6) + 0.0 AS c{i}" for i, x in enumerate(xs)) + " FROM w" for n, xs in _DECODED.items()))
def decode_texels(spark, sf):
    k, z = F.col("p_partkey"), F.col("p_size")
    t = _t(spark, sf, "part").select("p_partkey", ((k * 2654435761 + z * 97) % 4294967296).alias("u"), ((k * 40503 + z * 65599) % 4294967296).alias("v"))

    def made(name: str):
        form = texels.from_samples(_SPLIT, 2) if name == "split" else texels.layout(name)
        u = F.col("u").bitwiseAND(F.lit(0xFFFFFFFF - _CLEARED.get(name, 0)))
        texel = F.unhex(F.concat(little_endian_hex(u, 4), little_endian_hex(F.col("v"), 4))).substr(F.lit(1), F.lit(form.size))
        return F.struct(F.lit(name).alias("format"), *[_r6(v).alias(f"c{i}") for i, v in enumerate(texels.values(texel, form))])

    parts = [t.select("p_partkey", made(n).alias("m")).select("p_partkey", "m.*") for n in _DECODED]
    return reduce(lambda a, b: a.unionByName(b), parts)


_HALF = "greatest(floor(log2(abs(v))), -14)"


@query(f"WITH {_PIXELS} SELECT vec_id, x, y, round(CASE WHEN v = 0 THEN 0 ELSE sign(v) * floor(abs(v) / pow(2.0, {_HALF} - 10) + 0.5) * pow(2.0, {_HALF} - 10) END, 6) + 0.0 AS value FROM px")
def image_texels(spark, sf):
    form = texels.layout("R16_SFLOAT")
    images = texels.payloads(_pixels(spark, sf), ["vec_id"], form, ["v"], "float").withColumns({"width": F.lit(8), "height": F.lit(8)})
    return texels.pixels(images, form).select("vec_id", "x", "y", _r6(F.col("c0")).alias("value"))
