"""The dimension table of pixel formats, built from the rules of the public numbering."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the public numbering: the first extension number, 4:2:2 and multi-planar formats, and formats of three-dimensional blocks.
FIRST_EXTENSION = 1000001000
PVRTC = (1000054000, 1000054007)
ASTC_FLOAT = (1000066000, 1000066013)
YCBCR = (1000156000, 1000156033)
YCBCR_444 = (1000330000, 1000330003)
A4_PACKED = (1000340000, 1000340001)
FIXED_16 = (1000464000, 1000464000)
A1_A8 = (1000470000, 1000470001)
ASTC_3D = (1000288000, 1000288029)
#: Of YCBCR those of half horizontal chroma, in one plane or more.
HALF_CHROMA = [0, 1, 4, 5, 10, 11, 14, 15, 20, 21, 24, 25, 27, 28, 31, 32]
#: Of YCBCR those of one plane, which are not prohibited.
ONE_PLANE = [0, 1, 7, 8, 9, 10, 11, 17, 18, 19, 20, 21, 27, 28]


def _within(vk_format: Column, ends: tuple[int, int]) -> Column:
    return vk_format.between(*ends)


def known_extension(vk_format: Column) -> Column:
    """Whether a number beyond the table is one of the public extension formats."""
    return reduce(lambda a, b: a | b, [_within(vk_format, e) for e in (PVRTC, ASTC_FLOAT, YCBCR, ASTC_3D, YCBCR_444, A4_PACKED, FIXED_16, A1_A8)])


def prohibited_extension(vk_format: Column) -> Column:
    """Formats of several planes."""
    return (_within(vk_format, YCBCR) & ~(vk_format - YCBCR[0]).isin(ONE_PLANE)) | _within(vk_format, YCBCR_444)


def half_chroma(vk_format: Column) -> Column:
    """4:2:2 formats."""
    return _within(vk_format, YCBCR) & (vk_format - YCBCR[0]).isin(HALF_CHROMA)


def block_3d(vk_format: Column) -> Column:
    return _within(vk_format, ASTC_3D)


_INT = ["UNORM", "SNORM", "USCALED", "SSCALED", "UINT", "SINT"]
_ASTC = [(4, 4), (5, 4), (5, 5), (6, 5), (6, 6), (8, 5), (8, 6), (8, 8), (10, 5), (10, 6), (10, 8), (10, 10), (12, 10), (12, 12)]


def rows() -> list[tuple]:
    """(format, name, channels, block width, block height, block bytes, type size, compressed, srgb)."""
    out: list[tuple] = []

    def add(name, channels, size, type_size, block=(1, 1), packed=False):
        out.append((len(out), name, channels, *block, size, 1 if block != (1, 1) else type_size, block != (1, 1), name.endswith(("SRGB", "SRGB_BLOCK", "SRGB_PACK32"))))

    add("UNDEFINED", 0, 0, 1)
    add("R4G4_UNORM_PACK8", 2, 1, 1)
    for n, c in (("R4G4B4A4", 4), ("B4G4R4A4", 4), ("R5G6B5", 3), ("B5G6R5", 3), ("R5G5B5A1", 4), ("B5G5R5A1", 4), ("A1R5G5B5", 4)):
        add(f"{n}_UNORM_PACK16", c, 2, 2)
    for n, c in (("R8", 1), ("R8G8", 2), ("R8G8B8", 3), ("B8G8R8", 3), ("R8G8B8A8", 4), ("B8G8R8A8", 4)):
        for t in [*_INT, "SRGB"]:
            add(f"{n}_{t}", c, c, 1)
    for t in [*_INT, "SRGB"]:
        add(f"A8B8G8R8_{t}_PACK32", 4, 4, 4)
    for n in ("A2R10G10B10", "A2B10G10R10"):
        for t in _INT:
            add(f"{n}_{t}_PACK32", 4, 4, 4)
    for n, c in (("R16", 1), ("R16G16", 2), ("R16G16B16", 3), ("R16G16B16A16", 4)):
        for t in [*_INT, "SFLOAT"]:
            add(f"{n}_{t}", c, 2 * c, 2)
    for b in (32, 64):
        for c in range(1, 5):
            for t in ("UINT", "SINT", "SFLOAT"):
                add("".join(f"{x}{b}" for x in "RGBA"[:c]) + f"_{t}", c, b // 8 * c, b // 8)
    add("B10G11R11_UFLOAT_PACK32", 3, 4, 4)
    add("E5B9G9R9_UFLOAT_PACK32", 3, 4, 4)
    for n, c, s, t in (("D16_UNORM", 1, 2, 2), ("X8_D24_UNORM_PACK32", 1, 4, 4), ("D32_SFLOAT", 1, 4, 4), ("S8_UINT", 1, 1, 1), ("D16_UNORM_S8_UINT", 2, 4, 2), ("D24_UNORM_S8_UINT", 2, 4, 4), ("D32_SFLOAT_S8_UINT", 2, 8, 4)):
        add(n, c, s, t)
    for n, c, s, kinds in (
        ("BC1_RGB", 3, 8, "UNORM SRGB"),
        ("BC1_RGBA", 4, 8, "UNORM SRGB"),
        ("BC2", 4, 16, "UNORM SRGB"),
        ("BC3", 4, 16, "UNORM SRGB"),
        ("BC4", 1, 8, "UNORM SNORM"),
        ("BC5", 2, 16, "UNORM SNORM"),
        ("BC6H", 3, 16, "UFLOAT SFLOAT"),
        ("BC7", 4, 16, "UNORM SRGB"),
        ("ETC2_R8G8B8", 3, 8, "UNORM SRGB"),
        ("ETC2_R8G8B8A1", 4, 8, "UNORM SRGB"),
        ("ETC2_R8G8B8A8", 4, 16, "UNORM SRGB"),
        ("EAC_R11", 1, 8, "UNORM SNORM"),
        ("EAC_R11G11", 2, 16, "UNORM SNORM"),
    ):
        for k in kinds.split():
            add(f"{n}_{k}_BLOCK", c, s, 1, (4, 4))
    for block in _ASTC:
        for k in ("UNORM", "SRGB"):
            add(f"ASTC_{block[0]}x{block[1]}_{k}_BLOCK", 4, 16, 1, block)
    return out


def table(spark: SparkSession) -> DataFrame:
    """Bounded by the numbering (185 rows), so safe to broadcast.

    Numeric scaled formats are prohibited; sRGB twins and the facts that rules
    read follow from the names.
    """
    names = {r[1] for r in rows()}
    twin = lambda n: any(n != t and n.replace(k, "SRGB") == t for k in _INT for t in names if k in n)
    out = [(*r, "SCALED" in r[1], bool(re.match(r"(X8_)?[DS]\d", r[1])), not r[8] and twin(r[1]), r[1].startswith("ASTC")) for r in rows()]
    return spark.createDataFrame(
        out,
        "format int, name string, channels int, block_w int, block_h int, block_bytes int, type_size int, compressed boolean, srgb boolean, "
        "prohibited boolean, depth_stencil boolean, srgb_twin boolean, astc_ldr boolean",
    )


def facts(headers: DataFrame) -> DataFrame:
    """Adds ``fact``, the row of the format table as a struct (null where the number is not in it)."""
    known = table(headers.sparkSession)
    packed = known.select(F.col("format").cast("long").alias("vk_format"), F.struct(*[c for c in known.columns if c != "format"]).alias("fact"))
    return headers.join(F.broadcast(packed), "vk_format", "left")
