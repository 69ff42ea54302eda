"""Format descriptors: what a format's descriptor must say, and the rules over what a file says.

Rows have texture_id, vk_format, sc_scheme, height, levels, gltf, model,
primaries, transfer, dfd_version, texel_block (sizes less one), planes and
samples as the container parser gives them. Ids, severities and names of rules,
numbers of models, channels and qualifiers are fixed values of the format.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import formats
from .validate import ERROR, WARNING, raised

# Fixed values of the format.
RGBSDA, YUVSDA, BC1A, BC2, BC3, BC4, BC5, BC6H, BC7, ETC2, ASTC, ETC1S, UASTC, UASTC_HDR = 1, 2, 128, 129, 130, 131, 132, 133, 134, 161, 162, 163, 166, 167
LINEAR, EXPONENT, SIGNED, FLOAT = 1, 2, 4, 8
CHANNELS = {"R": 0, "G": 1, "B": 2, "D": 14, "S": 13, "A": 15}
MINUS_ONE, ONE, ALL = 0xBF800000, 0x3F800000, 0xFFFFFFFF
VERSION, LAST_TRANSFER, LAST_PRIMARIES = 2, 19, 10
SRGB = 2
ETC1S_RGB, ETC1S_RRR, ETC1S_GGG, ETC1S_AAA = 0, 3, 4, 15
UASTC_CHANNELS = (0, 3, 4, 5)
PVRTC1, PVRTC2, ETC1 = 164, 165, 160
#: Channels that a model has; models that are not listed have no rule.
MODEL_CHANNELS = {
    RGBSDA: (0, 1, 2, 13, 14, 15),
    YUVSDA: (0, 1, 2, 13, 14, 15),
    BC1A: (0, 1),
    BC2: (0, 15),
    BC3: (0, 15),
    BC4: (0,),
    BC5: (0, 1),
    BC6H: (0,),
    BC7: (0,),
    ETC1: (0,),
    ETC2: (0, 1, 2, 15),
    ASTC: (0,),
    ETC1S: (0, 3, 4, 15),
    PVRTC1: (0,),
    PVRTC2: (0,),
    UASTC: (0, 3, 4, 5, 6),
}


def _bounds(kind: str, bits: int) -> tuple[int, int, int]:
    """Qualifiers, lower and upper of a component."""
    if kind in ("UNORM", "SRGB"):
        return 0, 0, (1 << min(bits, 32)) - 1
    if kind == "SNORM":
        most = (1 << (bits - 1)) - 1
        return SIGNED, -most & ALL, most
    if kind in ("UINT", "USCALED"):
        return 0, 0, 1
    if kind in ("SINT", "SSCALED"):
        return SIGNED, ALL, 1
    return (FLOAT, 0, ONE) if kind == "UFLOAT" else (SIGNED | FLOAT, MINUS_ONE, ONE)


def _component(letter: str, kind: str, bits: int, offset: int) -> tuple:
    q, lower, upper = _bounds(kind, bits)
    return offset, bits, CHANNELS[letter], q | (LINEAR if kind == "SRGB" and letter == "A" else 0), lower, upper


def _blocks(name: str, size: int) -> tuple[int, list[tuple]] | None:
    """Model and samples of block-compressed formats."""
    linear = LINEAR if "SRGB" in name else 0
    whole = lambda channel, offset, bits, q=0, lower=0, upper=ALL: (offset, bits, channel, q, lower, upper)
    signed = dict(q=SIGNED, lower=0x80000000, upper=0x7FFFFFFF) if "SNORM" in name else {}
    if name.startswith("BC1"):
        return BC1A, [whole(1 if "RGBA" in name else 0, 0, 64)]
    if name.startswith(("BC2", "BC3")):
        return BC2 if "BC2" in name else BC3, [whole(15, 0, 64, linear), whole(0, 64, 64)]
    if name.startswith("BC4"):
        return BC4, [whole(0, 0, 64, **signed)]
    if name.startswith("BC5"):
        return BC5, [whole(0, 0, 64, **signed), whole(1, 64, 64, **signed)]
    if name.startswith("BC6H"):
        return BC6H, [whole(0, 0, 128, FLOAT, 0, ONE) if "UFLOAT" in name else whole(0, 0, 128, SIGNED | FLOAT, MINUS_ONE, ONE)]
    if name.startswith("BC7"):
        return BC7, [whole(0, 0, 128)]
    if name.startswith("ETC2_R8G8B8A8"):
        return ETC2, [whole(15, 0, 64, linear), whole(2, 64, 64)]
    if name.startswith("ETC2_R8G8B8_"):
        return ETC2, [whole(2, 0, 64)]
    if name.startswith("EAC_R11_"):
        return ETC2, [whole(0, 0, 64, **signed)]
    if name.startswith("EAC_R11G11"):
        return ETC2, [whole(0, 0, 64, **signed), whole(1, 64, 64, **signed)]
    return (ASTC, [whole(0, 0, 128)]) if name.startswith("ASTC") else None


def expected(name: str, size: int, compressed: bool) -> tuple[int, list[tuple] | None]:
    """Model and samples (offset, bits, channel, qualifiers, lower, upper) of a format by its name; samples None where no rule is given."""
    if compressed:
        found = _blocks(name, size)
        return found if found else (ETC2, None)
    parts = re.findall(r"(?:([RGBADSEX])(\d+))", name.split("_PACK")[0])
    kinds = re.findall(r"UNORM|SNORM|USCALED|SSCALED|UINT|SINT|SRGB|SFLOAT|UFLOAT", name)
    if not parts or not kinds or parts[0][0] == "E" or (parts[0][0] in "XDS" and len(parts) > 1):
        return RGBSDA, None
    if "PACK" in name:
        parts = parts[::-1]  # the last named is the least significant
    out, at = [], 0
    for letter, bits in parts:
        out.append(_component(letter, kinds[0], int(bits), at))
        at += int(bits)
    return RGBSDA, out


def expected_table(spark: SparkSession) -> DataFrame:
    """(vk_format, want): model, samples and bytes of each format of the numbering; bounded by it, so safe to broadcast."""
    rows = [(r[0], (*expected(r[1], r[5], r[7]), r[5])) for r in formats.rows() if r[0]]
    sample = "struct<bit_offset:int,bit_length:int,channel:int,qualifiers:int,lower:bigint,upper:bigint>"
    return spark.createDataFrame(rows, f"vk_format long, want struct<model:int,samples:array<{sample}>,bytes:int>")


def _sample_rules() -> list[tuple[int, str, str, Column]]:
    c = F.col
    s, w = c("s"), c("w")
    alpha, linear = s["channel"] == 15, s["qualifiers"].bitwiseAND(F.lit(LINEAR)) != 0
    listed = c("checked") & w.isNotNull()
    rest = lambda x: x["qualifiers"].bitwiseAND(F.lit(15 - LINEAR))
    differs = lambda f: s[f] != w[f]
    placed = F.exists(F.coalesce(s["positions"], F.array()), lambda p: p != 0)
    straight = c("transfer").isin(0, 1)
    uastc = (c("vk_format") == 0) & (c("model") == UASTC) & c("sc_scheme").isin(0, 2, 3) & (c("sample") == 0)
    lz = (c("sc_scheme") == 1) & (c("sample") < 2)
    odd = reduce(lambda a, b: a | b, [(c("model") == m) & ~s["channel"].isin(*has) for m, has in MODEL_CHANNELS.items()])
    return [
        (6101, ERROR, "InvalidChannelForModel", odd),
        (6028, ERROR, "FormatMismatch", listed & (differs("bit_offset") | differs("bit_length") | differs("channel") | (rest(s) != rest(w)) | differs("lower") | differs("upper") | placed)),
        (6108, ERROR, "InvalidQualifierLinearForLinearTF", listed & straight & linear),
        (6109, ERROR, "InvalidQualifierLinearForNonLinearTF", listed & ~straight & (c("transfer") <= LAST_TRANSFER) & (alpha != linear)),
        (6102, ERROR, "InvalidBitOffsetForUASTC", uastc & (s["bit_offset"] != 0)),
        (6104, ERROR, "InvalidBitLengthForUASTC", uastc & (s["bit_length"] != 128)),
        (6103, ERROR, "InvalidBitOffsetForBLZE", lz & (s["bit_offset"] != c("sample") * 64)),
        (6105, ERROR, "InvalidBitLengthForBLZE", lz & (s["bit_length"] != 64)),
        (6106, ERROR, "InvalidLower", (uastc | lz) & (s["lower"] != 0)),
        (6107, ERROR, "InvalidUpper", (uastc | lz) & (s["upper"] != ALL)),
    ]


def _block_rules() -> list[tuple[int, str, str, Column]]:
    c = F.col
    n = F.size("samples")
    model, want, fact = c("model"), c("want"), c("fact")
    plain, undefined, lz = c("sc_scheme").isin(0, 2, 3), c("vk_format") == 0, c("sc_scheme") == 1
    uastc = plain & undefined & (model == UASTC)
    other = plain & undefined & (model != UASTC)
    planes = lambda *v: c("planes") != F.array(*[x if isinstance(x, Column) else F.lit(x) for x in (*v, *[0] * (8 - len(v)))])
    unsized = (c("planes")[0] == 0) & (c("sc_scheme") != 0)
    four = c("texel_block") != F.array(F.lit(3), F.lit(3), F.lit(0), F.lit(0))
    deeper = F.exists(F.slice("planes", 2, 7), lambda p: p != 0)
    first, second = F.get("samples", F.lit(0))["channel"], F.get("samples", F.lit(1))["channel"]
    compressed = F.coalesce(fact["compressed"], F.lit(False))
    g = F.coalesce(c("gltf"), F.lit(False))
    etc1s = g & (model == ETC1S) & (n > 0)
    wrong_second = (n > 1) & (((first == ETC1S_RGB) & (second != ETC1S_AAA)) | ((first == ETC1S_RRR) & (second != ETC1S_GGG)))
    block_model = (model >= BC1A) & undefined & ~c("sc_scheme").isin(1, 4)
    half = formats.half_chroma(c("vk_format"))
    # formats of single texels that are read sample by sample
    read = plain & ~undefined & fact.isNotNull() & ~compressed & ~F.coalesce(fact["prohibited"], F.lit(False))
    placed = F.exists("samples", lambda s: F.exists(F.coalesce(s["positions"], F.array()), lambda p: p != 0))
    kind = lambda s: s["qualifiers"].bitwiseAND(F.lit(SIGNED | FLOAT))
    mixed = F.size(F.array_distinct(F.transform("samples", kind))) > 1
    return [
        (6031, ERROR, "UH4X4ModelRequiresASTC4X4FVkFormat", (model == UASTC_HDR) & (c("vk_format") != formats.ASTC_FLOAT[0])),
        (6011, ERROR, "BasicVersionNotSupported", c("dfd_version") != VERSION),
        (6012, ERROR, "BasicInvalidTransferFunction", c("transfer") > LAST_TRANSFER),
        (6013, ERROR, "BasicSRGBMismatch", fact["srgb"] & (c("transfer") != SRGB)),
        (6014, ERROR, "BasicNotSRGBMismatch", fact["srgb_twin"] & (c("transfer") == SRGB)),
        (6017, ERROR, "IncorrectModelFor422", half & ~formats.prohibited_extension(c("vk_format")) & (model != YUVSDA)),
        (6203, ERROR, "InterpretDFDMixedChannels", read & ~deeper & ~placed & mixed),
        (6204, ERROR, "InterpretDFDMultisample", read & ~deeper & placed),
        (6016, ERROR, "IncorrectModelForBlock", compressed & (model != want["model"]) & (model != UASTC_HDR)),
        (6015, ERROR, "IncorrectModelForRGB", ~undefined & fact.isNotNull() & ~compressed & (model != RGBSDA)),
        (6018, ERROR, "IncorrectModelForBLZE", lz & (model != ETC1S)),
        (6303, ERROR, "InvalidChannelGLTFBU", (etc1s & (~first.isin(ETC1S_RGB, ETC1S_RRR) | wrong_second)) | (g & (model == UASTC) & (n > 0) & ~first.isin(*UASTC_CHANNELS))),
        (6302, ERROR, "IncompatibleModelGLTFBU", g & (model == UASTC) & ~c("sc_scheme").isin(0, 2)),
        (6301, ERROR, "IncorrectModelGLTFBU", g & ~model.isin(ETC1S, UASTC)),
        (6304, ERROR, "InvalidColorSpaceGLTFBU", g & ~((c("primaries") == 1) & (c("transfer") == SRGB)) & ~((c("primaries") == 0) & (c("transfer") == 1))),
        (6019, ERROR, "InvalidColorPrimaries", c("primaries") > LAST_PRIMARIES),
        (6025, ERROR, "SampleCountMismatch", plain & ~undefined & (n != F.size(want["samples"])) & want["samples"].isNotNull()),
        (6030, WARNING, "BytesPlanesUnsized", ((plain & (~undefined | (model == UASTC))) & unsized) | (lz & (c("planes")[0] == 0))),
        (6021, ERROR, "BytesPlanesMismatch", (plain & ~undefined & ~unsized & planes(want["bytes"])) | (uastc & ~unsized & planes(16)) | (lz & (c("planes")[0] != 0) & planes(8, F.when(n == 2, 8).otherwise(0)))),
        (6026, ERROR, "InvalidSampleCount", (uastc & (n != 1)) | (lz & ~n.isin(1, 2))),
        (6020, ERROR, "InvalidTexelBlockDimension", (uastc | lz) & four),
        (6027, ERROR, "ZeroSamples", other & (n == 0)),
        (6023, ERROR, "BytesPlane0Zero", other & (c("sc_scheme") == 0) & (c("planes")[0] == 0)),
        (6024, ERROR, "MultiplaneFormatsNotSupported", (other & (c("sc_scheme") == 0) & deeper) | (read & deeper)),
        (3007, ERROR, "BlockCompressedNoHeight", block_model & (c("height") == 0)),
        (3017, ERROR, "BlockCompressedNoLevel", block_model & (c("levels") == 0)),
    ]


#: Rules that the parser finds in the bytes of the descriptor (fixed values).
BYTE_RULES = {
    6001: (ERROR, "SizeMismatch"),
    6002: (WARNING, "TooManyDFDBlocks"),
    6003: (WARNING, "UnknownDFDBlock"),
    6004: (ERROR, "NotEnoughDataForBlockHeader"),
    6005: (WARNING, "MultipleBDFD"),
    6006: (ERROR, "DescriptorBlockSizeTooSmall"),
    6007: (ERROR, "DescriptorBlockSizeTooBig"),
    6008: (ERROR, "MissingBDFD"),
    6009: (ERROR, "BasicDescriptorBlockSizeInvalid"),
    6010: (ERROR, "BasicDescriptorBlockSizeTooSmall"),
    6029: (WARNING, "TooManySamples"),
}


def byte_issues(files: DataFrame) -> DataFrame:
    """(path, id, severity, rule) of what the parser noted in ``dfd_issues``."""
    names = F.create_map(*[x for i, (s, r) in BYTE_RULES.items() for x in (F.lit(i), F.struct(F.lit(s).alias("severity"), F.lit(r).alias("rule")))])
    return files.select("path", F.explode("dfd_issues").alias("id")).select("path", "id", names[F.col("id")].alias("r")).select("path", "id", "r.severity", "r.rule")


def issues(headers: DataFrame, key: str = "texture_id") -> DataFrame:
    """Rules of the basic descriptor, one row per broken rule, or per sample for rules of samples (``sample``, else null)."""
    known = formats.facts(headers.drop("fact")).join(F.broadcast(expected_table(headers.sparkSession)), "vk_format", "left")
    whole = raised(known.where("model is not null"), _block_rules(), key).withColumn("sample", F.lit(None).cast("int"))
    checked = F.col("sc_scheme").isin(0, 2, 3) & (F.col("vk_format") != 0)
    each = known.select(key, "vk_format", "sc_scheme", "model", "transfer", checked.alias("checked"), F.col("want.samples").alias("wanted"), F.posexplode("samples").alias("sample", "s"))
    each = each.withColumn("w", F.get("wanted", F.col("sample")))
    return whole.unionByName(raised(each, _sample_rules(), key, "sample"))


def differences(left: DataFrame, right: DataFrame, key: str = "texture_id") -> DataFrame:
    """Basic descriptors of two files field by field: (key, section, sample, path, left_value, right_value) where they differ.

    Fields of the block have no sample; a sample that one side lacks differs in
    each of its fields, with null for that side.
    """
    fields = ["model", "primaries", "transfer", "flags", "dfd_version", "texel_block", "planes"]
    text = lambda name: F.to_json(F.array(name)) if name in ("texel_block", "planes") else F.col(name).cast("string")

    def block(t: DataFrame, value: str) -> DataFrame:
        named = F.explode(F.array(*[F.struct(F.lit(n).alias("path"), text(n).alias("v")) for n in fields if n in t.columns]))
        return t.select(key, named.alias("f")).select(key, F.lit(-1).alias("sample"), "f.path", F.col("f.v").alias(value))

    def samples(t: DataFrame, value: str) -> DataFrame:
        each = t.select(key, F.posexplode("samples").alias("sample", "s"))
        names = ["bit_offset", "bit_length", "channel", "qualifiers", "lower", "upper"]
        named = F.explode(F.array(*[F.struct(F.lit(n).alias("path"), F.col("s")[n].cast("string").alias("v")) for n in names]))
        return each.select(key, "sample", named.alias("f")).select(key, "sample", "f.path", F.col("f.v").alias(value))

    side = lambda t, v: block(t, v).unionByName(samples(t, v))
    both = side(left, "left_value").join(side(right, "right_value"), [key, "sample", "path"], "full")
    other = both.where(~F.col("left_value").eqNullSafe(F.col("right_value")))
    return other.select(key, F.lit("dataFormatDescriptor").alias("section"), F.nullif(F.col("sample"), F.lit(-1)).alias("sample"), "path", "left_value", "right_value")
