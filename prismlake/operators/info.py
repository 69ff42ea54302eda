"""What a file is: its header, sections, levels, descriptor, keys and global data as one document, and facts drawn from its descriptor.

Input are examined files (``container.examined``). Names of schemes, models,
primaries and transfer functions are fixed values of the format; numbers
without a name are given as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import descriptor, formats, globaldata, texels

# Names by number.
SCHEMES = {0: "KTX_SS_NONE", 1: "KTX_SS_BASIS_LZ", 2: "KTX_SS_ZSTD", 3: "KTX_SS_ZLIB"}
MODELS = {
    0: "UNSPECIFIED", 1: "RGBSDA", 2: "YUVSDA", 3: "YIQSDA", 4: "LABSDA", 5: "CMYKA", 6: "XYZW", 7: "HSVA_ANG", 8: "HSLA_ANG", 9: "HSVA_HEX", 10: "HSLA_HEX", 11: "YCGCOA", 12: "YCCBCCRC", 13: "ICTCP", 14: "CIEXYZ", 15: "CIEXYY",
    128: "DXT1A", 129: "DXT2", 130: "DXT4", 131: "BC4", 132: "BC5", 133: "BC6H", 134: "BC7", 160: "ETC1", 161: "ETC2", 162: "ASTC", 163: "ETC1S", 164: "PVRTC", 165: "PVRTC2", 166: "UASTC",
}
PRIMARIES = ["UNSPECIFIED", "BT709", "BT601_EBU", "BT601_SMPTE", "BT2020", "CIEXYZ", "ACES", "ACESCC", "NTSC1953", "PAL525", "DISPLAYP3", "ADOBERGB"]
TRANSFERS = ["UNSPECIFIED", "LINEAR", "SRGB", "ITU", "NTSC", "SLOG", "SLOG2", "BT1886", "HLG_OETF", "HLG_EOTF", "PQ_EOTF", "PQ_OETF", "DCIP3", "PAL_OETF", "PAL625_EOTF", "ST240", "ACESCC", "ACESCCT", "ADOBERGB", "HLG_UNNORMALIZED_OETF"]
CHANNEL_NAMES = {0: "RED", 1: "GREEN", 2: "BLUE", 13: "STENCIL", 14: "DEPTH", 15: "ALPHA"}
QUALIFIERS = {1: "LINEAR", 2: "EXPONENT", 4: "SIGNED", 8: "FLOAT"}
UASTC_HDR_4X4, UASTC_HDR_6X6 = 167, 168
#: Endings of names of extension formats.
SUFFIXES = {1000464000: "_NV", 1000470000: "_KHR", 1000470001: "_KHR"}
UASTC_COMPONENTS = {4: 1, 5: 2, 0: 3, 3: 4}
#: Formats that each codec encodes from.
ENCODED_FROM = {
    "basis": ["R8_UNORM", "R8_SRGB", "R8G8_UNORM", "R8G8_SRGB", "R8G8B8_UNORM", "R8G8B8_SRGB", "R8G8B8A8_UNORM", "R8G8B8A8_SRGB"],
    "uastc-hdr": ["R16G16B16_SFLOAT", "R16G16B16A16_SFLOAT"],
}


def named(number: Column, names: dict[int, str] | list[str], prefix: str = "") -> Column:
    """A number's name, or the number as text where it has none."""
    items = names.items() if isinstance(names, dict) else enumerate(names)
    table = F.create_map(*[x for k, v in items for x in (F.lit(k).cast("long"), F.lit(prefix + v))])
    return F.coalesce(F.try_element_at(table, number.cast("long")), number.cast("string"))


def format_name(number: Column) -> Column:
    """The format's name by the public numbering, or its number."""
    known = {r[0]: r[1] for r in formats.rows()} | {v: k + SUFFIXES.get(v, "") for k, v in texels.EXTENSIONS.items()}
    return named(number, known, "VK_FORMAT_")


def sample_list() -> Column:
    """The samples of the basic descriptor with their names."""
    flags = lambda q: F.array_compact(F.array(*[F.when(q.bitwiseAND(F.lit(bit)) != 0, F.lit(n)) for bit, n in QUALIFIERS.items()]))
    rgb = F.col("model").isin(descriptor.RGBSDA, descriptor.YUVSDA)
    channel = lambda c: F.when(rgb, named(c, CHANNEL_NAMES)).otherwise(c.cast("string"))
    return F.transform(
        "samples",
        lambda s: F.struct(
            flags(s["qualifiers"]).alias("qualifiers"), channel(s["channel"]).alias("channelType"), s["bit_length"].alias("bitLength"), s["bit_offset"].alias("bitOffset"), s["positions"].alias("samplePosition"), s["lower"].alias("sampleLower"), s["upper"].alias("sampleUpper")
        ),
    )


def document(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, info): one JSON document a file; sections that a file lacks are left out."""
    c = F.col
    part = lambda n: F.struct(c(f"{n}_offset").alias("byteOffset"), c(f"{n}_length").alias("byteLength"))
    header = F.struct(
        format_name(c("vk_format")).alias("vkFormat"), c("type_size").alias("typeSize"), c("width").alias("pixelWidth"), c("height").alias("pixelHeight"), c("depth").alias("pixelDepth"),
        c("layers").alias("layerCount"), c("faces").alias("faceCount"), c("levels").alias("levelCount"), named(c("sc_scheme"), SCHEMES).alias("supercompressionScheme"),
    )
    levels = F.transform(F.slice("level_index", 1, 64), lambda x: F.struct(x["byte_offset"].alias("byteOffset"), x["byte_length"].alias("byteLength"), x["uncompressed_length"].alias("uncompressedByteLength")))
    index = F.struct(part("dfd").alias("dataFormatDescriptor"), part("kvd").alias("keyValueData"), part("sgd").alias("supercompressionGlobalData"), levels.alias("levels"))
    block = F.struct(
        F.lit("KHRONOS").alias("vendorId"), F.lit("BASICFORMAT").alias("descriptorType"), c("dfd_version").alias("versionNumber"), named(c("model"), MODELS, "KHR_DF_MODEL_").alias("colorModel"), named(c("primaries"), PRIMARIES, "KHR_DF_PRIMARIES_").alias("colorPrimaries"),
        named(c("transfer"), TRANSFERS, "KHR_DF_TRANSFER_").alias("transferFunction"), F.when(c("flags") == 1, F.array(F.lit("KHR_DF_FLAG_ALPHA_PREMULTIPLIED"))).otherwise(F.array().cast("array<string>")).alias("flags"),
        F.transform("texel_block", lambda x: x + 1).alias("texelBlockDimension"), c("planes").alias("bytesPlane"), sample_list().alias("samples"),
    )
    described = F.when(c("dfd_length") > 0, F.struct(c("dfd_total").alias("totalSize"), F.when(c("model").isNotNull(), F.array(block)).otherwise(F.array().cast(f"array<{_type(files, block)}>")).alias("blocks")))
    text = lambda v: F.coalesce(F.when(F.is_valid_utf8(v.cast("string")), F.regexp_replace(v.cast("string"), "\\x00$", "")), F.hex(v))
    pairs = F.when(c("kvd_length") > 0, F.map_from_entries(F.transform(_distinct("metadata"), lambda m: F.struct(m["key"], text(m["value"])))))
    books = globaldata.sections(files, key).select(key, c("book"))
    each = globaldata.images(globaldata.sections(files, key).where(c("sc_scheme") == globaldata.BASIS_LZ), key)
    of_image = F.struct("image", F.when(c("flags") == 0, F.array().cast("array<string>")).otherwise(F.array(F.when(c("flags") == globaldata.P_FRAME, "ETC1S_P_FRAME").otherwise(c("flags").cast("string")))).alias("imageFlags"), c("rgb_length").alias("rgbSliceByteLength"), c("rgb_offset").alias("rgbSliceByteOffset"), c("alpha_length").alias("alphaSliceByteLength"), c("alpha_offset").alias("alphaSliceByteOffset"))
    lists = each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(of_image)), lambda x: x.dropFields("image")).alias("_images"))
    both = files.join(books.withColumnRenamed("book", "_book"), key, "left").join(lists, key, "left")
    b = c("_book")
    data = F.when(
        c("sgd_length") > 0,
        F.struct(named(c("sc_scheme"), SCHEMES).alias("type"), b["endpoint_count"].alias("endpointCount"), b["selector_count"].alias("selectorCount"), b["endpoints_length"].alias("endpointsByteLength"), b["selectors_length"].alias("selectorsByteLength"), b["tables_length"].alias("tablesByteLength"), b["extended_length"].alias("extendedByteLength"), c("_images").alias("images")),
    )
    whole = F.struct(header.alias("header"), index.alias("index"), described.alias("dataFormatDescriptor"), pairs.alias("keyValueData"), data.alias("supercompressionGlobalData"))
    return both.select(key, F.when(c("vk_format").isNotNull(), F.to_json(whole)).alias("info"))


def _type(files: DataFrame, block: Column) -> str:
    return files.select(block.alias("b")).schema["b"].dataType.simpleString()


def _distinct(name: str) -> Column:
    """The first entry of each key."""
    return F.filter(name, lambda m, i: F.array_position(F.transform(name, lambda x: x["key"]), m["key"]) == i + 1)


# ------------------------------------------------------------------ facts of a descriptor, over model and samples


def largest_channel_bits() -> Column:
    """The most bits that one channel has in all its samples."""
    sums = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.aggregate(F.filter("samples", lambda s: s["channel"] == k), F.lit(0), lambda n, s: n + s["bit_length"]))
    return F.array_max(sums)


def components() -> Column:
    """Components of an image, before it was encoded; null where a descriptor's channels are of no known combination."""
    model, n = F.col("model"), F.size(F.array_distinct(F.transform("samples", lambda s: s["channel"])))
    first, second = F.get("samples", F.lit(0))["channel"], F.get("samples", F.lit(1))["channel"]
    etc1s = F.when(n == 1, F.when(first == descriptor.ETC1S_RGB, 3).otherwise(1)).when((first == descriptor.ETC1S_RGB) & (second == descriptor.ETC1S_AAA), 4).when((first == descriptor.ETC1S_RRR) & (second == descriptor.ETC1S_GGG), 2)
    uastc = F.try_element_at(F.create_map(*[F.lit(x) for pair in UASTC_COMPONENTS.items() for x in pair]), first)
    return F.when(model == descriptor.ETC1S, etc1s).when(model == descriptor.UASTC, uastc).otherwise(n)


def needs_transcoding() -> Column:
    return F.col("model").isin(descriptor.ETC1S, descriptor.UASTC, UASTC_HDR_6X6)


def transcodable() -> Column:
    return needs_transcoding() | (F.col("model") == UASTC_HDR_4X4)


def high_range() -> Column:
    """Whether the values are floats or of a model for a high dynamic range."""
    return F.exists("samples", lambda s: s["qualifiers"].bitwiseAND(F.lit(descriptor.FLOAT)) != 0) | F.col("model").isin(descriptor.BC6H, UASTC_HDR_4X4, UASTC_HDR_6X6)


def refused_encoding(codec: str) -> Column:
    """Why a file cannot be encoded with a codec ("basis", "uastc-hdr" or "astc"), null if it can."""
    numbers = [n for name, n in texels.decodable().items() if name in ENCODED_FROM.get(codec, [])]
    why = F.when(F.col("sc_scheme") != 0, "supercompressed")
    if codec == "astc":
        return why.when(F.col("model") == descriptor.ASTC, "already of that model")
    return why.when(~F.col("vk_format").isin(numbers), "format")


def refused_selection(level: Column, layer: Column, face: Column, slice_: Column) -> Column:
    """Why (level, layer, face, slice) cannot be extracted from a header's file, null if it can; null selectors are not given.

    A layer, face or slice may only be asked of an array, a cube map or a 3D
    texture; counts of 0 are those of a file without one.
    """
    c = F.col
    at = lambda v, n: v.isNotNull() & (v >= n)
    one = lambda n: F.greatest(c(n), F.lit(1))
    left = F.greatest(F.call_function("shiftright", one("depth").cast("long"), F.coalesce(level, F.lit(0)).cast("int")), F.lit(1))
    return (
        F.when(at(level, one("levels")), "level is missing")
        .when(layer.isNotNull() & (c("layers") == 0), "no array").when(at(layer, one("layers")), "layer is missing")
        .when(face.isNotNull() & (c("faces") != 6), "no cube map").when(at(face, c("faces")), "face is missing")
        .when(slice_.isNotNull() & (c("depth") == 0), "no 3D texture").when(at(slice_, left), "slice is missing")
    )
