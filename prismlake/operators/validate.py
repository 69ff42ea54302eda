"""Validation: rules as predicates over catalog tables; each raises rows (id, severity, rule) of ``issues``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizes import align
from . import formats

ERROR, WARNING, FATAL = "error", "warning", "fatal"


def header_rules(compressed: Column) -> list[tuple[int, str, str, Column]]:
    """(id, severity, rule, predicate) over vk_format, type_size, width, height, depth, layers, faces, levels, sc_scheme.

    Ids, severities and names are fixed values of the published rule table, here and below.
    """
    c = F.col
    shown = F.greatest(c("levels"), F.lit(1))
    largest = F.greatest(c("width"), c("height"), c("depth"))
    full = F.length(F.bin(F.greatest(largest, F.lit(1))))
    return [
        (3004, ERROR, "VkFormatAndBasis", c("sc_scheme").isin(1, 4) & (c("vk_format") != 0)),
        (3005, ERROR, "TypeSizeNotOne", ((c("vk_format") == 0) | compressed) & (c("type_size") != 1)),
        (3006, ERROR, "WidthZero", c("width") == 0),
        (3007, ERROR, "BlockCompressedNoHeight", compressed & (c("height") == 0)),
        (3008, ERROR, "CubeHeightWidthMismatch", (c("faces") == 6) & (c("width") != c("height"))),
        (3009, ERROR, "DepthNoHeight", (c("depth") != 0) & (c("height") == 0)),
        (3013, ERROR, "CubeWithDepth", (c("faces") == 6) & (c("depth") != 0)),
        (3014, WARNING, "ThreeDArray", (c("depth") != 0) & (c("layers") != 0)),
        (3015, ERROR, "InvalidFaceCount", ~c("faces").isin(1, 6)),
        (3016, ERROR, "TooManyMipLevels", largest < F.pow(F.lit(2.0), (shown - 1).cast("double"))),
        (3017, ERROR, "BlockCompressedNoLevel", compressed & (c("levels") == 0)),
        (3018, WARNING, "VendorSupercompression", c("sc_scheme").between(0x10000, 0x1FFFF)),
        (3019, ERROR, "InvalidSupercompression", ~c("sc_scheme").between(0, 4) & ~c("sc_scheme").between(0x10000, 0x1FFFF)),
        (3101, ERROR, "InvalidSupercompressionGLTFBU", c("gltf") & ~c("sc_scheme").isin(0, 1, 2)),
        (3102, ERROR, "InvalidTextureTypeGLTFBU", c("gltf") & ((c("depth") != 0) | (c("layers") != 0) | (c("faces") != 1))),
        (3103, ERROR, "InvalidPixelWidthHeightGLTFBU", c("gltf") & ((c("width") % 4 != 0) | (c("height") % 4 != 0))),
        (3104, ERROR, "InvalidLevelCountGLTFBU", c("gltf") & ~((c("levels") == 1) | (c("levels") == full))),
    ]


def format_rules(fact: Column) -> list[tuple[int, str, str, Column]]:
    """Header rules that need facts of the format: ``fact`` is its row of ``formats.table``, or null where the number is not in it."""
    c = F.col
    known, depth_stencil = fact.isNotNull(), F.coalesce(fact["depth_stencil"], F.lit(False))
    plain = known & ~fact["compressed"] & (c("vk_format") != 0)
    return [
        (3001, ERROR, "ProhibitedFormat", F.coalesce(fact["prohibited"], F.lit(False)) | formats.prohibited_extension(c("vk_format"))),
        (3002, ERROR, "InvalidFormat", ~known & (c("vk_format") < formats.FIRST_EXTENSION)),
        (3003, WARNING, "UnknownFormat", ~known & (c("vk_format") >= formats.FIRST_EXTENSION) & ~formats.known_extension(c("vk_format"))),
        (3010, ERROR, "DepthBlockCompressedNoDepth", formats.block_3d(c("vk_format")) & (c("depth") == 0)),
        (3011, ERROR, "DepthStencilFormatWithDepth", depth_stencil & (c("depth") != 0)),
        (3012, ERROR, "TypeSizeMismatch", plain & (c("type_size") != fact["type_size"])),
    ]


def raised(table: DataFrame, rules: list[tuple[int, str, str, Column]], *keys: str) -> DataFrame:
    """One row per key and broken rule. All rules are tested in one scan."""
    hits = F.array_compact(F.array(*[F.when(p, F.struct(F.lit(i).alias("id"), F.lit(s).alias("severity"), F.lit(r).alias("rule"))) for i, s, r, p in rules]))
    return table.select(*keys, F.explode(hits).alias("issue")).select(*keys, "issue.*")


def section_rules() -> list[tuple[int, str, str, Column]]:
    """Over dfd/kvd/sgd offset and length, levels and sc_scheme: each section follows where the last should end, aligned to 4 (global data to 8)."""
    c = F.col
    start = align(80 + 24 * F.greatest(c("levels"), F.lit(1)), F.lit(4))
    after_dfd = start + c("dfd_length")
    after_kvd = F.when(c("kvd_length") > 0, align(after_dfd, F.lit(4)) + c("kvd_length")).otherwise(after_dfd)
    return [
        (3020, ERROR, "IndexDFDMissing", (c("dfd_length") == 0) | (c("dfd_offset") == 0)),
        (3021, ERROR, "IndexDFDInvalidOffset", c("dfd_offset") != start),
        (3028, ERROR, "IndexDFDInvalidLength", (c("dfd_offset") != 0) & (c("dfd_length") != 0) & (c("kvd_offset") != 0) & (c("dfd_length") != c("kvd_offset") - c("dfd_offset"))),
        (3022, ERROR, "IndexKVDInvalidOffset", (c("kvd_length") > 0) & (c("kvd_offset") != align(after_dfd, F.lit(4)))),
        (3023, ERROR, "IndexKVDOffsetWithoutLength", (c("kvd_length") == 0) & (c("kvd_offset") != 0)),
        (3024, ERROR, "IndexSGDInvalidOffset", (c("sgd_length") > 0) & (c("sgd_offset") != align(after_kvd, F.lit(8)))),
        (3025, ERROR, "IndexSGDOffsetWithoutLength", (c("sgd_length") == 0) & (c("sgd_offset") != 0)),
        (3026, ERROR, "IndexSGDMissing", c("sc_scheme").isin(1, 4) & (c("sgd_length") == 0)),
        (3027, ERROR, "IndexSGDNotApplicable", c("sc_scheme").isin(2, 3) & (c("sgd_length") != 0)),
    ]


def level_issues(levels: DataFrame) -> DataFrame:
    """Level index rules over texture_id, level, byte_offset, byte_length, uncompressed_length, expected_size, alignment, sc_scheme, vk_format, images, index_end.

    ``expected_size`` is that of the format, ``images`` the number of faces times
    layers (1 at least), ``index_end`` the end of the last section before the
    payload. Without a known format (vk_format 0) sizes are not compared; where
    the format gives them, offsets are those of the smaller levels' sizes, else
    each level follows the smaller one as it is.
    """
    up = Window.partitionBy("texture_id").orderBy("level")
    down = Window.partitionBy("texture_id").orderBy(F.col("level").desc())
    c = F.col
    seen = levels.withColumns(
        {
            "_length_before": F.lag("uncompressed_length").over(up),
            "_offset_before": F.lag("byte_offset").over(up),
            "_end": F.coalesce(F.lag(F.col("byte_offset") + F.col("byte_length")).over(down), F.col("index_end")),
            "_smaller": F.coalesce(F.sum(align(F.col("expected_size"), F.col("alignment"))).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        }
    )
    return raised(seen, level_rules(), "texture_id", "level")


def level_issues_of_lists(files: DataFrame, key: str = "texture_id") -> DataFrame:
    """The same over files with their levels in a list (``index``, sorted by level, of the other columns): no window, so for streams too."""
    at = F.col("index")
    size = F.size(at)
    before = lambda i, f: F.when(i > 0, F.get(at, i - 1)[f])
    after = lambda i, f: F.when(i + 1 < size, F.get(at, i + 1)[f])
    rest = lambda i: F.aggregate(F.slice(at, i + 2, size), F.lit(0).cast("long"), lambda n, x: n + align(x["expected_size"], x["alignment"]).cast("long"))
    found = F.transform(
        at,
        lambda x, i: F.struct(
            x.alias("x"), before(i, "uncompressed_length").alias("_length_before"), before(i, "byte_offset").alias("_offset_before"),
            F.coalesce(after(i, "byte_offset") + after(i, "byte_length"), x["index_end"]).alias("_end"), rest(i).alias("_smaller"),
        ),
    )
    each = files.select(key, F.explode(found).alias("l")).select(key, "l.x.*", "l._length_before", "l._offset_before", "l._end", "l._smaller")
    return raised(each, level_rules(), key, "level")


def level_rules() -> list[tuple[int, str, str, Column]]:
    """Over a level with its neighbours: _length_before, _offset_before (the larger level's), _end (of the smaller one), _smaller (aligned sizes of all smaller ones)."""
    c = F.col
    known, plain = c("vk_format") != 0, c("sc_scheme") == 0
    follows = F.when(known & plain, align(c("index_end"), c("alignment")) + c("_smaller")).otherwise(align(c("_end"), c("alignment")))
    lz, intermediate = c("sc_scheme") == 1, c("sc_scheme") == 4
    whole = c("uncompressed_length") % c("images") == 0
    return [
        (4001, ERROR, "IncorrectIndexOrder", c("uncompressed_length") > c("_length_before")),
        (4002, ERROR, "IncorrectLevelOrder", c("byte_offset") > c("_offset_before")),
        (4003, ERROR, "IncorrectByteOffsetUnaligned", c("byte_offset") % c("alignment") != 0),
        (4004, ERROR, "IncorrectByteOffset", (c("byte_offset") % c("alignment") == 0) & (c("byte_offset") != follows)),
        (4005, ERROR, "IncorrectByteLength", known & plain & (c("byte_length") != c("expected_size"))),
        (4007, ERROR, "NonZeroUBLForBLZE", lz & (c("uncompressed_length") != 0)),
        (4011, ERROR, "NonZeroUBLForUH6X6IE", intermediate & (c("uncompressed_length") != 0)),
        (4006, ERROR, "IncorrectUncompressedByteLength", known & plain & (c("uncompressed_length") != c("expected_size"))),
        (4009, ERROR, "ZeroUncompressedLength", ~known & ~lz & ~intermediate & (c("uncompressed_length") == 0)),
        (4010, ERROR, "InvalidUncompressedLength", ~known & ~lz & ~intermediate & (c("uncompressed_length") != 0) & ~whole),
    ]


#: Keys that the format defines (fixed values).
KNOWN_KEYS = ["KTXcubemapIncomplete", "KTXorientation", "KTXmapRange", "KTXglFormat", "KTXdxgiFormat__", "KTXmetalPixelFormat", "KTXswizzle", "KTXwriter", "KTXwriterScParams", "KTXastcDecodeMode", "KTXanimData"]
SRGB, ASTC = 2, 162  # transfer function and colour model (fixed values)
#: Rules that the parser finds in the bytes of the key/value block (fixed values).
BLOCK_RULES = {
    7001: (WARNING, "TooManyEntries"),
    7002: (ERROR, "NotEnoughDataForAnEntry"),
    7003: (ERROR, "KeyAndValueByteLengthTooLarge"),
    7004: (ERROR, "KeyAndValueByteLengthTooSmall"),
    7005: (ERROR, "KeyMissingNullTerminator"),
    7006: (ERROR, "KeyForbiddenBOM"),
    7007: (ERROR, "KeyInvalidUTF8"),
    7008: (ERROR, "SizesDontAddUp"),
    7011: (ERROR, "PaddingNotZero"),
}


def block_issues(files: DataFrame) -> DataFrame:
    """(path, id, severity, rule) of what the parser noted in ``kvd_issues``."""
    names = F.create_map(*[x for i, (s, r) in BLOCK_RULES.items() for x in (F.lit(i), F.struct(F.lit(s).alias("severity"), F.lit(r).alias("rule")))])
    return files.select("path", F.explode("kvd_issues").alias("id")).select("path", "id", names[F.col("id")].alias("r")).select("path", "id", "r.severity", "r.rule")


def _key_rules() -> list[tuple[int, str, str, Column]]:
    c, key = F.col, F.col("key")
    is_ = lambda k: key == k
    size = F.length("value")
    nul = (size > 0) & (F.substring("value", -1, 1) == F.lit(b"\0"))
    text = F.expr("cast(substring(value, 1, length(value) - cast(value is not null and length(value) > 0 and substring(value, -1, 1) = X'00' as int)) as string)")
    chars = F.length(text.cast("binary"))
    at = lambda i, allowed: (chars > i) & (c("_dims") > i) & ~F.substring(text, i + 1, 1).isin(*allowed)
    bits = F.conv(F.hex(F.substring("value", 1, 1)), 16, 10).cast("int")
    faces = F.bit_count(bits.bitwiseAND(F.lit(63)))
    word = lambda i: F.concat(*[F.substring("value", i * 4 + k, 1) for k in (4, 3, 2, 1)])  # noqa: E731  # little-endian
    finite = lambda i: F.conv(F.hex(word(i)), 16, 10).cast("long").bitwiseAND(F.lit(0x7F800000)) != F.lit(0x7F800000)
    mapped = F.coalesce(c("linear_or_float"), F.lit(True))
    cube, orient, range_, swizzle, mode = is_("KTXcubemapIncomplete"), is_("KTXorientation"), is_("KTXmapRange"), is_("KTXswizzle"), is_("KTXastcDecodeMode")
    gl, writer, params, anim = is_("KTXglFormat"), is_("KTXwriter"), is_("KTXwriterScParams"), is_("KTXanimData")
    return [
        (7013, ERROR, "KeyEmpty", key == ""),
        (7013, ERROR, "DuplicateKey", c("_nth") > 1),
        (7009, ERROR, "UnknownReservedKey", key.rlike("^(KTX|ktx)") & ~key.isin(KNOWN_KEYS)),
        (7010, WARNING, "CustomMetadata", ~key.rlike("^(KTX|ktx)") & (key != "")),
        (7106, ERROR, "KTXcubemapIncompleteInvalidSize", cube & (size != 1)),
        (7101, ERROR, "KTXcubemapIncompleteInvalidBitSet", cube & (size > 0) & (bits.bitwiseAND(F.lit(192)) != 0)),
        (7102, WARNING, "KTXcubemapIncompleteAllBitsSet", cube & (size > 0) & (faces == 6)),
        (7103, ERROR, "KTXcubemapIncompleteNoBitSet", cube & (size > 0) & (faces == 0)),
        (7104, ERROR, "KTXcubemapIncompleteIncompatibleLayerCount", cube & (size > 0) & (F.expr("try_mod(layers, bit_count(cast(conv(hex(substring(value, 1, 1)), 16, 10) as int) & 63))") != 0)),
        (7105, ERROR, "KTXcubemapIncompleteWithFaceCountNot1", cube & (size > 0) & (c("faces") != 1)),
        (3008, ERROR, "CubeHeightWidthMismatch", cube & (size > 0) & (c("width") != c("height"))),
        (3013, ERROR, "CubeWithDepth", cube & (size > 0) & (c("depth") != 0)),
        (7107, ERROR, "KTXorientationMissingNull", orient & ~nul),
        (7108, ERROR, "KTXorientationIncorrectDimension", orient & (chars != c("_dims"))),
        (7109, ERROR, "KTXorientationInvalidValue", orient & (at(0, "rl") | at(1, "du") | at(2, "oi"))),
        (7202, ERROR, "KTXorientationInvalidGLTFBU", orient & c("gltf") & (text != "rd")),
        (7137, ERROR, "KTXmapRangeInvalidFormat", range_ & ~mapped),
        (7136, ERROR, "KTXmapRangeInvalidSize", range_ & mapped & (size != 8)),
        (7138, ERROR, "KTXmapRangeInvalidScale", range_ & mapped & (size == 8) & ~finite(0)),
        (7139, ERROR, "KTXmapRangeInvalidOffset", range_ & mapped & (size == 8) & finite(0) & ~finite(1)),
        (7111, ERROR, "KTXglFormatWithVkFormat", gl & (c("vk_format") != 0)),
        (7110, ERROR, "KTXglFormatInvalidSize", gl & (size != 12)),
        (7112, ERROR, "KTXglFormatInvalidValueForCompressed", gl & (size == 12) & (F.substring("value", 5, 8) != F.lit(bytes(8))) & (c("sc_scheme").isin(1, 4) | c("block_model"))),
        (7114, ERROR, "KTXdxgiFormatWithVkFormat", is_("KTXdxgiFormat__") & (c("vk_format") != 0)),
        (7113, ERROR, "KTXdxgiFormatInvalidSize", is_("KTXdxgiFormat__") & (size != 4)),
        (7116, ERROR, "KTXmetalPixelFormatWithVkFormat", is_("KTXmetalPixelFormat") & (c("vk_format") != 0)),
        (7115, ERROR, "KTXmetalPixelFormatInvalidSize", is_("KTXmetalPixelFormat") & (size != 4)),
        (7117, ERROR, "KTXswizzleMissingNull", swizzle & ~nul),
        (7118, ERROR, "KTXswizzleInvalidSize", swizzle & (chars != 4)),
        (7119, ERROR, "KTXswizzleInvalidValue", swizzle & F.substring(text, 1, 4).rlike("[^rgba01]")),
        (7121, WARNING, "KTXswizzleWithDepthOrStencil", swizzle & c("depth_stencil")),
        (7201, ERROR, "KTXswizzleInvalidGLTFBU", swizzle & c("gltf") & (text != "rgba")),
        (7122, ERROR, "KTXwriterMissingNull", writer & ~nul),
        (7123, ERROR, "KTXwriterInvalidUTF8", writer & ~F.is_valid_utf8(text)),
        (7126, ERROR, "KTXwriterScParamsMissingNull", params & ~nul),
        (7127, ERROR, "KTXwriterScParamsInvalidUTF8", params & ~F.is_valid_utf8(text)),
        (7131, ERROR, "KTXastcDecodeModeMissingNull", mode & ~nul),
        (7132, ERROR, "KTXastcDecodeModeInvalidValue", mode & ~text.isin("rgb9e5", "unorm8")),
        (7134, WARNING, "KTXastcDecodeModeNotASTC", mode & (c("model") != ASTC)),
        (7133, ERROR, "KTXastcDecodeModeunorm8NotLDR", mode & F.coalesce(c("model") == ASTC, F.lit(True)) & (text == "unorm8") & ~c("astc_ldr")),
        (7135, WARNING, "KTXastcDecodeModeWithsRGB", mode & (c("transfer") == SRGB)),
        (7128, ERROR, "KTXanimDataInvalidSize", anim & (size != 12)),
        (7129, ERROR, "KTXanimDataNotArray", anim & (c("layers") == 0)),
    ]


#: Header facts that key rules read, with the value that raises nothing where a table lacks the column.
HEADER_FACTS = {"vk_format": "long", "sc_scheme": "long", "width": "long", "height": "long", "depth": "long", "layers": "long", "faces": "long", "model": "int", "transfer": "int", "gltf": "boolean", "depth_stencil": "boolean", "astc_ldr": "boolean", "block_model": "boolean", "linear_or_float": "boolean"}


def metadata_issues(metadata: DataFrame, headers: DataFrame) -> DataFrame:
    """Rules over (texture_id, ordinal, key, value binary) and the header facts of each texture.

    ``headers`` has texture_id and those of HEADER_FACTS that are known; a rule
    that reads a missing or null fact raises nothing. Textures without any
    metadata miss their writer too.
    """
    by = Window.partitionBy("texture_id").orderBy("ordinal")
    c = F.col
    facts = headers.select("texture_id", *[(c(n) if n in headers.columns else F.lit(None)).cast(t).alias(n) for n, t in HEADER_FACTS.items()])
    dims = F.when(c("depth") != 0, 3).when(c("height") != 0, 2).otherwise(F.when(c("height").isNotNull(), 1))
    seen = metadata.withColumns({"_before": F.lag("key").over(by), "_nth": F.row_number().over(Window.partitionBy("texture_id", "key").orderBy("ordinal"))}).join(facts, "texture_id", "left").withColumn("_dims", dims)
    own = raised(seen, _key_rules(), "texture_id", "key")
    has = lambda k: F.max((c("key") == k).cast("int"))
    found = seen.groupBy("texture_id").agg(F.coalesce(F.max((c("key") < c("_before")).cast("int")), F.lit(0)).alias("unsorted"), has("KTXwriter").alias("writer"), has("KTXwriterScParams").alias("params"), has("KTXanimData").alias("anim"), has("KTXcubemapIncomplete").alias("cube"))
    whole = headers.select("texture_id").join(found, "texture_id", "left").na.fill(0, ["unsorted", "writer", "params", "anim", "cube"])
    rules = [
        (7012, ERROR, "OutOfOrder", c("unsorted") == 1),
        (7130, ERROR, "KTXanimDataWithCubeIncomplete", (c("anim") == 1) & (c("cube") == 1)),
        (7124, ERROR, "KTXwriterRequiredButMissing", (c("writer") == 0) & (c("params") == 1)),
        (7125, WARNING, "KTXwriterMissing", (c("writer") == 0) & (c("params") == 0)),
    ]
    key = F.when(c("id") == 7130, "KTXanimData").when(c("id") != 7012, "KTXwriter")
    return own.unionByName(raised(whole, rules, "texture_id").withColumn("key", key))


def verdict(textures: DataFrame, issues: DataFrame, warnings_as_errors: bool = False) -> DataFrame:
    """texture_id, n_errors (fatal ones too), n_warnings and valid, for textures with and without issues; with ``stage`` in the issues also stopped_at, that of a fatal one."""
    bad = F.col("severity").isin(ERROR, FATAL)
    sums = [F.sum(bad.cast("int")).alias("e"), F.sum((~bad).cast("int")).alias("w")]
    more = ["stopped_at"] if "stage" in issues.columns else []
    if more:
        sums.append(F.min(F.when(F.col("severity") == FATAL, F.col("stage"))).alias("stopped_at"))
    n = issues.groupBy("texture_id").agg(*sums)
    out = textures.select("texture_id").join(n, "texture_id", "left").select("texture_id", F.coalesce("e", F.lit(0)).cast("long").alias("n_errors"), F.coalesce("w", F.lit(0)).cast("long").alias("n_warnings"), *more)
    fine = F.col("n_errors") == 0
    return out.withColumn("valid", fine & (F.col("n_warnings") == 0) if warnings_as_errors else fine)


def until_fatal(issues: DataFrame, order: str) -> DataFrame:
    """Issues up to and with the first fatal one of each texture; validation stops there."""
    w = Window.partitionBy("texture_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max((F.col("severity") == FATAL).cast("int")).over(w), F.lit(0))
    return issues.withColumn("_stop", before).where("_stop = 0").drop("_stop")


def all_issues(*parts: DataFrame) -> DataFrame:
    """Rule groups in their order."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.withColumn("stage", F.lit(i)) for i, p in enumerate(parts)])
