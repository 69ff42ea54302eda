"""Supercompression global data: its bytes as rows of image descriptors and code-book extents, their rules, and a comparison.

Two schemes have such a section. BASIS_LZ: a header of counts and lengths, one
descriptor an image, then end points, selectors, tables and extended data, one
after the other. UASTC_HDR_6X6: descriptors alone. Files are rows with a key,
sc_scheme, width, height, depth, layers, faces, levels and ``global_data``
(binary); levels are rows with the key, level, byte_offset, byte_length and, for
the rules that read slices, bytes. Field places and rule ids are fixed values of
the format.

Sums of an offset and a length do not wrap. Descriptors that the section is too
short for are absent rows; slices that end before their header raise no rule of
that header.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import little_endian
from .validate import ERROR, raised

BASIS_LZ, UASTC_HDR_6X6 = 1, 4
ETC1S = 163
P_FRAME = 2
HEADER_BYTES = 20
#: (name, place, bytes) in the BASIS_LZ header.
HEADER = [("endpoint_count", 0, 2), ("selector_count", 2, 2), ("endpoints_length", 4, 4), ("selectors_length", 8, 4), ("tables_length", 12, 4), ("extended_length", 16, 4)]
#: The same in a descriptor of each scheme, and a descriptor's size.
DESCRIPTOR = {
    BASIS_LZ: ([("flags", 0, 4), ("rgb_offset", 4, 4), ("rgb_length", 8, 4), ("alpha_offset", 12, 4), ("alpha_length", 16, 4)], 20),
    UASTC_HDR_6X6: ([("rgb_offset", 0, 4), ("rgb_length", 4, 4), ("slice_type", 8, 4)], 12),
}
FIELDS = ["flags", "rgb_offset", "rgb_length", "alpha_offset", "alpha_length", "slice_type"]
BOOKS = ["endpoints", "selectors", "tables", "extended"]
PROFILE, VERSIONS = 0xAB, (0xCD, 0xCE)
PLACE = ["level", "layer", "face", "slice"]


def _one(name: str) -> Column:
    return F.greatest(F.col(name).cast("long"), F.lit(1).cast("long"))


def _slices(level: Column) -> Column:
    return F.greatest(F.call_function("shiftright", F.col("depth").cast("long"), level.cast("int")), F.lit(1).cast("long"))


def image_count() -> Column:
    """Images of all levels; layers, levels and depth of 0 count as one."""
    slices = F.aggregate(F.sequence(F.lit(0), (_one("levels") - 1).cast("int")), F.lit(0).cast("long"), lambda n, v: n + _slices(v))
    return _one("layers") * F.col("faces") * slices


def sections(files: DataFrame, key: str = "texture_id") -> DataFrame:
    """Files of the two schemes that have the section, with n_bytes, image_count and, for BASIS_LZ of 20 bytes or more, ``book``: the header's fields and each code book's extent in the section."""
    raw, size = F.col("global_data"), F.length("global_data").cast("long")
    start = F.lit(HEADER_BYTES) + F.col("image_count") * DESCRIPTOR[BASIS_LZ][1]
    found = files.where(F.col("sc_scheme").isin(BASIS_LZ, UASTC_HDR_6X6) & (F.length("global_data") > 0)).withColumns({"n_bytes": size, "image_count": image_count()})
    fields, at = [little_endian(raw, F.lit(p), n).alias(name) for name, p, n in HEADER], start
    for b in BOOKS:
        length = little_endian(raw, F.lit(next(p for name, p, _ in HEADER if name == f"{b}_length")), 4)
        fields.append(F.struct(at.alias("at"), length.alias("length")).alias(b))
        at = at + length
    return found.withColumn("book", F.when((F.col("sc_scheme") == BASIS_LZ) & (F.col("n_bytes") >= HEADER_BYTES), F.struct(*fields, at.alias("end"))))


def images(found: DataFrame, key: str = "texture_id") -> DataFrame:
    """One row for each descriptor that the section holds: key, sc_scheme, image, level, layer, face, slice and FIELDS (null where a scheme lacks one)."""
    lz = F.col("sc_scheme") == BASIS_LZ
    step = F.when(lz, DESCRIPTOR[BASIS_LZ][1]).otherwise(DESCRIPTOR[UASTC_HDR_6X6][1])
    first = F.when(lz, HEADER_BYTES).otherwise(0)
    level = F.explode(F.sequence(F.lit(0), (_one("levels") - 1).cast("int")))
    per_level = found.select(key, "sc_scheme", "global_data", "n_bytes", "image_count", first.alias("first"), step.alias("step"), "depth", _one("layers").alias("n_layers"), F.col("faces").alias("n_faces"), level.alias("level"))
    per_level = per_level.withColumn("n_slices", _slices(F.col("level")))
    each = F.col("n_layers") * F.col("n_faces")
    before = each * F.when(F.col("level") == 0, 0).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(F.col("level") - 1, F.lit(0))), F.lit(0).cast("long"), lambda n, v: n + _slices(v)))
    placed = per_level.withColumn("before", before).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), each * F.col("n_slices") - 1)))
    div = lambda a, b: F.call_function("div", a, b)
    i, at = F.col("i"), F.col("first") + (F.col("before") + F.col("i")) * F.col("step")
    whole = F.when(lz, F.col("n_bytes") >= F.col("first") + F.col("image_count") * F.col("step")).otherwise(at + F.col("step") <= F.col("n_bytes"))
    places = {s: {name: (p, n) for name, p, n in DESCRIPTOR[s][0]} for s in DESCRIPTOR}

    def value(name: str) -> Column:
        read = lambda s: little_endian(F.col("global_data"), F.col("at") + places[s][name][0], places[s][name][1]) if name in places[s] else F.lit(None).cast("long")
        return F.when(lz, read(BASIS_LZ)).otherwise(read(UASTC_HDR_6X6)).alias(name)

    rows = placed.withColumn("at", at.cast("long")).where(whole)
    return rows.select(key, "sc_scheme", (F.col("before") + i).alias("image"), "level", div(i, F.col("n_faces") * F.col("n_slices")).alias("layer"), (div(i, F.col("n_slices")) % F.col("n_faces")).alias("face"), (i % F.col("n_slices")).alias("slice"), *[value(n) for n in FIELDS])


def _section_rules() -> list[tuple[int, str, str, Column]]:
    c, book = F.col, F.col("book")
    lz, hdr = c("sc_scheme") == BASIS_LZ, c("sc_scheme") == UASTC_HDR_6X6
    step = DESCRIPTOR[UASTC_HDR_6X6][1]
    return [
        (8101, ERROR, "BLZESizeTooSmallHeader", lz & (c("n_bytes") < HEADER_BYTES)),
        (8102, ERROR, "BLZESizeIncorrect", lz & (book["end"] != c("n_bytes"))),
        (8103, ERROR, "BLZEExtendedByteLengthNotZero", lz & (c("model") == ETC1S) & (book["extended_length"] != 0)),
        (8201, ERROR, "UH6X6IESizeTooSmall", hdr & (c("n_bytes") < step)),
        (8202, ERROR, "UH6X6IEByteLengthInvalidSize", hdr & (c("n_bytes") >= step) & (c("n_bytes") % step != 0)),
    ]


def _image_rules() -> list[tuple[int, str, str, Column]]:
    """Over one image with its level's byte_length, and ``head``: profile, version, width and height that its slice begins with."""
    c = F.col
    lz, hdr = c("sc_scheme") == BASIS_LZ, c("sc_scheme") == UASTC_HDR_6X6
    outside = lambda x: c(f"{x}_offset") + c(f"{x}_length") > c("byte_length")
    profile, version = F.shiftright("slice_type", 8).bitwiseAND(F.lit(255)), c("slice_type").bitwiseAND(F.lit(255))
    side = lambda n: F.greatest(F.call_function("shiftright", c(n).cast("long"), c("level")), F.lit(1).cast("long"))
    head = c("head")
    return [
        (8104, ERROR, "BLZEInvalidImageFlagBit", lz & (c("flags").bitwiseAND(F.lit(0xFFFFFFFF - P_FRAME)) != 0)),
        (8106, ERROR, "BLZEZeroRGBLength", lz & (c("rgb_length") == 0)),
        (8107, ERROR, "BLZEInvalidRGBSlice", lz & outside("rgb")),
        (8108, ERROR, "BLZEInvalidAlphaSlice", lz & outside("alpha")),
        (8109, ERROR, "BLZEDFDMismatchAlpha", lz & (c("alpha_length") == 0) & (c("n_samples") == 2)),
        (8110, ERROR, "BLZEDFDMismatchNoAlpha", lz & (c("alpha_length") != 0) & (c("n_samples") == 1)),
        (8203, ERROR, "UH6X6IEZeroRGBLength", hdr & (c("rgb_length") == 0)),
        (8204, ERROR, "UH6X6IEInvalidRGBSlice", hdr & outside("rgb")),
        (8205, ERROR, "UH6X6IEInvalidRGBSliceTypeProfile", hdr & (profile != PROFILE)),
        (8206, ERROR, "UH6X6IEInvalidRGBSliceTypeVersion", hdr & ~version.isin(*VERSIONS)),
        (8207, ERROR, "UH6X6IERGBSliceTypeProfileMismatch", hdr & (head["profile"] != profile)),
        (8208, ERROR, "UH6X6IERGBSliceTypeVersionMismatch", hdr & (head["version"] != version)),
        (8209, ERROR, "UH6X6IEInvalidRGBSliceDimensionsInData", hdr & ((head["width"] != side("width")) | (head["height"] != side("height")))),
    ]


def _slice_head(levels: DataFrame) -> Column:
    """What the slice at ``rgb_offset`` begins with, null if the level's bytes are not there or end before."""
    if "bytes" not in levels.columns:
        return F.lit(None).cast("struct<profile: long, version: long, width: long, height: long>")
    at = F.col("rgb_offset")
    word = lambda k: little_endian(F.col("bytes"), at + 2 * k, 2)
    return F.when(at + 6 <= F.length("bytes"), F.struct(F.shiftright(word(0), 8).alias("profile"), word(0).bitwiseAND(F.lit(255)).alias("version"), word(1).alias("width"), word(2).alias("height")))


def issues(files: DataFrame, levels: DataFrame, key: str = "texture_id") -> DataFrame:
    """(key, level, layer, face, slice, id, severity, rule); rules of the whole section have no place.

    ``files`` has also model, n_samples and anim (whether the key for animation
    is there); an unknown fact (null) raises nothing. Where a section's size is
    not a whole number of descriptors, or too small, its images are not judged.
    """
    found = sections(files, key)
    nowhere = {p: F.lit(None).cast("long") for p in PLACE}
    own = raised(found, _section_rules(), key).withColumns(nowhere)
    sound = found.where((F.col("sc_scheme") == BASIS_LZ) | (F.col("n_bytes") % DESCRIPTOR[UASTC_HDR_6X6][1] == 0))
    index = levels.select(key, F.col("level").cast("int").alias("level"), "byte_length", *(["bytes"] if "bytes" in levels.columns else []))
    each = images(sound, key).join(index, [key, "level"]).join(files.select(key, "n_samples", "width", "height"), key).withColumn("head", _slice_head(levels))
    placed = raised(each, _image_rules(), key, *PLACE).withColumns({p: F.col(p).cast("long") for p in PLACE})
    frames = images(sound, key).where((F.col("sc_scheme") == BASIS_LZ) & (F.col("flags").bitwiseAND(F.lit(P_FRAME)) != 0)).select(key).distinct()
    moving = raised(frames.join(files.select(key, "anim"), key), [(8105, ERROR, "BLZENoAnimationSequencesPFrame", ~F.col("anim"))], key).withColumns(nowhere)
    columns = [key, *PLACE, "id", "severity", "rule"]
    return own.select(columns).unionByName(placed.select(columns)).unionByName(moving.select(columns))


def differences(left: DataFrame, right: DataFrame, key: str = "texture_id", ignore: str = "none") -> DataFrame:
    """(key, section, path, left_value, right_value) of two files' sections, field by field and image by image, where they differ.

    Code books are compared by their bytes (values: null); one that a side
    lacks, or that ends beyond its section, differs. Where neither file is of
    scheme BASIS_LZ the bytes of the sections are compared whole. ``ignore``: "none",
    "unknown" (skips that), "payload" (skips that and the code books), "all".
    """
    out = left.select(key, F.lit("supercompressionGlobalData").alias("section"), F.lit("").alias("path"), F.lit("").alias("left_value"), F.lit("").alias("right_value")).limit(0)
    if ignore == "all":
        return out
    facts = lambda t, x: t.select(key, F.col("sc_scheme").cast("long").alias(f"{x}_scheme"), F.coalesce("global_data", F.lit(b"")).alias(f"{x}_raw"))
    both = facts(left, "l").join(facts(right, "r"), key)
    either = both.where((F.col("l_scheme") == BASIS_LZ) | (F.col("r_scheme") == BASIS_LZ)).select(key, "l_scheme", "r_scheme")

    def side(t: DataFrame, value: str) -> DataFrame:
        lz = sections(t.where(F.col("sc_scheme") == BASIS_LZ), key)
        named = F.array(*[F.struct(F.lit(n).alias("path"), F.col("book")[n].cast("string").alias("v")) for n, _, _ in HEADER])
        head = lz.where("book is not null").select(key, F.explode(named).alias("f"))
        each = F.array(*[F.struct(F.concat(F.lit("images/"), F.col("image"), F.lit(f"/{n}")).alias("path"), F.col(n).cast("string").alias("v")) for n, _, _ in DESCRIPTOR[BASIS_LZ][0]])
        rows = head.unionByName(images(lz, key).select(key, F.explode(each).alias("f")))
        return rows.select(key, "f.path", F.col("f.v").alias(value))

    fields = side(left, "left_value").join(side(right, "right_value"), [key, "path"], "full").where(~F.col("left_value").eqNullSafe(F.col("right_value")))
    kinds = either.where("l_scheme <> r_scheme").select(key, F.lit("type").alias("path"), F.col("l_scheme").cast("string").alias("left_value"), F.col("r_scheme").cast("string").alias("right_value"))
    found = fields.select(key, "path", "left_value", "right_value").unionByName(kinds)
    null = F.lit(None).cast("string")
    if ignore != "payload":

        def books(t: DataFrame, value: str) -> DataFrame:
            lz = sections(t.where(F.col("sc_scheme") == BASIS_LZ), key).where("book is not null")
            taken = lambda b: F.when(F.col("book")[b]["at"] + F.col("book")[b]["length"] <= F.col("n_bytes"), F.col("global_data").substr((F.col("book")[b]["at"] + 1).cast("int"), F.col("book")[b]["length"].cast("int")))
            named = F.explode(F.array(*[F.struct(F.lit(f"{b}_data").alias("path"), taken(b).alias("v")) for b in BOOKS]))
            return lz.select(key, named.alias("f")).select(key, "f.path", F.col("f.v").alias(value))

        all_books = either.select(key, F.explode(F.array(*[F.lit(f"{b}_data") for b in BOOKS])).alias("path"))
        pairs = all_books.join(books(left, "a"), [key, "path"], "left").join(books(right, "b"), [key, "path"], "left")
        found = found.unionByName(pairs.where(F.coalesce(F.col("a") != F.col("b"), F.lit(True))).select(key, "path", null.alias("left_value"), null.alias("right_value")))
    if ignore == "none":
        other = both.where((F.col("l_scheme") != BASIS_LZ) & (F.col("r_scheme") != BASIS_LZ) & (F.col("l_raw") != F.col("r_raw")))
        found = found.unionByName(other.select(key, F.lit("raw_payload").alias("path"), null.alias("left_value"), null.alias("right_value")))
    return found.select(key, F.lit("supercompressionGlobalData").alias("section"), "path", "left_value", "right_value")
