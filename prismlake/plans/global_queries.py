"""Queries over supercompression global data. Sections and payloads are derived from ``part`` as bytes; the SQL works on the numbers behind them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import little_endian_hex
from ..operators import globaldata
from .registry import TEXTURES, _textures, query

# ------------------------------------------------------------------ the numbers, in SQL

_FILES = """{name} AS (
  SELECT *, CAST(n_images AS BIGINT) AS n, CASE WHEN k % 43 = 0 THEN 0 WHEN k % 41 = 0 THEN 8 WHEN k % 31 = 0 THEN whole + 3 WHEN k % 37 = 0 THEN 30 ELSE whole END AS n_bytes
  FROM (SELECT *, CASE WHEN scheme = 1 THEN 20 + 20 * n_images + endpoints_length + selectors_length + tables_length + extended_length ELSE 12 * n_images END AS whole
    FROM (SELECT *, faces * greatest(layers, 1) * list_sum([greatest(depth >> CAST(v AS INT), 1) for v in range(greatest(levels, 1))]) AS n_images
      FROM (SELECT texture_id AS k, width, height, faces, CASE WHEN layers = 1 THEN 0 ELSE layers END AS layers, {levels} AS levels, CASE WHEN texture_id % 4 = 1 AND faces = 1 THEN texture_id % 9 + 1 ELSE 0 END AS depth,
        {scheme} AS scheme, CASE WHEN texture_id % 19 = 0 THEN 166 ELSE 163 END AS model, 1 + texture_id % 2 AS n_samples, texture_id % 5 = 0 AS anim,
        texture_id % 65536 AS endpoint_count, texture_id * 5 % 65536 AS selector_count, texture_id % 7{more} AS endpoints_length, texture_id % 5 AS selectors_length, texture_id % 3 AS tables_length, CASE WHEN texture_id % 23 = 0 THEN 4 ELSE 0 END AS extended_length
        FROM textures{where}))))"""
_LEFT = {"name": "files", "levels": "CASE WHEN texture_id % 5 = 2 THEN 0 ELSE least(levels, 3) END", "scheme": "CASE texture_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE texture_id % 2 * 2 END", "more": "", "where": ""}
_RIGHT = {
    "name": "others",
    "levels": "CASE WHEN texture_id % 5 = 2 OR texture_id % 14 = 0 THEN 0 ELSE least(levels, 3) END",
    "scheme": "CASE WHEN texture_id % 60 = 0 THEN 2 WHEN texture_id % 3 = 0 THEN 1 WHEN texture_id % 3 = 1 THEN 4 ELSE texture_id % 2 * 2 END",
    "more": " + CASE WHEN texture_id % 8 = 0 THEN 1 ELSE 0 END",
    "where": " WHERE texture_id % 6 <> 5",
}
_FLAGS = "CASE WHEN (k + i) % 17 = 0 THEN 2 WHEN (k + i) % 29 = 0 THEN 9 ELSE 0 END"
_VALUES = {
    "flags": _FLAGS,
    "rgb_offset": "CASE WHEN scheme = 4 THEN (i * 37 + k) % 33 * 6 + CASE WHEN (k + i) % 29 = 0 THEN 1 ELSE 0 END ELSE (i * 37 + k) % 200 END",
    "rgb_length": "(k * 3 + i * 11) % 97",
    "alpha_offset": "(i * 53 + k) % 180",
    "alpha_length": "CASE WHEN (k + i) % 4 < 2 THEN 0 ELSE 1 + (i * 5 + k) % 60 END",
    "slice_type": "CASE WHEN (k + i) % 13 = 0 THEN 44237 WHEN (k + i) % 11 = 0 THEN 43983 ELSE 43981 + k % 2 END",
}


def _images_sql(files: str, changed: bool = False) -> str:
    flags = f"{_FLAGS} + CASE WHEN k % 9 = 0 AND i = 1 THEN 4 ELSE 0 END" if changed else _FLAGS
    values = ", ".join(f"CAST({flags if n == 'flags' else v} AS BIGINT) AS {n}" for n, v in _VALUES.items())
    return f"""
  SELECT *, {values} FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY k ORDER BY level, layer, face, slice) - 1 AS BIGINT) AS i FROM (
      SELECT *, unnest(range(greatest(depth >> CAST(level AS INT), 1))) AS slice FROM (SELECT *, unnest(range(faces)) AS face FROM (SELECT *, unnest(range(greatest(layers, 1))) AS layer FROM (SELECT *, unnest(range(greatest(levels, 1))) AS level FROM {files})))))
  WHERE CASE WHEN scheme = 1 THEN n_bytes >= 20 + 20 * n WHEN scheme = 4 THEN n_bytes % 12 = 0 AND 12 * i + 12 <= n_bytes ELSE false END"""


_LONG = "CAST(NULL AS BIGINT)"
_SECTION = [
    (8101, "BLZESizeTooSmallHeader", "scheme = 1 AND n_bytes < 20"),
    (8102, "BLZESizeIncorrect", "scheme = 1 AND n_bytes >= 20 AND n_bytes <> whole"),
    (8103, "BLZEExtendedByteLengthNotZero", "scheme = 1 AND n_bytes >= 20 AND model = 163 AND extended_length > 0"),
    (8201, "UH6X6IESizeTooSmall", "scheme = 4 AND n_bytes < 12"),
    (8202, "UH6X6IEByteLengthInvalidSize", "scheme = 4 AND n_bytes >= 12 AND n_bytes % 12 > 0"),
]
_IMAGE = [
    (8104, "BLZEInvalidImageFlagBit", "scheme = 1 AND flags NOT IN (0, 2)"),
    (8106, "BLZEZeroRGBLength", "scheme = 1 AND rgb_length = 0"),
    (8107, "BLZEInvalidRGBSlice", "scheme = 1 AND rgb_offset + rgb_length > byte_length"),
    (8108, "BLZEInvalidAlphaSlice", "scheme = 1 AND alpha_offset + alpha_length > byte_length"),
    (8109, "BLZEDFDMismatchAlpha", "scheme = 1 AND alpha_length = 0 AND n_samples = 2"),
    (8110, "BLZEDFDMismatchNoAlpha", "scheme = 1 AND alpha_length > 0 AND n_samples = 1"),
    (8203, "UH6X6IEZeroRGBLength", "scheme = 4 AND rgb_length = 0"),
    (8204, "UH6X6IEInvalidRGBSlice", "scheme = 4 AND rgb_offset + rgb_length > byte_length"),
    (8205, "UH6X6IEInvalidRGBSliceTypeProfile", "scheme = 4 AND slice_type // 256 <> 171"),
    (8206, "UH6X6IEInvalidRGBSliceTypeVersion", "scheme = 4 AND slice_type % 256 NOT IN (205, 206)"),
    (8207, "UH6X6IERGBSliceTypeProfileMismatch", "scheme = 4 AND there AND u[(r + 1) % 6 + 1] <> slice_type // 256"),
    (8208, "UH6X6IERGBSliceTypeVersionMismatch", "scheme = 4 AND there AND u[r + 1] <> slice_type % 256"),
    (8209, "UH6X6IEInvalidRGBSliceDimensionsInData", "scheme = 4 AND there AND (u[(r + 2) % 6 + 1] + 256 * u[(r + 3) % 6 + 1] <> w OR u[(r + 4) % 6 + 1] + 256 * u[(r + 5) % 6 + 1] <> h)"),
]
_ISSUES = (
    f"WITH {TEXTURES}, {_FILES.format(**_LEFT)}, images AS ({_images_sql('files')}),"
    """
sides AS (SELECT *, 150 + (k * 7 + level * 13) % 150 AS byte_length, greatest(width >> CAST(level AS INT), 1) AS w, greatest(height >> CAST(level AS INT), 1) AS h, CAST(rgb_offset % 6 AS INT) AS r FROM images),
judged AS (SELECT *, rgb_offset + 6 <= byte_length AS there, [205 + k % 2, CASE WHEN k % 47 = 0 THEN 170 ELSE 171 END, odd % 256, odd // 256, h % 256, h // 256] AS u FROM (SELECT *, w + CASE WHEN k % 53 = 0 THEN 1 ELSE 0 END AS odd FROM sides)) """
    + " UNION ALL ".join(
        [f"SELECT k AS texture_id, {_LONG} AS level, {_LONG} AS layer, {_LONG} AS face, {_LONG} AS slice, {i} AS id, 'error' AS severity, '{r}' AS rule FROM files WHERE n_bytes > 0 AND {p}" for i, r, p in _SECTION]
        + [f"SELECT k, level, layer, face, slice, {i}, 'error', '{r}' FROM judged WHERE {p}" for i, r, p in _IMAGE]
        + [f"SELECT DISTINCT k, {_LONG}, {_LONG}, {_LONG}, {_LONG}, 8105, 'error', 'BLZENoAnimationSequencesPFrame' FROM images WHERE scheme = 1 AND flags = 2 AND NOT anim"]
    )
)

# ------------------------------------------------------------------ the same as bytes, in Spark


def _files(spark, sf, right: bool = False) -> tuple[DataFrame, DataFrame]:
    """(files with their section, levels with their payload)."""
    k, i = F.col("texture_id"), F.col("i")
    n = F.lit
    scheme = F.when(k % 3 == 0, 1).when(k % 3 == 1, 4).otherwise(k % 2 * 2)
    few = (k % 5 == 2) | ((k % 14 == 0) if right else F.lit(False))
    t = _textures(spark, sf).where((k % 6 != 5) if right else F.lit(True))
    t = t.withColumns(
        {
            "depth": F.when((k % 4 == 1) & (F.col("faces") == 1), k % 9 + 1).otherwise(0).cast("long"),
            "layers": F.when(F.col("layers") == 1, 0).otherwise(F.col("layers")).cast("long"),
            "levels": F.when(few, 0).otherwise(F.least("levels", n(3))).cast("long"),
            "sc_scheme": (F.when(k % 60 == 0, 2).otherwise(scheme) if right else scheme).cast("long"),
            "model": F.when(k % 19 == 0, 166).otherwise(163),
            "n_samples": (1 + k % 2).cast("int"),
            "anim": k % 5 == 0,
        }
    ).withColumn("n", globaldata.image_count())
    lengths = {"endpoints": k % 7 + ((k % 8 == 0).cast("int") if right else 0), "selectors": k % 5, "tables": k % 3, "extended": F.when(k % 23 == 0, 4).otherwise(0)}
    values = {name: F.expr(re.sub(r"\bk\b", "texture_id", sql).replace("scheme", "sc_scheme")) for name, sql in _VALUES.items()}
    if right:
        values["flags"] = values["flags"] + F.when((k % 9 == 0) & (i == 1), 4).otherwise(0)
    lz = F.col("sc_scheme") == 1
    hexes = F.when(lz, F.concat(*[little_endian_hex(values[v], 4) for v, _, _ in globaldata.DESCRIPTOR[1][0]])).otherwise(F.concat(*[little_endian_hex(values[v], 4) for v, _, _ in globaldata.DESCRIPTOR[4][0]]))
    parts = t.withColumn("i", F.explode(F.sequence(n(0).cast("long"), F.col("n") - 1))).select("texture_id", F.struct("i", hexes.alias("h")).alias("d"))
    parts = parts.groupBy("texture_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("d")), lambda d: d["h"]), "").alias("descriptors"))
    head = F.concat(little_endian_hex(k, 2), little_endian_hex(k * 5, 2), *[little_endian_hex(x, 4) for x in lengths.values()])

    def book(name: str, length: Column) -> Column:
        seed = k + ((k % 10 == 0).cast("int") if right and name == "selectors" else 0)
        return F.array_join(F.transform(F.slice(F.sequence(n(0), n(9)), n(1), length.cast("int")), lambda j: little_endian_hex((seed + j) % 251, 1)), "")

    whole = F.when(lz, F.concat(head, F.col("descriptors"), *[book(b, x) for b, x in lengths.items()])).otherwise(F.when(F.col("sc_scheme") == 4, F.col("descriptors")).otherwise(F.repeat(n("5A"), 12 * F.col("n").cast("int"))))
    cut = F.when(k % 43 == 0, "").when(k % 41 == 0, F.substring("whole", 1, 16)).when(k % 31 == 0, F.concat("whole", n("000000"))).when(k % 37 == 0, F.substring(F.concat("whole", n("00" * 30)), 1, 60)).otherwise(F.col("whole"))
    files = t.join(parts, "texture_id").withColumn("whole", whole).withColumn("global_data", F.unhex(cut))
    files = files.select("texture_id", "width", "height", "depth", "layers", "faces", "levels", "sc_scheme", "model", "n_samples", "anim", "global_data")
    level = files.select("texture_id", "width", "height", F.explode(F.sequence(n(0).cast("long"), F.greatest("levels", n(1)) - 1)).alias("level"))
    side = lambda c: F.greatest(F.call_function("shiftright", F.col(c), F.col("level").cast("int")), n(1).cast("long"))
    unit = F.concat(little_endian_hex(205 + k % 2, 1), F.when(k % 47 == 0, "AA").otherwise("AB"), little_endian_hex(side("width") + (k % 53 == 0).cast("int"), 2), little_endian_hex(side("height"), 2))
    size = 150 + (k * 7 + F.col("level") * 13) % 150
    return files, level.select("texture_id", "level", size.alias("byte_length"), F.unhex(F.repeat(unit, 50)).substr(n(1), size.cast("int")).alias("bytes"))


@query(_ISSUES)
def validate_global_data(spark, sf):
    return globaldata.issues(*_files(spark, sf))


def _fields_sql(files: str, images: str) -> str:
    head = " UNION ALL ".join(f"SELECT k, '{n}' AS path, CAST({n} AS VARCHAR) AS v FROM {files} WHERE scheme = 1 AND n_bytes >= 20" for n, _, _ in globaldata.HEADER)
    each = " UNION ALL ".join(f"SELECT k, 'images/' || i || '/{n}', CAST({n} AS VARCHAR) FROM {images} WHERE scheme = 1" for n, _, _ in globaldata.DESCRIPTOR[1][0])
    return f"{head} UNION ALL {each}"


def _books_sql(files: str, seed: str) -> str:
    at, out = "20 + 20 * n", []
    for b in globaldata.BOOKS:
        end = f"{at} + {b}_length"
        mine = seed if b == "selectors" else "k"
        out.append(f"SELECT k, '{b}_data' AS path, CASE WHEN {b}_length = 0 THEN 'none' ELSE {b}_length || ':' || ({mine}) % 251 END AS v FROM {files} WHERE scheme = 1 AND n_bytes >= 20 AND {end} <= n_bytes")
        at = end
    return " UNION ALL ".join(out)


def _byte_sql(scheme: str, n: str) -> str:
    """Byte b of a section of scheme 4 (descriptors of n images), 0 or 2 (one letter), with zeros after it."""
    value = lambda name: re.sub(r"\bi\b", "(b // 12)", _VALUES[name]).replace("scheme", scheme)
    words = " ".join(f"WHEN {at // 4} THEN {value(name)}" for name, at, _ in globaldata.DESCRIPTOR[4][0])
    return f"(CASE WHEN b >= 12 * {n} THEN 0 WHEN {scheme} = 4 THEN ((CASE b % 12 // 4 {words} END) >> CAST(b % 4 * 8 AS INT)) & 255 ELSE 90 END)"


@query(
    f"""WITH {TEXTURES}, {_FILES.format(**_LEFT)}, {_FILES.format(**_RIGHT)}, limages AS ({_images_sql('files')}), rimages AS ({_images_sql('others', True)}),
lf AS ({_fields_sql('files', 'limages')}), rf AS ({_fields_sql('others', 'rimages')}), lb AS ({_books_sql('files', 'k')}), rb AS ({_books_sql('others', 'k + CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END')}),
pair AS (SELECT l.k, l.scheme AS ls, r.scheme AS rs, l.n_bytes AS ln, r.n_bytes AS rn, l.n AS li, r.n AS ri FROM files l JOIN others r ON l.k = r.k),
found AS (
  SELECT coalesce(lf.k, rf.k) AS k, coalesce(lf.path, rf.path) AS path, lf.v AS left_value, rf.v AS right_value FROM lf FULL JOIN rf ON lf.k = rf.k AND lf.path = rf.path WHERE lf.v IS DISTINCT FROM rf.v
  UNION ALL SELECT k, 'type', CAST(ls AS VARCHAR), CAST(rs AS VARCHAR) FROM pair WHERE (ls = 1 OR rs = 1) AND ls <> rs
  UNION ALL SELECT pair.k, b.path, NULL, NULL FROM pair CROSS JOIN (VALUES ('endpoints_data'), ('selectors_data'), ('tables_data'), ('extended_data')) b(path)
    LEFT JOIN lb ON lb.k = pair.k AND lb.path = b.path LEFT JOIN rb ON rb.k = pair.k AND rb.path = b.path WHERE (ls = 1 OR rs = 1) AND (lb.v IS NULL OR rb.v IS NULL OR lb.v <> rb.v)
  UNION ALL SELECT k, 'raw_payload', NULL, NULL FROM pair WHERE ls <> 1 AND rs <> 1 AND (ln <> rn OR list_contains([{_byte_sql('ls', 'li')} <> {_byte_sql('rs', 'ri')} for b in range(CAST(ln AS BIGINT))], true)))
SELECT k AS texture_id, 'supercompressionGlobalData' AS section, path, left_value, right_value FROM found"""
)
def compare_global_data(spark, sf):
    return globaldata.differences(_files(spark, sf)[0], _files(spark, sf, right=True)[0])
