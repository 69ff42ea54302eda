"""Every registered catalog query and its SQL over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits, channels, color
from ..operators import catalog, compare, descriptor, formats, image, metadata, metrics, selectors, validate

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _textures(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.synthetic_textures(_t(spark, sf, "part"))


# The synthetic catalog in SQL.
TEXTURES = """
textures0 AS (
  SELECT p_partkey AS texture_id, CAST(p_size * 16 AS BIGINT) AS width,
    CAST(CASE WHEN p_partkey % 11 = 0 THEN p_size * 16 ELSE (p_partkey % 7 + 1) * 32 END AS BIGINT) AS height,
    CAST(1 AS BIGINT) AS depth, CAST(CASE WHEN p_partkey % 11 = 0 THEN 6 ELSE 1 END AS BIGINT) AS faces,
    CAST(1 + p_partkey % 3 AS BIGINT) AS layers,
    CAST(CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 4 END AS BIGINT) AS block_w,
    CAST(CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 4 END AS BIGINT) AS block_h,
    CAST(CASE WHEN p_partkey % 3 = 0 THEN 4 WHEN p_partkey % 3 = 1 THEN 8 ELSE 16 END AS BIGINT) AS block_bytes,
    CAST(CASE WHEN p_partkey % 5 = 0 THEN 2 ELSE 0 END AS BIGINT) AS sc_scheme
  FROM part),
textures AS (SELECT *, CAST(length(bin(greatest(width, height))) AS BIGINT) AS levels FROM textures0)"""
LEVELS = (
    TEXTURES
    + """,
levels0 AS (
  SELECT *, greatest(1, width >> CAST(level AS INT)) AS level_width, greatest(1, height >> CAST(level AS INT)) AS level_height
  FROM (SELECT *, unnest(range(levels)) AS level FROM textures)),
levels1 AS (
  SELECT *, ((level_width + block_w - 1) // block_w) * ((level_height + block_h - 1) // block_h) * block_bytes AS image_size FROM levels0),
levels2 AS (SELECT *, image_size * layers * faces AS level_size FROM levels1),
levels_ AS (
  SELECT *, CASE WHEN sc_scheme = 0 THEN (level_size + lcm4 - 1) // lcm4 * lcm4 ELSE level_size END AS padded_size
  FROM (SELECT *, CASE block_bytes & 3 WHEN 0 THEN block_bytes WHEN 2 THEN block_bytes * 2 ELSE block_bytes * 4 END AS lcm4 FROM levels2))"""
)
LOCATED = (
    LEVELS
    + """,
located AS (
  SELECT *, CAST(coalesce(sum(padded_size) OVER (PARTITION BY texture_id ORDER BY level DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset
  FROM levels_)"""
)
IMAGES = (
    LOCATED
    + """,
images AS (
  SELECT *, byte_offset + (layer * faces + face) * image_size AS image_offset
  FROM (SELECT *, unnest(range(faces)) AS face FROM (SELECT *, unnest(range(layers)) AS layer FROM located)))"""
)

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return register


# ------------------------------------------------------------------ catalog


@query(f"WITH {LOCATED} SELECT texture_id, level, level_width, level_height, level_size, padded_size, byte_offset FROM located")
def level_offsets(spark, sf):
    return catalog.level_offsets(_textures(spark, sf)).select("texture_id", "level", "level_width", "level_height", "level_size", "padded_size", "byte_offset")


def _parsed_headers(spark, sf) -> DataFrame:
    """The catalog as headers state it: no layers where it is no array, no levels where they are made later, and 3D textures."""
    k = F.col("texture_id")
    zero = F.lit(0).cast("long")
    t = _textures(spark, sf)
    solid = (k % 4 == 1) & (F.col("faces") == 1)
    return t.withColumns(
        {
            "depth": F.when(solid, k % 9 + 1).otherwise(zero),
            "layers": F.when(F.col("layers") == 1, zero).otherwise(F.col("layers")),
            "levels": F.when(k % 5 == 2, zero).otherwise(F.least(F.col("levels"), F.lit(4))),
        }
    )


# Sizes as in the survey: at least one level, layer and slice; each dimension halves with the level.
HEADERS_3D = (
    TEXTURES
    + """,
headers3 AS (
  SELECT texture_id, width, height, CASE WHEN texture_id % 4 = 1 AND faces = 1 THEN texture_id % 9 + 1 ELSE 0 END AS depth, faces, CASE WHEN layers = 1 THEN 0 ELSE layers END AS layers,
    CASE WHEN texture_id % 5 = 2 THEN 0 ELSE least(levels, 4) END AS levels, block_w, block_h, block_bytes, sc_scheme FROM textures),
levels3 AS (
  SELECT *, CAST(ceil(greatest(width // (1 << level), 1) / block_w) * ceil(greatest(height // (1 << level), 1) / block_h) AS BIGINT) * block_bytes AS image_size, greatest(depth // (1 << level), 1) AS level_depth
  FROM (SELECT *, CAST(unnest(range(greatest(levels, 1))) AS INT) AS level FROM headers3)),
sized3 AS (SELECT *, image_size * level_depth * faces * greatest(layers, 1) AS level_size FROM levels3),
located3 AS (
  SELECT *, CAST(coalesce(sum(CASE WHEN sc_scheme = 0 THEN ceil(level_size / lcm(block_bytes, 4)) * lcm(block_bytes, 4) ELSE level_size END)
    OVER (PARTITION BY texture_id ORDER BY level DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset FROM sized3)"""
)


@query(f"WITH {HEADERS_3D} SELECT texture_id, CAST(level AS BIGINT) AS level, CAST(level_depth AS BIGINT) AS level_depth, CAST(level_size AS BIGINT) AS level_size, byte_offset FROM located3")
def header_level_offsets(spark, sf):
    return catalog.level_offsets(_parsed_headers(spark, sf)).select("texture_id", "level", "level_depth", "level_size", "byte_offset")


@query(
    f"""WITH {HEADERS_3D}, n AS (SELECT *, unnest(range(CAST(greatest(layers, 1) * faces * level_depth AS BIGINT))) AS i FROM located3)
SELECT texture_id, CAST(level AS BIGINT) AS level, CAST(i // (faces * level_depth) AS BIGINT) AS layer, CAST(i // level_depth % faces AS BIGINT) AS face, CAST(i % level_depth AS BIGINT) AS slice, CAST(byte_offset + i * image_size AS BIGINT) AS image_offset FROM n"""
)
def header_image_offsets(spark, sf):
    return catalog.images(catalog.level_offsets(_parsed_headers(spark, sf))).select("texture_id", "level", "layer", "face", "slice", "image_offset")


@query(f"WITH {LEVELS} SELECT texture_id, CAST(sum(padded_size) AS BIGINT) AS data_size, CAST(sum(level_size) AS BIGINT) AS plain_size, CAST(sum(layers * faces) AS BIGINT) AS n_images FROM levels_ GROUP BY texture_id")
def level_totals(spark, sf):
    return catalog.level_totals(_textures(spark, sf))


@query(f"WITH {IMAGES} SELECT texture_id, level, layer, face, image_offset, image_size FROM images")
def image_offsets(spark, sf):
    return catalog.images(catalog.level_offsets(_textures(spark, sf))).select("texture_id", "level", "layer", "face", "image_offset", "image_size")


@query(
    f"WITH {LOCATED} SELECT texture_id, level, (level_width + block_w - 1) // block_w AS blocks_x, (level_height + block_h - 1) // block_h AS blocks_y FROM located"
)
def block_grid(spark, sf):
    return catalog.block_grid(catalog.level_offsets(_textures(spark, sf))).select("texture_id", "level", "blocks_x", "blocks_y")


@query(f"WITH {TEXTURES} SELECT texture_id, to_json({{'pixelWidth': width, 'pixelHeight': height, 'levelCount': levels, 'faceCount': faces, 'layerCount': layers}}) AS info FROM textures")
def info_json(spark, sf):
    named = [("pixelWidth", "width"), ("pixelHeight", "height"), ("levelCount", "levels"), ("faceCount", "faces"), ("layerCount", "layers")]
    return _textures(spark, sf).select("texture_id", F.to_json(F.struct(*[F.col(c).alias(n) for n, c in named])).alias("info"))


@query(
    f"""WITH {TEXTURES}, n AS (SELECT texture_id, levels, layers, faces, unnest(range(levels * layers * faces)) AS ordinal FROM textures)
SELECT texture_id, ordinal, ordinal // (layers * faces) % levels AS level, ordinal // faces % layers AS layer, ordinal % faces AS face FROM n"""
)
def input_positions(spark, sf):
    t = _textures(spark, sf).withColumn("ordinal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("levels") * F.col("layers") * F.col("faces") - 1)))
    div = lambda a, b: F.floor(a / b).cast("long")
    n = F.col("ordinal")
    return t.select(
        "texture_id", "ordinal", (div(n, F.col("layers") * F.col("faces")) % F.col("levels")).alias("level"), (div(n, F.col("faces")) % F.col("layers")).alias("layer"), (n % F.col("faces")).alias("face")
    )


# ------------------------------------------------------------------ selectors

FRAGMENT = "concat('m=', CAST(texture_id % 3 AS VARCHAR), ',', CAST(texture_id % 3 + 2 AS VARCHAR), CASE WHEN texture_id % 2 = 0 THEN '&a=,2' ELSE '&a=1' END, CASE WHEN texture_id % 5 = 0 THEN '&f=2,' ELSE '' END)"
_SPARK_FRAGMENT = FRAGMENT.replace("VARCHAR", "STRING")


@query(
    f"""WITH {IMAGES} SELECT texture_id, level, layer, face, image_offset FROM images
WHERE level >= texture_id % 3 AND level < texture_id % 3 + 2
  AND CASE WHEN texture_id % 2 = 0 THEN layer < 2 ELSE layer = 1 END
  AND CASE WHEN texture_id % 5 = 0 THEN face >= 2 ELSE face = 0 END"""
)
def fragment_select(spark, sf):
    found = catalog.images(catalog.level_offsets(_textures(spark, sf))).withColumn("fragment", F.expr(_SPARK_FRAGMENT))
    return selectors.select(found, F.col("fragment")).select("texture_id", "level", "layer", "face", "image_offset")


@query(
    f"""WITH {TEXTURES}, f AS (SELECT *, {FRAGMENT} AS fragment FROM textures)
SELECT texture_id, fragment, texture_id % 3 + 2 <= levels AS levels_ok, CASE WHEN texture_id % 2 = 0 THEN 2 <= layers ELSE 1 < layers END AS layers_ok,
  CASE WHEN texture_id % 5 = 0 THEN 2 < faces ELSE true END AS faces_ok FROM f"""
)
def fragment_bounds(spark, sf):
    t = _textures(spark, sf).withColumn("fragment", F.expr(_SPARK_FRAGMENT))
    f = F.col("fragment")
    ok = lambda key, n: selectors.within(selectors.ranges(f, key), F.col(n))
    return t.select("texture_id", "fragment", ok("m", "levels").alias("levels_ok"), ok("a", "layers").alias("layers_ok"), ok("f", "faces").alias("faces_ok"))


@query(
    """SELECT page_id, coalesce(nullif(regexp_extract(url, '#(.*)$', 1), ''), '') AS fragment,
  regexp_matches(coalesce(nullif(regexp_extract(url, '#(.*)$', 1), ''), ''), '^$|^([maf]=(\\d+|\\d*,\\d*))(&[maf]=(\\d+|\\d*,\\d*))*$') AS valid FROM pages"""
)
def fragment_valid(spark, sf):
    f = F.regexp_extract("url", "#(.*)$", 1)
    return _t(spark, sf, "pages").select("page_id", f.alias("fragment"), selectors.valid(f).alias("valid"))


# ------------------------------------------------------------------ colour

_KEYS = "l_orderkey, l_linenumber"
_V = "(l_discount + 0.0)"


def _line(spark, sf):
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") + 0.0).alias("v"), (F.col("l_tax") + 0.0).alias("w"), F.col("l_quantity").cast("long").alias("q"))


def _r6(c):
    return F.round(c, 6) + 0.0


@query(f"SELECT {_KEYS}, round(CASE WHEN {_V} < 0.0031308 THEN 12.92 * {_V} ELSE 1.055 * pow({_V}, 1 / 2.4) - 0.055 END, 6) + 0.0 AS code FROM lineitem")
def srgb_encode(spark, sf):
    return _line(spark, sf).select("l_orderkey", "l_linenumber", _r6(color.srgb_encode(F.col("v"))).alias("code"))


_D = f"({_V} * 10)"


@query(f"SELECT {_KEYS}, round(least(greatest(CASE WHEN {_D} < 0.04045 THEN {_D} / 12.92 ELSE pow(({_D} + 0.055) / 1.055, 2.4) END, 0), 1), 6) + 0.0 AS intensity FROM lineitem")
def srgb_decode(spark, sf):
    return _line(spark, sf).select("l_orderkey", "l_linenumber", _r6(color.srgb_decode(F.col("v") * 10)).alias("intensity"))


_E = color.ITU_EXPAND


@query(f"SELECT {_KEYS}, round(CASE WHEN {_V} < 0.018 THEN 4.5 * {_V} ELSE {1 + _E!r} * pow({_V}, 0.45) - {_E!r} END, 6) + 0.0 AS code FROM lineitem")
def itu_encode(spark, sf):
    return _line(spark, sf).select("l_orderkey", "l_linenumber", _r6(color.itu_encode(F.col("v"))).alias("code"))


@query(f"SELECT {_KEYS}, round(least(greatest(CASE WHEN {_D} < 0.018 * 4.5 THEN {_D} / 4.5 ELSE pow(({_D} + {_E!r}) / {1 + _E!r}, {1 / 0.45!r}) END, 0), 1), 6) + 0.0 AS intensity FROM lineitem")
def itu_decode(spark, sf):
    return _line(spark, sf).select("l_orderkey", "l_linenumber", _r6(color.itu_decode(F.col("v") * 10)).alias("intensity"))


@query(
    f"""WITH p AS (SELECT {_KEYS}, pow(greatest({_V}, 0), {color.PQ_M1}) AS y FROM lineitem)
SELECT {_KEYS}, round(pow(({color.PQ_C1} + {color.PQ_C2} * y) / (1 + {color.PQ_C3} * y), {color.PQ_M2}), 6) + 0.0 AS code FROM p"""
)
def pq_encode(spark, sf):
    return _line(spark, sf).select("l_orderkey", "l_linenumber", _r6(color.pq_encode(F.col("v"))).alias("code"))


@query(f"SELECT {_KEYS}, round(least(greatest(pow({_D}, {1 / 2.2!r}), 0), 1), 6) + 0.0 AS code FROM lineitem WHERE {_D} >= 0")
def gamma_encode(spark, sf):
    return _line(spark, sf).where("v * 10 >= 0").select("l_orderkey", "l_linenumber", _r6(color.gamma_encode(F.col("v") * 10, 2.2)).alias("code"))


def _matrix_sql(source: str, target: str) -> list[str]:
    names = ("r", "g", "b")
    return [" + ".join(f"{m!r} * {n}" for m, n in zip(row, names, strict=True)) for row in color.conversion(source, target)]


_RGB = f"rgb AS (SELECT {_KEYS}, {_V} AS r, (l_tax + 0.0) AS g, CAST(CAST(l_quantity AS BIGINT) AS DOUBLE) / 255 AS b FROM lineitem)"


def _rgb(spark, sf):
    return _line(spark, sf).select("l_orderkey", "l_linenumber", F.col("v").alias("r"), F.col("w").alias("g"), (F.col("q").cast("double") / 255).alias("b"))


@query(f"WITH {_RGB} SELECT {_KEYS}, " + ", ".join(f"round({e}, 6) + 0.0 AS {n}" for e, n in zip(_matrix_sql("bt709", "bt2020"), ("r2", "g2", "b2"), strict=True)) + " FROM rgb")
def primaries_convert(spark, sf):
    out = color.convert_primaries([F.col(c) for c in "rgb"], "bt709", "bt2020")
    return _rgb(spark, sf).select("l_orderkey", "l_linenumber", *[_r6(c).alias(n) for c, n in zip(out, ("r2", "g2", "b2"), strict=True)])


def _srgb_sql(e: str) -> str:
    return f"CASE WHEN {e} < 0.0031308 THEN 12.92 * {e} ELSE 1.055 * pow({e}, 1 / 2.4) - 0.055 END"


@query(
    f"WITH {_RGB}, m AS (SELECT {_KEYS}, "
    + ", ".join(f"greatest({e}, 0.0) AS {n}" for e, n in zip(_matrix_sql("displayp3", "bt709"), "xyz", strict=True))
    + f" FROM rgb) SELECT {_KEYS}, "
    + ", ".join(f"CAST(least(greatest(floor(({_srgb_sql(n)}) * 255 + 0.5), 0), 255) AS BIGINT) AS {o}" for n, o in zip("xyz", ("r8", "g8", "b8"), strict=True))
    + " FROM m"
)
def color_transform(spark, sf):
    out = color.transform([F.col(c) for c in "rgb"], color.linear, color.srgb_encode, "displayp3", "bt709", 255)
    return _rgb(spark, sf).select("l_orderkey", "l_linenumber", *[c.alias(n) for c, n in zip(out, ("r8", "g8", "b8"), strict=True)])


# ------------------------------------------------------------------ bits


def _quantize_sql(v: str, bits_: int) -> str:
    t = (1 << bits_) - 1
    return f"CAST(CASE WHEN {v} < 0 THEN 0 WHEN {v} > 1 THEN {t} ELSE floor({v} * {t} + 0.5) END AS BIGINT)"


@query(f"SELECT {_KEYS}, {_quantize_sql(_D, 8)} AS code8, {_quantize_sql(_D, 10)} AS code10, {_quantize_sql(_D, 16)} AS code16 FROM lineitem")
def quantize_unorm(spark, sf):
    v = F.col("v") * 10
    return _line(spark, sf).select("l_orderkey", "l_linenumber", *[bits.float_to_unorm(v, b).alias(f"code{b}") for b in (8, 10, 16)])


_Q = "CAST(l_quantity AS BIGINT)"


@query(
    f"""WITH q AS (SELECT {_KEYS}, {_Q} * 5 AS q FROM lineitem)
SELECT {_KEYS}, least((q >> 3) + ((q >> 2) & 1), 31) AS to5, least((q >> 2) + ((q >> 1) & 1), 63) AS to6, (q << 8) | q AS to16, (q << 2) | (q >> 6) AS to10,
  CAST(round(q / 255.0, 6) AS DOUBLE) AS as_float FROM q"""
)
def unorm_rescale(spark, sf):
    q = F.col("q") * 5
    return _line(spark, sf).select(
        "l_orderkey",
        "l_linenumber",
        bits.rescale_unorm(q, 8, 5).alias("to5"),
        bits.rescale_unorm(q, 8, 6).alias("to6"),
        bits.rescale_unorm(q, 8, 16).alias("to16"),
        bits.rescale_unorm(q, 8, 10).alias("to10"),
        F.round(bits.unorm_to_float(q, 8), 6).alias("as_float"),
    )


@query(
    f"""WITH q AS (SELECT {_KEYS}, {_Q} * 5 AS q FROM lineitem)
SELECT {_KEYS}, q & 15 AS uint4, (((q >> 7) & 1) << 3) | (q & 7) AS sint4, CASE WHEN q >= 128 THEN q - 256 ELSE q END AS signed8, (q >> 2) & 7 AS field3,
  CAST(round(greatest((CASE WHEN q >= 128 THEN q - 256 ELSE q END) / 127.0, -1.0), 6) AS DOUBLE) AS snorm FROM q"""
)
def integer_rescale(spark, sf):
    q = F.col("q") * 5
    signed = bits.sign_extend(q, 8)
    return _line(spark, sf).select(
        "l_orderkey", "l_linenumber", bits.rescale_uint(q, 4).alias("uint4"), bits.rescale_sint(q, 8, 4).alias("sint4"), signed.alias("signed8"), bits.field(q, 2, 3).alias("field3"), F.round(bits.snorm_to_float(signed, 8), 6).alias("snorm")
    )


@query(
    f"""WITH q AS (SELECT {_KEYS}, {_Q} * 5 AS r, (l_orderkey * 7) % 256 AS g, (l_orderkey * 13 + l_linenumber) % 256 AS b FROM lineitem)
SELECT {_KEYS}, (least((r >> 3) + ((r >> 2) & 1), 31) << 11) | (least((g >> 2) + ((g >> 1) & 1), 63) << 5) | least((b >> 3) + ((b >> 2) & 1), 31) AS packed565,
  (g << 8) | r AS swapped FROM q"""
)
def pack565(spark, sf):
    t = _line(spark, sf).withColumns({"r": F.col("q") * 5, "g": F.col("l_orderkey") * 7 % 256, "b": (F.col("l_orderkey") * 13 + F.col("l_linenumber")) % 256})
    parts = [bits.rescale_unorm(F.col(c), 8, n) for c, n in (("r", 5), ("g", 6), ("b", 5))]
    return t.select("l_orderkey", "l_linenumber", bits.pack(parts, [5, 6, 5]).alias("packed565"), bits.swap_bytes(F.col("r") * 256 + F.col("g"), 2).alias("swapped"))


@query(
    """WITH h AS (SELECT event_id, (event_id * 40503) % 65536 AS h FROM events),
p AS (SELECT event_id, h, (h >> 10) & 31 AS e, (h & 1023) / 1024.0 AS m, (h >> 15) & 1 AS s FROM h)
SELECT event_id, h AS code, CAST(round((CASE WHEN s = 1 THEN -1 ELSE 1 END) * (CASE WHEN e = 0 THEN m * pow(2.0, -14) ELSE (1 + m) * pow(2.0, e - 15) END), 6) + 0.0 AS DOUBLE) AS value FROM p WHERE e < 31"""
)
def half_decode(spark, sf):
    t = _t(spark, sf, "events").select("event_id", (F.col("event_id") * 40503 % 65536).alias("code"))
    return t.where(bits.field(F.col("code"), 10, 5) < 31).select("event_id", "code", _r6(bits.half_to_float(F.col("code"))).alias("value"))


# ------------------------------------------------------------------ channels

_CODES = f"c AS (SELECT {_KEYS}, {_Q} * 5 AS r, (l_orderkey * 7) % 256 AS g, (l_orderkey * 13 + l_linenumber) % 256 AS b, (l_orderkey * 3) % 256 AS a FROM lineitem)"


def _codes(spark, sf):
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    return _line(spark, sf).select("l_orderkey", "l_linenumber", (F.col("q") * 5).alias("r"), (k * 7 % 256).alias("g"), ((k * 13 + n) % 256).alias("b"), (k * 3 % 256).alias("a"))


@query(f"WITH {_CODES} SELECT {_KEYS}, b AS c0, g AS c1, CAST(0 AS BIGINT) AS c2, CAST(255 AS BIGINT) AS c3 FROM c")
def swizzle(spark, sf):
    out = channels.swizzle([F.col(c) for c in "rgba"], "bg01", F.lit(255))
    return _codes(spark, sf).select("l_orderkey", "l_linenumber", *[c.cast("long").alias(f"c{i}") for i, c in enumerate(out)])


@query(f"WITH {_CODES} SELECT {_KEYS}, " + ", ".join(_quantize_sql(f"(CAST({c} AS DOUBLE) / 255 * (CAST(a AS DOUBLE) / 255))", 8) + f" AS {c}p" for c in "rgb") + " FROM c")
def premultiply(spark, sf):
    out = channels.premultiply([F.col(c) for c in "rgb"], F.col("a"), 8)
    return _codes(spark, sf).select("l_orderkey", "l_linenumber", *[c.alias(f"{n}p") for c, n in zip(out, "rgb", strict=True)])


@query(
    f"""WITH {_CODES}, v AS (SELECT {_KEYS}, r, g, b, 2 * (CAST(r AS DOUBLE) / 255) - 1 AS x, 2 * (CAST(g AS DOUBLE) / 255) - 1 AS y, 2 * (CAST(b AS DOUBLE) / 255) - 1 AS z FROM c),
n AS (SELECT *, sqrt(x * x + y * y + z * z) AS s FROM v)
SELECT {_KEYS}, """
    + ", ".join(f"CASE WHEN s = 0 THEN {c} ELSE {_quantize_sql(f'(({v} / s + 1) / 2)', 8)} END AS n{c}" for c, v in zip("rgb", "xyz", strict=True))
    + " FROM n"
)
def normalize(spark, sf):
    out = channels.normalize([F.col(c) for c in "rgb"], 8)
    return _codes(spark, sf).select("l_orderkey", "l_linenumber", *[c.cast("long").alias(f"n{n}") for c, n in zip(out, "rgb", strict=True)])


# ------------------------------------------------------------------ images

_PIXELS = "px AS (SELECT vec_id, CAST(i % 8 AS INT) AS x, CAST(i // 8 AS INT) AS y, CAST(embedding[CAST(i + 1 AS INT)] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings))"


def _pixels(spark, sf):
    t = _t(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).where("i < 64")
    return t.select("vec_id", (F.col("i") % 8).cast("int").alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), F.col("v").cast("double").alias("v"))


@query(f"WITH {_PIXELS} SELECT vec_id, round(min(v), 6) + 0.0 AS min_value, round(max(v), 6) + 0.0 AS max_value FROM px GROUP BY vec_id")
def channel_range(spark, sf):
    t = _pixels(spark, sf).groupBy("vec_id").agg(*metrics.channel_range(F.col("v")))
    return t.select("vec_id", _r6(F.col("min_value")).alias("min_value"), _r6(F.col("max_value")).alias("max_value"))


@query(
    f"""WITH {_PIXELS}, r AS (SELECT *, min(v) OVER (PARTITION BY vec_id) AS lo, max(v) OVER (PARTITION BY vec_id) AS hi FROM px)
SELECT vec_id, x, y, round(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE v - lo END, 6) + 0.0 AS mapped FROM r"""
)
def range_map(spark, sf):
    return metrics.auto_range(_pixels(spark, sf), "vec_id", "v").select("vec_id", "x", "y", _r6(F.col("mapped")).alias("mapped"))


_CODED = f"{_PIXELS}, two AS (SELECT vec_id, x, y, floor((v + 1) / 2 * 255 + 0.5) AS a, floor(floor((v + 1) / 2 * 255 + 0.5) / 8) * 8 AS b FROM px)"


def _coded(spark, sf):
    a = F.floor((F.col("v") + 1) / 2 * 255 + 0.5).cast("double")
    return _pixels(spark, sf).select("vec_id", "x", "y", a.alias("a"), (F.floor(a / 8) * 8).cast("double").alias("b"))


@query(f"WITH {_CODED}, m AS (SELECT vec_id, avg((a - b) * (a - b)) AS mse FROM two GROUP BY vec_id) SELECT vec_id, CASE WHEN mse > 0 THEN round(10 * log10(65025.0 / mse), 6) END AS psnr FROM m")
def psnr(spark, sf):
    return _coded(spark, sf).groupBy("vec_id").agg(F.round(metrics.psnr(F.col("a"), F.col("b")), 6).alias("psnr"))


@query(
    f"""WITH {_CODED}, m AS (SELECT vec_id, x // 4 AS tx, y // 4 AS ty, avg(a) AS ma, avg(b) AS mb, avg(a * a) AS aa, avg(b * b) AS bb, avg(a * b) AS ab FROM two GROUP BY ALL)
SELECT vec_id, round(avg((2 * ma * mb + 6.5025) * (2 * (ab - ma * mb) + 58.5225) / ((ma * ma + mb * mb + 6.5025) * (aa - ma * ma + bb - mb * mb + 58.5225))), 6) AS ssim FROM m GROUP BY vec_id"""
)
def ssim(spark, sf):
    return metrics.windowed_ssim(_coded(spark, sf), "vec_id", "x", "y", "a", "b", 4).select("vec_id", F.round("ssim", 6).alias("ssim"))


@query(f"WITH {_PIXELS}, l AS (SELECT vec_id, v, x, y, unnest(range(4)) AS level FROM px) SELECT vec_id, CAST(level AS INT) AS level, x >> CAST(level AS INT) AS mx, y >> CAST(level AS INT) AS my, round(avg(v), 6) + 0.0 AS value FROM l GROUP BY ALL")
def box_mip(spark, sf):
    return image.box_mip(_pixels(spark, sf), "vec_id", "x", "y", "v", 8, 8).withColumn("value", _r6(F.col("value")))


@query(f"WITH {_PIXELS} SELECT vec_id, x, 7 - y AS y, round(v, 6) + 0.0 AS v FROM px")
def flip_y(spark, sf):
    return _pixels(spark, sf).select("vec_id", "x", image.flip_y(F.col("y"), 8).alias("y"), _r6(F.col("v")).alias("v"))


def _weights_sql(name: str, source: int, target: int, kernel: str) -> str:
    rows = ", ".join(f"({t}, {s}, {w!r})" for t, s, w in image.weights(source, target, kernel))
    return f"{name}(t, s, w) AS (VALUES {rows})"


def _resample_sql(kernel: str, target: int) -> str:
    return f"""WITH {_PIXELS}, {_weights_sql("k", 8, target, kernel)}
SELECT vec_id, kx.t AS tx, ky.t AS ty, round(sum(v * CAST(kx.w AS DOUBLE) * CAST(ky.w AS DOUBLE)), 6) + 0.0 AS value FROM px JOIN k kx ON kx.s = x JOIN k ky ON ky.s = y GROUP BY ALL"""


def _resample(spark, sf, kernel, target):
    return image.resample(_pixels(spark, sf), "vec_id", "x", "y", "v", (8, 8), (target, target), kernel).withColumn("value", _r6(F.col("value")))


@query(_resample_sql("tent", 4))
def resample_tent(spark, sf):
    return _resample(spark, sf, "tent", 4)


@query(_resample_sql("lanczos4", 6))
def resample_lanczos4(spark, sf):
    return _resample(spark, sf, "lanczos4", 6)


# The kernel in SQL: sinc times sinc over four lobes; weights of a target position sum to 1, edges repeat.
_LANCZOS4 = "CASE WHEN d = 0 THEN 1.0 WHEN abs(d) < 4 THEN sin(pi() * d) / (pi() * d) * sin(pi() * d / 4) / (pi() * d / 4) ELSE 0.0 END"


@query(
    f"""WITH {_PIXELS}, target AS (SELECT CAST(level AS INT) AS level, CAST(unnest(range(8 >> CAST(level AS INT))) AS INT) AS t FROM range(1, 4) r(level)),
tap AS (SELECT level, t, i, (i - ((t + 0.5) * (1 << level) - 0.5)) / (1 << level) AS d FROM (SELECT level, t, unnest(range(-40, 48)) AS i FROM target)),
raw AS (SELECT level, t, least(greatest(i, 0), 7) AS s, {_LANCZOS4} AS w FROM tap),
k AS (SELECT level, t, CAST(s AS INT) AS s, sum(w) / sum(sum(w)) OVER (PARTITION BY level, t) AS w FROM raw GROUP BY level, t, s)
SELECT vec_id, 0 AS level, x AS tx, y AS ty, round(CAST(v AS DOUBLE), 6) + 0.0 AS value FROM px
UNION ALL SELECT vec_id, kx.level, kx.t, ky.t, round(sum(v * kx.w * ky.w), 6) + 0.0 FROM px JOIN k kx ON kx.s = x JOIN k ky ON ky.s = y AND ky.level = kx.level GROUP BY ALL"""
)
def mip_lanczos4(spark, sf):
    return image.mip_pyramid(_pixels(spark, sf), "vec_id", "x", "y", "v", 8, 8).withColumn("value", _r6(F.col("value")))


# ------------------------------------------------------------------ compare

_META = """meta AS (
  SELECT p_partkey AS texture_id, 'KTXwriter' AS key, p_brand AS value FROM part WHERE p_partkey % 4 <> 0 UNION ALL
  SELECT p_partkey, 'KTXorientation', CASE WHEN p_partkey % 9 = 0 THEN 'xx' ELSE 'rd' END FROM part UNION ALL
  SELECT p_partkey, 'comment', p_name FROM part WHERE p_partkey % 3 = 0 UNION ALL
  SELECT p_partkey, 'KTXmadeUp', '' FROM part WHERE p_partkey % 17 = 0 UNION ALL
  SELECT p_partkey, 'KTXwriterScParams', '--x' FROM part WHERE p_partkey % 8 = 0),
other AS (
  SELECT texture_id, key, CASE WHEN key = 'KTXwriter' AND texture_id % 5 = 0 THEN concat(value, '!') WHEN key = 'comment' AND texture_id % 6 = 0 THEN '' ELSE value END AS value
  FROM meta WHERE NOT (key = 'KTXmadeUp' AND texture_id % 2 = 0) UNION ALL
  SELECT p_partkey, 'added', '' FROM part WHERE p_partkey % 13 = 0)"""


def _meta(spark, sf) -> tuple[DataFrame, DataFrame]:
    _t(spark, sf, "part").createOrReplaceTempView("_part")
    sql = _META.replace("FROM part", "FROM _part")
    return tuple(spark.sql(f"WITH {sql} SELECT * FROM {n}") for n in ("meta", "other"))


@query(
    f"""WITH {_META} SELECT coalesce(a.texture_id, b.texture_id) AS texture_id, coalesce(a.key, b.key) AS key,
  CASE WHEN a.key IS NULL THEN 'right' WHEN b.key IS NULL THEN 'left' ELSE 'changed' END AS kind, a.value AS left_value, b.value AS right_value
FROM (SELECT * FROM meta WHERE key <> 'comment') a FULL JOIN (SELECT * FROM other WHERE key <> 'comment') b ON a.texture_id = b.texture_id AND a.key = b.key
WHERE a.value IS DISTINCT FROM b.value"""
)
def metadata_diff(spark, sf):
    left, right = _meta(spark, sf)
    return compare.metadata(left, right, spark.createDataFrame([("comment",)], "key string"))


def _two_catalogs(spark, sf):
    left = catalog.level_offsets(_textures(spark, sf))
    changed = F.col("level_size") + F.when(F.col("texture_id") % 23 == 0, 4).otherwise(0)
    right = left.where("NOT (texture_id % 29 = 0 AND level = levels - 1)").withColumn("level_size", changed)
    return left, right


@query(
    f"""WITH {LOCATED}, r AS (SELECT *, level_size + CASE WHEN texture_id % 23 = 0 THEN 4 ELSE 0 END AS changed FROM located WHERE NOT (texture_id % 29 = 0 AND level = levels - 1)),
j AS (SELECT l.texture_id, l.level, l.byte_offset AS lo, r.byte_offset AS ro, l.level_size AS ls, r.changed AS rs, r.texture_id IS NULL AS gone FROM located l LEFT JOIN r ON l.texture_id = r.texture_id AND l.level = r.level)
SELECT texture_id, level, 'levelIndex' AS section, CASE WHEN gone THEN 'left' ELSE 'both' END AS present, 'byte_offset' AS path, CAST(lo AS VARCHAR) AS left_value, CAST(ro AS VARCHAR) AS right_value FROM j WHERE gone OR lo <> ro
UNION ALL SELECT texture_id, level, 'levelIndex', CASE WHEN gone THEN 'left' ELSE 'both' END, 'level_size', CAST(ls AS VARCHAR), CAST(rs AS VARCHAR) FROM j WHERE gone OR ls <> rs"""
)
def compare_levels(spark, sf):
    left, right = _two_catalogs(spark, sf)
    return compare.fields(left, right, ["texture_id", "level"], ["byte_offset", "level_size"], "levelIndex")


@query(
    f"""WITH {TEXTURES}, r AS (SELECT *, CASE WHEN texture_id % 19 = 0 THEN width + 16 ELSE width END AS w2, CASE WHEN texture_id % 7 = 0 THEN 0 ELSE sc_scheme END AS s2 FROM textures)
SELECT texture_id, 'header' AS section, 'both' AS present, 'pixelWidth' AS path, CAST(width AS VARCHAR) AS left_value, CAST(w2 AS VARCHAR) AS right_value FROM r WHERE width <> w2
UNION ALL SELECT texture_id, 'header', 'both', 'supercompressionScheme', CAST(sc_scheme AS VARCHAR), CAST(s2 AS VARCHAR) FROM r WHERE sc_scheme <> s2"""
)
def compare_headers(spark, sf):
    t = _textures(spark, sf).withColumns({"pixelWidth": F.col("width"), "supercompressionScheme": F.col("sc_scheme")})
    other = t.withColumns({"pixelWidth": F.when(F.col("texture_id") % 19 == 0, F.col("width") + 16).otherwise(F.col("width")), "supercompressionScheme": F.when(F.col("texture_id") % 7 == 0, 0).otherwise(F.col("sc_scheme")).cast("long")})
    return compare.fields(t, other, ["texture_id"], ["pixelWidth", "supercompressionScheme"], "header")


@query(
    f"""WITH {_CODED}, d AS (SELECT vec_id, x, y, a, b, count(*) OVER (PARTITION BY vec_id) AS n_differences, row_number() OVER (PARTITION BY vec_id ORDER BY y, x) AS rank FROM two WHERE a <> b)
SELECT vec_id, x, y, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, n_differences, CAST(rank AS INT) AS rank FROM d WHERE rank <= 3"""
)
def compare_blocks(spark, sf):
    return compare.first_differences(_coded(spark, sf).where("a <> b"), ["vec_id"], ["y", "x"], 3)


@query("SELECT event_id, length(props) AS left_length, CASE WHEN event_id % 3 <> 0 THEN length(concat(props, CASE WHEN event_id % 2 = 0 THEN ' ' ELSE '' END)) END AS right_length, false AS equal FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0")
def compare_payloads(spark, sf):
    t = _t(spark, sf, "events")
    raw = lambda c: c.cast("binary").alias("bytes")
    right = t.where("event_id % 3 <> 0").select("event_id", raw(F.concat("props", F.when(F.col("event_id") % 2 == 0, " ").otherwise(""))))
    return compare.payload(t.select("event_id", raw(F.col("props"))), right, ["event_id"])


# ------------------------------------------------------------------ validate

_HEADERS = f"""{TEXTURES},
headers AS (SELECT texture_id, CASE WHEN texture_id % 3 = 0 THEN 37 WHEN texture_id % 3 = 1 THEN 131 ELSE 157 END AS vk_format,
  CASE WHEN texture_id % 10 = 1 THEN 4 ELSE 1 END AS type_size, CASE WHEN texture_id % 41 = 0 THEN 0 ELSE width END AS width, CASE WHEN texture_id % 37 = 0 THEN 0 ELSE height END AS height,
  CASE WHEN texture_id % 31 = 0 THEN 4 ELSE 0 END AS depth, layers - 1 AS layers, CASE WHEN texture_id % 43 = 0 THEN 3 ELSE faces END AS faces,
  CASE WHEN texture_id % 13 = 0 THEN levels + 1 WHEN texture_id % 17 = 0 THEN 0 ELSE levels END AS levels,
  CASE WHEN texture_id % 53 = 0 THEN 65536 WHEN texture_id % 59 = 0 THEN 9 WHEN texture_id % 61 = 0 THEN 1 ELSE sc_scheme END AS sc_scheme,
  texture_id % 3 <> 0 AS compressed, texture_id % 4 = 0 AS gltf FROM textures)"""


def _headers(spark, sf) -> DataFrame:
    _textures(spark, sf).createOrReplaceTempView("_textures")
    return spark.sql("SELECT" + _HEADERS.split("headers AS (SELECT")[1][:-1].replace("FROM textures", "FROM _textures"))


_BIG = "greatest(width, height, depth)"
_RULES = [
    (3004, "error", "VkFormatAndBasis", "sc_scheme IN (1, 4) AND vk_format <> 0"),
    (3005, "error", "TypeSizeNotOne", "(vk_format = 0 OR compressed) AND type_size <> 1"),
    (3006, "error", "WidthZero", "width = 0"),
    (3007, "error", "BlockCompressedNoHeight", "compressed AND height = 0"),
    (3008, "error", "CubeHeightWidthMismatch", "faces = 6 AND width <> height"),
    (3009, "error", "DepthNoHeight", "depth <> 0 AND height = 0"),
    (3013, "error", "CubeWithDepth", "faces = 6 AND depth <> 0"),
    (3014, "warning", "ThreeDArray", "depth <> 0 AND layers <> 0"),
    (3015, "error", "InvalidFaceCount", "faces NOT IN (1, 6)"),
    (3016, "error", "TooManyMipLevels", f"{_BIG} < (1 << CAST(greatest(levels, 1) - 1 AS INT))"),
    (3017, "error", "BlockCompressedNoLevel", "compressed AND levels = 0"),
    (3018, "warning", "VendorSupercompression", "sc_scheme BETWEEN 65536 AND 131071"),
    (3019, "error", "InvalidSupercompression", "NOT (sc_scheme BETWEEN 0 AND 4) AND NOT (sc_scheme BETWEEN 65536 AND 131071)"),
    (3101, "error", "InvalidSupercompressionGLTFBU", "gltf AND sc_scheme NOT IN (0, 1, 2)"),
    (3102, "error", "InvalidTextureTypeGLTFBU", "gltf AND (depth <> 0 OR layers <> 0 OR faces <> 1)"),
    (3103, "error", "InvalidPixelWidthHeightGLTFBU", "gltf AND (width % 4 <> 0 OR height % 4 <> 0)"),
    (3104, "error", "InvalidLevelCountGLTFBU", f"gltf AND NOT (levels = 1 OR levels = length(bin(greatest({_BIG}, 1))))"),
]
_HEADER_ISSUES = " UNION ALL ".join(f"SELECT texture_id, {i} AS id, '{s}' AS severity, '{r}' AS rule FROM headers WHERE {p}" for i, s, r, p in _RULES)


@query(f"WITH {_HEADERS} {_HEADER_ISSUES}")
def validate_header(spark, sf):
    return validate.raised(_headers(spark, sf), validate.header_rules(F.col("compressed")), "texture_id")


@query(
    f"""WITH {_HEADERS}, f AS (SELECT texture_id, type_size, CASE WHEN texture_id % 7 = 0 THEN 124 WHEN texture_id % 11 = 0 THEN 11 WHEN texture_id % 13 = 0 THEN 185 WHEN texture_id % 17 = 0 THEN 1000156003
    WHEN texture_id % 19 = 0 THEN 1000288002 WHEN texture_id % 23 = 0 THEN 1000999999 WHEN texture_id % 29 = 0 THEN 70 ELSE 37 END AS vk_format, depth FROM headers)
SELECT texture_id, 3001 AS id, 'error' AS severity, 'ProhibitedFormat' AS rule FROM f WHERE vk_format IN (11, 1000156003)
UNION ALL SELECT texture_id, 3002, 'error', 'InvalidFormat' FROM f WHERE vk_format = 185
UNION ALL SELECT texture_id, 3003, 'warning', 'UnknownFormat' FROM f WHERE vk_format = 1000999999
UNION ALL SELECT texture_id, 3010, 'error', 'DepthBlockCompressedNoDepth' FROM f WHERE vk_format = 1000288002 AND depth = 0
UNION ALL SELECT texture_id, 3011, 'error', 'DepthStencilFormatWithDepth' FROM f WHERE vk_format = 124 AND depth <> 0
UNION ALL SELECT texture_id, 3012, 'error', 'TypeSizeMismatch' FROM f WHERE (vk_format IN (124, 70) AND type_size <> 2) OR (vk_format IN (11, 37) AND type_size <> 1)"""
)
def validate_formats(spark, sf):
    k = F.col("texture_id")
    number = F.when(k % 7 == 0, 124).when(k % 11 == 0, 11).when(k % 13 == 0, 185).when(k % 17 == 0, 1000156003).when(k % 19 == 0, 1000288002).when(k % 23 == 0, 1000999999).when(k % 29 == 0, 70).otherwise(37)
    headers = formats.facts(_headers(spark, sf).withColumn("vk_format", number.cast("long")))
    return validate.raised(headers, validate.format_rules(F.col("fact")), "texture_id")


# The payload begins after sections that end at byte 205; some payloads are shifted as a whole, some files have no known format.
_INDEX = f"""{LOCATED},
idx0 AS (SELECT *, CASE WHEN sc_scheme = 0 THEN lcm4 ELSE 1 END AS alignment, CASE WHEN texture_id % 47 = 0 THEN 1 ELSE sc_scheme END AS scheme, CASE WHEN texture_id % 27 = 0 THEN 0 ELSE 37 END AS vk_format FROM located),
idx AS (SELECT texture_id, level, byte_offset AS smaller, scheme, vk_format, alignment, faces * layers AS images, level_size AS expected_size, 205 AS index_end,
  CASE WHEN alignment = 1 THEN 205 ELSE 208 END + byte_offset + CASE WHEN texture_id % 31 = 0 THEN 16 WHEN texture_id % 19 = 0 AND level = 0 THEN 2 WHEN texture_id % 23 = 0 AND level = 1 THEN 16 ELSE 0 END AS byte_offset,
  level_size + CASE WHEN texture_id % 7 = 0 AND level = 2 THEN 8 ELSE 0 END AS byte_length,
  CASE WHEN texture_id % 54 = 0 AND level = 1 THEN 0 WHEN texture_id % 27 = 0 AND level = 0 THEN level_size + 1 WHEN texture_id % 29 = 0 AND level = 1 THEN 9999999 ELSE level_size END AS uncompressed_length FROM idx0)"""
_LEVEL_ISSUES = """
SELECT a.texture_id, a.level, 4001 AS id, 'error' AS severity, 'IncorrectIndexOrder' AS rule FROM idx a JOIN idx b ON a.texture_id = b.texture_id AND a.level = b.level + 1 WHERE a.uncompressed_length > b.uncompressed_length
UNION ALL SELECT a.texture_id, a.level, 4002, 'error', 'IncorrectLevelOrder' FROM idx a JOIN idx b ON a.texture_id = b.texture_id AND a.level = b.level + 1 WHERE a.byte_offset > b.byte_offset
UNION ALL SELECT texture_id, level, 4003, 'error', 'IncorrectByteOffsetUnaligned' FROM idx WHERE byte_offset % alignment <> 0
UNION ALL SELECT a.texture_id, a.level, 4004, 'error', 'IncorrectByteOffset' FROM idx a LEFT JOIN idx b ON a.texture_id = b.texture_id AND b.level = a.level + 1
  WHERE a.byte_offset % a.alignment = 0 AND a.byte_offset <> CASE WHEN a.vk_format <> 0 AND a.scheme = 0 THEN ceil(a.index_end / a.alignment) * a.alignment + a.smaller
    ELSE ceil(coalesce(b.byte_offset + b.byte_length, a.index_end) / a.alignment) * a.alignment END
UNION ALL SELECT texture_id, level, 4005, 'error', 'IncorrectByteLength' FROM idx WHERE vk_format <> 0 AND scheme = 0 AND byte_length <> expected_size
UNION ALL SELECT texture_id, level, 4006, 'error', 'IncorrectUncompressedByteLength' FROM idx WHERE vk_format <> 0 AND scheme = 0 AND uncompressed_length <> expected_size
UNION ALL SELECT texture_id, level, 4007, 'error', 'NonZeroUBLForBLZE' FROM idx WHERE scheme = 1 AND uncompressed_length <> 0
UNION ALL SELECT texture_id, level, 4009, 'error', 'ZeroUncompressedLength' FROM idx WHERE vk_format = 0 AND scheme NOT IN (1, 4) AND uncompressed_length = 0
UNION ALL SELECT texture_id, level, 4010, 'error', 'InvalidUncompressedLength' FROM idx WHERE vk_format = 0 AND scheme NOT IN (1, 4) AND uncompressed_length % images <> 0"""


@query(f"WITH {_INDEX} {_LEVEL_ISSUES}")
def validate_levels(spark, sf):
    from ..functions.sizes import lcm4

    k, v = F.col("texture_id"), F.col("level")
    alignment = F.when(F.col("sc_scheme") == 0, lcm4(F.col("block_bytes"))).otherwise(1)
    moved = F.when(k % 31 == 0, 16).when((k % 19 == 0) & (v == 0), 2).when((k % 23 == 0) & (v == 1), 16).otherwise(0)
    index = catalog.level_offsets(_textures(spark, sf)).select(
        "texture_id",
        "level",
        (F.col("byte_offset") + F.when(alignment == 1, 205).otherwise(208) + moved).alias("byte_offset"),
        (F.col("level_size") + F.when((k % 7 == 0) & (v == 2), 8).otherwise(0)).alias("byte_length"),
        F.when((k % 54 == 0) & (v == 1), 0).when((k % 27 == 0) & (v == 0), F.col("level_size") + 1).when((k % 29 == 0) & (v == 1), 9999999).otherwise(F.col("level_size")).alias("uncompressed_length"),
        F.col("level_size").alias("expected_size"),
        alignment.alias("alignment"),
        F.when(k % 47 == 0, 1).otherwise(F.col("sc_scheme")).alias("sc_scheme"),
        F.when(k % 27 == 0, 0).otherwise(37).alias("vk_format"),
        (F.col("faces") * F.col("layers")).alias("images"),
        F.lit(205).alias("index_end"),
    )
    return validate.level_issues(index)


# Metadata of every texture in file order; ``text`` stands for the bytes, ``nul`` for the NUL after them.
_ENTRIES = """
entries AS (
  SELECT p_partkey AS texture_id, 1 AS ordinal, 'KTXorientation' AS key, CASE WHEN p_partkey % 9 = 0 THEN 'xx' WHEN p_partkey % 9 = 1 THEN 'r' WHEN p_partkey % 9 = 2 THEN 'rdi' ELSE 'rd' END AS text, p_partkey % 10 <> 0 AS nul FROM part UNION ALL
  SELECT p_partkey, 2, 'KTXswizzle', CASE WHEN p_partkey % 3 = 0 THEN 'rgbx' WHEN p_partkey % 3 = 1 THEN 'rgba' ELSE 'rg' END, p_partkey % 14 <> 0 FROM part WHERE p_partkey % 2 = 0 UNION ALL
  SELECT p_partkey, 3, 'KTXwriter', p_brand, p_partkey % 12 <> 1 FROM part WHERE p_partkey % 4 <> 0 UNION ALL
  SELECT p_partkey, 4, 'KTXwriterScParams', '--x', p_partkey % 16 <> 0 FROM part WHERE p_partkey % 8 = 0 UNION ALL
  SELECT p_partkey, 5, 'KTXmadeUp', '', false FROM part WHERE p_partkey % 17 = 0 UNION ALL
  SELECT p_partkey, 6, 'comment', p_name, false FROM part WHERE p_partkey % 3 = 0 UNION ALL
  SELECT p_partkey, 7, 'comment', 'again', false FROM part WHERE p_partkey % 15 = 0 UNION ALL
  SELECT p_partkey, 8, '', 'x', false FROM part WHERE p_partkey % 51 = 0 UNION ALL
  SELECT p_partkey, 9, 'KTXanimData', CASE WHEN p_partkey % 25 = 0 THEN '123456789012' ELSE '1234' END, false FROM part WHERE p_partkey % 5 = 0 UNION ALL
  SELECT p_partkey, 10, 'KTXcubemapIncomplete', '?', false FROM part WHERE p_partkey % 35 = 0 UNION ALL
  SELECT p_partkey, 11, 'KTXastcDecodeMode', CASE WHEN p_partkey % 18 = 0 THEN 'unorm8' ELSE 'f16' END, true FROM part WHERE p_partkey % 6 = 0 UNION ALL
  SELECT p_partkey, 12, 'KTXglFormat', '1234', false FROM part WHERE p_partkey % 22 = 0)"""
_META_FACTS = """
facts AS (SELECT texture_id, width, height, 0 AS depth, layers - 1 AS layers, faces, CASE WHEN texture_id % 3 = 2 THEN 162 ELSE 1 END AS model, CASE WHEN texture_id % 4 = 2 THEN 2 ELSE 1 END AS transfer, 37 AS vk_format, texture_id % 44 = 0 AS gltf FROM textures),
e AS (SELECT e.*, f.* EXCLUDE (texture_id) FROM entries e JOIN facts f ON e.texture_id = f.texture_id)"""
_META_RULES = [
    (7013, "error", "KeyEmpty", "key = ''"),
    (7013, "error", "DuplicateKey", "key = 'comment' AND ordinal = 7"),
    (7009, "error", "UnknownReservedKey", "key = 'KTXmadeUp'"),
    (7010, "warning", "CustomMetadata", "key = 'comment'"),
    (7107, "error", "KTXorientationMissingNull", "key = 'KTXorientation' AND NOT nul"),
    (7108, "error", "KTXorientationIncorrectDimension", "key = 'KTXorientation' AND length(text) <> 2"),
    (7109, "error", "KTXorientationInvalidValue", "key = 'KTXorientation' AND text = 'xx'"),
    (7202, "error", "KTXorientationInvalidGLTFBU", "key = 'KTXorientation' AND gltf AND text <> 'rd'"),
    (7117, "error", "KTXswizzleMissingNull", "key = 'KTXswizzle' AND NOT nul"),
    (7118, "error", "KTXswizzleInvalidSize", "key = 'KTXswizzle' AND length(text) <> 4"),
    (7119, "error", "KTXswizzleInvalidValue", "key = 'KTXswizzle' AND text = 'rgbx'"),
    (7201, "error", "KTXswizzleInvalidGLTFBU", "key = 'KTXswizzle' AND gltf AND text <> 'rgba'"),
    (7122, "error", "KTXwriterMissingNull", "key = 'KTXwriter' AND NOT nul"),
    (7126, "error", "KTXwriterScParamsMissingNull", "key = 'KTXwriterScParams' AND NOT nul"),
    (7128, "error", "KTXanimDataInvalidSize", "key = 'KTXanimData' AND text = '1234'"),
    (7129, "error", "KTXanimDataNotArray", "key = 'KTXanimData' AND layers = 0"),
    (7102, "warning", "KTXcubemapIncompleteAllBitsSet", "key = 'KTXcubemapIncomplete'"),
    (7104, "error", "KTXcubemapIncompleteIncompatibleLayerCount", "key = 'KTXcubemapIncomplete' AND layers % 6 <> 0"),
    (7105, "error", "KTXcubemapIncompleteWithFaceCountNot1", "key = 'KTXcubemapIncomplete' AND faces <> 1"),
    (3008, "error", "CubeHeightWidthMismatch", "key = 'KTXcubemapIncomplete' AND width <> height"),
    (7132, "error", "KTXastcDecodeModeInvalidValue", "key = 'KTXastcDecodeMode' AND text = 'f16'"),
    (7134, "warning", "KTXastcDecodeModeNotASTC", "key = 'KTXastcDecodeMode' AND model <> 162"),
    (7135, "warning", "KTXastcDecodeModeWithsRGB", "key = 'KTXastcDecodeMode' AND transfer = 2"),
    (7110, "error", "KTXglFormatInvalidSize", "key = 'KTXglFormat'"),
    (7111, "error", "KTXglFormatWithVkFormat", "key = 'KTXglFormat' AND vk_format <> 0"),
]
_META_ISSUES = (
    " UNION ALL ".join(f"SELECT texture_id, key, {i} AS id, '{s}' AS severity, '{r}' AS rule FROM e WHERE {p}" for i, s, r, p in _META_RULES)
    + """ UNION ALL SELECT DISTINCT a.texture_id, NULL, 7012, 'error', 'OutOfOrder' FROM entries a JOIN entries b ON a.texture_id = b.texture_id AND a.ordinal < b.ordinal AND a.key > b.key
UNION ALL SELECT texture_id, 'KTXanimData', 7130, 'error', 'KTXanimDataWithCubeIncomplete' FROM facts WHERE texture_id % 5 = 0 AND texture_id % 35 = 0
UNION ALL SELECT texture_id, 'KTXwriter', 7124, 'error', 'KTXwriterRequiredButMissing' FROM facts WHERE texture_id % 8 = 0
UNION ALL SELECT texture_id, 'KTXwriter', 7125, 'warning', 'KTXwriterMissing' FROM facts WHERE texture_id % 4 = 0 AND texture_id % 8 <> 0"""
)


def _metadata_issues(spark, sf) -> DataFrame:
    _t(spark, sf, "part").createOrReplaceTempView("_part")
    entries = spark.sql(f"WITH {_ENTRIES.replace('FROM part', 'FROM _part')} SELECT * FROM entries")
    value = F.concat(F.encode("text", "UTF-8"), F.when(F.col("nul"), F.lit(b"\0")).otherwise(F.lit(b"")))
    k = F.col("texture_id")
    facts = _textures(spark, sf).select(
        "texture_id", "width", "height", F.lit(0).alias("depth"), (F.col("layers") - 1).alias("layers"), "faces", F.when(k % 3 == 2, 162).otherwise(1).alias("model"), F.when(k % 4 == 2, 2).otherwise(1).alias("transfer"), F.lit(37).alias("vk_format"), (k % 44 == 0).alias("gltf")
    )
    return validate.metadata_issues(entries.select("texture_id", "ordinal", "key", value.alias("value")), facts)


@query(f"WITH {TEXTURES}, {_ENTRIES}, {_META_FACTS} {_META_ISSUES}")
def validate_metadata(spark, sf):
    return _metadata_issues(spark, sf)


# Descriptors of five known formats, of a block format without a number, and of what was changed in some of them.
_DESCRIPTORS = f"""{TEXTURES},
kinds(kind, vk_format, model, transfer, block, bytes, samples) AS (VALUES
  (0, 37, 1, 1, 0, 4, [[0, 8, 0, 0, 0, 255], [8, 8, 1, 0, 0, 255], [16, 8, 2, 0, 0, 255], [24, 8, 15, 0, 0, 255]]),
  (1, 43, 1, 2, 0, 4, [[0, 8, 0, 0, 0, 255], [8, 8, 1, 0, 0, 255], [16, 8, 2, 0, 0, 255], [24, 8, 15, 1, 0, 255]]),
  (2, 97, 1, 1, 0, 8, [[0, 16, 0, 12, 3212836864, 1065353216], [16, 16, 1, 12, 3212836864, 1065353216], [32, 16, 2, 12, 3212836864, 1065353216], [48, 16, 15, 12, 3212836864, 1065353216]]),
  (3, 131, 128, 1, 3, 8, [[0, 64, 0, 0, 0, 4294967295]]),
  (4, 157, 162, 1, 3, 16, [[0, 128, 0, 0, 0, 4294967295]]),
  (5, 0, 166, 2, 3, 16, [[0, 128, 0, 0, 0, 4294967295]]),
  (6, 4, 1, 1, 0, 2, [[0, 5, 2, 0, 0, 31], [5, 6, 1, 0, 0, 63], [11, 5, 0, 0, 0, 31]])),
blocks AS (SELECT t.texture_id AS id, k.* FROM textures t JOIN kinds k ON t.texture_id % 7 = k.kind)"""
_CHANGED = """
changed AS (SELECT id AS texture_id, kind, vk_format, CASE WHEN id % 11 = 0 THEN 2 ELSE 0 END AS sc_scheme, 16 AS height, 1 AS levels, id % 6 = 0 AS gltf, CASE WHEN id % 13 = 0 THEN 99 ELSE model END AS model,
  CASE WHEN id % 17 = 0 THEN 12 ELSE 1 END AS primaries, CASE WHEN id % 19 = 0 THEN 25 WHEN id % 10 = 3 THEN 2 ELSE transfer END AS transfer, CASE WHEN id % 23 = 0 THEN 1 ELSE 2 END AS dfd_version,
  CASE WHEN id % 31 = 0 THEN 7 ELSE block END AS edge, CASE WHEN id % 22 = 0 THEN 0 WHEN id % 29 = 0 THEN bytes + 1 ELSE bytes END AS plane,
  id % 37 = 0 AS cut, id % 9 = 4 AS moved, samples FROM blocks)"""
_DFD_RULES = [
    (6011, "error", "BasicVersionNotSupported", "dfd_version <> 2"),
    (6012, "error", "BasicInvalidTransferFunction", "transfer > 19"),
    (6013, "error", "BasicSRGBMismatch", "vk_format = 43 AND transfer <> 2"),
    (6014, "error", "BasicNotSRGBMismatch", "vk_format IN (37, 131, 157) AND transfer = 2"),
    (6016, "error", "IncorrectModelForBlock", "(vk_format = 131 AND model <> 128) OR (vk_format = 157 AND model <> 162)"),
    (6015, "error", "IncorrectModelForRGB", "vk_format IN (4, 37, 43, 97) AND model <> 1"),
    (6302, "error", "IncompatibleModelGLTFBU", "gltf AND model = 166 AND sc_scheme NOT IN (0, 2)"),
    (6301, "error", "IncorrectModelGLTFBU", "gltf AND model NOT IN (163, 166)"),
    (6304, "error", "InvalidColorSpaceGLTFBU", "gltf AND NOT (primaries = 1 AND transfer = 2) AND NOT (primaries = 0 AND transfer = 1)"),
    (6019, "error", "InvalidColorPrimaries", "primaries > 10"),
    (6025, "error", "SampleCountMismatch", "vk_format <> 0 AND cut"),
    (6026, "error", "InvalidSampleCount", "vk_format = 0 AND model = 166 AND cut"),
    (6027, "error", "ZeroSamples", "vk_format = 0 AND model <> 166 AND cut"),
    (6020, "error", "InvalidTexelBlockDimension", "vk_format = 0 AND model = 166 AND edge <> 3"),
    (6030, "warning", "BytesPlanesUnsized", "sc_scheme <> 0 AND plane = 0 AND (vk_format <> 0 OR model = 166)"),
    (6021, "error", "BytesPlanesMismatch", "NOT (sc_scheme <> 0 AND plane = 0) AND ((vk_format <> 0 AND plane <> (SELECT bytes FROM kinds k WHERE k.kind = changed.kind)) OR (vk_format = 0 AND model = 166 AND plane <> 16))"),
    (6023, "error", "BytesPlane0Zero", "vk_format = 0 AND model <> 166 AND sc_scheme = 0 AND plane = 0"),
]
_DFD_SAMPLES = """
seen AS (SELECT texture_id, vk_format, model, transfer, unnest(CASE WHEN cut THEN samples[2:] ELSE samples END) AS s, moved, cut,
  unnest(range(len(CASE WHEN cut THEN samples[2:] ELSE samples END))) AS sample, samples FROM changed),
one AS (SELECT texture_id, vk_format, model, transfer, CAST(sample AS INT) AS sample, samples[sample + 1] AS w, s[1] + CASE WHEN moved AND sample = 0 THEN 1 ELSE 0 END AS s1, s[2] AS s2, s[3] AS s3, s[4] AS s4, s[5] AS s5, s[6] AS s6 FROM seen)"""
_DFD_SAMPLE_ISSUES = """
SELECT texture_id, sample, 6028 AS id, 'error' AS severity, 'FormatMismatch' AS rule FROM one WHERE vk_format <> 0 AND (s1 <> w[1] OR s2 <> w[2] OR s3 <> w[3] OR s4 - s4 % 2 <> w[4] - w[4] % 2 OR s5 <> w[5] OR s6 <> w[6])
UNION ALL SELECT texture_id, sample, 6108, 'error', 'InvalidQualifierLinearForLinearTF' FROM one WHERE vk_format <> 0 AND transfer < 2 AND s4 % 2 = 1
UNION ALL SELECT texture_id, sample, 6109, 'error', 'InvalidQualifierLinearForNonLinearTF' FROM one WHERE vk_format <> 0 AND transfer BETWEEN 2 AND 19 AND (s3 = 15) <> (s4 % 2 = 1)
UNION ALL SELECT texture_id, sample, 6102, 'error', 'InvalidBitOffsetForUASTC' FROM one WHERE vk_format = 0 AND model = 166 AND sample = 0 AND s1 <> 0"""


def _descriptors(spark, sf, changed: bool = True) -> DataFrame:
    k = F.col("texture_id")
    sample = "array<struct<bit_offset:int,bit_length:int,channel:int,qualifiers:int,lower:bigint,upper:bigint,positions:array<int>>>"
    known = {r[1]: r for r in formats.rows()}
    rows = []
    for kind, name in enumerate(["R8G8B8A8_UNORM", "R8G8B8A8_SRGB", "R16G16B16A16_SFLOAT", "BC1_RGB_UNORM_BLOCK", "ASTC_4x4_UNORM_BLOCK", None, "R5G6B5_UNORM_PACK16"]):
        if name:
            r = known[name]
            model, samples = descriptor.expected(name, r[5], r[7])
            rows.append((kind, r[0], model, 2 if "SRGB" in name else 1, r[3] - 1, r[5], [(*s, [0] * 4) for s in samples]))
        else:
            rows.append((kind, 0, descriptor.UASTC, 2, 3, 16, [(0, 128, 0, 0, 0, descriptor.ALL, [0] * 4)]))
    kinds = spark.createDataFrame(rows, f"kind long, vk_format long, model int, transfer int, block int, bytes int, samples {sample}")
    t = _textures(spark, sf).select("texture_id", (k % 7).alias("kind")).join(F.broadcast(kinds), "kind")
    if not changed:
        return t.select("texture_id", "model", F.lit(1).alias("primaries"), "transfer", F.lit(2).alias("dfd_version"), "samples")
    edge, plane = F.when(k % 31 == 0, 7).otherwise(F.col("block")), F.when(k % 22 == 0, 0).when(k % 29 == 0, F.col("bytes") + 1).otherwise(F.col("bytes"))
    left = F.when(k % 37 == 0, F.slice("samples", 2, 99)).otherwise(F.col("samples"))
    moved = F.transform(left, lambda s, i: s.withField("bit_offset", s["bit_offset"] + F.when((i == 0) & (k % 9 == 4), 1).otherwise(0)))
    zero = F.lit(0)
    return t.select(
        "texture_id",
        "vk_format",
        F.when(k % 11 == 0, 2).otherwise(0).alias("sc_scheme"),
        F.lit(16).alias("height"),
        F.lit(1).alias("levels"),
        (k % 6 == 0).alias("gltf"),
        F.when(k % 13 == 0, 99).otherwise(F.col("model")).alias("model"),
        F.when(k % 17 == 0, 12).otherwise(1).alias("primaries"),
        F.when(k % 19 == 0, 25).when(k % 10 == 3, 2).otherwise(F.col("transfer")).alias("transfer"),
        F.when(k % 23 == 0, 1).otherwise(2).alias("dfd_version"),
        F.array(edge, edge, zero, zero).alias("texel_block"),
        F.array(plane, *[zero] * 7).alias("planes"),
        moved.alias("samples"),
    )


@query(
    f"""WITH {_DESCRIPTORS}, {_CHANGED}, {_DFD_SAMPLES}
{" UNION ALL ".join(f"SELECT texture_id, CAST(NULL AS INT) AS sample, {i} AS id, '{s}' AS severity, '{r}' AS rule FROM changed WHERE {p}" for i, s, r, p in _DFD_RULES)}
UNION ALL {_DFD_SAMPLE_ISSUES}"""
)
def validate_descriptor(spark, sf):
    return descriptor.issues(_descriptors(spark, sf)).select("texture_id", "sample", "id", "severity", "rule")


_SAMPLE_FIELDS = ["bit_offset", "bit_length", "channel", "qualifiers", "lower", "upper"]


@query(
    f"""WITH {_DESCRIPTORS}, {_CHANGED}, {_DFD_SAMPLES},
l AS (SELECT id AS texture_id, CAST(i AS INT) AS sample, samples[i + 1] AS v FROM (SELECT id, samples, unnest(range(len(samples))) AS i FROM blocks)),
r AS (SELECT texture_id, sample, [s1, s2, s3, s4, s5, s6] AS v FROM one),
f(n, path) AS (VALUES {", ".join(f"({i + 1}, '{n}')" for i, n in enumerate(_SAMPLE_FIELDS))}),
d AS (SELECT coalesce(l.texture_id, r.texture_id) AS texture_id, coalesce(l.sample, r.sample) AS sample, f.path, CAST(l.v[f.n] AS VARCHAR) AS lv, CAST(r.v[f.n] AS VARCHAR) AS rv FROM l FULL JOIN r ON l.texture_id = r.texture_id AND l.sample = r.sample CROSS JOIN f),
b AS (SELECT c.texture_id, 'model' AS path, CAST(b.model AS VARCHAR) AS lv, CAST(c.model AS VARCHAR) AS rv FROM changed c JOIN blocks b ON b.id = c.texture_id
  UNION ALL SELECT texture_id, 'primaries', '1', CAST(primaries AS VARCHAR) FROM changed
  UNION ALL SELECT c.texture_id, 'transfer', CAST(b.transfer AS VARCHAR), CAST(c.transfer AS VARCHAR) FROM changed c JOIN blocks b ON b.id = c.texture_id
  UNION ALL SELECT texture_id, 'dfd_version', '2', CAST(dfd_version AS VARCHAR) FROM changed)
SELECT texture_id, 'dataFormatDescriptor' AS section, sample, path, lv AS left_value, rv AS right_value FROM d WHERE lv IS DISTINCT FROM rv
UNION ALL SELECT texture_id, 'dataFormatDescriptor', NULL, path, lv, rv FROM b WHERE lv <> rv"""
)
def compare_descriptors(spark, sf):
    right = _descriptors(spark, sf).drop("texel_block", "planes")
    return descriptor.differences(_descriptors(spark, sf, changed=False), right)


# ------------------------------------------------------------------ metadata maps

_LISTS = f"""{_META.split("other AS")[0].rstrip().rstrip(",")}, lists AS (SELECT texture_id, list({{'key': key, 'value': value}} ORDER BY key) AS pairs FROM meta GROUP BY texture_id)"""


def _lists(spark, sf) -> DataFrame:
    return _meta(spark, sf)[0].groupBy("texture_id").agg(F.sort_array(F.collect_list(F.struct("key", "value"))).alias("pairs"))


@query(
    f"""WITH {_LISTS}
SELECT texture_id, list_extract(list_filter(pairs, lambda p: p.key = 'KTXwriter'), 1).value AS writer, CAST(to_json(list_concat(list_filter(pairs, lambda p: p.key <> 'comment'), [{{'key': 'comment', 'value': 'new'}}])) AS VARCHAR) AS added,
  CAST(to_json(list_filter(pairs, lambda p: p.key <> 'KTXorientation' AND p.key <> 'none')) AS VARCHAR) AS deleted FROM lists"""
)
def metadata_edit(spark, sf):
    p = F.col("pairs")
    return _lists(spark, sf).select("texture_id", metadata.found(p, "KTXwriter").alias("writer"), F.to_json(metadata.added(p, "comment", "new")).alias("added"), F.to_json(metadata.deleted(p, "KTXorientation", "none")).alias("deleted"))


@query(
    f"""WITH {_LISTS}, kept AS (SELECT texture_id, key, value FROM meta WHERE key NOT IN ('KTXwriter', 'KTXwriterScParams') UNION ALL SELECT texture_id, 'KTXwriter', 'tool' FROM lists
  UNION ALL SELECT l.texture_id, 'KTXwriterScParams', CASE WHEN m.value IS NULL THEN '--zstd 5' ELSE m.value || ' --zstd 5' END FROM lists l LEFT JOIN meta m ON m.texture_id = l.texture_id AND m.key = 'KTXwriterScParams')
SELECT texture_id, CAST(to_json(list({{'key': key, 'value': value}} ORDER BY key)) AS VARCHAR) AS pairs FROM kept GROUP BY texture_id"""
)
def metadata_stamp(spark, sf):
    return _lists(spark, sf).select("texture_id", F.to_json(metadata.stamped(F.col("pairs"), "tool", "--zstd 5")).alias("pairs"))


from . import export_queries, global_queries, info_queries, report_queries, rewrite_queries, texel_queries  # noqa: E402, F401  # further queries, registered by their import
