"""Queries over exported images: names and kinds, and pixels of 4:2:2 blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, export
from . import registry
from .registry import _t, query


@query(
    f"""WITH {registry.HEADERS_3D}, n AS (SELECT *, unnest(range(CAST(greatest(layers, 1) * faces * level_depth AS BIGINT))) AS i FROM located3)
SELECT texture_id, CAST(level AS BIGINT) AS level, CAST(i // (faces * level_depth) AS BIGINT) AS layer, CAST(i // level_depth % faces AS BIGINT) AS face, CAST(i % level_depth AS BIGINT) AS slice,
  'output' || CASE WHEN levels > 1 THEN '_level' || level ELSE '' END || CASE WHEN faces = 6 THEN '_face' || (i // level_depth % faces) ELSE '' END || CASE WHEN layers > 0 THEN '_layer' || (i // (faces * level_depth)) ELSE '' END
    || CASE WHEN depth > 1 THEN '_depth' || (i % level_depth) ELSE '' END AS name,
  CASE texture_id % 5 WHEN 0 THEN 'png' WHEN 1 THEN 'exr' WHEN 2 THEN 'unpacked png' WHEN 3 THEN 'raw' ELSE 'exr' END AS kind FROM n"""
)
def export_names(spark, sf):
    k = F.col("texture_id")
    number = F.when(k % 5 == 0, 43).when(k % 5 == 1, 97).when(k % 5 == 2, 1000156000).when(k % 5 == 3, 131).otherwise(98)
    images = catalog.images(catalog.level_offsets(registry._parsed_headers(spark, sf)))
    return images.select("texture_id", "level", "layer", "face", "slice", export.names(images).alias("name"), export.kind(number).alias("kind"))


_BLOCKS = "b AS (SELECT p_partkey AS k, y, bx, (p_partkey * 7 + bx * 31 + y * 5) % 256 AS y0, (p_partkey * 3 + bx * 17) % 256 AS y1, (p_partkey + bx * bx * 29 + y) % 256 AS u, (p_size * 11 + bx * 43) % 256 AS v FROM (SELECT *, unnest(range(6)) AS bx FROM (SELECT p_partkey, p_size, unnest(range(2)) AS y FROM part)))"


def _line(a: str, b: str, share: float) -> str:
    """A code on the line between two, in the same order of operations, so that halves round alike."""
    a, b = f"CAST({a} AS DOUBLE) / 255.0", f"CAST({b} AS DOUBLE) / 255.0"
    return f"CAST(floor(({a} + ({b} - {a}) * {share}) * 255 + 0.5) AS BIGINT)"


@query(
    f"""WITH {_BLOCKS},
n AS (SELECT *, coalesce(lag(y1) OVER w, y1) AS y1l, coalesce(lead(y0) OVER w, y0) AS y0r, coalesce(lag(u) OVER w, u) AS ul, coalesce(lead(u) OVER w, u) AS ur, coalesce(lag(v) OVER w, v) AS vl, coalesce(lead(v) OVER w, v) AS vr FROM b WINDOW w AS (PARTITION BY k, y ORDER BY bx)),
p AS (SELECT k, y, 2 * bx AS x, {_line("vl", "v", 0.875)} AS r, CAST(y0 AS BIGINT) AS g, CAST(u AS BIGINT) AS b FROM n UNION ALL SELECT k, y, 2 * bx + 1, {_line("v", "vr", 0.375)}, y1, {_line("u", "ur", 0.5)} FROM n)
SELECT k AS p_partkey, y, x, r, g, b FROM p"""
)
def unpack_chroma(spark, sf):
    k, y, b, n = F.col("p_partkey"), F.col("y"), F.col("bx"), F.lit
    t = _t(spark, sf, "part").select("p_partkey", "p_size", F.explode(F.sequence(n(0).cast("long"), n(1).cast("long"))).alias("y")).withColumn("bx", F.explode(F.sequence(n(0).cast("long"), n(5).cast("long"))))
    t = t.select("p_partkey", "y", "bx", ((k * 7 + b * 31 + y * 5) % 256).alias("y0"), ((k * 3 + b * 17) % 256).alias("y1"), ((k + b * b * 29 + y) % 256).alias("u"), ((F.col("p_size") * 11 + b * 43) % 256).alias("v"))
    return export.chroma_pixels(t, ["p_partkey"], 8, v=0.75)
