"""Queries over rewriting: compressed indices, parameter strings, replaced byte ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.bits import little_endian_hex
from ..operators import catalog, rewrite
from .registry import LEVELS, _t, _textures, query


@query(
    f"""WITH {LEVELS}, small AS (SELECT texture_id, level, level_size, level_size * (texture_id % 5 + 1) // 7 + level AS packed FROM levels_)
SELECT a.texture_id, a.level, CAST(205 + coalesce(sum(b.packed), 0) AS BIGINT) AS byte_offset, a.packed AS byte_length, a.level_size AS uncompressed_length
FROM small a LEFT JOIN small b ON a.texture_id = b.texture_id AND b.level > a.level GROUP BY a.texture_id, a.level, a.packed, a.level_size"""
)
def deflate_index(spark, sf):
    t = catalog.level_offsets(_textures(spark, sf))
    packed = F.floor(F.col("level_size") * (F.col("texture_id") % 5 + 1) / 7) + F.col("level")
    return rewrite.compressed_index(t.select("texture_id", "level", F.col("level_size").alias("byte_length"), packed.alias("compressed_length"), F.lit(205).alias("start")))


_WRITERS = ["ktx create v4", "ktx deflate v4", "toktx v4.3", "ktxsc v1", "other 1.0", ""]
_PARAMS = ["--zstd 18", "--encode uastc --zstd 5 --zlib 3", "--encode basis", "--zcmp 19 --uastc 2", "", "--bcmp --zcmp", "--qlevel 3 --zlib 9"]


def _pick(texts: list[str], by: str) -> str:
    return f"[{', '.join(repr(t) for t in texts)}][{by} + 1]"


@query(
    f"""WITH t AS (SELECT p_partkey, {_pick(_WRITERS, 'p_partkey % 6')} AS w, {_pick(_PARAMS, 'p_partkey // 6 % 7')} AS p FROM part),
f AS (SELECT *, w <> '' AND p <> '' AS known, w LIKE 'ktx create%' OR w LIKE 'ktx deflate%' AS own FROM t),
l AS (SELECT *, CASE WHEN known AND own THEN regexp_replace(p, ' ?--(zlib|zstd) [1-9][0-9]?', '') WHEN known AND w[:5] IN ('toktx', 'ktxsc') THEN regexp_replace(p, ' ?--zcmp ?[1-9]?[0-9]? ?', '') ELSE p END AS rest FROM f)
SELECT p_partkey, CASE WHEN known AND own AND rest <> '' THEN w ELSE 'prism 1' END AS writer,
  CASE WHEN rest = '' THEN '--zstd 7' WHEN known AND own THEN rest || ' --zstd 7' ELSE '--zstd 7 / (from ' || CASE WHEN known THEN split_part(w, ' ', 1) ELSE '' END || ') ' || rest END AS params FROM l"""
)
def deflate_params(spark, sf):
    k = F.col("p_partkey")
    at = lambda texts, i: F.element_at(F.array(*[F.lit(t) for t in texts]), (i + 1).cast("int"))
    writer, params = rewrite.deflation(at(_WRITERS, k % 6), at(_PARAMS, F.floor(k / 6) % 7), "prism 1", "--zstd 7")
    return _t(spark, sf, "part").select("p_partkey", writer.alias("writer"), params.alias("params"))


_PATCHES = "patch AS (SELECT p_partkey AS k, j, (p_partkey * 7 + j * 37) % 110 AS at_, 5 + (p_partkey + j * 3) % 20 AS n, (p_partkey + j * 5) % 7 AS seq FROM (SELECT p_partkey, unnest(range(p_partkey % 6)) AS j FROM part))"


@query(
    f"""WITH {_PATCHES}, byte AS (SELECT p_partkey AS k, unnest(range(120)) AS i FROM part),
hit AS (SELECT b.k, b.i, arg_max((p.k * 3 + p.j * 50 + b.i - p.at_) % 256, p.seq * 10 + p.j) AS v FROM byte b JOIN patch p ON p.k = b.k AND b.i >= p.at_ AND b.i < p.at_ + p.n AND p.at_ + p.n <= 120 GROUP BY b.k, b.i)
SELECT b.k AS texture_id, string_agg(printf('%02X', coalesce(h.v, (b.k + b.i) % 251)), '' ORDER BY b.i) AS payload FROM byte b LEFT JOIN hit h ON h.k = b.k AND h.i = b.i GROUP BY b.k"""
)
def patch_payloads(spark, sf):
    k, n, j = F.col("p_partkey"), F.lit, F.col("j")
    text = lambda size, f: F.unhex(F.array_join(F.transform(F.sequence(n(0), size - 1), lambda i: little_endian_hex(f(i), 1)), ""))
    part = _t(spark, sf, "part")
    payloads = part.select(k.alias("texture_id"), text(n(120), lambda i: (k + i) % 251).alias("payload"))
    each = part.where(k % 6 > 0).select("p_partkey", F.explode(F.sequence(n(0), (k % 6 - 1).cast("int"))).alias("j"))
    size = (5 + (k + j * 3) % 20).cast("int")
    patches = each.select(k.alias("texture_id"), ((k + j * 5) % 7 * 10 + j).alias("seq"), ((k * 7 + j * 37) % 110).alias("at"), text(size, lambda i: (k * 3 + j * 50 + i) % 256).alias("bytes"))
    return rewrite.patched(payloads, patches).select("texture_id", F.hex("payload").alias("payload"))
