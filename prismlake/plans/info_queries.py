"""Queries over what files are: their documents, and facts of their descriptors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import info
from . import registry
from .registry import _CHANGED, _DESCRIPTORS, TEXTURES, _descriptors, _textures, query

_COUNT = "(SELECT count(DISTINCT s[3]) FROM (SELECT unnest(left_) AS s))"


@query(
    f"""WITH {_DESCRIPTORS}, {_CHANGED}, own AS (SELECT texture_id, vk_format, sc_scheme, model, CASE WHEN cut THEN samples[2:] ELSE samples END AS left_ FROM changed)
SELECT texture_id, CASE WHEN model = 166 THEN CASE WHEN len(left_) > 0 THEN 3 END ELSE len(list_distinct([s[3] for s in left_])) END AS components,
  CAST(coalesce(list_max([list_sum([CASE WHEN s[3] = c THEN s[2] ELSE 0 END for s in left_]) for c in range(16)]), 0) AS INT) AS channel_bits, model IN (163, 166, 168) AS transcoded, model IN (163, 166, 167, 168) AS transcodable,
  len([s for s in left_ if s[4] & 8 > 0]) > 0 OR model IN (133, 167, 168) AS high_range,
  CASE WHEN sc_scheme <> 0 THEN 'supercompressed' WHEN vk_format NOT IN (9, 15, 16, 22, 23, 29, 37, 43) THEN 'format' END AS basis, CASE WHEN sc_scheme <> 0 THEN 'supercompressed' WHEN model = 162 THEN 'already of that model' END AS astc FROM own"""
)
def descriptor_facts(spark, sf):
    facts = {"components": info.components(), "channel_bits": info.largest_channel_bits(), "transcoded": info.needs_transcoding(), "transcodable": info.transcodable(), "high_range": info.high_range(), "basis": info.refused_encoding("basis"), "astc": info.refused_encoding("astc")}
    return _descriptors(spark, sf).select("texture_id", *[v.alias(n) for n, v in facts.items()])


@query(
    f"""WITH {registry.HEADERS_3D},
asked AS (SELECT texture_id, layers, faces, depth, levels, CASE WHEN texture_id % 3 = 0 THEN texture_id % 5 END AS lv, CASE WHEN texture_id % 4 < 2 THEN texture_id % 7 END AS ly, CASE WHEN texture_id % 5 < 2 THEN texture_id % 8 END AS fc, CASE WHEN texture_id % 6 = 1 THEN texture_id % 9 END AS sl FROM headers3)
SELECT texture_id, CASE WHEN lv >= greatest(levels, 1) THEN 'level is missing' WHEN ly IS NOT NULL AND layers = 0 THEN 'no array' WHEN ly >= layers THEN 'layer is missing' WHEN fc IS NOT NULL AND faces <> 6 THEN 'no cube map' WHEN fc >= faces THEN 'face is missing'
  WHEN sl IS NOT NULL AND depth = 0 THEN 'no 3D texture' WHEN sl >= greatest(depth // (1 << CAST(coalesce(lv, 0) AS INT)), 1) THEN 'slice is missing' END AS refused FROM asked"""
)
def selection_legality(spark, sf):
    k = F.col("texture_id")
    ask = [F.when(k % 3 == 0, k % 5), F.when(k % 4 < 2, k % 7), F.when(k % 5 < 2, k % 8), F.when(k % 6 == 1, k % 9)]
    return registry._parsed_headers(spark, sf).select("texture_id", info.refused_selection(*ask).alias("refused"))


@query(
    f"""WITH {TEXTURES}, n AS (SELECT texture_id AS k, * FROM textures)
SELECT k AS texture_id, to_json({{'vkFormat': CASE WHEN k % 4 = 0 THEN 'VK_FORMAT_R8G8B8A8_UNORM' WHEN k % 4 = 1 THEN 'VK_FORMAT_BC1_RGB_UNORM_BLOCK' WHEN k % 4 = 2 THEN 'VK_FORMAT_R10X6_UNORM_PACK16' ELSE '1000999999' END,
  'scheme': CASE k % 5 WHEN 0 THEN 'KTX_SS_NONE' WHEN 1 THEN 'KTX_SS_BASIS_LZ' WHEN 2 THEN 'KTX_SS_ZSTD' WHEN 3 THEN 'KTX_SS_ZLIB' ELSE '4' END, 'primaries': CASE k % 3 WHEN 0 THEN 'UNSPECIFIED' WHEN 1 THEN 'BT709' ELSE '77' END}}) AS names FROM n"""
)
def enum_names(spark, sf):
    k = F.col("texture_id")
    number = F.when(k % 4 == 0, 37).when(k % 4 == 1, 131).when(k % 4 == 2, 1000156007).otherwise(1000999999)
    names = F.struct(info.format_name(number).alias("vkFormat"), info.named(k % 5, info.SCHEMES).alias("scheme"), info.named(F.when(k % 3 == 2, 77).otherwise(k % 3), info.PRIMARIES).alias("primaries"))
    return _textures(spark, sf).select("texture_id", F.to_json(names).alias("names"))
