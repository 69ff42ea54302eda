"""Queries over whole validations: section indices, gaps, further descriptor rules, the ordered verdict and its report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import descriptor, paddings, report, validate
from . import global_queries, registry
from .registry import TEXTURES, _t, _textures, query

# ------------------------------------------------------------------ section indices

_K = "texture_id"
_SECTIONS = f"""{TEXTURES},
sections AS (
  SELECT *, CASE WHEN sgd_length = 0 THEN CASE WHEN {_K} % 31 = 0 THEN 8 ELSE 0 END ELSE (after_kvd + 7) // 8 * 8 + CASE WHEN {_K} % 37 = 0 THEN 8 ELSE 0 END END AS sgd_offset
  FROM (SELECT *, CASE WHEN kvd_length = 0 THEN CASE WHEN {_K} % 8 = 0 THEN 100 ELSE 0 END ELSE (start + dfd_length + 3) // 4 * 4 + CASE WHEN {_K} % 19 = 0 THEN 2 ELSE 0 END END AS kvd_offset,
      CASE WHEN kvd_length = 0 THEN start + dfd_length ELSE (start + dfd_length + 3) // 4 * 4 + kvd_length END AS after_kvd
    FROM (SELECT texture_id, n_levels, 80 + 24 * greatest(n_levels, 1) AS start, CASE WHEN {_K} % 41 = 0 THEN 0 WHEN {_K} % 13 = 0 THEN 84 + 24 * greatest(n_levels, 1) ELSE 80 + 24 * greatest(n_levels, 1) END AS dfd_offset,
        CASE WHEN {_K} % 17 = 0 THEN 0 ELSE 44 + 16 * ({_K} % 3) END AS dfd_length, CASE WHEN {_K} % 4 = 0 THEN 0 ELSE 20 + {_K} % 9 END AS kvd_length,
        CASE WHEN {_K} % 3 = 0 THEN CASE WHEN {_K} % 23 = 0 THEN 0 ELSE 64 END WHEN {_K} % 29 = 0 THEN 16 ELSE 0 END AS sgd_length, CASE {_K} % 3 WHEN 0 THEN 1 + {_K} % 2 * 3 WHEN 1 THEN 0 ELSE 2 END AS scheme
      FROM (SELECT *, CASE WHEN {_K} % 5 = 2 THEN 0 ELSE levels END AS n_levels FROM textures))))"""
_SECTION_RULES = [
    (3020, "IndexDFDMissing", "dfd_length = 0 OR dfd_offset = 0"),
    (3021, "IndexDFDInvalidOffset", "dfd_offset <> start"),
    (3022, "IndexKVDInvalidOffset", f"kvd_length > 0 AND {_K} % 19 = 0"),
    (3023, "IndexKVDOffsetWithoutLength", "kvd_length = 0 AND kvd_offset > 0"),
    (3024, "IndexSGDInvalidOffset", f"sgd_length > 0 AND {_K} % 37 = 0"),
    (3025, "IndexSGDOffsetWithoutLength", "sgd_length = 0 AND sgd_offset > 0"),
    (3026, "IndexSGDMissing", "scheme IN (1, 4) AND sgd_length = 0"),
    (3027, "IndexSGDNotApplicable", "scheme = 2 AND sgd_length > 0"),
    (3028, "IndexDFDInvalidLength", "dfd_offset > 0 AND dfd_length > 0 AND kvd_offset > 0 AND kvd_offset - dfd_offset <> dfd_length"),
]
_SECTION_ISSUES = " UNION ALL ".join(f"SELECT texture_id, {i} AS id, 'error' AS severity, '{r}' AS rule FROM sections WHERE {p}" for i, r, p in _SECTION_RULES)


def _sections(spark, sf) -> DataFrame:
    """The section indices of files that should keep them in order, and of some that do not."""
    k, n = F.col("texture_id"), F.lit
    up = lambda v, a: F.ceil(v / a) * a
    t = _textures(spark, sf).withColumn("levels", F.when(k % 5 == 2, 0).otherwise(F.col("levels")).cast("long"))
    start = 80 + 24 * F.greatest("levels", n(1))
    dfd = F.when(k % 17 == 0, 0).otherwise(44 + 16 * (k % 3))
    kvd = F.when(k % 4 == 0, 0).otherwise(20 + k % 9)
    sgd = F.when(k % 3 == 0, F.when(k % 23 == 0, 0).otherwise(64)).when(k % 29 == 0, 16).otherwise(0)
    t = t.select("texture_id", "levels", start.alias("start"), F.when(k % 41 == 0, 0).when(k % 13 == 0, start + 4).otherwise(start).alias("dfd_offset"), dfd.alias("dfd_length"), kvd.alias("kvd_length"), sgd.alias("sgd_length"), F.when(k % 3 == 0, 1 + k % 2 * 3).when(k % 3 == 1, 0).otherwise(2).alias("sc_scheme"))
    end = F.col("start") + F.col("dfd_length")
    none = F.col("kvd_length") == 0
    t = t.withColumns({"kvd_offset": F.when(none, F.when(k % 8 == 0, 100).otherwise(0)).otherwise(up(end, 4) + F.when(k % 19 == 0, 2).otherwise(0)), "after": F.when(none, end).otherwise(up(end, 4) + F.col("kvd_length"))})
    return t.withColumn("sgd_offset", F.when(F.col("sgd_length") == 0, F.when(k % 31 == 0, 8).otherwise(0)).otherwise(up(F.col("after"), 8) + F.when(k % 37 == 0, 8).otherwise(0)))


@query(f"WITH {_SECTIONS} {_SECTION_ISSUES}")
def validate_sections(spark, sf):
    return validate.raised(_sections(spark, sf), validate.section_rules(), "texture_id")


# ------------------------------------------------------------------ gaps

_BLOCKS = f"""blocks AS (
  SELECT texture_id, ordinal, CASE ordinal WHEN 0 THEN 'DFD' WHEN 1 THEN 'KVD' WHEN 2 THEN 'SGD' ELSE 'image level ' || (8 - ordinal) END AS name, start,
    CASE ordinal WHEN 0 THEN dfd_offset WHEN 1 THEN kvd_offset WHEN 2 THEN sgd_offset ELSE start + 200 + (ordinal - 3) * 96 + ({_K} * ordinal) % 7 * 8 END AS place,
    CASE ordinal WHEN 0 THEN dfd_length WHEN 1 THEN kvd_length WHEN 2 THEN sgd_length ELSE 80 + {_K} % 11 * 4 END AS size
  FROM (SELECT *, unnest(range(9)) AS ordinal FROM sections)),
there AS (SELECT * FROM blocks WHERE place > 0 AND size > 0)"""


@query(
    f"""WITH {_SECTIONS}, {_BLOCKS},
ends AS (SELECT a.texture_id, a.ordinal, max(b.place + b.size) AS e FROM there a JOIN there b ON a.texture_id = b.texture_id AND b.ordinal < a.ordinal GROUP BY ALL),
reach AS (SELECT t.*, greatest(t.start, coalesce(e, t.start)) AS r FROM there t LEFT JOIN ends ON ends.texture_id = t.texture_id AND ends.ordinal = t.ordinal)
SELECT texture_id, name, CAST(r AS BIGINT) AS gap_offset, CAST(place - r AS BIGINT) AS gap_length FROM reach WHERE place >= r"""
)
def padding_gaps(spark, sf):
    k, i, n = F.col("texture_id"), F.col("ordinal"), F.lit
    t = _sections(spark, sf).withColumn("ordinal", F.explode(F.sequence(n(0), n(8))))
    name = F.when(i == 0, "DFD").when(i == 1, "KVD").when(i == 2, "SGD").otherwise(F.concat(n("image level "), (8 - i).cast("string")))
    offset = F.when(i == 0, F.col("dfd_offset")).when(i == 1, F.col("kvd_offset")).when(i == 2, F.col("sgd_offset")).otherwise(F.col("start") + 200 + (i - 3) * 96 + (k * i) % 7 * 8)
    length = F.when(i == 0, F.col("dfd_length")).when(i == 1, F.col("kvd_length")).when(i == 2, F.col("sgd_length")).otherwise(80 + k % 11 * 4)
    return paddings.gap_intervals(t.select("texture_id", "ordinal", name.alias("name"), offset.cast("long").alias("offset"), length.cast("long").alias("length"), F.col("start").cast("long").alias("start")))


# ------------------------------------------------------------------ further rules of descriptors

# Two or three samples each: formats of single texels, of 4:2:2 blocks and of none, with channels, positions and qualifiers of all kinds.
_ODD = """odd AS (SELECT p_partkey AS texture_id, [37, 97, 1000156000, 131, 0][p_partkey % 5 + 1] AS vk_format, CASE WHEN p_partkey % 7 = 0 THEN 2 WHEN p_partkey % 5 = 3 THEN 128 WHEN p_partkey % 11 = 0 THEN 163 ELSE 1 END AS model,
  p_partkey % 2 * 2 AS scheme, 2 + p_partkey % 2 AS n, CASE WHEN p_partkey % 17 = 0 THEN 4 ELSE 0 END AS plane FROM part),
odd_samples AS (SELECT *, (texture_id + sample * 3) % 16 AS channel, CASE WHEN texture_id % 3 = 0 AND sample = 1 THEN 4 WHEN texture_id % 19 = 0 THEN 12 ELSE 0 END AS q, CASE WHEN texture_id % 13 = 0 AND sample = 0 THEN 64 ELSE 0 END AS x FROM (SELECT *, unnest(range(n)) AS sample FROM odd)),
odd_kinds AS (SELECT texture_id, max(x) > 0 AS placed, count(DISTINCT q & 12) > 1 AS mixed FROM odd_samples GROUP BY texture_id)"""
_MORE = [
    (6017, "IncorrectModelFor422", "vk_format = 1000156000 AND model <> 2"),
    (6024, "MultiplaneFormatsNotSupported", "(vk_format IN (37, 97) AND plane > 0) OR (vk_format = 0 AND scheme = 0 AND plane > 0)"),
    (6203, "InterpretDFDMixedChannels", "vk_format IN (37, 97) AND plane = 0 AND NOT placed AND mixed"),
    (6204, "InterpretDFDMultisample", "vk_format IN (37, 97) AND plane = 0 AND placed"),
]


@query(
    f"WITH {_ODD}, judged AS (SELECT o.*, k.placed, k.mixed FROM odd o JOIN odd_kinds k USING (texture_id)) "
    + " UNION ALL ".join(f"SELECT texture_id, CAST(NULL AS INT) AS sample, {i} AS id, 'error' AS severity, '{r}' AS rule FROM judged WHERE {p}" for i, r, p in _MORE)
    + " UNION ALL SELECT texture_id, CAST(sample AS INT), 6101, 'error', 'InvalidChannelForModel' FROM odd_samples WHERE CASE WHEN model IN (1, 2) THEN channel NOT IN (0, 1, 2, 13, 14, 15) WHEN model = 128 THEN channel > 1 ELSE channel NOT IN (0, 3, 4, 15) END"
)
def validate_channels(spark, sf):
    k, n = F.col("texture_id"), F.lit
    t = _t(spark, sf, "part").select(F.col("p_partkey").alias("texture_id"))
    number = F.element_at(F.array(*[n(x).cast("long") for x in (37, 97, 1000156000, 131, 0)]), (k % 5 + 1).cast("int"))
    sample = lambda i: F.struct((16 * i).cast("int").alias("bit_offset"), n(16).alias("bit_length"), ((k + i * 3) % 16).cast("int").alias("channel"), F.when((k % 3 == 0) & (i == 1), 4).when(k % 19 == 0, 12).otherwise(0).alias("qualifiers"), n(0).cast("long").alias("lower"), n(1).cast("long").alias("upper"), F.array(F.when((k % 13 == 0) & (i == 0), 64).otherwise(0), n(0), n(0), n(0)).alias("positions"))
    made = t.select(
        "texture_id", number.alias("vk_format"), (k % 2 * 2).alias("sc_scheme"), n(16).alias("height"), n(1).alias("levels"), n(False).alias("gltf"), F.when(k % 7 == 0, 2).when(k % 5 == 3, 128).when(k % 11 == 0, 163).otherwise(1).alias("model"),
        n(1).alias("primaries"), n(1).alias("transfer"), n(2).alias("dfd_version"), F.array(*[n(0)] * 4).alias("texel_block"), F.array(n(4), F.when(k % 17 == 0, 4).otherwise(0), *[n(0)] * 6).alias("planes"), F.transform(F.sequence(n(0), (1 + k % 2).cast("int")), sample).alias("samples"),
    )
    return descriptor.issues(made).where(F.col("id").isin(6101, *[i for i, _, _ in _MORE])).select("texture_id", "sample", "id", "severity", "rule")


# ------------------------------------------------------------------ the ordered verdict

# Some files end early: validation stops at the step that reads past their end, whatever its rules and later ones would find.
_CUT = "CASE WHEN texture_id % 67 = 0 THEN 0 WHEN texture_id % 71 = 0 THEN 2 WHEN texture_id % 73 = 0 THEN 3 WHEN texture_id % 79 = 0 THEN 4 WHEN texture_id % 83 = 0 THEN 5 END"
_GROUPS = [("header_issues", 0), ("format_issues", 0), ("section_issues", 1), ("descriptor_issues", 2), ("level_issues", 3), ("metadata_issues", 4), ("global_issues", 5)]


def _all_sql() -> str:
    """Issues of all groups with their step; each group keeps its own tables."""
    sources = ["validate_header", "validate_formats", "validate_sections", "validate_descriptor", "validate_levels", "validate_metadata", "validate_global_data"]
    return ", ".join(f"{name} AS ({registry.ORACLES[source]})" for (name, _), source in zip(_GROUPS, sources, strict=True))


_RAISED = " UNION ALL ".join(f"SELECT texture_id, {stage} AS stage, id, severity, rule FROM {name}" for name, stage in _GROUPS)
_ORDERED = f"""WITH {_all_sql()},
files AS (SELECT p_partkey AS texture_id FROM part), cut AS (SELECT texture_id, {_CUT} AS cut FROM files),
kept AS (SELECT r.* FROM ({_RAISED}) r JOIN cut USING (texture_id) WHERE cut IS NULL OR stage < cut
  UNION ALL SELECT texture_id, cut, 1003, 'fatal', 'UnexpectedEOF' FROM cut WHERE cut IS NOT NULL)"""


def _ordered(spark, sf) -> tuple[DataFrame, DataFrame]:
    files = _textures(spark, sf).select("texture_id")
    groups = [registry.validate_header, registry.validate_formats, validate_sections, registry.validate_descriptor, registry.validate_levels, registry.validate_metadata, global_queries.validate_global_data]
    parts = [g(spark, sf).select("texture_id", F.lit(stage).alias("stage"), "id", "severity", "rule") for g, (_, stage) in zip(groups, _GROUPS, strict=True)]
    ends = files.select("texture_id", F.expr(_CUT).alias("stage")).where("stage is not null")
    parts.append(ends.select("texture_id", "stage", F.lit(1003).alias("id"), F.lit(validate.FATAL).alias("severity"), F.lit("UnexpectedEOF").alias("rule")))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    # reading comes before the rules of its step
    order = F.col("stage") * 2 + (F.col("severity") != validate.FATAL).cast("int")
    return files, validate.until_fatal(found.withColumn("_order", order), "_order").drop("_order")


@query(
    _ORDERED
    + """
SELECT f.texture_id, CAST(count(*) FILTER (severity IN ('error', 'fatal')) AS BIGINT) AS n_errors, CAST(count(*) FILTER (severity = 'warning') AS BIGINT) AS n_warnings,
  min(stage) FILTER (severity = 'fatal') AS stopped_at, count(*) FILTER (severity IN ('error', 'fatal')) = 0 AS valid FROM files f LEFT JOIN kept k ON k.texture_id = f.texture_id GROUP BY f.texture_id"""
)
def validate_verdict(spark, sf):
    files, found = _ordered(spark, sf)
    return validate.verdict(files, found)


@query(
    _ORDERED
    + """
SELECT f.texture_id, f.texture_id NOT IN (SELECT texture_id FROM kept WHERE severity IN ('error', 'fatal')) AS valid,
  coalesce((SELECT string_agg(k.severity || '-' || lpad(CAST(k.id AS VARCHAR), 4, '0') || ': ' || k.rule, chr(10) ORDER BY k.stage, k.id, k.severity, k.rule) FROM kept k WHERE k.texture_id = f.texture_id), '') AS report FROM files f"""
)
def validate_report(spark, sf):
    files, found = _ordered(spark, sf)
    found = found.withColumnRenamed("texture_id", "path").withColumn("place", F.lit(None).cast("string"))
    lines = found.select("path", F.struct("stage", "id", "severity", "rule").alias("at"), "severity", "id", "rule", "place")
    text = report.as_lines(lines.select("path", "severity", "id", "rule", "place", "at"), keep=["at"])
    told = text.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("report"))
    gate = report.admitted(files, found, "texture_id").withColumn("valid", F.lit(True))
    out = files.join(told.withColumnRenamed("path", "texture_id"), "texture_id", "left").join(gate, "texture_id", "left")
    return out.select("texture_id", F.coalesce("valid", F.lit(False)).alias("valid"), F.coalesce("report", F.lit("")).alias("report"))
