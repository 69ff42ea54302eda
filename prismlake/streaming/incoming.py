"""A stream of dropped container files through parsing and validation. Not part of the format's own tools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import descriptor, formats, validate
from ..sources import container


def files(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """New files of a folder, parsed without their payload."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_trigger).load(path)
    return container.parsed(stream, payload=False)


def issues(parsed: DataFrame, gltf: bool = False) -> DataFrame:
    """Header, section, format and descriptor issues of each file; files that cannot be parsed raise one fatal issue.

    Rules over several rows of a file (level index, order of keys) need the
    whole file's rows and are left to batches: ``validate``.
    """
    known = formats.facts(parsed.where("status = 'ok'"))
    headers = known.withColumn("compressed", F.coalesce("fact.compressed", F.lit(False))).withColumn("gltf", F.lit(gltf))
    found = validate.raised(headers, [*validate.header_rules(F.col("compressed")), *validate.format_rules(F.col("fact")), *validate.section_rules()], "path")
    for more in (validate.block_issues(headers), descriptor.byte_issues(headers), descriptor.issues(headers, "path").drop("sample")):
        found = found.unionByName(more)
    bad = parsed.where("status <> 'ok'").select("path", F.lit(2001).alias("id"), F.lit(validate.FATAL).alias("severity"), F.col("status").alias("rule"))
    return found.unionByName(bad)
