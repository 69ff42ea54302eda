"""Gaps between the blocks of a file: the complement of its sections and levels, in the order in which they are checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .validate import ERROR


def gap_intervals(blocks: DataFrame, key: str = "texture_id") -> DataFrame:
    """(key, name, gap_offset, gap_length): the gap before each block, over blocks (key, ordinal, name, offset, length, start).

    ``start`` is where the first block may begin. A gap lies between the
    furthest end so far and a block that begins there or later; blocks that
    begin before it, and those without offset or length, have none.
    """
    before = Window.partitionBy(key).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    there = blocks.where((F.col("offset") > 0) & (F.col("length") > 0))
    seen = there.withColumn("reached", F.greatest("start", F.coalesce(F.max(F.col("offset") + F.col("length")).over(before), F.col("start"))))
    return seen.where(F.col("offset") >= F.col("reached")).select(key, "name", F.col("reached").alias("gap_offset"), (F.col("offset") - F.col("reached")).alias("gap_length"))


def issues(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, place, id, severity, rule) of the first byte that is not zero in each gap, as the examined files list them."""
    found = files.select(key, F.explode("paddings").alias("p"))
    return found.select(key, F.col("p.before").alias("place"), F.lit(7011).alias("id"), F.lit(ERROR).alias("severity"), F.lit("PaddingNotZero").alias("rule"))
