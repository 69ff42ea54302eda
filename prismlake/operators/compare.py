"""Structured comparison of two catalogs: rows of (path, left, right) that differ."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fields(left: DataFrame, right: DataFrame, on: list[str], names: list[str], section: str) -> DataFrame:
    """Field-by-field differences of two tables; a row that one side lacks differs in all fields.

    Returns the key columns, section, path, left_value, right_value and present
    (both, left or right).
    """
    a = left.select(*on, *[F.col(n).alias(f"_l_{n}") for n in names], F.lit(1).alias("_l"))
    b = right.select(*on, *[F.col(n).alias(f"_r_{n}") for n in names], F.lit(1).alias("_r"))
    both = a.join(b, on, "full_outer")
    present = F.when(F.col("_l").isNull(), "right").when(F.col("_r").isNull(), "left").otherwise("both")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("path"), F.col(f"_l_{n}").cast("string").alias("left_value"), F.col(f"_r_{n}").cast("string").alias("right_value")) for n in names]))
    rows = both.select(*on, F.lit(section).alias("section"), present.alias("present"), each.alias("d")).select(*on, "section", "present", "d.*")
    return rows.where((F.col("present") != "both") | ~F.col("left_value").eqNullSafe(F.col("right_value")))


def metadata(left: DataFrame, right: DataFrame, ignore: DataFrame | None = None, on: str = "texture_id") -> DataFrame:
    """Differences of key/value metadata: changed, left only and right only.

    A present but empty value differs from a missing one. Keys of ``ignore`` are left out.
    """
    if ignore is not None:
        left, right = (t.join(ignore, "key", "left_anti") for t in (left, right))
    a = left.select(on, "key", F.col("value").alias("left_value"), F.lit(1).alias("_l"))
    b = right.select(on, "key", F.col("value").alias("right_value"), F.lit(1).alias("_r"))
    both = a.join(b, [on, "key"], "full_outer")
    kind = F.when(F.col("_l").isNull(), "right").when(F.col("_r").isNull(), "left").when(~F.col("left_value").eqNullSafe(F.col("right_value")), "changed")
    return both.withColumn("kind", kind).where("kind is not null").select(on, "key", "kind", "left_value", "right_value")


def payload(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Raw payload comparison: the cheap tests first (presence, length, hash)."""
    a = left.select(*on, F.col("bytes").alias("_a"))
    b = right.select(*on, F.col("bytes").alias("_b"))
    same = (F.length("_a") == F.length("_b")) & (F.sha2("_a", 256) == F.sha2("_b", 256))
    return a.join(b, on, "full_outer").select(*on, F.length("_a").alias("left_length"), F.length("_b").alias("right_length"), F.coalesce(same, F.col("_a").isNull() & F.col("_b").isNull()).alias("equal")).where("not equal")


def first_differences(diffs: DataFrame, per: list[str], order: list[str], limit: int) -> DataFrame:
    """The first ``limit`` differences of each group and their total, as the report shows them."""
    w = Window.partitionBy(*per)
    return diffs.withColumn("n_differences", F.count("*").over(w)).withColumn("rank", F.row_number().over(w.orderBy(*order))).where(F.col("rank") <= limit)
