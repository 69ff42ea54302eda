"""Quality metrics and ranges of images given as (image id, position, value) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def psnr(a: Column, b: Column, peak: float = 255.0) -> Column:
    """Aggregate: peak signal-to-noise ratio in dB; null where the images are equal."""
    mse = F.avg((a - b) * (a - b))
    return F.when(mse > 0, 10 * F.log10(F.lit(peak * peak) / mse))


def ssim(a: Column, b: Column, peak: float = 255.0) -> Column:
    """Aggregate: structural similarity over the grouped pixels (Wang et al. 2004, one window)."""
    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
    ma, mb = F.avg(a), F.avg(b)
    va, vb = F.avg(a * a) - ma * ma, F.avg(b * b) - mb * mb
    cov = F.avg(a * b) - ma * mb
    return (2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))


def windowed_ssim(pixels: DataFrame, image: str, x: str, y: str, a: str, b: str, window: int = 8, peak: float = 255.0) -> DataFrame:
    """Mean over windows of ``window`` x ``window`` pixels that do not overlap."""
    tiles = pixels.groupBy(image, F.floor(F.col(x) / window).alias("_tx"), F.floor(F.col(y) / window).alias("_ty")).agg(ssim(F.col(a), F.col(b), peak).alias("s"))
    return tiles.groupBy(image).agg(F.avg("s").alias("ssim"))


def channel_range(v: Column) -> list[Column]:
    """Aggregates: least and greatest value."""
    return [F.min(v).alias("min_value"), F.max(v).alias("max_value")]


def auto_range(pixels: DataFrame, image: str, value: str) -> DataFrame:
    """Maps each image to [0, 1] by its own least and greatest value; adds scale, offset and mapped."""
    w = Window.partitionBy(image)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    scaled = pixels.withColumns({"_lo": lo, "_hi": hi})
    scale = F.when(F.col("_hi") > F.col("_lo"), 1 / F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo"))).otherwise(F.lit(1.0))
    out = scaled.withColumn("scale", scale).withColumn("offset", -F.col("_lo") * F.col("scale"))
    return out.withColumn("mapped", F.col(value) * F.col("scale") + F.col("offset")).drop("_lo", "_hi")
