"""Image operators over pixel rows (image, x, y, value): flips, mip pyramids and separable resampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flip_y(y: Column, height: Column | int) -> Column:
    return (height if isinstance(height, Column) else F.lit(height)) - 1 - y


def box_mip(pixels: DataFrame, image: str, x: str, y: str, value: str, width: int, height: int) -> DataFrame:
    """The whole mip pyramid, each level averaged from the base over power-of-two boxes."""
    levels = 1 + int(math.floor(math.log2(max(width, height))))
    each = pixels.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    shift = lambda c: F.call_function("shiftright", F.col(c).cast("int"), F.col("level"))
    return each.groupBy(image, "level", shift(x).alias("mx"), shift(y).alias("my")).agg(F.avg(value).alias("value"))


def tent(d: float) -> float:
    return max(0.0, 1 - abs(d))


def box(d: float) -> float:
    return 1.0 if -0.5 <= d < 0.5 else 0.0


def mitchell(d: float, b: float = 1 / 3, c: float = 1 / 3) -> float:
    d = abs(d)
    if d < 1:
        return ((12 - 9 * b - 6 * c) * d**3 + (-18 + 12 * b + 6 * c) * d**2 + 6 - 2 * b) / 6
    if d < 2:
        return ((-b - 6 * c) * d**3 + (6 * b + 30 * c) * d**2 + (-12 * b - 48 * c) * d + 8 * b + 24 * c) / 6
    return 0.0


def bell(d: float) -> float:
    d = abs(d)
    return 0.75 - d * d if d < 0.5 else 0.5 * (d - 1.5) ** 2 if d < 1.5 else 0.0


def lanczos(lobes: int):
    def f(d: float) -> float:
        if d == 0:
            return 1.0
        return math.sin(math.pi * d) / (math.pi * d) * math.sin(math.pi * d / lobes) / (math.pi * d / lobes) if abs(d) < lobes else 0.0

    return f


def sinc(d: float) -> float:
    return 1.0 if d == 0 else math.sin(math.pi * d) / (math.pi * d)


def exact_blackman(d: float) -> float:
    """The exact Blackman window over [-1, 1] (fixed values of its definition)."""
    return 7938 / 18608 + 9240 / 18608 * math.cos(math.pi * d) + 1430 / 18608 * math.cos(2 * math.pi * d)


def blackman(d: float) -> float:
    return sinc(d) * exact_blackman(d / 3) if abs(d) < 3 else 0.0


def gaussian(d: float) -> float:
    return math.exp(-2 * d * d) * math.sqrt(2 / math.pi) * exact_blackman(d / 1.25) if abs(d) < 1.25 else 0.0


def _bessel0(x: float) -> float:
    total, term, k = 1.0, 1.0, 1
    while term > total * 1e-16:
        term *= (x / (2 * k)) ** 2
        total += term
        k += 1
    return total


def kaiser(d: float, attenuation: float = 40.0) -> float:
    """Windowed by Kaiser's formula for an attenuation in decibels."""
    alpha = 0.58417 * (attenuation - 20.96) ** 0.4 + 0.07886 * (attenuation - 20.96)
    return sinc(d) * _bessel0(alpha * math.sqrt(1 - (d / 3) ** 2)) / _bessel0(alpha) if abs(d) < 3 else 0.0


def quadratic(r: float):
    """Dodgson's family: 1 interpolates, 0.5 approximates."""

    def f(d: float) -> float:
        d = abs(d)
        return -2 * r * d * d + (r + 1) / 2 if d < 0.5 else r * d * d - (2 * r + 0.5) * d + 0.75 * (r + 1) if d < 1.5 else 0.0

    return f


#: name: (kernel, half-width)
FILTERS = {
    "box": (box, 0.5),
    "tent": (tent, 1.0),
    "bell": (bell, 1.5),
    "b-spline": (lambda d: mitchell(d, 1, 0), 2.0),
    "mitchell": (mitchell, 2.0),
    "catmullrom": (lambda d: mitchell(d, 0, 0.5), 2.0),
    "lanczos3": (lanczos(3), 3.0),
    "lanczos4": (lanczos(4), 4.0),
    "lanczos6": (lanczos(6), 6.0),
    "lanczos12": (lanczos(12), 12.0),
    "blackman": (blackman, 3.0),
    "kaiser": (kaiser, 3.0),
    "gaussian": (gaussian, 1.25),
    "quadratic_interp": (quadratic(1.0), 1.5),
    "quadratic_approx": (quadratic(0.5), 1.5),
    "quadratic_mix": (quadratic(0.8), 1.5),
}


def _source(i: int, n: int, wrap: str) -> int:
    if wrap == "wrap":
        return i % n
    if wrap == "reflect":
        i %= 2 * n
        return i if i < n else 2 * n - 1 - i
    return min(max(i, 0), n - 1)


def weights(source: int, target: int, kernel: str, wrap: str = "clamp") -> list[tuple[int, int, float]]:
    """(target position, source position, weight) of one axis; weights of a target position sum to 1."""
    f, half = FILTERS[kernel]
    scale = max(source / target, 1.0)
    out = []
    for t in range(target):
        centre = (t + 0.5) * source / target - 0.5
        taps: dict[int, float] = {}
        for i in range(math.floor(centre - half * scale), math.ceil(centre + half * scale) + 1):
            if w := f((i - centre) / scale):
                k = _source(i, source, wrap)
                taps[k] = taps.get(k, 0.0) + w
        total = sum(taps.values())
        out += [(t, k, w / total) for k, w in sorted(taps.items())]
    return out


def resample(pixels: DataFrame, image: str, x: str, y: str, value: str, source: tuple[int, int], target: tuple[int, int], kernel: str = "tent", wrap: str = "clamp") -> DataFrame:
    """Separable resampling: a weights table joined on x, summed, then on y. Its size is that of the image's edges."""
    spark = pixels.sparkSession
    wx = spark.createDataFrame(weights(source[0], target[0], kernel, wrap), f"tx int, {x} int, wx double")
    wy = spark.createDataFrame(weights(source[1], target[1], kernel, wrap), f"ty int, {y} int, wy double")
    across = pixels.join(F.broadcast(wx), x).groupBy(image, "tx", y).agg(F.sum(F.col(value) * F.col("wx")).alias("_v"))
    return across.join(F.broadcast(wy), y).groupBy(image, "tx", "ty").agg(F.sum(F.col("_v") * F.col("wy")).alias("value"))


def mip_pyramid(pixels: DataFrame, image: str, x: str, y: str, value: str, width: int, height: int, kernel: str = "lanczos4", wrap: str = "clamp") -> DataFrame:
    """The whole mip pyramid (image, level, tx, ty, value), each level resampled from the base; level 0 is the base itself.

    The weights of all levels are one table each way, so that the base is read
    and shuffled twice, whatever the number of levels.
    """
    spark = pixels.sparkSession
    levels = 1 + int(math.floor(math.log2(max(width, height))))
    size = lambda n, k: max(n >> k, 1)
    each = lambda n: [(k, *w) for k in range(1, levels) for w in weights(n, size(n, k), kernel, wrap)]
    wx = spark.createDataFrame(each(width), f"level int, tx int, {x} int, wx double")
    wy = spark.createDataFrame(each(height), f"level int, ty int, {y} int, wy double")
    across = pixels.join(F.broadcast(wx), x).groupBy(image, "level", "tx", y).agg(F.sum(F.col(value) * F.col("wx")).alias("_v"))
    small = across.join(F.broadcast(wy), ["level", y]).groupBy(image, "level", "tx", "ty").agg(F.sum(F.col("_v") * F.col("wy")).alias("value"))
    base = pixels.select(image, F.lit(0).alias("level"), F.col(x).alias("tx"), F.col(y).alias("ty"), F.col(value).cast("double").alias("value"))
    return base.unionByName(small)
