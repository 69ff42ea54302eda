"""Images out of containers: where each goes and as what, their raw bytes, and pixels of 4:2:2 blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bits import float_to_unorm, unorm_to_float
from . import formats, texels


def kind(vk_format: Column) -> Column:
    """The kind of file that holds an image of a format: "png" (normalised), "exr" (integers and floats), "unpacked png" (4:2:2), else "raw"."""
    normal, real = [], []
    for name, (number, source, _) in texels.targets().items():
        (normal if source == "unorm" else real).append(number)
    one_plane = formats.half_chroma(vk_format) & ~formats.prohibited_extension(vk_format)
    return F.when(vk_format.isin(normal), "png").when(vk_format.isin(real), "exr").when(one_plane, "unpacked png").otherwise("raw")


def names(images: DataFrame) -> Column:
    """An image's name: parts that its texture has only one of are left out. Over levels, faces, layers, depth (of the header), level, face, layer, slice."""
    c = F.col
    part = lambda there, text, n: F.when(there, F.concat(F.lit(f"_{text}"), c(n).cast("string"))).otherwise("")
    return F.concat(F.lit("output"), part(c("levels") > 1, "level", "level"), part(c("faces") == 6, "face", "face"), part(c("layers") > 0, "layer", "layer"), part(c("depth") > 1, "depth", "slice"))


def raw_images(images: DataFrame, payloads: DataFrame, key: str = "texture_id") -> DataFrame:
    """(key, name, content): the bytes of each image (its offset and size in its level's payload), for ``write.format("texture")``.

    ``payloads`` has (key, level, bytes); images that do not lie within them are
    left out.
    """
    both = images.join(payloads, [key, "level"]).where((F.col("offset") >= 0) & (F.col("offset") + F.col("size") <= F.length("bytes")))
    content = F.col("bytes").substr((F.col("offset") + 1).cast("int"), F.col("size").cast("int"))
    return both.select(key, F.concat(names(images), F.lit(".raw")).alias("name"), content.alias("content"))


def _between(at: float, points: list[tuple[float, Column]]) -> Column:
    """The value at a place by straight lines through points; beyond the inner ones the outer lines go on."""
    k = next((i for i in range(1, len(points) - 1) if at < points[i][0]), len(points) - 1)
    (a, u), (b, v) = points[k - 1], points[k]
    return u + (v - u) * ((at - a) / (b - a))


def chroma_pixels(blocks: DataFrame, keys: list[str], bits: int, left: float = 0.5, right: float = 1.5, u: float = 0.5, v: float = 0.5) -> DataFrame:
    """(keys, y, x, r, g, b) of rows (keys, y, bx, y0, y1, u, v): each block of two luma and one chroma pair becomes two pixels.

    Samples lie at the places given, in pixels of their block; between blocks
    values are interpolated, at a line's ends the end block stands for its
    neighbour. Red is of v, green of luma, blue of u.
    """
    line = Window.partitionBy(*keys, "y").orderBy("bx")
    real = {n: unorm_to_float(F.col(n), bits) for n in ("y0", "y1", "u", "v")}
    at = blocks.select(*keys, "y", "bx", *[x.alias(n) for n, x in real.items()])
    near = {f"{n}{way}": F.coalesce(step(n).over(line), F.col(n)) for way, step in (("_l", F.lag), ("_r", F.lead)) for n in ("y0", "y1", "u", "v")}
    at = at.withColumns(near)
    flat = lambda n, place: [(place - 2, F.col(f"{n}_l")), (place, F.col(n)), (place + 2, F.col(f"{n}_r"))]
    luma = [(right - 2, F.col("y1_l")), (left, F.col("y0")), (right, F.col("y1")), (left + 2, F.col("y0_r"))]
    pixel = lambda i: F.struct((F.col("bx") * 2 + i).alias("x"), *[float_to_unorm(_between(i + 0.5, points), bits).alias(n) for n, points in (("r", flat("v", v)), ("g", luma), ("b", flat("u", u)))])
    return at.select(*keys, "y", F.explode(F.array(pixel(0), pixel(1))).alias("p")).select(*keys, "y", "p.*")
