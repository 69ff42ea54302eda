"""The texture catalog: textures, their mip levels and images, as DataFrames.

``synthetic_textures`` derives a catalog from the ``part`` table so that each
operator can run, and be compared with SQL, on tables of any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizes import align, at_level, ceil_div, image_bytes, lcm4, level_count


def synthetic_textures(part: DataFrame) -> DataFrame:
    """texture_id, width, height, depth, faces, layers, levels, block_w, block_h, block_bytes, sc_scheme."""
    key = F.col("p_partkey")
    cube = key % 11 == 0
    kind = key % 3
    t = part.select(
        key.alias("texture_id"),
        (F.col("p_size") * 16).cast("long").alias("width"),
        F.when(cube, F.col("p_size") * 16).otherwise((key % 7 + 1) * 32).cast("long").alias("height"),
        F.lit(1).cast("long").alias("depth"),
        F.when(cube, 6).otherwise(1).cast("long").alias("faces"),
        (1 + kind).cast("long").alias("layers"),
        F.when(kind == 0, 1).otherwise(4).cast("long").alias("block_w"),
        F.when(kind == 0, 1).otherwise(4).cast("long").alias("block_h"),
        F.when(kind == 0, 4).when(kind == 1, 8).otherwise(16).cast("long").alias("block_bytes"),
        F.when(key % 5 == 0, 2).otherwise(0).cast("long").alias("sc_scheme"),
    )
    return t.withColumn("levels", level_count(F.col("width"), F.col("height")))


def levels(textures: DataFrame) -> DataFrame:
    """One row per mip level with its image, level and padded sizes.

    A header may say 0: levels (one, the rest is made when loaded), layers (no
    array) and depth (not 3D) count as one. Depth halves with each level;
    ``block_d``, if there, is the depth of a block.
    """
    one = F.lit(1).cast("long")
    exploded = textures.withColumn("level", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("levels"), one) - 1)))
    w, h, d = (at_level(F.col(c), F.col("level")) for c in ("width", "height", "depth"))
    sized = exploded.withColumns({"level_width": w, "level_height": h, "level_depth": ceil_div(d, F.col("block_d")) if "block_d" in textures.columns else d})
    image = image_bytes(F.col("level_width"), F.col("level_height"), F.col("block_w"), F.col("block_h"), F.col("block_bytes"))
    sized = sized.withColumn("image_size", image).withColumn("level_size", F.col("image_size") * F.greatest(F.col("layers"), one) * F.col("faces") * F.col("level_depth"))
    return sized.withColumn("padded_size", align(F.col("level_size"), F.when(F.col("sc_scheme") == 0, lcm4(F.col("block_bytes"))).otherwise(F.lit(1))))


def level_offsets(textures: DataFrame) -> DataFrame:
    """Offset of each level in the payload: the padded sizes of all higher levels, which are stored first."""
    before = Window.partitionBy("texture_id").orderBy(F.col("level").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return levels(textures).withColumn("byte_offset", F.coalesce(F.sum("padded_size").over(before), F.lit(0)).cast("long"))


def level_totals(textures: DataFrame) -> DataFrame:
    """Payload bytes of each texture, padded and plain, and its number of images."""
    return (
        levels(textures)
        .groupBy("texture_id")
        .agg(F.sum("padded_size").cast("long").alias("data_size"), F.sum("level_size").cast("long").alias("plain_size"), F.sum(F.greatest(F.col("layers"), F.lit(1)) * F.col("faces") * F.col("level_depth")).cast("long").alias("n_images"))
    )


def images(located: DataFrame) -> DataFrame:
    """One row per image (level, layer, face, and depth slice of 3D textures) of located levels, with its own offset."""
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(1).cast("long")) - 1))
    each = located.withColumn("layer", upto(F.col("layers"))).withColumn("face", upto(F.col("faces"))).withColumn("slice", upto(F.col("level_depth")))
    before = (F.col("layer") * F.col("faces") + F.col("face")) * F.col("level_depth") + F.col("slice")
    return each.withColumn("image_offset", F.col("byte_offset") + before * F.col("image_size"))


def image_position(n: int, levels_: int, layers: int, faces: int) -> tuple[int, int, int]:
    """Where the n-th input image goes: levels vary slowest, then layers, then faces."""
    return n // (layers * faces) % levels_, n // faces % layers, n % faces


def block_grid(located: DataFrame) -> DataFrame:
    """Blocks across and down each level."""
    return located.withColumns({"blocks_x": ceil_div(F.col("level_width"), F.col("block_w")), "blocks_y": ceil_div(F.col("level_height"), F.col("block_h"))})
