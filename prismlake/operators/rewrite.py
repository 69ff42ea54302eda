"""Rewriting of containers: offsets of compressed levels, the parameter string of a deflation, and replaced images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tools whose options are known by name, and how their own deflate options look.
OWN_TOOLS, OWN_OPTION = "ktx (?:create|deflate|encode|transcode)", " ?--(?:zlib|zstd) [1-9][0-9]?"
OLD_TOOLS, OLD_OPTION = "ktxsc|toktx", " ?--zcmp ?[1-9]?[0-9]? ?"


def compressed_index(levels: DataFrame, key: str = "texture_id") -> DataFrame:
    """(key, level, byte_offset, byte_length, uncompressed_length) over (key, level, byte_length, compressed_length, start): levels follow each other from the smallest on, without padding."""
    down = Window.partitionBy(key).orderBy(F.col("level").desc()).rowsBetween(Window.unboundedPreceding, -1)
    offset = F.col("start") + F.coalesce(F.sum("compressed_length").over(down), F.lit(0))
    return levels.select(key, "level", offset.alias("byte_offset"), F.col("compressed_length").alias("byte_length"), F.col("byte_length").alias("uncompressed_length"))


def _without_first(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, f"(?s)^(.*?){pattern}", "$1")


def deflation(writer: Column, params: Column, tool: str, options: str) -> tuple[Column, Column]:
    """Writer and parameters after a deflation by ``tool`` with ``options`` ("--zstd 18"); null or empty texts are absent.

    Options of a tool of the family stay and its deflate option is replaced, and
    so stays that writer; those of others are kept behind the new option, named
    by the first word of their writer.
    """
    w, p = F.coalesce(writer, F.lit("")), F.coalesce(params, F.lit(""))
    known = (p != "") & (w != "")
    own = known & w.rlike(OWN_TOOLS)
    left = F.when(own, _without_first(p, OWN_OPTION)).when(known & w.rlike(OLD_TOOLS), _without_first(p, OLD_OPTION)).otherwise(p)
    stays = own & (left != "")
    name = F.when(known & ~own, F.split(w, " ")[0]).otherwise("")
    told = F.when(left == "", options).when(stays, F.concat(left, F.lit(f" {options}"))).otherwise(F.concat(F.lit(f"{options} / (from "), name, F.lit(") "), left))
    return F.when(stays, w).otherwise(tool), told


def patched(payloads: DataFrame, patches: DataFrame, key: str = "texture_id") -> DataFrame:
    """(key, payload) with the byte ranges of ``patches`` (key, seq, at, bytes) replaced; where several cover a byte the greatest seq counts.

    Patches are cut at each other's ends, each piece takes the latest patch that
    covers it, and payload and pieces are joined once. Patches that do not lie
    within the payload are refused, empty ones change nothing.
    """
    sized = payloads.select(key, F.length("payload").cast("long").alias("size"))
    fit = patches.select(key, "seq", F.col("at").cast("long").alias("at"), "bytes", F.length("bytes").cast("long").alias("n")).where("n > 0")
    fit = fit.join(sized, key).where((F.col("at") >= 0) & (F.col("at") + F.col("n") <= F.col("size")))
    ends = fit.select(key, "size", F.explode(F.array(F.col("at"), F.col("at") + F.col("n"))).alias("low")).unionByName(sized.join(fit.select(key).distinct(), key).select(key, "size", F.lit(0).cast("long").alias("low"))).distinct()
    up = Window.partitionBy(key).orderBy("low")
    pieces = ends.withColumn("high", F.coalesce(F.lead("low").over(up), F.col("size"))).where("low < high")
    cover = pieces.alias("p").join(fit.alias("f"), (F.col(f"p.{key}") == F.col(f"f.{key}")) & (F.col("f.at") <= F.col("p.low")) & (F.col("f.at") + F.col("f.n") >= F.col("p.high")), "left")
    body = F.col("f.bytes").substr((F.col("p.low") - F.col("f.at") + 1).cast("int"), (F.col("p.high") - F.col("p.low")).cast("int"))
    latest = cover.groupBy(F.col(f"p.{key}").alias(key), F.col("p.low").alias("low"), F.col("p.high").alias("high")).agg(F.max_by(F.hex(body), F.col("f.seq")).alias("new"))
    lists = latest.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("low", "high", "new"))).alias("pieces"))
    old = lambda p: F.hex(F.col("payload").substr((p["low"] + 1).cast("int"), (p["high"] - p["low"]).cast("int")))
    whole = F.unhex(F.array_join(F.transform("pieces", lambda p: F.coalesce(p["new"], old(p))), ""))
    return payloads.join(lists, key, "left").select(key, F.when(F.col("pieces").isNull(), F.col("payload")).otherwise(whole).alias("payload"))


def image_patches(images: DataFrame, new: DataFrame, key: str = "texture_id") -> DataFrame:
    """Patches that set images (key, seq, level, layer, face, slice, bytes), by the images' offsets and sizes; those of another size are refused."""
    place = [key, "level", "layer", "face", "slice"]
    return new.join(images.select(*place, "image_offset", "image_size"), place).where(F.length("bytes") == F.col("image_size")).select(key, "seq", F.col("image_offset").alias("at"), "bytes")
