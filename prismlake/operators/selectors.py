"""Fragment selectors such as ``m=0,2&a=1&f=0,6``: half-open ranges over mip level, array layer and face."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys of the supported dimensions; time and region selectors are rejected.
KEYS = {"m": "level", "a": "layer", "f": "face"}
RANGE = "struct<begin:bigint,end:bigint>"


def ranges(fragment: Column, key: str) -> Column:
    """Array of (begin, end) of a key; null if the fragment does not have it.

    A single number n selects n alone; a missing begin is 0, a missing end is open (null).
    """
    own = F.filter(F.split(fragment, "&"), lambda p: p.startswith(f"{key}="))

    def parsed(part: Column) -> Column:
        body = F.substring_index(part, "=", -1)
        # no comma: one index; else each side may be missing
        lo = F.regexp_extract(body, r"^(\d*)", 1)
        hi = F.regexp_extract(body, r"^\d*,(\d*)$", 1)
        begin = F.when(lo == "", F.lit(0)).otherwise(lo.cast("long"))
        end = F.when(~body.contains(","), begin + 1).when(hi == "", F.lit(None).cast("long")).otherwise(hi.cast("long"))
        return F.struct(begin.cast("long").alias("begin"), end.cast("long").alias("end"))

    return F.when(F.size(own) > 0, F.transform(own, parsed))


def valid(fragment: Column) -> Column:
    """Whether every part is a known key with a range; an empty fragment is."""
    return fragment.rlike(r"^$|^([maf]=(\d+|\d*,\d*))(&[maf]=(\d+|\d*,\d*))*$")


def contains(found: Column, index: Column) -> Column:
    """Whether any range has the index. Without a selector only index 0 is selected."""
    inside = F.exists(found, lambda r: (r["begin"] <= index) & (r["end"].isNull() | (index < r["end"])))
    return F.when(found.isNull(), index == 0).otherwise(inside)


def within(found: Column, count: Column) -> Column:
    """Whether every range lies inside 0..count; an open range must begin inside."""
    return F.when(found.isNull(), F.lit(True)).otherwise(F.forall(found, lambda r: (r["begin"] < count) & (r["end"].isNull() | (r["end"] <= count))))


def select(images: DataFrame, fragment: Column) -> DataFrame:
    """The images that a fragment selects."""
    out = images
    for key, name in KEYS.items():
        out = out.withColumn(f"_{key}", ranges(fragment, key))
    for key, name in KEYS.items():
        out = out.where(contains(F.col(f"_{key}"), F.col(name)))
    return out.drop(*[f"_{k}" for k in KEYS])
