"""Key/value metadata as arrays of (key, value): find, add, delete, sort and stamp, as column expressions.

An array has each key once; a null array is an empty one. Sorted order is that
of code points, as containers are written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PAIR = "array<struct<key:string,value:string>>"


def _pairs(pairs: Column) -> Column:
    return F.coalesce(pairs, F.array().cast(PAIR))


def found(pairs: Column, key: str | Column) -> Column:
    """The value of a key, or null."""
    return F.get(F.filter(_pairs(pairs), lambda p: p["key"] == key), F.lit(0))["value"]


def deleted(pairs: Column, *keys: str | Column) -> Column:
    """The pairs without the given keys; missing ones are no error."""

    def without(out: Column, key: str | Column) -> Column:
        return F.filter(out, lambda p: p["key"] != key)

    return reduce(without, keys, _pairs(pairs))


def added(pairs: Column, key: str | Column, value: str | Column) -> Column:
    """The pairs with one more at the end; a pair of the same key goes."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.concat(deleted(pairs, key), F.array(F.struct(lit(key).alias("key"), lit(value).alias("value"))))


def ordered(pairs: Column) -> Column:
    """The pairs by code points of their keys."""
    return F.sort_array(_pairs(pairs))


def stamped(pairs: Column, writer: str | Column, params: str | Column | None = None) -> Column:
    """Rewritten by ``writer``: its name replaces the last writer's; ``params`` are added behind those of earlier steps, joined by a blank."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    out = added(pairs, "KTXwriter", writer)
    if params is not None:
        out = added(out, "KTXwriterScParams", F.concat_ws(" ", found(pairs, "KTXwriterScParams"), lit(params)))
    return ordered(out)
