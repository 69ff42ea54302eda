"""Connected components over candidate buckets, with DataFrame operations only.

Two rows are candidates if they share a bucket. A bucket can be huge (a family
of near copies), so its pairs are never all made: rounds of pivots compare a
few central rows of each bucket with all others, rows that land in one
component need no further comparison, and what is left between components is
compared directly once it is no more than ``fan`` pairs a row (FIRST_FAN before
anything is joined). A pivot leaves
its bucket after it was compared with every row there, so the rounds end and
no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise

FAN = 32
FIRST_FAN = 8
PIVOTS = 8
#: Ids up to this many (8 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def with_ids(df: DataFrame, ids: DataFrame, on: str, how: str = "left_semi", rows: int | None = None) -> DataFrame:
    """Semi- or anti-join against a table of ids; ids are broadcast only if their counted number is small."""
    rows = ids.count() if rows is None else rows
    return df.join(F.broadcast(ids) if rows <= BROADCAST_ROWS else ids, on, how)


def connected_components(links: DataFrame) -> DataFrame:
    """Links (a, b) to (id, component), component being the smallest id reachable.

    Each round points every node at its smallest neighbour, follows that
    pointer once more, and contracts the links to those targets; parts at least
    halve in number. Pointers lead to smaller ids only, so the last one is the
    smallest of its component.
    """
    edges = materialise(links.select("a", "b").where("a <> b").distinct(), "links")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = materialise(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("to")), "step")
        jump = step.join(step.select(F.col("id").alias("to"), F.col("to").alias("next")), "to").select("id", F.col("next").alias("to"))
        jump = materialise(jump, "jump")
        if labels is None:
            new = jump.withColumnRenamed("to", "component")
        else:
            new = labels.join(jump.select(F.col("id").alias("component"), "to"), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
        new = materialise(new, "labels")
        end = lambda c: jump.select(F.col("id").alias(c), F.col("to").alias(f"t{c}"))
        left = materialise(edges.join(end("a"), "a").join(end("b"), "b").select(F.col("ta").alias("a"), F.col("tb").alias("b")).where("a <> b").distinct(), "links")
        for t in (edges, step, jump, *([labels] if labels is not None else [])):
            discard(t)
        labels, edges = new, left
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels


def relabel(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """Labels (id, component) after more links (a, b); None while there are no links at all."""
    if links.isEmpty():
        return labels
    if labels is None:
        return materialise(connected_components(links), "components")
    old = lambda c: labels.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
    merged = links.join(old("a"), "a", "left").join(old("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct()
    moved = connected_components(merged)
    # ids new to the labels are in `moved` under their own name
    known = labels.join(moved.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    fresh = moved.join(labels.select("id"), "id", "left_anti").select("id", "component")
    return materialise(known.unionByName(fresh), "components")


def resolve(members: DataFrame, verify: Callable[[DataFrame], DataFrame], near: Callable | None = None, fan: int = FAN, pivots: int = PIVOTS) -> DataFrame | None:
    """Members (key, id, size) to labels (id, component) of the ids that have links, or None without links.

    ``verify`` takes distinct pairs (a, b) and returns those that are links;
    ``near(size_a, size_b)`` is a cheap condition that every link meets; the more
    it rules out, the larger ``fan`` may be.
    """
    near = near or (lambda a, b: F.lit(True))
    labels, tested = None, None
    active = materialise(members, "members")
    # rows that share many large buckets are central to their family: better pivots
    sizes = active.groupBy("key").agg(F.count("*").alias("g"))
    central = active.join(sizes, "key").groupBy("id").agg(F.sum("g").alias("central"))
    with_rank = materialise(active.join(central, "id"), "members")
    discard(active)
    active = with_rank
    while True:
        if labels is None:
            here = active.withColumn("c", F.col("id"))
        else:
            here = active.join(labels, "id", "left").select("key", "id", "size", "central", F.coalesce("component", "id").alias("c"))
        by_part = here.groupBy("key", "c").agg(F.count("*").alias("n"))
        by_key = by_part.groupBy("key").agg(F.sum("n").alias("g"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"), F.count("*").alias("parts"), F.max("n").alias("most"))
        open_ = by_key.where("parts > 1").select("key", ((F.col("g").cast("double") * F.col("g") - F.col("squares")) / 2 > (FIRST_FAN if labels is None and tested is None else fan) * F.col("g")).alias("large"))
        here = materialise(here.join(open_, "key"), "open")
        discard(active)
        if here.isEmpty():
            discard(here)
            return labels
        small = here.where("not large")
        left = small.select("key", F.col("id").alias("a"), F.col("size").alias("sa"), F.col("c").alias("ca"))
        right = small.select("key", F.col("id").alias("b"), F.col("size").alias("sb"), F.col("c").alias("cb"))
        pairs = left.join(right, "key").where((F.col("ca") < F.col("cb")) & near(F.col("sa"), F.col("sb"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        large = here.where("large")
        chosen = None
        if not large.isEmpty():
            order = F.struct((-F.col("central")).alias("o"), F.col("id"))
            # of each component the most central row; of those the few most central
            best = large.groupBy("key", "c").agg(F.min(F.struct(order.alias("o"), "size")).alias("p"))
            chosen = materialise(_first(best, pivots), "pivots")
            star = large.join(chosen, "key").where((F.col("id") != F.col("pid")) & (F.col("c") != F.col("pc")) & near(F.col("size"), F.col("psize"))).select(F.least("id", "pid").alias("a"), F.greatest("id", "pid").alias("b"))
            pairs = pairs.union(star)
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "pairs")
        links = materialise(verify(pairs), "verified")
        labels = relabel(labels, links)
        tested = pairs if tested is None else tested.union(pairs)
        # small buckets are done; pivots were compared with their whole bucket
        active = large.select("key", "id", "size", "central")
        if chosen is not None:
            active = active.join(chosen.select("key", F.col("pid").alias("id")), ["key", "id"], "left_anti")
        active = materialise(active, "members")
        discard(here)


def _first(best: DataFrame, pivots: int) -> DataFrame:
    """The most central rows of each bucket."""
    top = Window.partitionBy("key").orderBy("p")
    return best.withColumn("r", F.row_number().over(top)).where(F.col("r") <= pivots).select("key", F.col("p.o.id").alias("pid"), F.col("c").alias("pc"), F.col("p.size").alias("psize"))
