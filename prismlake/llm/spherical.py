"""Embedding near-dedup: spherical k-means cells, blocked cosine products, one representative a group.

Vectors of one label and one dimension are compared by cosine in double
precision. Equal vectors form a class first, of which one takes part. A node
(at first a label) with more than CELL classes is split by spherical k-means,
fitted on a sample of about SAMPLE of its rows; each vector has one home cell
and is also sent, as a probe, to each cell whose vectors can come within the
threshold: for x at home in cell c and y at home in c', with unit vectors at
most r = sqrt(2 - 2 * threshold) apart, y.(c' - d) >= 0 for every centroid d
gives x.(c' - d) >= -r * |c' - d|. The test is exact, so no link is lost,
whatever the centroids are; probes go to one side of each pair of cells only,
so each pair meets once. Cells that are still large are split again, unless
the sample shows that splitting spares nothing (a tight ball of vectors). Each
cell is then cut into blocks of about BLOCK rows, and a task multiplies two
blocks at a time; it returns a count for each row and a spanning forest of
links, never the pairs. A cell of g classes takes g * g / BLOCK copied rows:
counting links exactly is the one part that is not linear.

Defined results: a row whose label or vector is null, or whose vector is
empty, zero, or holds a null or non-finite component, links with nothing; nor
do vectors of different dimensions. Rows that repeat (an id and a vector, or an
id and several vectors) are vectors of their own and count each other as
links. A row with a null id is linked like any other, but its id is never the
smallest of a component (null if all are null); it is kept only then. An empty
table gives an empty result. Only the id, label and vector columns are read,
so extra columns cannot clash.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import linking
from .common import discard, fresh, materialise

THRESHOLD = 0.98
#: Classes that a cell may hold before it is split.
CELL = 1024
#: Cells that one node is split into, at most.
FAN = 32
#: Rows of a node that k-means is fitted on, in expectation.
SAMPLE = 4096
#: A node is split only if that leaves less than this share of its products.
WORTH = 0.95
#: Rows of a block, in expectation.
BLOCK = 1024
DEPTH = 12
#: Bytes that are broadcast at most.
BROADCAST_BYTES = 32_000_000
SLACK = 1e-9
NODE = ["label", "dim", "path"]


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, whatever their size."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids of unit vectors: assignment by greatest cosine, means scaled to length one."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    home = None
    for _ in range(rounds):
        new = (x @ c.T).argmax(1)
        if home is not None and (new == home).all():
            break
        home = new
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        size = np.sqrt((total * total).sum(1))
        c = np.where(size[:, None] > SLACK, total / np.maximum(size, SLACK)[:, None], c)
    return c


def reached(dots: np.ndarray, centroids: np.ndarray, threshold: float) -> np.ndarray:
    """Which cells hold vectors that may be linked with each row, by its dots with the centroids."""
    apart = np.sqrt(np.maximum(((centroids[:, None] - centroids[None]) ** 2).sum(2), 0))
    need = -math.sqrt(max(2 - 2 * threshold, 0)) * apart - SLACK
    ok = np.ones(dots.shape, bool)
    for d in range(len(centroids)):
        ok &= dots - dots[:, d : d + 1] >= need[:, d]
    return ok


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.concatenate(column.to_numpy()).astype(float, copy=False).reshape(-1, dim)


def _with_small(rows: DataFrame, small: DataFrame, keys: list[str], weight: str, row_bytes: int) -> DataFrame:
    """Rows joined with one row a key of ``small``.

    The heaviest keys, as many as a broadcast of BROADCAST_BYTES has room for,
    are broadcast; each other key holds a small share of the rows and is shuffled.
    """
    room = max(1, BROADCAST_BYTES // row_bytes)
    if small.count() <= room:
        return rows.join(F.broadcast(small), keys)
    heavy = materialise(small.orderBy(F.col(weight).desc(), *keys).limit(room), "heavy")
    names = F.broadcast(heavy.select(*keys))
    light = rows.join(names, keys, "left_anti").join(small.join(names, keys, "left_anti"), keys)
    return rows.join(F.broadcast(heavy), keys).unionByName(light)


def _fitted(sample: DataFrame, threshold: float) -> DataFrame:
    """Per node with its sampled rows: the matrix of centroids, or an empty one where splitting spares nothing."""

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = unit(_matrix(pdf["v"], int(key[1])))
        c = kmeans(x, min(FAN, -(-2 * int(pdf["n"].iloc[0]) // CELL)))
        dots = x @ c.T
        home = dots.argmax(1)
        probes = (reached(dots, c, threshold) & (np.arange(len(c)) < home[:, None])).sum(0)
        homes = np.bincount(home, minlength=len(c))
        worth = (homes * (homes + 2 * probes)).sum() < WORTH * len(x) ** 2
        return pd.DataFrame({"label": [key[0]], "dim": [key[1]], "path": [key[2]], "n": [int(pdf["n"].iloc[0])], "centroids": [c.tobytes() if worth else b""]})

    label = dict(sample.dtypes)["label"]
    return sample.groupBy(*NODE).applyInPandas(fit, f"label {label}, dim int, path string, n long, centroids binary")


def _assigned(rows: DataFrame, threshold: float) -> DataFrame:
    """Rows with their node's centroids, sent to their home cell and to the cells they probe."""

    def assign(batches):
        for pdf in batches:
            for blob, at in pdf.groupby("centroids", sort=False).indices.items():
                part = pdf.iloc[at]
                dim = int(part["dim"].iloc[0])
                c = np.frombuffer(blob).reshape(-1, dim)
                dots = unit(_matrix(part["v"], dim)) @ c.T
                home = dots.argmax(1)
                own = part["home"].to_numpy()
                cell = np.arange(len(c))
                goes = reached(dots, c, threshold) & (~own[:, None] | (cell < home[:, None]))
                goes[np.flatnonzero(own), home[own]] = True
                r, k = np.nonzero(goes)
                out = part.iloc[r].copy()
                out["path"] = out["path"] + "." + pd.Series(k.astype(str), index=out.index)
                out["home"] = own[r] & (k == home[r])
                yield out.drop(columns=["centroids"])

    schema = ", ".join(f"{c} {t}" for c, t in rows.drop("centroids").dtypes)
    return rows.mapInPandas(assign, schema)


def cells(classes: DataFrame, threshold: float) -> DataFrame:
    """Rows (label, dim, path, home, cid, w, v): each class once at home, and as a probe where it may be linked."""
    open_ = classes.select("label", F.size("v").alias("dim"), F.lit("").alias("path"), F.lit(True).alias("home"), "cid", "w", "v")
    closed, written = None, None
    for _ in range(DEPTH):
        large = materialise(open_.groupBy(*NODE).agg(F.sum(F.col("home").cast("long")).alias("n"), F.max("dim").alias("d")).where(F.col("n") > CELL), "large-cells")
        widest = large.agg(F.max("d")).first()[0]
        if widest is None:
            break
        drawn = _with_small(open_.where("home"), large.drop("d"), NODE, "n", 100).where(F.pmod(F.xxhash64("cid"), F.col("n")) < SAMPLE)
        fitted = materialise(_fitted(drawn.select(*NODE, "n", "v"), threshold), "centroids")
        models = fitted.where(F.length("centroids") > 0)
        split = materialise(_assigned(_with_small(open_, models, NODE, "n", 8 * FAN * widest).select(*open_.columns, "centroids"), threshold), "cells")
        names = models.select(*NODE)
        stay = open_.join(F.broadcast(names) if names.count() <= BROADCAST_BYTES // 200 else names, NODE, "left_anti")
        closed = stay if closed is None else closed.unionByName(stay)
        open_, written = split, large
        discard(written)
    return open_ if closed is None else closed.unionByName(open_)


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows dealt to pairs of blocks: (leaf, i, o), inner or outer. The blocks of probes come after those of home rows."""
    sizes = rows.groupBy(*NODE).agg(F.sum(F.col("home").cast("long")).alias("h"), F.sum((~F.col("home")).cast("long")).alias("p"), F.count("*").alias("n"))
    sizes = sizes.where("h > 0 and n > 1").withColumn("leaf", F.monotonically_increasing_id())
    sizes = materialise(sizes.select(*NODE, "n", "leaf", F.ceil(F.col("h") / BLOCK).cast("int").alias("hb"), F.ceil(F.col("p") / BLOCK).cast("int").alias("pb")), "leaves")
    dealt = _with_small(rows, sizes, NODE, "n", 200)
    block = F.pmod(F.xxhash64("cid"), F.when(F.col("home"), F.col("hb")).otherwise(F.greatest("pb", F.lit(1)))).cast("int")
    dealt = dealt.withColumn("b", F.when(F.col("home"), block).otherwise(F.col("hb") + block))
    # inner rows meet their own block and all later ones, outer rows all earlier blocks of home rows
    span = lambda lo, hi: F.when(lo < hi, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<int>"))
    inner = F.when(F.col("home"), F.transform(span(F.col("b"), F.col("hb") + F.col("pb")), lambda o: F.struct(F.col("b").alias("i"), o.alias("o"), F.lit(True).alias("inner")))).otherwise(F.array().cast("array<struct<i:int,o:int,inner:boolean>>"))
    outer = F.transform(span(F.lit(0), F.least("b", "hb")), lambda i: F.struct(i.alias("i"), F.col("b").alias("o"), F.lit(False).alias("inner")))
    return dealt.select("leaf", "dim", "cid", "w", "v", F.explode(F.concat(inner, outer)).alias("at")).select("leaf", "at.i", "at.o", "at.inner", "dim", "cid", "w", "v")


class _Pair:
    """Two blocks of unit vectors: sums of linked rows' weights, and a spanning forest of the links."""

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.inner: list[tuple] = []
        self.outer: list[tuple] = []

    def results(self) -> pd.DataFrame | None:
        if not self.inner:
            return None
        a = [np.concatenate(x) for x in zip(*self.inner, strict=True)]
        same = not self.outer
        b = a if same else [np.concatenate(x) for x in zip(*self.outer, strict=True)]
        have, got = np.zeros(len(a[0])), np.zeros(len(b[0]))
        part, edges = np.arange(len(a[0])), []
        for lo in range(0, len(b[0]), 256):
            hit = self._hits(b[2][lo : lo + 256], a[2])
            if same:
                hit[np.arange(len(hit)), lo + np.arange(len(hit))] = False
            got[lo : lo + 256] = hit @ a[1]
            if not same:
                have += b[1][lo : lo + 256] @ hit
            for r in np.flatnonzero(hit.any(1)):
                x = lo + r
                met, first = np.unique(part[hit[r]], return_index=True)
                at = np.flatnonzero(hit[r])[first]
                if same:
                    new = met != part[x]
                    met, at = met[new], at[new]
                    edges += [(b[0][x], a[0][k]) for k in at]
                    part[np.isin(part, met)] = part[x]
                else:
                    edges += [(b[0][x], a[0][k]) for k in at]
                    part[np.isin(part, met[1:])] = met[0]
        ids, n = (a[0], got) if same else (np.concatenate([a[0], b[0]]), np.concatenate([have, got]))
        some = n > 0
        ends = np.array(edges, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": np.concatenate([ids[some], ends[:, 0]]), "b": np.concatenate([np.full(some.sum(), -1), ends[:, 1]]), "n": np.concatenate([n[some], np.zeros(len(ends))])}).astype("int64")

    def _hits(self, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        cos = y @ x.T
        hit = cos >= self.threshold
        for i, j in np.argwhere(np.abs(cos - self.threshold) < SLACK):  # so near that the order of sums could decide
            hit[i, j] = math.fsum(y[i] * x[j]) >= self.threshold
        return hit


def _products(dealt: DataFrame, threshold: float) -> DataFrame:
    """(a, -1, n): a class and the weight of those it is linked with in one pair of blocks; (a, b, 0): links that span them."""

    def run(batches):
        here, pair = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            keys = pdf[["leaf", "i", "o", "inner"]].to_numpy()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), len(pdf)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if here != (key := tuple(keys[lo, :3])):
                    if pair is not None and (found := pair.results()) is not None:
                        yield found
                    here, pair = key, _Pair(threshold)
                part = pdf.iloc[lo:hi]
                rows = (part["cid"].to_numpy(), part["w"].to_numpy(float), unit(_matrix(part["v"], int(part["dim"].iloc[0]))))
                (pair.inner if keys[lo, 3] else pair.outer).append(rows)
        if pair is not None and (found := pair.results()) is not None:
            yield found

    sorted_ = dealt.repartition("leaf", "i", "o").sortWithinPartitions("leaf", "i", "o", F.col("inner").desc(), "cid")
    return sorted_.mapInPandas(run, "a long, b long, n long")


def _sound(v: Column, label: Column) -> Column:
    """Whether a row can be linked at all."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _version() -> Column:
    """Tells rows of one id apart by their label and vector."""
    return F.xxhash64("label", "v").alias("version")


def _grouped(vectors: DataFrame, threshold: float, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """Per row: id, version, n_links, component_id."""
    v = F.col(vector_col).cast("array<double>")
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), v.alias("v")).withColumn("sound", _sound(F.col("v"), F.col("label")))
    rows = given.where("sound").drop("sound")
    classes = rows.groupBy("label", "v").agg(F.min("id").alias("least"), F.count("*").alias("w")).withColumn("cid", F.monotonically_increasing_id())
    classes = materialise(classes, "vector-classes")
    found = materialise(_products(_blocks(cells(classes, threshold)), threshold), "products")
    sums = found.where("b < 0").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
    names = materialise(linking.connected_components(found.where("b >= 0").select("a", "b")), "vector-components")
    part = materialise(classes.join(names.withColumnRenamed("id", "cid"), "cid", "left").join(sums, "cid", "left").select("label", "v", "least", "w", F.coalesce("component", "cid").alias("component"), (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")), "vector-parts")
    least = materialise(part.where("n_links >= w").groupBy("component").agg(F.min("least").alias("lowest")), "vector-least")
    n = least.count()
    named = part.join(F.broadcast(least) if n <= linking.BROADCAST_ROWS // 3 else least, "component", "left").withColumn("component_id", F.coalesce("lowest", "least"))
    named = materialise(named.select("label", "v", "least", "w", "n_links", "component_id"), "vector-names")
    single = named.where("w = 1").select(F.col("least").alias("id"), _version(), "n_links", "component_id")
    copied = named.where("w > 1").drop("least")
    width = 8 * (copied.agg(F.max(F.size("v"))).first()[0] or 0) + 100
    several = _with_small(rows, copied, ["label", "v"], "w", width).select("id", _version(), "n_links", "component_id")
    apart = given.where("not sound").select("id", _version(), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    for t in (found, names, part, least):
        discard(t)
    return single.unionByName(several).unionByName(apart)


def components(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per row: id, n_links (other vectors linked directly), component_id (smallest id reachable), kept."""
    found = _grouped(vectors, threshold, id_col, vector_col, label_col)
    return found.select("id", "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def representatives(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row of each group, that of the smallest id, with all its columns; rows without a group stay. Of rows with one id, if they stay, one does."""
    found = materialise(_grouped(vectors, threshold, id_col, vector_col, label_col), "vector-groups")
    at, rank = fresh(vectors, "at"), fresh(vectors, "rank")
    gone = found.where(~F.col("id").eqNullSafe(F.col("component_id"))).select(F.struct("id", "version").alias(at)).distinct()
    again = found.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1 and id is not null").select(F.col("id").alias(f"{at}_id"))
    version = F.xxhash64(F.col(label_col), F.col(vector_col).cast("array<double>")).alias("version")
    kept = linking.with_ids(vectors.withColumn(at, F.struct(F.col(id_col).cast("long").alias("id"), version)), gone, at, "left_anti").withColumn(f"{at}_id", F.col(f"{at}.id"))
    first = Window.partitionBy(f"{at}_id").orderBy(f"{at}.version")
    one = linking.with_ids(kept, again, f"{at}_id").withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1).drop(rank)
    return linking.with_ids(kept, again, f"{at}_id", "left_anti").unionByName(one).select(*vectors.columns)
