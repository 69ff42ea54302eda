"""Quality rules: an isolation forest over rule statistics.

Path lengths over random splits identify anomalous documents: junk is isolated
after few splits. Trees are grown on a subsample of fixed size (the method's
own bound, ``trees * subsample`` rows, drawn by a hash over all rows); every
row is scored, and the score's threshold is calibrated on all labelled rows.

Defined results: a null or empty text has zero words and fails the base rule;
rows that repeat are judged alike; an empty table gives an empty result and a
forest that keeps what passes the base rule; without labels the threshold is
``DEFAULT_THRESHOLD``. Extra columns pass through ``filter_documents`` untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textstats
from .common import materialise

TREES = 100
SUBSAMPLE = 256
DEFAULT_THRESHOLD = 0.6
#: At most this share of the good labelled rows may be rejected by the forest.
MAX_GOOD_REJECTED = 0.01
BINS = 1000

STATS_TYPE = T.StructType([T.StructField(n, T.LongType()) for n in textstats.NAMES])


@F.pandas_udf(STATS_TYPE)
def statistics(text: pd.Series) -> pd.DataFrame:
    """The rule statistics of whole texts, as a struct."""
    return pd.DataFrame([textstats.statistics(t) for t in text], columns=textstats.NAMES)


def base_failed(stats: Column) -> Column:
    n = stats["n_words"]
    return (n < 10) | (100 * stats["n_repeat_words"] > 20 * n)


def expected_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.maximum(np.asarray(n, float), 1)
    out = np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / n, 0.0)
    return np.where(n == 2, 1.0, out)


@dataclass
class Forest:
    """Trees as flat arrays: split feature (-1: leaf), split value, left child (right is next), path length."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    length: np.ndarray
    roots: np.ndarray
    normal: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path length / expected): near 1 is anomalous, 0.5 and less is common."""
        if not len(self.roots) or not len(x):
            return np.full(len(x), 0.5)
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while True:
                f = self.feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(f, 0)] >= self.value[at]
                at = np.where(inner, self.left[at] + right, at)
            total += self.length[at]
        return 2.0 ** (-total / len(self.roots) / self.normal)


def grow(x: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 7) -> Forest:
    """Grow a forest on ``x``, at most ``trees * subsample`` rows; tree t takes every trees-th row from t on."""
    feature, value, left, length, roots = [], [], [], [], []
    rng = np.random.default_rng(seed)
    depth_limit = int(np.ceil(np.log2(max(subsample, 2))))

    def node() -> int:
        for a, v in ((feature, -1), (value, 0.0), (left, 0), (length, 0.0)):
            a.append(v)
        return len(feature) - 1

    used = 0
    for t in range(min(trees, len(x))):
        rows = x[t::trees][:subsample]
        used = max(used, len(rows))
        roots.append(node())
        stack = [(roots[-1], rows, 0)]
        while stack:
            at, pts, depth = stack.pop()
            low, high = pts.min(0), pts.max(0)
            open_ = np.flatnonzero(high > low)
            if depth == depth_limit or len(pts) < 2 or not len(open_):
                length[at] = depth + float(expected_path(len(pts)))
                continue
            f = rng.choice(open_)
            v = rng.uniform(low[f], high[f])
            go = pts[:, f] >= v
            if go.all() or not go.any():
                v = high[f]
                go = pts[:, f] >= v
            feature[at], value[at] = f, v
            a, b = node(), node()
            left[at] = a
            stack += [(a, pts[~go], depth + 1), (b, pts[go], depth + 1)]
    return Forest(*map(np.asarray, (feature, value, left, length, roots)), max(float(expected_path(used)), 1.0))


@dataclass
class Rules:
    forest: Forest
    threshold: float

    def anomaly(self, stats: Column) -> Column:
        forest = self.forest

        @F.pandas_udf("double")
        def score(s: pd.DataFrame) -> pd.Series:
            return pd.Series(forest.score(textstats.ratios(s[list(textstats.NAMES)].to_numpy())))

        return score(stats)

    def verdict(self, text: Column) -> Column:
        """Whether a text is kept: statistics, base rule and forest in one pass over the text."""
        rules = self

        @F.pandas_udf("boolean")
        def keep(text: pd.Series) -> pd.Series:
            s = np.array([textstats.statistics(t) for t in text]).reshape(-1, len(textstats.NAMES))
            n, repeats = s[:, 0], s[:, textstats.NAMES.index("n_repeat_words")]
            bad = (n < 10) | (100 * repeats > 20 * n)
            return pd.Series(~bad & (rules.forest.score(textstats.ratios(s)) < rules.threshold))

        return keep(text)


def fit_forest(stats: DataFrame, trees: int = TREES, subsample: int = SUBSAMPLE) -> Forest:
    """Grow the forest on rows drawn by hash from all of ``stats`` (columns key, s)."""
    want = trees * subsample
    n = stats.count()
    share = min(1.0, 1.1 * want / max(n, 1))
    draw = F.pmod(F.xxhash64("key", F.lit(11)), F.lit(1 << 30))
    rows = (
        stats.where(draw < int(share * (1 << 30)) + 1)
        .select(draw.alias("draw"), "key", "s.*")
        .orderBy("draw", "key", *textstats.NAMES)
        .limit(want)
        .drop("draw", "key")
        .toPandas()
    )
    return grow(textstats.ratios(rows.to_numpy().reshape(-1, len(textstats.NAMES))), trees, subsample)


def calibrate(scored: DataFrame, labels: DataFrame) -> float:
    """The threshold on ``anomaly`` with the best true minus false rejection rate over all labelled rows.

    ``scored`` has key and anomaly, ``labels`` has key and good (0/1). Among
    thresholds that reject at most MAX_GOOD_REJECTED of the good rows. Only a
    histogram of BINS scores reaches the driver.
    """
    h = (
        scored.join(labels.where("good is not null"), "key")
        .groupBy(F.floor(F.col("anomaly") * BINS).cast("int").alias("bin"))
        .agg(F.sum(F.when(F.col("good") == 0, 1).otherwise(0)).alias("bad"), F.sum(F.when(F.col("good") != 0, 1).otherwise(0)).alias("good"))
        .toPandas()
    )
    bad, good = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for b, x, y in zip(h["bin"], h["bad"], h["good"], strict=True):
        bad[b] += x
        good[b] += y
    if not bad.sum() or not good.sum():
        return DEFAULT_THRESHOLD
    true = np.cumsum(bad[::-1])[::-1] / bad.sum()
    false = np.cumsum(good[::-1])[::-1] / good.sum()
    gain = np.where(false <= MAX_GOOD_REJECTED, true - 3 * false, -1)
    return (len(gain) - 1 - int(np.argmax(gain[::-1]))) / BINS


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[Rules, DataFrame]:
    """Fit on all of ``docs``; also returns the materialised (key, s) statistics of every row."""
    stats = materialise(docs.select(F.col(id_col).alias("key"), statistics(F.col(text_col)).alias("s")), "rule-stats")
    rules = Rules(fit_forest(stats), DEFAULT_THRESHOLD)
    marked = labels.select(F.col(id_col).alias("key"), F.col(label_col).alias("good"))
    # what the base rule rejects anyway says nothing about the forest's threshold
    passed = stats.where(~base_failed(F.col("s")))
    rules.threshold = calibrate(passed.select("key", rules.anomaly(F.col("s")).alias("anomaly")), marked)
    return rules, stats


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row per document: key, statistics, base_failed, anomaly and kept."""
    rules, stats = fit(docs, labels, id_col, text_col, label_col)
    failed = base_failed(F.col("s"))
    out = stats.select(F.col("key").alias(id_col), "s.*", failed.alias("base_failed"), rules.anomaly(F.col("s")).alias("anomaly"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < rules.threshold))


def filter_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    rules, _ = fit(docs, labels, id_col, text_col, label_col)
    return docs.where(rules.verdict(F.col(text_col)))
