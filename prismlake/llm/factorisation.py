"""Quality classifier: a factorisation machine.

Hashed words, binned structure statistics and the text's length interact
pairwise through low-rank factors; a score costs time linear in the number of
features by the identity sum_{i<j} <v_i, v_j> x_i x_j =
(|sum v_i x_i|^2 - sum |v_i|^2 x_i^2) / 2.

The machine is fitted on a sample of at most TRAIN_ROWS labelled rows (by
hash); every row is scored on its whole text.

Defined results: null and empty texts have the structure features alone and
get a score; rows that repeat score alike; without labelled rows of both kinds
every score is the share of label 1 (0.5 without any); an empty table gives an
empty result. Only id and text are read, so extra columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textstats
from .common import materialise

#: Bound of the sample that a classifier is fitted on.
TRAIN_ROWS = 8000
WORD_BITS = 15
BINS = 16
FACTORS = 6
EPOCHS = 6
THRESHOLD = 0.3
FOLDS = 5

#: Upper ends of the bins of each ratio, of the text's length and of its words, evenly spaced over their usual span.
_SPAN = {"symbols": 3.0, "upper": 1.0, "dup_lines": 1.0, "repeats": 1.0, "digits": 0.3, "marks": 2.0, "stops": 0.4, "word_length": 10.0}
_STRUCTURE = len(_SPAN) + 3


def structure(stats: np.ndarray) -> np.ndarray:
    """The bin of each structure statistic, one row per text; a square-root scale resolves small values."""
    r = textstats.ratios(stats)
    spans = np.array([_SPAN[n] for n in textstats.RATIO_NAMES])
    scaled = np.sqrt(np.clip(r / spans, 0, 1))
    scaled[:, -1] = np.clip((r[:, -1] - 3) / 7, 0, 1)
    words = np.log2(1 + stats[:, 0]) / 16
    chars = np.log2(1 + stats[:, 1]) / 20
    distinct = stats[:, textstats.NAMES.index("n_distinct")] / (stats[:, 0] + 1)
    x = np.column_stack([scaled, words, chars, distinct])
    return np.minimum((np.clip(x, 0, 1) * BINS).astype(int), BINS - 1)


def features(texts, stats: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """(indices, values) of each text: hashed distinct words of unit length in all, then one feature per statistic."""
    texts = list(texts)
    if stats is None:
        stats = np.array([textstats.statistics(t) for t in texts]).reshape(-1, len(textstats.NAMES))
    bins = structure(stats) + np.arange(_STRUCTURE) * BINS + (1 << WORD_BITS)
    out, mask = [], (1 << WORD_BITS) - 1
    for text, b in zip(texts, bins, strict=True):
        idx = np.unique(np.array([crc32(w) & mask for w in set((text or "").encode().lower().split())], int))
        x = np.full(len(idx), 1 / np.sqrt(max(len(idx), 1)))
        out.append((np.concatenate([idx, b]), np.concatenate([x, np.ones(len(b))])))
    return out


@dataclass
class Machine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def logit(self, idx: np.ndarray, x: np.ndarray) -> float:
        v = self.factor[idx] * x[:, None]
        s = v.sum(0)
        return self.bias + self.weight[idx] @ x + 0.5 * (s @ s - (v * v).sum())

    def score(self, rows) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip([self.logit(i, x) for i, x in rows], -30, 30)))


def train(rows, target: np.ndarray, epochs: int = EPOCHS, rate: float = 0.1, decay: float = 1e-4, seed: int = 5) -> Machine:
    """Stochastic gradient descent with a step per coordinate (AdaGrad)."""
    rng = np.random.default_rng(seed)
    size = (1 << WORD_BITS) + _STRUCTURE * BINS
    share = float(np.mean(target)) if len(target) else 0.5
    m = Machine(float(np.log((share + 1e-3) / (1 - share + 1e-3))), np.zeros(size), rng.normal(0, 0.02, (size, FACTORS)))
    if share in (0.0, 1.0) or not len(target):
        m.factor[:] = 0
        return m
    gw, gv, gb = np.full(size, 1e-2), np.full((size, FACTORS), 1e-2), 1.0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            idx, x = rows[k]
            v = m.factor[idx]
            vx = v * x[:, None]
            s = vx.sum(0)
            z = m.bias + m.weight[idx] @ x + 0.5 * (s @ s - (vx * vx).sum())
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target[k]
            dw = g * x + decay * m.weight[idx]
            dv = g * x[:, None] * (s - vx) + decay * v
            gw[idx] += dw * dw
            gv[idx] += dv * dv
            gb += g * g
            m.weight[idx] -= rate * dw / np.sqrt(gw[idx])
            m.factor[idx] -= 0.3 * rate * dv / np.sqrt(gv[idx])
            m.bias -= rate * g / np.sqrt(gb)
    return m


def held_out(id_col: Column) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(FOLDS)) == 0


def training_sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, target) of at most ``rows`` labelled rows outside the held-out fold, drawn by hash from all of them."""
    given = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    # of several labels of one id the greatest counts
    each = given.groupBy(F.col(id_col).alias("key")).agg(F.max(F.col(label_col).cast("double")).alias("target"))
    drawn = materialise(each.orderBy(F.xxhash64("key"), "key").limit(rows), "drawn")  # at most `rows` ids
    return docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "key")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Machine:
    def extract(batches):
        for pdf in batches:
            found = features(pdf["text"])
            yield pd.DataFrame({"key": pdf["key"], "target": pdf["target"], "idx": [i.astype("<i4").tobytes() for i, _ in found], "x": [x.astype("<f4").tobytes() for _, x in found]})

    sample = training_sample(docs, labels, label_col, id_col, text_col, rows).mapInPandas(extract, "key long, target double, idx binary, x binary").toPandas()
    sample = sample.sort_values(["key", "target", "idx"], ignore_index=True)
    parsed = [(np.frombuffer(i, "<i4").astype(int), np.frombuffer(x, "<f4").astype(float)) for i, x in zip(sample["idx"], sample["x"], strict=True)]
    return train(parsed, sample["target"].to_numpy(float))


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc id, held_out, score, predicted."""
    small = Machine(machine.bias, machine.weight.astype("f4"), machine.factor.astype("f4"))

    @F.pandas_udf(T.DoubleType())
    def probability(text: pd.Series) -> pd.Series:
        return pd.Series(small.score(features(text)), dtype=float)

    key = F.col(id_col)
    out = docs.select(key, held_out(key).alias("held_out"), probability(F.col(text_col)).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
