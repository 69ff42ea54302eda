"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

Tokens with look-alike signs, hidden letters, long repetitions or letters spaced
apart become character lattices, whatever their length; of words joined by signs
both the whole and the parts do; a Viterbi search decodes them under a character trigram
model whose counts come from all documents. Between letters spaced apart a word
may end; such stretches count as one word and as the words found in them. The restored words are scored by a
sparse logistic model (FTRL) over hashed words and word beginnings, fitted on at
most TRAIN_ROWS labelled rows.

Defined results: null and empty texts get the model's base rate; rows that
repeat score alike; without labelled rows of both kinds all scores are the
share of label 1; an empty table gives an empty result. Only id and text are
read, so extra columns cannot clash.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .factorisation import held_out, training_sample

TRAIN_ROWS = 20_000
BITS = 18
THRESHOLD = 0.5
PREFIXES = (4, 5, 6, 7)
#: Features must differ between the classes by this many standard errors.
LEAST_Z = 4.0

# Signs that stand for letters.
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
#: Log-probabilities of the channel: a sign for its letter, an inserted sign, a letter repeated.
AS_LETTER, INSERTED, REPEATED = -1.0, -6.0, -0.5
#: A digit is hardly ever inserted between letters.
DIGIT_INSERTED = -14.0
#: Two separators where a word goes on; between words, one or two are free.
WIDE_GAP = -4.0
#: Signs that hide a letter, any of them.
MASKS, MASKED = "*#%", -2.0
HIDDEN = [("", INSERTED), *((c, MASKED) for c in "abcdefghijklmnopqrstuvwxyz")]
#: Columns after which the likeliest way so far is taken, in lattices with many hidden letters.
COMMIT = 2048

SYMBOLS = 28  # 0: boundary, 1-26: a-z, 27: any other letter
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[128:256] = 27


def text_trigrams(texts: list[bytes]) -> np.ndarray:
    """Counts of the letter trigrams of each text with its edges, by code; bytes of one character beyond ASCII count as other letters."""
    raw = b"".join(b"  " + t + b" " for t in texts)
    c = _CLASS[np.frombuffer(raw, np.uint8)].astype(np.int32)
    codes = c[:-2] * (SYMBOLS * SYMBOLS) + c[1:-1] * SYMBOLS + c[2:]
    ends = np.cumsum([len(t) + 3 for t in texts])[:-1]
    own = np.ones(len(codes), bool)
    own[np.concatenate([ends - 2, ends - 1])] = False  # windows over two texts
    return np.bincount(codes[own], minlength=SYMBOLS**3)


def trigram_counts(raw: bytes) -> np.ndarray:
    return text_trigrams([raw])


def language_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log-probabilities [a, b, c] of letter c after a, b, counted over all documents (SYMBOLS**3 sums reach the driver)."""

    def count(batches):
        total = np.zeros(SYMBOLS**3, np.int64)
        for pdf in batches:
            some, size = [], 0
            for t in pdf["text"]:
                if t:
                    some.append(t.encode())
                    size += len(some[-1])
                if size > 1 << 22:
                    total += text_trigrams(some)
                    some, size = [], 0
            if some:
                total += text_trigrams(some)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"gram": at, "n": total[at]})

    given = docs.select(F.col(text_col).alias("text"))
    counts = given.mapInPandas(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(SYMBOLS**3)
    n[counts["gram"].to_numpy(int)] = counts["n"]
    return smoothed(n)


def smoothed(n: np.ndarray) -> np.ndarray:
    """Trigram estimates backed off to bigrams and letters."""
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    one = n.sum((0, 1)) + 1
    one = one / one.sum()
    two = n.sum(0)
    two = (two + 10 * one) / (two.sum(1, keepdims=True) + 10)
    return np.log((n + 5 * two[None]) / (n.sum(2, keepdims=True) + 5))


def _code(ch: str) -> int:
    return ord(ch) - 96 if "a" <= ch <= "z" else 27 if ch.isalpha() else 0


def _options(ch: str, n: int) -> list[tuple[str, float]]:
    """Letters that n equal signs may stand for, and their prices."""
    if ch.isalpha():
        return [(ch * n, 0.0)] if n < 3 else [(ch, REPEATED), (ch * 2, REPEATED)]
    options = [("", DIGIT_INSERTED if ch.isdigit() else INSERTED)]
    for letter in LOOKS.get(ch, ""):
        options += [(letter * n, AS_LETTER)] if n < 3 else [(letter, AS_LETTER + REPEATED), (letter * 2, AS_LETTER + REPEATED)]
    return options


def _search(options_of: list[list[tuple[str, float]]], model: np.ndarray) -> str:
    """The likeliest way through a lattice; a space in it is the end of a word. Linear in its length."""
    if sum(len(o) > 20 for o in options_of) > 1:
        return _wide_search(options_of, model)
    best: dict = {(0, 0): (0.0, None)}  # state to cost and way, the last letters first
    for options in options_of:
        new: dict = {}
        for (a, b), (cost, way) in best.items():
            for letters, price in options:
                x, y, total = a, b, cost + price
                for c in letters:
                    k = _code(c)
                    total += model[x, y, k]
                    x, y = y, k
                if (x, y) not in new or new[x, y][0] < total:
                    new[x, y] = (total, (way, letters) if letters else way)
        best = new
    way = max(((c + model[a, b, 0], w) for (a, b), (c, w) in best.items()), default=(0, None), key=lambda x: x[0])[1]
    out = []
    while way:
        way, letters = way
        out.append(letters)
    return "".join(reversed(out))


def _wide_search(options_of: list[list[tuple[str, float]]], model: np.ndarray) -> str:
    """The same over all states at once, for columns of many options.

    Only costs are kept on the way; the way itself is found from its end. Every
    COMMIT columns the best one so far is settled.
    """
    cost = np.full((SYMBOLS, SYMBOLS), -np.inf)
    cost[0, 0] = 0.0
    turned = np.ascontiguousarray(model.transpose(1, 2, 0))  # [b, c, a]
    kinds: dict = {}  # columns come from few lists
    out: list[str] = []

    def double(before: np.ndarray, k1: int, k2: int) -> tuple[float, int, int]:
        first = before + model[:, :, k1]
        then = first.max(0) + model[:, k1, k2]
        b = int(then.argmax())
        return then[b], int(first[:, b].argmax()), b

    def forward(before: np.ndarray, options: list) -> np.ndarray:
        if id(options) not in kinds:
            own = [(_code(x), price) for x, price in options if len(x) == 1]
            kinds[id(options)] = [k for k, _ in own], turned[:, [k for k, _ in own]] + np.array([p for _, p in own])[None, :, None], [(x, p) for x, p in options if len(x) != 1]
        letter, prices, others = kinds[id(options)]
        new = np.full_like(before, -np.inf)
        if letter:  # state (a, b) to (b, c), for all a at once
            new[:, letter] = (before.T[:, None, :] + prices).max(2)
        for x, price in others:
            if x:
                k1, k2 = map(_code, x)
                new[k1, k2] = max(new[k1, k2], double(before, k1, k2)[0] + price)
            else:
                np.maximum(new, before + price, out=new)
        return new

    def backward(before: np.ndarray, options: list, x: int, y: int) -> tuple[str, int, int]:
        """The option that led to a state, and the state before it."""
        tried = []
        for letters, price in options:
            if not letters:
                tried.append((before[x, y] + price, letters, x, y))
            elif len(letters) == 1 and _code(letters) == y:
                ways = before[:, x] + model[:, x, y]
                a = int(ways.argmax())
                tried.append((ways[a] + price, letters, a, x))
            elif len(letters) == 2 and tuple(map(_code, letters)) == (x, y):
                value, a, b = double(before, x, y)
                tried.append((value + price, letters, a, b))
        return max(tried, key=lambda t: t[0])[1:]

    for start in range(0, len(options_of), COMMIT):
        part, costs = options_of[start : start + COMMIT], [cost]
        for options in part:
            costs.append(forward(costs[-1], options))
        ends = costs[-1] + (model[:, :, 0] if start + COMMIT >= len(options_of) else 0.0)
        x, y = settled = divmod(int(ends.argmax()), SYMBOLS)
        way = []
        for before, options in zip(reversed(costs[:-1]), reversed(part), strict=True):
            letters, x, y = backward(before, options, x, y)
            way.append(letters)
        out += reversed(way)
        cost = np.full_like(cost, -np.inf)
        cost[settled] = costs[-1][settled]
    return "".join(out)


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """What each run of equal signs in a lower-case token may stand for."""
    out = []
    for run, ch in re.findall(r"((.)\2*)", token, re.S):
        if ch in MASKS:
            out += [HIDDEN] * len(run)
        else:
            out.append(_options(ch, len(run)))
    return out


def decode(token: str, model: np.ndarray) -> str:
    """The likeliest letters behind a lower-case token.

    Letters stand for themselves; a run of three or more may be one or two;
    signs stand for the letters they look like, hide one or were inserted.
    """
    return _search(lattice(token), model)


def segment(stretch: str, model: np.ndarray) -> list[str]:
    """The likeliest words behind lower-case signs spaced apart."""
    return _search(spaced_lattice(stretch), model).split()


def spaced_lattice(stretch: str) -> list[list[tuple[str, float]]]:
    """The options of signs spaced apart; between two of them a word may end."""
    out: list = []
    for run, _, _ in re.findall(r"((?:[ .\-_*]*([^ .\-_*]))(?:[ .\-_*]\2){2,}|[ .\-_*]*([^ .\-_*]))", stretch):
        gap = len(run) - len(run.lstrip(" .-_*"))
        signs = re.sub(r"[ .\-_*]", "", run)
        if out:
            out.append([(" ", 0.0), ("", WIDE_GAP if gap > 1 else 0.0)])
        out.append(_options(signs[0], len(signs)))
    return out


_STRIP = "\"'.,;:?()[]{}<>#*%&_-~^/\\"
_JUNK_END = re.compile(r"([^\w\s])\1{2,}$|!+$")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_]|[@$!|+])(?:[ .\-_*]{1,2}(?:[^\W_]|[@$!|+])){3,}(?![^\W_])")
_ODD = re.compile(r"[^\W\d_]")
_RUN = re.compile(r"(.)\1\1")
_SIGNS = LOOKS.keys() | set(MASKS)
#: Signs that join words to one token.
_JOINS = re.compile(r"[-_/.,:;=~&]+")


class Restorer:
    """Restores texts; each distinct token is decoded once per worker, up to a cap on what is remembered."""

    def __init__(self, model: np.ndarray, keep: int = 300_000):
        self.model, self.keep, self.known = model, keep, {}

    def token(self, w: str) -> str:
        if w.isalpha() and not _RUN.search(w):
            return w
        w = _JUNK_END.sub("", w.strip(_STRIP)).strip(_STRIP)
        if w.isalpha() and not _RUN.search(w):
            return w
        # without a letter it is a number or a mark
        if not _ODD.search(w) or not (set(w) & _SIGNS or _RUN.search(w)):
            return "".join(c for c in w if c.isalpha())
        return decode(w, self.model)

    def restored(self, w: str) -> tuple[str, ...]:
        """The word behind a token as a whole, and those behind its parts if it is several joined by signs."""
        whole = self.token(w)
        if w.isalpha():
            return (whole,)
        parts = [p for p in _JOINS.split(w.strip(_STRIP)) if p]
        return (whole, *map(self.token, parts)) if len(parts) > 1 else (whole,)

    def words(self, text: str | None) -> set[str]:
        """The distinct restored words of a whole text."""
        text = (text or "").lower()
        spaced = {m[0] for m in _SPACED.finditer(text) if _ODD.search(m[0])}
        joined = {re.sub(r"[ .\-_*]", "", m) for m in spaced}
        known = self.known
        if len(known) > self.keep:
            known.clear()
        tokens = set(text.split()) | joined
        for w in tokens.difference(known):
            known[w] = self.restored(w)
        return set().union(*map(known.__getitem__, tokens), *(segment(m, self.model) for m in spaced))


def indices(words: set[str]) -> np.ndarray:
    """Hashed features: each word and its beginnings."""
    mask, out = (1 << BITS) - 1, set()
    for w in words:
        out.add(crc32(w.encode()) & mask)
        for n in PREFIXES:
            if len(w) > n:
                out.add(crc32(w[:n].encode(), n) & mask)
    return np.fromiter(out, np.int64, len(out))


@dataclass
class Logistic:
    bias: float
    weight: np.ndarray

    def score(self, idx: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weight[idx].sum(), -30, 30))))


def informative(rows: list[np.ndarray], target: np.ndarray, least_z: float = LEAST_Z) -> np.ndarray:
    """Features whose share among toxic and other rows differs by at least ``least_z`` standard errors."""
    n1, n0 = target.sum(), len(target) - target.sum()
    count = lambda keep: np.bincount(np.concatenate([r for r, k in zip(rows, keep, strict=True) if k] or [np.empty(0, int)]), minlength=1 << BITS)
    a, b = count(target > 0.5), count(target <= 0.5)
    p = (a + b) / max(n1 + n0, 1)
    z = (a / max(n1, 1) - b / max(n0, 1)) / np.sqrt(p * (1 - p) * (1 / max(n1, 1) + 1 / max(n0, 1)) + 1e-12)
    return (np.abs(z) >= least_z) & (a + b >= 4)


def train(rows: list[np.ndarray], target: np.ndarray, epochs: int = 12, alpha: float = 0.3, l1: float = 1.0, l2: float = 0.05, seed: int = 3) -> Logistic:
    """Follow-the-regularised-leader over the informative features."""
    share = float(np.mean(target)) if len(target) else 0.5
    chosen = informative(rows, target)
    rows = [r[chosen[r]] for r in rows]
    bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    rng = np.random.default_rng(seed)

    def weights(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((1 + np.sqrt(ni)) / alpha + l2))

    if 0 < share < 1:
        gb = 1.0
        for _ in range(epochs):
            for k in rng.permutation(len(rows)):
                i = rows[k]
                w = weights(z[i], n[i])
                g = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -30, 30))) - target[k]
                sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
                z[i] += g - sigma * w
                n[i] += g * g
                gb += g * g
                bias -= 0.05 * g / np.sqrt(gb)
    return Logistic(bias, weights(z, n))


def fit(docs: DataFrame, labels: DataFrame, model: np.ndarray, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Logistic:
    def extract(batches):
        restore = Restorer(model)
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "target": pdf["target"], "idx": [np.sort(indices(restore.words(t))).astype("<i4").tobytes() for t in pdf["text"]]})

    sample = training_sample(docs, labels, label_col, id_col, text_col, rows).mapInPandas(extract, "key long, target double, idx binary").toPandas()
    sample = sample.sort_values(["key", "target", "idx"], ignore_index=True)
    return train([np.frombuffer(i, "<i4") for i in sample["idx"]], sample["target"].to_numpy(float))


def score(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc id, held_out, score, predicted."""
    model = language_model(docs, text_col)
    learned = fit(docs, labels, model, label_col, id_col, text_col)

    @F.pandas_udf(T.DoubleType())
    def probability(text: pd.Series) -> pd.Series:
        restore = _restorer(model)
        return pd.Series([learned.score(indices(restore.words(t))) for t in text], dtype=float)

    key = F.col(id_col)
    out = docs.select(key, held_out(key).alias("held_out"), probability(F.col(text_col)).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))


_last: list = []


def _restorer(model: np.ndarray) -> Restorer:
    """The same restorer for all batches of a worker's task."""
    if not _last or _last[0].model is not model:
        _last[:] = [Restorer(model)]
    return _last[0]
