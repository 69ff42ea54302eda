"""Document fingerprints: SpotSigs.

A signature is a common-word anchor with the CHAIN content words that follow
it; a document's fingerprint is its set of signatures. Sets are compared by
Jaccard similarity, pruned by their lengths: sets whose lengths differ by more
than the threshold allows fall into partitions that are never compared, and
two similar sets share a signature among the first few of each.

Defined results: texts without any signature have one of all their words; null
and empty texts have an empty fingerprint, which is like another empty one (1)
and unlike all others (0); rows that repeat follow each other in the order of
ids; of a single row the next document is itself; an empty table gives an
empty result. Only id and text are read.
"""

from __future__ import annotations

import base64
import hashlib
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import linking
from .common import materialise, partitions

CHAIN = 2
THRESHOLD = 0.8
#: Buckets of neighbouring ids for each partition.
BUCKETS = 4
#: Common words of English, French, German and Spanish.
ANCHORS = frozenset(
    w.encode()
    for w in (
        "the of and to in is that for with by are it on this be from as was or at an a he not but "
        "de la le les et des en un une du que qui dans pour par sur pas au est il ce se ne avec "
        "der die das und den dem ist von mit zu auf für im nicht ein eine als auch sich es bei "
        "el los las y por con para su al del no lo como más o"
    ).split()
)
_PUNCTUATION = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def signatures(text: str | None, chain: int = CHAIN) -> np.ndarray:
    """The distinct signatures of a whole text as sorted 32-bit hashes."""
    words = (text or "").lower().encode().translate(_PUNCTUATION).split()
    spots, content = [], []
    for w in words:
        if w in ANCHORS:
            spots.append((w, len(content)))
        else:
            content.append(w)
    last = len(content) - chain
    found = {crc32(b" ".join((a, *content[k : k + chain]))) for a, k in spots if k <= last}
    if not found and words:
        found = {crc32(b"\0" + b" ".join(words))}
    return np.array(sorted(found), ">u4")


def fingerprint(found: np.ndarray) -> str:
    return base64.b64encode(found.tobytes()).decode()


def parsed(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), ">u4")


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets; 0 without a comparison where their lengths alone rule out ``least``."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _compared(key, text: str, own: np.ndarray, after: str, after_sigs: np.ndarray) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + after[:half]
    sigs = signatures(edited)
    return (key, len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprint(own), fingerprint(sigs), likeness(own, sigs), likeness(own, after_sigs))


RESULT = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
RESULT_TYPES = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, its edited text's, and likeness to that and to the next document's, by descending id.

    Documents are dealt once to buckets of neighbouring ids; each bucket also
    gets the first document of the bucket after it, so that all neighbours
    meet. Only the buckets' bounds and first ids reach the driver.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.coalesce(F.col("id"), F.lit(-(1 << 63)).cast("long"))
    given = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("k", key)
    parts = partitions(spark)
    n = BUCKETS * parts
    bounds = np.array(sorted({int(x) for x in given.approxQuantile("k", [i / n for i in range(1, n)], 1 / (4 * n))}), np.int64)

    @F.pandas_udf("int")
    def bucket(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, k.to_numpy(np.int64), "right"), dtype="int32")

    given = given.withColumn("bucket", bucket("k"))
    heads = sorted(((r["bucket"], r["k"]) for r in given.groupBy("bucket").agg(F.max("k").alias("k")).collect()), reverse=True)
    following = spark.createDataFrame([(k, b) for (b, _), (_, k) in zip(heads, heads[1:] + heads[:1], strict=True)], "k long, bucket int")
    order = F.xxhash64("text")
    first = given.drop("bucket").join(F.broadcast(following), "k").groupBy("k", "bucket").agg(F.min_by("text", order).alias("text"))
    rows = given.withColumn("after", F.lit(False)).unionByName(first.select(F.lit(None).cast("long").alias("id"), "text", "k", "bucket", F.lit(True).alias("after")))
    dealt = rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "after", F.col("k").desc(), order)

    def run(batches):
        here, last = None, None
        for pdf in batches:
            out = []
            for key, text, b, after in zip(pdf["id"], pdf["text"], pdf["bucket"], pdf["after"], strict=True):
                if b != here:
                    here, last = b, None
                sigs = signatures(text)
                if last is not None:
                    out.append(_compared(*last, text, sigs))
                last = None if after else (key, text, sigs)
            yield pd.DataFrame(out, columns=RESULT).astype({"id": "Int64", "n_chars": "Int64", "near_edited": "float64", "near_next": "float64"})

    return dealt.select("id", "text", "bucket", "after").mapInPandas(run, RESULT_TYPES)


def groups(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component): documents linked by a fingerprint likeness of ``threshold`` or more; no link is lost.

    Equal fingerprints are one class. A set shares one of the first
    n - ceil(threshold n) + 1 signatures with every set as similar, within its
    own length partition or the next.
    """

    def sign(batches):
        for pdf in batches:
            sigs = [signatures(t) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "n": [len(s) for s in sigs], "fp": [s.tobytes() for s in sigs]})

    def index(batches):
        step = np.log(1 / threshold)
        for pdf in batches:
            rows = []
            for key, n, fp in zip(pdf["id"], pdf["n"], pdf["fp"], strict=True):
                first = np.frombuffer(fp, ">u4")[: n - int(np.ceil(threshold * n - 1e-9)) + 1]
                band = int(np.log(n) / step)
                rows += [((int(s) << 16) + b, key, n) for s in first for b in (band, band + 1)]
            yield pd.DataFrame(rows, columns=["key", "id", "size"]).astype("int64")

    def check(batches):
        for pdf in batches:
            like = [likeness(np.frombuffer(x, ">u4"), np.frombuffer(y, ">u4"), threshold) for x, y in zip(pdf["fa"], pdf["fb"], strict=True)]
            yield pdf.loc[np.array(like, float) >= threshold - 1e-12, ["a", "b"]]

    given = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = materialise(given.mapInPandas(sign, "id long, n long, fp binary").withColumn("h", F.xxhash64("fp")), "spots")
    classes = materialise(rows.where("n > 0").groupBy("h").agg(F.min("id").alias("id")).join(rows.select("id", "h", "n", "fp"), ["id", "h"]).dropDuplicates(["h"]), "spot-classes")
    keyed = materialise(classes.select("id", "n", "fp").mapInPandas(index, "key long, id long, size long"), "spot-index")
    shared = keyed.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select("key")
    side = lambda c: classes.select(F.col("id").alias(c), F.col("fp").alias(f"f{c}"))
    labels = linking.resolve(
        keyed.join(shared, "key", "left_semi"), lambda pairs: pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(check, "a long, b long"), lambda x, y: F.least(x, y) >= threshold * F.greatest(x, y)
    )
    found = classes.select("h", F.col("id").alias("rep"))
    found = found.withColumn("component", F.col("rep")) if labels is None else found.join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    return rows.select("id", "h").join(materialise(found.select("h", "component"), "spot-groups"), "h", "left").select("id", F.coalesce("component", "id").alias("component"))
