import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

EXTRA = ["id", "key", "n", "h", "version", "component", "sim", "g", "spans", "words", "topic", "kept", "_key", "rank", "block"]


def words(rng, n, vocabulary=400):
    return [rng.choice(VOCABULARY[:vocabulary]) for _ in range(n)]


_rng = random.Random(5)
VOCABULARY = ["the", "of", "and", "in", "is", "that", "with", "de", "der"] + ["".join(_rng.choice("abcdefghijklmnoprstuvé") for _ in range(_rng.randint(3, 9))) for _ in range(600)]


def make_texts(n=60, seed=1):
    """Prose with copies, near copies, shared passages and lines, and the edge cases."""
    rng = random.Random(seed)
    passage = " ".join(words(rng, 60))
    out = []
    for i in range(n):
        lines = [" ".join(words(rng, rng.randint(3, 30))).capitalize() + "." for _ in range(rng.randint(1, 6))]
        if i % 7 == 3:
            lines.insert(rng.randint(0, len(lines)), passage)
        if i % 5 == 2:
            lines.insert(0, "A common line that many of the documents have in them.")
        out.append("\n".join(lines))
    for i in range(0, n, 9):
        out.append(out[i])
        w = out[i].split(" ")
        for _ in range(max(1, len(w) // 60)):
            w[rng.randrange(len(w))] = "edited"
        out.append(" ".join(w))
    return [*out, None, "", "one", "two words", "aaaa " * 400, " ".join(words(rng, 6000)), "\n\n", "ÀÉ ñ x" * 30]


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, ("en", "fr", None)[i % 3], f"src{i % 4}" if i % 10 else None, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def labels(spark, texts):
    return spark.createDataFrame([(i, int(i % 6 != 1), int(i % 4 == 1)) for i in range(0, len(texts), 2)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def clashing(docs):
    """The documents with extra columns of names that operators use inside."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit(1) for c in EXTRA})
