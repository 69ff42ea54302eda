"""The training-text pipeline: five stages over ``documents``.

Each stage takes all that its predecessor kept, written as Parquet and read
again; all but the last return the columns of ``documents``.

Defined results, for all stages: other columns pass through, whatever their
names, up to packing, which reads id and text alone. A null or empty text has no
words and goes in the first stage; so does any text of fewer than ten words. A
null id is an id. Rows that repeat are judged alike by the quality rules, keep
their lines both (they are one document), and become one row in near-dedup. Of
equal documents the one of the least id stays, whatever the order of rows.
Texts of any length are read whole. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismlake.llm import line_dedup, mixing, near_dedup, packing, quality_rules
from prismlake.llm.common import discard, materialise, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; without labels the threshold is a fixed one."""
    return quality_rules.filter_documents(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; documents stay, with what is left of their text (it may be empty), and n_chars follows it."""
    cut = line_dedup.dedup(docs).withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long"))
    return cut.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: shingles of five words, similarity of 0.8 or more."""
    return near_dedup.filter_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled to flattened source, language and topic weights; a null source or language is a value of its own."""
    return mixing.sample(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents that are left, in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near_copies), ("mixing", mix), ("packing", pack)]

#: The forest, the edit similarity of lines and the tokenizer cannot be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``."""
    docs, written = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
        if written is not None:
            discard(written)
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)
