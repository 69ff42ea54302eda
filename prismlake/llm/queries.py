"""The registered queries: each derives its contract's columns from its operator's results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import factorisation, licenses, line_dedup, mixing, near_dedup, oracles, packing, quality_rules, resampling, spherical, spotsigs, suffix_dedup, toxicity, variants
from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spotsigs.compare_with_next(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("id", "doc_id")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.components(table(spark, sf_dir, "documents"), width=4)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.dedup(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return cut.select("doc_id", F.col(cut.columns[-1]).cast("long").alias("n_removed"), F.length(text).cast("long").alias("n_chars_left"), F.sha2(text, 256).alias("kept_sha256"))


def op5_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.probabilities(table(spark, sf_dir, "documents"))
    return found.withColumn("probability", F.round("probability", 6))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return factorisation.score(docs, factorisation.fit(docs, table(spark, sf_dir, "labels")))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_anagram_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(table(spark, sf_dir, "documents"))


def op12_spherical_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spherical.components(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_spotsigs,
        op3_near_dedup,
        op4_line_dedup,
        op5_raking,
        op6_packing,
        op7_factorisation_machine,
        op8_licenses,
        op9_noisy_channel,
        op10_suffix_array,
        op11_anagram_hashing,
        op12_spherical_kmeans,
        op13_importance_resampling,
    )
}
ORACLES: dict[str, str] = {
    "op3_near_dedup": oracles.near_dedup(),
    "op5_raking": oracles.raking(),
    "op8_licenses": oracles.licence_scan(),
    "op11_anagram_hashing": oracles.spelling_variants(),
    "op12_spherical_kmeans": oracles.near_vectors(),
    "op13_importance_resampling": oracles.importance_draw(),
}
