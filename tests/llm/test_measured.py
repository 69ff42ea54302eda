"""What the fitted operators reach on labels that they did not see, on the given tables."""

import os

import numpy as np
import pytest
from prismlake.llm import factorisation, quality_rules, toxicity
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def area(score, positive):
    """Share of pairs of a positive and a negative row that the score puts in order."""
    a, b = score[positive][:, None], score[~positive][None]
    return float(((a > b) + 0.5 * (a == b)).mean())


def held_out(scored, labels, column):
    found = scored.where("held_out").join(labels.where(F.col(column).isNotNull()).select("doc_id", column), "doc_id").toPandas()
    return found["score"].to_numpy(float), found["predicted"].to_numpy(int) == 1, found[column].to_numpy(int) == 1


def test_quality_classifier_on_held_out_labels(given):
    docs, labels = given
    score, predicted, good = held_out(factorisation.score(docs, factorisation.fit(docs, labels)), labels, "quality")
    assert len(score) > 500 and area(score, good) > 0.95
    assert predicted[good].mean() > 0.95 and predicted[~good].mean() < 0.3


def test_toxicity_on_held_out_labels(given):
    docs, labels = given
    score, predicted, toxic = held_out(toxicity.score(docs, labels), labels, "toxic")
    assert len(score) > 500 and area(score, toxic) > 0.93
    assert predicted[~toxic].mean() < 0.05


def test_quality_rules_on_held_out_labels(given):
    """The threshold is calibrated without the fold that it is judged on."""
    docs, labels = given
    fold = factorisation.held_out(F.col("doc_id"))
    judged = quality_rules.judge(docs, labels.where(~fold)).join(labels.where(fold), "doc_id").toPandas()
    good, kept = judged["quality"].to_numpy(int) == 1, judged["kept"].to_numpy(bool)
    assert good.sum() > 400 and kept[good].mean() > 0.93
    assert (~good).sum() == 0 or np.mean(~kept[~good]) > 0.5
