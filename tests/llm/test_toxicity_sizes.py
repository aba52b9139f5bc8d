"""The classifier on tables of several sizes: the constant follows the prior, clean rows stay clean, reruns agree."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from filmfold.llm import toxicity


def test_constant_for():
    scores = np.array([-3.0, 0.0, 2.0, 5.0])
    for prior in (0.01, 0.12, 0.5):
        shifted = scores + toxicity.constant_for(scores, prior)
        assert abs((1 / (1 + np.exp(-shifted))).mean() - prior) < 1e-9


def test_a_fit_on_noise_stays_at_the_prior():
    rng = np.random.default_rng(2)
    positive = np.arange(400) < 40
    rows = [np.unique(rng.integers(0, 30, 5)) for _ in positive]
    weights, constant = toxicity.fit(rows, positive, 30, 0.1)
    scores = np.array([weights[r].sum() + constant for r in rows])
    assert abs((1 / (1 + np.exp(-scores[~positive]))).mean() - 0.1) < 0.02


@pytest.mark.parametrize("size, recall", [("sf0.001", 0.0), ("sf0.01", 0.5)])
def test_held_out_rows(spark, size, recall):
    docs, labels = (spark.read.parquet(f"/root/testdata/{size}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    rows = toxicity.held_out(toxicity.score(docs.select("doc_id", "text"), model)).join(
        labels.select("doc_id", "toxic"), "doc_id").filter("held_out and toxic is not null").collect()
    wrong = [r.predicted for r in rows if r.toxic == 0]
    assert sum(wrong) <= 0.05 * len(wrong)
    assert np.mean([r.predicted for r in rows if r.toxic == 1]) >= recall
    again = toxicity.train(docs.repartition(7), labels.orderBy(F.desc("doc_id")))
    assert again.bias == pytest.approx(model.bias, abs=1e-9) and again.weights.keys() == model.weights.keys()
