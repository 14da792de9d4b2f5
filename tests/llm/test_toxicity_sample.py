"""A score means the same whether or not the sample reaches its bound."""

import random

import pytest

from lintfleet.llm import toxicity
from tests.llm.conftest import WORDS


def test_the_bound_of_the_sample_does_not_move_the_score(spark, docs_of):
    rng = random.Random(4)
    rows, toxic = [], []
    for i in range(4000):
        bad = i % 10 == 0
        toxic.append((i, int(bad)))
        rows.append((i, " ".join(rng.choices(WORDS, k=8)) + (" vileword" if rng.random() < (0.7 if bad else 0.02) else "")))
    labels = spark.createDataFrame(toxic, "doc_id long, toxic int")
    whole, bounded = (toxicity.train(docs_of(rows), labels, size=size) for size in (4000, 300))
    assert b"vileword" in whole.odds and b"vileword" in bounded.odds
    assert bounded.probability(0.0) == pytest.approx(whole.probability(0.0), abs=0.03)
    assert whole.probability(0.0) == pytest.approx(0.033, abs=0.02)
