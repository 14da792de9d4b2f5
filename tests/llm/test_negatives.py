"""Hard negatives against a plain search over all rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lintfleet.llm import negatives


def plain(rows, every, positives=5, keep=3, low=50, high=95):
    """rows: (vec_id, label, vector); repeated anchors ask once."""
    use = [(i, c, [math.floor(256 * x) for x in v]) for i, c, v in rows
           if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, c, v in {(i, c, tuple(v)) for i, c, v in use if i % every == 0}:
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, d) for j, d, w in use if len(w) == len(v))
        for p, j, _ in [x for x in scored if x[2] == c and x[1] != i][:positives]:
            inside = [(n, k) for n, k, d in scored if d != c and low * -p <= 100 * -n <= high * -p][:keep]
            out += [(i, j, r + 1, k, -p, -n) for r, (n, k) in enumerate(inside)]
    return sorted(out)


SHAPE = "vec_id long, label int, embedding array<double>"


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, SHAPE).repartition(4).select("*", *[F.lit("x").alias(c) for c in ("score", "anchor", "slot", "place", "rank", "a.b", "vector")])
    out = negatives.mine_negatives(df, F.col("vec_id") % 5 == 0, **more)
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in out.collect())


def near(rng, base, spread):
    return [x + rng.gauss(0, spread) for x in base]


def vectors(n=160):
    rng = random.Random(n)
    base = [rng.gauss(0, 0.3) for _ in range(8)]
    return [(i, rng.randrange(3), near(rng, base, rng.choice([0.05, 0.2]))) for i in range(n)]


def odd():
    base = [0.5] * 4
    rows = [(None, 1, base), (0, None, base), (5, 1, None), (10, 1, [0.5, None, 0.5, 0.5]), (15, 1, [float("nan"), 1.0, 1.0, 1.0]), (20, 2, [math.inf, 0.0, 0.0, 0.0]),
            (25, 1, []), (26, 1, []), (27, 2, []), (30, 1, [1.0, 2.0]), (31, 1, [1.0, 2.5]), (32, 2, [1.0, 1.6]), (35, 1, [0.0] * 4)]
    rows += [(i, i % 2, base) for i in range(40, 90)]  # ties
    rows += [(45, 1, base), (45, 1, base), (45, 0, [0.1] * 4), (50, 0, [-0.5] * 4), (51, 0, [-0.5] * 4), (52, 1, [-0.4] * 4)]
    return rows + [(60 + i, 1, [0.45, 0.45, 0.4, 0.5]) for i in range(4)]


@pytest.mark.parametrize("rows", [vectors(), odd(), [], [(5, 1, [1.0, 2.0])]])
@pytest.mark.parametrize("anchor_bytes", [negatives.ANCHOR_BYTES, 400])
def test_equals_a_plain_search(spark, rows, anchor_bytes):
    assert mined(spark, rows, anchor_bytes=anchor_bytes) == plain(rows, 5)


def test_windows_and_counts_are_parameters(spark):
    rows = vectors(90)
    assert mined(spark, rows, positives=2, negatives=4, low=20, high=80) == plain(rows, 5, 2, 4, 20, 80)


def test_large_components_keep_their_order(spark):
    rows = [(i, i % 2, [2.0**20 + i, 3.0 * i, 2.0**21]) for i in range(20)] + [(20 + i, i % 2, [2.0**25 + i, -1.0]) for i in range(12)]
    assert mined(spark, rows) == plain(rows, 5)
    huge = [(0, 1, [1e300, 1.0]), (1, 1, [1e300, 2.0]), (2, 2, [1e299, 1.0])]
    assert mined(spark, huge) == []  # all scores are the outermost one, so no other label is in the window
