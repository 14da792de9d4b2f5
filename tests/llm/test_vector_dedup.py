"""Near duplicates among vectors against a comparison of all, and the recall of the index right at the threshold."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lintfleet.llm import vector_dedup

SHAPE = "vec_id long, label int, embedding array<double>"


def plain(rows, cosine=0.93):
    """(vec_id, n_links, component_id, kept) of rows (vec_id, label, vector)."""

    def usable(row):
        i, c, v = row
        return i is not None and c is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    unit = [np.array(v) / abs(np.array(v)).max() if usable((i, c, v)) else None for i, c, v in rows]
    unit = [None if u is None else u / np.linalg.norm(u) for u in unit]
    links = [[b for b in range(len(rows)) if a != b and unit[a] is not None and unit[b] is not None and rows[a][1] == rows[b][1]
              and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine] for a in range(len(rows))]
    out, seen = [None] * len(rows), set()
    for start in range(len(rows)):
        if start in seen:
            continue
        todo, group = [start], {start}
        while todo:
            for b in links[todo.pop()]:
                if b not in group:
                    group.add(b)
                    todo.append(b)
        seen |= group
        least = min((rows[g][0] for g in group), key=lambda x: (x is None, x))
        for g in group:
            out[g] = (rows[g][0], len(links[g]), least, rows[g][0] == least)
    return out


def found(spark, rows, shape=SHAPE, **more):
    df = spark.createDataFrame(rows, shape).repartition(4).select("*", *[F.lit("x").alias(c) for c in ("node", "n", "key", "raw", "cell", "a.b", "at", "links", "kept")])
    return [(r.vec_id, r.n_links, r.component_id, r.kept) for r in vector_dedup.near_duplicates(df, **more).collect()]


def order(rows):
    return sorted(rows, key=lambda x: tuple((v is None, v or 0) for v in x))


def clusters(n=400, dims=12, seed=5):
    """Vectors around centres, many pairs near the threshold, one group far larger than the others."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, dims))
    which = np.where(rng.random(n) < 0.35, 0, rng.integers(40, size=n))
    points = centres[which] + rng.normal(size=(n, dims)) * rng.choice([0.0, 0.05, 0.2, 0.3], size=n)[:, None]
    return [(int(i), int(i % 2), p.tolist()) for i, p in zip(rng.permutation(n), points, strict=True)]


ODD = [(None, 1, [1.0, 0.0]), (None, 1, [1.0, 0.0]), (1, None, [1.0, 0.0]), (2, 1, None), (3, 1, []), (4, 1, [0.0, 0.0]), (5, 1, [1.0, None]), (6, 1, [1.0, math.nan]),
       (7, 1, [math.inf, 0.0]), (8, 1, [1.0, 0.0]), (9, 1, [2.0, 0.0]), (10, 1, [-0.0, 1.0]), (11, 1, [0.0, 1.0]), (12, 2, [0.0, 1.0]), (13, 1, [1.0, 0.0, 0.0]), (14, 1, [3.0]),
       (15, 1, [-3.0]), (16, 1, [1e300, 1e300]), (17, 1, [1e-300, 1e-300]), (18, 1, [7.0]), (8, 1, [1.0, 0.0]), (8, 1, [0.0, -1.0]), (8, 2, [0.0, 1.0])]


@pytest.mark.parametrize("more", [{}, {"block": 3}, {"per_cell": 1}, {"per_cell": 1, "block": 3, "recall": 1.0}])
def test_odd_rows(spark, more):
    rows = ODD + [(100 + i, 3, [1.0, 1.0]) for i in range(12)]
    assert order(found(spark, rows, **more)) == order(plain(rows))


@pytest.mark.parametrize("rows", [[], [(1, 1, [1.0])], [(1, None, None)]])
def test_few_rows(spark, rows):
    assert order(found(spark, rows)) == order(plain(rows))


@pytest.mark.parametrize("block", [vector_dedup.BLOCK, 16])
def test_full_recall_equals_a_comparison_of_all(spark, block):
    rows = clusters()
    assert order(found(spark, rows, recall=1.0, per_cell=8, block=block)) == order(plain(rows))


def test_index_finds_nearly_all_and_nothing_else(spark):
    rows = clusters(600)
    want = {i: n for i, n, _, _ in plain(rows)}
    got = {i: n for i, n, _, _ in found(spark, rows, per_cell=8, block=32)}
    assert all(got[i] <= want[i] for i in want)
    assert sum(got.values()) >= 0.97 * sum(want.values()) > 1000


def test_recall_at_the_threshold():
    """Pairs at exactly the threshold, which are the hardest, in other directions than those the bound was set with."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=(3000, 24))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    grid = vector_dedup.fit(base, 20, 0.93, vector_dedup.RECALL)
    away = rng.laplace(size=base.shape)
    away -= (away * base).sum(1, keepdims=True) * base
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    partner = 0.93 * base + math.sqrt(1 - 0.93**2) * away

    def visits(points):
        left, right = vector_dedup.halves(points, 12)
        return [vector_dedup.traverse(a, b, grid.excess) for a, b in zip(vector_dedup.distances(left, grid.first), vector_dedup.distances(right, grid.second), strict=True)]

    x, y = visits(base), visits(partner)
    assert np.mean([a[0] in b or b[0] in a for a, b in zip(x, y, strict=True)]) >= 0.95
    assert np.mean([len(a) for a in x]) < 200  # of 400 cells


def test_traversal_goes_by_ascending_distance():
    rng = random.Random(3)
    for _ in range(30):
        a, b = np.array([rng.random() for _ in range(7)]), np.array([rng.random() for _ in range(5)])
        sums = (a[:, None] + b[None, :]).ravel()
        cells = vector_dedup.traverse(a, b, 0.4)
        assert sorted(cells) == np.flatnonzero(sums - sums.min() <= 0.4).tolist()
        assert (np.diff(sums[cells]) >= 0).all()
    assert sorted(vector_dedup.traverse(a, b, np.inf)) == list(range(35))
