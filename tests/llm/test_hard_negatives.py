"""Hard negatives against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat.llm import hard_negatives


def brute(rows, anchors):
    sound = []
    for key, vector, label in rows:
        if key is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        sound.append((key, [math.floor(256 * x) for x in vector], label))
    out = []
    for a, q, mine in sound:
        if not anchors(a):
            continue
        scores = [(-sum(x * y for x, y in zip(q, p)), b, label) for b, p, label in sound if b != a]
        for down, positive, _ in sorted(s for s in scores if s[2] == mine)[:5]:
            fit = sorted(s for s in scores if s[2] != mine and 30 * -down <= 100 * -s[0] <= 90 * -down)
            out += [(a, positive, r, n, -down, -s) for r, (s, n, _) in enumerate(fit[:10], 1)]
    return sorted(out)


def mined(spark, rows, every=10):
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id bigint, embedding array<float>, label int, rank int")
    return sorted(map(tuple, hard_negatives.mine(df, F.col("vec_id") % every == 0).collect()))


def vectors(n, dims, clusters, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims))
    x = centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, dims)) * rng.choice([0.05, 0.5, 2.0], (n, 1))
    x[n // 2 : n // 2 + n // 5] = x[0]  # a large group of copies
    return [(i, [float(np.float32(v)) for v in row], int(label)) for i, (row, label) in enumerate(zip(x, rng.integers(0, 3, n)))]


@pytest.mark.parametrize("clusters", [1, 12])
def test_brute_force(spark, monkeypatch, clusters):
    monkeypatch.setattr(hard_negatives, "SLICE", 150)
    monkeypatch.setattr(hard_negatives, "BLOCK", 9)
    monkeypatch.setattr(hard_negatives, "CLUSTER", 12)
    monkeypatch.setattr(hard_negatives, "STRIDE", 16)
    rows = vectors(700, 6, clusters, clusters)
    want = brute(rows, lambda a: a % 10 == 0)
    assert want and mined(spark, rows) == want


def test_walks_end_early(spark):
    """Clustered rows: the bound of far cells ends the walk before it looks at them."""
    rng = np.random.default_rng(2)
    members = np.array([[1000, 10, 0], [1000, 0, 10]])
    near = np.array([[900 + i, i, i] for i in range(20)])
    far = rng.integers(-100, 0, (5000, 3))
    x = np.concatenate([near, far])
    bounds = hard_negatives.upper_bounds(x.astype(float), hard_negatives.unit(members[:1].astype(float))[0], 0.02)
    looked = []
    wants = np.arange(2), np.full(2, -(1 << 60)), np.full(2, 1 << 60), np.full(2, -(1 << 60)), lambda rows, at: looked.append(len(at)) or np.ones((len(rows), len(at)), bool)
    sizes = np.linalg.norm(members, axis=1)
    rows, at, scores = hard_negatives.walk(members, sizes, x, np.arange(len(x)), bounds, wants, 5)
    full = members @ x.T
    assert sum(looked) <= 2 * hard_negatives.STRIDE
    for r in (0, 1):
        assert sorted(scores[rows == r])[::-1] == sorted(full[r])[::-1][:5]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 1), (1, [1.0, 0.5], 1), (2, [0.5, 0.5], 2), (3, None, 1), (4, [1.0, None], 1), (5, [nan, 1.0], 2), (6, [inf, 1.0], 2),
        (None, [1.0, 1.0], 1), (7, [1.0, 1.0], None), (8, [], 2), (9, [0.7], 2), (10, [0.0, 0.0], 1), (11, [0.5, 0.5], 2), (11, [0.5, 0.5], 2),
        (20, [-1.0, 0.0], 3), (21, [1.0, 0.0], 3),
    ]
    want = brute(rows, lambda a: a % 10 == 0)
    assert want and mined(spark, rows) == want


def test_empty(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []  # no anchor
