"""Recall of linked vectors where links are rare or one group is large."""

import numpy as np
import pytest

from quadrat.llm import vectors


def test_audit_is_per_node():
    large = {i: 5000 for i in range(2000)}
    pairs = {10_000 + i: 1 for i in range(300)}
    assert not vectors.recall_holds(large | pairs, large, False)  # all pairs lost beside a large group
    assert vectors.recall_holds(large | pairs, large | pairs, False)
    assert not vectors.recall_holds({i: 0 for i in range(4096)}, {}, False)  # nothing measured
    assert vectors.recall_holds({i: 0 for i in range(50)}, {}, True)
    assert not vectors.recall_holds({1: 1, 2: 1}, {1: 1}, True)


@pytest.mark.parametrize("dim", [8, 64])
def test_rare_pairs_beside_a_large_group(spark, dim):
    """A large group of near copies and pairs of cosine 0.905 to 0.93: nearly all of the pairs are found."""
    rng = np.random.default_rng(dim)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    centre = unit(rng.normal(size=(1, dim)))
    large = unit(centre + 0.005 * rng.normal(size=(2000, dim)))
    a = unit(rng.normal(size=(2500, dim)))
    side = rng.normal(size=a.shape)
    side = unit(side - (side * a).sum(1, keepdims=True) * a)
    cos = rng.uniform(0.905, 0.93, (len(a), 1))
    x = np.concatenate([large, a, cos * a + np.sqrt(1 - cos**2) * side])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = np.array([r.n_links for r in vectors.linked_vectors(df).orderBy("vec_id").collect()])
    near = x @ x.T >= vectors.LEAST
    np.fill_diagonal(near, False)
    want = near.sum(1)
    rest = np.arange(len(x)) >= len(large)
    share = got[rest & (want > 0)] / want[rest & (want > 0)]
    assert (got <= want).all() and share.mean() >= 0.96
