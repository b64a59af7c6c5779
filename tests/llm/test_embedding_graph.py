"""The graph and the search of op2 go on for all vectors of a shard together, and vectors travel as they were given."""

import numpy as np
import pandas as pd

from areaqual.llm import embedding_dups

SETTINGS = embedding_dups.Settings()


def units(n, size=8, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, size))
    x[n // 2 :] = x[: n - n // 2] + 0.05 * rng.normal(size=(n - n // 2, size))
    return x / np.linalg.norm(x, axis=1)[:, None]


def plain_prune(s, at, others, degree, alpha):
    """One node and one kept neighbour after the other."""
    kept = []
    for factor in (1.0, alpha * alpha):
        for k in others:
            if k not in kept and len(kept) < degree and all(factor * (1 - s[m, k]) > 1 - s[at, k] for m in kept):
                kept.append(k)
    return sorted(kept)


def test_robust_prune_matches_a_plain_one():
    x = units(80)
    s = x @ x.T
    others = np.array([[k for k in np.argsort(-s[at]) if k != at][:30] for at in range(80)])
    others[::7, 20:] = -1
    for degree in (3, 8, 24):
        kept = embedding_dups.robust_prune(s, np.arange(80), others, degree, 1.2)
        for at in range(80):
            want = plain_prune(s, at, [k for k in others[at] if k >= 0], degree, 1.2)
            assert sorted(others[at][kept[at]]) == want


def test_search_of_all_queries_finds_what_is_in_range():
    x = units(600)
    a, b, medoid = embedding_dups.build(x, SETTINGS)
    assert (np.diff(a) >= 0).all() and (a != b).all() and np.bincount(a).max() <= 2 * SETTINGS.degree
    near = np.full((600, 2 * SETTINGS.degree), 600)
    for k in range(600):
        near[k, : (a == k).sum()] = b[a == k]
    q, k = embedding_dups.in_range(x @ x.T, near, [medoid], SETTINGS)
    real = x @ x.T >= SETTINGS.least
    assert len({*zip(q.tolist(), k.tolist())}) == len(q) and real[q, k].all()
    assert len(q) >= 0.95 * real.sum()


def test_links_of_many_pairs_lead_to_the_smallest():
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 300, (2, 200))
    best = np.arange(300)
    for _ in range(300):
        for m, n in zip(a, b):
            best[m] = best[n] = min(best[m], best[n])
    assert (embedding_dups.smallest_linked(a, b, 300) == best).all()


def test_neighbours_elsewhere_are_passed_over():
    near = embedding_dups._neighbours(np.array([50, 7, 9]), pd.Series([np.array([7, 8, 9]), np.array([], np.int64), np.array([50])]))
    assert [sorted(r) for r in near.tolist()] == [[1, 2], [3, 3], [0, 3]]


def test_vectors_travel_as_they_were_given(spark):
    rows = [(k, v.tolist(), 1) for k, v in enumerate(units(20))]
    classes = embedding_dups._classes(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    kinds = dict(embedding_dups._assigned(classes, SETTINGS).dtypes)
    assert kinds["embedding"] == "array<float>" and "unit" not in kinds
    column = pd.Series([np.array([3e37, 4e37], np.float64), np.array([1e-30, 0], np.float64)])
    assert np.allclose(embedding_dups.unit_vectors(column), [[0.6, 0.8], [1, 0]])
