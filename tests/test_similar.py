"""Pairs above a threshold against all products."""

import numpy as np
import pytest

from weftline.operators import similar


def clusters(n, dims, seed, spread=0.2, centres=12):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dims))
    return c[rng.integers(0, centres, n)] + rng.normal(size=(n, dims)) * spread


def table(spark, v, base=0):
    rows = [(base + i, x.tolist(), "k") for i, x in enumerate(v)] + [(base + 10_000, None, "k"), (base + 10_001, [0.0] * v.shape[1], "k")]
    return spark.createDataFrame(rows, "id long, vec array<double>, key string").repartition(3)


@pytest.mark.parametrize("kind,threshold", [("clusters", 0.8), ("clusters", 0.95), ("spread", 0.3), ("one", 0.8), ("spread", 0.0)])
def test_all_pairs(spark, monkeypatch, kind, threshold):
    """Blocks and sides are small, so hot places are split; one: all rows in one place."""
    monkeypatch.setattr(similar, "BLOCK", 20)
    monkeypatch.setattr(similar, "RIGHT", 30)
    a, b = (clusters(150, 6, s, 0.2 if kind == "clusters" else 9.0) for s in (1, 2))
    if kind == "one":
        a, b = np.ones((150, 6)), np.ones((150, 6)) + 1e-3
    got = {(r.a, r.b): r.similarity for r in similar.similar_pairs(table(spark, a), table(spark, b, 500), "id", threshold, pivots=15).collect()}
    u, w = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    s = np.round(u @ w.T, 6)
    want = {(int(i), 500 + int(k)): s[i, k] for i, k in np.argwhere(s > threshold)}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_nothing(spark):
    some = table(spark, clusters(5, 3, 1))
    for x, y in ((some.limit(0), some), (some, some.limit(0)), (some.where("id >= 10000"), some)):
        assert similar.similar_pairs(x, y, "id").count() == 0
    with pytest.raises(ValueError):
        similar.similar_pairs(some, some, "id", -0.5)


def test_rows_reach_few_blocks():
    """In clusters a row goes to the blocks of its own and is spared the rest; the blocks of all its partners are among them."""
    v = clusters(600, 16, 3, 0.05)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    p = v[:24]
    own = similar.angles(v, p)
    home = own.argmin(axis=1)
    rows = []
    for h in sorted(set(home)):
        at = np.flatnonzero(home == h)
        seen = np.column_stack([own[at, h], own[at][:, : similar.REFERENCES]])
        rows.append((h, 0, len(at), seen.min(axis=0).tolist(), seen.max(axis=0).tolist()))
    blocks = similar.Blocks(p, rows)
    row, block = blocks.reached(v, float(np.arccos(0.9)))
    assert len(row) < 0.4 * len(v) * len(rows)
    place, reached = {r[0]: i for i, r in enumerate(rows)}, set(zip(row.tolist(), block.tolist()))
    assert all((int(k), place[home[i]]) in reached for i, k in np.argwhere(v @ v.T > 0.9))
