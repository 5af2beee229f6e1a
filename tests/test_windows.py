"""Means of windows against direct sums; a global shuffle; sums of products."""

import numpy as np
import pytest

from weftline.operators import embedding, vectors


@pytest.mark.parametrize("length", [1, 3, 10, 23])
def test_window_means(spark, monkeypatch, length):
    """Blocks are shorter than windows and texts; texts of every length, without known words, and with a null key."""
    monkeypatch.setattr(vectors, "WINDOW_BLOCK", 7)
    rng = np.random.default_rng(length)
    space = {w: rng.normal(size=3) for w in "abc"}
    texts = {k: [str(x) for x in rng.choice(list("abcxy"), n)] for k, n in enumerate([0, 1, 7, 8, 22, 23, 50])} | {90: ["x"] * 30, None: list("abcab")}
    rows = [(k, i, w, 5) for k, t in texts.items() for i, w in enumerate(t)]
    tokens = spark.createDataFrame(rows, "doc_id long, pos int, token string, block int").repartition(4)
    table = spark.createDataFrame([(w, v.tolist()) for w, v in space.items()], "token string, vec array<double>")
    got = {(r.doc_id, r.start): r for r in vectors.window_means(tokens, table, length).collect()}
    want = {(k, i): [space[w] for w in t[i : i + length] if w in space] for k, t in texts.items() for i in range(len(t) - length + 1)}
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k].n_known == len(v)
        assert got[k].vec is None if not v else np.allclose(got[k].vec, np.mean(v, axis=0))


def test_shuffled_pairs(spark):
    rows = [(f"a{i:03d}", f"b{i % 20:02d}") for i in range(90)]
    got = embedding.shuffled_pairs(spark.createDataFrame(rows, "first string, second string").repartition(5)).collect()
    assert sorted(r.first for r in got) == sorted(a for a, _ in rows) and sorted(r.second for r in got) == sorted(b for _, b in rows)
    import hashlib

    by = sorted((b for _, b in rows), key=lambda b: (hashlib.md5(f"0:{b}".encode()).hexdigest(), b))
    assert sorted((r.first, r.second) for r in got) == sorted(zip(sorted(a for a, _ in rows), by))


def test_translation_matrix(spark):
    rng = np.random.default_rng(2)
    w, x = rng.normal(size=(4, 3)), rng.normal(size=(40, 4))
    frame = lambda m: spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(m)], "token string, vec array<double>").repartition(3)
    pairs = spark.createDataFrame([(str(i), str(i)) for i in range(38)] + [("gone", "1")], "first string, second string")
    assert np.allclose(embedding.translation_matrix(pairs, frame(x), frame(x @ w)), w)
    with pytest.raises(ValueError):
        embedding.translation_matrix(pairs.limit(0), frame(x), frame(x))


def test_window_means_of_some_starts(spark):
    tokens = spark.createDataFrame([(1, p, "abx"[p % 3]) for p in range(9000)] + [(None, p, "a") for p in range(5)], "doc_id long, pos int, token string")
    space = spark.createDataFrame([("a", [1.0]), ("b", [3.0])], "token string, vec array<double>")
    starts = spark.createDataFrame([(1, 4095), (1, 4096), (1, 8990), (1, 8998), (2, 0)], "doc_id long, start int")
    rows = vectors.window_means(tokens, space, 4, starts=starts)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # with the starts, none with vectors
    whole = {(r.doc_id, r.start): (r.n_known, r.vec) for r in vectors.window_means(tokens, space, 4, limit=0).collect()}
    got = {(r.doc_id, r.start): (r.n_known, r.vec) for r in rows.collect()}
    assert got == {k: whole[k] for k in ((1, 4095), (1, 4096), (1, 8990))}
    assert {(r.doc_id, r.start): (r.n_known, r.vec) for r in vectors.window_means(tokens, space, 4).collect()} == whole


@pytest.mark.parametrize("length", [1, 3, 10, 23])
def test_text_windows(spark, monkeypatch, length):
    """From rows of words: as by positions, without a shuffle; pieces are shorter than windows and texts."""
    monkeypatch.setattr(vectors, "WINDOW_BLOCK", 7)
    rng = np.random.default_rng(length)
    texts = [(k, [str(x) for x in rng.choice(list("abcxy"), n)]) for k, n in enumerate([0, 1, 7, 8, 22, 23, 50])] + [(90, ["x"] * 30), (None, list("abcab")), (91, None)]
    table = spark.createDataFrame([(w, rng.normal(size=3).tolist()) for w in "abc"], "token string, vec array<double>")
    frame = spark.createDataFrame(texts, "doc_id long, words array<string>").coalesce(2)
    rows = vectors.text_windows(frame, table, length)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in plan and "Sort" not in plan
    exact = lambda df: sorted(((r.doc_id if r.doc_id is not None else -1, r.start, r.n_known, r.vec and [round(x, 9) for x in r.vec]) for r in df.collect()), key=repr)
    want = exact(vectors.text_windows(frame, table, length, limit=0))
    assert len(want) == sum(max(0, len(t or []) - length + 1) for _, t in texts) and exact(rows) == want
