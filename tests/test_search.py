import os
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.config import SearchConfig, grid
from weftline.operators import cluster, passages, reuse, search
from weftline.sources.shared import stored


@pytest.mark.parametrize("n,long,short,want", [(20, 1.0, 1.3, 46), (21, 1.0, 1.3, 42), (13, 0.4, 1.4, 31), (26, 0.4, 1.4, 36), (18, 1.0, 1.6, 46)])
def test_search_length(spark, n, long, short, want):
    assert SearchConfig(long_adjust=long, short_adjust=short).search_length(n) == want
    got = spark.createDataFrame([(n,)], "n int").select(search.search_length(F.col("n"), long, short, 20).alias("x")).first()["x"]
    assert got == want


def test_grid_and_directory():
    assert len(grid(top_n=[1, 2], method=["a", "b", "c"])) == 6
    assert SearchConfig(long_adjust=1.0, short_adjust=1.3, method="word").results_dir("t") == "t_full_130_20_100_500_word"


def hits(spark, starts, n, q=1):
    rows = [(q, s, 1.0 - i / 100, i + 1, n) for i, s in enumerate(starts)]
    return spark.createDataFrame(rows, "query_id long, start long, similarity double, rank int, search_len int")


def test_islands(spark):
    got = cluster.islands(hits(spark, [30, 1, 2, 3, 9, 10], 2), F.lit(2)).orderBy("begin").collect()
    assert [(r.begin, r.end, r.best_rank) for r in got] == [(1, 4, 2), (9, 11, 5), (30, 31, 1)]
    assert [r.cluster_no for r in got] == [2, 3, 1]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 200), unique=True, max_size=40), st.integers(1, 20))
def test_greedy_heads(starts, n):
    got = cluster.greedy_heads(starts, n)
    assert sorted(x for _, own in got for x in own) == sorted(starts)
    assert [i for i, _ in got] == sorted(i for i, _ in got)


def test_greedy_claims_around_the_best_hit():
    """A head claims what starts from search_len - 1 before to search_len after it."""
    assert cluster.greedy_heads([100, 93, 110, 111, 90, 101], 10) == [(0, [93, 100, 101, 110]), (3, [111]), (4, [90])]


def test_overlap_and_flags(spark):
    pct = cluster.overlap_percent(F.lit(12), F.lit(20), F.lit(10), F.lit(4))
    none = cluster.overlap_percent(F.lit(14), F.lit(20), F.lit(10), F.lit(4))
    assert spark.range(1).select(pct, none, cluster.overlap_percent(F.lit(0), F.lit(3), F.lit(0), F.lit(4))).first()[:] == (50.0, 0.0, 100.0)
    found = spark.createDataFrame([(1, 3, 71.25), (1, 10, 73.75), (2, 1, 95.0), (2, 7, 100.0)], "query_id long, cluster_no int, pct double")
    le = {r.query_id: r for r in cluster.flags(found, SearchConfig()).collect()}
    assert not le[1].any_full and le[1].near_some and le[1].best_partial_rank == 10
    assert le[2].top_full and le[2].best_overlap_rank == 7 and le[2].first_hit_rank == 1
    odd = {r.query_id: r for r in cluster.flags(found, SearchConfig(topk_mode="reference", threshold_unit="reference")).collect()}
    assert odd[1].any_full and odd[1].near_full and odd[1].best_overlap_rank == 10


@pytest.mark.parametrize("matrix_bytes", [search.MATRIX_BYTES, 0])
@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_scan_against_direct_sums(spark, metric, matrix_bytes):
    """By one matrix for all blocks, and by each block's own vectors."""
    rng = np.random.default_rng(0)
    vectors = np.vstack([np.zeros(4), rng.normal(size=(9, 4))])
    flat = rng.integers(0, 10, 102)
    q = pd.DataFrame({"variant": [0, 0, 1, 1], "query_id": [5, 6, 5, 9], "vector": [rng.normal(size=4) for _ in range(3)] + [np.zeros(4)], "search_len": [7, 3, 5, 5], "top_n": [4, 4, 2, 2], "gold_start": [-1, -1, 30, -1], "gold_similarity": [np.nan, np.nan, 0.1, np.nan]})
    coded = spark.createDataFrame([(i, int(x) or None) for i, x in enumerate(flat)], "g long, code long").repartition(3)
    codes = stored(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors) if i], "code long, vec array<double>"), "codes")
    pieces = search.blocks(coded, 6, 16)
    found = search.scan(pieces, codes, q, len(flat), block=16, metric=metric, matrix_bytes=matrix_bytes).collect()
    for r in q.itertuples():
        sims = []
        for s in range(len(flat) - r.search_len + 1):
            own = flat[s : s + r.search_len]
            if np.count_nonzero(own) and (r.vector.any() or metric == "euclidean"):
                w = vectors[own].sum(axis=0) / np.count_nonzero(own)
                v = w @ r.vector / np.linalg.norm(w) / np.linalg.norm(r.vector) if metric == "cosine" else 1 - np.linalg.norm(w - r.vector)
                sims.append((-round(float(v), 6), s))
        own = [x for x in found if (x.variant, x.query_id) == (r.variant, r.query_id)]
        hits = sorted((-x.similarity, x.start) for x in own if x.kind == "hit")[: r.top_n]
        assert np.allclose(hits, sorted(sims)[: r.top_n], atol=2e-6) if sims else not hits
        assert sum(x.n for x in own if x.kind == "stat") == len(sims)
        assert abs(sum(x.total for x in own if x.kind == "stat") + sum(v for v, _ in sims)) < 1e-4
        if r.gold_start >= 0:
            assert sum(x.n for x in own if x.kind == "before") == sum((v, s) < (-0.1, 30) for v, s in sims)
            there = search.scan(pieces, codes, q[q.gold_start >= 0], len(flat), block=16, metric=metric, only_gold=True, matrix_bytes=matrix_bytes).collect()
            assert [x.start for x in there] == [30] and abs(there[0].similarity + dict((s, v) for v, s in sims)[30]) < 2e-6


def test_tasks_send_their_best_alone(spark):
    """However many blocks a task has, it sends top_n hits a query; ties go to the smaller start."""
    q = pd.DataFrame({"variant": [0], "query_id": [1], "vector": [np.array([1.0, 0.0])], "search_len": [1], "top_n": [3], "gold_start": [-1], "gold_similarity": [np.nan]})
    coded = spark.range(500).selectExpr("id as g", "1 + id % 2 as code")
    codes = stored(spark.createDataFrame([(1, [1.0, 1.0]), (2, [2.0, 2.0])], "code long, vec array<double>"), "codes")
    found = search.scan(search.blocks(coded, 0, 16), codes, q, 500, block=16, stats=False)
    assert found.count() <= 3 * spark.sparkContext.defaultParallelism
    assert [r.start for r in search.ranked(found, 3).orderBy("rank").collect()] == [0, 1, 2]


def test_dense_codes(spark):
    space = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, 2.0]), ("c", [0.5, 0.0]), ("d", None)], "token string, vec array<double>")
    codes, names = search.dense_codes(space)
    by = {r.code: tuple(r.vec) for r in codes.collect()}
    assert sorted(by) == [1, 2] and {r.token: by[r.code] for r in names.collect()} == {"a": (1.0, 2.0), "b": (1.0, 2.0), "c": (0.5, 0.0)}


def test_located(spark):
    """Phrases within a document, across documents and empty ones, of one word, at both ends, and in part only."""
    docs = [(1, "a b c a b d".split()), (2, []), (3, "e f g".split()), (4, ["h"]), (5, "a b d a b c x".split()), (6, None)]
    flat = [w for _, ws in docs for w in ws or []]
    df = spark.createDataFrame(docs, "doc_id long, words array<string>")
    phrases = {0: "a b d".split(), 1: "d e f".split(), 2: "g h a".split(), 3: ["x"], 4: ["a"], 5: "b c x y".split(), 6: "b c x".split(), 7: "f h".split(), 8: [], 9: "b d e f g h a b d".split(), 10: ["zz"], 11: "h h".split()}
    want = {}
    for k, p in phrases.items():
        at = [i for i in range(len(flat) - len(p) + 1) if flat[i : i + len(p)] == p] if p else []
        if at:
            want[k] = at[0]
    queries = spark.createDataFrame(list(phrases.items()), "query_id long, words array<string>")
    for at_once in (3, 2000):
        assert {r.query_id: r.gold_start for r in passages.locate(df, queries, "doc_id", at_once).collect()} == want


def test_search_across_spaces(spark):
    """Query and gold differ in words and length; the set goes through in parts; what has no vector or place is no failure."""
    rng = np.random.default_rng(4)
    vec = {w: rng.normal(size=3) for w in "abcdefg"}  # x and y have none
    docs = [(1, list("abxcdefg")), (2, None), (3, list("gfedcbay")), (4, [])]
    flat = [w for _, ws in docs for w in ws or []]
    queries = [(1, ["A", "C"], list("bxc")), (2, ["E"], list("aa")), (3, ["Q"], list("ab")), (4, [], list("ab")), (5, ["B", "Z"], None), (6, ["G", "F", "E", "D"], list("gfed"))]
    target = spark.createDataFrame(docs, "key long, words array<string>")
    space = spark.createDataFrame([(w, v.tolist()) for w, v in vec.items()], "token string, vec array<double>")
    own = spark.createDataFrame([(w.upper(), (3 * v).tolist()) for w, v in vec.items()], "token string, vec array<double>")
    q = spark.createDataFrame(queries, "query_id long, words array<string>, gold array<string>")
    configs = [SearchConfig(long_adjust=0.0, short_adjust=0.5, top_n=4, method="word"), SearchConfig(long_adjust=0.0, short_adjust=1.0, top_n=2, method="word")]
    for at_once, matrix_bytes in ((2, search.MATRIX_BYTES), (100, 0)):
        for c, s in zip(configs, passages.search_passages(target, space, q, own, configs, at_once=at_once, matrix_bytes=matrix_bytes)):
            hits = {}
            for r in s.hits().collect():
                hits.setdefault(r.query_id, []).append((r["rank"], r.start, r.similarity))
            ranks = {r.query_id: (r.gold_start, r.predicted_rank, r.n_windows) for r in s.predicted_ranks().collect()}
            for k, words, gold in queries:
                known = [vec[w.lower()] for w in words if w.lower() in vec]
                n = c.search_length(len(words))
                sims = []
                for i in range(len(flat) - n + 1) if known else ():
                    window = [vec[w] for w in flat[i : i + n] if w in vec]
                    if window:
                        a, b = np.mean(window, axis=0), np.mean(known, axis=0)
                        sims.append((-round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 6), i))
                assert [x[1] for x in sorted(hits.get(k, []))] == [i for _, i in sorted(sims)[: c.top_n]]
                at = "".join(flat).find("".join(gold)) if gold and words else -1
                if known and at >= 0:
                    assert ranks[k] == (at, [i for _, i in sorted(sims)].index(at), len(sims))
                else:
                    assert k not in ranks
            lines = {r.query_id: r.report for r in s.report().collect()}
            assert set(lines) == {1, 2, 6} | ({5} if 5 in hits else set()) and "Gold is 1.50 times longer" in lines[1] and "***" in lines[1] and "Correct passage unknown" in lines[2]
            assert s.summary().first().total_phrases == 5


@pytest.mark.parametrize("method", ["char", "term"])
def test_other_tokenizers_against_direct_sums(spark, tmp_path, method):
    import hashlib
    import re

    from weftline.plans import passage_search as P

    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(40, 4))
    texts = ["the brother, doubled; there", "x。y the other", "nothing"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "the ther 。xouble")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    cut = (lambda t: list(t)) if method == "char" else (lambda t: re.findall("|".join(sorted(P.TERMS, key=len, reverse=True)) + "|.", t))
    strip = lambda t: t.translate(str.maketrans("", "", "：。，」「；、 ？！『』"))

    def vec(t):
        k = int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 40
        return vecs[k] if k % 10 else None

    parts = []
    for t in cut(strip("the ther 。xouble")):
        v = vec(t)
        if v is None and len(t) > 1:
            own = [x for c in t if (x := vec(c)) is not None]
            v = np.mean(own, axis=0) if own and method == "term" else None
        if v is not None:
            parts.append(v)
    q = np.mean(parts, axis=0)
    flat = [w for t in texts for w in cut(strip(t))]
    config = SearchConfig(long_adjust=0.0, short_adjust=0.3, method=method)
    n = config.search_length(len(cut(strip("the ther 。xouble"))))
    sims = []
    for s in range(len(flat) - n + 1):
        own = [v for w in flat[s : s + n] if (v := vec(w)) is not None]
        if own:
            w = np.mean(own, axis=0)
            sims.append((-round(float(w @ q / np.linalg.norm(w) / np.linalg.norm(q)), 6), s))
    s = P.run(spark, str(tmp_path), config)
    got = [(-r.similarity, r.start) for r in search.ranked(s.found, 10).orderBy("rank").collect()]
    assert np.allclose(got, sorted(sims)[:10], atol=2e-6)


def every_alignment(n, m):
    """All ways through n and m items, as index pairs."""
    if not n and not m:
        return [[]]
    out = []
    if n and m:
        out += [[*x, (n - 1, m - 1)] for x in every_alignment(n - 1, m - 1)]
    if m:
        out += [[*x, (-1, m - 1)] for x in every_alignment(n, m - 1)]
    if n:
        out += [[*x, (n - 1, -1)] for x in every_alignment(n - 1, m)]
    return out


@pytest.mark.parametrize("n,m", [(1, 1), (1, 3), (3, 2), (4, 4)])
def test_alignment_is_the_best_of_all(n, m):
    gain = lambda way, s, gap: sum(s[i, j] if i >= 0 and j >= 0 else -gap for i, j in way)
    rng = np.random.default_rng(10 * n + m)
    for gap in (0.1, 0.7):
        a, b = rng.normal(size=(n, 3)), rng.normal(size=(m, 3))
        s = a @ b.T / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(b, axis=1)
        best = max(gain(w, s, gap) for w in every_alignment(n, m))
        for way in (reuse.align(s, gap), reuse.align_long(a, b, gap, rows=2)):
            assert way in every_alignment(n, m) and abs(gain(way, s, gap) - best) < 1e-8


@pytest.mark.parametrize("n,m,rows", [(40, 60, 7), (60, 40, 60), (64, 64, 1), (1, 50, 5), (50, 1, 5), (300, 200, 128)])
def test_long_alignment_is_that_of_the_whole_table(n, m, rows):
    """With repeated vectors, so that there are ties."""
    rng = np.random.default_rng(n)
    kinds = rng.normal(size=(5, 4))
    a, b = kinds[rng.integers(0, 5, n)], kinds[rng.integers(0, 5, m)]
    a[n // 2] = 0
    whole = reuse._unit_rows(a) @ reuse._unit_rows(b).T
    for gap in (0.2, 0.7):
        assert reuse.align_long(a, b, gap, rows) == reuse.align(np.rint(whole * reuse.UNIT) / reuse.UNIT, round(gap * reuse.UNIT) / reuse.UNIT)


def test_long_texts_align_in_little_memory():
    """What a table of all cells would need several hundred times over."""
    import tracemalloc

    rng = np.random.default_rng(1)
    a = rng.normal(size=(6000, 8))
    b = np.delete(a, np.arange(100, 6000, 50), axis=0)
    tracemalloc.start()
    way = reuse.align_vectors(a, b, 0.2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60e6 and len(a) * len(b) * 8 > 250e6
    assert sum(i >= 0 and j >= 0 and np.array_equal(a[i], b[j]) for i, j in way) > 0.95 * len(b)


def test_texts_by_levels(spark):
    tokens = spark.createDataFrame([(k, s, p, w) for k, t in ((1, "a b\nc a"), (2, "c a\nb"), (3, "")) for s, line in enumerate(t.split("\n")) for p, w in enumerate(line.split())], "id long, sent int, pos int, token string")
    space = spark.createDataFrame([("a", [1.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0]), ("c", [0.0, 0.0, 1.0])], "token string, vec array<double>")
    pairs = spark.createDataFrame([(9, 1, 2), (8, 1, 3)], "key long, a long, b long")
    for level, want in (("words", [(0, -1), (1, -1), (2, 0), (3, 1), (-1, 2)]), ("sentences", [(0, -1), (1, 0), (-1, 1)])):
        s = reuse.sequences(tokens, space, "id", level, 3)
        got = reuse.align_texts(s.withColumnRenamed("id", "a"), s.withColumnRenamed("id", "b"), pairs).orderBy("step").collect()
        assert [(r.i, r.j) for r in got] == want and {r.key for r in got} == {9}


def test_alignment_modes():
    s = np.eye(3)
    assert reuse.align(s) == [(0, 0), (1, 1), (2, 2)]
    assert reuse.align(np.ones((1, 3)), 0.1) == [(-1, 0), (-1, 1), (0, 2)]
    assert reuse.align(s, 0.7, "reference")[-1][0] in (-1, 2)
    with pytest.raises(ValueError):
        reuse.align(s, mode="x")


def test_extend_ends_with_the_text():
    v = np.tile([1.0, 0.5], (15, 1))
    assert reuse.compare_chunks(v, v, 2, 2)[:2] == (0, 0)
    assert reuse.compare_chunks(v, -v, 2, 2) is None


def test_seeds(spark):
    df = spark.createDataFrame([(1, "一二天天天"), (2, "x"), (3, None)], "id int, t string")
    got = reuse.seed_index(reuse.seeds(df, "id", "t")).collect()
    assert {r.seed: r.positions for r in got} == {"二天": [1], "天天": [2, 3]}


def test_a_copy_has_no_distance_far_from_the_beginning():
    """Sums over a whole block are large, and a copy's distance is the root of their difference."""
    r = np.random.default_rng(5)
    flat = r.normal(size=(6000, 8)) + 3
    q = pd.DataFrame([(0, 1, flat[5900:5912].mean(axis=0), 12, 3, -1, np.nan)], columns=["variant", "query_id", "vector", "search_len", "top_n", "gold_start", "gold_similarity"])
    finder = search.Finder(q, len(flat), 8192, "euclidean", False, False)
    finder.add(0, 0, flat, np.ones(len(flat), bool))
    means = np.stack([flat[i : i + 12].mean(axis=0) for i in range(len(flat) - 11)])
    want = np.round(1 - np.linalg.norm(means - q["vector"][0], axis=1), 6)
    assert [x[4] for x in finder.found()] == sorted(want, reverse=True)[:3]
    assert finder.found()[0][3:5] == (5900, 1.0)


def test_lagged_products():
    rows = np.random.default_rng(6).normal(size=(4500, 5))
    for k, got in search._lagged(rows, [1, 63, 64, 200, 513, 5000]).items():
        want = np.einsum("ij,ij->i", rows[k:], rows[: max(len(rows) - k, 0)])
        assert np.allclose(got, want)


def test_packed_deals_as_blocks(spark):
    words = [["a", "b", "x"], [], ["a"] * 40, ["b", "c"]]
    placed = search.global_offsets(spark.createDataFrame([(i, w, len(w)) for i, w in enumerate(words)], "key long, words array<string>, size int"), "key", "size")
    names = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "token string, code long")
    runs = search.packed(placed, search.hashed_names(names), 6, 16)
    got = sorted((r.block, r.g + i, c) for r in runs.collect() for i, c in enumerate(r.codes))
    want = search.blocks(search.tokens_of(placed).join(names, "token", "left"), 6, 16)
    assert got == sorted(tuple(r) for r in want.collect())
    assert search.hashed_names(names, 12) is None


def _walked(rng, n, dims):
    """Tokens whose mean drifts, a stretch without vectors and a planted copy."""
    vectors = rng.normal(size=(n, dims)) + 2 * np.sin(np.arange(n)[:, None] / 700 + np.arange(dims))
    vectors[900:1100] = 0
    vectors[3000:3090] = vectors[200:290]
    return vectors, vectors.any(axis=1)


def test_windows_judged_by_groups():
    """Queries with a floor find what sums of every window give, also at both ends and near windows without vectors, and few
    windows are looked at."""
    rng = np.random.default_rng(8)
    vectors, known = _walked(rng, 6000, 6)
    sizes = [64, 65, 66, 67, 90, 150]
    own = [vectors[200 : 200 + s].mean(axis=0) for s in sizes[:-1]] + [vectors[5850:].mean(axis=0)]
    prefix = np.concatenate([np.zeros((1, 6)), np.cumsum(vectors, axis=0)])
    want = {}
    for i, (s, v) in enumerate(zip(sizes, own)):
        sums, many = prefix[s:] - prefix[:-s], np.convolve(known, np.ones(s), "valid")
        at = np.flatnonzero(many > 0.5)
        x = np.round(sums[at] @ v / np.linalg.norm(v) / np.linalg.norm(sums[at], axis=1), 6)
        want[i] = sorted(zip((-x).tolist(), at.tolist()))[:5]
    q = pd.DataFrame({"variant": 0, "query_id": range(6), "vector": own, "search_len": sizes, "top_n": 5, "gold_start": -1, "gold_similarity": np.nan, "floor": [-want[i][4][0] for i in range(6)]})
    finder = search.Finder(q, len(vectors), 2048, "cosine", False, False)
    looked, row = [], finder._row
    finder._row = lambda i, s, begin, at: (looked.append(len(s)), row(i, s, begin, at))
    for block in range(3):
        piece = slice(block * 2048, block * 2048 + 2048 + 149)
        finder.add(block, block * 2048, vectors[piece], known[piece])
    for i in range(6):
        got = sorted((-r[4], r[3]) for r in finder.found() if r[1] == i and r[2] == "hit")
        assert [g for _, g in got] == [g for _, g in want[i]] and np.allclose([x for x, _ in got], [x for x, _ in want[i]], atol=2e-6)
    assert sum(looked) < 6 * 6000 / 4


def test_a_part_is_searched_first(spark, monkeypatch):
    """What a part has gives a floor to all; the best of the whole stay the same, ties too."""
    monkeypatch.setattr(search, "FIRST_FROM", 8)
    monkeypatch.setattr(search, "FIRST", 4)
    q = pd.DataFrame({"variant": [0, 1], "query_id": [1, 1], "vector": [np.array([1.0, 0.0])] * 2, "search_len": [1, 2], "top_n": [3, 40], "gold_start": [-1, -1], "gold_similarity": [np.nan, np.nan]})
    coded = spark.range(500).selectExpr("id as g", "1 + id % 7 as code")
    codes = stored(spark.createDataFrame([(k, [float(k), 7.0 - k]) for k in range(1, 8)], "code long, vec array<double>"), "codes")
    pieces = search.blocks(coded, 1, 16)
    found = search.scan(pieces, codes, q, 500, block=16, stats=False)
    assert [r.start for r in search.ranked(found.where("variant = 0"), 3).orderBy("rank").collect()] == [6, 13, 20]
    assert [r.start for r in search.ranked(found.where("variant = 1"), 40).orderBy("rank").collect()] == [5 + 7 * k for k in range(40)]
    assert search.floors(found, q) == [1.0, found.where("variant = 1").selectExpr("max(similarity)").first()[0]]
    assert search.floors(found, q.assign(top_n=10_000)) == [-np.inf, -np.inf]


def test_keyed_space_repeats_no_vector(spark):
    names = spark.createDataFrame([("a", 7), ("b", 7), ("c", 3), ("d", 9), ("e", None), ("f", 4)], "token string, key long")
    rows = spark.createDataFrame([(7, [1.0, 2.0]), (3, [0.5, 0.0]), (5, [9.0, 9.0]), (4, None)], "key long, vec array<float>")
    codes, named = search.dense_codes(search.KeyedSpace(names, rows))
    by = {r.code: tuple(r.vec) for r in codes.collect()}
    assert sorted(by) == [1, 2] and {r.token: by[r.code] for r in named.collect()} == {"a": (1.0, 2.0), "b": (1.0, 2.0), "c": (0.5, 0.0)}


@pytest.mark.parametrize("value,dtype", [(0.25, np.float32), (0.1, np.float64)])
def test_matrix_takes_no_more_than_its_numbers_need(spark, value, dtype):
    made = stored(spark.createDataFrame([(1, [1.0, 2.0]), (2, [value, 3.0])], "code long, vec array<double>"), "codes")
    small = search._matrix(made.stored_at, 2, 2, small=True)
    assert small.dtype == dtype and small.tolist() == [[0.0, 0.0], [1.0, 2.0], [value, 3.0]]
    assert search._matrix(made.stored_at, 2, 2).dtype == np.float64


def test_names_are_read_in_order_of_their_hashes(spark):
    names = spark.createDataFrame([(f"w{k}", k + 1) for k in range(500)], "token string, code long")
    made = search.hashed_names(names)
    hashes = spark.createDataFrame([(f"w{k}",) for k in range(501)], "token string").select(F.xxhash64("token").alias("h")).toPandas()["h"].to_numpy()
    assert search.codes_of(hashes, made.stored_at).tolist() == [*range(1, 501), 0]
    assert [r.hash for r in spark.read.parquet(made.stored_at).selectExpr("hash", "input_file_name() as f").orderBy("f").collect()] == sorted(hashes[:-1].tolist())


@pytest.mark.parametrize("scale", [1.0, 1e-3, 1e20])
def test_single_precision_leaves_out_no_window(scale):
    """Counts, ranks and hits with "count" are those of direct sums, also where windows have no direction, and few are looked at;
    variants that differ in top_n are looked at once."""
    rng = np.random.default_rng(9)
    vectors, known = rng.normal(size=(3000, 16)) * scale, rng.random(3000) > 0.1
    known[700:760] = False
    vectors[~known] = 0
    vectors[1500:1520:2] = [1.0] + [0.0] * 15
    vectors[1501:1520:2] = [-1.0] + [0.0] * 15  # these cancel
    known[1500:1520] = True
    sizes, gold = [6, 20, 33], [1234, 40, 2047]
    prefix = np.concatenate([np.zeros((1, 16)), np.cumsum(vectors, axis=0)])
    rows, want = [], {}
    for i, (s, g) in enumerate(zip(sizes, gold)):
        v = vectors[g : g + s].mean(axis=0) + scale * rng.normal(size=16) * 0.02
        sums = np.array([vectors[k : k + s].sum(axis=0) for k in range(3000 - s + 1)])
        norm, many = np.linalg.norm(sums, axis=1), np.convolve(known, np.ones(s), "valid")
        at = np.flatnonzero((many > 0.5) & (norm > 1e-9 * np.linalg.norm(prefix[s:], axis=1)))
        x = np.round(sums[at] @ v / np.linalg.norm(v) / norm[at], 6)
        order = np.lexsort((at, -x))
        want[i] = len(at), int(np.flatnonzero(at[order] == g)[0]), at[order][:5].tolist()
        rows += [(variant, i, v, s, top, g, float(x[at == g][0]), float(x[order[4]])) for variant, top in ((0, 3), (1, 5))]
    q = pd.DataFrame(rows, columns=["variant", "query_id", "vector", "search_len", "top_n", "gold_start", "gold_similarity", "floor"])
    finder = search.Finder(q, 3000, 1024, "cosine", False, "count")
    looked, row = [], finder._row
    finder._row = lambda i, s, begin, at: (looked.append(len(s)), row(i, s, begin, at))
    for block in range(3):
        piece = slice(block * 1024, block * 1024 + 1024 + 32)
        finder.add(block, block * 1024, vectors[piece], known[piece])
    assert sum(looked) < 300 or scale > 1e15  # beyond what single precision holds every window is looked at
    for variant, top in ((0, 3), (1, 5)):
        for i, (n, before, starts) in want.items():
            own = [r for r in finder.found() if r[:2] == (variant, i)]
            assert [r[5:] for r in own if r[2] == "stat"] == [(n, None, None)]
            assert [r[5] for r in own if r[2] == "before"] == [before]
            assert [r[3] for r in sorted(own, key=lambda r: (-(r[4] or 0), r[3])) if r[2] == "hit"] == starts[:top]


def test_place_cuts_after_dealing_and_marks_new_tokens(spark):
    """Words are cut from the dealt text; head, tail and fresh are theirs, and a place made of them finds phrases across documents."""
    from weftline.functions.tokenize import latin_words
    from weftline.operators import passages

    rows = spark.createDataFrame([(3, "d e"), (1, "a b a"), (2, None), (4, ""), (5, "b c d")], "id long, text string").repartition(3)
    placed = passages.place(rows, "id", latin_words(F.col("text")))
    got = {r.key: (r.offset, r.size, r.head, r.tail) for r in placed.collect()}
    assert got == {1: (0, 3, "a", "a"), 2: (3, 0, None, None), 3: (3, 2, "d", "e"), 4: (5, 0, None, None), 5: (5, 3, "b", "d")}
    assert {r.t for r in placed.select(F.explode("fresh").alias("t")).collect()} == {"a", "b", "c", "d", "e"}
    found = search.located(placed, {1: ["a", "d", "e", "b"], 2: ["c", "d"], 3: ["e"], 4: ["d", "a"], 5: ["b", "c", "d", "e"]})
    assert {r.query_id: r.gold_start for r in found.collect()} == {1: 2, 2: 6, 3: 4}


@pytest.mark.parametrize("gold", [False, True])
def test_words_go_before_the_scan(spark, gold):
    """Where no passages are asked for, stored words and the shuffles that dealt them don't outlast the last scan."""
    texts = spark.createDataFrame([(k, [w for w in "abcde" * (k + 2)]) for k in range(6)], "doc long, words array<string>")
    space = spark.createDataFrame([(w, [float(k), 1.0]) for k, w in enumerate("abcd")], "token string, vec array<double>")
    queries = spark.createDataFrame([(1, list("bcd")), (2, list("eab"))], "query_id long, words array<string>")
    found = []
    for kept in (True, False):
        placed = passages.place(texts, "doc")
        s, = passages.search_passages(placed, space, queries, space, [SearchConfig(top_n=5)], gold=gold, texts=kept)
        assert os.path.isdir(placed.stored_at.removeprefix("file://")) == kept
        found.append(sorted(map(repr, (s.flags() if gold else s.clusters()).collect())))
    assert found[0] == found[1] and found[0]
