"""Extension by rounds against the growth of whole texts."""

import random

import numpy as np
import pytest

from weftline.operators import extension, reuse


def plain(places, texts, vec):
    """Places in order, those that an earlier match covers on its diagonal left out."""
    out = []
    for a, b in sorted({(a, b) for a, _, b, _ in places}):
        spans = []
        for i, j in sorted({(i, j) for x, i, y, j in places if (x, y) == (a, b)}):
            if any(d == i - j and lo <= i < hi for d, lo, hi in spans):
                continue
            one, two = (np.array([vec.get(w, np.zeros(3)) for w in texts[k]]) for k in (a, b))
            if got := reuse.compare_chunks(one, two, i, j):
                out.append((a, b, i, j, *got[:4], round(got[4], 9)))
                spans.append((got[0] - got[1], got[0], got[0] + got[2]))
    return sorted(out)


@pytest.mark.parametrize("block,first", [(4, 3), (64, 64)])
def test_rounds_are_whole_growth(spark, monkeypatch, block, first):
    """Blocks and rounds shorter than matches; matches up to the texts' ends, none, one inside another, unknown words."""
    monkeypatch.setattr(extension, "BLOCK", block)
    monkeypatch.setattr(extension, "FIRST", first)
    monkeypatch.setattr(extension, "MOST", 2 * first)
    r = random.Random(block)
    rng = np.random.default_rng(1)
    vec = {f"w{k}": rng.normal(size=3) for k in range(30)}
    word = lambda: f"w{r.randrange(33)}"
    base = [word() for _ in range(150)]
    noisy = [w if r.random() < 0.9 else word() for w in base]
    texts = {1: base, 2: [word() for _ in range(40)] + noisy + [word() for _ in range(30)], 3: noisy[50:] + noisy[:50], 4: base[:11]}
    places = [(1, i, 2, i + 40) for i in range(0, 140, 9)] + [(1, 60, 3, 10), (1, 20, 3, 120), (4, 0, 1, 0), (4, 1, 2, 41), (1, 5, 2, 90)]
    frame = spark.createDataFrame([(k, p, w) for k, t in texts.items() for p, w in enumerate(t)], "id long, pos int, token string").repartition(3)
    space = spark.createDataFrame([(w, v.tolist()) for w, v in vec.items()], "token string, vec array<double>")
    blocks = extension.text_blocks(frame, space, "id", 3)
    assert blocks.where(f"size(vecs) > {block}").isEmpty()
    got = extension.extend_places(spark.createDataFrame(places, "key_a long, i int, key_b long, j int"), blocks, blocks).collect()
    want = plain(places, texts, vec)
    assert sorted((r.key_a, r.key_b, r.i, r.j, r.start_a, r.start_b, r.length_a, r.length_b, round(r.similarity, 9)) for r in got) == want
    assert len(want) > 3 and max(w[6] for w in want) > 40


def test_no_places(spark):
    blocks = extension.text_blocks(spark.createDataFrame([(1, 0, "a")], "id long, pos int, token string"), spark.createDataFrame([("a", [1.0])], "token string, vec array<double>"), "id", 1)
    assert extension.extend_places(spark.createDataFrame([], "key_a long, i int, key_b long, j int"), blocks, blocks).count() == 0


def test_blocks_hold_codes(spark):
    """With the vectors read by workers and with vectors in the blocks the matches are the same; the former have no vectors."""
    r = np.random.default_rng(8)
    space = spark.createDataFrame([(f"t{i}", r.normal(size=4).tolist()) for i in range(50)], "token string, vec array<double>")
    shared = [f"t{i}" for i in r.integers(0, 55, 90)]
    texts = {1: [f"t{i}" for i in r.integers(0, 55, 30)] + shared, 2: shared + [f"t{i}" for i in r.integers(0, 55, 100)]}
    tokens = spark.createDataFrame([(k, p, w) for k, v in texts.items() for p, w in enumerate(v)], "id long, pos int, token string")
    places = spark.createDataFrame([(1, 35, 2, 5), (1, 60, 2, 30)], "key_a long, i int, key_b long, j int")
    coded, plain = extension.text_blocks(tokens, space, "id", 4), extension.text_blocks(tokens, space, "id", 4, limit=0)
    assert dict(coded.dtypes)["vecs"] == "array<int>" and plain.book is None
    exact = lambda b, c: sorted(tuple(round(x, 9) for x in r) for r in extension.extend_places(places, b, c).collect())
    assert exact(coded, coded) == exact(plain, plain) == exact(coded, plain)
    assert exact(coded, coded)


def test_seeds_of_arrays(spark):
    """Seeds come from each row's own words, without sorts or windows, and meet few seeds where they are read."""
    texts = [(1, "a b c d e f"), (2, "b c d e f g"), (2, "x y z"), (3, None), (4, "a b"), (5, "c d e"), (5, "f a b c d")]
    df = spark.createDataFrame(texts, "id long, text string").selectExpr("id", "split(text, ' ') as words")
    got = sorted(tuple(r) for r in reuse.text_seeds(df, "id", "words", 3).collect())
    want = sorted((k, " ".join(t.split()[i : i + 3]), i) for k, t in texts if t for i in range(len(t.split()) - 2))
    assert got == want  # rows 2 and 5 stay apart
    one, two = (reuse.text_seeds(df.where(x), "id", "words", 3) for x in ("id <= 1", "id > 1"))
    shared = {s for k, s, _ in want if k == 1} & {s for k, s, _ in want if k > 1}
    for few in (reuse.FEW, 0):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(reuse, "FEW", few)
            rows = reuse.shared_seeds(one, two)
            assert sorted(r[0] for r in rows.collect()) == sorted(shared)
            places = reuse.locations(one.withColumnRenamed("pos", "i"), two.withColumnRenamed("id", "other").withColumnRenamed("pos", "j"))
            assert sorted((r["id"], r["seed"], r["i"], r["other"], r["j"]) for r in places.collect()) == sorted((a, s, i, b, j) for a, s, i in want if a == 1 for b, t, j in want if b > 1 and s == t)


def test_shared_seeds_neither_sort_nor_shuffle_words(spark):
    from weftline.plans import queries

    plan = queries.shared_seeds(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan and "LeftSemi" in plan and "strategy=broadcast" in plan


def test_gated_without_vectors(spark, monkeypatch):
    """Places at texts' beginnings and ends, with unknown words: as by joined windows; what is shuffled holds no vector."""
    from weftline.operators import reuse

    monkeypatch.setattr(reuse, "PLACES_AT_ONCE", 3)
    rng = np.random.default_rng(5)
    space = spark.createDataFrame([(w, rng.normal(size=4).tolist()) for w in "abcde"], "token string, vec array<double>")
    shared = [str(x) for x in rng.choice(list("abcdex"), 14)]
    texts = {k: [*(str(x) for x in rng.choice(list("abcdexy"), n)), *shared, *(str(x) for x in rng.choice(list("abxy"), m))] for k, (n, m) in enumerate([(0, 0), (3, 9), (20, 1), (9, 30)])} | {8: ["x"] * 15, 9: list("abc")}
    frame = spark.createDataFrame(list(texts.items()), "id long, words array<string>").coalesce(2)
    one, two = frame.withColumnRenamed("id", "a"), frame.withColumnRenamed("id", "b")
    rows = [(x, i, y, j) for x in texts for y in texts for i in range(len(texts[x])) for j in range(len(texts[y])) if texts[x][i : i + 3] == texts[y][j : j + 3]]
    places = spark.createDataFrame(rows, "a long, i int, b long, j int")
    got, book = reuse.gated(places, one, two, "a", "b", space, 0.7)
    assert book and "array<double>" not in got._jdf.queryExecution().optimizedPlan().toString()
    exact = lambda df: sorted((r.a, r.i, r.b, r.j, r.similarity, r.start_a, r.start_b, r.best) for r in df.collect())
    want = exact(reuse.gated(places, one, two, "a", "b", space, 0.7, limit=0)[0])
    assert len(want) > 50 and exact(got) == want


def test_word_blocks_are_text_blocks(spark):
    texts = {1: list("ab" * 70), 2: list("c" * 64), 3: [], 4: ["x"], None: list("ba")}
    frame = spark.createDataFrame(list(texts.items()), "id long, words array<string>").coalesce(1)
    space = spark.createDataFrame([("a", [1.0]), ("b", [2.0]), ("c", [1.0])], "token string, vec array<double>")
    tokens = frame.selectExpr("id", "posexplode(words) as (pos, token)")
    one = extension.text_blocks(tokens, space, "id", 1)
    two = extension.word_blocks(frame, space, "id", 1, one.book)
    read = lambda b: sorted(map(repr, b.collect()))
    assert read(one) == read(two) and len(read(two)) == 6


def test_matches_that_end_keep_no_sums():
    ended, going = {"grows": False, "sum_a": np.ones(2), "sum_b": np.ones(2)}, {"grows": True, "sum_a": np.ones(2), "sum_b": np.ones(2)}
    frame = extension._frame([ended, going])
    assert frame["sum_a"][0] is None and frame["sum_b"][0] is None and frame["sum_a"][1] is not None
