import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import vector as V
from weftline.operators import embedding, search, vectors
from weftline.sources import readers, writers


def space(spark, d):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in d.items()], "token string, vec array<double>")


def test_expressions(spark):
    a, b = np.array([1.0, 2, 3]), np.array([0.5, -1, 2])
    row = spark.createDataFrame([(a.tolist(), b.tolist(), [0.0] * 3)], "a array<double>, b array<double>, z array<double>")
    got = row.select(V.dot(F.col("a"), F.col("b")), V.cosine(F.col("a"), F.col("b")), V.euclidean(F.col("a"), F.col("b")), V.cosine(F.col("a"), F.col("z")), V.cosine(F.col("a"), F.col("z"), None)).first()
    assert np.allclose(got[:4], [a @ b, a @ b / np.linalg.norm(a) / np.linalg.norm(b), np.linalg.norm(a - b), 0])
    assert got[4] is None
    with pytest.raises(ValueError):
        V.compare(F.col("a"), F.col("b"), "manhattan")


def test_phrases_fall_back_to_characters(spark):
    s = space(spark, {"ab": [1, 0], "c": [0, 1], "d": [0, 3]})
    p = spark.createDataFrame([(1, 0, "ab"), (1, 1, "cd"), (1, 2, "x"), (2, 0, "xy")], "id long, pos int, token string")
    got = {r.id: r.vec for r in vectors.phrase_vectors(p, s, ["id"]).collect()}
    assert got == {1: [0.5, 1.0]}


def test_windows_count_unknown_words(spark):
    s = space(spark, {"a": [1], "b": [3]})
    t = spark.createDataFrame([(1, i, w) for i, w in enumerate("axbxx")], "doc_id long, pos int, token string")
    got = {r.start: (r.n_known, r.vec) for r in vectors.window_means(t, s, 2).collect()}
    assert got == {0: (1, [1.0]), 1: (1, [3.0]), 2: (1, [3.0]), 3: (0, None)}


def test_documents(spark):
    s = space(spark, {"a": [1], "b": [3], "c": [5]})
    d = spark.createDataFrame([(1, "a b\nc"), (2, ""), (3, None)], "id long, t string")
    t = vectors.document_tokens(d, "id", "t")
    assert vectors.document_vectors(t, s, "id").collect()[0].vec == [3.5]
    assert vectors.document_vectors(t, s, "id", "words").collect()[0].vec == [3.0]


def test_merge_second_wins(spark):
    got = {r.token: r.vec for r in embedding.merge(space(spark, {"a": [1], "b": [2]}), space(spark, {"b": [3]})).collect()}
    assert got == {"a": [1.0], "b": [3.0]}


def test_projection_recovers_a_linear_map(spark):
    rng = np.random.default_rng(1)
    x, w = rng.normal(size=(30, 4)), rng.normal(size=(4, 3))
    a, b = space(spark, {str(i): v for i, v in enumerate(x)}), space(spark, {str(i): v for i, v in enumerate(x @ w)})
    pairs = a.select(F.col("token").alias("first"), F.col("token").alias("second"))
    got = embedding.translation_matrix(pairs, a, b)
    assert np.allclose(got, w)
    row = embedding.project(a, got).where("token = '3'").first()
    assert np.allclose(row.vec, x[3] @ w)


def test_pairs(spark):
    s = space(spark, {"a": [1], "b": [0]})
    p = spark.createDataFrame([(0, "a", "b"), (1, "a", "a"), (2, "a", "zz"), (3, "ab", "a")], "ord long, src string, tgt string")
    kept = embedding.pairs_in(p, s, s)
    assert sorted((r.first, r.second) for r in kept.collect()) == [("a", "a"), ("a", "b")]
    assert sorted((r.first, r.second) for r in embedding.pairs_in(p, s, s, flip=True).collect()) == [("a", "a"), ("b", "a")]
    sims = embedding.pair_similarity(embedding.last_per_key(kept), s, s).collect()
    assert [(r.first, r.second, r.similarity) for r in sims] == [("a", "a", 1.0)]


def test_files(spark, tmp_path):
    s = space(spark, {"a": [1, 2], "b": [3, 4.5]})
    writers.write_vec(s, str(tmp_path / "x.vec"))
    assert sorted((r.token, r.vec) for r in readers.read_vec(spark, str(tmp_path / "x.vec")).collect()) == [("a", [1.0, 2.0]), ("b", [3.0, 4.5])]
    (tmp_path / "u.txt").write_text("a b<utt>\nc", encoding="utf8")
    assert [r.text for r in readers.read_utterances(spark, str(tmp_path / "u.txt")).collect()] == ["a b", "c"]
    (tmp_path / "al.csv").write_text('t,q,score\n"x\ny",佛,5\n,,4\n\nz,言,5\n', encoding="utf8")
    al = readers.read_alignment(spark, str(tmp_path / "al.csv"))
    assert [(r.query_id, r.target, r.query) for r in readers.searched_phrases(al).collect()] == [(0, "x\ny", "佛"), (1, "z", "言")]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "b.txt").write_text("佛 1", encoding="utf8")
    (tmp_path / "d" / "a.txt").write_text("言", encoding="utf8")
    assert [(r.label, r.text) for r in readers.read_dir(spark, str(tmp_path / "d"), {"言": "讠"}, cleaned=True).collect()] == [("a.txt", "讠"), ("b.txt", "佛")]
    (tmp_path / "p.txt").write_text("a,b\n\nc,d\n", encoding="utf8")
    assert [(r.src, r.tgt) for r in readers.read_pairs(spark, str(tmp_path / "p.txt")).collect()] == [("a", "b"), ("c", "d")]


def test_stream(spark, tmp_path):
    from weftline.streaming.seeds import shared_with

    known = spark.createDataFrame([("ab", 3)], "seed string, pos int")
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1, "xab"), (2, "q")], "id long, t string").write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, t string").json(str(tmp_path / "in"))
    q = shared_with(stream, known, "id", "t").writeStream.format("memory").queryName("seeds_out").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.id, r.pos, r.known_pos) for r in spark.table("seeds_out").collect()] == [(1, 1, 3)]


def test_recipe(spark, tmp_path):
    from weftline.plans import recipes

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("ab c\nab d\n\nc d", encoding="utf8")
    (tmp_path / "in" / "b.txt").write_text("d c", encoding="utf8")
    out = str(tmp_path / "out")
    extra = spark.createDataFrame([("cd",), ("zz",)], "token string")
    made = {r.token: r.vec for r in recipes.create_space(spark, str(tmp_path / "in"), out, size=4, extra=extra).collect()}
    assert set(made) == {"ab", "c", "d", "cd", "zz"}
    assert {r.token for r in readers.read_vec(spark, f"{out}/vec").collect()} == set(made)
    again = embedding.load_words(spark, f"{out}/model").vectors(spark.createDataFrame([(k,) for k in made], "token string"))
    assert {r.token: r.vec for r in again.collect()} == made
    cut = recipes.corpus_words(spark, str(tmp_path / "in"), "term", ["bc"])
    assert sorted(r.words for r in cut.where("label = 'a.txt'").collect()) == [[], ["a", "b", "d"], ["a", "bc"], ["c", "d"]]
    s = space(spark, {"a": [1, 0], "b": [0, 1]})
    t = space(spark, {"x": [0, 2], "y": [2, 0]})
    glossary = spark.createDataFrame([(0, "x", "a"), (1, "y", "b"), (2, "y", "gone")], "ord long, src string, tgt string")
    got = recipes.map_spaces(t, s, glossary, str(tmp_path / "map"))
    assert got["n"] == 2 and np.isclose(got["mean"], 1)


def test_blocked_comparison(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(30)] + [(30, [0.0] * 3), (31, None)]
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    monkeypatch.setattr(vectors, "QUERY_BYTES", 3 * 8 * 2)  # several passes
    q = df.where("id % 6 = 0 and id < 30")
    for method, f in (("cosine similarity", lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b) if b.any() else 0.0), ("euclidean distance", lambda a, b: np.linalg.norm(a - b))):
        got = {(r.a, r.b): r.value for r in vectors.compare_all(q, df, "id", method).collect()}
        assert len(got) == 5 * 31
        assert all(np.isclose(v, f(np.array(rows[a][1]), np.array(rows[b][1]))) for (a, b), v in got.items())
    monkeypatch.setattr(vectors, "PASSES", 1)
    with pytest.raises(ValueError):
        vectors.compare_all(q, df, "id")
    assert vectors.compare_all(q.where("id < 0"), df, "id").count() == 0


def test_plane_against_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 3)) * [5, 2, 0.1]
    got = embedding.plane(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")).orderBy("id").collect()
    _, _, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs([r.plane for r in got]), np.abs(x @ v[:2].T), atol=1e-6)


def test_token_means_shuffle_no_vectors(spark):
    t = spark.createDataFrame([(k, s, w) for k in range(40) for s in range(3) for w in "aab" + "cxd"[s] * (k % 3)], "id long, sent int, token string")
    t = t.unionByName(spark.createDataFrame([(None, 0, "a"), (None, 0, None), (7, 9, "x")], t.schema))
    space = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [4.0, 0.5]), ("c", [1.0, 2.0]), ("d", [-3.0, 0.0])], "token string, vec array<double>")
    rows = vectors.sentence_vectors(t, space, "id", 2)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    exact = lambda df: {(r.id, r.sent): (r.n, [round(x, 12) for x in r.vec]) for r in df.collect()}
    assert exact(rows) == exact(vectors.token_means(t, space, ["id", "sent"], 2, limit=0))
    assert exact(rows)[None, 0] == (1, [1.0, 2.0]) and (7, 9) not in exact(rows)


def test_distinct_tokens(spark, monkeypatch):
    rows = spark.createDataFrame([(["a", "b", None, "a"],), (None,), ([],), (["b", "c"],)], "words array<string>")
    assert sorted(r.token for r in vectors.distinct_tokens(rows, "words").collect()) == ["a", "b", "c"]


def test_text_means_shuffle_no_words(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PART_WORDS", 3)
    texts = spark.createDataFrame([(1, list("aab")), (2, []), (3, None), (4, ["x"]), (None, ["a", None]), (5, list("c" * 9 + "d")), (1, ["c", "x"])], "id long, words array<string>")
    keyed = search.KeyedSpace(spark.createDataFrame([("a", 1), ("b", 2), ("c", 1), ("d", 3)], "token string, key long"), spark.createDataFrame([(1, [1.0, 2.0]), (2, [4.0, 0.5]), (3, [-3.0, 0.0])], "key long, vec array<double>"))
    rows = vectors.text_means(texts, keyed, "id", dims=2)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan and plan.count("Exchange hashpartitioning") == 1
    exact = lambda df: {r.id: (r.n, [round(x, 12) for x in r.vec]) for r in df.collect()}
    assert exact(rows) == {1: (4, [1.75, 1.625]), None: (1, [1.0, 2.0]), 5: (10, [0.6, 1.8])}
    assert exact(vectors.text_means(texts, keyed, "id", dims=2, limit=0)) == exact(rows)
    assert exact(vectors.token_means(texts.select("id", F.explode("words").alias("token")), keyed, ["id"], 2)) == exact(rows)
