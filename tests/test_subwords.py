"""Training of subword vectors."""

import random

import numpy as np

from weftline.operators import embedding, subwords

STEMS = {"sun": ["sunny", "sunlit", "sunrise", "sunset"], "sea": ["seaside", "seashore", "seabed", "seaward"]}


def sentences(n, seed=1):
    r = random.Random(seed)
    return [[r.choice(STEMS[stem]) for _ in range(8)] for stem in (r.choice(list(STEMS)) for _ in range(n))]


def frame(spark, rows, parts):
    return spark.createDataFrame([(s,) for s in rows] + [(None,), ([],), ([None, ""],)], "words array<string>").repartition(parts)


def test_bag():
    whole = subwords.bag("ab", (1, 0), 1000)
    assert len(whole) == 1 and set(whole) < set(subwords.bag("ab", (2, 3), 1 << 30)) | set(whole)
    assert len(subwords.bag("ab", (2, 3), 1 << 30)) == 6  # <a ab b> <ab ab> <ab>


def test_gradients():
    """Against finite differences, with a bucket that a word has twice and one that two words share."""
    rng = np.random.default_rng(0)
    inner, outer = rng.normal(size=(6, 4)), rng.normal(size=(5, 4))
    flat, starts = np.array([0, 1, 1, 2, 3, 5]), np.array([0, 3])
    targets, labels = np.array([[0, 2, 2], [4, 0, 1]]), np.array([[1.0, 0, 0], [1, 0, 0]])
    _, by_flat, by_target = subwords.gradients(inner, outer, flat, starts, targets, labels)
    a, b = np.zeros_like(inner), np.zeros_like(outer)
    np.add.at(a, flat, by_flat)
    np.add.at(b, targets, by_target)
    loss = lambda: subwords.gradients(inner, outer, flat, starts, targets, labels)[0]
    for table, got in ((inner, a), (outer, b)):
        for i, j in np.ndindex(table.shape):
            held = table[i, j]
            table[i, j] = held + 1e-5
            up = loss()
            table[i, j] = held - 1e-5
            assert abs((up - loss()) / 2e-5 - got[i, j]) < 1e-4
            table[i, j] = held


def test_equal_models_from_any_split(spark):
    """Parts follow from content; a sentence that makes up a third of all is spread over them."""
    rows = sentences(60) + [["sunny", "seaside", "sunset"]] * 30
    dealt, parts = subwords._dealt(frame(spark, rows, 3), 50)
    shares = dealt.groupBy("part").agg({"times": "sum"}).collect()
    assert parts > 8 and len(shares) == parts
    assert sum(r.times for r in dealt.collect()) == len(rows)
    assert max(r.times for r in dealt.where("words[1] = 'seaside' and size(words) = 3").collect()) <= -(-30 // parts)
    made = []
    for split in (1, 7):
        model = subwords.fit(frame(spark, rows, split), size=4, ngrams=(2, 3), rounds=2, buckets=64, part_words=50)
        made.append({r.token: tuple(r.vec) for r in model.vectors(embedding.words_of(frame(spark, rows, 2))).collect()})
    assert made[0] == made[1] and len(made[0]) == 8


def test_related_words_come_close(spark, tmp_path):
    """Words that stand together are nearer than others, unseen ones by their subwords; a saved model is the same."""
    seen = [s for s in sentences(1500) if "sunset" not in s and "seabed" not in s]
    model = subwords.fit(frame(spark, seen, 4), size=12, ngrams=(3, 4), rounds=8, buckets=4096, part_words=400)
    words = [w for ws in STEMS.values() for w in ws] + ["sundown"]
    vec = {r.token: np.array(r.vec) for r in model.vectors(spark.createDataFrame([(w,) for w in words], "token string")).collect()}
    mean = np.mean(list(vec.values()), axis=0)  # in so small a corpus all words share a large part
    held, vec = vec["sunset"], {k: v - mean for k, v in vec.items()}
    cos = lambda a, b: float(vec[a] @ vec[b] / np.linalg.norm(vec[a]) / np.linalg.norm(vec[b]))
    for one, other in (("sun", "sea"), ("sea", "sun")):
        for a in STEMS[one]:
            inside = np.mean([cos(a, b) for b in STEMS[one] if a != b])
            assert inside > np.mean([cos(a, b) for b in STEMS[other]]) + 0.2, a
    assert cos("sundown", "sunny") > cos("sundown", "seaside")
    model.save(str(tmp_path / "m"))
    again = subwords.load(spark, str(tmp_path / "m")).vectors(spark.createDataFrame([("sunset",)], "token string")).first()
    assert np.array_equal(again.vec, held)


def test_no_words(spark):
    model = subwords.fit(frame(spark, [], 1), size=4, buckets=16)
    got = model.vectors(spark.createDataFrame([("a",), ("",), (None,)], "token string")).collect()
    assert [r.token for r in got] == ["a"] and len(got[0].vec) == 4
