"""Fast similarity sketches and near-duplicates against all pairs."""

import random

import numpy as np
import pytest

from weftline.llm import sketch

SCHEMA = "doc_id long, text string, key long, size long, band long, label long, rep string"


def words(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n)]


def changed(w, n, seed):
    r = random.Random(seed)
    out = list(w)
    for i in r.sample(range(len(w)), n):
        out[i] = f"changed{seed}x{i}"
    return out


def plain(rows):
    """{row: (n_shingles, component)} by all pairs of distinct texts."""
    def grams(text):
        w = (text or "").translate({c: c + 32 for c in range(65, 91)}).split() if (text or "").isascii() else (text or "").encode().lower().decode().split(" ")
        return {" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w and w != [""] else set()

    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if sets[i] and key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return [(len(s), least.get(find(i)) if s else rows[i][0]) for i, s in enumerate(sets)]


def run(spark, rows):
    df = spark.createDataFrame([(*r, 5, 6, 7, 8, "r") for r in rows], SCHEMA).repartition(3)
    got = sketch.near_duplicates(df)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    got = sorted(map(tuple, got.collect()), key=repr)
    want = sorted(((k, n, c, k == c) for (k, _), (n, c) in zip(rows, plain(rows))), key=repr)
    assert got == want
    return got


def test_every_coordinate_fills():
    sets = [np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for n in (1, 2, 7, 50, 3000)]
    s = sketch.sketches(sets)
    assert (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    rounds = (s >> np.uint64(55)).max(axis=1)
    assert rounds[0] <= 2 * sketch.COORDINATES - 1 and rounds[-1] <= 3
    assert (sketch.sketches(sets[3:4]) == s[3]).all()  # alone as beside others


@pytest.mark.parametrize("size", [12, 60, 400, 5000])
@pytest.mark.parametrize("j", [0.3, 0.6, 0.85, 0.95])
def test_agreement_follows_similarity(size, j):
    rng = np.random.default_rng(size)
    agree, truth = [], []
    for _ in range(40):
        both = round(size * 2 * j / (1 + j))
        pool = rng.integers(0, 1 << 63, 2 * size - both, dtype=np.int64).astype(np.uint64)
        a, b = np.sort(pool[:size]), np.sort(pool[size - both :])
        s = sketch.sketches([a, b])
        agree.append((s[0] == s[1]).mean())
        truth.append(both / len(pool))
    # 40 pairs of 128 coordinates: the mean's deviation is below 0.007
    assert abs(np.mean(agree) - np.mean(truth)) < 0.03 and np.std(agree) < 0.06


def test_planes():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 300, dtype=np.int64).astype(np.uint64)
    a, b = sketch.planes_of(sketch.sketches([np.sort(base), np.sort(np.concatenate([base[:-10], base[:10] + np.uint64(1)]))]))
    half = len(a) // sketch.PLANES
    apart = 0
    for w in range(half):
        differ = 0
        for k in range(sketch.PLANES):
            differ |= int(a[k * half + w]) ^ int(b[k * half + w])
        apart += (differ & (2**64 - 1)).bit_count()
    exact = sketch.sketches([np.sort(base), np.sort(np.concatenate([base[:-10], base[:10] + np.uint64(1)]))])
    assert 0 < apart <= int((exact[0] != exact[1]).sum()) <= sketch.APART


def test_odd_rows(spark):
    base = " ".join(words(120, 1))
    texts = [base, None, "", " \n\t", base, " ".join(changed(base.split(), 3, 1)), "one two", "One  TWO", "three", base.upper(), " ".join(words(6000, 5)), "Éa éa b c", "éa éa b c"]
    rows = list(enumerate(texts))
    run(spark, [*rows, rows[0], rows[1], (3, base + " x"), (10, base + " y"), (None, base), (None, "only here without an id"), (None, None)])
    assert sketch.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_threshold(spark):
    """Pairs on both sides of the bound, of many sizes."""
    rows = []
    for k, n in enumerate([4, 8, 17, 23, 40, 41, 66, 100, 300, 900]):
        w = words(n, 50 + k)
        rows.append((100 * k, " ".join(w)))
        for m in range(1, 9):
            if m <= n // 2:
                rows.append((100 * k + m, " ".join(changed(w, max(1, n * m // 120), 1000 * k + m))))
        rows.append((100 * k + 50, " ".join(w + words(max(1, n // 6), 7))))
    run(spark, rows)


def test_group_around_a_text_that_is_not_the_smallest(spark):
    """Copies of one text that link with it and not with each other; a second text in the same buckets; a chain."""
    base = words(200, 9)
    rows = [(i, " ".join(changed(base, 5, i))) for i in range(60)] + [(500, " ".join(base))]
    other = base[:120] + words(80, 10)
    rows += [(600 + i, " ".join(changed(other, 4, 900 + i))) for i in range(30)] + [(700, " ".join(other))]
    chain = words(150, 11)
    for i in range(25):
        rows.append((800 + i, " ".join(chain)))
        chain = changed(chain, 2, 5000 + i)
    run(spark, rows)


def test_copies_that_miss_their_text(spark):
    """A group in which half the copies are changed too often to link with the text, and some of these have copies themselves."""
    base = words(150, 21)
    rows = [(i, " ".join(changed(base, 2 + i % 9, i))) for i in range(120)] + [(999, " ".join(base))]
    far = changed(base, 11, 777)
    rows += [(2000 + i, " ".join(changed(far, 2, 3000 + i))) for i in range(10)]
    run(spark, rows)


def test_components_join_what_is_known(spark, monkeypatch):
    """Labels that get more links are those of all links together; what is settled costs no round, and no link is compared anew."""
    from weftline.llm import components as C

    r = random.Random(3)
    first = [(r.randrange(80), r.randrange(80)) for _ in range(50)] + [(k, k + 1) for k in range(100, 130)]
    more = [(r.randrange(140), r.randrange(140)) for _ in range(40)] + [(200, 201)]
    frame = lambda rows: spark.createDataFrame([(int(a), int(b)) for a, b in rows], "a long, b long")
    found = lambda df: sorted(map(tuple, df.collect()))
    assert found(C.joined(C.components(frame(first)), frame(more))) == [x for x in found(C.components(frame(first + more)))]
    seen = []
    real = C.stored
    monkeypatch.setattr(C, "stored", lambda df, name, *x: seen.append(name) or real(df, name, *x))
    assert found(C.components(frame([(5, 1), (7, 1), (9, 8)]))) == [(1, 1), (5, 1), (7, 1), (8, 8), (9, 8)]
    assert seen == ["star"]
    seen.clear()
    labels = C.components(frame([(k, 1) for k in range(2, 60)]))
    seen.clear()
    assert found(C.joined(labels, frame([(40, 0)])))[:3] == [(0, 0), (1, 0), (2, 0)] and seen == ["star"]
