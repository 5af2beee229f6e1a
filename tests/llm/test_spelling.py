"""Spelling variants against all pairs of words."""

import random
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import spelling

SCHEMA = "doc_id long, text string, word string, n long, block int, role int, gram string"


def plain(rows):
    count = Counter()
    for key, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        run = ""
        for c in low + " ":
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
            elif run:
                h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
                if h % 199 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                count[run] += len(run) >= 6
                run = ""
    n = {w: k for w, k in count.items() if k >= 5}
    drop = lambda w: {w[:i] + w[i + 1 :] for i in range(len(w))}
    near = {w: {x for x in n if (len(x) == len(w) and sum(a != b for a, b in zip(w, x)) == 1) or (len(x) + 1 == len(w) and x in drop(w)) or (len(w) + 1 == len(x) and w in drop(x))} for w in n}
    best = {w: min(((-n[x], x) for x in near[w]), default=None) for w in n}
    form = {w: b[1] if b and -b[0] >= 5 * n[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n), key=repr)


def run(spark, rows, **how):
    df = spark.createDataFrame([(*r, "w", 1, 2, 3, "g") for r in rows], SCHEMA).repartition(3)
    got = spelling.variants(df, **how)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = sorted(map(tuple, got.collect()), key=repr)
    assert got == plain(rows)
    return got


def edited(w, r, letters="abcdéÿ"):
    i = r.randrange(len(w))
    return r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice(letters) + w[i:], w[:i] + r.choice(letters) + w[i + 1 :]])


@settings(max_examples=300, deadline=None)
@given(st.text("ab", min_size=6, max_size=9), st.text("ab", min_size=6, max_size=9))
def test_one_edit(a, b):
    near = (len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1) or (len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b))))
    assert spelling.one_edit(a, b) == near


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), unique=True).map(sorted), min_size=1, max_size=7), st.integers(1, 7))
def test_merged(lists, least):
    lists = [x for x in lists if x]
    if len(lists) < least:
        return
    count = Counter(i for x in lists for i in x)
    assert list(spelling.merged(lists, least)) == sorted(i for i, n in count.items() if n >= least)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab", min_size=6, max_size=10), unique=True, min_size=2, max_size=40))
def test_index_finds_every_near_word(words):
    for size in range(6, 12):
        long = sorted(w for w in words if len(w) == size)
        if long:
            index = spelling.Index(long)
            for w in words:
                if len(w) in (size - 1, size):
                    assert sorted(index.near(w)) == [i for i, y in enumerate(long) if spelling.one_edit(w, y)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=6, max_size=10), unique=True, min_size=2, max_size=30))
def test_near_words_meet_in_a_group(words):
    counts = Counter(g for w in words for g in spelling.grams(w))
    for x in words:
        for y in words:
            if spelling.one_edit(x, y):
                q = spelling.GRAM
                own = spelling.rarest(x, counts, q + 1 if len(x) == len(y) else q)
                assert set(own) & set(spelling.rarest(y, counts, q + 1))


@pytest.mark.parametrize("group", [20_000, 7])
def test_variants(spark, group):
    r = random.Random(5)
    base = ["".join(r.choices("abcdé", k=r.randint(6, 9))) for _ in range(25)]
    rows, key = [], 0
    for w in base:
        for x, k in [(w, 120), *((edited(w, r), r.choice([5, 6, 24, 25])) for _ in range(4))]:
            for _ in range(k):
                rows.append((key % 37, x.upper() if key % 5 == 0 and x.isascii() else x))
                key += 1
    path = ["aaaaaaaa"]
    for i in range(3):  # a path of forms, each over five times as frequent
        path.append(path[-1][:i] + "z" + path[-1][i + 1 :])
    rows += [(1000 + j, x) for i, x in enumerate(path) for j in range((8, 50, 300, 1800)[i])]
    rows = [(k, " ".join(t for _, t in g)) for k, g in grouped(rows)]
    got = run(spark, rows, group=group)
    assert any(x[1] and x[2] != x[1] for x in got)


def grouped(rows):
    out = {}
    for k, t in rows:
        out.setdefault(k, []).append((k, t))
    return sorted(out.items())


def test_odd_rows(spark):
    long = " ".join(["lettered", "letterad"] * 3000) + "x" * 5000
    rows = [(1, None), (2, ""), (3, "short ones"), (None, "nameless nameless nameless nameless nameless"), (4, long), (4, long), (5, long + "ü" + "Ä" * 7), (6, "×÷×÷×÷ " * 6), (7, "naïvetés-NAÏVETéS " * 9)]
    run(spark, rows)
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None, "w", 1, 2, 3, "g")], SCHEMA)).count() == 0


def test_long_text_in_pieces(spark, monkeypatch):
    """Runs come in pieces where a text is long; a hot word is in every row."""
    rows = [(i, "everywhere everywherd " * (1 + i % 3)) for i in range(300)]
    run(spark, rows)


def test_checksum_by_sql():
    import duckdb

    from weftline.llm.sql_spelling import crc32_sql

    for text in ("1:abcdef", "", "-9:naïvetés", "é" * 40):
        assert duckdb.execute(f"select {crc32_sql('s')} from (select '{text}' as s)").fetchone()[0] == zlib.crc32(text.encode())
