"""Vector codes against every distance, in integers of any size."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from weftline.llm import codebooks

SCHEMA = "vec_id long, embedding array<double>, label int, id long, v string, code string, _by int"


def plain(rows, parts=8, entries=16, rounds=6):
    """rows: (id, vector, label), vectors of one length. {id: (code, error)}, digest."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(Fraction(x) * 4096) for x in v] for _, v, _ in rows]
    each = len(whole[0]) // parts
    cut = [[w[p * each : (p + 1) * each] for p in range(parts)] for w in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        new = []
        for p, book in enumerate(books):
            own = [near(c[p], book)[1] for c in cut]
            member = [[c[p] for c, o in zip(cut, own) if o == e] for e in range(len(book))]
            new.append([[sum(x) // len(m) for x in zip(*m)] if m else book[e] for e, m in enumerate(member)])
        books = new
    done = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [("".join(f"{i:02x}" for _, i in d), sum(s for s, _ in d)) for d in done], rows, digest


def random_rows(n, width, seed, scale=1.0):
    r = random.Random(seed)
    return [(i * 3 - 20, [r.gauss(0, scale) for _ in range(width)], r.choice([None, 1, 1, 2])) for i in range(n)]


@pytest.mark.parametrize("seed,kind", [(1, "plain"), (2, "ties"), (3, "huge"), (4, "zero")])
def test_annuli(seed, kind):
    r = np.random.default_rng(seed)
    book, x = r.integers(-900, 900, (16, 4)), r.integers(-900, 900, (500, 4))
    if kind == "ties":
        book, x = r.integers(-2, 3, (16, 4)), r.integers(-2, 3, (500, 4))
    elif kind == "huge":
        book, x = book.astype(object) * 10**40, x.astype(object) * 10**40 + 7
    elif kind == "zero":
        book = book * 0
    a = codebooks.Annuli([[int(v) for v in e] for e in book.tolist()])
    which, squares = a.nearest(x)
    for row, w, s in zip(x.tolist(), which.tolist(), squares.tolist()):
        assert (s, w) == min((sum((p - q) ** 2 for p, q in zip(row, e)), i) for i, e in enumerate(book.tolist()))
        assert a.nearest_one([int(v) for v in row]) == (w, s)


def test_annuli_leave_entries_out(monkeypatch):
    """Entries outside the interval aren't evaluated."""
    a = codebooks.Annuli([[1000 * i, 0] for i in range(16)])
    seen = []
    monkeypatch.setattr(np, "repeat", lambda v, n, f=np.repeat: seen.append(int(np.sum(n))) or f(v, n))
    which, _ = a.nearest(np.array([[1000 * i + 100, 0] for i in range(16)]))
    assert which.tolist() == list(range(16)) and seen[0] <= 2 * 16


def test_integers():
    assert codebooks.integers(np.array([-1 / 4096 - 1e-9, 0.0, 2.5])).tolist() == [-2, 0, 10240]
    assert codebooks.integers(np.array([[1e300, -0.1]])).tolist() == [[int(1e300) * 4096, -410]]


@pytest.mark.parametrize("n,width,scale", [(300, 16, 1.0), (5, 8, 1.0), (60, 8, 1e5), (60, 8, 1e30)])
def test_compressed(spark, n, width, scale):
    rows = random_rows(n, width, n, scale)
    rows += [rows[3], (rows[4][0], rows[1][1], 9)]  # a repeated row, a repeated id
    df = spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], SCHEMA).repartition(3)
    got = codebooks.compressed(df).collect()
    want, order, digest = plain(rows)
    total = {}
    for (_, error), (_, _, label) in zip(want, order):
        if error < 1 << 63:
            total[label] = total.get(label, 0) + error
    long = lambda x: x if x is not None and x < 1 << 63 else None
    want = sorted(((k, c, long(e), long(total.get(lab))) for (k, _, lab), (c, e) in zip(order, want)), key=repr)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in got), key=repr) == want
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = random_rows(40, 8, 7)
    odd = [(500, None, 1), (501, [nan] * 8, 1), (502, [inf, *[0.0] * 7], 1), (503, [None, *[0.0] * 7], None)]
    other = [(600, [1.0] * 4, 77), (601, [], 77), (602, [0.5] * 16, None)]
    nameless = [(None, [0.25] * 8, None)]
    df = spark.createDataFrame([(*r, 1, "x", "y", 2) for r in good + odd + other + nameless], SCHEMA)
    got = codebooks.compressed(df).collect()
    want, order, digest = plain(good + nameless)
    by = {(r.vec_id): r for r in got}
    assert len(got) == 44 and not {500, 501, 502, 503} & set(by)
    assert all((by[k].code, by[k].error) == w for (k, _, _), w in zip(order, want)) and by[600].codebooks_sha256 == digest
    assert all(by[k].code is None and by[k].error is None for k in (600, 601, 602)) and by[600].label_error is None
    assert codebooks.compressed(df.where("false")).count() == 0
    only = codebooks.compressed(df.where("vec_id >= 600")).collect()
    assert len(only) == 3 and all(r.code is None for r in only)


def test_sums_beside_a_hot_value(spark, monkeypatch):
    monkeypatch.setattr(codebooks, "BROADCAST_ROWS", 50)
    rows = codebooks.stored(spark.range(3000).selectExpr("id", "case when id % 3 = 0 then null else id % 700 end as label", "id as error"), "t")
    got = codebooks.with_sums(rows, "label", "error", "total").collect()
    want = {}
    for r in rows.collect():
        want[r.label] = want.get(r.label, 0) + r.error
    assert len(got) == 3000 and all(r.total == want[r.label] for r in got)


def test_decode(spark):
    rows = random_rows(50, 8, 3)
    df = spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows] + [(999, [1.0], 1, 1, "x", "y", 2)], SCHEMA)
    books = codebooks.train(df)
    got = {r.id: r for r in codebooks.decode(codebooks.encode(df, books), books).collect()}
    assert got[999].vec is None
    for k, v, _ in rows:
        whole = [math.floor(x * 4096) for x in v]
        assert sum((a - round(b * 4096)) ** 2 for a, b in zip(whole, got[k].vec)) == got[k].error


@pytest.mark.parametrize("name", ["op13_codes"])
def test_sql(spark, name):
    import glob
    import os

    import duckdb

    from tests.conftest import SF
    from weftline.llm import queries, sql

    if not os.path.isdir(SF):
        pytest.skip("no tables")
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    assert sorted(map(tuple, df.select(*cols).collect())) == sorted(con.execute(f"select {', '.join(cols)} from ({sql.oracle_sql()[name]})").fetchall())
