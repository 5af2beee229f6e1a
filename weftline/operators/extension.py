"""Extension of places where two texts meet to whole matches, by rounds of joins.

A text's codes of vectors are stored once, in blocks of BLOCK positions; workers read the vectors. A place asks for the blocks
around it: there its best beginning is found. Then each match that still grows asks for the blocks behind it, of both texts, twice
as many positions each round, and takes with it only its sums and what it has seen so far. So a row holds a stretch of two texts,
never a text, however long they are and however many places a text has. Last, the places of two texts are gone through in their
order, and those that an earlier match covers on its diagonal are dropped, as if they had not been tried.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from weftline.operators import search
from weftline.operators.reuse import _cosine, _cosines, optimize_start
from weftline.operators.vectors import lookup
from weftline.sources.shared import discard, stored

BLOCK = 64
#: Positions that a match asks for in its first round, and at most.
FIRST, MOST = 64, 1024

MATCH = "key_a long, key_b long, i long, j long, start_a long, start_b long, length_a long, length_b long, similarity double"
STATE = "id long, key_a long, key_b long, i long, j long, size_a long, size_b long, start_a long, start_b long, n long, last_n long, now double, similarity double, drops long, sum_a array<double>, sum_b array<double>, grows boolean"


def text_blocks(tokens: DataFrame, space: DataFrame, key: str, dims: int, book: search.Book | None = None, limit: int = search.MATRIX_BYTES) -> DataFrame:
    """Stored (key, block, vecs) of (key, pos, token), positions from 0 without gaps: codes in the ``book`` of the space, which
    stays with the table; where the space is more than ``limit`` bytes, vectors, zeros for a token without one."""
    book = book or search.book(space, dims, limit)
    block = F.floor(F.col("pos") / BLOCK).cast("long").alias("block")
    if book is None:
        zero = F.array(*[F.lit(0.0)] * dims)
        rows = lookup(tokens.select(F.col(key).alias("key"), "pos", "token"), space, keep=True)
        rows = rows.select("key", block, F.struct("pos", F.coalesce(F.transform("vec", lambda x: x.cast("double")), zero).alias("v")).alias("x"))
    else:
        rows = tokens.select(F.col(key).alias("key"), block, F.struct("pos", F.xxhash64("token").alias("v")).alias("x"))
    out = rows.groupBy("key", "block").agg(F.array_sort(F.collect_list("x")).alias("x")).select("key", "block", F.transform("x", lambda x: x["v"]).alias("vecs"))
    if book is not None:

        def coded(batches):
            for batch in batches:
                vecs = batch.column(2)
                codes = pa.array(book.codes(vecs.flatten().to_numpy()))
                sizes = np.concatenate([[0], np.cumsum(vecs.value_lengths().to_numpy())]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(sizes), codes)], ["key", "block", "vecs"])

        out = out.mapInArrow(coded, StructType([out.schema["key"], out.schema["block"], StructField("vecs", ArrayType(IntegerType()))]))
    out = stored(out, "extension-blocks")
    out.book = book
    return out


def word_blocks(texts: DataFrame, space: DataFrame | search.KeyedSpace, key: str, dims: int, book: search.Book | None = None, limit: int = search.MATRIX_BYTES) -> DataFrame:
    """As ``text_blocks`` from (key, words), a row a text: texts are cut where they are read, nothing is shuffled."""
    book = book or search.book(space, dims, limit)
    if book is None:
        return text_blocks(texts.select(key, F.posexplode("words").alias("pos", "token")), search.space_table(space), key, dims, limit=limit)

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            many = -(-sizes // BLOCK)
            row = np.repeat(np.arange(len(sizes)), many)
            block = np.arange(len(row)) - (np.cumsum(many) - many)[row]
            starts = (np.cumsum(sizes) - sizes)[row] + block * BLOCK
            codes = pa.array(book.codes(lists.flatten().to_numpy()))
            vecs = pa.ListArray.from_arrays(pa.array(np.append(starts, len(codes)).astype(np.int32)), codes)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(block), vecs], ["key", "block", "vecs"])

    hashes = texts.where(F.size("words") > 0).select(F.col(key).alias("key"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    out = stored(hashes.mapInArrow(run, StructType([hashes.schema["key"], StructField("block", LongType()), StructField("vecs", ArrayType(IntegerType()))])), "extension-blocks")
    out.book = book
    return out


def _vectors(stretch: np.ndarray, book: search.Book | None, beside: search.Book | None) -> np.ndarray:
    return np.stack(stretch) if book is None else book.matrix(beside)[np.asarray(stretch)]


def _stretches(rows: DataFrame, blocks: DataFrame, side: str, lo: Column, hi: Column) -> DataFrame:
    """(id, v<side>): the vectors at [lo, hi) of each row's text of this side; none where that is empty."""
    asked = rows.select("id", F.col(f"key_{side}").alias("key"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi")).where("hi > lo")
    asked = asked.withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / BLOCK).cast("long"), F.floor((F.col("hi") - 1) / BLOCK).cast("long"))))
    met = asked.join(blocks, ["key", "block"]).groupBy("id").agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.array_sort(F.collect_list(F.struct("block", "vecs"))).alias("x"))
    whole = F.flatten(F.transform("x", lambda x: x["vecs"]))
    return met.select("id", F.slice(whole, (F.col("lo") % BLOCK + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")).alias(f"v{side}"))


def grown(state: dict, va: np.ndarray, vb: np.ndarray, threshold: float, patience: int) -> dict:
    """A match after the next positions of both texts. It ends where the similarity of its means isn't above the threshold, or
    after ``patience`` drops since its last rise; the last rise counts."""
    n = min(len(va), len(vb))
    a, b = (np.cumsum(np.vstack([state[s], v[:n]]), axis=0)[1:] for s, v in (("sum_a", va), ("sum_b", vb)))
    for k, s in enumerate(_cosines(a, b).tolist()):
        if state["drops"] >= patience or s <= threshold:
            return state | {"grows": False}
        at = state["n"] + 1
        if s > state["now"]:
            state = state | {"last_n": at, "similarity": s, "drops": 0}
        elif s < state["now"]:
            state = state | {"drops": state["drops"] + 1}
        state = state | {"n": at, "now": s}
    if n:
        state = state | {"sum_a": a[-1], "sum_b": b[-1]}
    room = min(state["size_a"] - state["start_a"], state["size_b"] - state["start_b"]) - state["n"]
    return state | {"grows": room > 0}


def _frame(states: list[dict]) -> pd.DataFrame:
    """Rows of STATE; matches that have ended keep no sums."""
    states = [s if s["grows"] else s | {"sum_a": None, "sum_b": None} for s in states]
    return pd.DataFrame(states, columns=[x.split()[0] for x in STATE.split(", ")])


def _begun(rows: DataFrame, threshold: float, min_length: int, patience: int, books: tuple) -> DataFrame:
    """Rows of STATE of the places (id, ..., va, vb: stretches around them) that pass the gate, grown to the stretches' ends."""

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                a, b = _vectors(r.va, *books), _vectors(r.vb, *books[::-1])
                i, j = int(r.i - r.lo_a), int(r.j - r.lo_b)
                if _cosine(a[i : i + min_length].mean(axis=0), b[j : j + min_length].mean(axis=0)) <= threshold:
                    continue
                x, y, s = optimize_start(a, b, i, j, min_length)
                sums = (np.cumsum(v[at : at + min_length], axis=0)[-1] for v, at in ((a, x), (b, y)))
                room = min(r.size_a - r.lo_a - x, r.size_b - r.lo_b - y) - min_length
                own = (r.id, r.key_a, r.key_b, r.i, r.j, r.size_a, r.size_b, r.lo_a + x, r.lo_b + y, min_length, min_length, s, s, 0, *sums, bool(s > threshold and room > 0))
                state = dict(zip((c.split()[0] for c in STATE.split(", ")), own))
                out.append(grown(state, a[x + min_length :], b[y + min_length :], threshold, patience) if state["grows"] else state)
            yield _frame(out)

    return rows.mapInPandas(run, STATE)


def _grown(rows: DataFrame, threshold: float, patience: int, books: tuple) -> DataFrame:
    names = [x.split()[0] for x in STATE.split(", ")]

    def run(batches):
        for pdf in batches:
            yield _frame([grown({c: getattr(r, c) for c in names}, _vectors(r.va, *books), _vectors(r.vb, *books[::-1]), threshold, patience) for r in pdf.itertuples()])

    return rows.mapInPandas(run, STATE)


def _uncovered(matches: DataFrame) -> DataFrame:
    """Of the matches of two texts, in order of their places, those whose place no earlier one that stays covers on its diagonal."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        spans: dict[int, list[tuple[int, int]]] = {}
        keep = []
        pdf = pdf.sort_values(["i", "j"])
        for r in pdf.itertuples():
            keep.append(not any(lo <= r.i < hi for lo, hi in spans.get(r.i - r.j, ())))
            if keep[-1]:
                spans.setdefault(r.start_a - r.start_b, []).append((r.start_a, r.start_a + r.length_a))
        return pdf[keep]

    return matches.groupBy("key_a", "key_b").applyInPandas(run, MATCH)


def extend_places(places: DataFrame, one: DataFrame, two: DataFrame, threshold: float = 0.9, min_length: int = 10, patience: int = 10) -> DataFrame:
    """Rows of MATCH from ``places`` (key_a, i, key_b, j) between texts whose ``text_blocks`` are ``one`` and ``two``."""
    books = one.book, two.book
    sizes = [b.groupBy(F.col("key").alias(f"key_{s}")).agg(F.sum(F.size("vecs")).alias(f"size_{s}")) for s, b in (("a", one), ("b", two))]
    rows = places.select(*(F.col(c).cast("long").alias(c) for c in ("key_a", "key_b", "i", "j"))).distinct().join(sizes[0], "key_a").join(sizes[1], "key_b")
    rows = rows.withColumn("id", F.monotonically_increasing_id())
    for s, at in (("a", "i"), ("b", "j")):
        rows = rows.withColumn(f"lo_{s}", F.greatest(F.col(at) - min_length + 2, F.lit(0)))
    rows = stored(rows, "extension-places")
    around = lambda s, at, b: _stretches(rows, b, s, F.col(f"lo_{s}"), F.least(F.col(at) + min_length + FIRST, F.col(f"size_{s}")))
    state = stored(_begun(rows.join(around("a", "i", one), "id").join(around("b", "j", two), "id"), threshold, min_length, patience, books), "extension-state")
    done, step = [state.where("not grows")], FIRST
    tables = [state]
    while not (active := state.where("grows")).isEmpty():
        behind = lambda s, b: _stretches(active, b, s, F.col(f"start_{s}") + F.col("n"), F.least(F.col(f"start_{s}") + F.col("n") + step, F.col(f"size_{s}")))  # noqa: E731, B023
        state = stored(_grown(active.join(behind("a", one), "id").join(behind("b", two), "id"), threshold, patience, books), "extension-state")
        tables.append(state)
        done.append(state.where("not grows"))
        step = min(2 * step, MOST)
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    found = found.select("key_a", "key_b", "i", "j", "start_a", "start_b", F.col("last_n").alias("length_a"), F.col("last_n").alias("length_b"), "similarity")
    out = stored(_uncovered(found), "extension-matches")
    discard(rows, *tables)
    return out
