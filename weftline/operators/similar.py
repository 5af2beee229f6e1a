"""All pairs of vectors above a cosine threshold, exactly, without comparing all pairs.

Angles are a metric. A bounded number of left rows, those of smallest hash, are pivots; each left row belongs to its nearest
pivot, and to a ring of it by its angle. A ring of more rows than BLOCK is split. A block keeps the least and largest angle of its
rows to its own pivot and to REFERENCES others. A right row goes to the blocks in which, by the triangle inequality, some row
may be within the threshold's angle: each of its own angles must lie within that of the block's interval. There the two
sides are one matrix product, and every pair above the threshold comes out. Pivots decide how much is left out, never what
is found; spread-out vectors are left out least, those in clusters most.

The driver holds pivots and block intervals: at most PIVOTS vectors, and REFERENCES + 1 intervals a block. Right rows are counted by
block before they are sent, so both sides of a product have bounded size, however many rows share a place.

Rows whose vector is null or has no length are similar to nothing. Repeated keys count as often as they occur.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import vector as V
from weftline.sources.shared import stored

PIVOTS, REFERENCES, RINGS = 512, 32, 24
#: Left rows of a block, and right rows that meet it at once.
BLOCK, RIGHT = 2_000, 20_000
#: Added to angles for what floats lose.
SLACK = 1e-6


def _units(df: DataFrame, key: str, vec: str) -> DataFrame:
    """(key, v) of length 1, for rows with a length."""
    rows = df.select(F.col(key).alias("key"), F.transform(vec, lambda x: x.cast("double")).alias("_v")).withColumn("_n", V.norm(F.col("_v")))
    return rows.where("_n > 0").select("key", V.scaled(F.col("_v"), F.lit(1.0) / F.col("_n")).alias("v"))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def angles(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(rows @ pivots.T, -1, 1))


class Blocks:
    """Intervals of angles of the blocks, sorted by pivot and ring: (pivot, ring, part count), least and largest angles."""

    def __init__(self, pivots: np.ndarray, table: list[tuple[int, int, int, list[float], list[float]]]):
        self.pivots = pivots
        self.references = np.arange(min(REFERENCES, len(pivots)))
        self.pivot = np.array([t[0] for t in table], np.int64)
        self.ring = np.array([t[1] for t in table], np.int64)
        self.parts = np.array([-(-t[2] // BLOCK) for t in table], np.int64)
        self.low, self.high = (np.array([t[k] for t in table]).reshape(len(table), -1) for k in (3, 4))

    def reached(self, v: np.ndarray, within: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, block) of unit vectors that may be within an angle of some row of a block."""
        own = angles(v, self.pivots)
        far = lambda a, k: (a < self.low[:, k] - within - SLACK) | (a > self.high[:, k] + within + SLACK)
        ok = ~far(own[:, self.pivot], 0)
        for k, p in enumerate(self.references):
            ok &= ~far(own[:, [p]], k + 1)
        return np.nonzero(ok)


def similar_pairs(left: DataFrame, right: DataFrame, key: str, threshold: float = 0.8, vec: str = "vec", digits: int = 6, pivots: int = PIVOTS) -> DataFrame:
    """(a, b, similarity) of every left and right row whose rounded cosine similarity is above ``threshold``, from 0 to 1."""
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold must be from 0 to 1")
    spark, kind = left.sparkSession, {f.name: f.dataType.simpleString() for f in left.schema}[key]
    one, two = stored(_units(left, key, vec), "similar-left"), stored(_units(right, key, vec), "similar-right")
    schema = f"a {kind}, b {kind}, similarity double"
    chosen = one.orderBy(F.xxhash64("key"), "v").limit(pivots).select("v").toArrow()  # a bounded number of rows
    if not chosen.num_rows:
        return spark.createDataFrame([], schema)
    p = np.unique(_matrix(chosen.column("v")), axis=0)
    within = float(np.arccos(max(0.0, threshold - 0.5 * 10**-digits)))
    n_ref = min(REFERENCES, len(p))

    def homes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = angles(v, p)
        home = own.argmin(axis=1)
        return home, np.minimum((own[np.arange(len(v)), home] / np.pi * RINGS).astype(np.int64), RINGS - 1), own

    def measure(batches):
        for batch in batches:
            home, ring, own = homes(_matrix(batch.column("v")))
            code = home * RINGS + ring
            order = np.argsort(code, kind="stable")
            which, starts, counts = np.unique(code[order], return_index=True, return_counts=True)
            seen = np.column_stack([own[np.arange(len(home)), home], own[:, :n_ref]])[order]
            low, high = np.minimum.reduceat(seen, starts), np.maximum.reduceat(seen, starts)
            yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(counts), pa.array(low.tolist()), pa.array(high.tolist())], ["code", "n", "low", "high"])

    seen = one.select("v").mapInArrow(measure, "code long, n long, low array<double>, high array<double>")
    ends = [f(F.get(c, F.lit(k))).alias(f"{c}{k}") for f, c in ((F.min, "low"), (F.max, "high")) for k in range(n_ref + 1)]
    table = seen.groupBy("code").agg(F.sum("n").alias("n"), *ends).orderBy("code").collect()  # PIVOTS * RINGS rows at most
    blocks = Blocks(p, [(r["code"] // RINGS, r["code"] % RINGS, r["n"], [r[f"low{k}"] for k in range(n_ref + 1)], [r[f"high{k}"] for k in range(n_ref + 1)]) for r in table])

    def count(batches):
        total = np.zeros(len(blocks.pivot), np.int64)
        for batch in batches:
            total += np.bincount(blocks.reached(_matrix(batch.column("v")), within)[1], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["block", "n"])

    sent = two.select("v").mapInArrow(count, "block long, n long").groupBy("block").agg(F.sum("n").alias("n")).collect()  # a number a block
    rights = np.zeros(len(blocks.pivot), np.int64)
    for r in sent:
        rights[r["block"]] = -(-r["n"] // RIGHT)
    of_code = {int(c * RINGS + r): i for i, (c, r) in enumerate(zip(blocks.pivot, blocks.ring))}
    names = ["block", "part", "side", "key", "v"]

    def spread(key_: pa.Array, v: pa.Array, row: np.ndarray, block: np.ndarray, part: np.ndarray, side: np.ndarray) -> pa.RecordBatch:
        at = pa.array(row)
        return pa.RecordBatch.from_arrays([pa.array(block), pa.array(part), pa.array(side), key_.take(at), v.take(at)], names)

    def deal(times: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each entry ``times`` over, with the number of the copy."""
        at = np.repeat(np.arange(len(own)), times)
        return at, np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)

    def lefts(batches):
        turn = 0
        for batch in batches:
            home, ring, _ = homes(_matrix(batch.column("v")))
            block = np.array([of_code[c] for c in (home * RINGS + ring).tolist()], np.int64)
            part = (np.arange(len(block)) + turn) % blocks.parts[block]
            turn += len(block)
            at, side = deal(rights[block], block)
            yield spread(batch.column("key"), batch.column("v"), at, block[at], part[at], side)

    def rightward(batches):
        turn = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                piece = batch.slice(lo, 1024)
                row, block = blocks.reached(_matrix(piece.column("v")), within)
                side = (np.arange(len(row)) + turn) % np.maximum(rights[block], 1)
                turn += len(row)
                at, part = deal(blocks.parts[block], block)
                yield spread(piece.column("key"), piece.column("v"), row[at], block[at], part, side[at])

    def product(a: pa.Table, b: pa.Table) -> pa.Table:
        x, y = _matrix(a.column("v")), _matrix(b.column("v"))
        found: list[tuple[np.ndarray, ...]] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        for lo in range(0, len(y) if len(x) else 0, 1024):
            value = np.round(x @ y[lo : lo + 1024].T, digits)
            i, k = np.nonzero(value > threshold)
            found.append((i, k + lo, value[i, k]))
        i, k, value = (np.concatenate(c) for c in zip(*found))
        return pa.table([a.column("key").take(pa.array(i)), b.column("key").take(pa.array(k)), pa.array(value)], names=["a", "b", "similarity"])

    shape = f"block long, part long, side long, key {kind}, v array<double>"
    by = ("block", "part", "side")
    sides = one.mapInArrow(lefts, shape), two.mapInArrow(rightward, shape)
    return sides[0].groupBy(*by).cogroup(sides[1].groupBy(*by)).applyInArrow(product, schema)
