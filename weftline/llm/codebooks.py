"""Vector code compression: product codes whose nearest entries are found in annuli of norms.

A component x becomes the integer floor(4096 * x); vectors are cut into equal parts, and each part position has a codebook.
Entries are sorted by norm. The distance to the entry of nearest norm bounds what can be better: by the triangle inequality
only entries whose norm differs from the part's by no more than it. Binary search finds their interval, the annulus, and
every entry in it, bounds included, is evaluated exactly in integers. Norms are floats, so the interval is widened
by more than they can err; that only adds evaluations.

Each round is one pass over the rows. A task adds up its rows' parts by entry, so it sends at most one number for each
component of the codebooks; Spark sums these as decimals and the driver receives as many numbers as the codebooks
have: entries times a vector's length, however many rows there are. ``df`` is read once a round: store it where that is dear.

Defined results: rows whose vector is null or holds null, NaN or infinite components are dropped. The length that counts
is that of the smallest kept id's vector; a vector of another length, or any if that isn't a positive multiple of the number
of parts, has a null code and error and takes no part in training. A null id comes after all others, rows that share
an id come in order of their components. With fewer rows than entries the codebooks are shorter. Components of any finite size
are exact: beyond SMALL they are Python's integers. An error beyond a long is null, and so is a sum; sums pass over nulls. An empty table gives no
rows. Columns of ``df`` but id, vector and label aren't read.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import BROADCAST_ROWS, bounded_broadcast, release, small_batches, stored

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components below this are summed and squared as 64-bit integers: 2^15 rows of a batch, or 2^11 squares, stay below 2^63.
SMALL = 1 << 25
#: Larger sums travel as digits of this base.
BASE = 1 << 60
#: Rows that numpy handles at once.
STEP = 1 << 13


@dataclass(frozen=True)
class Codebooks:
    """books[part][entry][component] as Python's integers."""

    books: list[list[list[int]]]
    scale: int = SCALE

    @property
    def length(self) -> int:
        return sum(len(book[0]) for book in self.books if book)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for book in self.books for entry in book for x in entry).encode()).hexdigest()


def integers(v: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * v): 64-bit integers where all are below SMALL, else Python's."""
    v = np.asarray(v, np.float64)
    if not v.size or np.abs(v).max() < SMALL / scale:
        return np.floor(v * scale).astype(np.int64)
    exact = lambda x: int(x) * scale if abs(x) >= 1 << 53 else math.floor(x * scale)  # noqa: E731  above 2^53 doubles are whole
    return np.array([exact(x) for x in v.ravel().tolist()], object).reshape(v.shape)


class Annuli:
    """One part's codebook, its entries sorted by norm."""

    def __init__(self, book: list[list[int]]):
        squares = [sum(x * x for x in entry) for entry in book]
        self.order = sorted(range(len(book)), key=lambda i: (squares[i], i))
        self.book = book
        self.roots = [math.isqrt(squares[i]) for i in self.order]
        self.small = all(abs(x) < SMALL for entry in book for x in entry)
        if self.small:
            self.entries = np.array(book, np.int64)[self.order]
            self.norms = np.sqrt(np.array([squares[i] for i in self.order], np.float64))

    def nearest_one(self, x: list[int]) -> tuple[int, int]:
        """(entry, squared distance) of one part in integers of any size; ties to the lower entry."""
        own = math.isqrt(sum(a * a for a in x))
        distance = lambda i: (sum((a - b) ** 2 for a, b in zip(x, self.book[i])), i)
        best = distance(self.order[min(bisect_left(self.roots, own), len(self.roots) - 1)])
        reach = math.isqrt(best[0]) + 2  # roots are cut to integers
        for place in range(bisect_left(self.roots, own - reach), bisect_right(self.roots, own + reach)):
            best = min(best, distance(self.order[place]))
        return best[1], best[0]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entries, squared distances) of parts, rows of ``x``."""
        if x.dtype == object or not self.small:
            found = [self.nearest_one([int(a) for a in row]) for row in x.tolist()]
            return np.array([a for a, _ in found], np.int64), np.array([b for _, b in found], object)
        own = np.sqrt((x * x).sum(axis=1).astype(np.float64))
        first = np.minimum(np.searchsorted(self.norms, own), len(self.norms) - 1)
        reach = np.sqrt(((x - self.entries[first]) ** 2).sum(axis=1).astype(np.float64)) * (1 + 1e-9) + own * 1e-9 + 1e-6
        lo, hi = np.searchsorted(self.norms, own - reach, "left"), np.searchsorted(self.norms, own + reach, "right")
        counts = hi - lo
        row = np.repeat(np.arange(len(x)), counts)
        place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + lo[row]
        squares = ((x[row] - self.entries[place]) ** 2).sum(axis=1)
        index = np.array(self.order)[place]
        starts = np.cumsum(counts) - counts  # the entry of nearest norm is in each annulus, so none is empty
        least = np.minimum.reduceat(squares, starts)
        return np.minimum.reduceat(np.where(squares == least[row], index, len(self.order)), starts), least


def _known(vec: str) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.col(vec).isNotNull() & F.forall(F.transform(vec, lambda x: x.cast("double")), finite)


def _kept(df: DataFrame, key: str, vec: str, *more: Column) -> DataFrame:
    rows = df.select(F.col(key).cast("long").alias("id"), F.transform(vec, lambda x: x.cast("double")).alias("v"), *more, _known(vec).alias("kept"))
    return rows.where("kept").drop("kept")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), width)


def _first(rows: DataFrame, entries: int, parts: int) -> tuple[int, np.ndarray]:
    """The vectors' length (0 if it can't be cut), and the first vectors of that length."""
    order = F.col("id").asc_nulls_last(), F.col("v").asc()
    one = rows.orderBy(*order).limit(1).collect()
    width = len(one[0]["v"]) if one else 0
    if not width or width % parts:
        return 0, np.empty((0, 0))
    same = rows.where(F.size("v") == width).orderBy(*order).limit(entries).collect()  # a codebook's rows
    return width, np.array([r["v"] for r in same])


def _sums(rows: DataFrame, books: Codebooks) -> dict[tuple[int, int, int], int]:
    """{(part, entry, component; -1 counts): sum} over all rows' nearest entries."""
    width, parts, scale, tables = books.length, len(books.books), books.scale, books.books
    each = width // parts

    def run(batches):
        release()
        annuli = [Annuli(book) for book in tables]
        entries = len(tables[0])
        total = np.zeros((parts, entries, each), object)
        counts = np.zeros((parts, entries), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                x = integers(_matrix(batch.column(0).slice(at, STEP), width), scale).reshape(-1, parts, each)
                for p in range(parts):
                    entry, _ = annuli[p].nearest(x[:, p])
                    order = np.argsort(entry, kind="stable")
                    which, starts = np.unique(entry[order], return_index=True)
                    total[p, which] += np.add.reduceat(x[order, p], starts, axis=0).astype(object)
                    counts[p] += np.bincount(entry, minlength=entries)
        found = []
        for p, e in zip(*np.nonzero(counts)):
            found.append((p, e, -1, 0, int(counts[p, e])))
            for c, value in enumerate(total[p, e].tolist()):
                value, digit = int(value), 0
                while not -BASE < value < BASE:
                    value, low = divmod(value, BASE)
                    found.append((p, e, c, digit, low))
                    digit += 1
                found.append((p, e, c, digit, value))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["part", "entry", "component", "digit", "value"])

    cells = rows.select("v").where(F.size("v") == width).mapInArrow(run, "part long, entry long, component long, digit long, value long")
    cells = cells.groupBy("part", "entry", "component", "digit").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    out: dict[tuple[int, int, int], int] = {}
    for r in cells:
        at = r["part"], r["entry"], r["component"]
        out[at] = out.get(at, 0) + int(r["value"]) * BASE ** r["digit"]
    return out


def train(df: DataFrame, key: str = "vec_id", vec: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks after ``rounds`` of assigning every part of every row and replacing entries by their parts' floored means."""
    if min(parts, entries) < 1 or entries > 256:
        raise ValueError("parts and entries must be positive, entries at most 256")
    small_batches(df.sparkSession, STEP)
    rows = _kept(df, key, vec)
    width, first = _first(rows, entries, parts)
    if not width:
        return Codebooks([[] for _ in range(parts)], scale)
    start = integers(first, scale).reshape(len(first), parts, -1)
    books = Codebooks([[[int(x) for x in row] for row in start[:, p].tolist()] for p in range(parts)], scale)
    for _ in range(rounds):
        sums = _sums(rows, books)
        mean = lambda p, e, entry: [sums[p, e, c] // sums[p, e, -1] for c in range(len(entry))] if (p, e, -1) in sums else entry  # noqa: E731, B023
        books = Codebooks([[mean(p, e, entry) for e, entry in enumerate(book)] for p, book in enumerate(books.books)], scale)
    return books


def encode(df: DataFrame, books: Codebooks, key: str = "vec_id", vec: str = "embedding", label: str | None = None) -> DataFrame:
    """(id, code, error[, label]) of every kept row: code is binary, a byte for each part; error the summed squared distances."""
    width, scale, tables = books.length, books.scale, books.books
    more = [F.col(label).alias("label")] if label else []
    rows = _kept(df, key, vec, *more)
    kind = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name == "label"]

    def run(batches):
        release()
        annuli = [Annuli(book) for book in tables] if width else []
        for batch in batches:
            sizes = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            fit = np.flatnonzero(sizes == width) if width else np.empty(0, np.int64)
            codes, errors = np.zeros((len(fit), len(tables)), np.uint8), np.zeros(len(fit), object)
            own = batch.column("v").take(pa.array(fit))
            for at in range(0, len(fit), STEP):
                x = integers(_matrix(own.slice(at, STEP), width), scale).reshape(-1, len(tables), width // len(tables))
                for p, a in enumerate(annuli):
                    codes[at : at + len(x), p], least = a.nearest(x[:, p])
                    errors[at : at + len(x)] += least.astype(object)
            code, error = [None] * batch.num_rows, [None] * batch.num_rows
            for i, c, e in zip(fit.tolist(), codes, errors.tolist()):
                code[i], error[i] = c.tobytes(), e if e < 1 << 63 else None
            columns = [batch.column("id"), pa.array(code, pa.binary()), pa.array(error, pa.int64())] + ([batch.column("label")] if kind else [])
            yield pa.RecordBatch.from_arrays(columns, ["id", "code", "error"] + ["label"] * len(kind))

    small_batches(df.sparkSession, STEP)
    return rows.mapInArrow(run, ", ".join(["id long", "code binary", "error long", *kind]))


def decode(codes: DataFrame, books: Codebooks, code: str = "code") -> DataFrame:
    """``codes`` with ``vec``, the entries that a code names, divided by the scale; null where the code is."""
    tables = F.array(*[F.array(*[F.array(*[F.lit(float(x) / books.scale) for x in entry]) for entry in book]) for book in books.books])
    at = lambda p: F.conv(F.substring(F.hex(F.col(code)), 2 * p + 1, 2), 16, 10).cast("int")
    parts = F.array(*[F.get(tables[p], at(p)) for p in range(len(books.books))])
    return codes.withColumn("vec", F.when(F.col(code).isNotNull(), F.flatten(parts)))


def with_sums(rows: DataFrame, by: str, value: str, out: str) -> DataFrame:
    """``rows``, a stored table, with the sum of ``value`` over equal ``by``, nulls together; null beyond a long. Sums are
    broadcast if they are few, else those of the values of ``by`` that have a thousandth of all rows or more, of which there are
    a thousand at most; the others are joined by a shuffle that no single one of them can fill."""
    sums = stored(rows.groupBy(F.col(by).alias("_by")).agg(F.sum(F.col(value).cast("decimal(38,0)")).alias("_sum"), F.count(F.lit(1)).alias("_n")), "code-sums")
    sums = sums.select("_by", F.expr("try_cast(_sum as bigint)").alias(out), "_n", F.lit(True).alias("_met"))
    same = F.col(by).eqNullSafe(F.col("_by"))
    if sums.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(bounded_broadcast(sums), same, "left").drop("_by", "_n", "_met")
    bound = sums.agg(F.sum("_n")).first()[0] / 1000
    hot = rows.join(F.broadcast(sums.where(F.col("_n") >= bound)), same, "left")
    rest = hot.where("_met is null").drop("_by", "_n", "_met", out).join(sums.where(F.col("_n") < bound), same, "left")
    return hot.where("_met").unionByName(rest).drop("_by", "_n", "_met")


def compressed(df: DataFrame, key: str = "vec_id", vec: str = "embedding", label: str = "label") -> DataFrame:
    """(key, code as hexadecimal text, error, label_error, codebooks_sha256) of every kept row, by codebooks trained on all of them."""
    books = train(df, key, vec)
    rows = with_sums(stored(encode(df, books, key, vec, label), "code-rows"), "label", "error", "label_error")
    return rows.select(F.col("id").alias(key), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
