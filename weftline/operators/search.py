"""Passage search: every window of a target sequence is ranked against query vectors.

The target is one global sequence of tokens, coded by a join with its space, in blocks that overlap by the longest window
less one, so any block can be searched alone. A block multiplies the prefix sums of its vectors with all queries at once; a
window's product with a query, for any length, is then a difference of two numbers, and its norm comes from one pass a length.
A task goes through its blocks in order and keeps the best N of each query so far: a later window must beat the N-th, so few
are ever sorted, and only N a query and three sums leave a task. Tokens without a vector count as zero in sums and not at
all in the divisor.

Vectors reach the tasks as a stored table, which each Python worker reads once, if their bytes are at most MATRIX_BYTES; beyond
that each block gets the vectors of its own tokens by a join, of any number. The driver holds neither.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import dataset, fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from weftline.sources.shared import discard, free_shuffles, stored

#: Positions in a block.
BLOCK = 16_384
#: Similarities are ranked at this many decimals, ties by start.
DIGITS = 6
#: Bytes of vectors that every Python worker may hold, and blocks that a task searches one after the other at least.
MATRIX_BYTES, BLOCKS_A_TASK = 256 << 20, 16
#: Tasks of a scan a core at most: each task sends its best N, so many tasks would send much.
TASKS_A_CORE = 8


def search_length(n: Column, long_adjust: float, short_adjust: float, short_length: int) -> Column:
    """``n`` tokens of a query as tokens of the target: a double product, cut to an integer."""
    return F.when(n > short_length, (n * F.lit(1.0 + long_adjust)).cast("int")).otherwise((n * F.lit(1.0 + short_adjust)).cast("int"))


#: Tokens that a task remembers as seen.
SEEN = 1 << 19


def global_offsets(rows: DataFrame, key: str, size: str, words: str | None = None, dealt: bool = False) -> DataFrame:
    """``rows`` (key, size, ...), stored, with ``offset``: the sizes of all rows before, in order of key. Ranges of keys are
    summed apart while they are written; only one number a range passes the driver. ``dealt``: they lie in sorted ranges already.
    ``words``: a column of tokens; of these ``fresh`` gets what the task hasn't seen among its last, each token at least once."""

    def run(batches):
        part, total, seen = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            own = batch.column(batch.schema.get_field_index(size)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = total + np.cumsum(own)
            total = int(ends[-1]) if len(ends) else total
            more = {"_part": pa.array(np.full(len(own), part, np.int32)), "_before": pa.array(ends - own)}
            if words:
                new = pc.unique(batch.column(batch.schema.get_field_index(words)).flatten()).drop_null()
                new = new if seen is None else new.filter(pc.invert(pc.is_in(new, value_set=seen)))
                seen = new if seen is None else pa.concat_arrays([seen, new])
                seen = None if len(seen) > SEEN else seen
                more["fresh"] = pa.ListArray.from_arrays(pa.array(np.where(np.arange(len(own) + 1) > 0, len(new), 0), pa.int32()), new)
            yield pa.RecordBatch.from_arrays([*batch.columns, *more.values()], [*batch.schema.names, *more])

    schema = StructType([*rows.schema.fields, StructField("_part", IntegerType()), StructField("_before", LongType()), *([StructField("fresh", ArrayType(StringType()))] if words else [])])
    ranged = rows if dealt else rows.repartitionByRange(F.col(key)).sortWithinPartitions(key)
    ranged = stored(ranged.mapInArrow(run, schema), "search-ranges")
    if words:
        free_shuffles(rows.sparkSession)  # texts were dealt
    sums = {r["_part"]: r["n"] for r in ranged.groupBy("_part").agg(F.sum(size).alias("n")).collect()}
    before, total = {}, 0
    for part in sorted(sums):
        before[part] = total
        total += sums[part] or 0
    base = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("_part")] if before else F.lit(0)
    out = ranged.withColumn("offset", (base + F.col("_before")).cast("long")).drop("_part", "_before")
    out.stored_at = ranged.stored_at
    return out


def tokens_of(placed: DataFrame, words: str = "words") -> DataFrame:
    """(g, token): the global sequence of documents (offset, words)."""
    return placed.select("offset", F.posexplode(words).alias("pos", "token")).select((F.col("offset") + F.col("pos")).alias("g"), "token")


@dataclass(frozen=True)
class KeyedSpace:
    """A space in two tables, ``names`` (token, key) and ``vectors`` (key, vec), tokens and keys distinct: no vector is repeated for
    each token that has it."""

    names: DataFrame
    vectors: DataFrame


def space_table(space: DataFrame | KeyedSpace) -> DataFrame:
    """(token, vec)"""
    return space.names.join(space.vectors, "key").select("token", "vec") if isinstance(space, KeyedSpace) else space


def dense_codes(space: DataFrame | KeyedSpace) -> tuple[DataFrame, DataFrame]:
    """Stored (code, vec) of the distinct vectors of a space, numbered from 1 without gaps, and (token, code). The space is
    computed once: what follows reads it by hashes of vectors, or by its keys."""
    if isinstance(space, KeyedSpace):
        named = stored(space.names.where("key is not null"), "search-space")
        used = space.vectors.where("vec is not null").join(named.select("key").distinct(), "key", "left_semi")
        rows = used.select("key", F.transform("vec", lambda x: x.cast("double")).alias("vec"), F.lit(1).alias("_one"))
        codes = stored(global_offsets(rows, "key", "_one").select((F.col("offset") + 1).alias("code"), "vec", "key"), "search-vectors")
        out = codes.select("code", "vec")
        out.stored_at = codes.stored_at
        return out, named.join(codes.select("key", "code"), "key").select("token", "code")
    marked = space.where("vec is not null").select("token", F.transform("vec", lambda x: x.cast("double")).alias("vec")).withColumn("_h", F.xxhash64("vec"))
    marked = stored(marked.repartition("_h").sortWithinPartitions("_h"), "search-space")
    distinct = marked.select("_h", "vec").distinct().withColumn("_one", F.lit(1))
    vectors = stored(global_offsets(distinct, "_h", "_one").select((F.col("offset") + 1).alias("code"), "vec", "_h"), "search-vectors")
    n, hashes = vectors.agg(F.count(F.lit(1)), F.countDistinct("_h")).first()
    if n == hashes:
        names = marked.select("token", "_h").join(vectors.select("_h", "code"), "_h").select("token", "code")
    else:
        names = marked.join(vectors.withColumnRenamed("vec", "_v"), "_h").where(F.col("vec") == F.col("_v")).select("token", "code")
    out = vectors.select("code", "vec")
    out.stored_at = vectors.stored_at
    return out, names


def hashed_names(names: DataFrame, limit: int = MATRIX_BYTES) -> DataFrame | None:
    """Stored (hash, code) of ``names`` (token, code), which workers read to look tokens up by their 64-bit hashes; None where
    they are more than ``limit`` bytes or two of them share a hash, so that a join must do it."""
    rows = stored(names.select(F.xxhash64("token").alias("hash"), F.col("code").cast("int").alias("code")), "search-names")
    n, hashes = rows.agg(F.count(F.lit(1)), F.countDistinct("hash")).first()
    out = stored(rows.repartitionByRange("hash").sortWithinPartitions("hash"), "search-names") if n == hashes and 12 * n <= limit else None
    discard(rows)
    return out


@dataclass(frozen=True)
class Book:
    """Where workers find a space: its ``dense_codes`` (n of them) and its ``hashed_names``."""

    vectors: str
    n: int
    dims: int
    names: str

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        return codes_of(hashes, self.names)

    def matrix(self, beside: Book | None = None) -> np.ndarray:
        return _matrix(self.vectors, self.n, self.dims, beside.vectors if beside else None)


def book(space: DataFrame | KeyedSpace, dims: int | None = None, limit: int = MATRIX_BYTES) -> Book | None:
    """The tables of a space, stored; None where a worker shouldn't hold them, so that joins must do it."""
    codes, names = dense_codes(space)
    n = codes.count()
    if dims is None:
        first = codes.select(F.size("vec").alias("n")).first()
        dims = first["n"] if first else 1
    hashed = hashed_names(names, limit) if (n + 1) * dims * 8 <= limit else None
    return None if hashed is None else Book(codes.stored_at, n, dims, hashed.stored_at)


#: The names that this worker read last, by their path.
_NAMES: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def codes_of(hashes: np.ndarray, path: str) -> np.ndarray:
    """The codes of tokens by the stored ``hashed_names`` at ``path``; 0 where a token has none."""
    if path not in _NAMES:
        _NAMES.clear()
        store, at = fs.FileSystem.from_uri(path)
        table = dataset.dataset(at, filesystem=store, format="parquet", schema=pa.schema([("hash", pa.int64()), ("code", pa.int32())]))
        keys, codes, n = np.empty(table.count_rows(), np.int64), np.empty(table.count_rows(), np.int32), 0
        for batch in table.to_batches(batch_size=1 << 16, batch_readahead=1, fragment_readahead=1, use_threads=False):
            keys[n : n + len(batch)], codes[n : n + len(batch)] = batch.column("hash").to_numpy(), batch.column("code").to_numpy()
            n += len(batch)
        if np.any(keys[1:] < keys[:-1]):
            order = np.argsort(keys)
            keys, codes = keys[order], codes[order]
        _NAMES[path] = keys, codes
    keys, codes = _NAMES[path]
    if not len(keys):
        return np.zeros(len(hashes), np.int32)
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    return np.where(keys[at] == hashes, codes[at], 0).astype(np.int32)


def packed(placed: DataFrame, names: DataFrame, halo: int, block: int = BLOCK, words: str = "words") -> DataFrame:
    """(block, g, codes): what ``blocks`` deals, as runs of codes from position ``g`` on, from documents (offset, words) and
    ``hashed_names``."""
    path = names.stored_at

    def run(batches):
        for batch in batches:
            codes = codes_of(batch.column("hashes").flatten().to_numpy(), path)
            ends = np.cumsum(batch.column("n").to_numpy())
            own, at, runs = [], [], []
            for offset, lo, hi in zip(batch.column("offset").to_pylist(), [0, *ends[:-1].tolist()], ends.tolist()):
                for b in range(max(offset - halo, 0) // block, (offset + hi - lo - 1) // block + 1):
                    first, last = max(offset, b * block), min(offset + hi - lo, (b + 1) * block + halo)
                    if first < last:
                        own.append(b)
                        at.append(first)
                        runs.append(codes[lo + first - offset : lo + last - offset])
            bounds = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(runs) if runs else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(at, pa.int64()), lists], ["block", "g", "codes"])

    rows = placed.where(F.size(words) > 0).select("offset", F.size(words).alias("n"), F.transform(words, lambda w: F.xxhash64(w)).alias("hashes"))
    return rows.mapInArrow(run, "block long, g long, codes array<int>")


def blocks(coded: DataFrame, halo: int, block: int = BLOCK) -> DataFrame:
    """(block, g, code): positions (g, code) dealt to the block they lie in and to those whose ``halo`` behind them they are in."""
    first, last = F.floor(F.greatest(F.col("g") - halo, F.lit(0)) / block), F.floor(F.col("g") / block)
    return coded.select(F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("block"), "g", F.coalesce("code", F.lit(0)).cast("long").alias("code"))


def located(placed: DataFrame, phrases: dict[int, list[str]], words: str = "words") -> DataFrame:
    """(query_id, gold_start): the first place in the whole sequence where a phrase's words follow one another. ``placed``
    has documents (offset, size, words); ``phrases`` is the query set.

    Documents are gone through once, in pairs of neighbours, also across documents; only those that a phrase has stay. A phrase's
    rarest pair gives its candidates, and these are checked pair by pair, by a join on positions.
    """
    spark = placed.sparkSession
    phrases = {k: w for k, w in phrases.items() if w}
    rows = placed.where("size > 0").select("offset", "size", F.col(words).alias("words"))
    out = spark.createDataFrame([], "query_id long, gold_start long")
    if single := [(k, w[0]) for k, w in phrases.items() if len(w) == 1]:
        own = F.broadcast(spark.createDataFrame(single, "query_id long, token string"))
        out = tokens_of(rows).join(own, "token").groupBy("query_id").agg(F.min("g").alias("gold_start"))
    steps = [(k, i, a, b, len(w) - 1) for k, w in phrases.items() for i, (a, b) in enumerate(zip(w, w[1:]))]
    if not steps:
        return out
    number = {p: i for i, p in enumerate(sorted({(a, b) for _, _, a, b, _ in steps}))}
    whole = F.broadcast(spark.createDataFrame([(k, i, number[a, b], n) for k, i, a, b, n in steps], "query_id long, at int, pair int, n int"))
    vocabulary = sorted({w for p in number for w in p})
    place = {w: i for i, w in enumerate(vocabulary)}
    keys = np.array([place[a] * len(vocabulary) + place[b] for a, b in number], np.int64)  # in order: words are sorted, and so are pairs

    def run(batches):
        known = pa.array(vocabulary, pa.string())
        for batch in batches:
            lists = batch.column("words")
            code = pc.index_in(lists.flatten(), value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            both = (code[:-1] >= 0) & (code[1:] >= 0)
            both[ends[:-1] - 1] = False
            at = np.flatnonzero(both)
            key = code[at] * len(vocabulary) + code[at + 1]
            pair = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            at, pair = at[keys[pair] == key], pair[keys[pair] == key]
            g = (batch.column("offset").to_numpy() - ends + sizes)[np.searchsorted(ends, at, side="right")] + at
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(pair, pa.int32())], ["g", "pair"])

    ends = placed.where("size > 0").select("offset", "size", *("head", "tail") if "head" in placed.columns else (F.get(words, F.lit(0)).alias("head"), F.element_at(words, -1).alias("tail")))
    heads = ends.select(F.col("offset").alias("end"), "head")
    across = ends.select((F.col("offset") + F.col("size")).alias("end"), "tail").join(heads, "end").select((F.col("end") - 1).alias("offset"), F.array("tail", "head").alias("words"))
    seen = stored(rows.select("offset", "words").unionByName(across).mapInArrow(run, "g long, pair int"), "search-seen")
    counts = seen.groupBy("pair").agg(F.count(F.lit(1)).alias("c"))
    rare = whole.join(counts, "pair").groupBy("query_id").agg(F.min_by(F.struct("at", "pair"), F.struct("c", "at")).alias("r"), F.count(F.lit(1)).alias("have"), F.first("n").alias("n"))
    rare = rare.where("have = n").select("query_id", "r.*")  # one row a query; without one of its pairs a phrase is nowhere
    starts = seen.join(F.broadcast(rare), "pair").select("query_id", (F.col("g") - F.col("at")).alias("start")).where("start >= 0")
    asked = starts.join(whole, "query_id").select("query_id", "start", (F.col("start") + F.col("at")).alias("g"), "pair", "n")
    full = asked.join(seen, ["g", "pair"]).groupBy("query_id", "start", "n").agg(F.count(F.lit(1)).alias("k")).where("k = n")
    return out.unionByName(full.groupBy("query_id").agg(F.min("start").alias("gold_start")))


SCAN = "variant int, query_id long, kind string, start long, similarity double, n long, total double, squares double"


def _best(similarity: np.ndarray, start: np.ndarray, top_n: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``top_n`` largest with their starts, ties by start."""
    if top_n < len(similarity):
        floor = np.partition(similarity, len(similarity) - top_n)[len(similarity) - top_n]
        keep = similarity >= floor
        similarity, start = similarity[keep], start[keep]
    order = np.lexsort((start, -similarity))[:top_n]
    return similarity[order], start[order]


#: Queries that are multiplied at once, positions of a square of products, squares held, sizes up to which squares are made, and
#: how many products of a square cost one of two rows.
AT_ONCE, SIDE, SQUARES, WIDEST, FEW = 64, 64, 32, 512, 8
#: Positions of a block whose sums are held at once, at least.
PIECE = 8192
#: Neighbouring windows that are judged by one of them, sizes from which they are, and the share of groups that may be left to look at.
GROUP, GROUPED_FROM, LEFT = 4, 64, 1 / 3
#: After so many pieces a query whose groups were looked at in vain is judged by groups again.
PAUSE = 4
#: The share of windows up to which those that single precision leaves are looked at one by one.
FEW_LEFT = 1 / 8
#: Of a long sequence every so manieth block is searched first, from so many blocks on: no hit of the whole is less than the
#: N-th of a part.
FIRST, FIRST_FROM = 64, 256


def _sums(vectors: np.ndarray, run: int = 16) -> np.ndarray:
    """Sums of all rows before each row, and of all: in runs side by side, then across runs."""
    n, dims = vectors.shape
    out = np.zeros((-(-n // run) * run + 1, dims))
    out[1 : n + 1] = vectors
    runs = out[1:].reshape(-1, run, dims)
    for k in range(1, run):
        runs[:, k] += runs[:, k - 1]
    runs[1:] += np.cumsum(runs[:-1, -1], axis=0)[:, None]
    return out[: n + 1]


def _lagged(prefix: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    """For each of ``sizes`` the product of each row with the row so many behind it. Squares of products of neighbouring rows
    hold them on their diagonals, so rows are read once for all sizes, unless these are so few that most products would be
    for nothing."""
    out = {k: np.empty(max(len(prefix) - k, 0)) for k in sizes}
    near = [k for k in sizes if k <= WIDEST]
    if len(near) * FEW < SIDE + max(near, default=0):
        near = []
    for k in set(sizes) - set(near):
        for lo in range(0, len(out[k]), 1024):
            hi = min(lo + 1024, len(out[k]))
            out[k][lo:hi] = np.einsum("ij,ij->i", prefix[lo + k : hi + k], prefix[lo:hi])
    if not near:
        return out
    reach, n = max(near), -(-len(prefix) // SIDE)
    padded = np.zeros((n * SIDE + reach, prefix.shape[1]))
    padded[: len(prefix)] = prefix
    step, item = padded.strides
    for lo in range(0, n, SQUARES):
        m = min(SQUARES, n - lo)
        rows = padded[lo * SIDE :]
        wide = np.lib.stride_tricks.as_strided(rows, (m, SIDE + reach, prefix.shape[1]), (SIDE * step, step, item), writeable=False)
        square = wide @ rows[: m * SIDE].reshape(m, SIDE, -1).transpose(0, 2, 1)
        for k in near:
            begin, end = lo * SIDE, min((lo + m) * SIDE, len(out[k]))
            if begin < end:
                out[k][begin:end] = square[:, k : k + SIDE].diagonal(axis1=1, axis2=2).ravel()[: end - begin]
    return out


def _norms(prefix: np.ndarray, sizes: list[int]) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """For each of ``sizes`` the squared lengths of windows in single precision, and how far they may be off at each position.
    Sums are taken from the first of SIDE positions, so they are small."""
    n, dims = -(-len(prefix) // SIDE), prefix.shape[1]
    out, off = {k: np.empty(n * SIDE, np.float32) for k in sizes}, np.zeros(n * SIDE)
    near = [k for k in sizes if k <= WIDEST]
    if len(near) * FEW < SIDE + max(near, default=0):
        near = []
    for k in set(sizes) - set(near):
        for lo in range(0, len(prefix) - k, 1024):
            gap = prefix[lo + k : lo + k + 1024] - prefix[lo : min(lo + 1024, len(prefix) - k)]
            out[k][lo : lo + len(gap)] = np.einsum("ij,ij->i", gap, gap)
    if not near:
        return out, off
    reach = max(near)
    padded = np.empty((n * SIDE + reach, dims))
    padded[: len(prefix)], padded[len(prefix) :] = prefix, prefix[-1]
    step, item = padded.strides
    for lo in range(0, n, SQUARES):
        m = min(SQUARES, n - lo)
        rows = np.lib.stride_tricks.as_strided(padded[lo * SIDE :], (m, SIDE + reach, dims), (SIDE * step, step, item), writeable=False)
        rows = (rows - rows[:, :1]).astype(np.float32)
        lengths = np.einsum("bij,bij->bi", rows, rows)
        square = rows @ rows[:, :SIDE].transpose(0, 2, 1)
        square *= -2
        square += lengths[:, :, None]
        square += lengths[:, None, :SIDE]
        at = slice(lo * SIDE, (lo + m) * SIDE)
        off[at] = np.repeat(4 * (dims + 8) * 2.0**-24 * lengths.max(axis=1), SIDE)
        for k in near:
            out[k][at] = square[:, k : k + SIDE].diagonal(axis1=1, axis2=2).ravel()
    return out, off


class Finder:
    """What a task finds in its blocks, which come in order. ``stats``: sums over all windows, or "count", how many there are."""

    def __init__(self, queries: pd.DataFrame, length: int, block: int, metric: str, only_gold: bool, stats: bool | str):
        self.length, self.block, self.metric, self.only_gold = length, block, metric, only_gold
        self.counted, self.stats = stats == "count", stats is True
        alike: dict[tuple, list] = {}  # variants that differ in their top_n only look at the same windows
        for r in queries.itertuples():
            alike.setdefault((r.vector.tobytes(), int(r.search_len), int(r.gold_start), r.gold_similarity if np.isfinite(r.gold_similarity) else None), []).append(r)
        self.members = [sorted(rows, key=lambda r: -r.top_n) for rows in alike.values()]
        self.rows = [rows[0] for rows in self.members]
        self.windows = dict.fromkeys((int(r.search_len) for r in self.rows), 0)
        distinct = {r.vector.tobytes(): r.vector for r in self.rows}  # variants share vectors
        self.place = {k: i for i, k in enumerate(distinct)}
        self.vectors = np.stack(list(distinct.values())) if distinct else np.zeros((0, 1))
        self.norms = np.linalg.norm(self.vectors, axis=1)
        self.reach = max([0, *(int(r.search_len) for r in self.rows)])
        self.of = [self.place[r.vector.tobytes()] for r in self.rows]
        self.best = {i: (np.empty(0), np.empty(0, np.int64)) for i, r in enumerate(self.rows) if r.top_n}
        self.floor = [float(r.floor) for r in self.rows] if "floor" in queries else [-np.inf] * len(self.rows)
        self.sums = {i: [0, 0.0, 0.0] for i in range(len(self.rows))}
        self.before = {i: 0 for i, r in enumerate(self.rows) if r.gold_start >= 0 and np.isfinite(r.gold_similarity)}
        self.gold: list[tuple] = []
        self.pause = dict.fromkeys(self.best, 0)
        self.waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {i: [] for i in self.best}

    def _least(self, i: int) -> float:
        """What a window of a query must have to be among its best."""
        similarity = self.best[i][0]
        return max(float(similarity[-1]), self.floor[i]) if len(similarity) >= self.rows[i].top_n else self.floor[i]

    def _keep(self, i: int, similarity: np.ndarray, start: np.ndarray) -> None:
        """New windows of a query wait until they are as many as its best, so these are seldom sorted."""
        self.waiting[i].append((similarity, start))
        have, more, most = len(self.best[i][0]), sum(len(s) for s, _ in self.waiting[i]), self.rows[i].top_n
        if more >= most or have < most <= have + more:
            self._merge(i)

    def _merge(self, i: int) -> None:
        if self.waiting[i]:
            similarity, start = (np.concatenate(x) for x in zip(self.best[i], *self.waiting[i]))
            self.best[i], self.waiting[i] = _best(similarity, start, int(self.rows[i].top_n)), []

    def _cut(self, i: int) -> float:
        """What a window of a query must have to be among its best or to rank before its gold passage."""
        return min(self._least(i) if i in self.best else np.inf, float(self.rows[i].gold_similarity) if i in self.before else np.inf)

    def _grouped(self, i: int) -> bool:
        """Whether a query's windows may be judged by groups."""
        return self.metric == "cosine" and not (self.only_gold or self.stats or self.counted) and self.rows[i].search_len >= GROUPED_FROM and np.inf > self._cut(i) > 0.01

    def add(self, block: int, begin: int, vectors: np.ndarray, known: np.ndarray) -> None:
        """A block's tokens from position ``begin`` on: their vectors, zeros where they have none, and which have one. They are gone
        through in pieces that stay in a core's cache."""
        if self.only_gold:
            for i, r in enumerate(self.rows):
                if block * self.block <= r.gold_start < block * self.block + self.block:
                    self._at_gold(i, int(r.gold_start) - begin, vectors, known)
            return
        step = max(PIECE, 4 * self.reach)
        for lo in range(0, min(len(vectors), int(block) * self.block + self.block - begin), step):
            piece = slice(lo, lo + step + self.reach)
            self._piece(min(step, int(block) * self.block + self.block - begin - lo), begin + lo, vectors[piece], known[piece])

    def _at_gold(self, i: int, at: int, vectors: np.ndarray, known: np.ndarray) -> None:
        """The window at a query's gold passage."""
        r, query, size = self.rows[i], self.vectors[self.of[i]], int(self.rows[i].search_len)
        own, many = vectors[at : at + size], int(known[at : at + size].sum())
        if size < 1 or at < 0 or at + size > len(vectors) or not many:
            return
        total = own.sum(axis=0)
        if self.metric == "cosine":
            norm, length = np.linalg.norm(total), self.norms[self.of[i]]
            if not length or norm <= 1e-9 * np.sqrt(np.einsum("ij,ij->", own, own)):
                return
            s = total @ query / (norm * length)
        else:
            s = 1 - np.linalg.norm(total / many - query)
        s = float(np.rint(s * 10.0**DIGITS) / 10.0**DIGITS)
        self.gold += [(int(m.variant), int(m.query_id), "gold", int(r.gold_start), s, 1, None, None) for m in self.members[i]]

    def _singly(self, sizes: dict[int, list[int]], starts: int, begin: int, prefix: np.ndarray, squares: np.ndarray, counts: np.ndarray, queries: np.ndarray) -> dict[int, list[int]]:
        """Counts windows, looks at queries of which few windows can be hits, and returns the others, whose every window must be
        looked at.

        Products and lengths in single precision are off by less than a bound that follows from the sums' lengths; only windows
        that it doesn't rule out are looked at in double precision.
        """
        rest: dict[int, list[int]] = {}
        asked = []
        sure = 1e-20 < squares.max() < 1e30  # of what single precision can hold
        for size, members in sizes.items():
            for i in members:
                cut = self._cut(i)
                if cut > 0.01 and sure:
                    asked.append((size, i, cut - 2 * 10.0**-DIGITS))
                else:
                    rest.setdefault(size, []).append(i)
        wanted = sorted(sizes if self.counted else {size for size, _, _ in asked})
        if not wanted:
            return rest
        norms, off = _norms(prefix, wanted) if sure else ({}, None)
        low: dict[int, np.ndarray] = {}
        for size in wanted:
            n = min(starts, len(prefix) - size, self.length - size + 1 - begin)
            if self.counted:
                some = counts[size : size + n] > counts[:n]
                unsure = np.flatnonzero(some & ~(norms[size][:n] > 2 * off[:n] + 1e-12 * squares[size : size + n])) if sure else np.flatnonzero(some)
                self.windows[size] += int(np.count_nonzero(some)) - len(unsure) + len(self._sums_at(unsure, size, prefix, squares, counts)[0])
            if sure:
                low[size] = np.sqrt(np.maximum(norms[size][:n] - off[:n], 0)).astype(np.float32)
        asked = sorted((self.of[i], size, i, cut) for size, i, cut in asked if cut < np.inf)
        if not asked:
            return rest
        used = sorted({k for k, *_ in asked})
        row = {k: at for at, k in enumerate(used)}
        single, products = prefix.astype(np.float32), queries[used].astype(np.float32)
        slack = np.float32(4 * (prefix.shape[1] + 8) * 2.0**-24 * np.sqrt(squares.max()))
        first = last = 0
        bounds, gaps, marks = np.empty(starts, np.float32), np.empty(starts, np.float32), np.empty(starts, bool)
        for k, size, i, cut in asked:
            if row[k] >= last:
                first, last = row[k], row[k] + AT_ONCE // 2
                held = products[first:last] @ single.T
            n, product = len(low[size]), held[row[k] - first]
            bound, gap, mark = bounds[:n], gaps[:n], marks[:n]
            np.multiply(low[size], np.float32(cut * (1 - 1e-6)), out=bound)
            np.subtract(bound, slack, out=bound)
            np.subtract(product[size : size + n], product[:n], out=gap)
            left = np.count_nonzero(np.greater(gap, bound, out=mark))
            if left > FEW_LEFT * n:
                rest.setdefault(size, []).append(i)
            elif left:
                at = np.flatnonzero(mark)
                at, sums, norm = self._sums_at(at, size, prefix, squares, counts)
                if len(at):
                    self._row(i, (sums @ queries[self.of[i]]) / norm, begin, at)
        return rest

    def _sums_at(self, at: np.ndarray, size: int, prefix: np.ndarray, squares: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows at ``at`` those that have a direction, their sums and the lengths of these."""
        sums = np.take(prefix, at + size, axis=0)
        sums -= np.take(prefix, at, axis=0)
        norm = np.sqrt(np.einsum("ij,ij->i", sums, sums))
        ok = (counts[at + size] > counts[at]) & (norm > 1e-9 * np.sqrt(squares[at + size] + 1e-30))
        return (at, sums, norm) if ok.all() else (at[ok], sums[ok], norm[ok])

    def _piece(self, starts: int, begin: int, vectors: np.ndarray, known: np.ndarray) -> None:
        """The windows at the first ``starts`` positions."""
        cosine = self.metric == "cosine"
        counts = np.concatenate([[0], np.cumsum(known)])
        queries = self.vectors
        if cosine:
            queries = np.divide(queries, self.norms[:, None], out=np.zeros_like(queries), where=self.norms[:, None] > 0)
        elif counts[-1]:  # distances are the same from any origin, and sums smaller from the middle
            middle = vectors.sum(axis=0) / counts[-1]
            vectors, queries = np.where(known[:, None], vectors - middle, 0.0), queries - middle
        prefix = _sums(vectors)
        squares = np.einsum("ij,ij->i", prefix, prefix)
        lengths = np.einsum("ij,ij->i", queries, queries)
        sizes: dict[int, list[int]] = {}
        for i, r in enumerate(self.rows):
            n = min(starts, len(vectors) - int(r.search_len) + 1, self.length - int(r.search_len) + 1 - begin)
            if r.search_len >= 1 and n >= 1 and not (cosine and not self.norms[self.of[i]]):
                sizes.setdefault(int(r.search_len), []).append(i)
        if cosine:
            sizes = self._by_groups(sizes, starts, begin, prefix, squares, counts, queries)
            if not self.stats and sizes and (self.counted or 1e-20 < squares.max() < 1e30):
                sizes = self._singly(sizes, starts, begin, prefix, squares, counts, queries)
        across = _lagged(prefix, list(sizes))
        asked = [i for members in sizes.values() for i in members]
        held, at_held = np.empty((0, 0)), 0
        for at_row, i in enumerate(asked):
            size = int(self.rows[i].search_len)
            if not at_row or size != int(self.rows[asked[at_row - 1]].search_len):
                n = min(starts, len(vectors) - size + 1, self.length - size + 1 - begin)
                many = counts[size : size + n] - counts[:n]
                norm = np.sqrt(np.maximum(squares[size : size + n] + squares[:n] - 2 * across[size][:n], 0))
                ok = many > 0
                if cosine:
                    ok &= norm > 1e-9 * np.sqrt(squares[size : size + n] + 1e-30)
                whole = ok.all()
                at = None if whole else np.flatnonzero(ok)
                many, norm = (many, norm) if whole else (many[at], norm[at])
                inverse = None if not cosine else 1 / norm
                twice, own = (None, None) if cosine else (-2 / many, (norm / many) ** 2)
                doubt = None if cosine else (1e8 * 2e-15 * squares.max() / many**2) ** 2  # of a square, where its root isn't sure
            if at_row % AT_ONCE == 0:
                held, at_held = queries[[self.of[k] for k in asked[at_row : at_row + AT_ONCE]]] @ prefix.T, at_row
            if not len(norm):
                continue
            product = held[at_row - at_held]
            s = product[size : size + n] - product[:n]
            s = s if whole else s[at]
            if cosine:
                s *= inverse
            else:
                square = s * twice
                square += own
                square += lengths[self.of[i]]
                np.maximum(square, 0, out=square)
                for k in np.flatnonzero(square < doubt) if len(square) and square.min() < doubt.max() else ():
                    place = k if whole else at[k]
                    gap = vectors[place : place + size].sum(axis=0) / many[k] - queries[self.of[i]]
                    square[k] = gap @ gap
                s = np.subtract(1, np.sqrt(square, out=square), out=square)
            self._row(i, s, begin, at)

    def _by_groups(self, sizes: dict[int, list[int]], starts: int, begin: int, prefix: np.ndarray, lengths: np.ndarray, counts: np.ndarray, queries: np.ndarray) -> dict[int, list[int]]:
        """Looks at queries whose least hit is so good that most groups of GROUP neighbouring windows can't have one, and returns
        the others, whose every window must be looked at.

        A group's windows differ from its middle one, w, by at most r in length; so their angles to w are at most asin(r / |w|),
        and where one has a cosine above t, w has one above cos(acos(t) + asin(r / |w|)).
        """
        rest: dict[int, list[int]] = {}
        asked = []
        for size, members in sizes.items():
            for i in members:
                if not self._grouped(i):
                    rest.setdefault(size, []).append(i)
                elif self.pause[i]:
                    self.pause[i] -= 1
                    rest.setdefault(size, []).append(i)
                else:
                    asked.append((size, i))
        if not asked:
            return rest
        half, last = GROUP // 2, len(prefix) - 1
        middle = np.arange(half, last + 3 * GROUP, GROUP)  # sums stay the same behind the end
        grid = np.take(prefix, np.minimum(middle, last), axis=0)
        squares = np.einsum("ij,ij->i", grid, grid)
        away = {j: np.linalg.norm(np.take(prefix, np.clip(middle + j, 0, last), axis=0) - grid, axis=1) for j in range(-2 * half, 2 * half)}
        across = _lagged(grid, sorted({(size + half) // GROUP for size, _ in asked}))
        held = queries[[self.of[i] for _, i in asked]] @ grid.T
        done = None
        for row, (size, i) in enumerate(asked):
            if size != done:
                done, lag = size, (size + half) // GROUP
                n = min(starts, len(prefix) - size, self.length - size + 1 - begin)
                m, more = -(-n // GROUP), size - lag * GROUP
                square = squares[lag : lag + m] + squares[:m] - 2 * across[lag][:m]
                radius = reduce(np.maximum, (away[j][:m] + away[j + more][lag : lag + m] for j in range(-half, half)))
                side = square - radius**2
                unsure = (side < 1e-3 * square) | (square < 1e-9 * squares.max())
                side = np.sqrt(np.where(unsure, 0, side))
                radius[unsure] = np.inf
            least = self._cut(i) - 2 * 10.0**-DIGITS
            bound = side * least
            bound -= radius * np.sqrt(max(1 - least * least, 1e-6))
            groups = np.flatnonzero(held[row, lag : lag + m] - held[row, :m] > bound)
            if len(groups) > LEFT * m:
                self.pause[i] = PAUSE
                rest.setdefault(size, []).append(i)
            elif len(groups):
                at = (groups[:, None] * GROUP + np.arange(GROUP)).ravel()
                at, sums, norm = self._sums_at(at[at < n], size, prefix, lengths, counts)
                if len(at):
                    self._row(i, (sums @ queries[self.of[i]]) / norm, begin, at)
        return rest

    def _row(self, i: int, s: np.ndarray, begin: int, at: np.ndarray | None) -> None:
        """``s``: the similarities of a query's windows, to be rounded; ``at``: their places after ``begin``, all of them if None."""
        r = self.rows[i]
        if not (self.stats or i in self.before):  # few can be among the best, and only these are rounded
            if i in self.best:
                near = np.flatnonzero(s > self._least(i) - 10.0**-DIGITS)
                if len(near):
                    self._keep(i, np.round(s[near], DIGITS), begin + (near if at is None else at[near]))
            return
        unit = 10.0**DIGITS
        s *= unit
        s = np.rint(s, out=s)  # whole numbers of the last digit, so sums are exact
        if self.stats:
            total = self.sums[i]
            total[0] += len(s)
            total[1] += float(s.sum()) / unit
            total[2] += float(s @ s) / unit**2
        cut = np.rint(self._cut(i) * unit)
        if not len(s) or not s.max() >= cut:
            return
        if not np.isinf(cut):  # few can be among the best or rank before a gold passage
            near = np.flatnonzero(s >= cut)
            s, at = s[near], near if at is None else at[near]
        start = lambda k: begin + (k if at is None else at[k])
        if i in self.best:
            similarity, _ = self.best[i]
            full = len(similarity) >= r.top_n  # later windows lose ties
            new = np.flatnonzero(s > np.rint(similarity[-1] * unit)) if full else np.arange(len(s))
            new = new if np.isinf(self.floor[i]) else new[s[new] >= np.rint(self.floor[i] * unit)]
            if len(new):
                self._keep(i, s[new] / unit, start(new))
        if i in self.before:
            gold = np.rint(r.gold_similarity * unit)
            equal = np.flatnonzero(s == gold)
            self.before[i] += int(np.count_nonzero(s > gold)) + int(np.count_nonzero(start(equal) < r.gold_start))

    def found(self) -> list[tuple]:
        """Rows of SCAN."""
        out = list(self.gold)
        if self.only_gold:
            return out
        for i in self.best:
            self._merge(i)
        for i, members in enumerate(self.members):
            hits = list(zip(*(v.tolist() for v in self.best[i]))) if i in self.best else []
            for r in members:
                ids = int(r.variant), int(r.query_id)
                out += [(*ids, "hit", k, x, 1, None, None) for x, k in hits[: int(r.top_n)]]
                if self.stats:
                    out.append((*ids, "stat", -1, None, *self.sums[i]))
                elif self.counted and self.norms[self.of[i]]:
                    out.append((*ids, "stat", -1, None, self.windows[int(r.search_len)], None, None))
                if i in self.before:
                    out.append((*ids, "before", -1, None, self.before[i], None, None))
        return out


def _found(rows: list[tuple]) -> pa.Table:
    kinds = pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64()
    columns = zip(*rows) if rows else [[]] * len(kinds)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in SCAN.split(", ")])


#: The matrix that this worker read last, by its path.
_HELD: dict[str, np.ndarray] = {}


def _matrix(path: str, n: int, dims: int, beside: str | None = None, small: bool = False) -> np.ndarray:
    """A stored table (code, vec) as a matrix whose row 0 is zeros. ``beside``: another one that stays. ``small``: of half the size,
    where no number needs more."""
    if path not in _HELD or (not small and _HELD[path].dtype != np.float64):
        for other in set(_HELD) - {beside}:
            del _HELD[other]
        store, at = fs.FileSystem.from_uri(path)
        matrix = np.zeros((n + 1, dims), np.float32 if small else np.float64)
        for batch in dataset.dataset(at, filesystem=store, format="parquet").to_batches(columns=["code", "vec"], batch_size=8192, batch_readahead=1, fragment_readahead=1, use_threads=False):
            rows = np.asarray(batch.column("vec").flatten(), np.float64).reshape(batch.num_rows, dims)
            if matrix.dtype == np.float32 and not np.array_equal(rows, rows.astype(np.float32), equal_nan=True):
                matrix = matrix.astype(np.float64)
            matrix[batch.column("code").to_numpy()] = rows
        _HELD[path] = matrix
    return _HELD[path]


def _runs(batches) -> Iterator[tuple[int, int, np.ndarray]]:
    """(block, first position, codes) of the rows of ``packed`` that are sorted by block and g."""
    kept: list[np.ndarray] = []
    block = begin = None
    for batch in batches:
        codes, sizes = batch.column(2).flatten().to_numpy(), batch.column(2).value_lengths().to_numpy()
        ends = np.cumsum(sizes)
        own, at = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if kept and own[a] != block:
                yield block, begin, np.concatenate(kept)
                kept = []
            if not kept:
                block, begin = int(own[a]), int(at[a])
            kept.append(codes[ends[a] - sizes[a] : ends[b - 1]])
    if kept:
        yield block, begin, np.concatenate(kept)


def _by_block(batches) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(block, g, code) of rows that are sorted by block and g."""
    kept: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        own = tuple(c.to_numpy() for c in batch.columns)
        cuts = [0, *(np.flatnonzero(np.diff(own[0])) + 1).tolist(), len(own[0])]
        for a, b in zip(cuts, cuts[1:]):
            if kept and a < b and kept[-1][0][-1] != own[0][a]:
                yield int(kept[0][0][0]), *(np.concatenate([k[c] for k in kept]) for c in (1, 2))
                kept = []
            if a < b:
                kept.append(tuple(c[a:b] for c in own))
    if kept:
        yield int(kept[0][0][0]), *(np.concatenate([k[c] for k in kept]) for c in (1, 2))


def floors(found: DataFrame, queries: pd.DataFrame) -> list[float]:
    """For each of ``queries`` the similarity of its N-th best hit in rows of a ``scan``, -inf where it has fewer; a number a
    query passes the driver."""
    best = F.sort_array(F.collect_list("similarity"), asc=False)
    sizes = sorted({int(n) for n in queries["top_n"] if n > 0})
    rows = found.where("kind = 'hit'").groupBy("variant", "query_id").agg(best.alias("s")).select("variant", "query_id", *(F.get("s", F.lit(n - 1)).alias(f"_{n}") for n in sizes)).collect()
    least = {(r["variant"], r["query_id"], n): r[f"_{n}"] for r in rows for n in sizes if r[f"_{n}"] is not None}
    return [least.get(k, -np.inf) for k in zip(queries["variant"], queries["query_id"], queries["top_n"])]


def scan(pieces: DataFrame, vectors: DataFrame, queries: pd.DataFrame, length: int, block: int = BLOCK, metric: str = "cosine", only_gold: bool = False, stats: bool | str = True, matrix_bytes: int = MATRIX_BYTES, share: int = 1) -> DataFrame:
    """Per task, variant and query: the best ``top_n`` hits (kind hit), sums over all windows (stat), and, where a query has
    gold_similarity and gold_start, how many windows rank before that place (before). With ``only_gold`` nothing but
    the similarity of the windows at gold_start (gold). ``stats`` "count" leaves out all sums but the number of windows, and then,
    as without ``stats``, windows that single precision rules out aren't looked at. ``share``: of so many blocks ``pieces`` has one.

    ``pieces``: rows of ``blocks`` or of ``packed``. ``vectors``: stored (code, vec) of ``dense_codes``; code 0 has no vector. ``queries``: variant,
    query_id, vector, search_len, top_n, gold_start, gold_similarity; variants are runs with other parameters, which share the
    pass. It travels with the tasks, so it is a part of a query set of checked size. ``length`` is the length of the whole
    sequence; of a long one every FIRST-th block is searched first, and what is less than its N-th best isn't looked at. Similarity is one less the distance, cosine or euclidean, between a query's vector and a window's mean.
    """
    if metric not in ("cosine", "euclidean"):
        raise ValueError(f"{metric} not known")
    dims = len(queries["vector"].iloc[0]) if len(queries) else 1
    n = vectors.count()
    last = -(-length // block)
    cores = pieces.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(-(-last // BLOCKS_A_TASK), TASKS_A_CORE * cores), min(last, cores)) if share == 1 else max(1, min(-(-last // share // 2), cores))
    stats = stats and (stats if metric == "cosine" else True)  # distances have no bound that leaves windows out
    if last >= FIRST_FROM and "floor" not in queries.columns and not only_gold and (queries["top_n"] > 0).any():
        own = queries.assign(floor=-np.inf, gold_start=-1, gold_similarity=np.nan)
        first = scan(pieces.where(F.col("block") % FIRST == 0), vectors, own, length, block, metric, False, False, matrix_bytes, FIRST)
        queries = queries.assign(floor=floors(first, queries))
    if "codes" in pieces.columns and (n + 1) * dims * 8 <= matrix_bytes:
        path = vectors.stored_at

        def runs(batches):
            finder, matrix = Finder(queries, length, block, metric, only_gold, stats), _matrix(path, n, dims, small=True)
            for own, begin, code in _runs(batches):
                finder.add(own, begin, matrix[code].astype(np.float64, copy=False), code > 0)
            yield from _found(finder.found()).to_batches()

        return pieces.select("block", "g", "codes").repartition(parts, "block").sortWithinPartitions("block", "g").mapInArrow(runs, SCAN)
    if "codes" in pieces.columns:
        pieces = pieces.select("block", "g", F.posexplode("codes").alias("_at", "code")).select("block", (F.col("g") + F.col("_at")).alias("g"), F.col("code").cast("long").alias("code"))
    rows = pieces.select("block", "g", "code")
    if (n + 1) * dims * 8 <= matrix_bytes:
        path = vectors.stored_at

        def run(batches):
            finder, matrix = Finder(queries, length, block, metric, only_gold, stats), _matrix(path, n, dims, small=True)
            for own, g, code in _by_block(batches):
                finder.add(own, int(g[0]), matrix[code].astype(np.float64, copy=False), code > 0)
            yield from _found(finder.found()).to_batches()

        return rows.repartition(parts, "block").sortWithinPartitions("block", "g").mapInArrow(run, SCAN)

    def alone(left: pa.Table, right: pa.Table) -> pa.Table:
        finder = Finder(queries, length, block, metric, only_gold, stats)
        left = left.sort_by([("g", "ascending")])
        if left.num_rows:
            codes, code = right.column("of").to_numpy(), left.column("code").to_numpy()
            matrix = np.zeros((len(codes) + 1, dims))
            matrix[1:] = np.asarray(right.column("vec").combine_chunks().flatten(), np.float64).reshape(len(codes), dims)
            order = np.argsort(codes)
            near = np.searchsorted(codes, code, sorter=order)
            at = np.where(code > 0, order[np.minimum(near, len(codes) - 1)] + 1 if len(codes) else 0, 0)
            finder.add(int(left.column("block")[0].as_py()), int(left.column("g")[0].as_py()), matrix[at], code > 0)
        return _found(finder.found())

    own = rows.where("code > 0").select(F.col("block").alias("at"), F.col("code").alias("of")).distinct()
    own = own.join(vectors.select(F.col("code").alias("of"), "vec"), "of")
    return rows.groupBy("block").cogroup(own.groupBy("at")).applyInArrow(alone, SCAN)


def ranked(found: DataFrame, top_n: int) -> DataFrame:
    """(query_id, start, similarity, rank) of the best ``top_n``, rank from 1."""
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "start")
    hits = found.where("kind = 'hit'").select("query_id", "start", "similarity", F.row_number().over(order).alias("rank"))
    return hits.where(F.col("rank") <= top_n)


def statistics(found: DataFrame) -> DataFrame:
    """(query_id, n_windows, mean_sim, std_sim): population deviation over all windows; no row without windows."""
    s = found.where("kind = 'stat'").groupBy("query_id").agg(F.sum("n").alias("n_windows"), F.sum("total").alias("t"), F.sum("squares").alias("q"))
    s = s.where("n_windows > 0")
    mean, square = F.try_divide("t", "n_windows"), F.try_divide("q", "n_windows")
    return s.select("query_id", "n_windows", mean.alias("mean_sim"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std_sim"))
