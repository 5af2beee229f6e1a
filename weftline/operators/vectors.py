"""Vector spaces and what is averaged over them: phrases, windows, sentences, documents.

A space is (token, vec). Tokens meet it by equi-join; a side is broadcast by Spark only below its threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from weftline.functions import vector as V
from weftline.operators import search


def dims_of(df: DataFrame, vec: str = "vec") -> int:
    """The length of the first vector; 0 if there is none. Costs a row of ``df``."""
    row = df.select(F.size(vec).alias("n")).where("n > 0").first()
    return row["n"] if row else 0


def _sums(df: DataFrame, by: list[str], vec: str, weight: Column | None, dims: int | None) -> DataFrame:
    """(by, _sum, _weight): element-wise sums as plain aggregates, so that each task sends one row a group."""
    dims = dims_of(df, vec) if dims is None else dims
    w = F.lit(1) if weight is None else weight
    of = lambda i: F.get(vec, F.lit(i)).cast("double") if weight is None else F.get(vec, F.lit(i)).cast("double") * w
    cells = [F.sum(of(i)).alias(f"_s{i}") for i in range(dims)]
    none = F.expr("cast(null as array<double>)")
    out = df.groupBy(*by).agg(*cells, F.sum(w).alias("_weight"))
    return out.select(*by, (F.array(*[F.col(f"_s{i}") for i in range(dims)]) if dims else none).alias("_sum"), "_weight")


def mean_vectors(df: DataFrame, by: list[str], vec: str = "vec", weight: str | None = None, dims: int | None = None) -> DataFrame:
    """(by, vec, n): weighted element-wise mean. ``dims``: the vectors' length, else taken from the first."""
    parts = _sums(df, by, vec, F.col(weight) if weight else None, dims)
    return parts.select(*by, V.scaled(F.col("_sum"), F.lit(1.0) / F.col("_weight")).alias("vec"), F.col("_weight").alias("n"))


def sum_vectors(df: DataFrame, by: list[str], vec: str = "vec", dims: int | None = None) -> DataFrame:
    return _sums(df, by, vec, None, dims).select(*by, F.col("_sum").alias("vec"))


def lookup(tokens: DataFrame, space: DataFrame, keep: bool = False) -> DataFrame:
    """Tokens with their vectors; ``keep`` keeps those without one."""
    return tokens.join(space, "token", "left" if keep else "inner")


#: Words whose vectors a task holds at once.
PART_WORDS = 1 << 16
#: Distinct tokens that a task holds before it sends them.
TOKENS_HELD = 1 << 19


def distinct_tokens(df: DataFrame, column: str = "token") -> DataFrame:
    """(token) of a column of tokens or of lists of them, each once, nulls left out. Tasks send what is distinct among
    TOKENS_HELD of theirs at least, so most repetitions never become a row."""
    nested = isinstance(df.schema[column].dataType, ArrayType)

    def run(batches):
        held, size, mark = [], 0, TOKENS_HELD // 4
        for batch in batches:
            own = pc.unique(batch.column(0).flatten() if nested else batch.column(0)).drop_null()
            held.append(own)
            size += len(own)
            if size > mark:
                held = [pc.unique(pa.chunked_array(held))]
                size, mark = len(held[0]), max(TOKENS_HELD // 4, 2 * len(held[0]))
                if size > TOKENS_HELD:
                    yield pa.RecordBatch.from_arrays(held, ["token"])
                    held, size, mark = [], 0, TOKENS_HELD // 4
        if held:
            yield pa.RecordBatch.from_arrays([pc.unique(pa.chunked_array(held))], ["token"])

    return df.select(F.col(column).alias("token")).mapInArrow(run, "token string").distinct()


def token_means(tokens: DataFrame, space: DataFrame | search.KeyedSpace, by: list[str], dims: int | None = None, limit: int = search.MATRIX_BYTES) -> DataFrame:
    """(by, vec, n): the mean vector of each group's tokens that have one, and how many these are. ``tokens``: by, token.

    Only hashes of tokens are shuffled, to the first column of ``by``; the workers look them up in stored tables. Where the
    space is more than ``limit`` bytes, distinct tokens of a group are counted and joined with their vectors.
    """
    book = search.book(space, dims, limit)
    if book is None:
        counts = tokens.groupBy(*by, "token").agg(F.count(F.lit(1)).alias("_c"))
        return mean_vectors(lookup(counts, search.space_table(space)), by, weight="_c", dims=dims)
    dims = book.dims
    fields = {f.name: f for f in tokens.schema.fields}

    def run(batches):
        matrix, last, total, many = book.matrix(), None, None, 0

        def rows(key: pa.RecordBatch, sums: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            ends = pa.array(dims * np.arange(len(counts) + 1), pa.int32())
            vec = pa.ListArray.from_arrays(ends, pa.array((sums / counts[:, None]).ravel()))
            return pa.RecordBatch.from_arrays([*key.columns, vec, pa.array(counts)], [*by, "vec", "n"])

        for batch in batches:
            code = book.codes(batch.column("_hash").to_numpy())
            batch, code = batch.select(by).filter(pa.array(code > 0)), code[code > 0]
            if not len(code):
                continue
            ids = [np.asarray(c.dictionary_encode().indices.fill_null(-1)) for c in batch.columns]
            first = np.flatnonzero(np.concatenate([[True], np.any([np.diff(i) != 0 for i in ids], axis=0)]))
            sums = np.add.reduceat(matrix[code], first, axis=0)
            counts = np.diff([*first, len(code)])
            if last is not None:
                if batch.slice(0, 1).equals(last):
                    sums[0] += total
                    counts[0] += many
                else:
                    yield rows(last, total[None], np.array([many]))
            key = batch.take(pa.array(first))
            if len(first) > 1:
                yield rows(key.slice(0, len(first) - 1), sums[:-1], counts[:-1])
            last, total, many = batch.slice(len(code) - 1, 1), sums[-1], int(counts[-1])
        if last is not None:
            yield rows(last, total[None], np.array([many]))

    hashes = tokens.select(*by, F.xxhash64("token").alias("_hash")).repartition(by[0]).sortWithinPartitions(*by)
    out = StructType([*(fields[c] for c in by), StructField("vec", ArrayType(DoubleType())), StructField("n", LongType())])
    return hashes.mapInArrow(run, out)


def text_means(texts: DataFrame, space: DataFrame | search.KeyedSpace, key: str, words: str = "words", dims: int | None = None, limit: int = search.MATRIX_BYTES) -> DataFrame:
    """(key, vec, n) as ``token_means`` by ``key``, from an array of words a row: a row's words are summed where it is read, so a
    vector a row is shuffled, and no word. Where the space is more than ``limit`` bytes, words are counted and joined."""
    book = search.book(space, dims, limit)
    if book is None:
        return token_means(texts.select(key, F.explode(words).alias("token")), space, [key], dims, limit)
    kind = {f.name: f.dataType.simpleString() for f in texts.schema}[key]

    def run(batches):
        matrix = book.matrix()
        for batch in batches:
            lists = batch.column(1)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            code, row = book.codes(lists.flatten().to_numpy()), np.repeat(np.arange(len(sizes)), sizes)
            code, row = code[code > 0], row[code > 0]
            if not len(code):
                continue
            first = np.flatnonzero(np.concatenate([[True], np.diff(row) != 0]))
            counts = np.diff([*first, len(code)])
            sums, lo = np.empty((len(first), book.dims)), 0
            while lo < len(first):  # as many rows as have PART_WORDS words, or one
                hi = max(lo + 1, int(np.searchsorted(first, first[lo] + PART_WORDS)))
                end = first[hi] if hi < len(first) else len(code)
                sums[lo:hi] = np.add.reduceat(matrix[code[first[lo] : end]], first[lo:hi] - first[lo], axis=0)
                lo = hi
            vec = pa.ListArray.from_arrays(pa.array(book.dims * np.arange(len(first) + 1), pa.int32()), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[first])), vec, pa.array(counts)], ["key", "vec", "n"])

    hashes = texts.where(F.size(words) > 0).select(key, F.transform(words, lambda w: F.xxhash64(w)).alias("hashes"))
    sums = hashes.mapInArrow(run, f"key {kind}, vec array<double>, n long").withColumnRenamed("key", key)
    cells = [F.sum(F.get("vec", F.lit(i))).alias(f"_s{i}") for i in range(book.dims)]
    parts = sums.groupBy(key).agg(*cells, F.sum("n").alias("n"))
    return parts.select(key, F.array(*[F.col(f"_s{i}") / F.col("n") for i in range(book.dims)]).alias("vec"), "n")


def centered(space: DataFrame, dims: int | None = None) -> DataFrame:
    """``space`` less its mean vector."""
    mean = mean_vectors(space, [], dims=dims).select(F.col("vec").alias("_m"))
    return space.join(F.broadcast(mean), F.lit(True)).withColumn("vec", F.zip_with("vec", "_m", lambda a, b: a - b)).drop("_m")  # one row


def phrase_vectors(phrases: DataFrame, space: DataFrame, by: list[str], whole: Column | None = None, dims: int | None = None) -> DataFrame:
    """(by, vec) from (by, pos, token). A token without vector but with several characters stands for the mean of its
    characters' vectors, as one unit. ``whole``: a phrase that is a key itself takes that vector."""
    own = lookup(phrases, space, keep=True)
    chars = phrases.where(F.length("token") > 1).join(space.select("token"), "token", "left_anti")
    chars = chars.withColumn("c", F.explode(F.split("token", ""))).where("c <> ''").join(space.select(F.col("token").alias("c"), F.col("vec").alias("cv")), "c")
    parts = mean_vectors(chars, [*by, "pos"], "cv", dims=dims).select(*by, "pos", F.col("vec").alias("part"))
    rows = own.join(parts, [*by, "pos"], "left").withColumn("vec", F.coalesce("vec", "part")).where("vec is not null")
    out = mean_vectors(rows, by, dims=dims)
    if whole is not None:
        key = phrases.select(*by, whole.alias("token")).distinct().join(space, "token").select(*by, F.col("vec").alias("_whole"))
        out = out.join(key, by, "full").withColumn("vec", F.coalesce("_whole", "vec")).drop("_whole")
    return out


#: Positions of a block of ``window_means``.
WINDOW_BLOCK = 4096


def window_means(tokens: DataFrame, space: DataFrame | search.KeyedSpace, length: int, by: str = "doc_id", starts: DataFrame | None = None, limit: int = search.MATRIX_BYTES) -> DataFrame:
    """(by, start, n_known, vec) of every complete window of ``length`` tokens of (by, pos, token), or of those at ``starts``
    (by, start), which are distinct; vec is null where no token has a vector. Positions go from 0 on without gaps.

    Texts are cut into blocks that the length less one overlaps; a window is a difference of two prefix sums of its block. So a
    task holds a block, whatever the texts' and the windows' lengths. Hashes of tokens are shuffled, and vectors only where the
    space is more than ``limit`` bytes.
    """
    if length < 1:
        raise ValueError("a window has a token at least")
    book = search.book(space, None, limit)
    if book is None:
        rows = lookup(tokens.select(by, "pos", "token"), search.space_table(space).select("token", F.transform("vec", lambda x: x.cast("double")).alias("vec")), keep=True)
    else:
        rows = tokens.select(by, "pos", F.xxhash64("token").alias("vec"))
    if starts is None:
        rows = rows.withColumn("asked", F.lit(True))
    else:
        rows = rows.join(starts.select(by, F.col("start").alias("pos"), F.lit(True).alias("asked")), [by, "pos"], "left")
    first = F.floor(F.greatest(F.col("pos") - (length - 1), F.lit(0)) / WINDOW_BLOCK).cast("long")
    dealt = rows.select(F.col(by).alias("by"), "pos", "vec", F.coalesce("asked", F.lit(False)).alias("asked"), F.explode(F.sequence(first, F.floor(F.col("pos") / WINDOW_BLOCK).cast("long"))).alias("block"))
    kind = {f.name: f.dataType.simpleString() for f in tokens.schema}[by]

    def windows(key: pa.Array, block: int, begin: int, vec: pa.Array, asked: np.ndarray) -> pa.RecordBatch | None:
        at = np.flatnonzero(asked[: max(0, min(len(vec) - length + 1, (block + 1) * WINDOW_BLOCK - begin))])
        n = len(at)
        if n < 1:
            return None
        if book is None:
            known = np.asarray(vec.is_valid())
            own = np.asarray(vec.drop_null().flatten(), np.float64)
            dims = len(own) // max(1, int(known.sum()))
            whole = np.zeros((len(vec) + 1, dims))
            whole[1:][known] = own.reshape(-1, dims) if dims else whole[1:][known]
        else:
            code, dims = book.codes(vec.to_numpy()), book.dims
            known = code > 0
            whole = np.concatenate([np.zeros((1, dims)), book.matrix()[code]])
        np.cumsum(whole, axis=0, out=whole)
        counts = np.concatenate([[0], np.cumsum(known)])
        many = counts[at + length] - counts[at]
        mean = (whole[at + length] - whole[at])[many > 0] / many[many > 0, None]
        ends = np.concatenate([[0], np.cumsum(np.where(many > 0, dims, 0))]).astype(np.int32)
        vecs = pa.ListArray.from_arrays(pa.array(ends), pa.array(mean.ravel()), mask=pa.array(many == 0))
        return pa.RecordBatch.from_arrays([key.take(pa.array(np.zeros(n, np.int64))), pa.array((begin + at).astype(np.int32)), pa.array(many.astype(np.int32)), vecs], ["by", "start", "n_known", "vec"])

    def run(batches):
        held: list[pa.RecordBatch] = []

        def closed():
            table = pa.Table.from_batches(held).combine_chunks()
            out = windows(table.column("by").combine_chunks(), table.column("block")[0].as_py(), table.column("pos")[0].as_py(), table.column("vec").combine_chunks(), np.asarray(table.column("asked")))
            held.clear()
            if out is not None:
                yield out

        for batch in batches:
            key, block = batch.column("by"), np.asarray(batch.column("block"))
            code = np.asarray(key.dictionary_encode().indices.fill_null(-1))
            cuts = [0, *(np.flatnonzero((np.diff(code) != 0) | (np.diff(block) != 0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    if held and (held[-1].column("by")[-1] != key[a] or held[-1].column("block")[-1].as_py() != block[a]):
                        yield from closed()
                    held.append(batch.slice(a, b - a))
        if held:
            yield from closed()

    sorted_ = dealt.select("by", "block", "pos", "vec", "asked").repartition("by", "block").sortWithinPartitions("by", "block", "pos")
    return sorted_.mapInArrow(run, f"by {kind}, start int, n_known int, vec array<double>").withColumnRenamed("by", by)


def text_windows(texts: DataFrame, space: DataFrame | search.KeyedSpace, length: int, key: str = "doc_id", words: str = "words", limit: int = search.MATRIX_BYTES) -> DataFrame:
    """(key, start, n_known, vec) as ``window_means`` of all starts, from an array of words a row: nothing of the texts is shuffled or
    sorted. Rows that share a key are texts of their own. A task holds the vectors of WINDOW_BLOCK windows."""
    if length < 1:
        raise ValueError("a window has a token at least")
    book = search.book(space, None, limit)
    if book is None:
        return window_means(texts.select(key, F.posexplode(words).alias("pos", "token")), space, length, key, limit=limit)
    kind = {f.name: f.dataType.simpleString() for f in texts.schema}[key]

    def run(batches):
        matrix, dims = book.matrix(), book.dims
        for batch in batches:
            lists = batch.column(1)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            code, row = book.codes(lists.flatten().to_numpy()), np.repeat(np.arange(len(sizes)), sizes)
            begin = np.cumsum(sizes) - sizes
            for lo in range(0, len(code) - length + 1, WINDOW_BLOCK):
                hi = min(lo + WINDOW_BLOCK, len(code) - length + 1)
                at = np.flatnonzero(row[lo:hi] == row[lo + length - 1 : hi + length - 1])  # windows that end in their own text
                if not len(at):
                    continue
                own = code[lo : hi + length - 1]
                whole = np.concatenate([np.zeros((1, dims)), matrix[own]])
                np.cumsum(whole, axis=0, out=whole)
                counts = np.concatenate([[0], np.cumsum(own > 0)])
                many = counts[at + length] - counts[at]
                mean = (whole[at + length] - whole[at])[many > 0] / many[many > 0, None]
                ends = np.concatenate([[0], np.cumsum(np.where(many > 0, dims, 0))]).astype(np.int32)
                vecs = pa.ListArray.from_arrays(pa.array(ends), pa.array(mean.ravel()), mask=pa.array(many == 0))
                text = row[lo + at]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text)), pa.array((lo + at - begin[text]).astype(np.int32)), pa.array(many.astype(np.int32)), vecs], ["key", "start", "n_known", "vec"])

    hashes = texts.where(F.size(words) >= length).select(key, F.transform(words, lambda w: F.xxhash64(w)).alias("hashes"))
    return hashes.mapInArrow(run, f"key {kind}, start int, n_known int, vec array<double>").withColumnRenamed("key", key)


def document_tokens(df: DataFrame, key: str, text: str, remove: str | None = None) -> DataFrame:
    """(key, sent, pos, token): lines are sentences, single spaces split words; empty words stay out."""
    body = F.col(text)
    if remove:
        from weftline.functions.text import remove_repeatedly

        body = remove_repeatedly(body, remove)
    s = df.select(key, F.posexplode(F.split(body, "\n")).alias("sent", "_s"))
    return s.select(key, "sent", F.posexplode(F.split("_s", " ")).alias("pos", "token")).where("token <> ''")


def sentence_vectors(tokens: DataFrame, space: DataFrame | search.KeyedSpace, key: str, dims: int | None = None) -> DataFrame:
    return token_means(tokens, space, [key, "sent"], dims)


def document_vectors(tokens: DataFrame, space: DataFrame | search.KeyedSpace, key: str, method: str = "sentences", dims: int | None = None) -> DataFrame:
    """Mean of the sentences' means, or of all words."""
    if method == "sentences":
        return mean_vectors(sentence_vectors(tokens, space, key, dims), [key], dims=dims)
    if method != "words":
        raise ValueError(f"{method} not known")
    return token_means(tokens, space, [key], dims)


#: Bytes of query vectors that travel with a pass over the rows, and passes at most.
QUERY_BYTES, PASSES = 64 << 20, 16


def _values(q: np.ndarray, r: np.ndarray, method: str) -> np.ndarray:
    """rows x queries"""
    product = r @ q.T
    if method == "linear kernel":
        return product
    if method == "euclidean distance":
        squares = (r * r).sum(axis=1)[:, None] + (q * q).sum(axis=1)
        out = np.sqrt(np.maximum(squares - 2 * product, 0))
        for i, k in np.argwhere(out * out < 1e-6 * squares):  # differences that the formula would lose
            out[i, k] = np.linalg.norm(r[i] - q[k])
        return out
    norms = np.linalg.norm(r, axis=1)[:, None] * np.linalg.norm(q, axis=1)
    cosine = np.divide(product, norms, out=np.zeros_like(product), where=norms > 0)
    if method == "cosine similarity":
        return cosine
    if method == "cosine distance":
        return 1 - cosine
    raise ValueError(f"{method} not known")


def compare_all(queries: DataFrame, rows: DataFrame, key: str, method: str = "cosine similarity", vec: str = "vec", above: float | None = None, digits: int | None = None) -> DataFrame:
    """A stated query set against all rows: (a, b, value), as products of blocks. The query set's size is checked: QUERY_BYTES
    of it travel with one pass over the rows, and it may need PASSES of these at most. ``digits`` rounds values, of
    which only those ``above`` a bound are returned."""
    spark = rows.sparkSession
    dims = dims_of(queries, vec)
    n = queries.count() if dims else 0
    each = max(1, QUERY_BYTES // (8 * max(dims, 1)))
    if n > each * PASSES:
        raise ValueError(f"{n} queries are too many to compare with every row")
    own = queries.select(F.col(key).alias("a"), F.transform(vec, lambda x: x.cast("double")).alias("v")).toArrow()  # checked above
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}[key]
    schema = f"a {kind}, b {kind}, value double"

    def matrix(column) -> np.ndarray:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)

    def against(part: pa.Table):
        ids, q = part.column("a").combine_chunks(), matrix(part.column("v"))

        def run(batches):
            for batch in batches:
                for lo in range(0, batch.num_rows, step := max(1, (1 << 20) // max(1, len(q)))):
                    piece = batch.slice(lo, step)
                    value = _values(q, matrix(piece.column(1)), method)
                    value = value if digits is None else np.round(value, digits)
                    i, k = np.indices(value.shape).reshape(2, -1) if above is None else np.nonzero(value > above)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(k)), piece.column(0).take(pa.array(i)), pa.array(value[i, k])], ["a", "b", "value"])

        return rows.select(F.col(key).alias("b"), F.transform(vec, lambda x: x.cast("double")).alias("v")).where("v is not null").mapInArrow(run, schema)

    out = None
    for lo in range(0, own.num_rows, each):
        part = against(own.slice(lo, each))
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out
