"""Text reuse: seeds, shared seeds, candidate places, gates, extension, alignment."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import vector as V
from weftline.operators import search
from weftline.sources.shared import stored

# Fixed value: characters of which a seed may not consist alone.
NUMERALS = "一二三四五六七八九十百千"
#: Seeds of the one side up to which they are broadcast: some 60 bytes each.
FEW = 500_000


def seeds(df: DataFrame, key: str, text: str, size: int = 2, ignore: str = NUMERALS) -> DataFrame:
    """(key, seed, pos): character n-grams, but those of ignored characters only."""
    n = F.length(text) - size
    at = F.when(n >= 0, F.sequence(F.lit(0), n))
    rows = df.select(key, text, F.explode(at).alias("pos")).select(key, F.substring(F.col(text), F.col("pos") + 1, F.lit(size)).alias("seed"), "pos")
    return rows.where(F.translate("seed", ignore, "") != "") if ignore else rows


def word_seeds(tokens: DataFrame, key: str, size: int) -> DataFrame:
    """(key, seed, pos): n-grams of (key, pos, token) as text, words joined by a space."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(0, size - 1)
    rows = tokens.select(key, "pos", F.array_join(F.collect_list("token").over(w), " ").alias("seed"), F.count(F.lit(1)).over(w).alias("n"))
    return rows.where(F.col("n") == size).select(key, "seed", "pos")


def text_seeds(texts: DataFrame, key: str, words: str, size: int) -> DataFrame:
    """(key, seed, pos): as ``word_seeds``, from an array of words a row; nothing is shuffled or sorted. Rows that share a key are
    texts of their own."""
    n = F.size(words) - size
    at = F.when(n >= 0, F.sequence(F.lit(0), n))
    grams = F.transform(at, lambda i: F.concat_ws(" ", *(F.get(F.col(words), i + k) for k in range(size))))
    return texts.select(key, F.posexplode(grams).alias("pos", "seed")).select(key, "seed", "pos")


def seed_index(rows: DataFrame, *by: str) -> DataFrame:
    """(by, seed, positions); with ``by`` an index a text."""
    return rows.groupBy(*by, "seed").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def _few(rows: DataFrame, most: int = FEW) -> tuple[DataFrame, bool]:
    """Stored ``rows``, hinted for a broadcast if they are at most ``most``; whether they are."""
    own = stored(rows, "seeds")
    few = own.limit(most + 1).count() <= most
    return (F.broadcast(own) if few else own), few


def shared_seeds(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct seeds that both have: ``b`` meets a few seeds of ``a`` where it is read, and only what is shared is shuffled; else
    both are reduced before the join."""
    own, few = _few(a.select("seed").distinct())
    if few:
        return b.select("seed").join(own, "seed", "left_semi").distinct()
    return own.join(b.select("seed").distinct(), "seed", "left_semi")


def seed_vectors(tokens: DataFrame, space: DataFrame, key: str, size: int) -> DataFrame:
    """(seed, vec): the mean vector of each n-gram's first occurrence; words without a vector are passed over."""
    from weftline.operators.vectors import window_means

    means = window_means(tokens, space, size, key)
    rows = word_seeds(tokens, key, size).join(means.select(key, F.col("start").alias("pos"), "vec"), [key, "pos"])
    return rows.groupBy("seed").agg(F.min_by("vec", F.struct(key, "pos")).alias("vec")).where("vec is not null")


def similar_seeds(queries: DataFrame, rows: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b, similarity) of seeds with cosine above the threshold, all of the one text's against all of the other's."""
    from weftline.operators.similar import similar_pairs

    return similar_pairs(queries, rows, "seed", threshold)


def locations(a: DataFrame, b: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """(seed, source positions × target positions), as an equi-join on the seed, where ``b`` isn't shuffled if ``a`` has few."""
    if shared is not None:
        a = a.join(shared, "seed", "left_semi")
    return _few(a)[0].join(b, "seed")


def gate(pairs: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Pairs (va, vb) whose means are more similar than the threshold, with the similarity."""
    return pairs.withColumn("similarity", F.round(V.cosine(F.col("va"), F.col("vb")), 6)).where(F.col("similarity") > threshold)


#: Places whose windows' vectors a task holds at once.
PLACES_AT_ONCE = 512


def near_texts(texts: DataFrame, places: DataFrame, key: str) -> DataFrame:
    """Of ``texts`` those that have a place; ids of places are met where texts are read, up to FEW of them."""
    return texts.join(_few(places.select(key).distinct())[0], key, "left_semi")


def stretches(places: DataFrame, texts: DataFrame, key: str, at: str, before: int, behind: int) -> DataFrame:
    """(key, at, lo, hashes): for each distinct place (key, at) the hashes of its text's ``words`` from ``lo``, ``before`` words before
    it or the text's beginning, to ``behind`` words from it on or the text's end."""
    asked = places.groupBy(key).agg(F.collect_set(at).alias("_at"))
    rows = texts.select(key, F.transform("words", lambda w: F.xxhash64(w)).alias("_h")).join(asked, key).select(key, "_h", F.explode("_at").alias(at))
    lo = F.greatest(F.col(at) - before, F.lit(0))
    return rows.select(key, at, lo.alias("lo"), F.slice("_h", lo + 1, F.least(F.col(at) + behind, F.size("_h")) - lo).alias("hashes"))


def _sums_around(hashes: pa.Array, lo: np.ndarray, at: np.ndarray, back: int, length: int, book: search.Book) -> tuple[np.ndarray, np.ndarray]:
    """Of each stretch the sums of the windows that begin from ``back`` before ``at`` to there (rows x windows x dims), and whether
    a window lies in its text as a whole and has a vector."""
    sizes = hashes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    column = np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row] + (back - at + lo)[row]
    code = np.full((len(sizes), back + length), -1, np.int64)
    code[row, column] = book.codes(hashes.flatten().to_numpy())
    prefix = np.zeros((len(sizes), back + length + 1, book.dims))
    np.cumsum(book.matrix()[np.maximum(code, 0)], axis=1, out=prefix[:, 1:])
    counts = np.zeros((2, len(sizes), back + length + 1), np.int64)
    np.cumsum(np.stack([code >= 0, code > 0]), axis=2, out=counts[:, :, 1:])
    there, known = counts[:, :, length:] - counts[:, :, : back + 1]
    return prefix[:, length:] - prefix[:, : back + 1], (there == length) & (known > 0)


def gated(places: DataFrame, one: DataFrame, two: DataFrame, key_a: str, key_b: str, space: DataFrame | search.KeyedSpace, threshold: float = 0.9, min_length: int = 10, limit: int = search.MATRIX_BYTES) -> tuple[DataFrame, search.Book | None]:
    """Of ``places`` (key_a, i, key_b, j) those whose windows of min_length are more similar than the threshold, with the
    similarity, and (start_a, start_b, best): the most similar pair of windows that begin up to min_length - 2 before i and j,
    ties to the smaller start_a, then start_b. Also the ``book`` of the space. ``one`` and ``two`` have texts (key, words).

    A place takes hashes of the words around it along, and windows are made where both stretches meet, so no vector is shuffled;
    but where the space is more than ``limit`` bytes, windows are joined.
    """
    book, back = search.book(space, None, limit), min_length - 2
    if book is None:
        from weftline.operators.vectors import window_means

        rows = [(k, t.select(k, F.posexplode("words").alias("pos", "token"))) for k, t in ((key_a, one), (key_b, two))]
        wa, wb = (stored(window_means(t, space, min_length, k, limit=limit), "gate-windows") for k, t in rows)
        va, vb = wa.select(key_a, F.col("start").alias("i"), F.col("vec").alias("va")), wb.select(key_b, F.col("start").alias("j"), F.col("vec").alias("vb"))
        near = gate(places.join(va, [key_a, "i"]).join(vb, [key_b, "j"]), threshold).select(key_a, "i", key_b, "j", "similarity")
        return near.join(best_starts(near, wa, wb, key_a, key_b, min_length).withColumnRenamed("similarity", "best"), [key_a, "i", key_b, "j"]), None
    unit = 10.0**search.DIGITS

    def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(x, axis=2)[:, :, None] * np.linalg.norm(y, axis=2)[:, None]
        return np.rint(np.divide(x @ y.transpose(0, 2, 1), norm, out=np.zeros_like(norm), where=norm > 0) * unit) / unit

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, PLACES_AT_ONCE):
                batch = whole.slice(lo, PLACES_AT_ONCE)
                column = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: B023, E731
                (x, okx), (y, oky) = (_sums_around(batch.column(f"hashes_{k}"), column(f"lo_{k}"), column(at), back, min_length, book) for k, at in (("a", "i"), ("b", "j")))
                own = np.where(okx[:, back] & oky[:, back], cosines(x[:, back:], y[:, back:])[:, 0, 0], -np.inf)
                passed = np.flatnonzero(own > threshold)
                if not len(passed):
                    continue
                scores = np.where(okx[passed][:, :, None] & oky[passed][:, None], cosines(x[passed], y[passed]), -np.inf).reshape(len(passed), -1)
                best = scores.argmax(axis=1)
                start = [pa.array((column(at)[passed] - back + k).astype(np.int32)) for at, k in (("i", best // (back + 1)), ("j", best % (back + 1)))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(passed)) for c in ("key_a", "i", "key_b", "j")), pa.array(own[passed]), *start, pa.array(scores[np.arange(len(passed)), best])], names)

    names = ["key_a", "i", "key_b", "j", "similarity", "start_a", "start_b", "best"]
    sides = [stretches(places, t, k, at, back, min_length).select(k, at, F.col("lo").alias(f"lo_{n}"), F.col("hashes").alias(f"hashes_{n}")) for n, t, k, at in (("a", one, key_a, "i"), ("b", two, key_b, "j"))]
    both = places.join(_few(sides[0], FEW // 4)[0], [key_a, "i"]).join(sides[1], [key_b, "j"])
    kind = dict(places.dtypes)
    out = both.select(F.col(key_a).alias("key_a"), "i", F.col(key_b).alias("key_b"), "j", "lo_a", "hashes_a", "lo_b", "hashes_b").mapInArrow(run, f"key_a {kind[key_a]}, i {kind['i']}, key_b {kind[key_b]}, j {kind['j']}, similarity double, start_a int, start_b int, best double")
    return out.withColumnRenamed("key_a", key_a).withColumnRenamed("key_b", key_b), book


def best_start(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Of candidate starts (i, j, similarity) the most similar; ties to the smaller i, then j."""
    return pairs.groupBy(*by).agg(F.max_by(F.struct("i", "j", "similarity"), F.struct("similarity", (-F.col("i")).alias("x"), (-F.col("j")).alias("y"))).alias("_b")).select(*by, "_b.*")


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    n = float(np.linalg.norm(a) * np.linalg.norm(b))
    return float(a @ b) / n if n else 0.0


def best_starts(rows: DataFrame, one: DataFrame, two: DataFrame, key_a: str, key_b: str, min_length: int = 10) -> DataFrame:
    """Of places ``rows`` (key_a, i, key_b, j) the most similar pair of windows that begin up to min_length - 2 before i and
    j: (key_a, i, key_b, j, start_a, start_b, similarity); ties to the smaller start_a, then start_b. ``one`` and ``two``
    have the texts' windows of min_length, (key_a, start, vec) and (key_b, start, vec)."""
    places = rows.select(key_a, "i", key_b, "j").distinct()
    back = lambda at: F.explode(F.sequence(F.greatest(F.col(at) - min_length + 2, F.lit(0)), F.col(at)))
    a = places.withColumn("start_a", back("i")).join(one.select(key_a, F.col("start").alias("start_a"), F.col("vec").alias("va")), [key_a, "start_a"])
    both = a.withColumn("start_b", back("j")).join(two.select(key_b, F.col("start").alias("start_b"), F.col("vec").alias("vb")), [key_b, "start_b"])
    both = both.withColumn("similarity", F.round(V.cosine(F.col("va"), F.col("vb")), 6))
    best = F.max_by(F.struct("start_a", "start_b", "similarity"), F.struct("similarity", -F.col("start_a"), -F.col("start_b")))
    return both.where("va is not null and vb is not null").groupBy(key_a, "i", key_b, "j").agg(best.alias("_b")).select(key_a, "i", key_b, "j", "_b.*")


def _prefix(vectors: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros((1, vectors.shape[1])), np.cumsum(vectors, axis=0)])


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row; 0 where a vector has no length."""
    n = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
    return np.divide(np.einsum("ij,ij->i", a, b), n, out=np.zeros(len(n)), where=n > 0)


def optimize_start(source: np.ndarray, target: np.ndarray, i: int, j: int, min_length: int = 10) -> tuple[int, int, float]:
    """The most similar pair of windows that begin up to min_length - 2 before i and j; the first on ties. A window that
    a text's end cuts is the mean of what is left."""

    def windows(vectors: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
        begin = np.arange(max(0, at - min_length + 2), at + 1)
        sums = _prefix(vectors[begin[0] : at + min_length])
        return begin, sums[np.minimum(begin - begin[0] + min_length, len(sums) - 1)] - sums[begin - begin[0]]

    (a, x), (b, y) = windows(source, i), windows(target, j)
    norm = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)
    scores = np.round(np.divide(x @ y.T, norm, out=np.zeros_like(norm), where=norm > 0), 12)
    k, m = np.unravel_index(np.argmax(scores), scores.shape)
    return int(a[k]), int(b[m]), float(scores[k, m])


def extend(source: np.ndarray, target: np.ndarray, i: int, j: int, length: int, similarity: float, threshold: float = 0.9, patience: int = 10) -> tuple[int, int, float]:
    """The length to which both sides grow from i and j: with s(n) the similarity of their means over n, growth goes on
    while s(n) is above the threshold and fewer than ``patience`` drops have come since the last rise, to where either
    text ends; the last rise before that counts, or the beginning. Similarities come from prefix sums, for twice as many
    lengths each time."""
    room = max(0, min(len(source) - i, len(target) - j) - length)
    tried = min(64, room)
    while True:
        ends = length + np.arange(1, tried + 1)
        a, b = _prefix(source[i : i + length + tried]), _prefix(target[j : j + length + tried])
        s = np.concatenate([[similarity], _cosines(a[ends], b[ends])])
        step = np.sign(np.diff(s))
        rise = np.concatenate([[0], np.where(step > 0, np.arange(1, len(s)), 0)])
        last = np.maximum.accumulate(rise)  # the last rise up to each length
        drops = np.concatenate([[0], np.cumsum(step < 0)])
        ended = (s <= threshold) | np.concatenate([[False], (drops - drops[last])[:-1] >= patience])
        if ended.any() or tried == room:
            stop = int(np.argmax(ended)) if ended.any() else len(s)
            n = int(last[stop - 1]) if stop else 0
            return length + n, length + n, float(s[n])
        tried = min(2 * tried, room)


def compare_chunks(source: np.ndarray, target: np.ndarray, i: int, j: int, threshold: float = 0.9, min_length: int = 10):
    """(source start, target start, source length, target length, similarity), or None below the gate."""
    if _cosine(source[i : i + min_length].mean(axis=0), target[j : j + min_length].mean(axis=0)) <= threshold:
        return None
    a, b, s = optimize_start(source, target, i, j, min_length)
    n, m, s = extend(source, target, a, b, min_length, s, threshold)
    return a, b, n, m, s


@dataclass(frozen=True)
class Scoring:
    """What an alignment's cells gain: a step along both sequences gains the pair's score; a step along one loses ``gap``, or
    gains the score too (``free_steps``). The first row falls by ``gap`` a column, or has the last row's loss
    throughout (``level_row``). An alignment reaches both beginnings, or ends at either (``open_end``)."""

    gap: float = 0.7
    free_steps: bool = False
    level_row: bool = False
    open_end: bool = False


def scoring(mode: str, gap: float) -> Scoring:
    if mode == "needleman_wunsch":
        return Scoring(gap)
    if mode == "reference":
        return Scoring(gap, free_steps=True, level_row=True, open_end=True)
    raise ValueError(f"{mode} not known")


#: What a cell remembers of where its best score comes from; the first wins ties.
BOTH, ALONG_SECOND, ALONG_FIRST = 0, 1, 2


def align(scores: np.ndarray, gap: float = 0.7, mode: str = "needleman_wunsch") -> list[tuple[int, int]]:
    """Index pairs of an alignment, -1 for a gap: one dynamic programme, a whole anti-diagonal at a time, whose cells keep
    the step that led there. ``mode`` names a Scoring."""
    rule = scoring(mode, gap)
    n, m = scores.shape
    best = np.zeros((n + 1, m + 1))
    came = np.zeros((n + 1, m + 1), np.uint8)
    best[:, 0] = -gap * np.arange(n + 1)
    best[0] = -gap * n if rule.level_row else -gap * np.arange(m + 1)
    came[0], came[1:, 0] = ALONG_SECOND, ALONG_FIRST
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        j = d - i
        own = scores[i - 1, j - 1]
        aside = own if rule.free_steps else -gap
        from_ = np.stack([best[i - 1, j - 1], best[i, j - 1], best[i - 1, j]])
        total = from_ + np.stack([own, np.broadcast_to(aside, own.shape), np.broadcast_to(aside, own.shape)])
        came[i, j] = np.argmax(from_ if rule.free_steps else np.round(total, 9), axis=0)  # equal gains don't decide
        best[i, j] = total.max(axis=0)
    out: list[tuple[int, int]] = []
    i, j = n, m
    while (i and j) if rule.open_end else (i or j):
        step = came[i, j]
        i, j = i - (step != ALONG_SECOND), j - (step != ALONG_FIRST)
        out.append((-1 if step == ALONG_SECOND else int(i), -1 if step == ALONG_FIRST else int(j)))
    return out[::-1]


#: Cells up to which an alignment is held whole; beyond it rows are kept now and then and computed again.
CELLS, KEPT_ROWS = 1 << 22, 128
#: Similarities are whole numbers of 1 / UNIT there, so that sums along any path are exact.
UNIT = 1 << 30


def _unit_rows(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=np.zeros_like(v, dtype=np.float64), where=n > 0)


def align_long(first: np.ndarray, second: np.ndarray, gap: float = 0.7, rows: int = KEPT_ROWS) -> list[tuple[int, int]]:
    """The alignment of two sequences of vectors by their cosines as ``align`` has it by needleman_wunsch, in memory that grows
    with their lengths and not with the product.

    A row of cells follows from the row before by one pass: what comes from above or aslant, then the running maximum of these
    less the gaps between. Every ``rows``-th row is kept. The way back computes the rows between two kept ones again, only up to
    the column it has reached, this time with the step each cell takes.
    """
    a, b = _unit_rows(first), _unit_rows(second)
    n, m, cost = len(a), len(b), round(gap * UNIT)
    ramp = cost * np.arange(m + 1)
    similar = lambda lo, hi, width: np.rint(a[lo:hi] @ b[:width].T * UNIT).astype(np.int64)

    def following(before: np.ndarray, own: np.ndarray, i: int) -> np.ndarray:
        cells = np.empty(len(before), np.int64)
        cells[0] = -cost * i
        np.maximum(before[:-1] + own, before[1:] - cost, out=cells[1:])
        cells += ramp[: len(cells)]
        np.maximum.accumulate(cells, out=cells)
        cells -= ramp[: len(cells)]
        return cells

    kept = [-ramp]
    for lo in range(0, n, rows):
        cells = kept[-1]
        for k, own in enumerate(similar(lo, min(lo + rows, n), m)):
            cells = following(cells, own, lo + k + 1)
        kept.append(cells)
    out: list[tuple[int, int]] = []
    i, j = n, m
    for lo in range((n - 1) // rows * rows if n else 0, -1, -rows):
        if not i:
            break
        cells, steps = kept[lo // rows][: j + 1], []
        for k, own in enumerate(similar(lo, i, j)):
            before, cells = cells, following(cells, own, lo + k + 1)
            aslant, aside = cells[1:] == before[:-1] + own, cells[1:] == cells[:-1] - cost
            steps.append(np.concatenate([[ALONG_FIRST], np.where(aslant, BOTH, np.where(aside, ALONG_SECOND, ALONG_FIRST))]).astype(np.uint8))
        while i > lo:
            step = steps[i - lo - 1][j]
            i, j = i - (step != ALONG_SECOND), j - (step != ALONG_FIRST)
            out.append((-1 if step == ALONG_SECOND else int(i), -1 if step == ALONG_FIRST else int(j)))
    out += [(-1, k) for k in range(j - 1, -1, -1)]
    return out[::-1]


def align_vectors(first: np.ndarray, second: np.ndarray, gap: float, mode: str = "needleman_wunsch") -> list[tuple[int, int]]:
    """By ``align``; by ``align_long`` where the cells would be many."""
    if mode == "needleman_wunsch" and len(first) * len(second) > CELLS:
        return align_long(first, second, gap)
    return align(_unit_rows(first) @ _unit_rows(second).T, gap, mode)


def sequences(tokens: DataFrame, space: DataFrame, key: str, level: str = "sentences", dims: int | None = None) -> DataFrame:
    """(key, vecs): the vectors of a text's sentences, or of its words, that have one, in their order. ``tokens``: key, sent, pos,
    token."""
    from weftline.operators.vectors import lookup, sentence_vectors

    if level == "sentences":
        rows = sentence_vectors(tokens, space, key, dims).select(key, F.struct("sent", "vec").alias("x"))
    elif level == "words":
        rows = lookup(tokens, space).select(key, F.struct("sent", "pos", "vec").alias("x"))
    else:
        raise ValueError(f"{level} not known")
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["vec"]).alias("vecs"))


def align_texts(one: DataFrame, two: DataFrame, pairs: DataFrame, gap: float = 0.2, mode: str = "needleman_wunsch") -> DataFrame:
    """(key, step, i, j) for ``pairs`` (key, a, b) of texts whose ``sequences`` are in ``one`` (a, vecs) and ``two`` (b, vecs)."""
    both = pairs.join(one.withColumnRenamed("vecs", "va"), "a").join(two.withColumnRenamed("vecs", "vb"), "b")
    return align_sequences(both.select("key", "va", "vb"), gap, mode)


def align_sequences(pairs: DataFrame, gap: float = 0.2, mode: str = "needleman_wunsch") -> DataFrame:
    """(key, step, i, j) from rows (key, va, vb: array<array<double>>); a pair's sequences lie in one row."""

    def run(batches):
        for pdf in batches:
            rows = []
            for key, va, vb in zip(pdf["key"], pdf["va"], pdf["vb"]):
                if va is None or vb is None or not len(va) or not len(vb):
                    continue
                rows += [(key, k, i, j) for k, (i, j) in enumerate(align_vectors(np.stack(va), np.stack(vb), gap, mode))]
            yield pd.DataFrame(rows, columns=["key", "step", "i", "j"])

    return pairs.mapInPandas(run, "key long, step int, i int, j int")


