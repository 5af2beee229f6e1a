"""Word vectors from subwords: skip-gram with negative sampling, trained in many parts side by side.

A word is the mean of its buckets: itself between marks, and its character n-grams, hashed. What it predicts has hashed
buckets too, so a model has a fixed size, no vocabulary, and a vector for any word, seen or not.

Sentences are dealt to parts by their content: equal ones are counted first and their copies spread over the parts, so no part
grows with one sentence. In a round each part goes through its sentences in their own order, from the same parameters and with
random numbers of its own; then the changes of the parts that changed a row are averaged. Changes travel as whole numbers of
2^-32, so sums don't depend on any order: a model is the same however Spark splits the input. Parameters go from round to
round as a stored table; the driver sees counts by bucket and nothing else.

Null and empty sentences and words stay out; without any word all vectors are the initial ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import search
from weftline.sources.shared import stored

BUCKETS = 1 << 16
#: Words of a part, pairs of a step.
PART_WORDS, STEP_PAIRS = 200_000, 32
FIXED = float(1 << 32)
META = "size int, buckets int, least int, most int, seed long"


def bag(word: str, ngrams: tuple[int, int], buckets: int) -> list[int]:
    """A word's buckets: itself and its n-grams of the given lengths, between marks."""
    marked = f"<{word}>"
    parts = {marked[i : i + n] for n in range(ngrams[0], ngrams[1] + 1) for i in range(len(marked) - n + 1)} | {marked}
    return [xxhash.xxh3_64_intdigest(p.encode("utf-8", "surrogatepass")) % buckets for p in sorted(parts - {"<", ">"})]


def target(word: str, buckets: int) -> int:
    """The bucket by which a word is predicted."""
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"), 1) % buckets


def initial(size: int, buckets: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).uniform(-0.5 / size, 0.5 / size, (buckets, size))


def gradients(inner: np.ndarray, outer: np.ndarray, flat: np.ndarray, starts: np.ndarray, targets: np.ndarray, labels: np.ndarray):
    """(loss, by flat bucket, by target) of pairs: the buckets of a pair's word begin at ``starts`` in ``flat``; ``targets`` has
    the word it should predict and those it shouldn't."""
    counts = np.diff(np.append(starts, len(flat)))[:, None]
    hidden = np.add.reduceat(inner[flat], starts, axis=0) / counts
    own = outer[targets]
    score = np.einsum("bd,bkd->bk", hidden, own)
    p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    loss = -np.log(np.where(labels > 0, p, 1 - p) + 1e-12).sum()
    error = p - labels
    back = np.einsum("bk,bkd->bd", error, own) / counts
    return loss, np.repeat(back, counts[:, 0], axis=0), error[:, :, None] * hidden[:, None, :]


def train_part(sentences: list[list[str]], inner: np.ndarray, outer: np.ndarray, noise: np.ndarray, ngrams: tuple[int, int], window: int, negatives: int, rate: float, seed: list[int]) -> float:
    """Go through the sentences once and change the parameters in place; the loss of a pair, on average. ``noise``: summed shares
    of the buckets that negatives are drawn from."""
    rng = np.random.default_rng(seed)
    number: dict[str, int] = {}
    ids = [np.array([number.setdefault(w, len(number)) for w in s]) for s in sentences]
    bags = [bag(w, ngrams, len(inner)) for w in number]
    goal = np.array([target(w, len(outer)) for w in number])
    total, n = 0.0, 0
    centre, context = [], []
    for s in ids:
        reach = rng.integers(1, window + 1, len(s))
        at = np.arange(len(s))
        for d in range(1, min(window, len(s) - 1) + 1):
            for sign in (-1, 1):
                ok = (reach >= d) & (at + sign * d >= 0) & (at + sign * d < len(s))
                centre.append(s[ok])
                context.append(s[at[ok] + sign * d])
    centre, context = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (centre, context))
    order = rng.permutation(len(centre))
    labels = np.array([1.0] + [0.0] * negatives)
    for lo in range(0, len(order), STEP_PAIRS):
        pairs = order[lo : lo + STEP_PAIRS]
        own = [bags[c] for c in centre[pairs]]
        flat, lengths = np.array([b for x in own for b in x]), np.array([len(x) for x in own])
        drawn = np.minimum(np.searchsorted(noise, rng.random((len(pairs), negatives)), side="right"), len(noise) - 1)
        targets = np.column_stack([goal[context[pairs]], drawn])
        loss, by_flat, by_target = gradients(inner, outer, flat, np.cumsum(lengths) - lengths, targets, np.broadcast_to(labels, targets.shape))
        step = rate * (1 - lo / len(order))
        np.subtract.at(inner, flat, step * by_flat)
        np.subtract.at(outer, targets, step * by_target)
        total, n = total + float(loss), n + len(pairs)
    return total / max(n, 1)


@dataclass(frozen=True)
class SubwordModel:
    """``table``: stored (code, vec), what training has added to rows 1 to buckets, for words, and those after, for what they predict."""

    table: DataFrame
    size: int
    buckets: int
    ngrams: tuple[int, int]
    seed: int

    def vectors(self, words: DataFrame) -> DataFrame:
        """(token, vec) of the distinct tokens of ``words``."""
        path, size, buckets, ngrams, seed = self.table.stored_at, self.size, self.buckets, self.ngrams, self.seed

        def run(batches):
            inner = initial(size, buckets, seed) + search._matrix(path, 2 * buckets, size)[1 : buckets + 1]
            for batch in batches:
                vec = [inner[bag(w, ngrams, buckets)].mean(axis=0).tolist() for w in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vec, pa.list_(pa.float64()))], ["token", "vec"])

        return words.where("token <> ''").select("token").distinct().mapInArrow(run, "token string, vec array<double>")

    def save(self, path: str) -> None:
        self.table.write.mode("overwrite").parquet(f"{path}/rows")
        one = [(self.size, self.buckets, *self.ngrams, self.seed)]
        self.table.sparkSession.createDataFrame(one, META).write.mode("overwrite").parquet(f"{path}/shape")


def load(spark: SparkSession, path: str) -> SubwordModel:
    m = spark.read.parquet(f"{path}/shape").first()
    return SubwordModel(stored(spark.read.parquet(f"{path}/rows"), "subword-rows"), m["size"], m["buckets"], (m["least"], m["most"]), m["seed"])


def _dealt(sentences: DataFrame, part_words: int) -> tuple[DataFrame, int]:
    """Stored (part, words, times) and the number of parts."""
    words = F.filter("words", lambda w: w.isNotNull() & (w != ""))
    counts = stored(sentences.select(words.alias("words")).where(F.size("words") > 0).groupBy("words").agg(F.count(F.lit(1)).alias("n")), "subword-sentences")
    parts = max(1, -(-int(counts.agg(F.sum(F.size("words") * F.col("n"))).first()[0] or 0) // part_words))
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.least("n", F.lit(parts)) - 1)).alias("k")
    rows = counts.select("words", "n", k)
    part, times = F.pmod(F.xxhash64("words") + F.col("k"), F.lit(parts)), F.floor(F.col("n") / parts) + (F.col("k") < F.col("n") % parts).cast("int")
    return stored(rows.select(part.cast("int").alias("part"), "words", times.cast("int").alias("times")), "subword-parts"), parts


def fit(sentences: DataFrame, size: int = 64, ngrams: tuple[int, int] = (3, 6), seed: int = 7, window: int = 5, negatives: int = 5, rounds: int = 3, rate: float = 0.1, buckets: int = BUCKETS, part_words: int = PART_WORDS) -> SubwordModel:
    """A model of (words: array<string>), by ``rounds`` of all parts."""
    if 2 * buckets * size * 8 > search.MATRIX_BYTES:
        raise ValueError("buckets times size is more than a worker may hold")
    spark = sentences.sparkSession
    dealt, _ = _dealt(sentences, part_words)

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for words, times in zip(batch.column("words").to_pylist(), batch.column("times").to_pylist()):
                for w in words:
                    total[target(w, buckets)] += times
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    noise = np.zeros(buckets)
    for r in dealt.select("words", "times").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS at most
        noise[r["bucket"]] = r["n"] ** 0.75
    noise = np.cumsum(noise / max(noise.sum(), 1e-12))

    table = stored(spark.createDataFrame([], "code long, vec array<double>"), "subword-rows")
    for turn in range(rounds):
        path, own_rate = table.stored_at, rate * (1 - turn / rounds)

        def train(group: pa.Table) -> pa.Table:
            rows = sorted(zip(group.column("words").to_pylist(), group.column("times").to_pylist()))
            before = search._matrix(path, 2 * buckets, size)[1:].copy()
            before[:buckets] += initial(size, buckets, seed)
            after = before.copy()
            train_part([w for w, n in rows for _ in range(n)], after[:buckets], after[buckets:], noise, ngrams, window, negatives, own_rate, [seed, turn, group.column("part")[0].as_py()])
            at = np.flatnonzero((after != before).any(axis=1))
            change = pa.array(np.rint((after[at] - before[at]) * FIXED).astype(np.int64).tolist(), pa.list_(pa.int64()))
            return pa.table([pa.array(at + 1), change], names=["code", "change"])

        changes = dealt.groupBy("part").applyInArrow(train, "code long, change array<long>")
        sums = [F.sum(F.get("change", F.lit(i))).alias(f"s{i}") for i in range(size)]
        mean = changes.groupBy("code").agg(F.count(F.lit(1)).alias("n"), *sums)
        mean = mean.select("code", F.array(*[F.col(f"s{i}") / F.col("n") / FIXED for i in range(size)]).alias("more"))
        both = table.join(mean, "code", "full")
        table = stored(both.select("code", F.when(F.col("vec").isNull(), F.col("more")).when(F.col("more").isNull(), F.col("vec")).otherwise(F.zip_with("vec", "more", lambda a, b: a + b)).alias("vec")), "subword-rows")
    return SubwordModel(table, size, buckets, ngrams, seed)
