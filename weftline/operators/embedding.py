"""The embedding pipeline: spaces are merged, covered, paired, projected, evaluated, trained."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import vector as V
from weftline.operators import subwords
from weftline.operators.search import global_offsets


def merge(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both spaces; the second wins where they share a token."""
    return second.unionByName(first.join(second.select("token"), "token", "left_anti").select(*second.columns))


def coverage(words: DataFrame, space: DataFrame) -> DataFrame:
    """(n_words, n_covered) over distinct words."""
    w = words.select("token").distinct()
    known = space.select("token").distinct().withColumn("_in", F.lit(1))
    return w.join(known, "token", "left").agg(F.count(F.lit(1)).alias("n_words"), F.count("_in").alias("n_covered"))


def pairs_in(pairs: DataFrame, source: DataFrame, target: DataFrame, flip: bool = False, level: str = "word") -> DataFrame:
    """Pairs (src, tgt) with both words in their spaces; level char keeps one-character sources; flip swaps the columns."""
    if level == "char":
        pairs = pairs.where(F.length("src") == 1)
    kept = pairs.join(source.select(F.col("token").alias("src")), "src", "left_semi").join(target.select(F.col("token").alias("tgt")), "tgt", "left_semi")
    a, b = ("tgt", "src") if flip else ("src", "tgt")
    return kept.select(*[c for c in pairs.columns if c not in ("src", "tgt")], F.col(a).alias("first"), F.col(b).alias("second"))


def last_per_key(pairs: DataFrame) -> DataFrame:
    """Of (ord, first, second) the last for each first."""
    return pairs.groupBy("first").agg(F.max_by("second", "ord").alias("second"))


def pair_similarity(pairs: DataFrame, one: DataFrame, two: DataFrame) -> DataFrame:
    """(first, second, similarity); null where a vector has no length."""
    a = one.select(F.col("token").alias("first"), F.col("vec").alias("va"))
    b = two.select(F.col("token").alias("second"), F.col("vec").alias("vb"))
    return pairs.join(a, "first").join(b, "second").select("first", "second", V.cosine(F.col("va"), F.col("vb"), None).alias("similarity"))


def similarity_statistics(rows: DataFrame) -> DataFrame:
    s = F.col("similarity")
    return rows.agg(F.count(s).alias("n"), F.avg(s).alias("mean"), F.stddev_samp(s).alias("std"), F.max(s).alias("max"), F.min(s).alias("min"), F.median(s).alias("median"))


def shuffled_pairs(pairs: DataFrame, seed: int = 0) -> DataFrame:
    """A random partner for each first: all firsts in their order meet all seconds in the order of a seeded md5, rank by rank.
    Ranks come from ranges that are counted apart, so no task has them all."""
    rows = pairs.select("first", "second").withColumn("_one", F.lit(1))
    order = F.struct(F.md5(F.concat(F.lit(f"{seed}:"), "second")).alias("m"), "second")
    left = global_offsets(rows.select(F.struct("first", "second").alias("_k"), "_one"), "_k", "_one").select(F.col("_k.first").alias("first"), "offset")
    right = global_offsets(rows.select(order.alias("_k"), "_one"), "_k", "_one").select(F.col("_k.second").alias("second"), "offset")
    return left.join(right, "offset").select("first", "second")


def translation_matrix(pairs: DataFrame, source: DataFrame, target: DataFrame) -> np.ndarray:
    """W that minimizes |XW - Y|: X'X and X'Y are added up batch by batch in each task, which sends them once, a row for each
    of a vector's components; a d x d system is solved on the driver."""
    x = source.select(F.col("token").alias("first"), F.transform("vec", lambda v: v.cast("double")).alias("x"))
    y = target.select(F.col("token").alias("second"), F.transform("vec", lambda v: v.cast("double")).alias("y"))
    both = pairs.join(x, "first").join(y, "second").select("x", "y")
    one = both.first()
    if one is None:
        raise ValueError("no pair has vectors in both spaces")
    d, wide = len(one["x"]), len(one["x"]) + len(one["y"])

    def products(batches):
        total = np.zeros((d, wide))
        for batch in batches:
            x, y = (np.asarray(c.flatten(), np.float64).reshape(batch.num_rows, -1) for c in batch.columns)
            total += x.T @ np.hstack([x, y])
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(total.tolist())], ["i", "row"])

    sums = both.mapInArrow(products, "i int, row array<double>").groupBy("i").agg(*(F.sum(F.get("row", F.lit(j))).alias(f"s{j}") for j in range(wide)))
    m = np.array([r[1:] for r in sorted(sums.collect())])  # d x 2d numbers
    return np.linalg.lstsq(m[:, :d], m[:, d:], rcond=None)[0]


def project(space: DataFrame, w: np.ndarray) -> DataFrame:
    """Vectors times W, whose size is that of a vector squared, batch by batch. A null vector stays null."""

    @F.arrow_udf("array<double>")
    def times(v: pa.Array) -> pa.Array:
        known = v.drop_null()
        out = np.asarray(known.flatten(), np.float64).reshape(len(known), w.shape[0]) @ w
        sizes = np.where(np.asarray(v.is_valid()), w.shape[1], 0)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.reshape(-1)), mask=pa.array(~np.asarray(v.is_valid())))

    return space.withColumn("vec", times(F.transform("vec", lambda x: x.cast("double"))))


def fit_words(sentences: DataFrame, size: int = 64, ngrams: tuple[int, int] | None = None, seed: int = 7, window: int = 5, **how) -> subwords.SubwordModel:
    """A model of (words: array<string>); with ``ngrams`` a word also stands for its character n-grams of these lengths. The
    model has vectors(words) and save(path)."""
    return subwords.fit(sentences, size, ngrams or (1, 0), seed, window, **how)


def words_of(sentences: DataFrame) -> DataFrame:
    return sentences.select(F.explode("words").alias("token")).distinct()


def train_words(sentences: DataFrame, size: int = 64, ngrams: tuple[int, int] | None = None, seed: int = 7, window: int = 5, **how) -> DataFrame:
    """(token, vec) of the sentences' own words by ``fit_words``."""
    return fit_words(sentences, size, ngrams, seed, window, **how).vectors(words_of(sentences))


def load_words(spark: SparkSession, path: str) -> subwords.SubwordModel:
    """A saved model."""
    return subwords.load(spark, path)


def plane(space: DataFrame, k: int = 2) -> DataFrame:
    """``space`` with its first k principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = space.withColumn("_v", array_to_vector(F.transform("vec", lambda x: x.cast("double"))))
    return PCA(k=k, inputCol="_v", outputCol="_p").fit(rows).transform(rows).withColumn("plane", vector_to_array("_p")).drop("_v", "_p")


def first_labels(rows: DataFrame) -> DataFrame:
    """Of rows (ord, label, ...) the first per label."""
    w = Window.partitionBy("label").orderBy("ord")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
