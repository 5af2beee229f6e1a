"""The flagship plan: benchmark phrases as queries, documents as one target sequence.

Tables hold no vectors by word, so a token's vector is the row of ``embeddings`` that its md5 names; every tenth is
left out, as a word without a vector.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.config import SearchConfig
from weftline.functions import text as T
from weftline.functions import tokenize as N
from weftline.functions.tokenize import latin_words
from weftline.operators import passages
from weftline.operators.passages import PassageSearch
from weftline.operators.search import KeyedSpace, space_table
from weftline.operators.vectors import dims_of, distinct_tokens
#: Queries and target are of one language here: as long, short ones a third longer.
CONFIG = SearchConfig(long_adjust=0.0, short_adjust=0.3, method="word")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hashed_id(token: Column, n: int) -> Column:
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long") % n).cast("int")


def known(vec_id: Column) -> Column:
    return vec_id % 10 != 0


def keyed_space(spark: SparkSession, sf_dir: str, tokens: DataFrame) -> KeyedSpace:
    """The names of distinct ``tokens`` that have a vector, and the vectors."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    rows = distinct_tokens(tokens, tokens.columns[0]).withColumn("key", hashed_id(F.col("token"), vectors.count()).cast("long"))
    return KeyedSpace(rows.where(known(F.col("key"))), vectors)


def hashed_space(spark: SparkSession, sf_dir: str, tokens: DataFrame) -> DataFrame:
    """(token, vec) of distinct ``tokens`` that have a vector."""
    return space_table(keyed_space(spark, sf_dir, tokens.select("token")))


def word_table(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    """(key, pos, token)"""
    return table(spark, sf_dir, name).select(key, F.posexplode(latin_words(F.col("text"))).alias("pos", "token"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df``, dealt out by ``key`` only where its files are so few blocks that a task would read more than twice a core's share."""
    counts = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("part")).count().collect()]  # a number a partition
    return df.repartition(key) if max(counts, default=0) * df.sparkSession.sparkContext.defaultParallelism > 2 * sum(counts) else df


def word_arrays(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id") -> DataFrame:
    """(key, words), a row a text."""
    return spread(table(spark, sf_dir, name).select(key, "text"), key).select(key, latin_words(F.col("text")).alias("words"))


#: Terms of the dictionary tokenizer.
TERMS = ["tion", "ther", "the", "th", "ing", "er", "ouble"]


def tokens_of(text: Column, method: str) -> Column:
    """A text's tokens by the name of a tokenizer: words, characters, or dictionary terms and other characters."""
    if method == "word":
        return latin_words(text)
    if method == "char":
        return N.characters(T.strip_query(text))
    if method in ("term", "term2"):
        return N.dictionary(TERMS)(T.strip_query(text))
    raise ValueError(f"{method} not known")


def dims(spark: SparkSession, sf_dir: str) -> int:
    return dims_of(table(spark, sf_dir, "embeddings"), "embedding")


def _target(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    return passages.place(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", tokens_of(F.col("text"), method))


def _queries(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    """(query_id, words): a phrase is its own gold passage."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), tokens_of(F.col("text"), method).alias("words"))


def _space(spark: SparkSession, sf_dir: str, *words: DataFrame) -> DataFrame:
    """The vectors of all words, and of all characters of longer ones."""
    tokens = [distinct_tokens(w, "words") for w in words]
    return hashed_space(spark, sf_dir, tokens[0] if len(tokens) == 1 else tokens[0].unionByName(tokens[1]))


def located(spark: SparkSession, sf_dir: str, config: SearchConfig = CONFIG) -> DataFrame:
    """(query_id, gold_start): where each query itself stands in the documents, without a search."""
    return passages.locate(_target(spark, sf_dir, config.method), _queries(spark, sf_dir, config.method))


def run(spark: SparkSession, sf_dir: str, config: SearchConfig = CONFIG, gold: bool = False, top_n: int | None = None, stats: bool | str = True, ranks: bool = True, texts: bool = False) -> PassageSearch:
    return run_all(spark, sf_dir, [config], gold, top_n, stats, ranks, texts)[0]


def run_all(spark: SparkSession, sf_dir: str, configs: list[SearchConfig], gold: bool = False, top_n: int | None = None, stats: bool | str = True, ranks: bool = True, texts: bool = False) -> list[PassageSearch]:
    """``texts``: whether passages and reports are asked for."""
    method = configs[0].method
    target, queries = _target(spark, sf_dir, method), _queries(spark, sf_dir, method)
    chars = queries.select(F.explode("words").alias("w")).where(F.length("w") > 1).select(N.characters(F.col("w")).alias("words"))
    space = keyed_space(spark, sf_dir, target.select("fresh"))
    own = _space(spark, sf_dir, queries, chars) if method in ("term", "term2") else _space(spark, sf_dir, queries)
    return passages.search_passages(target, space, queries, own, configs, gold=gold, stats=stats, top_n=top_n, dims=dims(spark, sf_dir), ranks=ranks, texts=texts)


#: The other language of ``run_across``: its words are the target's read backwards, and every third of a phrase has no equivalent.
MISSING = 3


def run_across(spark: SparkSession, sf_dir: str, config: SearchConfig, stats: bool | str = True, texts: bool = False) -> PassageSearch:
    """Phrases of another language against the documents: query words and gold passage differ, and so do their spaces. The query
    space has the same directions at half the length, under words read backwards."""
    target, phrases = _target(spark, sf_dir, "word"), _queries(spark, sf_dir, "word")
    other = F.transform(F.filter("words", lambda w, i: i % MISSING != MISSING - 1), F.reverse)
    queries = phrases.select("query_id", other.alias("words"), F.col("words").alias("gold"))
    space = _space(spark, sf_dir, phrases)
    own = space.select(F.reverse("token").alias("token"), F.transform("vec", lambda x: x / 2).alias("vec"))
    return passages.search_passages(target, keyed_space(spark, sf_dir, target.select("fresh")), queries, own, [config], stats=stats, dims=dims(spark, sf_dir), texts=texts)[0]
