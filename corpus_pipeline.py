"""From raw documents to token ids in five stages, each written as Parquet and read again by the next.

1. quality: adaptive thresholds per language and source; rejected documents go.
2. near_duplicates: n-gram Jaccard join; the smallest id of each group stays.
3. repeated_passages: bytes of 50-byte strings that a smaller id has too are cut out of the texts.
4. mixing: Poisson replication to equal shares of all sources; a row's copies keep its doc_id.
5. tokens: byte-level BPE; ids, and whether decoding them gives the text back.

Nulls, empty and very long texts, ties, repeated rows, empty tables and further columns are treated as the operators
define; a null text has no words and so fails the first stage. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, jaccard, mixing, quality, suffixes
from weftline.llm.common import free_shuffles, stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_per_group(docs).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffixes.without_repeats(docs)
    return cut.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.decoded(bpe.with_ids(docs, path, pattern), path, pattern)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixing", mixed),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        free_shuffles(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
