"""Readers; every file is read by Spark, so any store that Spark reads will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.text import clean, simplify


def read_csv(spark: SparkSession, path: str, columns: list[str], sep: str = ",", mapping: dict[str, str] | None = None, header: bool = True) -> DataFrame:
    """All columns as strings, empty rows left out; ``mapping`` simplifies characters."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.csv(path, schema=schema, sep=sep, header=header, multiLine=True, quote='"', escape='"', nullValue="\u0000", emptyValue="")
    df = df.where(" or ".join(f"`{c}` is not null" for c in columns))
    return df.select(*(simplify(F.col(c), mapping).alias(c) for c in columns)) if mapping else df


def read_alignment(spark: SparkSession, path: str, columns: tuple[str, ...] = ("target", "query", "score")) -> DataFrame:
    """(row_no, target, query, score): one file of an alignment in file order."""
    df = read_csv(spark, path, list(columns)).withColumn("_id", F.monotonically_increasing_id())
    return df.withColumn("row_no", (F.row_number().over(Window.orderBy("_id")) - 1).cast("long")).drop("_id")  # one file


def searched_phrases(alignment: DataFrame, leave_out: tuple[int, ...] = (), score: str = "5") -> DataFrame:
    """Phrases with the given score, numbered from 0 in file order, less those left out."""
    no = F.row_number().over(Window.orderBy("row_no")) - 1  # one file
    rows = alignment.where(F.col("score") == score).withColumn("query_id", no.cast("long"))
    return rows.where(~F.col("query_id").isin(*leave_out)) if leave_out else rows


def read_text(spark: SparkSession, path: str, mapping: dict[str, str] | None = None, cleaned: bool = False) -> DataFrame:
    """(path, text): whole files."""
    df = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    df = df.withColumn("text", simplify(F.col("text"), mapping)) if mapping else df
    return df.withColumn("text", clean(F.col("text"))) if cleaned else df


def read_dir(spark: SparkSession, path: str, mapping: dict[str, str] | None = None, cleaned: bool = False) -> DataFrame:
    """(label, text) of all files below ``path``, in order of label and text; the label is the file's name."""
    df = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    text = F.col("value")
    text = simplify(text, mapping) if mapping else text
    df = df.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("label"), (clean(text) if cleaned else text).alias("text"))
    return df.orderBy("label", "text")


def read_vec(spark: SparkSession, path: str) -> DataFrame:
    """(token, vec) from .vec text: a header line of two numbers, then a word and its numbers."""
    parts = F.split("value", " ")
    rows = spark.read.text(path).where("value <> ''").where(F.size(parts) > 2)
    return rows.select(parts[0].alias("token"), F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), lambda x: x.cast("double")).alias("vec"))


def read_utterances(spark: SparkSession, path: str, mark: str = "<utt>\n") -> DataFrame:
    """(text) by utterance."""
    return spark.read.option("lineSep", mark).text(path).withColumnRenamed("value", "text")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(ord, src, tgt) of a glossary, blank lines left out."""
    parts = F.split("value", ",")
    rows = spark.read.text(path).where("value <> ''").withColumn("ord", F.monotonically_increasing_id())
    return rows.select("ord", parts[0].alias("src"), F.get(parts, F.lit(1)).alias("tgt"))


def read_first_lines(spark: SparkSession, path: str, n: int = 100) -> DataFrame:
    return spark.read.text(path).withColumn("ord", F.monotonically_increasing_id()).orderBy("ord").limit(n).select(F.col("value").alias("term"))
