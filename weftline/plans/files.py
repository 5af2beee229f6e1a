"""Tables through files: each query writes a given table to the shared folder by a writer and reads it by a reader; and the
operators on texts that no other query reaches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import dictionary as D
from weftline.functions import text as T
from weftline.functions import tokenize as N
from weftline.functions import vector as V
from weftline.operators import embedding, vectors
from weftline.plans import passage_search as P
from weftline.plans import queries as Q
from weftline.sources import readers, writers
from weftline.sources.shared import shared_folder

#: Characters that ``clean_files`` replaces, as a conversion of a script would.
MAPPING = {"e": "é", "a": "à"}
#: What ``removed_words`` cuts texts at.
REMOVED = "the"
LEFT_OUT = (2,)


def csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted fields with commas and line ends."""
    path = shared_folder(spark, "csv")
    rows = P.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows.write.csv(path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    back = readers.read_csv(spark, path, rows.columns)
    return back.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.md5("text").alias("text_md5"))


def alignment_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of an alignment in one file, the rows of score 5, numbered, less those left out."""
    path = shared_folder(spark, "alignment")
    score = F.when(F.col("item_id") % 3 == 0, "4").otherwise("5")
    rows = P.table(spark, sf_dir, "benchmark").orderBy("item_id").select(F.col("text").alias("target"), F.reverse("text").alias("query"), score.alias("score"))
    rows.coalesce(1).write.csv(path, header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    found = readers.searched_phrases(readers.read_alignment(spark, path), LEFT_OUT)
    return found.select("query_id", "row_no", F.md5("query").alias("query_md5"))


def _item_files(spark: SparkSession, sf_dir: str) -> str:
    path = shared_folder(spark, "items")
    writers.write_reports(P.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("report")), path, "item_id")
    return path


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole files; the id is in the path."""
    rows = readers.read_text(spark, f"{_item_files(spark, sf_dir)}/*/*.txt")
    return rows.select(F.regexp_extract("path", "item_id=([0-9]+)", 1).cast("long").alias("item_id"), F.md5("text").alias("text_md5"))


def clean_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = readers.read_text(spark, f"{_item_files(spark, sf_dir)}/*/*.txt", MAPPING, cleaned=True)
    return rows.select(F.regexp_extract("path", "item_id=([0-9]+)", 1).cast("long").alias("item_id"), "text")


def folder_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files below a folder."""
    return readers.read_dir(spark, _item_files(spark, sf_dir)).groupBy(F.md5("text").alias("text_md5")).agg(F.count(F.lit(1)).alias("n"))


def vec_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "vec")
    writers.write_vec(P.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("token"), F.transform("embedding", lambda x: x.cast("double")).alias("vec")), path)
    rows = readers.read_vec(spark, path)
    return rows.select(F.col("token").cast("long").alias("token"), F.size("vec").alias("n"), F.round(V.norm(F.col("vec")), 6).alias("norm"), F.round(F.col("vec")[0], 6).alias("v0"))


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "utterances")
    P.table(spark, sf_dir, "documents").select(F.col("text").alias("value")).where("value is not null").write.option("lineSep", "<utt>\n").text(path)
    return readers.read_utterances(spark, path).groupBy(F.md5("text").alias("text_md5")).agg(F.count(F.lit(1)).alias("n"))


def pair_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "pairs")
    writers.write_pairs(Q.pair_filter(spark, sf_dir).select("first", "second"), path)
    return readers.read_pairs(spark, path).groupBy("src", "tgt").agg(F.count(F.lit(1)).alias("n"))


def similarity_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "similarities")
    writers.write_similarities(Q.pair_similarity(spark, sf_dir), path)
    return spark.read.csv(path, "first string, second string, similarity double")


def term_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary by a file: distinct terms, longest first."""
    path = shared_folder(spark, "terms")
    P.word_table(spark, sf_dir, "benchmark", "item_id").select(F.col("token").alias("value")).write.text(path)
    terms = N.clean_terms(N.read_terms(spark, path))
    return spark.createDataFrame(list(enumerate(terms)), "place long, term string")


def dictionary_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary that goes from a file to the workers: all words of the documents that have four letters or more, or are
    a phrase's own."""
    path = shared_folder(spark, "dictionary")
    words = P.word_table(spark, sf_dir).where(F.length("token") >= 4).select("token").unionByName(P.word_table(spark, sf_dir, "benchmark", "item_id").select("token"))
    words.select(F.col("token").alias("value")).write.text(path)
    rows = D.tokenize_with(P.table(spark, sf_dir, "benchmark").select("item_id", "text"), "text", D.read_dictionary(spark, path))
    return rows.select("item_id", F.size("tokens").alias("n"), F.array_join("tokens", "|").alias("tokens"))


def first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred most frequent words, as the first lines of a file."""
    path = shared_folder(spark, "frequent")
    counts = P.word_table(spark, sf_dir).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    counts.orderBy(F.desc("n"), "token").limit(150).select(F.col("token").alias("value")).coalesce(1).write.text(path)
    return readers.read_first_lines(spark, path, 100)


def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder for each query's report."""
    path = shared_folder(spark, "reports")
    writers.write_reports(Q.phrase_report(spark, sf_dir), path)
    rows = spark.read.text(path, wholetext=True)  # query_id is a partition
    return rows.select(F.col("query_id").cast("long").alias("query_id"), F.md5("value").alias("report_md5"))


def compiled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus of sentences of words, a sentence a line."""
    path = shared_folder(spark, "corpus")
    docs = P.table(spark, sf_dir, "documents").where("text is not null")
    writers.compile_text(docs.select(F.transform(F.split("text", "\n"), N.words).alias("text")), path)
    return spark.read.option("lineSep", "\n").text(path).groupBy(F.md5("value").alias("line_md5")).agg(F.count(F.lit(1)).alias("n"))


def _marked() -> F.Column:
    """Texts in which a letter stands for the syllable mark."""
    return F.translate(F.col("text"), "e", T.SYLLABLE)


def target_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = T.target_tokens(_marked())
    return P.table(spark, sf_dir, "documents").select("doc_id", F.size(words).alias("n"), F.md5(F.array_join(words, "|")).alias("words_md5"))


def gold_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = T.target_tokens(_marked(), drop_empty=False)
    return P.table(spark, sf_dir, "benchmark").select("item_id", F.size(words).alias("n"), F.array_join(words, "|").alias("words"))


def removed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.document_tokens(P.table(spark, sf_dir, "documents"), "doc_id", "text", REMOVED)
    return rows.groupBy("doc_id", "sent").agg(F.count(F.lit(1)).alias("n"), F.min("token").alias("least"), F.max("token").alias("most"))


def space_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = N.words(F.col("text"))
    return P.table(spark, sf_dir, "documents").select("doc_id", F.size(words).alias("n"), F.md5(F.array_join(words, "|")).alias("words_md5"))


def clean_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaning that leaves punctuation, takes blanks alone, and further patterns."""
    kept = T.clean(F.col("html"), whitespace=False, newlines=False, other=("[Q-Z]+", "é."), keep_punctuation=True, blanks=True)
    return P.table(spark, sf_dir, "pages").select("page_id", kept.alias("cleaned"))


def whole_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases that are keys of the space themselves take that vector."""
    w = P.word_table(spark, sf_dir, "benchmark", "item_id")
    texts = P.table(spark, sf_dir, "benchmark").select("item_id", F.array_join(N.latin_words(F.col("text")), " ").alias("phrase"))
    chars = w.select("item_id", "pos", F.explode(F.split("token", "")).alias("token")).where("token <> ''")
    tokens = w.unionByName(chars).select("token").unionByName(texts.select(F.col("phrase").alias("token")))
    v = vectors.phrase_vectors(w.join(texts, "item_id"), P.hashed_space(spark, sf_dir, tokens), ["item_id"], F.col("phrase"), P.dims(spark, sf_dir))
    return v.select("item_id", F.round(V.norm(F.col("vec")), 6).alias("norm"), F.round(F.col("vec")[0], 6).alias("v0"))


def first_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ord"), "label")
    return embedding.first_labels(rows).select("ord", "label")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        csv_rows, alignment_phrases, text_files, clean_files, folder_texts, vec_file, utterances, pair_file, similarity_file, term_list, dictionary_tokens, first_lines,
        report_files, compiled_lines, target_words, gold_words, removed_words, space_words, clean_kept, whole_phrases, first_labels,
    )
    return {f.__name__: f for f in found}
