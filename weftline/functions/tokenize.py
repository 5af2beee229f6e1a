"""Tokenizers as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.shared import collected

SENTENCE_END = r"[\n。？！．]"
PHRASE_END = r"[。？！；：、，「」『』《》 *()○]"
BRACKETS = "[]()"
#: Terms up to which one alternation is compiled; beyond it ``with_words`` takes a trie.
REGEX_TERMS = 10_000
#: Terms that the driver holds.
MOST_TERMS = 5_000_000


def characters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def words(c: Column) -> Column:
    return F.split(c, " ")


def paragraphs(c: Column) -> Column:
    return F.split(c, "\n\n")


def sentences(c: Column) -> Column:
    return F.split(c, SENTENCE_END)


def phrases(c: Column) -> Column:
    return F.split(c, PHRASE_END)


def flatten(c: Column) -> Column:
    return F.filter(F.flatten(c), lambda x: x != "")


def latin_words(c: Column) -> Column:
    """Runs of a-z, after A-Z are lower-cased."""
    return F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z]+"), F.lit(0)), F.lower)


def clean_terms(terms: list[str]) -> list[str]:
    """Distinct terms without brackets and blanks, longest first; ties in order of text."""
    found = {t.translate(str.maketrans("", "", BRACKETS)) for t in terms if t}
    return sorted(found - {""}, key=lambda t: (-len(t), t))


def dictionary(terms: list[str]) -> Callable[[Column], Column]:
    """Leftmost longest dictionary words, everything else by characters."""
    quoted = ["\\Q" + t.replace("\\E", "\\E\\\\E\\Q") + "\\E" for t in clean_terms(terms)]
    pattern = "(?s)(" + "|".join([*quoted, "."]) + ")"
    return lambda c: F.regexp_extract_all(c, F.lit(pattern), F.lit(1))


def sentences_of_words(c: Column, terms: list[str], segment: Callable[[Column], Column] | None = None) -> Column:
    """Paragraphs, sentences, phrases, words: an array of words for each sentence that has some. A word of the
    dictionary that holds the end of a phrase or sentence is cut there, as its marks would be. What follows a phrase's
    last dictionary word, if it has two characters or more, is cut by ``segment``, a segmenter from text to words; without
    one it falls into characters, as what stands before dictionary words does."""
    cut = dictionary(terms)
    known = F.array(*[F.lit(t) for t in clean_terms(terms)]) if terms else F.expr("cast(array() as array<string>)")

    def words_in(phrase: Column) -> Column:
        found = cut(phrase)
        if segment is None:
            return found
        last = F.coalesce(F.array_max(F.transform(found, lambda w, i: F.when(F.array_contains(known, w), i + 1))), F.lit(0))
        tail = F.array_join(F.slice(found, last + 1, F.size(found) - last), "")
        return F.when(F.length(tail) > 1, F.concat(F.slice(found, F.lit(1), last), segment(tail))).otherwise(found)

    whole = flatten(F.transform(paragraphs(c), sentences))
    return F.filter(F.transform(whole, lambda s: flatten(F.transform(phrases(s), words_in))), lambda ws: F.size(ws) > 0)


def as_string(sentences: Column, between: str) -> Column:
    """Sentences of words as text: words by spaces, sentences by ``between``."""
    return F.array_join(F.transform(sentences, lambda ws: F.array_join(ws, " ")), between)


def reparsed(words: Column, terms: list[str]) -> Column:
    """A sentence's words, joined and cut anew by a dictionary."""
    return dictionary(terms)(F.array_join(words, ""))


def with_words(df: DataFrame, text: str, terms: list[str], out: str = "tokens") -> DataFrame:
    """``df`` with dictionary words: by one pattern, or by a stored dictionary where that would be too large. Results are the
    same. Terms that are a table needn't pass the driver: see ``dictionary.tokenize_with``."""
    if len(own := clean_terms(terms)) > REGEX_TERMS:
        from weftline.functions.dictionary import dictionary_of, tokenize_with

        return tokenize_with(df, text, dictionary_of(df.sparkSession.createDataFrame([(t,) for t in own], "term string")), out)
    return df.withColumn(out, dictionary(own)(F.col(text)))


def read_terms(spark: SparkSession, path: str) -> list[str]:
    """A term list, one per line. Term lists are dictionaries of a language; one of more than MOST_TERMS lines is refused."""
    return collected(spark.read.text(path).distinct(), MOST_TERMS, path)["value"].tolist()
