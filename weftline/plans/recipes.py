"""From a folder of texts to a vector space: compile, cut, train, write, check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import tokenize as N
from weftline.operators import embedding
from weftline.sources import readers, writers


def corpus_words(spark: SparkSession, folder: str, method: str = "word", terms: list[str] | None = None, mapping: dict[str, str] | None = None) -> DataFrame:
    """(label, words), a row a line: characters, words between spaces, or words joined and cut anew by a dictionary."""
    lines = readers.read_dir(spark, folder, mapping).select("label", F.explode(F.split("text", "\n")).alias("line"))
    if method == "term":
        return N.with_words(lines.withColumn("line", F.replace("line", F.lit(" "), F.lit(""))), "line", terms or [], "words").select("label", "words")
    cut = {"char": N.characters, "word": N.words}
    if method not in cut:
        raise ValueError(f"{method} not known")
    return lines.select("label", F.filter(cut[method](F.col("line")), lambda w: w != "").alias("words"))


def create_space(spark: SparkSession, folder: str, out: str, method: str = "word", terms: list[str] | None = None, size: int = 64, ngrams: tuple[int, int] | None = None, extra: DataFrame | None = None) -> DataFrame:
    """Train on the texts of ``folder``; write the corpus, the model and the .vec text below ``out``; returns (token, vec).
    ``extra`` (token): terms that the space shall have too; those that the texts lack get their vectors from their subwords."""
    words = corpus_words(spark, folder, method, terms)
    writers.compile_text(words.select(F.array_join("words", " ").alias("text")), f"{out}/corpus")
    words = words.where(F.size("words") > 0)
    model = embedding.fit_words(words, size, ngrams)
    model.save(f"{out}/model")
    tokens = embedding.words_of(words)
    space = model.vectors(tokens if extra is None else tokens.unionByName(extra.select("token")))
    writers.write_vec(space, f"{out}/vec")
    return space


def map_spaces(source: DataFrame, target: DataFrame, glossary: DataFrame, out: str, flip: bool = True, level: str = "word") -> dict[str, float]:
    """Pairs of ``glossary`` (ord, src, tgt) that both spaces have, the source space projected into the target's by them,
    and how similar the pairs are then; the pairs and the similarities are written below ``out``."""
    one, two = (target, source) if flip else (source, target)
    pairs = embedding.pairs_in(glossary, *((source, target)), flip=flip, level=level)
    writers.write_pairs(pairs.select("first", "second"), f"{out}/pairs")
    own = embedding.last_per_key(pairs)
    projected = embedding.project(two, embedding.translation_matrix(own.select(F.col("second").alias("first"), F.col("first").alias("second")), two, one))
    rows = embedding.pair_similarity(own, one, projected)
    writers.write_similarities(rows, f"{out}/similarities")
    return embedding.similarity_statistics(rows).first().asDict()
