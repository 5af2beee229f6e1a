"""One query per operator over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.config import grid
from weftline.functions import text as T
from weftline.functions import tokenize as N
from weftline.functions import vector as V
from weftline.operators import cluster, embedding, extension, report, reuse, search, vectors
from weftline.plans import passage_search as P
from weftline.sources.shared import stored

TERMS = P.TERMS


def _embeddings(spark, sf_dir):
    return P.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"), "label")


def _matrix(method: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _embeddings(spark, sf_dir)
        return vectors.compare_all(rows.where("id % 50 = 0"), rows, "id", method).select("a", "b", F.round("value", 6).alias("value"))

    return run


def clean_text(spark, sf_dir):
    return P.table(spark, sf_dir, "pages").select("page_id", T.clean(F.col("html")).alias("cleaned"))


def strip_punct(spark, sf_dir):
    s = T.strip_query(F.col("text"))
    return P.table(spark, sf_dir, "documents").select("doc_id", F.md5(s).alias("stripped_md5"), F.length(s).alias("n_chars_left"))


def sent_split(spark, sf_dir):
    return P.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(N.sentences(F.col("text"))).alias("pos", "sentence"))


def phrase_split(spark, sf_dir):
    return P.table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(N.phrases(F.col("text"))).alias("pos", "phrase"))


def char_tokens(spark, sf_dir):
    return P.table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(N.characters(F.col("text"))).alias("pos", "token"))


def dict_tokens(spark, sf_dir):
    cut = N.dictionary(TERMS)
    return P.table(spark, sf_dir, "documents").select("doc_id", F.size(cut(F.col("text"))).alias("n_tokens"), F.md5(F.array_join(cut(F.col("text")), "|")).alias("tokens_md5"))


def dict_sentences(spark, sf_dir):
    return P.table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(N.sentences_of_words(F.col("text"), TERMS)).alias("sent", "words")).select("item_id", "sent", F.array_join("words", "|").alias("words"))


def find_all(spark, sf_dir):
    return P.table(spark, sf_dir, "documents").select("doc_id", F.explode(T.find_all(F.lit("the"), F.col("text"))).alias("at"))


def seed_index(spark, sf_dir):
    s = reuse.seeds(P.table(spark, sf_dir, "benchmark"), "item_id", "text", 2)
    return reuse.seed_index(s, "item_id").select("item_id", "seed", F.array_join("positions", ",").alias("positions"))


def term_category(spark, sf_dir):
    c = P.table(spark, sf_dir, "documents").select(F.explode(N.characters(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return c.select("term", "n", T.category(F.col("term")).alias("category"))


def group_rows(spark, sf_dir):
    rows = P.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("v"))
    return rows.select("conv_id", F.size("v").alias("n"), F.array_join(F.transform("v", lambda x: x["role"]), ",").alias("roles"))


def _doc_vectors(spark, sf_dir):
    texts = P.word_arrays(spark, sf_dir)
    return vectors.text_means(texts, P.keyed_space(spark, sf_dir, texts.select("words")), "doc_id", dims=P.dims(spark, sf_dir))


def doc_vectors(spark, sf_dir):
    return _doc_vectors(spark, sf_dir).select("doc_id", F.posexplode("vec").alias("dim", "v")).select("doc_id", "dim", F.round("v", 6).alias("value"))


def _sentences(spark, sf_dir):
    s = P.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("sent", "line"))
    return s.select("doc_id", "sent", F.explode(N.latin_words(F.col("line"))).alias("token"))


def sent_vectors(spark, sf_dir):
    t = _sentences(spark, sf_dir)
    v = vectors.sentence_vectors(t, P.keyed_space(spark, sf_dir, t.select("token")), "doc_id", P.dims(spark, sf_dir))
    return v.select("doc_id", "sent", "n", F.round(V.norm(F.col("vec")), 6).alias("norm"), F.round(F.col("vec")[0], 6).alias("v0"))


def doc_sentence_means(spark, sf_dir):
    t = _sentences(spark, sf_dir)
    v = vectors.document_vectors(t, P.keyed_space(spark, sf_dir, t.select("token")), "doc_id", "sentences", P.dims(spark, sf_dir))
    return v.select("doc_id", F.col("n").alias("n_sentences"), F.round(V.norm(F.col("vec")), 6).alias("norm"), F.round(F.col("vec")[0], 6).alias("v0"))


def _doc_pairs(method):
    def run(spark, sf_dir):
        d = stored(_doc_vectors(spark, sf_dir), "doc-vectors")  # read for the queries and for the rows
        return vectors.compare_all(d.where("doc_id % 50 = 0"), d, "doc_id", method).select("a", "b", F.round("value", 6).alias("value"))

    return run


def vector_sum(spark, sf_dir):
    return vectors.sum_vectors(_embeddings(spark, sf_dir), ["label"]).select("label", F.posexplode("vec").alias("dim", "v")).select("label", "dim", F.round("v", 5).alias("value"))


def center_space(spark, sf_dir):
    c = vectors.centered(_embeddings(spark, sf_dir).select(F.col("id").alias("token"), "vec"))
    return c.select("token", F.round(V.norm(F.col("vec")), 6).alias("norm"))


def vocab_coverage(spark, sf_dir):
    w = P.word_table(spark, sf_dir)
    return embedding.coverage(w, P.hashed_space(spark, sf_dir, w))


def _glossary(spark, sf_dir):
    w = P.word_table(spark, sf_dir, "benchmark", "item_id")
    nxt = F.lead("token").over(Window.partitionBy("item_id").orderBy("pos"))
    return w.select((F.col("item_id") * 1000 + F.col("pos")).alias("ord"), F.col("token").alias("src"), nxt.alias("tgt")).where("tgt is not null")


def _kept_pairs(spark, sf_dir, **how):
    w = P.word_table(spark, sf_dir, "benchmark", "item_id")
    s = P.hashed_space(spark, sf_dir, w)
    return embedding.pairs_in(_glossary(spark, sf_dir), s, s, **how), s


def pair_filter(spark, sf_dir):
    return _kept_pairs(spark, sf_dir)[0]


def pair_flip(spark, sf_dir):
    return _kept_pairs(spark, sf_dir, flip=True)[0]


def pair_similarity(spark, sf_dir):
    p, s = _kept_pairs(spark, sf_dir)
    return embedding.pair_similarity(embedding.last_per_key(p), s, s).select("first", "second", F.round("similarity", 6).alias("similarity"))


def pair_similarity_stats(spark, sf_dir):
    return embedding.similarity_statistics(pair_similarity(spark, sf_dir)).select("n", *(F.round(c, 6).alias(c) for c in ("mean", "std", "max", "min", "median")))


def random_pair_stats(spark, sf_dir):
    p, s = _kept_pairs(spark, sf_dir)
    sims = embedding.pair_similarity(embedding.shuffled_pairs(p), s, s)
    return embedding.similarity_statistics(sims).select("n", *(F.round(c, 6).alias(c) for c in ("mean", "std", "max", "min", "median")))


def embedding_merge(spark, sf_dir):
    e = _embeddings(spark, sf_dir).select(F.col("id").alias("token"), "vec", "label")
    second = e.where("label = 0").select("token", F.transform("vec", lambda x: -x).alias("vec"))
    return embedding.merge(e.select("token", "vec"), second).select("token", F.round(F.col("vec")[0], 6).alias("v0"))


def search_length(spark, sf_dir):
    c = P.CONFIG
    n = F.size(N.latin_words(F.col("text")))
    return P.table(spark, sf_dir, "benchmark").select("item_id", n.alias("n_tokens"), search.search_length(n, c.long_adjust, c.short_adjust, c.short_length).alias("search_len"))


def length_stats(spark, sf_dir):
    s = search_length(spark, sf_dir)
    return s.agg(F.count("n_tokens").alias("n"), F.sum("n_tokens").alias("total"), F.round(F.avg("n_tokens"), 6).alias("mean"), F.median("n_tokens").alias("median"))


def phrase_vectors(spark, sf_dir):
    w = P.word_table(spark, sf_dir, "benchmark", "item_id")
    v = vectors.phrase_vectors(w, P.hashed_space(spark, sf_dir, w.unionByName(w.select("item_id", "pos", F.explode(F.split("token", "")).alias("token")).where("token <> ''"))), ["item_id"], dims=P.dims(spark, sf_dir))
    return v.select("item_id", "n", F.round(V.norm(F.col("vec")), 6).alias("norm"), F.round(F.col("vec")[0], 6).alias("v0"))


def window_vectors(spark, sf_dir):
    texts = P.word_arrays(spark, sf_dir)
    v = vectors.text_windows(texts, P.keyed_space(spark, sf_dir, texts.select("words")), 10)
    return v.select("doc_id", "start", "n_known", F.round(V.norm(F.col("vec")), 6).alias("norm"), F.round(F.col("vec")[0], 6).alias("v0"))


def _topk(spark, sf_dir, k, config=P.CONFIG):
    s = P.run(spark, sf_dir, config, top_n=k, stats=False)
    return search.ranked(s.found, k).join(s.queries, "query_id").select("query_id", "rank", "start", (F.col("start") + F.col("search_len") - 1).alias("end"), "similarity")


def passage_search_topk(spark, sf_dir, k: int = 10):
    return _topk(spark, sf_dir, k)


def passage_search_euclid(spark, sf_dir, k: int = 10):
    return _topk(spark, sf_dir, k, replace(P.CONFIG, metric="euclidean"))


def passage_search_chars(spark, sf_dir, k: int = 10):
    return _topk(spark, sf_dir, k, replace(P.CONFIG, method="char"))


def passage_search_terms(spark, sf_dir, k: int = 10):
    return _topk(spark, sf_dir, k, replace(P.CONFIG, method="term"))


def global_rank(spark, sf_dir):
    return P.run(spark, sf_dir, gold=True, top_n=0, stats="count").predicted_ranks()


def sim_stats(spark, sf_dir):
    return search.statistics(P.run(spark, sf_dir, top_n=0).found).select("query_id", "n_windows", F.round("mean_sim", 5).alias("mean_sim"), F.round("std_sim", 5).alias("std_sim"))


def locate_phrase(spark, sf_dir):
    return P.located(spark, sf_dir)


def merge_islands(spark, sf_dir):
    return P.run(spark, sf_dir, stats=False).clusters().select("query_id", "cluster_no", "begin", "end", "best_rank", "optimal_start", "n_hits")


def cluster_rank(spark, sf_dir):
    return P.run(spark, sf_dir, stats=False).clusters().select("query_id", "cluster_no", "best_rank", F.round("optimal_similarity", 6).alias("similarity"))


def merge_greedy(spark, sf_dir):
    return P.run(spark, sf_dir, replace(P.CONFIG, cluster_mode="greedy"), stats=False).clusters()


def overlap_pct(spark, sf_dir):
    s = P.run(spark, sf_dir, gold=True, stats=False, ranks=False)
    return cluster.overlaps(s.clusters(), s.gold()).select("query_id", "cluster_no", F.round("pct", 6).alias("pct"))


def hit_flags(spark, sf_dir):
    return P.run(spark, sf_dir, gold=True, stats=False, ranks=False).flags()


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def run_summary(spark, sf_dir):
    return _rounded(P.run(spark, sf_dir, gold=True, stats="count").summary())


def run_report(spark, sf_dir):
    s = P.run(spark, sf_dir, gold=True, stats="count")
    windows = search.statistics(s.found).agg(F.max("n_windows").alias("windows"))
    return report.run_report(s.summary().join(F.broadcast(windows), F.lit(True)), "benchmark", s.config, F.col("windows"))  # one row


def phrase_report(spark, sf_dir):
    return P.run(spark, sf_dir, gold=True, texts=True).report()


#: Of a search across languages: query words are fewer than those of their passages.
ACROSS = replace(P.CONFIG, long_adjust=0.4, short_adjust=0.6, top_n=50)


def across_report(spark, sf_dir):
    return P.run_across(spark, sf_dir, ACROSS, texts=True).report()


def across_summary(spark, sf_dir):
    return _rounded(P.run_across(spark, sf_dir, ACROSS, stats="count").summary())


def param_grid(spark, sf_dir):
    configs = grid(long_adjust=[0.0, 0.4], short_adjust=[0.3], top_n=[100, 500], method=["word"])
    out = None
    for s in P.run_all(spark, sf_dir, configs, gold=True, stats="count"):
        cols = ("clustered_median", "clustered_mean", "partial_median", "partial_mean", "rank_median", "rank_mean", "top_full_ratio", "any_full_ratio", "any_some_ratio")
        row = s.summary().select(F.lit(s.config.results_dir("benchmark")).alias("config"), *(F.round(c, 6).alias(c) for c in cols))
        out = row if out is None else out.unionByName(row)
    return out


def _seeds5(spark, sf_dir):
    return reuse.text_seeds(P.word_arrays(spark, sf_dir, "benchmark", "item_id"), "item_id", "words", 5), reuse.text_seeds(P.word_arrays(spark, sf_dir), "doc_id", "words", 5)


def shared_seeds(spark, sf_dir):
    return reuse.shared_seeds(*_seeds5(spark, sf_dir))


def match_locations(spark, sf_dir):
    a, b = _seeds5(spark, sf_dir)
    return reuse.locations(a.withColumnRenamed("pos", "i"), b.withColumnRenamed("pos", "j")).select("item_id", "i", "doc_id", "j")


def shared_seeds_vec(spark, sf_dir):
    w = P.word_table(spark, sf_dir, "benchmark", "item_id")
    v = reuse.seed_vectors(w, P.hashed_space(spark, sf_dir, w), "item_id", 4)
    return reuse.similar_seeds(v, v)


def _gated(spark, sf_dir):
    """Places whose windows of 10 are similar, the words of both tables' texts that have a place, the space and its book."""
    seeds = _seeds5(spark, sf_dir)
    places = stored(reuse.locations(seeds[0].withColumnRenamed("pos", "i"), seeds[1].withColumnRenamed("pos", "j")).select("item_id", "i", "doc_id", "j"), "gate-places")
    near = lambda name, key: stored(reuse.near_texts(P.table(spark, sf_dir, name).select(key, "text"), places, key).select(key, N.latin_words(F.col("text")).alias("words")), "gate-texts")
    a, b = near("benchmark", "item_id"), near("documents", "doc_id")
    s = P.keyed_space(spark, sf_dir, a.select("words").unionByName(b.select("words")))
    rows, book = reuse.gated(places, a, b, "item_id", "doc_id", s)
    return rows, a, b, s, book


def chunk_gate(spark, sf_dir):
    return _gated(spark, sf_dir)[0].select("item_id", "i", "doc_id", "j", "similarity")


def best_location(spark, sf_dir):
    rows = _gated(spark, sf_dir)[0]
    return reuse.best_start(rows, ["item_id", "doc_id"])


def optimize_start(spark, sf_dir):
    return _gated(spark, sf_dir)[0].select("item_id", "i", "doc_id", "j", "start_a", "start_b", F.col("best").alias("similarity"))


def extend_match(spark, sf_dir):
    rows, a, b, s, book = _gated(spark, sf_dir)
    places = stored(rows.select(F.col("item_id").alias("key_a"), F.col("doc_id").alias("key_b"), "i", "j"), "gate-passed")
    n = P.dims(spark, sf_dir)
    return extension.extend_places(places, extension.word_blocks(a, s, "item_id", n, book), extension.word_blocks(reuse.near_texts(b, places.withColumnRenamed("key_b", "doc_id"), "doc_id"), s, "doc_id", n, book))


def align_sequences(spark, sf_dir):
    w = P.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.explode(N.latin_words(F.col("text"))).alias("token"))
    v = vectors.mean_vectors(vectors.lookup(w, P.hashed_space(spark, sf_dir, w)), ["conv_id", "role", "turn"], dims=P.dims(spark, sf_dir))
    side = lambda r: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == r, F.struct("turn", "vec")))), lambda x: x["vec"])
    return reuse.align_sequences(v.groupBy(F.col("conv_id").alias("key")).agg(side("user").alias("va"), side("assistant").alias("vb")))


def align_documents(spark, sf_dir):
    """Each two documents of neighbouring ids, sentence by sentence."""
    tokens = _sentences(spark, sf_dir)
    s = reuse.sequences(tokens, P.hashed_space(spark, sf_dir, tokens), "doc_id", "sentences", P.dims(spark, sf_dir))
    ids = P.table(spark, sf_dir, "documents").select("doc_id")
    pairs = ids.where("doc_id % 2 = 0").select(F.expr("doc_id div 2").alias("key"), F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"))
    return reuse.align_texts(s.withColumnRenamed("doc_id", "a"), s.withColumnRenamed("doc_id", "b"), pairs)


def project_space(spark, sf_dir):
    e = _embeddings(spark, sf_dir).select(F.col("id").cast("string").alias("token"), "vec")
    target = e.select("token", F.transform(F.slice("vec", 1, 16), lambda x: 2 * x).alias("vec"))
    pairs = e.select(F.col("token").alias("first"), F.col("token").alias("second"))
    return embedding.project(e, embedding.translation_matrix(pairs, e, target)).select("token", F.posexplode("vec").alias("dim", "v")).select("token", "dim", F.round("v", 5).alias("value"))


def train_words(spark, sf_dir):
    s = P.table(spark, sf_dir, "benchmark").select(N.latin_words(F.col("text")).alias("words"))
    return embedding.train_words(s, 16, (2, 3), part_words=500).select("token", F.posexplode("vec").alias("dim", "v")).select("token", "dim", F.round("v", 5).alias("value"))


def space_plane(spark, sf_dir):
    rows = embedding.plane(_embeddings(spark, sf_dir).select("id", "vec"))
    return rows.select("id", F.round(F.col("plane")[0], 5).alias("x"), F.round(F.col("plane")[1], 5).alias("y"))


def gloss_labels(spark, sf_dir):
    one, two = T.gloss(F.col("first"), F.col("second"), {"the": "article", "and": "conjunction", "was": "verb"})
    return pair_filter(spark, sf_dir).select("ord", one.alias("first_label"), two.alias("second_label"))


def reparse_words(spark, sf_dir):
    again = N.reparsed(N.latin_words(F.col("text")), TERMS)
    return P.table(spark, sf_dir, "benchmark").select("item_id", F.array_join(again, "|").alias("words"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = (
        passage_search_topk, passage_search_euclid, passage_search_chars, passage_search_terms, clean_text, strip_punct, sent_split, phrase_split, char_tokens, dict_tokens, dict_sentences, find_all, seed_index, term_category, group_rows,
        doc_vectors, sent_vectors, doc_sentence_means, vector_sum, center_space, vocab_coverage, pair_filter, pair_flip, pair_similarity, pair_similarity_stats, random_pair_stats,
        embedding_merge, search_length, length_stats, phrase_vectors, window_vectors, global_rank, sim_stats, locate_phrase, merge_islands, cluster_rank, merge_greedy, overlap_pct,
        hit_flags, run_summary, run_report, phrase_report, across_report, across_summary, param_grid, shared_seeds, match_locations, shared_seeds_vec, chunk_gate, best_location, optimize_start, extend_match, align_sequences, align_documents,
        project_space, train_words, space_plane, gloss_labels, reparse_words,
    )
    out = {f.__name__: f for f in names}
    for name, method in (("cosine_matrix", "cosine similarity"), ("dot_matrix", "linear kernel"), ("euclid_matrix", "euclidean distance"), ("cosine_distance", "cosine distance")):
        out[name] = _matrix(method)
    out["doc_similarity"], out["doc_distance"] = _doc_pairs("cosine similarity"), _doc_pairs("euclidean distance")
    return out
