"""Passage search across two spaces: phrases of one language, a target text of another.

``search_passages`` takes DataFrames alone: the target's documents as words, its space, the query set with its own space, and
for each query, where known, the passage it should find (gold), in the target's words. Query and gold need not be alike:
windows are as long as the query's words times the adjustment, the gold passage as long as it is.

The query set goes through the tasks in parts of QUERIES_AT_ONCE, each one scan, so it may have any size; query vectors are
means that Spark makes by joins with the query space.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.config import SearchConfig
from weftline.operators import cluster, report, search, vectors
from weftline.sources.shared import discard, free_shuffles, stored

#: Queries that travel with one scan.
QUERIES_AT_ONCE = 2_000


@dataclass
class PassageSearch:
    """What one configuration has found. ``queries``: query_id, n_tokens, search_len, words, gold; ``places``: query_id,
    gold_start, gold_similarity of the gold passages that stand in the target."""

    found: DataFrame
    queries: DataFrame
    config: SearchConfig
    length: int
    places: DataFrame | None
    placed: DataFrame

    def hits(self) -> DataFrame:
        return search.ranked(self.found, self.config.top_n).join(self.queries.select("query_id", "search_len"), "query_id")

    def clusters(self) -> DataFrame:
        window = F.lit(self.config.window) if self.config.window is not None else None
        return cluster.islands(self.hits(), window) if self.config.cluster_mode == "islands" else cluster.greedy(self.hits())

    def gold(self) -> DataFrame:
        """(query_id, gold_start, gold_similarity, gold_len)"""
        own = self.queries.select("query_id", F.size("gold").alias("gold_len"))
        return own.join(self.places, "query_id").select("query_id", "gold_start", "gold_similarity", "gold_len")

    def predicted_ranks(self) -> DataFrame:
        """(query_id, gold_start, predicted_rank, n_windows): rank from 0 of the gold passage's window among all windows."""
        before = self.found.where("kind = 'before'").groupBy("query_id").agg(F.sum("n").alias("predicted_rank"))
        rows = self.places.select("query_id", "gold_start").join(before, "query_id").join(search.statistics(self.found), "query_id")
        return rows.select("query_id", "gold_start", "predicted_rank", "n_windows")

    def flags(self) -> DataFrame:
        return cluster.flags(cluster.overlaps(self.clusters(), self.gold()), self.config)

    def summary(self) -> DataFrame:
        return cluster.summary(self.queries, self.flags(), self.predicted_ranks())

    def passages(self, clusters: DataFrame) -> DataFrame:
        """``clusters`` with ``words``, the target's words from begin to end, by a join on positions."""
        spans = clusters.select("query_id", "cluster_no", F.explode(F.sequence("begin", "end")).alias("g"))
        words = spans.join(search.tokens_of(self.placed), "g").groupBy("query_id", "cluster_no")
        words = words.agg(F.array_sort(F.collect_list(F.struct("g", "token"))).alias("_w"))
        words = words.select("query_id", "cluster_no", F.transform("_w", lambda x: x["token"]).alias("words"))
        return clusters.join(words, ["query_id", "cluster_no"], "left")

    def report(self) -> DataFrame:
        """(query_id, report): each query, its gold passage, where that is, and all clusters with their passages, stars around
        the best window."""
        c = stored(self.clusters(), "passages-clusters")
        long = F.col("n_tokens") > self.config.short_length
        used = F.when(long, 1 + self.config.long_adjust).otherwise(1 + self.config.short_adjust)
        q = self.queries.withColumn("query", F.array_join("words", " ")).withColumn("ratio", F.try_divide(F.size("gold"), F.size("words"))).withColumn("used_ratio", used)
        q = q.withColumn("gold", F.array_join("gold", " ")).drop("words")
        q = q.join(self.places.select("query_id", "gold_start"), "query_id", "left").join(self.predicted_ranks().select("query_id", "predicted_rank"), "query_id", "left")
        return report.query_report(self.passages(c), q, cluster.overlaps(c, self.gold()), search.statistics(self.found))


def query_vectors(queries: DataFrame, space: DataFrame, dims: int, parts: bool = False) -> DataFrame:
    """(query_id, vector): mean vectors of words that are in the space; with ``parts`` a word that isn't stands for the mean
    of its characters. Null where there is none."""
    words = queries.select("query_id", F.posexplode("words").alias("pos", "token"))
    means = vectors.phrase_vectors(words, space, ["query_id"], dims=dims) if parts else vectors.mean_vectors(vectors.lookup(words, space), ["query_id"], dims=dims)
    return means.select("query_id", F.col("vec").alias("vector"))


def place(target: DataFrame, key: str, words: str | Column = "words") -> DataFrame:
    """Stored (offset, size, words, head, tail, fresh) of the target's documents in order of ``key``: head and tail are the first
    and last words, fresh lists have each token at least once. ``words`` may be computed from the target's columns; it is, once,
    after these are dealt."""
    rows = target.repartitionByRange(F.col(key)).sortWithinPartitions(key).select(F.col(key).alias("key"), (F.col(words) if isinstance(words, str) else words).alias("words"))
    n = F.greatest(F.size("words"), F.lit(0))
    rows = rows.select("key", "words", n.alias("size"), F.get("words", F.lit(0)).alias("head"), F.get("words", n - 1).alias("tail"))
    return search.global_offsets(rows, "key", "size", "words", dealt=True)


def search_passages(
    target: DataFrame, target_space: DataFrame | search.KeyedSpace, queries: DataFrame, query_space: DataFrame, configs: list[SearchConfig], key: str = "key",
    gold: bool = True, stats: bool | str = True, top_n: int | None = None, dims: int | None = None, at_once: int = QUERIES_AT_ONCE, matrix_bytes: int = search.MATRIX_BYTES, ranks: bool = True, texts: bool = True,
) -> list[PassageSearch]:
    """One result a configuration, all by one scan of the target; configurations share tokenizer, metric and left-out queries.

    ``target``: (key, words), ordered by key, or what ``place`` made of it. Spaces: (token, vec) of one length; the target's also as a KeyedSpace. ``queries``: (query_id, words[, gold]), ids
    distinct. With ``gold`` the passages' places are found first, and the scan counts what ranks before each. ``top_n``,
    ``stats`` ("count": only how many windows there are) and ``ranks`` (of gold passages) leave out what isn't asked for; without ``texts`` the stored words,
    also what ``place`` made, are deleted before the last scan, so that there are no passages and reports. Null and empty word lists have no vector, no windows and no place.
    """
    if len({(c.method, c.metric, c.leave_out) for c in configs}) != 1:
        raise ValueError("one scan has one tokenizer, one metric and one query set")
    spark, config = target.sparkSession, configs[0]
    dims = (vectors.dims_of(target_space.vectors if isinstance(target_space, search.KeyedSpace) else target_space) or 1) if dims is None else dims
    codes, names = search.dense_codes(target_space)
    placed = target if {"offset", "size", "words"} <= set(target.columns) else place(target, key)
    length = int(placed.agg(F.sum("size")).first()[0] or 0)
    hashed = search.hashed_names(names, matrix_bytes)

    own = queries.select("query_id", "words", F.col("gold") if "gold" in queries.columns else F.col("words").alias("gold"))
    own = own.where((F.size("words") > 0) & ~F.col("query_id").isin(list(config.leave_out))) if config.leave_out else own.where(F.size("words") > 0)
    own = own.join(query_vectors(own, query_space, dims, config.method in ("term", "term2")), "query_id", "left")
    own = stored(search.global_offsets(own.withColumn("_one", F.lit(1)), "query_id", "_one").withColumn("part", F.floor(F.col("offset") / at_once)).drop("_one", "offset"), "passages-queries")
    parts, most = own.agg(F.max("part"), F.max(F.size("words"))).first()
    halo = max([0, *(c.search_length(most or 0) - 1 for c in configs), *(c.search_length(min(most or 0, c.short_length)) - 1 for c in configs)])
    if hashed is None:
        dealt = search.blocks(search.tokens_of(placed).join(names, "token", "left").select("g", "code"), halo)
    else:
        dealt = search.packed(placed, hashed, halo)
    pieces = stored(dealt, "search-blocks", "lz4")

    found, places = [], []
    for part in range(0 if parts is None else parts + 1):
        f, p = _part(own.where(F.col("part") == part), placed, pieces, codes, length, configs, gold, stats, top_n, matrix_bytes, ranks, texts or part < parts or not hasattr(placed, "stored_at"))
        found.append(f)
        places.append(p)
    discard(pieces, codes, *([] if hashed is None else [hashed]))
    none = spark.createDataFrame([], search.SCAN), spark.createDataFrame([], PLACES)
    found, places = (reduce(DataFrame.unionByName, x) if x else y for x, y in zip((found, places), none))
    pick = lambda df, i: df.where(F.col("variant") == i).drop("variant")
    out = []
    for i, c in enumerate(configs):
        n = F.size("words")
        size = search.search_length(n, c.long_adjust, c.short_adjust, c.short_length)
        rows = own.select("query_id", n.alias("n_tokens"), size.alias("search_len"), "words", "gold")
        out.append(PassageSearch(pick(found, i), rows, c, length, pick(places, i) if gold else None, placed))
    return out


PLACES = "variant int, query_id long, gold_start long, gold_similarity double"


def _part(own: DataFrame, placed: DataFrame, pieces: DataFrame, codes: DataFrame, length: int, configs: list[SearchConfig], gold: bool, stats: bool | str, top_n: int | None, matrix_bytes: int, ranks: bool, kept: bool) -> tuple[DataFrame, DataFrame]:
    """Stored rows of SCAN, and of PLACES, for a part of the query set, which the driver holds. Unless ``placed`` is ``kept``, it's deleted before
    the scan."""
    spark, metric = own.sparkSession, configs[0].metric
    rows = own.select("query_id", F.size("words").alias("size"), "vector", "gold").toPandas().sort_values("query_id")
    dims = max([len(v) for v in rows["vector"] if v is not None], default=1)
    rows["vector"] = [np.zeros(dims) if v is None else np.asarray(v, np.float64) for v in rows["vector"]]
    q = pd.concat([rows.drop(columns="gold").assign(variant=i, search_len=[c.search_length(n) for n in rows["size"]], top_n=c.top_n if top_n is None else top_n) for i, c in enumerate(configs)])
    q["gold_start"], q["gold_similarity"] = -1, np.nan
    places = []
    if gold:
        phrases = {int(k): list(w) for k, w in zip(rows["query_id"], rows["gold"]) if w is not None}
        starts = {r["query_id"]: r["gold_start"] for r in search.located(placed, phrases).collect()}  # a number a query
        q["gold_start"] = [starts.get(k, -1) for k in q["query_id"]]
        wanted = sorted({s // search.BLOCK for s in starts.values()})
        there = q[q["gold_start"] >= 0]
        near = search.scan(pieces.where(F.col("block").isin(wanted)), codes, there, length, metric=metric, only_gold=True, matrix_bytes=matrix_bytes).collect() if wanted else []
        sims = {(r["variant"], r["query_id"]): r["similarity"] for r in near}
        q["gold_similarity"] = [sims.get((v, k), np.nan) for v, k in zip(q["variant"], q["query_id"])]
        places = [(int(v), int(k), int(s), None if np.isnan(x) else float(x)) for v, k, s, x in zip(q["variant"], q["query_id"], q["gold_start"], q["gold_similarity"]) if s >= 0]
    if not ranks:
        q["gold_similarity"] = np.nan
    if not kept:
        discard(placed)
    free_shuffles(spark)  # of the places
    found = stored(search.scan(pieces, codes, q, length, metric=metric, stats=stats, matrix_bytes=matrix_bytes), "search-found")
    return found, spark.createDataFrame(places, PLACES)


def locate(target: DataFrame, queries: DataFrame, key: str = "key", at_once: int = QUERIES_AT_ONCE) -> DataFrame:
    """(query_id, gold_start) of the queries' (query_id, words) own first places in the target (key, words), without a search."""
    placed = target if {"offset", "size", "words"} <= set(target.columns) else place(target, key)
    own = stored(search.global_offsets(queries.where(F.size("words") > 0).withColumn("_one", F.lit(1)), "query_id", "_one").withColumn("part", F.floor(F.col("offset") / at_once)), "passages-queries")
    parts = own.agg(F.max("part")).first()[0]
    out = [search.located(placed, {r["query_id"]: list(r["words"]) for r in own.where(F.col("part") == p).collect()}) for p in range(0 if parts is None else parts + 1)]
    return reduce(DataFrame.unionByName, out) if out else target.sparkSession.createDataFrame([], "query_id long, gold_start long")
