"""Hits to passages: merging of neighbours, overlap with known passages, flags, and their summary."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.config import SearchConfig


def islands(hits: DataFrame, window: Column | None = None) -> DataFrame:
    """Hits (query_id, start, similarity, rank, search_len) merged while the next start is at most the last end + window
    + 1. Returns (query_id, cluster_no, begin, end, best_rank, optimal_start, optimal_similarity, n_hits)."""
    gap = F.coalesce(window, F.col("search_len")) if window is not None else F.col("search_len")
    w = Window.partitionBy("query_id").orderBy("start")
    new = F.coalesce((F.col("start") - F.lag("start").over(w) > F.col("search_len") + gap).cast("int"), F.lit(1))
    parts = hits.withColumn("_new", new).withColumn("_c", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.min_by(F.struct("start", "similarity"), "rank")
    out = parts.groupBy("query_id", "_c").agg(
        F.min("start").alias("begin"), F.max(F.col("start") + F.col("search_len") - 1).alias("end"), F.min("rank").alias("best_rank"),
        best.alias("b"), F.count(F.lit(1)).alias("n_hits"), F.array_sort(F.collect_list(F.struct("start", "similarity"))).alias("hits"),
    )
    no = F.row_number().over(Window.partitionBy("query_id").orderBy("best_rank"))
    return out.select("query_id", no.alias("cluster_no"), "begin", "end", "best_rank", F.col("b.start").alias("optimal_start"), F.col("b.similarity").alias("optimal_similarity"), "n_hits", "hits")


def greedy_heads(starts: list[int], search_len: int) -> list[tuple[int, list[int]]]:
    """``starts`` in order of rank. The best unclaimed hit claims what starts from search_len - 1 before to search_len
    after it. Returns (index of the head, claimed starts) in order of rank."""
    free = dict.fromkeys(range(len(starts)))
    out = []
    for i in range(len(starts)):
        if i in free:
            own = [j for j in free if -(search_len - 1) <= starts[j] - starts[i] <= search_len]
            for j in own:
                del free[j]
            out.append((i, sorted(starts[j] for j in own)))
    return out


def greedy(hits: DataFrame) -> DataFrame:
    """As ``islands`` by rank first; a query has at most top-N hits."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        n = int(pdf["search_len"].iloc[0])
        rows = []
        for no, (i, own) in enumerate(greedy_heads(pdf["start"].tolist(), n), 1):
            head = pdf.iloc[i]
            rows.append((int(head["query_id"]), no, own[0], own[-1] + n - 1, int(head["rank"]), int(head["start"]), float(head["similarity"]), len(own)))
        return pd.DataFrame(rows, columns=["query_id", "cluster_no", "begin", "end", "best_rank", "optimal_start", "optimal_similarity", "n_hits"])

    return hits.groupBy("query_id").applyInPandas(run, "query_id long, cluster_no int, begin long, end long, best_rank int, optimal_start long, optimal_similarity double, n_hits long")


def overlap_percent(begin: Column, end: Column, gold: Column, gold_len: Column) -> Column:
    """Share of the gold passage in [begin, end], in percent; null where there is no gold."""
    common = F.least(gold + gold_len - 1, end) - F.greatest(gold, begin) + 1
    return F.try_divide(F.greatest(common, F.lit(0)).cast("double"), gold_len) * 100


def overlaps(clusters: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, cluster_no, pct) of the clusters that meet their query's gold passage (gold_start, gold_len)."""
    both = clusters.join(gold, "query_id").withColumn("pct", overlap_percent(F.col("begin"), F.col("end"), F.col("gold_start"), F.col("gold_len")))
    return both.where("pct > 0").select("query_id", "cluster_no", "pct")


def flags(found: DataFrame, config: SearchConfig) -> DataFrame:
    """Per query with any overlap: six flags, the cluster with the largest overlap and the first that is full."""
    unit = 100.0 if config.threshold_unit == "fraction" else 1.0
    full, part = F.col("pct") >= config.full * unit, F.col("pct") >= config.partial * unit
    near = F.col("cluster_no") <= config.top_k if config.topk_mode == "le" else F.col("cluster_no") >= config.top_k
    first = F.col("cluster_no") == 1
    by_size = F.struct(-F.col("pct"), F.col("cluster_no"))
    return found.groupBy("query_id").agg(
        F.bool_or(first & full).alias("top_full"), F.bool_or(near & full).alias("near_full"), F.bool_or(full).alias("any_full"),
        F.bool_or(first & part).alias("top_some"), F.bool_or(near & part).alias("near_some"), F.lit(True).alias("any_some"),
        F.min_by(F.when(full, F.col("cluster_no")), F.when(full, by_size)).alias("best_overlap_rank"),
        F.min(F.when(full, F.col("cluster_no"))).alias("first_hit_rank"),
        F.min_by(F.when(part & ~full, F.col("cluster_no")), F.when(part & ~full, by_size)).alias("best_partial_rank"),
    )


def summary(per_query: DataFrame, marks: DataFrame, ranks: DataFrame) -> DataFrame:
    """One row: counts of flags, cluster ranks, global ranks and their ratios to all queries."""
    n = per_query.agg(F.count(F.lit(1)).alias("total_phrases"))
    c = marks.agg(*(F.count_if(x).alias(x) for x in ("top_full", "near_full", "any_full", "top_some", "near_some", "any_some")), F.median("best_overlap_rank").alias("clustered_median"), F.avg("best_overlap_rank").alias("clustered_mean"), F.count("best_overlap_rank").alias("_full"),
        F.median("best_partial_rank").alias("partial_median"), F.avg("best_partial_rank").alias("partial_mean"), F.count("best_partial_rank").alias("_part"))
    r = ranks.agg(F.median("predicted_rank").alias("rank_median"), F.avg("predicted_rank").alias("rank_mean"), F.stddev_pop("predicted_rank").alias("rank_pstdev"))
    one = F.lit(1)
    rows = n.withColumn("_k", one).join(c.withColumn("_k", one), "_k").join(r.withColumn("_k", one), "_k").drop("_k")  # three rows of one
    rows = rows.withColumn("missing_full", F.col("total_phrases") - F.col("_full")).withColumn("missing_partial", F.col("total_phrases") - F.col("_part")).drop("_full", "_part")
    for x in ("top_full", "any_full", "any_some"):
        rows = rows.withColumn(f"{x}_ratio", F.try_divide(F.col(x).cast("double"), F.col("total_phrases")))
    return rows
