"""Report strings: a cluster's lines, a query's report, a run's summary; numbers by format_string."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.config import SearchConfig
from weftline.functions.text import with_stars


def cluster_lines(words: Column | None = None) -> Column:
    """Of a row of ``islands`` with search_len: header, text if ``words`` of the range are given, and all hits."""
    head = F.format_string("%d: Optimal at %d, scored %.5f, globally ranked at %d. Displaying %d to %d", "cluster_no", "optimal_start", "optimal_similarity", "best_rank", "begin", "end")
    coda = F.concat(F.lit("All subsumed results scores: "), F.array_join(F.transform("hits", lambda h: F.format_string("%d:%.5f", h["start"], h["similarity"])), "; "))
    parts = [head]
    if words is not None:
        parts.append(F.array_join(with_stars(words, (F.col("optimal_start") - F.col("begin")).cast("int"), F.col("search_len")), " "))
    return F.concat_ws("\n", *parts, coda, F.lit("\n"))


def query_report(clusters: DataFrame, queries: DataFrame, found: DataFrame, stats: DataFrame) -> DataFrame:
    """(query_id, report). ``queries``: query_id, query, gold, gold_start, predicted_rank, ratio, used_ratio, search_len.
    ``clusters`` with the words of their ranges show them, stars around the best window."""
    words = F.col("words") if "words" in clusters.columns else None
    parts = clusters.join(queries.select("query_id", "search_len"), "query_id").withColumn("lines", cluster_lines(words))
    body = parts.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cluster_no", "lines"))), lambda x: x["lines"]), "\n").alias("body"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("pct")).alias("p"), "cluster_no")))
    hits = found.groupBy("query_id").agg(F.array_join(F.transform(order, lambda x: F.format_string("%.2f%% of gold in Result #%d", -x["p"], x["cluster_no"])), "\n").alias("overlap"))
    rows = queries.join(stats, "query_id").join(body, "query_id").join(hits, "query_id", "left")
    none = F.when(F.col("gold_start").isNull(), "Correct passage unknown").otherwise("Correct match not represented in these results")
    text = F.concat_ws(
        "\n", F.col("query"), F.concat(F.coalesce("gold", F.lit("")), F.lit("\n")),
        F.format_string("Actual location: %s, predicted rank: %s out of %d;\n", F.coalesce(F.col("gold_start").cast("string"), F.lit("None")), F.coalesce(F.col("predicted_rank").cast("string"), F.lit("None")), "n_windows"),
        F.concat(F.coalesce("overlap", none), F.lit("\n")),
        F.format_string("Gold is %.2f times longer, actual adjustment ratio was %s", "ratio", F.col("used_ratio").cast("string")),
        F.format_string("avg similarity score: %.2f\nstd of similarity score: %.2f\n", "mean_sim", "std_sim"), F.col("body"),
    )
    return rows.select("query_id", text.alias("report"))


def _ranks(kind: str, median: str, mean: str, missing: str) -> Column:
    return F.when(F.col(median).isNull(), F.lit(f"No {kind} results")).otherwise(
        F.format_string(f"The median clustered {kind} passage appears at rank %s, average is %.2f, with %d phrases with no {kind} results", F.col(median).cast("string"), mean, missing)
    )


def run_report(summary: DataFrame, name: str, config: SearchConfig, windows: Column | None = None) -> DataFrame:
    """(report): parameters and the summary row as prose. ``windows``: how many places were ranked."""
    near = "in the top %d results" if config.topk_mode == "le" else "from result %d on"
    near = near % config.top_k
    lines = [
        F.lit(f"Results for {name}\n"),
        F.lit(f"The top {config.top_n} results are displayed, clustering when the start of another result is within {'full' if config.window is None else config.window} tokens"),
        F.lit(f"Search window is adjusted by a factor of {config.long_adjust + 1}"),
        F.lit(f"Phrases of up to {config.short_length} tokens are adjusted by {config.short_adjust + 1}"),
        F.lit(f"Tokens are of kind {config.method}\nThe distance metric used is {config.metric}\n"),
        _ranks("full", "clustered_median", "clustered_mean", "missing_full"),
        _ranks("partial", "partial_median", "partial_mean", "missing_partial"),
        F.format_string("The median predicted global rank is %s%s, the average %.2f, the standard deviation %.2f\n", F.col("rank_median").cast("string"), F.lit("") if windows is None else F.format_string(" of %d", windows), "rank_mean", "rank_pstdev"),
        F.format_string("A total of %d phrases were searched", "total_phrases"),
        F.format_string(f"The full passage was found in the top result %d times, {near} %d times, in any %d times", "top_full", "near_full", "any_full"),
        F.format_string(f"Some of it was found in the top result %d times, {near} %d times, in any %d times", "top_some", "near_some", "any_some"),
    ]
    return summary.select(F.concat_ws("\n", *lines).alias("report"))
