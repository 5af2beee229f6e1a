"""Seeds of texts that arrive in a stream, met with those of a fixed text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.reuse import seeds


def shared_with(stream: DataFrame, known: DataFrame, key: str, text: str, size: int = 2) -> DataFrame:
    """Each arriving text's seeds that ``known`` (seed, pos) has: a stream-static join, without state."""
    return seeds(stream, key, text, size).join(known.select("seed", F.col("pos").alias("known_pos")), "seed")


def seed_counts(stream: DataFrame, time: str, text: str, size: int = 2, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Counts of seeds in windows of event time; the watermark bounds the state."""
    rows = stream.withWatermark(time, late)
    n = F.length(text) - size
    grams = F.transform(F.when(n >= 0, F.sequence(F.lit(0), n)), lambda i: F.substring(F.col(text), i + 1, F.lit(size)))
    return rows.select(time, F.explode(grams).alias("seed")).groupBy(F.window(time, window), "seed").agg(F.count(F.lit(1)).alias("n"))
