"""Connected components by large-star and small-star rounds over stored edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import gathered, stored


def _settled(e: DataFrame, n: int) -> bool:
    """Whether distinct edges (hi, lo) are stars around their least ids: each hi has one lo, no lo is a hi."""
    ids = e.select(F.col("hi").alias("id"), F.lit(1).alias("up")).unionByName(e.select(F.col("lo").alias("id"), F.lit(0).alias("up")))
    found = ids.groupBy("id").agg(F.sum("up").alias("ups"), F.count(F.lit(1)).alias("n"))
    return not gathered(found, n).agg(F.max(F.expr("ups > 1 or (ups = 1 and n > 1)"))).first()[0]


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(id, component) for every id on an edge between two ids; component is the smallest id reachable.

    Each round halves the distances or better, and rounds end once all edges are stars. A node's neighbours are never
    gathered: its least neighbour is an aggregate, joined back; a hot node's edges can be split between tasks by Spark.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    e = stored(e, "star")
    n = e.count()
    for _ in range(rounds):
        if _settled(e, n):
            break
        both = e.unionByName(e.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, both["hi"] == least["u"]).where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        large = stored(gathered(large, n), "star")
        least = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        small = large.join(least, large["hi"] == least["u"]).where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        e = small.unionByName(least.select(F.col("u").alias("hi"), F.col("m").alias("lo"))).distinct()
        e = stored(gathered(e, n), "star")
    else:
        raise RuntimeError("components didn't settle")
    return e.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionByName(e.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (id, component) with more ``links`` (a, b): only components that these meet are edges of the rounds."""
    of = lambda x: labels.select(F.col("id").alias(x), F.col("component").alias(f"c{x}"))
    met = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    moved = components(met)
    old = labels.join(moved.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left")
    new = moved.join(labels.select("id"), "id", "left_anti")
    return old.select("id", F.coalesce("to", "component").alias("component")).unionByName(new.select("id", "component"))
