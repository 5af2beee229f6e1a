"""Mixing sources to target weights by Poisson replication: native DataFrame operations only.

Every source gets a mean repetition rate, its target share of the characters over its real share. A row's number
of copies inverts a Poisson distribution of that rate at a uniform number that md5 makes from the row's id and the
seed, so any task, on any day, gives a row the same count; a large rate is the sum of smaller ones, each with its own
number. Rows are exploded by their counts and shuffled globally:
a hash of id, copy and seed deals them out to partitions and orders them there.

Defined results: columns _copies, _copy and _order are the result's, and replace columns of ``df`` of these names; other
names don't matter; a null source is the source ''; a source without a target weight, with a weight of 0 or without
characters gets rate 0; a null text has no characters; a null id hashes as the empty text; repeated rows get the
same count each; an empty table gives no rows. Sources are few next to rows: their table is broadcast up to
BROADCAST_ROWS rows and joined by shuffle, with Spark's own splitting of skewed keys, beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import bounded_broadcast, fresh, stored

#: 2^52: hash digits as a fraction below 1 that a double holds exactly.
SPAN = float(1 << 52)
#: Larger rates are split into equal parts of PART_RATE at most, whose Poisson counts add up.
#: P(more than PART_COPIES | PART_RATE) is below 1e-17, less than the hash resolves.
PART_RATE = 16.0
PART_COPIES = 64


def hashed(seed: int, *parts: Column) -> Column:
    """52 bits of md5 over seed and parts, as bigint."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def source_rates(df: DataFrame, weights: dict[str, float] | None = None, total: float = 1.0, max_rate: float | None = None) -> DataFrame:
    """(src, chars, rate): ``total`` is the size of the mix over that of the input. Without weights all sources
    that have characters get the same. With ``max_rate`` no source is repeated more often, and the mix misses its target."""
    sizes = df.groupBy(F.coalesce("source", F.lit("")).alias("src")).agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("double").alias("chars"))
    sizes = stored(sizes, "mix-sizes")
    if weights is None:
        target = sizes.where("chars > 0").select("src", F.lit(1.0).alias("weight"))
    else:
        target = df.sparkSession.createDataFrame([(k or "", float(v)) for k, v in weights.items()] or [("", 0.0)], "src string, weight double").groupBy("src").agg(F.sum("weight").alias("weight"))
    both = sizes.join(target, "src", "left")
    sums = both.agg(F.sum("chars").alias("chars"), F.sum(F.when(F.col("chars") > 0, F.col("weight"))).alias("weight")).first()  # one row
    chars, weight = float(sums["chars"] or 0), float(sums["weight"] or 0)
    rate = F.when((F.col("chars") > 0) & (F.col("weight") > 0), F.col("weight") * F.lit(chars * total) / (F.col("chars") * F.lit(weight or 1.0))).otherwise(F.lit(0.0))
    if max_rate is not None:
        rate = F.least(rate, F.lit(float(max_rate)))
    return stored(both.select("src", "chars", rate.alias("rate")), "mix-rates")


def poisson_count(u: Column, rate: Column) -> Column:
    """The smallest k with P(X <= k) > u, for rates up to PART_RATE."""
    start = F.struct(F.lit(0).alias("k"), F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"))
    end = F.aggregate(
        F.sequence(F.lit(1), F.lit(PART_COPIES)),
        start,
        lambda s, i: F.when(s["cdf"] > u, s).otherwise(F.struct(i.alias("k"), (s["p"] * rate / i).alias("p"), (s["cdf"] + s["p"] * rate / i).alias("cdf"))),
    )
    return F.when(F.exp(-rate) > u, F.lit(0)).otherwise(end["k"])


def copies(seed: int, key: str, rate: Column) -> Column:
    """A row's Poisson count at any rate."""
    parts = F.greatest(F.ceil(rate / F.lit(PART_RATE)), F.lit(1)).cast("int")
    first = poisson_count(hashed(seed, F.col(key)) / F.lit(SPAN), rate / parts)
    rest = F.aggregate(F.sequence(F.lit(2), parts), F.lit(0), lambda n, i: n + poisson_count(hashed(seed, F.col(key), i) / F.lit(SPAN), rate / parts))
    return F.when(parts > 1, first + rest).otherwise(first)


def replicate(df: DataFrame, rates: DataFrame, seed: int, key: str = "doc_id") -> DataFrame:
    """``df`` with _copies, _copy and _order: each row as often as its count says."""
    src, rate = fresh(df, "_src"), fresh(df, "_rate")
    r = bounded_broadcast(rates).select(F.col("src").alias(src), F.col("rate").alias(rate))
    rows = df.join(r, F.coalesce(df["source"], F.lit("")) == F.col(src), "left")
    rows = rows.withColumn("_copies", copies(seed, key, F.coalesce(rate, F.lit(0.0))))
    rows = rows.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return rows.withColumn("_order", hashed(seed + 1, F.col(key), F.col("_copy"))).drop(src, rate)


def shuffled(df: DataFrame, parts: int | None = None) -> DataFrame:
    """A global random order: rows are dealt out by _order and sorted by it in each partition."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, "_order").sortWithinPartitions("_order", "_copy")


def mix(df: DataFrame, weights: dict[str, float] | None = None, total: float = 1.0, seed: int = 20_11, key: str = "doc_id", max_rate: float | None = None) -> DataFrame:
    """The whole operator: rates, counts, copies, order. Keeps all columns and adds _copies, _copy and _order."""
    return shuffled(replicate(df, source_rates(df, weights, total, max_rate), seed, key))
