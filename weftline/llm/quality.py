"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source.

Signals are counted per text. Each becomes an integer metric, and each (lang, source, metric) a sketch: a
histogram over buckets of which 32 make an octave, so a value is known to 1/32. Sketches merge by adding counts,
in any order with the same result. A metric's limits come from its group's sketch alone:

* quartiles: the quartiles, moved outwards on both sides by FENCE times their distance;
* tail: the 99th percentile, moved up by TAIL times its distance from the 95th;
* gap: where the sketch has an empty stretch of GAP times or more (values plus NOISE) with no more than a quarter of the rows
  above it, the geometric middle of the widest; otherwise as tail. So a share of junk above 5 % doesn't move the limit.

A group with fewer than MIN_ROWS rows, or whose quantiles leave the rule no distance, has no limit of its own and uses that of
its language's merged sketch, then that of everything; if none has one, nothing is rejected. There are no fixed cutoffs. Rows are
then joined with their group's limits.

Only rows that pass the base rule enter the sketches, so junk doesn't move the limits. Defined results: a null
text has no words and fails the base rule; null lang and source are groups of their own, ''; an empty table gives
no rows; repeated rows count as often as they occur; columns that are added begin with a prefix that no column of the
table has, whatever its names.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import bounded_broadcast, drop_caches, small_batches, stored

MIN_WORDS, MIN_ROWS = 50, 200
FENCE, TAIL, GAP, NOISE = 5, 2, 4, 16
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: name: (metric over the signals in SQL, rule of its limits)
METRICS = {
    "symbols": ("1000 * n_symbols div n_words", "gap"),
    "dup_lines": ("1000 * n_dup_lines div greatest(n_lines, 1)", "tail"),
    "repeats": ("1000 * n_repeat_words div n_words", "tail"),
    "word_length": ("100 * word_chars div n_words", "quartiles"),
}

SIGNALS = "n_words bigint, word_chars bigint, n_symbols bigint, n_lines bigint, n_dup_lines bigint, n_repeat_words bigint"
_NAMES = [x.split()[0] for x in SIGNALS.split(", ")]


def signals_of(text: str | None) -> tuple[int, ...]:
    """The counts of one text, in the order of SIGNALS."""
    if not text:
        return (0,) * 6
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at exactly the six ASCII spaces
    chars = len(text) - sum(map(text.count, SPACES))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    repeats = 0
    if len(words) > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(counts := Counter(windows)) < len(windows):
            end = 0  # words before it are counted
            for i, w in enumerate(windows):
                if counts[w] > 1:
                    repeats += i + 3 - max(i, end)
                    end = i + 3
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeats


def prefix_for(df: DataFrame) -> str:
    """What no column of ``df`` begins with."""
    prefix = "_q_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = f"_{prefix}"
    return prefix


def with_signals(df: DataFrame, text: str = "text", prefix: str = "_q_") -> DataFrame:
    """``df`` with a struct column <prefix>signals."""
    small_batches(df.sparkSession)

    @F.arrow_udf(f"struct<{SIGNALS.replace(' bigint', ': bigint')}>")
    def signals(texts: pa.Array) -> pa.Array:
        drop_caches()
        rows = [signals_of(x) for x in texts.to_pylist()]
        cols = list(zip(*rows)) if rows else [()] * len(_NAMES)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], names=_NAMES)

    # Not to be moved into filters, where it would be evaluated again.
    return df.withColumn(f"{prefix}signals", signals.asNondeterministic()(F.col(text)))


def base_failed(s: str = "_q_signals") -> Column:
    return F.expr(f"{s}.n_words < {MIN_WORDS} or 100 * {s}.n_repeat_words > 50 * {s}.n_words")


def bucket(c: str) -> str:
    """SQL: values below 64 are their own buckets, others keep their 6 leading bits."""
    shift = f"greatest(length(bin({c})) - 6, 0)"
    return f"({shift} * 32 + shiftright({c}, cast({shift} as int)))"


def bucket_low(c: str) -> str:
    """SQL: the least value of a bucket."""
    shift = f"greatest({c} div 32 - 1, 0)"
    return f"shiftleft({c} - {shift} * 32, cast({shift} as int))"


def _group(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def sketches(df: DataFrame, prefix: str = "_q_") -> DataFrame:
    """(lang, source, metric, bucket, n) of the rows that pass the base rule. ``df`` has <prefix>signals."""
    rows = df.where(~base_failed(f"{prefix}signals")).select(_group("lang").alias("lang"), _group("source").alias("source"), f"{prefix}signals.*")
    pairs = ", ".join(f"'{k}', cast({m} as bigint)" for k, (m, _) in METRICS.items())
    long = rows.selectExpr("lang", "source", f"stack({len(METRICS)}, {pairs}) as (metric, v)")
    return long.groupBy("lang", "source", "metric", F.expr(bucket("v")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, *by: str) -> DataFrame:
    """The sketches of coarser groups: counts add up."""
    return sketch.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))


#: Quantiles in hundredths.
QUANTILES = (25, 75, 95, 99)


def quantiles(sketch: DataFrame, *by: str) -> DataFrame:
    """(by, metric, rows, q25, q75, q95, q99, gap): gap is the middle of the widest empty stretch, null where there is none. A
    sketch has some 32 buckets for each octave of its values, so a window over one is small whatever its rows."""
    keys = [*by, "metric"]
    run = Window.partitionBy(*keys).orderBy("bucket")
    x = sketch.withColumn("low", F.expr(bucket_low("bucket"))).withColumn("upto", F.sum("n").over(run)).withColumn("rows", F.sum("n").over(Window.partitionBy(*keys)))
    x = x.withColumn("wide", (F.lead("low").over(run) + NOISE).cast("double") / (F.col("low") + NOISE))
    gap = (F.col("wide") >= GAP) & (F.col("upto") * 4 >= F.col("rows") * 3)
    middle = F.floor(F.sqrt(F.col("wide")) * (F.col("low") + NOISE)).cast("long") - NOISE
    at = lambda q: F.min(F.when(F.col("upto") * 100 >= F.col("rows") * q, F.col("low"))).alias(f"q{q}")
    widest = F.max(F.when(gap, F.struct("wide", middle.alias("middle"))))
    return x.groupBy(*keys).agg(F.max("rows").alias("rows"), *(at(q) for q in QUANTILES), widest["middle"].alias("gap"))


def fences(q: DataFrame, min_rows: int, fence: int = FENCE, tail: int = TAIL) -> DataFrame:
    """Rows of ``quantiles`` with lo and hi by their metric's rule; null where they leave it no distance."""
    rule = F.lit(None).cast("string")
    for k, (_, name) in METRICS.items():
        rule = F.when(F.col("metric") == k, F.lit(name)).otherwise(rule)
    far = F.when(F.col("q99") > F.col("q95"), F.col("q99") + tail * (F.col("q99") - F.col("q95")))
    spread = F.when(F.col("q75") > F.col("q25"), fence * (F.col("q75") - F.col("q25")))
    hi = F.when(rule == "quartiles", F.col("q75") + spread).when(rule == "gap", F.coalesce("gap", far)).otherwise(far)
    return q.where(F.col("rows") >= min_rows).withColumn("hi", hi).withColumn("lo", F.when(rule == "quartiles", F.col("q25") - spread))


def limits(df: DataFrame, min_rows: int = MIN_ROWS, prefix: str = "_q_") -> DataFrame:
    """(<prefix>lang, <prefix>source, <prefix>lo_<metric>, <prefix>hi_<metric>), stored, for every group of ``df``, which has
    <prefix>signals."""
    fine = stored(sketches(df, prefix), "quality-sketch")
    groups = df.select(_group("lang").alias("lang"), _group("source").alias("source")).distinct()

    def wide(q: DataFrame, by: list[str], tag: str) -> DataFrame:
        one = lambda c, k: F.max(F.when(F.col("metric") == k, F.col(c))).alias(f"{c}_{k}_{tag}")
        return fences(q, min_rows if by else 0).groupBy(*by).agg(*(one(c, k) for k in METRICS for c in ("lo", "hi")))

    a = wide(quantiles(fine, "lang", "source"), ["lang", "source"], "a")
    b = wide(quantiles(merged(fine, "lang"), "lang"), ["lang"], "b")
    c = wide(quantiles(merged(fine)), [], "c").first()  # one row
    out = groups.join(a, ["lang", "source"], "left").join(b, ["lang"], "left")
    pick = [F.coalesce(f"{x}_{k}_a", f"{x}_{k}_b", F.lit(c[f"{x}_{k}_c"] if c else None).cast("bigint")).alias(f"{prefix}{x}_{k}") for k in METRICS for x in ("lo", "hi")]
    return stored(out.select(F.col("lang").alias(f"{prefix}lang"), F.col("source").alias(f"{prefix}source"), *pick), "quality-limits")


def judged(df: DataFrame, lim: DataFrame, prefix: str = "_q_") -> DataFrame:
    """``df``, which has <prefix>signals, with boolean columns <prefix>base_failed and <prefix>kept, and for each metric
    <prefix>fits_<metric>."""
    both = df.join(bounded_broadcast(lim), (_group("lang") == F.col(f"{prefix}lang")) & (_group("source") == F.col(f"{prefix}source")), "left")
    out, kept = both.withColumn(f"{prefix}base_failed", base_failed(f"{prefix}signals")), F.lit(True)
    for k, (metric, _) in METRICS.items():
        for name in _NAMES:
            metric = metric.replace(name, f"{prefix}signals.{name}")
        words = f"{prefix}signals.n_words"
        v = F.expr(f"if({words} = 0, null, {metric.replace(f'div {words}', f'div nullif({words}, 0)')})")
        fits = F.coalesce(v <= F.col(f"{prefix}hi_{k}"), F.lit(True)) & F.coalesce(v >= F.col(f"{prefix}lo_{k}"), F.lit(True))
        out = out.withColumn(f"{prefix}fits_{k}", fits)
        kept = kept & F.col(f"{prefix}fits_{k}")
    return out.withColumn(f"{prefix}kept", ~F.col(f"{prefix}base_failed") & kept).drop(*lim.columns)


def quality_filter(df: DataFrame) -> DataFrame:
    """The rows of ``df`` that pass, with its columns. Signals are counted once and stored beside the rows."""
    prefix = prefix_for(df)
    marked = stored(with_signals(df, prefix=prefix), "quality-marked")
    return judged(marked, limits(marked, prefix=prefix), prefix).where(f"{prefix}kept").select(*(F.col(f"`{c}`") for c in df.columns))
