"""Rows by their texts: operators that compare texts treat equal ones as one node."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import bounded_broadcast, fresh, gathered, stored

#: Rows up to which tables of (id, digest) are broadcast: 40 bytes a row.
SMALL_ROWS = 300_000


def digest_of(text: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


@dataclass
class Nodes:
    """A node is its text's smallest id; texts that share this one, or have none, get numbers below all ids."""

    #: Stored (key, digest, node, rep, n) of every row: rep is the smallest id of its text, n the text's rows.
    member: DataFrame
    #: Stored (digest, node, rep) of nodes that aren't their text's smallest id.
    odd: DataFrame
    any_odd: bool
    #: Stored (key, digest) of rows whose text belongs to a smaller id.
    copies: DataFrame
    #: (key: the node, text, id), a row a text, but for rows that repeat id and text.
    docs: DataFrame
    n_bytes: int

    def place(self, df: DataFrame, key: str, text: str, node: str) -> DataFrame:
        """``df`` with its rows' nodes as column ``node``; of a copy it isn't its text's."""
        own = F.col(key).cast("long")
        if not self.any_odd:
            return df.withColumn(node, own)
        d, n = fresh(df, "digest"), fresh(df, "odd")
        odd = bounded_broadcast(self.odd.select(F.col("digest").alias(d), F.col("node").alias(n)), SMALL_ROWS)
        return df.join(odd, digest_of(text) == F.col(d), "left").withColumn(node, F.coalesce(F.col(n), own)).drop(d, n)


def nodes_of(df: DataFrame, key: str, text: str, name: str) -> Nodes:
    """The nodes of ``df``. ``name`` begins the names of stored tables."""
    digest = digest_of(text).alias("digest")
    rows = stored(df.select(F.col(key).cast("long").alias("key"), digest, F.coalesce(F.octet_length(text), F.lit(0)).alias("bytes")), f"{name}-rows", "lz4")
    n_rows = rows.count()
    classes = rows.groupBy("digest").agg(F.min("key").alias("rep"), F.max("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
    classes = stored(gathered(classes, n_rows), f"{name}-classes")
    n_bytes, lowest = classes.agg(F.sum("bytes"), F.min("rep")).first()
    twice = classes.groupBy("rep").agg(F.count(F.lit(1)).alias("times")).where("times > 1 or rep is null").select(F.col("rep").alias("r"))
    odd = classes.join(twice, F.col("rep").eqNullSafe(F.col("r")), "left_semi")
    odd = stored(odd.select("digest", (F.lit((lowest or 0) - 1) - F.monotonically_increasing_id()).alias("node"), "rep"), f"{name}-odd")
    any_odd = not odd.isEmpty()
    nodes = classes.join(odd.select("digest", "node"), "digest", "left").withColumn("node", F.coalesce("node", "rep")) if any_odd else classes.withColumn("node", F.col("rep"))
    member = stored(gathered(rows.select("key", "digest").join(nodes.select("digest", "node", "rep", "n"), "digest"), n_rows), f"{name}-nodes")
    copies = stored(gathered(member.where(~F.col("key").eqNullSafe(F.col("rep"))).select("key", "digest").distinct(), n_rows), f"{name}-copies")
    docs = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    c = bounded_broadcast(copies, SMALL_ROWS).select(F.col("key").alias("k"), F.col("digest").alias("d"))
    docs = docs.join(c, F.col("key").eqNullSafe(F.col("k")) & (digest_of("text") == F.col("d")), "left_anti")
    out = Nodes(member, odd, any_odd, copies, docs, int(n_bytes or 0))
    out.docs = out.place(docs.withColumnRenamed("key", "id"), "id", "text", "key").select("key", "text", "id")
    return out
