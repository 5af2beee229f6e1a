"""Chat formatting by reply trees: native DataFrame operations only.

Messages are nodes with a parent. Root-to-leaf paths are enumerated by iterative self-joins that double their
reach each round: after round k a table holds every node's 2^k-th ancestor, and each leaf's path its last 2^k
nodes, so a tree of depth d takes about log2(d) rounds and a path's rows are made once, never as arrays of arrays.
Branches are ranked by score, the best ``keep`` of each conversation are formatted.

Template: ``<|im_start|>`` role newline text ``<|im_end|>`` newline. In texts ``\\`` becomes ``\\\\`` and ``<|``
becomes ``<\\|``, so no control string can occur in a text; a newline in a role becomes ``<|nl|>``. ``parse``
undoes this exactly.

Defined results: null text or role is empty; a null conversation id is a conversation of its own; turns that
tie are ordered by role and text, and repeated rows stay repeated; null turns come first; an empty table gives
no rows. A node whose parent doesn't exist is a root. Nodes on a cycle have no leaf and give no path, and neither does a
leaf whose ancestors run into a cycle; rounds end when they reach further than the largest conversation has nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import running_sums
from weftline.llm.common import stored

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def chain_of_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Nodes of conversations whose turns answer the turn before: (conv, node, parent, role, text, score)."""
    rows = df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    at = F.row_number().over(Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")).cast("long")
    rows = rows.withColumn("node", at)
    return rows.select("conv", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.length("text").cast("double").alias("score"))


def paths(nodes: DataFrame) -> DataFrame:
    """(conv, leaf, node, up): each leaf's ancestors and their distance. ``nodes`` is a stored table."""
    links = nodes.select("conv", "node", "parent")
    known = links.select("conv", F.col("node").alias("parent"))
    jump = links.join(known, _same(links, known, "conv", "parent"), "left_semi").select("conv", "node", F.col("parent").alias("to"))
    inner = links.where("parent is not null").select("conv", F.col("parent").alias("node")).distinct()
    reach = links.join(inner, _same(links, inner, "conv", "node"), "left_anti").select("conv", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    jump, reach, step = stored(jump, "chat-jump"), stored(reach, "chat-reach"), 1
    sizes = nodes.groupBy(F.col("conv").alias("c")).agg(F.count(F.lit(1)).alias("n_nodes"))
    most = sizes.agg(F.max("n_nodes")).first()[0] or 0
    while not jump.isEmpty() and step <= most:
        j = jump.select(F.col("conv").alias("c"), F.col("node").alias("n"), "to")
        more = reach.join(j, F.col("conv").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n"))).select("conv", "leaf", F.col("to").alias("node"), (F.col("up") + step).alias("up"))
        far = jump.select("conv", "node", F.col("to").alias("via"))
        far = far.join(j, F.col("conv").eqNullSafe(F.col("c")) & (F.col("via") == F.col("n"))).select("conv", "node", F.col("to"))
        reach, jump, step = stored(reach.unionByName(more), "chat-reach"), stored(far, "chat-jump"), step * 2
    if jump.isEmpty():
        return reach
    deep = reach.groupBy("conv", "leaf").agg(F.max("up").alias("up")).join(sizes, F.col("conv").eqNullSafe(F.col("c"))).where("up >= n_nodes")
    deep = deep.select(F.col("conv").alias("c"), F.col("leaf").alias("l"))
    return reach.join(deep, F.col("conv").eqNullSafe(F.col("c")) & (F.col("leaf") == F.col("l")), "left_anti")


def _same(a: DataFrame, b: DataFrame, *keys: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


def format_trees(nodes: DataFrame, keep: int = 1) -> DataFrame:
    """(conv, leaf, branch, score, n_turns, formatted): the ``keep`` best branches of each conversation.

    A branch's score is the mean of its nodes' scores; ties go to the smaller leaf.
    """
    nodes = stored(nodes, "chat-nodes")
    way = paths(nodes)
    n = nodes.select(F.col("conv").alias("c"), F.col("node").alias("n"), "role", "text", "score")
    full = way.join(n, F.col("conv").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n")))
    piece = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit(NEWLINE)), F.lit("\n"), escape(F.col("text")), F.lit(END + "\n"))
    turns = F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), piece.alias("piece"))))
    whole = full.groupBy("conv", "leaf").agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("n_turns"), turns.alias("turns"))
    best = Window.partitionBy("conv").orderBy(F.desc("score"), "leaf")
    whole = whole.withColumn("branch", F.row_number().over(best)).where(F.col("branch") <= keep)
    return whole.select("conv", "leaf", "branch", "score", "n_turns", F.array_join(F.col("turns.piece"), "").alias("formatted"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns of a formatted conversation, unescaped."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(p: Column) -> Column:
        body = F.substring(p, len(START) + 1, 2147483647)
        cut = F.locate("\n", body)
        role = unescape(F.replace(F.substring(body, F.lit(1), cut - 1), F.lit(NEWLINE), F.lit("\n")))
        return F.struct(role.alias("role"), unescape(F.substring(body, cut + 1, F.length(body))).alias("text"))

    return F.transform(pieces, turn)


def loss_text(turns: Column, role: str = "assistant") -> Column:
    """All text under the loss mask: the assistant's texts, without markers."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == role), lambda t: t["text"]), "")


def loss_spans(formatted: Column, role: str = "assistant") -> Column:
    """array<struct<begin, length>>: spans of ``formatted``, in characters, on which a model is trained."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    head, tail = START + role + "\n", len(END) + 1
    ends = running_sums(F.transform(pieces, lambda p: F.length(p) + tail))

    def span(p: Column, i: Column) -> Column:
        length = F.length(p) - len(head)
        return F.when(F.startswith(p, F.lit(head)), F.struct((F.get(ends, i) - tail - length).alias("begin"), length.alias("length")))

    return F.filter(F.transform(pieces, span), lambda x: x.isNotNull())
