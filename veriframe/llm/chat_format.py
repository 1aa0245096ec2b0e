"""Chat formatting: reply trees to root-to-leaf paths, ranked by score, each formatted as one conversation.

DataFrame operations only. The template writes a turn as ``<s>[INST]role[/INST]text</s>``.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from veriframe.session import cut_lineage

# Control strings of the template.
TURN, MIDDLE, END = "<s>[INST]", "[/INST]", "</s>"
# Escapes: the escape character first, undone last. Escaped text holds neither "<" nor "[", so no control string.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("[", "\\s"))


def escape(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    for plain, written in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def leaf_paths(nodes: DataFrame, top: int | None = 1) -> DataFrame:
    """Reply trees (conv_id, node, parent, score) to rows (conv_id, leaf, node, depth, rank) of the chosen paths.

    Self-joins double the reach: after k of them a node knows its 2^k-th ancestor, its depth and the summed score so
    far, so a thread of n turns takes log2(n) joins up and as many down to list the paths. Paths of a conversation are
    ranked by mean score, ties by the smaller leaf; ``top`` is how many stay (None: all). A node whose parent is null
    or unknown is a root. A cycle has no root and gives no path.
    """
    key = ["conv_id"]
    named = nodes.select("conv_id", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = named.select(F.col("conv_id").alias("c"), F.col("node").alias("p"))
    up = named.join(known, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("parent") == F.col("p")), "left")
    up = cut_lineage(up.select("conv_id", "node", F.col("p").alias("up"), F.lit(1).alias("depth"), "score"))
    limit, levels = up.count(), []
    while not up.where("up is not null").isEmpty() and (1 << len(levels)) <= limit:
        # Nodes that have reached their root take no further part on the left.
        below = up.where("up is not null").select("conv_id", "node", "up", "depth", "score")
        levels.append(below.select("conv_id", "node", "up"))
        far = up.select(
            F.col("conv_id").alias("c"), F.col("node").alias("p"), F.col("up").alias("far"),
            F.col("depth").alias("more"), F.col("score").alias("plus"),
        )
        moved = below.join(far, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("up") == F.col("p"))).select(
            "conv_id", "node", F.col("far").alias("up"), (F.col("depth") + F.col("more")).alias("depth"),
            (F.col("score") + F.col("plus")).alias("score"),
        )
        up = cut_lineage(up.where("up is null").unionByName(cut_lineage(moved)))
    inner = named.where("parent is not null").select(F.col("conv_id").alias("c"), F.col("parent").alias("p")).distinct()
    leaves = up.where("up is null").join(
        inner, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("p")), "left_anti"
    )
    order = Window.partitionBy(*key).orderBy((F.col("score") / F.col("depth")).desc(), "node")
    leaves = leaves.withColumn("rank", F.row_number().over(order))
    paths = leaves.select("conv_id", F.col("node").alias("leaf"), "node", "depth", "rank")
    paths = paths if top is None else paths.where(F.col("rank") <= top)
    for k in range(len(levels) - 1, -1, -1):
        jump = levels[k].where("up is not null").select(F.col("conv_id").alias("c"), F.col("node").alias("p"), "up")
        met = paths.join(jump, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("p")), "left")
        here = F.struct("node", "depth")
        above = F.struct(F.col("up").alias("node"), (F.col("depth") - (1 << k)).alias("depth"))
        both = F.explode(F.when(F.col("up").isNull(), F.array(here)).otherwise(F.array(here, above))).alias("x")
        paths = met.select("conv_id", "leaf", "rank", both).select("conv_id", "leaf", "x.node", "x.depth", "rank")
        paths = cut_lineage(paths) if k % 4 == 3 else paths
    return paths


def format_paths(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(conv_id, leaf, rank, formatted, loss_mask): the turns of each path in order, written with the template.

    loss_mask holds the code-point ranges (start from 0, length) of the assistant texts, control strings excluded.
    """
    turns = paths.alias("p").join(
        nodes.select("conv_id", "node", "role", "text").alias("n"),
        F.col("p.conv_id").eqNullSafe(F.col("n.conv_id")) & (F.col("p.node") == F.col("n.node")),
    ).select(
        "p.conv_id", "p.leaf", "p.rank", "p.depth", F.coalesce("n.role", F.lit("")).alias("role"),
        escape(F.col("role")).alias("head"), escape(F.col("text")).alias("body"),
    )
    listed = turns.groupBy("conv_id", "leaf", "rank").agg(
        F.sort_array(F.collect_list(F.struct("depth", "head", "body", (F.col("role") == "assistant").alias("learn")))).alias("t")
    )
    written = F.transform("t", lambda x: F.concat(F.lit(TURN), x["head"], F.lit(MIDDLE), x["body"], F.lit(END)))
    before = len(TURN) + len(MIDDLE)
    state = F.aggregate(
        "t",
        F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("array()").cast("array<struct<start:bigint,length:bigint>>").alias("mask")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["head"]) + F.length(x["body"]) + before + len(END)).alias("at"),
            F.when(x["learn"], F.concat(acc["mask"], F.array(F.struct(
                (acc["at"] + F.length(x["head"]) + before).alias("start"), F.length(x["body"]).cast("bigint").alias("length"),
            )))).otherwise(acc["mask"]).alias("mask"),
        ),
    )
    return listed.select(
        "conv_id", "leaf", "rank", F.array_join(written, "").alias("formatted"), state["mask"].alias("loss_mask"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (array of role, text), read from ``formatted``, and loss_text, cut out by ``loss_mask``."""
    parts = F.filter(F.split("formatted", F.lit(END)), lambda p: p != "")
    turns = F.transform(parts, lambda p: F.struct(
        unescape(F.substring_index(F.substring(p, len(TURN) + 1, 1 << 30), MIDDLE, 1)).alias("role"),
        unescape(F.substring_index(p, MIDDLE, -1)).alias("text"),
    ))
    masked = F.transform("loss_mask", lambda m: F.substring(F.col("formatted"), m["start"].cast("int") + 1, m["length"].cast("int")))
    return formatted.withColumn("turns", turns).withColumn("loss_text", unescape(F.array_join(masked, "")))


def threads(conversations: DataFrame) -> DataFrame:
    """Turns in a row as reply trees with one branch: each turn answers the one before it.

    Turns go by number (null first), then role and text, so repeated rows and ties have a place each. Rows of a null
    conv_id form one conversation.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("node", F.row_number().over(order).cast("bigint"))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return rows.select("conv_id", "node", parent.alias("parent"), F.lit(0.0).alias("score"), "role", "text")
