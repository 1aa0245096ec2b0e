"""Prefix trie of turn sequences by van Emde Boas recursion: cut at half depth, name the cut prefixes, graft totals upward.

One round works on all parts of one size at once: the upper trie and every lower forest of every part. So a trie of depth
D takes about log2(D) rounds of joins on unique keys, whatever its shape, and no task holds a conversation or a subtree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from veriframe.operators.ranking import positions
from veriframe.session import cut_lineage

#: Turns that are numbered in one window, and the ids of an end list that are joined into one string.
NUMBERING_CELL, END_CELL = 4096, 256
ROOT = hashlib.md5(b"").digest()


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, position, role, text): turns numbered from 1 by turn (null first), then role and text, null as empty.

    Rows without conv_id belong to no conversation and are left out. Turns are numbered in cells of 4,096 turn values,
    so a long conversation is spread over tasks.
    """
    kept = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    order = [F.asc_nulls_first("turn"), F.col("role"), F.col("text")]
    return positions(kept, ["conv_id"], [], order, block=("turn", NUMBERING_CELL)).drop("turn")


def _pair(a: Column, b: Column) -> Column:
    return F.unhex(F.md5(F.concat(a, b)))


def _blocks(turns: DataFrame, levels: int) -> list[DataFrame]:
    """By level k: (conv_id, j, digest) of the turns j * 2^k + 1 to (j + 1) * 2^k, of whole blocks only."""
    said = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    at = turns.select("conv_id", (F.col("position") - 1).alias("j"), F.unhex(F.md5(said)).alias("digest"))
    out = [cut_lineage(at)]
    for _ in range(1, levels):
        half = lambda odd: F.max(F.when(F.pmod("j", F.lit(2)) == odd, F.col("digest")))
        two = out[-1].groupBy("conv_id", F.floor(F.col("j") / 2).alias("j")).agg(half(0).alias("a"), half(1).alias("b"))
        out.append(cut_lineage(two.where("b IS NOT NULL").select("conv_id", "j", _pair(F.col("a"), F.col("b")).alias("digest"))))
    return out


def _names(convs: DataFrame, blocks: list[DataFrame]) -> DataFrame:
    """(conv_id, depth, name) of every prefix of every sequence, the empty one included.

    A part is a root name and the turns of one block below it. Its cut prefix is named by the root and the digest of the
    block's upper half; it is the root of the lower half, whose forest is cut in the next round along with the upper trie.
    """
    parts = convs.select("conv_id", F.lit(0).cast("long").alias("j"), F.lit(ROOT).alias("name"))
    for block in reversed(blocks):
        upper = parts.select("conv_id", (F.col("j") * 2).alias("j"), "name")
        lower = upper.join(block, ["conv_id", "j"]).select("conv_id", (F.col("j") + 1).alias("j"), _pair(F.col("name"), F.col("digest")).alias("name"))
        parts = cut_lineage(upper.unionByName(lower))
    return parts.withColumnRenamed("j", "depth")


def _subtree_sums(nodes: DataFrame, levels: int, values: list[str]) -> DataFrame:
    """(name, values) summed over every node's subtree; ``nodes`` has (name, depth, parent, values).

    On the way up, level k keeps the nodes at depths that 2^k divides, with their ancestor 2^k above and the totals of
    the 2^k layers from them on: the lower forests' totals are grafted on the upper tries' nodes. On the way down,
    nodes between two cuts get the whole totals of the cut nodes below them.
    """
    here, kept = nodes.select("name", "depth", F.col("parent").alias("above"), *values), []
    add = lambda df: df.groupBy("above").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    total = [(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values]
    for k in range(levels):
        is_odd = F.pmod(F.shiftright("depth", k), F.lit(2)) == 1
        odd, even = here.where(is_odd), here.where(~is_odd)
        kept.append((odd, even))
        grafted = even.join(add(odd).withColumnRenamed("above", "name"), "name", "left").select("name", "depth", "above", *total)
        step = odd.select(F.col("name").alias("above"), F.col("above").alias("_above"))
        here = cut_lineage(grafted.join(step, "above", "left").select("name", "depth", F.col("_above").alias("above"), *values))
    whole = here.select("name", *values)
    for odd, even in reversed(kept):
        below = add(even.select("name", "above").where("above IS NOT NULL").join(whole, "name"))
        odd = odd.join(below.withColumnRenamed("above", "name"), "name", "left").select("name", *total)
        whole = cut_lineage(whole.unionByName(odd))
    return whole


def _end_digests(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256): digest of the ascending decimal conv_ids of each name, comma-joined.

    Ids are joined in cells of 256; a task then reads a name's cells in order and keeps the digest's state alone.
    """
    cell = F.floor(F.col("conv_id") / END_CELL).alias("cell")
    ids = F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",")
    cells = ends.groupBy("name", cell).agg(ids.alias("ids")).repartition("name").sortWithinPartitions("name", "cell")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for key, ids in zip(batch["name"].to_pylist(), batch["ids"].to_pylist()):
                if key == name:
                    state.update(b",")
                else:
                    done += [(name, state.hexdigest())] if state else []
                    name, state = key, hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["name", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([state.hexdigest()])], ["name", "ends_sha256"])

    return cells.mapInArrow(digest, "name binary, ends_sha256 string")


def build_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node: (name, conv_id, depth, parent, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    ``turns`` has (conv_id, position, role, text), positions 1, 2, ... without gaps; ``convs`` has every conv_id once, also
    of sequences without a turn. A node is a distinct sequence of first turns (role and text both), named by a digest;
    conv_id is its smallest member. Equal first turns, however many, meet in map-side sums. No sequence: no node.
    """
    turns, convs = cut_lineage(turns), cut_lineage(convs.select("conv_id"))
    depth = turns.agg(F.max("position")).first()[0] or 0
    levels = max(1, depth.bit_length())
    names = _names(convs, _blocks(turns, levels))
    lengths = turns.groupBy("conv_id").agg(F.max("position").alias("n_turns"))
    last = turns.select("conv_id", F.col("position").alias("depth"), F.octet_length("text").cast("long").alias("bytes"))
    nodes = cut_lineage(
        names.join(last, ["conv_id", "depth"], "left").groupBy("name", "depth").agg(
            F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.coalesce(F.max("bytes"), F.lit(0)).alias("bytes")
        )
    )
    above = names.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    nodes = cut_lineage(nodes.join(above, ["conv_id", "depth"], "left"))
    children = nodes.groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    nodes = cut_lineage(nodes.join(children, "name", "left").fillna(0, ["n_children"]))
    own = nodes.select(
        "name", "depth", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"),
    )
    sums = _subtree_sums(own, levels, ["n_leaves", "saved_tokens"])
    ended = convs.join(lengths, "conv_id", "left").select("conv_id", F.coalesce("n_turns", F.lit(0)).alias("depth"))
    digests = _end_digests(names.join(ended, ["conv_id", "depth"]).select("name", "conv_id"))
    parents = nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums, "name").join(digests, "name", "left").join(parents, "parent", "left")
    return out.select(
        "name", "conv_id", "depth", "parent", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, convs) of conversations that begin like a neighbour: a stand-in for prompts that many conversations share.

    Conversation c takes the first h turns of conversation c - c % 5 (all if fewer, none if absent), then its own turns
    after its first h, where h is the unsigned CRC32 of c in decimal, modulo 9.
    """
    turns = cut_lineage(ordered_turns(conversations))
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    convs = turns.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), shared.alias("h"))
    heads = turns.where("position <= 8").withColumnRenamed("conv_id", "base")
    borrowed = convs.join(heads, "base").where("position <= h")
    taken = borrowed.groupBy("conv_id").agg(F.count("*").alias("taken"))
    moved = turns.join(convs.join(taken, "conv_id", "left"), "conv_id").where("position > h").withColumn(
        "position", F.col("position") - F.col("h") + F.coalesce("taken", F.lit(0))
    )
    columns = ["conv_id", "position", "role", "text"]
    return borrowed.select(*columns).unionByName(moved.select(*columns)), convs
