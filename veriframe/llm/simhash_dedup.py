"""Near-duplicate groups of documents: SimHash fingerprints joined by covering locality-sensitive hashing."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import DataFrame

from veriframe.llm.components import connected_components
from veriframe.llm.shared import limit_arrow_batches, text_bytes
from veriframe.session import cut_lineage

SEED = 42
CHUNK = 1 << 15


def fingerprint(text: bytes, width: int = 4) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text; no word gives zero.

    A-Z are lower-cased, words are what ASCII white space separates, a text of fewer than ``width`` words is one
    shingle. A bit is set if it is set in over half of the shingle hashes, repeats included.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined, width = b" ".join(words), min(width, len(words))
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: len(ends) - width]]
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), CHUNK):
        pairs = zip(starts[at : at + CHUNK], ends[at + width - 1 : at + CHUNK + width - 1])
        hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in pairs], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return sum(1 << i for i in np.flatnonzero(2 * counts > len(starts)).tolist())


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp long) of every row with a doc_id, over the whole text (null: empty)."""
    limit_arrow_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, width) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.where("doc_id is not null").select("doc_id", simhash(text_bytes()).alias("fp"))


def covering_masks(radius: int) -> list[int]:
    """2^(radius+1) - 1 masks of 64 bits, as signed longs: any two words within ``radius`` bits agree on one of them.

    Bit i belongs to vector i mod 2^(radius+1) over GF(2); mask v takes the bits whose vector has an odd product with
    v. The vectors of ``radius`` differing bits always leave some v that is orthogonal to all of them.
    """
    size = 1 << (radius + 1)
    masks = [sum(1 << i for i in range(64) if ((i % size) & v).bit_count() % 2) for v in range(1, size)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def star_edges(nodes: np.ndarray, prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges from the smallest node of each component within one bucket to its other nodes.

    Breadth-first: a print is compared with those not reached yet, so a dense bucket takes few passes.
    """
    order = np.argsort(nodes, kind="stable")
    nodes, prints, edges = nodes[order], prints[order], []
    while len(nodes) > 1:
        root, frontier = int(nodes[0]), prints[:1]
        nodes, prints = nodes[1:], prints[1:]
        while len(frontier) and len(nodes):
            near, step = np.zeros(len(nodes), bool), 1 + (1 << 21) // len(nodes)
            for at in range(0, len(frontier), step):
                differing = np.bitwise_count(frontier[at : at + step, None] ^ prints[None, :])
                near |= (differing <= radius).any(axis=0)
            edges += [(int(x), root) for x in nodes[near]]
            frontier, nodes, prints = prints[near], nodes[~near], prints[~near]
    return edges


def bucket_edges(classes: DataFrame, radius: int, block: int) -> DataFrame:
    """Edges (u, v) that connect exactly those of (node, fp) that chains of prints within ``radius`` bits connect.

    A bucket of more than ``block`` prints is cut into blocks by hash and every pair of its blocks is searched on its
    own, so no task holds more than about two blocks. A print's keys ask for a merge join: Spark takes them for about as
    large as the prints and would send all of them to the driver.
    """
    tables = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in covering_masks(radius)]))
    rows = classes.select("node", "fp", tables.alias("table", "key"))
    sizes = rows.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / block).cast("int")
    shared = rows.join(sizes.hint("merge"), ["table", "key"]).select(
        "table", "key", "node", "fp", parts.alias("parts"), F.pmod(F.xxhash64("fp"), parts).cast("int").alias("part"),
    )
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    paired = shared.withColumn("other", other).select(
        "table", "key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "node", "fp",
    )
    buckets = paired.groupBy("table", "key", "lo", "hi").agg(F.collect_list(F.struct("node", "fp")).alias("b"))

    @F.pandas_udf("array<struct<u:long,v:long>>")
    def linked(nodes: pd.Series, prints: pd.Series) -> pd.Series:
        return pd.Series([
            star_edges(np.asarray(n, np.int64), np.asarray(p, np.int64).view(np.uint64), radius)
            for n, p in zip(nodes, prints)
        ])

    found = buckets.where(F.size("b") > 1).select(F.explode(linked("b.node", "b.fp")).alias("e"))
    return found.select("e.u", "e.v").distinct()


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4, block: int = 4096) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one per row of ``docs`` with a doc_id.

    Documents link when their fingerprints differ in at most ``radius`` bits; component_id is the smallest doc_id a
    chain of links reaches. Equal fingerprints form one class first, so copies never meet pair by pair. Null and empty
    texts have fingerprint zero and link like any other. Rows without doc_id are left out: nothing names them.
    A repeated doc_id gives a row each; with different texts it joins their groups.
    """
    prints = cut_lineage(fingerprints(docs, width))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("node"))
    # A doc_id repeated with another text is one document with two prints: its classes are linked.
    repeated = (
        prints.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("doc_id")
    )
    own = prints.join(repeated, "doc_id").join(classes, "fp").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    parts = connected_components(bucket_edges(classes, radius, block).unionByName(own))
    named = classes.join(parts, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id",
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest doc_id. Rows without doc_id go."""
    groups = near_duplicates(docs)
    kept = groups.where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns)
