"""Ranked lexical search turned round: an index over the items' terms is broadcast and the documents stream through it.

A task holds the index of one block of items, at most k hits per item and one batch of texts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from veriframe.llm.shared import limit_arrow_batches, text_bytes

#: (term, item) pairs in one broadcast index, about; more items are searched in several blocks, dealt by hash.
BLOCK_POSTINGS = 1_000_000
#: Cells of the score table (documents x items) that a task fills at once.
CELLS = 2_000_000
#: Bytes of one text that are cut into words at once.
SLICE = 1 << 20
#: ASCII letters are lower-cased; all ASCII but letters and digits parts words; other bytes are those of longer characters.
_FOLD = bytes(
    b if b >= 128 or chr(b).isdigit() or "a" <= chr(b) <= "z" else b + 32 if "A" <= chr(b) <= "Z" else 32 for b in range(256)
)


def word_slices(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a whole text in lists of bounded size."""
    folded, at = text.translate(_FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + SLICE) if len(folded) - at > SLICE else -1
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def term_counts(text: bytes, term_ids: dict[bytes, int]) -> tuple[int, Counter]:
    """(number of terms, occurrences of the index's terms by their id)."""
    n, counts = 0, Counter()
    for terms in word_slices(text):
        n += len(terms)
        counts.update(map(term_ids.get, terms))
    counts.pop(None, None)
    return n, counts


@dataclass
class Index:
    """Postings of a block of items: those of term t are first[t] to first[t + 1]."""

    term_ids: dict[bytes, int]
    item_ids: list[int | None]
    first: np.ndarray
    item: np.ndarray
    times: np.ndarray  # occurrences in the item; times the term's weight when ``weighted``


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times); rows that share an item_id (null as well) are one item with the terms of all of them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch["item_id"], batch["text"]):
                for terms in word_slices(text.as_py()):
                    found = Counter(terms)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item.as_py()] * len(found), pa.int64()), pa.array(list(found), pa.binary()),
                         pa.array(list(found.values()), pa.int64())], ["item_id", "term", "times"],
                    )

    texts = items.select(F.col("item_id").cast("long").alias("item_id"), text_bytes().alias("text"))
    found = texts.mapInArrow(rows, "item_id long, term binary, times long")
    return found.groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def build_index(rows: list) -> Index:
    """The inverted index of collected rows (item_id, term, times)."""
    items = {i: k for k, i in enumerate(sorted({r["item_id"] for r in rows}, key=lambda i: (i is None, i or 0)))}
    terms = {t: k for k, t in enumerate(sorted({bytes(r["term"]) for r in rows}))}
    term = np.array([terms[bytes(r["term"])] for r in rows], np.int64)
    order = np.argsort(term, kind="stable")
    return Index(
        terms, list(items), np.searchsorted(term[order], np.arange(len(terms) + 1)),
        np.array([items[r["item_id"]] for r in rows], np.int64)[order], np.array([r["times"] for r in rows], np.int64)[order],
    )


def corpus_statistics(texts: DataFrame, index: Index) -> tuple[int, int, np.ndarray]:
    """(documents with a term, all their terms, documents that hold each term of the index), counted within the tasks."""
    shared = texts.sparkSession.sparkContext.broadcast(index.term_ids)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding, total = np.zeros(len(shared.value) + 2, np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                n, counts = term_counts(text.as_py(), shared.value)
                total += n
                holding[-2] += n > 0
                holding[list(counts)] += 1
        holding[-1] = total
        used = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(holding[used])], ["term", "n"])

    sums = {r["term"]: r["n"] for r in texts.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    size = len(index.term_ids)
    return sums.get(size, 0), sums.get(size + 1, 0), np.array([sums.get(t, 0) for t in range(size)], np.int64)


def weighted(index: Index, documents: int, holding: np.ndarray) -> Index:
    """The index with times x weight in place of times."""
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in holding], np.int64)
    spread = np.repeat(weights, np.diff(index.first))
    return Index(index.term_ids, index.item_ids, index.first, index.item, index.times * spread)


def scores(index: Index, counted: list[Counter], lengths: list[int]) -> np.ndarray:
    """Table (documents x items) of 64-bit scores; ``lengths`` are the documents' m."""
    doc = np.repeat(np.arange(len(counted)), [len(c) for c in counted])
    term = np.fromiter((t for c in counted for t in c), np.int64, len(doc))
    tf = np.fromiter((n for c in counted for n in c.values()), np.int64, len(doc))
    value = (1_000_000_000 * tf) // (1000 * tf + 8 * np.array(lengths, np.int64)[doc])
    postings = index.first[term + 1] - index.first[term]
    entry = np.repeat(np.arange(len(doc)), postings)
    at = np.arange(len(entry)) - np.repeat(np.cumsum(postings) - postings, postings) + index.first[term][entry]
    out = np.zeros(len(counted) * len(index.item_ids), np.int64)
    np.add.at(out, doc[entry] * len(index.item_ids) + index.item[at], value[entry] * index.times[at])
    return out.reshape(len(counted), len(index.item_ids))


class Heaps:
    """The k best hits of every item so far: highest score first, then the smaller doc_id, rows without one last."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.floor = k, np.ones(items, np.int64)
        self.item = self.score = self.nameless = self.doc = np.zeros(0, np.int64)

    def add(self, table: np.ndarray, nameless: np.ndarray, docs: np.ndarray) -> None:
        row, item = np.nonzero(table >= self.floor)
        if not len(row):
            return
        cells = [(self.item, item), (self.score, table[row, item]), (self.nameless, nameless[row]), (self.doc, docs[row])]
        item, score, nameless, doc = (np.concatenate(c) for c in cells)
        order = np.lexsort((doc, nameless, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        kept = order[place < self.k]
        last = place == self.k - 1
        self.floor[item[last]] = score[order][last]
        self.item, self.score, self.nameless, self.doc = item[place < self.k], score[kept], nameless[kept], doc[kept]


def _search_block(texts: DataFrame, index: Index, documents: int, total: int, k: int) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(index)
    step = max(1, CELLS // max(1, len(index.item_ids)))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        heaps = Heaps(len(own.item_ids), k)
        for batch in batches:
            ids, texts = batch["doc_id"], batch["text"]
            nameless, named = np.asarray(ids.is_null().to_numpy(False), np.int64), ids.fill_null(0).to_numpy(False)
            for at in range(0, len(batch), step):
                pairs = [term_counts(text.as_py(), own.term_ids) for text in texts[at : at + step]]
                m = [25 + 75 * n * documents // total if n else 0 for n, _ in pairs]
                heaps.add(scores(own, [c for _, c in pairs], m), nameless[at : at + step], named[at : at + step])
        yield pa.RecordBatch.from_arrays(
            [pa.array([own.item_ids[i] for i in heaps.item], pa.int64()), pa.array(heaps.doc, mask=heaps.nameless > 0),
             pa.array(heaps.score)], ["item_id", "doc_id", "score"],
        )

    return texts.mapInArrow(stream, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the k documents with the highest score above 0 for each item.

    Only the term statistics of one block of items (its broadcast index) and at most k hits per item and task leave the
    tasks; the merge keeps k per item before its shuffle. Texts are read twice per block of ``BLOCK_POSTINGS``: to count
    and to score. Null and empty texts have no term and count nowhere. Every row of ``docs`` is a document, also a
    repeated one; rows without doc_id come last among equal scores. Items of the same item_id are one item; an item
    without terms, or with terms that no document holds, has no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    limit_arrow_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    terms = item_terms(items)
    blocks = -(-terms.count() // BLOCK_POSTINGS)
    found = spark.createDataFrame([], "item_id long, doc_id long, score long")
    for block in range(blocks):
        mine = F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block
        rows = terms.where(mine).collect()
        if not rows:
            continue
        index = build_index(rows)
        documents, total, holding = corpus_statistics(texts, index)
        found = found.unionByName(_search_block(texts, weighted(index, documents, holding), documents, total, k))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
