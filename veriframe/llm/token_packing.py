"""Concatenate-and-cut packing: global offsets by two-pass prefix sums over partitions, then fixed windows."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyspark.sql.functions as F
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from veriframe.llm.shared import limit_arrow_batches
from veriframe.session import scratch_path

WINDOW = 1024
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
#: Characters of one run of white space, or of anything else, from which on the library itself encodes a text.
LONG_RUN = 5000
_RUNS = re.compile(r"\s+|\S+")
_ENCODERS: dict[str, tiktoken.Encoding] = {}
_LIBRARY: dict[str, Tokenizer] = {}


def _byte_letters() -> dict[str, int]:
    """The letters that a byte-level vocabulary writes bytes with: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str) -> tiktoken.Encoding:
    """Encoder with the ids of a byte-level BPE file of the ``tokenizers`` library.

    It gives the ids of Tokenizer.from_file(path).encode(text, add_special_tokens=False) several times as fast. That
    holds for files whose merges are numbered in their order, which is checked, with the usual pattern.
    """
    if path not in _ENCODERS:
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        letters, vocab = _byte_letters(), model["model"]["vocab"]
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special}
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError("the ids of this vocabulary don't follow its merges")
        _ENCODERS[path] = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _ENCODERS[path]


def token_ids(text: str, path: str) -> list[int]:
    """Ids of a text of any size. Long runs without a border go to the library itself: the fast way is not made for them."""
    if len(text) >= LONG_RUN and any(m.end() - m.start() >= LONG_RUN for m in _RUNS.finditer(text)):
        if path not in _LIBRARY:
            _LIBRARY[path] = Tokenizer.from_file(path)
        return _LIBRARY[path].encode(text, add_special_tokens=False).ids
    return encoder(path).encode(text, allowed_special="all")


def tokenize(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, part, before, ids): little-endian 32-bit ids with the end id, and the ids before them in the partition."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            starts, packed = [], []
            for text in batch["text"]:
                ids = np.array([*token_ids(text.as_py(), path), END_ID], "<u4")
                starts.append(before)
                packed.append(ids.tobytes())
                before += len(ids)
            columns = [batch["doc_id"], pa.array([part] * len(batch), pa.int32()), pa.array(starts, pa.int64()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "before", "ids"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(rows, "doc_id long, part int, before long, ids binary")


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one per piece.

    Documents follow each other as they are read, each with an end id, and are cut wherever a window ends, so only the
    last sequence needs padding. The first pass tokenizes into a table in the shared folder, with each document's place
    in its partition; the totals of the partitions (one number each reaches the driver) give every partition its place.
    Pieces on both sides of a window's or partition's border share the sequence_id. Null and empty texts are one piece
    of the end id alone; repeated rows and null ids are packed like others, and runs of any length (white space, one word) are whole.
    """
    spark = docs.sparkSession
    limit_arrow_batches(spark)
    place = scratch_path(spark, "token-ids")
    path = path or public_tokenizers.path(TOKENIZER)
    tokenize(docs, path).write.option("compression", "zstd").parquet(place)
    table = spark.read.parquet(place)
    ends = F.max(F.col("before") + (F.length("ids") / 4).cast("long")).alias("total")
    totals = {r["part"]: r["total"] for r in table.groupBy("part").agg(ends).collect()}
    base, so_far = {}, 0
    for part in sorted(totals):
        base[part] = so_far
        so_far += totals[part]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for row, (part, before, ids) in enumerate(zip(batch["part"].to_pylist(), batch["before"].to_pylist(), batch["ids"])):
                ids = memoryview(ids.as_buffer())
                at, end, size = base[part] + before, 0, len(ids) // 4
                first = at
                while end < size:
                    start, end = end, min(size, end + window - at % window)
                    crc = zlib.crc32(ids[4 * start : 4 * end])
                    rows.append(row)
                    out.append((start, end - start, crc, size, at // window, at % window))
                    at = first + end
            columns = [pa.array(c, pa.int64()) for c in zip(*out)] or [pa.array([], pa.int64())] * 6
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(rows, pa.int64())), *columns], PIECE)

    return table.mapInArrow(pieces, ", ".join(f"{c} long" for c in PIECE))
