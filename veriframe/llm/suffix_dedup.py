"""Repeated byte strings by column-wise construction of a collection's Burrows-Wheeler transform and common prefixes.

Strings of ``size`` bytes that are equal have the same anchor (the 32 bytes of least hash) at the same place. So texts are
cut into pieces, one per run of strings with one anchor; pieces meet by anchor, aligned on it, and equal strings start in
the same column. A task builds the transform of the pieces it holds from the last column to the first: each round puts
one symbol in front of every piece, sorts the suffixes of that column by that symbol from the order of the round before,
and updates their common prefixes; symbols, transform and prefixes pass through sequential files.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from veriframe.llm.shared import limit_arrow_batches, written
from veriframe.session import cut_lineage

SIZE = 400
ANCHOR = 32
#: Different pieces of one anchor that a task compares at once; anchors with more are dealt again by more of their content.
GROUP = 4096
#: Bytes of pieces in one collection, about (whole anchors).
COLLECTION = 3 << 20
#: Starts in a block when an anchor is dealt again, by round; strings of the last round's blocks are compared whole.
BLOCKS = (16, 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


# --- the collection's transform ------------------------------------------------------------------


def _between(prefixes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For neighbours of a new order: the least common prefix between their old places (prefixes[i]: of i - 1 and i)."""
    before, after = order[:-1], order[1:]
    out = prefixes[after]
    far = np.flatnonzero(after != before + 1)
    if len(far):
        ends = np.empty(2 * len(far), np.int64)
        ends[::2], ends[1::2] = before[far] + 1, after[far] + 1
        out[far] = np.minimum.reduceat(np.append(prefixes, 0), ends)[::2]
    return out


def collection_columns(pieces: list[bytes], marks: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """The transform of pieces aligned on their marks, column by column from the last one.

    Yields (column, order, symbols, prefixes): the pieces that have a suffix starting in the column, in the order of these
    suffixes (a suffix that is a beginning of another comes first; equal ones in any order), the symbols before them
    (-1: none) and the common prefix of each with its predecessor. Symbols are read from a file one column per round.
    """
    lengths = np.array([len(p) for p in pieces], np.int64)
    first, last = -marks, lengths - marks  # columns of a piece: first to last - 1
    low, high = int(first.min()), int(last.max())
    table = np.zeros((high - low, len(pieces)), np.uint8)
    for i, piece in enumerate(pieces):
        table[first[i] - low : last[i] - low, i] = np.frombuffer(piece, np.uint8)
    with tempfile.TemporaryFile() as file:
        file.write(np.ascontiguousarray(table[::-1]).data)
        del table
        file.seek(0)
        order, prefixes = np.zeros(0, np.int64), np.zeros(0, np.int32)
        entering = {int(c): np.flatnonzero(last == c) for c in np.unique(last)}
        leaving = set(first.tolist())
        column = np.frombuffer(file.read(len(pieces)), np.uint8)
        for c in range(high - 1, low - 1, -1):
            come = entering.get(c + 1)
            if come is not None:  # their suffix was empty so far: less than all others
                order = np.concatenate([come, order])
                prefixes = np.concatenate([np.zeros(len(come), np.int32), prefixes])
            symbols = column[order]
            moved = np.argsort(symbols, kind="stable")
            symbols = symbols[moved]
            grown = np.zeros(len(order), np.int32)
            if len(order) > 1:
                grown[1:] = np.where(symbols[1:] == symbols[:-1], _between(prefixes, moved) + 1, 0)
            order, prefixes = order[moved], grown
            column = np.frombuffer(file.read(len(pieces)), np.uint8)
            preceding = np.where(first[order] < c, column[order].astype(np.int16), -1) if len(column) else np.full(len(order), -1)
            yield c, order, preceding, prefixes
            if c in leaving:
                stay = np.flatnonzero(first[order] < c)
                if len(stay):  # a common prefix now spans those that left
                    starts = np.concatenate([[0], stay[:-1] + 1])
                    prefixes = np.minimum.reduceat(prefixes[: stay[-1] + 1], starts)
                    prefixes = np.where(np.arange(len(stay)) == 0, 0, prefixes).astype(np.int32)
                else:
                    prefixes = prefixes[:0]
                order = order[stay]


def write_transform(pieces: list[bytes], marks: np.ndarray, transform, prefix_file) -> np.ndarray:
    """Write the transform (symbol + 1 as 16 bits) and common prefixes (32 bits); returns (columns, orders) to read them by."""
    sizes = []
    for c, order, symbols, prefixes in collection_columns(pieces, marks):
        transform.write((symbols + 1).astype("<u2").tobytes())
        prefix_file.write(np.stack([order.astype("<i4"), prefixes.astype("<i4")]).tobytes())
        sizes.append((c, len(order)))
    return np.array(sizes, np.int64).reshape(-1, 2)


def repeated_starts(pieces: list[bytes], marks: np.ndarray, size: int) -> list[list[tuple[int, int]]]:
    """For each piece the runs [from, to) of starts of strings of ``size`` bytes that other pieces have in the same column."""
    with tempfile.TemporaryFile() as transform, tempfile.TemporaryFile() as prefix_file:
        sizes = write_transform(pieces, marks, transform, prefix_file)
        prefix_file.seek(0)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for c, n in sizes:
            order, prefixes = np.frombuffer(prefix_file.read(8 * int(n)), "<i4").reshape(2, -1)
            long = prefixes >= size
            if long.any():
                long |= np.append(long[1:], False)
                found.append((order[long], np.full(int(long.sum()), c)))
    out: list[list[tuple[int, int]]] = [[] for _ in pieces]
    if found:
        piece, column = (np.concatenate(x) for x in zip(*found))
        by = np.lexsort((column, piece))
        piece, start = piece[by], (column + marks[piece])[by]
        cut = np.flatnonzero((np.diff(piece) != 0) | (np.diff(start) != 1)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(piece)]):
            out[piece[a]].append((int(start[a]), int(start[b - 1]) + 1))
    return out


# --- pieces ------------------------------------------------------------------------------------------


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every window of ``width`` values."""
    n = len(values)
    padded = np.concatenate([values, np.full(-n % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, 1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchored_pieces(text: bytes, size: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, strings, mark, key): runs of starts whose strings have the same anchor; piece = strings + size - 1 bytes.

    The anchor of a string is its leftmost part of ``ANCHOR`` bytes with the least hash, so it depends on the string only.
    """
    n, span = len(text), min(ANCHOR, size)
    if n < size:
        return
    words = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text + bytes(8), np.uint8), 8)[: n + 1]
    mixed = np.ascontiguousarray(words).view("<u8").ravel()[:n] * _ODD
    mixed ^= mixed >> np.uint64(29)
    mixed *= _ODD
    count = n - span + 1
    hashes = mixed[:count].copy() if span >= 8 else np.frombuffer(text, np.uint8)[:count].astype(np.uint64) * _ODD
    for at in range(8, span - 7, 8):
        hashes = (hashes ^ (mixed[at : at + count] >> np.uint64(at // 4))) * _ODD
    hashes ^= hashes >> np.uint64(31)
    width = size - span + 1
    least = _least(hashes, width)
    bounds = [0, *(np.flatnonzero(least[1:] != least[:-1]) + 1).tolist(), len(least)]
    for a, b in zip(bounds, bounds[1:]):
        key = least[a]
        start = a
        for p in np.flatnonzero(hashes[a : b + width - 1] == key).tolist():
            end = min(b, a + p + 1)
            if end > start:
                yield start, end - start, a + p, int(key.astype(np.int64))
                start = end


def block_pieces(piece: bytes, mark: int, key: int, size: int, width: int) -> Iterator[tuple[int, int, int, int]]:
    """(start, strings, mark, key) of a piece dealt again: blocks of ``width`` columns, keyed by the bytes that all share."""
    at, strings = 0, len(piece) - size + 1
    while at < strings:
        column = (at - mark) // width * width  # the block's first column
        end = min(strings, column + width + mark)
        common = piece[column + mark + width - 1 : column + mark + size]
        digest = hashlib.md5(b"%d:%d:" % (key, column) + common).digest()
        yield at, end - at, mark, int.from_bytes(digest[:8], "little", signed=True)
        at = end


_PLACE = "at long, strings long, mark long, key long, piece binary, copies long"
_FIELDS = ["owner", "at", "strings", "mark", "key", "piece", "copies"]


def _places(bodies: DataFrame, size: int, level: int) -> DataFrame:
    """Where pieces begin: one row per owner and different piece, and rows without key for further copies in the same owner.

    (owner, at, strings, mark, key, piece, copies): mark is the anchor's place in the piece, copies how often it is there.
    """
    kind = bodies.schema["owner"].dataType
    arrow = pa.int64() if kind.typeName() == "long" else pa.binary()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in _FIELDS]
            for owner, body, mark, key in zip(*(batch[c] for c in ("owner", "body", "mark", "key"))):
                owner, body = owner.as_py(), body.as_py()
                found = anchored_pieces(body, size) if not level else block_pieces(body, mark.as_py(), key.as_py(), size, BLOCKS[level - 1])
                rows: dict[bytes, list] = {}
                again: list[list[int]] = []
                for at, n, place, own in found:
                    piece = hashlib.md5(body[at : at + n + size - 1]).digest()
                    if piece not in rows:
                        rows[piece] = [owner, at, n, place - at, own, piece, 1]
                        continue
                    rows[piece][-1] += 1
                    if again and again[-1][1] == at:  # one row for a whole stretch: a long run of one letter is two rows
                        again[-1][1] = at + n
                    else:
                        again.append([at, at + n])
                for row in [*rows.values(), *([owner, at, end - at, 0, None, b"", 0] for at, end in again)]:
                    for column, value in zip(columns, row):
                        column.append(value)
            types = [arrow, *[pa.int64()] * 4, pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], _FIELDS)

    return bodies.mapInArrow(cut, f"owner {kind.simpleString().replace('bigint', 'long')}, {_PLACE}")


def _compared(pieces: DataFrame, size: int) -> DataFrame:
    """(piece, from, to) by the collections' transforms; all pieces of a key are in one collection."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            if sum(b["body"].map(len).sum() for b in held) < COLLECTION:
                continue
            rows = pd.concat(held, ignore_index=True)
            open_key = rows["key"] == rows["key"].iloc[-1]
            if not open_key.all():
                yield from compare(rows[~open_key])
                rows = rows[open_key]
            held = [rows]
        if held:
            yield from compare(pd.concat(held, ignore_index=True))

    def compare(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if len(rows):
            bodies = [bytes(b) for b in rows["body"]]
            runs = repeated_starts(bodies, rows["mark"].to_numpy(np.int64), size)
            out = [(p, a, b) for p, own in zip(rows["piece"], runs) for a, b in own]
            yield pd.DataFrame(out, columns=["piece", "from", "to"])

    dealt = pieces.select("key", "piece", "mark", "body").repartition("key").sortWithinPartitions("key")
    return dealt.mapInPandas(build, "piece binary, `from` long, `to` long")


def _repeats(bodies: DataFrame, size: int, level: int = 0) -> DataFrame:
    """(owner, from, to): starts of strings of ``size`` bytes of a body (owner, mark, key, body) that start elsewhere too."""
    places = written(_places(bodies, size, level), "places")
    again = places.where("key IS NULL OR copies > 1").select("owner", F.col("at").alias("from"), (F.col("at") + F.col("strings")).alias("to"))
    # Most anchors are there once: they are dropped before pieces are gathered.
    often = places.where("key IS NOT NULL").groupBy("key").agg(F.sum("copies").alias("n")).where("n > 1").select("key")
    keyed = written(places.where("key IS NOT NULL").join(often, "key"), "shared-places")
    home = F.min(F.struct("owner", "at", "strings", "mark")).alias("home")
    kinds = cut_lineage(keyed.groupBy("key", "piece").agg(F.sum("copies").alias("copies"), home))
    shared = kinds.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1")
    asked = kinds.join(shared, "key").select("key", "piece", "kinds", "home.*")
    parts = asked.groupBy("owner").agg(F.collect_list(F.struct("key", "piece", "kinds", "at", "strings", "mark")).alias("parts"))
    inside = F.substring("body", F.col("part.at").cast("int") + 1, (F.col("part.strings") + (size - 1)).cast("int"))
    pieces = bodies.select("owner", "body").join(parts, "owner").select("body", F.explode("parts").alias("part")).select(
        "part.key", "part.piece", "part.kinds", "part.mark", inside.alias("body")
    )
    pieces = written(pieces, "pieces")
    whole = kinds.where("copies > 1").select("piece", F.lit(0).cast("long").alias("from"), F.col("home.strings").alias("to"))
    if level == len(BLOCKS):
        found = _compared(pieces, size)
    else:
        found = _compared(pieces.where(F.col("kinds") <= GROUP), size)
        many = pieces.where(F.col("kinds") > GROUP).select(F.col("piece").alias("owner"), "mark", "key", "body")
        if not many.isEmpty():
            deeper = _repeats(many, size, level + 1)
            found = found.unionByName(deeper.select(F.col("owner").alias("piece"), "from", "to"))
    spread = keyed.select("owner", "at", "piece").join(found.unionByName(whole), "piece")
    return spread.select("owner", (F.col("at") + F.col("from")).alias("from"), (F.col("at") + F.col("to")).alias("to")).unionByName(again)


def remove_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Rows (doc_id, text, spans, kept): byte spans covered by strings of ``size`` bytes that start elsewhere too, and the rest.

    spans are the maximal runs (start, end), ascending; kept is the text's UTF-8 bytes without them. Every row is a
    document, also one that repeats another or has no doc_id; a null text is empty and stays null. Texts of under ``size``
    bytes keep all. Strings are judged on the input: the first of several copies goes as well. Other columns are not
    read. Equal pieces are compared once; of an anchor with over ``GROUP`` different pieces, the starts are dealt again
    in blocks by the bytes that a block's strings share, down to single strings, so no key gathers more than that.
    """
    spark = docs.sparkSession
    limit_arrow_batches(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = written(rows, "texts")
    null = F.lit(None).cast("long")
    bodies = rows.where(F.octet_length("text") >= size).select(
        F.col("row").alias("owner"), null.alias("mark"), null.alias("key"), F.col("text").cast("binary").alias("body")
    )
    hits = _repeats(bodies, size).groupBy("owner").agg(F.collect_list(F.struct("from", "to")).alias("hits"))

    @F.pandas_udf("struct<spans:array<struct<start:long,end:long>>,kept:binary>")
    def without(texts: pd.Series, hits: pd.Series) -> pd.DataFrame:
        spans, kept = [], []
        for text, own in zip(texts, hits):
            if own is None:
                spans.append(None), kept.append(None)
                continue
            merged: list[list[int]] = []
            for a, b in sorted((h["from"], h["to"] + size - 1) for h in own):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            ends = [0, *(x for span in merged for x in span), len(text)]
            spans.append([{"start": a, "end": b} for a, b in merged])
            kept.append(b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2])))
        return pd.DataFrame({"spans": spans, "kept": kept})

    joined = rows.join(hits.withColumnRenamed("owner", "row"), "row", "left")
    cut = without(F.when(F.col("hits").isNotNull(), F.col("text").cast("binary")), F.col("hits"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return joined.withColumn("cut", cut).select(
        "doc_id", "text", F.coalesce("cut.spans", none).alias("spans"),
        F.coalesce("cut.kept", F.coalesce("text", F.lit("")).cast("binary")).alias("kept"),
    )
