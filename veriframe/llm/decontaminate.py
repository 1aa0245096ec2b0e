"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted verification.

DataFrame operations only. Windows begin where a shared shingle puts an item's start; their prints meet the items' prints in
Hamming blocks; around every window found, the passage with the best exact similarity is cut out by running sums.
"""

from __future__ import annotations

from itertools import combinations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from veriframe.session import cut_lineage

SHINGLE = 5
BLOCKS = 4
BLOCK_BITS = 64 // BLOCKS
FLIPS = 3
#: Two prints that differ in at most this many bits agree on some block within FLIPS bits.
RADIUS = BLOCKS * (FLIPS + 1) - 1
#: Window sizes by the item's length: a passage of 0.8 similarity has between 0.8 and 1.25 of its letters.
SIZES = (0.8, 1.0, 1.25)
#: Item shingles up to which they are broadcast; more of them meet the documents' shingles in a shuffle.
MOST_BROADCAST = 200_000


def words(text: Column) -> Column:
    """Lower-cased runs of characters other than ASCII white space, controls and punctuation (null: none)."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-/:-@\[-`{-\x7F]+"), "")


def shingles(word_pairs: str, size: int = SHINGLE) -> Column:
    """Elements of an array of word hashes to its shingles, as longs whose low byte is the shingle's weight.

    A word hash carries the letters of its word in its low byte. The weight of a shingle is the number of its letters
    (at most 255): a run of long words says more than a run of short ones.
    """
    starts = F.sequence(F.lit(0), F.size(word_pairs) - size)

    def one(i: Column) -> Column:
        parts = [F.get(word_pairs, i + k) for k in range(size)]
        letters = sum((p.bitwiseAND(F.lit(255)) for p in parts[1:]), parts[0].bitwiseAND(F.lit(255)))
        return F.xxhash64(*parts).bitwiseAND(F.lit(~255)).bitwiseOR(F.least(letters, F.lit(255)))

    return F.when(F.size(word_pairs) >= size, F.transform(starts, one)).otherwise(F.expr("array()").cast("array<bigint>"))


def placed_shingles(rows: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Adds pos and shingle (a hash) for every shingle of ``hashes``; positions are exploded, so hashing is compiled."""
    starts = F.when(F.size("hashes") >= size, F.sequence(F.lit(0), F.size("hashes") - size))
    parts = [F.get("hashes", F.col("pos") + k) for k in range(size)]
    return rows.select("*", F.explode(starts).alias("pos")).withColumn("shingle", F.xxhash64(*parts))


def hashed_words(words_column: str) -> Column:
    return F.transform(
        words_column,
        lambda w: F.xxhash64(w).bitwiseAND(F.lit(~255)).bitwiseOR(F.least(F.length(w), F.lit(255)).cast("bigint")),
    )


def simhash(hashes: str) -> Column:
    """64-bit SimHash of the words of a window: a bit is set if over half of its word hashes set it."""
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"),
        lambda acc, bit: acc.bitwiseOR(F.when(
            F.aggregate(
                hashes, F.lit(0),
                lambda n, h: n + F.call_function("shiftright", F.xxhash64(h), bit).bitwiseAND(F.lit(1)).cast("int"),
            ) * 2 > F.size(hashes),
            F.call_function("shiftleft", F.lit(1).cast("bigint"), bit),
        ).otherwise(F.lit(0).cast("bigint"))),
    )


def block_values(print_column: str) -> Column:
    mask = F.lit((1 << BLOCK_BITS) - 1)
    parts = [F.shiftrightunsigned(print_column, BLOCK_BITS * b).bitwiseAND(mask).cast("int") for b in range(BLOCKS)]
    return F.array(*parts)


def flip_masks() -> list[int]:
    return [sum(1 << i for i in c) for n in range(FLIPS + 1) for c in combinations(range(BLOCK_BITS), n)]


def item_classes(benchmark: DataFrame) -> DataFrame:
    """Items by equal words: (item_id: the smallest, item_copies, hashes, length). Items without a word go."""
    items = benchmark.where("item_id is not null").select("item_id", words(F.col("text")).alias("w"))
    classes = items.where(F.size("w") > 0).groupBy("w").agg(
        F.min("item_id").alias("item_id"), F.count("*").alias("item_copies"),
    )
    return classes.select("item_id", "item_copies", hashed_words("w").alias("hashes"), F.size("w").alias("length"))


def _weight(column: Column) -> Column:
    return F.aggregate(column, F.lit(0).cast("bigint"), lambda n, s: n + s.bitwiseAND(F.lit(255)))


def contexts(docs: DataFrame, items: DataFrame, missing: float = 0.2) -> DataFrame:
    """(key, start, length, from, hashes): places where an item of ``length`` words may begin, with the words around.

    A place is where a shared shingle puts the item's start, or, for a passage that lacks up to ``missing`` of the item's
    beginning, the shared shingle itself. Without a shared shingle the similarity is zero. hashes are the words from a
    quarter of the length before the place to one and a half lengths behind it.
    """
    placed = placed_shingles(items.select("length", "hashes"))
    placed = cut_lineage(placed.select("shingle", F.col("pos").alias("offset"), "length").distinct())
    hashed = docs.select("key", words(F.col("text")).alias("w")).select("key", hashed_words("w").alias("hashes"))
    rows = placed_shingles(hashed)
    whole = F.greatest(F.col("pos") - F.col("offset"), F.lit(0))
    cut = F.when((F.col("offset") > 0) & (F.col("offset") <= F.col("length") * missing), F.col("pos"))
    start = F.explode(F.array_compact(F.array(whole, cut))).alias("start")
    first = F.greatest(F.col("start") - F.ceil(F.col("length") / 4).cast("int"), F.lit(0)).alias("from")
    around = F.slice("hashes", F.col("from") + 1, F.col("start") - F.col("from") + F.ceil(F.col("length") * 1.5).cast("int"))
    if placed.count() <= MOST_BROADCAST:
        # The word hashes ride along only within the stage: rows are written after the join has kept those that match.
        found = rows.join(F.broadcast(placed), "shingle").select("key", "length", "hashes", start)
        return found.select("*", first).select("key", "start", "length", "from", around.alias("hashes")).distinct()
    found = rows.select("key", "pos", "shingle").join(placed, "shingle").select("key", "length", start).distinct()
    return found.join(hashed, "key").select("*", first).select("key", "start", "length", "from", around.alias("hashes")).distinct()


def close_prints(places: DataFrame, items: DataFrame) -> DataFrame:
    """(key, item_id, hamming, start, from, hashes): places with a window whose print is within RADIUS of an item's.

    Windows of each of ``SIZES`` begin at the place. Blocks of the prints are looked up with up to FLIPS bits changed, so
    no print within the radius is missed. Equal windows are looked up once. The items' 2,788 keys each ask for a merge join:
    Spark takes them for as large as the items and would send all of them to the driver.
    """
    sizes = F.explode(F.array(*[F.ceil(F.col("length") * s).cast("int") for s in SIZES])).alias("size")
    windows = cut_lineage(places.select("*", sizes).withColumn("window", F.slice("hashes", F.col("start") - F.col("from") + 1, F.col("size"))))
    texts = windows.select("length", "window").distinct().withColumn("fp", simhash("window"))
    block = F.posexplode(block_values("fp")).alias("block", "value")
    probes = items.select("item_id", "length", F.col("fp").alias("item_fp"), block)
    flips = F.explode(F.array(*[F.lit(m) for m in flip_masks()]))
    probes = probes.withColumn("flip", flips).withColumn("value", F.col("value").bitwiseXOR(F.col("flip"))).drop("flip")
    differing = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    close = texts.select("length", "window", "fp", block).join(probes.hint("merge"), ["length", "block", "value"]).where(
        differing <= RADIUS).groupBy("length", "window", "item_id").agg(F.min(differing).alias("hamming"))
    found = windows.join(close, ["length", "window"])
    # Neighbouring places see the same words: the one with the closest print stands for those within an item's length.
    near = found.groupBy("key", "item_id", F.floor(F.col("start") / F.col("length"))).agg(
        F.min(F.struct("hamming", "start", "from", "hashes")).alias("p"))
    return near.select("key", "item_id", "p.hamming", "p.start", "p.from", "p.hashes")


def _cut(rows: DataFrame, rate: Column) -> DataFrame:
    """(cand, first, last, similarity): the run of shingles with the highest sum, and its exact similarity.

    Shared letters count as they are and others ``rate`` times against the run, so at a rate the best run is a similar
    enough one if there is any. Sums run along the shingles; a repeated shingle counts once.
    """
    along = Window.partitionBy("cand").orderBy("pos")
    gain = F.when(F.col("before").isNotNull(), 0.0).when(F.col("shared"), F.col("letters").cast("double")).otherwise(-rate * F.col("letters"))
    sums = rows.withColumn("gain", gain).withColumn("sum", F.sum("gain").over(along))
    low = F.min(F.struct((F.col("sum") - F.col("gain")).alias("low"), F.col("pos").alias("first"))).over(along)
    ends = sums.withColumn("low", low).groupBy("cand").agg(F.max(F.struct(
        (F.col("sum") - F.col("low.low")).alias("gain"), (-F.col("pos")).alias("last"), F.col("low.first").alias("first"))).alias("r"))
    runs = ends.select("cand", "r.first", (-F.col("r.last")).alias("last"))
    inside = rows.drop("rate").join(runs, "cand").where((F.col("pos") >= F.col("first")) & (F.col("pos") <= F.col("last")) & (F.coalesce("before", F.lit(-1)) < F.col("first")))
    shared = F.sum(F.when(F.col("shared"), F.col("letters")).otherwise(0))
    return inside.groupBy("cand", "first", "last").agg((shared / (F.sum("letters") + F.first("weight") - shared)).alias("similarity"))


def best_runs(close: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """(key, item_id, start_word, n_words, similarity, hamming): the best passage around each place, if it reaches ``threshold``.

    The first cut asks for the threshold, two more for the similarity found: each raises it, as in a ratio's ascent.
    """
    close = close.withColumn("cand", F.monotonically_increasing_id())
    close = cut_lineage(close)
    rows = placed_shingles(close.select("cand", "item_id", "from", "hashes"))
    letters = [F.get("hashes", F.col("pos") + k).bitwiseAND(F.lit(255)) for k in range(SHINGLE)]
    rows = rows.select("cand", "item_id", "pos", "shingle", F.least(sum(letters[1:], letters[0]), F.lit(255)).alias("letters"))
    own = placed_shingles(items.select("item_id", "hashes", "weight")).select("item_id", "shingle", F.lit(True).alias("shared")).distinct()
    same = Window.partitionBy("cand", "shingle").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(own, ["item_id", "shingle"], "left").join(items.select("item_id", "weight"), "item_id").select(
        "cand", "pos", "letters", "weight", F.coalesce("shared", F.lit(False)).alias("shared"), F.max("pos").over(same).alias("before"))
    rows = cut_lineage(rows)
    best = _cut(rows, F.lit(threshold))
    for _ in range(2):
        best = cut_lineage(best.where(F.col("similarity") >= threshold * 0.9))
        again = _cut(rows.join(best.select("cand", F.col("similarity").alias("rate")), "cand"), F.col("rate"))
        both = best.unionByName(again)
        best = both.groupBy("cand").agg(F.max(F.struct(
            "similarity", (-F.col("first")).alias("f"), (-F.col("last")).alias("l"))).alias("r")).select(
            "cand", (-F.col("r.f")).alias("first"), (-F.col("r.l")).alias("last"), "r.similarity")
    reached = best.where(F.col("similarity") >= threshold)
    return reached.join(close.select("cand", "key", "item_id", "from", "hamming"), "cand").select(
        "key", "item_id", (F.col("from") + F.col("first")).alias("start_word"),
        (F.col("last") - F.col("first") + SHINGLE).alias("n_words"), "similarity", "hamming")


def short_passages(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows as of ``best_runs`` for items of under five words: the places where their words stand in a row."""
    phrases = items.where(F.col("length") < SHINGLE)
    lengths = [r["length"] for r in phrases.select("length").distinct().collect()]  # four at most
    hashed = docs.select("key", words(F.col("text")).alias("w")).select("key", hashed_words("w").alias("hashes"))
    found = None
    for n in lengths:
        asked = placed_shingles(phrases.where(F.col("length") == n).select("item_id", "hashes"), n).select("item_id", "shingle")
        part = placed_shingles(hashed, n).select("key", "pos", "shingle").join(asked, "shingle").groupBy("key", "item_id").agg(
            F.min("pos").alias("start_word")).select("key", "item_id", "start_word", F.lit(n).alias("n_words"), F.lit(1.0).alias("similarity"), F.lit(0).alias("hamming"))
        found = part if found is None else found.unionByName(part)
    return found


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_key", F.xxhash64("doc_id", "text"))


def _found(docs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """(key, item_id, m): the best passage of every text (by key) and item."""
    keyed = docs.select(F.col("_key").alias("key"), "text")
    long = items.where(F.col("length") >= SHINGLE)
    found = best_runs(close_prints(contexts(keyed, long), long), long, threshold)
    short = short_passages(keyed, items)
    found = found if short is None else found.unionByName(short)
    return found.groupBy("key", "item_id").agg(F.max(F.struct(
        "similarity", (-F.col("start_word")).alias("before"), (-F.col("n_words")).alias("less"), (-F.col("hamming")).alias("far"))).alias("m"))


def _items(benchmark: DataFrame) -> DataFrame:
    items = item_classes(benchmark).withColumn("fp", simhash("hashes"))
    return cut_lineage(items.withColumn("weight", _weight(F.array_distinct(shingles("hashes")))))


def passages(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Rows (doc_id, item_id, item_copies, start_word, n_words, similarity, hamming): the best passage of each document and item.

    A passage is found through a window whose SimHash is within RADIUS bits of the item's, which the Hamming blocks find
    without loss; it is kept if its weighted shingle similarity (letters of shared five-word shingles over letters of
    all) is at least ``threshold``. Of equally similar passages the first counts, then the shortest. Case, punctuation
    and spacing don't matter. Items of under five words are matched as phrases, similarity 1. Null and empty texts match
    nothing; equal items appear under the smallest item_id, with their number; items without item_id are left out. A
    null doc_id is reported as null, and the rows of a repeated doc_id as one document.
    """
    items, keyed = _items(benchmark), _keyed(docs)
    best = _found(keyed, items, threshold)
    ids = keyed.select(F.col("_key").alias("key"), "doc_id").join(best.select("key").distinct(), "key", "left_semi").distinct()
    named = best.join(ids, "key").groupBy("doc_id", "item_id").agg(F.max("m").alias("m"))
    return named.join(items.select("item_id", "item_copies"), "item_id").select(
        "doc_id", "item_id", "item_copies", (-F.col("m.before")).cast("long").alias("start_word"), (-F.col("m.less")).cast("int").alias("n_words"),
        "m.similarity", (-F.col("m.far")).cast("int").alias("hamming"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Documents without a passage of the benchmark. Items of under five words take no document: they are common phrases."""
    keyed = _keyed(docs)
    items = _items(benchmark).where(F.col("length") >= SHINGLE)
    found = _found(keyed, items, threshold).select(F.col("key").alias("_key")).distinct()
    return keyed.join(found, "_key", "left_anti").select(docs.columns)
