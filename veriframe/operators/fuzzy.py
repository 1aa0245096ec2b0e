"""Fuzzy names: bit-parallel edit distance, complete candidate search by segments, similarity of names.

Two texts are close when their edit distance (adjacent swaps count one) is at most a quarter of the longer length, which
is a similarity of 0.75. Everything is column expressions and equi-joins over distinct texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe import config
from veriframe.functions.text import let
from veriframe.operators.ranking import top_k
from veriframe.session import cut_lineage

# --- fixed values ---------------------------------------------------------------
FILLER_LIKE = ["university", "университет"]
MIN_FILLER_LENGTH = 5
FILLER_EDITS = 2
MIN_LONG_WORD = 3

#: Letters of the shorter text that fit the bit vectors: two of them are added without leaving a signed 64-bit word.
BITS = 62
#: One edit in so many letters keeps two texts close.
LETTERS_PER_EDIT = 4


# --- distance --------------------------------------------------------------------


def _letters(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def letter_masks(text: Column) -> Column:
    """Map of each letter of a text of at most ``BITS`` letters to the bits of its places."""
    def masks(letters: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(letters) - 1)
        mask = lambda c: F.aggregate(places, F.lit(0).cast("long"), lambda m, i: F.when(
            F.get(letters, i) == c, m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))).otherwise(m))
        return F.map_from_entries(F.transform(F.array_distinct(letters), lambda c: F.struct(c, mask(c))))

    return let(_letters(text), masks)


def _bit_parallel(pattern: Column, text: Column) -> Column:
    """Columns of the distance table as bit vectors of vertical differences, one step per letter of ``text``.

    vp and vn mark where the column grows and falls; zero marks the places whose diagonal does not grow. A swap ends
    where this letter and the one before stand the other way round in the pattern.
    """
    one, size = F.lit(1).cast("long"), F.length(pattern)
    top, full = F.call_function("shiftleft", one, size - 1), F.call_function("shiftleft", one, size) - 1
    state = lambda vp, vn, zero, seen, d: F.struct(
        vp.alias("vp"), vn.alias("vn"), zero.alias("zero"), seen.alias("seen"), d.alias("d"))
    none = F.lit(0).cast("long")

    def step(s: Column, hit: Column) -> Column:
        swapped = F.shiftleft(F.bitwise_not(s["zero"]).bitwiseAND(hit), 1).bitwiseAND(s["seen"])
        carried = (hit.bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"])
        zeros = carried.bitwiseOR(hit).bitwiseOR(s["vn"]).bitwiseOR(swapped).bitwiseAND(full)

        def move(zero: Column) -> Column:
            up = s["vn"].bitwiseOR(F.bitwise_not(zero.bitwiseOR(s["vp"])).bitwiseAND(full))
            down = zero.bitwiseAND(s["vp"])
            d = s["d"] + F.when(up.bitwiseAND(top) != 0, 1).when(down.bitwiseAND(top) != 0, -1).otherwise(0)
            after = lambda row: state(
                F.shiftleft(down, 1).bitwiseOR(F.bitwise_not(zero.bitwiseOR(row))).bitwiseAND(full),
                row.bitwiseAND(zero), zero, hit, d)
            return let(F.shiftleft(up, 1).bitwiseOR(one).bitwiseAND(full), after)

        return let(zeros, move)

    def fold(masks: Column) -> Column:
        hits = F.transform(_letters(text), lambda c: F.coalesce(F.try_element_at(masks, c), none))
        return F.aggregate(hits, state(full, none, none, none, size), lambda s, hit: step(s, hit), lambda s: s["d"])

    return let(letter_masks(pattern), fold)


def _by_rows(a: Column, b: Column) -> Column:
    """The plain recurrence, a row per letter of ``a``: for texts that are both longer than the bit vectors."""
    def rows(x: Column, y: Column) -> Column:
        start = F.sequence(F.lit(0), F.size(y))
        init = F.struct(start.alias("before"), start.alias("last"), F.lit(0).alias("i"))

        def row(s: Column) -> Column:
            here = F.get(x, s["i"])

            def cell(out: Column, j: Column) -> Column:
                same = (here == F.get(y, j - 1)).cast("int")
                best = F.least(F.get(s["last"], j) + 1, F.get(out, j - 1) + 1, F.get(s["last"], j - 1) + 1 - same)
                swap = (s["i"] > 0) & (j > 1) & (here == F.get(y, j - 2)) & (F.get(x, s["i"] - 1) == F.get(y, j - 1))
                return F.concat(out, F.array(F.when(swap, F.least(best, F.get(s["before"], j - 2) + 1)).otherwise(best)))

            cells = F.aggregate(F.sequence(F.lit(1), F.size(y)), F.array(s["i"] + 1), cell)
            return F.struct(s["last"].alias("before"), cells.alias("last"), (s["i"] + 1).alias("i"))

        return F.aggregate(x, init, lambda s, _: row(s), lambda s: F.element_at(s["last"], -1))

    return let(F.struct(_letters(a).alias("x"), _letters(b).alias("y")), lambda p: rows(p["x"], p["y"]))


def osa_distance(a: Column, b: Column) -> Column:
    """Edit distance with adjacent swaps, each part touched once; null if either is null. No Python."""
    def distance(p: Column) -> Column:
        short, long = p["short"], p["long"]
        return F.when(short == "", F.length(long)).when(short == long, 0).when(
            F.length(short) <= BITS, _bit_parallel(short, long)).otherwise(_by_rows(short, long)).cast("long")

    pair = lambda x, y: F.struct(x.alias("short"), y.alias("long"))
    ordered = F.when(F.length(a) <= F.length(b), pair(a, b)).otherwise(pair(b, a))
    return F.when(a.isNotNull() & b.isNotNull(), let(ordered, distance))


def similarity(distance: Column, a: Column, b: Column) -> Column:
    return F.when((a == "") | (b == ""), 0.0).otherwise(1 - distance / F.greatest(F.length(a), F.length(b)))


# --- candidates -------------------------------------------------------------------


def _segments(texts: DataFrame, name: str) -> DataFrame:
    """(name, length, i, part): a text that may take k edits in k + 1 nearly equal segments."""
    size = F.length(name)
    cut = lambda i: F.floor(i * F.col("length") / (F.col("k") + 1)).cast("int")
    rows = texts.select(name, size.alias("length"), F.floor(size / LETTERS_PER_EDIT).cast("int").alias("k")).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i"))
    return rows.select(name, "length", "i", F.substring(F.col(name), cut(F.col("i")) + 1, cut(F.col("i") + 1) - cut(F.col("i"))).alias("part"))


def _probes(texts: DataFrame, name: str, longer: int) -> DataFrame:
    """(name, length, i, part): where a segment of a text of ``length`` letters may stand in this shorter one.

    Every edit is counted for one segment: that of its letter, or that left of the gap it fills or of the end it swaps
    across. Of k + 1 segments the first i with at most i edits counted up to it has none of its own, and i before it. So it
    stands whole, or with its first letter swapped to the left, where i edits before it and k - i after it can reach.
    """
    size = F.length(name)
    most = F.floor(size * LETTERS_PER_EDIT / (LETTERS_PER_EDIT - 1)).cast("int")
    rows = texts.select(name, size.alias("size"), F.explode(F.when(
        size + longer <= most, F.sequence(size + longer, most)).otherwise(F.array().cast("array<int>"))).alias("length"))
    rows = rows.withColumn("k", F.floor(F.col("length") / LETTERS_PER_EDIT).cast("int")).withColumn(
        "i", F.explode(F.sequence(F.lit(0), F.col("k"))))
    cut = lambda i: F.floor(i * F.col("length") / (F.col("k") + 1)).cast("int")
    grown, after = F.col("size") - F.col("length"), F.col("k") - F.col("i")
    rows = rows.select("*", cut(F.col("i")).alias("start"), (cut(F.col("i") + 1) - cut(F.col("i"))).alias("width"), F.explode(
        F.sequence(F.greatest(-F.col("i"), grown - after), F.least(F.col("i"), grown + after))).alias("shift"))
    rows = rows.withColumn("at", F.col("start") + F.col("shift")).where(
        (F.col("at") >= 0) & (F.col("at") + F.col("width") <= F.col("size")))
    own = F.substring(F.col(name), F.col("at") + 1, F.col("width"))
    swapped = F.concat(F.substring(F.col(name), F.col("at"), F.lit(1)), F.substring(F.col(name), F.col("at") + 2, F.col("width") - 1))
    # The swap is one of the i edits before and moves nothing.
    parts = F.array(own, F.when((F.col("at") > 0) & (F.abs("shift") < F.col("i")), swapped))
    return rows.select(name, "length", "i", F.explode(F.array_distinct(F.array_compact(parts))).alias("part"))


def near_candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b): all pairs of ``near_texts`` and some that are further apart, for callers with a test of their own.

    A text makes some hundred rows that no size estimate knows of: the texts are dealt to a fixed number of tasks, which
    adaptive execution leaves alone, and the keys meet in merge joins.
    """
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = left.where("a <> ''").select("a").distinct().repartition(tasks)
    b = right.where("b <> ''").select("b").distinct().repartition(tasks)
    on = ["length", "i", "part"]
    pairs = _probes(a, "a", 0).join(_segments(b, "b").hint("merge"), on).select("a", "b").unionByName(
        _probes(b, "b", 1).join(_segments(a, "a").hint("merge"), on).select("a", "b"))
    return pairs.distinct()


def near_texts(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, distance) of all pairs of a text of ``left`` (a) and of ``right`` (b) within a quarter of the longer length.

    Complete: the longer text of a pair is cut in segments, the shorter one is looked up by where they may stand. Empty
    texts are close to nothing.
    """
    pairs = near_candidates(left, right)
    reached = F.floor(F.greatest(F.length("a"), F.length("b")) / LETTERS_PER_EDIT)
    return pairs.withColumn("distance", osa_distance(F.col("a"), F.col("b"))).where(F.col("distance") <= reached)


# --- names --------------------------------------------------------------------------


def significant_words(text: Column) -> Column:
    """Drop misspelled filler words (at most two edits away); keep everything when nothing would remain."""
    def near_filler(word: Column) -> Column:
        tests = [(F.abs(F.length(word) - len(f)) <= FILLER_EDITS) & (osa_distance(F.lit(f), word) <= FILLER_EDITS) for f in FILLER_LIKE]
        return (F.length(word) >= MIN_FILLER_LENGTH) & (tests[0] | tests[1])

    return let(F.filter(F.split(text, " "), lambda w: w != ""), lambda words: let(
        F.filter(words, lambda w: ~near_filler(w)),
        lambda kept: F.when(F.size(kept) > 0, kept).otherwise(words)))


def _length_bound(asked: Column, named: Column) -> Column:
    """What the mean of the best word similarities can be at most, from lengths alone."""
    close = lambda w, n: 1 - F.abs(F.length(w) - F.length(n)) / F.greatest(F.length(w), F.length(n))
    best = F.transform(asked, lambda w: F.coalesce(F.array_max(F.transform(named, lambda n: close(w, n))), F.lit(0.0)))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(asked)


def fuzzy_matches(variants: DataFrame, names: DataFrame) -> DataFrame:
    """(variant, name, similarity) of all pairs with similarity 0.75 or more (``config.MIN_FUZZY``), none missing.

    The similarity is the better of that of the whole texts and the mean over the query's words of three or more letters
    of the best one in the name; misspelled filler words count nowhere. A mean of 0.75 needs one word that is close,
    so candidates share a close word or are close as a whole; lengths rule out more before any distance is taken.
    """
    asked = cut_lineage(variants.select("variant").distinct().select("variant", significant_words(F.col("variant")).alias("words")))
    named = cut_lineage(names.select("name").distinct().select("name", significant_words(F.col("name")).alias("words")))
    whole_a = asked.select("variant", F.array_join("words", " ").alias("a"))
    whole_b = named.select("name", F.array_join("words", " ").alias("b"))
    whole = near_texts(whole_a, whole_b).join(whole_a, "a").join(whole_b, "b").select(
        "variant", "name", similarity(F.col("distance"), F.col("a"), F.col("b")).alias("whole"))
    long = F.filter("words", lambda w: F.length(w) >= MIN_LONG_WORD)
    asked_words = asked.select("variant", F.posexplode(long).alias("i", "a"))
    name_words = named.select("name", F.explode(F.array_distinct("words")).alias("b"))
    close = near_texts(asked_words, name_words).select("a", "b")
    pairs = asked_words.select("variant", "a").distinct().join(close, "a").join(name_words, "b").select("variant", "name").distinct()
    rows = pairs.join(asked.select("variant", long.alias("asked")), "variant").join(named.withColumnRenamed("words", "named"), "name")
    rows = rows.where(_length_bound(F.col("asked"), F.col("named")) >= config.MIN_FUZZY - 1e-9)
    words = cut_lineage(rows.select("variant", "name", "named", F.posexplode("asked").alias("i", "a")).select(
        "variant", "name", "i", "a", F.explode(F.array_distinct("named")).alias("b")))
    # Distances once per distinct pair of words.
    table = words.select("a", "b").distinct().select("a", "b", similarity(osa_distance(F.col("a"), F.col("b")), F.col("a"), F.col("b")).alias("s"))
    mean = words.join(table, ["a", "b"]).groupBy("variant", "name", "i").agg(F.max("s").alias("s")).groupBy("variant", "name").agg(
        F.avg("s").alias("whole"))
    best = whole.unionByName(mean).groupBy("variant", "name").agg(F.round(F.max("whole"), 9).alias("similarity"))
    return best.where(F.col("similarity") >= config.MIN_FUZZY)


def suggestions(variants: DataFrame, terms: DataFrame, index: DataFrame, places: DataFrame,
                cap: int = config.CARDS_CAP) -> DataFrame:
    """For unresolved queries: close names first, then entities in a place the query names, by popularity.

    ``variants`` (norm, variant) of the unresolved queries; ``places`` (place_name, place_id) normalized;
    index rows carry ``place_id``.
    """
    close = fuzzy_matches(variants, terms)
    per_name = variants.join(close, "variant").groupBy("norm", "name").agg(F.max("similarity").alias("similarity"))
    short = top_k(terms.select("name", "qid").distinct().join(index.select("qid", "sitelinks"), "qid"), ["name"],
                  [F.desc("sitelinks"), F.col("qid")], cap, "_r").drop("_r")
    named = per_name.join(short, "name").select(
        "norm", "qid", F.lit(0).alias("src"), (-F.col("similarity")).alias("key"), "sitelinks")
    in_place = top_k(index.select("qid", "sitelinks", "place_id"), ["place_id"],
                     [F.desc("sitelinks"), F.col("qid")], cap, "_r").drop("_r")
    local = variants.join(places, F.col("variant") == F.col("place_name")).join(in_place, "place_id").select(
        "norm", "qid", F.lit(1).alias("src"), F.lit(0.0).alias("key"), "sitelinks")
    merged = named.unionByName(local).groupBy("norm", "qid", "sitelinks").agg(F.min(F.struct("src", "key")).alias("at"))
    return top_k(merged, ["norm"], [F.col("at"), F.desc("sitelinks"), F.col("qid")], cap, "place").select(
        "norm", "qid", "place", F.col("at.src").alias("src")
    )
