"""Entry retrieval: typo-tolerant words over three fields, rated by BM25+, all words of a query or else any of them.

The vocabulary of the queries meets that of the index once; a word's rated entries serve every query that holds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriframe import config
from veriframe.functions.text import fold_text
from veriframe.operators.fuzzy import near_candidates
from veriframe.operators.ranking import top_k
from veriframe.session import cut_lineage, stored

# --- fixed values ---------------------------------------------------------------
FIELD_OF_KIND = {"label": "names", "alias": "aliases", "generated": "acronyms"}
FIELD_BOOST = {"names": 2.0, "aliases": 1.0, "acronyms": 1.5}
#: BM25+ as usual for short fields: saturation, length, floor.
SATURATION, LENGTH, FLOOR = 1.2, 0.7, 0.5
PREFIX_WEIGHT, PREFIX_FADE, FUZZY_WEIGHT = 0.375, 0.3, 0.45
MIN_FUZZY_WORD, FUZZY_SHARE, MAX_EDITS = 5, 0.2, 6
LINK_BOOST = 0.25
#: Entries whose words one task holds, about.
ENTRIES_PER_TASK = 50_000


def entry_words(terms: DataFrame, index: DataFrame) -> DataFrame:
    """(qid, found, links, tf_*, length_*): an entry's words, how often and among how many different ones in each field.

    Index terms (qid, text, kind) are folded once per distinct text, and all rows of an entry meet in one shuffle by qid, in
    tasks that become more with the entries. ``links`` is the entry's raise, null if the index lacks it.
    """
    # Stored: filters on the words would else go below the distinct, which folds every row.
    folded = stored(terms.select("text").distinct().select("text", F.split(fold_text(F.col("text")), " ").alias("words")), "folded")
    tasks = max(int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions")), index.count() // ENTRIES_PER_TASK + 1)
    words = terms.where(F.col("kind").isin(list(FIELD_OF_KIND))).join(folded, "text").select("qid", "kind", F.explode("words").alias("found"))
    counted = words.where("found <> ''").repartition(tasks, "qid").groupBy("qid", "found").agg(
        *[F.count(F.when(F.col("kind") == kind, 1)).alias(f"tf_{field}") for kind, field in FIELD_OF_KIND.items()])
    raised = 1 + LINK_BOOST * F.log10(1 + F.coalesce("sitelinks", F.lit(0)))
    links = index.select("qid", raised.alias("links")).repartition(tasks, "qid").groupBy("qid").agg(F.sum("links").alias("links"))
    own = Window.partitionBy("qid")
    return counted.join(links.hint("merge"), "qid", "left").select(
        "*", *[F.count(F.when(F.col(f"tf_{field}") > 0, 1)).over(own).alias(f"length_{field}") for field in FIELD_BOOST])


def _vocabulary(words: DataFrame) -> DataFrame:
    """(found, holding_*): how many entries hold a word in each field."""
    return words.groupBy("found").agg(
        *[F.count(F.when(F.col(f"tf_{field}") > 0, 1)).alias(f"holding_{field}") for field in FIELD_BOOST])


def word_weights(asked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, found, weight): the words of the index (found) that stand for a query word, the better the higher.

    Equal words; from four letters longer words that begin with it; from five letters words within a fifth of its
    length in plain edits, six at most.
    """
    w, n = F.col("word"), F.col("found")
    asked, vocabulary = asked.select("word").distinct(), vocabulary.select(F.col("word").alias("found")).distinct()
    equal = asked.join(vocabulary, w == n).select("word", "found", F.lit(1.0).alias("weight"))
    starts = vocabulary.where(F.length("found") > config.MIN_PREFIX_WORD).select("found", F.explode(F.transform(
        F.sequence(F.lit(config.MIN_PREFIX_WORD), F.length("found") - 1), lambda i: F.substring("found", F.lit(1), i))).alias("word"))
    longer = F.length("found") / (F.length("found") + PREFIX_FADE * (F.length("found") - F.length("word")))
    begun = asked.join(starts, "word").select("word", "found", (PREFIX_WEIGHT * longer).alias("weight"))
    edits = F.least(F.floor(F.length("word") * FUZZY_SHARE + 0.5), F.lit(MAX_EDITS))
    near = near_candidates(asked.where(F.length("word") >= MIN_FUZZY_WORD).select(F.col("word").alias("a")),
                           vocabulary.select(F.col("found").alias("b"))).select(F.col("a").alias("word"), F.col("b").alias("found"))
    near = near.withColumn("d", F.levenshtein("word", "found")).where((F.col("d") > 0) & (F.col("d") <= edits) & ~n.startswith(w))
    typed = near.select("word", "found", (FUZZY_WEIGHT * F.length("found") / (F.length("found") + F.col("d"))).alias("weight"))
    return equal.unionByName(begun).unionByName(typed)


def _relevance(tf: Column, holding: Column, entries: Column, length: Column, mean: Column) -> Column:
    rare = F.log(1 + (entries - holding + 0.5) / (holding + 0.5))
    return rare * (FLOOR + tf * (SATURATION + 1) / (tf + SATURATION * (1 - LENGTH + LENGTH * length / mean)))


def _rated(words: DataFrame, holding: DataFrame, vocabulary: DataFrame, entries: int) -> DataFrame:
    """The words of entries that ``holding`` names, with its columns, qid and value."""
    totals = vocabulary.agg(*[F.sum(f"holding_{field}").alias(field) for field in FIELD_BOOST]).first()
    value = F.lit(0.0)
    for field, boost in FIELD_BOOST.items():
        tf, held, length = (F.col(f"{c}_{field}") for c in ("tf", "holding", "length"))
        mean = (totals[field] or 1) / max(entries, 1)
        value = value + F.when(tf > 0, F.lit(boost) * F.col("links") * _relevance(tf, held, F.lit(entries), length, F.lit(mean))).otherwise(0.0)
    rows = words.where("links IS NOT NULL").join(holding, "found")
    return rows.select(*[c for c in holding.columns if not c.startswith("holding_")], "qid", value.alias("value"))


def rated_entries(terms: DataFrame, index: DataFrame) -> DataFrame:
    """(found, qid, value): relevance of an entry for each of its words over its fields, raised by its links."""
    words = cut_lineage(entry_words(terms, index))
    vocabulary = stored(_vocabulary(words), "vocabulary")
    return _rated(words, vocabulary, vocabulary, index.count())


def _sign(word: Column) -> Column:
    """One of 64 bits."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(word), F.lit(64)).cast("int"))


def _started(costs: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(v, total, word) with a variant's rarest word, and (v, total, qid, s) with the entries that hold it.

    ``held`` are an entry's words' signs. An entry without the sign of a word doesn't hold it, so only the others are looked
    up word by word: nearly all of them hold all words.
    """
    first = costs.groupBy("v", "total").agg(F.min(F.struct("cost", "word")).alias("r"), F.bit_or(_sign(F.col("word"))).alias("needed")).select(
        "v", "total", F.col("r.word").alias("word"), "needed")
    started = first.join(held, "word").where(F.col("needed").bitwiseAND(F.col("held")) == F.col("needed"))
    return first.drop("needed"), started.select("v", "total", "qid", "s")


def search(variants: DataFrame, terms: DataFrame, index: DataFrame, k: int = config.RETRIEVAL_POOL) -> DataFrame:
    """(norm, qid, score, rank): the retrieval pool of every query.

    ``variants`` (norm, variant), ``terms`` (qid, text, kind). A variant finds the entries that hold all its words; only
    where there is none, those that hold any. An entry scores the sum over the words, times the number of words it holds;
    the best variant counts. Entries with all words are looked for through the variant's rarest word. For any word, the
    most common one gives its k best entries only: an entry below these can come in by another word alone.
    """
    texts = variants.select("variant").distinct().select(
        F.monotonically_increasing_id().alias("v"), "variant", F.array_distinct(F.split("variant", " ")).alias("words"))
    texts = cut_lineage(texts)  # fixes the numbers
    asked = texts.select("v", F.size("words").alias("total"), F.explode("words").alias("word"))
    words, entries = cut_lineage(entry_words(terms, index)), index.count()
    vocabulary = stored(_vocabulary(words), "vocabulary")
    weights = stored(word_weights(asked, vocabulary.select(F.col("found").alias("word"))).join(vocabulary, "found"), "weights")
    tasks = max(int(terms.sparkSession.conf.get("spark.sql.shuffle.partitions")), entries // ENTRIES_PER_TASK + 1)
    scored = _rated(words, weights, vocabulary, entries).repartition(tasks, "qid").groupBy("word", "qid").agg(F.sum(F.col("weight") * F.col("value")).alias("s"))
    scored = cut_lineage(scored.withColumn("held", F.bit_or(_sign(F.col("word"))).over(Window.partitionBy("qid"))))
    held, scored = scored, scored.drop("held")
    cost = scored.groupBy("word").agg(F.count(F.lit(1)).alias("cost"))
    costs = cut_lineage(asked.join(cost, "word", "left").na.fill(0, ["cost"]))

    first, started = _started(costs, held)
    others = costs.select("v", "word").join(first.select("v", "word"), ["v", "word"], "left_anti")
    # Ids first: rows sort by the beginning of the first key, and words share theirs.
    more = started.where("total > 1").withColumnRenamed("s", "s0").join(others, "v").join(scored, ["qid", "word"])
    several = more.groupBy("v", "total", "qid").agg((F.sum("s") + F.first("s0")).alias("s"), (F.count(F.lit(1)) + 1).alias("n"))
    whole = cut_lineage(started.where("total = 1").select("v", "total", "qid", "s", F.lit(1).cast("bigint").alias("n")).unionByName(
        several.where("n = total")))
    rest = costs.join(whole.select("v").distinct(), "v", "left_anti").where("cost > 0 AND total > 1")
    common = rest.groupBy("v").agg(F.max(F.struct("cost", "word")).alias("r")).select("v", F.col("r.word").alias("word"))
    essential = rest.join(common, ["v", "word"], "left_anti").join(scored, "word").select("v", "total", "word", "qid", "s")
    best = top_k(scored.join(common.select("word").distinct(), "word", "left_semi"), ["word"], [F.desc(F.round("s", 6)), F.col("qid")], k, "_r")
    # What the other words find, with the most common one's share where it holds the entry as well, and its own best entries.
    found = essential.groupBy("v", "qid").agg(F.sum("s").alias("s"), F.count(F.lit(1)).alias("n"))
    shared = found.join(common, "v").join(scored.withColumnRenamed("s", "more"), ["qid", "word"], "left").select(
        "v", "qid", (F.col("s") + F.coalesce("more", F.lit(0.0))).alias("s"), (F.col("n") + F.col("more").isNotNull().cast("int")).alias("n"))
    leading = common.join(best, "word").select("v", "qid", "s", F.lit(1).cast("bigint").alias("n"))
    hits = whole.select("v", "qid", "s", "n").unionByName(shared).unionByName(leading).select(
        "v", "qid", F.round(F.col("s") * F.col("n"), 6).alias("score"))
    # An entry that k others beat in a variant is beaten in the query as well. Up to k of the leading rows stand here a second
    # time, with less: by the common word alone.
    hits = top_k(hits, ["v"], [F.desc("score"), F.col("qid")], 2 * k, "_r").drop("_r")
    per_norm = variants.join(texts.select("v", "variant"), "variant").join(hits, "v").groupBy("norm", "qid").agg(F.max("score").alias("score"))
    return top_k(per_norm, ["norm"], [F.desc("score"), F.col("qid")], k)
