"""Generated sentences are kept only as far as they cite given sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriframe.functions.text import lead_quote
from veriframe.operators.ranking import top_k

MAX_SENTENCES = 5


def clean_sentence(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s*\[\d+(?:\s*,\s*\d+)*\]", ""))


def ground_sentences(sentences: DataFrame, sources: DataFrame, cap: int = MAX_SENTENCES) -> DataFrame:
    """(doc_id, pos, text, cited list) -> first ``cap`` sentences that cite at least one existing source.

    Citations are renumbered to the distinct existing ones in order; inline markers are stripped.
    """
    rows = sentences.select("doc_id", "pos", clean_sentence(F.col("text")).alias("text"), F.explode("cited").alias("n"))
    valid = rows.filter("text <> ''").join(sources.select("doc_id", "n").distinct(), ["doc_id", "n"], "left_semi")
    # One sentence cites a handful of sources.
    grouped = valid.groupBy("doc_id", "pos", "text").agg(F.array_sort(F.collect_set("n")).alias("cited"))
    return top_k(grouped, ["doc_id"], [F.col("pos")], cap, "place")


def ground_picks(picks: DataFrame, catalogue: DataFrame, cap: int = 5) -> DataFrame:
    """(request_id, pos, qid, reason): distinct known ids with a reason, in order, up to ``cap``."""
    known = picks.filter(F.trim(F.coalesce("reason", F.lit(""))) != "").withColumn("qid", F.trim("qid")).join(
        catalogue.select("qid").distinct(), "qid", "left_semi")
    first = known.groupBy("request_id", "qid").agg(
        F.min("pos").alias("pos"), F.min_by(F.substring(F.trim("reason"), 1, 200), "pos").alias("reason"))
    return top_k(first, ["request_id"], [F.col("pos")], cap, "place")


def quote_summaries(summaries: DataFrame, preferred: str = "ru") -> DataFrame:
    """(entity_id, lang, quote): the opening of the summary in the preferred language, else of the first one.

    Summaries (entity_id, lang, ord, extract); blank extracts don't count, an entity with no other has no row.
    """
    rows = summaries.filter(F.col("extract").rlike(r"\S"))
    order = F.struct((~F.col("lang").eqNullSafe(F.lit(preferred))).alias("other"), "ord", "lang")
    best = rows.groupBy("entity_id").agg(F.min_by(F.struct("lang", "extract"), order).alias("s"))
    return best.select("entity_id", "s.lang", lead_quote(F.col("s.extract")).alias("quote"))
