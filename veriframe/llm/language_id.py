"""Language identification by rank-order profiles of character n-grams and the out-of-place distance."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from veriframe.llm.shared import hash_sample, limit_arrow_batches

ORDERS = (1, 2, 3)
PROFILE = 400
#: Documents that each language's profile is learned from, at most about.
DOCS_PER_LANGUAGE = 2_000
UNKNOWN = "und"
_BITS = 21  # a code point
_EDGE = 1  # stands for what separates words


def _letter_codes() -> np.ndarray:
    """Code point to its lower-case letter's code point, others to zero."""
    table = np.zeros(0x110000, np.int64)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


_TABLE: list[np.ndarray] = []


def letters(text: str) -> np.ndarray:
    """Letters in lower case with single edge codes between words and at both ends; empty if there is no letter."""
    if not _TABLE:
        _TABLE.append(_letter_codes())
    codes = _TABLE[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    codes = np.concatenate(([0], codes, [0]))
    if not codes.any():
        return codes[:0]
    kept = codes[(codes > 0) | np.concatenate(([True], codes[:-1] > 0))]
    return np.where(kept > 0, kept, _EDGE)


def count_ngrams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams and their counts. An n-gram may begin or end with a word's edge, but not span two words."""
    grams = []
    for n in ORDERS:
        packed, whole = np.zeros(max(len(codes) - n + 1, 0), np.int64), None
        for k in range(n):
            part = codes[k : len(codes) - n + 1 + k]
            packed = (packed << _BITS) | part
            if n == 1 or 0 < k < n - 1:
                whole = part > _EDGE if whole is None else whole & (part > _EDGE)
        grams.append(packed if whole is None else packed[whole])
    return np.unique(np.concatenate(grams), return_counts=True)


def ranked(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams in order, ties by the smaller code."""
    return grams[np.lexsort((grams, -counts))[:size]]


def is_held_out(column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE, size: int = PROFILE) -> dict[str, np.ndarray]:
    """Profiles {language: n-grams in order of rank} from rows that aren't held out and have a language.

    Each language's documents are sampled by hash of doc_id down to about ``per_language``; counting is done by
    Spark, and only ``size`` n-grams per language, a number each, reach the driver and the tasks.
    """
    limit_arrow_batches(docs.sparkSession)
    labelled = docs.where(~is_held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    totals = labelled.groupBy("lang").agg(F.count("*").alias("_total"))
    # One row per language: far less than its profile, which every task holds anyway. So texts are not shuffled by language.
    sample = hash_sample(labelled.join(F.broadcast(totals), "lang"), "doc_id", F.col("_total"), per_language).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                codes = letters(text)
                if len(codes):
                    sums.setdefault(lang, Counter()).update(dict(zip(*(x.tolist() for x in count_ngrams(codes)))))
        for lang, grams in sums.items():
            yield pd.DataFrame({"lang": lang, "gram": list(grams), "n": list(grams.values())})

    counts = sample.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    profiles: dict[str, list] = {}
    for r in top.orderBy("lang", "rank").collect():
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return {lang: np.array(grams, np.int64) for lang, grams in profiles.items()}


class Classifier:
    """Out-of-place distances to all profiles at once."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE):
        self.languages, self.size = sorted(profiles), size
        self.grams = np.unique(np.concatenate([np.zeros(0, np.int64), *profiles.values()]))
        # The last row serves n-grams that no profile has: out of place by the most everywhere.
        self.ranks = np.full((len(self.grams) + 1, len(self.languages)), size, np.int64)
        for j, lang in enumerate(self.languages):
            self.ranks[np.searchsorted(self.grams, profiles[lang]), j] = np.arange(len(profiles[lang]))

    def classify(self, text: str | None) -> tuple[str, float]:
        """(language, score): the score is one less the distance as a share of the worst one; ties by name."""
        codes = letters(text or "")
        if not len(codes) or not self.languages:
            return UNKNOWN, 0.0
        top = ranked(*count_ngrams(codes), self.size)
        at = np.searchsorted(self.grams, top)
        at[at == len(self.grams)] = 0
        at = np.where(self.grams[at] == top, at, len(self.grams)) if len(self.grams) else np.zeros(len(top), np.int64)
        rows = self.ranks[at]
        away = np.where(rows < self.size, np.abs(rows - np.arange(len(top))[:, None]), self.size).sum(axis=0)
        best = int(away.argmin())
        return self.languages[best], float(1 - away[best] / (self.size * len(top)))


def predict(docs: DataFrame, profiles: dict[str, np.ndarray]) -> DataFrame:
    """Adds lang_pred and score; both come from the whole text alone."""
    limit_arrow_batches(docs.sparkSession)
    model = Classifier(profiles)

    @F.pandas_udf("lang_pred string, score double")
    def classified(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.classify(t) for t in texts], columns=["lang_pred", "score"])

    return docs.withColumn("_l", classified(F.coalesce("text", F.lit("")))).select("*", "_l.lang_pred", "_l.score").drop("_l")


def identify(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score), one per row; a text that is null or has no letter is ``und``.

    Without any labelled row everything is ``und``. A null doc_id counts as not held out.
    """
    rows = docs.select("doc_id", "text")
    return predict(rows, train(docs)).select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least_score: float = 0.05) -> DataFrame:
    """Documents whose language is recognised: not ``und`` and at least ``least_score`` away from the worst distance."""
    profiles = train(docs)
    rows = predict(docs.withColumn("_row", F.struct(*docs.columns)).select("_row", "text"), profiles)
    return rows.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)).select("_row.*")
