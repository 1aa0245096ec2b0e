"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed words."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from veriframe.llm.shared import hash_sample, limit_arrow_batches, text_bytes

DIMENSIONS = 1 << 16
#: Labelled documents that the fit takes, at most about.
FIT_ROWS = 8_000
#: Grades: 0 toxic, 1 neither toxic nor good, 2 good.
GRADES = 3
PREFIXES = range(3, 9)
#: A bucket counts by how far its signed-root likelihood ratio between grades lies above this noise level.
NOISE = 2.5
_EDGES = b".,;:!?|\"'()#%*$&"
_CACHE_WORDS = 1 << 18


def word_buckets(word: bytes) -> list[int]:
    """Buckets of a word: itself and its beginnings, hashed."""
    word = word.strip(_EDGES)
    starts = [b"^" + word[:n] for n in PREFIXES if len(word) > n]
    return [zlib.crc32(x) % DIMENSIONS for x in [word, *starts]] if word else []


class Features:
    """Sorted buckets of the distinct words of a text, optionally only those in ``active``; words are cached."""

    def __init__(self, active: np.ndarray | None = None):
        self.active, self.cache = active, {}

    def __call__(self, text: bytes) -> np.ndarray:
        found: set[int] = set()
        if len(self.cache) > _CACHE_WORDS:
            self.cache.clear()
        for word in set(text.lower().split()):
            buckets = self.cache.get(word)
            if buckets is None:
                buckets = word_buckets(word)
                if self.active is not None:
                    buckets = [b for b in buckets if self.active[b]]
                self.cache[word] = buckets
            if buckets:
                found.update(buckets)
        return np.array(sorted(found), np.int32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Ordinal:
    """P(grade > k) = sigmoid(sum of a text's bucket weights - t_k), with one weight vector and ordered thresholds t."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, at: np.ndarray) -> np.ndarray:
        return _sigmoid(self.weights[at].sum() - self.thresholds)


def bucket_scales(at: np.ndarray, row: np.ndarray, grades: np.ndarray) -> np.ndarray:
    """How strongly the presence of each bucket tells grades above a level from those below, less NOISE."""
    best = np.zeros(DIMENSIONS)
    for level in range(GRADES - 1):
        high = grades > level
        n = np.array([high.sum(), (~high).sum()], float)
        if n.min() == 0:
            continue
        k = np.stack([np.bincount(at, high[row], minlength=DIMENSIONS), np.bincount(at, ~high[row], minlength=DIMENSIONS)])
        gain = np.zeros(DIMENSIONS)
        for hits, total, rate in (*((k[i], n[i], k[i] / n[i]) for i in (0, 1)), (-k.sum(0), -n.sum(), k.sum(0) / n.sum())):
            rate = np.clip(rate, 1e-9, 1 - 1e-9)
            gain += hits * np.log(rate) + (total - hits) * np.log(1 - rate)
        best = np.maximum(best, np.sqrt(np.maximum(2 * gain, 0)))
    return np.maximum(best - NOISE, 0) / 5


def fit(rows: list[tuple[np.ndarray, int]], epochs: int = 60, rate: float = 0.1, decay: float = 2e-4) -> Ordinal:
    """Full-gradient Adagrad on the likelihood. Thresholds are a first value and positive gaps, so they stay ordered.

    Rare grades weigh as much as common ones in sum. Without rows all weights are zero.
    """
    grades, index = np.array([g for _, g in rows], np.int64), np.arange(len(rows))
    at = np.concatenate([np.zeros(0, np.int32), *(a for a, _ in rows)])
    row = np.repeat(index, [len(a) for a, _ in rows]) if rows else index
    scale = bucket_scales(at, row, grades)
    used = scale[at] > 0
    at, row = at[used], row[used]
    value, weights, squares = scale[at], np.zeros(DIMENSIONS), np.full(DIMENSIONS, 1e-8)
    shares = np.array([(np.sum(grades > k) + 1) / (len(grades) + 2) for k in range(GRADES - 1)])
    start = -np.log(shares / (1 - shares))
    free = np.concatenate(([start[0]], np.log(np.maximum(np.diff(start), 1e-3))))
    free_squares = np.full(len(free), 1e-8)
    balance = (len(grades) / (GRADES * np.maximum(np.bincount(grades, minlength=GRADES), 1)))[grades]
    for _ in range(epochs if rows else 0):
        thresholds = np.cumsum(np.concatenate(([free[0]], np.exp(free[1:]))))
        score = np.bincount(row, weights[at] * value, minlength=len(rows))
        edges = np.column_stack([np.ones(len(rows)), _sigmoid(score[:, None] - thresholds), np.zeros(len(rows))])
        over, under = edges[index, grades], edges[index, grades + 1]
        share = balance / np.maximum(over - under, 1e-9) / len(rows)
        slope_over, slope_under = over * (1 - over) * share, under * (1 - under) * share
        gradient = np.bincount(at, (slope_over - slope_under)[row] * value, minlength=DIMENSIONS) - decay * weights
        by_threshold = np.zeros(GRADES - 1)
        np.subtract.at(by_threshold, np.maximum(grades - 1, 0), np.where(grades > 0, slope_over, 0))
        np.add.at(by_threshold, np.minimum(grades, GRADES - 2), np.where(grades < GRADES - 1, slope_under, 0))
        by_free = np.cumsum(by_threshold[::-1])[::-1] * np.concatenate(([1.0], np.exp(free[1:])))
        squares += gradient**2
        free_squares += by_free**2
        weights += rate * gradient / np.sqrt(squares)
        free += 0.1 * by_free / np.sqrt(free_squares)
    return Ordinal(weights * scale, np.cumsum(np.concatenate(([free[0]], np.exp(free[1:])))))


def ratings(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): toxic if any row says so, else good if all rows with a quality do. Null ratings say nothing."""
    rated = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id").agg(
        F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"), F.min(F.coalesce("quality", F.lit(1))).alias("good"),
    )
    return rated.select("doc_id", F.when(F.col("toxic") >= 1, 0).when(F.col("good") >= 1, 2).otherwise(1).alias("grade"))


def is_held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> Ordinal:
    """Fit on about ``bound`` labelled documents outside the held-out fifth, chosen by hash of doc_id."""
    limit_arrow_batches(docs.sparkSession)
    rated = ratings(labels).where(~is_held_out())
    rated = hash_sample(rated, "doc_id", max(rated.count(), 1), bound)

    @F.pandas_udf("array<int>")
    def hashed(texts: pd.Series) -> pd.Series:
        buckets = Features()
        return pd.Series([buckets(t) for t in texts])

    rows = docs.select("doc_id", "text").join(F.broadcast(rated), "doc_id").select("doc_id", "grade", hashed(text_bytes()).alias("at"))
    table = rows.toArrow()
    found = [(i, g, np.asarray(a.values, np.int32)) for i, g, a in zip(table["doc_id"].to_pylist(), table["grade"].to_pylist(), table["at"])]
    return fit([(a, g) for _, g, a in sorted(found, key=lambda x: (x[0], x[2].tobytes()))])


def score(docs: DataFrame, model: Ordinal, least_tail: float = 0.5) -> DataFrame:
    """Rows (doc_id, held_out, expected_grade, tail_prob, keep), one per row of ``docs``.

    expected_grade is from 0 to GRADES - 1, tail_prob is the probability of more than the lowest grade (not toxic),
    keep says that it is at least ``least_tail``. Null and empty texts are judged by the thresholds alone.
    """
    limit_arrow_batches(docs.sparkSession)

    @F.pandas_udf("expected_grade double, tail_prob double")
    def judged(texts: pd.Series) -> pd.DataFrame:
        buckets = Features(model.weights != 0)
        tails = [model.tails(buckets(t)) for t in texts]
        return pd.DataFrame([(float(t.sum()), float(t[0])) for t in tails], columns=["expected_grade", "tail_prob"])

    rows = docs.select("doc_id", is_held_out().alias("held_out"), judged(text_bytes()).alias("j"))
    return rows.select("doc_id", "held_out", "j.expected_grade", "j.tail_prob", (F.col("j.tail_prob") >= least_tail).alias("keep"))


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
