"""Exact top-k inner-product search by MaxScore over shards of integer vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from veriframe.llm.shared import limit_arrow_batches
from veriframe.session import cut_lineage

#: Vectors in a shard and queries in a block, about (dealt by hash).
SHARD, QUERY_BLOCK = 8192, 256
STEP = 8  # terms that are probed at once


def shard_topk(ids: np.ndarray, rows: np.ndarray, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k best (score, id) of one shard by MaxScore, without the query's own id; ties to the smaller id.

    A term's postings are the shard's values of one dimension, its bound the highest product there. The first rows set
    the threshold. Terms whose bounds together can't lift a row over it are non-essential: only rows that the essential
    terms leave within reach are probed further, a few terms at a time.
    """
    products = np.stack([query * rows.min(axis=0), query * rows.max(axis=0)])
    low, high = products.min(axis=0), products.max(axis=0)
    others = np.flatnonzero(ids != query_id)
    head, rest = others[: 16 * k], others[16 * k :]
    scores = rows[head] @ query
    top = np.lexsort((ids[head], -scores))[:k]
    best_ids, best = ids[head][top], scores[top]
    if len(rest):
        threshold = best[-1] if len(best) == k else -np.inf
        order = np.argsort(-(high - low), kind="stable")
        # Non-essential: the longest tail of terms that, at its best, leaves a row of least essential score below.
        reach = low.sum() + np.cumsum((high - low)[order][::-1])[::-1]
        essential = max(int(np.searchsorted(-reach, -threshold, side="right")), 1)
        partial, at = rows[rest][:, order[:essential]] @ query[order[:essential]], essential
        while True:
            alive = partial + high[order[at:]].sum() >= threshold
            rest, partial = rest[alive], partial[alive]
            if at == len(order) or not len(rest):
                break
            terms = order[at : at + STEP]
            partial, at = partial + rows[np.ix_(rest, terms)] @ query[terms], at + len(terms)
        best_ids, best = np.concatenate([best_ids, ids[rest]]), np.concatenate([best, partial])
        top = np.lexsort((best_ids, -best))[:k]
        best_ids, best = best_ids[top], best[top]
    return [(int(s), int(i)) for s, i in zip(best, best_ids)]


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v) with floor(1024 * x); vectors that are null or hold null or non-finite values are left out.

    One vector per vec_id: of several the smallest, so repeated rows count once. Rows without vec_id are left out.
    """
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(F.forall("embedding", finite))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1024).cast("long"))
    return usable.select("vec_id", whole.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k highest inner products of each query among all other vectors.

    Vectors are dealt to shards and queries to blocks by hash; each block visits each shard, and the shards' results
    are merged. Vectors of different lengths are compared over the longer one with zeros.
    """
    spark = vectors.sparkSession
    limit_arrow_batches(spark)
    vectors, queries = cut_lineage(vectors), cut_lineage(queries)
    n, dims, most = vectors.agg(F.count("*"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    n_queries, dims, most = queries.count(), max(dims or 0, 1), most or 0
    shards, blocks = -(-max(n, 1) // SHARD), -(-max(n_queries, 1) // QUERY_BLOCK)
    exact = float if most * most * dims < 1 << 53 else object
    padded = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("v")))

    def packed(df: DataFrame, key: str, parts: int) -> DataFrame:
        dealt = df.select(F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias(key), "vec_id", padded.alias("v"))
        lists = dealt.groupBy(key).agg(F.collect_list(F.struct("vec_id", "v")).alias("b"))
        return lists.select(key, F.col("b.vec_id").alias(f"{key}_ids"), F.flatten("b.v").alias(f"{key}_values"))

    everywhere = packed(queries, "block", blocks).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    # As many tasks as pairs of a block and a shard, at most about one each.
    pairs = packed(vectors, "shard", shards).join(everywhere, "shard").repartition(min(shards * blocks, 4096), "shard", "block")

    @F.pandas_udf("array<struct<query_id:long,vec_id:long,score:long>>")
    def found(ids: pd.Series, values: pd.Series, query_ids: pd.Series, query_values: pd.Series) -> pd.Series:
        out = []
        for a, b, c, d in zip(ids, values, query_ids, query_values):
            rows = np.asarray(b, np.int64).reshape(-1, dims).astype(exact)
            asked = np.asarray(d, np.int64).reshape(-1, dims).astype(exact)
            a = np.asarray(a, np.int64)
            out.append([(int(q), i, s) for q, v in zip(c, asked) for s, i in shard_topk(a, rows, int(q), v, k)])
        return pd.Series(out)

    hits = pairs.select(F.explode(found("shard_ids", "shard_values", "block_ids", "block_values")).alias("h")).select("h.*")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
