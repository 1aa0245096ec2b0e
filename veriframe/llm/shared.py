"""Small helpers of the subpackage."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from veriframe.session import scratch_path


def limit_arrow_batches(spark: SparkSession, max_bytes: int = 16 << 20) -> None:
    """Bound an Arrow batch by bytes as well as rows, so that very long texts don't fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(max_bytes))


def text_bytes(column: str = "text") -> Column:
    """UTF-8 bytes of a text (null: empty): Python workers then skip decoding."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def hash_sample(df: DataFrame, key: str, total: Column | int, bound: int) -> DataFrame:
    """About ``bound`` of ``total`` rows, all of them when there are fewer, chosen by the hash of ``key``.

    A row's fate depends on its key only, so a lost task draws the same rows again.
    """
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.greatest(F.lit(total), F.lit(1))) < bound)


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a compressed table in the shared folder: cuts lineage like a checkpoint, in less space."""
    place = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(place)
    return df.sparkSession.read.parquet(place)
