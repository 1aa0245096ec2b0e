"""Ranking without collecting a group into one task.

``top_k`` relies on the window group limit: a ``row_number() <= k`` filter keeps k rows per group on the map
side, so a hot group never travels whole. ``positions`` numbers *all* rows of a group exactly: rows are
counted per (group, coarse order) cell, the cell counts become offsets, and only the rows of one cell
share a window partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k).withColumn(
        name, F.col(name).cast("bigint")
    )


def positions(df: DataFrame, keys: list[str], coarse: list[str], fine: list[Column], name: str = "position",
              block: tuple[str, int] | None = None) -> DataFrame:
    """Exact 1-based position inside each group, ordered by ``coarse`` columns (ascending), then ``fine``.

    ``block`` = (integer column, width) adds ``floor(column / width)`` as the last coarse column, which
    bounds a cell even when every other coarse column is equal; the column must be the first of ``fine``.
    """
    cells = list(coarse)
    if block:
        column, width = block
        df = df.withColumn("_block", F.floor(F.col(column) / width).cast("bigint"))
        cells.append("_block")
    # One struct as key: nulls in it are equal, and the window and the join share one shuffle of the rows.
    df = df.withColumn("_cell", F.struct(*keys, *cells))
    counts = df.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*[F.col("_cell")[c] for c in keys]).orderBy(*[F.col("_cell")[c] for c in cells]).rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = counts.select("_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_cell").orderBy(*fine)
    joined = df.withColumn("_rn", F.row_number().over(inside)).join(offsets, "_cell")
    drop = ["_cell", "_rn", "_offset"] + (["_block"] if block else [])
    return joined.withColumn(name, (F.col("_offset") + F.col("_rn")).cast("bigint")).drop(*drop)


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that treats nulls as equal and keeps one copy of the key columns."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    condition = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on]
    return left.join(renamed, condition, how).drop(*[f"_r_{c}" for c in on])


def histogram_percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact nearest-lower/upper interpolated percentiles from value counts.

    Values are counted first (partial aggregation), so a group is represented by its distinct values. They are numbered
    within cells of growing width, and the cells' totals give the offsets: no task holds all values of a hot group.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_cell", (F.signum(value) * F.floor(F.log2(1 + F.abs(value)) * 64)).cast("int"))
    cells = counts.groupBy(*keys, "_cell").agg(F.sum("_n").alias("_cell_n"))
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*keys, "_cell", F.coalesce(F.sum("_cell_n").over(before), F.lit(0)).alias("_offset"),
                         F.sum("_cell_n").over(Window.partitionBy(*keys)).alias("_total"))
    inside = Window.partitionBy(*keys, "_cell").orderBy(value)
    cum = null_safe_join(counts.withColumn("_in", F.sum("_n").over(inside)), cells, [*keys, "_cell"])
    cum = cum.withColumn("_hi", F.col("_offset") + F.col("_in"))
    cum = cum.withColumn("_lo", F.col("_hi") - F.col("_n"))
    out = [F.sum("_n").cast("bigint").alias("n"), F.min(value).alias("min"), F.max(value).alias("max")]
    for name, share in shares.items():
        rank = (F.col("_total") - 1) * F.lit(share)
        low, high = F.floor(rank), F.ceil(rank)
        at = lambda r: F.max(F.when((F.col("_lo") <= r) & (r < F.col("_hi")), F.col(value)))
        weight = F.max(rank - low)
        out.append((at(low) + (at(high) - at(low)) * weight).alias(name))
    return cum.groupBy(*keys).agg(*out)
