"""Radius search with a grid instead of comparing every point with every center."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriframe import config
from veriframe.functions.geo import haversine_m, valid_point

CELL_DEG = 0.05
LON_CELLS = int(360 / CELL_DEG)


def within_radius(points: DataFrame, centers: DataFrame, radius_m: float) -> DataFrame:
    """(point_id, center_id, distance_m) for points at most ``radius_m`` from a center.

    Each center lists the grid cells its bounding box touches; each point has one cell; the exact distance
    decides. Cells wrap at the date line and a center near a pole takes the whole ring.
    """
    meters_per_degree = config.EARTH_RADIUS_M * 3.141592653589793 / 180
    dlat = F.lit(radius_m / meters_per_degree * 1.000001)
    near_pole = F.abs("c_lat") + dlat > 89.0
    # Widest longitude span of the circle, taken at its latitude closest to a pole.
    dlon = F.when(near_pole, 180.0).otherwise(
        F.least(F.lit(180.0), dlat / F.cos(F.radians(F.abs("c_lat") + dlat)))
    )
    cell = lambda c: F.floor(c / CELL_DEG)
    boxes = centers.filter(valid_point(F.col("lat"), F.col("lon"))).select(
        "center_id", F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon")
    ).withColumns({
        "lat_cell": F.explode(F.sequence(cell(F.col("c_lat") - dlat), cell(F.col("c_lat") + dlat))),
    }).withColumn(
        "_lon", F.explode(F.sequence(
            cell(F.col("c_lon") - dlon),
            F.least(cell(F.col("c_lon") + dlon), cell(F.col("c_lon") - dlon) + (LON_CELLS - 1))))
    ).withColumn("lon_cell", F.pmod("_lon", F.lit(LON_CELLS)))
    located = points.filter(valid_point(F.col("lat"), F.col("lon"))).withColumns({
        "lat_cell": cell(F.col("lat")), "lon_cell": F.pmod(cell(F.col("lon")), F.lit(LON_CELLS)),
    })
    distance = haversine_m(F.col("c_lat"), F.col("c_lon"), F.col("lat"), F.col("lon"))
    return located.join(boxes, ["lat_cell", "lon_cell"]).withColumn("distance_m", distance).filter(
        F.col("distance_m") <= radius_m
    ).select("point_id", "center_id", "distance_m")
