"""Streams of points against stored polygons. Predicates are stateless, so a stream-static join needs no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shapes import WORLD, Box
from ..operators.spatial_join import spatial_join


def locate_stream(points: DataFrame, polygons: DataFrame, point: str, polygon: str, how: str = "inner", precision: int = 15, world: Box = WORLD) -> DataFrame:
    """Each streamed point with the polygons it lies within. how: inner or left."""
    if how not in ("inner", "left"):
        raise ValueError("how: inner or left")
    return spatial_join(points, polygons, point, polygon, "within", how, precision, world)


def counts_by_region(located: DataFrame, time: str, region: str, window: str, delay: str) -> DataFrame:
    """Windowed counts by region; rows later than `delay` are dropped by the watermark."""
    return located.withWatermark(time, delay).groupBy(F.window(time, window), F.col(region)).agg(F.count("*").alias("n"))
