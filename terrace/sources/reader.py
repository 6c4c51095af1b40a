"""One entry point for all spatial file formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grid
from ..functions.shapes import WORLD, Box, multis, points
from .geojson import read_geojson
from .osm import read_osm
from .shapefile import read_shapefile

_READERS = {"shapefile": read_shapefile, "geojson": read_geojson, "osm": read_osm}


def read_spatial(spark: SparkSession, path: str, type: str = "shapefile", index: bool = False, precision: int = 30, world: Box = WORLD, **options) -> DataFrame:
    """point, polyline, polygon, metadata, valid and, if asked for, index (array<struct<curve, relation>>) of the shape."""
    if type not in _READERS:
        raise ValueError(f"type: one of {', '.join(_READERS)}")
    if not path:
        raise ValueError("a path is needed")
    df = _READERS[type](spark, path, **options)
    if index:
        kinds = [grid.index(s, precision, world) for s in (points("point"), multis("polyline"), multis("polygon"))]
        df = df.withColumn("index", F.coalesce(*kinds))
    return df
