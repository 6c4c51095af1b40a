"""OpenStreetMap XML, through Spark's XML source, joins and aggregates.

All nodes are points; ways are joined with their nodes. Null where a way has no known node; a point of one; a polygon if
it is closed and an area (area=yes, or neither barrier nor highway); else a polyline. Relations are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shapes import point_or_null, polygon, polyline
from .geojson import finished

_TAGS = "tag array<struct<_k:string,_v:string>>"
_NODE = f"_id string, _lat double, _lon double, {_TAGS}"
_WAY = f"_id string, nd array<struct<_ref:string>>, {_TAGS}"


def _metadata():
    # A key that repeats keeps its last value.
    keys = F.array_distinct(F.transform("tag", lambda t: t["_k"]))
    last = F.transform(keys, lambda k: F.element_at(F.filter("tag", lambda t: t["_k"] == k), -1)["_v"])
    return F.coalesce(F.map_from_arrays(keys, last), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("metadata")


def read_osm(spark: SparkSession, path: str) -> DataFrame:
    read = spark.read.format("xml")
    nodes = read.option("rowTag", "node").schema(_NODE).load(path)
    ways = spark.read.format("xml").option("rowTag", "way").schema(_WAY).load(path)
    none = F.lit(None)
    blank_line = F.when(F.lit(False), polyline(F.array(F.lit(0)), F.array(F.lit(0.0)), F.array(F.lit(0.0))))
    blank_area = F.when(F.lit(False), polygon(F.array(F.lit(0)), F.array(F.lit(0.0)), F.array(F.lit(0.0))))
    as_points = nodes.select(point_or_null("_lon", "_lat").alias("point"), blank_line.alias("polyline"), blank_area.alias("polygon"), _metadata())

    refs = ways.select("_id", F.posexplode("nd").alias("place", "nd")).select("_id", "place", F.col("nd._ref").alias("ref"))
    placed = refs.join(nodes.select(F.col("_id").alias("ref"), "_lon", "_lat"), "ref")
    paths = placed.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("place", "_lon", "_lat", "ref"))).alias("path"))  # a way's nodes
    joined = ways.select("_id", "tag", _metadata()).join(paths, "_id", "left")
    xs, ys = F.transform("path", lambda n: n["_lon"]), F.transform("path", lambda n: n["_lat"])
    n = F.coalesce(F.size("path"), F.lit(0))
    m = F.col("metadata")
    closed = (n > 2) & (F.element_at("path", 1)["ref"] == F.element_at("path", -1)["ref"])
    area = closed & (F.coalesce(m["area"] == "yes", F.lit(False)) | ~(F.map_contains_key(m, "barrier") | F.map_contains_key(m, "highway")))
    one = F.array(F.lit(0))
    as_ways = joined.select(
        F.when(n == 1, point_or_null(F.get(xs, F.lit(0)), F.get(ys, F.lit(0)))).alias("point"),
        F.when((n > 1) & ~area, polyline(one, xs, ys)).alias("polyline"),
        F.when(area, polygon(one, xs, ys)).alias("polygon"),
        "metadata",
    )
    return finished(as_points.unionByName(as_ways))
