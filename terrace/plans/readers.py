"""Queries of the readers and text formats: each writes a small file of the nation table, reads it back and has its SQL."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import functions as F

from ..functions import grid, predicates as P
from ..functions.buffer import buffer
from ..functions.geojson import polygon_from_json, polygon_to_json
from ..functions.shapes import Shape, is_valid, length, lines, multis, num_rings, point, points, vertex
from ..functions.wkt import as_wkt, wkt
from ..operators.shared import checkpoint_dir
from ..operators.spatial_join import spatial_join
from ..sources.geojson import read_geojson, write_geojson
from ..sources.reader import read_spatial
from ..sources.shapefile import splits
from ..streaming.static_join import counts_by_region, locate_stream
from .catalogue import DIAMONDS, query
from .files import moved, nation_rows, nation_shapefiles, put
from .inputs import CX, CY, DIAMOND, HALF, SEGMENTS, SQL, SQUARE, customers, edge_tests, nations, segments

_NAT = f"WITH {SQL}"


def _shapefiles(spark, d, **options):
    return read_spatial(spark, put(spark, nation_shapefiles(nation_rows(spark, d))), "shapefile", **options)


@query(_NAT + """ SELECT n_name AS name, CAST(n_nationkey AS VARCHAR) AS key, n_nationkey % 7 <> 0 AS valid, CASE WHEN n_nationkey % 7 <> 0 THEN 2 ELSE 0 END AS rings,
  CASE WHEN n_nationkey % 7 <> 0 THEN 10 ELSE 0 END AS vertices, CASE WHEN n_nationkey % 7 <> 0 THEN cx - 24 END AS xmin, CASE WHEN n_nationkey % 7 <> 0 THEN cy + 6 END AS hole_top FROM nat""")
def shapefile_polygons(spark, d):
    """Polygons with holes and null shapes, joined with their dBase rows."""
    p = multis("polygon")
    rows = _shapefiles(spark, d).where(F.col("metadata")["LAYER"] == "areas")
    there = F.col("polygon").isNotNull()
    return rows.select(F.col("metadata")["NAME"].alias("name"), F.col("metadata")["KEY"].alias("key"), "valid", F.when(there, num_rings(p)).otherwise(0).alias("rings"), F.when(there, length(p)).otherwise(0).alias("vertices"), "polygon.xmin", vertex(p, 6)["y"].alias("hole_top"))


@query(_NAT + " SELECT n_name AS name, cx AS x, cy AS y FROM nat")
def shapefile_points(spark, d):
    return _shapefiles(spark, d).where("point IS NOT NULL").select(F.col("metadata")["NAME"].alias("name"), "point.x", "point.y")


@query(_NAT + """ SELECT n_name AS name, layer, parts, vertices, cx - w AS xmin, cy + h AS ymax FROM nat CROSS JOIN (VALUES ('roads', 2, 8, 24, 12), ('ridges', 1, 5, 12, 6)) k(layer, parts, vertices, w, h)""")
def shapefile_polylines(spark, d):
    """Lines of several parts, and lines with heights, whose x and y are read."""
    s = multis("polyline")
    rows = _shapefiles(spark, d).where("polyline IS NOT NULL")
    return rows.select(F.col("metadata")["NAME"].alias("name"), F.col("metadata")["LAYER"].alias("layer"), num_rings(s).alias("parts"), length(s).alias("vertices"), "polyline.xmin", "polyline.ymax")


@query("SELECT 100::BIGINT AS records, 96::BIGINT AS shapes, true AS split, true AS small")
def shapefile_split(spark, d):
    """The .shx plans splits of whole records; what is read doesn't depend on their size."""
    path = put(spark, nation_shapefiles(nation_rows(spark, d)))
    rows = read_spatial(spark, path, "shapefile", split_bytes=1000)
    read = rows.agg(F.count("*").alias("records"), F.count(F.coalesce(F.col("point.xmin"), F.col("polyline.xmin"), F.col("polygon.xmin"))).alias("shapes"))
    plan = splits(spark, path, 1000).agg((F.count("*") > 8).alias("split"), (F.max("length") < 1400).alias("small"))
    return read.crossJoin(plan)  # one row each


@query(_NAT + " SELECT relation, count(*) AS cells FROM (SELECT 'Contains' AS relation FROM nat) GROUP BY relation")
def index_on_load(spark, d):
    """The index that a reader makes: a point has the one cell that contains it."""
    rows = _shapefiles(spark, d, index=True, precision=20).where("point IS NOT NULL")
    return rows.select(F.explode("index").alias("i")).groupBy("i.relation").agg(F.count("*").alias("cells"))


def _feature(of, coordinates, **properties):
    return {"type": "Feature", "properties": properties, "geometry": {"type": of, "coordinates": coordinates}}


@query(_NAT + """, made AS (SELECT n_name, n_nationkey % 6 AS k, cx, cy FROM nat)
SELECT n_name AS name, CASE WHEN k IN (0, 1) THEN 'point' WHEN k IN (2, 3) THEN 'polyline' ELSE 'polygon' END AS kind, CASE k WHEN 1 THEN x.i * 1.0 ELSE 0 END AS nth,
  CASE k WHEN 0 THEN cx WHEN 1 THEN cx + x.i WHEN 2 THEN cx - 24 WHEN 3 THEN cx - 24 WHEN 4 THEN cx - 24 ELSE cx - 24 + x.i * 100 END AS xmin, CASE WHEN k IN (3, 4) THEN 2 WHEN k IN (2, 5) THEN 1 ELSE 0 END AS parts
FROM made JOIN (VALUES (0), (1), (2)) x(i) ON x.i = 0 OR (k = 1 AND x.i <= 2) OR (k = 5 AND x.i = 1)""")
def geojson_collection(spark, d):
    """A feature collection in one file with every geometry type, and its properties."""
    makers = [
        lambda x, y: ("Point", [x, y]),
        lambda x, y: ("MultiPoint", [[x, y], [x + 1, y], [x + 2, y]]),
        lambda x, y: ("LineString", moved(x, y, DIAMOND)),
        lambda x, y: ("MultiLineString", [moved(x, y, DIAMOND), moved(x, y, HALF)]),
        lambda x, y: ("Polygon", [moved(x, y, SQUARE), moved(x, y, HALF)]),
        lambda x, y: ("MultiPolygon", [[moved(x, y, SQUARE)], [moved(x + 100, y, SQUARE)]]),
    ]
    features = [_feature(*makers[k % 6](x, y), name=n, cx=x, kind=k % 6) for k, n, x, y in nation_rows(spark, d)]
    path = put(spark, {"nations.geojson": json.dumps({"type": "FeatureCollection", "features": features}).encode()})
    rows = read_spatial(spark, path, "geojson")
    m, b = F.col("metadata"), F.coalesce("polyline", "polygon")
    kind = F.when(F.col("point").isNotNull(), "point").when(F.col("polyline").isNotNull(), "polyline").otherwise("polygon")
    nth = F.when(m["kind"] == "1", F.col("point.x") - m["cx"].cast("double")).otherwise(0.0)
    return rows.select(m["name"].alias("name"), kind.alias("kind"), nth.alias("nth"), F.coalesce("point.xmin", b["xmin"]).alias("xmin"), F.when(b.isNotNull(), F.size(b["indices"])).otherwise(0).alias("parts"))


@query(_NAT + " SELECT n_name AS name, cx - 24 AS xmin, cy - 12 AS ymin, cx + 24 AS xmax, cy + 12 AS ymax, true AS valid FROM nat")
def geojson_lines(spark, d):
    """Features a line, written by tasks and read back: the envelope of each."""
    path = f"{checkpoint_dir(spark)}/geojson-{uuid.uuid4().hex}"
    write_geojson(nations(spark, d).withColumn("p", F.struct("n_name")), "diamond", path, "p")
    rows = read_geojson(spark, path, lines=True)
    return rows.select(F.col("metadata")["n_name"].alias("name"), *[f"polygon.{c}" for c in ("xmin", "ymin", "xmax", "ymax")], "valid")


def _osm(rows) -> bytes:
    """Four nodes for each nation and a way around them: closed unless the key leaves 2 by 3; a highway where it leaves 1."""
    out = ["<?xml version='1.0' encoding='UTF-8'?>", "<osm version='0.6'>"]
    for k, _, x, y in rows:
        out += [f"<node id='n{k}_{i}' lat='{b}' lon='{a}'>" + (f"<tag k='corner' v='{i}'/>" if i == 0 else "") + "</node>" for i, (a, b) in enumerate(moved(x, y, DIAMOND)[:4])]
    for k, name, *_ in rows:
        refs = [0, 1, 2, 3] + [0] * (k % 3 != 2)
        out.append(f"<way id='w{k}'>" + "".join(f"<nd ref='n{k}_{i}'/>" for i in refs) + f"<tag k='name' v='{name}'/>" + "<tag k='highway' v='road'/>" * (k % 3 == 1) + "</way>")
    return "\n".join([*out, "</osm>"]).encode()


@query(_NAT + """ SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'polygon' ELSE 'polyline' END AS kind, n_name AS name, CASE WHEN n_nationkey % 3 = 2 THEN 4 ELSE 5 END AS vertices, cx - 24 AS x0, cy + 12 AS y1 FROM nat
UNION ALL SELECT 'point', NULL, 1, cx + dx, cy + dy FROM nat CROSS JOIN (VALUES (-24.0, 0.0), (0.0, 12.0), (24.0, 0.0), (0.0, -12.0)) c(dx, dy)""")
def osm_ways(spark, d):
    """Nodes as points; ways joined with their nodes, as lines, or as polygons where they are closed and no road."""
    path = put(spark, {"nations.osm": _osm(nation_rows(spark, d))})
    rows = read_spatial(spark, f"{path}/nations.osm", "osm")
    b, p = F.coalesce("polyline", "polygon"), F.col("point")
    kind = F.when(p.isNotNull(), "point").when(F.col("polyline").isNotNull(), "polyline").otherwise("polygon")
    x0, y1 = F.coalesce(p["x"], F.get(b["xcoordinates"], F.lit(0))), F.coalesce(p["y"], F.get(b["ycoordinates"], F.lit(1)))
    return rows.select(kind.alias("kind"), F.col("metadata")["name"].alias("name"), F.coalesce(F.size(b["xcoordinates"]), F.lit(1)).alias("vertices"), x0.alias("x0"), y1.alias("y1"))


@query(f"WITH {SQL} SELECT c_custkey, x / 1048576 AS small, x * 1048576 AS large, y / 1048576 AS y0 FROM cust")
def wkt_exponents(spark, d):
    """Small and large coordinates, whose text has exponents, come back exactly."""
    n = 1048576.0
    text = customers(spark, d).select("c_custkey", as_wkt(points(point(F.col("x") / n, F.col("x") * n))).alias("a"), F.concat(F.lit("LINESTRING ("), F.col("x").cast("string"), F.lit(" "), (F.col("y") / n).cast("string"), F.lit(", 1e3 -2.5E-2)")).alias("b"))
    return text.select("c_custkey", wkt("a")["point"].alias("p"), wkt("b")["polyline"].alias("q")).select("c_custkey", F.col("p.x").alias("small"), F.col("p.y").alias("large"), F.get("q.ycoordinates", F.lit(0)).alias("y0"))


@query(_NAT + " SELECT n_nationkey, 2 AS rings, cx - 24 AS xmin, cy + 6 AS hole_top, true AS valid FROM nat")
def polygon_json_roundtrip(spark, d):
    text = nations(spark, d).select("n_nationkey", polygon_to_json(multis("holed")).alias("text"))
    p = multis("p")
    return text.select("n_nationkey", polygon_from_json("text").alias("p")).select("n_nationkey", num_rings(p).alias("rings"), "p.xmin", vertex(p, 6)["y"].alias("hole_top"), is_valid(p).alias("valid"))


@query(f"WITH {SQL}, tests AS ({edge_tests(DIAMONDS)}) SELECT c_custkey, n_nationkey FROM tests WHERE on_edge OR above % 2 = 1")
def covers_join(spark, d):
    """The closed form of containment."""
    return spatial_join(nations(spark, d), customers(spark, d), "diamond", "point", "covers").select("c_custkey", "n_nationkey")


@query(f"WITH {SQL} SELECT n_nationkey, count(*) FILTER (WHERE abs(x - cx) / 24 + abs(y - cy) / 12 > 1) AS apart, count(*) FILTER (WHERE abs(x - cx) / 24 + abs(y - cy) / 12 = 1) AS touching FROM cust CROSS JOIN nat GROUP BY n_nationkey")
def disjoint_touches(spark, d):
    """Customers apart from each nation, and on its rim: all pairs are what is asked for, of 25 nations."""
    p, g = points("point"), multis("diamond")
    pairs = customers(spark, d).crossJoin(F.broadcast(nations(spark, d).select("n_nationkey", "diamond")))
    return pairs.groupBy("n_nationkey").agg(F.count_if(P.disjoint(p, g)).alias("apart"), F.count_if(P.touches(p, g)).alias("touching"))


@query(f"WITH {SEGMENTS} SELECT o_orderkey, true AS first_half, ax = bx AS whole_in_half FROM segs")
def line_contains_line(spark, d):
    """A segment contains its first half; that one contains the whole only where both are a point."""
    s = Shape(F.col("segment"), "line")
    half = segments(spark, d).withColumn("half", F.struct(F.lit(2).alias("type"), F.least("segment.startX", (s["startX"] + s["endX"]) / 2).alias("xmin"), F.least("segment.startY", (s["startY"] + s["endY"]) / 2).alias("ymin"), F.greatest("segment.startX", (s["startX"] + s["endX"]) / 2).alias("xmax"), F.greatest("segment.startY", (s["startY"] + s["endY"]) / 2).alias("ymax"), "segment.startX", "segment.startY", ((s["startX"] + s["endX"]) / 2).alias("endX"), ((s["startY"] + s["endY"]) / 2).alias("endY")))
    return half.select("o_orderkey", P.contains(s, lines("half")).alias("first_half"), P.contains(lines("half"), s).alias("whole_in_half"))


@query(f"WITH {SQL}, k AS (SELECT CAST(least(1023, greatest(0, floor((x + 180) / 360.0 * 1024))) AS BIGINT) AS ix, CAST(least(1023, greatest(0, floor((y + 90) / 180.0 * 1024))) AS BIGINT) AS iy FROM cust) SELECT count(DISTINCT (ix, iy)) AS cells, true AS near FROM k")
def distinct_cells(spark, d):
    """Cells are equal if precision and bits are; the approximate count is within a tenth."""
    cells = customers(spark, d).select(grid.point_cell(points("point"), 20).alias("c")).select("c.precision", "c.bits")
    exact = F.count_distinct("precision", "bits")
    return cells.agg(exact.alias("cells"), F.approx_count_distinct("bits", 0.02).alias("about")).select("cells", (F.abs(F.col("about") - F.col("cells")) <= F.col("cells") / 10).alias("near"))


@query(f"WITH {SQL} SELECT c_custkey, x * x + y * y <= 10000 AS inside FROM cust")
def python_predicate(spark, d):
    """A predicate of one's own, an Arrow function over the fields of a point."""
    @F.pandas_udf("boolean")
    def inside(x: pd.Series, y: pd.Series) -> pd.Series:
        return x * x + y * y <= 10000

    return customers(spark, d).select("c_custkey", inside("point.x", "point.y").alias("inside"))


@query(f"WITH {SEGMENTS} SELECT o_orderkey, true AS holds_ends, false AS holds_beside, true AS long_thin FROM segs")
def buffer_segments(spark, d):
    """Buffers of segments, and of one 1275 long with a distance of 0.01: points inside and beside them."""
    s, n = Shape(F.col("segment"), "line"), 0.01
    at = lambda x, y: Shape(point(x, y), "point")
    made = segments(spark, d).select("o_orderkey", "segment", buffer(s, 0.5, 8).alias("b"))
    asked = [at(s["startX"], s["startY"]), at(s["endX"], s["endY"]), at(s["startX"] + 1, s["startY"] - 1)]
    held = made.select("o_orderkey", P.within_each(asked, multis("b")).alias("w"))
    tested = held.select("o_orderkey", (F.get("w", F.lit(0)) & F.get("w", F.lit(1))).alias("holds_ends"), F.get("w", F.lit(2)).alias("holds_beside"))
    # The long one is the same for all segments: one row with its answer, beside each of them.
    thin = spark.range(1).select(F.struct(F.lit(0.0).alias("startX"), F.lit(0.0).alias("startY"), F.lit(1000.0).alias("endX"), F.lit(777.0).alias("endY")).alias("thin"))
    one, t = thin.select(buffer(lines("thin"), n, 8).alias("t")), multis("t")
    long_thin = P.within(at(F.lit(-0.005), F.lit(0.0)), t) & P.within(at(F.lit(500.0), F.lit(388.5)), t) & ~P.within(at(F.lit(500.0), F.lit(388.52)), t) & P.within(at(F.lit(1000.005), F.lit(777.0)), t)
    return tested.crossJoin(F.broadcast(one.select(long_thin.alias("long_thin"))))


_LOCATED = f"WITH {SQL}, tests AS ({edge_tests(DIAMONDS)}), pairs AS (SELECT c_custkey, n_nationkey FROM tests WHERE NOT on_edge AND above % 2 = 1)"


def _streamed(spark, d):
    read = spark.readStream.schema(spark.read.parquet(f"{d}/customer.parquet").schema).parquet(f"{d}/customer.parquet*")
    moving = read.select("c_custkey", point(F.expr(CX), F.expr(CY)).alias("point"), F.timestamp_seconds(F.col("c_custkey") * 60).alias("time"))
    return locate_stream(moving, nations(spark, d).select("n_nationkey", "diamond"), "point", "diamond")


def _drained(stream, folder, name):
    """Runs a stream over what there is, into files below the shared folder."""
    out = f"{folder}/{name}"
    started = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").outputMode("append").trigger(availableNow=True).start()
    started.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


@query(_LOCATED + " SELECT c_custkey, n_nationkey FROM pairs")
def stream_located(spark, d):
    """A stream of customers against stored nations."""
    return _drained(_streamed(spark, d).select("c_custkey", "n_nationkey"), f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}", "located")


@query(_LOCATED + ", late AS (SELECT max(c_custkey) * 60 - 7200 AS mark FROM pairs) SELECT n_nationkey, c_custkey * 60 // 3600 * 3600 AS began, count(*) AS n FROM pairs, late GROUP BY n_nationkey, began, mark HAVING c_custkey * 60 // 3600 * 3600 + 3600 <= mark")
def stream_counts(spark, d):
    """Hourly counts by nation, of the hours that the watermark has closed."""
    counts = counts_by_region(_streamed(spark, d), "time", "n_nationkey", "1 hour", "2 hours")
    rows = _drained(counts.select("n_nationkey", "window", "n"), f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}", "counts")
    return rows.select("n_nationkey", F.unix_timestamp("window.start").alias("began"), "n")
