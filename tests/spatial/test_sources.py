"""Readers over files written here, the spatial join against a cross join, streams and pushed filters."""

import gzip
import random
import struct

import pytest
from pyspark.sql import functions as F

from terrace.functions import predicates as P
from terrace.functions.shapes import Box, Shape, box_polygon, multis, point, points, polyline
from terrace.functions.wkt import wkt
from terrace.operators.spatial_join import HOW, spatial_join
from terrace.sources.geojson import read_geojson, write_geojson
from terrace.sources.reader import read_spatial
from terrace.sources.shapefile import read_dbf, read_shx
from terrace.streaming.static_join import locate_stream


def shp(kind, bodies):
    """Bytes of .shp and .shx of records of one type; None is a null shape."""
    records, index, at = b"", b"", 50
    for i, body in enumerate(bodies):
        data = struct.pack("<i", 0) if body is None else struct.pack("<i", kind) + body
        index += struct.pack(">ii", at, len(data) // 2)
        records += struct.pack(">ii", i + 1, len(data) // 2) + data
        at += (8 + len(data)) // 2

    def head(n):
        return struct.pack(">i", 9994) + bytes(20) + struct.pack(">i", (100 + n) // 2) + struct.pack("<ii", 1000, kind) + bytes(64)

    return head(len(records)) + records, head(len(index)) + index


def multipart(parts, z=False):
    xs = [p for part in parts for p in part]
    firsts = [sum(map(len, parts[:i])) for i in range(len(parts))]
    out = struct.pack("<4d", min(x for x, _ in xs), min(y for _, y in xs), max(x for x, _ in xs), max(y for _, y in xs))
    out += struct.pack("<ii", len(parts), len(xs)) + struct.pack(f"<{len(parts)}i", *firsts) + b"".join(struct.pack("<dd", *p) for p in xs)
    return out + (struct.pack(f"<{2 + len(xs)}d", *[0.0] * (2 + len(xs))) * 2 if z else b"")


def dbf(fields, rows):
    width = 1 + sum(n for _, _, n in fields)
    out = struct.pack("<4BihhH", 3, 24, 1, 1, len(rows), 32 + 32 * len(fields) + 1, width, 0) + bytes(18)
    for name, kind, n in fields:
        out += name.encode().ljust(11, b"\0") + kind.encode() + bytes(4) + bytes([n, 0]) + bytes(14)
    out += b"\r"
    for flag, *values in rows:
        out += flag + b"".join(v.encode().ljust(n) for v, (_, _, n) in zip(values, fields))
    return out + b"\x1a"


SQUARE = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0), (0.0, 0.0)]
HOLE = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 1.0)]


def test_shapefiles(spark, tmp_path):
    for name, (kind, bodies) in {"a": (5, [multipart([SQUARE, HOLE]), None, multipart([SQUARE])]), "b": (1, [struct.pack("<dd", -99.8, 19.5)]), "c": (13, [multipart([SQUARE[:2], HOLE], z=True)])}.items():
        data, index = shp(kind, bodies)
        (tmp_path / f"{name}.shp").write_bytes(data)
        (tmp_path / f"{name}.shx").write_bytes(index)
    (tmp_path / "a.dbf").write_bytes(dbf([("STATE", "C", 4), ("N", "N", 6)], [(b" ", "CA", "  1.5"), (b"*", "XX", "0"), (b" ", "NV", "2")]))
    rows = read_spatial(spark, str(tmp_path)).collect()
    assert len(rows) == 5 and sum(r.valid for r in rows) == 4
    assert [sum(r[c] is not None for r in rows) for c in ("point", "polyline", "polygon")] == [1, 1, 2]
    assert sorted(r.metadata["STATE"] for r in rows if r.metadata) == ["CA", "NV"] and {r.metadata["N"] for r in rows if r.metadata} == {"1.5", "2"}
    line = next(r.polyline for r in rows if r.polyline)
    assert line.indices == [0, 2] and line.xmax == 2.0
    holed = next(r.polygon for r in rows if r.metadata and r.metadata["STATE"] == "CA")
    assert holed.indices == [0, 5] and holed.ymax == 4.0
    assert [tuple(r)[1:] for r in read_shx(spark, str(tmp_path)).where("file like '%b'").collect()] == [(1, 100, 20)]
    assert read_dbf(spark, str(tmp_path)).count() == 2
    indexed = read_spatial(spark, str(tmp_path), index=True, precision=25)
    assert indexed.where("point is not null").select(F.size("index"), "index.relation").first()[:2] == (1, ["Contains"])
    with pytest.raises(ValueError):
        read_spatial(spark, str(tmp_path), type="other")


def test_geojson(spark, tmp_path):
    text = """{"type":"FeatureCollection","features":[
      {"type":"Feature","properties":{"a":"x","b":{"c":1}},"geometry":{"type":"Polygon","coordinates":[[[0,0],[0,4.0],[4,4],[4,0],[0,0]],[[1,1],[2,1],[2,2],[1,1]]]}},
      {"type":"Feature","properties":{},"geometry":{"type":"Point","coordinates":[102,0.5]}},
      {"type":"Feature","properties":null,"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[0,1],[1,1],[0,0]]],[[[5,5],[5,6],[6,6],[5,5]]]]}},
      {"type":"Feature","properties":{},"geometry":{"type":"LineString","coordinates":[[0,0],[1,1]]}},
      {"type":"Feature","properties":{},"geometry":{"type":"MultiLineString","coordinates":[[[0,0],[1,1]],[[2,2],[3,3]]]}},
      {"type":"Feature","properties":{},"geometry":{"type":"MultiPoint","coordinates":[[1,2],[3,4]]}},
      {"type":"Feature","properties":{"n":"1"},"geometry":null}]}"""
    (tmp_path / "plain.geojson").write_text(text)
    with gzip.open(tmp_path / "packed.geojson.gz", "wt") as f:
        f.write(text)
    rows = read_spatial(spark, str(tmp_path / "plain.geojson"), type="geojson").collect()
    assert [sum(r[c] is not None for r in rows) for c in ("point", "polyline", "polygon")] == [3, 2, 3] and len(rows) == 9
    first = next(r for r in rows if r.metadata and r.metadata.get("a"))
    assert first.polygon.indices == [0, 5] and first.metadata["b"] == '{"c":1}'
    assert next(r.polyline.indices for r in rows if r.polyline and len(r.polyline.xcoordinates) == 4) == [0, 2]
    assert read_geojson(spark, str(tmp_path)).count() == 18
    polygons = read_geojson(spark, str(tmp_path / "plain.geojson")).where("polygon is not null")
    write_geojson(polygons, "polygon", str(tmp_path / "lines"), "metadata")
    back = read_geojson(spark, str(tmp_path / "lines"), lines=True)
    assert sorted(map(str, back.select("polygon").collect())) == sorted(map(str, polygons.select("polygon").collect()))


def test_osm(spark, tmp_path):
    (tmp_path / "a.osm").write_text("""<osm>
      <node id="1" lat="43.7" lon="79.4"/><node id="2" lat="45.4214" lon="75.6919"><tag k="name" v="two"/></node><node id="3" lat="45.5017" lon="73.5673"/>
      <way id="4"><nd ref="2"/><nd ref="1"/><nd ref="3"/><tag k="type" v="road"/></way>
      <way id="5"><nd ref="1"/><nd ref="2"/><nd ref="3"/><nd ref="1"/><tag k="landuse" v="retail"/></way>
      <way id="6"><nd ref="1"/><nd ref="2"/><nd ref="1"/><tag k="highway" v="x"/></way>
      <way id="7"><nd ref="99"/></way><way id="8"><nd ref="3"/></way>
      <relation id="9"><member ref="4"/></relation></osm>""")
    rows = read_spatial(spark, str(tmp_path), type="osm").collect()
    assert [sum(r[c] is not None for r in rows) for c in ("point", "polyline", "polygon")] == [4, 2, 1] and len(rows) == 8
    road = next(r for r in rows if r.metadata.get("type") == "road")
    assert road.polyline.xcoordinates == [75.6919, 79.4, 73.5673] and road.polyline.indices == [0]
    assert next(r for r in rows if r.polygon).polygon.indices == [0]


def boxes(spark, seed, n, name, size):
    r = random.Random(seed)
    rows = [(i, r.randint(-170, 170) / 1.0, r.randint(-80, 80) / 1.0, r.randint(0, size) / 2) for i in range(n)] + [(n, None, None, None)]
    df = spark.createDataFrame(rows, f"{name}_id int, x double, y double, s double")
    return df.select(f"{name}_id", F.when(F.col("x").isNotNull(), box_polygon("x", "y", F.col("x") + F.col("s") + 0.5, F.col("y") + F.col("s") + 0.5)).alias(f"{name}_shape"), F.when(F.col("x").isNotNull(), point("x", "y")).alias(f"{name}_point"))


@pytest.mark.parametrize("left,right,predicate", [("a_point", "b_shape", "within"), ("a_shape", "b_shape", "intersects"), ("b_shape", "a_point", "intersects"), ("a_shape", "b_shape", "contains")])
def test_indexed_join_equals_cross_join(spark, left, right, predicate):
    a, b = boxes(spark, 1, 60, "a", 60).cache(), boxes(spark, 2, 50, "b", 60).cache()
    l, r = (a, b) if left.startswith("a") else (b, a)
    key_l, key_r = l.columns[0], r.columns[0]
    test = {"within": P.within, "intersects": P.intersects, "contains": P.contains}[predicate](Shape.of(l, left), Shape.of(r, right))
    for how in HOW:
        expected = l.join(r, test, how)
        got = spatial_join(l, r, left, right, predicate, how, precision=10, left_key=[key_l], right_key=[key_r])
        keys = [key_l] + ([key_r] if how not in ("left_semi", "left_anti") else [])
        assert sorted(map(str, got.select(*keys).collect())) == sorted(map(str, expected.select(*keys).collect())), how


def test_join_needs_no_key(spark):
    a, b = boxes(spark, 1, 20, "a", 60), boxes(spark, 2, 20, "b", 60)
    got = spatial_join(a, b, "a_shape", "b_shape", "intersects", "left_anti")
    keyed = spatial_join(a, b, "a_shape", "b_shape", "intersects", "left_anti", left_key=["a_id"])
    assert sorted(r.a_id for r in got.collect()) == sorted(r.a_id for r in keyed.collect())
    with pytest.raises(ValueError):
        spatial_join(a, a, "a_shape", "a_shape")
    with pytest.raises(ValueError):
        spatial_join(a, b, "a_shape", "b_shape", precision=12)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_range_filters_reach_the_scan(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    spark.range(100).select(F.col("id").cast("double").alias("x"), F.col("id").cast("double").alias("y"), F.lit("z").alias("other")).write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    for test in (P.within_box(points(point("x", "y")), Box(1, 2, 3, 4)), P.within_circle(points(point("x", "y")), 3.0, 3.0, 2.0)):
        text = plan(df.where(test).select("x"))
        assert "GreaterThanOrEqual(x" in text and "LessThanOrEqual(y" in text and "other" not in text.split("ReadSchema")[1]


def test_join_is_an_equi_join(spark):
    a, b = boxes(spark, 1, 20, "a", 60), boxes(spark, 2, 20, "b", 60)
    text = plan(spatial_join(a, b, "a_point", "b_shape"))
    assert "NestedLoop" not in text and "Cartesian" not in text
    assert "BroadcastExchange" in plan(spatial_join(a, F.broadcast(b), "a_point", "b_shape"))


def test_stream_of_points(spark, tmp_path):
    polygons = spark.createDataFrame([(1, "POLYGON ((0 0, 0 4, 4 4, 4 0, 0 0))")], "region int, text string").select("region", wkt("text")["polygon"].alias("shape"))
    spark.createDataFrame([(1, 1.0, 1.0), (2, 9.0, 9.0), (3, 2.0, 3.0)], "id int, x double, y double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, x double, y double").parquet(str(tmp_path / "in")).withColumn("point", point("x", "y"))
    q = locate_stream(stream, polygons, "point", "shape").select("id", "region").writeStream.format("memory").queryName("located").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.id for r in spark.table("located").collect()) == [1, 3]


def test_lone_vertices(spark):
    one = Shape(polyline(F.array(F.lit(0)), F.array(F.lit(1.0)), F.array(F.lit(1.0))), "multi")
    assert spark.range(1).select(P.intersects(one, Shape(point(1.0, 1.0), "point")), multis(one.col)["xmin"]).first()[:] == (True, 1.0)


def test_windowed_counts_of_a_stream(spark, tmp_path):
    from terrace.streaming.static_join import counts_by_region

    rows = [("2024-01-01 00:00:10", 1), ("2024-01-01 00:00:50", 1), ("2024-01-01 00:01:10", 2), ("2024-01-01 01:00:00", 1)]
    spark.createDataFrame(rows, "t string, region int").select(F.col("t").cast("timestamp").alias("t"), "region").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t timestamp, region int").parquet(str(tmp_path / "in"))
    counted = counts_by_region(stream, "t", "region", "1 minute", "1 minute")
    q = counted.writeStream.outputMode("complete").format("memory").queryName("counted").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.region, r.n) for r in spark.table("counted").collect()) == [(1, 1), (1, 2), (2, 1)]
