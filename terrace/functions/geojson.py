"""Geometry objects of GeoJSON, read and written by built-in JSON functions; and polygons as JSON objects of arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .shapes import POLYGON, Shape, as_column, point_or_null, polygon, polyline


def _coordinates(s: Shape) -> Column:
    return F.transform(s.vertices, lambda v: F.array(v["x"], v["y"]))


def as_geojson(s: Shape) -> Column:
    """Point, LineString (of a segment), MultiLineString or Polygon; null for null."""

    def out(kind: str, coordinates: Column) -> Column:
        return F.to_json(F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates")))

    if s.kind == "point":
        made = out("Point", F.array(s["x"], s["y"]))
    elif s.kind == "line":
        made = out("LineString", _coordinates(s))
    else:
        every, first, n = _coordinates(s), s["indices"], F.size(s["xcoordinates"])
        rings = F.transform(first, lambda a, i: F.slice(every, a + 1, F.coalesce(F.get(first, i + 1), n) - a))
        made = F.when(s["type"] == POLYGON, out("Polygon", rings)).otherwise(out("MultiLineString", rings))
    return F.when(s.col.isNotNull(), made)


def feature(s: Shape, properties: Column | None = None) -> Column:
    """A Feature; properties: a map or struct."""
    empty = F.lit("{}") if properties is None else F.coalesce(F.to_json(properties), F.lit("{}"))
    return F.concat(F.lit('{"type":"Feature","properties":'), empty, F.lit(',"geometry":'), F.coalesce(as_geojson(s), F.lit("null")), F.lit("}"))


def _firsts(rings: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(rings)), lambda k: F.aggregate(F.slice(rings, F.lit(1), k - 1), F.lit(0), lambda n, r: n + F.size(r)))


def _from_rings(rings: Column, make) -> Column:
    flat = F.flatten(rings)
    made = make(_firsts(rings), F.transform(flat, lambda p: F.get(p, F.lit(0))), F.transform(flat, lambda p: F.get(p, F.lit(1))))
    return F.when(F.size(rings) > 0, made)


def shapes_of(kind: Column | str, coordinates: Column | str) -> Column:
    """array<struct<point, polyline, polygon>> of a geometry's type and coordinates (JSON text). Other types give an empty array."""
    kind, text = as_column(kind), as_column(coordinates)
    none = F.lit(None)
    flat = F.from_json(text, "array<double>")
    line = F.from_json(text, "array<array<double>>")
    rings = F.from_json(text, "array<array<array<double>>>")
    many = F.from_json(text, "array<array<array<array<double>>>>")
    nothing = _from_rings(rings, polyline)  # only for its type

    def one(p=None, q=None, r=None) -> Column:
        blank_point, blank = F.when(F.lit(False), point_or_null(0.0, 0.0)), F.when(F.lit(False), nothing)
        return F.struct((p if p is not None else blank_point).alias("point"), (q if q is not None else blank).alias("polyline"), (r if r is not None else blank).alias("polygon"))

    return (
        F.when(kind == "Point", F.array(one(p=point_or_null(F.get(flat, F.lit(0)), F.get(flat, F.lit(1))))))
        .when(kind == "MultiPoint", F.transform(line, lambda c: one(p=point_or_null(F.get(c, F.lit(0)), F.get(c, F.lit(1))))))
        .when(kind == "LineString", F.array(one(q=_from_rings(F.array(line), polyline))))
        .when(kind.isin("MultiLineString", "Polyline"), F.array(one(q=_from_rings(rings, polyline))))
        .when(kind == "Polygon", F.array(one(r=_from_rings(rings, polygon))))
        .when(kind == "MultiPolygon", F.transform(many, lambda m: one(r=_from_rings(m, polygon))))
        .otherwise(none)
    )


_JSON = "struct<xcoordinates:array<double>,ycoordinates:array<double>,rings:array<int>,boundingBox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>"


def polygon_from_json(text: Column | str) -> Column:
    """A polygon of {xcoordinates, ycoordinates, rings, boundingBox}; the box is computed anew."""
    j = F.from_json(as_column(text), _JSON)
    return polygon(j["rings"], j["xcoordinates"], j["ycoordinates"])


def polygon_to_json(s: Shape) -> Column:
    box = F.struct(*[s[n].alias(n) for n in ("xmin", "ymin", "xmax", "ymax")])
    return F.when(s.col.isNotNull(), F.to_json(F.struct(s["xcoordinates"].alias("xcoordinates"), s["ycoordinates"].alias("ycoordinates"), s["indices"].alias("rings"), box.alias("boundingBox"))))
