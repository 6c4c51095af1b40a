"""Well-known text of points, line strings and polygons, parsed by built-in string functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .shapes import Shape, as_column, point, polygon, polyline

_NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
_PAIR = rf"{_NUMBER}\s+{_NUMBER}"
_LIST = rf"\(\s*{_PAIR}(?:\s*,\s*{_PAIR})*\s*\)"
_POINT = rf"^\s*POINT\s*\(\s*({_NUMBER})\s+({_NUMBER})\s*\)\s*$"
_LINE = rf"^\s*LINESTRING\s*{_LIST}\s*$"
_POLYGON = rf"^\s*POLYGON\s*\(\s*{_LIST}(?:\s*,\s*{_LIST})*\s*\)\s*$"
_EMPTY = r"^\s*(?:POINT|LINESTRING|POLYGON)\s+EMPTY\s*$"


def _numbers(part: Column) -> Column:
    return F.transform(F.regexp_extract_all(part, F.lit(rf"({_NUMBER})"), F.lit(1)), lambda v: v.cast("double"))


def _every_second(values: Column, first: int) -> Column:
    return F.filter(values, lambda v, i: i % 2 == first)


def try_wkt(text: Column | str) -> Column:
    """struct<point, polyline, polygon> with one field set; text that isn't WKT, and EMPTY, gives null fields."""
    t = as_column(text)
    x, y = (F.regexp_extract(t, _POINT, i) for i in (1, 2))
    is_point, is_line, is_polygon = t.rlike(_POINT), t.rlike(_LINE), t.rlike(_POLYGON)
    rings = F.transform(F.regexp_extract_all(t, F.lit(r"\(([^()]+)\)"), F.lit(1)), _numbers)
    flat = F.flatten(rings)
    # First vertex of each ring: vertices in the rings before it.
    firsts = F.transform(F.sequence(F.lit(1), F.size(rings)), lambda k: F.aggregate(F.slice(rings, F.lit(1), k - 1), F.lit(0), lambda n, r: n + (F.size(r) / 2).cast("int")))
    return F.struct(
        F.when(is_point, point(F.when(is_point, x).cast("double"), F.when(is_point, y).cast("double"))).alias("point"),
        F.when(is_line, polyline(F.array(F.lit(0)), _every_second(_numbers(t), 0), _every_second(_numbers(t), 1))).alias("polyline"),
        F.when(is_polygon, polygon(firsts, _every_second(flat, 0), _every_second(flat, 1))).alias("polygon"),
    )


def wkt(text: Column | str) -> Column:
    """As try_wkt, but text that isn't WKT fails the query. Null stays null."""
    t = as_column(text)
    ok = t.isNull() | t.rlike(_POINT) | t.rlike(_LINE) | t.rlike(_POLYGON) | t.rlike(_EMPTY)
    return F.when(t.isNotNull() & F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("not well-known text: "), t)).cast("boolean")), try_wkt(t))


def _pair(x: Column, y: Column) -> Column:
    return F.concat_ws(" ", x.cast("string"), y.cast("string"))


def as_wkt(s: Shape) -> Column:
    """Text of a shape; parts of a polyline become a MULTILINESTRING."""
    if s.kind == "point":
        return F.concat(F.lit("POINT ("), _pair(s["x"], s["y"]), F.lit(")"))
    listed = F.transform(s.vertices, lambda v: _pair(v["x"], v["y"]))
    if s.kind == "line":
        return F.concat(F.lit("LINESTRING ("), F.array_join(listed, ", "), F.lit(")"))
    first, n = s["indices"], F.size(s["xcoordinates"])
    rings = F.transform(first, lambda a, i: F.concat(F.lit("("), F.array_join(F.slice(listed, a + 1, F.coalesce(F.get(first, i + 1), n) - a), ", "), F.lit(")")))
    body = F.array_join(rings, ", ")
    return F.when(s.is_polygon, F.concat(F.lit("POLYGON ("), body, F.lit(")"))).when(F.size(first) == 1, F.concat(F.lit("LINESTRING "), body)).otherwise(F.concat(F.lit("MULTILINESTRING ("), body, F.lit(")")))
