"""SQL names for the functions: temporary SQL functions, which Spark inlines, so filters still reach scans."""

from __future__ import annotations

from pyspark.sql import SparkSession

_P = "STRUCT<type: INT, xmin: DOUBLE, ymin: DOUBLE, xmax: DOUBLE, ymax: DOUBLE, x: DOUBLE, y: DOUBLE>"
_M = "STRUCT<type: INT, xmin: DOUBLE, ymin: DOUBLE, xmax: DOUBLE, ymax: DOUBLE, indices: ARRAY<INT>, xcoordinates: ARRAY<DOUBLE>, ycoordinates: ARRAY<DOUBLE>>"
_EDGES = "transform(filter(sequence(0, greatest(size(g.xcoordinates) - 2, 0)), i -> size(g.xcoordinates) > 1 AND NOT array_contains(g.indices, i + 1)), i -> named_struct('x0', get(g.xcoordinates, i), 'y0', get(g.ycoordinates, i), 'x1', get(g.xcoordinates, i + 1), 'y1', get(g.ycoordinates, i + 1)))"
_ON = "(p.x BETWEEN least(e.x0, e.x1) AND greatest(e.x0, e.x1) AND p.y BETWEEN least(e.y0, e.y1) AND greatest(e.y0, e.y1) AND (p.y - e.y0) * (e.x1 - e.x0) - (e.y1 - e.y0) * (p.x - e.x0) = 0)"
_ABOVE = "(((e.x0 <= p.x AND p.x < e.x1) OR (e.x1 <= p.x AND p.x < e.x0)) AND p.y < try_divide(e.y1 - e.y0, e.x1 - e.x0) * (p.x - e.x0) + e.y0)"
_GATE = "g.xmin <= p.x AND p.x <= g.xmax AND g.ymin <= p.y AND p.y <= g.ymax"

FUNCTIONS = {
    "st_point": f"(x DOUBLE, y DOUBLE) RETURNS {_P} RETURN named_struct('type', 1, 'xmin', x, 'ymin', y, 'xmax', x, 'ymax', y, 'x', x, 'y', y)",
    "st_polygon": f"(indices ARRAY<INT>, xs ARRAY<DOUBLE>, ys ARRAY<DOUBLE>) RETURNS {_M} RETURN named_struct('type', 5, 'xmin', array_min(xs), 'ymin', array_min(ys), 'xmax', array_max(xs), 'ymax', array_max(ys), 'indices', indices, 'xcoordinates', xs, 'ycoordinates', ys)",
    "st_polyline": f"(indices ARRAY<INT>, xs ARRAY<DOUBLE>, ys ARRAY<DOUBLE>) RETURNS {_M} RETURN named_struct('type', 3, 'xmin', array_min(xs), 'ymin', array_min(ys), 'xmax', array_max(xs), 'ymax', array_max(ys), 'indices', indices, 'xcoordinates', xs, 'ycoordinates', ys)",
    "st_within": f"(p {_P}, g {_M}) RETURNS BOOLEAN RETURN {_GATE} AND g.type = 5 AND NOT exists({_EDGES}, e -> {_ON}) AND size(filter({_EDGES}, e -> {_ABOVE})) % 2 = 1",
    "st_onboundary": f"(p {_P}, g {_M}) RETURNS BOOLEAN RETURN {_GATE} AND exists({_EDGES}, e -> {_ON})",
    "st_inbox": f"(p {_P}, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE) RETURNS BOOLEAN RETURN p.x >= x0 AND p.x <= x1 AND p.y >= y0 AND p.y <= y1",
    "st_incircle": f"(p {_P}, x DOUBLE, y DOUBLE, r DOUBLE) RETURNS BOOLEAN RETURN p.x >= x - r AND p.x <= x + r AND p.y >= y - r AND p.y <= y + r AND (p.x - x) * (p.x - x) + (p.y - y) * (p.y - y) <= r * r",
}


def register(spark: SparkSession) -> list[str]:
    """Creates the functions in the session and returns their names."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(FUNCTIONS)
