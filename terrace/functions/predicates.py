"""Containment, intersection and range predicates between shapes, as Column expressions.

Everything reduces to orientation tests on edges. Semantics: a polygon contains its strict interior, over all rings by
exclusive or; a point intersects a polygon on its boundary only; a segment intersects a polygon if it meets an edge or,
unless strict, has an end inside. Tests of bounding boxes come first. Null shapes give null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .shapes import POLYGON, Box, Shape, as_column


def area(ax, ay, bx, by, cx, cy) -> Column:
    """Doubled area of a triangle, signed by its orientation; exact comparisons, no tolerance."""
    return (cy - ay) * (bx - ax) - (by - ay) * (cx - ax)


def on_edge(e: Column, x: Column, y: Column) -> Column:
    between = (x >= F.least(e["x0"], e["x1"])) & (x <= F.greatest(e["x0"], e["x1"])) & (y >= F.least(e["y0"], e["y1"])) & (y <= F.greatest(e["y0"], e["y1"]))
    return between & (area(e["x0"], e["y0"], e["x1"], e["y1"], x, y) == 0)


def crosses_above(e: Column, x: Column, y: Column) -> Column:
    """Whether the upward ray from (x, y) crosses an edge; upright edges are never crossed."""
    span = ((e["x0"] <= x) & (x < e["x1"])) | ((e["x1"] <= x) & (x < e["x0"]))
    return span & (y < F.try_divide(e["y1"] - e["y0"], e["x1"] - e["x0"]) * (x - e["x0"]) + e["y0"])


def edges_meet(e: Column, f: Column) -> Column:
    """Two segments share a point: an end of one lies on the other, or each parts the other's ends."""
    touch = on_edge(e, f["x0"], f["y0"]) | on_edge(e, f["x1"], f["y1"]) | on_edge(f, e["x0"], e["y0"]) | on_edge(f, e["x1"], e["y1"])

    def left(g: Column, x, y) -> Column:
        return area(g["x0"], g["y0"], g["x1"], g["y1"], x, y) > 0

    return touch | ((left(f, e["x0"], e["y0"]) != left(f, e["x1"], e["y1"])) & (left(e, f["x0"], f["y0"]) != left(e, f["x1"], f["y1"])))


def inside(edges: Column, x: Column, y: Column) -> Column:
    """Strictly inside rings: on no edge, and an odd number of edges above."""
    return ~F.exists(edges, lambda e: on_edge(e, x, y)) & (F.size(F.filter(edges, lambda e: crosses_above(e, x, y))) % 2 == 1)


def boxes_overlap(a: Shape, b: Shape) -> Column:
    """Closed bounding boxes share a point."""
    return (a["xmin"] <= b["xmax"]) & (b["xmin"] <= a["xmax"]) & (a["ymin"] <= b["ymax"]) & (b["ymin"] <= a["ymax"])


def box_contains(a: Shape, b: Shape) -> Column:
    return (a["xmin"] <= b["xmin"]) & (a["ymin"] <= b["ymin"]) & (a["xmax"] >= b["xmax"]) & (a["ymax"] >= b["ymax"])


def _any_vertex_inside(item: Shape, container: Shape) -> Column:
    return F.exists(item.vertices, lambda v: inside(container.edges, v["x"], v["y"]))


def intersects(a: Shape, b: Shape, strict: bool = False) -> Column:
    """a and b share a point. strict: edges must meet; lying inside isn't enough."""
    gate = boxes_overlap(a, b)
    if a.kind == b.kind == "point":
        return gate
    if a.kind == "point" or b.kind == "point":
        p, other = (a, b) if a.kind == "point" else (b, a)
        return gate & F.exists(other.edges, lambda e: on_edge(e, p["x"], p["y"]))
    met = F.exists(a.edges, lambda e: F.exists(b.edges, lambda f: edges_meet(e, f)))
    if not strict:
        for container, item in ((a, b), (b, a)):
            if container.kind == "multi":
                met = met | (container.is_polygon & _any_vertex_inside(item, container))
    return gate & met


def contains(a: Shape, b: Shape) -> Column:
    """a contains b: points of a polygon's boundary are not contained; segments and polylines contain what lies on them."""
    gate = box_contains(a, b)
    if a.kind == "point":
        return gate & boxes_overlap(a, b) if b.kind == "point" else F.when(a.col.isNull() | b.col.isNull(), F.lit(None)).otherwise(F.lit(False))
    covered = F.forall(b.edges, lambda f: F.exists(a.edges, lambda e: on_edge(e, f["x0"], f["y0"]) & on_edge(e, f["x1"], f["y1"])))
    if b.kind == "point":
        covered = F.exists(a.edges, lambda e: on_edge(e, b["x"], b["y"]))
    if a.kind == "line":
        return gate & covered
    if b.kind == "point":
        within_rings = inside(a.edges, b["x"], b["y"])
    else:
        within_rings = F.forall(b.vertices, lambda v: inside(a.edges, v["x"], v["y"]))
        within_rings = within_rings & ~F.exists(b.edges, lambda f: F.exists(a.edges, lambda e: edges_meet(e, f)))
        if b.kind == "multi":  # no hole of a inside b
            within_rings = within_rings & ~(b.is_polygon & F.exists(a.vertices, lambda v: inside(b.edges, v["x"], v["y"])))
    return gate & F.when(a.is_polygon, within_rings).otherwise(covered)


def within(a: Shape, b: Shape) -> Column:
    return contains(b, a)


def within_each(ps: list[Shape], s: Shape) -> Column:
    """array<boolean>: `within` of each of several points and one polyline or polygon, by the same arithmetic in numpy.

    An Arrow function, for shapes made row by row with many edges, where a lambda for each edge is slow. Not for conditions
    of outer joins or within lambdas, where Spark takes no Python.
    """
    each = len(ps)

    @F.arrow_udf("array<boolean>")
    def tested(kind: pa.Array, indices: pa.Array, xs: pa.Array, ys: pa.Array, px: pa.Array, py: pa.Array) -> pa.Array:
        n = len(kind)
        size, parts = (np.asarray(pc.fill_null(pc.list_value_length(v), 0)) for v in (xs, indices))
        x, y, first = (v.flatten().to_numpy(zero_copy_only=False) for v in (xs, ys, indices))
        begin, row = np.cumsum(size) - size, np.repeat(np.arange(n), size)
        last = begin + size - 1
        keep = np.ones(len(x), bool)
        keep[last[size > 1]] = False
        starts = begin[np.repeat(np.arange(n), parts)] + first
        keep[starts[first > 0] - 1] = False
        a = np.flatnonzero(keep)
        r = row[a]
        b = np.minimum(a + 1, last[r])
        x0, y0, x1, y1 = x[a], y[a], x[b], y[b]
        left, right, low, high = np.minimum(x0, x1), np.maximum(x0, x1), np.minimum(y0, y1), np.maximum(y0, y1)
        area_of = np.asarray(pc.fill_null(kind, 0)) == POLYGON
        at_x, at_y = (v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, each) for v in (px, py))
        out = np.zeros((n, each), bool)
        with np.errstate(divide="ignore", invalid="ignore"):
            slope = (y1 - y0) / (x1 - x0)
            for k in range(each):
                u, v = at_x[r, k], at_y[r, k]
                on = (u >= left) & (u <= right) & (v >= low) & (v <= high) & ((v - y0) * (x1 - x0) - (y1 - y0) * (u - x0) == 0)
                above = ((x0 <= u) & (u < x1) | (x1 <= u) & (u < x0)) & (v < slope * (u - x0) + y0)
                touched, odd = np.bincount(r, on, n) > 0, np.bincount(r, above, n) % 2 == 1
                out[:, k] = np.where(area_of, odd & ~touched, touched)
        offsets = pa.array(np.arange(n + 1, dtype=np.int32) * each, mask=np.append(np.asarray(pc.is_null(kind)), False))
        return pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))

    c = s.col
    found = tested(c["type"], c["indices"], c["xcoordinates"], c["ycoordinates"], F.array(*[p["x"] for p in ps]), F.array(*[p["y"] for p in ps]))
    return F.zip_with(F.array(*[box_contains(s, p) for p in ps]), found, lambda gate, hit: gate & hit)


def covers(a: Shape, b: Shape) -> Column:
    """A point inside a polygon or on its boundary; otherwise as contains."""
    if b.kind == "point" and a.kind == "multi":
        return box_contains(a, b) & (F.exists(a.edges, lambda e: on_edge(e, b["x"], b["y"])) | (a.is_polygon & inside(a.edges, b["x"], b["y"])))
    return contains(a, b)


def touches(a: Shape, b: Shape) -> Column:
    """A point on the boundary of a polygon or at an end of a part of a line; other shapes: they meet, and neither reaches the other's inside.

    Between two polygons: edges meet, no vertex of either lies inside the other, and no two edges properly cross.
    """
    if a.kind == "point" or b.kind == "point":
        p, other = (a, b) if a.kind == "point" else (b, a)
        if other.kind == "point":
            return boxes_overlap(a, b) & F.lit(False)
        ends = F.exists(other.ends, lambda v: (v["x"] == p["x"]) & (v["y"] == p["y"]))
        return F.when(other.is_polygon, intersects(a, b)).otherwise(ends)

    def left(g: Column, x, y) -> Column:
        return F.signum(area(g["x0"], g["y0"], g["x1"], g["y1"], x, y))

    def crossed(e: Column, f: Column) -> Column:
        return (left(f, e["x0"], e["y0"]) * left(f, e["x1"], e["y1"]) < 0) & (left(e, f["x0"], f["y0"]) * left(e, f["x1"], f["y1"]) < 0)

    within_other = F.lit(False)
    for container, item in ((a, b), (b, a)):
        if container.kind == "multi":
            within_other = within_other | (container.is_polygon & _any_vertex_inside(item, container))
    return intersects(a, b, strict=True) & ~within_other & ~F.exists(a.edges, lambda e: F.exists(b.edges, lambda f: crossed(e, f)))


def disjoint(a: Shape, b: Shape) -> Column:
    """Neither meets nor lies in the other."""
    apart = ~intersects(a, b)
    for x, y in ((a, b), (b, a)):
        if x.kind == "point" and y.kind == "multi":
            apart = apart & ~contains(y, x)
    return apart


def within_box(s: Shape, box: Box) -> Column:
    """The shape's bounding box lies in a closed box: four comparisons, which reach Parquet scans over plain columns."""
    return (s["xmin"] >= box.xmin) & (s["ymin"] >= box.ymin) & (s["xmax"] <= box.xmax) & (s["ymax"] <= box.ymax)


def within_circle(s: Shape, x: float, y: float, radius: float) -> Column:
    """The shape's bounding box lies in a closed disc. The disc's own box is tested first, so scans can skip."""

    def far(a: Column, b: Column) -> Column:
        return (a - x) * (a - x) + (b - y) * (b - y)

    corners = [("xmin", "ymin")] if s.kind == "point" else [(a, b) for a in ("xmin", "xmax") for b in ("ymin", "ymax")]
    out = within_box(s, Box(x - radius, y - radius, x + radius, y + radius))
    for a, b in corners:
        out = out & (far(s[a], s[b]) <= radius * radius)
    return out


def within_distance(a: Shape, b: Shape, distance: float | Column) -> Column:
    """Two points at most `distance` apart."""
    d = as_column(distance)
    dx, dy = a["x"] - b["x"], a["y"] - b["y"]
    return dx * dx + dy * dy <= d * d
