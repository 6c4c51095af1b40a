"""Planar shapes as plain structs: constructors, accessors and edges as Column expressions.

A point is struct<type, xmin, ymin, xmax, ymax, x, y>, a segment has startX, startY, endX, endY instead of x, y, and
polylines and polygons have indices (first vertex of each part or ring), xcoordinates and ycoordinates. Field access on
structs is folded away by Catalyst, so range filters over points reach Parquet scans. A null shape is SQL NULL.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT, LINE, POLYLINE, POLYGON = 1, 2, 3, 5
_BOX = "type int, xmin double, ymin double, xmax double, ymax double"
POINT_TYPE = f"struct<{_BOX}, x double, y double>".replace(" int", ":int").replace(" double", ":double")
LINE_TYPE = f"struct<{_BOX}, startX double, startY double, endX double, endY double>".replace(" int", ":int").replace(" double", ":double")
MULTI_TYPE = f"struct<{_BOX}, indices array<int>, xcoordinates array<double>, ycoordinates array<double>>".replace(" int,", ":int,").replace(" double", ":double").replace(" array", ":array")


def as_column(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


@dataclass(frozen=True)
class Box:
    """An axis-parallel rectangle, a literal."""

    xmin: float
    ymin: float
    xmax: float
    ymax: float

    def __post_init__(self):
        if self.xmin > self.xmax or self.ymin > self.ymax:
            raise ValueError("a box's least coordinates come first")

    def contains(self, other: Box) -> bool:
        return self.xmin <= other.xmin and self.ymin <= other.ymin and self.xmax >= other.xmax and self.ymax >= other.ymax

    def contains_point(self, x: float, y: float) -> bool:
        return self.xmin <= x <= self.xmax and self.ymin <= y <= self.ymax

    def disjoint(self, other: Box) -> bool:
        """Boxes that touch aren't disjoint."""
        return self.xmin > other.xmax or other.xmin > self.xmax or self.ymin > other.ymax or other.ymin > self.ymax

    def intersects(self, other: Box) -> bool:
        """Boxes that only touch don't intersect."""
        return self.xmin < other.xmax and other.xmin < self.xmax and self.ymin < other.ymax and other.ymin < self.ymax

    def within_circle(self, x: float, y: float, radius: float) -> bool:
        return all((a - x) ** 2 + (b - y) ** 2 <= radius**2 for a in (self.xmin, self.xmax) for b in (self.ymin, self.ymax))


WORLD = Box(-180.0, -90.0, 180.0, 90.0)


def _struct(tag: int, xmin, ymin, xmax, ymax, **fields: Column) -> Column:
    box = {"type": F.lit(tag), "xmin": xmin, "ymin": ymin, "xmax": xmax, "ymax": ymax}
    return F.struct(*[c.alias(n) for n, c in (box | fields).items()])


def point(x: Column | str | float, y: Column | str | float) -> Column:
    """A point. Nothing stands between a filter on it and the columns it is made of, so filters reach the scan.

    With a null coordinate every predicate is null, as with a null point.
    """
    return raw_point(as_column(x).cast("double"), as_column(y).cast("double"))


def point_or_null(x: Column | str | float, y: Column | str | float) -> Column:
    """A point; null if a coordinate is null."""
    x, y = as_column(x).cast("double"), as_column(y).cast("double")
    return F.when(x.isNotNull() & y.isNotNull(), raw_point(x, y))


def raw_point(x: Column, y: Column) -> Column:
    return _struct(POINT, x, y, x, y, x=x, y=y)


def line(start_x, start_y, end_x, end_y) -> Column:
    a, b, c, d = (as_column(v).cast("double") for v in (start_x, start_y, end_x, end_y))
    return _struct(LINE, F.least(a, c), F.least(b, d), F.greatest(a, c), F.greatest(b, d), startX=a, startY=b, endX=c, endY=d)


def _multi(tag: int, indices: Column | str, xs: Column | str, ys: Column | str) -> Column:
    i, x, y = as_column(indices).cast("array<int>"), as_column(xs).cast("array<double>"), as_column(ys).cast("array<double>")

    def made(m: Column) -> Column:
        x, y = m["x"], m["y"]
        return F.when(F.size(x) > 0, _struct(tag, F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y), indices=m["i"], xcoordinates=x, ycoordinates=y))

    # Bound, so that coordinates that are long to make are made once and not again for the box.
    return bound(F.struct(i.alias("i"), x.alias("x"), y.alias("y")), made)


def polyline(indices, xs, ys) -> Column:
    """A polyline; null without a vertex."""
    return _multi(POLYLINE, indices, xs, ys)


def polygon(indices, xs, ys) -> Column:
    """A polygon of closed rings (first vertex repeated); null without a vertex. Several rings combine by exclusive or."""
    return _multi(POLYGON, indices, xs, ys)


def ring(*vertices: tuple) -> Column:
    """A polygon of one closed ring."""
    x, y = zip(*vertices)
    return polygon(F.array(F.lit(0)), F.array(*[as_column(v).cast("double") for v in x]), F.array(*[as_column(v).cast("double") for v in y]))


def box_polygon(xmin, ymin, xmax, ymax) -> Column:
    return ring((xmin, ymin), (xmin, ymax), (xmax, ymax), (xmax, ymin), (xmin, ymin))


@dataclass(frozen=True)
class Shape:
    """A shape column and what it holds: "point", "line" or "multi" (polylines and polygons, told apart by their tag)."""

    col: Column
    kind: str
    made_edges: Column | None = None  # a column of the edges, where they are made already

    @staticmethod
    def of(df: DataFrame, name: str) -> Shape:
        """Kind from the schema. A qualified name is looked up by its last part."""
        kind = df.schema[name.rsplit(".", 1)[-1]].dataType
        fields = set(kind.fieldNames()) if isinstance(kind, T.StructType) else set()
        for field, found in (("indices", "multi"), ("startX", "line"), ("x", "point")):
            if field in fields:
                return Shape(F.col(name), found)
        raise TypeError(f"{name} isn't a shape column")

    def __getitem__(self, field: str) -> Column:
        return self.col[field]

    @property
    def box(self) -> tuple[Column, Column, Column, Column]:
        return tuple(self.col[n] for n in ("xmin", "ymin", "xmax", "ymax"))

    @property
    def edges(self) -> Column:
        """array<struct<x0, y0, x1, y1>>; parts and rings aren't joined. A point has none."""
        return edges(self) if self.made_edges is None else self.made_edges

    @property
    def vertices(self) -> Column:
        """array<struct<x, y>>"""
        c = self.col
        if self.kind == "point":
            return F.array(F.struct(c["x"].alias("x"), c["y"].alias("y")))
        if self.kind == "line":
            return F.array(*[F.struct(c[f"{e}X"].alias("x"), c[f"{e}Y"].alias("y")) for e in ("start", "end")])
        return F.zip_with(c["xcoordinates"], c["ycoordinates"], lambda x, y: F.struct(x.alias("x"), y.alias("y")))

    @property
    def ends(self) -> Column:
        """array<struct<x, y>>: first and last vertex of a segment, or of each part."""
        if self.kind != "multi":
            return self.vertices
        first, n = self.col["indices"], F.size(self.col["xcoordinates"])
        places = F.concat(first, F.transform(first, lambda a, i: F.coalesce(F.get(first, i + 1), n) - 1))
        return F.transform(places, lambda i: F.struct(F.get(self.col["xcoordinates"], i).alias("x"), F.get(self.col["ycoordinates"], i).alias("y")))

    @property
    def is_polygon(self) -> Column:
        return F.lit(False) if self.kind != "multi" else self.col["type"] == POLYGON


def points(name: Column | str) -> Shape:
    return Shape(as_column(name), "point")


def lines(name: Column | str) -> Shape:
    return Shape(as_column(name), "line")


def multis(name: Column | str) -> Shape:
    return Shape(as_column(name), "multi")


def bound(c: Column, made: Callable[[Column], Column]) -> Column:
    """made(c), with c evaluated once and outside of made's lambdas, where Spark allows no Python UDF (buffers are made by one)."""
    return F.get(F.transform(F.array(c), made), F.lit(0))


def edges(s: Shape) -> Column:
    c = s.col

    def edge(a, b, d, e) -> Column:
        return F.struct(a.alias("x0"), b.alias("y0"), d.alias("x1"), e.alias("y1"))

    if s.kind == "line":
        return F.array(edge(c["startX"], c["startY"], c["endX"], c["endY"]))
    if s.kind == "point":
        return F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>")

    def cut(m: Column) -> Column:
        x, y, first = m["xcoordinates"], m["ycoordinates"], m["indices"]
        n = F.size(x)
        # One vertex alone is an edge of no length, so that a polyline of one vertex can be met.
        inner = F.filter(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: (n == 1) | ~F.array_contains(first, i + 1))
        several = F.transform(inner, lambda i: edge(F.get(x, i), F.get(y, i), F.get(x, F.least(i + 1, n - 1)), F.get(y, F.least(i + 1, n - 1))))
        # One ring or part, the most frequent: each vertex with its next.
        m1 = F.greatest(n - 1, F.lit(0))
        one = F.arrays_zip(F.slice(x, 1, m1).alias("x0"), F.slice(y, 1, m1).alias("y0"), F.slice(x, 2, m1).alias("x1"), F.slice(y, 2, m1).alias("y1"))
        return F.when((F.size(first) == 1) & (n > 1), one).otherwise(several)

    return bound(c, cut)


# Accessors.


def length(s: Shape) -> Column:
    """Number of vertices."""
    return F.lit(1) if s.kind == "point" else F.lit(2) if s.kind == "line" else F.size(s["xcoordinates"])


def vertex(s: Shape, i: Column | int) -> Column:
    """The i-th vertex (from 0) as a point; null beyond the last."""
    v = F.get(s.vertices, F.lit(i) if isinstance(i, int) else i)
    return F.when(v.isNotNull(), raw_point(v["x"], v["y"]))


def num_rings(s: Shape) -> Column:
    return F.size(s["indices"])


def ring_polygon(s: Shape, i: Column | int) -> Column:
    """The i-th ring or part (from 0) on its own."""
    i = F.lit(i) if isinstance(i, int) else i
    a = F.get(s["indices"], i)
    n = F.coalesce(F.get(s["indices"], i + 1), F.size(s["xcoordinates"])) - a
    xs, ys = F.slice(s["xcoordinates"], a + 1, n), F.slice(s["ycoordinates"], a + 1, n)
    cut = _struct(POLYGON, F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys), indices=F.array(F.lit(0)), xcoordinates=xs, ycoordinates=ys)
    return F.when(a.isNotNull(), cut.withField("type", s["type"]))


def mid(s: Shape) -> Column:
    """A segment's middle."""
    return raw_point((s["startX"] + s["endX"]) / 2, (s["startY"] + s["endY"]) / 2)


def start(s: Shape) -> Column:
    return raw_point(s["startX"], s["startY"])


def end(s: Shape) -> Column:
    return raw_point(s["endX"], s["endY"])


def is_empty(s: Shape) -> Column:
    return s.col.isNull() if s.kind != "multi" else s.col.isNull() | (F.size(s["xcoordinates"]) == 0)


def is_valid(s: Shape) -> Column:
    """Not null; the rings of polygons are closed."""
    if s.kind != "multi":
        return s.col.isNotNull()

    def rings_closed(m: Column) -> Column:
        x, y, first = m["xcoordinates"], m["ycoordinates"], m["indices"]
        ends = F.concat(F.slice(first, 2, F.greatest(F.size(first) - 1, F.lit(0))), F.array(F.size(x)))
        return F.forall(F.arrays_zip(first.alias("a"), ends.alias("z")), lambda r: (F.get(x, r["a"]) == F.get(x, r["z"] - 1)) & (F.get(y, r["a"]) == F.get(y, r["z"] - 1)))

    closed = bound(s.col, rings_closed)
    return F.coalesce(s.col.isNotNull() & ((s["type"] != POLYGON) | closed), F.lit(False))


def equal_to(a: Shape, b: Shape, tolerance: float = 0.0) -> Column:
    """Same vertices in the same order, each coordinate within the tolerance."""
    pairs = F.arrays_zip(a.vertices.alias("a"), b.vertices.alias("b"))
    near = F.forall(pairs, lambda p: (F.abs(p["a"]["x"] - p["b"]["x"]) <= tolerance) & (F.abs(p["a"]["y"] - p["b"]["y"]) <= tolerance))
    return (length(a) == length(b)) & near
