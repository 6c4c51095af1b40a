"""Planar buffers: the polygon of all points at most a distance from a shape.

A point's buffer is a regular polygon and a segment's two sides and two half turns, Column expressions of any size. For
polylines and polygons the outline is the level line of the distance field around the shape, traced on a grid in an Arrow
UDF: rings come out closed, and holes and separate parts as rings of their own. Its error is below the cube of a grid step
over the distance. A shape so long for its distance that the grid would outgrow MOST_POINTS at LEAST_STEPS to the distance
is an error.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .shapes import MULTI_TYPE, Shape, bound, point, polygon


def point_buffer(s: Shape, distance: float, sides: int = 64) -> Column:
    turns = F.sequence(F.lit(0), F.lit(sides))
    # The last vertex repeats the first exactly.
    xs = F.transform(turns, lambda i: s["x"] + distance * F.cos(-(i % sides) * (2 * math.pi / sides)))
    ys = F.transform(turns, lambda i: s["y"] + distance * F.sin(-(i % sides) * (2 * math.pi / sides)))
    return F.when(s.col.isNotNull(), polygon(F.array(F.lit(0)), xs, ys))


def segment_buffer(s: Shape, distance: float, sides: int = 64) -> Column:
    """A half turn around the end, another around the start, and the sides between them."""
    c, half = s.col, max(1, sides // 2)
    # Two half turns of half + 1 vertices each; the last vertex repeats the first. What doesn't depend on the row is a literal.
    turns = [(j > half, (j - 1 if j > half else j) * (math.pi / half)) for j in range(2 * half + 2)]
    places = F.array(*[F.struct(F.lit(second).alias("second"), F.lit(turn).alias("turn")) for second, turn in [*turns, turns[0]]])

    def around(start: str, end: str, turn: Callable[[Column], Column]) -> Column:
        row = F.struct((F.atan2(c["endY"] - c["startY"], c["endX"] - c["startX"]) - math.pi / 2).alias("base"), c[start].alias("start"), c[end].alias("end"))
        return bound(row, lambda m: F.transform(places, lambda v: F.when(v["second"], m["start"]).otherwise(m["end"]) + distance * turn(m["base"] + v["turn"])))

    return F.when(c.isNotNull(), polygon(F.array(F.lit(0)), around("startX", "endX", F.cos), around("startY", "endY", F.sin)))


#: Points of the grid around one shape, and its steps to the distance where it has to be coarser than asked for.
MOST_POINTS, LEAST_STEPS = 4_000_000, 4


def _edges(indices: list[int], xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    keep = np.ones(max(1, len(xs) - 1), bool)
    for i in indices[1:]:
        keep[i - 1] = False
    a = np.arange(len(keep))[keep]
    b = np.minimum(a + 1, len(xs) - 1)
    return np.stack([xs[a], ys[a], xs[b], ys[b]], 1)


def distance_field(gx: np.ndarray, gy: np.ndarray, edges: np.ndarray, area: bool) -> np.ndarray:
    """Distance of grid points to the edges; with `area`, 0 inside the rings (odd crossings)."""
    best = np.full(gx.shape, np.inf)
    odd = np.zeros(gx.shape, bool)
    for x0, y0, x1, y1 in edges:
        dx, dy = x1 - x0, y1 - y0
        size = dx * dx + dy * dy
        t = np.clip(((gx - x0) * dx + (gy - y0) * dy) / size, 0, 1) if size else 0.0
        best = np.minimum(best, (gx - x0 - t * dx) ** 2 + (gy - y0 - t * dy) ** 2)
        if area and dx:
            odd ^= ((x0 <= gx) & (gx < x1) | (x1 <= gx) & (gx < x0)) & (gy < dy / dx * (gx - x0) + y0)
    return np.where(odd, 0.0, np.sqrt(best))


def level_rings(x: np.ndarray, y: np.ndarray, field: np.ndarray, level: float) -> list[list[tuple[float, float]]]:
    """Closed rings where a field crosses a level; the field is above it all along the grid's rim."""
    low = field <= level

    def cut(i: int, j: int, k: int, m: int) -> tuple[float, float]:
        a, b = field[i, j], field[k, m]
        t = (level - a) / (b - a)
        return x[i] + t * (x[k] - x[i]), y[j] + t * (y[m] - y[j])

    links: dict[tuple, list[tuple]] = {}
    mixed = low[:-1, :-1].astype(int) + low[1:, :-1] + low[1:, 1:] + low[:-1, 1:]
    for i, j in zip(*np.nonzero((mixed > 0) & (mixed < 4))):
        corners = [(i, j), (i + 1, j), (i + 1, j + 1), (i, j + 1)]
        sides = [tuple(sorted((corners[n], corners[(n + 1) % 4]))) for n in range(4) if low[corners[n]] != low[corners[(n + 1) % 4]]]
        if len(sides) == 4 and low[corners[0]] == (field[i : i + 2, j : j + 2].mean() <= level):
            sides = [sides[0], sides[1], sides[2], sides[3]]
        elif len(sides) == 4:
            sides = [sides[3], sides[0], sides[1], sides[2]]
        for a, b in zip(sides[::2], sides[1::2]):
            links.setdefault(a, []).append(b)
            links.setdefault(b, []).append(a)
    rings, seen = [], set()
    for first in links:
        if first in seen:
            continue
        path, before, at = [], None, first
        while at not in seen:
            seen.add(at)
            path.append(cut(*at[0], *at[1]))
            onward = [n for n in links[at] if n != before] or links[at]
            before, at = at, onward[0] if onward[0] not in seen else onward[-1]
        rings.append([*path, path[0]])
    return rings


def outline(indices: list[int], xs: list[float], ys: list[float], area: bool, distance: float, steps: int) -> dict | None:
    px, py = np.array(xs, float), np.array(ys, float)
    if not len(px) or distance <= 0:
        return None
    step = distance / steps
    x = np.arange(px.min() - distance - 2 * step, px.max() + distance + 3 * step, step)
    y = np.arange(py.min() - distance - 2 * step, py.max() + distance + 3 * step, step)
    if len(x) * len(y) > MOST_POINTS:  # a large shape: a coarser grid, of bounded size
        f = math.sqrt(len(x) * len(y) / MOST_POINTS)
        if steps / f < LEAST_STEPS:
            raise ValueError(f"a shape of {px.max() - px.min():g} by {py.max() - py.min():g} is too long for a buffer of {distance:g}: split it, or buffer its segments")
        x, y = np.linspace(x[0], x[-1], max(3, int(len(x) / f))), np.linspace(y[0], y[-1], max(3, int(len(y) / f)))
    field = distance_field(x[:, None] + 0 * y[None, :], 0 * x[:, None] + y[None, :], _edges(list(indices), px, py), area)
    rings = level_rings(x, y, field, distance)
    firsts = np.cumsum([0] + [len(r) for r in rings[:-1]]).tolist()
    ox, oy = [float(p[0]) for r in rings for p in r], [float(p[1]) for r in rings for p in r]
    return {"type": 5, "xmin": min(ox), "ymin": min(oy), "xmax": max(ox), "ymax": max(oy), "indices": firsts, "xcoordinates": ox, "ycoordinates": oy}


def buffer(s: Shape, distance: float, steps: int = 24) -> Column:
    """The buffer polygon of a shape. steps: grid steps to the distance (of a point: a sixteenth turn has so many sides / 6)."""
    if distance <= 0:
        raise ValueError("a buffer's distance is positive")
    if s.kind == "point":
        return point_buffer(s, distance, 4 * steps)
    if s.kind == "line":
        return segment_buffer(s, distance, 4 * steps)
    c = s.col

    @F.pandas_udf(MULTI_TYPE)
    def traced(kinds: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fields = ["type", "xmin", "ymin", "xmax", "ymax", "indices", "xcoordinates", "ycoordinates"]
        for shapes in kinds:
            rows = [None if pd.isna(r.type) else outline(r.indices, r.xcoordinates, r.ycoordinates, r.type == 5, distance, steps) for r in shapes.itertuples()]
            yield pd.DataFrame({f: pd.Series([r[f] if r else None for r in rows], dtype="object" if f in fields[5:] else None) for f in fields})

    made = traced(F.struct(c["type"].alias("type"), c["indices"].alias("indices"), c["xcoordinates"].alias("xcoordinates"), c["ycoordinates"].alias("ycoordinates")))
    return F.when(c.isNotNull(), made)


def circle(x: float, y: float, radius: float) -> Column:
    """A disc's polygon as a literal."""
    return point_buffer(Shape(point(x, y), "point"), radius)
