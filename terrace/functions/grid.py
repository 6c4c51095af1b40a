"""A Z-order grid over the plane: cells of points, covers of shapes and how a cell relates to a shape.

A cell of precision p (a multiple of 5, at most 60) has ceil(p / 2) bits of x and floor(p / 2) of y, interleaved with x
first. `bits` holds them at the high end of a long; `key` (the same bits at the low end) is what joins use. Coordinates
beyond the world count as on its rim.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .predicates import edges_meet, inside
from .shapes import WORLD, Box, Shape, bound

#: The geohash alphabet (fixed values).
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
WITHIN, CONTAINS, INTERSECTS, DISJOINT = "Within", "Contains", "Intersects", "Disjoint"


def sizes(precision: int) -> tuple[int, int]:
    """Bits of x and of y."""
    if not 0 < precision <= 60:
        raise ValueError("a precision is from 1 to 60")
    return (precision + 1) // 2, precision // 2


def checked(precision: int) -> int:
    if precision % 5 or not 0 < precision <= 60:
        raise ValueError("an index precision is a multiple of 5 up to 60")
    return precision


def _place(v: Column, low: float, high: float, bits: int) -> Column:
    n = 1 << bits
    return F.when(v.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((v - low) / (high - low) * n))).cast("long"))


def _spread(v: Column) -> Column:
    """Puts a zero between the bits of a number below 2**31: its binary digits, read as digits to base 4.

    v occurs once. Shifts and masks take it twice a step, so 32 copies of a point's whole expression, for each coordinate.
    """
    return F.conv(F.bin(v), 4, 10).cast("long")


def key(ix: Column, iy: Column, precision: int) -> Column:
    x, y = _spread(ix), _spread(iy)
    return x.bitwiseOR(F.shiftleft(y, 1)) if precision % 2 else F.shiftleft(x, 1).bitwiseOR(y)


def point_key(x: Column, y: Column, precision: int, world: Box = WORLD) -> Column:
    nx, ny = sizes(precision)
    return key(_place(x, world.xmin, world.xmax, nx), _place(y, world.ymin, world.ymax, ny), precision)


def _cell(ix: Column, iy: Column, precision: int, world: Box) -> Column:
    nx, ny = sizes(precision)
    w, h = (world.xmax - world.xmin) / (1 << nx), (world.ymax - world.ymin) / (1 << ny)
    corner = {"xmin": ix * w + world.xmin, "ymin": iy * h + world.ymin, "xmax": (ix + 1) * w + world.xmin, "ymax": (iy + 1) * h + world.ymin}
    return F.struct(*[c.cast("double").alias(n) for n, c in corner.items()], F.lit(precision).alias("precision"), F.shiftleft(key(ix, iy, precision), 64 - precision).alias("bits"))


def point_cell(s: Shape, precision: int, world: Box = WORLD) -> Column:
    """struct<xmin, ymin, xmax, ymax, precision, bits> of the cell that holds a point."""
    nx, ny = sizes(precision)
    return F.when(s.col.isNotNull(), _cell(_place(s["x"], world.xmin, world.xmax, nx), _place(s["y"], world.ymin, world.ymax, ny), precision, world))


def _ends(s: Shape, precision: int, world: Box, rim: bool) -> list[tuple[Column, Column]]:
    """First and last column, and first and last row, of the cells that a shape's box overlaps. rim: those that hold a point of it, be it of its rim."""
    out = []
    for a, z, low, high, bits in (("xmin", "xmax", world.xmin, world.xmax, sizes(precision)[0]), ("ymin", "ymax", world.ymin, world.ymax, sizes(precision)[1])):
        first, last = _place(s[a], low, high, bits), _place(s[z], low, high, bits)
        if not rim:  # the last cell may only be touched
            last = F.when(((s[z] - low) / (high - low) * (1 << bits) == last) & (last > first), last - 1).otherwise(last)
        out.append((first, last))
    return out


def _ranges(s: Shape, precision: int, world: Box, rim: bool) -> tuple[Column, Column]:
    """Numbers of the columns and of the rows of these cells."""
    return tuple(F.sequence(*ends) for ends in _ends(s, precision, world, rim))


def cover(s: Shape, precision: int, world: Box = WORLD) -> Column:
    """Cells that a shape's bounding box overlaps; a box without area has the cells that hold it."""
    if s.kind == "point":
        return F.when(s.col.isNotNull(), F.array(point_cell(s, precision, world)))
    xs, ys = _ranges(s, precision, world, rim=False)
    return F.when(s.col.isNotNull(), F.flatten(F.transform(xs, lambda ix: F.transform(ys, lambda iy: _cell(ix, iy, precision, world)))))


def cover_keys(s: Shape, precision: int, world: Box = WORLD) -> Column:
    """Keys of all cells that hold a point of a shape's closed box: two boxes that share a point share a key."""
    if s.kind == "point":
        return F.when(s.col.isNotNull(), F.array(point_key(s["x"], s["y"], precision, world)))
    xs, ys = _ranges(s, precision, world, rim=True)
    return F.when(s.col.isNotNull(), F.flatten(F.transform(xs, lambda ix: F.transform(ys, lambda iy: key(ix, iy, precision)))))


def relate(cell: Column, s: Shape) -> Column:
    """Contains: the cell holds the shape. Within: the cell lies in the polygon. Else Intersects or Disjoint."""
    x0, y0, x1, y1 = (cell[n] for n in ("xmin", "ymin", "xmax", "ymax"))

    def edge(a, b, c, d) -> Column:
        return F.struct(a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1"))

    holds = (x0 <= s["xmin"]) & (y0 <= s["ymin"]) & (x1 >= s["xmax"]) & (y1 >= s["ymax"])
    if s.kind == "point":
        return F.when(holds, F.lit(CONTAINS)).otherwise(F.lit(DISJOINT))
    own = F.array(edge(x0, y0, x0, y1), edge(x0, y1, x1, y1), edge(x1, y1, x1, y0), edge(x1, y0, x0, y0), edge(x0, y0, x1, y1), edge(x0, y1, x1, y0))
    hit = F.exists(s.edges, lambda e: F.exists(own, lambda f: edges_meet(e, f)))
    corners = [inside(s.edges, a, b) for a in (x0, x1) for b in (y0, y1)]
    every, some = corners[0] & corners[1] & corners[2] & corners[3], corners[0] | corners[1] | corners[2] | corners[3]
    # A small hole can lie between the cell's edges and diagonals: its vertices are inside the cell then.
    hole = F.exists(s.vertices, lambda v: (v["x"] > x0) & (v["x"] < x1) & (v["y"] > y0) & (v["y"] < y1))
    polygon = s.is_polygon
    return F.when(holds, CONTAINS).when(polygon & ~hit & every & ~hole, WITHIN).when(hit | hole | (polygon & some), INTERSECTS).otherwise(DISJOINT)


#: Cells of a shape's box that one row may have; more would be one array of too many keys.
MOST_CELLS = 1 << 24
#: Share of a cell by which a line counts as near it, so that rounding at a cell's rim does no harm.
NEAR = 1e-6


def _spans(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of whole numbers the numbers from low to high: (which pair, number)."""
    n = high - low + 1
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + low[which]


def cells_of(indices: np.ndarray, x: np.ndarray, y: np.ndarray, area: bool, columns: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Column, row and whether it lies inside of each cell that a shape meets. x, y: in cells, from the world's corner.

    Cells near an edge don't lie inside. The others lie inside or outside as a whole: their centres decide. A shape that
    leaves the world has all cells of its box, none inside, since points beyond the rim count as on it.
    """
    box = [np.clip(np.floor(np.array(v)), 0, n - 1).astype(np.int64) for v, n in (((x.min(), x.max()), columns), ((y.min(), y.max()), rows))]
    if x.min() >= NEAR and y.min() >= NEAR and x.max() <= columns - NEAR and y.max() <= rows - NEAR:
        box = [np.floor(np.array((v.min() - NEAR, v.max() + NEAR))).astype(np.int64) for v in (x, y)]
        box = [np.clip(v, 0, n - 1) for v, n in zip(box, (columns, rows))]
        outside = False
    else:
        outside = True
    (i0, i1), (j0, j1) = box
    wide, high = int(i1 - i0 + 1), int(j1 - j0 + 1)
    if wide * high > MOST_CELLS:
        raise ValueError(f"a shape's box has {wide * high} cells: choose a lower precision")
    if outside:
        i, j = np.divmod(np.arange(wide * high), high)
        return i + i0, j + j0, np.zeros(wide * high, bool)
    keep = np.ones(max(1, len(x) - 1), bool)
    keep[np.asarray(indices[1:], np.int64) - 1] = False
    a = np.flatnonzero(keep)
    b = np.minimum(a + 1, len(x) - 1)
    x0, y0, x1, y1 = x[a], y[a], x[b], y[b]
    # Columns that each edge comes near to, and the rows of its part in each.
    left, right = np.minimum(x0, x1), np.maximum(x0, x1)
    e, i = _spans(np.maximum(np.floor(left - NEAR).astype(np.int64), i0), np.minimum(np.floor(right + NEAR).astype(np.int64), i1))
    run = x1[e] - x0[e]
    with np.errstate(divide="ignore", invalid="ignore"):
        ta, tb = np.clip((i - NEAR - x0[e]) / run, 0, 1), np.clip((i + 1 + NEAR - x0[e]) / run, 0, 1)
    ta, tb = np.where(run == 0, 0.0, ta), np.where(run == 0, 1.0, tb)
    ya, yb = y0[e] + ta * (y1[e] - y0[e]), y0[e] + tb * (y1[e] - y0[e])
    k, j = _spans(np.maximum(np.floor(np.minimum(ya, yb) - NEAR).astype(np.int64), j0), np.minimum(np.floor(np.maximum(ya, yb) + NEAR).astype(np.int64), j1))
    near = np.zeros((high, wide), bool)
    near[j - j0, i[k] - i0] = True
    inside = np.zeros((high, wide), bool)
    if area:
        # Edges across the middle of each row change the side of all centres to the right.
        bottom, top = np.minimum(y0, y1), np.maximum(y0, y1)
        first, last = np.ceil(bottom - 0.5).astype(np.int64), np.ceil(top - 0.5).astype(np.int64) - 1
        some = np.flatnonzero(last >= first)
        e, j = _spans(first[some], last[some])
        e = some[e]
        cross = x0[e] + (j + 0.5 - y0[e]) / (y1[e] - y0[e]) * (x1[e] - x0[e])
        turns = np.zeros((high, wide + 1), np.int64)
        np.add.at(turns, (j - j0, np.clip(np.ceil(cross - 0.5).astype(np.int64) - i0, 0, wide)), 1)
        inside = (np.cumsum(turns[:, :wide], axis=1) % 2 == 1) & ~near
    j, i = np.nonzero(near | inside)
    return i + i0, j + j0, inside[j, i]


def meeting_cells(s: Shape, precision: int, world: Box = WORLD) -> Column:
    """array<struct<ix, iy, inside>>: cells that a polyline or polygon meets or comes near to, and those that lie inside it."""
    columns, rows = (1 << n for n in sizes(precision))

    @F.arrow_udf("array<struct<ix:bigint,iy:bigint,inside:boolean>>")
    def found(kind: pa.Array, indices: pa.Array, xs: pa.Array, ys: pa.Array) -> pa.Array:
        lists: list[tuple] = []
        sizes_, null = [], []
        for t, first, x, y in zip(kind.to_pylist(), indices, xs, ys):
            gone = t is None or not x.is_valid or not len(x)
            null.append(gone)
            if gone:
                sizes_.append(0)
                continue
            u = (x.values.to_numpy(zero_copy_only=False) - world.xmin) / (world.xmax - world.xmin) * columns
            v = (y.values.to_numpy(zero_copy_only=False) - world.ymin) / (world.ymax - world.ymin) * rows
            lists.append(cells_of(first.values.to_numpy(zero_copy_only=False), u, v, t == 5, columns, rows))
            sizes_.append(len(lists[-1][0]))
        parts = [np.concatenate(p) for p in zip(*lists)] if lists else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
        cells = pa.StructArray.from_arrays([pa.array(p) for p in parts], ["ix", "iy", "inside"])
        offsets = pa.array(np.append(0, np.cumsum(sizes_)).astype(np.int32), mask=np.append(null, False).astype(bool))
        return pa.ListArray.from_arrays(offsets, cells)

    c = s.col
    return found(c["type"], c["indices"], c["xcoordinates"], c["ycoordinates"])


def index(s: Shape, precision: int = 30, world: Box = WORLD) -> Column:
    """array<struct<curve, relation>>: the cells that a shape meets, and how. Only cells near an edge are compared with the shape."""
    checked(precision)
    if s.kind == "point":
        return F.when(s.col.isNotNull(), F.array(F.struct(point_cell(s, precision, world).alias("curve"), F.lit(CONTAINS).alias("relation"))))
    if s.kind == "line":
        found = F.transform(cover(s, precision, world), lambda c: F.struct(c.alias("curve"), relate(c, s).alias("relation")))
        return F.filter(found, lambda c: c["relation"] != DISJOINT)

    def related(m: Column) -> Column:
        of = Shape(m["s"], "multi", m["edges"])
        (left, right), (low, high) = _ends(of, precision, world, rim=False)
        cells = F.filter(m["cells"], lambda c: (c["ix"] >= left) & (c["ix"] <= right) & (c["iy"] >= low) & (c["iy"] <= high))
        made = F.transform(cells, lambda c: F.struct(_cell(c["ix"], c["iy"], precision, world).alias("curve"), c["inside"].alias("inside")))
        found = F.transform(made, lambda c: F.struct(c["curve"].alias("curve"), F.when(c["inside"], F.lit(WITHIN)).otherwise(relate(c["curve"], of)).alias("relation")))
        return F.filter(found, lambda c: c["relation"] != DISJOINT)

    together = F.struct(s.col.alias("s"), s.edges.alias("edges"), meeting_cells(s, precision, world).alias("cells"))
    return F.when(s.col.isNotNull(), bound(together, related))


def cell_key(cell: Column, precision: int) -> Column:
    return F.shiftrightunsigned(cell["bits"], 64 - precision)


def code(cell: Column, precision: int) -> Column:
    """The bits as text."""
    return F.lpad(F.bin(cell_key(cell, precision)), precision, "0")


def base32(cell: Column, precision: int) -> Column:
    """Geohash text."""
    checked(precision)
    k = cell_key(cell, precision)
    return F.concat(*[F.substr(F.lit(ALPHABET), F.shiftrightunsigned(k, precision - 5 * (i + 1)).bitwiseAND(F.lit(31).cast("long")).cast("int") + 1, F.lit(1)) for i in range(precision // 5)])


def children(cell: Column, precision: int) -> Column:
    """The four cells of precision + 2 in a cell; their boxes follow from their bits."""
    k = cell_key(cell, precision)
    mx, my = (cell["xmin"] + cell["xmax"]) / 2, (cell["ymin"] + cell["ymax"]) / 2
    out = []
    for i in range(4):
        xbit, ybit = (i >> 1, i & 1) if precision % 2 == 0 else (i & 1, i >> 1)
        sides = {"xmin": mx if xbit else cell["xmin"], "ymin": my if ybit else cell["ymin"], "xmax": cell["xmax"] if xbit else mx, "ymax": cell["ymax"] if ybit else my}
        out.append(F.struct(*[c.alias(n) for n, c in sides.items()], F.lit(precision + 2).alias("precision"), F.shiftleft(k * 4 + i, 62 - precision).alias("bits")))
    return F.array(*out)
