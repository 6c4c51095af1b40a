"""Predicates, grid and joins against hand-computed values."""

import math

import pytest
from pyspark.sql import functions as F

from terrace.functions import grid, predicates as P
from terrace.functions.buffer import buffer, circle
from terrace.functions.geojson import as_geojson, polygon_from_json, polygon_to_json
from terrace.functions.shapes import Box, Shape, is_valid, length, line, lines, multis, num_rings, point, points, polygon, polyline, ring, ring_polygon, vertex
from terrace.functions.transform import nad83, scale, transform
from terrace.functions.wkt import as_wkt, try_wkt, wkt

S = ((1, 1), (1, -1), (-1, -1), (-1, 1), (1, 1))
H = ((0.5, 0), (0, 0.5), (-0.5, 0), (0, -0.5), (0.5, 0))


def multi(make, *parts):
    firsts, xs, ys = [], [], []
    for p in parts:
        firsts.append(len(xs))
        xs += [float(v[0]) for v in p]
        ys += [float(v[1]) for v in p]
    return Shape(make(F.array(*map(F.lit, firsts)), F.array(*map(F.lit, xs)), F.array(*map(F.lit, ys))), "multi")


def square(x0, y0, x1, y1):
    return multi(polygon, ((x0, y0), (x0, y1), (x1, y1), (x1, y0), (x0, y0)))


def pt(x, y):
    return Shape(point(float(x), float(y)), "point")


def seg(a, b):
    return Shape(line(float(a[0]), float(a[1]), float(b[0]), float(b[1])), "line")


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)
    return lambda *cols: list(one.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_point_in_polygon(value):
    s, holed = multi(polygon, S), multi(polygon, S, H)
    assert value(*[P.within(pt(*p), s) for p in ((0, 0), (2, 2), (1, 1), (1, 0))]) == [True, False, False, False]
    assert value(*[P.within(pt(*p), holed) for p in ((0, 0), (0.5, 0), (0.75, 0.75))]) == [False, False, True]
    assert value(*[P.intersects(s, pt(*p)) for p in ((0, 0), (1, 1), (0, -1))]) == [False, True, True]
    assert value(P.covers(s, pt(0, 0)), P.covers(s, pt(1, 1)), P.covers(s, pt(2, 2))) == [True, True, False]
    # A concave outline: an upright edge elsewhere in line with the point doesn't count as touched.
    ell = multi(polygon, ((0, 0), (0, 2), (1, 2), (1, 1), (2, 1), (2, 0), (0, 0)))
    assert value(P.within(pt(1, 0.5), ell)) == [True]


def test_lines(value):
    s = multi(polygon, S)
    cases = [((0, 0), (0, 5)), ((0, 0), (1, 0)), ((1, 1), (1, 0)), ((1, 1), (2, 2)), ((0, 0), (0.5, 0.5)), ((2, 2), (3, 3))]
    assert value(*[P.intersects(s, seg(*c)) for c in cases]) == [True] * 5 + [False]
    assert value(P.intersects(s, seg((0, 0), (0.5, 0.5)), strict=True), P.intersects(s, square(-0.5, -0.5, 0.5, 0.5), strict=True), P.intersects(s, square(-0.5, -0.5, 0.5, 0.5))) == [False, False, True]
    open_ = multi(polyline, S[:4])
    assert value(*[P.intersects(open_, seg(*c)) for c in (((0, 0), (2, 0)), ((1, 1), (2, 2)), ((1.1, 1.1), (2, 2)), ((0, 0), (0, 1)))]) == [True, True, False, False]
    holed = multi(polygon, S, H)
    assert value(*[P.intersects(holed, multi(polyline, c)) for c in (((0, 0), (3, 3)), ((0.75, 0.75), (0.9, 0.9)), ((0, 0), (0.3, 0)))]) == [True, True, False]
    assert value(P.contains(open_, pt(1, 0)), P.contains(open_, pt(0, 1)), P.contains(seg((0, 0), (2, 2)), pt(1, 1)), P.contains(seg((0, 0), (0, 2)), pt(0, 3))) == [True, False, True, False]


def test_polygons(value):
    s = multi(polygon, S)
    others = [square(0, 0, 2, 2), square(1, -1, 2, 1), square(1, 1, 2, 2), square(3, 3, 4, 4), square(-0.5, -0.5, 0.5, 0.5), square(-2, -2, 2, 2)]
    assert value(*[P.intersects(s, o) for o in others]) == [True, True, True, False, True, True]
    assert value(P.contains(s, others[4]), P.contains(s, others[0]), P.contains(multi(polygon, S, H), square(-0.9, -0.9, 0.9, 0.9)), P.within(others[4], s)) == [True, False, False, True]
    assert value(P.disjoint(s, others[3]), P.disjoint(s, pt(0, 0)), P.disjoint(s, others[0])) == [True, False, False]


def test_ranges(value):
    box = Box(0, 0, 1, 1)
    assert value(P.within_box(pt(0, 0), box), P.within_box(pt(2, 2), box), P.within_circle(pt(0, 0), 0.5, 0.5, 1.0), P.within_circle(pt(1.4, 1.4), 0.5, 0.5, 1.0), P.within_circle(multi(polygon, S), 0, 0, 1.42)) == [True, False, True, False, True]
    assert not Box(0, 0, 1, 1).disjoint(Box(1, 1, 2, 2)) and Box(0, 0, 1, 1).disjoint(Box(0.5, 1.1, 2, 2)) and not Box(0, 0, 1, 1).intersects(Box(1, 1, 2, 2))


def test_relate(value):
    cell = F.struct(F.lit(0.0).alias("xmin"), F.lit(0.0).alias("ymin"), F.lit(0.5).alias("xmax"), F.lit(0.5).alias("ymax"))
    shapes = [multi(polygon, S), square(1.1, -2, 2, -1), square(1, -2, 2, -1), square(1, -2, 2, 0), square(0, -2, 2, 0)]
    assert value(*[grid.relate(cell, s) for s in shapes]) == ["Within", "Disjoint", "Disjoint", "Disjoint", "Intersects"]
    hole = multi(polygon, S, ((0.3, 0.1), (0.4, 0.1), (0.4, 0.15), (0.3, 0.1)))
    assert value(grid.relate(cell, hole)) == ["Intersects"]


def test_cells(value):
    c = grid.point_cell(pt(-122.3959313, 37.7912976), 25)
    assert value(grid.base32(c, 25), grid.code(c, 25)) == ["9q8yy", "0100110110010001111011110"]
    assert value(grid.base32(grid.point_cell(pt(116.6009234, 40.0798573), 30), 30)) == ["wx4uj2"]
    c = grid.point_cell(pt(-122.4517249, 37.765315), 5)
    bits, kids = value(c["bits"], F.transform(grid.children(c, 5), lambda k: F.struct(k["bits"], k["xmin"], k["ymin"], k["xmax"], k["ymax"])))
    assert bits == 9 << 59 and kids[2][0] == 5476377146882523136
    for _, x0, y0, x1, y1 in kids:
        deeper = grid.point_key(F.lit((x0 + x1) / 2), F.lit((y0 + y1) / 2), 7)
        assert value(deeper)[0] in [((k[0] % 2**64) >> 57) for k in kids]
    world = Box(-4, -4, 4, 4)

    def codes(s, p):
        return F.array_sort(F.transform(grid.cover(s, p, world), lambda k: grid.code(k, p)))

    assert value(codes(square(1, 1, 3, 3), 2), codes(square(1, 1, 3, 3), 4), codes(square(1, 1, 3, 3), 6)) == [["11"], ["1100", "1101", "1110", "1111"], ["110011", "110110", "111001", "111100"]]
    with pytest.raises(ValueError):
        grid.index(pt(0, 0), 7)


def test_text_formats(value):
    p = wkt(F.lit("POLYGON ((0 0, 0 4, 4 4, 4 0, 0 0),(1 1, 2 1, 2 2, 1 1))"))["polygon"]
    s = Shape(p, "multi")
    assert value(num_rings(s), length(s), is_valid(s)) == [2, 9, True]
    assert value(as_wkt(s)) == ["POLYGON ((0.0 0.0, 0.0 4.0, 4.0 4.0, 4.0 0.0, 0.0 0.0), (1.0 1.0, 2.0 1.0, 2.0 2.0, 1.0 1.0))"]
    assert value(wkt(F.lit("POINT(-1.5 2)"))["point"]["x"], wkt(F.lit("LINESTRING (30 10, 10 30, 40 40)"))["polyline"]["xcoordinates"]) == [-1.5, [30.0, 10.0, 40.0]]
    assert value(wkt(F.lit("POINT EMPTY")), try_wkt(F.lit("POINT (1 2) junk"))["point"]) [1] is None
    with pytest.raises(Exception):
        value(wkt(F.lit("CIRCLE (1 2)")))
    assert value(as_geojson(pt(1, 2)), as_geojson(ring_polygon_shape(s))) == ['{"type":"Point","coordinates":[1.0,2.0]}', '{"type":"Polygon","coordinates":[[[1.0,1.0],[2.0,1.0],[2.0,2.0],[1.0,1.0]]]}']
    back = Shape(polygon_from_json(polygon_to_json(s)), "multi")
    assert value(as_wkt(back)) == value(as_wkt(s))
    assert value(vertex(s, 1)["y"], vertex(s, 99)) == [4.0, None]


def ring_polygon_shape(s):
    return multis(ring_polygon(s, 1))


def test_transform_and_projection(value):
    s = multi(polygon, S)
    assert value(transform(s, scale(2.0, 3.0))["ymax"], transform(seg((0, 0), (1, 2)), scale(2.0, 3.0))["endY"]) == [3.0, 6.0]
    x, y = value(*(lambda t: (t["x"], t["y"]))(transform(pt(-122.0, 37.7), nad83(403))))
    assert 1_800_000 < x < 2_000_000 and 600_000 < y < 700_000


def test_buffers(value):
    b = multis(buffer(pt(0, 1), 0.5))
    assert value(P.within(pt(0, 0.75), b), P.within(pt(0.4, 1), b), P.within(pt(0.6, 1), b)) == [True, True, False]
    b = multis(buffer(multi(polyline, ((-1, 1), (1, 1), (1, -1), (-1, -1))), 0.5))
    assert value(P.within(pt(1.3, 1.3), b), P.within(pt(0.4, 0.4), b), P.within(pt(1.4, 1.4), b), is_valid(b)) == [True, False, False, True]
    holed = multis(buffer(multi(polygon, ((0, 0), (0, 9), (9, 9), (9, 0), (0, 0)), ((3, 3), (3, 6), (6, 6), (6, 3), (3, 3))), 0.5))
    assert value(P.within(pt(4.5, 4.5), holed), P.within(pt(3.3, 4), holed), P.within(pt(-0.4, 4), holed), P.within(pt(-0.6, 4), holed), num_rings(holed)) == [False, True, True, False, 2]
    assert value(circle(0, 0, 1)["xmax"])[0] == pytest.approx(1) and math.isclose(value(buffer(seg((0, 0), (2, 0)), 1.0)["ymax"])[0], 1, abs_tol=0.01)
    with pytest.raises(Exception, match="too long"):
        value(buffer(multi(polyline, ((0, 0), (1000, 777), (2000, 0))), 0.01))
    assert value(lines(line(0, 0, 1, 1))["xmax"], points(point(1, 2))["y"], ring((0, 0), (1, 0), (0, 0))["xmax"]) == [1.0, 2.0, 1.0]


def test_strict_intersection_over_all_orders(spark):
    from terrace.plans import catalogue
    from terrace.plans.inputs import nations, segments

    d = "/root/testdata/sf0.001"
    crossed = segments(spark, d).join(nations(spark, d), P.intersects(Shape(F.col("segment"), "line"), multis("diamond"), strict=True))
    every = {tuple(r) for r in crossed.select("o_orderkey", "n_nationkey").collect()}
    rows = catalogue.queries()["intersects_strict"](spark, d).collect()
    assert {tuple(r) for r in rows} == every and len(rows) == len(every) > 0
