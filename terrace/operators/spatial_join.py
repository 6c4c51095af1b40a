"""Joins on spatial predicates through an equi-join on grid cells.

Both sides get keys of cells; rows of one cell are candidates and the predicate decides. Spark chooses a broadcast or a
sort-merge join on the cell and splits skewed cells.

A point has one cell. A polyline or polygon that points are joined with has the cells that it meets, not those of its box,
and a cell that lies inside a polygon answers for its points: there the predicate isn't evaluated, and the polygon's edges
don't come along. Of two shapes with an extent both have the cells of their boxes, and a pair that meets in several cells
counts in one of them only, the cell of the lower left corner of the boxes' overlap, so no distinct is needed.

With a point on the left inner, left, semi and anti joins are one equi-join. Other outer, semi and anti joins find the
matching pairs first and join them back by row keys. Null shapes never match.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grid, predicates
from ..functions.shapes import WORLD, Box, Shape, raw_point
from .shared import checkpoint_dir

PREDICATES: dict[str, Callable[[Shape, Shape], Column]] = {
    "within": predicates.within,
    "contains": predicates.contains,
    "intersects": predicates.intersects,
    "intersects_strict": lambda a, b: predicates.intersects(a, b, strict=True),
    "covers": predicates.covers,
}
#: What a point in a cell inside a polygon means for a predicate.
INSIDE = {"within": True, "contains": True, "covers": True, "intersects": False, "intersects_strict": False}
HOW = ("inner", "left", "right", "full", "left_semi", "left_anti")


def with_index(df: DataFrame, shape: str, precision: int = 30, world: Box = WORLD, name: str = "index") -> DataFrame:
    """df with an index column, array<struct<curve, relation>>, which can be stored and used by spatial_join."""
    return df.withColumn(name, grid.index(Shape.of(df, shape), precision, world))


def _point_cells(df: DataFrame, p: Shape, precision: int, world: Box, name: str) -> DataFrame:
    return df.withColumn(name, F.when(p.col.isNotNull(), grid.point_key(p["x"], p["y"], precision, world)))


def _region_cells(df: DataFrame, s: Shape, precision: int, world: Box, index: str | None, name: str) -> tuple[DataFrame, Shape]:
    """A row for each cell of a shape: its key `name`, and `name`_in, whether it lies inside. Edges come along only where it doesn't."""
    if index is not None:
        wrong = F.exists(F.col(index), lambda c: c["curve"]["precision"] != precision)
        cells = F.transform(F.col(index), lambda c: F.struct(grid.cell_key(c["curve"], precision).alias("key"), (c["relation"] == grid.WITHIN).alias("inside")))
        cells = F.when(wrong, F.raise_error(F.lit(f"{index} isn't of precision {precision}")).cast("array<struct<key:bigint,inside:boolean>>")).otherwise(cells)
        one = F.col(f"{name}_c")
        df = df.withColumn(f"{name}_e", s.edges).withColumn(f"{name}_c", F.explode(cells)).withColumns({name: one["key"], f"{name}_in": one["inside"]})
    else:
        one = F.col(f"{name}_c")
        df = df.withColumn(f"{name}_e", s.edges).withColumn(f"{name}_c", F.explode(grid.meeting_cells(s, precision, world)))
        df = df.withColumns({name: grid.key(one["ix"], one["iy"], precision), f"{name}_in": one["inside"]})
    df = df.withColumn(f"{name}_e", F.when(~F.col(f"{name}_in"), F.col(f"{name}_e"))).drop(f"{name}_c")
    return df, Shape(s.col, s.kind, F.col(f"{name}_e"))


def _box_cells(df: DataFrame, s: Shape, precision: int, world: Box, name: str) -> tuple[DataFrame, Shape]:
    if s.kind == "multi":
        df = df.withColumn(f"{name}_e", s.edges)
        s = Shape(s.col, s.kind, F.col(f"{name}_e"))
    return df.withColumn(name, F.explode(grid.cover_keys(s, precision, world))), s


def _candidates(left: DataFrame, right: DataFrame, l: Shape, r: Shape, predicate: str, condition: Column | None, precision: int, world: Box, left_index: str | None, right_index: str | None) -> tuple[DataFrame, DataFrame, Column]:
    """Both sides with their cells, and the condition of the join."""
    on = F.col("__cell_l") == F.col("__cell_r")
    kinds = {l.kind, r.kind}
    if kinds == {"point", "multi"} and predicate in INSIDE:
        if l.kind == "point":
            a, (b, r) = _point_cells(left, l, precision, world, "__cell_l"), _region_cells(right, r, precision, world, right_index, "__cell_r")
        else:
            b, (a, l) = _point_cells(right, r, precision, world, "__cell_r"), _region_cells(left, l, precision, world, left_index, "__cell_l")
        p, inside = (l, F.col("__cell_r_in")) if l.kind == "point" else (r, F.col("__cell_l_in"))
        # A point beyond the world counts as on its rim, so its cell says nothing about it.
        inside = inside & (p["x"] >= world.xmin) & (p["x"] <= world.xmax) & (p["y"] >= world.ymin) & (p["y"] <= world.ymax)
        points_right = predicate in ("contains", "covers")
        answer = INSIDE[predicate] and (l.kind == "multi") == points_right
        matched = PREDICATES[predicate](l, r)
        matched = inside | matched if answer else ~inside & matched
    else:
        a, l = _box_cells(left, l, precision, world, "__cell_l")
        b, r = _box_cells(right, r, precision, world, "__cell_r")
        matched = PREDICATES[predicate](l, r)
        if "point" not in kinds:
            # Of all cells that a pair shares, that of the lower left corner of the boxes' overlap.
            once = grid.point_key(F.greatest(l["xmin"], r["xmin"]), F.greatest(l["ymin"], r["ymin"]), precision, world)
            on = on & (F.col("__cell_l") == once)
    return a, b, on & matched & condition if condition is not None else on & matched


def spatial_join(
    left: DataFrame,
    right: DataFrame,
    left_shape: str,
    right_shape: str,
    predicate: str = "within",
    how: str = "inner",
    precision: int = 15,
    world: Box = WORLD,
    condition: Column | None = None,
    left_index: str | None = None,
    right_index: str | None = None,
    left_key: list[str] | None = None,
    right_key: list[str] | None = None,
) -> DataFrame:
    """Rows of left and right with predicate(left shape, right shape), and `condition` if given.

    Column names of the two sides must differ. left_index, right_index: index columns of this precision to use instead of
    the shape. left_key, right_key: columns that name a row, for joins that need it; without them rows are numbered and
    written to the checkpoint folder.
    """
    if predicate not in PREDICATES:
        raise ValueError(f"predicate: one of {', '.join(PREDICATES)}")
    if how not in HOW:
        raise ValueError(f"how: one of {', '.join(HOW)}")
    if both := set(left.columns) & set(right.columns):
        raise ValueError(f"both sides have {', '.join(sorted(both))}")
    grid.checked(precision)
    left_columns, right_columns = left.columns, right.columns
    l, r = Shape.of(left, left_shape), Shape.of(right, right_shape)
    if (left_index or right_index) and not (l.kind == "point" and r.kind == "multi" and predicate == "within" or l.kind == "multi" and r.kind == "point" and predicate == "contains"):
        raise ValueError("a stored index serves joins of points within polygons: it leaves out cells that only touch a shape")

    def candidates(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame, Column]:
        return _candidates(a, b, l, r, predicate, condition, precision, world, left_index, right_index)

    if l.kind == "point" and how in ("inner", "left", "left_semi", "left_anti") or how == "inner":
        a, b, on = candidates(left, right)
        return a.join(b, on, how).select(*left_columns, *(right_columns if how in ("inner", "left") else []))

    def numbered(df: DataFrame, key: list[str] | None, name: str) -> DataFrame:
        if key:
            return df.withColumn(name, F.struct(*key))
        context = df.sparkSession.sparkContext
        if not context._jsc.sc().getCheckpointDir().isDefined():
            context.setCheckpointDir(checkpoint_dir(df.sparkSession))
        return df.withColumn(name, F.monotonically_increasing_id()).checkpoint()

    needs_right = how in ("right", "full")
    a = numbered(left, left_key, "__l")
    b = numbered(right, right_key, "__r") if needs_right else right.withColumn("__r", F.lit(0))
    x, y, on = candidates(a, b)
    pairs = x.join(y, on).drop("__cell_l", "__cell_r")
    if how in ("left_semi", "left_anti"):
        return a.join(pairs.select(F.col("__l").alias("__hit")), F.col("__l") == F.col("__hit"), how).select(*left_columns)
    out = pairs.select(*left_columns, *right_columns)
    if how in ("left", "full"):
        lone = a.join(pairs.select(F.col("__l").alias("__hit")), F.col("__l") == F.col("__hit"), "left_anti")
        out = out.unionByName(lone.select(*left_columns, *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in right_columns]))
    if needs_right:
        lone = b.join(pairs.select(F.col("__r").alias("__hit")), F.col("__r") == F.col("__hit"), "left_anti")
        out = out.unionByName(lone.select(*[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left_columns], *right_columns))
    return out


def distance_join(left: DataFrame, right: DataFrame, left_point: str, right_point: str, distance: float, precision: int = 15, world: Box = WORLD) -> DataFrame:
    """Pairs of points at most `distance` apart: the right ones reach over the cells of their square."""
    if both := set(left.columns) & set(right.columns):
        raise ValueError(f"both sides have {', '.join(sorted(both))}")
    l, r = Shape.of(left, left_point), Shape.of(right, right_point)
    box = F.struct((r["x"] - distance).alias("xmin"), (r["y"] - distance).alias("ymin"), (r["x"] + distance).alias("xmax"), (r["y"] + distance).alias("ymax"))
    a = left.withColumn("__cell_l", F.when(l.col.isNotNull(), grid.point_key(l["x"], l["y"], precision, world)))
    b = right.withColumn("__cell_r", F.explode(grid.cover_keys(Shape(F.when(r.col.isNotNull(), box), "multi"), precision, world)))
    on = (F.col("__cell_l") == F.col("__cell_r")) & predicates.within_distance(l, r, distance)
    # A left row may have many pairs, so rows are dealt over tasks before: a small file's rows are one or few tasks else.
    a = a.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return a.join(b, on).select(*left.columns, *right.columns)


#: Halvings of the radius that `nearest` may begin with, and how many right points a cell of about a disc's size may have there, times k.
MOST_HALVINGS, CROWD = 10, 8


def _halvings(right: DataFrame, r: Shape, k: int, precision: int) -> int:
    """How often to halve the radius, so that even in the densest part a disc has few right points. One row goes to the driver."""
    deepest = min(MOST_HALVINGS, (60 - precision) // 2)
    finest = max(2, precision - 4 + 2 * deepest)
    cells = right.where(r.col.isNotNull()).groupBy(grid.point_key(r["x"], r["y"], finest).alias("cell")).agg(F.count("*").alias("n"))
    at = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(deepest))).alias("up"))
    sums = at.groupBy("up", F.expr("shiftrightunsigned(cell, 2 * up)").alias("cell")).agg(F.sum("n").alias("n"))
    least = sums.groupBy("up").agg(F.max("n").alias("n")).where(F.col("n") <= CROWD * k).agg(F.max("up")).first()[0]
    return deepest if least is None else deepest - least


def nearest(left: DataFrame, right: DataFrame, left_point: str, right_point: str, k: int, distance: float, left_key: list[str], precision: int = 15) -> DataFrame:
    """The k nearest right points within `distance` of each left row, nearest first (`rank` from 1).

    Left rows of one place have one answer, so places are searched; of right rows of one place only the first k can count.
    Discs begin small and double up to `distance`: a place with k right points in its disc is settled, since all others are
    farther. precision: of the grid at `distance`; smaller discs have smaller cells. Rounds are Parquet in the shared folder.
    """
    import uuid

    from pyspark.sql import Window

    if both := set(left.columns) & set(right.columns):
        raise ValueError(f"both sides have {', '.join(sorted(both))}")
    spark = left.sparkSession
    l, r = Shape.of(left, left_point), Shape.of(right, right_point)
    rest = [c for c in right.columns if c != right_point]
    first = Window.partitionBy("__x", "__y").orderBy(*rest) if rest else Window.partitionBy("__x", "__y").orderBy("__x")
    folder = f"{checkpoint_dir(spark)}/nearest-{uuid.uuid4().hex}"

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    few = right.where(r.col.isNotNull()).withColumns({"__x": r["x"], "__y": r["y"]}).withColumn("__n", F.row_number().over(first))
    few = stored(few.where(F.col("__n") <= k).drop("__x", "__y", "__n"), "right")
    few_r = Shape.of(few, right_point)
    places = left.where(l.col.isNotNull()).select(l["x"].alias("__x"), l["y"].alias("__y")).distinct()
    open_ = stored(places, "places").withColumn("__p", raw_point(F.col("__x"), F.col("__y")))
    p = Shape.of(open_, "__p")
    d = (p["x"] - few_r["x"]) * (p["x"] - few_r["x"]) + (p["y"] - few_r["y"]) * (p["y"] - few_r["y"])
    best = Window.partitionBy("__x", "__y").orderBy("squared_distance", *rest)
    found = None
    for halved in range(_halvings(few, few_r, k, precision), -1, -1):
        pairs = distance_join(open_, few, "__p", right_point, distance / 2**halved, precision + 2 * halved).withColumn("squared_distance", d)
        ranked = pairs.withColumn("__n", F.row_number().over(best)).where(F.col("__n") <= k).drop("__p")
        # A place counts as settled by its k-th right row; the others' rows wait for a larger disc.
        ranked = stored(ranked, f"round-{halved}")
        if halved:
            settled = ranked.where(F.col("__n") == k).select(F.col("__x").alias("__sx"), F.col("__y").alias("__sy"))
            same = (F.col("__x") == F.col("__sx")) & (F.col("__y") == F.col("__sy"))
            open_ = stored(open_.join(settled, same, "left_anti"), f"open-{halved}")
            ranked = ranked.join(settled, same, "left_semi")
        found = ranked if found is None else found.unionByName(ranked)
        if halved and open_.isEmpty():
            break
    answers = found.drop("__n")
    joined = left.join(answers, (l["x"] == F.col("__x")) & (l["y"] == F.col("__y"))).drop("__x", "__y")
    ranks = F.row_number().over(Window.partitionBy(*left_key).orderBy("squared_distance", *rest))
    return joined.select(*left.columns, *right.columns, "squared_distance").withColumn("rank", ranks).where(F.col("rank") <= k)
