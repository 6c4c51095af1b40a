"""What lets queries grow with their input: small expressions and joins without the pairs that nobody asks for."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from terrace.functions import grid, predicates as P
from terrace.functions.shapes import Shape, multis, point, polyline
from terrace.functions.wkt import wkt
from terrace.operators import spatial_join as spatial_join_module
from terrace.operators.spatial_join import distance_join, nearest


def test_cell_keys_name_a_coordinate_a_bounded_number_of_times(spark):
    """Once to test it for null and once to place it; by shifts and masks it was 64 times, in the scan's filter too."""
    made = str(grid.point_key(F.col("abscissa"), F.col("ordinate"), 30))
    assert made.count("abscissa") <= 2 and made.count("ordinate") <= 2


def test_cell_keys_interleave_every_bit(spark):
    """Keys against Python's bits, at the ends of the range and for null."""
    places = [(a, b) for a in (0, 1, 2**29, 2**30 - 1, 0x2AAAAAAA) for b in (0, 3, 2**30 - 1, 0x15555555)] + [(None, 1)]
    rows = spark.createDataFrame(places, "ix long, iy long").select("ix", "iy", grid.key(F.col("ix"), F.col("iy"), 60).alias("even"), grid.key(F.col("ix"), F.col("iy"), 59).alias("odd")).collect()

    def mixed(high, low):
        return sum((high >> i & 1) << 2 * i + 1 | (low >> i & 1) << 2 * i for i in range(30))

    for r in rows:
        if r.ix is None:
            assert r.even is None and r.odd is None
        else:
            assert (r.even, r.odd) == (mixed(r.ix, r.iy), mixed(r.iy, r.ix))


def _scattered(spark, n, m):
    """Points of which many share a place, with a crowd, lone ones, nulls and a repeated key."""
    left = [(i, float(i * 37 % 40) - 20, float(i * 11 % 30) - 15) for i in range(n)] + [(n, 170.0, 80.0), (n + 1, None, 1.0), (0, 3.0, 3.0), (n + 2, -60.0, 0.0)]
    right = [(j, float(j * 13 % 20) - 10, float(j * 7 % 20) - 10) for j in range(m)] + [(m + j, 5 + j / 64, 5.0) for j in range(60)] + [(m + 60, -69.0, 0.0), (m + 61, None, 0.0)]
    made = lambda rows, k, p: spark.createDataFrame(rows, f"{k} long, x double, y double").select(k, F.when(F.col("x").isNotNull(), point("x", "y")).alias(p))
    return made(left, "a", "p"), made(right, "b", "q")


def test_nearest_is_that_of_all_pairs(spark):
    left, right = _scattered(spark, 300, 200)
    d = (F.col("p.x") - F.col("q.x")) ** 2 + (F.col("p.y") - F.col("q.y")) ** 2
    rank = F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))
    every = left.crossJoin(right).withColumn("d", d).where("d <= 144").withColumn("rank", rank).where("rank <= 3")
    wanted = sorted(map(tuple, every.select("a", "b", "d", "rank").collect()))
    found = nearest(left, right, "p", "q", 3, 12.0, ["a"], precision=10)
    assert found.columns == ["a", "p", "b", "q", "squared_distance", "rank"]
    assert sorted(map(tuple, found.select("a", "b", "squared_distance", "rank").collect())) == wanted and len(wanted) > 600


def test_nearest_compares_few_pairs(spark):
    """40 rows at each of 100 places on both sides: all pairs within the distance were ranked, 16 million; now places are, in small discs."""
    rows = spark.range(4000).select("id", (F.col("id") % 10).cast("double").alias("x"), (F.floor(F.col("id") / 10) % 10).cast("double").alias("y"))
    left, right = rows.select(F.col("id").alias("a"), point("x", "y").alias("p")), rows.select(F.col("id").alias("b"), point("x", "y").alias("q"))
    seen = []
    join = spatial_join_module.distance_join

    def counted(*args, **options):
        seen.append(join(*args, **options).count())
        return join(*args, **options)

    spatial_join_module.distance_join = counted
    try:
        found = nearest(left, right, "p", "q", 3, 30.0, ["a"], precision=10).where("squared_distance = 0 AND b % 100 = a % 100 AND rank <= 3").count()
    finally:
        spatial_join_module.distance_join = join
    assert found == 12000 and sum(seen) < 20000


def test_distance_join_spreads_the_left_rows(spark):
    """A file of one split is one task; its rows are dealt over tasks before each gets its pairs."""
    left, right = _scattered(spark, 100, 100)
    joined = distance_join(left.coalesce(1), F.broadcast(right), "p", "q", 12.0, precision=10)
    d = (F.col("p.x") - F.col("q.x")) ** 2 + (F.col("p.y") - F.col("q.y")) ** 2
    assert joined.select(F.spark_partition_id()).distinct().count() > 1
    assert sorted(map(tuple, joined.select("a", "b").collect())) == sorted(map(tuple, left.crossJoin(right).where(d <= 144).select("a", "b").collect()))


def test_several_points_at_once_are_within_as_one_by_one(spark):
    texts = ["POLYGON ((0 0, 0 4, 4 4, 4 0, 0 0),(1 1, 2 1, 2 2, 1 2, 1 1))", "POLYGON ((0 0, 0 2, 1 2, 1 1, 2 1, 2 0, 0 0))", "LINESTRING (0 0, 3 3, 3 0)", "POINT (1 1)", None, "POLYGON ((0 0, 2 3, 4 0, 0 0))"]
    two = polyline(F.array(F.lit(0), F.lit(2)), F.array(*map(F.lit, (0.0, 1.0, 3.0, 3.0))), F.array(*map(F.lit, (0.0, 0.0, 0.0, 3.0))))
    shapes = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.when(F.col("i") == 3, two).otherwise(F.coalesce(wkt("t")["polygon"], wkt("t")["polyline"])).alias("g"))
    at = [(0.5, 0.5), (1.5, 1.5), (1.0, 1.0), (3.0, 1.0), (0.0, 0.0), (2.0, 0.0), (1.0, 5.0), (2.0, 2.0)]
    points_ = [Shape(point(*p), "point") for p in at] + [Shape(point(F.col("i") + 0.25, F.col("i") * 0.5), "point")]
    rows = shapes.select(P.within_each(points_, multis("g")).alias("each"), F.array(*[P.within(p, multis("g")) for p in points_]).alias("one")).collect()
    assert len(rows) == 6 and sum(r.each is None for r in rows) == 1
    assert all(r.each == r.one for r in rows if r.each is not None) and sum(map(sum, (r.one for r in rows if r.each is not None))) > 12


def test_segment_buffers_are_tested_without_a_lambda_for_each_edge(spark):
    """The long buffer is one row's, and no predicate goes over the edges of each segment's buffer in the rows' projection."""
    from terrace.plans import catalogue

    made = catalogue.queries()["buffer_segments"](spark, "/root/testdata/sf0.001")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "tested(" in plan and "Join Cross" in plan
    rows = made.collect()
    assert len(rows) == 1500 and all(r.holds_ends and not r.holds_beside and r.long_thin for r in rows)
