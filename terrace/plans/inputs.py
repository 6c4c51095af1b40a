"""Shapes made of the test tables: exact in binary, so both engines agree to the last bit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shapes import line, point, polygon, polyline

CX = "CAST((c_custkey * 7919 % 2880 - 1440) / 8.0 AS DOUBLE)"
CY = "CAST((c_custkey * 104729 % 1440 - 720) / 8.0 AS DOUBLE)"
NX = "CAST(n_nationkey % 5 * 64 - 128 AS DOUBLE)"
NY = "CAST(floor(n_nationkey / 5) * 32 - 64 AS DOUBLE)"

#: The same in SQL: customers as points, nations as diamonds, order segments, and the diamonds' edges.
SQL = f"""
cust AS (SELECT c_custkey, c_name, {CX} AS x, {CY} AS y FROM customer),
nat AS (SELECT n_nationkey, n_name, n_regionkey, CAST(n_nationkey % 5 * 64 - 128 AS DOUBLE) AS cx, CAST(n_nationkey // 5 * 32 - 64 AS DOUBLE) AS cy FROM nation),
diamond_edges AS (
  SELECT n_nationkey, cx - 24 AS x0, cy AS y0, cx AS x1, cy + 12 AS y1 FROM nat UNION ALL SELECT n_nationkey, cx, cy + 12, cx + 24, cy FROM nat
  UNION ALL SELECT n_nationkey, cx + 24, cy, cx, cy - 12 FROM nat UNION ALL SELECT n_nationkey, cx, cy - 12, cx - 24, cy FROM nat),
square_edges AS (
  SELECT n_nationkey, cx - 24 AS x0, cy - 12 AS y0, cx - 24 AS x1, cy + 12 AS y1 FROM nat UNION ALL SELECT n_nationkey, cx - 24, cy + 12, cx + 24, cy + 12 FROM nat
  UNION ALL SELECT n_nationkey, cx + 24, cy + 12, cx + 24, cy - 12 FROM nat UNION ALL SELECT n_nationkey, cx + 24, cy - 12, cx - 24, cy - 12 FROM nat),
hole_edges AS (
  SELECT n_nationkey, cx - 12 AS x0, cy AS y0, cx AS x1, cy + 6 AS y1 FROM nat UNION ALL SELECT n_nationkey, cx, cy + 6, cx + 12, cy FROM nat
  UNION ALL SELECT n_nationkey, cx + 12, cy, cx, cy - 6 FROM nat UNION ALL SELECT n_nationkey, cx, cy - 6, cx - 12, cy FROM nat)"""


def edge_tests(edges: str) -> str:
    """CTE body: for each customer and nation whose box holds the point, whether it is on an edge and how many are above."""
    return f"""
  SELECT c.c_custkey, e.n_nationkey,
    bool_or(c.x BETWEEN least(x0, x1) AND greatest(x0, x1) AND c.y BETWEEN least(y0, y1) AND greatest(y0, y1) AND (c.y - y0) * (x1 - x0) - (y1 - y0) * (c.x - x0) = 0) AS on_edge,
    count(*) FILTER (WHERE x0 <> x1 AND ((x0 <= c.x AND c.x < x1) OR (x1 <= c.x AND c.x < x0)) AND c.y < (y1 - y0) / nullif(x1 - x0, 0) * (c.x - x0) + y0) AS above
  FROM cust c JOIN nat n ON c.x BETWEEN n.cx - 24 AND n.cx + 24 AND c.y BETWEEN n.cy - 12 AND n.cy + 12 JOIN ({edges}) e ON e.n_nationkey = n.n_nationkey
  GROUP BY c.c_custkey, e.n_nationkey"""


def customers(spark: SparkSession, d: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/customer.parquet")
    return df.select("c_custkey", "c_name", F.expr(CX).alias("x"), F.expr(CY).alias("y")).withColumn("point", point("x", "y"))


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/supplier.parquet")
    return df.select("s_suppkey", point(F.expr(CX.replace("c_custkey", "s_suppkey")), F.expr(CY.replace("c_custkey", "s_suppkey"))).alias("s_point"))


def _closed(make, *rings) -> F.Column:
    firsts, xs, ys = [], [], []
    for r in rings:
        firsts.append(F.lit(len(xs)))
        xs += [F.col("cx") + dx for dx, _ in r]
        ys += [F.col("cy") + dy for _, dy in r]
    return make(F.array(*firsts), F.array(*xs), F.array(*ys))


DIAMOND = ((-24.0, 0.0), (0.0, 12.0), (24.0, 0.0), (0.0, -12.0), (-24.0, 0.0))
HALF = ((-12.0, 0.0), (0.0, 6.0), (12.0, 0.0), (0.0, -6.0), (-12.0, 0.0))
SQUARE = ((-24.0, -12.0), (-24.0, 12.0), (24.0, 12.0), (24.0, -12.0), (-24.0, -12.0))


def nations(spark: SparkSession, d: str) -> DataFrame:
    """diamond, holed (a square with a diamond hole), outline (the diamond as a polyline)"""
    df = spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey", F.expr(NX).alias("cx"), F.expr(NY).alias("cy"))
    return df.withColumns({"diamond": _closed(polygon, DIAMOND), "holed": _closed(polygon, SQUARE, HALF), "outline": _closed(polyline, DIAMOND)})


SEGMENTS = f"""
segs AS (SELECT o_orderkey, x AS ax, y AS ay, x + CAST((o_orderkey % 64 - 32) / 8.0 AS DOUBLE) AS bx, y + CAST((o_orderkey % 64 - 32) / 8.0 AS DOUBLE) AS by_
  FROM (SELECT o_orderkey, {CX.replace("c_custkey", "o_custkey")} AS x, {CY.replace("c_custkey", "o_custkey")} AS y FROM orders))"""


def segments(spark: SparkSession, d: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/orders.parquet")
    x, y = (F.expr(c.replace("c_custkey", "o_custkey")) for c in (CX, CY))
    shift = F.expr("CAST((o_orderkey % 64 - 32) / 8.0 AS DOUBLE)")
    return df.select("o_orderkey", line(x, y, x + shift, y + shift).alias("segment"))
