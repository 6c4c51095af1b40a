"""Aggregates of shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.shapes import Shape


def envelope(s: Shape) -> Column:
    """Box of all shapes of a group."""
    return F.struct(*[f(s[n]).alias(n) for f, n in ((F.min, "xmin"), (F.min, "ymin"), (F.max, "xmax"), (F.max, "ymax"))])


def centroid(s: Shape) -> Column:
    """Mean of points."""
    return F.struct(F.avg(s["x"]).alias("x"), F.avg(s["y"]).alias("y"))
