"""GeoJSON files: whole files or JSON lines of features, through Spark's text reader and JSON functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geojson import shapes_of
from ..functions.shapes import multis
from ..functions import shapes as S

_FEATURE = "struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string,geometries:array<struct<type:string,coordinates:string>>>>"


def finished(df: DataFrame) -> DataFrame:
    """point, polyline, polygon, metadata, valid: the columns that all spatial sources have."""
    valid = F.coalesce(F.col("point").isNotNull() | S.is_valid(multis("polyline")) | S.is_valid(multis("polygon")), F.lit(False))
    return df.select("point", "polyline", "polygon", "metadata", valid.alias("valid"))


def from_features(features: DataFrame) -> DataFrame:
    """features: a column `feature` of the JSON's struct. A row for each shape; a feature without a geometry has one row."""
    f = F.col("feature")
    geometries = F.when(f["geometry"]["type"] == "GeometryCollection", F.transform(f["geometry"]["geometries"], lambda g: F.struct(g["type"].alias("type"), g["coordinates"].alias("coordinates")))).otherwise(F.array(F.struct(f["geometry"]["type"].alias("type"), f["geometry"]["coordinates"].alias("coordinates"))))
    each = features.select(f["properties"].alias("metadata"), F.explode(geometries).alias("g"))
    made = each.select("metadata", F.explode_outer(shapes_of(F.col("g.type"), F.col("g.coordinates"))).alias("s"))
    return finished(made.select("s.point", "s.polyline", "s.polygon", "metadata"))


def read_geojson(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Feature collections, a file each (any codec that Spark reads), or one feature a line. Nested properties stay JSON text.

    A file of one collection is parsed by one task; large data should come as lines, which split.
    """
    text = spark.read.text(path, wholetext=not lines)
    if lines:
        return from_features(text.where(F.trim("value") != "").select(F.from_json("value", _FEATURE).alias("feature")))
    whole = F.from_json("value", f"struct<type:string,features:array<{_FEATURE}>,properties:map<string,string>,geometry:struct<type:string,coordinates:string,geometries:array<struct<type:string,coordinates:string>>>>")
    parsed = text.select(whole.alias("c"))
    one = F.array(F.struct(F.col("c.type").alias("type"), F.col("c.properties").alias("properties"), F.col("c.geometry").alias("geometry")))
    return from_features(parsed.select(F.explode(F.when(F.col("c.type") == "Feature", one).otherwise(F.col("c.features"))).alias("feature")))


def write_geojson(df: DataFrame, shape: str, path: str, properties: str | None = None) -> None:
    """One feature a line; properties: a map or struct column."""
    from ..functions.geojson import feature
    from ..functions.shapes import Shape

    df.select(feature(Shape.of(df, shape), F.col(properties) if properties else None).alias("value")).write.text(path)
