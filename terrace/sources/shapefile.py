"""Shapefiles: .shp geometry with .dbf attributes, and .shx record offsets.

Files come through Spark's binaryFile source, so any store that Spark reads will do. A file is read by one task. Where it
has a .shx, its offsets plan splits of about SPLIT_BYTES, which are cut out of the content in the JVM and dealt over the
cluster, so many tasks decode one file; a file without a .shx is one split. Records are joined with attributes by file and
by the record number in the record's header.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import shapes as S
from .geojson import finished

#: Shape types of the format, fixed values.
NULL, POINT, POLYLINE, POLYGON, MULTIPOINT, POINT_Z, POLYLINE_Z, POLYGON_Z, MULTIPOINT_Z = 0, 1, 3, 5, 8, 11, 13, 15, 18
POINT_M, POLYLINE_M, POLYGON_M, MULTIPOINT_M = 21, 23, 25, 28


def shp_records(data: bytes) -> Iterator[tuple[int, int, list[int], list[float], list[float]]]:
    """(record number, 1, 3, 5 or 0 for null, first vertex of each part, xs, ys). Z and M are left out; a multipoint gives points."""
    if len(data) < 100 or struct.unpack(">i", data[:4])[0] != 9994:
        raise ValueError("not a shapefile")
    yield from records_of(data, 100, min(len(data), 2 * struct.unpack(">i", data[24:28])[0]))


def records_of(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[int, int, list[int], list[float], list[float]]]:
    """As shp_records, of the records from one place of the bytes to another."""
    end = len(data) if end is None else end
    while at + 12 <= end:
        number, words = struct.unpack_from(">ii", data, at)
        body, at = at + 8, at + 8 + 2 * words
        (kind,) = struct.unpack_from("<i", data, body)
        if kind == NULL:
            yield number, 0, [], [], []
        elif kind in (POINT, POINT_Z, POINT_M):
            x, y = struct.unpack_from("<dd", data, body + 4)
            yield number, 1, [0], [x], [y]
        elif kind in (POLYLINE, POLYGON, POLYLINE_Z, POLYGON_Z, POLYLINE_M, POLYGON_M):
            parts, n = struct.unpack_from("<ii", data, body + 36)
            firsts = list(struct.unpack_from(f"<{parts}i", data, body + 44))
            values = struct.unpack_from(f"<{2 * n}d", data, body + 44 + 4 * parts)
            yield number, 3 if kind % 10 == 3 else 5, firsts, list(values[::2]), list(values[1::2])
        elif kind in (MULTIPOINT, MULTIPOINT_Z, MULTIPOINT_M):
            (n,) = struct.unpack_from("<i", data, body + 36)
            values = struct.unpack_from(f"<{2 * n}d", data, body + 40)
            for x, y in zip(values[::2], values[1::2]):
                yield number, 1, [0], [x], [y]
        else:
            raise ValueError(f"shape type {kind} isn't supported")


def shx_offsets(data: bytes) -> list[tuple[int, int]]:
    """(offset, length) in bytes of each record."""
    if struct.unpack(">i", data[:4])[0] != 9994 or struct.unpack("<i", data[28:32])[0] != 1000:
        raise ValueError("not a shapefile index")
    n = (2 * struct.unpack(">i", data[24:28])[0] - 100) // 8
    return [(2 * a, 2 * b) for a, b in struct.iter_unpack(">ii", data[100 : 100 + 8 * n])]


def dbf_records(data: bytes, trim: bool = True, encoding: str = "utf-8") -> Iterator[tuple[int, dict[str, str | None]]]:
    """(record number from 1, fields as text). Deleted records are skipped but counted."""
    n, header, width = struct.unpack_from("<ihh", data, 4)
    fields, at = [], 32
    while data[at] != 0x0D:
        name = data[at : at + 11].split(b"\0")[0].decode("ascii", "replace")
        fields.append((name, chr(data[at + 11]), data[at + 16]))
        at += 32
    for i in range(n):
        at = header + i * width
        if at >= len(data) or data[at] == 0x1A:
            return
        if data[at] == 0x2A:
            continue
        at, out = at + 1, {}
        for name, kind, size in fields:
            value = data[at : at + size].decode(encoding, "replace")
            out[name] = value.strip() if trim and kind in "NFDL" else value.rstrip(" \0") if trim else value
            at += size
        yield i + 1, out


def _binary(spark: SparkSession, path: str, extension: str) -> DataFrame:
    """file (without its extension), content"""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{extension}").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_replace("path", r"(?i)\.[a-z]+$", "").alias("file"), "content")


#: Bytes of a .shp that a task decodes at a time.
SPLIT_BYTES = 16 << 20


def splits(spark: SparkSession, path: str, size: int = SPLIT_BYTES) -> DataFrame:
    """file, start, length: stretches of whole records, of about `size` bytes, of each .shp that has a .shx."""
    records = read_shx(spark, path).withColumn("split", F.floor(F.col("offset") / size))
    each = records.groupBy("file", "split").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length") + 8).alias("end"))
    return each.select("file", "start", (F.col("end") - F.col("start")).alias("length"))


def read_shp(spark: SparkSession, path: str, size: int = SPLIT_BYTES) -> DataFrame:
    """file, record, kind (1, 3, 5; 0 for null), indices, xs, ys"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("record", pa.int32()), ("kind", pa.int32()), ("indices", pa.list_(pa.int32())), ("xs", pa.list_(pa.float64())), ("ys", pa.list_(pa.float64()))])
        for batch in batches:
            for name, start, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                held: list[tuple] = []
                for record in (shp_records if start is None else records_of)(content.as_py()):
                    held.append((name, *record))
                    if len(held) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    planned = splits(spark, path, size).groupBy("file").agg(F.collect_list(F.struct("start", "length")).alias("planned"))  # of one file
    files = _binary(spark, path, "shp").join(planned, "file", "left").select("file", "content", F.explode_outer("planned").alias("split"))
    part = F.when(F.col("split").isNull(), F.col("content")).otherwise(F.substring("content", F.col("split.start").cast("int") + 1, F.col("split.length").cast("int")))
    dealt = files.select("file", F.col("split.start").alias("start"), part.alias("part")).repartition("file", "start")
    return dealt.mapInArrow(run, "file string, record int, kind int, indices array<int>, xs array<double>, ys array<double>")


def read_dbf(spark: SparkSession, path: str, trim: bool = True) -> DataFrame:
    """file, record, metadata (map of text)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("record", pa.int32()), ("metadata", pa.map_(pa.string(), pa.string()))])
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = [(name, i, list(x.items())) for i, x in dbf_records(content.as_py(), trim)]
                for a in range(0, len(rows), 5000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 5000]), schema.types)], schema=schema)

    return _binary(spark, path, "dbf").mapInArrow(run, "file string, record int, metadata map<string,string>")


def read_shx(spark: SparkSession, path: str) -> DataFrame:
    """file, record, offset, length of each record, in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = [(name, i + 1, a, b) for i, (a, b) in enumerate(shx_offsets(content.as_py()))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.int64(), pa.int64()))], names=["file", "record", "offset", "length"])

    return _binary(spark, path, "shx").mapInArrow(run, "file string, record int, offset long, length long")


def read_shapefile(spark: SparkSession, path: str, trim: bool = True, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """point, polyline, polygon, metadata, valid of every record below a path. metadata is null without a .dbf row."""
    k = F.col("kind")
    rows = read_shp(spark, path, split_bytes).join(read_dbf(spark, path, trim), ["file", "record"], "left")
    return finished(
        rows.select(
            F.when(k == 1, S.point_or_null(F.get("xs", F.lit(0)), F.get("ys", F.lit(0)))).alias("point"),
            F.when(k == 3, S.polyline("indices", "xs", "ys")).alias("polyline"),
            F.when(k == 5, S.polygon("indices", "xs", "ys")).alias("polygon"),
            "metadata",
        )
    )
