"""Small spatial files made of the nation table, for the queries of the readers. Bytes go through Hadoop's file system API."""

from __future__ import annotations

import struct
import uuid

from pyspark.sql import SparkSession

from ..operators.shared import checkpoint_dir
from .inputs import DIAMOND, HALF, SQUARE


def put(spark: SparkSession, files: dict[str, bytes]) -> str:
    """A new folder below the shared one, with these files."""
    folder = f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name, data in files.items():
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        out = path.getFileSystem(conf).create(path)
        out.write(bytearray(data))
        out.close()
    return folder


def nation_rows(spark: SparkSession, d: str) -> list[tuple[int, str, float, float]]:
    """Key, name and centre of the 25 nations, in order of the key."""
    from .inputs import NX, NY

    rows = spark.read.parquet(f"{d}/nation.parquet").selectExpr("n_nationkey", "n_name", f"{NX} AS cx", f"{NY} AS cy").orderBy("n_nationkey").collect()
    return [tuple(r) for r in rows]


def moved(cx: float, cy: float, ring: tuple) -> list[tuple[float, float]]:
    return [(cx + dx, cy + dy) for dx, dy in ring]


def multipart(parts: list[list[tuple[float, float]]], heights: bool = False) -> bytes:
    """A record's content after its type: box, numbers of parts and vertices, first vertices, vertices; zeros as heights and measures."""
    every = [v for part in parts for v in part]
    xs, ys = zip(*every)
    firsts = [sum(map(len, parts[:i])) for i in range(len(parts))]
    out = struct.pack("<4d2i", min(xs), min(ys), max(xs), max(ys), len(parts), len(every)) + struct.pack(f"<{len(parts)}i", *firsts)
    out += b"".join(struct.pack("<2d", *v) for v in every)
    return out + (struct.pack(f"<{2 + len(every)}d", *[0.0] * (2 + len(every))) * 2 if heights else b"")


def shapefile(kind: int, contents: list[bytes | None]) -> tuple[bytes, bytes]:
    """The .shp and the .shx of records of one type; None is a null shape."""
    records, index, words = [], [], 50
    for number, content in enumerate(contents, 1):
        data = struct.pack("<i", 0) if content is None else struct.pack("<i", kind) + content
        index.append(struct.pack(">2i", words, len(data) // 2))
        records.append(struct.pack(">2i", number, len(data) // 2) + data)
        words += 4 + len(data) // 2

    def whole(body: bytes) -> bytes:
        return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 50 + len(body) // 2) + struct.pack("<2i", 1000, kind) + bytes(64) + body

    return whole(b"".join(records)), whole(b"".join(index))


def dbase(fields: list[tuple[str, str, int]], rows: list[tuple[str, ...]]) -> bytes:
    """A .dbf of text rows. fields: name, type letter, width."""
    head = struct.pack("<4BIHH20x", 3, 124, 1, 1, len(rows), 33 + 32 * len(fields), 1 + sum(w for *_, w in fields))
    for name, letter, width in fields:
        head += struct.pack("<11sc4xBB14x", name.encode(), letter.encode(), width, 0)
    return head + b"\r" + b"".join(b" " + b"".join(v.encode().ljust(w) for v, (*_, w) in zip(row, fields)) for row in rows) + b"\x1a"


def nation_shapefiles(rows: list[tuple[int, str, float, float]]) -> dict[str, bytes]:
    """areas (a square with a hole; null for every seventh), spots, roads (two parts) and ridges (with heights), each with its .dbf."""
    kinds = {
        "areas": (5, [None if k % 7 == 0 else multipart([moved(x, y, SQUARE), moved(x, y, HALF)]) for k, _, x, y in rows]),
        "spots": (1, [struct.pack("<2d", x, y) for _, _, x, y in rows]),
        "roads": (3, [multipart([moved(x, y, DIAMOND), moved(x, y, HALF[:3])]) for _, _, x, y in rows]),
        "ridges": (13, [multipart([moved(x, y, HALF)], heights=True) for _, _, x, y in rows]),
    }
    out = {}
    for name, (kind, contents) in kinds.items():
        out[f"{name}.shp"], out[f"{name}.shx"] = shapefile(kind, contents)
        out[f"{name}.dbf"] = dbase([("NAME", "C", 25), ("KEY", "N", 6), ("LAYER", "C", 8)], [(n, str(k), name) for k, n, _, _ in rows])
    return out
