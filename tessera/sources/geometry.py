"""Polygon sinks: WKB, GeoJSON features, and shapefiles for results that fit one file."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ring_wkb(ring: list[tuple[float, float]]) -> bytes:
    """A polygon of one closed ring of (x, y) as little-endian WKB."""
    return struct.pack("<BIII", 1, 3, 1, len(ring)) + b"".join(struct.pack("<dd", x, y) for x, y in ring)


def wkb_ring(data: bytes) -> list[tuple[float, float]]:
    """The first ring of a polygon in WKB of either byte order."""
    order = "<" if data[0] else ">"
    kind, rings, points = struct.unpack_from(f"{order}3I", data, 1)
    if kind != 3 or not rings:
        raise ValueError("no polygon with a ring")
    return list(struct.iter_unpack(f"{order}dd", data[13 : 13 + 16 * points]))


def to_wkb(ring: Column) -> Column:
    """Rings of (y, x) structs as WKB."""

    @F.pandas_udf("binary")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda r: None if r is None else ring_wkb([(p["x"], p["y"]) for p in r]))

    return run(F.transform(ring, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))))


def features(df: DataFrame, ring: str, properties: list[str]) -> DataFrame:
    """A GeoJSON feature per row, as text."""
    points = F.transform(ring, lambda p: F.array(p["x"], p["y"]))
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(points).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), F.struct(*properties).alias("properties"))).alias("value"))


def shapefile(rings: list[list[tuple[float, float]]], names: list[str], width: int = 80) -> dict[str, bytes]:
    """The three files of a polygon shapefile with a name column (A15). The format
    is one file, so this is for annotation layers, not for cells."""

    def box(points: list[tuple[float, float]]) -> tuple[float, float, float, float]:
        xs, ys = [p[0] for p in points] or [0.0], [p[1] for p in points] or [0.0]
        return min(xs), min(ys), max(xs), max(ys)

    def head(words: int) -> bytes:
        every = box([p for r in rings for p in r])
        return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i", 1000, 5) + struct.pack("<4d", *every) + struct.pack("<4d", 0, 0, 0, 0)

    shp, shx, at = b"", b"", 50
    for i, ring in enumerate(rings, 1):
        body = struct.pack("<i4d3i", 5, *box(ring), 1, len(ring), 0) + b"".join(struct.pack("<dd", *p) for p in ring)
        shp += struct.pack(">2i", i, len(body) // 2) + body
        shx += struct.pack(">2i", at, len(body) // 2)
        at += 4 + len(body) // 2
    row = lambda n: b" " + n.encode("utf-8")[:width].ljust(width)
    dbf = struct.pack("<4BIHH20x", 3, 100, 1, 1, len(names), 65, 1 + width) + struct.pack("<11sc4xBB14x", b"annotation", b"C", width, 0) + b"\r" + b"".join(map(row, names)) + b"\x1a"
    return {"shp": head(50 + len(shp) // 2) + shp, "shx": head(50 + len(shx) // 2) + shx, "dbf": dbf}
