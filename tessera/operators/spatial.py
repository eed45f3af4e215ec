"""Geometry on arrays of points: hulls, rasters, rings, graphs, stitching."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.joins import distances, ray_inside

RING = "array<struct<y:double,x:double>>"


def hull(y: np.ndarray, x: np.ndarray) -> list[tuple[float, float]]:
    """Closed convex hull as (y, x), counter-clockwise from the least x (H1).
    Fewer than three points come back as they are; collinear ones as their ends."""
    points = sorted(set(zip(x.tolist(), y.tolist(), strict=True)))
    if len(points) < 3:
        return [(b, a) for a, b in zip(x.tolist(), y.tolist(), strict=True)]

    def half(run) -> list:
        out: list = []
        for p in run:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    ring = half(points) + half(points[::-1])
    return [(b, a) for a, b in [*ring, ring[0]]]


def hulls(pixels: DataFrame, key: str = "cell_id", buffer: float = 0.0) -> DataFrame:
    """A hull per cell, shifted by the buffer (H1). A cell's pixels are few, so
    they are one row, and a batch holds many cells."""
    rows = pixels.groupBy(key).agg(F.collect_list("y").alias("y"), F.collect_list("x").alias("x"))

    def run(batches):
        for pdf in batches:
            rings = [hull(np.asarray(y, float) + buffer, np.asarray(x, float) + buffer) for y, x in zip(pdf["y"], pdf["x"], strict=True)]
            yield pd.DataFrame({key: pdf[key], "ring": [[{"y": a, "x": b} for a, b in ring] for ring in rings]})

    return rows.mapInPandas(run, f"{key} {dict(pixels.dtypes)[key]}, ring {RING}")


def rasterised(rings: DataFrame, key: str = "cell_id") -> DataFrame:
    """Interior pixels of rings (H2): each row of the bounding box is tested, so
    rows grow with the area only."""
    edge = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    ys = F.sequence(F.ceil(edge(F.array_min, "y")).cast("int"), F.floor(edge(F.array_max, "y")).cast("int"))
    xs = F.sequence(F.ceil(edge(F.array_min, "x")).cast("int"), F.floor(edge(F.array_max, "x")).cast("int"))
    grid = rings.withColumn("py", F.explode(ys)).withColumn("px", F.explode(xs))
    return grid.where(ray_inside(F.col("py").cast("double"), F.col("px").cast("double"), F.col("ring"))).select(key, F.col("py").alias("y"), F.col("px").alias("x"))


def expanded(ring: Column, d: float, most: float) -> Column:
    """A ring moved outward from its mean by ``d``, at most ``most - 1``, rounded
    half to even (H3)."""
    d = min(d, most - 1)
    mean = lambda c: F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[c]) / F.size(ring)

    def move(p: Column) -> Column:
        dy, dx = p["y"] - mean("y"), p["x"] - mean("x")
        far = F.sqrt(dy * dy + dx * dx)
        step = F.when(far > 0, d / far).otherwise(0.0)
        return F.struct(F.bround(p["y"] + dy * step).alias("y"), F.bround(p["x"] + dx * step).alias("x"))

    return F.transform(ring, move)


def cytoplasm(grown: DataFrame, nuclei: DataFrame, height: int, width: int, reach: float | None = None) -> DataFrame:
    """Cytoplasm pixels (H4): grown pixels inside the bounds, each to the nearest
    nucleus' cell and only if that is its own, less all nuclei. ``grown`` and
    ``nuclei`` are (cell_id, y, x). ``reach`` is more than nuclei were grown by; if
    it isn't given, the largest grown shape's diagonal, which no pixel's distance
    to its own nucleus exceeds. Cells left without one fall back to their nucleus."""
    from tessera.operators.joins import nearest

    if reach is None:
        sides = grown.unionByName(nuclei.select("cell_id", "y", "x")).groupBy("cell_id").agg((F.max("y") - F.min("y")).alias("h"), (F.max("x") - F.min("x")).alias("w"))
        reach = (sides.agg(F.max(F.sqrt(F.col("h") * F.col("h") + F.col("w") * F.col("w")))).first()[0] or 0.0) + 1.0
    inner = grown.where((F.col("y") >= 0) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("x") < width)).distinct()
    points = inner.select(F.struct("cell_id", "y", "x").alias("pixel"), F.col("y").cast("double").alias("cy"), F.col("x").cast("double").alias("cx"))
    targets = nuclei.select(F.col("cell_id").alias("owner"), F.col("y").cast("double").alias("cy"), F.col("x").cast("double").alias("cx"))
    own = nearest(points, targets, reach, point_id="pixel", target_id="owner").where("pixel.cell_id = owner").select("pixel.*")
    free = own.join(nuclei.select("y", "x").distinct(), ["y", "x"], "left_anti").select("cell_id", "y", "x")
    return free.unionByName(nuclei.join(free, "cell_id", "left_anti").select("cell_id", "y", "x"))


def box_ring(y_min: Column, x_min: Column, y_max: Column, x_max: Column) -> Column:
    """A rectangle's closed ring."""
    point = lambda y, x: F.struct(y.cast("double").alias("y"), x.cast("double").alias("x"))
    return F.array(point(y_min, x_min), point(y_min, x_max), point(y_max, x_max), point(y_max, x_min), point(y_min, x_min))


def tma_cores(features: DataFrame) -> DataFrame:
    """Cores that aren't missing: (name, ring) (H8)."""
    return features.where("not is_missing").select("name", "ring")


def waxman_edges(points: DataFrame, *, key: str, longest: float | None = None, alpha: float = 1.0, beta: float = 0.1, least: float = 0.9) -> DataFrame:
    """Waxman edges (H9): P = alpha·exp(-d/(beta·L)) above ``least`` means d below
    -beta·L·ln(least/alpha), so only near pairs are joined. L is the largest
    distance; it is attained between hull points."""
    longest = diameter(points) if longest is None else longest
    reach = -beta * longest * math.log(least / alpha)
    if reach <= 0:
        return points.sparkSession.createDataFrame([], "src long, dst long, d double, p double")
    return distances(points, reach, key=key).withColumn("p", alpha * F.exp(-F.col("d") / (beta * longest)))


def diameter(points: DataFrame) -> float:
    """The largest distance between points: a hull for each batch on the executors,
    then one for each partition of those, the few extreme points at the driver."""
    def run(batches):
        held = np.zeros((0, 2))
        for pdf in batches:
            both = np.vstack([held, pdf[["cy", "cx"]].to_numpy(float)])
            held = np.array(hull(both[:, 0], both[:, 1])).reshape(-1, 2)
        if len(held):
            yield pd.DataFrame(held, columns=["cy", "cx"])

    extremes = points.select("cy", "cx").where("cy is not null and cx is not null").mapInPandas(run, "cy double, cx double").toPandas()
    if len(extremes) < 2:
        return 0.0
    ring = np.array(hull(extremes["cy"].to_numpy(), extremes["cx"].to_numpy()))
    return float(max(np.hypot(*(ring - p).T).max() for p in ring))


def stitched(pixels: DataFrame, order: str = "selection_ord") -> DataFrame:
    """Tiles pasted on one canvas; on overlaps the later one wins."""
    return pixels.groupBy("y", "x").agg(F.max_by("v", order).alias("v"))


def canvas(tiles: DataFrame, tile: int = 1000) -> DataFrame:
    """The canvas' size."""
    return tiles.agg((F.greatest(F.coalesce(F.max("y0"), F.lit(0)), F.lit(0)) + tile).alias("height"), (F.greatest(F.coalesce(F.max("x0"), F.lit(0)), F.lit(0)) + tile).alias("width"))


def core_rect(df: DataFrame, zoom: float, shift_y: Column, shift_x: Column) -> DataFrame:
    """Display rectangles in output pixels, less the shift, not below 0."""
    out = lambda c, s: F.greatest(F.bround(F.col(c) * zoom) - s, F.lit(0)).cast("long")
    return df.withColumns({"out_y": out("y", shift_y), "out_x": out("x", shift_x)})


def disk(radius: int) -> Column:
    """Offsets (dy, dx) of a disk stamp."""
    span = F.sequence(F.lit(-radius), F.lit(radius))
    pairs = F.flatten(F.transform(span, lambda dy: F.transform(span, lambda dx: F.struct(dy.alias("dy"), dx.alias("dx")))))
    return F.filter(pairs, lambda p: p["dy"] * p["dy"] + p["dx"] * p["dx"] <= radius * radius)


def brushed(mask: DataFrame, strokes: DataFrame, radius: int, erase: bool = False) -> DataFrame:
    """The mask with disk stamps added or erased."""
    stamp = strokes.select("ty", "tx", F.explode(disk(radius)).alias("o")).select((F.col("ty") + F.col("o.dy")).alias("ty"), (F.col("tx") + F.col("o.dx")).alias("tx"))
    return mask.join(stamp, ["ty", "tx"], "left_anti") if erase else mask.union(stamp).distinct()
