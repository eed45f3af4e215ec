"""Polygons with any outline and holes: area, overlay, nesting, validity.

A polygon is an array of closed rings of (y, x) points, the outline first and
holes after it; a point is inside if a ray from it crosses the rings an odd
number of times. Overlays cut the plane at every vertex and crossing into upright
slabs, in which no two edges cross, so that areas are exact and results are
trapezoids. Pairs are found by bounding boxes on a grid, never all with all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.aggregates import ring_area
from tessera.operators.joins import in_boxes, overlaps, ray_crossings, ray_on_edge

POLYGON = "array<array<struct<y:double,x:double>>>"


def edges_of(polygons: list[list[list[dict]]]) -> np.ndarray:
    """Edges from left to right: x0, y0, x1, y1 and the polygon's number; upright ones bound no slab."""
    rows = [(a["x"], a["y"], b["x"], b["y"], k) for k, rings in enumerate(polygons) for ring in rings for a, b in zip(ring, ring[1:])]
    edges = np.array([r if r[0] < r[2] else (r[2], r[3], r[0], r[1], r[4]) for r in rows if r[0] != r[2]], float)
    return edges.reshape(-1, 5)


def crossings(edges: np.ndarray) -> np.ndarray:
    """The x of every proper crossing of two edges."""
    out = []
    for i, (x0, y0, x1, y1, _) in enumerate(edges):
        o = edges[i + 1 :]
        dx, dy, ox, oy = x1 - x0, y1 - y0, o[:, 2] - o[:, 0], o[:, 3] - o[:, 1]
        cross = dx * oy - dy * ox
        with np.errstate(divide="ignore", invalid="ignore"):
            t = ((o[:, 0] - x0) * oy - (o[:, 1] - y0) * ox) / cross
            u = ((o[:, 0] - x0) * dy - (o[:, 1] - y0) * dx) / cross
        out.append(x0 + t[(cross != 0) & (t > 0) & (t < 1) & (u >= 0) & (u <= 1)] * dx)
    return np.concatenate(out) if out else np.zeros(0)


def trapezoids(polygons: list[list[list[dict]]], keep: Callable[[np.ndarray], bool], low: float = -np.inf, high: float = np.inf) -> Iterator[tuple[float, ...]]:
    """Trapezoids (x0, x1, lower y at x0 and x1, upper y at x0 and x1) of the region
    between ``low`` and ``high`` where ``keep``, given which polygons one is inside of, holds."""
    edges = edges_of(polygons)
    if not len(edges):
        return
    stops = np.unique(np.clip(np.concatenate([edges[:, 0], edges[:, 2], crossings(edges)]), low, high))
    for a, b in zip(stops[:-1].tolist(), stops[1:].tolist()):
        mid = (a + b) / 2
        here = edges[(edges[:, 0] < mid) & (edges[:, 2] > mid)]
        slope = (here[:, 3] - here[:, 1]) / (here[:, 2] - here[:, 0])
        order = np.argsort(here[:, 1] + slope * (mid - here[:, 0]), kind="stable")
        here, slope = here[order], slope[order]
        at = [here[:, 1] + slope * (x - here[:, 0]) for x in (a, b)]
        inside = np.zeros(len(polygons), bool)
        for i in range(len(here) - 1):
            inside[int(here[i, 4])] ^= True
            if keep(inside):
                yield a, b, float(at[0][i]), float(at[1][i]), float(at[0][i + 1]), float(at[1][i + 1])


def area_where(polygons: list, keep: Callable[[np.ndarray], bool], low: float = -np.inf, high: float = np.inf) -> float:
    return sum((b - a) * (u0 + u1 - l0 - l1) / 2 for a, b, l0, l1, u0, u1 in trapezoids(polygons, keep, low, high))


def is_simple(ring: list[dict] | None) -> bool:
    """Whether a ring closes, has some area, and meets itself only where edges follow
    each other (H7)."""
    if not ring or len(ring) < 4 or ring[0] != ring[-1] or any(p is None or p["y"] is None or p["x"] is None for p in ring):
        return False
    p = np.array([(q["x"], q["y"]) for q in ring], float)
    d = np.diff(p, axis=0)
    if (np.abs(d).sum(axis=1) == 0).any() or abs((p[:-1, 0] * p[1:, 1] - p[1:, 0] * p[:-1, 1]).sum()) == 0:
        return False

    def side(o: np.ndarray, v: np.ndarray, q: np.ndarray) -> np.ndarray:
        return np.sign(v[0] * (q[:, 1] - o[1]) - v[1] * (q[:, 0] - o[0]))

    n = len(d)
    for i in range(n):
        a, b = p[:-1], p[1:]
        s1, s2 = side(p[i], d[i], a), side(p[i], d[i], b)
        t1 = np.sign(d[:, 0] * (p[i, 1] - a[:, 1]) - d[:, 1] * (p[i, 0] - a[:, 0]))
        t2 = np.sign(d[:, 0] * (p[i + 1, 1] - a[:, 1]) - d[:, 1] * (p[i + 1, 0] - a[:, 0]))
        boxes = (np.minimum(a, b) <= np.maximum(p[i], p[i + 1])).all(axis=1) & (np.maximum(a, b) >= np.minimum(p[i], p[i + 1])).all(axis=1)
        meet = (s1 * s2 <= 0) & (t1 * t2 <= 0) & boxes
        near = np.array([(i - 1) % n, i, (i + 1) % n])
        meet[near] = False
        if meet.any():
            return False
        # The next edge may not run back over this one.
        j = (i + 1) % n
        if d[i, 0] * d[j, 1] == d[i, 1] * d[j, 0] and (d[i] * d[j]).sum() < 0:
            return False
    return True


def valid_rings(rings: DataFrame, ring: str = "ring") -> DataFrame:
    """``rings`` with is_valid (H7). Invalid ones are told apart rather than repaired."""
    def test(column: pa.Array) -> pa.Array:
        return pa.array([is_simple(r) for r in column.to_pylist()], pa.bool_())

    return rings.withColumn("is_valid", F.arrow_udf(test, "boolean")(F.col(ring)))


def polygon_area(rings: Column) -> Column:
    """The outline's area less the holes' (D17)."""
    return F.aggregate(rings, F.lit(0.0), lambda s, r: s - ring_area(r)) + 2 * ring_area(F.get(rings, 0))


def inside_polygon(y: Column, x: Column, rings: Column) -> Column:
    """Whether a point is strictly inside."""
    odd = F.aggregate(rings, F.lit(0), lambda s, r: s + ray_crossings(y, x, r)) % 2 == 1
    return odd & ~F.exists(rings, lambda r: ray_on_edge(y, x, r))


def boxed(polygons: DataFrame, rings: str = "rings") -> DataFrame:
    """Polygons with the bounds of their outline."""
    outline = F.get(F.col(rings), 0)
    edge = lambda f, c: f(F.transform(outline, lambda p: p[c]))
    return polygons.withColumns({f"{c}_{n}": edge(f, c) for c in "yx" for n, f in (("min", F.array_min), ("max", F.array_max))})


def within(points: DataFrame, polygons: DataFrame, *, key: str, how: str = "inner", grid: float = 500.0) -> DataFrame:
    """All polygons that a point (y, x) lies in (C8); with ``how="left"`` points in
    none stay, once, with nulls."""
    near = in_boxes(points.select(key, "y", "x"), boxed(polygons), grid=grid)
    hits = near.where(inside_polygon(F.col("y").cast("double"), F.col("x").cast("double"), F.col("rings"))).select(key, *polygons.columns)
    return points.join(hits, key, how)


def _pair_area(keep: Callable[[np.ndarray], bool]) -> Callable:
    def area(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([area_where([p, q], keep) for p, q in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())

    return F.arrow_udf(area, "double")


def _pairs(polygons: DataFrame, grid: float) -> DataFrame:
    """Pairs (a_id < b_id) whose bounds overlap, with names and rings of both."""
    close = overlaps(boxed(polygons), grid=grid)
    one = lambda s: polygons.select(F.col("ann_id").alias(f"{s}_key"), F.col("rings").alias(f"{s}_rings"))
    return close.join(one("a"), F.col("a_id") == F.col("a_key")).join(one("b"), F.col("b_id") == F.col("b_key")).drop("a_key", "b_key")


def overlap_pairs(polygons: DataFrame, *, grid: float = 500.0) -> DataFrame:
    """Pairs of polygons (a_id < b_id, with names) that share area, and how much."""
    both = _pair_area(lambda inside: bool(inside.all()))
    return _pairs(polygons, grid).withColumn("area", both("a_rings", "b_rings")).where("area > 0").select("a_id", "b_id", "a_name", "b_name", "area")


def overlap_counts(polygons: DataFrame, *, grid: float = 500.0) -> DataFrame:
    """Overlapping pairs per unordered pair of names."""
    names = [F.least("a_name", "b_name").alias("name_1"), F.greatest("a_name", "b_name").alias("name_2")]
    return overlap_pairs(polygons, grid=grid).groupBy(*names).agg(F.count("*").alias("n"))


def containment(polygons: DataFrame, *, grid: float = 500.0) -> DataFrame:
    """Pairs (outer_id, inner_id): all of the inner polygon lies in the outer one."""
    pairs = _pairs(polygons, grid)
    beyond = _pair_area(lambda inside: bool(inside[0] and not inside[1]))
    measured = pairs.select("a_id", "b_id", polygon_area(F.col("a_rings")).alias("aa"), polygon_area(F.col("b_rings")).alias("ba"), beyond("a_rings", "b_rings").alias("ab"), beyond("b_rings", "a_rings").alias("bb"))
    ways = F.array(*[F.struct(F.col(o).alias("outer_id"), F.col(i).alias("inner_id"), (F.col(rest) <= 1e-9 * F.col(own)).alias("held")) for o, i, rest, own in (("b_id", "a_id", "ab", "aa"), ("a_id", "b_id", "bb", "ba"))])
    return measured.select(F.explode(ways).alias("w")).where("w.held").select("w.outer_id", "w.inner_id")


def union_area(polygons: DataFrame, *, strip: float = 1000.0) -> DataFrame:
    """Area covered by at least one polygon (D17). The plane is cut into upright
    strips, each measured by itself, so a task holds what meets one strip."""
    bounds = boxed(polygons)
    strips = F.sequence(F.floor(F.col("x_min") / strip).cast("long"), F.floor(F.col("x_max") / strip).cast("long"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["strip"].iloc[0])
        return pd.DataFrame({"area": [area_where([[list(r) for r in p] for p in pdf["rings"]], lambda inside: bool(inside.any()), k * strip, (k + 1) * strip)]})

    parts = bounds.select("rings", F.explode(strips).alias("strip")).groupBy("strip").applyInPandas(run, "area double")
    return parts.agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("area"))


def less_contained(polygons: DataFrame, *, grid: float = 500.0) -> DataFrame:
    """Every polygon less all polygons inside it (F7, H11): ann_id, its area and its
    trapezoids as closed rings. Polygons with nothing inside go the same way."""
    inner = polygons.select(F.col("ann_id").alias("i"), F.col("rings").alias("hole"))
    held = containment(polygons, grid=grid).where("outer_id <> inner_id").join(inner, F.col("inner_id") == F.col("i"))
    holes = held.groupBy(F.col("outer_id").alias("o")).agg(F.collect_list("hole").alias("holes"))
    joined = polygons.join(holes, F.col("ann_id") == F.col("o"), "left")
    rest = "struct<area:double,rings:array<array<struct<y:double,x:double>>>>"

    def cut(rings: pa.Array, others: pa.Array) -> pa.Array:
        out = []
        for p, q in zip(rings.to_pylist(), others.to_pylist(), strict=True):
            found = list(trapezoids([p, *(q or [])], lambda inside: bool(inside[0] and not inside[1:].any())))
            shapes = [[{"y": l0, "x": a}, {"y": l1, "x": b}, {"y": u1, "x": b}, {"y": u0, "x": a}, {"y": l0, "x": a}] for a, b, l0, l1, u0, u1 in found]
            out.append({"area": sum((b - a) * (u0 + u1 - l0 - l1) / 2 for a, b, l0, l1, u0, u1 in found), "rings": shapes})
        point = pa.struct([("y", pa.float64()), ("x", pa.float64())])
        return pa.array(out, pa.struct([("area", pa.float64()), ("rings", pa.list_(pa.list_(point)))]))

    return joined.withColumn("_rest", F.arrow_udf(cut, rest)("rings", "holes")).select("ann_id", "_rest.area", "_rest.rings")


def population_by_annotation(cells: DataFrame, polygons: DataFrame, member: Column, *, key: str = "cell_id", scale: float = 1.0) -> DataFrame:
    """Count, percent and cells per square millimetre inside every annotation (D13);
    ``scale`` is micrometres a pixel."""
    hits = within(cells, polygons.select("ann_id", "rings"), key=key)
    counts = hits.groupBy(F.col("ann_id").alias("a")).agg(F.sum(member.cast("int")).cast("long").alias("n"), F.count("*").alias("n_all"))
    joined = polygons.join(counts, F.col("ann_id") == F.col("a"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    area = polygon_area(F.col("rings")) * scale * scale * 1e-6
    return joined.select("ann_id", "name", "n", (100.0 * F.col("n") / F.col("n_all")).alias("percent"), (F.col("n") / area).alias("per_mm2"))
