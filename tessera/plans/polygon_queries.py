"""Queries on annotation polygons that are no boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import aggregates, polygons
from tessera.plans.registry import query

c = F.col


def _ring(*points: tuple[str, str]):
    """A closed ring of (x, y) expressions."""
    return F.array(*[F.struct(F.expr(y).cast("double").alias("y"), F.expr(x).cast("double").alias("x")) for x, y in (*points, points[0])])


def outlines(df: DataFrame) -> DataFrame:
    """Rings of the view ``outline``: triangles, Ls, and boxes with a hole."""
    triangle = F.array(_ring(("x_min", "y_min"), ("x_max", "y_min"), ("x_min", "y_max")))
    ell = F.array(_ring(("x_min", "y_min"), ("x_max", "y_min"), ("x_max", "y_min + b"), ("x_min + a", "y_min + b"), ("x_min + a", "y_max"), ("x_min", "y_max")))
    box = _ring(("x_min", "y_min"), ("x_max", "y_min"), ("x_max", "y_max"), ("x_min", "y_max"))
    hole = _ring(("x_min + 100", "y_min + 100"), ("x_min + 100", "y_min + 200"), ("x_min + 200", "y_min + 200"), ("x_min + 200", "y_min + 100"))
    return df.select("ann_id", "name", F.when(c("kind") == 0, triangle).when(c("kind") == 1, ell).otherwise(F.array(box, hole)).alias("rings"))


def nested(df: DataFrame) -> DataFrame:
    """Outlines, and a small triangle in the first corner of each."""
    small = F.array(_ring(("x_min + 10", "y_min + 10"), ("x_min + 60", "y_min + 10"), ("x_min + 10", "y_min + 60")))
    return outlines(df).union(df.select((c("ann_id") + 1000).alias("ann_id"), "name", small))


_W, _H = "(x_max - x_min)", "(y_max - y_min)"
_AREA = f"CASE kind WHEN 0 THEN {_W} * {_H} / 2.0 WHEN 1 THEN {_W} * {_H} - ({_W} - a) * ({_H} - b) ELSE {_W} * {_H} - 10000 END"
_INSIDE = f"""y > y_min AND x > x_min AND y < y_max AND x < x_max AND CASE kind WHEN 0 THEN (x - x_min) * {_H} + (y - y_min) * {_W} < {_W} * {_H}
  WHEN 1 THEN y < y_min + b OR x < x_min + a ELSE NOT (y BETWEEN y_min + 100 AND y_min + 200 AND x BETWEEN x_min + 100 AND x_min + 200) END"""


@query("c8_within_polygons", f"SELECT cell_id, ann_id FROM cells LEFT JOIN outline ON {_INSIDE}")
def _(v):
    return polygons.within(v["cells"], outlines(v["outline"]), key="cell_id", how="left").select("cell_id", "ann_id")


@query("d16_polygon_labels", f"SELECT cell_id, coalesce(string_agg(name, ',' ORDER BY ann_id), 'Undefined') AS name FROM cells LEFT JOIN outline ON {_INSIDE} GROUP BY cell_id")
def _(v):
    hits = polygons.within(v["cells"], outlines(v["outline"]), key="cell_id", how="left")
    return aggregates.joined_labels(hits, "cell_id", "ann_id", "name")


@query("d17_polygon_area", f"SELECT name, round(sum({_AREA})::DOUBLE, 6) AS pixel_area FROM outline GROUP BY name")
def _(v):
    return outlines(v["outline"]).groupBy("name").agg(F.round(F.sum(polygons.polygon_area(c("rings"))), 6).alias("pixel_area"))


@query("d13_population_by_annotation", f"""SELECT ann_id, name, CAST(count(*) FILTER (m1_expression AND NOT m2_expression) AS BIGINT) AS n, round(100.0 * count(*) FILTER (m1_expression AND NOT m2_expression) / nullif(count(cell_id), 0), 6) AS percent,
  round(count(*) FILTER (m1_expression AND NOT m2_expression) / (any_value({_AREA}) * 0.5::DOUBLE * 0.5 * 1e-6), 6) AS per_mm2 FROM outline LEFT JOIN cellinfo ON {_INSIDE.replace("y >", "cellinfo.y >", 1)} GROUP BY ann_id, name""")
def _(v):
    found = polygons.population_by_annotation(v["cellinfo"], outlines(v["outline"]), c("m1_expression") & ~c("m2_expression"), scale=0.5)
    return found.select("ann_id", "name", "n", F.round("percent", 6).alias("percent"), F.round("per_mm2", 6).alias("per_mm2"))


@query("c9_polygon_containment")
def _(v):
    return polygons.containment(nested(v["outline"]))


@query("d17_polygon_union_area")
def _(v):
    return polygons.union_area(outlines(v["outline"])).select(F.round("area", 3).alias("area"))


@query("d19_polygon_overlap_counts")
def _(v):
    return polygons.overlap_counts(outlines(v["outline"]))


@query("f7_polygon_difference_all")
def _(v):
    return polygons.less_contained(nested(v["outline"])).select("ann_id", F.round("area", 3).alias("area"), F.size("rings").alias("parts"))


@query("h7_self_crossing_rings", "SELECT ann_id, ann_id % 3 = 0 AS is_valid FROM ann")
def _(v):
    """Boxes, bow ties and rings that don't close."""
    box = _ring(("x_min", "y_min"), ("x_max", "y_min"), ("x_max", "y_max"), ("x_min", "y_max"))
    tie = _ring(("x_min", "y_min"), ("x_max", "y_max"), ("x_max", "y_min"), ("x_min", "y_max"))
    ring = F.when(c("ann_id") % 3 == 0, box).when(c("ann_id") % 3 == 1, tie).otherwise(F.slice(box, 1, 4))
    return polygons.valid_rings(v["ann"].select("ann_id", ring.alias("ring"))).select("ann_id", "is_valid")
