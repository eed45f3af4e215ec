"""Joins on cell tables: keyed, semi and anti, overlay, and spatial joins by grid buckets.

Spatial joins never compare all pairs: one side is dealt into grid cells, the
other into every grid cell it can meet, and an equi-join on the cell is followed
by the exact predicate. AQE splits crowded cells.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources import store


def zip_markers(frames: dict[str, DataFrame], key: str = "cell_id") -> DataFrame:
    """Per-marker tables side by side on their key, columns named ``{marker}_…``."""
    named = [df.select(key, *[F.col(c).alias(f"{m}_{c}") for c in df.columns if c != key]) for m, df in frames.items()]
    return reduce(lambda a, b: a.join(b, key), named)


def lookup(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join of a keyed lookup table (C3, C17); the planner broadcasts it if it is small."""
    return df.join(table, key, "left")


def _bucket(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("long")


def band_join(left: DataFrame, right: DataFrame, radius: float, *, y: str = "cy", x: str = "cx") -> DataFrame:
    """Pairs closer than ``radius`` on both axes, strictly (C4). Columns of
    ``right`` get the suffix ``_r``."""
    other = right.select([F.col(c).alias(f"{c}_r") for c in right.columns])
    near = [F.explode(F.sequence(_bucket(F.col(f"{c}_r") - radius, radius), _bucket(F.col(f"{c}_r") + radius, radius))) for c in (y, x)]
    other = other.withColumn("_by", near[0]).withColumn("_bx", near[1])
    mine = left.withColumns({"_by": _bucket(F.col(y), radius), "_bx": _bucket(F.col(x), radius)})
    hit = (F.abs(F.col(y) - F.col(f"{y}_r")) < radius) & (F.abs(F.col(x) - F.col(f"{x}_r")) < radius)
    return mine.join(other, ["_by", "_bx"]).where(hit).drop("_by", "_bx")


def support(det: DataFrame, radius: float = 5.0) -> DataFrame:
    """Per detection, in how many other stains one lies within the box (C4)."""
    pairs = band_join(det, det, radius).where("stain <> stain_r")
    return pairs.groupBy("det_id").agg(F.count_distinct("stain_r").alias("support"))


def _nearest_within(points: DataFrame, targets: DataFrame, radius: float, point_id: str, target_id: str) -> DataFrame:
    """Each point's nearest target closer than ``radius``: (point_id, target_id, d2).
    Points, not targets, are sent to the up to four cells they reach. Nothing is
    broadcast, as the planner takes the copies for as few as the points."""
    size = 2 * radius
    p = points.select(F.col(point_id).alias("p"), F.col("cy").alias("py"), F.col("cx").alias("px"))
    t = targets.select(F.col(target_id).alias("t"), F.col("cy").alias("ty"), F.col("cx").alias("tx"))
    for c in "yx":
        p = p.withColumn(f"_b{c}", F.explode(F.sequence(_bucket(F.col(f"p{c}") - radius, size), _bucket(F.col(f"p{c}") + radius, size))))
        t = t.withColumn(f"_b{c}", _bucket(F.col(f"t{c}"), size))
    d2 = F.pow(F.col("py") - F.col("ty"), 2) + F.pow(F.col("px") - F.col("tx"), 2)
    pairs = p.hint("merge").join(t, ["_by", "_bx"]).select("p", "t", d2.alias("d2")).where(F.col("d2") < radius * radius)
    best = pairs.groupBy("p").agg(F.min(F.struct("d2", "t")).alias("b"))
    return best.select(F.col("p").alias(point_id), F.col("b.t").alias(target_id), F.col("b.d2").alias("d2"))


def _crowding(targets: DataFrame, size: float) -> float:
    """Among how many targets of its grid cell a target lies, on average."""
    counts = targets.where("cy is not null and cx is not null").groupBy(_bucket(F.col("cy"), size), _bucket(F.col("cx"), size)).agg(F.count("*").cast("double").alias("n"))
    return counts.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 0.0


def nearest(points: DataFrame, targets: DataFrame, radius: float, *, point_id: str, target_id: str, few: int = 64) -> DataFrame:
    """Each point's nearest target within ``radius`` (C5); equal distances go to the smaller id.

    Where more than ``few`` targets share a cell of that size, pairs would grow with
    the square of the density. Then targets of one place become that with the
    smallest id, and the search starts at the radius that meets about two; points
    that found none search twice as far, up to ``radius``. One found closer than
    the radius searched is the nearest of all."""
    if _crowding(targets, radius) <= few:
        return _nearest_within(points, targets, radius, point_id, target_id)
    points = store.saved(points.where("cy is not null and cx is not null").select(point_id, "cy", "cx"))
    targets = store.saved(targets.where("cy is not null and cx is not null").groupBy("cy", "cx").agg(F.min(target_id).alias(target_id)))
    r, found = radius * min(1.0, (2 / _crowding(targets, radius)) ** 0.5), []
    while True:
        best = _nearest_within(points, targets, r, point_id, target_id)
        if r >= radius:
            return reduce(DataFrame.union, [*found, best])
        found.append(best := store.saved(best))
        done = best.select(F.col(point_id).alias("_done"))
        points = store.saved(points.join(done, F.col(point_id).eqNullSafe(F.col("_done")), "left_anti"))
        if points.isEmpty():
            return reduce(DataFrame.union, found)
        r = min(2 * r, radius)


def in_boxes(points: DataFrame, boxes: DataFrame, *, grid: float = 500.0, how: str = "inner") -> DataFrame:
    """Points (y, x) strictly inside boxes (y_min, y_max, x_min, x_max)."""
    spread = boxes
    for c in ("y", "x"):
        spread = spread.withColumn(f"_b{c}", F.explode(F.sequence(_bucket(F.col(f"{c}_min"), grid), _bucket(F.col(f"{c}_max"), grid))))
    mine = points.withColumns({"_by": _bucket(F.col("y"), grid), "_bx": _bucket(F.col("x"), grid)})
    inside = (mine["_by"] == spread["_by"]) & (mine["_bx"] == spread["_bx"])
    inside = inside & (F.col("y") > F.col("y_min")) & (F.col("y") < F.col("y_max")) & (F.col("x") > F.col("x_min")) & (F.col("x") < F.col("x_max"))
    return mine.join(spread, inside, how).drop("_by", "_bx")


def first_box(points: DataFrame, boxes: DataFrame, *, key: str, order: str, label: str, default: str = "Undefined") -> DataFrame:
    """The first box (by ``order``) that a point lies in, else a default label."""
    hits = in_boxes(points.select(key, "y", "x"), boxes).groupBy(key).agg(F.min_by(label, order).alias(label))
    return points.join(hits, key, "left").withColumn(label, F.coalesce(label, F.lit(default)))


def ray_crossings(y: Column, x: Column, ring: Column) -> Column:
    """How many edges of a closed ring a ray from the point along x crosses."""
    def crosses(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, i + 1)
        cut = a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / F.nullif(b["y"] - a["y"], F.lit(0.0))
        return F.when((a["y"] > y) != (b["y"] > y), F.coalesce(x < cut, F.lit(False))).otherwise(F.lit(False))

    return F.aggregate(F.sequence(F.lit(0), F.size(ring) - 2), F.lit(0), lambda s, i: s + crosses(i).cast("int"))


def ray_on_edge(y: Column, x: Column, ring: Column) -> Column:
    """Whether the point lies on an edge of a closed ring."""
    def on_edge(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, i + 1)
        flat = (b["x"] - a["x"]) * (y - a["y"]) == (b["y"] - a["y"]) * (x - a["x"])
        return flat & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))

    return F.exists(F.sequence(F.lit(0), F.size(ring) - 2), on_edge)


def ray_inside(y: Column, x: Column, ring: Column) -> Column:
    """Even-odd test of a point against a closed ring, points on an edge excluded."""
    return (ray_crossings(y, x, ring) % 2 == 1) & ~ray_on_edge(y, x, ring)


def in_polygons(points: DataFrame, polygons: DataFrame, *, grid: float = 500.0) -> DataFrame:
    """Points strictly inside polygons' rings: bounding boxes first, then the ring."""
    ys, xs = F.transform("ring", lambda p: p["y"]), F.transform("ring", lambda p: p["x"])
    boxed = polygons.withColumns({"y_min": F.array_min(ys), "y_max": F.array_max(ys), "x_min": F.array_min(xs), "x_max": F.array_max(xs)})
    return in_boxes(points, boxed, grid=grid).where(ray_inside(F.col("y").cast("double"), F.col("x").cast("double"), F.col("ring"))).drop("y_min", "y_max", "x_min", "x_max")


def containment(boxes: DataFrame, *, grid: float = 500.0) -> DataFrame:
    """Pairs (outer_id, inner_id) of boxes where one contains the other (C9): the
    inner box's corner meets the outer box's grid cells."""
    outer = boxes.select([F.col(c).alias(f"{c}_o") for c in boxes.columns])
    for c in ("y", "x"):
        outer = outer.withColumn(f"_b{c}", F.explode(F.sequence(_bucket(F.col(f"{c}_min_o"), grid), _bucket(F.col(f"{c}_max_o"), grid))))
    inner = boxes.withColumns({"_by": _bucket(F.col("y_min"), grid), "_bx": _bucket(F.col("x_min"), grid)})
    held = reduce(lambda a, b: a & b, [F.col(f"{c}_min_o") <= F.col(f"{c}_min") for c in "yx"] + [F.col(f"{c}_max_o") >= F.col(f"{c}_max") for c in "yx"])
    return inner.join(outer, ["_by", "_bx"]).where(held & (F.col("ann_id") != F.col("ann_id_o"))).select(F.col("ann_id_o").alias("outer_id"), F.col("ann_id").alias("inner_id"))


def overlaps(boxes: DataFrame, *, grid: float = 500.0) -> DataFrame:
    """Unordered pairs of overlapping boxes, each once: by the grid cell of their
    intersection's corner (D19)."""
    spread = boxes
    for c in ("y", "x"):
        spread = spread.withColumn(f"_b{c}", F.explode(F.sequence(_bucket(F.col(f"{c}_min"), grid), _bucket(F.col(f"{c}_max"), grid))))
    a, b = spread.alias("a"), spread.alias("b")
    first = reduce(lambda p, q: p & q, [F.col(f"a._b{c}") == _bucket(F.greatest(F.col(f"a.{c}_min"), F.col(f"b.{c}_min")), grid) for c in "yx"])
    meet = reduce(lambda p, q: p & q, [(F.col(f"a.{c}_min") < F.col(f"b.{c}_max")) & (F.col(f"b.{c}_min") < F.col(f"a.{c}_max")) for c in "yx"])
    on = (F.col("a._by") == F.col("b._by")) & (F.col("a._bx") == F.col("b._bx"))
    return a.join(b, on).where(first & meet & (F.col("a.ann_id") < F.col("b.ann_id"))).select(F.col("a.ann_id").alias("a_id"), F.col("b.ann_id").alias("b_id"), F.col("a.name").alias("a_name"), F.col("b.name").alias("b_name"))


def on_mask(cells: DataFrame, mask: DataFrame) -> DataFrame:
    """Cells whose thumbnail pixel (ty, tx) is in the mask."""
    return cells.join(mask, ["ty", "tx"], "left_semi")


def overlay(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Union of rows and columns; values of ``left`` win."""
    l, r = left.select([F.col(c).alias(f"{c}_l") for c in left.columns]), right.select([F.col(c).alias(f"{c}_r") for c in right.columns])
    names = list(dict.fromkeys(left.columns + right.columns))
    joined = l.join(r, F.col(f"{key}_l") == F.col(f"{key}_r"), "full")
    pick = {c: [F.col(f"{c}_{s}") for s, df in (("l", left), ("r", right)) if c in df.columns] for c in names}
    return joined.select([F.coalesce(*cols).alias(c) for c, cols in pick.items()])


def update(df: DataFrame, edits: DataFrame, key: str, column: str, order: str | None = None) -> DataFrame:
    """One column overwritten for the keys in ``edits``; with ``order`` the last
    edit of a key wins (C13, J9)."""
    if order:
        edits = edits.groupBy(key).agg(F.max_by(column, order).alias(column))
    new = edits.select(key, F.col(column).alias("_new"), F.lit(True).alias("_hit"))
    return df.join(new, key, "left").withColumn(column, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(column))).drop("_new", "_hit")


def distances(points: DataFrame, within: float, *, key: str) -> DataFrame:
    """Pairs of points closer than ``within`` and their distance, each pair once (C14).
    A point is sent to its own grid cell and those after it only, so a pair of
    different cells meets once. The copies are never broadcast: the planner takes
    them for as few as the points."""
    p = points.select(F.col(key).alias("p"), F.col("cy").alias("py"), F.col("cx").alias("px"))
    own = {"_oy": _bucket(F.col("py"), within), "_ox": _bucket(F.col("px"), within)}
    sent = p.withColumns(own).withColumn("_by", F.explode(F.sequence("_oy", _bucket(F.col("py") + within, within))))
    left = F.when(F.col("_by") == F.col("_oy"), F.col("_ox")).otherwise(_bucket(F.col("px") - within, within))
    sent = sent.withColumn("_bx", F.explode(F.sequence(left, _bucket(F.col("px") + within, within))))
    sent = sent.withColumn("_own", (F.col("_by") == F.col("_oy")) & (F.col("_bx") == F.col("_ox"))).drop("_oy", "_ox")
    mine = points.select(F.col(key).alias("q"), F.col("cy").alias("qy"), F.col("cx").alias("qx"), _bucket(F.col("cy"), within).alias("_by"), _bucket(F.col("cx"), within).alias("_bx"))
    d = F.sqrt(F.pow(F.col("py") - F.col("qy"), 2) + F.pow(F.col("px") - F.col("qx"), 2))
    once = F.when(F.col("_own"), F.col("p") < F.col("q")).otherwise(F.col("p") != F.col("q"))
    pairs = sent.hint("merge").join(mine, ["_by", "_bx"]).where((d < within) & once)
    return pairs.select(F.least("p", "q").alias("src"), F.greatest("p", "q").alias("dst"), d.alias("d"))


def clicked(cells: DataFrame, clicks: DataFrame) -> DataFrame:
    """Clicks resolved to cells by truncated coordinates."""
    cut = lambda df: df.withColumns({"_y": F.col("y").cast("int"), "_x": F.col("x").cast("int")})
    return cut(clicks).join(cut(cells).select("cell_id", "_y", "_x"), ["_y", "_x"]).drop("_y", "_x")


def selected(choice: DataFrame, tiles: DataFrame, key: str = "tile_index") -> tuple[DataFrame, DataFrame]:
    """The chosen tiles, and the choices that don't exist."""
    return tiles.join(choice, key), choice.join(tiles, key, "left_anti")


def positives(cells: DataFrame, marked: DataFrame, key: str = "cell_id") -> tuple[DataFrame, DataFrame]:
    """Cells in an index set, and the others (C11)."""
    return cells.join(marked, key, "left_semi"), cells.join(marked, key, "left_anti")


def population(cells: DataFrame, positive: list[str] = (), negative: list[str] = ()) -> DataFrame:
    """Cells positive for all of some markers and negative for all of others; a
    cell that was never reviewed is neither (F4, B25)."""
    tests = [F.col(f"{m}_expression") for m in positive] + [~F.col(f"{m}_expression") for m in negative]
    return cells.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def rank_within(df: DataFrame, part: list[str], order: list[Column], most: int | None = None, out: str = "rank") -> DataFrame:
    """Ranks from 1; the first ``most`` of each group where given."""
    ranked = df.withColumn(out, F.row_number().over(Window.partitionBy(*part).orderBy(*order)))
    return ranked if most is None else ranked.where(F.col(out) <= most)
