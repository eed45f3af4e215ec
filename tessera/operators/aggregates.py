"""Aggregations on pixel and cell tables, exact throughout."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A nuclear haematoxylin median p5 above this marks no red blood cell.
RBC_THRESHOLD = 0.30
DECILES = [i / 10 for i in range(1, 10)]


def _moments(v: Column, n: Column) -> tuple[Column, Column]:
    """Mean and population variance of values with counts."""
    total = F.sum(n)
    mean = F.sum(v * n) / total
    return mean, F.greatest(F.sum(v * v * n) / total - mean * mean, F.lit(0.0))


def histogram(px: DataFrame, by: list[str], value: str) -> DataFrame:
    """Each intensity's count (n) per group: all that exact statistics need, and at
    most as many rows a group as there are intensities, summed before the shuffle."""
    return px.groupBy(*by, value).agg(F.count("*").alias("n"))


def profile(px: DataFrame, by: list[str], value: str, scale: float = 255.0) -> DataFrame:
    """Intensity profile (D1; D2 with scale 1): min, max, population SD, mean,
    IQR and deciles by linear interpolation, from histograms."""
    counts = histogram(px.where(F.col(value).isNotNull()), by, value)
    v = F.col(value).cast("double")
    mean, variance = _moments(v, F.col("n"))
    both = F.percentile(v / scale, F.array(*[F.lit(q) for q in [*DECILES, 0.25, 0.75]]), F.col("n"))
    out = counts.groupBy(*by).agg((F.min(v) / scale).alias("min"), (F.max(v) / scale).alias("max"), (F.sqrt(variance) / scale).alias("sd"), (mean / scale).alias("mean"), both.alias("_q"))
    return out.select(*by, "min", "max", "sd", "mean", (F.col("_q")[10] - F.col("_q")[9]).alias("iqr"), *[F.col("_q")[i].alias(f"p{i + 1}") for i in range(9)])


def count_peaks(values: np.ndarray, counts: np.ndarray | None = None, *, bandwidth: float = 5.0, least: float = 0.01, grid: int = 1024) -> int:
    """Maxima above ``least`` of a Gaussian kernel density on an even grid that
    reaches three bandwidths past the values; at least 1 (D3, E11)."""
    values = np.asarray(values, float)
    counts = np.ones(len(values)) if counts is None else np.asarray(counts, float)
    known = ~np.isnan(values)
    if not known.any():
        return 1
    at, where = np.unique(values[known], return_inverse=True)
    weight = np.bincount(where, counts[known])
    xs = np.linspace(at[0] - 3 * bandwidth, at[-1] + 3 * bandwidth, grid)
    density = (np.exp(-0.5 * ((xs[:, None] - at) / bandwidth) ** 2) * weight).sum(axis=1) / (weight.sum() * bandwidth * np.sqrt(2 * np.pi))
    turns = np.diff(np.sign(np.gradient(density))) < 0
    return max(1, int((density[:-1][turns] > least).sum()))


def kde_peaks(px: DataFrame, by: list[str], value: str, **options) -> DataFrame:
    """Number of density peaks per group (D3), from each group's histogram: a
    group is one row with at most as many entries as there are intensities."""
    histogram = px.groupBy(*by, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    rows = histogram.groupBy(*by).agg(F.collect_list("v").alias("v"), F.collect_list("n").alias("n"))

    @F.pandas_udf("int")
    def peaks(values: pd.Series, counts: pd.Series) -> pd.Series:
        return pd.Series([count_peaks(v, n, **options) for v, n in zip(values, counts, strict=True)], dtype="int32")

    return rows.select(*by, peaks("v", "n").alias("num_peaks"))


def region_stats(px: DataFrame, value: str) -> DataFrame:
    """Mean, median, min, max, SD and variance per compartment and, as ``cell``,
    of all compartments together (D4). The variance is of raw values over 255 once."""
    counts = histogram(px.where(F.col(value).isNotNull()), ["cell_id", "comp"], value)
    v = F.col(value).cast("double")
    mean, variance = _moments(v, F.col("n"))
    stats = [(mean / 255).alias("mean"), (F.percentile(v, F.lit(0.5), F.col("n")) / 255).alias("median"), (F.min(v) / 255).alias("min"), (F.max(v) / 255).alias("max"), (F.sqrt(variance) / 255).alias("sd"), (variance / 255).alias("variance")]
    return counts.groupingSets([["cell_id", "comp"], ["cell_id"]], "cell_id", "comp").agg(*stats).withColumn("comp", F.coalesce("comp", F.lit("cell")))


def morphology(pixels: DataFrame, scale: float = 1.0, key: str = "cell_id") -> DataFrame:
    """Area, perimeter, axes and circularity of pixel sets (D5). Edge pixels lack
    one of four neighbours; neighbours are found by running lengths, not joins."""
    row, column = Window.partitionBy(key, "y").orderBy("x"), Window.partitionBy(key, "x").orderBy("y")
    gaps = [F.lag("x").over(row) == F.col("x") - 1, F.lead("x").over(row) == F.col("x") + 1, F.lag("y").over(column) == F.col("y") - 1, F.lead("y").over(column) == F.col("y") + 1]
    full = gaps[0] & gaps[1] & gaps[2] & gaps[3]
    marked = pixels.withColumn("edge", ~F.coalesce(full, F.lit(False)))
    centre = Window.partitionBy(key)
    edge = F.col("edge")
    cy, cx = (F.avg(F.when(edge, F.col(c))).over(centre) for c in ("y", "x"))
    marked = marked.withColumn("d", F.when(edge, F.sqrt(F.pow(F.col("y") - cy, 2) + F.pow(F.col("x") - cx, 2))))
    out = marked.groupBy(key).agg(F.count("*").alias("n"), F.count(F.when(edge, 1)).alias("edges"), F.max("d").alias("far"), F.min("d").alias("near"))
    one = F.col("n") == 1
    return out.select(
        key, (F.col("n") * scale * scale).alias("area"), (F.col("edges") * scale).alias("perimeter"),
        (F.when(one, 1.0).otherwise(2 * F.col("far")) * scale).alias("major"), (F.when(one, 1.0).otherwise(2 * F.col("near")) * scale).alias("minor"),
        F.when(one, 1.0).otherwise(F.least(F.lit(1.0), 4 * F.pi() * F.col("n") / (F.col("edges") * F.col("edges")))).alias("circularity"),
    )


def keep_nucleated(nuc: DataFrame, threshold: float = RBC_THRESHOLD) -> DataFrame:
    """Cells whose median over stains of the nuclear p5 exceeds the threshold, strictly."""
    p5 = nuc.groupBy("cell_id", "stain").agg((F.percentile("v_hema", 0.5) / 255).alias("p5"))
    return p5.groupBy("cell_id").agg(F.median("p5").alias("p5")).where(F.col("p5") > threshold)


def tissue_share(tiles: DataFrame, mask: DataFrame, tile: int, zoom: float) -> DataFrame:
    """Percent of each tile's thumbnail window in the mask, at most 100 (D7). A
    mask pixel knows its tile, so no range join is needed."""
    side = tile * zoom
    found = mask.select(F.floor(F.col("ty") / side).cast("int").alias("gy"), F.floor(F.col("tx") / side).cast("int").alias("gx")).groupBy("gy", "gx").agg(F.count("*").alias("n"))
    return tiles.join(found, ["gy", "gx"], "left").withColumn("tissue_pct", F.least(F.lit(100.0), F.coalesce("n", F.lit(0)) / (side * side) * 100)).drop("n")


def tissue_area(pct: Column, scale: float, side: int = 1020) -> Column:
    """Square micrometres of tissue in a tile (D8); the side includes both buffers."""
    return pct / 100 * side * side * scale * scale


def tier_medians(df: DataFrame, tier: str, values: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Count and medians per tier, and per sample or core where given."""
    return df.groupBy(*by, tier).agg(F.count("*").alias("n_cells"), *[F.median(v).alias(f"{v}_median") for v in values])


def mean_and_sd(df: DataFrame, by: str, values: list[str]) -> DataFrame:
    """Means and sample standard deviations."""
    return df.groupBy(by).agg(*[f(v).alias(f"{v}_{n}") for v in values for n, f in (("mean", F.avg), ("std", F.stddev_samp))])


def positive_density(cells: DataFrame, tiles: DataFrame, flag: str) -> DataFrame:
    """Positive cells per area and tile."""
    found = cells.groupBy("tile_index").agg(F.sum(F.col(flag).cast("int")).cast("long").alias("n_pos"))
    return tiles.join(found, "tile_index", "left").withColumn("n_pos", F.coalesce("n_pos", F.lit(0))).withColumn("density", F.col("n_pos") / F.col("tissue_area_um2"))


def population_metrics(cells: DataFrame, tiles: DataFrame, member: Column) -> DataFrame:
    """Count, percent and cells per square millimetre, per tile and for the whole tissue."""
    per_tile = cells.groupBy("tile_index").agg(F.sum(member.cast("int")).cast("long").alias("n"), F.count("*").alias("n_all"))
    joined = tiles.select("tile_index", "tissue_area_um2").join(per_tile, "tile_index", "left")
    sums = joined.groupingSets([["tile_index"], []], "tile_index").agg(F.sum("n").alias("n"), F.sum("n_all").alias("n_all"), F.sum("tissue_area_um2").alias("area"))
    return sums.select("tile_index", F.coalesce("n", F.lit(0)).alias("n"), (100.0 * F.col("n") / F.col("n_all")).alias("percent"), (F.col("n") / (F.col("area") * 1e-6)).alias("per_mm2"))


def shares(df: DataFrame, by: str) -> DataFrame:
    """Group sizes and their shares of all rows."""
    return df.groupBy(by).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def joined_labels(hits: DataFrame, key: str, order: str, label: str, default: str = "Undefined") -> DataFrame:
    """A key's labels in order, comma-joined; the default without any."""
    rows = hits.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col(label).isNotNull(), F.struct(order, label)))).alias("a"))
    text = F.array_join(F.transform("a", lambda s: s[label]), ",")
    return rows.select(key, F.when(text == "", F.lit(default)).otherwise(text).alias(label))


def ring_area(ring: Column) -> Column:
    """Shoelace area of a closed ring."""
    steps = F.sequence(F.lit(0), F.size(ring) - 2)
    term = lambda i: F.get(ring, i)["x"] * F.get(ring, i + 1)["y"] - F.get(ring, i + 1)["x"] * F.get(ring, i)["y"]
    return F.abs(F.aggregate(steps, F.lit(0.0), lambda s, i: s + term(i))) / 2


def union_area(boxes: DataFrame, by: tuple[str, ...] = (), strip: float = 1000.0) -> DataFrame:
    """Area covered by at least one box (D17). Boxes are cut at upright strips; in a
    strip, between neighbouring x edges, the merged y intervals count. Slabs only
    meet boxes of their own strip."""
    cut = boxes.select(*by, "x_min", "x_max", "y_min", "y_max", F.explode(F.sequence(F.floor(F.col("x_min") / strip).cast("long"), F.floor(F.col("x_max") / strip).cast("long"))).alias("_strip"))
    cut = cut.withColumns({"x_min": F.greatest(F.col("x_min").cast("double"), F.col("_strip") * strip), "x_max": F.least(F.col("x_max").cast("double"), (F.col("_strip") + 1) * strip)}).where("x_min < x_max")
    keys = (*by, "_strip")
    edges = cut.select(*keys, F.explode(F.array("x_min", "x_max")).alias("x")).distinct()
    nxt = F.lead("x").over(Window.partitionBy(*keys).orderBy("x"))
    slabs = edges.withColumn("x_to", nxt).where("x_to is not null").select(*[F.col(c).alias(f"_{c}") for c in keys], "x", "x_to")
    on = (F.col("x_min") <= F.col("x")) & (F.col("x_max") >= F.col("x_to"))
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    held = cut.join(slabs, on).select(*keys, "x", "x_to", "y_min", "y_max")
    w = Window.partitionBy(*keys, "x").orderBy("y_min", "y_max").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("y_max").over(w)
    gain = F.greatest(F.lit(0), F.col("y_max") - F.greatest(F.col("y_min"), F.coalesce(reach, F.col("y_min"))))
    return held.withColumn("a", gain * (F.col("x_to") - F.col("x"))).groupBy(*by).agg(F.sum("a").cast("double").alias("area"))


def bounds(mask: DataFrame, buffer: int, height: int, width: int) -> DataFrame:
    """The mask's bounding box with a buffer, clamped (D20); no row for an empty mask."""
    found = mask.agg(F.min("ty").alias("a"), F.max("ty").alias("b"), F.min("tx").alias("c"), F.max("tx").alias("d")).where("a is not null and c is not null")
    return found.select(
        F.greatest(F.col("a") - buffer, F.lit(0)).alias("y_min"), F.least(F.col("b") + buffer, F.lit(height)).alias("y_max"),
        F.greatest(F.col("c") - buffer, F.lit(0)).alias("x_min"), F.least(F.col("d") + buffer, F.lit(width)).alias("x_max"),
    )


def normalised(df: DataFrame, value: str, low: float, high: float, by: tuple[str, ...] = (), clip: bool = True, caps: tuple[float, float] | None = None) -> DataFrame:
    """Rescaled between two percentiles of the group, from its histogram.
    Without a group they are one row joined to all; ``caps`` bound the lower one
    (from above) and the upper one (from below)."""
    counts = histogram(df.where(F.col(value).isNotNull()), list(by), value)
    found = F.percentile(F.col(value).cast("double"), F.array(F.lit(low), F.lit(high)), F.col("n"))
    limits = (counts.groupBy(*by) if by else counts).agg(found.alias("_q"))
    limits = limits.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_q")[0].alias("_lo"), F.col("_q")[1].alias("_hi"))
    if caps:
        limits = limits.withColumns({"_lo": F.least("_lo", F.lit(float(caps[0]))), "_hi": F.greatest("_hi", F.lit(float(caps[1])))})
    on = None
    for c in by:
        same = F.col(c).eqNullSafe(F.col(f"_{c}"))
        on = same if on is None else on & same
    joined = df.join(limits, on, "left") if by else df.join(F.broadcast(limits))  # one row
    out = F.coalesce((F.col(value) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)), F.lit(0.0))
    return joined.withColumn("norm", F.greatest(F.lit(0.0), F.least(F.lit(1.0), out)) if clip else out).drop(*limits.columns)
