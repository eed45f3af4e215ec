"""The wide table of cell metrics: 8 columns of the cell and 67 of every marker (G1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.aggregates import kde_peaks, profile

#: The format's column names.
CELL = ("Tile index", "ROI-relative cell y_coord (pixels)", "ROI-relative cell x_coord (pixels)", "Nuc peri (microns)", "Nuc area (microns)", "Nuc circularity", "Nuc major axis (microns)", "Nuc minor axis (microns)")
PLACE = ("y_coor (pixels)", "x_coor (pixels)")
SHAPE = ("cyto peri (microns)", "cyto area (microns)", "cyto circularity", "cyto major axis (microns)", "cyto minor (microns)")
BLOCKS = (("nuc", "hema"), ("cyto", "AEC"), ("nuc", "AEC"), ("mem", "AEC"))
STATS = {"min": "min", "max": "max", "SD": "sd", "mean": "mean", "IQR": "iqr", **{f"p{i}": f"p{i}" for i in range(1, 10)}, "num_peaks": "num_peaks"}
FORM = ("perimeter", "area", "circularity", "major", "minor")


def header(markers: list[str]) -> list[str]:
    return [*CELL, *(f"{m} {c}" for m in markers for c in (*PLACE, *SHAPE, *(f"{comp} {channel} {s}" for comp, channel in BLOCKS for s in STATS)))]


def profiles(px: DataFrame, channels: dict[str, str]) -> DataFrame:
    """Long profiles (cell_id, marker, comp, channel, statistics) of pixel rows
    (cell_id, marker, comp, a column for each channel)."""
    out = None
    for channel, column in channels.items():
        kept = px.where(F.col("comp").isin([c for c, k in BLOCKS if k == channel]))
        by = ["cell_id", "marker", "comp"]
        peaks = kde_peaks(kept, by, column).select(*[F.col(c).alias(f"_{c}") for c in by], "num_peaks")
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
        part = profile(kept, by, column).join(peaks, same).drop(*[f"_{c}" for c in by]).withColumn("channel", F.lit(channel))
        out = part if out is None else out.unionByName(part)
    return out


def cell_metrics(cells: DataFrame, places: DataFrame, long: DataFrame, markers: list[str], *, digits: int = 3) -> DataFrame:
    """One row per cell, in the order of ``header``, after cell_id.

    ``cells``: cell_id, tile_index, y, x and the nucleus' FORM. ``places``: cell_id,
    marker, y, x and the cell's FORM in that marker, which is rounded to whole
    numbers. ``long``: as ``profiles`` gives it. Values are rounded half to even. The
    markers are given, so each table is one aggregation and no job looks for names.
    A cell without a marker's pixels has nulls there."""
    def pick(test: Column, value: Column, name: str) -> Column:
        return F.max(F.when(test, value)).alias(name)

    of_cell = [F.bround(F.col(c).cast("double"), digits).alias(n) for c, n in zip(("y", "x", *FORM), CELL[1:], strict=True)]
    first = cells.select("cell_id", F.col("tile_index").cast("double").alias(CELL[0]), *of_cell)
    spots = [pick(F.col("marker") == m, F.bround(F.col(c).cast("double"), 0), f"{m} {n}") for m in markers for c, n in zip(("y", "x", *FORM), (*PLACE, *SHAPE), strict=True)]
    second = places.groupBy(F.col("cell_id").alias("_p")).agg(*spots)
    stats = [pick((F.col("marker") == m) & (F.col("comp") == comp) & (F.col("channel") == channel), F.bround(F.col(c).cast("double"), digits), f"{m} {comp} {channel} {n}") for m in markers for comp, channel in BLOCKS for n, c in STATS.items()]
    third = long.groupBy(F.col("cell_id").alias("_s")).agg(*stats)
    joined = first.join(second, F.col("cell_id") == F.col("_p"), "left").join(third, F.col("cell_id") == F.col("_s"), "left")
    return joined.select("cell_id", *[F.col(f"`{c}`") for c in header(markers)])
