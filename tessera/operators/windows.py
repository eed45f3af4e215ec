"""Ordinals, ranks, scaling and order-dependent matching."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.store import saved


def dense_ids(df: DataFrame, order: list, by: tuple[str, ...] = (), out: str = "cell_index") -> DataFrame:
    """0, 1, 2 … in order (E1). Without a partition column rows are dealt by ranges
    of the order and written; a range's numbers begin where the ranges before it
    end, so no task numbers more than its own."""
    if by:
        return df.withColumn(out, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("int"))
    dealt = saved(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy(F.col("_part").alias("_p")).agg(F.count("*").alias("_n"))
    # A row for each partition.
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    numbered = dealt.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return numbered.join(F.broadcast(before), F.col("_part") == F.col("_p")).withColumn(out, F.col("_before") + F.col("_at") - 1).drop("_part", "_p", "_before", "_at")


def tile_grid(rows: int, columns: int, df: DataFrame, row: str = "gy", column: str = "gx") -> DataFrame:
    """All grid positions, left-joined by ``df``."""
    spark = df.sparkSession
    grid = spark.range(rows * columns).select(F.floor(F.col("id") / columns).cast("int").alias(row), (F.col("id") % columns).cast("int").alias(column))
    return grid.join(df, [row, column], "left")


def ordered(df: DataFrame, *cols) -> DataFrame:
    """Sorted by tile, then index."""
    return df.orderBy(*cols)


def first_per(df: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """The value of each group's first row (E5)."""
    return df.groupBy(by).agg(F.min_by(value, order).alias(value))


def standardised(df: DataFrame, values: list[str]) -> DataFrame:
    """Zero mean, unit population deviation; constant columns become 0."""
    stats = df.agg(*[f(v).alias(f"{n}_{v}") for v in values for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    scaled = {v: (F.col(v) - F.col(f"m_{v}")) / F.when(F.col(f"s_{v}") == 0, 1.0).otherwise(F.col(f"s_{v}")) for v in values}
    return df.join(F.broadcast(stats)).withColumns(scaled).drop(*stats.columns)  # one row


def from_least(df: DataFrame, values: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Coordinates less the group's smallest."""
    return df.withColumns({v: F.col(v) - F.min(v).over(Window.partitionBy(*by)) for v in values})


def chunk_of(key: Column, rows: int, size: int = 45_000, seed: int = 0) -> Column:
    """A reproducible random chunk for about ``size`` rows each."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(max(1, rows // size)))


def sign_changes(df: DataFrame, value: str, order: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Where a series turns from rising to falling."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("is_peak", F.coalesce((F.col(value) > F.lag(value).over(w)) & (F.col(value) > F.lead(value).over(w)), F.lit(False)))


def greedy_matches(cy: np.ndarray, cx: np.ndarray, stain: np.ndarray, *, radius: float, percent: float, n_stains: int, low: float, high_y: float, high_x: float) -> list[tuple[int, int]]:
    """Consensus of one tile (E9): detections are visited in order and skipped if
    consumed; each consumes its matches in other stains, even if it is then
    rejected. It is kept with more than ``int(percent · stains / 100)`` stains
    matching and a centroid inside the bounds."""
    used, kept = np.zeros(len(cy), bool), []
    need = int(percent * n_stains / 100)
    order = np.argsort(cy, kind="stable")
    ys = cy[order]
    for i in range(len(cy)):
        if used[i]:
            continue
        a, b = np.searchsorted(ys, (cy[i] - radius, cy[i] + radius))
        near = order[a : b + 1]
        near = near[(np.abs(cy[near] - cy[i]) < radius) & (np.abs(cx[near] - cx[i]) < radius) & (stain[near] != stain[i]) & ~used[near]]
        used[near] = True
        used[i] = True
        matches = len(set(stain[near].tolist()))
        if matches > need and low < cy[i] < high_y and low < cx[i] < high_x:
            kept.append((i, matches))
    return kept


def consensus(det: DataFrame, *, tile: int, n_stains: int, radius: float = 5.0, percent: float = 40.0, buffer: float = 0.0) -> DataFrame:
    """Greedy consensus per tile (E9). A tile holds a bounded number of cells."""
    tiled = det.withColumns({"ty": F.floor(F.col("cy") / tile), "tx": F.floor(F.col("cx") / tile)})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["stain", "det_id"], ignore_index=True)
        y0, x0 = pdf["ty"].iloc[0] * tile, pdf["tx"].iloc[0] * tile
        kept = greedy_matches((pdf["cy"] - y0).to_numpy(), (pdf["cx"] - x0).to_numpy(), pdf["stain"].to_numpy(), radius=radius, percent=percent, n_stains=n_stains, low=buffer, high_y=tile - buffer, high_x=tile - buffer)
        out = pdf.loc[[i for i, _ in kept], ["det_id", "stain", "cy", "cx"]]
        return out.assign(matches=[m for _, m in kept])

    return tiled.groupBy("ty", "tx").applyInPandas(run, "det_id long, stain int, cy double, cx double, matches int")
