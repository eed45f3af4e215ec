"""Set operations and reshaping of cell tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def appended(parts: list[DataFrame]) -> DataFrame:
    """Tables of tiles one under another, columns by name (F1, F2, F8)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def missing_tiles(tiles: DataFrame, metrics: DataFrame) -> DataFrame:
    """Tiles without metrics (F1)."""
    return tiles.join(metrics, "tile_index", "left_anti")


def tagged(frames: dict[str, DataFrame]) -> DataFrame:
    """Samples under one another with their names."""
    return appended([df.withColumn("sample_name", F.lit(name)) for name, df in frames.items()])


def common(sets: list[DataFrame]) -> DataFrame:
    """Rows in all index sets."""
    return reduce(DataFrame.intersect, sets)


def without(all_rows: DataFrame, some: DataFrame) -> DataFrame:
    """Rows not in another index set."""
    return all_rows.exceptAll(some)


def wide(long: DataFrame, key: list[str], name: str, names: list, values: dict[str, str]) -> DataFrame:
    """One row per key, columns ``{name}_{value}``, in one pass (G1). The names
    are given, so no job looks for them."""
    return long.groupBy(*key).pivot(name, names).agg(*[F.first(c).alias(a) for a, c in values.items()])


def stacked(df: DataFrame, key: list[str], columns: list[str], name: str = "part", value: str = "value") -> DataFrame:
    """Wide to long."""
    return df.unpivot(key, columns, name, value)


def difference(long: DataFrame, key: list[str], name: str, left: str, right: str, value: str) -> DataFrame:
    """One named value less another per key."""
    pick = lambda n: F.max(F.when(F.col(name) == n, F.col(value)))
    return long.where(F.col(name).isin(left, right)).groupBy(*key).agg((pick(left) - pick(right)).alias("difference"))


def beside(frames: list[DataFrame], key: str) -> DataFrame:
    """Feature tables side by side on their key."""
    return reduce(lambda a, b: a.join(b, key), frames)


def polygons_of(features: DataFrame, rings: str = "coordinates") -> DataFrame:
    """Nested multi-polygons as one row per polygon."""
    return features.select("*", F.posexplode(rings).alias("part", "ring")).drop(rings)
