"""Projections, filters and scalar expressions on cell tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Micrometres per pixel by image type and magnification.
SCALE_FACTORS = {("svs", "20x"): 0.5031, ("svs", "40x"): 0.2521, ("ndpi", "20x"): 0.4414, ("ndpi", "40x"): 0.2207}
#: Column-name parts that are not clustering features.
NOT_FEATURES = ("y.coor", "x.coor", "cell", "peri", "area", "circularity", "major", "minor", "peaks", "IQR", "hema", "dapi")


def project(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Keep and rename columns (B1)."""
    return df.select([F.col(f"`{a}`").alias(b) for a, b in names.items()])


def feature_columns(columns: list[str], marker: str, other_dna: str | None = None) -> list[str]:
    """A marker's clustering features among wide column names (B2); the marker
    is matched as a whole word, so ``CD3`` leaves ``CD38`` out."""
    mine = [c for c in columns if re.search(rf"(?<!\w){re.escape(marker)}(?!\w)", c)]
    return [c for c in mine if not any(re.search(p, c) for p in NOT_FEATURES) and not (other_dna and other_dna in c)]


def three_level_names(columns: list[str], replaces: list[tuple[str, str]], drop: str | None = None) -> dict[str, tuple[str, ...]]:
    """Ordered replaces, then a drop pattern, then a split on dots."""
    out = {}
    for c in columns:
        name = reduce(lambda s, r: s.replace(*r), replaces, c)
        if not (drop and re.search(drop, name)):
            out[c] = tuple(name.split("."))[:3]
    return out


def clean_name(name: Column) -> Column:
    """Marker names without ``. ' " space -``."""
    return F.translate(name, ".'\" -", "")


def parse_list(text: Column, kind: str = "string") -> Column:
    """A typed list: blanks and quotes go, commas split."""
    return F.split(F.regexp_replace(text, "[\\s'\"]", ""), ",").cast(f"array<{kind}>")


def resolution(text: Column) -> Column:
    """``20x`` as 20."""
    return F.rtrim(text, F.lit("x")).try_cast("int")


def parse_point(text: Column) -> Column:
    """``[y, x]`` as a struct of ints."""
    parts = F.regexp_extract_all(text, F.lit(r"(-?\d+)"), F.lit(1))
    return F.struct(F.try_element_at(parts, F.lit(1)).cast("int").alias("y"), F.try_element_at(parts, F.lit(2)).cast("int").alias("x"))


def scale_factor(image_type: Column, res: Column) -> Column:
    """Micrometres per pixel, null for unknown pairs."""
    out = F.lit(None).cast("double")
    for (kind, mag), value in SCALE_FACTORS.items():
        out = F.when((image_type == kind) & (res == mag), F.lit(value)).otherwise(out)
    return out


def complement(v: Column, top: int = 255) -> Column:
    """Clamp to ``top``, then invert."""
    return F.lit(top) - F.least(v, F.lit(top))


def rescale(v: Column, top: Column | float = 255.0) -> Column:
    """Intensities over their largest value."""
    return v / top


def round_row(df: DataFrame, digits: int = 3, whole: tuple[str, ...] = ()) -> DataFrame:
    """Half-even rounding of all fractional columns, of ``whole`` ones to integers first."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    return df.select([F.bround(F.bround(F.col(c), 0) if c in whole else F.col(c), digits).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns])


def absolute(origin: Column, shift: Column, rel: Column, buffer: Column | int, linear: Column) -> Column:
    """A cell's absolute coordinate, cut off toward zero."""
    return (origin + shift + rel - buffer - linear).cast("int")


def shift_by_tile(cells: DataFrame, tiles: DataFrame) -> DataFrame:
    """Tile-relative to absolute coordinates."""
    return cells.join(tiles.select("tile_index", "y0", "x0"), "tile_index").withColumns({"abs_y": F.col("y") + F.col("y0"), "abs_x": F.col("x") + F.col("x0")}).drop("y0", "x0")


def thumbnail(coord: Column, res: float, size: int, mag: float = 1.25) -> Column:
    """The thumbnail pixel of an output pixel, clamped to the mask on both sides."""
    return F.greatest(F.least(F.bround(coord / (res / mag)), F.lit(float(size - 1))), F.lit(0.0)).cast("int")


def inside(y: Column, x: Column, height: int, width: int, buffer: int) -> Column:
    """Strictly within the buffer on both axes."""
    return (y > buffer) & (y < height - buffer) & (x > buffer) & (x < width - buffer)


def subtier(root: Column, sub: Column) -> Column:
    """``root.sub``."""
    return F.concat_ws(".", root.cast("string"), sub.cast("string"))


def has_root(tier: Column, root: int) -> Column:
    return (tier >= root) & (tier < root + 1)


def key_part(key: Column, from_end: int) -> Column:
    """A part of a dashed key, counted from its end."""
    return F.element_at(F.split(key, "-"), -from_end)


def shift_ring(ring: Column, dx: Column | float, dy: Column | float) -> Column:
    """A polygon ring moved."""
    return F.transform(ring, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))


def unique_names(df: DataFrame, name: str, order: str, out: str = "unique_name") -> DataFrame:
    """``n, n_1, n_2`` in order."""
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    return df.withColumn(out, F.when(rn == 0, F.col(name)).otherwise(F.concat_ws("_", F.col(name), rn.cast("string"))))


def cycle_names(cycles: DataFrame) -> DataFrame:
    """One row per cycle and channel, named ``cycle_{n}_{marker}``."""
    return cycles.select("cycle", F.posexplode("markers").alias("channel", "marker")).withColumn("name", F.concat_ws("_", F.lit("cycle"), F.col("cycle").cast("string"), F.col("marker")))


def masked(v: Column, mask: Column) -> Column:
    """Pixels outside the mask are 0."""
    return F.when(mask, v).otherwise(F.lit(0))


def has_label(labels: Column, label: str) -> Column:
    """Comma-joined labels hold one."""
    return F.array_contains(F.split(labels, ","), label)


def all_true(*cols: Column) -> Column:
    """Every flag is set."""
    return reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in cols])


def evaluated(df: DataFrame, suffix: str = "_expression", order: str = "cell_id") -> DataFrame:
    """Per marker whether it was reviewed: its first row has a call."""
    found = [c for c in df.columns if c.endswith(suffix)]
    firsts = df.agg(*[F.min_by(F.col(c).isNotNull(), F.col(order)).alias(c) for c in found])
    return firsts.unpivot([], found, "marker", "evaluated").withColumn("marker", F.regexp_replace("marker", f"{suffix}$", ""))


def measurement_map(pairs: Column) -> Column:
    """Name and value structs as a map."""
    return F.map_from_entries(pairs)
