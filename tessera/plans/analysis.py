"""The three entry points end to end: analysis of pixels, clustering of cells, review.

``analyse`` takes one row per stain and pixel (stain, y, x, hema, aec) and gives
cell metrics and shapes; ``cluster`` gives tiers; ``review`` calls positives and
answers a population query. Every step is one of the operators.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import aggregates, image, joins, learn, reshape, scalar, spatial, windows
from tessera.plans.technologies import TECHNOLOGIES, Settings
from tessera.sources.store import saved


@dataclass(frozen=True)
class Analysis:
    cells: DataFrame  # cell_id, ty, tx, cy, cx, shape of the nucleus, core where cores are given
    pixels: DataFrame  # cell_id, comp, y, x
    metrics: DataFrame  # cell_id, stain, comp and the intensity profile


def detections(px: DataFrame, stains: list[int], tile: int, model: str) -> DataFrame:
    """Pixels of all stains' detections: (stain, det_id, y, x), ids unique over all."""
    parts = [image.segmented(px.where(F.col("stain") == s).select("y", "x", F.col("hema").alias("v")), tile, model).withColumn("stain", F.lit(s)) for s in stains]
    every = reduce(DataFrame.unionByName, parts)
    return every.select("stain", F.xxhash64("stain", "ty", "tx", "det_id").alias("det_id"), "y", "x")


def compartments(nuclei: DataFrame, grow: int, height: int, width: int) -> DataFrame:
    """Nucleus, cytoplasm and membrane pixels (H4): the nucleus grown by a disk,
    each pixel to its nearest nucleus; the membrane is the outer edge of both."""
    grown = nuclei.select("cell_id", "y", "x", F.explode(spatial.disk(grow)).alias("o")).select("cell_id", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    cyto = saved(spatial.cytoplasm(grown, nuclei, height, width))
    whole = nuclei.select("cell_id", "y", "x").union(cyto).distinct()
    moves = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0))])
    beside = whole.select("cell_id", (F.col("y")).alias("py"), F.col("x").alias("px"), F.explode(moves).alias("m"))
    open_ = beside.select("cell_id", (F.col("py") + F.col("m.dy")).alias("y"), (F.col("px") + F.col("m.dx")).alias("x"), "py", "px").join(whole, ["cell_id", "y", "x"], "left_anti")
    edge = open_.select("cell_id", F.col("py").alias("y"), F.col("px").alias("x")).distinct()
    named = {"nuc": nuclei.select("cell_id", "y", "x"), "cyto": cyto, "mem": edge}
    return reshape.appended([df.withColumn("comp", F.lit(n)) for n, df in named.items()])


def in_cores(cells: DataFrame, cores: DataFrame, tile: int) -> DataFrame:
    """Cells with ``core``: the first one (by ``place``) that their tile's centre
    lies strictly inside, else ``Undefined`` (C3)."""
    centre = {c: (F.col(f"t{c}") + 0.5) * tile for c in ("y", "x")}
    tiles = cells.select("ty", "tx").distinct().withColumns({"at": F.struct("ty", "tx"), **centre})
    named = joins.first_box(tiles, cores, key="at", order="place", label="core")
    return cells.join(named.select("ty", "tx", "core"), ["ty", "tx"])


def analyse(px: DataFrame, settings: Settings, *, stains: list[int], height: int, width: int, grow: int = 3, model: str = "threshold", cores: DataFrame | None = None) -> Analysis:
    """Segmentation, consensus, compartments, red blood cell filter, profiles, as
    the settings' technology asks for. ``stains`` are those that show nuclei (DNA
    channels of cycles); without matching only the first of them is segmented.
    ``cores`` (core, place, y_min, y_max, x_min, x_max) names tiles by their centre."""
    technology = TECHNOLOGIES[settings.technology]()
    found = saved(detections(px, stains if technology.matched else stains[:1], settings.tile, model))
    centres = found.groupBy("stain", "det_id").agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"))
    kept = centres.select("det_id", "stain", "cy", "cx")
    if technology.matched:
        kept = windows.consensus(centres, tile=settings.tile, n_stains=len(stains), radius=settings.noise_px, percent=settings.consensus_percent, buffer=0.0)
    kept = saved(kept)
    nuclei = saved(found.join(kept.select("det_id", "stain"), ["det_id", "stain"], "left_semi").select(F.col("det_id").alias("cell_id"), "y", "x"))
    pixels = saved(compartments(nuclei, grow, height, width))
    seen = pixels.join(px, ["y", "x"])
    alive = kept.select(F.col("det_id").alias("cell_id"))
    if technology.chromogenic:
        blood = seen.where("comp = 'nuc'").withColumn("v_hema", F.col("hema"))
        alive = saved(aggregates.keep_nucleated(blood, settings.rbc_threshold).select("cell_id"))
    profiles = aggregates.profile(seen.join(alive, "cell_id", "left_semi"), ["cell_id", "stain", "comp"], "aec", scale=255.0 if technology.chromogenic else 1.0)
    shapes = aggregates.morphology(nuclei.join(alive, "cell_id", "left_semi"))
    at = kept.select(F.col("det_id").alias("cell_id"), F.floor(F.col("cy") / settings.tile).cast("int").alias("ty"), F.floor(F.col("cx") / settings.tile).cast("int").alias("tx"), "cy", "cx")
    if cores is not None:
        at = in_cores(at, cores, settings.tile)
    return Analysis(at.join(shapes, "cell_id"), pixels, saved(scalar.round_row(profiles)))


def cluster(metrics: DataFrame, stain: int, k: int = 7, seed: int = 0) -> DataFrame:
    """A stain's tiers from the nuclear, cytoplasmic and membrane profiles, ranked
    by the median nuclear p5: (cell_id, tier)."""
    stats = ["min", "max", "sd", "mean", *[f"p{i}" for i in range(1, 10)]]
    wide = reshape.wide(metrics.where(F.col("stain") == stain), ["cell_id"], "comp", ["nuc", "cyto", "mem"], {s: s for s in stats})
    columns = [f"{c}_{s}" for c in ("nuc", "cyto", "mem") for s in stats]
    features = wide.na.fill(0.0, columns).select("cell_id", F.array(*columns).alias("features"), F.col("nuc_p5").alias("p5"))
    return learn.tiers(features, "features", k, seed, rank_by="p5", key="cell_id").select("cell_id", "tier", "p5")


def review(cells: DataFrame, tiers: dict[str, DataFrame], positive: dict[str, list[int]], tiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls per marker, and counts and densities of the cells positive for all."""
    for marker, tier in tiers.items():
        named = tier.select("cell_id", F.col("tier").alias(f"{marker}_tier"))
        cells = learn.called(joins.lookup(cells, named, "cell_id"), f"{marker}_tier", positive[marker], f"{marker}_expression")
    member = scalar.all_true(*[F.col(f"{m}_expression") for m in tiers])
    return cells, aggregates.population_metrics(cells, tiles, member)
