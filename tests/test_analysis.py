"""Pixels to population metrics on a drawn slide."""

import numpy as np
from pyspark.sql import functions as F

from tessera.plans import analysis
from tessera.plans.technologies import Settings


SPOTS = [(y, x) for y in (15, 45, 75) for x in (15, 45, 75)]


def slide(spark):
    """Nine nuclei in three stains; the fifth is seen in the first stain only."""
    rng = np.random.default_rng(1)
    rows = []
    for stain in range(3):
        hema, aec = np.full((90, 90), 5), np.zeros((90, 90), int)
        for i, (y, x) in enumerate(SPOTS):
            if i != 4 or stain == 0:
                hema[y - 3 : y + 4, x - 3 : x + 4] = 200
            aec[y - 6 : y + 7, x - 6 : x + 7] = (40 + 150 * (i % 2)) + rng.integers(0, 5, (13, 13))
        rows += [(stain, y, x, int(hema[y, x]), int(aec[y, x])) for y in range(90) for x in range(90)]
    return spark.createDataFrame(rows, "stain int, y int, x int, hema int, aec int")


def test_from_pixels_to_population(spark):
    px = slide(spark)
    settings = Settings(sample="s", markers=("a", "b", "c"), technology="micsss", tile=30)
    out = analysis.analyse(px, settings, stains=[0, 1, 2], height=90, width=90)
    cells = out.cells.collect()
    assert {(round(r.cy), round(r.cx)) for r in cells} == set(SPOTS) - {SPOTS[4]}
    assert all(r.area == 49 and r.perimeter == 24 for r in cells)
    sizes = {r.comp: r.n for r in out.pixels.groupBy("comp").agg((F.count("*") / 8).alias("n")).collect()}
    assert sizes["nuc"] == 49 and sizes["cyto"] > 49 and 0 < sizes["mem"] < sizes["cyto"]
    metrics = out.metrics.where("comp = 'nuc' and stain = 1").collect()
    assert len(metrics) == 8 and all(r.mean > 0.1 for r in metrics)
    tiers = analysis.cluster(out.metrics, 1, k=2)
    assert {r.tier: r["count"] for r in tiers.groupBy("tier").count().collect()} == {0: 4, 1: 4}
    tiled = out.cells.withColumn("tile_index", F.col("ty") * 3 + F.col("tx"))
    tiles = spark.range(9).select(F.col("id").cast("int").alias("tile_index"), F.lit(1e6).alias("tissue_area_um2"))
    called, found = analysis.review(tiled, {"b": tiers}, {"b": [0]}, tiles)
    total = found.where("tile_index is null").first()
    assert (total.n, total.percent) == (4, 50.0) and called.where("b_expression").count() == 4


def test_single_image_technologies_and_cores(spark):
    """One image's cells without matching; tiles outside all cores are undefined, the first of two cores counts."""
    settings = Settings(sample="s", markers=("a", "b", "c"), technology="if", tile=30)
    cores = spark.createDataFrame([("B", 1, 0, 60, 0, 60), ("A", 0, 0, 30, 0, 90), ("C", 2, 75, 90, 0, 90)], "core string, place int, y_min int, y_max int, x_min int, x_max int")
    out = analysis.analyse(slide(spark), settings, stains=[0, 1, 2], height=90, width=90, cores=cores)
    found = {(round(r.cy), round(r.cx)): r.core for r in out.cells.collect()}
    assert set(found) == set(SPOTS)
    assert all(core == ("A" if y == 15 else "B" if y == 45 and x < 60 else "Undefined") for (y, x), core in found.items())
    means = [r.mean for r in out.metrics.where("comp = 'nuc'").collect()]
    assert len(means) == 27 and min(means) >= 40 and max(means) <= 195
    bare = analysis.in_cores(out.cells.drop("core"), cores.limit(0), 30)
    assert {r.core for r in bare.collect()} == {"Undefined"}
