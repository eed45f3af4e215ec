"""Hand-made cases for the operators: edges, ties, quirks, kernels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import aggregates, image, joins, learn, polygons, scalar, spatial, windows
from tessera.plans import technologies

c = F.col


def pixels(spark, points, key=1):
    return spark.createDataFrame([(key, y, x) for y, x in points], "cell_id long, y int, x int")


def test_morphology_of_squares_and_single_pixels(spark):
    square = aggregates.morphology(pixels(spark, [(y, x) for y in range(3) for x in range(3)])).first()
    assert (square.area, square.perimeter, square.minor) == (9, 8, 2) and square.major == pytest.approx(2 * math.sqrt(2))
    assert square.circularity == 1.0
    one = aggregates.morphology(pixels(spark, [(4, 4)]), 0.5).first()
    assert (one.area, one.perimeter, one.major, one.minor, one.circularity) == (0.25, 0.5, 0.5, 0.5, 1.0)


def test_percentiles_interpolate(spark):
    df = spark.createDataFrame([(1, v) for v in (3, 1, 4, 1, 5, 9, 2, 6)], "cell_id int, v int")
    row = aggregates.profile(df, ["cell_id"], "v", 1.0).first()
    assert (row.p1, row.p5, row.p9, row.iqr) == pytest.approx((1.0, 3.5, 6.9, 3.5)) and row.sd == pytest.approx(2.57087, abs=1e-4)


def test_half_even_rounding(spark):
    df = scalar.round_row(spark.createDataFrame([(0.5,), (2.5,), (-1.5,)], "v double"), 0)
    assert [r.v for r in df.collect()] == [0, 2, -2]


def test_boxes_are_strict(spark):
    det = spark.createDataFrame([(1, 0, 10.0, 10.0), (2, 1, 15.0, 10.0), (3, 2, 14.999, 10.0), (4, 0, 12.0, 12.0)], "det_id long, stain int, cy double, cx double")
    got = {r.det_id: r.support for r in joins.support(det).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 2}
    cells = spark.createDataFrame([(1, 0, 5), (2, 5, 5)], "cell_id int, y int, x int")
    box = spark.createDataFrame([(1, "A", 0, 0, 10, 10), (2, "B", 4, 4, 9, 9)], "ann_id int, name string, x_min int, y_min int, x_max int, y_max int")
    assert {r.cell_id: r.name for r in joins.first_box(cells, box, key="cell_id", order="ann_id", label="name").collect()} == {1: "Undefined", 2: "A"}
    both = aggregates.joined_labels(joins.in_boxes(cells, box, how="left"), "cell_id", "ann_id", "name")
    assert {r.cell_id: r.name for r in both.collect()} == {1: "Undefined", 2: "A,B"}


def test_greedy_consensus_consumes_before_it_rejects():
    at = np.array
    kept = windows.greedy_matches(at([5.0, 6.0, 6.5]), at([50.0, 50, 50]), at([0, 1, 2]), radius=5, percent=40, n_stains=3, low=10, high_y=90, high_x=90)
    assert kept == []
    assert windows.greedy_matches(at([50.0, 51, 52]), at([50.0] * 3), at([0, 1, 2]), radius=5, percent=40, n_stains=3, low=10, high_y=90, high_x=90) == [(0, 2)]
    assert windows.greedy_matches(at([50.0, 51]), at([50.0] * 2), at([0, 1]), radius=5, percent=40, n_stains=3, low=10, high_y=90, high_x=90) == []


def test_unique_names_and_lists(spark):
    df = spark.createDataFrame([(0, "A"), (1, "A"), (2, "B"), (3, "A")], "i int, n string")
    assert [r.unique_name for r in scalar.unique_names(df, "n", "i").orderBy("i").collect()] == ["A", "A_1", "B", "A_2"]
    row = df.limit(1).select(scalar.parse_list(F.lit(" '3', 4"), "int").alias("l"), scalar.resolution(F.lit("40x")).alias("r"), scalar.parse_point(F.lit("[-3, 12]")).alias("p")).first()
    assert (row.l, row.r, tuple(row.p)) == ([3, 4], 40, (-3, 12))
    assert scalar.feature_columns(["CD3 nuc AEC p5", "CD38 nuc AEC p5", "CD3 nuc hema p5", "CD3 nuc AEC IQR", "CD3 cyto area"], "CD3") == ["CD3 nuc AEC p5"]


def test_tile_count_grows_by_the_remainder():
    assert image.tile_count(2600, 1000) == 4 and image.tile_count(2000, 1000) == 2


def test_red_blood_cells_are_dropped_at_the_threshold(spark):
    px = spark.createDataFrame([(1, 0, 76.5), (2, 0, 77.0)], "cell_id int, stain int, v_hema double")
    assert [r.cell_id for r in aggregates.keep_nucleated(px).collect()] == [2]


def test_erosion_and_brush(spark):
    block = spark.createDataFrame([(y, x) for y in range(3, 8) for x in range(3, 8)], "ty int, tx int")
    assert {(r.ty, r.tx) for r in image.eroded(block, 1, 20, 20).collect()} == {(y, x) for y in range(4, 7) for x in range(4, 7)}
    corner = spark.createDataFrame([(y, x) for y in range(3) for x in range(3)], "ty int, tx int")
    assert image.eroded(corner, 1, 3, 3).count() == 9
    stroke = spark.createDataFrame([(10, 10)], "ty int, tx int")
    assert spatial.brushed(block, stroke, 1).count() == 30 and spatial.brushed(block, block.limit(1), 0, erase=True).count() == 24


def test_unreviewed_cells_are_in_neither_set(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "cell_id int, m_expression boolean")
    assert [r.cell_id for r in joins.population(df, ["m"]).collect()] == [1] and [r.cell_id for r in joins.population(df, [], ["m"]).collect()] == [2]


def test_ties_go_to_the_lower_tile(spark):
    df = spark.createDataFrame([(1, 7, 5), (1, 3, 5), (1, 4, 4)], "tier int, tile int, n int")
    assert [r.tile for r in joins.rank_within(df, ["tier"], [F.desc("n"), c("tile")], 2).orderBy("rank").collect()] == [3, 7]


def test_overlay_and_updates(spark):
    a = spark.createDataFrame([(1, None, "a"), (2, 5, "b")], "k int, v int, w string")
    b = spark.createDataFrame([(1, 9, True), (3, 8, False)], "k int, v int, z boolean")
    assert sorted(tuple(r) for r in joins.overlay(a, b, "k").collect()) == [(1, 9, "a", True), (2, 5, "b", None), (3, 8, None, False)]
    edits = spark.createDataFrame([(2, 1, 1), (2, 7, 2), (9, 1, 1)], "k int, v int, at int")
    assert {r.k: r.v for r in joins.update(a, edits, "k", "v", "at").collect()} == {1: None, 2: 7}


def test_hull_raster_and_rings(spark):
    ring = spatial.hull(np.array([0, 0, 4, 4, 2]), np.array([0, 4, 4, 0, 2]))
    assert ring[0] == ring[-1] and len(ring) == 5
    assert spatial.hull(np.array([1, 2]), np.array([1, 2])) == [(1, 1), (2, 2)]
    df = spatial.hulls(pixels(spark, [(0, 0), (0, 4), (4, 4), (4, 0), (2, 2)]))
    assert df.select(aggregates.ring_area(c("ring")).alias("a")).first().a == 16.0
    assert spatial.rasterised(df).count() == 9
    assert polygons.valid_rings(df).first().is_valid


def test_union_area_counts_overlap_once(spark):
    df = spark.createDataFrame([("a", 0, 0, 10, 10), ("a", 5, 5, 15, 15), ("a", 6, 6, 9, 9), ("b", 0, 0, 2, 2)], "name string, x_min int, y_min int, x_max int, y_max int")
    assert {r.name: r.area for r in aggregates.union_area(df, ("name",)).collect()} == {"a": 175.0, "b": 4.0}
    assert joins.overlaps(df.where("name = 'a'").withColumn("ann_id", F.monotonically_increasing_id())).count() == 3


def test_kde_peaks():
    rng = np.random.default_rng(1)
    two = np.concatenate([rng.normal(50, 4, 300), rng.normal(150, 4, 300)])
    assert aggregates.count_peaks(two) == 2 and aggregates.count_peaks(np.array([7.0])) == 1 and aggregates.count_peaks(np.array([])) == 1


def test_waxman_needs_no_pairs_to_find_the_diameter(spark):
    rng = np.random.default_rng(2)
    points = rng.uniform(0, 1000, (300, 2))
    df = spark.createDataFrame([(i, float(y), float(x)) for i, (y, x) in enumerate(points)], "id long, cy double, cx double")
    d = np.hypot(*(points[:, None] - points[None]).transpose(2, 0, 1))
    assert spatial.diameter(df) == pytest.approx(d.max())
    p = np.exp(-d / (0.1 * d.max()))
    assert spatial.waxman_edges(df, key="id").count() == ((p > 0.9) & (np.arange(300)[:, None] < np.arange(300))).sum()


def test_kernels_on_synthetic_images():
    rng = np.random.default_rng(3)
    still = rng.uniform(0, 255, (64, 80))
    assert image.phase_shift(still, image.shifted(still, -3, 5)) == (3, -5)
    holes = still.copy()
    holes[10:12, 10:12] = 255
    assert image.inpainted(holes).max() < 255 and image.inpainted(np.full((3, 3), 255)).max() == 255
    slide = np.full((80, 80), 240.0)
    slide[20:60, 20:60] = 90
    mask = image.tissue_mask(slide, sigma=1, least_size=100)
    assert mask[40, 40] and not mask[5, 5] and not image.tissue_mask(np.full((9, 9), 3.0)).any()
    blobs = np.zeros((30, 30))
    blobs[3:8, 3:8] = blobs[15:20, 15:22] = 200
    assert image.threshold_nuclei(blobs).max() == 2
    stains = image._unit(np.array([[0.65, 0.70, 0.29], list(image.AEC), [0.0, 0, 1]]))
    amounts = rng.uniform(0.2, 1.5, (500, 2)) * rng.integers(0, 2, (500, 2)) + 0.05
    rgb = (243 * np.exp(-amounts @ stains[:2]) - 1).reshape(20, 25, 3)
    found = image.macenko(rgb)
    assert found[0] @ stains[0] > 0.95 and found[1] @ stains[1] > 0.95
    assert image.local_equalised(still).max() <= 1 and image.clahe(still).shape == still.shape


def test_sharpen_against_numpy(spark):
    rng = np.random.default_rng(4)
    plane = rng.integers(0, 256, (6, 7))
    df = spark.createDataFrame([(y, x, int(plane[y, x])) for y in range(6) for x in range(7)], "y int, x int, v int")
    edge = np.pad(plane, 1, mode="edge")
    want = np.clip(5 * plane - edge[:-2, 1:-1] - edge[2:, 1:-1] - edge[1:-1, :-2] - edge[1:-1, 2:], 0, 255)
    assert {(r.y, r.x): r.v for r in image.sharpened(df).collect()} == {(y, x): want[y, x] for y in range(6) for x in range(7)}


def test_pca_and_tiers(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 3, [float(v) for v in rng.normal(i % 3 * 10, 1, 4)]) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, label int, f array<double>")
    tiered = learn.tiers(df.withColumn("p5", c("f")[0]), "f", k=3, rank_by="p5")
    assert {(r.tier, r.label) for r in tiered.collect()} == {(0, 2), (1, 1), (2, 0)}
    _, ratios = learn.reduced(df, "f")
    assert ratios.sum() == pytest.approx(1) and learn.components_for(np.array([0.5, 0.4, 0.1]), 0.9) == 2
    assert learn.choose_k(df, "f", range(2, 5), low=2, high=4)[0] == 3
    sub = learn.reclustered(tiered, "f", 1, k=2)
    assert sub.where("tier = 1 and sub is null").count() == 0 and learn.regrouped(sub, 1).where("sub is not null").count() == 0


def test_technologies_are_made_on_demand(spark):
    assert set(technologies.TECHNOLOGIES) == {"micsss", "singleplex", "tma", "if", "cycif"}
    px = spark.createDataFrame([(1, 0, "nuc", 100, 200), (2, 0, "nuc", 100, 10)], "cell_id long, stain int, comp string, v_aec int, v_hema int")
    make = lambda t: technologies.Settings(sample="s", markers=("a",), technology=t)
    assert technologies.run(make("micsss"), px).count() == 1
    assert technologies.run(make("if"), px).select("max").first()[0] == 100.0
    assert make("if").as_table(spark).count() == len(vars(make("if")))
