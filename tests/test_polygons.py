"""Polygons against a fine raster, and kernels of other modules against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import aggregates, image, learn, polygons, spatial, windows
from tessera.plans import polygon_queries
from tessera.plans.views import Views
from tests.conftest import SF

RING = "array<array<struct<y:double,x:double>>>"


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in (*points, points[0])]


def inside(rings, x, y):
    """Even-odd for arrays of points."""
    odd = np.zeros(np.shape(x), bool)
    for r in rings:
        for a, b in zip(r, r[1:]):
            over = (a["y"] > y) != (b["y"] > y)
            with np.errstate(divide="ignore", invalid="ignore"):
                odd ^= over & (x < a["x"] + (y - a["y"]) * (b["x"] - a["x"]) / (b["y"] - a["y"]))
    return odd


def star(rng, n=9, size=60):
    angle = np.sort(rng.uniform(0, 2 * np.pi, n))
    far = rng.uniform(0.3, 1, n) * size
    x, y = rng.uniform(60, 140, 2)
    return [ring(*zip((x + far * np.cos(angle)).round(2), (y + far * np.sin(angle)).round(2)))]


SHAPES = {
    "union": lambda f: bool(f.any()), "all": lambda f: bool(f.all()), "difference": lambda f: bool(f[0] and not f[1:].any()),
}


def test_overlay_matches_a_raster():
    rng = np.random.default_rng(4)
    y, x = np.mgrid[0:200:0.25, 0:200:0.25] + 0.125
    for _ in range(6):
        shapes = [star(rng) for _ in range(4)] + [[ring((50, 50), (150, 50), (150, 150), (50, 150)), ring((80, 80), (120, 80), (100, 120))]]
        maps = np.array([inside(s, x, y) for s in shapes])
        want = {"union": maps.any(0), "all": maps.all(0), "difference": maps[0] & ~maps[1:].any(0)}
        for name, keep in SHAPES.items():
            got = polygons.area_where(shapes, keep)
            assert got == pytest.approx(want[name].sum() / 16, abs=25)
            halves = polygons.area_where(shapes, keep, -np.inf, 90.5) + polygons.area_where(shapes, keep, 90.5, np.inf)
            assert halves == pytest.approx(got)


def test_simple_rings():
    good = [ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)), ring((0, 0), (2, 0), (4, 0), (4, 4))]
    bad = [ring((0, 0), (4, 4), (4, 0), (0, 4)), ring((0, 0), (4, 0), (4, 4), (0, 4))[:-1], ring((0, 0), (4, 0), (2, 0), (2, 4)), ring((0, 0), (1, 1), (2, 2)), ring((0, 0), (2, 0), (2, 2), (0, 0), (-2, 2)), [], None]
    assert [polygons.is_simple(r) for r in good] == [True] * 3 and [polygons.is_simple(r) for r in bad] == [False] * 7


@pytest.fixture(scope="module")
def shapes(spark):
    frame = polygon_queries.nested(Views(spark, SF)["outline"])
    return frame, {r.ann_id: ([[p.asDict() for p in q] for q in r.rings], r.name) for r in frame.collect()}


def test_pairs_match_brute_force(shapes):
    frame, by = shapes
    area = {i: polygons.area_where([p], SHAPES["all"]) for i, (p, _) in by.items()}
    held, meet = set(), {}
    for a in by:
        for b in by:
            both = polygons.area_where([by[a][0], by[b][0]], SHAPES["all"]) if a != b else 0
            if both >= area[b] * (1 - 1e-9) and a != b:
                held.add((a, b))
            if a < b and both > 0:
                meet[(a, b)] = both
    assert len(held) >= 25 and {(r.outer_id, r.inner_id) for r in polygons.containment(frame).collect()} == held
    got = {(r.a_id, r.b_id): r.area for r in polygons.overlap_pairs(frame).collect()}
    assert set(got) == set(meet) and all(got[k] == pytest.approx(meet[k]) for k in got)
    counts = {}
    for a, b in meet:
        names = tuple(sorted((by[a][1], by[b][1])))
        counts[names] = counts.get(names, 0) + 1
    assert {(r.name_1, r.name_2): r.n for r in polygons.overlap_counts(frame).collect()} == counts
    rest = {r.ann_id: r for r in polygons.less_contained(frame).collect()}
    for i, (p, _) in by.items():
        inner = [by[b][0] for a, b in held if a == i]
        assert rest[i].area == pytest.approx(polygons.area_where([p, *inner], SHAPES["difference"]))
        assert sum(polygons.area_where([[[q.asDict() for q in t]]], SHAPES["all"]) for t in rest[i].rings) == pytest.approx(rest[i].area)
    whole = polygons.area_where([p for p, _ in by.values()], SHAPES["union"])
    assert polygons.union_area(frame).first().area == pytest.approx(whole) and polygons.union_area(frame, strip=137.0).first().area == pytest.approx(whole)


def test_points_in_polygons_and_empty_tables(spark, shapes):
    frame, by = shapes
    points = spark.createDataFrame([(i, (i * 97) % 4000 + 0.37, (i * 61) % 4000 + 0.41, 1) for i in range(200)], "cell_id long, y double, x double, rings int")
    hits = polygons.within(points.drop("rings"), frame, key="cell_id", how="left").collect()
    want = {(i, a) for i in range(200) for a, (p, _) in by.items() if inside(p, np.float64((i * 61) % 4000 + 0.41), np.float64((i * 97) % 4000 + 0.37))}
    assert {(r.cell_id, r.ann_id) for r in hits if r.ann_id is not None} == want and {r.cell_id for r in hits} == set(range(200))
    none = frame.limit(0)
    assert polygons.union_area(none).first().area == 0 and polygons.containment(none).count() == polygons.less_contained(none).count() == 0
    cells = points.drop("rings").withColumn("m", F.lit(True))
    assert polygons.population_by_annotation(cells.limit(0), frame, F.col("m")).where("n = 0 and percent is null").count() == len(by)


def flood(mask):
    out, n = np.zeros(mask.shape, int), 0
    for start in zip(*np.nonzero(mask)):
        if not out[start]:
            n += 1
            stack = [start]
            while stack:
                y, x = stack.pop()
                if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x] and not out[y, x]:
                    out[y, x] = n
                    stack += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    return out


def test_labels_match_a_flood_fill():
    rng = np.random.default_rng(5)
    for share in (0, 0.3, 0.55, 0.7, 1):
        mask = rng.random((40, 57)) < share
        assert (image.labelled(mask) == flood(mask)).all()
    spiral = np.zeros((9, 9), bool)
    spiral[0], spiral[:, 8], spiral[8], spiral[2:, 0], spiral[2, :7], spiral[2:7, 6], spiral[6, 2:7] = [True] * 7
    assert (image.labelled(spiral) == flood(spiral)).all()


def test_numbers_without_a_group(spark):
    table = spark.createDataFrame([((i * 37) % 101, i) for i in range(101)], "k int, i int")
    got = {r.i: r.cell_index for r in windows.dense_ids(table, ["k"]).collect()}
    assert got == {i: (i * 37) % 101 for i in range(101)}
    assert windows.dense_ids(table.limit(0), ["k"]).count() == 0


def test_empty_tables_and_masks(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, core int")
    assert learn.tiers(none, "embedding").count() == learn.tiers_per_core(none, "embedding", "core").count() == learn.mixture(none, "embedding", merge_to=2).count() == 0
    assert aggregates.bounds(spark.createDataFrame([], "ty int, tx int"), 5, 130, 140).count() == 0
    assert spatial.diameter(spark.createDataFrame([], "cy double, cx double")) == 0


def test_cores_are_clustered_apart(spark):
    rng = np.random.default_rng(6)
    rows = [(c, i, [float(v) for v in rng.normal(20 * (i % 3) * (1 + c), 0.5, 4)]) for c in range(3) for i in range(60)]
    got = learn.tiers_per_core(spark.createDataFrame(rows, "core int, vec_id int, embedding array<double>"), "embedding", "core", k=3).collect()
    for core in range(3):
        groups = {}
        for r in got:
            if r.core == core:
                groups.setdefault(r.vec_id % 3, set()).add(r.tier)
        assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == 3


def test_diameter_and_autofluorescence(spark):
    points = np.random.default_rng(7).uniform(0, 100, (300, 2))
    frame = spark.createDataFrame([tuple(map(float, p)) for p in points], "cy double, cx double")
    assert spatial.diameter(frame) == pytest.approx(max(np.hypot(*(points - p).T).max() for p in points))
    px = spark.createDataFrame([(i, v, (i * 3) % 7, (i * 5) % 11) for i, v in enumerate([0, 10, 50, 200, 30, 90])], "i int, v int, a int, b int")
    rows = sorted(px.collect(), key=lambda r: r.i)
    v = np.array([r.v for r in rows], float)
    for name in "ab":
        af = np.array([r[name] for r in rows], float)
        v = np.where(np.array([r.v for r in rows]) == 0, 0, np.maximum(v - af / af.max() * v.max(), 0))
    out = image.less_autofluorescence(px, ["a", "b"])
    assert [r.v for r in sorted(out.collect(), key=lambda r: r.i)] == np.floor(v).astype(int).tolist()
    assert out._jdf.queryExecution().executedPlan().toString().count("Scan") <= 1


def test_dark_autofluorescence_channel_leaves_nothing(spark):
    """As the query's SQL has it: greatest(null, 0) is 0."""
    px = spark.createDataFrame([(0, 5, 0, 1), (1, 9, 0, 0), (2, 0, 0, 1)], "i int, v int, dark int, lit int")
    got = lambda *channels: [r.v for r in image.less_autofluorescence(px, list(channels)).orderBy("i").collect()]
    assert got("lit") == [0, 9, 0]
    assert got("dark") == got("dark", "lit") == got("lit", "dark") == [0, 0, 0]
    none = px.withColumn("dark", F.lit(None).cast("int"))
    assert [r.v for r in image.less_autofluorescence(none, ["dark"]).collect()] == [0, 0, 0]
    assert image.less_autofluorescence(px.where("false"), ["lit"]).count() == 0


def test_cytoplasm_reaches_as_far_as_cells_grow(spark):
    nuclei = spark.createDataFrame([(1, 100, 100)], "cell_id long, y int, x int")
    grown = spark.createDataFrame([(1, 100, x) for x in range(20, 181)], "cell_id long, y int, x int")
    assert spatial.cytoplasm(grown, nuclei, 300, 300).count() == 160
