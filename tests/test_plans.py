"""Physical plans: joins by key, pruned and filtered scans, no Python where none is needed."""

import numpy as np
import pytest

import __spark_entry__  # noqa: F401  (fills the registry)
from tessera.operators import joins, spatial
from tessera.plans import registry
from tessera.plans.views import Views
from tests.conftest import SF


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


SPATIAL = ["c4_consensus_support", "c5_nearest", "c6_point_in_rectangle", "c7_point_in_polygon", "c8_within_all_matches", "c9_containment", "c14_distances", "d16_joined_annotations", "d19_overlap_pairs"]


@pytest.mark.parametrize("name", SPATIAL)
def test_spatial_joins_have_keys(spark, name):
    text = plan(registry.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["flagship_tile_density", "d1_intensity_profile", "d4_region_stats", "d5_morphology", "d13_population_metrics", "e4_top_tiles", "g1_wide_rows", "i2_erosion", "i4_sharpen"])
def test_no_python_in_sql_operators(spark, name):
    text = plan(registry.QUERIES[name](spark, SF))
    assert "Python" not in text and "Pandas" not in text and "Arrow" not in text


def test_scans_are_pruned_and_filtered(spark):
    text = plan(registry.QUERIES["b14_bounds"](spark, SF))
    assert "o_totalprice" not in text and "o_orderdate" not in text
    text = plan(Views(spark, SF)["lineitem"].where("l_quantity > 40").select("l_partkey"))
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,40.0)]" in text and "ReadSchema: struct<l_partkey:bigint,l_quantity:double>" in text


def test_morphology_shuffles_by_cell_and_line(spark):
    text = plan(registry.QUERIES["d5_morphology"](spark, SF))
    assert "Join" not in text


def test_near_pairs_scale_with_density(spark):
    points = spark.range(20_000).selectExpr("id", "cast(id % 200 * 10 as double) as cy", "cast(id div 200 * 10 as double) as cx")
    assert joins.distances(points, 10.5, key="id").count() == 2 * 200 * 100 - 200 - 100
    assert spatial.diameter(points) == pytest.approx((1990**2 + 990**2) ** 0.5)


def test_near_pairs_never_broadcast_their_copies(spark):
    """The planner takes a point's copies for as few as the points, so a table below its limit filled the driver."""
    text = plan(registry.QUERIES["c14_distances"](spark, SF))
    assert "BroadcastHashJoin" not in text and "SortMergeJoin" in text


def test_near_pairs_meet_once(spark):
    """Coordinates on and beside cell borders, below 0, equal points, keys that don't follow the grid, absent values."""
    rng = np.random.default_rng(5)
    at = np.vstack([rng.integers(-9, 9, (150, 2)) * 1.5, rng.uniform(-12, 12, (150, 2)), rng.integers(-4, 4, (100, 2)) * 3 - 1e-12])
    keys = rng.permutation(len(at)).tolist()
    rows = [(k, float(y), float(x)) for k, (y, x) in zip(keys, at, strict=True)]
    points = spark.createDataFrame([*rows, (1000, None, 1.0), (None, 0.0, 0.0)], "id long, cy double, cx double")
    want = sorted((k, m) for k, y, x in rows for m, v, u in rows if k < m and np.sqrt((y - v) ** 2 + (x - u) ** 2) < 3)
    got = joins.distances(points, 3.0, key="id").collect()
    assert sorted((r.src, r.dst) for r in got) == want
    place = {k: (y, x) for k, y, x in rows}
    assert all(r.d == pytest.approx(np.hypot(place[r.src][0] - place[r.dst][0], place[r.src][1] - place[r.dst][1])) for r in got)


def test_nearest_never_broadcasts_copies(spark):
    text = plan(registry.QUERIES["c5_nearest"](spark, SF))
    assert "BroadcastHashJoin" not in text and "SortMergeJoin" in text


def test_nearest_among_crowded_targets(spark):
    """30,000 targets of one place, a crowd, a few far off, ties, points beyond reach: as brute force, with few rows of pairs."""
    rng = np.random.default_rng(3)
    rows = [(i, 5.0, 5.0) for i in range(30_000, 60_000)] + [(i, float(y), float(x)) for i, (y, x) in enumerate(rng.integers(-40, 40, (2000, 2)) / 4)]
    rows += [(70_000 + i, float(y), float(x)) for i, (y, x) in enumerate(rng.uniform(10, 90, (20, 2)))]
    points = [(i, float(y), float(x)) for i, (y, x) in enumerate(rng.integers(-60, 400, (300, 2)) / 4)] + [(7, 5.0, 5.0), (400, None, 1.0)]
    t = np.array(rows)
    want = {}
    for i, y, x in points:
        if y is None:
            continue
        d2 = (t[:, 1] - y) ** 2 + (t[:, 2] - x) ** 2
        if d2.min() < 100 and (d2.min(), t[d2 == d2.min(), 0].min()) < want.get(i, (1e9, 0)):
            want[i] = (d2.min(), t[d2 == d2.min(), 0].min())
    df = joins.nearest(spark.createDataFrame(points, "id long, cy double, cx double"), spark.createDataFrame(rows, "t long, cy double, cx double"), 10.0, point_id="id", target_id="t")
    got = df.collect()
    assert len(got) == len(want) and {r.id: (r.d2, r.t) for r in got} == want
    assert 0 < len(want) < 300
