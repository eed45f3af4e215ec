"""Queries over all of their input, against brute force."""

import numpy as np
import pytest

from tessera.plans import analysis_queries, registry  # noqa: F401  (the first fills the registry)
from tests.conftest import SF


class Drawn(dict):
    """Views given as tables."""


def run(spark, name, monkeypatch, **tables):
    monkeypatch.setattr(registry, "Views", lambda s, d: Drawn(tables))
    return registry.QUERIES[name](spark, "").collect()


def brute_cytoplasm(shape):
    """(n, s) of each cell: every pixel's nearest nucleus among all."""
    nuclei = {(i, i // 1000 * 9 + y, i % 1000 * 8 + x) for i, y, x in shape}
    height, taken = max(y for _, y, _ in nuclei) + 3, {(y, x) for _, y, x in nuclei}
    who = np.array(sorted(nuclei))
    out = {}
    for i, y0, x0 in nuclei:
        for y in range(max(0, y0 - 2), min(height, y0 + 3)):
            for x in range(max(0, x0 - 2), min(8000, x0 + 3)):
                d2 = (who[:, 1] - y) ** 2 + (who[:, 2] - x) ** 2
                if who[d2 == d2.min(), 0].min() == i and (y, x) not in taken:
                    out.setdefault(i, set()).add((y, x))
    for i in {i for i, _, _ in nuclei} - set(out):
        out[i] = {(y, x) for j, y, x in nuclei if i == j}
    return {i: (len(p), sum(y * 100 + x for y, x in p)) for i, p in out.items()}


def test_cytoplasm_of_every_cell(spark, monkeypatch):
    rng = np.random.default_rng(4)
    cells = [*range(1, 45), 999, 1000, 1001, 1002, 2003]
    shape = sorted({(i, int(rng.integers(1, 8)), int(rng.integers(0, 6))) for i in cells for _ in range(9)})
    table = spark.createDataFrame(shape, "cell_id long, y int, x int")
    got = {r.cell_id: (r.n, r.s) for r in run(spark, "h4_cytoplasm_all", monkeypatch, shape=table)}
    assert set(got) == set(cells) and got == brute_cytoplasm(shape)


def test_difference_of_every_annotation(spark, monkeypatch):
    boxes = [(1, "a", 0, 0, 40, 30), (101, "a", 5, 5, 20, 20), (2, "b", 10, 8, 30, 25), (3, "c", 100, 100, 110, 120), (4, "d", 12, 9, 14, 12)]
    table = spark.createDataFrame(boxes, "ann_id int, name string, x_min int, y_min int, x_max int, y_max int")
    got = {r.ann_id: r.difference for r in run(spark, "f7_difference_all", monkeypatch, ann_nested=table)}
    want = {}
    for i, _, x0, y0, x1, y1 in boxes:
        grid = np.zeros((130, 130), bool)
        grid[y0:y1, x0:x1] = True
        for j, _, a0, b0, a1, b1 in boxes:
            if i != j and x0 < a0 and y0 < b0 and a1 < x1 and b1 < y1:
                grid[b0:b1, a0:a1] = False
        want[i] = float(grid.sum())
    assert got == want


@pytest.mark.parametrize("name, view, key", [("h4_cytoplasm_all", "shape", "cell_id"), ("f7_difference_all", "ann_nested", "ann_id")])
def test_no_id_is_lost(spark, name, view, key):
    from tessera.plans.views import Views

    ids = {r[0] for r in Views(spark, SF)[view].select(key).distinct().collect()}
    assert {r[key] for r in registry.QUERIES[name](spark, SF).select(key).collect()} == ids


def test_learning_uses_the_whole_range(monkeypatch):
    """choose_k and mixture are called with the operators' own ranges."""
    import inspect

    from tessera.operators import learn

    class Stop(Exception):
        pass

    def seen(f):
        def call(*args, **kwargs):
            bound = inspect.signature(f).bind(*args, **kwargs)
            bound.apply_defaults()
            raise Stop(dict(bound.arguments))

        return call

    for name, query, want in (("choose_k", "d24_choose_k", {"ks": range(5, 50), "low": 15, "high": 30}), ("mixture", "j7_gaussian_mixture", {"k": 60})):
        monkeypatch.setattr(learn, name, seen(getattr(learn, name)))
        monkeypatch.setattr(registry, "Views", lambda s, d: Drawn(feat=None))
        with pytest.raises(Stop) as stop:
            registry.QUERIES[query](None, "")
        assert {k: stop.value.args[0][k] for k in want} == want


def test_choose_k_runs_all_fits_in_shared_passes(spark):
    """45 values of k by 3 fits took a job a round each; inertia and silhouette as brute force and pyspark.ml have them."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    from tessera.operators import learn

    rng = np.random.default_rng(1)
    made = np.repeat(rng.uniform(-50, 50, (6, 5)), 60, axis=0) + rng.normal(0, 0.2, (360, 5)) + 1000
    df = spark.createDataFrame([(v.tolist(),) for v in made], "f array<double>").repartition(3)
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    context.setJobGroup("choose_k", "")
    try:
        k, rows = learn.choose_k(df, "f")
        jobs = len(tracker.getJobIdsForGroup("choose_k"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert [r[0] for r in rows] == list(range(5, 50)) and k == 15 and max(rows, key=lambda r: r[2])[0] == 6 and jobs < 100
    inertia, silhouette = dict((r[0], r[1:]) for r in rows)[6]
    groups = made.reshape(6, 60, 5)
    assert inertia == pytest.approx(((groups - groups.mean(1, keepdims=True)) ** 2).sum())
    truth = spark.createDataFrame([(v.tolist(), i // 60) for i, v in enumerate(made)], "f array<double>, prediction int").select(array_to_vector("f").alias("features"), "prediction")
    assert silhouette == pytest.approx(ClusteringEvaluator().evaluate(truth))


def test_choose_k_on_odd_tables(spark):
    from tessera.operators import learn

    few = spark.createDataFrame([([1.0, 2.0],)] * 3 + [([4.0, 6.0],)], "f array<float>")
    assert [(k, round(a, 6), round(b, 6)) for k, a, b in learn.choose_k(few, "f", range(2, 4))[1]] == [(2, 0.0, 0.75), (3, 0.0, 0.75)]
    assert learn.choose_k(few.where("false"), "f", range(5, 7)) == (15, [(5, 0.0, 0.0), (6, 0.0, 0.0)])
    with pytest.raises(Exception, match="one length"):
        learn.choose_k(few.union(spark.createDataFrame([([1.0],)], few.schema)), "f", range(2, 4))
