"""Scaling, PCA, clustering and calling of cells, with pyspark.ml."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tessera.sources import store


def scaled_vectors(df: DataFrame, column: str, out: str = "scaled") -> DataFrame:
    """Vectors with zero mean and unit population deviation per component."""
    vectors = df.withColumn("_v", array_to_vector(F.col(column).cast("array<double>")))
    if not df.limit(1).count():
        return vectors.withColumnRenamed("_v", out)
    row = vectors.select(Summarizer.metrics("mean", "variance", "count").summary(F.col("_v")).alias("s")).select("s.mean", "s.variance", "s.count").first()
    n = row["count"]
    mean, sd = np.array(row["mean"].toArray()), np.sqrt(row["variance"].toArray() * (n - 1) / n)
    sd[sd == 0] = 1.0
    pairs = F.arrays_zip(F.col(column).cast("array<double>").alias("v"), F.array(*map(F.lit, mean.tolist())).alias("m"), F.array(*map(F.lit, sd.tolist())).alias("s"))
    return vectors.withColumn(out, array_to_vector(F.transform(pairs, lambda p: (p["v"] - p["m"]) / p["s"]))).drop("_v")


def components_for(ratios: np.ndarray, share: float) -> int:
    """The fewest components whose variances reach the share."""
    return min(len(ratios), int(np.searchsorted(np.cumsum(ratios), share - 1e-12)) + 1)


def reduced(df: DataFrame, column: str, share: float = 0.90, out: str = "pca") -> tuple[DataFrame, np.ndarray]:
    """Principal components of scaled vectors up to the share of variance, and all
    variance ratios (J1)."""
    scaled = scaled_vectors(df, column)
    shape = scaled.agg(F.max(F.size(column)), F.count("*")).first()
    if not shape[1]:
        return scaled.withColumnRenamed("scaled", out), np.zeros(0)
    width = min(shape)
    model = PCA(k=width, inputCol="scaled", outputCol="_all").fit(scaled)
    ratios = model.explainedVariance.toArray()
    k = components_for(ratios, share)
    cut = model.transform(scaled).withColumn(out, array_to_vector(F.slice(vector_to_array("_all"), 1, k)))
    return cut.drop("_all", "scaled"), ratios


def best_kmeans(df: DataFrame, k: int, features: str, seed: int = 0, inits: int = 3, rounds: int = 300, out: str = "prediction"):
    """The cheapest of several k-means fits."""
    fits = [KMeans(k=k, seed=seed + i, maxIter=rounds, featuresCol=features, predictionCol=out).fit(df) for i in range(inits)]
    return min(fits, key=lambda m: m.summary.trainingCost)


def tiers(df: DataFrame, column: str, k: int = 7, seed: int = 0, share: float = 0.90, rank_by: str | None = None, key: str = "vec_id") -> DataFrame:
    """k-means tiers (J2); with ``rank_by`` tier 0 has the largest median of that
    column, so that numbers don't depend on the clustering's labels."""
    vectors, ratios = reduced(df, column, share)
    if not len(ratios):
        return vectors.withColumn("tier", F.lit(0)).drop("pca")
    # Scaling and projection are done once for all fits, not in each of their rounds.
    vectors = store.saved(vectors)
    called = best_kmeans(vectors, k, "pca", seed, out="_c").transform(vectors).drop("pca")
    if rank_by is None:
        return called.withColumnRenamed("_c", "tier")
    medians = called.groupBy("_c").agg(F.median(rank_by).alias("_m"))
    ranks = medians.withColumn("tier", F.row_number().over(Window.orderBy(F.desc("_m"), "_c")) - 1).drop("_m")
    return called.join(F.broadcast(ranks), "_c").drop("_c")  # k rows


def _fit_core(points: np.ndarray, k: int, seed: int, share: float) -> np.ndarray:
    """Scaled, projected to the share of variance, the cheapest of three k-means."""
    spread = points.std(axis=0)
    scaled = (points - points.mean(axis=0)) / np.where(spread == 0, 1.0, spread)
    _, sizes, axes = np.linalg.svd(scaled, full_matrices=False)
    ratios = sizes**2 / max((sizes**2).sum(), 1e-300)
    reduced_points = scaled @ axes[: components_for(ratios, share)].T
    fits = []
    for i in range(3):
        label = grouped(reduced_points, k, seed + i)
        cost = sum(((reduced_points[label == g] - reduced_points[label == g].mean(axis=0)) ** 2).sum() for g in np.unique(label))
        fits.append((cost, i, label))
    return min(fits, key=lambda f: f[:2])[2]


def tiers_per_core(df: DataFrame, column: str, core: str, k: int = 7, seed: int = 0, share: float = 0.90) -> DataFrame:
    """Each core clustered for itself (J3), one task a core: a core is a few thousand cells."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(tier=_fit_core(np.vstack(pdf[column].to_list()).astype(float), k, seed, share).astype("int32"))

    schema = StructType([*df.schema.fields, StructField("tier", IntegerType())])
    return df.groupBy(core).applyInPandas(run, schema)


def reclustered(df: DataFrame, column: str, tier: int, k: int = 7, seed: int = 0, key: str = "vec_id") -> DataFrame:
    """One tier split into sub-tiers (J5): tier stays the root, ``sub`` is new and
    null elsewhere."""
    part = tiers(df.where(F.col("tier") == tier).drop("tier"), column, k, seed).select(key, F.col("tier").alias("sub"))
    return df.join(part, key, "left")


def regrouped(df: DataFrame, root: int) -> DataFrame:
    """A root's sub-tiers merged back."""
    return df.withColumn("sub", F.when(F.col("tier") == root, F.lit(None)).otherwise(F.col("sub")))


def called(cells: DataFrame, tier: str, positive: list[int], out: str, core: tuple[str, str] | None = None) -> DataFrame:
    """Positive calling (J8): True for the chosen tiers, else False, in the active core only."""
    flag = F.col(tier).isin(positive)
    if core:
        old = F.col(out) if out in cells.columns else F.lit(None).cast("boolean")
        flag = F.when(F.col(core[0]) == core[1], flag).otherwise(old)
    return cells.withColumn(out, flag)


class _Blocks:
    """A column of vectors as binary blocks of up to 2048 rows, in one partition a
    core, so that many fits share each pass: Spark's KMeans needs a job for every
    round of every fit. Passes see vectors less their mean, which keeps 32-bit
    products exact enough for assignments."""

    def __init__(self, df: DataFrame, column: str):
        context, kind = df.sparkSession.sparkContext, np.dtype("<f4" if dict(df.dtypes)[column] == "array<float>" else "<f8")

        def pack(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    rows = batch.column(0).slice(at, 2048)
                    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(kind)
                    if rows.null_count or len(set(rows.value_lengths().to_pylist())) > 1 or not np.isfinite(flat).all():
                        raise ValueError(f"{column}: vectors have to be finite and of one length")
                    yield pa.RecordBatch.from_pydict({"block": [flat.tobytes()], "n": pa.array([len(rows)], pa.int32())})

        vectors = df.select(F.col(column).cast("array<float>" if kind.itemsize == 4 else "array<double>"))
        blocks = vectors.mapInArrow(pack, "block binary, n int").where("n > 0").coalesce(context.defaultParallelism)
        self.blocks, self.kind = store.saved(blocks.withColumn("id", F.monotonically_increasing_id())), kind
        shape = self.blocks.agg(F.sum("n"), F.max(F.length("block") / F.col("n")), F.min(F.length("block") / F.col("n"))).first()
        if shape[1] != shape[2]:
            raise ValueError(f"{column}: vectors have to be of one length")
        self.n, self.width, self.mean = shape[0] or 0, int((shape[1] or 0) / kind.itemsize), 0.0
        if self.n:
            self.mean = self.summed(lambda x, i: x.sum(0)) / self.n

    def _mapped(self, function, schema: str, merged: bool) -> DataFrame:
        kind, width, mean = self.kind, self.width, self.mean

        def run(batches):
            total = None
            for batch in batches:
                for block, i in zip(batch.column("block"), batch.column("id").to_pylist(), strict=True):
                    out = function(np.frombuffer(block.as_buffer(), kind).reshape(-1, width).astype(float) - mean, i)
                    if not merged and len(out):
                        yield pa.RecordBatch.from_pydict({"out": [np.ascontiguousarray(out).tobytes()]})
                    elif merged:
                        total = out if total is None else total + out
            if total is not None:
                yield pa.RecordBatch.from_pydict({"out": [total.tobytes()]})

        return self.blocks.select("block", "id").mapInArrow(run, schema)

    def summed(self, function) -> np.ndarray:
        """The sum of ``function(vectors, block id)``, an array of doubles, over all blocks;
        by a tree where partitions are many."""
        parts = self._mapped(function, "out binary", True)
        if self.blocks.rdd.getNumPartitions() <= 16:
            return np.sum([np.frombuffer(r[0]) for r in parts.collect()], axis=0)
        return parts.rdd.map(lambda r: np.frombuffer(r[0])).treeReduce(lambda a, b: a + b)

    def chosen(self, function) -> np.ndarray:
        """The few rows of doubles that ``function`` picks from all blocks."""
        found = [np.frombuffer(r[0]) for r in self._mapped(function, "out binary", False).collect()]
        return np.concatenate([f for f in found if len(f)] or [np.zeros(0)])


def _gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all vectors to all centres, not below 0."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(1), 0)


def _seeds(blocks: _Blocks, ks: list[int], seeds: list[int]) -> list[np.ndarray]:
    """First centres of every seed and k, by k-means|| over all vectors: any vector, two
    draws of about 2·max(ks) candidates by their squared distance, weighted by the
    vectors they are nearest to, and k-means++ over them for each k."""
    most, out = 2 * max(ks), []

    def first(x, i):
        """The block's least of random numbers, and its vector, for each seed."""
        lots = [np.random.default_rng([seed, 2, i]).random(len(x)) for seed in seeds]
        return np.vstack([np.concatenate([[j, lot.min()], x[lot.argmin()]]) for j, lot in enumerate(lots)])

    firsts = blocks.chosen(first).reshape(-1, blocks.width + 2)
    pools = [min(firsts[firsts[:, 0] == j].tolist())[2:] for j in range(len(seeds))]
    pools = [np.array([p]) for p in pools]
    for step in range(2):
        costs = blocks.summed(lambda x, i: np.array([_gaps(x, p).min(1).sum() for p in pools]))

        def draw(x, i, step=step, costs=costs):
            hits = []
            for j, p in enumerate(pools):
                hit = np.random.default_rng([seeds[j], step, i]).random(len(x)) * costs[j] < most * _gaps(x, p).min(1)
                hits.append(np.hstack([np.full((hit.sum(), 1), float(j)), x[hit]]))
            return np.vstack(hits)

        drawn = blocks.chosen(draw).reshape(-1, blocks.width + 1)
        drawn = drawn[np.lexsort(drawn.T[::-1])]  # whatever the order of tasks
        pools = [np.vstack([p, drawn[drawn[:, 0] == j, 1:]]) for j, p in enumerate(pools)]
    weights = blocks.summed(lambda x, i: np.concatenate([np.bincount(_gaps(x, p).argmin(1), minlength=len(p)).astype(float) for p in pools]))
    weights = np.split(weights, np.cumsum([len(p) for p in pools])[:-1])
    for seed, pool, weight in zip(seeds, pools, weights, strict=True):
        for k in ks:
            rng = np.random.default_rng([seed, k])
            picks = [rng.choice(len(pool), p=weight / weight.sum())]
            near = _gaps(pool, pool[picks]).min(1)
            while len(picks) < k:
                odds = near * weight
                picks.append(rng.choice(len(pool), p=odds / odds.sum()) if odds.sum() > 0 else picks[0])
                near = np.minimum(near, _gaps(pool, pool[picks[-1:]])[:, 0])
            out.append(pool[picks])
    return out


def kmeans_of_all(blocks: _Blocks, fits: list[np.ndarray], rounds: int, tol: float = 1e-4) -> list[np.ndarray]:
    """Lloyd's rounds for many fits at once, a pass a round over all vectors, until
    no centre moves more than ``tol``; a centre without vectors stays."""
    fits, live = list(fits), list(range(len(fits)))
    for _ in range(rounds):
        now = [np.hstack([fits[i], -(fits[i] ** 2).sum(1)[:, None] / 2]).astype("<f4") for i in live]

        def step(x, i, now=now):
            one, out = np.hstack([x, np.ones((len(x), 1))]).astype("<f4"), []
            for f in now:
                near = f @ one.T  # largest for the nearest centre
                hot = (near == near.max(0)).astype("<f4")
                if hot.sum() != len(x):  # ties go to the first centre
                    hot = (np.arange(len(f))[:, None] == near.argmax(0)).astype("<f4")
                out.append((hot @ one).astype(float).ravel())
            return np.concatenate(out)

        sums, at, moving = blocks.summed(step), 0, []
        for i in live:
            old = fits[i]
            total = sums[at : at + old.size + len(old)].reshape(len(old), -1)
            at += total.size
            fits[i] = np.where(total[:, -1:] > 0, total[:, :-1] / np.maximum(total[:, -1:], 1), old)
            if ((fits[i] - old) ** 2).sum(1).max() > tol * tol:
                moving.append(i)
        if not (live := moving):
            break
    return fits


def _silhouettes(blocks: _Blocks, fits: list[np.ndarray]) -> list[float]:
    """Mean silhouettes by squared distances over all vectors, as ClusteringEvaluator has them."""
    def members(x, i):
        out = []
        for f in fits:
            hot = np.zeros((len(x), len(f)))
            hot[np.arange(len(x)), _gaps(x, f).argmin(1)] = 1
            out.append(np.hstack([hot.T @ x, hot.T @ (x * x).sum(1)[:, None], hot.sum(0)[:, None]]).ravel())
        return np.concatenate(out)

    sums = np.split(blocks.summed(members), np.cumsum([len(f) * (blocks.width + 2) for f in fits])[:-1])
    sums = [s.reshape(-1, blocks.width + 2) for s in sums]

    def score(x, i):
        out = []
        for f, s in zip(fits, sums, strict=True):
            n, own, rows = s[:, -1], _gaps(x, f).argmin(1), np.arange(len(x))
            many = np.maximum(n, 1)
            far = np.maximum((x * x).sum(1)[:, None] + s[:, -2] / many - 2 * (x @ (s[:, :-2] / many[:, None]).T), 0)
            a = far[rows, own] * n[own] / np.maximum(n[own] - 1, 1)
            far[:, n == 0] = np.inf
            far[rows, own] = np.inf
            b = far.min(1)
            top = np.maximum(a, b)
            known = (n[own] > 1) & np.isfinite(b) & (top > 0)
            out.append(((b - a)[known] / top[known]).sum())
        return np.array(out)

    return (blocks.summed(score) / blocks.n).tolist()


def choose_k(df: DataFrame, column: str, ks: range = range(5, 50), seed: int = 0, low: int = 15, high: int = 30, inits: int = 3, rounds: int = 50) -> tuple[int, list[tuple[int, float, float]]]:
    """k by silhouette and elbow (D24): the smaller of both, forced to ``low``
    outside ``low`` to ``high``; with (k, inertia, silhouette) of every k. All fits,
    ``inits`` a k, share each pass over the vectors; the cheapest of a k counts."""
    ks, blocks = list(ks), _Blocks(df, column)
    if not blocks.n:
        return low, [(k, 0.0, 0.0) for k in ks]
    fits = kmeans_of_all(blocks, _seeds(blocks, ks, [seed + i for i in range(inits)]), rounds)
    costs = blocks.summed(lambda x, i: np.array([_gaps(x, f).min(1).sum() for f in fits])).reshape(inits, len(ks))
    best = [fits[costs[:, j].argmin() * len(ks) + j] for j in range(len(ks))]
    rows = list(zip(ks, costs.min(0).tolist(), _silhouettes(blocks, best), strict=True))
    best = max(rows, key=lambda r: (r[2], -r[0]))[0]
    x, y = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows])
    down = (x - x[0]) / max(np.ptp(x), 1e-12) + (y - y.min()) / max(np.ptp(y), 1e-12)
    k = min(best, int(x[down.argmin()]))
    return (k if low <= k <= high else low), rows


def grouped(points: np.ndarray, k: int, seed: int = 0, rounds: int = 100) -> np.ndarray:
    """k-means over a few points in memory; equal points share a group."""
    distinct, back = np.unique(points, axis=0, return_inverse=True)
    back = back.ravel()
    if len(distinct) <= k:
        return back
    centres = distinct[np.random.default_rng(seed).choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        near = ((distinct[:, None] - centres) ** 2).sum(-1).argmin(1)
        new = np.array([distinct[near == i].mean(0) if (near == i).any() else centres[i] for i in range(k)])
        if np.allclose(new, centres):
            break
        centres = new
    return near[back]


def mixture(df: DataFrame, column: str, k: int = 60, seed: int = 0, merge_to: int | None = None, dims: int = 3) -> DataFrame:
    """Gaussian mixture on the first principal components (J7), its components
    merged by k-means over their means. The components stand in for a non-linear
    embedding of as many dimensions, which has no Spark form."""
    vectors, ratios = reduced(df, column)
    if not len(ratios):
        return vectors.drop("pca").withColumns({c: F.lit(0) for c in ("gmm", "cluster")[: 1 + bool(merge_to)]})
    vectors = store.saved(vectors.withColumn("pca", array_to_vector(F.slice(vector_to_array("pca"), 1, dims))))
    model = GaussianMixture(k=k, seed=seed, featuresCol="pca", predictionCol="gmm").fit(vectors)
    out = model.transform(vectors).drop("pca", "probability")
    if merge_to:
        means = np.array([r["mean"].toArray() for r in model.gaussiansDF.select("mean").collect()])  # k rows
        groups = enumerate(grouped(means, merge_to, seed).tolist())
        merged = df.sparkSession.createDataFrame(list(groups), "gmm int, cluster int")
        out = out.join(F.broadcast(merged), "gmm")
    return out
