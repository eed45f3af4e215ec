"""Queries for aggregation, windows, geometry, images and learning (D, E, H, I, J, K, L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import aggregates, image, joins, learn, polygons, scalar, spatial, windows
from tessera.plans import technologies
from tessera.plans.registry import query

c = F.col
_Q = ", ".join(f"round(quantile_cont({{v}}, 0.{i}), 6) AS p{i}" for i in range(1, 10))
_PROFILE = "round(min({v}), 6) AS min, round(max({v}), 6) AS max, round(stddev_pop({v}), 6) AS sd, round(avg({v}), 6) AS mean, round(quantile_cont({v}, 0.75) - quantile_cont({v}, 0.25), 6) AS iqr, " + _Q


def rounded(df, *keep, digits=6):
    return df.select([c(n) if n in keep else F.round(n, digits).alias(n) for n in df.columns])


@query("d1_intensity_profile", f"SELECT cell_id, stain, comp, {_PROFILE.format(v='v_aec / 255.0')} FROM px GROUP BY 1, 2, 3")
def _(v):
    return rounded(aggregates.profile(v["px"], ["cell_id", "stain", "comp"], "v_aec"), "cell_id", "stain", "comp")


@query("d2_intensity_profile_raw", f"SELECT cell_id, comp, {_PROFILE.format(v='v_hema::DOUBLE')} FROM px GROUP BY 1, 2")
def _(v):
    return rounded(aggregates.profile(v["px"], ["cell_id", "comp"], "v_hema", 1.0), "cell_id", "comp")


@query("d3_kde_peaks")
def _(v):
    return aggregates.kde_peaks(v["px"], ["cell_id"], "v_aec")


_STATS = "round(avg(v_aec / 255.0), 6) AS mean, round(quantile_cont(v_aec, 0.5) / 255.0, 6) AS median, round(min(v_aec / 255.0), 6) AS min, round(max(v_aec / 255.0), 6) AS max, round(stddev_pop(v_aec) / 255.0, 6) AS sd, round(var_pop(v_aec) / 255.0, 6) AS variance"


@query("d4_region_stats", f"SELECT cell_id, comp, {_STATS} FROM px GROUP BY 1, 2 UNION ALL SELECT cell_id, 'cell', {_STATS} FROM px GROUP BY 1")
def _(v):
    return rounded(aggregates.region_stats(v["px"], "v_aec"), "cell_id", "comp")


@query("d5_morphology", """WITH e AS (SELECT s.*, EXISTS (SELECT 1 FROM shape t WHERE t.cell_id = s.cell_id AND t.y = s.y AND t.x = s.x - 1) AND EXISTS (SELECT 1 FROM shape t WHERE t.cell_id = s.cell_id AND t.y = s.y AND t.x = s.x + 1)
  AND EXISTS (SELECT 1 FROM shape t WHERE t.cell_id = s.cell_id AND t.y = s.y - 1 AND t.x = s.x) AND EXISTS (SELECT 1 FROM shape t WHERE t.cell_id = s.cell_id AND t.y = s.y + 1 AND t.x = s.x) AS inner_ FROM shape s),
  m AS (SELECT cell_id, avg(y) AS my, avg(x) AS mx FROM e WHERE NOT inner_ GROUP BY 1),
  a AS (SELECT e.cell_id, count(*) AS n, count(*) FILTER (NOT inner_) AS p, max(sqrt((y - my) ** 2 + (x - mx) ** 2)) FILTER (NOT inner_) AS far, min(sqrt((y - my) ** 2 + (x - mx) ** 2)) FILTER (NOT inner_) AS near FROM e JOIN m USING (cell_id) GROUP BY 1)
  SELECT cell_id, round(n * 0.25::DOUBLE, 6) AS area, round(p * 0.5::DOUBLE, 6) AS perimeter, round(CASE WHEN n = 1 THEN 0.5 ELSE far END, 6) AS major, round(CASE WHEN n = 1 THEN 0.5 ELSE near END, 6) AS minor,
  round(CASE WHEN n = 1 THEN 1 ELSE least(1, 4 * pi() * n / (p * p)) END, 6) AS circularity FROM a""")
def _(v):
    return rounded(aggregates.morphology(v["shape"], 0.5), "cell_id")


@query("d6_nucleated_cells", "SELECT cell_id, round(quantile_cont(p5, 0.5), 6) AS p5 FROM (SELECT cell_id, stain, quantile_cont(v_hema, 0.5) / 255.0 AS p5 FROM px WHERE comp = 'nuc' GROUP BY 1, 2) GROUP BY cell_id HAVING quantile_cont(p5, 0.5) > 0.30")
def _(v):
    return rounded(aggregates.keep_nucleated(v["px"].where("comp = 'nuc'")), "cell_id")


@query("d7_tissue_percent", "SELECT CAST(gy AS INT) AS gy, CAST(gx AS INT) AS gx, round(least(100, (SELECT count(*) FROM mask WHERE floor(ty / 25.0) = gy AND floor(tx / 25.0) = gx) / 625.0 * 100), 6) AS tissue_pct FROM range(0, 6) a(gy), range(0, 6) b(gx)")
def _(v):
    grid = v.spark.range(36).select(F.floor(c("id") / 6).cast("int").alias("gy"), (c("id") % 6).cast("int").alias("gx"))
    return rounded(aggregates.tissue_share(grid, v["mask"], 1000, 0.025), "gy", "gx")


@query("d8_tissue_area", "SELECT tile_index, round(tissue_area_um2, 3) AS area FROM tilestats")
def _(v):
    return v["tilestats"].select("tile_index", F.round(aggregates.tissue_area(c("tissue_pct"), 0.5031), 3).alias("area"))


_TIERS = "SELECT {by}m1_tier, count(*) AS n_cells, quantile_cont(y, 0.5) AS y_median, quantile_cont(x, 0.5) AS x_median FROM cellinfo GROUP BY {by}m1_tier"


@query("d9_cluster_medians", _TIERS.format(by=""))
def _(v):
    return aggregates.tier_medians(v["cellinfo"], "m1_tier", ["y", "x"])


@query("d10_ranked_tiers", "SELECT m1_tier, CAST(row_number() OVER (ORDER BY m DESC, m1_tier) AS INT) AS rank FROM (SELECT m1_tier, quantile_cont(x, 0.5) AS m FROM cellinfo GROUP BY 1)")
def _(v):
    medians = aggregates.tier_medians(v["cellinfo"], "m1_tier", ["x"])
    return joins.rank_within(medians, [], [F.desc("x_median"), c("m1_tier")]).select("m1_tier", "rank")


@query("d11_group_mean_sd", "SELECT label, round(avg(embedding[1]), 6) AS v_mean, round(stddev_samp(embedding[1]), 6) AS v_std FROM feat GROUP BY label")
def _(v):
    return rounded(aggregates.mean_and_sd(v["feat"].select("label", c("embedding")[0].cast("double").alias("v")), "label", ["v"]), "label")


@query("d12_positive_density", "SELECT tile_index, CAST(coalesce(n, 0) AS BIGINT) AS n_pos, round(coalesce(n, 0) / tissue_area_um2, 12) AS density FROM tilestats LEFT JOIN (SELECT tile_index, sum(m1_expression::INT) AS n FROM cellinfo GROUP BY 1) USING (tile_index)")
def _(v):
    found = aggregates.positive_density(v["cellinfo"], v["tilestats"], "m1_expression")
    return found.select("tile_index", "n_pos", F.round("density", 12).alias("density"))


@query("d13_population_metrics", """WITH t AS (SELECT tile_index, tissue_area_um2 AS a, n, k FROM tilestats LEFT JOIN (SELECT tile_index, sum((m1_expression AND NOT m2_expression)::INT) AS n, count(*) AS k FROM cellinfo GROUP BY 1) USING (tile_index))
  SELECT tile_index, CAST(coalesce(n, 0) AS BIGINT) AS n, round(100.0 * n / k, 6) AS percent, round(n / (a * 1e-6), 6) AS per_mm2 FROM t
  UNION ALL SELECT NULL, CAST(coalesce(sum(n), 0) AS BIGINT), round(100.0 * sum(n) / sum(k), 6), round(sum(n) / (sum(a) * 1e-6), 6) FROM t""")
def _(v):
    found = aggregates.population_metrics(v["cellinfo"], v["tilestats"], c("m1_expression") & ~c("m2_expression"))
    return rounded(found, "tile_index", "n")


@query("d14_value_counts", "SELECT tile_index, m1_tier, count(*) AS count FROM cellinfo GROUP BY 1, 2")
def _(v):
    return v["cellinfo"].groupBy("tile_index", "m1_tier").count()


@query("d15_tier_share", "SELECT m2_tier, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM cellinfo GROUP BY 1")
def _(v):
    return rounded(aggregates.shares(v["cellinfo"], "m2_tier"), "m2_tier", "n")


@query("d16_joined_annotations", "SELECT cell_id, coalesce(string_agg(name, ',' ORDER BY ann_id), 'Undefined') AS name FROM cells LEFT JOIN ann ON y > y_min AND y < y_max AND x > x_min AND x < x_max GROUP BY cell_id")
def _(v):
    return aggregates.joined_labels(joins.in_boxes(v["cells"], v["ann"], how="left"), "cell_id", "ann_id", "name")


@query("d17_annotation_area", "SELECT name, sum((x_max - x_min) * (y_max - y_min))::DOUBLE AS pixel_area FROM ann GROUP BY name")
def _(v):
    ring = spatial.box_ring(c("y_min"), c("x_min"), c("y_max"), c("x_max"))
    return v["ann"].withColumn("a", aggregates.ring_area(ring)).groupBy("name").agg(F.sum("a").alias("pixel_area"))


@query("d17_union_area", """WITH xs AS (SELECT DISTINCT x_min AS x FROM ann UNION SELECT x_max FROM ann), s AS (SELECT x, lead(x) OVER (ORDER BY x) AS x2 FROM xs),
  ys AS (SELECT DISTINCT y_min AS y FROM ann UNION SELECT y_max FROM ann), t AS (SELECT y, lead(y) OVER (ORDER BY y) AS y2 FROM ys)
  SELECT sum((x2 - x) * (y2 - y))::DOUBLE AS area FROM s, t WHERE x2 IS NOT NULL AND y2 IS NOT NULL AND EXISTS (SELECT 1 FROM ann WHERE x_min <= x AND x_max >= x2 AND y_min <= y AND y_max >= y2)""")
def _(v):
    return aggregates.union_area(v["ann"])


@query("d18_distinct_tiers", "SELECT DISTINCT tile_index, m1_tier FROM cellinfo")
def _(v):
    return v["cellinfo"].select("tile_index", "m1_tier").distinct()


@query("d19_overlap_pairs", "SELECT a.ann_id AS a_id, b.ann_id AS b_id FROM ann a JOIN ann b ON a.ann_id < b.ann_id AND a.x_min < b.x_max AND b.x_min < a.x_max AND a.y_min < b.y_max AND b.y_min < a.y_max")
def _(v):
    return joins.overlaps(v["ann"]).select("a_id", "b_id")


@query("d20_mask_bounds", "SELECT greatest(min(ty) - 5, 0) AS y_min, least(max(ty) + 5, 130) AS y_max, greatest(min(tx) - 5, 0) AS x_min, least(max(tx) + 5, 140) AS x_max FROM mask")
def _(v):
    return aggregates.bounds(v["mask"], 5, 130, 140)


@query("d21_percentile_normalise", "SELECT i.y, i.x, round(greatest(0, least(1, coalesce((v - lo) / nullif(hi - lo, 0), 0))), 6) AS norm FROM img i JOIN (SELECT y, quantile_cont(v, 0.1) AS lo, quantile_cont(v, 0.9) AS hi FROM img GROUP BY y) q USING (y)")
def _(v):
    return rounded(aggregates.normalised(v["img"], "v", 0.1, 0.9, ("y",)).select("y", "x", "norm"), "y", "x")


@query("d21_global_normalise", "SELECT y, x, round(greatest(0, least(1, coalesce((v - least(lo, 100)) / nullif(greatest(hi, 200) - least(lo, 100), 0), 0))), 6) AS norm FROM img, (SELECT quantile_cont(v, 0.4) AS lo, quantile_cont(v, 0.6) AS hi FROM img)")
def _(v):
    """Over all pixels, the lower limit 100 at most and the upper one 200 at least."""
    return rounded(aggregates.normalised(v["img"], "v", 0.4, 0.6, caps=(100, 200)).select("y", "x", "norm"), "y", "x")


@query("d22_canvas_extent", "SELECT max(y0) + 1000 AS height, max(x0) + 1000 AS width FROM tilestats")
def _(v):
    return spatial.canvas(v["tilestats"])


@query("d23_project_medians", "SELECT CASE WHEN cell_id % 2 = 0 THEN 'a' ELSE 'b' END AS sample, m1_tier, count(*) AS n_cells, quantile_cont(y, 0.5) AS y_median FROM cellinfo GROUP BY 1, 2")
def _(v):
    df = v["cellinfo"].withColumn("sample", F.when(c("cell_id") % 2 == 0, "a").otherwise("b"))
    return aggregates.tier_medians(df, "m1_tier", ["y"], ("sample",))


@query("d24_choose_k")
def _(v):
    k, rows = learn.choose_k(v["feat"], "embedding")
    return v.spark.createDataFrame([(a, b, s, a == k) for a, b, s in rows], "k int, inertia double, silhouette double, chosen boolean")


@query("e1_dense_ids", "SELECT cell_id, CAST(row_number() OVER (PARTITION BY tile_index ORDER BY y, x) - 1 AS INT) AS cell_index FROM cells")
def _(v):
    return windows.dense_ids(v["cells"], ["y", "x"], ("tile_index",)).select("cell_id", "cell_index")


@query("e1_dense_ids_overall", "SELECT cell_id, row_number() OVER (ORDER BY y, x, cell_id) - 1 AS cell_index FROM cells")
def _(v):
    return windows.dense_ids(v["cells"], ["y", "x", "cell_id"]).select("cell_id", "cell_index")


@query("e2_tile_enumeration", "SELECT CAST(gy AS INT) AS gy, CAST(gx AS INT) AS gx, tissue_pct FROM range(0, 5) a(gy), range(0, 4) b(gx) LEFT JOIN tilestats ON y0 = gy * 1000 AND x0 = gx * 1000")
def _(v):
    known = v["tilestats"].select((c("y0") / 1000).cast("int").alias("gy"), (c("x0") / 1000).cast("int").alias("gx"), "tissue_pct")
    return windows.tile_grid(5, 4, known)


@query("e3_rank_clusters", "SELECT m1_tier, CAST(row_number() OVER (ORDER BY quantile_cont(y, 0.5) DESC, m1_tier) AS INT) AS rank FROM cellinfo GROUP BY m1_tier")
def _(v):
    return joins.rank_within(aggregates.tier_medians(v["cellinfo"], "m1_tier", ["y"]), [], [F.desc("y_median"), c("m1_tier")]).select("m1_tier", "rank")


@query("e4_top_tiles", "SELECT m1_tier, tile_index, n, CAST(r AS INT) AS rank FROM (SELECT m1_tier, tile_index, count(*) AS n, row_number() OVER (PARTITION BY m1_tier ORDER BY count(*) DESC, tile_index) AS r FROM cellinfo GROUP BY 1, 2) WHERE r <= 5")
def _(v):
    counts = v["cellinfo"].groupBy("m1_tier", "tile_index").agg(F.count("*").alias("n"))
    return joins.rank_within(counts, ["m1_tier"], [F.desc("n"), c("tile_index")], 5)


@query("e5_first_per_tier", "SELECT m1_tier, arg_min(m2_expression, cell_id) AS m2_expression FROM cellinfo GROUP BY m1_tier")
def _(v):
    return windows.first_per(v["cellinfo"], "m1_tier", "m2_expression", "cell_id")


@query("e6_sorted_cells", "SELECT tile_index, cell_id FROM cells ORDER BY tile_index, cell_id")
def _(v):
    return windows.ordered(v["cells"].select("tile_index", "cell_id"), "tile_index", "cell_id")


@query("e7_standardise", "SELECT cell_id, round((y - avg(y) OVER ()) / stddev_pop(y) OVER (), 6) AS y, round((x - avg(x) OVER ()) / stddev_pop(x) OVER (), 6) AS x FROM cells")
def _(v):
    return rounded(windows.standardised(v["cells"].select("cell_id", "y", "x"), ["y", "x"]), "cell_id")


@query("e8_normalised_origins", "SELECT tile_index, y0 - min(y0) OVER () AS y0, x0 - min(x0) OVER () AS x0 FROM tilestats WHERE tile_index > 4")
def _(v):
    return windows.from_least(v["tilestats"].where("tile_index > 4").select("tile_index", "y0", "x0"), ["y0", "x0"])


@query("e9_greedy_consensus")
def _(v):
    return windows.consensus(v["det"], tile=1000, n_stains=3)


@query("e10_shuffled_chunks")
def _(v):
    n = v["cells"].count()
    return v["cells"].select("cell_id", windows.chunk_of(c("cell_id"), n, 500).alias("chunk")).groupBy("chunk").count()


@query("e11_series_peaks", "SELECT y, x, coalesce(v > lag(v) OVER w AND v > lead(v) OVER w, false) AS is_peak FROM img WINDOW w AS (PARTITION BY y ORDER BY x)")
def _(v):
    return windows.sign_changes(v["img"], "v", "x", ("y",)).select("y", "x", "is_peak")


@query("f7_polygon_difference_union", """SELECT (SELECT sum((x_max - x_min) * (y_max - y_min)) FROM ann WHERE ann_id = 4)::DOUBLE - (SELECT sum((x_max - x_min) * (y_max - y_min)) FROM ann_nested WHERE ann_id = 104)::DOUBLE AS difference""")
def _(v):
    nested = v["ann_nested"].where("ann_id in (4, 104)")
    whole = aggregates.union_area(nested.where("ann_id = 4")).select(c("area").alias("w"))
    inner = aggregates.union_area(nested.where("ann_id = 104")).select(c("area").alias("i"))
    return whole.join(inner).select((c("w") - c("i")).alias("difference"))


@query("f7_difference_all")
def _(v):
    """Every annotation less the union of all annotations inside it."""
    boxes = v["ann_nested"]
    held = joins.containment(boxes).join(boxes, c("inner_id") == c("ann_id")).select("outer_id", "x_min", "x_max", "y_min", "y_max")
    inner = aggregates.union_area(held, ("outer_id",)).withColumnRenamed("area", "inner_area")
    whole = aggregates.union_area(boxes.select("ann_id", "x_min", "x_max", "y_min", "y_max"), ("ann_id",))
    return whole.join(inner, c("ann_id") == c("outer_id"), "left").select("ann_id", (c("area") - F.coalesce("inner_area", F.lit(0.0))).alias("difference"))


@query("h1_convex_hull", """WITH d AS (SELECT DISTINCT cell_id, y, x FROM shape), e AS (SELECT p.cell_id, p.x AS px, p.y AS py, q.x AS qx, q.y AS qy FROM d p JOIN d q ON p.cell_id = q.cell_id AND (p.x, p.y) <> (q.x, q.y)
  WHERE NOT EXISTS (SELECT 1 FROM d r WHERE r.cell_id = p.cell_id AND ((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) < 0
    OR ((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) = 0 AND (r.x - p.x) * (q.x - p.x) + (r.y - p.y) * (q.y - p.y) NOT BETWEEN 0 AND (q.x - p.x) ** 2 + (q.y - p.y) ** 2))))
  SELECT cell_id, CAST(count(*) + 1 AS INT) AS points, round(sum(px * qy - qx * py) / 2.0::DOUBLE, 6) AS area FROM e GROUP BY cell_id HAVING count(*) >= 3""")
def _(v):
    """Hulls with an area: its corners (the first one twice) and size."""
    rings = spatial.hulls(v["shape"]).where(F.size("ring") > 3)
    return rings.select("cell_id", F.size("ring").alias("points"), F.round(aggregates.ring_area(c("ring")), 6).alias("area"))


def _rings(v):
    return v["ann"].select(c("ann_id").alias("cell_id"), spatial.box_ring(c("y_min") / 20.0, c("x_min") / 20.0, c("y_max") / 20.0, c("x_max") / 20.0).alias("ring"))


@query("h2_rasterise", "SELECT ann_id AS cell_id, sum((ceil(x_max / 20.0) - floor(x_min / 20.0) - 1) * (ceil(y_max / 20.0) - floor(y_min / 20.0) - 1))::BIGINT AS pixels FROM ann GROUP BY ann_id")
def _(v):
    return spatial.rasterised(_rings(v)).groupBy("cell_id").agg(F.count("*").alias("pixels"))


@query("h3_radial_expansion", """SELECT ann_id, round_even(y_min / 20.0::DOUBLE + dy * 6 / sqrt(dy * dy + dx * dx), 0) AS y, round_even(x_min / 20.0::DOUBLE + dx * 6 / sqrt(dy * dy + dx * dx), 0) AS x FROM (SELECT *, y_min / 20.0::DOUBLE - (y_min * 3 + y_max * 2) / 100.0::DOUBLE AS dy, x_min / 20.0::DOUBLE - (x_min * 3 + x_max * 2) / 100.0::DOUBLE AS dx FROM ann)""")
def _(v):
    grown = _rings(v).select(c("cell_id").alias("ann_id"), F.element_at(spatial.expanded(c("ring"), 6.0, 10.0), 1).alias("p"))
    return grown.select("ann_id", "p.y", "p.x")


@query("h4_cytoplasm", """WITH n AS (SELECT cell_id, y, x FROM shape WHERE y < 4 AND x < 3 AND cell_id < 40), nuc AS (SELECT cell_id, y, x + cell_id % 5 * 9 AS x FROM n WHERE cell_id < 6),
  g AS (SELECT DISTINCT cell_id, y + dy AS y, x + dx AS x FROM nuc, (SELECT a AS dy, b AS dx FROM range(-2, 3) t(a), range(-2, 3) u(b))),
  i AS (SELECT * FROM g WHERE y >= 0 AND y < 50 AND x >= 0 AND x < 60),
  o AS (SELECT i.cell_id, i.y, i.x, arg_min(nuc.cell_id, ((i.y - nuc.y) ** 2 + (i.x - nuc.x) ** 2, nuc.cell_id)) AS own FROM i, nuc GROUP BY 1, 2, 3),
  f AS (SELECT cell_id, y, x FROM o WHERE own = cell_id AND (y, x) NOT IN (SELECT y, x FROM nuc))
  SELECT CAST(cell_id AS BIGINT) AS cell_id, count(*) AS n, CAST(sum(y * 100 + x) AS BIGINT) AS s FROM (SELECT * FROM f UNION ALL SELECT * FROM nuc WHERE cell_id NOT IN (SELECT cell_id FROM f)) GROUP BY 1""")
def _(v):
    nuclei = v["shape"].where("y < 4 and x < 3 and cell_id < 6").select("cell_id", "y", (c("x") + c("cell_id") % 5 * 9).alias("x"))
    step = F.explode(F.sequence(F.lit(-2), F.lit(2)))
    grown = nuclei.withColumn("dy", step).withColumn("dx", step).select("cell_id", (c("y") + c("dy")).alias("y"), (c("x") + c("dx")).alias("x"))
    return spatial.cytoplasm(grown, nuclei, 50, 60).groupBy("cell_id").agg(F.count("*").alias("n"), F.sum(c("y") * 100 + c("x")).cast("long").alias("s"))


#: Cells in a row of the drawn slide, and the pixels from one cell to the next: grown shapes (up to 7 by 6) overlap.
_ACROSS, _DOWN, _RIGHT = 1000, 9, 8


@query("h4_cytoplasm_all")
def cytoplasm_all(v):
    """The cytoplasm of every cell of ``shape``, laid out on a grid."""
    row, col = F.floor(c("cell_id") / _ACROSS), c("cell_id") % _ACROSS
    nuclei = v["shape"].select("cell_id", (row * _DOWN + c("y")).cast("int").alias("y"), (col * _RIGHT + c("x")).cast("int").alias("x"))
    height = (nuclei.agg(F.max("y")).first()[0] or 0) + 3
    step = F.explode(F.sequence(F.lit(-2), F.lit(2)))
    grown = nuclei.withColumn("dy", step).withColumn("dx", step).select("cell_id", (c("y") + c("dy")).alias("y"), (c("x") + c("dx")).alias("x"))
    cyto = spatial.cytoplasm(grown, nuclei, height, _ACROSS * _RIGHT, 3.0)
    return cyto.groupBy("cell_id").agg(F.count("*").alias("n"), F.sum(c("y").cast("long") * 100 + c("x")).alias("s"))


@query("h5_ring_area", "SELECT ann_id AS cell_id, (x_max - x_min) * (y_max - y_min) / 400.0 AS area FROM ann")
def _(v):
    return _rings(v).select("cell_id", F.round(aggregates.ring_area(c("ring")), 6).alias("area"))


@query("h6_point_in_ring", "SELECT cell_id, ann_id FROM cells JOIN ann ON (x - x_min) * (y_max - y_min) > (y - y_min) * (x_max - x_min) AND y > y_min AND x < x_max")
def _(v):
    point = lambda y, x: F.struct(c(y).cast("double").alias("y"), c(x).cast("double").alias("x"))
    corners = F.array(point("y_min", "x_min"), point("y_min", "x_max"), point("y_max", "x_max"), point("y_min", "x_min"))
    return joins.in_polygons(v["cells"], v["ann"].select("ann_id", corners.alias("ring"))).select("cell_id", "ann_id")


@query("h7_ring_validity", "SELECT ann_id AS cell_id, ann_id % 2 = 0 AS is_valid FROM ann")
def _(v):
    half = _rings(v).withColumn("ring", F.when(c("cell_id") % 2 == 0, c("ring")).otherwise(F.slice("ring", 1, 3)))
    return polygons.valid_rings(half).select("cell_id", "is_valid")


@query("h8_tma_cores", "SELECT name || '-' || ann_id AS name FROM ann WHERE ann_id % 4 <> 0")
def _(v):
    features = v["ann"].select(F.concat_ws("-", "name", c("ann_id").cast("string")).alias("name"), (c("ann_id") % 4 == 0).alias("is_missing"), F.array().alias("ring"))
    return spatial.tma_cores(features).select("name")


@query("h9_waxman_graph", """WITH p AS (SELECT cell_id, y, x FROM cells WHERE tile_index = 11), l AS (SELECT max(sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2)) AS l FROM p a, p b)
  SELECT a.cell_id AS src, b.cell_id AS dst, round(exp(-sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2) / (0.8 * l)), 6) AS p FROM p a JOIN p b ON a.cell_id < b.cell_id, l WHERE exp(-sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2) / (0.8 * l)) > 0.9""")
def _(v):
    points = v["cells"].where("tile_index = 11").select("cell_id", c("y").cast("double").alias("cy"), c("x").cast("double").alias("cx"))
    # The default beta of 0.1 leaves no edge between these sparse points.
    return spatial.waxman_edges(points, key="cell_id", beta=0.8).select("src", "dst", F.round("p", 6).alias("p"))


@query("h10_coexpression", "SELECT cell_id, c.y + y0 AS abs_y, c.x + x0 AS abs_x FROM cellinfo c JOIN tilestats USING (tile_index) WHERE m1_expression AND m2_expression")
def _(v):
    both = v["cellinfo"].where(scalar.all_true(c("m1_expression"), c("m2_expression")))
    return scalar.shift_by_tile(both, v["tilestats"]).select("cell_id", "abs_y", "abs_x")


@query("h12_stitch", "SELECT y, x, arg_max(v, o) AS v FROM (SELECT y + 3 * CAST(o AS INT) AS y, x + 5 * CAST(o AS INT) AS x, v, o FROM img, range(0, 3) t(o)) GROUP BY 1, 2")
def _(v):
    pasted = v["img"].withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(2)))).select((c("y") + 3 * c("o")).alias("y"), (c("x") + 5 * c("o")).alias("x"), "v", "o")
    return spatial.stitched(pasted, "o")


@query("h13_core_rectangles", "SELECT ann_id, CAST(greatest(round_even(y_min * 1.6::DOUBLE, 0) - 300, 0) AS BIGINT) AS out_y, CAST(greatest(round_even(x_min * 1.6::DOUBLE, 0) - 40, 0) AS BIGINT) AS out_x FROM ann")
def _(v):
    rects = v["ann"].select("ann_id", c("y_min").alias("y"), c("x_min").alias("x"))
    return spatial.core_rect(rects, 1.6, F.lit(300), F.lit(40)).select("ann_id", "out_y", "out_x")


_DISK = "SELECT DISTINCT CAST(n_nationkey * 5 + a AS INT) AS ty, CAST(n_nationkey * 4 + b AS INT) AS tx FROM nation, range(-3, 4) t(a), range(-3, 4) u(b) WHERE a * a + b * b <= 9"


@query("h14_brush_add", f"SELECT ty, tx FROM mask UNION {_DISK}")
def _(v):
    return spatial.brushed(v["mask"], _strokes(v), 3)


@query("h14_brush_erase", f"SELECT ty, tx FROM mask EXCEPT {_DISK}")
def _(v):
    return spatial.brushed(v["mask"], _strokes(v), 3, erase=True)


def _strokes(v):
    return v["nation"].select((c("n_nationkey") * 5).cast("int").alias("ty"), (c("n_nationkey") * 4).cast("int").alias("tx"))


@query("i1_tissue_mask")
def _(v):
    slides = v["img"].select(F.explode(F.sequence(F.lit(0), F.lit(1))).alias("slide"), "y", "x", "v")
    return image.tissue_masks(slides.withColumn("v", c("v") - 20 * c("slide")), "slide", 41, 53, sigma=1.0, least_size=3)


@query("i2_erosion", "SELECT ty, tx FROM mask m WHERE (SELECT count(*) FROM mask k WHERE k.ty BETWEEN m.ty - 1 AND m.ty + 1 AND k.tx BETWEEN m.tx - 1 AND m.tx + 1) = (least(ty + 1, 126) - greatest(ty - 1, 0) + 1) * (least(tx + 1, 130) - greatest(tx - 1, 0) + 1)")
def _(v):
    return image.eroded(v["mask"], 1, 127, 131)


@query("i3_contrast_stretch", "SELECT y, x, round(greatest(0, least(1, coalesce((v - lo) / nullif(hi - lo, 0), 0))), 6) AS v FROM img, (SELECT quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM img)")
def _(v):
    return rounded(image.stretched(v["img"]).select("y", "x", "v"), "y", "x")


@query("i3_histogram_equalise", "SELECT y, x, round(cume_dist() OVER (ORDER BY v), 6) AS share FROM img")
def _(v):
    return rounded(image.equalised(v["img"]).select("y", "x", "share"), "y", "x")


@query("i3_local_equalise")
def _(v):
    return image.per_tile(v["img"], 20, image.local_equalised).groupBy("ty", "tx").agg(F.round(F.avg("v"), 6).alias("mean"))


@query("i3_clahe")
def _(v):
    return image.per_tile(v["img"], 40, image.clahe).groupBy("ty", "tx").agg(F.round(F.avg("v"), 6).alias("mean"))


@query("i4_sharpen", """SELECT a.y, a.x, CAST(greatest(0, least(255, 5 * a.v - coalesce(b.v, a.v) - coalesce(c.v, a.v) - coalesce(d.v, a.v) - coalesce(e.v, a.v))) AS INT) AS v FROM img a LEFT JOIN img b ON b.y = a.y AND b.x = a.x - 1
  LEFT JOIN img c ON c.y = a.y AND c.x = a.x + 1 LEFT JOIN img d ON d.y = a.y - 1 AND d.x = a.x LEFT JOIN img e ON e.y = a.y + 1 AND e.x = a.x""")
def _(v):
    return image.sharpened(v["img"])


@query("i6_autofluorescence", "SELECT y, x, CAST(floor(CASE WHEN v = 0 THEN 0 ELSE coalesce(greatest(v - af / nullif(ta, 0) * tv, 0), v) END) AS INT) AS v FROM img, (SELECT max(v)::DOUBLE AS tv, max(af)::DOUBLE AS ta FROM img)")
def _(v):
    return image.less_autofluorescence(v["img"], ["af"]).select("y", "x", "v")


@query("i7_stain_matrix")
def _(v):
    rgb = v["img"].select("y", "x", c("v").alias("r"), ((c("v") * 7) % 200).alias("g"), ((c("v") * 4 + 50) % 240).alias("b"))
    found = image.stain_matrices(rgb, 20)
    return found.select("ty", "tx", "stain", *[F.round(n, 6).alias(n) for n in "rgb"])


@query("i8_colour_deconvolution", "SELECT y, x, round(-ln((v + 1) / 243.0) * 0.5, 6) AS hema, round(-ln((af + 1) / 243.0) * 0.25, 6) AS aec, round(-ln((v % 7 + 1) / 243.0), 6) AS residual FROM img")
def _(v):
    rgb = v["img"].select("y", "x", c("v").alias("r"), c("af").alias("g"), (c("v") % 7).alias("b"))
    return rounded(image.deconvolved(rgb, [[2, 0, 0], [0, 4, 0], [0, 0, 1]]).drop("r", "g", "b"), "y", "x")


_MOVES = [(0, 0, 0), (1, 3, -2), (2, -5, 4)]


@query("i9_registration", "SELECT pair::INT AS pair, dy::INT AS dy, dx::INT AS dx FROM (VALUES (0, 0, 0), (1, 3, -2), (2, -5, 4)) t(pair, dy, dx)")
def _(v):
    moves = v.spark.createDataFrame(_MOVES, "pair int, sy int, sx int")
    still = v["img"].select("y", "x", "v").join(F.broadcast(moves))  # three rows
    moving = still.select("pair", F.lit(1).alias("side"), (c("y") - c("sy")).alias("y"), (c("x") - c("sx")).alias("x"), "v").where("y between 0 and 40 and x between 0 and 52")
    return image.registrations(still.select("pair", F.lit(0).alias("side"), "y", "x", "v").union(moving), "pair", 41, 53)


@query("i11_registered_channels", "SELECT pair::INT AS pair, y + dy::INT AS y, x + dx::INT AS x, v FROM img, (VALUES (0, 0, 0), (1, 3, -2), (2, -5, 4)) t(pair, dy, dx) WHERE y + dy BETWEEN 0 AND 40 AND x + dx BETWEEN 0 AND 52")
def _(v):
    shifts = v.spark.createDataFrame(_MOVES, "pair int, dy int, dx int")
    channels = v["img"].select(F.explode(F.array(*[F.lit(m[0]) for m in _MOVES])).alias("pair"), "y", "x", "v")
    return image.registered(channels, shifts, "pair", 41, 53).select("pair", "y", "x", "v")


@query("i12_inpaint")
def _(v):
    filled = image.per_tile(v["img"], 20, lambda tile: image.inpainted(tile, 230))
    return filled.groupBy("ty", "tx").agg(F.round(F.max("v"), 6).alias("top"))


@query("i13_tile_extraction", "SELECT CAST(y // 20 AS INT) AS ty, CAST(x // 20 AS INT) AS tx, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM img GROUP BY 1, 2")
def _(v):
    return v["img"].groupBy(F.floor(c("y") / 20).cast("int").alias("ty"), F.floor(c("x") / 20).cast("int").alias("tx")).agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("i14_segmentation")
def _(v):
    return image.segmented(v["img"].select("y", "x", "v"), 20).groupBy("ty", "tx", "det_id").count()


@query("i16_tiling_map", """SELECT CAST(gy AS INT) AS gy, CAST(gx AS INT) AS gx, round(p, 6) AS tissue_pct, CAST(row_number() OVER (ORDER BY gy, gx) - 1 AS INT) AS tile_index FROM (SELECT gy, gx, least(100, count(ty) / 1600.0 * 100) AS p FROM range(0, 4) a(gy) CROSS JOIN range(0, 4) b(gx)
  LEFT JOIN mask ON ty // 40 = gy AND tx // 40 = gx GROUP BY 1, 2) WHERE p > 15""")
def _(v):
    tiles = image.tiling_grid(v["mask"], tile=40, zoom=1.0, threshold=15, size=(127, 131))
    return rounded(tiles.select("gy", "gx", "tissue_pct", "tile_index"), "gy", "gx", "tile_index")


@query("i18_multichannel", "SELECT y, x, v || ',' || af AS planes FROM img")
def _(v):
    return image.planes(v["img"], ["v", "af"]).withColumn("planes", F.array_join("planes", ","))


@query("j1_pca_components")
def _(v):
    _, ratios = learn.reduced(v["feat"], "embedding")
    k = learn.components_for(ratios, 0.90)
    return v.spark.createDataFrame([(i, float(r), i < k) for i, r in enumerate(ratios)], "component int, ratio double, kept boolean")


@query("j2_kmeans_tiers")
def _(v):
    df = v["feat"].withColumn("p5", c("embedding")[0])
    return learn.tiers(df, "embedding", rank_by="p5").groupBy("tier").agg(F.count("*").alias("n"), F.median("p5").alias("p5"))


@query("j3_kmeans_per_core")
def _(v):
    cores = v["feat"].withColumn("core", (c("vec_id") % 2).cast("int"))
    return learn.tiers_per_core(cores, "embedding", "core", k=3).groupBy("core", "tier").count()


@query("j4_project_clustering")
def _(v):
    from tessera.operators import reshape

    pooled = reshape.tagged({"a": v["feat"].where("vec_id % 2 = 0"), "b": v["feat"].where("vec_id % 2 = 1")})
    return learn.tiers(pooled, "embedding").groupBy("sample_name", "tier").count()


@query("j5_recluster")
def _(v):
    first = v["feat"].withColumn("tier", c("label"))
    return learn.reclustered(first, "embedding", 0, k=3).groupBy("tier", "sub").count()


@query("j6_regroup", "SELECT m1_tier AS tier, CASE WHEN m1_tier <> 3 THEN m2_tier END AS sub, count(*) AS n_cells, quantile_cont(y, 0.5) AS y_median FROM cellinfo GROUP BY 1, 2")
def _(v):
    df = v["cellinfo"].select(c("m1_tier").alias("tier"), c("m2_tier").alias("sub"), "y")
    return aggregates.tier_medians(learn.regrouped(df, 3), "sub", ["y"], ("tier",))


@query("j7_gaussian_mixture")
def _(v):
    return learn.mixture(v["feat"], "embedding", merge_to=3).groupBy("cluster").count()


@query("j8_positive_calling", "SELECT cell_id, CASE WHEN tile_index % 2 = 0 THEN m1_tier IN (0, 2) ELSE m1_expression END AS m1_expression FROM cellinfo")
def _(v):
    df = v["cellinfo"].withColumn("core", F.when(c("tile_index") % 2 == 0, "x").otherwise("y"))
    return learn.called(df, "m1_tier", [0, 2], "m1_expression", ("core", "x")).select("cell_id", "m1_expression")


@query("j9_cell_edits", "SELECT cell_id, CASE WHEN cell_id % 10 = 0 THEN false ELSE m2_expression END AS m2_expression FROM cellinfo")
def _(v):
    picked = v["cellinfo"].where("cell_id % 10 = 0").select("cell_id")
    log = picked.select("cell_id", F.lit(True).alias("m2_expression"), F.lit(1).alias("at")).union(picked.select("cell_id", F.lit(False), F.lit(2)))
    return joins.update(v["cellinfo"].select("cell_id", "m2_expression"), log, "cell_id", "m2_expression", "at")


@query("l1_technology_run", "SELECT cell_id, stain, comp, round(avg(v_aec / 255.0), 6) AS mean FROM px WHERE cell_id IN (SELECT cell_id FROM (SELECT cell_id, stain, quantile_cont(v_hema, 0.5) / 255.0 AS p5 FROM px WHERE comp = 'nuc' GROUP BY 1, 2) GROUP BY cell_id HAVING quantile_cont(p5, 0.5) > 0.30) GROUP BY 1, 2, 3")
def _(v):
    settings = technologies.Settings(sample="s", markers=("m1", "m2"), technology="micsss")
    return rounded(technologies.run(settings, v["px"]).select("cell_id", "stain", "comp", "mean"), "cell_id", "stain", "comp")


FLAGSHIP = """WITH p AS (SELECT cell_id, stain, quantile_cont(v_hema, 0.5) / 255.0 AS p5 FROM px WHERE comp = 'nuc' GROUP BY 1, 2), k AS (SELECT cell_id FROM p GROUP BY cell_id HAVING quantile_cont(p5, 0.5) > 0.30)
  SELECT tile_index, count(*) AS n_cells, round(count(*) / any_value(tissue_area_um2), 9) AS density FROM k JOIN cells USING (cell_id) JOIN tilestats USING (tile_index) GROUP BY tile_index"""


@query("flagship_tile_density", FLAGSHIP)
def flagship(v):
    """Per-cell profile, red blood cells dropped, cells per tile and area."""
    kept = aggregates.keep_nucleated(v["px"].where("comp = 'nuc'")).select("cell_id")
    counts = kept.join(v["cells"].select("cell_id", "tile_index"), "cell_id").groupBy("tile_index").agg(F.count("*").alias("n_cells"))
    return counts.join(v["tilestats"], "tile_index").select("tile_index", "n_cells", F.round(c("n_cells") / c("tissue_area_um2"), 9).alias("density"))
