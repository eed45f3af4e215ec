"""Queries for scans, expressions, joins, sets and reshaping (A, B, C, F, G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import aggregates, image, joins, reshape, scalar, windows
from tessera.plans.registry import query
from tessera.sources import tables

c = F.col


def r6(x):
    return F.round(x, 6)


@query("a1_region_scan", "SELECT g.y, g.x, CAST(coalesce(i.v, 0) AS INT) AS v FROM (SELECT CAST(a AS INT) - 3 AS y, CAST(b AS INT) + 20 AS x FROM range(0, 50) t(a), range(0, 40) u(b)) g LEFT JOIN img i ON i.y = g.y AND i.x = g.x")
def _(v):
    return image.region(v["img"].select("y", "x", "v"), -3, 20, 50, 40)


@query("a2_thumbnail", "SELECT CAST(floor(y * 0.25) AS INT) AS ty, CAST(floor(x * 0.25) AS INT) AS tx, round(avg(v), 6) AS v FROM img GROUP BY 1, 2")
def _(v):
    return image.thumbnail(v["img"], 0.25).withColumn("v", r6("v"))


_XML = "'<Image PhysicalSizeX=\"' || CAST(s_suppkey % 7 + 1 AS VARCHAR) || '.5\" PhysicalSizeXUnit=\"' || CASE s_suppkey % 3 WHEN 0 THEN 'µm' WHEN 1 THEN 'mm' ELSE 'pt' END || '\"/>'"


@query("a4_ome_metadata", f"""SELECT s_suppkey, round(CASE regexp_extract(xml, 'SizeXUnit="([^"]+)"', 1) WHEN 'µm' THEN 25400 / CAST(regexp_extract(xml, 'SizeX="([^"]+)"', 1) AS DOUBLE)
  WHEN 'mm' THEN 25.4 / CAST(regexp_extract(xml, 'SizeX="([^"]+)"', 1) AS DOUBLE) END, 6) AS dpi, 1024 AS tile FROM (SELECT s_suppkey, {_XML} AS xml FROM supplier)""")
def _(v):
    xml = F.expr(_XML.replace("VARCHAR", "STRING"))
    return v["supplier"].select("s_suppkey", r6(tables.ome_dpi(xml)).alias("dpi"), tables.ome_tile(xml).alias("tile"))


@query("a5_slide_metadata", "SELECT c_custkey AS slide, round(abs(c_acctbal) / 1e7 * 1000, 9) AS um_per_px, CAST(CASE WHEN c_custkey % 2 = 0 THEN 20 ELSE 40 END AS INT) AS res FROM customer")
def _(v):
    slides = v["customer"].select(c("c_custkey").alias("slide"), (F.abs("c_acctbal") / 1e7).alias("mm_x"), F.when(c("c_custkey") % 2 == 0, 20.0).otherwise(40.0).alias("magnification"))
    return tables.slide_metadata(slides).select("slide", F.round("um_per_px", 9).alias("um_per_px"), "res")


@query("a7_json_fields", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(v):
    return v["events"].select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("a11_find_slide", "SELECT min(p_brand || '/' || p_name || '.svs') AS path FROM part WHERE lower(p_brand || '/' || p_name || '.svs') LIKE '%brand#1%' AND lower(p_brand || '/' || p_name || '.svs') LIKE '%1%'")
def _(v):
    return tables.find_slide(v["part"].select(F.concat_ws("/", "p_brand", F.concat("p_name", F.lit(".svs"))).alias("path")), "BRAND#1", "1").select("path")


@query("a13_cell_json", """SELECT tile_index, m.marker, 's_ROI#' || tile_index || '_' || m.marker || '.json' AS file, '{"cell_id":' || cell_id || ',"y":' || y || ',"x":' || x || '}' AS value
  FROM cells, (VALUES ('m1'), ('m2')) m(marker)""")
def _(v):
    marked = v["cells"].withColumn("sample", F.lit("s")).withColumn("marker", F.explode(F.array(F.lit("m1"), F.lit("m2"))))
    return tables.cell_json(marked, ["cell_id", "y", "x"]).drop("sample")


@query("a16_reviewer_copy", "SELECT cell_id, coalesce(CASE WHEN cell_id % 5 = 0 THEN NOT m1_expression END, m1_expression) AS m1_expression FROM cellinfo")
def _(v):
    base = v["cellinfo"].select("cell_id", "m1_expression")
    return tables.reviewer_copy(base, base.where("cell_id % 5 = 0").withColumn("m1_expression", ~c("m1_expression")), "cell_id", ["m1_expression"])


@query("b1_rename_project", 'SELECT cell_id AS "Cell index", tile_index AS "Tile index", y AS "Relative y_coord", x AS "Relative x_coord", m1_tier AS tier FROM cellinfo')
def _(v):
    return scalar.project(v["cellinfo"], {"cell_id": "Cell index", "tile_index": "Tile index", "y": "Relative y_coord", "x": "Relative x_coord", "m1_tier": "tier"})


@query("b2_marker_features", "SELECT cell_id, round(p5, 6) AS nuc_p5, round(p9, 6) AS nuc_p9 FROM (SELECT cell_id, quantile_cont(v_aec / 255.0, 0.5) AS p5, quantile_cont(v_aec / 255.0, 0.9) AS p9 FROM px WHERE comp = 'nuc' AND stain = 1 GROUP BY cell_id)")
def _(v):
    stats = aggregates.profile(v["px"].where("comp = 'nuc' and stain = 1"), ["cell_id"], "v_aec")
    named = scalar.project(stats, {"cell_id": "cell_id", **{f"p{i}": f"CD3 nuc AEC p{i}" for i in (5, 9)}, "iqr": "CD3 nuc AEC IQR", "min": "CD38 nuc AEC min"})
    keep = scalar.feature_columns(named.columns, "CD3")
    return named.select("cell_id", *[r6(c(f"`{n}`")).alias(f"nuc_{n[-2:]}") for n in keep])


@query("b3_name_levels", "SELECT cell_id, CAST(v_aec AS INT) AS nuc_aec_p5 FROM (SELECT cell_id, min(v_aec) AS v_aec FROM px GROUP BY cell_id)")
def _(v):
    df = v["px"].groupBy("cell_id").agg(F.min("v_aec").alias("nuc AEC.p5"), F.max("v_aec").alias("nuc AEC IQR"))
    names = scalar.three_level_names(df.columns[1:], [(" ", "."), ("AEC", "aec")], r"IQR$")
    return df.select("cell_id", *[c(f"`{old}`").alias("_".join(new)) for old, new in names.items()])


@query("b4_clean_names", """SELECT p_partkey, replace(replace(replace(replace(replace(p_brand || '-x. ''y"', '.', ''), '''', ''), '"', ''), ' ', ''), '-', '') AS name FROM part""")
def _(v):
    return v["part"].select("p_partkey", scalar.clean_name(F.concat("p_brand", F.lit("-x. 'y\""))).alias("name"))


@query("b5_parse_lists", "SELECT n_nationkey, n_nationkey AS a, n_regionkey AS b, CAST(20 AS INT) AS res FROM nation")
def _(v):
    text = F.concat_ws(" ,", F.concat(F.lit("'"), c("n_nationkey").cast("string"), F.lit("'")), c("n_regionkey").cast("string"))
    ints = scalar.parse_list(text, "int")
    return v["nation"].select("n_nationkey", ints[0].alias("a"), ints[1].alias("b"), scalar.resolution(F.lit("20x")).alias("res"))


@query("b6_parse_points", "SELECT cell_id, -y AS py, x AS px FROM cells")
def _(v):
    point = scalar.parse_point(F.format_string("[-%d, %d]", "y", "x"))
    return v["cells"].select("cell_id", point.alias("p")).select("cell_id", c("p.y").alias("py"), c("p.x").alias("px"))


@query("b7_scale_factor", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 AND p_partkey % 2 = 0 THEN 0.5031 WHEN p_size % 3 = 0 THEN 0.2521 WHEN p_size % 3 = 1 AND p_partkey % 2 = 0 THEN 0.4414 WHEN p_size % 3 = 1 THEN 0.2207 END::DOUBLE AS sf FROM part")
def _(v):
    kind = F.element_at(F.array(F.lit("svs"), F.lit("ndpi"), F.lit("tif")), (c("p_size") % 3 + 1).cast("int"))
    return v["part"].select("p_partkey", scalar.scale_factor(kind, F.when(c("p_partkey") % 2 == 0, "20x").otherwise("40x")).alias("sf"))


@query("b8_complement", "SELECT y, x, 255 - least(v, 255) AS inv FROM img")
def _(v):
    return v["img"].select("y", "x", scalar.complement(c("v")).alias("inv"))


@query("b9_rescale", "SELECT y, x, round(v / 255.0, 6) AS f8, round(v / 65535.0, 9) AS f16 FROM img")
def _(v):
    return v["img"].select("y", "x", r6(scalar.rescale(c("v"))).alias("f8"), F.round(scalar.rescale(c("v"), 65535.0), 9).alias("f16"))


@query("b10_round_half_even", "SELECT event_id, round_even(round_even(event_id / 2.0::DOUBLE, 0), 3) AS whole, round_even(event_id / 4.0::DOUBLE, 3) AS part FROM events")
def _(v):
    return scalar.round_row(v["events"].select("event_id", (c("event_id") / 2.0).alias("whole"), (c("event_id") / 4.0).alias("part")), 3, ("whole",))


@query("b11_absolute_coords", "SELECT cell_id, CAST(trunc(y * 0.5 + 100 - 2000.25 - 10 - 0.5) AS INT) AS ay FROM cells")
def _(v):
    return v["cells"].select("cell_id", scalar.absolute(c("y") * 0.5, F.lit(100), F.lit(-2000.25), 10, F.lit(0.5)).alias("ay"))


@query("b12_tile_shift", "SELECT cell_id, c.tile_index, c.y, c.x, c.y + y0 AS abs_y, c.x + x0 AS abs_x FROM cells c JOIN tilestats t ON t.tile_index = c.tile_index")
def _(v):
    return scalar.shift_by_tile(v["cells"], v["tilestats"]).select("cell_id", "tile_index", "y", "x", "abs_y", "abs_x")


@query("b13_thumbnail_lookup", "SELECT cell_id, CAST(greatest(least(round_even(y / (20 / 1.25::DOUBLE), 0), 199), 0) AS INT) AS ty FROM cells")
def _(v):
    return v["cells"].select("cell_id", scalar.thumbnail(c("y"), 20.0, 200).alias("ty"))


@query("b14_bounds", "SELECT det_id FROM det WHERE cy > 150 AND cy < 3850 AND cx > 150 AND cx < 3850")
def _(v):
    return v["det"].where(scalar.inside(c("cy"), c("cx"), 4000, 4000, 150)).select("det_id")


@query("b15_subtier", "SELECT cell_id, m1_tier || '.' || m2_tier AS label, m1_tier + m2_tier / 10.0 >= 3 AND m1_tier + m2_tier / 10.0 < 4 AS in3 FROM cellinfo")
def _(v):
    return v["cellinfo"].select("cell_id", scalar.subtier(c("m1_tier"), c("m2_tier")).alias("label"), scalar.has_root(c("m1_tier") + c("m2_tier") / 10.0, 3).alias("in3"))


@query("b16_key_parts", "SELECT o_orderkey, o_orderstatus AS a, CAST(o_custkey AS VARCHAR) AS b FROM orders")
def _(v):
    key = F.concat_ws("-", F.lit("x"), "o_orderstatus", c("o_custkey").cast("string"))
    return v["orders"].select("o_orderkey", scalar.key_part(key, 2).alias("a"), scalar.key_part(key, 1).alias("b"))


@query("b17_measurement_map", "SELECT cell_id, max(CASE WHEN stain = 0 THEN v END) AS m0, max(CASE WHEN stain = 2 THEN v END) AS m2, count(*) AS n FROM (SELECT cell_id, stain, max(v_aec) AS v FROM px GROUP BY 1, 2) GROUP BY cell_id")
def _(v):
    long = v["px"].groupBy("cell_id", "stain").agg(F.max("v_aec").alias("v"))
    maps = long.groupBy("cell_id").agg(scalar.measurement_map(F.collect_list(F.struct(c("stain").cast("string"), "v"))).alias("m"))
    return maps.select("cell_id", F.try_element_at("m", F.lit("0")).alias("m0"), F.try_element_at("m", F.lit("2")).alias("m2"), F.size("m").cast("long").alias("n"))


@query("b19_shift_ring", "SELECT ann_id, x_max + 7.5::DOUBLE AS x2, y_min - 2.0::DOUBLE AS y2 FROM ann")
def _(v):
    from tessera.operators.spatial import box_ring

    ring = scalar.shift_ring(box_ring(c("y_min"), c("x_min"), c("y_max"), c("x_max")), F.lit(7.5), F.lit(-2.0))
    return v["ann"].select("ann_id", F.element_at(ring, 2)["x"].alias("x2"), F.element_at(ring, 2)["y"].alias("y2"))


@query("b20_unique_names", "SELECT ann_id, name, CASE WHEN r = 1 THEN name ELSE name || '_' || (r - 1) END AS unique_name FROM (SELECT ann_id, name, row_number() OVER (PARTITION BY name ORDER BY ann_id) AS r FROM ann)")
def _(v):
    return scalar.unique_names(v["ann"], "name", "ann_id").select("ann_id", "name", "unique_name")


@query("b22_cycle_names", "SELECT n_regionkey AS cycle, 'cycle_' || n_regionkey || '_' || n_name AS name FROM nation")
def _(v):
    cycles = v["nation"].groupBy(c("n_regionkey").alias("cycle")).agg(F.array_sort(F.collect_list("n_name")).alias("markers"))
    return scalar.cycle_names(cycles).select("cycle", "name")


@query("b24_masked_pixels", "SELECT y, x, CASE WHEN af > 3 THEN v ELSE 0 END AS v FROM img")
def _(v):
    return v["img"].select("y", "x", scalar.masked(c("v"), c("af") > 3).alias("v"))


@query("b25_expression_filter", "SELECT cell_id FROM (SELECT cell_id, CASE WHEN cell_id % 7 = 0 THEN NULL ELSE m1_expression END AS e FROM cellinfo) WHERE e = false")
def _(v):
    reviewed = v["cellinfo"].withColumn("m1_expression", F.when(c("cell_id") % 7 != 0, c("m1_expression")))
    return joins.population(reviewed, negative=["m1"]).select("cell_id")


@query("b26_label_membership", "SELECT n_nationkey, list_contains(string_split(r_name || ',' || n_name, ','), 'ASIA') AS hit FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(v):
    both = v["nation"].join(v["region"], c("n_regionkey") == c("r_regionkey"))
    return both.select("n_nationkey", scalar.has_label(F.concat_ws(",", "r_name", "n_name"), "ASIA").alias("hit"))


@query("b27_all_true", "SELECT cell_id FROM cellinfo WHERE m1_expression AND m2_expression")
def _(v):
    return v["cellinfo"].where(scalar.all_true(c("m1_expression"), c("m2_expression"))).select("cell_id")


@query("b28_evaluated_markers", "SELECT * FROM (VALUES ('m1', true), ('m2', false)) t(marker, evaluated)")
def _(v):
    half = v["cellinfo"].withColumn("m2_expression", F.lit(None).cast("boolean"))
    return scalar.evaluated(half)


@query("c1_inner_join", "SELECT c.cell_id, c.tile_index, m1_tier FROM cells c JOIN cellinfo i USING (cell_id)")
def _(v):
    return reshape.beside([v["cells"].select("cell_id", "tile_index"), v["cellinfo"].select("cell_id", "m1_tier")], "cell_id")


@query("c2_zip_markers", "SELECT cell_id, m1_tier, m2_tier FROM cellinfo")
def _(v):
    one, two = (v["cellinfo"].select("cell_id", c(f"m{i}_tier").alias("tier")) for i in (1, 2))
    return joins.zip_markers({"m1": one, "m2": two})


@query("c3_tile_core_lookup", "SELECT cell_id, CASE WHEN tile_index < 9 THEN 'core' || tile_index % 3 END AS core FROM cells")
def _(v):
    cores = v["tilestats"].where("tile_index < 9").select("tile_index", F.concat(F.lit("core"), (c("tile_index") % 3).cast("string")).alias("core"))
    return joins.lookup(v["cells"], cores, "tile_index").select("cell_id", "core")


@query("c4_consensus_support", "SELECT a.det_id, count(DISTINCT b.stain) AS support FROM det a JOIN det b ON abs(a.cy - b.cy) < 5 AND abs(a.cx - b.cx) < 5 AND a.stain <> b.stain GROUP BY a.det_id")
def _(v):
    return joins.support(v["det"])


@query("c5_nearest", """SELECT cell_id, arg_min(det_id, (d2, det_id)) AS det_id, min(d2) AS d2 FROM (SELECT cell_id, det_id, (y - cy) * (y - cy) + (x - cx) * (x - cx) AS d2 FROM cells, det WHERE abs(y - cy) < 40 AND abs(x - cx) < 40) WHERE d2 < 1600 GROUP BY cell_id""")
def _(v):
    points = v["cells"].select("cell_id", c("y").cast("double").alias("cy"), c("x").cast("double").alias("cx"))
    return joins.nearest(points, v["det"].select("det_id", "cy", "cx"), 40.0, point_id="cell_id", target_id="det_id")


@query("c6_point_in_rectangle", "SELECT cell_id, coalesce(arg_min(name, ann_id), 'Undefined') AS name FROM cells LEFT JOIN ann ON y > y_min AND y < y_max AND x > x_min AND x < x_max GROUP BY cell_id")
def _(v):
    return joins.first_box(v["cells"], v["ann"], key="cell_id", order="ann_id", label="name").select("cell_id", "name")


@query("c7_point_in_polygon", "SELECT cell_id, ann_id FROM cells JOIN ann ON y > y_min AND y < y_max AND x > x_min AND x < x_max")
def _(v):
    from tessera.operators.spatial import box_ring

    rings = v["ann"].select("ann_id", box_ring(c("y_min"), c("x_min"), c("y_max"), c("x_max")).alias("ring"))
    return joins.in_polygons(v["cells"], rings).select("cell_id", "ann_id")


@query("c8_within_all_matches", "SELECT cell_id, ann_id FROM cells LEFT JOIN ann ON y > y_min AND y < y_max AND x > x_min AND x < x_max")
def _(v):
    return joins.in_boxes(v["cells"], v["ann"], how="left").select("cell_id", "ann_id")


@query("c9_containment", "SELECT o.ann_id AS outer_id, i.ann_id AS inner_id FROM ann_nested o JOIN ann_nested i ON o.ann_id <> i.ann_id AND o.x_min <= i.x_min AND o.y_min <= i.y_min AND o.x_max >= i.x_max AND o.y_max >= i.y_max")
def _(v):
    return joins.containment(v["ann_nested"])


@query("c10_mask_lookup", "SELECT cell_id FROM cells WHERE EXISTS (SELECT 1 FROM mask WHERE ty = CAST(greatest(least(round_even(y / 32::DOUBLE, 0), 126), 0) AS INT) AND tx = CAST(greatest(least(round_even(x / 32::DOUBLE, 0), 130), 0) AS INT))")
def _(v):
    at = v["cells"].withColumns({"ty": scalar.thumbnail(c("y"), 40.0, 127), "tx": scalar.thumbnail(c("x"), 40.0, 131)})
    return joins.on_mask(at, v["mask"]).select("cell_id")


@query("c11_semi_anti", "SELECT cell_id, 'pos' AS side FROM cellinfo WHERE m1_tier >= 5 UNION ALL SELECT cell_id, 'neg' FROM cellinfo WHERE m1_tier < 5")
def _(v):
    pos, neg = joins.positives(v["cells"].select("cell_id"), v["cellinfo"].where("m1_tier >= 5").select("cell_id"))
    return pos.withColumn("side", F.lit("pos")).union(neg.withColumn("side", F.lit("neg")))


@query("c12_overlay", "SELECT coalesce(a.cell_id, b.cell_id) AS cell_id, coalesce(a.t, b.t) AS tier, b.u AS extra FROM (SELECT cell_id, m1_tier + 10 AS t FROM cellinfo WHERE cell_id % 3 = 0) a FULL JOIN (SELECT cell_id, m1_tier AS t, m2_tier AS u FROM cellinfo WHERE cell_id % 2 = 0) b ON a.cell_id = b.cell_id")
def _(v):
    left = v["cellinfo"].where("cell_id % 3 = 0").select("cell_id", (c("m1_tier") + 10).alias("tier"))
    right = v["cellinfo"].where("cell_id % 2 = 0").select("cell_id", c("m1_tier").alias("tier"), c("m2_tier").alias("extra"))
    return joins.overlay(left, right, "cell_id")


@query("c13_keyed_update", "SELECT cell_id, CASE WHEN tile_index = 3 THEN m1_tier = 6 ELSE m1_expression END AS m1_expression FROM cellinfo")
def _(v):
    edits = v["cellinfo"].where("tile_index = 3").select("cell_id", (c("m1_tier") == 6).alias("m1_expression"))
    return joins.update(v["cellinfo"].select("cell_id", "m1_expression"), edits, "cell_id", "m1_expression")


@query("c14_distances", "SELECT a.cell_id AS src, b.cell_id AS dst, round(sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2), 6) AS d FROM cells a JOIN cells b ON a.cell_id < b.cell_id AND abs(a.y - b.y) < 60 AND abs(a.x - b.x) < 60 WHERE sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2) < 60")
def _(v):
    points = v["cells"].select("cell_id", c("y").cast("double").alias("cy"), c("x").cast("double").alias("cx"))
    return joins.distances(points, 60.0, key="cell_id").withColumn("d", r6("d"))


@query("c15_click_resolve", "SELECT c.cell_id, k.det_id FROM cells c JOIN det k ON CAST(trunc(k.cy) AS INT) = c.y AND CAST(trunc(k.cx) AS INT) = c.x")
def _(v):
    return joins.clicked(v["cells"], v["det"].select("det_id", c("cy").alias("y"), c("cx").alias("x"))).select("cell_id", "det_id")


@query("c16_roi_selection", "SELECT tile_index, 'found' AS state FROM tilestats WHERE tile_index IN (1, 2, 3) UNION ALL SELECT 99, 'missing'")
def _(v):
    choice = v.spark.createDataFrame([(1,), (2,), (3,), (99,)], "tile_index int")
    found, lost = joins.selected(choice, v["tilestats"])
    return found.select("tile_index", F.lit("found").alias("state")).union(lost.select("tile_index", F.lit("missing")))


@query("c17_cluster_remap", "SELECT vec_id, label % 3 AS cluster FROM feat")
def _(v):
    mapping = v["feat"].select("label").distinct().withColumn("cluster", (c("label") % 3).cast("int"))
    return joins.lookup(v["feat"].select("vec_id", "label"), mapping, "label").select("vec_id", "cluster")


@query("f1_append_tiles", "SELECT cell_id, CAST(row_number() OVER (ORDER BY tile_index, cell_id) - 1 AS INT) AS cell_index FROM cells")
def _(v):
    parts = [v["cells"].where(c("tile_index") % 4 == k) for k in range(4)]
    return windows.dense_ids(reshape.appended(parts), ["tile_index", "cell_id"]).select("cell_id", "cell_index")


@query("f1_missing_tiles", "SELECT tile_index FROM tilestats WHERE tile_index NOT IN (SELECT tile_index FROM cells WHERE cell_id % 400 = 1)")
def _(v):
    return reshape.missing_tiles(v["tilestats"].select("tile_index"), v["cells"].where("cell_id % 400 = 1"))


@query("f2_append_stats", "SELECT tile_index, CASE WHEN tile_index < 4 THEN 'core' END AS core_label FROM tilestats")
def _(v):
    t = v["tilestats"].select("tile_index")
    return reshape.appended([t.where("tile_index >= 4"), t.where("tile_index < 4").withColumn("core_label", F.lit("core"))])


@query("f3_tagged_samples", "SELECT cell_id, CASE WHEN cell_id % 2 = 0 THEN 'even' ELSE 'odd' END AS sample_name FROM cells")
def _(v):
    ids = v["cells"].select("cell_id")
    return reshape.tagged({"even": ids.where("cell_id % 2 = 0"), "odd": ids.where("cell_id % 2 = 1")})


@query("f4_population_intersection", "SELECT cell_id FROM cellinfo WHERE m1_expression INTERSECT SELECT cell_id FROM cellinfo WHERE NOT m2_expression")
def _(v):
    info = v["cellinfo"]
    return reshape.common([joins.population(info, ["m1"]).select("cell_id"), joins.population(info, [], ["m2"]).select("cell_id")])


@query("f5_difference", "SELECT cell_id FROM cellinfo EXCEPT SELECT cell_id FROM cellinfo WHERE m1_expression AND NOT m2_expression")
def _(v):
    return reshape.without(v["cells"].select("cell_id"), joins.population(v["cellinfo"], ["m1"], ["m2"]).select("cell_id"))


@query("f6_flag_intersection", "SELECT cell_id FROM cellinfo WHERE m1_expression AND m2_expression AND y > 500 AND x > 500 AND tile_index <> 7")
def _(v):
    return v["cellinfo"].where(scalar.all_true(c("m1_expression"), c("m2_expression"), c("y") > 500, c("x") > 500, c("tile_index") != 7)).select("cell_id")


@query("f8_append_stitched", "SELECT cell_id, c.y + t.y0 AS y, c.x + t.x0 AS x FROM cells c JOIN tilestats t USING (tile_index) WHERE tile_index IN (1, 6)")
def _(v):
    moved = scalar.shift_by_tile(v["cells"], v["tilestats"])
    return reshape.appended([moved.where(c("tile_index") == t).select("cell_id", c("abs_y").alias("y"), c("abs_x").alias("x")) for t in (1, 6)])


@query("g1_wide_rows", "SELECT cell_id, max(CASE WHEN stain = 0 THEN a END) AS \"0_max\", max(CASE WHEN stain = 1 THEN a END) AS \"1_max\", max(CASE WHEN stain = 2 THEN a END) AS \"2_max\", max(CASE WHEN stain = 0 THEN i END) AS \"0_min\", max(CASE WHEN stain = 1 THEN i END) AS \"1_min\", max(CASE WHEN stain = 2 THEN i END) AS \"2_min\" FROM (SELECT cell_id, stain, max(v_aec) AS a, min(v_aec) AS i FROM px GROUP BY 1, 2) GROUP BY cell_id")
def _(v):
    long = v["px"].groupBy("cell_id", "stain").agg(F.max("v_aec").alias("a"), F.min("v_aec").alias("i"))
    return reshape.wide(long, ["cell_id"], "stain", [0, 1, 2], {"max": "a", "min": "i"})


@query("g2_unpivot", "SELECT cell_id, 'm1_tier' AS part, m1_tier AS value FROM cellinfo UNION ALL SELECT cell_id, 'm2_tier', m2_tier FROM cellinfo")
def _(v):
    return reshape.stacked(v["cellinfo"], ["cell_id"], ["m1_tier", "m2_tier"])


@query("g3_feature_difference", "SELECT cell_id, stain, max(CASE WHEN comp = 'nuc' THEN p END) - max(CASE WHEN comp = 'cyto' THEN p END) AS difference FROM (SELECT cell_id, stain, comp, max(v_hema) AS p FROM px GROUP BY 1, 2, 3) WHERE comp IN ('nuc', 'cyto') GROUP BY 1, 2")
def _(v):
    long = v["px"].groupBy("cell_id", "stain", "comp").agg(F.max("v_hema").alias("p"))
    return reshape.difference(long, ["cell_id", "stain"], "comp", "nuc", "cyto", "p")


@query("g4_beside", "SELECT vec_id, label, len(embedding) AS width FROM feat")
def _(v):
    return reshape.beside([v["feat"].select("vec_id", "label"), v["feat"].select("vec_id", F.size("embedding").cast("long").alias("width"))], "vec_id")


@query("g5_explode_polygons", "SELECT ann_id, p AS part, CASE p WHEN 0 THEN x_min ELSE x_max END AS x FROM ann, (VALUES (0), (1)) t(p)")
def _(v):
    nested = v["ann"].select("ann_id", F.array(F.array("x_min"), F.array("x_max")).alias("coordinates"))
    return reshape.polygons_of(nested).select("ann_id", "part", c("ring")[0].alias("x"))
