"""Queries for file formats on rows, annotation subtraction, registration and scalar functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera import functions as X
from tessera.operators import aggregates, export, image, joins, scalar, spatial
from tessera.plans import technologies
from tessera.plans.registry import query
from tessera.sources import images

c = F.col


@query("a3_tiff_round_trip", "SELECT CAST(y // 20 AS INT) AS ty, 1 AS page, CAST(sum(af) AS BIGINT) AS total FROM img GROUP BY 1 UNION ALL SELECT CAST(y // 20 AS INT), 0, CAST(sum(v) AS BIGINT) FROM img GROUP BY 1")
def _(v):
    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        ty, planes = int(pdf["ty"].iloc[0]), [np.zeros((20, 53), np.uint16) for _ in range(2)]
        for plane, name in zip(planes, ("v", "af"), strict=True):
            plane[pdf["y"] - 20 * ty, pdf["x"]] = pdf[name]
        return pd.DataFrame({"ty": [ty], "data": [images.tiff_bytes(planes)]})

    def read(batches):
        for pdf in batches:
            rows = [(t, i, int(images.tiff_plane(d, i).sum())) for t, d in zip(pdf["ty"], pdf["data"], strict=True) for i in range(len(images.tiff_pages(d)))]
            yield pd.DataFrame(rows, columns=["ty", "page", "total"])

    files = v["img"].withColumn("ty", F.floor(c("y") / 20).cast("int")).groupBy("ty").applyInPandas(write, "ty int, data binary")
    return files.mapInPandas(read, "ty int, page int, total long")


@query("a6_csv_rows", "SELECT cell_id, tile_index, y / 2.0::DOUBLE AS half FROM cells")
def _(v):
    schema = "cell_id BIGINT, tile_index INT, half DOUBLE"
    lines = v["cells"].select(F.to_csv(F.struct("cell_id", "tile_index", (c("y") / 2.0).alias("half"))).alias("line"))
    return lines.select(F.from_csv("line", schema).alias("r")).select("r.*")


@query("a7_geojson_features", "SELECT ann_id, name, x_min::DOUBLE AS x0, 5::BIGINT AS points FROM ann")
def _(v):
    ring = F.transform(spatial.box_ring(c("y_min"), c("x_min"), c("y_max"), c("x_max")), lambda p: F.array(p["x"], p["y"]))
    text = v["ann"].select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.array(ring).alias("coordinates")).alias("geometry"), F.struct("ann_id", "name").alias("properties"))).alias("j"))
    shape = "geometry struct<coordinates:array<array<array<double>>>>, properties struct<ann_id:int,name:string>"
    read = text.select(F.from_json("j", shape).alias("f"))
    return read.select("f.properties.ann_id", "f.properties.name", c("f.geometry.coordinates")[0][0][0].alias("x0"), F.size(c("f.geometry.coordinates")[0]).cast("long").alias("points"))


@query("a9_png_transforms", "SELECT n_nationkey, n_nationkey::DOUBLE - 3.5::DOUBLE AS dy, n_regionkey::DOUBLE AS dx FROM nation")
def _(v):
    def run(batches):
        for pdf in batches:
            texts = [images.png_text(images.png_bytes(np.zeros((2, 2)), {"dy": str(a - 3.5), "dx": str(float(b))})) for a, b in zip(pdf["n_nationkey"], pdf["n_regionkey"], strict=True)]
            yield pd.DataFrame({"n_nationkey": pdf["n_nationkey"], "dy": [float(t["dy"]) for t in texts], "dx": [float(t["dx"]) for t in texts]})

    return v["nation"].select("n_nationkey", "n_regionkey").mapInPandas(run, "n_nationkey int, dy double, dx double")


@query("a17_run_settings")
def _(v):
    return technologies.Settings(sample="s", markers=("m1", "m2"), technology="micsss").as_table(v.spark)


@query("b18_struct_json", """SELECT cell_id, '{"tile_index":' || tile_index || ',"at":{"y":' || y || ',"x":' || x || '}}' AS j FROM cells""")
def _(v):
    return v["cells"].select("cell_id", F.to_json(F.struct("tile_index", F.struct("y", "x").alias("at"))).alias("j"))


@query("b21_undefined", "SELECT cell_id, CASE WHEN tile_index > 5 THEN 'Undefined' ELSE 'core' || tile_index END AS label FROM cells")
def _(v):
    label = F.when(c("tile_index") <= 5, F.concat(F.lit("core"), c("tile_index").cast("string")))
    return v["cells"].select("cell_id", F.coalesce(label, F.lit("Undefined")).alias("label"))


@query("h11_annotation_subtraction", "SELECT o.ann_id, ((o.x_max - o.x_min) * (o.y_max - o.y_min) - (i.x_max - i.x_min) * (i.y_max - i.y_min))::DOUBLE AS area FROM ann_nested o JOIN ann_nested i ON i.ann_id = o.ann_id + 100")
def _(v):
    boxes = v["ann_nested"]
    pairs = joins.containment(boxes).where("inner_id = outer_id + 100")
    held = pairs.join(boxes, c("inner_id") == c("ann_id")).select("outer_id", "x_min", "x_max", "y_min", "y_max")
    inner = aggregates.union_area(held, ("outer_id",)).withColumnRenamed("area", "inner_area")
    return boxes.join(inner, c("ann_id") == c("outer_id")).select("ann_id", ((c("x_max") - c("x_min")) * (c("y_max") - c("y_min")) - c("inner_area")).alias("area"))


@query("i10_translated_tiles", "SELECT y + 3 AS y, x - 2 AS x, v FROM img WHERE y + 3 < 41 AND x - 2 >= 0")
def _(v):
    shift = v.spark.createDataFrame([(3, -2)], "dy int, dx int")
    moved = v["img"].join(F.broadcast(shift)).select((c("y") + c("dy")).alias("y"), (c("x") + c("dx")).alias("x"), "v")  # one row
    return moved.where("y between 0 and 40 and x between 0 and 52")


@query("i15_single_image_cells")
def _(v):
    cells = image.segmented(v["img"].select("y", "x", "v"), 20)
    keyed = cells.withColumn("cell_id", (c("ty") * 1000 + c("tx") * 100 + c("det_id")).cast("long"))
    shape = aggregates.morphology(keyed.select("cell_id", "y", "x"), 0.5)
    return shape.select("cell_id", *[F.round(n, 6).alias(n) for n in ("area", "perimeter", "major", "minor", "circularity")])


@query("i17_tiles_over_bounds", """SELECT CAST(gy AS INT) AS gy, CAST(gx AS INT) AS gx, round(least(100, count(ty) / 1600.0 * 100), 6) AS tissue_pct FROM range(0, 4) a(gy) CROSS JOIN range(0, 4) b(gx)
  LEFT JOIN (SELECT ty - (SELECT min(ty) FROM mask) AS ty, tx - (SELECT min(tx) FROM mask) AS tx FROM mask) ON ty // 40 = gy AND tx // 40 = gx GROUP BY 1, 2""")
def _(v):
    corner = v["mask"].agg(F.min("ty").alias("oy"), F.min("tx").alias("ox"))
    moved = v["mask"].join(F.broadcast(corner)).select((c("ty") - c("oy")).alias("ty"), (c("tx") - c("ox")).alias("tx"))  # one row
    grid = v.spark.range(16).select(F.floor(c("id") / 4).cast("int").alias("gy"), (c("id") % 4).cast("int").alias("gx"))
    return aggregates.tissue_share(grid, moved, 40, 1.0).select("gy", "gx", F.round("tissue_pct", 6).alias("tissue_pct"))


@query("l2_technologies", "SELECT t AS name, count(DISTINCT (cell_id, stain, comp)) AS n FROM px, (SELECT unnest(['cycif', 'if', 'micsss', 'singleplex', 'tma']) AS t) WHERE t IN ('cycif', 'if') OR cell_id IN "
  "(SELECT cell_id FROM (SELECT cell_id, stain, quantile_cont(v_hema, 0.5) / 255.0 AS p5 FROM px WHERE comp = 'nuc' GROUP BY 1, 2) GROUP BY cell_id HAVING quantile_cont(p5, 0.5) > 0.30) GROUP BY t")
def _(v):
    """Every registered technology run over all pixels: chromogenic ones drop red blood cells."""
    out = None
    for name in sorted(technologies.TECHNOLOGIES):
        rows = technologies.run(technologies.Settings(sample="s", markers=("m1", "m2"), technology=name), v["px"])
        part = rows.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query("l3_model_switch")
def _(v):
    """Detections of each registered model."""
    out = None
    for name in sorted(image.MODELS):
        part = image.segmented(v["img"].select("y", "x", "v"), 20, name).select(F.lit(name).alias("model"), "ty", "tx", "det_id").distinct().groupBy("model").count()
        out = part if out is None else out.unionByName(part)
    return out


@query("l4_review_query", "SELECT m1_tier, count(*) AS n FROM cellinfo WHERE m1_expression GROUP BY 1")
def _(v):
    technologies.review("tiers")(lambda df: joins.population(df, ["m1"]).groupBy("m1_tier").agg(F.count("*").alias("n")))
    return technologies.REVIEWS["tiers"](v["cellinfo"])


@query("l5_rowwise_as_expressions", "SELECT cell_id, CASE WHEN m1_tier = 3 THEN 3 ELSE m1_tier * 10 END AS t FROM cellinfo")
def _(v):
    return v["cellinfo"].select("cell_id", F.when(c("m1_tier") == 3, 3).otherwise(c("m1_tier") * 10).alias("t"))


@query("l6_group_join_text", "SELECT tile_index, string_agg(DISTINCT m1_tier::VARCHAR, ',' ORDER BY m1_tier::VARCHAR) AS tiers FROM cellinfo GROUP BY 1")
def _(v):
    return v["cellinfo"].groupBy("tile_index").agg(F.array_join(F.array_sort(F.collect_set(c("m1_tier").cast("string"))), ",").alias("tiers"))


@query("m1_math_functions", """SELECT cell_id, round(sqrt(y), 6) AS a, pow(x, 2)::DOUBLE AS b, round(exp(-y / 1000.0), 6) AS d, round_even(y / 4.0::DOUBLE, 0) AS e, trunc((x - 2000) / 3.0)::BIGINT AS f, abs(x - y) AS g, sign(x - y)::INT AS h,
  greatest(0, least(255, x - 1000))::DOUBLE AS i, round(y / 7.0::DOUBLE - floor(y / 7.0::DOUBLE), 6) AS j, round(sqrt(y * y + x * x), 6) AS k, round(least(1, 4 * pi() * y / (x * x + 1.0)), 6) AS l, round((y % 256 * 0.299 + x % 256 * 0.587 + 0.114 * 7)::DOUBLE, 6) AS m, ceil(y / 10.0)::BIGINT AS n, greatest(y - 100, 0) AS o FROM cells""")
def _(v):
    y, x = c("y"), c("x")
    return v["cells"].select(
        "cell_id", F.round(F.sqrt(y), 6).alias("a"), F.pow(x, 2).alias("b"), F.round(F.exp(-y / 1000.0), 6).alias("d"), X.half_even(y / 4.0).alias("e"), X.toward_zero((x - 2000) / 3.0).alias("f"),
        F.abs(x - y).alias("g"), F.signum(x - y).cast("int").alias("h"), X.clamp((x - 1000).cast("double"), 0.0, 255.0).alias("i"), F.round(X.remainder(y / 7.0, 1.0), 6).alias("j"), F.round(X.hypotenuse(y, x), 6).alias("k"),
        F.round(X.circularity(y, F.sqrt(x * x + 1.0)), 6).alias("l"), F.round(X.luma(y % 256, x % 256, F.lit(7)), 6).alias("m"), F.ceil(y / 10.0).alias("n"), X.at_least_zero(y - 100).alias("o"),
    )


@query("m2_array_map_functions", """SELECT cell_id, y - tile_index AS last_step, (x - tile_index) / 2.0::DOUBLE AS mid_gradient, (tile_index + y + x)::DOUBLE AS total, CASE WHEN x = y THEN 1 ELSE 2 END::BIGINT AS at,
  tile_index + x AS chosen_sum, 6::BIGINT AS n_joined, CASE WHEN y >= x THEN 'y' ELSE 'x' END AS top, 2::BIGINT AS n_keys, 1.5::DOUBLE AS put FROM cells""")
def _(v):
    values = F.array("tile_index", "y", "x")
    spots = F.array("y", "y", "x")
    flags = F.array(F.lit(True), F.lit(False), F.lit(True))
    m = F.create_map(F.lit("y"), c("y").cast("double"), F.lit("x"), c("x").cast("double"), F.lit("t"), F.lit(-1.0))
    top = X.by_value(X.without_key(m, "t"))[0]["key"]
    picked = X.chosen(values, flags)
    return v["cells"].select(
        "cell_id", X.steps(values)[0].alias("last_step"), X.gradient(values.cast("array<double>"))[1].alias("mid_gradient"), F.element_at(X.running_sum(values.cast("array<double>")), -1).alias("total"),
        F.when(c("x") == c("y"), F.lit(1)).otherwise(X.index_of(spots, c("x"))).cast("long").alias("at"), (picked[0] + picked[1]).alias("chosen_sum"), F.size(X.joined(F.array(values, values))).cast("long").alias("n_joined"),
        F.when(c("y") == c("x"), "y").otherwise(top).alias("top"), F.size(X.without_key(m, "t")).cast("long").alias("n_keys"), X.with_entry(m, F.lit("t"), F.lit(1.5))["t"].alias("put"),
    )


@query("m3_string_functions", """SELECT p_partkey, replace(replace(p_brand, '#', ''), 'B', '') AS a, string_split(p_name, ' ')[-1] AS b, trim('xx' || p_size || 'x', 'x') AS d, contains(lower(p_type), 'e') AS e,
  p_size % 256 AS f, printf('%.2f', p_size / 60.1::DOUBLE * 100) || '%' AS g, TRY_CAST(p_brand AS DOUBLE) AS h, p_size::DOUBLE AS i, p_name || '|' || p_brand AS j FROM part""")
def _(v):
    return v["part"].select(
        "p_partkey", X.delete(c("p_brand"), "#B").alias("a"), X.part(c("p_name"), " ", -1).alias("b"), X.stripped(F.concat(F.lit("xx"), c("p_size").cast("string"), F.lit("x")), "x").alias("d"), X.mentions(c("p_type"), "E").alias("e"),
        X.hex_rgb(F.concat(F.lit("#00"), F.lpad(F.hex(c("p_size").cast("long")), 2, "0"), F.lit("ff")))[1].alias("f"), X.percent(c("p_size") / 60.1).alias("g"), X.number(c("p_brand")).alias("h"), X.number(c("p_size").cast("string")).alias("i"),
        F.concat_ws("|", "p_name", "p_brand").alias("j"),
    )


@query("m4_json_and_null_functions", "SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS missing, value IS NULL AS is_na FROM events")
def _(v):
    return v["events"].select("event_id", X.optional(c("props"), "$.k", "none").alias("k"), X.optional(c("props"), "$.missing", "none").alias("missing"), c("value").isNull().alias("is_na"))


@query("k1_tile_hand_off", "SELECT tile_index, count(*) AS n, CAST(sum(m1_expression::INT) AS BIGINT) AS n_pos FROM cellinfo GROUP BY 1")
def _(v):
    """The batch form of the streamed hand-off: retried tiles count once."""
    from tessera.streaming import tiles

    twice = v["cellinfo"].select("tile_index", "cell_id", "m1_expression")
    return tiles.tile_counts(twice.union(twice).dropDuplicates(["tile_index", "cell_id"]), "m1_expression")


_MARKERS = ["CD3", "CD8", "PD1"]
_NAMED = "SELECT *, ['CD3', 'CD8', 'PD1'][stain + 1] AS marker FROM px"


def _export(v, digits: int):
    px = v["px"].withColumn("marker", F.element_at(F.array(*map(F.lit, _MARKERS)), c("stain") + 1))
    cells = v["cells"].join(aggregates.morphology(v["shape"], 0.5), "cell_id")
    places = px.select("cell_id", "marker").distinct().join(cells, "cell_id").withColumn("y", c("y") + F.length("marker"))
    return export.cell_metrics(cells, places, export.profiles(px, {"hema": "v_hema", "AEC": "v_aec"}), _MARKERS, digits=digits)


@query("g1_cell_metrics_export")
def _(v):
    """All 8 + 67 M columns, rounded as the format is."""
    return _export(v, 3)


@query("g1_cell_metrics_statistics", "SELECT cell_id, marker, comp, channel, round(min(v / 255.0), 5) AS p_min, round(quantile_cont(v / 255.0, 0.5), 5) AS p_mid, count(*) > 0 AS known FROM (SELECT cell_id, marker, comp, 'AEC' AS channel, v_aec AS v FROM ("
  + _NAMED + ") UNION ALL SELECT cell_id, marker, comp, 'hema', v_hema FROM (" + _NAMED + ") WHERE comp = 'nuc') GROUP BY 1, 2, 3, 4")
def _(v):
    """The export's blocks read back as rows: cells without a marker's pixels have none."""
    wide = _export(v, 9)
    blocks = F.array(*[F.struct(F.lit(m).alias("marker"), F.lit(comp).alias("comp"), F.lit(ch).alias("channel"), F.round(c(f"`{m} {comp} {ch} min`"), 5).alias("p_min"), F.round(c(f"`{m} {comp} {ch} p5`"), 5).alias("p_mid"), (c(f"`{m} {comp} {ch} num_peaks`") >= 1).alias("known")) for m in _MARKERS for comp, ch in export.BLOCKS])
    return wide.select("cell_id", F.explode(blocks).alias("b")).where("b.p_min is not null").select("cell_id", "b.*")
