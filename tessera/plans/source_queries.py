"""Queries on sources and sinks: settings, stain matrices, tile and polygon sinks, projects."""

from __future__ import annotations

import io
import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tessera.operators import spatial
from tessera.plans.registry import query
from tessera.sources import geometry, images, tables
from tessera.sources.store import folder

c = F.col


@query("a8_settings", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(n_regionkey * 100 AS BIGINT) AS tile, n_nationkey / 4.0::DOUBLE AS prob, n_name AS label FROM nation")
def _(v):
    """A settings text per nation: the first section that has a name counts, and a name may stand outside sections."""
    text = F.format_string('tiling:\n  tile: %d\nmodel:\n  tile: 5\n  prob: %s\nlabel: "%s"\n', (c("n_regionkey") * 100).cast("long"), (c("n_nationkey") / 4.0).cast("string"), c("n_name"))

    def read(batches):
        for pdf in batches:
            found = [tables.parse_parameters(t) for t in pdf["text"]]
            yield pd.DataFrame({"n_nationkey": pdf["n_nationkey"], **{k: [tables.parameter(s, k) for s in found] for k in ("tile", "prob", "label")}})

    return v["nation"].select(c("n_nationkey").cast("long"), text.alias("text")).mapInPandas(read, "n_nationkey long, tile long, prob double, label string")


@query("a10_stain_matrix", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, CAST(i AS INT) AS i, (n_nationkey * (i + 1) + n_regionkey)::DOUBLE AS red, (n_regionkey * i)::DOUBLE AS green, (i - 1)::DOUBLE AS blue FROM nation, range(3) r(i)")
def _(v):
    """A stain matrix per nation, written as .npy and read back."""

    def run(batches):
        for pdf in batches:
            out = []
            for a, b in zip(pdf["n_nationkey"], pdf["n_regionkey"], strict=True):
                file = io.BytesIO()
                np.save(file, np.array([[a * (i + 1) + b, b * i, i - 1] for i in range(3)], float))
                file.seek(0)
                out += [(a, i, *stain) for i, stain in enumerate(images.stain_matrix(file))]
            yield pd.DataFrame(out, columns=["n_nationkey", "i", "red", "green", "blue"])

    return v["nation"].select(c("n_nationkey").cast("long"), c("n_regionkey").cast("long")).mapInPandas(run, "n_nationkey long, i int, red double, green double, blue double")


def _sink(v) -> str:
    """Cells of three samples, written by sample and tile to the shared folder."""
    path = folder(v.spark, "tiles")
    tables.write_tiles(v["cellinfo"].select(F.format_string("S%d", c("tile_index") % 3).alias("sample"), "tile_index", "cell_id", "m1_tier"), path)
    return path


@query("a12_tile_sink", "SELECT 'S' || (tile_index % 3) AS sample, tile_index, cell_id, m1_tier FROM cellinfo")
def _(v):
    return v.spark.read.schema("cell_id long, m1_tier int, sample string, tile_index int").parquet(_sink(v))


@query("a15_wkb_sink", "SELECT ann_id, 5::BIGINT AS points, x_max::DOUBLE AS x_max, y_max::DOUBLE AS y_max, ((x_max - x_min) * (y_max - y_min))::DOUBLE AS area FROM ann")
def _(v):
    def read(batches):
        for pdf in batches:
            rings = [np.array(geometry.wkb_ring(w)) for w in pdf["wkb"]]
            areas = [abs(np.sum(r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1])) / 2 for r in rings]
            yield pd.DataFrame({"ann_id": pdf["ann_id"], "points": [len(r) for r in rings], "x_max": [r[:, 0].max() for r in rings], "y_max": [r[:, 1].max() for r in rings], "area": areas})

    ring = spatial.box_ring(c("y_min"), c("x_min"), c("y_max"), c("x_max"))
    return v["ann"].select("ann_id", geometry.to_wkb(ring).alias("wkb")).mapInPandas(read, "ann_id int, points long, x_max double, y_max double, area double")


@query("a15_shapefile_sink", """SELECT name, count(*) AS n, 100 + 136 * count(*) AS shp_bytes, 100 + 8 * count(*) AS shx_bytes, min(x_min)::DOUBLE AS x_min, min(y_min)::DOUBLE AS y_min,
  max(x_max)::DOUBLE AS x_max, max(y_max)::DOUBLE AS y_max FROM ann GROUP BY name""")
def _(v):
    """A layer of boxes per annotation name, read back from the files' headers."""

    def layer(pdf: pd.DataFrame) -> pd.DataFrame:
        rings = [[(b.x_min, b.y_min), (b.x_min, b.y_max), (b.x_max, b.y_max), (b.x_max, b.y_min), (b.x_min, b.y_min)] for b in pdf.itertuples()]
        files = geometry.shapefile([[(float(x), float(y)) for x, y in r] for r in rings], list(pdf["name"]))
        records = struct.unpack_from("<I", files["dbf"], 4)[0]
        return pd.DataFrame([(pdf["name"].iloc[0], records, len(files["shp"]), len(files["shx"]), *struct.unpack_from("<4d", files["shp"], 36))], columns=["name", "n", "shp_bytes", "shx_bytes", "x_min", "y_min", "x_max", "y_max"])

    return v["ann"].groupBy("name").applyInPandas(layer, "name string, n long, shp_bytes long, shx_bytes long, x_min double, y_min double, x_max double, y_max double")


@query("a18_project_samples", "SELECT 'sample=S' || (tile_index % 3) AS sample, count(DISTINCT tile_index) AS tiles FROM cellinfo GROUP BY 1")
def _(v):
    project = _sink(v)
    tile = tables.list_files(v.spark, project).select(F.regexp_extract("path", r"/(sample=[^/]+)/", 1).alias("of"), F.regexp_extract("path", r"/tile_index=(\d+)/", 1).alias("tile"))
    tiles = tile.groupBy("of").agg(F.countDistinct("tile").alias("tiles"))
    return tables.project_samples(v.spark, project).join(tiles, c("sample") == c("of"), "left").select("sample", F.coalesce("tiles", F.lit(0)).alias("tiles"))
