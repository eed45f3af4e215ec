"""Scans and sinks, round trips included."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.plans.views import Views
from tessera.sources import images, tables
from tessera.streaming import tiles
from tests.conftest import SF


def test_tiff_pages_and_window(spark, tmp_path):
    planes = [np.arange(60, dtype=np.uint8).reshape(6, 10), (np.arange(60, dtype=np.uint16) * 100).reshape(6, 10)]
    path = tmp_path / "a.tif"
    path.write_bytes(images.tiff_bytes(planes, dpi=25400, description="<OME/>"))
    data = path.read_bytes()
    pages = images.tiff_pages(data)
    assert [p["shape"] for p in pages] == [(6, 10, 1)] * 2 and pages[0]["description"] == "<OME/>" and pages[1]["dpi"] == 25400
    assert all((images.tiff_plane(data, i) == p).all() for i, p in enumerate(planes))
    with pytest.raises(IndexError):
        images.tiff_plane(data, 2)
    got = images.read_window(spark, str(path), page=1, y=-1, x=8, height=3, width=4, rows_per_task=2)
    assert {(r.y, r.x): r.v for r in got.collect()} == {(y, x): int(planes[1][y, x]) if 0 <= y < 6 and 0 <= x < 10 else 0 for y in range(-1, 2) for x in range(8, 12)}
    assert images.read_window(spark, str(path)).count() == 60


def test_png_text_keeps_order(tmp_path):
    text = {"x_max": "3", "x_min": "-1", "shift": "[1.5, 2]"}
    assert list(images.png_text(images.png_bytes(np.zeros((4, 5, 3)), text)).items()) == list(text.items())


def test_npy_and_yaml(tmp_path):
    np.save(tmp_path / "m.npy", np.eye(3))
    assert images.stain_matrix(str(tmp_path / "m.npy")) == np.eye(3).tolist()
    (tmp_path / "p.yaml").write_text("tiling:\n  tile: 1000\nmodel:\n  tile: 5\n  prob: 0.25\ntop: 1\n")
    settings = tables.read_parameters(str(tmp_path / "p.yaml"))
    assert [tables.parameter(settings, k) for k in ("tile", "prob", "top", "none")] == [1000, 0.25, 1, None]
    assert tables.parse_parameters("") == {}


@pytest.mark.parametrize("bare", [False, True])
def test_geojson(spark, tmp_path, bare):
    feature = '{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[0,1],[0,0]]]},"properties":{"name":"A"}}'
    (tmp_path / "a.json").write_text(f"[{feature},{feature}]" if bare else f'{{"features":[{feature},{feature}]}}')
    got = tables.read_features(spark, str(tmp_path / "a.json")).collect()
    assert len(got) == 2 and got[0].geometry.type == "Polygon" and got[0].properties["name"] == "A"


def test_csv_and_tile_sinks(spark, tmp_path):
    df = spark.createDataFrame([("s", 1, 10, 0.5), ("s", 2, 11, None)], "sample string, tile_index int, cell_id long, v double")
    df.coalesce(1).write.csv(str(tmp_path / "c"), header=True)
    assert tables.read_csv(spark, str(tmp_path / "c"), df.schema).exceptAll(df).count() == 0
    tables.write_tiles(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).where("tile_index = 2").count() == 1
    tables.write_cell_json(df.withColumn("marker", F.lit("m")), ["cell_id", "v"], str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).where("tile_index = 1").first().value == '{"cell_id":10,"v":0.5}'
    assert tables.list_files(spark, str(tmp_path / "c")).where("path like '%.csv'").count() == 1
    (tmp_path / "empty").mkdir()
    (tmp_path / "file").write_text("")
    assert [r.sample for r in tables.project_samples(spark, str(tmp_path)).collect()] == ["c", "empty", "j", "t"]
    assert tables.project_samples(spark, str(tmp_path / "empty")).count() == 0


def test_metadata(spark):
    xml = '<OME><Pixels PhysicalSizeX="0.5" PhysicalSizeXUnit="{}"/><TiffData TileWidth="512"/></OME>'
    df = spark.createDataFrame([(xml.format(u),) for u in ("µm", "mm", "pt")], "x string")
    rows = df.select(tables.ome_dpi(F.col("x")).alias("d"), tables.ome_tile(F.col("x")).alias("t")).collect()
    assert [r.d for r in rows] == [50800.0, 50.8, None] and rows[0].t == 512
    paths = spark.createDataFrame([("b/S1_cd3.ndpi",), ("a/s1_CD3.svs",), ("a/s1_cd3.txt",)], "path string")
    assert tables.find_slide(paths, "Cd3", "S1").first().path == "a/s1_CD3.svs"


def test_tiles_as_a_stream(spark, tmp_path):
    df = Views(spark, SF)["cellinfo"].select("tile_index", "cell_id", "m1_expression")
    for k in range(2):
        df.coalesce(1).write.parquet(str(tmp_path / "in" / f"try{k}"))
    rows = tiles.tile_stream(spark, str(tmp_path / "in" / "*"), df.schema)
    tiles.append_to(rows, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == df.count()
    counts = tiles.tile_counts(rows, "m1_expression").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    counts.awaitTermination()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == df.count()


def test_polygon_sinks(spark):
    import json
    import struct

    from tessera.operators.spatial import box_ring
    from tessera.sources import geometry

    df = spark.createDataFrame([("A", 1, 2, 5, 6)], "name string, y0 int, x0 int, y1 int, x1 int")
    ring = box_ring(F.col("y0"), F.col("x0"), F.col("y1"), F.col("x1"))
    wkb = df.select(geometry.to_wkb(ring).alias("w")).first().w
    assert struct.unpack_from("<BIII", wkb) == (1, 3, 1, 5) and struct.unpack_from("<dd", wkb, 13) == (2.0, 1.0)
    assert geometry.wkb_ring(wkb) == [(p["x"], p["y"]) for p in df.select(ring.alias("r")).first().r]
    with pytest.raises(ValueError):
        geometry.wkb_ring(struct.pack("<BIII", 1, 3, 0, 0))
    feature = json.loads(geometry.features(df.withColumn("ring", ring), "ring", ["name"]).first().value)
    assert feature["properties"] == {"name": "A"} and feature["geometry"]["coordinates"][0][2] == [6.0, 5.0]
    square = [(0.0, 0.0), (0.0, 2.0), (3.0, 2.0), (0.0, 0.0)]
    files = geometry.shapefile([square, square], ["A", "B"])
    assert struct.unpack_from(">i", files["shp"], 24)[0] * 2 == len(files["shp"]) and struct.unpack_from("<4d", files["shp"], 36) == (0, 0, 3, 2)
    at, words = struct.unpack_from(">2i", files["shx"], 108)
    assert struct.unpack_from(">2i", files["shp"], at * 2) == (2, words) and len(files["shx"]) == 116
    assert struct.unpack_from("<I", files["dbf"], 4)[0] == 2 and files["dbf"][65:].startswith(b" A")
