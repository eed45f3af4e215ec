"""TIFF layouts and compressions, windows by range, and the wide export."""

import struct
import zlib

import numpy as np
import pytest

from tessera.operators import export
from tessera.plans import more_queries, registry  # noqa: F401  (the first fills the second)
from tessera.plans.views import Views
from tessera.sources import images
from tests.conftest import SF


def packed(data):
    """LZW as TIFF writes it."""
    table, out, width, word = {}, [], 9, b""

    def clear():
        table.clear()
        table.update({bytes([i]): i for i in range(256)})

    clear()
    out.append((256, 9))
    for byte in data:
        longer = word + bytes([byte])
        if longer in table:
            word = longer
            continue
        out.append((table[word], width))
        table[longer] = len(table) + 2
        if len(table) + 2 >= (1 << width) and width < 12:
            width += 1
        if len(table) + 2 >= 4094:
            out.append((256, width))
            clear()
            width = 9
        word = bytes([byte])
    out += [(table[word], width)]
    if len(table) + 3 >= (1 << width) and width < 12:
        width += 1
    out.append((257, width))
    bits = "".join(f"{c:0{w}b}" for c, w in out)
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def tiff(image, *, compression, tile=None, big=False, predictor=1, order="<"):
    """A one-page TIFF of the given layout."""
    height, width, channels = image.shape
    tall, wide = tile or (7, width)
    blocks = []
    for y in range(0, height, tall):
        for x in range(0, width, wide):
            part = image[y : y + tall, x : x + wide]
            if tile:
                part = np.pad(part, ((0, tall - part.shape[0]), (0, wide - part.shape[1]), (0, 0)))
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=np.zeros_like(part[:, :1]))
            raw = part.astype(part.dtype.newbyteorder(order)).tobytes()
            blocks.append({1: bytes, 5: packed, 8: zlib.compress}[compression](raw))
    word = "Q" if big else "I"
    kind, size = (16, 8) if big else (4, 4)
    out = bytearray((b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, 0) if big else struct.pack(order + "HI", 42, 0)))
    link = 8 if big else 4
    offsets = []
    for b in blocks:
        offsets.append(len(out))
        out += b
    lists = {}
    for tag, values in ((324 if tile else 273, offsets), (325 if tile else 279, [len(b) for b in blocks])):
        lists[tag] = (len(out), values)
        out += struct.pack(f"{order}{len(values)}{word}", *values)
    tags = [(256, kind, 1, width), (257, kind, 1, height), (258, kind, 1, image.dtype.itemsize * 8), (259, kind, 1, compression), (277, kind, 1, channels), (317, kind, 1, predictor)]
    tags += [(322, kind, 1, wide), (323, kind, 1, tall)] if tile else [(278, kind, 1, tall)]
    tags += [(t, kind, len(v), at if len(v) > 1 else v[0]) for t, (at, v) in lists.items()]
    out[link : link + size] = struct.pack(order + word, len(out))
    out += struct.pack(order + ("Q" if big else "H"), len(tags))
    out += b"".join(struct.pack(f"{order}HH{word}{word}", *t) for t in sorted(tags)) + struct.pack(order + word, 0)
    return bytes(out)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("big", [False, True])
@pytest.mark.parametrize("tile", [None, (16, 16)])
@pytest.mark.parametrize("compression", [1, 5, 8])
def test_layouts(compression, tile, big, order):
    rng = np.random.default_rng(3)
    for dtype, channels, predictor in ((np.uint8, 3, 1), (np.uint16, 1, 2), (np.uint8, 1, 2)):
        image = (np.add.outer(np.arange(41), np.arange(53))[..., None] * 3 + rng.integers(0, 5, (41, 53, channels))).astype(dtype)
        data = tiff(image, compression=compression, tile=tile, big=big, predictor=predictor, order=order)
        whole = images.tiff_plane(data, 0)
        assert (whole == (image if channels > 1 else image[..., 0])).all()
        read = []
        page = images.tiff_pages(data)[0]
        window = images.tiff_window(lambda a, n: (read.append(n), data[a : a + n])[1], page, 30, -3, 20, 10)
        want = np.zeros((20, 10, channels), dtype)
        want[:11, 3:] = image[30:, :7]
        assert (window == want).all() and len(read) < len(page["blocks"])


def test_lzw_of_long_data():
    data = bytes(np.random.default_rng(1).integers(0, 4, 60_000).astype(np.uint8)) + b"a" * 9000
    assert images.lzw(packed(data)) == data


def test_window_source_reads_tiles(spark, tmp_path):
    image = np.random.default_rng(2).integers(0, 60_000, (70, 90, 1)).astype(np.uint16)
    (tmp_path / "s.tif").write_bytes(tiff(image, compression=8, tile=(16, 16), big=True))
    for path in (str(tmp_path / "s.tif"), f"file://{tmp_path}/s.tif"):
        frame = images.read_window(spark, path, y=5, x=60, height=80, width=20, rows_per_task=16)
        assert frame.rdd.getNumPartitions() > 3
        got = {(r.y, r.x): r.v for r in frame.collect()}
        assert len(got) == 1600 and all(v == (image[y, x, 0] if y < 70 and x < 90 else 0) for (y, x), v in got.items())
    with pytest.raises(Exception, match="page 1 of 1"):
        images.read_window(spark, str(tmp_path / "s.tif"), page=1).count()


def test_export_has_the_format_of_the_table(spark):
    frame = registry.QUERIES["g1_cell_metrics_export"](spark, SF)
    assert frame.columns == ["cell_id", *export.header(["CD3", "CD8", "PD1"])] and len(frame.columns) == 1 + 8 + 67 * 3
    rows = frame.collect()
    assert len(rows) == Views(spark, SF)["cells"].count()
    assert all(r["CD3 nuc AEC num_peaks"] >= 1 for r in rows if r["CD3 nuc AEC min"] is not None) and any(r["CD8 mem AEC p5"] is not None for r in rows)
    assert len(set(export.header(["A", "B"]))) == 8 + 134
