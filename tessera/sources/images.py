"""Image scans and sinks without imaging libraries: a dependency-free TIFF and PNG
codec, and a Spark data source that serves pixel windows."""

from __future__ import annotations

import contextlib
import struct
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: TIFF field type sizes.
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 12: 8, 16: 8}
_CODES = {1: "B", 3: "H", 4: "I", 12: "d", 16: "Q"}


def tiff_bytes(pages: list[np.ndarray], dpi: float | None = None, description: str = "") -> bytes:
    """Uncompressed multi-page TIFF of 8- or 16-bit planes."""
    out, links = bytearray(b"II*\0\0\0\0\0"), [4]
    for page in pages:
        page = np.ascontiguousarray(page)
        data = page.astype(page.dtype.newbyteorder("<")).tobytes()
        while len(out) % 2:
            out += b"\0"
        place = len(out)
        out += data
        text = description.encode() + b"\0"
        text_at = len(out)
        out += text + b"\0" * (len(text) % 2)
        res_at = len(out)
        out += struct.pack("<II", round((dpi or 72) * 100), 100)
        tags = [(256, 4, 1, page.shape[1]), (257, 4, 1, page.shape[0]), (258, 3, 1, page.dtype.itemsize * 8), (259, 3, 1, 1), (262, 3, 1, 1), (270, 2, len(text), text_at if len(text) > 4 else int.from_bytes(text.ljust(4, b"\0"), "little")), (273, 4, 1, place), (277, 3, 1, 1), (278, 4, 1, page.shape[0]), (279, 4, 1, len(data)), (282, 5, 1, res_at), (283, 5, 1, res_at), (296, 3, 1, 2)]
        out[links[-1] : links[-1] + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags)
        links.append(len(out))
        out += b"\0\0\0\0"
    return bytes(out)


Fetch = Callable[[int, int], bytes]


def _fetch(data: bytes | Fetch) -> Fetch:
    return data if callable(data) else lambda at, n: data[at : at + n]


def tiff_pages(data: bytes | Fetch) -> list[dict]:
    """The pages of a classic or 64-bit TIFF (A3), from its bytes or from a function
    that fetches (offset, length): shape, dtype, blocks, description. A block is a
    strip or a tile: its place in the image, shape, offset and length."""
    fetch = _fetch(data)
    head = fetch(0, 16)
    order = {b"II": "<", b"MM": ">"}[head[:2]]
    big = struct.unpack_from(order + "H", head, 2)[0] == 43
    word, count_word, entry = ("Q", "Q", 20) if big else ("I", "H", 12)
    (at,) = struct.unpack_from(order + word, head, 8 if big else 4)
    wide, pages = struct.calcsize(word), []
    while at:
        (n,) = struct.unpack(order + count_word, fetch(at, struct.calcsize(count_word)))
        table = fetch(at + struct.calcsize(count_word), entry * n + wide)
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(f"{order}HH{word}", table, entry * i)
            size = {**_SIZES, 5: 8}.get(kind, 1) * count
            place = entry * i + 4 + wide
            raw = table[place : place + size] if size <= wide else fetch(struct.unpack_from(order + word, table, place)[0], size)
            if kind == 2:
                tags[tag] = raw.rstrip(b"\0").decode("utf-8", "replace")
            elif kind in _CODES:
                tags[tag] = struct.unpack(f"{order}{count}{_CODES[kind]}", raw)
            elif kind == 5:
                a, b = struct.unpack(order + "II", raw[:8])
                tags[tag] = (a / b if b else 0.0,)
        pages.append(_page(tags, order))
        (at,) = struct.unpack_from(order + word, table, entry * n)
    return pages


def _page(tags: dict, order: str) -> dict:
    height, width, channels = tags[257][0], tags[256][0], tags.get(277, (1,))[0]
    if tags.get(259, (1,))[0] not in _UNPACK:
        raise ValueError(f"TIFF compression {tags[259][0]} can't be read")
    if tags.get(284, (1,))[0] != 1 and channels > 1:
        raise ValueError("TIFF pages with separate planes can't be read")
    if 324 in tags:
        tall, wide, offsets, lengths = tags[323][0], tags[322][0], tags[324], tags[325]
    else:
        tall, wide, offsets, lengths = min(tags.get(278, (height,))[0], height), width, tags[273], tags[279]
    across = -(-width // wide)
    blocks = []
    for i, (a, n) in enumerate(zip(offsets, lengths, strict=True)):
        y, x = i // across * tall, i % across * wide
        blocks.append((y, x, tall if 324 in tags else min(tall, height - y), wide, a, n))
    return {
        "shape": (height, width, channels), "dtype": np.dtype(f"{order}u{tags.get(258, (8,))[0] // 8}"), "blocks": blocks, "compression": tags.get(259, (1,))[0],
        "predictor": tags.get(317, (1,))[0], "description": tags.get(270, ""), "dpi": tags.get(282, (None,))[0],
    }


def lzw(data: bytes) -> bytes:
    """A TIFF's LZW block: codes of 9 to 12 bits, high bits first, one code early."""
    out, table, width, last = bytearray(), [], 9, None
    bits = held = 0
    for byte in data:
        bits, held = bits << 8 | byte, held + 8
        if held < width:
            continue
        held -= width
        code, bits = bits >> held, bits & (1 << held) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        word = table[code] if code < len(table) else last + last[:1]
        out += word
        if last is not None:
            table.append(last + word[:1])
        last = word
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return bytes(out)


#: By TIFF compression number: none, LZW, and the two numbers of Deflate.
_UNPACK = {1: bytes, 5: lzw, 8: zlib.decompress, 32946: zlib.decompress}


def tiff_window(data: bytes | Fetch, page: dict, y: int, x: int, height: int, width: int) -> np.ndarray:
    """A window of a page (A1); only the blocks that it meets are fetched, and what
    is outside the image is 0."""
    fetch, channels = _fetch(data), page["shape"][2]
    out = np.zeros((height, width, channels), page["dtype"].newbyteorder("="))
    for by, bx, tall, wide, at, n in page["blocks"]:
        a, b = max(y, by), min(y + height, by + tall, page["shape"][0])
        c, d = max(x, bx), min(x + width, bx + wide, page["shape"][1])
        if a >= b or c >= d:
            continue
        raw = _UNPACK[page["compression"]](fetch(at, n))
        block = np.frombuffer(raw, page["dtype"], tall * wide * channels).reshape(tall, wide, channels)
        if page["predictor"] == 2:
            block = np.cumsum(block, axis=1, dtype=page["dtype"].newbyteorder("="))
        out[a - y : b - y, c - x : d - x] = block[a - by : b - by, c - bx : d - bx]
    return out


def tiff_plane(data: bytes | Fetch, page: int) -> np.ndarray:
    """One page as an array; a page that isn't there is an error (A3)."""
    pages = tiff_pages(data)
    if not 0 <= page < len(pages):
        raise IndexError(f"page {page} of {len(pages)}")
    height, width, channels = pages[page]["shape"]
    out = tiff_window(data, pages[page], 0, 0, height, width)
    return out[..., 0] if channels == 1 else out


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png_bytes(image: np.ndarray, text: dict[str, str] | None = None) -> bytes:
    """8-bit grey or RGB PNG with text chunks."""
    image = np.asarray(image, np.uint8)
    rows = image.reshape(image.shape[0], -1)
    body = zlib.compress(np.hstack([np.zeros((len(rows), 1), np.uint8), rows]).tobytes())
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, 2 if image.ndim == 3 else 0, 0, 0, 0)
    notes = b"".join(_chunk(b"tEXt", k.encode("latin-1") + b"\0" + v.encode("latin-1")) for k, v in (text or {}).items())
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + notes + _chunk(b"IDAT", body) + _chunk(b"IEND", b"")


def png_text(data: bytes) -> dict[str, str]:
    """A PNG's text chunks in order (A9), such as a registered mask's transform."""
    at, out = 8, {}
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        if data[at + 4 : at + 8] == b"tEXt":
            k, _, v = data[at + 8 : at + 8 + n].partition(b"\0")
            out[k.decode("latin-1")] = v.decode("latin-1")
        at += 12 + n
    return out


def stain_matrix(path: str | BinaryIO) -> list[list[float]]:
    """A stain matrix from a ``.npy`` file, by path or opened (A10)."""
    return np.load(path, allow_pickle=False).tolist()


class _Rows(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


@contextlib.contextmanager
def opened(path: str) -> Iterator[Fetch]:
    """A function that fetches ranges of a file, local or by any address that pyarrow knows."""
    store, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with store.open_input_file(name) as f:

        def fetch(at: int, n: int) -> bytes:
            f.seek(at)
            return f.read(n)

        yield fetch


class TiffReader(DataSourceReader):
    """Bands of rows of one page's window; rows and columns outside the image are 0.
    A task fetches the blocks of its own band."""

    def __init__(self, options: dict):
        self.path, self.y, self.x = options["path"], int(options.get("y", 0)), int(options.get("x", 0))
        with opened(self.path) as fetch:
            pages, number = tiff_pages(fetch), int(options.get("page", 0))
        if not 0 <= number < len(pages):
            raise IndexError(f"page {number} of {len(pages)}")
        self.page, self.channel = pages[number], int(options.get("channel", 0))
        h, w, _ = self.page["shape"]
        self.height, self.width = int(options.get("height", h - self.y)), int(options.get("width", w - self.x))
        # Whole blocks a band, so that no block is fetched by two tasks for its height.
        tall = self.page["blocks"][0][2]
        self.band = int(options["rows_per_task"]) if "rows_per_task" in options else max(1, (1 << 20) // max(1, self.width) // tall) * tall

    def partitions(self):
        stops = [0, *range((-self.y) % self.band or self.band, self.height, self.band), self.height]
        return [_Rows(a, b) for a, b in zip(stops, stops[1:]) if a < b]

    def read(self, part: _Rows) -> Iterator[pa.RecordBatch]:
        top = self.y + part.first
        with opened(self.path) as fetch:
            found = tiff_window(fetch, self.page, top, self.x, part.last - part.first, self.width)[..., self.channel].astype(np.int32)
        y, x = np.mgrid[top : top + len(found), self.x : self.x + self.width].astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(y.ravel()), pa.array(x.ravel()), pa.array(found.ravel())], ["y", "x", "v"])


class TiffSource(DataSource):
    """``spark.read.format("tiff_pixels")`` with path, page and an optional window (A1, A3)."""

    @classmethod
    def name(cls) -> str:
        return "tiff_pixels"

    def schema(self) -> str:
        return "y int, x int, v int"

    def reader(self, schema) -> TiffReader:
        return TiffReader(self.options)


def read_window(spark: SparkSession, path: str, **window) -> DataFrame:
    spark.dataSource.register(TiffSource)
    return spark.read.format("tiff_pixels").options(path=path, **{k: str(v) for k, v in window.items()}).load()
