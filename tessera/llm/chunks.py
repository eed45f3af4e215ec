"""Texts as chunks between single spaces, with per-chunk values kept in sorted arrays."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from tessera.llm import textscan

#: Bytes of text that are looked up together.
GROUP = 1 << 20
_SPACE_ONLY, _FIRST = bytes(range(256)), np.uint64(0x9FB21C651E98DF25)
_MOST = 30_000
#: Bytes of chunks that a table keeps, far below what 32-bit places reach.
_TEXT = 1 << 28
#: Of a known chunk: the place and length of its list (-1: None), the place of its
#: bytes, and twice their number, plus 1 where the chunk begins its text.
_ROW = np.dtype([("place", np.int32), ("spot", np.int32), ("shape", np.uint32), ("count", np.int16)])


def groups(texts: pa.Array) -> Iterator[list[bytes]]:
    """Consecutive texts of about ``GROUP`` bytes, null as empty."""
    held, size = [], 0
    for text in texts.cast(pa.binary()):
        held.append(text.as_py() or b"")
        size += len(held[-1])
        if size >= GROUP:
            yield held
            held, size = [], 0
    if held:
        yield held


def _differ(text: np.ndarray, shapes: np.ndarray, known: np.ndarray, spots: np.ndarray, known_shapes: np.ndarray) -> np.ndarray:
    """Which chunks are not, byte by byte, those at ``spots`` of ``known``. ``text``
    holds the chunks' bytes one after another."""
    out = shapes != known_shapes
    sizes = shapes >> 1
    after = np.cumsum(sizes)
    at = np.repeat((spots - (after - sizes)).astype(np.int32), sizes)
    at += np.arange(len(at), dtype=np.int32)
    if len(at):
        unlike = np.flatnonzero(known.take(at, mode="clip") != text)
        out[np.searchsorted(after, unlike, side="right")] = True
    return out


class ChunkTable:
    """Integer lists by chunk, for texts whose chunks don't influence each other.

    ``make(chunk, first)`` gives a chunk's list, or None if it can't be treated
    apart from its neighbours. Chunks are found by a 64-bit hash (of the chunk,
    and of whether it begins its text where ``by_place``) and then compared byte
    by byte; a text with a chunk that only shares a hash is left to the caller.
    """

    def __init__(self, make: Callable[[str, bool], list[int] | None], kind: np.dtype, limit: int, by_place: bool):
        self.make, self.kind, self.limit, self.by_place = make, np.dtype(kind), limit, by_place
        self._clear()

    def _clear(self) -> None:
        #: Hashes of the known chunks, sorted, and the row of each in ``rows``.
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        #: What only grows at its end, and so is never copied: a row per chunk, the lists, the chunks' bytes.
        self.rows, self.pool, self.text = bytearray(), bytearray(), bytearray()

    def _learn(self, keys: np.ndarray, chunks: list[str], first: list[bool], raw: list[bytes], shapes: np.ndarray) -> None:
        found = [self.make(c, f) for c, f in zip(chunks, first, strict=True)]
        sizes = np.array([-1 if f is None or len(f) > _MOST else len(f) for f in found], np.int16)
        flat = array("i", [v for f, n in zip(found, sizes.tolist(), strict=True) if n > 0 for v in f])
        rows, lengths, long = np.zeros(len(keys), _ROW), np.maximum(sizes, 0).astype(np.int64), shapes >> 1
        rows["place"] = len(self.pool) // self.kind.itemsize + np.cumsum(lengths) - lengths
        rows["spot"] = len(self.text) + np.cumsum(long) - long
        rows["shape"], rows["count"] = shapes, sizes
        at, slots = np.searchsorted(self.keys, keys), len(self.keys) + np.arange(len(keys), dtype=np.int32)
        self.keys, self.slots = np.insert(self.keys, at, keys), np.insert(self.slots, at, slots)
        self.rows += rows.tobytes()
        self.pool += np.frombuffer(flat, np.int32).astype(self.kind).tobytes()
        self.text += b"".join(raw)

    def values(self, texts: list[bytes]) -> list[np.ndarray | None]:
        """Each text's lists, joined; None for texts that don't fall into chunks
        apart (several spaces in a row, spaces around, chunks without a list)."""
        joined = b" ".join(texts)
        _, starts, ends, hashes = textscan.scan(joined, _SPACE_ONLY)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        lows, highs = np.searchsorted(starts, begins[:-1]), np.searchsorted(starts, begins[1:])
        full = highs > lows
        heads = lows[full]
        if self.by_place:
            hashes[heads] = textscan.mix(hashes[heads] ^ _FIRST)
        unique, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        is_first = np.zeros(len(starts), bool)
        if self.by_place:
            is_first[heads] = True
        shapes = (ends - starts) * 2 + is_first
        new = np.ones(len(unique), bool)
        if len(self.keys):
            new = self.keys[np.minimum(np.searchsorted(self.keys, unique), len(self.keys) - 1)] != unique
        if new.any():
            if len(self.keys) + int(new.sum()) > self.limit or len(self.text) + int((shapes[where[new]] >> 1).sum()) > _TEXT:
                self._clear()
                new[:] = True
            spots = where[new]
            raw = [joined[a:b] for a, b in zip(starts[spots].tolist(), ends[spots].tolist(), strict=True)]
            self._learn(unique[new], [r.decode() for r in raw], is_first[spots].tolist(), raw, shapes[spots])
        entry = np.frombuffer(self.rows, _ROW)[self.slots[np.searchsorted(self.keys, unique)]][back]
        counts, places = entry["count"], entry["place"].astype(np.int64)
        sizes = np.maximum(counts, 0).astype(np.int64)
        after = np.cumsum(sizes)
        out = np.frombuffer(self.pool, self.kind)[np.repeat(places - after + sizes, sizes) + np.arange(int(after[-1]) if len(after) else 0)]
        bad = (counts < 0).astype(np.int64)
        raw = np.frombuffer(joined, np.uint8)
        differ = _differ(raw[raw != 32], shapes, np.frombuffer(self.text, np.uint8), entry["spot"], entry["shape"])
        bad += differ
        bad[1:] += starts[1:] - ends[:-1] != 1
        bad[heads] = (starts[heads] != begins[:-1][full]) | (counts[heads] < 0) | differ[heads]
        bad[highs[full] - 1] += ends[highs[full] - 1] != begins[1:][full] - 1
        wrong, edges = np.concatenate(([0], np.cumsum(bad))), np.concatenate(([0], after))
        return [None if wrong[b] > wrong[a] or a == b and text else out[edges[a] : edges[b]] for text, a, b in zip(texts, lows.tolist(), highs.tolist(), strict=True)]
