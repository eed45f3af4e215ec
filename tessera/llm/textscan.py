"""Vectorised word scanning of UTF-8 texts with numpy.

A word is a maximal run of bytes that a 256-entry table does not map to a
space. Both word rules used here split on ASCII bytes only, so bytes of
multi-byte characters are always parts of words and need no decoding.

Word identity is a 64-bit multilinear hash: each place of a word has an odd
pseudo-random weight of its own, so that no fixed pattern of bytes makes two
words meet, as it does with powers of one base. Callers that need certainty
compare the bytes of the (few) positions that a hash comparison selects.
"""

from __future__ import annotations

import numpy as np

#: Lower-cases A-Z; every ASCII byte that is no letter or digit ends a word.
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: White space (space and 0x09 to 0x0D) ends a word, nothing else changes.
SPACED = bytes(32 if c == 32 or 9 <= c <= 13 else c for c in range(256))
#: The same, with A-Z lower-cased.
SPACED_LOWER = bytes(32 if c == 32 or 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))

_GOLDEN = 0x9E3779B97F4A7C15
_PIECE = 1 << 20
_U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _weights(n: int) -> np.ndarray:
    """The weights of the first ``n`` places of a word."""
    return mix(np.arange(1, n + 1, dtype=_U) * _U(_GOLDEN)) | _U(1)


_FORWARD = _weights(1 << 12)


def _scan(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of an already translated buffer."""
    inside = np.empty(len(buf) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = buf != 32
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not len(starts):
        return starts, ends, np.zeros(0, _U)
    at = np.arange(len(buf))
    at -= np.repeat(np.concatenate(([0], starts)), np.diff(np.concatenate(([0], starts, [len(buf)]))))
    longest = int((ends - starts).max())
    weights = _FORWARD if longest <= len(_FORWARD) else _weights(longest)
    np.minimum(at, len(weights) - 1, out=at)
    # One more than the byte, so that a NUL byte counts.
    terms = weights[at] * (buf.astype(_U) + _U(1))
    terms[buf == 32] = 0
    return starts, ends, mix(np.add.reduceat(terms, starts))


def scan(text: bytes, table: bytes) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The translated text and its words' starts, ends and hashes.

    Works in pieces of about a megabyte that end between words, so that memory
    beyond the words' own arrays does not grow with the text.
    """
    text = text.translate(table)
    if len(text) <= _PIECE:
        return (text, *_scan(np.frombuffer(text, np.uint8)))
    found, begin = [], 0
    while begin < len(text):
        end = text.find(b" ", min(begin + _PIECE, len(text)))
        end = len(text) if end < 0 else end
        s, e, h = _scan(np.frombuffer(text, np.uint8, end - begin, begin))
        found.append((s + begin, e + begin, h))
        begin = end
    return (text, *(np.concatenate(x) for x in zip(*found, strict=True)))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive words."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, _U)
    out = np.zeros(count, _U)
    for j in range(n):
        out *= _U(0xD6E8FEB86659FD93)
        out += hashes[j : j + count]
    return mix(out)


def covered(starts: np.ndarray, lengths: np.ndarray | int, size: int) -> np.ndarray:
    """Which of ``size`` positions lie in one of the given runs."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0
