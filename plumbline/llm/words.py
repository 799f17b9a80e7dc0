"""64-bit hashes of the words of many texts at once, without a Python object for each word.

A word's hash is the mixed sum of a number for each of its bytes times a number for its place, both
drawn from a fixed rule; a word of more than ``PLACES`` bytes is hashed by its bytes as a whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

PLACES = 1 << 12
_PIECE = 1 << 16  # bytes hashed at once
_SPACE = 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (fixed multipliers)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_draws = mixed(np.arange(1, 256 + PLACES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE, _PLACE = _draws[:256].copy(), _draws[256:] | np.uint64(1)
_BYTE[_SPACE] = 0


def bytes_of(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The UTF-8 bytes of a column of texts and where each text begins in them (one place more than texts)."""
    column = column.cast(pa.large_string())
    _, places, data = column.buffers()
    at = np.frombuffer(places, np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    return memoryview(data)[at[0] : at[-1]] if data else memoryview(b""), at - at[0]


def hashed_words(column: pa.Array, letters: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and the number of all words) of texts without nulls.

    ``letters`` maps bytes (see ``bytes.translate``); words are what stands between the spaces it gives.
    """
    data, at = bytes_of(column)
    mapped = bytes(data).translate(letters)
    text = np.frombuffer(mapped, np.uint8)
    if not len(text):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    inside = text != _SPACE
    goes_on = inside.copy()  # the byte belongs to the word of the byte before
    goes_on[1:] &= inside[:-1]
    goes_on[at[at < len(text)]] = False
    starts = np.flatnonzero(inside & ~goes_on)
    inside[:-1] &= ~goes_on[1:]
    ends = np.flatnonzero(inside) + 1
    out = np.zeros(len(starts), np.uint64)
    cuts = np.unique(np.searchsorted(starts, np.arange(0, len(text) + _PIECE, _PIECE)))
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        begin = starts[low:high] - starts[low]
        size = min(int(ends[high - 1]), int(starts[high - 1]) + PLACES) - int(starts[low])
        place = np.arange(size) - np.repeat(begin, np.diff(begin, append=size))
        part = _BYTE[text[starts[low] : starts[low] + size]] * _PLACE[np.minimum(place, PLACES - 1)]
        out[low:high] = mixed(np.add.reduceat(part, begin))
    for i in np.flatnonzero(ends - starts > PLACES):
        out[i] = xxhash.xxh3_64_intdigest(mapped[starts[i] : ends[i]])
    return out, np.searchsorted(starts, at)
