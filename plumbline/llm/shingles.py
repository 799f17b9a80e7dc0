"""Word shingles and b-bit MinHash signatures of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from plumbline.llm.common import LOWER
from plumbline.llm.words import hashed_words, mixed

WORDS = 5
_LETTERS = bytes(32 if 9 <= b <= 13 else LOWER[b] for b in range(256))


def _runs(words: np.ndarray, length: int) -> np.ndarray:
    """The hash of each run of ``length`` words."""
    n = max(0, len(words) - length + 1)
    out = np.full(n, length, np.uint64)
    for i in range(length):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n])
    return out


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Of each text the sorted hashes of its distinct ``WORDS``-word shingles; a shorter text is one
    shingle of all its words, a text without words has none."""
    words, first = hashed_words(texts, _LETTERS)
    runs = _runs(words, WORDS)
    for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if high - low >= WORDS:
            yield np.unique(runs[low : high - WORDS + 1])
        else:
            yield _runs(words[low:high], high - low)[: high - low]


def shingles(text: str) -> np.ndarray:
    return next(shingle_sets(pa.array([text])))


class MinHash:
    """``symbols`` minima under different 32-bit linear hashes of the grams, mixed to 16 bits each.

    The grams are mixed hashes themselves, so a linear map of them is enough.
    """

    def __init__(self, symbols: int, seed: int = 7):
        draws = mixed(np.arange(1, 2 * symbols + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed))
        self.factors = (draws[:symbols] >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1)
        self.offsets = (draws[symbols:] >> np.uint64(32)).astype(np.uint32)[:, None]

    def of(self, grams: np.ndarray, step: int = 4096) -> np.ndarray:
        x = (grams >> np.uint64(32)).astype(np.uint32)
        best = np.full(len(self.factors), 0xFFFFFFFF, np.uint32)
        for low in range(0, len(x), step):
            best = np.minimum(best, (x[None, low : low + step] * self.factors + self.offsets).min(axis=1))
        return (mixed(best.astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)
