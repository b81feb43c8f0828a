"""Words of Arrow text columns as numpy arrays.

Texts are handled as UTF-8 bytes in slices of about ``SLICE`` bytes (a longer text is a slice of its own, never
cut), so memory follows the longest text, not the Arrow batch. Word hashes are polynomials modulo 2**64 taken
from one running sum per piece, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
WHITE = bytes([9, 10, 11, 12, 13, 32])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers, a function of the seed."""
    with np.errstate(over="ignore"):
        steps = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return mix(steps + np.uint64(seed)) | np.uint64(1)


class Words(NamedTuple):
    """Words of a slice: its text ``i`` owns words ``first[i]`` to ``first[i + 1]``, bytes ``edge[i]`` to ``edge[i + 1]``."""

    rows: range
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray
    edge: np.ndarray


class Splitter:
    """Cuts texts into words: runs of bytes of one kind. ``fold`` turns ASCII letters into lower case."""

    def __init__(self, kinds: str = "white", fold: bool = True):
        """``kinds``: "white" cuts at ASCII white space only; "letters" takes runs of letters, digits and non-ASCII
        bytes and skips the rest; "both" takes these runs and also the runs of other marks between them."""
        table = np.ones(256, np.uint8)
        if kinds != "white":
            table[:128] = 2 if kinds == "both" else 0
            for low, high in ((48, 58), (65, 91), (97, 123)):
                table[low:high] = 1
        table[list(WHITE)] = 0
        self.kind = table
        self.low = np.arange(256, dtype=np.uint8)
        if fold:
            self.low[65:91] += 32
        self._powers(1 << 16)

    def _powers(self, n: int) -> None:
        base, back = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
        self.up = np.full(n, base, np.uint64)
        self.down = np.full(n, back, np.uint64)
        self.up[0] = self.down[0] = 1
        self.up, self.down = np.cumprod(self.up), np.cumprod(self.down)

    def _hash(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.empty(len(start), np.uint64)
        lo = 0
        while lo < len(start):  # pieces of whole words, at most as long as the table of powers
            origin = start[lo]
            hi = max(lo + 1, int(np.searchsorted(end, origin + len(self.up), "right")))
            size = int(end[hi - 1] - origin)
            if size > len(self.up):
                self._powers(size)
            piece = self.low[data[origin : origin + size]].astype(np.uint64) + np.uint64(1)
            total = np.zeros(size + 1, np.uint64)
            np.cumsum(piece * self.up[:size], out=total[1:])
            at = start[lo:hi] - origin
            out[lo:hi] = (total[end[lo:hi] - origin] - total[at]) * self.down[at]
            lo = hi
        return mix(out)

    def slices(self, texts: pa.Array, size: int = SLICE) -> Iterator[Words]:
        """Every text of the array, in order, in slices of about ``size`` bytes; a null has no words."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        _, offsets, content = texts.buffers()
        at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        whole = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
            data, edges = whole[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
            kind = np.zeros(len(data) + 2, np.uint8)
            kind[1:-1] = self.kind[data]
            inside, change = kind[1:-1] > 0, kind[1:] != kind[:-1]
            change[edges] = True  # words end where their text ends
            opens, closes = inside & change[:-1], inside & change[1:]
            start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
            hashes = self._hash(data, start, end)
            yield Words(range(lo, hi), data, start, end, np.searchsorted(start, edges), hashes, edges)
            lo = hi


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words and the bounds of each text's windows.

    A text with fewer words, but at least one, has its whole sequence as its only window.
    """
    n = np.diff(words.first)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    bounds = np.concatenate(([0], np.cumsum(count)))
    factors = odd_numbers(size + 1, 7)
    begin = np.repeat(words.first[:-1] - bounds[:-1], count) + np.arange(bounds[-1])
    length = np.repeat(np.minimum(n, size), count)
    padded = np.concatenate((words.hash, np.zeros(size, np.uint64)))
    out = length.astype(np.uint64) * factors[size]
    for k in range(size):
        out += np.where(length > k, padded[begin + k], np.uint64(0)) * factors[k]
    return mix(out), bounds


def distinct_sets(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes in ascending order, and their bounds."""
    kept, size = [], [0]
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own = np.sort(hashes[lo:hi])
        if hi - lo > 1:
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        kept.append(own)
        size.append(len(own))
    return np.concatenate(kept) if kept else hashes[:0], np.cumsum(size)
