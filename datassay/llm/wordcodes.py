"""Words of a batch of texts as numbers, without a Python object a word.

A batch's texts are one array of bytes; spans are found by a table of blanks, and a word's 64-bit hash is a polynomial in
its bytes, read off running sums and mixed. Equal words have equal hashes at any place and in any batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import mix64

#: Odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
UNDER = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** (0..n-1) modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


class Sums:
    """Hashes of any stretch of a sequence of numbers: sum of x[i] * BASE ** (i - start), mixed."""

    def __init__(self, x: np.ndarray):
        self.total = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x.astype(np.uint64) * powers(BASE, len(x)), out=self.total[1:])
        self.under = powers(UNDER, len(x) + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self.total[ends] - self.total[starts]) * self.under[starts])


def flags(characters: bytes) -> np.ndarray:
    """A table of which byte values are in characters."""
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


BLANK = flags(b" \t\n\x0b\x0c\r")


def pieces(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first, bytes, offsets) of runs of texts of about `most` bytes, whole texts each: text first + i is bytes[offsets[i]:offsets[i + 1]]. Nulls are empty."""
    column = column.cast(pa.binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        yield at, data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        at = to


def spans(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text number) of the runs of bytes that are not blank; no run goes over a text's end."""
    word = ~blank[data]
    before, after = np.empty(len(data), bool), np.empty(len(data), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before[:1] = after[-1:] = False
    before[cuts] = after[cuts - 1] = False
    starts = np.flatnonzero(word & ~before)
    return starts, np.flatnonzero(word & ~after) + 1, np.searchsorted(offsets, starts, side="right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches of bytes."""
    return Sums(data.astype(np.uint64) + np.uint64(1)).of(starts, ends)
