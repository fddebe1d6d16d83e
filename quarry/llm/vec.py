"""Vectorised words, lines and hashes over Arrow string columns.

Everything here works on UTF-8 bytes in blocks of about a megabyte, so no Python string
is made for a word and memory stays bounded whatever the length of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random value for each byte, and tables of byte classes.
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LEADING = (np.arange(256) & 0xC0) != 0x80
SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))

_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _tables(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, BLOCK + 1)
        with np.errstate(over="ignore"):
            steps = np.full(size, _BASE)
            steps[0] = 1
            _powers = np.cumprod(steps, dtype=np.uint64)
            steps[1:] = _BASE_INV
            _inverse = np.cumprod(steps, dtype=np.uint64)


class Texts:
    """A block of whole texts as one byte buffer. A null text counts as an empty one."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first
        self.n = len(offsets) - 1

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, side="right") - 1

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """The sum of a byte-wise flag in each text."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends, and the number of each text's first word (n + 1 numbers)."""
        inside = np.concatenate(([False], ~SPACE[self.data], [False]))
        cut = np.zeros(len(self.data) + 1, bool)
        cut[self.offsets] = True
        starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
        ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
        return starts, ends, np.searchsorted(starts, self.offsets)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As words(), for the pieces between line feeds; an empty text has one empty line."""
        feeds = np.flatnonzero(self.data == 10)
        starts = np.sort(np.concatenate((self.offsets[:-1], feeds + 1)), kind="stable")
        ends = np.sort(np.concatenate((self.offsets[1:], feeds)), kind="stable")
        first = np.searchsorted(feeds, self.offsets) + np.arange(self.n + 1)
        return starts, ends, first

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """64-bit hashes of byte ranges; equal bytes give equal hashes in any block and task."""
        _tables(len(self.data) + 1)
        with np.errstate(over="ignore"):
            data = LOWER[self.data] if lower else self.data
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(BYTE_VALUE[data] * _powers[: len(data)], out=total[1:])
            h = (total[ends] - total[starts]) * _inverse[starts]
            return mix(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))


def texts(column: pa.Array, block: int = BLOCK) -> Iterator[Texts]:
    """The column in blocks of about so many bytes; a longer text is a block of its own."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + block, side="right")) - 1)
        hi = min(hi, len(column))
        yield Texts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], lo)
        lo = hi


def windows(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive items of one text, and the place of each window's first item.

    first: the number of each text's first item (n + 1 numbers). A text with fewer items has none.
    """
    if len(hashes) < k:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    room = np.diff(first)
    left = np.repeat(first[1:], room) - np.arange(len(hashes))
    at = np.flatnonzero(left >= k)
    with np.errstate(over="ignore"):
        h = np.zeros(len(at), np.uint64)
        for i in range(k):
            h = mix(h * np.uint64(0x9FB21C651E98DF25) + hashes[at + i] + np.uint64(i + 1))
    return h, at


def keyed(hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Hashes that are equal for equal items of the same text only."""
    with np.errstate(over="ignore"):
        return mix(hashes ^ (docs.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB) + np.uint64(77)))


def lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and the place of each list's first value."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, kind))
