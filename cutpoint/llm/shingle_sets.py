"""Sets of word shingles of whole texts as sorted 64-bit hashes, made from UTF-8 bytes in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are handled together, and words whose shingles are sorted together.
BYTES, WORDS = 1 << 20, 1 << 19

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def scrambled(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A number per byte; A-Z have those of a-z.
_VALUE = scrambled(np.arange(1, 257, dtype=np.uint64))
_VALUE[65:91] = _VALUE[97:123]
_BASE = 0x2127599BF4325C37


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base % (1 << 64)))
    out[0] = 1
    return np.multiply.accumulate(out)


class WordHashes:
    """Hashes of words of ASCII-lower-cased texts."""

    def __init__(self):
        self.up = self.down = np.zeros(0, np.uint64)

    def _room(self, n: int) -> None:
        if n > len(self.up):
            self.up, self.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)

    def of(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of texts that lie end to end between ``cuts``, and how many each text has."""
        n = len(data)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(len(cuts) - 1, np.int64)
        self._room(n + 1)
        space = _SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[cuts] = True
        begins = ~space & (np.concatenate(([True], space[:-1])) | edge[:-1])
        ends = ~space & (np.concatenate((space[1:], [True])) | edge[1:])
        begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        # A polynomial over the bytes of a word, read off running sums and brought to the word's own start.
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUE[data] * self.up[:n], out=sums[1:])
        hashes = (sums[end] - sums[begin]) * self.down[begin]
        return scrambled(hashes), np.diff(np.searchsorted(begin, cuts))

    def runs(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first text, one after the last, word hashes, words per text) over all texts of a column."""
        if not len(column):
            return
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BYTES, "right")) - 1)
            if to > at + 1 or offsets[to] - offsets[at] <= BYTES:
                cuts = offsets[at : to + 1]
                hashes, counts = self.of(data[cuts[0] : cuts[-1]], cuts - cuts[0])
            else:
                hashes, counts = self._long(data[offsets[at] : offsets[to]])
            yield at, to, hashes, counts
            at = to

    def _long(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One text of many bytes, cut where words end."""
        found, at = [], 0
        while at < len(data):
            to = min(at + BYTES, len(data))
            while to < len(data) and not _SPACE[data[to]]:
                more = np.flatnonzero(_SPACE[data[to : to + BYTES]])
                to = to + int(more[0]) if len(more) else min(to + BYTES, len(data))
            found.append(self.of(data[at:to], np.array([0, to - at]))[0])
            at = to
        hashes = np.concatenate(found)
        return hashes, np.array([len(hashes)])


def shingle_sets(hashes: np.ndarray, counts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of texts given as word hashes end to end: (text, shingle), sorted.

    A text of fewer words is one shingle, one without words has none.
    """
    text = np.repeat(np.arange(len(counts)), counts)
    stop = np.repeat(np.cumsum(counts), counts)
    at = np.arange(len(hashes))
    start = at[(at + words <= stop) | (at == stop - np.repeat(counts, counts))]
    text, stop = text[start], stop[start]
    total = np.zeros(len(start), np.uint64)
    padded = np.concatenate((hashes, np.zeros(words, np.uint64)))
    for k in range(words):
        # The place is mixed in, so that order counts; words that are missing leave their place at 0.
        word = np.where(start + k < stop, padded[start + k] | np.uint64(1), np.uint64(0))
        total = scrambled(total + word * _ODD[k % 4]) + np.uint64(k)
    order = np.lexsort((total, text))
    text, total = text[order], total[order]
    new = np.ones(len(total), bool)
    new[1:] = (total[1:] != total[:-1]) | (text[1:] != text[:-1])
    return text[new], total[new]
