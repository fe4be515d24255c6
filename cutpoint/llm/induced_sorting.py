"""Suffix arrays by induced sorting, on numpy arrays.

Suffixes are classified as smaller (S) or larger (L) than their right neighbour. The leftmost S suffixes of
each run (LMS) are sorted by their substrings, named, and sorted as a shorter text; from them the L suffixes
are induced from the left and the S suffixes from the right. A bucket (all suffixes of one first character)
is induced a layer at a time: the suffixes known so far yield their left neighbours as one array.
"""

from __future__ import annotations

import numpy as np

#: With more characters than this a text is sorted by doubling ranks: its buckets are too small for arrays.
LARGEST_ALPHABET = 1024


def _types(text: np.ndarray) -> np.ndarray:
    """True for S suffixes. The last suffix is L: what follows the end is smaller than any character."""
    n = len(text)
    different = np.flatnonzero(text[:-1] != text[1:])
    up = np.zeros(n, bool)
    if len(different):
        smaller = text[different] < text[different + 1]
        # A run of equal characters takes the type of the comparison that ends it.
        lengths = np.diff(np.concatenate(([-1], different)))
        up[: different[-1] + 1] = np.repeat(smaller, lengths)
    return up


def _append(lists: list[list[np.ndarray]], text: np.ndarray, found: np.ndarray) -> None:
    """Add positions to the buckets of their characters, order kept."""
    if not len(found):
        return
    chars = text[found]
    order = np.argsort(chars, kind="stable")
    chars, found = chars[order], found[order]
    cuts = np.flatnonzero(np.concatenate(([True], chars[1:] != chars[:-1])))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(found)]):
        lists[chars[a]].append(found[a:b])


def _induce(text: np.ndarray, size: int, lms: np.ndarray) -> np.ndarray:
    """All suffixes in order, given the LMS suffixes in order (or their substrings, given any order)."""
    nothing = np.zeros(0, np.int64)
    seeds: list[list[np.ndarray]] = [[] for _ in range(size)]
    _append(seeds, text, lms)
    low: list[list[np.ndarray]] = [[] for _ in range(size)]
    # The last suffix follows from the empty one, which is before everything.
    low[text[-1]].append(np.array([len(text) - 1]))
    left: list[np.ndarray] = []
    for c in range(size):
        done, layer = 0, low[c]
        while done < len(layer):
            front = np.concatenate(layer[done:])
            done = len(layer)
            before = front[front > 0] - 1
            chars = text[before]
            same = before[chars == c]
            if len(same):
                layer.append(same)
            _append(low, text, before[chars > c])
        left.append(np.concatenate(layer) if layer else nothing)
        if seeds[c]:
            seed = np.concatenate(seeds[c])
            before = seed[seed > 0] - 1
            _append(low, text, before[text[before] > c])
    high: list[list[np.ndarray]] = [[] for _ in range(size)]
    right: list[np.ndarray] = [nothing] * size
    for c in range(size - 1, -1, -1):
        done, layer = 0, high[c]
        while done < len(layer):
            front = np.concatenate(layer[done:])
            done = len(layer)
            before = front[front > 0] - 1
            chars = text[before]
            same = before[chars == c]
            if len(same):
                layer.append(same)
            _append(high, text, before[chars < c])
        right[c] = np.concatenate(layer)[::-1] if layer else nothing
        back = left[c][::-1]
        before = back[back > 0] - 1
        _append(high, text, before[text[before] < c])
    return np.concatenate([part for c in range(size) for part in (left[c], right[c])])


def _names(text: np.ndarray, ordered: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Names of LMS substrings given in order: equal ones share a name. ``stop``: where each one ends."""
    a, b = ordered[:-1], ordered[1:]
    length = stop[ordered] - ordered
    equal = length[:-1] == length[1:]
    active = np.flatnonzero(equal)
    k = 0
    while len(active):
        same = text[a[active] + k] == text[b[active] + k]
        equal[active[~same]] = False
        active = active[same]
        k += 1
        active = active[length[active] >= k]
        active = active[(b[active] + k < len(text)) & (a[active] + k < len(text))]
    return np.concatenate(([0], np.cumsum(~equal)))


def _by_doubling(text: np.ndarray) -> np.ndarray:
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    n, reach = len(text), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - reach] = rank[reach:] if reach < n else 0
        pair = rank * (n + 2) + after
        order = np.argsort(pair, kind="stable")
        new = np.concatenate(([1], np.cumsum(pair[order][1:] != pair[order][:-1]) + 1))
        rank[order] = new
        if new[-1] == n or reach >= n:
            return order
        reach *= 2


def suffix_array(text: np.ndarray, size: int) -> np.ndarray:
    """Positions of all suffixes of ``text`` (whole numbers below ``size``) in order."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    if size > LARGEST_ALPHABET:
        return _by_doubling(text)
    up = _types(text)
    lms = np.flatnonzero(up[1:] & ~up[:-1]) + 1
    if not len(lms):
        return _induce(text, size, lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    by_substring = _induce(text, size, lms)
    ordered = by_substring[is_lms[by_substring]]
    stop = np.zeros(n, np.int64)
    stop[lms] = np.append(lms[1:], n)
    names = _names(text, ordered, stop)
    if names[-1] + 1 < len(lms):
        name_of = np.zeros(n, np.int64)
        name_of[ordered] = names
        ordered = lms[suffix_array(name_of[lms], int(names[-1]) + 1)]
    return _induce(text, size, ordered)


def common_words(text: np.ndarray, first: np.ndarray, second: np.ndarray, length: int) -> np.ndarray:
    """Whether ``length`` bytes (a multiple of 8) from ``first`` equal those from ``second``, compared 8 at a time."""
    padded = np.concatenate((text, np.zeros(length + 8, np.uint8)))
    eight = np.ndarray((len(text) + length,), "<u8", buffer=padded.data, strides=(1,))
    equal = np.ones(len(first), bool)
    active = np.arange(len(first))
    for k in range(0, length, 8):
        same = eight[first[active] + k] == eight[second[active] + k]
        equal[active[~same]] = False
        active = active[same]
    return equal
