"""Hash codes of all words of many texts at once."""

from __future__ import annotations

import numpy as np

from .common import BYTE_VALUES, powers, sized_slices

#: Bytes whose words are hashed at once.
SLICE = 2 << 20
#: White space, and bytes with A-Z lowered.
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _codes(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, begin) of every word; no word goes across ``cuts``."""
    inside = ~_SPACE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cut = cuts[(cuts > 0) & (cuts < len(data))]
    before[cut], after[cut - 1] = False, False
    begin, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[_LOWER[data]] * down[: len(data)], out=sums[1:])
    return mixed((sums[end] - sums[begin]) * up[begin] + (end - begin).astype(np.uint64)), begin


def word_codes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit code of every word of the texts in ``data``, A-Z lowered, and each text's first word (n + 1 offsets).

    Words are runs of bytes other than x20 and x09-x0D. A code is a polynomial of a random number for each byte, so all
    words are hashed at once; it depends on the word alone. Two words of a billion share one in about 3 % of corpora, or
    if made for it, of over 1000 bytes. A text of more than SLICE bytes is taken in pieces that end at white space.
    """
    codes, first, n = [], [np.zeros(1, np.int64)], 0
    for a, b in sized_slices(bounds, SLICE):
        at, stop = int(bounds[a]), int(bounds[b])
        cuts = bounds[a + 1 : b + 1]
        counted = np.zeros(len(cuts), np.int64)  # words before each cut
        while at < stop:
            end = min(stop, at + SLICE)
            if end < stop:  # only in a single long text
                there = np.flatnonzero(_SPACE[data[end:stop]])
                end = end + int(there[0]) if len(there) else stop
            code, begin = _codes(data[at:end], cuts - at)
            counted += np.searchsorted(begin, cuts - at)
            codes.append(code)
            at = end
        first.append(n + counted)
        n += int(counted[-1])
    return np.concatenate(codes) if codes else np.zeros(0, np.uint64), np.concatenate(first)
