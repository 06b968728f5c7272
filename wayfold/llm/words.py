"""Words of many texts as 64-bit hashes, found with numpy over the UTF-8 bytes."""

from __future__ import annotations

import numpy as np

from . import common

_PLACES = common.mix64(np.arange(5001, 5257)) | np.uint64(1)
_VALUES = common.mix64(np.arange(9001, 9257)) | np.uint64(1)

#: Byte to byte, 0 for what parts words: white space only.
BLANKS = np.arange(256, dtype=np.uint8)
BLANKS[[*range(9, 14), *range(28, 33)]] = 0
#: ASCII letters in lower case and all that isn't ASCII; the rest parts words.
LETTERS = np.zeros(256, np.uint8)
LETTERS[97:123], LETTERS[65:91], LETTERS[128:] = np.arange(97, 123), np.arange(97, 123), np.arange(128, 256)
#: As LETTERS, with digits: words whatever their case and the marks around them.
WORDS = LETTERS.copy()
WORDS[48:58] = np.arange(48, 58)
#: Bytes looked through at once.
STRETCH = 4 << 20


def _stretch(d: np.ndarray, edges: np.ndarray, most: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(first places, hashes) of the words in ``d``, whose blanks are 0; a word begins anew at each of ``edges``, and only its first ``most`` bytes count."""
    inside = d != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    place = np.arange(len(d)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(d)]])))
    # a word's length sets apart what a wrap of places would not; blanks add nothing
    if most is not None:
        inside &= place < most
    value = np.where(inside, _VALUES[d] * _PLACES[place & 255], np.uint64(0))
    size = np.add.reduceat(inside.astype(np.int64), starts)
    return starts, common.mix64(np.add.reduceat(value, starts) + common.mix64(size))


def word_hashes(data: np.ndarray, at: np.ndarray, table: np.ndarray = BLANKS, stretch: int = STRETCH, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the words of text i are hashes[offsets[i]:offsets[i + 1]], in order; of each its first ``most`` bytes, if that is given.

    Bytes are looked through in stretches that end at a blank or between texts, so that what a long text takes beside its words is bounded; only a single
    word longer than a stretch lengthens it.
    """
    starts: list[np.ndarray] = [np.zeros(0, np.int64)]
    hashes: list[np.ndarray] = [np.zeros(0, np.uint64)]
    a, end = int(at[0]), int(at[-1])
    while a < end:
        z = min(end, a + stretch)
        if z < end:
            blank = np.flatnonzero(table[data[a:z]] == 0)
            if len(blank):
                z = a + int(blank[-1]) + 1
            else:
                blank = next((k + int(x[0]) for k in range(z, end, stretch) if len(x := np.flatnonzero(table[data[k : min(end, k + stretch)]] == 0))), end - 1)
                z = blank + 1
        i, j = np.searchsorted(at, [a, z])
        first, h = _stretch(table[data[a:z]], at[i:j] - a, most)
        starts.append(first + a)
        hashes.append(h)
        a = z
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), at, side="left").astype(np.int64)
