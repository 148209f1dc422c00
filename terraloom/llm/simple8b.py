"""Simple-8b coding of whole numbers in 64-bit words, vectorised.

A word holds a selector in its top 4 bits and a run of equally wide values in the other 60. Values that would
widen a whole run may be kept aside as escapes (position and value), with 0 in their place.
"""

from __future__ import annotations

import numpy as np

#: Values per word and bits per value of the sixteen selectors (fixed values of the format).
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
#: Widths beyond which values may be escaped; the last escapes nothing.
ESCAPE_BITS = (10, 12, 15, 20, 30, 60)
_ESCAPE_BYTES = 8
_GROUP = 16


def bit_lengths(values: np.ndarray) -> np.ndarray:
    lengths = np.zeros(len(values), dtype=np.uint8)
    rest = values.astype(np.uint64)
    while rest.any():
        lengths += rest > 0
        rest = rest >> np.uint64(1)
    return lengths


def _bit_lengths_small(values: np.ndarray) -> np.ndarray:
    return _LENGTH_16[values] if len(values) and values.max() < 1 << 16 else bit_lengths(values)


_LENGTH_16 = bit_lengths(np.arange(1 << 16))


_NARROWEST = [next(i for i in range(1, 16) if BITS[i] >= b) for b in range(61)]
_ROOM = np.array([8 / COUNTS[i] for i in _NARROWEST])


def _width_to_escape(lengths: np.ndarray) -> int:
    """The width that makes the block smallest, estimated over short groups, each as wide as its widest kept value.

    A width is not worth a look if its escapes alone take more than all values at full width do.
    """
    held = np.bincount(lengths, minlength=61)
    full = min(w for w in ESCAPE_BITS if not held[w + 1 :].any())
    bound = len(lengths) * _ROOM[full]
    widths = [w for w in ESCAPE_BITS if w < full and held[w + 1 :].sum() * _ESCAPE_BYTES < bound]
    if not widths:
        return full
    groups = np.concatenate((lengths, np.zeros(-len(lengths) % _GROUP, dtype=lengths.dtype))).reshape(-1, _GROUP)
    cost = {}
    for width in [*widths, full]:
        away = groups > width
        widest = np.where(away, 0, groups).max(axis=1, initial=0)
        cost[width] = float(_ROOM[widest].sum() * _GROUP + away.sum() * _ESCAPE_BYTES)
    return min(cost, key=lambda w: (cost[w], -w))


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, and the positions and values of the escapes, of numbers below 2**60."""
    n = len(values)
    lengths = _bit_lengths_small(values)
    width = _width_to_escape(lengths)
    away = np.flatnonzero(lengths > width)
    escaped = values[away]
    if len(away):
        values = values.copy()
        values[away] = 0
        lengths = lengths.copy()
        lengths[away] = 0
    # The longest run that starts at each value, by selector from one value to many.
    choice = np.full(n, 15, dtype=np.int64)
    for selector in range(14, -1, -1):
        count = COUNTS[selector]
        if BITS[selector] >= width:
            choice[:] = selector
            continue
        # Places of narrow values, and as many behind the end: a run is full where the next so many are in step.
        narrow = np.concatenate((np.flatnonzero(lengths <= BITS[selector]), np.arange(n, n + count)))
        full = narrow[: 1 - count][narrow[count - 1 :] - narrow[: 1 - count] == count - 1]
        full = full[full < n]
        if not len(full):
            break
        choice[full] = selector
    following = (np.arange(n) + COUNTS[choice]).tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at = following[at]
    first = np.array(starts, dtype=np.int64)
    selectors = choice[first] if n else np.zeros(0, np.int64)
    words = selectors.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate((values.astype(np.uint64), np.zeros(240, np.uint64)))
    for selector in np.flatnonzero(np.bincount(selectors, minlength=16)):
        if BITS[selector]:
            mine = np.flatnonzero(selectors == selector)
            begin, word = first[mine], words[mine]
            for k in range(COUNTS[selector]):
                word |= padded[begin + k] << np.uint64(k * BITS[selector])
            words[mine] = word
    return words, away, escaped


def unpack(words: np.ndarray, n: int, positions: np.ndarray, escaped: np.ndarray) -> np.ndarray:
    """The ``n`` numbers of a block."""
    selectors = (words >> np.uint64(60)).astype(np.uint8)
    counts = COUNTS[selectors]
    first = np.cumsum(counts) - counts
    values = np.zeros(int(counts.sum()), dtype=np.uint64)
    for selector in np.flatnonzero(np.bincount(selectors, minlength=16)):
        if BITS[selector]:
            mine = np.flatnonzero(selectors == selector)
            shifts = (np.arange(COUNTS[selector]) * BITS[selector]).astype(np.uint64)
            mask = np.uint64((1 << int(BITS[selector])) - 1)
            values[first[mine][:, None] + np.arange(COUNTS[selector])] = (words[mine][:, None] >> shifts) & mask
    values = values[:n]
    values[positions] = escaped
    return values
