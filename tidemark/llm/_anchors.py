"""Content-defined anchors: places that equal byte windows choose alike, so that only few suffixes need to travel.

The anchor of a window is the leftmost of the places whose next GRAM bytes hash lowest among the window's first REACH
places. It depends on nothing outside the window, so equal windows have equal anchors at equal distance. Windows in a row
with one anchor form a stretch; all of a stretch's windows hold the anchor's core, the CORE bytes from it on.
"""

from __future__ import annotations

import numpy as np

from tidemark.llm import _text

WINDOW, GRAM, REACH = 200, 16, 128
CORE = WINDOW - REACH + 1


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i : i + width]) for every i, from running minima of blocks in both directions."""
    n = len(x)
    pad = -n % width
    y = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    left = np.minimum.accumulate(y, axis=1).ravel()
    right = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def stretches(data: np.ndarray, offsets: np.ndarray, hashes: _text.Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, last window, anchor) of every stretch, as places in ``data``; rows under WINDOW bytes have none."""
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < WINDOW:
        return none, none, none, none
    bits = np.uint64(max(20, int(n).bit_length()))
    place = np.arange(n - GRAM + 1)
    key = (hashes.of(place, place + GRAM) >> bits << bits) | place.astype(np.uint64)
    anchor = (_sliding_min(key, REACH) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(size)), np.maximum(0, size - WINDOW + 1))
    if not len(row):
        return none, none, none, none
    long = np.maximum(0, size - WINDOW + 1)
    window = np.arange(len(row)) - np.repeat(np.cumsum(long) - long, long) + offsets[row]
    own = anchor[window]
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (row[1:] != row[:-1])]))
    last = np.append(new[1:], len(row)) - 1
    return row[new], window[new], window[last], own[new]
