"""Content-defined anchors of byte texts: every window of a text has one, and equal windows have it at the same place.

The anchor of a window is the leftmost of its grams with the least hash. Windows of one anchor are neighbours, so an anchor
stands for the run of windows [first, last] that have it.
"""

from __future__ import annotations

import numpy as np

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * _A
    h += b
    h ^= h >> np.uint64(29)
    h *= _B
    h ^= h >> np.uint64(32)
    return h


def _wider(h: np.ndarray, step: int) -> np.ndarray:
    """Hashes of twice the length, or of any up to it, from hashes at i and i + step."""
    return _mix(h[:-step], h[step:]) if len(h) > step else h[:0]


def anchors(joined: np.ndarray, starts: np.ndarray, window: int, gram: int):
    """Of texts joined as bytes, text k from starts[k] to starts[k + 1]: arrays text, at, first, last, gram hash, span hash.

    at: place of the anchor; first, last: starts of its first and last window, all within the text; the span hash is of the
    bytes from the first window's start to the last one's end. gram is 32; window from 64 to 128.
    """
    if gram != 32 or not 64 <= window <= 128:
        raise ValueError("grams have 32 bytes, windows 64 to 128")
    n = len(joined)
    empty = np.zeros(0, np.int64)
    if n < window:
        return empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    h = (joined.astype(np.uint64) + np.uint64(1)) * _C
    for step in (1, 2, 4, 8, 16):
        h = _wider(h, step)
    grams = h
    h64 = _wider(h, 32)
    # the place in the low bits makes the leftmost of equal grams the least
    bits = np.uint64(max(1, int(n).bit_length()))
    low = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    reach, span = window - gram + 1, 1
    while 2 * span <= reach:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < reach:
        low = np.minimum(low[: len(low) - (reach - span)], low[reach - span :])
    place = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    sizes = np.diff(starts)
    text = np.repeat(np.arange(len(sizes)), np.maximum(sizes - window + 1, 0))
    shift = starts[:-1] - np.concatenate(([0], np.cumsum(np.maximum(sizes - window + 1, 0))[:-1]))
    own = np.arange(len(text)) + shift[text]
    place = place[own]
    edge = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (text[1:] != text[:-1]))))
    if not len(own):
        edge = edge[:0]
    first, last = own[edge], own[np.concatenate((edge[1:], [len(own)])) - 1] if len(edge) else empty
    at, text = place[edge], text[edge]
    over = window - 64
    whole = lambda i: _mix(h64[i], h64[i + over])
    spans = _mix(_mix(whole(first), whole(last)), (last - first).astype(np.uint64))
    return text, at, first, last, grams[at], spans


def window_hashes(joined: np.ndarray, window: int) -> np.ndarray:
    """Of every window of the bytes; window from 64 to 128."""
    h = (joined.astype(np.uint64) + np.uint64(1)) * _C
    for step in (1, 2, 4, 8, 16, 32):
        h = _wider(h, step)
    return _mix(h[: len(h) - (window - 64)], h[window - 64 :]) if len(joined) >= window else h[:0]
