"""Content-defined anchors of fixed-length windows over sequences.

The anchor of a window is its leftmost smallest gram, by hash. Equal windows have
equal anchors at equal places, so windows need comparing only where an anchor
recurs. Consecutive windows with one anchor form a run; two runs with the same
content have the same context hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from riskmon.llm.words import mix, powers

PIECE = 1 << 20
LOW = np.uint64((1 << 24) - 1)


def prefix_sums(values: np.ndarray) -> np.ndarray:
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of the values first..last-1 of each span, whatever its place."""
    _, down = powers(len(sums))
    return mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours."""
    out, span = keys, 1
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _runs(values: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    n = len(values)
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    sums = prefix_sums(values)
    grams = mix((sums[gram:] - sums[:-gram]) * powers(n + 1)[1][: n - gram + 1])
    keys = (grams & ~LOW) | np.arange(len(grams), dtype=np.uint64)
    at = (sliding_least(keys, length - gram + 1) & LOW).astype(np.int64)
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)[: len(at)]
    whole = np.flatnonzero(np.arange(len(at)) + length <= bounds[1:][owner])
    if not len(whole):
        return _runs(values[:0], bounds, length, gram)
    at, owner = at[whole], owner[whole]
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1]))))
    end = np.concatenate((new[1:], [len(at)])) - 1
    lo, hi, own = whole[new], whole[end], owner[new]
    context = span_hashes(sums, lo, hi + length) ^ mix((at[new] - lo).astype(np.uint64))
    return own, grams[at[new]], context, lo - bounds[own], hi - bounds[own]


def runs(values: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(owner, anchor hash, context hash, first window, last window) arrays of all sequences.

    Sequence i holds values[bounds[i]:bounds[i+1]]. Long ones are taken in
    overlapping pieces, where a run may end early.
    """
    i, count = 0, len(bounds) - 1
    while i < count:
        j = i + 1
        if bounds[j] - bounds[i] > PIECE:
            for at in range(int(bounds[i]), int(bounds[j]) - length + 1, PIECE):
                end = min(at + PIECE + length - 1, int(bounds[j]))
                own, h, c, lo, hi = _runs(values[at:end], np.array([0, end - at]), length, gram)
                yield own + i, h, c, lo + (at - bounds[i]), hi + (at - bounds[i])
        else:
            while j < count and bounds[j + 1] - bounds[i] <= PIECE:
                j += 1
            own, h, c, lo, hi = _runs(values[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], length, gram)
            yield own + i, h, c, lo, hi
        i = j


def cover(n: int, windows: list[tuple[int, int]], length: int) -> np.ndarray:
    """Which of n places lie in a window that starts in one of the ranges lo..hi."""
    change = np.zeros(n + 1, np.int64)
    for lo, hi in windows:
        change[lo] += 1
        change[min(hi + length, n)] -= 1
    return np.cumsum(change[:-1]) > 0
