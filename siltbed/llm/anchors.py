"""Stretches of a text whose windows share an anchor.

The anchor of a window of ``length`` bytes is its run of a third of them with the smallest hash (the first of equals).
It depends on the window's bytes alone, so equal windows have equal anchors at the same place in the window, wherever
they stand. Neighbouring windows mostly share their anchor; such a stretch of window starts is one row.
"""

from __future__ import annotations

import numpy as np

from siltbed.llm.shingles import _powers, mixed

PIECE = 1 << 18  # bytes hashed at once; longer texts are taken in pieces that overlap by a window less one byte
_PLACE_BITS = 26
_VALUES = mixed(np.arange(1000, 1256).astype(np.uint64))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by minima from both ends of blocks."""
    n = len(x)
    pad = -n % width
    blocks = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def window_hashes(data: np.ndarray, length: int, seed: int) -> np.ndarray:
    """A hash of the bytes of every window of ``length``; hashes of different seeds are independent."""
    n = len(data)
    if n < length:
        return np.zeros(0, np.uint64)
    up, down = _powers(1 << max(12, n.bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mixed(_VALUES + np.uint64(seed))[data] * up[:n], out=sums[1:])
    return mixed((sums[length:] - sums[:-length]) * down[:n - length + 1])


def stretches(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of one text's bytes: anchor hash, hash of the stretch's bytes, first window start, number of windows."""
    found = []
    anchor = max(1, length // 3)
    for at in range(0, max(1, len(data) - length + 1), PIECE):
        piece = data[at:at + PIECE + length - 1]
        if len(piece) < length:
            break
        n = len(piece)
        up, down = _powers(1 << max(12, n.bit_length()))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUES[piece] * up[:n], out=sums[1:])
        anchors = mixed((sums[anchor:] - sums[:-anchor]) * down[:n - anchor + 1])
        packed = anchors >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS) | np.arange(len(anchors), dtype=np.uint64)
        place = sliding_least(packed, length - anchor + 1) & np.uint64((1 << _PLACE_BITS) - 1)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        many = np.diff(np.append(first, len(place)))
        end = first + many + length - 1
        whole = mixed((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64))
        found.append((anchors[place[first].astype(np.int64)], whole, first + at, many))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found))
