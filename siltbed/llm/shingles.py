"""Sets of word shingles of many texts at once, as sorted 64-bit hashes, with numpy over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from siltbed.llm.worker_memory import remembered

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = x + _ODD
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _byte_values() -> tuple[np.ndarray, np.ndarray]:
    """A random value for each byte (upper-case ASCII letters as their lower case), and which bytes separate words."""
    lower = np.arange(256)
    lower[65:91] += 32
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    return mixed(lower.astype(np.uint64)), space


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    base, inverse = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)
    up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of a byte array; bytes 9 to 13 and 32 separate words."""
    values, space = remembered("byte values", 0, _byte_values)
    gap = space[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True]))))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    size = 1 << max(16, int(len(data)).bit_length())
    up, down = remembered("powers", size, lambda: _powers(size))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[:len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of every run of ``width`` words; of the whole sequence if it is shorter (but not empty)."""
    n = len(words)
    if n == 0:
        return words
    take = min(width, n)
    out = np.full(n - take + 1, np.uint64(take))
    for j in range(take):
        out = mixed(out * _ODD + words[j:n - take + 1 + j])
    return out


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of an Arrow string array; empty for null and blank texts."""
    for text in texts:
        data = np.frombuffer(text.as_buffer() or b"", np.uint8) if text.is_valid else np.zeros(0, np.uint8)
        yield np.unique(shingle_hashes(word_hashes(data)[0], width))
