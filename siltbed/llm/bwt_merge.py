"""Burrows-Wheeler transforms of shards of byte strings, merged by iterative interleave refinement.

The alphabet is blocks of ``stride`` bytes: the symbol before a suffix is the block of bytes that ends where it starts,
so one round of refinement extends what is known by a whole block. A shard sorts its own suffixes once. Two sorted
shards are merged by a bit for each suffix that says which shard it comes from: first all of one, then all of the
other; each round moves every suffix's predecessor to the bucket of its symbol, in the current order. After h rounds
the bits interleave by the first h blocks, and the borders between suffixes that differ there are the places where the
common prefix is shorter. No suffix of either shard is sorted again. Suffixes that stay in one interval after
length / stride rounds have ``length`` bytes in common.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SHARD_BYTES = 1 << 18
LARGEST_BLOCK = 50


def stable_order(x: np.ndarray) -> np.ndarray:
    """Stable order of non-negative 32-bit values, 16 bits at a time."""
    order = np.argsort((x & 0xFFFF).astype(np.uint16), kind="stable")
    if len(x) and int(x.max()) > 0xFFFF:
        order = order[np.argsort((x >> 16).astype(np.uint16)[order], kind="stable")]
    return order


def dense(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Ranks of rows sorted by ``order``, equal rows sharing one."""
    changed = np.zeros(len(order), bool)
    for k in keys:
        k = k[order]
        changed[1:] |= k[1:] != k[:-1]
    rank = np.empty(len(order), np.int32)
    rank[order] = np.cumsum(changed, dtype=np.int32)
    return rank


def doubled(rank: np.ndarray, end: np.ndarray, ahead: int) -> tuple[np.ndarray, np.ndarray]:
    """Order and ranks by (rank here, rank ``ahead`` places on); past the string's end comes first."""
    to = np.arange(ahead, len(rank) + ahead, dtype=np.int32)
    both = np.where(to < end, rank[np.minimum(to, len(rank) - 1)] + 1, 0).astype(np.int64)
    both += rank.astype(np.int64) * (int(rank.max(initial=0)) + 2)
    order = np.argsort(both)
    return order, dense(order, both)


@dataclass
class Shard:
    """Sorted suffixes (places in the common text), and the interval each is in once a merge has found them."""

    order: np.ndarray
    interval: np.ndarray


class Collection:
    """Strings laid out one after another, with the rank of the block that starts at each place."""

    def __init__(self, strings: list[bytes], length: int):
        self.length = length
        self.stride = max(d for d in range(1, LARGEST_BLOCK + 1) if length % d == 0)
        self.rounds = length // self.stride
        sizes = np.array([len(s) for s in strings], np.int32)
        self.ends = np.cumsum(sizes, dtype=np.int32)
        self.starts = self.ends - sizes
        self.owner = np.repeat(np.arange(len(strings), dtype=np.int32), sizes)
        self.begin, self.end = self.starts[self.owner], self.ends[self.owner]
        n, known = int(sizes.sum()), min(8, self.stride)
        padded = bytes(8).join(strings) + bytes(8)
        at = np.arange(n) + self.owner.astype(np.int64) * 8
        eight = np.ndarray((len(padded) - 7,), ">u8", padded, 0, (1,))[at].astype(np.uint64)
        eight >>= np.uint64(64 - 8 * known)
        self.block = dense(np.argsort(eight), eight)
        del at, eight
        while known < self.stride:  # ranks of longer and longer blocks, up to the stride
            more = min(2 * known, self.stride)
            self.block = doubled(self.block, self.end, more - known)[1]
            known = more

    def shard(self, first: int, last: int) -> Shard:
        """Sort the suffixes of strings first to last - 1 by their first ``length`` bytes, by doubling."""
        low, high = int(self.starts[first]), int(self.ends[last - 1])
        rank, end, done = self.block[low:high], self.end[low:high] - low, 1
        order = np.argsort(rank) if self.rounds == 1 else None
        while done < self.rounds:
            ahead = min(done, self.rounds - done)
            order, rank = doubled(rank, end, ahead * self.stride)
            done += ahead
        return Shard((order + low).astype(np.int32), rank[order])

    def before(self, shard: Shard) -> tuple[np.ndarray, np.ndarray]:
        """The shard's transform: the block before each suffix (-1 at a string's start); and the blocks of the suffixes
        that nothing follows, in order."""
        at = shard.order - self.stride
        has = at >= self.begin[shard.order]
        symbols = np.where(has, self.block[np.maximum(at, 0)], -1)
        last = shard.order + self.stride >= self.end[shard.order]
        return symbols, self.block[shard.order[last]]

    def merge(self, a: Shard, b: Shard) -> Shard:
        (before_a, last_a), (before_b, last_b) = self.before(a), self.before(b)
        n = len(a.order) + len(b.order)
        from_b = np.arange(n) >= len(a.order)
        interval = np.zeros(n, np.int32)
        head = np.concatenate([last_a, last_b])
        head_b = np.arange(len(head)) >= len(last_a)
        symbol = np.empty(n, np.int32)
        for i in range(self.rounds):
            symbol[~from_b], symbol[from_b] = before_a, before_b
            kept = symbol >= 0
            moved = np.concatenate([head, symbol[kept]])
            order = stable_order(moved)
            # At first nothing is known of what follows; later, that nothing follows is known.
            known = np.concatenate([np.full(len(head), -1 if i else 0, np.int32), interval[kept]])[order]
            from_b = np.concatenate([head_b, from_b[kept]])[order]
            moved = moved[order]
            border = np.zeros(n, np.int32)
            border[1:] = (moved[1:] != moved[:-1]) | (known[1:] != known[:-1])
            interval = np.cumsum(border, dtype=np.int32)
        order = np.empty(n, np.int32)
        order[~from_b], order[from_b] = a.order, b.order
        return Shard(order, interval)


def repeated_starts(strings: list[bytes], weights: np.ndarray, length: int) -> list[np.ndarray]:
    """For each string, whether the ``length`` bytes at each start occur twice or more among all strings, where string i
    stands for ``weights[i]`` occurrences. Strings shorter than ``length`` have no starts."""
    if not strings:
        return []
    whole = Collection(strings, length)
    per_shard = min(SHARD_BYTES, max(1, int(whole.ends[-1]) // 2))
    cuts = [0]
    for i in range(1, len(strings)):
        if whole.starts[i] - whole.starts[cuts[-1]] >= per_shard:
            cuts.append(i)
    shards = [whole.shard(i, j) for i, j in zip(cuts, [*cuts[1:], len(strings)])]
    while len(shards) > 1:
        shards = [whole.merge(*shards[i:i + 2]) if i + 1 < len(shards) else shards[i] for i in range(0, len(shards), 2)]
    order, interval = shards[0].order, shards[0].interval
    starts = order + length <= whole.end[order]
    order, interval = order[starts], interval[starts]
    if not len(order):
        return [np.zeros(0, bool) for _ in strings]
    total = np.bincount(interval, np.asarray(weights, float)[whole.owner[order]])
    found = np.zeros(int(whole.ends[-1]), bool)
    found[order] = total[interval] >= 2
    return [found[a:max(a, b - length + 1)] for a, b in zip(whole.starts.tolist(), whole.ends.tolist())]
