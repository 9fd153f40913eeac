import random
import zlib
from collections import defaultdict

import xxhash

from siltbed.llm.sharding import Range, Walk, sharded


def rows():
    texts = [None, "", "a", "ä" * 40, "x" * 50_000] + ["copy of one text"] * 300 + [f"text {i} " * (i % 37) for i in range(700)]
    return [(i if i % 50 else None, t, "clash") for i, t in enumerate(texts)]


def brute_force(sizes: list[int], shards: int) -> int:
    def needs(capacity):
        n, room = 1, capacity
        for s in sizes:
            if s > room:
                n, room = n + 1, capacity
            room -= s
        return n

    return next(c for c in range(max(max(sizes), -(-sum(sizes) // shards)), sum(sizes) + 1) if needs(c) <= shards)


def test_against_brute_force(spark):
    for many, shards in ((1005, 24), (400, 7), (30, 24), (1005, 1)):
        data = rows()[-many:]
        docs = spark.createDataFrame(data, "doc_id long, text string, shard string").repartition(4)
        got = sharded(docs, shards).collect()
        want = sorted((i or -1, len((t or "").encode()) + 8, None if t is None else zlib.crc32(t.encode())) for i, t, _ in data)
        assert sorted(((r.doc_id or -1, r.size, r.text_crc32) for r in got), key=str) == sorted(want, key=str)
        groups = defaultdict(int)
        for _, t, _ in data:
            key = 42 if t is None else xxhash.xxh64_intdigest(t.encode(), 42)
            groups[key & (1 << 63) - 1] += len((t or "").encode()) + 8
        by_shard, slots, where = defaultdict(int), defaultdict(list), defaultdict(set)
        for r in got:
            by_shard[r.shard] += r.size
            slots[r.shard].append(r.slot)
            where[r.text_crc32].add(r.shard)
        assert max(by_shard.values()) == brute_force([w for _, w in sorted(groups.items())], shards)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert all(len(s) == 1 for s in where.values()) and max(by_shard) < shards


def test_no_shard_is_empty_beside_a_hot_text(spark):
    """A third of the rows are one text: one shard holds it, the others share the rest nearly equally."""
    data = [(i, "hot text " * 20 if i % 3 == 0 else f"text {i} " * 20) for i in range(3000)]
    got = sharded(spark.createDataFrame(data, "doc_id long, text string").repartition(4), 24).collect()
    sizes = defaultdict(int)
    for r in got:
        sizes[r.shard] += r.size
    hot = next(r.shard for r in got if r.doc_id == 0)
    assert sorted(sizes) == list(range(24))
    others = [size for shard, size in sizes.items() if shard != hot]
    assert max(others) < 1.35 * sum(others) / 23 and min(others) > 0.6 * sum(others) / 23


def test_shards_are_nearly_equal(spark):
    data = [(i, f"text {i} " * (5 + i % 9)) for i in range(5000)]
    sizes = defaultdict(int)
    for r in sharded(spark.createDataFrame(data, "doc_id long, text string").repartition(4), 24).collect():
        sizes[r.shard] += r.size
    assert len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) < 0.02 * sum(sizes.values()) / 24


def test_balanced_cuts_keep_the_capacity():
    rnd = random.Random(6)
    for _ in range(300):
        weights = [rnd.choice([1, 2, 3, rnd.randrange(1, 200)]) for _ in range(rnd.randrange(1, 60))]
        shards = rnd.randrange(1, 12)
        walk = Walk([Range(i, 0, w, 1) for i, w in enumerate(weights)], shards)
        capacity = brute_force(weights, shards)
        cuts = walk.balanced(capacity)
        assert cuts[-1] == sum(weights) and cuts == sorted(cuts) and set(cuts) <= {0, *walk.ends}
        assert max(b - a for a, b in zip([0, *cuts], cuts)) <= capacity


def test_empty(spark):
    assert sharded(spark.createDataFrame([], "doc_id long, text string")).count() == 0
