import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from siltbed import storage
from siltbed.llm import jaccard_join
from siltbed.llm.bitsets import marked, may_hold
from siltbed.llm.jaccard_join import jaccard_components, may_link, signature
from siltbed.llm.shingles import shingle_sets


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1)))


def brute_force(rows, percent):
    sets = [shingles(t) for _, t in rows]
    linked = {i: set() for i in range(len(rows))}
    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, a in enumerate(sets):
        for j in {j for x in a for j in where[x] if j > i}:
            both = len(a & sets[j])
            if 100 * both >= percent * (len(a) + len(sets[j]) - both):
                linked[i].add(j)
                linked[j].add(i)
    out = []
    for i, (doc, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = linked[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((doc, len(sets[i]), doc if not sets[i] else min(ids, default=None)))
    return sorted(out, key=str)


def corpus():
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)] + ["Ä", "é!", "日本"]
    passage = [rnd.choice(vocabulary) for _ in range(30)]
    base = [[rnd.choice(vocabulary) for _ in range(rnd.choice([1, 2, 3, 4, 5, 20, 60, 150, 400]))] for _ in range(150)]
    rows = [" ".join(b) for b in base]
    for b in base:
        for _ in range(rnd.randrange(4)):
            c = list(b)
            for _ in range(rnd.randrange(1 + len(c) // 25)):
                c[rnd.randrange(len(c))] = rnd.choice(vocabulary)
            rows.append(rnd.choice([" ", "\n", " \t"]).join(c).upper())
    rows += [" ".join(passage + rnd.choices(vocabulary, k=rnd.randrange(1, 60))) for _ in range(150)]
    hot = rnd.choices(vocabulary, k=200)
    for i in range(200):
        c = list(hot)
        c[rnd.randrange(200)] = f"v{i}"
        rows.append(" ".join(c))
    rows += ["one and the same text of copies"] * 60 + [None, "", " \n", None, "x " * 20_000, "x " * 20_001]
    return [(i if i % 41 else None, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("percent,block", [(85, 512), (60, 16)])
def test_against_brute_force(spark, monkeypatch, percent, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", block)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, component_id int").repartition(4)
    got = sorted(map(tuple, jaccard_components(docs, percent=percent).collect()), key=str)
    assert got == brute_force(rows, percent)


def test_registered_query(spark):
    from siltbed.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(map(tuple, QUERIES["op2_ngram_jaccard_join"](spark, sf).collect()), key=str)
    assert got == brute_force(rows, 85)


def test_empty(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signatures_never_exclude_a_link():
    rnd = np.random.default_rng(3)
    for _ in range(300):
        a = np.unique(rnd.integers(0, 1 << 60, rnd.integers(1, 300)).astype(np.uint64))
        keep = rnd.random(len(a)) < 0.95
        b = np.unique(np.concatenate([a[keep], rnd.integers(0, 1 << 60, rnd.integers(0, 12)).astype(np.uint64)]))
        if len(b):
            both = len(np.intersect1d(a, b))
            linked = 100 * both >= 85 * (len(a) + len(b) - both)
            got = may_link(np.array([len(a)]), np.array([len(b)]), np.array([signature(a)], object), np.array([signature(b)], object), 85)
            assert got[0] or not linked


def test_shingles_and_fields(spark):
    texts = ["A b c d e", "a B c d E", None, "", " ", "a b", "a\tb", "a b c d e a b c d e", "ab cd", "a bcd"]
    sets = [tuple(s) for s in shingle_sets(pa.array(texts), 4)]
    assert [len(s) for s in sets] == [2, 2, 0, 0, 0, 1, 1, 5, 1, 1]
    assert sets[0] == sets[1] and sets[5] == sets[6] and sets[8] != sets[9]
    values = spark.range(1000).selectExpr("xxhash64(id) v")
    field = marked(values, "v", 1000)
    assert may_hold(field, np.array([r.v for r in values.collect()])).all()
    assert may_hold(field, np.random.default_rng(0).integers(-(1 << 62), 1 << 62, 10_000)).mean() < 0.15


def near_copies(many, words=60, changed=5, seed=3):
    rnd = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    out = []
    for _ in range(many):
        own = list(base)
        for at in rnd.sample(range(words), rnd.randrange(changed + 1)):
            own[at] = f"x{rnd.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_a_large_group_puts_out_rows_with_its_members():
    """2000 near copies, most pairs just below or above the threshold: neither step makes more rows than there are sets."""
    texts = near_copies(2000)
    sets = [h for h in shingle_sets(pa.array(texts), 4)]
    rows = pd.DataFrame({
        "tile": 1, "set_id": range(len(sets)), "n": [len(h) for h in sets], "component": range(len(sets)), "member": True,
        "side": 0, "signature": [jaccard_join.signature(h) for h in sets],
    })
    met = jaccard_join._with_candidates(rows, 85)
    assert len(met) <= len(rows) and met["set_id"].is_unique
    met = met.assign(hashes=[sets[i].tobytes() for i in met["set_id"]])
    links = jaccard_join._linked_in_tiles(met, 85)
    assert 0 < len(links) < len(met)
    small = near_copies(150, seed=4)
    sets = [set(h.tolist()) for h in shingle_sets(pa.array(small), 4)]
    arrays = [h for h in shingle_sets(pa.array(small), 4)]
    frame = pd.DataFrame({
        "tile": 1, "set_id": range(150), "component": range(150), "member": True, "side": 0,
        "hashes": [h.tobytes() for h in arrays],
    })
    found = jaccard_join._linked_in_tiles(frame, 85)
    wanted = [(i, j) for i in range(150) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    assert groups(150, found.itertuples(index=False, name=None)) == groups(150, wanted)


def groups(many, links):
    root = list(range(many))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(many)]


def test_large_tables_are_deleted_once_used(spark, folder, monkeypatch):
    monkeypatch.setattr(jaccard_join, "scratch_path", lambda session, label: f"{folder}/{label}")
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join([*words, "more"]), " ".join(words[::-1]), None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_components(docs, 4, 85).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3}
    left = {e.name for e in storage.visible_entries(spark, f"{folder}/jaccard")}
    assert "members" in left and not left & {"rows", "shared", "entries", "visiting", "signatures", "met", "stars0", "stars1"}
    assert not [name for name in left if name.endswith(("_wanted", "_arrays"))]
