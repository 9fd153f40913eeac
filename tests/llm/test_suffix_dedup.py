import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from siltbed import storage
from siltbed.llm import bwt_merge, suffix_dedup
from siltbed.llm.anchors import sliding_least, stretches
from siltbed.llm.bwt_merge import repeated_starts
from siltbed.llm.suffix_dedup import without_repeats


def brute_force(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(hashlib.md5(d[i:i + length]).digest() for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[hashlib.md5(d[i:i + length]).digest()] > 1:
                gone[i:i + length] = b"\x01" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((runs, bytes(b for b, g in zip(d, gone) if not g)))
    return out


def corpus():
    rnd = random.Random(8)
    letters = "abcdefgh éü日 \n"
    words = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    passages = [words(rnd.choice([350, 420, 600, 1500])) for _ in range(12)]
    texts = [words(rnd.randrange(50, 2500)) for _ in range(60)]
    texts += [words(rnd.randrange(300)) + rnd.choice(passages) + words(rnd.randrange(300)) for _ in range(80)]
    texts += [passages[0][:430] + words(5) + passages[1] + passages[1]]
    texts += [None, "", "a" * 3000, "ab" * 700, "a" * 399, "copy " * 30, "copy " * 30, "same text " * 60, "same text " * 60]
    texts += ["\0" * 900, "x" + "\0" * 500]
    near = words(1200)
    for i in range(40):
        at = rnd.randrange(1200)
        texts.append(near[:at] + "#" + near[at + 1:])
    return texts


@pytest.mark.parametrize("hot,length", [(2048, 400), (3, 400), (2048, 210)])
def test_against_brute_force(spark, monkeypatch, hot, length):
    monkeypatch.setattr(suffix_dedup, "HOT_STRETCHES", hot)
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 20_000)
    monkeypatch.setattr(bwt_merge, "SHARD_BYTES", 4_000)
    texts = corpus()
    docs = spark.createDataFrame([(i if i % 7 else None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    docs = docs.withColumn("i", docs["spans"]).repartition(3)
    want = brute_force(texts, length)
    got = {r.i: r for r in without_repeats(docs, length=length).collect()}
    assert len(got) == len(texts)
    for i, (n_spans, kept) in enumerate(want):
        assert (len(got[i].spans), bytes(got[i].kept_bytes)) == (n_spans, kept), i
        assert sum(s.end - s.first for s in got[i].spans) == len((texts[i] or "").encode()) - len(kept)


def test_copies_of_a_text_meet_once(spark, monkeypatch):
    real = suffix_dedup.merged_runs

    def strict(stretch, counts, length):
        assert not stretch.duplicated(["anchor", "whole"]).any()
        return real(stretch, counts, length)

    monkeypatch.setattr(suffix_dedup, "merged_runs", strict)
    rnd = random.Random(3)
    text = "".join(rnd.choice("abcdefgh \n") for _ in range(3000))
    texts = [text[:at] + "#" + text[at + 1:] for at in (300, 900, 1500, 2900)] * 80 + [text] * 80
    docs = spark.createDataFrame(list(enumerate(texts)), "i long, text string").repartition(6)
    got = {r.i: (len(r.spans), bytes(r.kept_bytes)) for r in without_repeats(docs).collect()}
    assert got == dict(enumerate(brute_force(texts, 400)))


def test_merge_alone(monkeypatch):
    monkeypatch.setattr(bwt_merge, "SHARD_BYTES", 60)
    rnd = random.Random(5)
    for length in (4, 12, 30, 7):
        for _ in range(30):
            strings = [bytes(rnd.choices(b"ab\0", k=rnd.randrange(1, 60))) for _ in range(rnd.randrange(1, 15))]
            weights = [rnd.choice([1, 1, 2]) for _ in strings]
            seen = Counter()
            for s, w in zip(strings, weights):
                for i in range(len(s) - length + 1):
                    seen[s[i:i + length]] += w
            want = [[seen[s[i:i + length]] > 1 for i in range(len(s) - length + 1)] for s in strings]
            assert [f.tolist() for f in repeated_starts(strings, np.array(weights), length)] == want


def test_stretches():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 50, 1000).astype(np.uint64)
    assert (sliding_least(x, 37) == np.lib.stride_tricks.sliding_window_view(x, 37).min(1)).all()
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    anchor, whole, first, windows = stretches(data, 400)
    assert first[0] == 0 and (first[1:] == first[:-1] + windows[:-1]).all() and first[-1] + windows[-1] == 4601
    shifted = stretches(np.concatenate([rng.integers(97, 100, 77).astype(np.uint8), data]), 400)
    assert set(anchor[1:]) <= set(shifted[0]) and set(whole[1:]) <= set(shifted[1])
    assert not len(stretches(data[:399], 400)[0])


def test_empty(spark):
    assert without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_only_the_spans_stay_on_disk(spark, folder, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "scratch_path", lambda session, label: f"{folder}/{label}")
    text = "".join(chr(97 + i * i % 23) + str(i) for i in range(60))
    docs = spark.createDataFrame([(1, text + "x" * 60), (2, "y" + text), (3, "z" * 90)], "doc_id long, text string")
    out = suffix_dedup.without_repeats(docs, length=40).selectExpr("doc_id", "size(spans) AS n").collect()
    assert {r.doc_id: r.n for r in out} == {1: 1, 2: 1, 3: 1}
    assert [e.name for e in storage.visible_entries(spark, f"{folder}/suffixes")] == ["spans"]
