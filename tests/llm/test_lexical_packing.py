import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltbed.llm import lexical_packing
from siltbed.llm.byte_bpe import ByteEncoder
from siltbed.llm.lexical_packing import Index, Packer, Rest, lexically_packed, statistics
from siltbed.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_identifiers_equal_the_library(library):
    ours = ByteEncoder()
    texts = pq.read_table(f"{SMALL}/documents.parquet")["text"].to_pylist()
    texts += ["", " ", "\n\n", "a  b", "x" * 5000, " " * 5000 + "x", "I'll don't 'S's", "<|endoftext|> \n<|endoftext|>a <|endoftext|>"]
    for first in range(0, 0x110000, 997):  # some characters of every block, in several places
        chars = [chr(c) for c in range(first, min(first + 997, 0x110000), 31) if not 0xD800 <= c < 0xE000]
        texts += ["".join(f"a{c}1 {c}{c} b\n{c} {c}2!{c}'s " for c in chars)]
    for text, wanted in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert ours(text).tolist() == wanted.ids


def check(rows, docs, library, window=1024):
    """``docs``: (id, text); ids are distinct."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert len(by_doc) == len(docs)
    for doc, text in docs:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window and at & (at - 1) == 0
    return by_sequence


def test_registered_query_packs_every_token_once(spark, library):
    rows = QUERIES["op13_lexical_packing"](spark, SMALL).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    sequences = check(rows, docs, library)
    tokens = sum(r.length for r in rows)
    assert len(sequences) <= tokens // 1024 + 4 * 11  # full windows, and at most eleven short ones for each task


def test_nulls_copies_and_clashing_columns(spark, library, monkeypatch):
    monkeypatch.setattr(lexical_packing, "SHARD_RESTS", 50)
    rnd = random.Random(8)
    words = ["river", "stone", "Licht", "über", "1984", "zoom", "and", "\n"]
    texts = [None, "", " ", "<|endoftext|>", "same text " * 60, "long " * 9000]
    texts += ["same text " * 60] * 300 + [" ".join(rnd.choices(words, k=rnd.randrange(400))) for _ in range(300)]
    docs = list(enumerate(texts, -3))
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rest", F.lit("clash")).withColumn("start", F.lit(1))
    check(lexically_packed(frame.repartition(3)).collect(), docs, library)
    assert lexically_packed(frame.filter("doc_id > 99999")).count() == 0


def test_repeated_rows_and_null_ids_are_packed_each(spark):
    frame = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "three"), (None, None)], "doc_id int, text string")
    rows = lexically_packed(frame).collect()
    assert sorted(sum(r.length for r in rows if r.doc_id == d) for d in (1, None)) == [3, 6] and len(rows) >= 4


def brute_scores(rests, corpus, seed):
    out = []
    for other in rests:
        score = 0.0
        for term in set(rests[seed].ids.tolist()):
            times = other.ids.tolist().count(term)
            if times:
                score += corpus.weights(np.array([term]), np.array([times]), np.array([float(len(other.ids))]))[0]
        out.append(score)
    return out


def test_index_scores_and_windows_equal_brute_force():
    random = np.random.default_rng(3)
    window = 16
    lists = [random.integers(1, 25, size=random.integers(1, window)).astype("<u2") for _ in range(60)]
    counts = np.bincount(np.concatenate([np.unique(x) for x in lists]), minlength=30)
    corpus = statistics(enumerate(counts.tolist()), len(lists), float(np.mean([len(x) for x in lists])))
    rests = [Rest(i, 0, len(x), x) for i, x in enumerate(lists)]
    index = Index(rests, corpus)
    scores = [index.scores(i) for i in range(len(rests))]
    for i in range(len(rests)):
        assert np.allclose(scores[i], brute_scores(rests, corpus, i))

    packer = Packer(corpus, 0, window)
    left = packer.pack(rests)
    packer.finish(left)
    sequences = defaultdict(list)
    for doc, start, length, _, _, sequence, offset, score in packer.pieces:
        sequences[sequence].append((offset, doc, start, length, score))
    unused = [len(x) for x in lists]
    for _, pieces in sorted(sequences.items()):
        pieces.sort()
        seed = pieces[0][1]
        if sum(p[3] for p in pieces) < window:
            continue  # what is left at the end
        others = [p[1] for p in pieces[1:]]
        wanted = sorted((d for d in range(len(lists)) if unused[d] and d != seed), key=lambda d: (-scores[seed][d], d))
        assert others == wanted[:len(others)]  # the best unused neighbours, in order
        assert all(abs(score - scores[seed][d]) < 1e-9 for _, d, _, _, score in pieces[1:])
        for _, doc, _, length, _ in pieces:
            unused[doc] -= length
    assert sum(p[2] for p in packer.pieces) == sum(map(len, lists))
