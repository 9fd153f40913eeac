import random
from collections import Counter, defaultdict
from itertools import combinations

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltbed.llm.byte_bpe import byte_token_counts
from siltbed.llm.packing import best_fit, best_packing, cost, downsized, packed, token_estimate
from siltbed.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def one_by_one(lengths, capacity):
    """Best-fit decreasing, piece by piece: rooms left."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        fitting = [r for r in rooms if r >= length]
        if fitting:
            rooms.remove(min(fitting))
            rooms.append(min(fitting) - length)
        else:
            rooms.append(capacity - length)
    return sorted(rooms)


def test_classes_equal_single_pieces():
    rnd = random.Random(2)
    for _ in range(60):
        top = rnd.choice([5, 30, 100])
        lengths = [min(top, 1 + int(rnd.expovariate(4 / top))) for _ in range(rnd.randrange(1, 400))]
        bins = best_fit(Counter(lengths), (top,))
        assert sorted(top - b.filled for b in bins for _ in range(b.count)) == one_by_one(lengths, top)


def test_joint_choice_is_no_dearer_than_any_single_length():
    rnd = random.Random(4)
    lengths = Counter(1 + int(rnd.expovariate(1 / 700)) % 4096 for _ in range(5000))
    def total(bins):
        return sum(b.count * cost(b.capacity) for b in bins)
    joint = best_packing(lengths, (512, 1024, 4096))
    assert total(joint) <= total(best_fit(lengths, (4096,)))
    assert Counter({length: 0 for length in lengths}) | sum((Counter({k: n * b.count}) for b in joint for k, n in b.contents), Counter()) == lengths
    assert all(b.filled <= b.capacity for b in joint)


def check(rows, wanted, capacities):
    by_doc, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        if r.n_tokens:
            bins[r.bin_id].append(r)
        else:
            assert r.bin_id is None and r.offset is None
    got = Counter()
    for doc, own in by_doc.items():
        got[doc] += sum(r.n_tokens for r in own)
    assert got == wanted
    assert sorted(bins) == list(range(len(bins)))
    for own in bins.values():
        own.sort(key=lambda r: r.offset)
        end = 0
        for r in own:
            assert r.offset == end
            end += r.n_tokens
        assert {r.capacity for r in own} == {min(c for c in capacities if c >= end)}


def test_every_piece_has_its_place(spark):
    rnd = random.Random(1)
    data = [(i % 900 if i % 97 else None, rnd.choice([0, 3, 40, 64, 100, 700, rnd.randrange(300)])) for i in range(2000)]
    data += [(5000, None), (5001, -3)]
    docs = spark.createDataFrame(data, "doc_id long, n long").withColumn("bin_id", F.lit("clash")).repartition(4)
    wanted = Counter()
    for doc, n in data:
        wanted[doc] += max(0, n or 0)
    check(packed(docs, F.col("n"), capacities=(32, 64, 128)).collect(), wanted, (32, 64, 128))


def test_registered_query_packs_the_tokens_of_the_library(spark):
    rows = QUERIES["op1_best_fit_packing"](spark, SMALL).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    counts = [len(e.ids) for e in library.encode_batch([r.text or "" for r in docs], add_special_tokens=False)]
    check(rows, Counter({r.doc_id: n for r, n in zip(docs, counts)}), (512, 1024, 2048, 4096, 8192))


def test_token_counts_of_odd_texts(spark):
    texts = [None, "", "a", "<|endoftext|>", "é" * 5, " " * 3000]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert [r.n for r in frame.select(byte_token_counts(F.col("text")).alias("n")).collect()] == wanted


def test_the_joint_choice_is_the_cheapest_of_all_choices():
    """Every choice of permitted lengths, packed piece by piece, against the choice made."""
    rnd = random.Random(9)
    for _ in range(15):
        lengths = [1 + int(rnd.expovariate(1 / 20)) % 64 for _ in range(rnd.randrange(1, 120))]
        totals = []
        for many in range(3):
            for others in combinations((8, 16, 32), many + 1):
                rooms = downsized(best_fit(Counter(lengths), (*others, 64)), (8, 16, 32, 64))
                totals.append(sum(b.count * cost(b.capacity) for b in rooms))
        chosen = sum(b.count * cost(b.capacity) for b in best_packing(Counter(lengths), (8, 16, 32, 64)))
        if max(lengths) > 32:
            assert chosen <= min(totals) + 1e-9


def test_texts_and_empty_table(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "Eins, zwei 3!"), (4, "w " * 30_000)], "doc_id long, text string")
    rows = packed(docs, token_estimate(F.col("text"))).collect()
    check(rows, Counter({1: 0, 2: 0, 3: 5, 4: 30_000}), (512, 1024, 2048, 4096, 8192))
    assert packed(docs.filter("doc_id > 9"), token_estimate(F.col("text"))).count() == 0
