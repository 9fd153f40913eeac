"""Counting and encoding against the tokenizers library."""

import hashlib
import random

import pytest
from tokenizers import Tokenizer

from siltbed.llm.bpe_codec import encode_texts, encoding_digests
from siltbed.llm.token_counts import with_token_counts
from siltbed.llm.word_bpe import public_vocabulary

VOCABULARY = "word_bpe_49k.json"


def texts():
    rnd = random.Random(3)
    ranges = [(32, 127), (0xA0, 0x250), (0x370, 0x600), (0x900, 0x3100), (0x4E00, 0x5000), (0xE000, 0x11000)]
    odd = ["".join(chr(rnd.randrange(*rnd.choice(ranges))) for _ in range(rnd.randrange(1, 50))) for _ in range(400)]
    plain = ["".join(rnd.choice("aeinorstlhdc ' ") for _ in range(rnd.randrange(1, 60))) for _ in range(300)]
    fixed = [None, "", " \n\t", "a" * 5000, "ab" * 4000 + "!", "<|endoftext|>x<|startoftext|><|endoftext|>",
             "I'LL don't 'S", "ΣΑΣ ΟΔΟΣ", "x" * 100 + " " * 200 + "y", "same", "same", "🙂👩‍👩‍👧 naïve"]
    return fixed + odd + plain


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)


def test_against_the_library(docs):
    library = Tokenizer.from_file(public_vocabulary(VOCABULARY))
    counted = {r.doc_id: r.n_tokens for r in with_token_counts(docs, VOCABULARY).collect()}
    encoded = {r.doc_id: r.encoding for r in encode_texts(docs, VOCABULARY).collect()}
    digests = {r.doc_id: r for r in encoding_digests(docs, VOCABULARY).collect()}
    for i, text in enumerate(texts()):
        want = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(want, skip_special_tokens=False)
        assert counted[i] == len(want)
        assert (encoded[i].n_tokens, encoded[i].ids, encoded[i].decoded) == (len(want), " ".join(map(str, want)), decoded)
        assert digests[i].n_tokens == len(want)
        assert digests[i].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_empty_table_and_null_id(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert with_token_counts(empty, VOCABULARY).count() == 0
    assert encoding_digests(empty, VOCABULARY).count() == 0
    row = with_token_counts(spark.createDataFrame([(None, "two words")], "doc_id long, text string"), VOCABULARY).first()
    assert (row.doc_id, row.n_tokens) == (None, 2)


def test_other_kinds_of_vocabulary_are_refused():
    from siltbed.llm.word_bpe import read_vocabulary

    with pytest.raises((ValueError, KeyError, TypeError)):
        read_vocabulary(public_vocabulary("byte_bpe_50k.json"))
