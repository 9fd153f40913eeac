"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a word form a doubly linked list; a heap holds the adjacent pairs that can merge, lowest rank and then
leftmost first. Each merge removes one symbol, so a word's count is its initial symbols minus its merges; identifiers
are never produced. Words repeat, so each Python worker remembers counts of a bounded number of short words.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.llm.word_bpe import WordVocabulary, merge_linked, public_vocabulary, read_vocabulary
from siltbed.llm.worker_memory import remembered

REMEMBERED_WORDS = 1_000_000
REMEMBERED_LENGTH = 64


class WordCounts(dict):
    """Tokens by word, filled on demand."""

    def __init__(self, vocabulary: WordVocabulary):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> int:
        symbols = self.vocabulary.symbols(word)
        count = len(symbols) - merge_linked(symbols, self.vocabulary.merges)[1]
        if len(word) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED_WORDS:
                self.clear()
            self[word] = count
        return count


def word_counts(path: str) -> WordCounts:
    """One memory for all tasks that a Python worker runs."""
    return remembered("word counts", path, lambda: WordCounts(read_vocabulary(path)), 2)


def count_tokens(text: str | None, counts: WordCounts) -> int:
    if not text:
        return 0
    vocabulary, total = counts.vocabulary, 0
    for is_special, piece in vocabulary.pieces(text):
        total += 1 if is_special else sum(map(counts.__getitem__, vocabulary.words(piece)))
    return total


def with_token_counts(
    docs: DataFrame, vocabulary: str, text: str = "text", into: str = "n_tokens"
) -> DataFrame:
    """``docs`` with the number of tokens of each whole text in column ``into`` (replaced where it exists).

    ``vocabulary`` names a file of the installed collection or, with a slash, a path on every executor. Null and empty
    texts count 0; special strings inside a text count 1 each; repeated rows are counted each; an empty table stays
    empty. Rows never move between tasks, so a hot source or a group of copies costs no more than other rows.
    """

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counts = word_counts(vocabulary if "/" in vocabulary else public_vocabulary(vocabulary))
        for texts in batches:
            yield pd.Series([count_tokens(t, counts) for t in texts], dtype="int64")

    return docs.withColumn(into, counted(F.col(text)))
