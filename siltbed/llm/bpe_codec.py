"""BPE encoding and decoding by speculation.

For the distinct new words of a batch, greedy longest match proposes tokens. A proposal is the true encoding exactly if
every token is what BPE makes of its own characters and no adjacent pair would have merged across its border at some
moment; both are checked for all pairs of the batch at once with numpy. Only words that fail undergo exact merging.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.llm.word_bpe import MASK, SHIFT, WordVocabulary, merge_linked, public_vocabulary, read_vocabulary
from siltbed.llm.worker_memory import remembered

REMEMBERED_WORDS = 600_000
REMEMBERED_LENGTH = 64
SCANNED_LENGTH = 100
BATCH_TEXTS = 64
NEVER = int(np.iinfo(np.int64).max)


def merge_exactly(symbols: list[int], merges: dict[int, int]) -> list[int]:
    """Merge the lowest-ranked pair, leftmost first, until none is left; long words by the heap, short ones by scans."""
    if len(symbols) > SCANNED_LENGTH:
        return [s for s in merge_linked(symbols, merges)[0] if s >= 0]
    kept, get = list(symbols), merges.get
    found = [get(a << SHIFT | b, NEVER) for a, b in zip(kept, kept[1:])]
    while found and (least := min(found)) != NEVER:
        i = found.index(least)
        kept[i] = merged = least & MASK
        del kept[i + 1], found[i]
        if i:
            found[i - 1] = get(kept[i - 1] << SHIFT | merged, NEVER)
        if i < len(found):
            found[i] = get(merged << SHIFT | kept[i + 1], NEVER)
    return kept


class Speculator:
    """Arrays over all tokens that the vectorised checks read."""

    def __init__(self, vocabulary: WordVocabulary):
        self.vocabulary = vocabulary
        self.size = max(vocabulary.names) + 1
        self.rank = np.full(self.size, -1, np.int64)
        self.left = np.arange(self.size)
        self.right = np.arange(self.size)
        pairs = np.array([(p >> SHIFT, p & MASK, m >> SHIFT, m & MASK) for p, m in vocabulary.merges.items()], np.int64).reshape(-1, 4)
        first = pairs[np.argsort(pairs[:, 2])[::-1]]  # a token that several merges make keeps the earliest
        self.rank[first[:, 3]], self.left[first[:, 3]], self.right[first[:, 3]] = first[:, 2], first[:, 0], first[:, 1]
        order = np.argsort(pairs[:, 0] * self.size + pairs[:, 1])
        self.keys = (pairs[:, 0] * self.size + pairs[:, 1])[order]
        self.key_rank = pairs[order, 2]
        self.proposed = self._own_encodings()
        self.longest: dict[str, int] = {}  # by the first two characters
        for token in self.proposed:
            self.longest[token[:2]] = max(self.longest.get(token[:2], 0), len(token))

    def _own_encodings(self) -> dict[str, int]:
        """Tokens that may be proposed: those whose parts stand next to each other unmerged until their own merge."""
        ids = np.fromiter(self.vocabulary.tokens.values(), np.int64)
        made = self.rank[ids] >= 0
        good = ~made
        good[made] = self.compatible(self.left[ids[made]], self.right[ids[made]], self.rank[ids[made]])
        sound = np.zeros(self.size, bool)
        sound[ids] = good
        by_rank = ids[np.argsort(self.rank[ids], kind="stable")]
        for i in by_rank.tolist():  # a part that is not sound makes the whole unsound
            if self.rank[i] >= 0 and not (sound[self.left[i]] and sound[self.right[i]]):
                sound[i] = False
        return {t: i for t, i in self.vocabulary.tokens.items() if sound[i]}

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        wanted = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, wanted), max(len(self.keys) - 1, 0))
        return np.where(self.keys[at] == wanted, self.key_rank[at], NEVER) if len(self.keys) else np.full(len(a), NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether a and b stay apart (before rank ``until``), for all pairs at once.

        Goes back in time along the right edge of a and the left edge of b: of the two symbols at the border the one
        made last is taken apart, and the pair then exposed must not merge before that symbol was made. Equal ranks
        happen from left to right, so the left neighbour's merge comes first and the right neighbour's comes after.
        """
        x, y = a.copy(), b.copy()
        limit = np.full(len(x), NEVER) if until is None else until.copy()
        fine = np.ones(len(x), bool)
        open_ = np.arange(len(x))
        while len(open_):
            cx, cy = x[open_], y[open_]
            clash = self.pair_rank(cx, cy) < limit[open_]
            fine[open_[clash]] = False
            rx, ry = self.rank[cx], self.rank[cy]
            more = ~clash & (np.maximum(rx, ry) >= 0)
            open_, cx, cy, rx, ry = open_[more], cx[more], cy[more], rx[more], ry[more]
            undo_left = rx > ry
            limit[open_] = np.where(undo_left, rx, ry + 1)
            x[open_] = np.where(undo_left, self.right[cx], cx)
            y[open_] = np.where(undo_left, cy, self.left[cy])
        return fine

    def propose(self, word: str) -> list[int]:
        """Greedy longest match; nothing if a symbol is outside the vocabulary, which is left to exact merging."""
        text, get, longest, at, out = self.vocabulary.spelled(word), self.proposed.get, self.longest, 0, []
        n, full = len(text), text + self.vocabulary.suffix
        while at < n:
            reach = longest.get(full[at:at + 2], 1)
            if len(full) - at <= reach and (token := get(full[at:])) is not None:
                out.append(token)
                break
            end = min(n - 1, at + reach)
            while end > at and (token := get(text[at:end])) is None:
                end -= 1
            if end <= at:
                if at == n - 1 and (token := get(full[at:])) is not None:
                    out.append(token)
                    break
                return []
            out.append(token)
            at = end
        return out

    def encode_words(self, words: list[str]) -> list[list[int]]:
        proposals = [self.propose(w) for w in words]
        lengths = np.fromiter(map(len, proposals), np.int64, len(proposals))
        flat = np.fromiter((t for p in proposals for t in p), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(words)), lengths)
        inner = np.flatnonzero(owner[1:] == owner[:-1]) if len(flat) else np.zeros(0, np.int64)
        pairs, which = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        fine = self.compatible(pairs // self.size, pairs % self.size)
        failed = lengths == 0
        failed[owner[inner[~fine[which]]]] = True
        for i in np.flatnonzero(failed).tolist():
            proposals[i] = merge_exactly(self.vocabulary.symbols(words[i]), self.vocabulary.merges)
        return proposals


def speculator(path: str) -> Speculator:
    return remembered("speculators", path, lambda: Speculator(read_vocabulary(path)))


class Encoder:
    """Encodes texts; remembers a bounded number of short words: their written ids and their decoded form."""

    def __init__(self, path: str):
        self.spec = Speculator(read_vocabulary(path))
        self.vocabulary = self.spec.vocabulary
        self.ids: dict[str, str] = {}
        self.decoded: dict[str, str] = {}

    def render(self, word: str, ids: list[int]) -> None:
        names = self.vocabulary.names
        self.ids[word] = " ".join(map(str, ids))
        self.decoded[word] = " ".join([names[i] for i in ids])

    def encode_batch(self, texts: Iterable[str | None]) -> Iterator[tuple[int, str, str]]:
        """Of each text: number of tokens, ids joined by a space, decoded text (token strings joined by a space)."""
        cut = self.vocabulary
        pieces = [[(special, [p] if special else cut.words(p)) for special, p in cut.pieces(t or "")] for t in texts]
        if len(self.ids) > REMEMBERED_WORDS:
            self.ids.clear()
            self.decoded.clear()
        for name, i in cut.specials.items():
            self.render(name, [i])
        new: set[str] = set()
        for text in pieces:
            for special, words in text:
                if not special:
                    new.update(words)
        new -= self.ids.keys()
        words = list(new)
        for word, ids in zip(words, self.spec.encode_words(words)):
            self.render(word, ids)
        for text in pieces:
            words = text[0][1] if len(text) == 1 else [w for _, words in text for w in words]
            ids = [i for w in words if (i := self.ids[w])]
            decoded = [d for w in words if (d := self.decoded[w])]
            ids = " ".join(ids)
            yield ids.count(" ") + 1 if ids else 0, ids, " ".join(decoded)
        for word in new:
            if len(word) > REMEMBERED_LENGTH:
                del self.ids[word], self.decoded[word]

    def encode(self, texts: pd.Series) -> Iterator[tuple[int, str, str]]:
        """In small batches, so that what a batch holds stays small whatever Spark hands over at once."""
        for at in range(0, len(texts), BATCH_TEXTS):
            yield from self.encode_batch(texts.iloc[at:at + BATCH_TEXTS])


def encoder(path: str) -> Encoder:
    """One memory for all tasks that a Python worker runs."""
    return remembered("encoders", path, lambda: Encoder(path), 2)


def encode_texts(docs: DataFrame, vocabulary: str, text: str = "text", into: str = "encoding") -> DataFrame:
    """``docs`` with a struct column ``into`` (replaced where it exists): n_tokens, ids and decoded, in full.

    Null and empty texts encode to no tokens and decode to the empty string; special strings inside a text are their
    own token; repeated rows are encoded each; an empty table stays empty. No row moves between tasks.
    """

    @F.pandas_udf("n_tokens long, ids string, decoded string")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = encoder(vocabulary if "/" in vocabulary else public_vocabulary(vocabulary))
        for texts in batches:
            yield pd.DataFrame(list(own.encode(texts)), columns=["n_tokens", "ids", "decoded"]).astype(
                {"n_tokens": "int64", "ids": "str", "decoded": "str"}
            )

    return docs.withColumn(into, encoded(F.col(text)))


def encoding_digests(docs: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """As :func:`encode_texts`, but with only n_tokens, ids_sha256 and decoded_sha256, so long texts don't travel back."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digested(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = encoder(vocabulary if "/" in vocabulary else public_vocabulary(vocabulary))
        for texts in batches:
            rows = [
                (n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                for n, ids, decoded in own.encode(texts)
            ]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"]).astype({"n_tokens": "int64"})

    out = docs.withColumn("_digest", digested(F.col(text)))
    return out.withColumns({c: F.col(f"_digest.{c}") for c in ("n_tokens", "ids_sha256", "decoded_sha256")}).drop("_digest")
