"""Shared reading of a word-level BPE vocabulary (``tokenizers`` JSON with an end-of-word suffix): text to words, words
to byte symbols, merge ranks. The file is read on the executors from a path given by the caller.
"""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import regex
from tokenizers import Tokenizer

from siltbed.llm.worker_memory import remembered

#: Outside these ranges (Latin, Greek, Cyrillic, punctuation, CJK) versions of Unicode may disagree.
UNCERTAIN = regex.compile(r"[^\u0000-\u00b1\u00b4-\u00b8\u00ba\u00bb\u00bf-\u052f\u1e00-\u1eff\u2000-\u206f\u20a0-\u20bf\u3040-\u30ff\u4e00-\u9fa5\uac00-\ud7a3]")

#: The usual word pattern, and the same for those ranges in a form that the faster standard matcher has.
USUAL_WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
FAST_WORD = re.compile(r"[^\W\d_]+|\d|'(?:[stmd]|re|ve|ll)|(?:[^\s\w]|_)+")
#: Two symbols as one key, and rank and merged symbol as one value.
SHIFT = 20
MASK = (1 << SHIFT) - 1


def byte_alphabet() -> list[str]:
    """The printable character each byte is written as in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names = {b: chr(b) for b in shown}
    spare = iter(range(0x100, 0x200))
    return [names.get(b) or chr(next(spare)) for b in range(256)]


@dataclass(frozen=True)
class WordVocabulary:
    tokens: dict[str, int]
    names: dict[int, str]
    merges: dict[int, int]  # left << SHIFT | right -> rank << SHIFT | merged
    specials: dict[str, int]
    suffix: str
    word: re.Pattern | regex.Pattern
    special: regex.Pattern | None
    alphabet: tuple[str, ...]
    library: Tokenizer  # only for its normal form and word borders

    def pieces(self, text: str):
        """Stretches of ordinary text and special strings of the raw text, in order, as (is_special, text)."""
        if self.special is None:
            yield False, text
            return
        at = 0
        for found in self.special.finditer(text):
            if found.start() > at:
                yield False, text[at:found.start()]
            yield True, found.group()
            at = found.end()
        if at < len(text):
            yield False, text[at:]

    def words(self, text: str) -> list[str]:
        """Words of ordinary text after its normal form and lower case, character by character without context.

        Characters whose case or class differs between versions of Unicode are left to the library's own steps.
        """
        if not text.isascii():
            if UNCERTAIN.search(text):
                normal = self.library.normalizer.normalize_str(text)
                return [normal[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(normal)]
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.word.findall(text.lower())

    def spelled(self, word: str) -> str:
        alphabet = self.alphabet
        return "".join([alphabet[b] for b in word.encode("utf-8")])

    def symbols(self, word: str) -> list[int]:
        spelled = self.spelled(word)
        found = [self.tokens.get(c) for c in spelled[:-1]]
        found.append(self.tokens.get(spelled[-1] + self.suffix))
        return [s for s in found if s is not None]


def read_vocabulary(path: str) -> WordVocabulary:
    """Read once by each worker."""
    return remembered("vocabularies", path, lambda: parse_vocabulary(path))


def parse_vocabulary(path: str) -> WordVocabulary:
    """Refuses files whose normal form, word pattern or model this module does not cover, rather than miscount."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model = spec["model"]
    steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
    split, level = spec["pre_tokenizer"]["pretokenizers"]
    plain = all(not model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    if (
        not plain
        or steps != ["NFC", "Replace", "Lowercase"]
        or (split["type"], split["behavior"], split["invert"]) != ("Split", "Removed", True)
        or (level["type"], level["add_prefix_space"], level["use_regex"]) != ("ByteLevel", False, False)
        or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"])
        or spec["post_processor"] or spec["decoder"]
    ):
        raise ValueError(f"{path} is not a word-level BPE vocabulary of the covered kind")
    tokens = model["vocab"]
    specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
    merges = {}
    for rank, (left, right) in enumerate(m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
        merges[tokens[left] << SHIFT | tokens[right]] = rank << SHIFT | tokens[left + right]
    pattern = split["pattern"]["Regex"]
    word = FAST_WORD if pattern == USUAL_WORD else regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
    by_length = sorted(specials, key=len, reverse=True)
    return WordVocabulary(
        tokens=tokens,
        names={i: t for t, i in tokens.items()} | {i: t for t, i in specials.items()},
        merges=merges,
        specials=specials,
        suffix=model["end_of_word_suffix"] or "",
        word=word,
        special=regex.compile("|".join(map(regex.escape, by_length))) if specials else None,
        alphabet=tuple(byte_alphabet()),
        library=Tokenizer.from_file(path),
    )


def public_vocabulary(name: str) -> str:
    """Where a vocabulary of the installed collection lies, on whichever machine this is called."""
    import public_tokenizers

    return public_tokenizers.path(name)


def merge_linked(symbols: list[int], merges: dict[int, int]) -> tuple[list[int], int]:
    """Merge one word's symbols by a heap over a linked list: what is left (-1 for the symbols merged away) and how
    many merges were made. A heap entry is rank and position; one whose pair has changed meanwhile is passed over."""
    n = len(symbols)
    kept, after, before, get = list(symbols), [*range(1, n), -1], list(range(-1, n - 1)), merges.get
    heap = [m >> SHIFT << 40 | i for i in range(n - 1) if (m := get(kept[i] << SHIFT | kept[i + 1])) is not None]
    heapify(heap)
    made = 0
    while heap:
        entry = heappop(heap)
        i = entry & 0xFFFFFFFFFF
        j = after[i]
        if j < 0 or kept[i] < 0:
            continue
        m = get(kept[i] << SHIFT | kept[j])
        if m is None or m >> SHIFT != entry >> 40:
            continue
        made += 1
        merged = m & MASK
        kept[i], kept[j] = merged, -1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            if (m := get(merged << SHIFT | kept[k])) is not None:
                heappush(heap, m >> SHIFT << 40 | i)
        h = before[i]
        if h >= 0 and (m := get(kept[h] << SHIFT | merged)) is not None:
            heappush(heap, m >> SHIFT << 40 | h)
    return kept, made
