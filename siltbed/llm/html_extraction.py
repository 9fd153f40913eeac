"""Main text of web pages by a recurrent block labeller.

A page is read into its leaf blocks: runs of text between block-level tags, each with the path of open tags and their
class and id words. A bidirectional LSTM in numpy reads the blocks of the whole page in order, each as a hashed vector
of its path, a hashed vector of its words and a few measures, and labels every block as main text or not. It is trained
when the query runs, on a bounded sample of the given pages and on copies of them with menus, sidebars, notices, forms
and comments put in, with labels that follow from the markup of the sample and of what was put in.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.llm.shingles import word_hashes
from siltbed.llm.worker_memory import remembered

#: Pages learned from, in expectation; chosen by a hash of the page.
TRAINING_PAGES = 200
PATH_SIZE, WORD_SIZE, HIDDEN = 96, 24, 16
EPOCHS, BATCH, RATE, SEED = 24, 32, 0.02, 7
BATCH_PAGES = 64

# Elements that end a block, that have no end tag, and whose content is no text.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre "
    "search section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template iframe object svg math canvas audio video".split())
ENDS_PARAGRAPH = BLOCKS - frozenset("button label option optgroup select textarea caption td th tr".split())
SIBLINGS = {"li": "li", "option": "option", "tr": "tr", "td": "td", "th": "td", "dd": "dd", "dt": "dd"}
# Parts of a page that are not its main text, by element and by class or id word.
BOILERPLATE_TAGS = frozenset("nav footer aside form menu button select textarea label dialog head title".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert advertisement banner sponsored promo menu nav navbar breadcrumb breadcrumbs sidebar widget related "
    "footer header masthead cookie consent notice alert popup modal comments comment respond replies subscribe "
    "newsletter share social login signup search pagination copyright disclaimer".split()
)
MAIN_TAGS = frozenset(["article", "main"])
MAIN_WORDS = frozenset("article content main post entry story body-text post-body article-body".split())
SPACE = re.compile(r"\s+")


@dataclass
class Block:
    path: tuple[str, ...]  # for each open element: its tag, then .word for each class or id word
    text: str
    linked: int  # characters inside links


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, tuple[str, ...]]] = []
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.linked = self.silent = self.links = 0

    def flush(self):
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.blocks.append(Block(tuple(w for _, words in self.open for w in words), text, self.linked))
        self.parts, self.linked = [], 0

    def close_to(self, depth: int):
        for tag, _ in self.open[depth:]:
            self.silent -= tag in SILENT
            self.links -= tag == "a"
        del self.open[depth:]

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
        else:
            self.parts.append(" " if tag == "br" else "")
        if tag in ENDS_PARAGRAPH:
            self.end("p", frozenset(["td", "th", "button", "article", "section", "div", "body"]))
        if tag in SIBLINGS:
            for other in [t for t, group in SIBLINGS.items() if group == SIBLINGS[tag]]:
                self.end(other, frozenset(["ul", "ol", "table", "select", "dl"]))
        if tag in VOID:
            return
        words = [tag]
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                words += ["." + w for w in re.split(r"[^a-z0-9]+", value.lower()) if w]
        self.open.append((tag, tuple(words)))
        self.silent += tag in SILENT
        self.links += tag == "a"

    def end(self, tag: str, barrier: frozenset[str] = frozenset()):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0] == tag:
                return self.close_to(depth)
            if self.open[depth][0] in barrier:
                return None
        return None

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        self.end(tag)

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def read_blocks(page: str | None) -> list[Block]:
    reader = _Reader()
    reader.feed(page or "")
    reader.close()
    reader.flush()
    return reader.blocks


def hinted(block: Block) -> bool:
    """What the markup says of a block that stands in marked-up pages; only the training sample is labelled so."""
    words = {w.lstrip(".") for w in block.path if w.startswith(".")}
    tags = {w for w in block.path if not w.startswith(".")}
    if tags & BOILERPLATE_TAGS or words & BOILERPLATE_WORDS:
        return False
    if "header" in tags and not tags & MAIN_TAGS:
        return False
    return bool(tags & MAIN_TAGS or words & MAIN_WORDS)


REMEMBERED_PATHS = 10_000


def path_vector(path: tuple[str, ...]) -> np.ndarray:
    x = np.zeros(PATH_SIZE, np.float32)
    for depth, word in enumerate(reversed(path)):
        x[zlib.crc32(word.encode()) % PATH_SIZE] += 1.0 if depth < 3 else 0.7
    return x


def vectors(blocks: list[Block]) -> np.ndarray:
    """One row per block: hashed path, hashed words, measures. The words of the whole page are hashed at once."""
    x = np.zeros((len(blocks), PATH_SIZE + WORD_SIZE + 5), np.float32)
    if not blocks:
        return x
    texts = [block.text.encode("utf-8", "replace") for block in blocks]
    ends = np.cumsum([len(t) + 1 for t in texts])
    words, starts = word_hashes(np.frombuffer(b"\n".join(texts), np.uint8))
    cell = np.searchsorted(ends, starts, "right") * WORD_SIZE + (words % np.uint64(WORD_SIZE)).astype(np.int64)
    counts = np.bincount(cell, minlength=len(blocks) * WORD_SIZE).reshape(len(blocks), WORD_SIZE)
    many = counts.sum(axis=1)
    x[:, PATH_SIZE:PATH_SIZE + WORD_SIZE] = counts / np.maximum(1, many)[:, None]
    for i, block in enumerate(blocks):
        x[i, :PATH_SIZE] = remembered("paths", block.path, lambda: path_vector(block.path), REMEMBERED_PATHS)
        n = len(block.text)
        x[i, -5:] = (np.log1p(n) / 8, min(1.0, block.linked / n), np.log1p(many[i]) / 6, i / len(blocks),
                     sum(map(block.text.count, ".,;")) / n)
    return x


class Labeller:
    """Two LSTMs, one for each direction, and a logistic unit on both states of each block."""

    NAMES = ("wx", "wh", "b")

    def __init__(self, size: int, hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {}
        for side in "fb":
            self.p["wx" + side] = (rng.standard_normal((size, 4 * hidden)) * 0.15).astype(np.float32)
            self.p["wh" + side] = (rng.standard_normal((hidden, 4 * hidden)) * 0.15).astype(np.float32)
            self.p["b" + side] = np.zeros(4 * hidden, np.float32)
            self.p["b" + side][hidden:2 * hidden] = 1.0  # remember at first
        self.p["v"] = (rng.standard_normal(2 * hidden) * 0.3).astype(np.float32)
        self.p["c"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, side: str):
        """States of one direction for padded sequences (pages, blocks, size); padding keeps the state."""
        pages, steps, _ = x.shape
        h = np.zeros((pages, self.hidden), np.float32)
        c = np.zeros_like(h)
        pre = x @ self.p["wx" + side] + self.p["b" + side]
        tape, out = [], np.zeros((pages, steps, self.hidden), np.float32)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            z = pre[:, t] + h @ self.p["wh" + side]
            i, f, o = (1 / (1 + np.exp(-z[:, k * self.hidden:(k + 1) * self.hidden])) for k in range(3))
            g = np.tanh(z[:, 3 * self.hidden:])
            m = mask[:, t, None]
            c_new = f * c + i * g
            h_new = o * np.tanh(c_new)
            tape.append((t, h, c, i, f, o, g, c_new, m))
            h, c = m * h_new + (1 - m) * h, m * c_new + (1 - m) * c
            out[:, t] = h
        return out, tape

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        states = np.concatenate([self._run(x, mask, "f")[0], self._run(x, mask, "b")[0]], axis=2)
        return 1 / (1 + np.exp(-(states @ self.p["v"] + self.p["c"][0])))

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        runs = {side: self._run(x, mask, side) for side in "fb"}
        states = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        p = 1 / (1 + np.exp(-(states @ self.p["v"] + self.p["c"][0])))
        slope = (p - y) * mask / mask.sum()
        grad = {"v": np.einsum("pt,pth->h", slope, states), "c": np.array([slope.sum()], np.float32)}
        back = slope[:, :, None] * self.p["v"]
        k = self.hidden
        for side, part in (("f", back[:, :, :k]), ("b", back[:, :, k:])):
            dx = np.zeros((*x.shape[:2], 4 * k), np.float32)
            dwh = np.zeros_like(self.p["wh" + side])
            dh, dc = np.zeros((len(x), k), np.float32), np.zeros((len(x), k), np.float32)
            for t, h, c, i, f, o, g, c_new, m in reversed(runs[side][1]):
                dh = dh + part[:, t]
                on = dh * m
                tanh_c = np.tanh(c_new)
                d_cell = dc * m + on * o * (1 - tanh_c**2)
                dz = np.concatenate([d_cell * g * i * (1 - i), d_cell * c * f * (1 - f), on * tanh_c * o * (1 - o),
                                     d_cell * i * (1 - g**2)], axis=1)
                dx[:, t] = dz
                dwh += h.T @ dz
                dh = dz @ self.p["wh" + side].T + dh * (1 - m)
                dc = d_cell * f + dc * (1 - m)
            grad["wx" + side] = np.tensordot(x, dx, ([0, 1], [0, 1]))
            grad["wh" + side], grad["b" + side] = dwh, dx.sum((0, 1))
        return grad

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> None:
        """Adam over batches of pages of similar length."""
        rng = np.random.default_rng(SEED)
        mean = {n: np.zeros_like(w) for n, w in self.p.items()}
        spread = {n: np.zeros_like(w) for n, w in self.p.items()}
        step = 0
        order = sorted(range(len(pages)), key=lambda i: len(pages[i][1]))
        batches = [order[i:i + BATCH] for i in range(0, len(order), BATCH)]
        for _ in range(epochs):
            for j in rng.permutation(len(batches)):
                x, mask = padded([pages[i][0] for i in batches[j]])
                y = np.zeros(mask.shape, np.float32)
                for row, i in enumerate(batches[j]):
                    y[row, :len(pages[i][1])] = pages[i][1]
                step += 1
                for n, g in self.gradients(x, mask, y).items():
                    g = np.clip(g, -1, 1)
                    mean[n] = 0.9 * mean[n] + 0.1 * g
                    spread[n] = 0.99 * spread[n] + 0.01 * g * g
                    self.p[n] -= RATE * (mean[n] / (1 - 0.9**step)) / (np.sqrt(spread[n] / (1 - 0.99**step)) + 1e-6)

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Whether each block is main text, for pages of any length, in their order."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        for at in range(0, len(order), BATCH_PAGES):
            own = order[at:at + BATCH_PAGES]
            x, mask = padded([pages[i] for i in own])
            p = self.probabilities(x, mask)
            for row, i in enumerate(own):
                out[i] = p[row, :len(pages[i])] >= 0.5
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x = np.zeros((len(pages), steps, pages[0].shape[1]), np.float32)
    mask = np.zeros((len(pages), steps), np.float32)
    for i, page in enumerate(pages):
        x[i, :len(page)], mask[i, :len(page)] = page, 1
    return x, mask


def altered(blocks: list[Block], labels: list[bool], pool: list[str], rng) -> tuple[list[Block], list[bool]]:
    """A copy of a page in which parts that are no main text were put in and the main part goes by another name."""
    frames = [
        ("aside",), ("div", ".sidebar"), ("div", ".widget"), ("section", ".comments"), ("div", ".comment"), ("ol", ".comments", "li", ".comment", "p"),
        ("div", ".cookie", ".notice"), ("div", ".notice"), ("div", ".alert"), ("form",), ("form", "label"), ("form", "button"), ("header",),
        ("header", "nav"), ("div", ".menu", "ul", "li", "a"), ("div", ".ads"), ("div", ".advert"), ("div", ".related", "ul", "li"),
        ("div", ".newsletter"), ("div", ".popup"), ("nav", ".breadcrumb"), ("div", ".share"), ("section", ".comments", "article", "p"),
        ("div", ".footer"), ("div", ".banner"), ("aside", "p"), ("aside", "h2"), ("div", ".subscribe", "form"), ("div", ".promo"),
    ]
    main = [("article",), ("main",), ("main", "article"), ("div", ".content"), ("div", ".post"), ("div", ".entry", ".content"), ("section", ".article")]
    name, out, marks = main[rng.integers(len(main))], [], []
    renamed = []
    for b in blocks:
        at = b.path.index("article") if "article" in b.path else -1
        renamed.append(Block((*b.path[:at], *name, *b.path[at + 1:]), b.text, b.linked) if at >= 0 else b)
    body = ("html", "body")
    for b, y in zip(renamed, labels):
        while rng.random() < 0.12:
            frame = frames[rng.integers(len(frames))]
            inside = (*body, *name) if y and rng.random() < 0.5 else body
            for _ in range(rng.integers(1, 4)):
                text = pool[rng.integers(len(pool))]
                text = " ".join(text.split()[:rng.integers(1, 40)])
                out.append(Block((*inside, *frame), text, len(text) if "a" in frame or "nav" in frame else 0))
                marks.append(False)
        out.append(b)
        marks.append(y)
    return out, marks


def train(pages: DataFrame, column: str = "html") -> Labeller:
    """Learns from TRAINING_PAGES pages in expectation; with no usable page, from one made of the same markup."""
    n = pages.count()
    scale = 1 << 30
    rate = min(scale, -(-scale * TRAINING_PAGES // max(1, n)))
    key = F.xxhash64(F.col(column), F.lit(SEED))
    rows = pages.filter(F.col(column).isNotNull() & (F.pmod(key, F.lit(scale)) < rate)).select(F.col(column).alias("h"))
    sample = sorted({r.h for r in rows.toLocalIterator()})
    sample = sample or ["<nav><a>menu</a></nav><article><h1>Title</h1><p>Some text, and more.</p></article><footer>end</footer>"]
    rng, data = np.random.default_rng(SEED), []
    read = [b for b in map(read_blocks, sample) if b]
    pool = [b.text for blocks in read for b in blocks] or ["text"]
    for blocks in read:
        labels = [hinted(b) for b in blocks]
        for _ in range(3):
            data.append(altered(blocks, labels, pool, rng))
        data.append((blocks, labels))
    labeller = Labeller(PATH_SIZE + WORD_SIZE + 5)
    if data:
        labeller.fit([(vectors(blocks), np.array(y, np.float32)) for blocks, y in data])
    return labeller


def with_main_text(pages: DataFrame, labeller: Labeller, column: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with the main text of each whole page in ``into`` (replaced where it exists), blocks joined by a newline.

    Character references are decoded, white space inside a block is one space. Null, empty and text-less pages give the
    empty string; repeated rows are read each; an empty table stays empty. No row moves between tasks.
    """

    @F.pandas_udf("string")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for at in range(0, len(batch), BATCH_PAGES):
                read = [read_blocks(p) for p in batch.iloc[at:at + BATCH_PAGES]]
                marks = labeller.label([vectors(b) for b in read])
                out += ["\n".join([b.text for b, keep in zip(blocks, own) if keep]) for blocks, own in zip(read, marks)]
            yield pd.Series(out, dtype=object)

    return pages.withColumn(into, extracted(F.col(column)))


def plain(text: str) -> str:
    """White space and references as blocks have them, for one string."""
    return SPACE.sub(" ", html.unescape(text)).strip()
