"""Main text of web pages by a recurrent labeller of their blocks.

A page is cut into blocks: the text between two block-level tags, with the path of open
tags and their class and id words. A bidirectional LSTM reads the blocks of a page
in order; each enters as the mean of learned vectors of its hashed path parts, the same
of its hashed words, and a few shape numbers. So every block is judged with the whole page
around it. All of it is numpy, for many pages of like length at a time.

The labels to learn from come from a bounded sample of the pages themselves: where
tags or class words say what a block is, a rule labels it. The sample is then varied:
telling tags become plain ones, and headers, notices, side columns, forms, adverts and
comments made of other texts are put in, so that order, length and
neighbours have to be learned too.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 300  # about so many pages fit the labeller
PATHS, WORDS = 1 << 11, 1 << 12
PATH_DIM, WORD_DIM, SHAPE_DIM, HIDDEN = 16, 8, 7, 16
SLICE = 400  # pages handled at a time

# Elements of HTML that start a block, that hold no text of the page, and that have no end tag.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
SKIPPED_TAGS = frozenset("head iframe math noembed noframes noscript object script style svg template textarea title".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that may lie in head, and elements that HTML does not start within svg or math but after them.
HEAD_TAGS = frozenset("base basefont bgsound command link meta noframes noscript script style template title".split())
BREAKOUT_TAGS = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike "
    "sub sup table tt u ul var".split()
)
RAW_TAGS = frozenset("script style textarea title iframe noembed noframes".split())
# Words of class and id attributes and tags that say what a block is.
ASIDE_WORDS = frozenset(
    "ad ads advert advertisement advertising aside banner breadcrumb breadcrumbs button comment comments consent cookie cookies copyright discussion disqus footer form gdpr "
    "header login masthead menu modal nav navbar navigation newsletter notice notification popup promo promotion related replies reply respond search share sharing sidebar "
    "signup skip social sponsor sponsored subscribe tags toolbar topbar widget".split()
)
MAIN_WORDS = frozenset("article articlebody content entry main post postbody story".split())
ASIDE_TAGS = frozenset("aside button dialog footer form header label legend menu nav option select".split())
MAIN_TAGS = frozenset("article main".split())
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW_TAGS}
_CLOSED_BY_SAME = frozenset("p li dt dd tr td th option".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(?:[!?])[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


@dataclass
class Block:
    path: list[str]  # open tags and, with a dot, their class and id words: each at most twice, and the innermost part last
    text: str
    linked: int = 0  # code points inside links
    label: float | None = field(default=None)


class _Open:
    """The open elements of a page. What is asked of all of them is kept beside each, so depth costs nothing."""

    def __init__(self):
        # tag, path parts so far, innermost part, within a skipped element, within a link
        self.frames: list[tuple[str, tuple[str, ...], str | None, bool, bool]] = []
        self.counts: Counter[str] = Counter()

    def push(self, tag: str, names: list[str]) -> None:
        _, path, last, skipped, linked = self.frames[-1] if self.frames else ("", (), None, False, False)
        if tag in BLOCK_TAGS or tag == "a":
            new = []
            for part in (tag, *names):
                if path.count(part) + new.count(part) < 2:
                    new.append(part)
                last = part
            path = (*path, *new) if new else path
        self.frames.append((tag, path, last, skipped or tag in SKIPPED_TAGS, linked or tag == "a"))
        self.counts[tag] += 1

    def cut(self, i: int) -> None:
        """Ends the element at i and all within it."""
        for tag, *_ in self.frames[i:]:
            self.counts[tag] -= 1
        del self.frames[i:]

    def has(self, tags) -> bool:
        return any(self.counts[t] for t in tags)

    def innermost(self) -> str | None:
        return self.frames[-1][0] if self.frames else None

    def end_last(self, tags: frozenset[str]) -> None:
        if self.has(tags):
            self.cut(next(i for i in range(len(self.frames) - 1, -1, -1) if self.frames[i][0] in tags))


def blocks_of(page: str | None) -> list[Block]:
    """The blocks of a page in order, with white space as one space and references decoded. Linear in the page, whatever its depth."""
    out: list[Block] = []
    stack = _Open()
    held: list[str] = []
    linked = 0
    at = 0
    page = page or ""

    def close() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(held)).split()) if held else ""
        if text:
            _, path, last, *_ = stack.frames[-1] if stack.frames else ("", (), None)
            out.append(Block([*path, last] if last is not None else [], text, linked))
        held.clear()
        linked = 0

    def said(text: str) -> None:
        nonlocal linked
        if stack.innermost() == "head" and text.strip():
            stack.cut(len(stack.frames) - 1)  # head holds no text: the body begins
        if text and not (stack.frames and stack.frames[-1][3]):
            held.append(text)
            if stack.frames and stack.frames[-1][4]:
                linked += len(text.strip())

    while True:
        m = _TAG.search(page, at)
        if m is None:
            said(page[at:])
            break
        said(page[at : m.start()])
        at = m.end()
        slash, tag, rest = (m.group(1), m.group(2), m.group(3)) if m.group(2) else (m.group(4), m.group(5), m.group(6))
        if not tag:
            continue
        tag = tag.lower()
        if not slash:
            # what cannot lie in an open head, svg or math ends it
            if tag in BREAKOUT_TAGS and not stack.has(("foreignobject", "desc", "annotation-xml")):
                stack.end_last(frozenset(("svg", "math")))
            if tag == "body" or stack.innermost() == "head" and tag not in HEAD_TAGS | {"head", "html"}:
                stack.end_last(frozenset(("head",)))
        if tag == "br":
            said(" ")
            continue
        if tag in BLOCK_TAGS or tag in SKIPPED_TAGS:
            close()
        if slash:
            if stack.counts[tag]:
                for i in range(len(stack.frames) - 1, -1, -1):
                    if stack.frames[i][0] == tag:
                        stack.cut(i)
                        break
                    if stack.frames[i][0] in MAIN_TAGS | ASIDE_TAGS and tag not in BLOCK_TAGS:
                        break
            continue
        if tag in VOID_TAGS or rest.endswith("/") and tag not in BLOCK_TAGS:
            continue
        if tag in BLOCK_TAGS and tag != "title" and (stack.counts["p"] or tag in _CLOSED_BY_SAME and stack.counts[tag]):
            # an open paragraph ends here, with what is open in it; so does an item of the same kind
            for i in range(len(stack.frames) - 1, -1, -1):
                if stack.frames[i][0] == "p" or tag in _CLOSED_BY_SAME and stack.frames[i][0] == tag:
                    stack.cut(i)
                    break
                if stack.frames[i][0] in BLOCK_TAGS or stack.frames[i][0] == "foreignobject":
                    break
        if tag in RAW_TAGS:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        names = [f".{w.lower()}" for g in _NAMED.findall(rest) for w in _PARTS.findall(g[0] or g[1] or g[2])] if rest else []
        stack.push(tag, names)
    close()
    return out


def _is_main(part: str) -> bool:
    return part[1:] in MAIN_WORDS if part.startswith(".") else part in MAIN_TAGS


def rule_label(path: list[str], outer: int = 0) -> float | None:
    """What tags and class words say: 1 main text, 0 something else, None nothing. The first ``outer`` parts say nothing of asides."""
    if any(p[1:] in ASIDE_WORDS if p.startswith(".") else p in ASIDE_TAGS for p in path[outer:]):
        return 0.0
    return 1.0 if any(map(_is_main, path)) else None


def rule_labels(blocks: list[Block]) -> list[float | None]:
    """``rule_label`` of the blocks of a page.

    A page of which nothing would be main text may lie in one form, or bear a word such as with-sidebar
    on an outer element: there, what all of its main blocks lie in (without any, all of its blocks) says nothing of asides.
    """
    labels = [rule_label(b.path) for b in blocks]
    if 1.0 in labels or 0.0 not in labels:
        return labels
    inner = [b.path[:-1] for b in blocks if any(map(_is_main, b.path))] or [b.path[:-1] for b in blocks]
    outer = 0
    for parts in zip(*inner):
        if len(set(parts)) > 1 or _is_main(parts[0]):
            break
        outer += 1
    return [rule_label(b.path, outer) for b in blocks]


def _slot(prefix: str, name: str, size: int) -> int:
    return zlib.crc32(f"{prefix}{name}".encode("utf-8", "surrogatepass")) % size


def encode_block(block: Block, before: int, total: int, known: float | None) -> tuple[list[int], list[int], list[float]]:
    """Path slots, word slots and shape numbers of a block; ``known`` is what the rule says."""
    path = block.path
    slots = [_slot("", p, PATHS) for p in dict.fromkeys(path)] + [_slot("last ", p, PATHS) for p in path[-1:]]
    words = block.text.lower().split()
    marks = sum(c in ".!?;:," for c in block.text)
    shape = [
        min(np.log1p(len(block.text)) / 6, 2.0), min(block.linked / max(len(block.text), 1), 1.0), min(marks / 8, 2.0),
        before / max(total, 1), min(total / 50, 2.0), float(known == 1.0), float(known == 0.0),
    ]
    return slots, [_slot("", w, WORDS) for w in words], shape


def encode_page(blocks: list[Block]):
    return [encode_block(b, i, len(blocks), known) for i, (b, known) in enumerate(zip(blocks, rule_labels(blocks), strict=True))]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BlockLabeller:
    """A bidirectional LSTM over the blocks of pages, with one score per block."""

    def __init__(self, seed: int = 29):
        rng = np.random.default_rng(seed)
        size = PATH_DIM + WORD_DIM + SHAPE_DIM
        w = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"path": rng.normal(0, 0.3, (PATHS, PATH_DIM)), "word": rng.normal(0, 0.1, (WORDS, WORD_DIM)), "out": w(2 * HIDDEN + size, 1), "bias": np.zeros(1)}
        for d in "fb":
            self.p |= {f"{d}x": w(size, 4 * HIDDEN), f"{d}h": w(HIDDEN, 4 * HIDDEN), f"{d}c": np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])}

    def _inputs(self, pages):
        """(page, step, feature) array, mask, and what the means were taken of."""
        longest = max(map(len, pages))
        x = np.zeros((len(pages), longest, PATH_DIM + WORD_DIM + SHAPE_DIM))
        mask = np.zeros((len(pages), longest))
        flat = [b for page in pages for b in page]
        row = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
        step = np.concatenate([np.arange(len(p)) for p in pages])
        mask[row, step] = 1
        parts = []
        for k, (name, at, dim) in enumerate((("path", 0, PATH_DIM), ("word", PATH_DIM, WORD_DIM))):
            counts = np.array([len(b[k]) for b in flat])
            slots = np.fromiter((s for b in flat for s in b[k]), np.int64, counts.sum())
            of = np.repeat(np.arange(len(flat)), counts)
            scale = 1 / np.sqrt(np.maximum(counts, 1)) if name == "path" else 1 / (counts + 4)  # few words say little
            # the sum of a block is a difference of running sums; blocks of no words have 0
            sums = np.zeros((len(slots) + 1, dim))
            np.cumsum(self.p[name][slots], axis=0, out=sums[1:])
            ends = np.cumsum(counts)
            x[row, step, at : at + dim] = (sums[ends] - sums[ends - counts]) * scale[:, None]
            parts.append((name, at, dim, slots, of, scale))
        x[row, step, PATH_DIM + WORD_DIM :] = np.array([b[2] for b in flat])
        return x, mask, row, step, parts

    def _run(self, x, mask, d):
        """States of one direction, and what its gradient needs. Padding keeps the state."""
        steps = range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1)
        h, c = np.zeros((len(x), HIDDEN)), np.zeros((len(x), HIDDEN))
        out, kept = np.zeros((*x.shape[:2], HIDDEN)), {}
        inputs = x @ self.p[f"{d}x"] + self.p[f"{d}c"]
        for t in steps:
            z = inputs[:, t] + h @ self.p[f"{d}h"]
            gate = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = gate[:, :HIDDEN], gate[:, HIDDEN : 2 * HIDDEN], gate[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            new = f * c + i * g
            m = mask[:, t : t + 1]
            kept[t] = (h, c, i, f, o, g, new)
            c = m * new + (1 - m) * c
            h = m * o * np.tanh(new) + (1 - m) * h
            out[:, t] = h
        return out, kept

    def _back(self, x, mask, d, kept, grad_out, grads):
        steps = range(x.shape[1] - 1, -1, -1) if d == "f" else range(x.shape[1])
        dh, dc = np.zeros((len(x), HIDDEN)), np.zeros((len(x), HIDDEN))
        dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN))
        for t in steps:
            h, c, i, f, o, g, new = kept[t]
            m = mask[:, t : t + 1]
            dh = dh + grad_out[:, t]
            th = np.tanh(new)
            dnew = m * (dc + dh * o * (1 - th**2))
            dz = np.concatenate([dnew * g * i * (1 - i), dnew * c * f * (1 - f), m * dh * th * o * (1 - o), dnew * i * (1 - g**2)], axis=1)
            dz_all[:, t] = dz
            grads[f"{d}h"] += h.T @ dz
            dh = dz @ self.p[f"{d}h"].T + (1 - m) * dh
            dc = dnew * f + (1 - m) * dc
        flat = dz_all.reshape(-1, 4 * HIDDEN)
        grads[f"{d}x"] += x.reshape(-1, x.shape[2]).T @ flat
        grads[f"{d}c"] += flat.sum(axis=0)
        return dz_all @ self.p[f"{d}x"].T

    def _forward(self, pages):
        x, mask, row, step, parts = self._inputs(pages)
        fw, kf = self._run(x, mask, "f")
        bw, kb = self._run(x, mask, "b")
        every = np.concatenate([fw, bw, x], axis=2)
        return _sigmoid((every @ self.p["out"])[:, :, 0] + self.p["bias"]), (x, mask, row, step, parts, kf, kb, every)

    def fit(self, pages, labels, epochs: int = 12, rate: float = 0.01) -> BlockLabeller:
        """Adam on the log-loss of the labelled blocks; a label of None does not count."""
        rng = np.random.default_rng(31)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        tick = 0
        for _ in range(epochs):
            order = np.array(sorted(range(len(pages)), key=lambda k: (len(pages[k]), rng.random())))
            groups = [order[k : k + 16] for k in range(0, len(order), 16)]
            for k in rng.permutation(len(groups)):
                some = groups[k]
                p, (x, mask, row, step, parts, kf, kb, every) = self._forward([pages[i] for i in some])
                gold = np.zeros_like(p)
                weight = np.zeros_like(p)
                for r, i in enumerate(some):
                    for s, label in enumerate(labels[i]):
                        if label is not None:
                            gold[r, s], weight[r, s] = label, 1
                error = (p - gold) * weight / max(weight.sum(), 1)
                grads = {key: np.zeros_like(v) for key, v in self.p.items()}
                grads["out"] = every.reshape(-1, every.shape[2]).T @ error.reshape(-1, 1)
                grads["bias"] = np.array([error.sum()])
                down = error[:, :, None] * self.p["out"][:, 0]
                dx = down[:, :, 2 * HIDDEN :] + self._back(x, mask, "f", kf, down[:, :, :HIDDEN], grads) + self._back(x, mask, "b", kb, down[:, :, HIDDEN : 2 * HIDDEN], grads)
                for name, at, dim, slots, of, scale in parts:
                    np.add.at(grads[name], slots, (dx[row, step, at : at + dim] * scale[:, None])[of])
                tick += 1
                for key in self.p:
                    first[key] = 0.9 * first[key] + 0.1 * grads[key]
                    second[key] = 0.99 * second[key] + 0.01 * grads[key] ** 2
                    self.p[key] -= rate * (first[key] / (1 - 0.9**tick)) / (np.sqrt(second[key] / (1 - 0.99**tick)) + 1e-8)
        return self

    def predict(self, pages) -> list[np.ndarray]:
        """Scores of the blocks of each page."""
        out = [np.zeros(0)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and end - at < 256 and len(pages[order[end]]) * (end - at + 1) <= 20_000 and len(pages[order[end]]) <= 1.3 * len(pages[order[at]]) + 4:
                end += 1
            scores, _ = self._forward([pages[k] for k in order[at:end]])
            for r, k in enumerate(order[at:end]):
                out[k] = scores[r, : len(pages[k])]
            at = end
        return out


def varied_pages(pages: list[list[Block]], seed: int = 37, times: int = 2) -> list[list[Block]]:
    """Labelled pages and variants of them: other tags for the same roles, and other blocks put in."""
    rng = np.random.default_rng(seed)
    pick = lambda options: options[int(rng.integers(len(options)))]
    texts = [b.text for page in pages for b in page if b.label == 1.0] or ["text"]
    main = [["article"], ["main"], ["div", ".content"], ["div", ".post"], ["div", ".story"], ["section"], ["div"], ["main", "article"], ["div", ".entry", ".content"]]
    menu = [["nav", "ul", "li", "a"], ["div", ".menu", "ul", "li", "a"], ["div", "ul", "li", "a"], ["header", "nav", "a"], ["div", ".navbar", "a"]]
    foot = [["footer"], ["footer", "p"], ["div", ".footer"], ["div", ".copyright", "p"], ["div", "p"]]
    extra = [
        ["header", "h1"], ["header", "p"], ["div", ".header"], ["aside", "p"], ["aside", "ul", "li"], ["div", ".sidebar", "p"], ["div", ".cookie", "p"], ["div", ".cookie", ".notice"],
        ["div", ".notice"], ["section", ".comments", "p"], ["div", ".comment", "p"], ["div", ".comments", "div", ".comment"], ["form", "label"], ["form"], ["form", "p"], ["div", ".ad"],
        ["div", ".advert", "p"], ["div", ".promo"], ["div", ".newsletter", "p"], ["div", ".share", "a"], ["div", ".related", "ul", "li", "a"], ["button"],
    ]

    def words(n: int) -> str:
        some = pick(texts).split()
        start = int(rng.integers(max(len(some) - n, 0) + 1))
        return " ".join(some[start : start + n])

    out = list(pages)
    for page in pages:
        for _ in range(times):
            own_main, own_menu, own_foot = pick(main), pick(menu), pick(foot)
            new: list[Block] = []
            inside = [i for i, b in enumerate(page) if b.label == 1.0]

            def put(n: int) -> None:
                for _ in range(n):
                    path = pick(extra)
                    # what is put into the article lies below its tags
                    within = inside and inside[0] < i <= inside[-1]
                    for _ in range(int(rng.integers(1, 4))):
                        text = words(int(rng.integers(2, 40)))
                        new.append(Block(["html", "body", *(own_main if within else []), *path], text, len(text) if path[-1] == "a" else 0, 0.0))

            for i, b in enumerate(page):
                if rng.random() < 0.12:
                    put(1)
                if b.label == 1.0:
                    path = ["html", "body", *own_main, b.path[-1] if b.path else "p"]
                elif "nav" in b.path or "li" in b.path:
                    path = ["html", "body", *own_menu]
                elif "footer" in b.path:
                    path = ["html", "body", *own_foot]
                else:
                    path = b.path
                new.append(Block(path, b.text, b.linked, b.label))
                if b.label == 1.0 and rng.random() < 0.15:
                    new.append(Block(path, words(int(rng.integers(1, 4))), 0, 1.0))
            i = len(page)
            put(int(rng.integers(0, 3)))
            out.append(new)
    return out


def fit_labeller(pages: DataFrame, sample: int = SAMPLE, html_col: str = "html") -> BlockLabeller:
    """A labeller from about ``sample`` pages whose tags say what their blocks are.

    Which pages are taken depends on a hash of their html alone. Blocks of which tags say nothing have no
    label; pages without a labelled main text are not learned from.
    """
    rows = pages.select(F.col(html_col).alias("html")).filter("html is not null").filter(F.length("html") <= 200_000)
    total = rows.count()
    taken = rows.filter(F.pmod(F.xxhash64("html"), F.lit(1 << 20)) < (1 << 20) * min(1.0, sample / max(total, 1)))
    learned = []
    for r in sorted({r["html"] for r in taken.orderBy(F.xxhash64("html"), "html").limit(4 * sample).collect()}):
        blocks = blocks_of(r)
        for b, label in zip(blocks, rule_labels(blocks), strict=True):
            b.label = label
        if any(b.label == 1.0 for b in blocks):
            learned.append(blocks)
    if not learned:
        words = [Block(["html", "body", "article", "p"], "some longer text of an article, with sentences. " * 3, 0, 1.0)] * 3
        learned = [[Block(["html", "body", "nav", "a"], "menu", 4, 0.0), *words, Block(["html", "body", "footer"], "notice", 0, 0.0)]] * 20
    varied = varied_pages(learned)
    rng = np.random.default_rng(43)
    # half of the blocks are learned without their words, so that no page is known by its vocabulary
    inputs = [[(path, words if rng.random() < 0.5 else [], shape) for path, words, shape in encode_page(p)] for p in varied]
    return BlockLabeller().fit(inputs, [[b.label for b in p] for p in varied])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", labelled: DataFrame | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) per row: the main text, its blocks joined by empty lines.

    The labeller is fitted on ``labelled`` (default: the pages). Null and empty pages and pages without a block have the
    empty text. Unclosed tags, quotes, comments and scripts end where the page does. Repeated
    rows and null ids keep their rows; other columns are ignored.
    """
    shared = pages.sparkSession.sparkContext.broadcast(fit_labeller(pages if labelled is None else labelled, html_col=html_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            for lo in range(0, batch.num_rows, SLICE):
                found = [blocks_of(h) for h in batch.column("html").slice(lo, SLICE).to_pylist()]
                scores = shared.value.predict([encode_page(b) for b in found])
                texts += ["\n\n".join(b.text for b, s in zip(bs, ss, strict=True) if s >= 0.5) for bs, ss in zip(found, scores, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
