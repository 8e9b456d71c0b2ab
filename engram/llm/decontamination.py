"""Benchmark decontamination: every passage queries a BM25 index of the test items.

The index is small and goes to every task: per term its items with their BM25
weight, divided by what the item scores against itself, so that 1 is a full match
of any item and one threshold serves all. Items lie in blocks, and a term keeps
its largest weight per block.

A passage is a window of twice the longest item, every item length: what is as
long as an item lies whole in some window. Windows are scored in numpy, many at a
time, in the order of WAND: frequent terms, whose weights together stay under a
third of the threshold, only enter as a bound of each block; the other terms add
their block maxima; (window, block) pairs whose bound stays below the threshold
are skipped and only the others are scored item by item. What is at or above the
threshold is retrieved, all of it, and then verified: word 3-grams of the item's
question and of its answer must both be found in the window.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.carry import carried, carry, with_kept
from engram.llm.hashing import PUNCTUATED, sequence_hashes, word_hashes

THRESHOLD = 0.6
OVERLAP = 0.6
K1, B = 1.2, 0.75
BLOCK = 8
MAX_ITEMS = 200_000  # the index travels to every task; more items are handled by calling in slices
SLICE = 500  # texts handled at a time
_FILTER = 1 << 20


def _words(texts) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes([t.lower() if t else t for t in texts], True, PUNCTUATED)


def question_and_answer(text: str) -> tuple[str, str]:
    """An item up to its last question mark or line end, and the rest; halves by words if there is none."""
    cut = max(text.rfind("?"), text.rstrip().rfind("\n"))
    if 0 < cut < len(text.rstrip()) - 1 and text[:cut].strip():
        return text[: cut + 1], text[cut + 1 :]
    words = text.split()
    half = (len(words) + 1) // 2
    return " ".join(words[:half]), " ".join(words[half:])


def _grams(words: np.ndarray) -> np.ndarray:
    return np.unique(sequence_hashes(words, min(3, len(words)))) if len(words) else np.zeros(0, np.uint64)


@dataclass
class Item:
    item_id: int
    weights: dict[int, float]
    question: np.ndarray
    answer: np.ndarray


class Index:
    def __init__(self, items: list[tuple[int, str]], threshold: float):
        self.threshold = threshold
        hashes, offsets = _words([t for _, t in items])
        each = [hashes[s:e] for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
        lengths = [len(w) for w in each if len(w)]
        self.step = max(lengths, default=1)
        df = Counter(h for w in each for h in set(w.tolist()))
        mean = sum(lengths) / max(len(lengths), 1)
        self.items: list[Item] = []
        for (item_id, text), words in zip(items, each, strict=True):
            if not len(words):
                continue
            raw = {
                h: math.log(1 + (len(items) - df[h] + 0.5) / (df[h] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean))
                for h, tf in Counter(words.tolist()).items()
            }
            whole = sum(raw.values())
            sides = [_grams(_words([x])[0]) for x in question_and_answer(text)]
            self.items.append(Item(item_id, {h: v / whole for h, v in raw.items()}, *sides))
        # frequent terms leave the postings while no item owes them a third of the threshold
        left = np.zeros(len(self.items))
        holds: dict[int, list[int]] = {}
        for i, item in enumerate(self.items):
            for h in item.weights:
                holds.setdefault(h, []).append(i)
        late = set()
        for h in sorted(holds, key=lambda h: (-df[h], h)):
            more = [left[i] + self.items[i].weights[h] for i in holds[h]]
            if max(more) > threshold / 3 or df[h] < 2:
                break
            left[holds[h]] = more
            late.add(h)
        self.blocks = math.ceil(len(self.items) / BLOCK)
        self.block_rest = np.array([left[b * BLOCK : (b + 1) * BLOCK].max() for b in range(self.blocks)])
        terms = sorted(set(holds) - late)
        self.terms = np.array(terms, dtype=np.uint64)
        self.near = np.zeros(_FILTER, dtype=bool)
        self.near[(self.terms & np.uint64(_FILTER - 1)).astype(np.int64)] = True
        start, block, most = [0], [], []
        for h in terms:
            best: dict[int, float] = {}
            for i in holds[h]:
                best[i // BLOCK] = max(best.get(i // BLOCK, 0), self.items[i].weights[h])
            block += best
            most += best.values()
            start.append(len(block))
        self.start, self.block, self.most = np.array(start), np.array(block, dtype=np.int64), np.array(most)

    def _candidates(self, words: np.ndarray, window: np.ndarray) -> np.ndarray:
        """window * blocks + block of the pairs whose bound reaches the threshold."""
        at = np.flatnonzero(self.near[(words & np.uint64(_FILTER - 1)).astype(np.int64)])
        if not len(at) or not len(self.terms):
            return np.zeros(0, dtype=np.int64)
        term = np.minimum(np.searchsorted(self.terms, words[at]), len(self.terms) - 1)
        real = self.terms[term] == words[at]
        term, window = term[real], window[at[real]]
        term = np.concatenate([term, term])
        window = np.concatenate([window, window - 1])
        pair = np.unique(window * len(self.terms) + term)
        window, term = pair // len(self.terms), pair % len(self.terms)
        count = self.start[term + 1] - self.start[term]
        first = np.repeat(self.start[term] - np.concatenate(([0], np.cumsum(count)[:-1])), count)
        post = first + np.arange(count.sum())
        key = np.repeat(window, count) * self.blocks + self.block[post]
        keys, back = np.unique(key, return_inverse=True)
        bound = np.bincount(back, self.most[post]) + self.block_rest[keys % self.blocks]
        return keys[bound >= self.threshold - 1e-9]

    def search(self, texts, overlap: float) -> Iterator[tuple[int, int, float, float, float]]:
        """(text index, item id, score, question share, answer share) of verified finds, best window of each."""
        words, offsets = _words(texts)
        lengths = np.diff(offsets)
        windows = lengths // self.step + 2  # one empty window before and after keeps texts apart
        base = np.concatenate(([0], np.cumsum(windows)))
        owner = np.repeat(np.arange(len(texts)), lengths)
        window = (np.arange(len(words)) - offsets[owner]) // self.step + base[owner] + 1
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        last, grams, terms = -1, None, set()
        for key in self._candidates(words, window).tolist():
            w, block = divmod(key, self.blocks)
            text = int(np.searchsorted(base, w, side="right")) - 1
            if w != last:
                lo = int(offsets[text]) + max(w - int(base[text]) - 1, 0) * self.step
                hi = min(int(offsets[text]) + (w - int(base[text]) + 1) * self.step, int(offsets[text + 1]))
                last, inside = w, words[lo:hi]
                terms = set(inside.tolist())
                grams = {n: sequence_hashes(inside, n) for n in (1, 2, 3)}
            for item in self.items[block * BLOCK : (block + 1) * BLOCK]:
                score = sum(v for h, v in item.weights.items() if h in terms)
                if score < self.threshold - 1e-9:
                    continue
                shares = [self._share(side, grams) for side in (item.question, item.answer)]
                if min(shares) < overlap:
                    continue
                found = (round(score, 6), round(shares[0], 6), round(shares[1], 6))
                if found > best.get((text, item.item_id), (0.0, 0.0, 0.0)):
                    best[text, item.item_id] = found
        for (text, item_id), found in sorted(best.items()):
            yield text, item_id, *found

    @staticmethod
    def _share(side: np.ndarray, grams: dict[int, np.ndarray]) -> float:
        if not len(side):
            return 1.0
        return max(float(np.isin(side, g).mean()) for g in grams.values())


def _shared_index(benchmark: DataFrame, threshold: float):
    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter("text is not null").orderBy("item_id", "text").limit(MAX_ITEMS + 1).collect()
    if len(rows) > MAX_ITEMS:
        raise ValueError(f"more than {MAX_ITEMS} items: search the benchmark in slices")
    return benchmark.sparkSession.sparkContext.broadcast(Index([(r["item_id"], r["text"]) for r in rows], threshold))


def _search(shared, batch: pa.RecordBatch, overlap: float) -> list[tuple]:
    """(row of the batch, item id, score, question share, answer share) of all finds."""
    found = []
    for lo in range(0, batch.num_rows, SLICE):
        found += [(lo + f[0], *f[1:]) for f in shared.value.search(batch.column("text").slice(lo, SLICE).to_pylist(), overlap)]
    return found


def find_leaks(
    documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, item_id, score, question_share, answer_share): the items that a document contains.

    One row per document and item: its best window, where score is the BM25 score
    as a share of the item's own. Null and empty texts and items match nothing; a
    one-word item has no answer, which then counts as found. Equal items each match. Rows with the same id
    are searched each on their own. Other columns are ignored. At most MAX_ITEMS items, which bounds the index.
    """
    shared = _shared_index(benchmark, threshold)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "item_id", "score", "question_share", "answer_share"]
        types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
        for batch in batches:
            ids, found = batch.column("doc_id").to_pylist(), _search(shared, batch, overlap)
            columns = [[ids[f[0]] for f in found], *([f[k] for f in found] for k in range(1, 5))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    docs = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).filter("text is not null")
    return docs.mapInArrow(search, "doc_id bigint, item_id bigint, score double, question_share double, answer_share double")


def count_leaks(
    documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """(doc_id, n_items) per row of ``documents``: how many items it contains, 0 for most; and the columns named in ``keep``."""
    shared = _shared_index(benchmark, threshold)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.bincount([f[0] for f in _search(shared, batch, overlap)] or np.zeros(0, np.int64), minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts[: batch.num_rows], pa.int64()), *carried(batch)], names=["doc_id", "n_items", *(["kept"] if keep else [])]
            )

    docs = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), *carry(keep))
    return with_kept(docs, search, "doc_id bigint, n_items bigint", keep)
