"""Toxicity scores by a factorization machine over hashed terms.

A text is the set of its hashed lower-case words. The score adds a weight per term
and, for every pair of terms, the product of their factor vectors: what two terms say
together, such as an insult beside the name of a group, need not be the sum of what
they say alone. Pairs cost no more than terms: their sum is half of (sum of factors)
squared minus the sum of squares. The machine is fitted by AdaGrad on a bounded
sample of the labelled texts and scores all texts in numpy batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.hashing import PUNCTUATED, word_hashes
from engram.llm.language_id import held_out

TERMS = 1 << 18
FACTORS = 8
SAMPLE = 30_000  # about so many labelled texts fit the machine
THRESHOLD = 0.3
SLICE = 500  # texts handled at a time
STEEPNESS = 2.0
PAIRS = 4e9  # so many pairs of terms in the texts are counted at most


def term_sets(texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct term slots of all texts in order, and offsets (one more than texts)."""
    words, offsets = word_hashes([t.lower() if t else t for t in texts], True, PUNCTUATED)
    text = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(offsets))
    keys = np.unique(text * TERMS + (words % np.uint64(TERMS)).astype(np.int64))
    return keys % TERMS, np.searchsorted(keys, np.arange(len(texts) + 1) * TERMS)


def _surprise(toxic, seen, expected):
    """Root of the deviance of ``toxic`` of ``seen`` texts where the share ``expected`` is."""
    share = toxic / seen
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(toxic > 0, toxic * np.log(share / expected), 0) + np.where(seen > toxic, (seen - toxic) * np.log((1 - share) / (1 - expected)), 0)
    return np.sqrt(2 * np.maximum(d, 0))


def _trust(surprise, tests: float):
    """From 0 to 1, a half where the greatest of ``tests`` surprises by chance alone is about to lie."""
    return 1 / (1 + np.exp(-STEEPNESS * (surprise - np.sqrt(2 * np.log(max(tests, 2))))))


def term_trust(terms: np.ndarray, offsets: np.ndarray, labels: np.ndarray, most: float = PAIRS) -> np.ndarray:
    """How far each term may be learned: by what it says alone, or by what a pair of it says beyond its two terms.

    Every pair is counted that lies in so many texts that it could be told from chance. With more than ``most``
    pairs in the texts, they are counted in a random part of them.
    """
    base = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(labels) else 0.5
    seen = np.bincount(terms, minlength=TERMS)
    toxic = np.bincount(terms, np.repeat(labels, np.diff(offsets)), minlength=TERMS)
    used = np.flatnonzero(seen)
    trust = np.zeros(TERMS)
    trust[used] = _trust(_surprise(toxic[used], seen[used], base), len(used))
    odds = np.log((toxic + base) / (seen - toxic + 1 - base)) - np.log(base / (1 - base))  # 0 for an unseen term
    # a pair of n texts that all have the rarer label surprises by the root of -2 n log(share)
    fewest = int(np.ceil(np.log(max(len(used), 2) ** 2 / 2) / -np.log(min(base, 1 - base))))
    order = used[seen[used] >= fewest]
    order = order[np.argsort(-seen[order], kind="stable")]
    rank = np.full(TERMS, -1, dtype=np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    text = np.repeat(np.arange(len(labels), dtype=np.int32), np.diff(offsets))
    held = rank[terms] >= 0
    text, ranks = text[held], rank[terms[held]]
    sizes = np.bincount(text, minlength=len(labels)).astype(float)
    mixed = np.random.default_rng(29).permutation(len(labels))
    taken = np.zeros(len(labels), dtype=bool)
    taken[mixed[np.cumsum(sizes[mixed] ** 2 / 2) <= most]] = True
    held = taken[text]
    text, ranks = text[held], ranks[held]
    by = np.lexsort((ranks, text))
    text, ranks = text[by], ranks[by]
    starts = np.searchsorted(text, np.arange(len(labels) + 1))[:-1]
    places = np.argsort(ranks, kind="stable")
    bounds = np.searchsorted(ranks[places], np.arange(len(order) + 1))
    guilty = labels > 0
    level, tests = odds[order] + np.log(base / (1 - base)), len(order) * (len(order) - 1) / 2
    best = np.zeros(len(order))

    def beside(at, size):
        """In how many texts each more frequent term stands beside the one at these places."""
        out = np.zeros(size, dtype=np.int64)
        for lo in range(0, len(at), 4096):
            first = starts[text[at[lo : lo + 4096]]]
            lengths = at[lo : lo + 4096] - first
            ends = np.cumsum(lengths)
            out += np.bincount(ranks[np.arange(ends[-1]) + np.repeat(first - ends + lengths, lengths)], minlength=size)
        return out

    for i in range(1, len(order)):
        at = places[bounds[i] : bounds[i + 1]]
        if len(at) < fewest:
            continue
        both = beside(at, i)
        other = np.flatnonzero(both >= fewest)
        if len(other):
            bad = beside(at[guilty[text[at]]], i)[other]
            expected = 1 / (1 + np.exp(-np.clip(level[i] + odds[order[other]], -7, 7)))
            surprise = _surprise(bad, both[other], expected)
            best[i] = max(best[i], surprise.max())
            best[other] = np.maximum(best[other], surprise)
    trust[order] = np.maximum(trust[order], _trust(best, tests))
    return trust


class FactorizationMachine:
    def __init__(self, prior: float = 0.0, seed: int = 17):
        self.bias = prior
        self.weight = np.zeros(TERMS, dtype=np.float32)
        self.factor = np.random.default_rng(seed).normal(0, 0.02, (TERMS, FACTORS)).astype(np.float32)

    def _parts(self, terms: np.ndarray, offsets: np.ndarray):
        """Linear and factor sums of each text; a text's factors are scaled by its number of terms."""
        counts = np.diff(offsets)
        text = np.repeat(np.arange(len(counts)), counts)
        linear = np.bincount(text, self.weight[terms], minlength=len(counts))
        v = self.factor[terms]
        filled = counts > 0
        sums, squares = np.zeros((len(counts), FACTORS)), np.zeros(len(counts))
        if filled.any():
            at = offsets[:-1][filled]
            sums[filled] = np.add.reduceat(v, at, axis=0)
            squares[filled] = np.add.reduceat((v * v).sum(axis=1), at)
        scale = 1 / np.sqrt(np.maximum(counts, 1))
        return text, linear, sums, squares, scale, v

    def logits(self, terms: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        _, linear, sums, squares, scale, _ = self._parts(terms, offsets)
        return self.bias + linear + 0.5 * scale * ((sums**2).sum(axis=1) - squares)

    def fit(self, terms: np.ndarray, offsets: np.ndarray, labels: np.ndarray, epochs: int = 40, rate: float = 0.5, keep: float = 1e-4, least: int = 3) -> FactorizationMachine:
        """Log-loss with a penalty on the squares; terms in fewer than ``least`` texts are not learned.

        The step of a term follows its evidence, alone or in a pair: what chance explains moves little, nothing is fixed.
        """
        rng = np.random.default_rng(23)
        common = np.bincount(terms, minlength=TERMS) >= least
        self.factor[~common] = 0
        text = np.repeat(np.arange(len(labels), dtype=np.int32), np.diff(offsets))[common[terms]]
        terms = terms[common[terms]]
        offsets = np.searchsorted(text, np.arange(len(labels) + 1))
        del text
        trust = term_trust(terms, offsets, labels)
        seen_w, seen_v, seen_b = np.ones(TERMS, np.float32), np.ones((TERMS, FACTORS), np.float32), 1.0
        counts = np.diff(offsets)
        for _ in range(epochs):
            order = rng.permutation(len(labels))
            for lo in range(0, len(order), 128):
                some = order[lo : lo + 128]
                own = np.concatenate([terms[offsets[i] : offsets[i + 1]] for i in some])
                bounds = np.concatenate(([0], np.cumsum(counts[some])))
                text, linear, sums, squares, scale, _ = self._parts(own, bounds)
                z = self.bias + linear + 0.5 * scale * ((sums**2).sum(axis=1) - squares)
                error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[some]
                g = error[text]
                key = np.sort((own.astype(np.int64) << 32) | np.arange(len(own)))
                by, own = key & 0xFFFFFFFF, key >> 32
                begins = np.flatnonzero(np.diff(own, prepend=-1))
                slots = own[begins]
                total = lambda x: np.add.reduceat(x[by], begins, axis=0) if len(by) else x
                grad_w = total(g) + keep * self.weight[slots]
                seen_w[slots] += grad_w**2
                self.weight[slots] -= rate * trust[slots] * grad_w / np.sqrt(seen_w[slots])
                pull = g * scale[text]
                grad_v = total((pull[:, None] * sums[text]).astype(np.float32)) - total(pull)[:, None] * self.factor[slots] + keep * self.factor[slots]
                seen_v[slots] += grad_v**2
                self.factor[slots] -= 0.5 * rate * trust[slots, None] * grad_v / np.sqrt(seen_v[slots])
                seen_b += error.sum() ** 2
                self.bias -= rate * error.sum() / np.sqrt(seen_b)
        return self


def fit_machine(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> FactorizationMachine:
    """A machine from (doc_id, text) and (doc_id, toxic), on about ``sample`` labelled documents.

    Which are taken depends on a hash of doc_id alone. An id that is labelled twice
    counts as toxic if any of its labels says so.
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    total = known.count()
    taken = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < (1 << 20) * min(1.0, sample / max(total, 1)))
    # a bounded sample: about ``sample`` narrow rows travel to the texts
    rows = documents.join(F.broadcast(taken), "doc_id").select("doc_id", "text", "toxic")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots, offsets = term_sets(batch.column("text").to_pylist())
            packed = [slots[s:e].astype(np.int32).tobytes() for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(packed, pa.binary())], names=["doc_id", "toxic", "terms"])

    table = rows.mapInArrow(terms, "doc_id bigint, toxic int, terms binary").toPandas().sort_values(["doc_id", "terms"], kind="stable")
    if not len(table):
        machine = FactorizationMachine(-3.0)
        machine.factor[:] = 0
        return machine
    own = [np.frombuffer(t, dtype=np.int32) for t in table["terms"]]
    gold = (table["toxic"].to_numpy() > 0).astype(float)
    share = np.clip(gold.mean(), 0.001, 0.999)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in own])))
    return FactorizationMachine(float(np.log(share / (1 - share)))).fit(np.concatenate(own), offsets, gold)


def score_toxicity(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``documents``.

    The machine is fitted on labelled rows that are not held out. Null and empty
    texts get the score of a text without terms. Without any labelled text all scores are the same
    low prior. Repeated rows and null ids (never held out) keep their rows;
    other columns are ignored.
    """
    docs = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    train = docs.filter(~held_out("doc_id")).filter("doc_id is not null")
    own = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "toxic").filter(~held_out("doc_id"))
    shared = documents.sparkSession.sparkContext.broadcast(fit_machine(train, own))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = [shared.value.logits(*term_sets(batch.column("text").slice(lo, SLICE).to_pylist())) for lo in range(0, batch.num_rows, SLICE)]
            z = np.concatenate([*z, np.zeros(0)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["doc_id", "held_out", "score"]
            )

    scored = docs.select("doc_id", held_out("doc_id").alias("held_out"), "text").mapInArrow(score, "doc_id bigint, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
