"""Alignment of two tokenizers over the same bytes, and how often their tokens meet.

A is a byte-level BPE of the ``tokenizers`` library, B a piece model of ``sentencepiece`` with byte
fallback. Both read the text with a blank before it. Spans of the tokenizers (code points for
A, bytes for B) give the cuts between tokens where a token is a span of the text; tokens that are a part of
a character (a multibyte character in several byte-level tokens, or in byte-fallback pieces) share a
span, and there the decoded bytes of the tokens set the cuts.

Neither tokenizer joins anything across a blank that follows other than white space, so a text is
read as segments that start at such blanks. That holds if no piece of B has its blank mark behind another character and A splits
by its built-in pattern; both are looked up in the vocabularies, and otherwise a segment is the whole text.
Each worker keeps what it knows of recent segments, up to a bound.

The corpus-wide count of an id pair is needed for every link. Few pairs make up most links: those
above a count that leaves at most ``HEAVY`` pairs are sent to every task. Links of all other pairs, none
of which is frequent, meet their counts in a join.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.scratch import Scratch

HEAVY = 1 << 20  #: pairs sent to every task: 16 bytes each
KNOWN = 400_000  #: segments that a worker remembers
SLICE = 1 << 20  #: code points that are put together at once
LONGEST = 256  #: code points of a segment that is remembered
FLUSH = 4_000_000  #: links counted by a task before it passes on their sums
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
BLANK = "▁"
_CUT = re.compile(r"(?<=\S)(?= .)", re.DOTALL)
_UNEVEN = re.compile(r"\s ")
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it is printable, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Aligner:
    """Tokens and cuts of segments for one pair of tokenizers."""

    def __init__(self, a_json: str, b_model: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        letters = _byte_letters()
        entries = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(entries.values(), default=-1) + 1)
        for entry, i in entries.items():
            self.a_bytes[i] = bytes(letters[c] for c in entry)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        found = [_BYTE_PIECE.fullmatch(p) for p in pieces]
        self.b_bytes = [
            bytes([int(m.group(1), 16)]) if m and self.b.is_byte(i) else p.replace(BLANK, " ").encode()
            for i, (p, m) in enumerate(zip(pieces, found, strict=True))
        ]
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        split = json.loads(a_json).get("pre_tokenizer") or {}
        by_pattern = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
        decimal = lambda n, mark: np.array([f"{i}{mark}" for i in range(n)], dtype=object)
        self.a_comma, self.a_bar = (decimal(len(self.a_bytes), m) for m in ",|")
        self.b_comma, self.b_end = (decimal(len(self.b_bytes), m) for m in ",;")
        self.dtype = np.uint16 if max(len(entries), len(pieces)) <= 1 << 16 else np.int32
        self.by_segment = by_pattern and not any(BLANK in p.lstrip(BLANK) for p in pieces)
        self.known: dict[str, int] = {}
        self._clear()

    def _clear(self) -> None:
        self.known.clear()
        self.good: list[bool] = []
        self.groups: list[str] = []
        self.a_ids: list[bytes] = []
        self.b_ids: list[bytes] = []
        self.n_groups: list[int] = []
        self.uses = np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keeps the segments that came more than once, as far as they are no more than half of what may be known."""
        uses = np.zeros(len(self.good), np.int64)
        uses[: len(self.uses)] = self.uses
        least = max(2, int(np.partition(uses, -(KNOWN // 2))[-(KNOWN // 2)]) + 1 if len(uses) > KNOWN // 2 else 2)
        keep = [(s, k) for s, k in self.known.items() if uses[k] >= least and len(s) <= LONGEST]
        held = [(self.good[k], self.a_ids[k], self.b_ids[k], self.groups[k], self.n_groups[k]) for _, k in keep]
        self._clear()
        self._remember([s for s, _ in keep], held)

    def _remember(self, segments: list[str], learned: list[tuple]) -> None:
        for segment, (good, a, b, groups, n) in zip(segments, learned, strict=True):
            self.known[segment] = len(self.good)
            self.good.append(good)
            self.a_ids.append(a)
            self.b_ids.append(b)
            self.groups.append(groups)
            self.n_groups.append(n)

    def used(self, numbers: list[list[int]]) -> None:
        counts = np.bincount([k for found in numbers for k in found], minlength=len(self.good))
        counts[: len(self.uses)] += self.uses
        self.uses = counts

    def segments(self, text: str) -> list[str]:
        """Parts of a text without the blank that each starts with."""
        if not self.by_segment:
            return [text]
        if text[:1] != " " and text[-1:] != " " and not _UNEVEN.search(text):
            return text.split(" ")
        return [s[1:] for s in _CUT.split(" " + text)]

    def learn(self, segments: list[str]) -> list[tuple]:
        """(good, A ids, B ids, groups as text, number of groups) of each segment; every group ends with a semicolon.

        Segments that nothing can join are read as one text. One that ends with white space could run into the
        next, and is read alone.
        """
        alone = [k for k, s in enumerate(segments) if not self.by_segment or not s or s[-1].isspace()]
        apart = set(alone)
        rest = [k for k in range(len(segments)) if k not in apart]
        out: list[tuple] = [(False, b"", b"", "", 0)] * len(segments)
        for some in [*([k] for k in alone), rest]:
            for k, found in zip(some, self._read([segments[k] for k in some]) if some else [], strict=True):
                out[k] = found
        return out

    def _read(self, segments: list[str]) -> list[tuple]:
        """The same for segments that follow each other; where some do not come out as they went in, in halves."""
        found = self._together(segments)
        if found is not None:
            return found
        if len(segments) == 1:
            return [(False, b"", b"", "", 0)]
        middle = len(segments) // 2
        return self._read(segments[:middle]) + self._read(segments[middle:])

    def _together(self, segments: list[str]) -> list[tuple] | None:
        """None if the tokens do not give back the bytes, or the end of a segment is not the end of tokens."""
        text = " " + " ".join(segments)
        data = text.encode("utf-8", "surrogatepass")
        first = self.a.encode(text, add_special_tokens=False)
        pieces = [(p.id, p.end) for p in self.b.encode(text[1:], return_type="proto").pieces]
        a = np.array(first.ids, np.int64)
        b, b_to = np.array(pieces, np.int64).reshape(-1, 2).T
        if b"".join([self.a_bytes[i] for i in first.ids]) != data or b"".join([self.b_bytes[i] for i, _ in pieces]) != data:
            return None
        chars = np.cumsum([0, *(len(s) + 1 for s in segments)])
        if len(data) == len(text):
            place = np.arange(len(text) + 1)
        else:  # the byte at which every code point begins
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            place = np.concatenate(([0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))))
        begins = place[chars]
        spans = place[np.array(first.offsets, np.int64).reshape(-1, 2)]
        a_cuts = _cuts(spans[:, 0], spans[:, 1], self.a_len[a])
        # B's spans are of the text without the blank before it, and each begins where the one before ended
        b_cuts = _cuts(np.concatenate(([0], b_to[:-1] + 1)), b_to + 1, self.b_len[b])
        both = np.zeros(len(data) + 1, np.uint8)
        both[a_cuts] |= 1
        both[b_cuts] |= 2
        cut = both == 3
        if not cut[begins[1:]].all():
            return None
        group = np.cumsum(cut)  # groups that end up to a byte
        a_last, b_last = cut[a_cuts], cut[b_cuts]
        side = np.concatenate([(group[a_cuts] - a_last) * 2, (group[b_cuts] - b_last) * 2 + 1])
        written = np.concatenate([np.where(a_last, self.a_bar[a], self.a_comma[a]), np.where(b_last, self.b_end[b], self.b_comma[b])])
        written = written[np.argsort(side, kind="stable")].tolist()
        a_at, b_at = np.searchsorted(a_cuts, begins, "right"), np.searchsorted(b_cuts, begins, "right")
        a_at[0] = b_at[0] = 0
        words, groups = (a_at + b_at).tolist(), np.diff(group[begins]).tolist()
        a_raw, b_raw, size = a.astype(self.dtype).tobytes(), b.astype(self.dtype).tobytes(), self.dtype().itemsize
        a_at, b_at = (a_at * size).tolist(), (b_at * size).tolist()
        return [
            (True, a_raw[a_at[k] : a_at[k + 1]], b_raw[b_at[k] : b_at[k + 1]], "".join(written[words[k] : words[k + 1]]), groups[k])
            for k in range(len(segments))
        ]

    def look_up(self, parts: list[list[str]]) -> list[list[int]]:
        """Numbers of the segments of several texts; they hold until the next call."""
        known = self.known
        fresh = list(dict.fromkeys(p for text in parts for p in text if p not in known))
        if len(known) + len(fresh) > KNOWN:
            self._forget()
            fresh = list(dict.fromkeys(p for text in parts for p in text if p not in known))
        for lo in range(0, len(fresh), 2000):
            some = fresh[lo : lo + 2000]
            self._remember(some, self.learn(some))
        numbers = [[known[p] for p in text] for text in parts]
        self.used(numbers)
        return numbers

    def forget_long(self) -> None:
        if any(len(p) > LONGEST for p in list(self.known)[-5000:]):
            self._forget()


def _cuts(begins: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte positions at which tokens end: the ends of their spans, or what the bytes of all tokens before say.

    A token that is its whole span ends with it; one that is a part of a character has only its bytes to go by.
    """
    return np.where(ends - begins == sizes, ends, np.cumsum(sizes))


class _Shared:
    """Both tokenizer files as a broadcast; an aligner is built once per worker process."""

    def __init__(self, spark, a_path: str | None, b_path: str | None):
        import public_tokenizers

        with open(a_path or public_tokenizers.path(A_FILE), encoding="utf-8") as file:
            a = file.read()
        with open(b_path or public_tokenizers.path(B_FILE), "rb") as file:
            b = file.read()
        self.key = hashlib.sha256(a.encode() + b).hexdigest()
        self.files = spark.sparkContext.broadcast((a, b))

    def __hash__(self):
        return hash(self.key)

    def __eq__(self, other):
        return self.key == other.key

    def aligner(self) -> Aligner:
        return _aligner(self)


@lru_cache(maxsize=1)
def _aligner(shared: _Shared) -> Aligner:
    return Aligner(*shared.files.value)


_TOKENS = "row bigint, doc_id bigint, a binary, b binary, n_groups bigint, groups_sha256 string"


def _tokenised(shared: _Shared):
    """Ids of both tokenizers and the groups of every text; no ids for texts that one of them changes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = shared.aligner()
        # millions of small lists and tuples without a cycle: looking for cycles among them took a third of the time
        gc.disable()
        try:
            for batch in batches:
                rows, ids, texts = (batch.column(c).to_pylist() for c in ("row", "doc_id", "text"))
                lo = 0
                while lo < len(texts):
                    hi, size = lo, 0
                    while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= SLICE):
                        size += len(texts[hi] or "")
                        hi += 1
                    yield _token_rows(aligner, rows[lo:hi], ids[lo:hi], texts[lo:hi])
                    aligner.forget_long()
                    lo = hi
        finally:
            gc.enable()

    return run


def _token_rows(aligner: Aligner, rows, ids, texts) -> pa.RecordBatch:
    none = (b"", b"", 0, "")
    out = [none] * len(texts)
    at = [k for k, t in enumerate(texts) if t]
    numbers = aligner.look_up([aligner.segments(texts[k]) for k in at])
    good, a_ids, b_ids, groups, n_groups = aligner.good, aligner.a_ids, aligner.b_ids, aligner.groups, aligner.n_groups
    for k, found in zip(at, numbers, strict=True):
        if all([good[s] for s in found]):
            digest = hashlib.sha256("".join([groups[s] for s in found])[:-1].encode()).hexdigest()
            out[k] = (b"".join([a_ids[s] for s in found]), b"".join([b_ids[s] for s in found]), sum([n_groups[s] for s in found]), digest)
    a, b, n, digest = zip(*out, strict=True) if out else ((), (), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64()), pa.array(digest, pa.string())],
        names=["row", "doc_id", "a", "b", "n_groups", "groups_sha256"],
    )


class _Slice:
    """Several texts of a batch of ids at once: every link and the text that it belongs to."""

    def __init__(self, aligner: Aligner, a: list[bytes], b: list[bytes]):
        self.n_a = np.array([len(x) for x in a], np.int64) // aligner.dtype().itemsize
        self.n_b = np.array([len(x) for x in b], np.int64) // aligner.dtype().itemsize
        a_ids = np.frombuffer(b"".join(a), aligner.dtype).astype(np.int64)
        b_ids = np.frombuffer(b"".join(b), aligner.dtype).astype(np.int64)
        self.a_ends, b_ends = np.cumsum(aligner.a_len[a_ids]), np.cumsum(aligner.b_len[b_ids])
        # both run over the same bytes; a stretch between cuts of either lies in one token of each
        cuts = np.zeros(int(self.a_ends[-1]) + 1 if len(a_ids) else 0, np.uint8)
        cuts[self.a_ends] |= 1
        cuts[b_ends] |= 2
        where = np.flatnonzero(cuts)
        kind = cuts[where]
        at_a, at_b = np.cumsum(kind & 1, dtype=np.int64) - (kind & 1), np.cumsum(kind >> 1, dtype=np.int64) - (kind >> 1)
        self.pairs = a_ids[at_a] * len(aligner.b_len) + b_ids[at_b]
        sizes = np.concatenate(([0], self.a_ends))
        ends = sizes[np.cumsum(self.n_a)]
        self.upto = np.concatenate(([0], np.searchsorted(where, ends, "right")))

    def per_text(self, values: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
        return sums[self.upto[1:]] - sums[self.upto[:-1]]


def _slices(aligner: Aligner, batch: pa.RecordBatch) -> Iterator[tuple[int, int, _Slice]]:
    a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
    lo = 0
    while lo < len(a):
        hi, size = lo, 0
        while hi < len(a) and (hi == lo or size + len(a[hi]) <= SLICE):
            size += len(a[hi])
            hi += 1
        yield lo, hi, _Slice(aligner, a[lo:hi], b[lo:hi])
        lo = hi


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    pairs, at = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
    return pairs, np.bincount(at, np.concatenate([n for _, n in parts]), len(pairs)).astype(np.int64)


def _counted(shared: _Shared):
    """(pair, n): links of a task, added up before they are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = shared.aligner()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def passed_on() -> Iterator[pa.RecordBatch]:
            pairs, n = _merged(held)
            for lo in range(0, len(pairs), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[lo : lo + 100_000]), pa.array(n[lo : lo + 100_000])], names=["pair", "n"])

        for batch in batches:
            for _, _, links in _slices(aligner, batch):
                held.append(np.unique(links.pairs, return_counts=True))
                if sum(len(p) for p, _ in held) > FLUSH:
                    held = [_merged(held)]
                    if len(held[0][0]) > FLUSH // 2:
                        yield from passed_on()
                        held = []
        if held:
            yield from passed_on()

    return run


class _Heavy:
    """Pairs with a high count, in order, for look-up by bisection."""

    def __init__(self, spark, rows: pa.Table):
        order = np.argsort(rows["pair"].to_numpy())
        self.values = spark.sparkContext.broadcast(tuple(rows[c].to_numpy()[order] for c in ("pair", "n", "best")))


_SUMS = "row bigint, n_a bigint, n_b bigint, n_links bigint, n_best bigint, count_sum bigint, light array<bigint>, times array<bigint>"


def _summed(shared: _Shared, heavy: _Heavy):
    """What the heavy pairs say of every text, and its links of other pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = shared.aligner()
        known, counts, best = heavy.values.value
        for batch in batches:
            rows = batch.column("row")
            for lo, hi, links in _slices(aligner, batch):
                at = np.searchsorted(known, links.pairs)
                at[at == len(known)] = 0
                hit = known[at] == links.pairs if len(known) else np.zeros(len(links.pairs), bool)
                n = np.where(hit, counts[at], 0) if len(known) else np.zeros(len(links.pairs), np.int64)
                first = hit & best[at] if len(known) else hit
                text = np.repeat(np.arange(hi - lo), np.diff(links.upto))
                span = len(aligner.a_len) * len(aligner.b_len)
                keys, times = np.unique(text[~hit] * span + links.pairs[~hit], return_counts=True)
                offsets = pa.array(np.searchsorted(keys, np.arange(hi - lo + 1) * span), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [rows.slice(lo, hi - lo), pa.array(links.n_a), pa.array(links.n_b), pa.array(np.diff(links.upto)), pa.array(links.per_text(first)),
                     pa.array(links.per_text(n)), pa.ListArray.from_arrays(offsets, pa.array(keys % span)), pa.ListArray.from_arrays(offsets, pa.array(times))],
                    names=["row", "n_a", "n_b", "n_links", "n_best", "count_sum", "light", "times"],
                )

    return run


def _tokens(documents: DataFrame, shared: _Shared, id_col: str, text_col: str) -> DataFrame:
    rows = documents.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    return rows.mapInArrow(_tokenised(shared), _TOKENS)


def align_tokens(documents: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, a, b, a_ends, b_ends) per row: ids of both tokenizers and the byte positions where their tokens end.

    Positions count from the blank before the text. Rows as in ``alignment_counts``; texts without tokens have empty lists.
    """
    shared = _Shared(documents.sparkSession, a_path, b_path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = shared.aligner()
        for batch in batches:
            out = batch[["doc_id"]].copy()
            for side, sizes in (("a", aligner.a_len), ("b", aligner.b_len)):
                ids = [np.frombuffer(x, aligner.dtype).astype(np.int64) for x in batch[side]]
                out[side], out[f"{side}_ends"] = ids, [np.cumsum(sizes[x]) for x in ids]
            yield out

    return _tokens(documents, shared, id_col, text_col).mapInPandas(run, "doc_id bigint, a array<bigint>, a_ends array<bigint>, b array<bigint>, b_ends array<bigint>")


def _pair_counts(tokens: DataFrame, shared: _Shared, n_b: int) -> DataFrame:
    """(pair, n, best): links of every id pair, and whether no pair of its B id has more."""
    pairs = tokens.select("a", "b").mapInArrow(_counted(shared), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    return pairs.withColumn("b", F.col("pair") % n_b)


def alignment_counts(
    documents: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row.

    Tokens of A and B link where their byte ranges overlap; byte positions where tokens of both end cut them into groups. The count of
    an id pair is its number of links in all rows. n_best are the links whose count is the highest of their B id, ties
    included; count_sum adds the counts of all links.

    Null and empty texts, and texts whose tokens do not give back the bytes of blank and text, have no
    tokens: zeros, and '' as digest. Texts of any length are read whole. Repeated rows count each time; null ids
    keep their rows; other columns are ignored; an empty table gives an empty one. ``a_path`` and ``b_path`` are
    the files of the tokenizers; ``heavy`` only bounds what is sent to tasks and changes no result.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "alignment")
    shared = _Shared(spark, a_path, b_path)
    n_b = len(shared.aligner().b_len)
    tokens = scratch.keep(_tokens(documents, shared, id_col, text_col), "tokens")
    counted = scratch.keep(_pair_counts(tokens, shared, n_b), "counted")
    most = counted.groupBy("b").agg(F.max("n").alias("most"))  # one row per B id
    pairs = scratch.keep(counted.join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")
    least = _least_heavy(pairs, heavy)
    top = _Heavy(spark, pairs.filter(F.col("n") >= least).toArrow())
    sums = scratch.keep(tokens.select("row", "a", "b").mapInArrow(_summed(shared, top), _SUMS), "sums")
    light = sums.select("row", F.explode(F.arrays_zip("light", "times")).alias("l")).select("row", F.col("l.light").alias("pair"), F.col("l.times").alias("times"))
    more = light.join(pairs.filter(F.col("n") < least), "pair").groupBy("row").agg(
        F.sum(F.col("n") * F.col("times")).alias("more_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best")
    )
    plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).cast("bigint").alias(a)
    return tokens.select("row", "doc_id", "n_groups", "groups_sha256").join(sums.drop("light", "times"), "row").join(more, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", plus("n_best", "more_best"), plus("count_sum", "more_sum"), "groups_sha256"
    )


def _least_heavy(pairs: DataFrame, heavy: int) -> int:
    """The least count that no more than ``heavy`` pairs reach, up to a twelfth of an octave."""
    bins = pairs.groupBy(F.floor(F.log2("n") * 12).alias("bin")).agg(F.count("*").alias("pairs"), F.min("n").alias("least")).collect()
    least, total = 1 << 62, 0
    for r in sorted(bins, key=lambda r: -r["bin"]):
        total += r["pairs"]
        if total > heavy:
            break
        least = r["least"]
    return least
