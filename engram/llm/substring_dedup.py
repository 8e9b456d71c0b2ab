"""Repeated passages across documents by content-defined chunks.

A gear rolling hash over the bytes of a text (every byte value has a random number;
the hash doubles and adds it, so a byte leaves it after 16 steps) cuts the text where
it falls below ``1/AVERAGE`` of its range. Where a text is cut depends on the 16 bytes
before alone: text inserted before a passage does not move the cuts in it. Chunks are
compared by digest. Following chunks of a document that all occur elsewhere too form
a repeated passage.

The chunks at the two ends of a shared passage also hold what lies beside it, so
they differ and a passage is found without its ends. It is reported if the found part has
``MIN_CORE`` words, and ``min_words`` words would fit with the two chunks beside it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.llm import hashing
from engram.llm.scratch import Scratch

AVERAGE = 32
WINDOW = 16
MIN_WORDS = 50
MIN_CORE = 8
STRETCH = 512  # bytes without a cut after which the least hash of the stretch makes them
LONGEST = 1 << 24  # bytes without a cut after which one is made

_gear = np.random.default_rng(41).integers(0, 1 << 16, 256, dtype=np.uint16)


def cut_positions(raw: np.ndarray, average: int = AVERAGE) -> np.ndarray:
    """Positions before which the bytes are cut, between code points; the ends are not among them."""
    h = _gear[raw]
    for k in (1, 2, 4, 8):
        step = h.copy()
        step[k:] += h[:-k] << np.uint16(k)
        h = step
    may = np.ones(len(raw), dtype=bool)
    may[: WINDOW - 1] = False
    may[1:] &= raw[1:] != raw[:-1]  # a run of one byte is not cut up
    at = np.flatnonzero(may & (h < np.uint16((1 << 16) // average)))
    # text that goes round in a circle may have no such place: it is cut where the hash is least
    ends = np.concatenate(([0], at, [len(raw)]))
    for k in np.flatnonzero(np.diff(ends) > STRETCH):
        own = np.arange(ends[k] + 1, ends[k + 1])
        own = own[may[own]]
        if len(own):
            at = np.concatenate((at, own[h[own] == h[own].min()]))
    at = np.sort(at) + 1
    at = at[at < len(raw)]
    for _ in range(3):
        at = at + ((raw[np.minimum(at, len(raw) - 1)] & 0xC0) == 0x80)
    at = at[at < len(raw)]
    return at[np.concatenate(([True], np.diff(at) > 0))] if len(at) else at


def _chunks_of(data: bytes, average: int):
    """Arrays (start, end, words, digest) of the chunks of one text, start and end in code points.

    A long text is read in pieces; each begins at the last cut of the one before.
    """
    at, points = 0, 0
    while at < len(data):
        size = hashing.PIECE
        while True:
            # the bytes before decide the first cuts
            lead = min(at, WINDOW)
            raw = np.frombuffer(data, dtype=np.uint8, count=min(size, len(data) - at) + lead, offset=at - lead)
            cuts = cut_positions(raw, average) - lead
            cuts = cuts[cuts > 0]
            final = at + size >= len(data)
            if final or len(cuts) or size >= LONGEST:
                break
            size *= 2
        raw = raw[lead:]
        if final:
            cuts = np.concatenate((cuts, [len(raw)]))
        elif not len(cuts):
            end = len(raw)
            while raw[end - 1] & 0xC0 == 0x80:
                end -= 1
            cuts = np.array([end - 1])
        raw = raw[: cuts[-1]]
        start = np.concatenate(([0], cuts[:-1]))
        up, down = hashing._tables(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(hashing._codes[raw] * up[: len(raw)], out=sums[1:])
        digest = hashing.mix((sums[cuts] - sums[start]) * down[start] + (cuts - start).astype(np.uint64))
        lead_bytes = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        space = hashing._is_separator[raw]
        begins = ~space
        begins[1:] &= space[:-1]
        words = np.concatenate(([0], np.cumsum(begins)))
        yield lead_bytes[start] + points, lead_bytes[cuts] + points, words[cuts] - words[start], digest.view(np.int64)
        points += int(lead_bytes[-1])
        at += int(cuts[-1])


def _chunk_table(average: int):
    """Rows (doc_id, place, shape, digest), few and narrow columns since there is one row per chunk.

    place has the number of the chunk and its start, shape its size (code points), its words
    and those of the chunks before and after it.
    """
    names = ["doc_id", "place", "shape", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, ids, size = [], [], 0

            def flush():
                columns = [np.concatenate(c) for c in zip(*held, strict=True)]
                counts = [len(h[0]) for h in held]
                docs = pa.array(ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(ids)), counts)))
                return pa.RecordBatch.from_arrays([docs, *map(pa.array, columns)], names=names)

            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not text:
                    continue
                parts = list(_chunks_of(text.encode("utf-8", "surrogatepass"), average))
                start, end, words, digest = (np.concatenate(c) for c in zip(*parts, strict=True))
                beside = np.minimum(words, 1023)
                before, after = np.concatenate(([0], beside[:-1])), np.concatenate((beside[1:], [0]))
                shape = ((end - start) << 36) | (np.minimum(words, 65535) << 20) | (before << 10) | after
                held.append(((np.arange(len(words)) << 32) | start, shape, digest))
                ids.append(doc_id)
                size += len(words)
                if size >= 200_000:
                    yield flush()
                    held, ids, size = [], [], 0
            if held:
                yield flush()

    return run


def repeated_passages(
    documents: DataFrame, min_words: int = MIN_WORDS, average: int = AVERAGE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, start, end, words, occurrences, first_doc_id, is_first): passages that occur more than once.

    One row per passage of a document, in code points, end exclusive. occurrences is the
    count of its rarest chunk, first_doc_id the smallest id with that chunk and
    is_first whether this is the first occurrence of all its chunks: what to drop for one
    copy of everything are the rows where it is false. Passages within one document count too.
    Null and empty texts have none. Rows with one id are read as parts of one document, and a row that repeats as a whole counts in occurrences
but is no passage of its own; a null id takes part and comes first. Other columns are ignored.
    """
    scratch = Scratch(documents.sparkSession, "chunks")
    docs = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    chunks = scratch.keep(
        docs.filter("text is not null").mapInArrow(_chunk_table(average), "doc_id bigint, place bigint, shape bigint, digest bigint"), "chunks"
    )
    shared = chunks.groupBy("digest").agg(F.count("*").alias("occurrences"), F.min(F.struct("doc_id", "place")).alias("first")).filter("occurrences > 1")
    found = chunks.join(shared, "digest").select("doc_id", "place", "shape", "occurrences", "first")
    of_doc = Window.partitionBy("doc_id").orderBy("place")
    bits = lambda shift, count: F.shiftright("shape", shift).bitwiseAND(F.lit((1 << count) - 1))
    no, start = F.shiftright("place", 32), F.col("place").bitwiseAND(F.lit((1 << 32) - 1))
    passages = (
        found.withColumn("again", F.col("place").eqNullSafe(F.lag("place").over(of_doc))).filter("not again")
        .withColumn("run", no - F.dense_rank().over(of_doc)).groupBy("doc_id", "run").agg(
            F.min(start).alias("start"), F.max(start + F.shiftright("shape", 36)).alias("end"), F.sum(bits(20, 16)).alias("words"),
            F.min("occurrences").alias("occurrences"), F.min_by("first.doc_id", "occurrences").alias("first_doc_id"),
            F.min(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("place") == F.col("first.place"))).alias("is_first"),
            (F.min_by(bits(10, 10), "place") + F.max_by(bits(0, 10), "place")).alias("more"),
        )
    )
    result = scratch.keep(
        passages.filter((F.col("words") >= MIN_CORE) & (F.col("words") + F.col("more") >= min_words)).drop("run", "more"), "result"
    )
    scratch.drop("chunks")
    return result
