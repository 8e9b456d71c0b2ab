"""Byte-level BPE over whole texts in overlapping chunks.

A text of more than ``CHUNK`` code points is cut into chunks that any task can
work on; each carries ``OVERLAP`` code points of the next. A chunk is pre-tokenised
from its first code point, which may lie within a pre-token of the whole text, and
from the start of the next chunk. The scan of a pre-token looks at nothing before
it, so from the first boundary that both scans of an overlap have, they agree: there
the chunks are stitched. Each chunk then encodes its pre-tokens; ids before
the stitch come from the one chunk, ids after it from the other. No stitch lies behind
white space, whose pre-token depends on what follows.

A text whose scans do not meet in some overlap (a pre-token longer than that) is
encoded by one scan over the whole of it. Texts of one chunk need no stitching and
leave the task that read them as finished rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 16
OVERLAP = 1 << 10
RANKS = "byte_bpe_50k.tiktoken"


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path(RANKS)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Codec:
    """Ids of texts and bytes of ids for one rank table and pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.decimal = [str(i) for i in range(max(ranks.values(), default=-1) + 1)]

    def boundaries(self, text: str, start: int, end: int) -> list[int]:
        """Ends of the pre-tokens of text[start:end], as positions in text."""
        return [start + m.end() for m in self.pattern.finditer(text[start:end])]

    def encode(self, text: str) -> list[int]:
        """Ids of a text that starts at a pre-token boundary."""
        return self.encoding.encode_ordinary(text)

    def decode(self, ids) -> bytes:
        return self.encoding.decode_bytes(ids)


@lru_cache(maxsize=2)
def _codec(key: str, holder) -> Codec:
    ranks, pattern = holder.value
    return Codec(ranks, pattern)


class _Shared:
    """A broadcast rank table; the codec is built once per worker process."""

    def __init__(self, spark, path: str | None, pattern: str | None):
        ranks, pattern = read_ranks(path or default_ranks()), pattern or default_pattern()
        self.key = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()
        self.value_of = spark.sparkContext.broadcast((ranks, pattern))

    def __hash__(self):
        return hash(self.key)

    def __eq__(self, other):
        return self.key == other.key

    @property
    def value(self):
        return self.value_of.value

    def codec(self) -> Codec:
        return _codec(self.key, self)


def _chunk_rows(shared: _Shared, chunk: int, overlap: int):
    """Per chunk: ids, and ids before each boundary of its first and last overlap."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = shared.codec()
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                text, ids = r.piece, []
                # the last piece has nothing after it; else what lies beyond chunk is the next one's overlap
                has_next = bool(r.more)
                ends = codec.boundaries(text, 0, len(text))
                heads, tails = [(0, 0)], []
                cut = 0
                for b in ends:
                    if b == len(text) and has_next:
                        break
                    if text[b - 1].isspace():  # white space may be read otherwise where a text ends after it
                        continue
                    near_head = b <= overlap
                    near_tail = has_next and b >= chunk
                    if near_head or near_tail:
                        ids += codec.encode(text[cut:b])
                        cut = b
                        if near_head:
                            heads.append((b, len(ids)))
                        if near_tail:
                            tails.append((b - chunk, len(ids)))
                if not has_next:
                    ids += codec.encode(text[cut:])
                out.append((
                    r.row, r.no, np.asarray(ids, np.int32).tobytes(), np.asarray(heads, np.int64).tobytes(), np.asarray(tails, np.int64).tobytes(),
                ))
            yield pd.DataFrame(out, columns=["row", "no", "ids", "heads", "tails"])

    return run


def _join_chunks(parts: pd.DataFrame) -> list[int] | None:
    """Ids of a text from its chunks, or None if two of them do not meet."""
    parts = parts.sort_values("no")
    out: list[np.ndarray] = []
    first = 0
    rows = list(parts.itertuples(index=False))
    for k, r in enumerate(rows):
        ids = np.frombuffer(r.ids, np.int32)
        if k + 1 == len(rows):
            out.append(ids[first:])
            break
        tails = dict(np.frombuffer(r.tails, np.int64).reshape(-1, 2).tolist())
        heads = np.frombuffer(rows[k + 1].heads, np.int64).reshape(-1, 2).tolist()
        meet = next(((tails[at], n) for at, n in heads if at in tails and tails[at] >= first), None)
        if meet is None:
            return None
        out.append(ids[first : meet[0]])
        first = meet[1]
    return np.concatenate(out).tolist()


def _digests(codec: Codec, ids: list[int]) -> tuple[int, str, str]:
    joined = " ".join([codec.decimal[i] for i in ids])
    return len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()


def _ids_only(codec: Codec, ids: list[int]) -> tuple[list[int]]:
    return (ids,)


def _encoded(documents: DataFrame, finish, fields: list[tuple[str, pa.DataType]], schema: str, ranks, pattern, id_col, text_col, chunk, overlap) -> DataFrame:
    """One row per document with ``finish(codec, ids)``."""
    shared = _Shared(documents.sparkSession, ranks, pattern)
    rows = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = F.length("text")

    def table(ids, values):
        columns = list(zip(*values, strict=True)) or [[] for _ in fields]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), *(pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True))],
            names=["doc_id", *(n for n, _ in fields)],
        )

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.codec()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            texts = batch.column("text").to_pylist()
            for lo in range(0, len(ids), 500):
                yield table(ids[lo : lo + 500], [finish(codec, codec.encode(t)) for t in texts[lo : lo + 500]])

    one = rows.filter(size <= chunk).mapInArrow(short, f"doc_id bigint, {schema}")

    long = rows.filter(size > chunk).withColumn("row", F.monotonically_increasing_id())
    last = F.floor((size - 1) / chunk).cast("int")
    pieces = long.select("row", "doc_id", "text", size.alias("size"), F.explode(F.sequence(F.lit(0), last)).alias("no")).select(
        "row", "doc_id", "no", (F.col("no") < F.floor((F.col("size") - 1) / chunk)).alias("more"),
        F.substring("text", F.col("no") * chunk + 1, F.lit(chunk + overlap)).alias("piece"),
    )
    coded = pieces.repartition(F.col("row"), F.col("no")).select("row", "no", "more", "piece").mapInPandas(
        _chunk_rows(shared, chunk, overlap), "row bigint, no int, ids binary, heads binary, tails binary"
    )

    def whole(key, parts: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        codec = shared.codec()
        ids = _join_chunks(parts) if len(parts) else None
        if ids is None:
            ids = codec.encode(texts["text"].iloc[0])
        values = finish(codec, ids)
        return pd.DataFrame([(texts["doc_id"].iloc[0], *values)], columns=["doc_id", *(n for n, _ in fields)])

    many = coded.groupBy("row").cogroup(long.groupBy("row")).applyInPandas(whole, f"doc_id bigint, {schema}")
    return one.unionByName(many)


def encode(documents: DataFrame, ranks: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids) per row: the ids of its whole text.

    ``ranks`` is the path of a rank file, ``pattern`` its pre-token pattern. Null
    texts are empty: no ids. Repeated rows and null ids keep their rows; other
    columns are ignored.
    """
    return _encoded(documents, _ids_only, [("ids", pa.list_(pa.int32()))], "ids array<int>", ranks, pattern, id_col, text_col, chunk, overlap)


def decode(rows: DataFrame, ranks: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, bytes) per row of (doc_id, ids): the raw bytes of the ids, joined; null ids give null."""
    shared = _Shared(rows.sparkSession, ranks, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.codec()
        for batch in batches:
            raw = [None if ids is None else codec.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], names=["doc_id", "bytes"])

    return rows.select(F.col(id_col).cast("bigint").alias("doc_id"), "ids").mapInArrow(run, "doc_id bigint, bytes binary")


def round_trip(documents: DataFrame, ranks: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of what ``encode`` and then ``decode`` give."""
    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    return _encoded(documents, _digests, fields, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", ranks, pattern, id_col, text_col, chunk, overlap)
