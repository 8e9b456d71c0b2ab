"""Language identification by n-gram filters that answer for all languages at once.

A filter slot is a bitmask with one bit per language: the bit slices of one Bloom
filter per language lie side by side, so one lookup of an n-gram (the AND of its
``HASHES`` slots) returns every language that contains it. A document's hits are
counted per bit, the expected false positives of each filter are taken off, and
the language with most of what is left is predicted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.carry import carried, carry, with_kept
from engram.llm.hashing import mix

PER_LANGUAGE = 2000  # about so many labelled documents of a language fit the filters
MIN_SHARE = 0.02  # a language contains an n-gram that so many of its documents have
SLOTS = 1 << 20
HASHES = 4
PIECE = 1 << 20  # code points handled at a time
UNKNOWN = "und"
_SPACE = 0
_letters: list[np.ndarray] = []


def held_out(id_col: str = "doc_id") -> Column:
    """The rows that no model may learn from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _pieces(text: str) -> list[str]:
    """The text in pieces of about PIECE code points, cut before a code point that is no letter."""
    if len(text) <= PIECE:
        return [text]
    out, at = [], 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end].isalpha():
            end += 1
        out.append(text[at:end])
        at = end
    return out


def trigrams(texts) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: n-gram hashes, the index of the text of each, and letters per text.

    Lower-cased letters; whatever is between two words counts as one space, and
    n-grams stay within a word and the spaces around it.
    """
    is_letter = _is_letter()
    n = len(texts)
    parts: list[str] = []
    owner: list[int] = []
    size = 0

    def run():
        joined = "\n" + "\n".join(parts) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        lengths = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
        of = np.concatenate(([owner[0]], np.repeat(owner, lengths)))
        letter = is_letter[codes]
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[0] = True
        codes, of, letter = np.where(letter, codes, _SPACE)[keep].astype(np.uint64), of[keep], letter[keep]
        count = np.bincount(of[letter], minlength=n)
        middle = letter[1:-1]
        grams = codes[:-2] | (codes[1:-1] << np.uint64(21)) | (codes[2:] << np.uint64(42))
        return mix(grams[middle]), of[1:-1][middle], count

    for i, text in enumerate(texts):
        for piece in _pieces((text or "").lower()):
            if parts and size + len(piece) > PIECE:
                yield run()
                parts, owner, size = [], [], 0
            parts.append(piece)
            owner.append(i)
            size += len(piece)
    if parts:
        yield run()


def _slots(grams: np.ndarray) -> list[np.ndarray]:
    step = grams >> np.uint64(32) | np.uint64(1)
    return [((grams + np.uint64(k) * step) & np.uint64(SLOTS - 1)).astype(np.int64) for k in range(HASHES)]


@dataclass
class LanguageFilters:
    languages: list[str]
    masks: np.ndarray
    false_rate: np.ndarray

    def contained_in(self, grams: np.ndarray) -> np.ndarray:
        """Bitmask of the languages that contain each n-gram."""
        found = None
        for at in _slots(grams):
            found = self.masks[at] if found is None else found & self.masks[at]
        return found

    def predict(self, texts) -> tuple[list[str], np.ndarray]:
        n, total = len(texts), len(self.languages)
        letters, grams = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        hits = np.zeros((total, n))
        for values, of, count in trigrams(texts):
            letters += count
            grams += np.bincount(of, minlength=n)
            masks = self.contained_in(values)
            for bit in range(total):
                hits[bit] += np.bincount(of[(masks >> masks.dtype.type(bit)) & masks.dtype.type(1) == 1], minlength=n)
        if not total:
            return [UNKNOWN] * n, np.zeros(n)
        rate = self.false_rate[:, None]
        right = np.clip((hits - rate * grams) / np.maximum(1 - rate, 1e-9), 0, None)
        best = right.argmax(axis=0)
        # the share of n-grams the language explains, times its lead over the next
        ranked = np.sort(right, axis=0)
        lead = ranked[-1] - (ranked[-2] if total > 1 else 0)
        score = np.where(ranked[-1] > 0, lead / np.maximum(ranked[-1], 1e-9), 0.0)
        score = 0.5 * score + 0.5 * ranked[-1] / np.maximum(grams, 1)
        known = letters > 0
        names = [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
        return names, np.where(known, np.clip(score, 0, 1), 0.0)


def fit_filters(labelled: DataFrame, per_language: int = PER_LANGUAGE, min_share: float = MIN_SHARE) -> LanguageFilters:
    """Filters from (doc_id, text, lang) rows, on about ``per_language`` of them for each language.

    Which rows are taken depends on a hash of doc_id alone. At most 64 languages.
    """
    labelled = labelled.filter("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if len(counts) > 64:
        raise ValueError(f"at most 64 languages fit a mask, got {len(counts)}")
    languages = sorted(counts)
    if not languages:
        return LanguageFilters([], np.zeros(SLOTS, dtype=np.uint8), np.zeros(0))
    share = F.element_at(F.create_map(*[F.lit(x) for k, c in counts.items() for x in (k, per_language / c)]), F.col("lang"))
    taken = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, group in batch.groupby("lang"):
                held = [np.unique(np.stack([of.astype(np.uint64), g]), axis=1)[1] for g, of, _ in trigrams(group["text"].tolist())]
                grams, times = np.unique(np.concatenate(held), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": grams.view(np.int64), "times": times})
                yield pd.DataFrame({"lang": [lang], "gram": None, "times": [len(group)]})

    rows = taken.mapInPandas(count, "lang string, gram bigint, times bigint").groupBy("lang", "gram").agg(F.sum("times").alias("times"))
    totals = rows.filter("gram is null").select("lang", F.col("times").alias("all"))
    rows = rows.filter("gram is not null").join(F.broadcast(totals), "lang").filter(F.col("times") >= min_share * F.col("all"))
    kept = rows.select("lang", "gram").toPandas()
    width = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if np.iinfo(t).bits >= len(languages))
    masks = np.zeros(SLOTS, dtype=width)
    for bit, lang in enumerate(languages):
        grams = kept.loc[kept["lang"] == lang, "gram"].to_numpy(np.int64).view(np.uint64)
        for at in _slots(grams):
            masks[at] |= width(1 << bit)
    fill = np.array([np.mean((masks >> width(b)) & width(1)) for b in range(len(languages))])
    return LanguageFilters(languages, masks, fill**HASHES)


def identify_languages(
    documents: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row of ``documents``, and the columns named in ``keep``.

    The filters are fitted on ``labelled`` (default: the documents), without the
    held-out rows and those with a null language or text. Null texts and texts
    without a letter are ``und`` with score 0, as is every text when nothing could
    be learned. A text without any known n-gram gets the first language by name
    and score 0; equal counts go to the first by name. Repeated rows are rows of their own;
    other columns are ignored. A column in ``keep`` replaces a result column of its name.
    """
    source = documents if labelled is None else labelled
    train = source.filter(~held_out(id_col)).select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    )
    shared = documents.sparkSession.sparkContext.broadcast(fit_filters(train))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = shared.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), *carried(batch)],
                names=["doc_id", "held_out", "lang_pred", "score", *(["kept"] if keep else [])],
            )

    rows = documents.select(
        F.col(id_col).cast("bigint").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"), *carry(keep)
    )
    return with_kept(rows, predict, "doc_id bigint, held_out boolean, lang_pred string, score double", keep)
