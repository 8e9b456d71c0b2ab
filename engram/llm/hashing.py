"""Word and shingle hashes of many texts at once, in numpy.

A word is a run of bytes other than space and the five ASCII controls 9 to 13.
Words of a whole batch are hashed together: a polynomial over byte codes from
one running sum, then a 64-bit finaliser. Long texts go through in pieces cut at
separators, so the working memory does not grow with a text beyond its words.
"""

from __future__ import annotations

import numpy as np

PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_WRAP = (1 << 64) - 1
SEPARATORS = b" \t\n\x0b\x0c\r"

_is_separator = np.zeros(256, dtype=bool)
_is_separator[list(SEPARATORS)] = True
_codes = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_codes_lower = _codes.copy()
_codes_lower[65:91] = _codes[97:123]
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = np.array(x, dtype=np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, PIECE + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base & _WRAP, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def _hash_words(data: bytes, codes: np.ndarray, separator: np.ndarray = _is_separator) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first byte positions of the words in ``data``."""
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = ~separator[raw]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(codes[raw] * up[: len(raw)], out=sums[1:])
    values = (sums[ends] - sums[starts]) * down[starts]
    return mix(values + (ends - starts).astype(np.uint64)), starts


#: ASCII bytes other than letters and digits
PUNCTUATED = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def word_hashes(texts, lower_ascii: bool = True, separator: np.ndarray = _is_separator) -> tuple[np.ndarray, np.ndarray]:
    """All word hashes of ``texts`` in order, and offsets (one more than texts).

    ``separator`` marks the bytes that end a word; it must include the space.
    """
    codes = _codes_lower if lower_ascii else _codes
    hashes: list[np.ndarray] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    held: list[bytes] = []
    first, size = 0, 0

    def flush(upto: int) -> None:
        nonlocal held, first, size
        if held:
            words, starts = _hash_words(b" ".join(held), codes, separator)
            lengths = np.fromiter((len(t) + 1 for t in held), np.int64, len(held))
            bounds = np.concatenate(([0], np.cumsum(lengths)))
            counts[first:upto] += np.diff(np.searchsorted(starts, bounds))
            hashes.append(words)
        held, size, first = [], 0, upto

    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        if size + len(data) > PIECE:
            flush(i)
        if len(data) <= PIECE:
            held.append(data)
            size += len(data) + 1
            continue
        at = 0
        while at < len(data):
            end = min(at + PIECE, len(data))
            while end < len(data) and not separator[data[end]]:
                end += 1
            words, _ = _hash_words(data[at:end], codes, separator)
            hashes.append(words)
            counts[i] += len(words)
            at = end
        first = i + 1
    flush(len(texts))
    every = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
    return every, np.concatenate(([0], np.cumsum(counts)))


def sequence_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` following words, in order."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    value = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        value = value * np.uint64(_BASE) + words[k : k + n]
    return mix(value + np.uint64(width))


def shingle_sets(texts, width: int = 5, lower_ascii: bool = True) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text.

    A text with fewer than ``width`` words has its whole sequence as the only
    shingle; one without words (or null) has none.
    """
    words, offsets = word_hashes(texts, lower_ascii)
    runs = sequence_hashes(words, width)
    out = []
    for start, end in zip(offsets[:-1], offsets[1:], strict=True):
        if end - start >= width:
            out.append(np.unique(runs[start : end - width + 1]))
        elif end > start:
            out.append(sequence_hashes(words[start:end], int(end - start)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
