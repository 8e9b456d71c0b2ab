"""Personal data: exact base patterns, and a conditional random field that adds spans.

The field is a linear chain over the tokens of a text. Its features are word
shapes: the token's pattern of letters, digits and signs, its parts, and the shapes
and words beside it. It is trained on a small labelled table (by default one that
``labelled_rows`` makes from formats) and decoded by Viterbi, many chains at once in
numpy. Only tokens with a digit or an at sign may be part of personal data; all
others are fixed to the label O. A fixed label cuts the chain: what lies between two
of them is decoded on its own with the same result as in one chain over the text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.carry import carry, with_kept

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
FEATURES = 1 << 13
MIN_MARGIN = 0.9  # least probability that a span is not O, of its least certain token
_ALLOWED = np.array([[b[0] != "I" or (a[1:] == b[1:] and a != "O") for b in LABELS] for a in LABELS])

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The guards before digits only keep the search from starting again inside a run of digits that has failed.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind index, start, end) of the base patterns, by kind, then start."""
    if not text:
        return []
    found = [(0, s, e) for s, e in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(int(p) <= 255 if len(p) < 10 else not p.strip("0")[3:] and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                found.append((3, m.start(), m.end()))
    return found


def shape(token: str) -> str:
    """The token with letters as a or A, digits as 0, other letters as w."""
    return "".join("0" if "0" <= c <= "9" else "A" if "A" <= c <= "Z" else "a" if "a" <= c <= "z" else "w" if c.isalpha() else c for c in token)


def _squeeze(s: str) -> str:
    return re.sub(r"(.)\1+", r"\1+", s)


@lru_cache(maxsize=50_000)
def _own(token: str) -> tuple[str, ...]:
    s = shape(token)
    digits = s.count("0")
    bare = "".join(c for c in token if "0" <= c <= "9")
    return (
        f"c={13 <= digits <= 19 and digits <= len(token) < digits + 4 and luhn(bare)}",
        f"s={s[:24]}", f"q={_squeeze(s)[:32]}", f"n={min(digits, 20)}", f"d={min(s.count('.'), 6)}", f"l={min(len(token), 30)}",
        f"@={'@' in token}", f"a={'a' in s or 'A' in s}", f"p={token[:1]}", f"e={token[-1:]}", f"h={min(s.count('-'), 4)}",
        f"lead={_squeeze(s)[:4]}",
    )


def features(tokens: list[str], i: int) -> list[int]:
    """Feature slots of token i: its own shape parts, and the shapes and words around it."""
    before, after = tokens[i - 1] if i else "<", tokens[i + 1] if i + 1 < len(tokens) else ">"
    names = [
        "1", *_own(tokens[i][:200]), f"-1q={_squeeze(shape(before[:60]))[:16]}", f"+1q={_squeeze(shape(after[:60]))[:16]}",
        f"-1w={before[:20].lower()}", f"+1w={after[:20].lower()}", f"-1n={min(shape(before[:60]).count('0'), 9)}",
        f"+1n={min(shape(after[:60]).count('0'), 9)}",
    ]
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) % FEATURES for n in names]


def _may(token: str) -> bool:
    return "@" in token or _DIGIT.search(token) is not None


def labelled_rows(seed: int = 11, rows: int = 400) -> list[tuple[list[str], list[str]]]:
    """A small labelled table: formats of personal data and of look-alikes, filled by a seeded generator."""
    rng = np.random.default_rng(seed)
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(rng.choice(list("abdeghilmnorstu"), int(rng.integers(2, 9))))
    octet = lambda: str(rng.integers(0, 256))

    def card(n=16):
        body = number(n - 1)
        return next(body + d for d in "0123456789" if luhn(body + d))

    def grouped(digits, sign=" "):
        return sign.join(digits[i : i + 4] for i in range(0, len(digits), 4))

    made = [
        ("email", lambda: f"{word()}.{number(2)}@{word()}{number(1)}.{word()}.com"), ("email", lambda: f"{word()}@{word()}.org"),
        ("email", lambda: f"{word()}_{word()}@{word()}"), ("email", lambda: f"{word()}@localhost"),
        ("ip", lambda: ".".join(octet() for _ in range(4))), ("ip", lambda: ".".join(octet() for _ in range(4)) + f":{number(4)}"),
        ("card", card), ("card", lambda: grouped(card())), ("card", lambda: grouped(card(), "-")), ("card", lambda: card(15)),
        ("phone", lambda: f"+1 ({number(3)}) 555-{number(4)}"), ("phone", lambda: f"({number(3)}) {number(3)}-{number(4)}"),
        ("phone", lambda: f"+{number(2)} {number(3)} {number(3)} {number(4)}"), ("phone", lambda: f"{number(3)}-{number(3)}-{number(4)}"),
        ("phone", lambda: f"00{number(2)} {number(3)} {number(7)}"), ("phone", lambda: f"+{number(11)}"),
    ]
    other = [
        lambda: f"{number(1)}.0.", lambda: f"{number(1)}.{number(1)}.", lambda: f"20{number(2)}", lambda: f"{number(2)}%", lambda: number(int(rng.integers(1, 8))),
        lambda: f"password={word()}{number(9)}", lambda: f"AKIA{word().upper()}{number(6)}", lambda: f'"{number(3)}{word()}{number(20)}{word()}{number(12)}"',
        lambda: f"{number(4)}-{number(2)}-{number(2)}", lambda: f"{number(2)}:{number(2)}", lambda: f"${number(3)}.{number(2)}", lambda: f"v{number(1)}.{number(2)}.{number(1)}",
        lambda: f"{number(1)},{number(3)},{number(3)}", lambda: f"@{word()}", lambda: f"{number(3)}{word()}{number(4)}", lambda: number(24), lambda: f"{number(2)}/{number(2)}/{number(4)}",
        lambda: f"#{number(5)}", lambda: f"{word()}{number(2)}", lambda: f"https://{word()}.com/{number(5)}", lambda: number(16), lambda: number(12), lambda: f"{number(4)} {number(4)}",
    ]
    table = []
    for _ in range(rows):
        tokens, labels = [], []
        for _ in range(int(rng.integers(1, 4))):
            for _ in range(int(rng.integers(0, 4))):
                tokens.append(word() + str(rng.choice(["", "", ",", "."])))
                labels.append("O")
            kind, value = made[int(rng.integers(len(made)))] if rng.random() < 0.5 else ("", other[int(rng.integers(len(other)))])
            value = value()
            if kind == "" and value.isdigit() and 13 <= len(value) <= 19 and luhn(value):
                continue
            for k, part in enumerate((value + str(rng.choice(["", "", "", ",", "."]))).split(" ")):
                tokens.append(part)
                labels.append(f"{'I' if k else 'B'}-{kind}" if kind else "O")
        tokens.append(word())
        labels.append("O")
        table.append((tokens, labels))
    return table


def labelled_table(spark: SparkSession, seed: int = 11, rows: int = 400) -> DataFrame:
    return spark.createDataFrame(labelled_rows(seed, rows), "tokens array<string>, labels array<string>")


def _chains(tokens: list[str]) -> list[range]:
    """Runs of tokens that may be personal data."""
    out, start = [], None
    for i, token in enumerate([*tokens, ""]):
        if _may(token):
            start = i if start is None else start
        elif start is not None:
            out.append(range(start, i))
            start = None
    return out


class ChainField:
    """Weights of a linear-chain conditional random field over LABELS."""

    def __init__(self):
        self.emit = np.zeros((FEATURES, len(LABELS)))
        self.move = np.where(_ALLOWED, 0.0, -1e4)
        self.move_in, self.move_out = self.move[0].copy(), np.zeros(len(LABELS))

    def fit(self, table: list[tuple[list[str], list[str]]], epochs: int = 15, rate: float = 0.3, keep: float = 2e-4) -> ChainField:
        """AdaGrad on the log-likelihood; the mean of the weights of the last epochs."""
        data = []
        for tokens, labels in table:
            for run in _chains(tokens):
                data.append(([features(tokens, i) for i in run], [LABELS.index(labels[i]) for i in run]))
        rng = np.random.default_rng(3)
        squares = [np.full(w.shape, 1e-6) for w in (self.emit, self.move, self.move_in)]
        for _ in range(epochs):
            for k in rng.permutation(len(data)):
                slots, gold = data[k]
                scores = np.stack([self.emit[s].sum(axis=0) for s in slots])
                alpha, beta, total = self._sums(scores)
                node = np.exp(alpha + beta - total)
                node[np.arange(len(gold)), gold] -= 1
                for i, s in enumerate(slots):
                    self._step(self.emit, squares[0], np.asarray(s), np.broadcast_to(node[i], (len(s), len(LABELS))), rate, keep)
                first = node[0]
                self._step(self.move_in, squares[2], slice(None), np.where(_ALLOWED[0], first, 0), rate, keep)
                for i in range(1, len(gold)):
                    edge = np.exp(alpha[i - 1][:, None] + self.move + (scores[i] + beta[i])[None] - total)
                    edge[gold[i - 1], gold[i]] -= 1
                    self._step(self.move, squares[1], slice(None), np.where(_ALLOWED, edge, 0), rate, keep)
        return self

    @staticmethod
    def _step(weights, squares, at, gradient, rate, keep):
        if isinstance(at, np.ndarray):
            gradient = gradient + keep * weights[at]
            np.add.at(squares, at, gradient**2)
            np.add.at(weights, at, -rate * gradient / np.sqrt(squares[at]))
        else:
            squares[at] += gradient**2
            weights[at] -= rate * gradient / np.sqrt(squares[at])

    def _sums(self, scores):
        """Forward and backward log sums, and the log of the partition sum."""
        lse = lambda x, axis: (m := x.max(axis=axis)) + np.log(np.exp(x - np.expand_dims(m, axis)).sum(axis=axis))
        alpha, beta = np.empty_like(scores), np.zeros_like(scores)
        alpha[0] = self.move_in + scores[0]
        for i in range(1, len(scores)):
            alpha[i] = lse(alpha[i - 1][:, None] + self.move, 0) + scores[i]
        for i in range(len(scores) - 2, -1, -1):
            beta[i] = lse(self.move + (scores[i + 1] + beta[i + 1])[None], 1)
        return alpha, beta, lse(alpha[-1], 0)

    def decode(self, chains: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi labels of many chains of emission scores; chains of like length go together."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(chains)
        order = sorted(range(len(chains)), key=lambda k: len(chains[k]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and len(chains[order[end]]) * (end - at + 1) <= 100_000 and len(chains[order[end]]) <= 2 * len(chains[order[at]]):
                end += 1
            some = order[at:end]
            at = end
            longest = len(chains[some[-1]])
            scores = np.zeros((len(some), longest, len(LABELS)))
            scores[:, :, 1:] = -1e4  # past the end of a chain: O, whatever came before
            for row, k in enumerate(some):
                scores[row, : len(chains[k])] = chains[k]
            back = np.zeros((len(some), longest, len(LABELS)), dtype=np.int8)
            best = self.move_in + scores[:, 0]
            for t in range(1, longest):
                paths = best[:, :, None] + self.move
                back[:, t] = paths.argmax(axis=1)
                best = paths.max(axis=1) + scores[:, t]
            path = np.zeros((len(some), longest), dtype=np.int64)
            path[:, -1] = best.argmax(axis=1)
            for t in range(longest - 1, 0, -1):
                path[:, t - 1] = back[np.arange(len(some)), t, path[:, t]]
            for row, k in enumerate(some):
                out[k] = path[row, : len(chains[k])]
        return out

    def spans(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """(kind index, start, end) that the field finds in each text."""
        where: list[tuple[int, list[tuple[int, int]], list[str]]] = []
        chains: list[np.ndarray] = []
        for k, text in enumerate(texts):
            if not text or not ("@" in text or _DIGIT.search(text)):
                continue
            before, run, places = "<", [], []
            for m in chain(_TOKEN.finditer(text), [None]):
                token = m.group() if m else ">"
                if m and _may(token):
                    run.append(token)
                    places.append(m.span())
                    continue
                if run:
                    tokens = [before, *run, token]
                    chains.append(np.stack([self.emit[features(tokens, i + 1)].sum(axis=0) for i in range(len(run))]))
                    where.append((k, places, run))
                    run, places = [], []
                before = token
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for (k, places, tokens), scores, path in zip(where, chains, self.decode(chains), strict=True):
            i = 0
            while i < len(path):
                if path[i] == 0:
                    i += 1
                    continue
                kind, j = (path[i] - 1) // 2, i + 1
                while j < len(path) and path[j] == 2 + 2 * kind:
                    j += 1
                alpha, beta, total = self._sums(scores)
                sure = 1 - np.exp(alpha[i:j, 0] + beta[i:j, 0] - total)
                start = places[i][0] + len(tokens[i]) - len(tokens[i].lstrip("\"'<[{,;:"))
                end = places[j - 1][0] + len(tokens[j - 1].rstrip("\"'>]},;:.!?"))
                if sure.min() >= MIN_MARGIN and start < end:
                    found[k].append((int(kind), start, end))
                i = j
        return found


def _clear_of(spans, base) -> list[tuple[int, int, int]]:
    """Spans that share no code point with a base span."""
    return [s for s in spans if all(s[2] <= b[1] or b[2] <= s[1] for b in base)]


def redacted(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with every span replaced by its kind; spans that overlap become one, of the first kind."""
    if not text or not spans:
        return text
    out, at = [], 0
    merged: list[list[int]] = []
    for kind, start, end in sorted(spans, key=lambda s: (s[1], s[0])):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    for kind, start, end in merged:
        out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def find_personal_data(
    documents: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", redact: bool = False, keep: list[str] | None = None
) -> DataFrame:
    """(doc_id, base, added): spans of personal data per row; with ``redact`` also the text without them, as redacted.

    The columns named in ``keep`` are carried along and replace result columns of their name.

    base and added are arrays of (kind, start, end) in code points, end exclusive,
    by kind (email, ip, card, phone) and start. Base spans are all matches of the
    base patterns; added spans come from the field and touch no base span.
    ``labelled`` has rows (tokens, labels); its rows are fetched, so keep it small. Null and empty texts have no
    spans and stay as they are. Repeated rows and null ids keep their rows; other
    columns are ignored.
    """
    spark = documents.sparkSession
    table = labelled_rows() if labelled is None else [(r["tokens"], r["labels"]) for r in labelled.select("tokens", "labels").collect()]
    shared = spark.sparkContext.broadcast(ChainField().fit(table))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def as_rows(spans):
        return [[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in sorted(x)] for x in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            base = [base_spans(t) for t in texts]
            added = [_clear_of(s, b) for s, b in zip(shared.value.spans(texts), base, strict=True)]
            columns = {"doc_id": batch.column("doc_id"), "base": pa.array(as_rows(base), span), "added": pa.array(as_rows(added), span)}
            if redact:
                columns["redacted"] = pa.array([redacted(t, b + a) for t, b, a in zip(texts, base, added, strict=True)], pa.string())
            if keep:
                columns["kept"] = batch.column("kept")
            yield pa.RecordBatch.from_pydict(columns)

    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    rows = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), *carry(keep))
    return with_kept(rows, run, f"doc_id bigint, base {spans}, added {spans}" + ", redacted string" * redact, keep)
