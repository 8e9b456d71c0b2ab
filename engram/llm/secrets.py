"""Secrets in texts: exact base patterns, and random-looking strings by a test battery.

All of it is column expressions. Long strings without blanks are read in the encoding their
characters allow (hex, base 36, 62 or 64) and tested for randomness there: chi-squared
uniformity over the alphabet and of its digits, the runs test about the middle
symbol, and serial correlation of neighbouring symbols. The squares of the four normal scores add up
to one statistic; a random string has a small one.

Which values are small enough depends on how ordinary long words of like length score in
the same corpus. Their statistics, counted in bins per length class (with the shorter ones), give each string a
p-value under "ordinary word", and the Benjamini-Hochberg rule in each class keeps the expected
share of words among the reported strings below ``rate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.llm.scratch import Scratch

RATE = 0.05
SHORTEST = 16
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# runs that are long enough: the same matches as of the runs of any length with the short ones dropped
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
STRING = r"[A-Za-z0-9+/_-]{%d,}={0,2}" % SHORTEST
_WORD = r"^([A-Z]?[a-z]+|[A-Z]+)$"
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: pattern and alphabet, the first that fits is taken
ENCODINGS = [
    (r"^[0-9a-f]+$", _DIGITS + "abcdef"), (r"^[0-9A-F]+$", _DIGITS + "ABCDEF"), (r"^[0-9a-z]+$", _DIGITS + _LOWER),
    (r"^[0-9A-Z]+$", _DIGITS + _UPPER), (r"^[0-9A-Za-z]+$", _DIGITS + _UPPER + _LOWER), (r"^[0-9A-Za-z_-]+$", _DIGITS + _UPPER + _LOWER + "_-"),
    (r".", _DIGITS + _UPPER + _LOWER + "+/_-"),
]
CLASSES = [16, 20, 24, 32, 48, 64]
BIN, BINS = 0.5, 400
_BLOCK = 1000


def _starts(text: Column, pattern: str, matches: Column) -> Column:
    """Start positions in code points of the matches of a pattern: what lies between them is measured.

    Running sums go block by block, so that many matches in one text stay cheap.
    """
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m")))
    empty = F.expr("cast(array() as array<int>)")

    def block(acc, b):
        part = F.slice(steps, b * _BLOCK + 1, F.lit(_BLOCK))
        return F.aggregate(
            part, F.struct(acc["at"].alias("at"), empty.alias("out")),
            lambda a, s: F.struct((a["at"] + s["g"] + s["m"]).alias("at"), F.array_append(a["out"], a["at"] + s["g"]).alias("out")),
        )

    def fold(acc, b):
        return F.transform(
            F.array(block(acc, b)), lambda r: F.struct(r["at"].alias("at"), F.array_append(acc["out"], r["out"]).alias("out"))
        )[0]

    whole = F.aggregate(
        F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / _BLOCK).cast("int")),
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<array<int>>)").alias("out")), fold,
    )
    return F.flatten(whole["out"])


_SPAN = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"


def _spans(text: Column, pattern: str, kind: str, group: Column | None = None) -> Column:
    """Spans of all matches; value is the match or what the parallel array ``group`` has."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = matches if group is None else group
    spans = F.zip_with(
        F.arrays_zip(_starts(text, pattern, matches).alias("start"), matches.alias("match")), values,
        lambda x, v: F.struct(F.lit(kind).alias("kind"), x["start"].cast("bigint").alias("start"),
                              (x["start"] + F.length(x["match"])).cast("bigint").alias("end"), v.alias("value")),
    )
    return F.when(F.size(matches) > 0, spans.cast(_SPAN)).otherwise(F.expr(f"cast(array() as {_SPAN})"))


def base_spans(text: Column) -> Column:
    """(kind, start, end, value) of the base patterns; those of one kind do not overlap."""
    none = F.expr(f"cast(array() as {_SPAN})")
    lower = F.lower(text)
    worded = F.lit(False)
    for word in ("passw", "secret", "token", "api"):
        worded = worded | lower.contains(word)
    value = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    assign = F.filter(_spans(text, ASSIGN, "assign", value), lambda s: F.length(s["value"]) >= 6)
    return F.concat(
        F.when(worded, assign).otherwise(none), F.when(text.contains("AKIA"), _spans(text, ACCESS, "access")).otherwise(none),
        _spans(text, HEX, "hex"),
    )


def _normal(chi2: Column, df: Column) -> Column:
    """Wilson and Hilferty's normal score of a chi-squared value."""
    return (F.pow(chi2 / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))


def randomness(strings: Column) -> Column:
    """Spans with the statistic of their value: small for what looks random in its encoding."""
    alphabet = F.lit(ENCODINGS[-1][1])

    def encoded(s):
        bare = F.regexp_replace(s["value"], "=+$", "")
        chosen = alphabet
        for pattern, symbols in ENCODINGS[-2::-1]:
            chosen = F.when(bare.rlike(pattern), F.lit(symbols)).otherwise(chosen)
        return F.struct(s.alias("span"), F.split(bare, "").alias("chars"), chosen.alias("alphabet"))

    def numbered(e):
        return F.struct(
            e["span"].alias("span"), e["chars"].alias("chars"), F.length(e["alphabet"]).cast("double").alias("a"),
            F.size(e["chars"]).cast("double").alias("n"),
            F.transform(e["chars"], lambda c: F.call_function("locate", c, e["alphabet"]) - F.lit(1.0)).alias("x"),
        )

    def measured(e):
        total = F.aggregate(e["x"], F.lit(0.0), lambda s, v: s + v)
        squares = F.aggregate(
            F.array_distinct(e["chars"]), F.lit(0.0),
            lambda s, c: s + F.pow(F.size(F.filter(e["chars"], lambda d: d == c)).cast("double"), F.lit(2.0)),
        )
        upper = F.size(F.filter(e["x"], lambda v: v > (e["a"] - 1) / 2)).cast("double")
        digits = F.size(F.filter(e["x"], lambda v: v < 10)).cast("double")
        m = F.size(e["chars"]) - 1
        neighbours = F.zip_with(F.slice(e["x"], 1, m), F.slice(e["x"], 2, m), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
        return F.struct(
            e["span"].alias("span"), e["a"].alias("a"), e["n"].alias("n"), e["x"].alias("x"), neighbours.alias("pairs"), (total / e["n"]).alias("mean"),
            squares.alias("squares"), upper.alias("upper"), digits.alias("digits"),
        )

    def scored(e):
        n, a, mean = e["n"], e["a"], e["mean"]
        chi = _normal(a * e["squares"] / n - n, a - 1)
        middle = (a - 1) / 2
        runs = 1 + F.size(F.filter(e["pairs"], lambda p: (p["p"] > middle) != (p["q"] > middle)))
        expected = 2 * e["upper"] * (n - e["upper"]) / n + 1
        variance = (expected - 1) * (expected - 2) / (n - 1)
        run = F.when(variance > 0, (runs - expected) / F.sqrt(variance)).otherwise(F.sqrt(n))
        spread = F.aggregate(e["x"], F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean))
        along = F.aggregate(e["pairs"], F.lit(0.0), lambda s, p: s + (p["p"] - mean) * (p["q"] - mean))
        serial = F.when(spread > 0, F.sqrt(n) * along / spread).otherwise(F.sqrt(n))
        share = F.lit(10.0) / a
        digit = (e["digits"] - n * share) / F.sqrt(n * share * (1 - share))
        statistic = F.pow(F.greatest(chi, F.lit(0.0)), F.lit(2.0)) + run * run + serial * serial + digit * digit
        length = F.length(e["span"]["value"])
        class_ = F.lit(0)
        for k, lo in enumerate(CLASSES):
            class_ = F.when(length >= lo, F.lit(k)).otherwise(class_)
        return F.struct(
            e["span"]["start"].alias("start"), e["span"]["end"].alias("end"), e["span"]["value"].rlike(_WORD).alias("word"), class_.alias("class"),
            F.least(F.floor(statistic / BIN), F.lit(BINS)).cast("int").alias("bin"),
        )

    return F.transform(F.transform(F.transform(F.transform(strings, encoded), numbered), measured), scored)


def random_limits(scored: DataFrame, rate: float) -> dict[int, int]:
    """Per length class the largest bin that is reported. A table of classes by bins is all that is fetched."""
    counts = scored.select(F.explode("strings").alias("s")).groupBy("s.class", "s.bin", "s.word").count()
    # a longer word looks less random, so shorter words stand in for the longer ones that a corpus may lack
    bins = counts.withColumn("class", F.explode(F.when(F.col("word"), F.sequence("class", F.lit(len(CLASSES) - 1))).otherwise(F.array("class"))))
    bins = bins.groupBy("class", "bin").agg(
        F.sum(F.when(F.col("word"), F.col("count")).otherwise(0)).alias("words"), F.sum(F.when(F.col("word"), 0).otherwise(F.col("count"))).alias("others")
    )
    upto, all_ = Window.partitionBy("class").orderBy("bin"), Window.partitionBy("class")
    words, others = F.sum("words").over(upto), F.sum("others").over(upto)
    p = (words + 1) / (F.sum("words").over(all_) + 1)
    kept = bins.withColumn("ok", (others > 0) & (p * F.sum("others").over(all_) <= rate * others))
    rows = kept.filter("ok").groupBy("class").agg(F.max("bin").alias("limit")).collect()
    return {r["class"]: r["limit"] for r in rows}


def find_secrets(documents: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, added) per row: arrays of (kind, start, end) in code points, end exclusive.

    base has the matches of the base patterns, added the reported random strings (kind
    random), which touch no base span; both are ordered by start, then kind as in KINDS. Strings
    of digits alone are numbers, not secrets. Null and empty texts have
    none. Repeated rows and null ids keep their rows; other columns are ignored.
    """
    scratch = Scratch(documents.sparkSession, "secrets")
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), base_spans(text).alias("base"), _spans(text, STRING, "random").alias("strings"))
    touches = lambda s, b: (s["start"] < b["end"]) & (b["start"] < s["end"])
    clear = F.filter(
        "strings", lambda s: ~F.exists("base", lambda b: touches(s, b)) & ~s["value"].rlike("^[0-9]+$") & s["value"].rlike("[A-Za-z0-9]")
    )
    scored = scratch.keep(
        found.withColumn("strings", clear).select("doc_id", F.transform("base", lambda s: F.struct(s["kind"], s["start"], s["end"])).alias("base"),
                                                  randomness(F.col("strings")).alias("strings")), "scored",
    )
    limit = F.lit(-1)
    limits = random_limits(scored, rate)
    added = F.filter("strings", lambda s: ~s["word"] & (s["bin"] <= _limit_of(s["class"], limits, limit)))
    added = F.transform(added, lambda s: F.struct(F.lit("random").alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return scored.select("doc_id", in_order(F.col("base")).alias("base"), added.alias("added"))


def _limit_of(class_: Column, limits: dict[int, int], none: Column) -> Column:
    out = none
    for k, v in limits.items():
        out = F.when(class_ == k, F.lit(v)).otherwise(out)
    return out


def in_order(spans: Column) -> Column:
    """Spans by start, then kind as in KINDS."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
