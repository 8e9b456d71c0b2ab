"""Which texts contain which terms: an exact substring join without a cross join.

Every term is represented by one anchor, the gram of it that the fewest terms
share. Texts are exploded into their distinct grams and meet the anchors in an
equi-join, then ``contains`` confirms the candidates. A text that contains a
term contains all its grams, so nothing is missed, and each pair appears once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LONG_GRAM = 6
LONGER_GRAMS = (10, 16)
FEW_TERMS = 64
BROADCAST_TERMS = 100_000
BROADCAST_CHARS = 16_000_000
FILTER_WORDS = 1 << 20
WINDOW = 4096


def grams(text: Column, q: int) -> Column:
    """All overlapping windows of q characters (a zero-width match per position)."""
    return F.regexp_extract_all(text, F.lit("(?s)(?=(.{%d}))" % q), F.lit(1))


def _gram_size(length: Column, longest: int) -> Column:
    """Of what size the grams of a term are: its own length up to LONG_GRAM, or the largest of LONGER_GRAMS that it has, up to ``longest``."""
    size = F.least(length, F.lit(LONG_GRAM))
    for q in LONGER_GRAMS:
        if q <= longest:
            size = F.when(length >= q, q).otherwise(size)
    return size


def _anchors(terms: DataFrame, term: str, sizes: list[int]) -> DataFrame:
    """One gram per distinct term: the least shared one, the leftmost of equals."""
    distinct = terms.select(F.col(term).alias("_term")).distinct()
    size = _gram_size(F.length("_term"), max(sizes))
    per_size = [
        distinct.filter(size == q).select("_term", F.posexplode(grams(F.col("_term"), q)))
        for q in sizes
    ]
    exploded = per_size[0]
    for more in per_size[1:]:
        exploded = exploded.unionByName(more)
    shared = exploded.groupBy("col").agg(F.count_distinct("_term").alias("_n"))
    return (
        exploded.join(shared, "col")
        .groupBy("_term")
        .agg(F.min_by("col", F.struct("_n", "pos")).alias("_gram"))
    )


def term_stats(terms: DataFrame, term: str) -> list:
    """Rows, distinct terms, characters of all columns and of distinct terms, and the longest, per length class: at most eight rows."""
    chars = F.length(F.to_json(F.struct("*")))
    return (
        terms.filter(F.length(term) > 0)
        .select(F.col(term).alias("_term"), chars.alias("_chars"))
        .groupBy("_term").agg(F.count("*").alias("_rows"), F.sum("_chars").alias("_chars"))
        .groupBy(_gram_size(F.length("_term"), max(LONGER_GRAMS)).alias("q"))
        .agg(
            F.sum("_rows").alias("n"), F.sum("_chars").alias("chars"),
            F.count("*").alias("terms"), F.sum(F.length("_term")).alias("term_chars"), F.max(F.length("_term")).alias("longest"),
        )
        .collect()
    )


def may_be_among(rows: DataFrame, column: str, among: DataFrame, distinct: int) -> DataFrame:
    """Rows whose value can be one of ``among``: a bitmap of the hashes of its column of that name, of bounded size, goes to every task.

    About sixteen bits per value up to FILTER_WORDS words; a value has four bits in one word. Rows that pass by chance, one in
    a hundred, are dropped by the join that follows.
    """
    words = 1
    while words < FILTER_WORDS and words * 4 < distinct:
        words *= 2
    place = F.xxhash64(column)
    mark = F.expr(" | ".join(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64({column}), {s}) & 63 as int))" for s in (24, 31, 38, 45)))
    word = F.pmod(place, F.lit(words))
    bitmap = among.select(column).distinct().groupBy(word.alias("_word")).agg(F.bit_or(mark).alias("_bits"))
    marked = rows.withColumn("_word", word).withColumn("_mark", mark)
    return marked.join(F.broadcast(bitmap), "_word").filter(F.col("_bits").bitwiseAND(F.col("_mark")) == F.col("_mark")).drop("_word", "_mark", "_bits")


def _found_again(rows: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with the other columns of ``found``, whose rows differ; a null key is a key like others."""
    same = [F.col(f"_rows.{c}").eqNullSafe(F.col(f"_found.{c}")) for c in key]
    return rows.alias("_rows").join(found.alias("_found"), same).select("_rows.*", *[f"_found.{c}" for c in found.columns if c not in key])


def _named(texts: DataFrame, text: str, terms: DataFrame, term: str) -> DataFrame:
    """``contained_terms`` for at most FEW_TERMS distinct terms: that many searches cost less than the grams of a text."""
    known = [r["_term"] for r in terms.select(F.col(term).alias("_term")).distinct().collect()]
    said = F.filter(F.array(*[F.lit(t) for t in sorted(known)]).cast("array<string>"), lambda t: F.col(text).contains(t))
    # outer, so that no check for an empty list is pushed below, where texts would be made anew for every term
    return texts.withColumn("_term", F.explode_outer(said)).join(F.broadcast(terms), F.col("_term") == F.col(term)).drop("_term")


def contained_terms(
    texts: DataFrame,
    text: str,
    terms: DataFrame,
    term: str,
    text_key: list[str],
    broadcast_terms: int = BROADCAST_TERMS,
    stats: list | None = None,
    windowed: bool = False,
) -> DataFrame:
    """Rows of ``texts`` paired with rows of ``terms`` where text contains term.

    Both columns must already be lower-cased when case is to be ignored. The
    size of the term side is checked: a handful of distinct terms is looked for one by one. Up to ``broadcast_terms`` rows
    the anchors are broadcast, without a shuffle of texts. Beyond, up to as many distinct terms are
    broadcast alone, and their other columns meet the hits in a join. With more distinct terms only the (key, gram)
    pairs whose gram may be an anchor are shuffled, and the few candidates fetch their text back by key and hash; a
    stream, which can't be read twice, or texts without a key, take the text along.
    ``stats`` may carry the ``term_stats`` of terms that are searched repeatedly. ``windowed`` is for texts of any
    length that name many terms: windows of them are searched, so that no term is looked for in a whole text.
    """
    terms = terms.filter(F.length(term) > 0)
    kinds = term_stats(terms, term) if stats is None else stats
    if windowed:
        return _contained_in_windows(texts, text, terms, term, text_key, broadcast_terms, kinds)
    fits = lambda rows, chars: sum(r[rows] for r in kinds) <= broadcast_terms and sum(r[chars] for r in kinds) <= BROADCAST_CHARS
    if fits("n", "chars") and sum(r["terms"] for r in kinds) <= FEW_TERMS:
        return _named(texts, text, terms, term)
    few = fits("n", "chars") or fits("terms", "term_chars")
    # a short term has grams of its own length, so that one of a single letter concerns no other; of many terms, that share
    # most short grams, longer ones are taken, so that few grams of a text are an anchor
    sizes = sorted({min(r["q"], LONG_GRAM) if few else r["q"] for r in kinds} or {LONG_GRAM})
    anchors = _anchors(terms, term, sizes)
    all_grams = F.array_distinct(F.concat(*[grams(F.col(text), q) for q in sizes]))
    columns = [c for c in texts.columns]
    if fits("n", "chars"):
        side = anchors.join(terms, F.col("_term") == F.col(term)).drop("_term")
        return (
            texts.withColumn("_gram", F.explode(all_grams))
            .join(F.broadcast(side), "_gram")
            .filter(F.col(text).contains(F.col(term)))
            .drop("_gram")
        )
    said = F.col(text).contains(F.col("_term"))
    if fits("terms", "term_chars"):
        hits = texts.withColumn("_gram", F.explode(all_grams)).join(F.broadcast(anchors), "_gram").filter(said)
    elif texts.isStreaming or not text_key:
        exploded = may_be_among(texts.withColumn("_gram", F.explode(all_grams)), "_gram", anchors, sum(r["terms"] for r in kinds))
        hits = exploded.join(anchors, "_gram").filter(said)
    else:
        whole = texts.withColumn("_text_hash", F.xxhash64(text))
        key = [*text_key, "_text_hash"]
        exploded = may_be_among(whole.select(*key, F.explode(all_grams).alias("_gram")), "_gram", anchors, sum(r["terms"] for r in kinds))
        hits = _found_again(whole, exploded.join(anchors, "_gram").select(*key, "_term").distinct(), key).filter(said)
    return hits.join(terms, F.col("_term") == F.col(term)).select(*columns, *[c for c in terms.columns])


def text_windows(text: Column, overlap: int, size: int = WINDOW) -> Column:
    """Pieces of ``size`` characters in order, each with the ``overlap`` characters after it, in one pass over the text."""
    size = max(size, 4 * overlap)
    pattern = F.lit("(?s)(.{1,%d})(?=(.{0,%d}))" % (size, overlap))
    return F.when(F.length(text) <= size, F.array(text)).otherwise(
        F.zip_with(F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2)), lambda own, after: F.concat(own, after))
    )


def _contained_in_windows(
    texts: DataFrame, text: str, terms: DataFrame, term: str, text_key: list[str], broadcast_terms: int, kinds: list
) -> DataFrame:
    """``contained_terms`` by windows that overlap by the longest term; rows are found again by key and hash of the text."""
    overlap = max((r["longest"] for r in kinds), default=1) - 1
    whole = texts.withColumn("_hash", F.xxhash64(text))
    key = [*text_key, "_hash"]
    parts = whole.select(*key, F.posexplode(text_windows(F.col(text), overlap)).alias("_at", "_part"))
    alone = terms.select(F.col(term).alias("_said")).distinct()
    found = contained_terms(parts, "_part", alone, "_said", [*key, "_at"], broadcast_terms, kinds).select(*key, "_said").distinct()
    return _found_again(whole, found, key).join(terms, F.col("_said") == F.col(term)).select(*texts.columns, *terms.columns)


def words_within(words: DataFrame, word: str, parts: DataFrame, part: str, max_lengths: int = 256) -> DataFrame:
    """(word, part): every word of a table of distinct words that contains a part, or is one.

    For words, not texts: each is cut into its spans of just the lengths that parts have, and these meet the
    parts by equality. With too many lengths the general containment join is used. A word has many spans, but Spark sizes
    them by the words, so they are kept from being broadcast: the parts are while few, and else both sides are shuffled.
    """
    small = parts.select(F.col(part)).filter(F.length(part) > 0).distinct()
    kinds = small.groupBy(F.length(part).alias("n")).agg(F.count("*").alias("parts")).limit(max_lengths + 1).collect()
    large = words.select(F.col(word))
    if len(kinds) > max_lengths:
        return contained_terms(large, word, small, part, [word]).select(word, part)
    lengths = sorted(r["n"] for r in kinds) or [1]
    few = sum(r["parts"] for r in kinds) <= BROADCAST_TERMS and sum(r["n"] * r["parts"] for r in kinds) <= BROADCAST_CHARS
    spans = [F.when(F.length(word) >= n, grams(F.col(word), n)).otherwise(F.array().cast("array<string>")) for n in lengths]
    exploded = large.select(word, F.explode(F.array_distinct(F.concat(*spans))).alias(part))
    return exploded.join(F.broadcast(small) if few else small.hint("merge"), part).select(word, part)


def alias_index(nodes: DataFrame, min_length: int = 1) -> DataFrame:
    """(term, pos, node columns): the name at position 0, then the aliases."""
    names = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    return (
        nodes.select("id", "type", "name", "confidence", F.posexplode(names).alias("pos", "spelling"))
        .withColumn("term", F.lower("spelling"))
        .filter(F.length("term") >= min_length)
    )


def resolve_names(names: DataFrame, nodes: DataFrame, column: str, ignore_case: bool = True) -> DataFrame:
    """Node id per name: names before aliases, then the smallest id (min per key, no sort)."""
    index = alias_index(nodes).select(
        (F.col("term") if ignore_case else F.col("spelling")).alias("_spelling"),
        F.struct(F.when(F.col("pos") == 0, 0).otherwise(1).alias("rank"), F.col("id")).alias("_hit"),
    )
    best = index.groupBy("_spelling").agg(F.min("_hit").alias("_hit"))
    wanted = F.lower(F.col(column)) if ignore_case else F.col(column)
    return names.join(best, wanted == F.col("_spelling"), "left").select(
        *names.columns, F.col("_hit.id").alias("node_id")
    )


def top_per(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First k rows per key. Spark prunes to k rows per key before it shuffles."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= k).drop("_rn")
