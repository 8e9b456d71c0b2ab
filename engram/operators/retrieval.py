"""Hybrid retrieval for a batch of queries over all memory tables in one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions import lexicons as lx
from engram.functions.scores import effective_confidence, half_if_missing, recency, text_match
from engram.functions.text import contains_any, first_match, labels_where, matches, no_strings, query_words
from engram.operators.graph import neighbors_of_type, undirected
from engram.operators.matching import alias_index, contained_terms, grams, top_per
from engram.operators.postings import posting_lists, rows_of_queries
from engram.operators.vectors import knn
from engram.session import use_checkpoints

MAX_NAME_LENGTHS = 256
HIT_COLUMNS = [
    "query_id", "memory_type", "id", "name", "type", "content", "text_match", "graph_proximity",
    "importance", "recency", "confidence", "stated", "execution_count", "success_rate", "found",
]


# --- query side --------------------------------------------------------------------
def classify_queries(queries: DataFrame) -> DataFrame:
    """Six signal sums, the first greatest type and how clearly it wins."""
    low = F.lower("text")
    sums = {}
    for kind in lx.QUERY_TYPES:
        parts = [F.when(matches(low, p), w).otherwise(0) for k, w, p in lx.QUERY_SIGNALS if k == kind]
        sums[kind] = reduce(lambda a, b: a + b, parts)
    scored = queries.withColumns(sums)
    best = F.greatest(*[F.col(k) for k in lx.QUERY_TYPES])
    total = reduce(lambda a, b: a + b, [F.col(k) for k in lx.QUERY_TYPES])
    winner = first_match([((F.col(k) == best) & (best > 0), k) for k in lx.QUERY_TYPES], "conceptual")
    return scored.withColumns(
        {
            "query_type": winner,
            "type_confidence": F.when(total > 0, best / total).otherwise(0.2),
        }
    )


def query_weights(classified: DataFrame, override: dict[str, float] | None = None) -> DataFrame:
    """Weights blended from the type's profile and the default by confidence.

    ``override`` replaces all weights; missing entries take the default ones.
    """
    if override is not None:
        return classified.withColumns(
            {f"w_{s}": F.lit(float(override.get(s, d))) for s, d in zip(lx.SCORES, lx.DEFAULT_WEIGHTS)}
        )
    blend = F.least(F.lit(1.0), F.col("type_confidence") * 1.5)
    columns = {}
    for i, s in enumerate(lx.SCORES):
        own = first_match([(F.col("query_type") == k, w[i]) for k, w in lx.WEIGHTS.items()], lx.DEFAULT_WEIGHTS[i])
        columns[f"w_{s}"] = own * blend + F.lit(lx.DEFAULT_WEIGHTS[i]) * (F.lit(1.0) - blend)
    return classified.withColumns(columns)


def mentioned_nodes(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, node_id, node_type): names or aliases of 3+ characters in the query.

    Queries are short, so they are cut into spans of just the lengths names
    have, and meet the names in an equality join. With too many name lengths
    the general containment join is used.
    """
    index = alias_index(nodes, 3).select(
        F.col("id").alias("node_id"), F.col("type").alias("node_type"), "term"
    )
    texts = queries.select("query_id", F.lower("text").alias("_low"))
    lengths = [
        r["n"]
        for r in index.select(F.length("term").alias("n")).distinct().limit(MAX_NAME_LENGTHS + 1).collect()
    ]
    if len(lengths) > MAX_NAME_LENGTHS:
        hits = contained_terms(texts, "_low", index, "term", ["query_id"])
    else:
        spans = F.array_distinct(F.concat(*[grams(F.col("_low"), n) for n in sorted(lengths) or [3]]))
        hits = texts.select("query_id", F.explode(spans).alias("term")).join(index, "term")
    return hits.select("query_id", "node_id", "node_type").distinct()


def implied_type(queries: DataFrame, mentioned: DataFrame) -> DataFrame:
    low = F.lower("text")
    implied = labels_where([(contains_any(low, words), kind) for kind, words in lx.TYPE_KEYWORDS])
    types = mentioned.groupBy("query_id").agg(F.collect_set("node_type").alias("_types"))
    fresh = F.array_except("_implied", F.coalesce("_types", no_strings()))
    return (
        queries.withColumn("_implied", implied)
        .join(types, "query_id", "left")
        .withColumn(
            "implied_type",
            F.coalesce(F.try_element_at(fresh, F.lit(1)), F.try_element_at("_implied", F.lit(1))),
        )
        .drop("_implied", "_types")
    )


def routing_boosts(queries: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, id, boost): 1 for mentioned nodes, edge strength for their
    neighbours of the implied type."""
    use_checkpoints(queries.sparkSession)
    mentioned = mentioned_nodes(queries, nodes).checkpoint()
    implied = implied_type(queries.select("query_id", "text"), mentioned)
    wanted = (
        mentioned.filter(F.col("node_type").isin("person", "organization"))
        .join(implied.filter("implied_type IS NOT NULL").select("query_id", "implied_type"), "query_id")
        .select("query_id", "node_id", F.col("implied_type").alias("node_type"))
    )
    near = neighbors_of_type(edges, nodes, wanted).select(
        "query_id", "id", half_if_missing(F.col("strength")).alias("boost")
    )
    named = mentioned.select("query_id", F.col("node_id").alias("id"), F.lit(1.0).alias("boost"))
    return named.unionByName(near).groupBy("query_id", "id").agg(F.max("boost").alias("boost"))


def asked_of(queries: DataFrame) -> DataFrame:
    """(query_id, query_low, words): the words of 3+ characters of every query."""
    return queries.select("query_id", F.lower("text").alias("query_low"), query_words(F.lower("text")).alias("words"))


def words_of(asked: DataFrame) -> DataFrame:
    """(query_id, query_low, words, word): one row per distinct word."""
    return asked.withColumn("word", F.explode(F.array_distinct("words")))


class Words:
    """The queries in lower case with their words, read by every branch and so written once, and the distinct words of each."""

    def __init__(self, queries: DataFrame) -> None:
        use_checkpoints(queries.sparkSession)
        self.asked = asked_of(queries).checkpoint()
        self.rows = words_of(self.asked)
        self.lows = self.asked.select("query_id", "query_low")


#: how rows of a branch are ordered before any query is known, the greatest first, and by how many times the limit they are cut
KEYWORD_ORDERS = {"semantic": 3, "episode": 2, "lesson": 1, "procedure": 1}


def keyword_candidates(words: Words, tables: dict[str, DataFrame], limit: int, wanted: list[str]) -> DataFrame:
    """(query_id, branch, id, place): the first rows with a word of the query, for all branches in one pass over the words.

    Written once: at most 3 x ``limit`` rows per query and branch.
    """
    sep = "\u0001"
    no = F.lit(0.0)

    def part(branch: str, first: Column, second: Column, *fields: Column) -> DataFrame:
        return tables[_TABLES[branch]].select(
            F.lit(branch).alias("branch"), "id", first.cast("double").alias("first"), second.cast("double").alias("second"),
            F.lower(F.concat_ws(sep, *fields)).alias("searched"),
        )

    make = {
        "semantic": lambda: part(
            "semantic", F.col("confidence"), no, F.col("name"), F.col("context"), F.col("significance"), F.array_join("aliases", sep),
            F.coalesce(F.to_json("attributes"), F.lit("{}")),
        ),
        "episode": lambda: part("episode", F.col("importance_score"), no, F.col("summary"), F.col("narrative")),
        "lesson": lambda: part("lesson", -_severity_rank(), F.col("times_reinforced"), F.col("statement"), F.col("prevention_rule")),
        "procedure": lambda: part(
            "procedure", F.col("confidence"), no, F.col("name"), F.to_json("steps"), F.to_json(F.struct(F.col("trigger_phrases").alias("phrases")))
        ),
    }
    rows = reduce(DataFrame.unionByName, [make[b]() for b in wanted])
    order = [F.col("first").desc(), F.col("second").desc(), F.col("id")]
    most = max(KEYWORD_ORDERS[b] for b in wanted) * limit
    found = rows_of_queries(rows, F.col("searched"), words.rows, ["branch", "id", "first", "second"], order, most, ["branch"])
    cut = first_match([(F.col("branch") == b, n * limit) for b, n in KEYWORD_ORDERS.items()], limit)
    return found.filter(F.col("place") <= cut).select("query_id", "branch", "id", "place").checkpoint()


_TABLES = {"semantic": "nodes", "episode": "episodes", "lesson": "lessons", "procedure": "procedures"}


def _severity_rank() -> Column:
    return F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "important", 1).otherwise(2)


def _found_in(found: DataFrame, branch: str) -> DataFrame:
    return found.filter(F.col("branch") == branch).select("query_id", "id", F.col("place").alias("word_rank"))


# --- content ---------------------------------------------------------------------------
def node_content() -> Column:
    lines = F.array_join(
        F.sort_array(
            F.transform(
                F.map_entries("attributes"), lambda e: F.concat(F.lit("  "), e["key"], F.lit(": "), e["value"])
            )
        ),
        "\n",
    )
    some = lambda c: F.length(c) > 0
    return F.concat(
        F.lit("["), F.col("type"), F.lit("] "), F.col("name"),
        F.when(some("context"), F.concat(F.lit("\n"), F.col("context"))).otherwise(""),
        F.when(some("significance"), F.concat(F.lit("\nSignificance: "), F.col("significance"))).otherwise(""),
        F.when(some(lines), F.concat(F.lit("\nAttributes:\n"), lines)).otherwise(""),
    )


def episode_content() -> Column:
    return F.concat(
        F.lit("[Episode] "), F.col("summary"), F.lit("\n"), F.substring(F.coalesce("narrative", F.lit("")), 1, 200)
    )


def lesson_content() -> Column:
    return F.concat(
        F.lit("[Lesson - "), F.col("severity"), F.lit("] "), F.col("statement"), F.lit("\nPrevention: "),
        F.coalesce("prevention_rule", F.lit("null")),
    )


def identity_content() -> Column:
    return F.concat(F.lit("[Identity - "), F.col("category"), F.lit("] "), F.col("key"), F.lit(": "), F.col("value"))


def procedure_content() -> Column:
    return F.concat(
        F.lit("[Procedure - "), F.col("type"), F.lit("] "), F.col("name"), F.lit("\nSteps: "),
        F.substring(F.array_join("steps", ". "), 1, 300),
    )


def section_content() -> Column:
    short = F.when(
        F.length("content") > 500, F.concat(F.substring("content", 1, 500), F.lit("..."))
    ).otherwise(F.col("content"))
    return F.concat(F.lit("["), F.col("path"), F.lit("] "), F.col("heading"), F.lit("\n"), short)


# --- branches ----------------------------------------------------------------------------
def _hit(df: DataFrame, memory_type: str, group: int, rank: Column, **given: Column) -> DataFrame:
    defaults = {
        "name": F.lit(None).cast("string"), "type": F.lit(None).cast("string"),
        "graph_proximity": F.lit(0.0), "stated": F.lit(False),
        "execution_count": F.lit(0).cast("bigint"), "success_rate": F.lit(0.0),
    }
    columns = {**defaults, **given}
    columns["memory_type"] = F.lit(memory_type)
    columns["found"] = F.struct(F.lit(group).alias("g"), rank.cast("double").alias("r"))
    return df.select("query_id", *[columns.get(c, F.col(c)).alias(c) for c in HIT_COLUMNS[1:]])


def _rank(order: list[Column]) -> Column:
    return F.row_number().over(Window.partitionBy("query_id").orderBy(*order))


def node_hits(queries: DataFrame, found: DataFrame, nodes: DataFrame, as_of, limit: int) -> DataFrame:
    """Nearest nodes and keyword nodes, merged; a node found by both keeps the
    nearest-neighbour row with the greater text match."""
    near = knn(queries, nodes, 2 * limit, 0.2).select(
        "query_id", F.col("item_id").alias("id"), "similarity", F.col("rank").alias("near_rank")
    )
    found = _found_in(found, "semantic")
    lows = queries.select("query_id", F.lower("text").alias("query_low"))
    merged = near.join(found, ["query_id", "id"], "full_outer").join(lows, "query_id").join(nodes.drop("embedding"), "id")
    is_near = F.col("near_rank").isNotNull()
    eff = effective_confidence(F.col("confidence"), F.col("last_modified"), as_of)
    score = text_match(F.col("query_low"), [F.col("name"), F.col("context"), F.col("significance")])
    trust = F.when(is_near, eff).otherwise(F.col("confidence"))
    scored = merged.withColumns(
        {
            "_tm": F.when(
                is_near & F.col("word_rank").isNotNull(), F.greatest("similarity", score)
            ).when(is_near, F.col("similarity")).otherwise(score),
            "_rank": F.when(is_near, F.col("near_rank")).otherwise(F.col("word_rank") + F.lit(1_000_000)),
        }
    )
    return _hit(
        scored, "semantic", 0, F.col("_rank"), name=F.col("name"), type=F.col("type"), content=node_content(),
        text_match=F.col("_tm"), importance=trust, confidence=trust,
        recency=recency(F.col("last_modified"), as_of),
        stated=is_near & (F.col("confidence_basis") == "stated"),
    )


def episode_hits(queries: DataFrame, found: DataFrame, episodes: DataFrame, as_of, limit: int) -> DataFrame:
    near = knn(queries, episodes, 2 * limit, 0.25).select(
        "query_id", F.col("item_id").alias("id"), "similarity", F.col("rank").alias("near_rank")
    )
    found = _found_in(found, "episode")
    lows = queries.select("query_id", F.lower("text").alias("query_low"))
    merged = (
        near.join(found, ["query_id", "id"], "full_outer").join(lows, "query_id")
        .join(episodes.select("id", "summary", "narrative", "importance_score", "created_at"), "id")
    )
    is_near = F.col("near_rank").isNotNull()
    score = text_match(F.col("query_low"), [F.col("summary"), F.col("narrative")])
    return _hit(
        merged, "episode", 1, F.when(is_near, F.col("near_rank")).otherwise(F.col("word_rank") + 1_000_000),
        content=episode_content(), text_match=F.when(is_near, F.col("similarity")).otherwise(score),
        importance=F.col("importance_score"), confidence=F.col("importance_score"),
        recency=recency(F.col("created_at"), as_of),
    )


def lesson_hits(found: DataFrame, words: Words, lessons: DataFrame, as_of) -> DataFrame:
    rank = _severity_rank()
    found = _found_in(found, "lesson").join(lessons, "id").join(words.lows, "query_id")
    return _hit(
        found, "lesson", 2, F.lit(0), content=lesson_content(),
        text_match=text_match(F.col("query_low"), [F.col("statement"), F.col("prevention_rule")]),
        importance=F.when(rank == 0, 1.0).when(rank == 1, 0.7).otherwise(0.4),
        recency=recency(F.col("created_at"), as_of),
        confidence=F.least(F.lit(1.0), F.lit(0.3) + F.col("times_reinforced") * 0.1),
    )


def search_identity(words: Words, identity: DataFrame) -> DataFrame:
    searched = F.lower(F.concat_ws("\u0001", "key", "value", "category"))
    found = rows_of_queries(identity, searched, words.rows, ["id"]).join(identity, "id").join(words.lows, "query_id")
    return _hit(
        found, "identity", 3, F.lit(0), content=identity_content(),
        text_match=text_match(F.col("query_low"), [F.col("key"), F.col("value")]),
        importance=F.when(F.col("category") == "core", 1.0).when(F.col("category") == "value", 0.9).otherwise(0.7),
        recency=F.lit(1.0),
        confidence=F.least(F.lit(1.0), F.lit(0.5) + F.col("times_affirmed") * 0.05),
    )


def procedure_hits(found: DataFrame, words: Words, procedures: DataFrame, as_of) -> DataFrame:
    found = _found_in(found, "procedure").join(procedures, "id").join(words.lows, "query_id")
    ran = F.col("execution_count") > 0
    return _hit(
        found, "procedure", 4, F.lit(0), name=F.col("name"), type=F.col("type"), content=procedure_content(),
        text_match=text_match(F.col("query_low"), [F.col("name"), F.array_join("steps", ". ")]),
        importance=F.col("confidence"), confidence=F.col("confidence"),
        recency=F.coalesce(recency(F.col("last_executed"), as_of), F.lit(0.3)),
        execution_count=F.col("execution_count"),
        success_rate=F.when(ran, F.col("success_count") / F.col("execution_count")).otherwise(0.0),
    )


def file_priority(path: Column, as_of) -> Column:
    from engram.functions.scores import days_between

    dated = F.try_to_timestamp(F.regexp_extract(path, r"(\d{4}-\d{2}-\d{2})", 1), F.lit("yyyy-MM-dd"))
    age = days_between(dated, as_of)
    rules = [(path == name, p) for name, p in lx.FILE_PRIORITY]
    rules += [
        (age < 1, 0.95), (age < 2, 0.85), (age < 7, 0.7), (age.isNotNull(), 0.5),
        (path.contains("research"), 0.6), (path.contains("journey") | path.contains("lesson"), 0.75),
    ]
    return first_match(rules, 0.5)


def section_scores(sections: DataFrame, as_of) -> DataFrame:
    """Query-independent part: id, lower-cased text, recency, priority, base score."""
    return sections.withColumns(
        {
            "id": F.concat(F.lit("md:"), F.col("path"), F.lit(":"), F.col("line_start").cast("string")),
            "_low": F.lower(F.concat(F.col("heading"), F.lit(" "), F.col("content"))),
            "s_recency": recency(F.col("modified"), as_of, 14.0),
            "s_priority": file_priority(F.col("path"), as_of),
        }
    ).withColumn("_base", F.col("s_priority") * 0.15 + F.col("s_recency") * 0.15)


def section_text_score() -> Column:
    """Phrase, word share, closeness and heading bonus; needs _low, heading, query_low, words."""
    low, head = F.col("_low"), F.lower("heading")
    matched = F.filter("words", lambda w: low.contains(w))
    share = F.size(matched) / F.greatest(F.size("words"), F.lit(1))
    base = F.greatest(F.when(low.contains(F.col("query_low")), 0.95).otherwise(0.0), share * 0.85)
    at = F.transform(matched, lambda w: F.instr(low, w))
    close = (F.size(matched) >= 2) & (F.array_max(at) - F.array_min(at) < 200)
    near = F.when(close, F.least(F.lit(1.0), base + 0.1)).otherwise(base)
    in_head = F.size(F.filter("words", lambda w: head.contains(w)))
    return F.least(F.lit(1.0), near + in_head * 0.05)


def _contenders(words: Words, prepared: DataFrame, limit: int) -> DataFrame:
    """(query_id, id) of the sections that can be among the ``limit`` best of a query, from narrow rows alone.

    How many words of the query a section and its heading have follows from the posting lists. What that leaves open,
    the whole query as a phrase and words close together, bounds the score on both sides; a section whose greatest score is
    below the ``limit``-th of the least ones is out, and only the others fetch their text.
    """
    both = F.array(F.struct(F.lit(0).alias("_head"), F.col("_low").alias("_said")), F.struct(F.lit(1).alias("_head"), F.lower("heading").alias("_said")))
    rows = prepared.select("id", "_base", F.explode(both).alias("_part")).select("id", "_base", "_part.*")
    lists = posting_lists(rows, F.col("_said"), words.rows, ["id", "_base", "_head"])
    each = words.rows.select("query_id", "word", F.size(F.filter("words", lambda w: w == F.col("word"))).alias("_times"), F.size("words").alias("_n"))
    found = lists.join(each, "word").groupBy("query_id", "id", "word").agg(
        F.max("_base").alias("_base"), F.max("_head").alias("_head"), F.max("_times").alias("_times"), F.max("_n").alias("_n")
    )
    found = found.groupBy("query_id", "id").agg(
        F.max("_base").alias("_base"), F.max("_n").alias("_n"), F.sum("_times").alias("_m"), F.sum(F.col("_times") * F.col("_head")).alias("_h")
    )
    share = F.col("_m") / F.col("_n") * 0.85
    phrase = F.when(F.col("_m") == F.col("_n"), F.greatest(share, F.lit(0.95))).otherwise(share)
    most = F.when(F.col("_m") >= 2, F.least(F.lit(1.0), phrase + 0.1)).otherwise(phrase)
    rest = F.least(F.lit(1.0), F.col("_h") * 0.3) * 0.2 + F.col("_base")
    of = lambda text: F.least(F.lit(1.0), text + F.col("_h") * 0.05) * 0.5 + rest
    bounded = found.select("query_id", "id", of(share).alias("_least"), of(most).alias("_most")).checkpoint()
    best = top_per(bounded, ["query_id"], [F.col("_least").desc(), F.col("id")], limit)
    bar = best.groupBy("query_id").agg(F.when(F.count("*") >= limit, F.min("_least")).otherwise(0.0).alias("_bar"))
    return bounded.join(bar, "query_id").filter(F.col("_most") >= F.col("_bar") - 1e-6).select("query_id", "id")


def search_sections(
    queries: DataFrame, sections: DataFrame, as_of, limit: int, min_score: float = 0.15, words: Words | None = None
) -> DataFrame:
    """Best sections per query, columns s_text, s_header, s_priority, s_recency, s_total.

    A section without any query word scores only its base, which is the same for
    all queries, so the ``limit`` best bases stand for all such sections. The scored sections, the bounds and the
    contenders are written once, so that each step is planned on its own.
    """
    words = Words(queries) if words is None else words
    prepared, asked = section_scores(sections, as_of).checkpoint(), words.asked
    matched = _contenders(words, prepared, limit).checkpoint().join(prepared, "id").join(asked, "query_id")
    wordless = asked.filter(F.size("words") == 0)
    if wordless.limit(1).count() > 0:
        phrase = contained_terms(prepared, "_low", wordless, "query_low", ["id"])
        matched = matched.unionByName(phrase)
    best = [
        r["id"]
        for r in prepared.orderBy(F.col("_base").desc(), "id").limit(limit).select("id").collect()
    ]
    if best:
        standing = (
            asked.withColumn("id", F.explode(F.array(*[F.lit(b) for b in best])))
            .join(prepared, "id")
            .filter(~F.exists("words", lambda w: F.col("_low").contains(w)))
            .filter((F.size("words") > 0) | ~F.col("_low").contains(F.col("query_low")))
        )
        matched = matched.unionByName(standing)
    head = F.lower("heading")
    header = F.least(F.lit(1.0), F.size(F.filter("words", lambda w: head.contains(w))) * 0.3)
    scored = matched.withColumns({"s_text": section_text_score(), "s_header": header}).withColumn(
        "s_total", F.col("s_text") * 0.5 + F.col("s_header") * 0.2 + F.col("_base")
    )
    kept = scored.filter(F.col("s_total") >= min_score)
    return top_per(kept, ["query_id"], [F.round("s_total", 9).desc(), F.col("id")], limit).drop("_low", "_base")


def section_hits(queries: DataFrame, words: Words, sections: DataFrame, as_of, limit: int) -> DataFrame:
    found = search_sections(queries, sections, as_of, 2 * limit, words=words)
    return _hit(
        found, "markdown", 5, F.lit(0), name=F.col("heading"), type=F.col("path"), content=section_content(),
        text_match=F.col("s_text"), importance=F.col("s_priority"), confidence=F.col("s_priority"),
        recency=F.col("s_recency"),
    )


# --- combination ------------------------------------------------------------------------------
def apply_boosts(hits: DataFrame, boosts: DataFrame, nodes: DataFrame, as_of) -> DataFrame:
    """Raise boosted hits and add boosted nodes that were not found."""
    raised = (
        hits.join(boosts, ["query_id", "id"], "left")
        .withColumns(
            {
                "graph_proximity": F.greatest("graph_proximity", F.coalesce("boost", F.lit(0.0))),
                "text_match": F.greatest("text_match", F.coalesce("boost", F.lit(0.0)) * 0.7),
                "routed": F.col("boost").isNotNull(),
            }
        )
        .drop("boost")
    )
    missing = boosts.join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti").join(nodes, "id")
    eff = effective_confidence(F.col("confidence"), F.col("last_modified"), as_of)
    injected = _hit(
        missing, "semantic", 6, -F.col("boost"), name=F.col("name"), type=F.col("type"), content=node_content(),
        text_match=F.lit(0.0), graph_proximity=F.col("boost"), importance=eff, confidence=eff,
        recency=recency(F.col("last_modified"), as_of),
    ).withColumn("routed", F.lit(True))
    return raised.unionByName(injected)


def graph_proximity(hits: DataFrame, nodes: DataFrame, edges: DataFrame, seeds: int = 5, fan_out: int = 10) -> DataFrame:
    """1/depth for named hits within two hops of the first five semantic hits.

    Only edges between a seed (or its ten strongest neighbours) and the hits of
    the same query are looked up, by pair, so a hub is never expanded in full. The seeds, their neighbours and the
    connections, a bounded number per query, are written once, so that each step is planned on its own.
    """
    use_checkpoints(hits.sparkSession)
    named = hits.filter(F.col("name").isNotNull()).select(
        "query_id", "id", "name", "memory_type", "routed", "found"
    )
    order = [F.col("found"), F.col("id")]
    first = top_per(named.filter("memory_type = 'semantic'"), ["query_id"], order, seeds).select(
        "query_id", F.col("id").alias("seed"), F.col("name").alias("seed_name")
    ).checkpoint()
    ends = named.select("query_id", "name").distinct().join(
        nodes.select(F.col("id").alias("dst"), "name"), "name"
    )
    both = undirected(edges)
    # the neighbours of a seed are the same for every query that has it
    near = (
        first.select("seed").distinct().join(both, F.col("seed") == F.col("src"))
        .filter("src <> dst")
        .join(nodes.select(F.col("id").alias("dst"), F.col("name").alias("mid_name")), "dst")
    )
    middle = (
        top_per(
            near, ["seed"],
            [F.col("strength").desc(), F.col("mid_name"), F.upper("relationship"), F.col("dst")], fan_out,
        )
        .select("seed", "mid_name")
        .distinct()
        .join(nodes.select(F.col("id").alias("src"), F.col("name").alias("mid_name")), "mid_name")
        .drop("mid_name")
        .join(first, "seed")
        .checkpoint()
    )
    links = both.select("src", "dst")
    one = (
        first.withColumn("src", F.col("seed")).join(ends, "query_id").filter("src <> dst")
        .withColumn("depth", F.lit(1))
    )
    two = middle.join(ends, "query_id").filter("name <> seed_name").withColumn("depth", F.lit(2))
    columns = ["query_id", "seed", "src", "dst", "name", "depth"]
    connected = (
        one.select(*columns).unionByName(two.select(*columns))
        .join(links, ["src", "dst"], "left_semi")
        .groupBy("query_id", "seed", "name")
        .agg(F.min("depth").alias("depth"))
        .checkpoint()
    )
    target = (
        connected.join(named, ["query_id", "name"])
        .filter("id <> seed")
        .groupBy("query_id", "seed", "name", "depth")
        .agg(F.min(F.struct("found", "id", "memory_type", "routed")).alias("hit"))
        .filter("NOT hit.routed")
        .groupBy("query_id", F.col("hit.id").alias("id"), F.col("hit.memory_type").alias("memory_type"))
        .agg((F.lit(1.0) / F.min("depth")).alias("_gp"))
    )
    return (
        hits.join(target, ["query_id", "id", "memory_type"], "left")
        .withColumn("graph_proximity", F.greatest("graph_proximity", F.coalesce("_gp", F.lit(0.0))))
        .drop("_gp")
    )


def fuse(hits: DataFrame, weighted: DataFrame, limit: int | None = 10, min_score: float = 0.1) -> DataFrame:
    """Weighted sum, thin-content and stated factors, layer affinity, experience."""
    w = weighted.select("query_id", "query_type", *[f"w_{s}" for s in lx.SCORES])
    joined = hits.join(w, "query_id")
    kind = F.col("memory_type")
    plain = reduce(lambda a, b: a + b, [F.col(s) * F.col(f"w_{s}") for s in lx.SCORES])
    gp = F.col("w_graph_proximity")
    paper = (
        F.col("text_match") * (F.col("w_text_match") + gp * 0.6)
        + F.col("importance") * F.col("w_importance")
        + F.col("recency") * (F.col("w_recency") + gp * 0.4)
        + F.col("confidence") * F.col("w_confidence")
    )
    size = F.length("content")
    thin = F.when(size < 50, 0.6).when(size < 100, 0.8).otherwise(1.0)
    base = F.when(kind == "markdown", paper).otherwise(
        plain * thin * F.when(F.col("stated"), 1.05).otherwise(1.0)
    )
    affinity = first_match(
        [
            ((F.col("query_type") == q) & (kind == t), a)
            for q, row in lx.LAYER_AFFINITY.items()
            for t, a in zip(lx.MEMORY_TYPES, row)
        ],
        1.0,
    )
    practised = (kind == "procedure") & (F.col("query_type") == "procedural") & (F.col("execution_count") > 0)
    experience = F.when(
        practised, F.lit(1.0) + F.least("execution_count", F.lit(10)) / 10 * 0.15 * F.col("success_rate")
    ).otherwise(1.0)
    scored = joined.withColumn("total_score", F.round(base * affinity * experience, 9))
    kept = scored.filter(F.col("total_score") >= min_score).drop(*[f"w_{s}" for s in lx.SCORES])
    if limit is None:
        return kept
    order = [F.col("total_score").desc(), F.col("memory_type"), F.col("id")]
    best = top_per(kept, ["query_id"], order, limit)
    return best.withColumn("rank", _rank(order))


def candidate_hits(
    queries: DataFrame, tables: dict[str, DataFrame], as_of, limit: int, memory_types: list[str] | None = None
) -> DataFrame:
    """Union of all branches, with boosts applied, before proximity and fusion."""
    wants = lambda t, *need: (memory_types is None or t in memory_types) and all(n in tables for n in need)
    words = Words(queries)
    branches = [b for b, table in _TABLES.items() if wants(b, table)]
    found = keyword_candidates(words, tables, limit, branches) if branches else None
    parts = []
    if "semantic" in branches:
        parts.append(node_hits(queries, found, tables["nodes"], as_of, limit))
    if "episode" in branches:
        parts.append(episode_hits(queries, found, tables["episodes"], as_of, limit))
    if "lesson" in branches:
        parts.append(lesson_hits(found, words, tables["lessons"], as_of))
    if wants("identity", "identity"):
        parts.append(search_identity(words, tables["identity"]))
    if "procedure" in branches:
        parts.append(procedure_hits(found, words, tables["procedures"], as_of))
    if wants("markdown", "sections"):
        parts.append(section_hits(queries, words, tables["sections"], as_of, limit))
    # a branch has a bounded number of rows per query; written one by one, each is planned on its own
    hits = reduce(lambda a, b: a.unionByName(b), [p.checkpoint() for p in parts])
    if wants("semantic", "nodes", "edges"):
        boosts = routing_boosts(queries, tables["nodes"], tables["edges"]).checkpoint()
        return apply_boosts(hits, boosts, tables["nodes"], as_of)
    return hits.withColumn("routed", F.lit(False))


def _settle(rows: DataFrame) -> DataFrame:
    """Write the queries, their weights or the candidates once: a bounded number of rows per query, read by every
    later step, from all branches."""
    use_checkpoints(rows.sparkSession)
    return rows.checkpoint()


def hybrid_search(
    queries: DataFrame,
    tables: dict[str, DataFrame],
    as_of,
    limit: int = 10,
    min_score: float = 0.1,
    weights: dict[str, float] | None = None,
    memory_types: list[str] | None = None,
) -> DataFrame:
    """Ranked hits per query. ``queries``: query_id, text, embedding (may be null)."""
    queries = _settle(queries)
    weighted = _settle(query_weights(classify_queries(queries), weights))
    hits = _settle(candidate_hits(queries, tables, as_of, limit, memory_types))
    if "edges" in tables and (memory_types is None or "semantic" in memory_types):
        hits = graph_proximity(hits, tables["nodes"], tables["edges"])
    return fuse(hits, weighted, limit, min_score)


def compare_search(queries: DataFrame, tables: dict[str, DataFrame], as_of, limit: int = 5, min_score: float = 0.05) -> DataFrame:
    """Counts and sources for memory only, markdown only, and both together."""
    queries = _settle(queries)
    weighted = _settle(query_weights(classify_queries(queries)))
    hits = _settle(candidate_hits(queries, tables, as_of, limit))
    brain = graph_proximity(hits.filter("memory_type <> 'markdown'"), tables["nodes"], tables["edges"])
    unified = graph_proximity(hits, tables["nodes"], tables["edges"])
    paper = hits.filter("memory_type = 'markdown'").withColumns(
        {"routed": F.lit(False), "graph_proximity": F.lit(0.0)}
    )
    out = []
    for label, part, source in [("brain", brain, "memory_type"), ("markdown", paper, "type"), ("unified", unified, "memory_type")]:
        # at most ``limit`` rows per query; written one by one, each system is planned on its own
        best = fuse(part, weighted, limit, min_score).checkpoint()
        out.append(
            best.groupBy("query_id").agg(
                F.count("*").alias("results"),
                F.sort_array(F.collect_set(source)).alias("sources"),
                F.count_if(F.col("memory_type") == "markdown").alias("markdown_results"),
                F.max("total_score").alias("top_score"),
            ).withColumn("system", F.lit(label))
        )
    return reduce(lambda a, b: a.unionByName(b), out)


def evaluate_retrieval(hits: DataFrame, cases: DataFrame, latency_ms: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(per case, per category and overall) hit rates.

    ``cases``: query_id, category, expected_keywords, expected_entities. The
    contents of one case are at most the search limit.
    """
    text = (
        hits.groupBy("query_id")
        .agg(
            F.array_join(
                F.transform(F.sort_array(F.collect_list(F.struct("rank", "content"))), lambda s: F.lower(s["content"])), " "
            ).alias("_all"),
            F.count("*").alias("result_count"),
            F.max("total_score").alias("top_score"),
        )
    )
    joined = cases.join(text, "query_id", "left").withColumns(
        {
            "_all": F.coalesce("_all", F.lit("")),
            "result_count": F.coalesce("result_count", F.lit(0)),
            "top_score": F.coalesce("top_score", F.lit(0.0)),
        }
    )

    def rate(column: str, empty: float) -> Column:
        n = F.coalesce(F.size(column), F.lit(0))
        found = F.size(F.filter(column, lambda k: F.col("_all").contains(F.lower(k))))
        return F.when(n > 0, found / F.greatest(n, F.lit(1))).otherwise(empty)

    per_case = joined.withColumns(
        {"keyword_hit_rate": rate("expected_keywords", 0.0), "entity_hit_rate": rate("expected_entities", 1.0)}
    ).drop("_all")
    speed = (1 - min(latency_ms / 1000, 1)) * 0.3
    summary = per_case.rollup("category").agg(
        F.count("*").alias("cases"), F.avg("keyword_hit_rate").alias("avg_keywords"),
        (F.avg("keyword_hit_rate") * 0.7 + speed).alias("fitness"),
    ).withColumn("category", F.coalesce("category", F.lit("overall")))
    return per_case, summary
