"""From a markdown corpus and model extractions to graph rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions import lexicons as lx
from engram.functions.scores import clamp
from engram.functions.text import contains_any, js_trim, labels_where, no_strings, one_of_chars
from engram.operators.consolidation import json_block
from engram.operators.matching import contained_terms, resolve_names
from engram.operators.ordering import follow_pointers, running_index
from engram.session import use_checkpoints

ENTITY_JSON = (
    "entities array<struct<name:string,type:string,aliases:array<string>,context:string,emotional_weight:double>>"
)
RELATION_JSON = (
    "relationships array<struct<source:string,target:string,relationship:string,category:string,"
    "strength:double,context:string>>"
)
BATCH_CHARS = 2500
BATCH_SECTIONS = 3


# --- curated seeds -------------------------------------------------------------------
def seed_nodes(entities: DataFrame) -> DataFrame:
    """Curated entities as rows for the node upsert."""
    return entities.select(
        "type", "name", F.coalesce("aliases", no_strings()).alias("aliases"),
        F.create_map().cast("map<string,string>").alias("attributes"), "context",
        F.lit(None).cast("string").alias("significance"), F.lit(1.0).alias("confidence"),
        F.lit("stated").alias("confidence_basis"),
        F.when(F.col("type") == "person", 0.8).otherwise(0.3).alias("emotional_weight"), "batch_order",
    )


def resolve_edges(rels: DataFrame, nodes: DataFrame, confidence: float, ignore_case: bool) -> tuple[DataFrame, DataFrame]:
    """(edges, rows whose endpoints are unknown)."""
    s = resolve_names(rels, nodes, "source", ignore_case).withColumnRenamed("node_id", "source_id")
    t = resolve_names(s, nodes, "target", ignore_case).withColumnRenamed("node_id", "target_id")
    known = F.col("source_id").isNotNull() & F.col("target_id").isNotNull()
    edges = t.filter(known).select(
        "source_id", "target_id", "relationship", "category", "strength", F.lit(confidence).alias("confidence"), "context"
    )
    return edges, t.filter(~known).select(*rels.columns)


def seed_graph(rels: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    return resolve_edges(rels, nodes, 1.0, ignore_case=False)


# --- discovery in sections ---------------------------------------------------------------
def discover_people(sections: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, context) of bold names that look like people and are not known yet."""
    names = sections.select(
        F.explode(F.regexp_extract_all("content", F.lit(lx.BOLD_NAME), F.lit(1))).alias("name"),
        F.concat(F.lit("Discovered in "), F.col("name"), F.lit(": "), F.col("heading")).alias("context"),
        F.struct("path", "line_start").alias("at"),
    )
    parts = F.split("name", " ")
    listed = lambda words: F.array(*[F.lit(w) for w in words])
    fragment = F.exists(
        listed(lx.NAME_FRAGMENTS), lambda f: F.col("name").contains(f) | f.contains(F.col("name"))
    )
    kept = names.filter(
        ~fragment
        & ~F.exists(parts, lambda p: F.length(p) < 3)
        & ~F.arrays_overlap(parts, listed(lx.NAME_COMMON_WORDS))
        & ~F.exists(parts, lambda p: (p == F.upper(p)) & (F.length(p) > 2))
        & ~F.arrays_overlap(parts, listed(lx.NAME_TECH_WORDS))
        & (F.size(parts) <= 3)
    )
    known = nodes.select(F.explode(F.concat(F.array("name"), F.coalesce("aliases", no_strings()))).alias("name")).distinct()
    return kept.join(known, "name", "left_anti").groupBy("name").agg(F.min_by("context", "at").alias("context"))


def lessons_from_sections(sections: DataFrame, strict: bool = True) -> DataFrame:
    content, heading = F.col("content"), F.col("heading")
    severity = (
        F.when(heading.contains("CRITICAL") | content.contains("CRITICAL"), "critical")
        .when(heading.contains("RECURRING"), "important").otherwise("minor")
    )
    default = "See full lesson for prevention steps."
    if not strict:
        return sections.filter(F.length(content) >= 50).select(
            "path", "line_start", F.concat(heading, F.lit(": "), F.substring(content, 1, 200)).alias("statement"),
            severity.alias("severity"), F.lit(default).alias("prevention_rule"), F.lit(1).alias("times_reinforced"),
        )
    told = F.regexp_extract(content, r"\*\*(?:Mistake|Problem):\*\*\s*(.+?)(?:\n|\z)", 1)
    rule = F.regexp_extract(content, r"\*\*(?:Rule|Fix):\*\*\s*(.+?)(?:\n|\z)", 1)
    some = lambda v, other: F.when(F.length(v) > 0, v).otherwise(other)
    return sections.filter(contains_any(content, ["Mistake:", "Problem:", "Rule:"])).select(
        "path", "line_start", F.concat(heading, F.lit(": "), some(told, F.substring(content, 1, 200))).alias("statement"),
        severity.alias("severity"), some(rule, F.lit(default)).alias("prevention_rule"), F.lit(1).alias("times_reinforced"),
    )


def section_importance(variant: str = "curated") -> Column:
    low, size = F.lower("content"), F.length("content")
    flag = lambda cond, gain: F.when(cond, gain).otherwise(0.0)
    score = F.lit(0.5) + flag(F.col("heading").rlike(one_of_chars(lx.HEADING_MARKERS_STRONG)), 0.2)
    score = score + flag(F.col("heading").rlike(one_of_chars(lx.HEADING_MARKERS_MILD)), 0.1)
    for words, gain in lx.SECTION_KEYWORD_GROUPS[variant]:
        score = score + flag(contains_any(low, words), gain)
    score = score + flag(size > 2000, 0.1) + flag(size > 5000, 0.1)
    return F.least(F.lit(1.0), score)


def section_topics(method: str = "words") -> Column:
    """Topics by the word list or by the pattern list."""
    if method == "words":
        low = F.lower("content")
        return labels_where([(low.contains(w), w) for w in lx.SECTION_TOPIC_WORDS])
    return labels_where([(F.col("content").rlike(p), label) for p, label in lx.SECTION_TOPICS])


def entity_topics(sections: DataFrame, entities: DataFrame, most: int = 20) -> DataFrame:
    """(path, line_start, topics): entities named in a section, first 20 by name."""
    key = ["path", "line_start"]
    own = entities.select("name", F.lower("name").alias("term"))
    other = entities.select("name", F.explode("aliases").alias("a")).filter(F.length("a") >= 3).select("name", F.lower("a").alias("term"))
    texts = sections.select(*key, F.lower("content").alias("_low"))
    hits = contained_terms(texts, "_low", own.unionByName(other).distinct(), "term", key, windowed=True).select(*key, "name").distinct()
    return hits.groupBy(*key).agg(F.slice(F.sort_array(F.collect_set("name")), 1, most).alias("topics"))


def daily_episodes(sections: DataFrame, variant: str = "curated", topics: str = "words") -> DataFrame:
    """Marked sections of daily files as episodes; sections carry ``role``."""
    markers = lx.DAILY_MARKERS_WIDE if variant == "model" else lx.DAILY_MARKERS
    shown = F.concat(F.col("heading"), F.substring("content", 1, 50))
    date = F.regexp_extract("name", r"(\d{4}-\d{2}-\d{2})", 1)
    point = lambda v: F.struct(F.lit(v).alias("valence"), F.lit(0.3).alias("arousal"))
    return sections.filter(
        (F.col("role") == "daily") & (F.length("content") > 100) & shown.rlike(one_of_chars(markers))
    ).select(
        F.concat(F.lit("md:"), F.col("path"), F.lit(":"), F.col("line_start").cast("string")).alias("id"),
        F.concat(F.lit("daily-"), F.when(F.length(date) > 0, date).otherwise("unknown")).alias("session_id"),
        F.substring("heading", 1, 500).alias("summary"), F.substring("content", 1, 4000).alias("narrative"),
        section_topics(topics).alias("topics"), section_importance(variant).alias("importance_score"),
        F.struct(point(0.0).alias("start"), F.lit("stable").alias("trajectory"), point(0.3).alias("end")).alias("arc"),
    )


def pack_batches(sections: DataFrame) -> DataFrame:
    """(path, line_start, batch): sections over 200 characters, packed
    in order to at most 2500 characters or three sections.

    Where a batch that starts at a section ends follows from the three sections after it, so every section gets a pointer
    to the next start. The starts of a file are what the pointers reach from its first section; pointers are
    doubled, so no file is read in order by one task.
    """
    use_checkpoints(sections.sparkSession)
    size = F.length("content")
    rows = sections.filter(size > 200).select("path", "line_start", size.alias("chars"), (F.length("heading") + size + 6).alias("full"))
    placed = running_index(rows, ["path"], ["line_start", "chars", "full"], F.floor(F.col("line_start") / 4096), "t").checkpoint()
    after = F.explode(F.sequence(F.lit(0), F.lit(BATCH_SECTIONS)))
    seen = placed.withColumn("k", after).select("path", (F.col("t") - F.col("k")).alias("t"), "k", "chars", "full").groupBy("path", "t").agg(
        F.map_from_entries(F.collect_list(F.struct("k", F.struct("chars", "full")))).alias("s")
    ).filter(F.map_contains_key("s", F.lit(0)))
    chars, full = (lambda k, c=c: F.try_element_at("s", F.lit(k))[c] for c in ("chars", "full"))
    filled, leap = full(0), F.lit(None).cast("int")
    rules = []
    for k in range(1, BATCH_SECTIONS + 1):
        rules.append(chars(k).isNotNull() & ((filled + chars(k) > BATCH_CHARS) if k < BATCH_SECTIONS else F.lit(True)))
        filled = filled + full(k)
    for k in range(BATCH_SECTIONS, 0, -1):
        leap = F.when(rules[k - 1], k).otherwise(leap)
    # a batch without a next one takes what is left of its file
    jumps = seen.select("path", "t", (F.col("t") + leap).alias("next")).checkpoint()
    starts = follow_pointers(placed.filter("t = 1").select("path", "t"), jumps.filter("next is not null"), ["path"]).join(jumps, ["path", "t"])
    numbered = running_index(starts, ["path"], ["t"], F.floor(F.col("t") / 4096), "batch")
    covered = numbered.select(
        "path", F.explode(F.sequence("t", F.coalesce(F.col("next") - 1, F.col("t") + BATCH_SECTIONS - 1))).alias("t"), (F.col("batch") - 1).cast("int").alias("batch")
    )
    return placed.join(covered, ["path", "t"]).select("path", F.col("line_start").cast("int").alias("line_start"), "batch")


def relation_candidates(sections: DataFrame, names: DataFrame, most: int = 30) -> DataFrame:
    """Sections of 100+ characters naming two or more entities, with the first 30 names."""
    key = ["path", "line_start"]
    texts = sections.filter(F.length("content") >= 100).select(*key, F.lower("content").alias("_low"))
    terms = names.select("name", F.lower("name").alias("term")).distinct()
    hits = contained_terms(texts, "_low", terms, "term", key, windowed=True).select(*key, "name").distinct()
    return (
        hits.groupBy(*key).agg(F.sort_array(F.collect_set("name")).alias("names"))
        .filter(F.size("names") >= 2).withColumn("names", F.slice("names", 1, most))
    )


# --- model extractions -----------------------------------------------------------------------
def clean_entities(raw: DataFrame, keep: list[str]) -> DataFrame:
    parsed = F.from_json(json_block(F.col("raw")), ENTITY_JSON)["entities"]
    rows = raw.select(*keep, F.posexplode(parsed).alias("pos", "e")).select(*keep, "pos", "e.*")
    aliases = F.filter(F.transform(F.coalesce("aliases", no_strings()), js_trim), lambda a: F.length(a) > 0)
    return rows.filter((F.length("name") > 0) & F.col("type").isin(lx.ENTITY_TYPES)).select(
        *keep, "pos", js_trim(F.col("name")).alias("name"), "type", aliases.alias("aliases"),
        F.substring(js_trim(F.coalesce("context", F.lit(""))), 1, 500).alias("context"),
        F.coalesce(clamp(F.col("emotional_weight"), 0.0, 1.0), F.lit(0.3)).alias("emotional_weight"),
    )


def clean_relationships(raw: DataFrame, names: DataFrame, keep: list[str]) -> DataFrame:
    """Known kinds and known endpoints only (case ignored), spelled as in ``names``."""
    parsed = F.from_json(json_block(F.col("raw")), RELATION_JSON)["relationships"]
    rows = raw.select(*keep, F.posexplode(parsed).alias("pos", "r")).select(*keep, "pos", "r.*")
    known = names.groupBy(F.lower("name").alias("_l")).agg(F.min("name").alias("_n"))
    s = known.select(F.col("_l").alias("_sl"), F.col("_n").alias("_s"))
    t = known.select(F.col("_l").alias("_tl"), F.col("_n").alias("_t"))
    return (
        rows.filter(F.col("relationship").isin(lx.RELATION_TYPES))
        .join(s, F.lower("source") == F.col("_sl")).join(t, F.lower("target") == F.col("_tl"))
        .select(
            *keep, "pos", F.col("_s").alias("source"), F.col("_t").alias("target"), "relationship",
            F.when(F.col("category").isin(lx.RELATION_CATEGORIES), F.col("category")).otherwise("relational").alias("category"),
            F.coalesce(clamp(F.col("strength"), 0.1, 1.0), F.lit(0.5)).alias("strength"),
            F.substring(js_trim(F.col("context")), 1, 300).alias("context"),
        )
    )


def match_names(given: DataFrame, names: DataFrame, column: str = "given") -> DataFrame:
    """Closest known name: equal ignoring case, else the first containing or contained one."""
    wanted = given.select(column).distinct().withColumn("_g", F.lower(js_trim(F.col(column))))
    known = names.select("name", F.lower("name").alias("_n")).distinct()
    equal = wanted.join(known, F.col("_g") == F.col("_n")).groupBy(column).agg(F.min("name").alias("_exact"))
    rest = wanted.join(equal, column, "left_anti").filter(F.length("_g") > 0)
    inside = contained_terms(known, "_n", rest, "_g", ["_n"]).select(column, "name")
    around = contained_terms(rest, "_g", known, "_n", [column]).select(column, "name")
    partial = inside.unionByName(around).groupBy(column).agg(F.min("name").alias("_partial"))
    return (
        given.join(equal, column, "left").join(partial, column, "left")
        .withColumn("matched", F.coalesce("_exact", "_partial", js_trim(F.col(column)))).drop("_exact", "_partial")
    )


def merge_entities(entities: DataFrame, rounds: int = 20) -> DataFrame:
    """Fold short forms into long ones: (name, type, aliases, context, emotional_weight).

    Every name picks one parent: the longest other name that contains it or is
    tied to it by an alias (ties alphabetical). Following parents leads to the
    root; the result does not depend on the order of the rows.
    """
    use_checkpoints(entities.sparkSession)
    rows = entities.withColumn("k", F.lower("name"))
    keys = rows.select("k").distinct()
    bigger = contained_terms(
        keys.select(F.col("k").alias("p")), "p", keys, "k", ["p"]
    ).filter(F.length("p") > F.length("k"))
    alias = rows.select("k", F.explode("aliases").alias("a")).select("k", F.lower("a").alias("p")).join(
        keys.select(F.col("k").alias("p")), "p", "left_semi"
    )
    tied = alias.unionByName(alias.select(F.col("p").alias("k"), F.col("k").alias("p")))
    rank = lambda c: F.struct((-F.length(c)).alias("l"), F.col(c).alias("v"))
    tied = tied.filter(rank("p") < rank("k"))
    best = bigger.select("k", "p").unionByName(tied.select("k", "p")).groupBy("k").agg(F.min(rank("p")).alias("b"))
    root = keys.join(best, "k", "left").select("k", F.coalesce("b.v", "k").alias("root")).checkpoint()
    for _ in range(rounds):
        up = root.select(F.col("k").alias("root"), F.col("root").alias("up"))
        step = root.join(up, "root").select("k", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved")).checkpoint()
        root = step.select("k", "root")
        if step.filter("moved").limit(1).count() == 0:
            break
    grouped = rows.join(root, "k").groupBy("root").agg(
        F.max_by("name", F.struct(F.length("name"), "name")).alias("name"),
        F.max_by("type", F.struct(F.length("name"), "name", "type")).alias("type"),
        F.max_by("context", F.struct(F.length("context"), "context")).alias("context"),
        F.max("emotional_weight").alias("emotional_weight"),
        F.collect_set("name").alias("_names"), F.array_distinct(F.flatten(F.collect_set("aliases"))).alias("_aliases"),
    )
    others = F.filter(F.array_union("_names", "_aliases"), lambda a: (a != F.col("name")) & (a != F.lower("name")))
    return grouped.select("name", "type", F.sort_array(others).alias("aliases"), "context", "emotional_weight")


def merge_relationships(rels: DataFrame) -> DataFrame:
    """One row per (source, target, relationship), case ignored: greatest strength, longest context."""
    first = F.struct("source", "target", "category")
    return (
        rels.groupBy(F.lower("source").alias("_s"), F.lower("target").alias("_t"), "relationship")
        .agg(
            F.min(first).alias("f"), F.max("strength").alias("strength"),
            F.max_by("context", F.struct(F.length("context"), "context")).alias("context"),
        )
        .select("f.source", "f.target", "relationship", "f.category", "strength", "context")
    )
