"""Keeping the memory in shape: decay, contradictions, duplicates, weights, inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions import lexicons as lx
from engram.functions.scores import days_between, effective_confidence, timestamp
from engram.functions.text import contains_any, first_match
from engram.operators.matching import alias_index, contained_terms, top_per
from engram.operators.vectors import similar_pairs
from engram.session import stored, use_checkpoints


# --- decay -------------------------------------------------------------------------
def with_effective(nodes: DataFrame, as_of) -> DataFrame:
    return nodes.withColumn(
        "effective_confidence", effective_confidence(F.col("confidence"), F.col("last_verified"), as_of)
    )


def decay_report(nodes: DataFrame, as_of) -> DataFrame:
    eff = F.col("effective_confidence")
    return with_effective(nodes, as_of).agg(
        F.count("*").alias("processed"),
        F.count_if(eff < F.col("confidence") * 0.9).alias("decayed"),
        F.count_if(eff < 0.3).alias("stale"),
        F.coalesce(F.avg(eff), F.lit(0.0)).alias("avg_effective"),
    )


def stalest(nodes: DataFrame, n: int, as_of) -> DataFrame:
    first = nodes.orderBy("last_verified", "id").limit(n)
    return with_effective(first, as_of).withColumn(
        "days_since_verified", F.round(days_between(F.col("last_verified"), as_of)).cast("bigint")
    )


def verify_nodes(nodes: DataFrame, verdicts: DataFrame, as_of) -> DataFrame:
    """``verdicts``: id, new_confidence (may be null)."""
    v = verdicts.groupBy("id").agg(F.max("new_confidence").alias("_c"), F.lit(True).alias("_seen"))
    return (
        nodes.join(v, "id", "left")
        .withColumn("last_verified", F.when(F.col("_seen"), timestamp(as_of)).otherwise(F.col("last_verified")))
        .withColumn("confidence", F.coalesce("_c", "confidence"))
        .select(*nodes.columns)
    )


# --- contradictions -----------------------------------------------------------------
def check_contradictions(nodes: DataFrame, updates: DataFrame, as_of, source: str = "ingestion") -> DataFrame:
    """One record per (id, field) whose new JSON value differs from a known one.

    ``nodes``: id, attributes. ``updates``: id, attributes.
    """
    old = nodes.select("id", F.explode("attributes").alias("field", "old_value")).filter("old_value IS NOT NULL AND old_value <> 'null'")
    new = updates.select("id", F.explode("attributes").alias("field", "new_value"))
    return old.join(new, ["id", "field"]).filter("NOT (old_value <=> new_value)").select(
        "id", "field", "old_value", "new_value", F.lit("existing").alias("old_source"),
        F.lit(source).alias("new_source"), timestamp(as_of).alias("detected_at"),
        F.lit(False).alias("resolved"), F.lit(None).cast("string").alias("resolution"),
    )


def resolve_contradictions(nodes: DataFrame, records: DataFrame, resolutions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, records) after resolving open records by (id, field).

    ``resolutions``: id, field, resolution, new_value. accepted_new writes the
    attribute when the node had an open record for it.
    """
    r = resolutions.select("id", "field", F.col("resolution").alias("_res"), F.col("new_value").alias("_new"))
    joined = records.join(r, ["id", "field"], "left")
    hit = F.col("_res").isNotNull() & ~F.col("resolved")
    updated = joined.withColumns(
        {
            "resolution": F.when(hit, F.col("_res")).otherwise(F.col("resolution")),
            "resolved": F.col("resolved") | hit,
        }
    ).select(*records.columns)
    accepted = joined.filter(hit & (F.col("_res") == "accepted_new") & F.col("_new").isNotNull())
    writes = (
        accepted.groupBy("id", "field").agg(F.max("_new").alias("_new"))
        .groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("field", "_new"))).alias("_w"))
    )
    empty = F.create_map().cast("map<string,string>")
    added = F.coalesce("_w", empty)
    kept = F.map_filter(F.coalesce("attributes", empty), lambda k, v: ~F.map_contains_key(added, k))
    out = nodes.join(writes, "id", "left").withColumn("attributes", F.map_concat(kept, added)).select(*nodes.columns)
    return out, updated


def scan_contradictions(records: DataFrame) -> DataFrame:
    return records.agg(
        F.count_distinct("id").alias("nodes_scanned"),
        F.count_if(~F.col("resolved")).alias("found"),
        F.count_if("resolved").alias("resolved"),
    )


def open_contradictions(records: DataFrame, nodes: DataFrame) -> DataFrame:
    return records.filter("NOT resolved").join(nodes.select("id", "name"), "id").select(
        "name", "field", "old_value", "new_value"
    )


# --- duplicates -----------------------------------------------------------------------
def drop_orphans(nodes: DataFrame, edges: DataFrame, persons: DataFrame) -> DataFrame:
    """Drop person nodes below full confidence without edges and without a person model."""
    ends = edges.select(F.col("source_id").alias("id")).unionByName(
        edges.select(F.col("target_id").alias("id"))
    ).distinct()
    orphans = (
        nodes.filter("type = 'person' AND confidence < 1.0")
        .join(ends, "id", "left_anti")
        .join(persons.select("name").distinct(), "name", "left_anti")
        .select("id")
    )
    return nodes.join(orphans, "id", "left_anti")


def duplicate_candidates(nodes: DataFrame, threshold: float = 0.92) -> DataFrame:
    persons = stored(nodes.filter("type = 'person' AND embedding IS NOT NULL").select("id", "name", "embedding"), "persons")  # read four times
    pairs = similar_pairs(persons, threshold)
    names = persons.select("id", "name")
    return (
        pairs.join(names.select(F.col("id").alias("a"), F.col("name").alias("n1")), "a")
        .join(names.select(F.col("id").alias("b"), F.col("name").alias("n2")), "b")
        .select(F.least("n1", "n2").alias("name1"), F.greatest("n1", "n2").alias("name2"), "similarity")
    )


def alias_merges(nodes: DataFrame, persons: DataFrame) -> DataFrame:
    """(short_id, short_name, full_id): single words that are a part of a full name.

    The longest full name wins, then the alphabetically first. Names that have a
    person model are kept.
    """
    people = nodes.filter("type = 'person'").select("id", "name")
    words = F.split("name", " ")
    full = people.filter(F.size(words) >= 2).select(
        F.col("id").alias("full_id"), F.col("name").alias("full_name"), F.explode(F.array_distinct(words)).alias("short_name")
    )
    best = full.groupBy("short_name").agg(
        F.min(F.struct((-F.length("full_name")).alias("l"), "full_name", "full_id")).alias("f")
    )
    return (
        people.filter(F.size(words) == 1)
        .join(persons.select("name").distinct(), "name", "left_anti")
        .select(F.col("id").alias("short_id"), F.col("name").alias("short_name"))
        .join(best, "short_name")
        .select("short_id", "short_name", F.col("f.full_id").alias("full_id"))
    )


def merge_aliases(nodes: DataFrame, edges: DataFrame, persons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without the merged short names (kept as aliases), edges repointed."""
    merges = alias_merges(nodes, persons)
    gained = merges.groupBy(F.col("full_id").alias("id")).agg(F.sort_array(F.collect_set("short_name")).alias("_new"))
    kept = (
        nodes.join(merges.select(F.col("short_id").alias("id")), "id", "left_anti")
        .join(gained, "id", "left")
        .withColumn("aliases", F.when(F.col("_new").isNotNull(), F.array_union("aliases", "_new")).otherwise(F.col("aliases")))
        .drop("_new")
    )
    s = merges.select(F.col("short_id").alias("source_id"), F.col("full_id").alias("_s"))
    t = merges.select(F.col("short_id").alias("target_id"), F.col("full_id").alias("_t"))
    moved = (
        edges.join(s, "source_id", "left").join(t, "target_id", "left")
        .withColumns({"source_id": F.coalesce("_s", "source_id"), "target_id": F.coalesce("_t", "target_id")})
        .select(*edges.columns)
    )
    return kept, moved


# --- edge weights -----------------------------------------------------------------------
def reweight_edges(edges: DataFrame, nodes: DataFrame, as_of, recent_days: int = 7) -> DataFrame:
    """Strength from status words, source counts and recency of both endpoints.

    The five ordered steps of the rule collapse into one expression. Nodes carry
    ``source_count``.
    """
    low = F.lower("context")
    down = F.coalesce(contains_any(low, lx.STATUS_DOWN), F.lit(False))
    up = F.coalesce(contains_any(low, lx.STATUS_UP), F.lit(False))
    fresh = F.unix_micros("last_modified") > F.unix_micros(timestamp(as_of)) - recent_days * 86_400_000_000
    flags = nodes.select(
        "id", F.struct(
            down.alias("down"), (up & ~down).alias("up"), F.coalesce("source_count", F.lit(0)).alias("n"),
            F.coalesce(fresh, F.lit(False)).alias("fresh"), F.lit(True).alias("known"),
        ).alias("f"),
    )
    s = flags.select(F.col("id").alias("source_id"), F.col("f").alias("_s"))
    t = flags.select(F.col("id").alias("target_id"), F.col("f").alias("_t"))
    any_ = lambda c: F.coalesce(F.col(f"_s.{c}"), F.lit(False)) | F.coalesce(F.col(f"_t.{c}"), F.lit(False))
    both = F.col("_s").isNotNull() & F.col("_t").isNotNull()
    s0 = F.when(any_("up"), 0.6).when(any_("down"), 0.3).otherwise(0.5)
    n = F.when(both, F.greatest("_s.n", "_t.n")).otherwise(0)
    s1 = F.least(F.lit(1.0), s0 + n * 0.04)
    s2 = F.when(any_("fresh"), F.least(F.lit(1.0), s1 + 0.1)).otherwise(s1)
    final = F.when(any_("down"), F.least(F.lit(0.35), s2)).otherwise(s2)
    return (
        edges.join(s, "source_id", "left").join(t, "target_id", "left")
        .withColumn("strength", final)
        .select(*edges.columns)
    )


# --- relationship inference ----------------------------------------------------------------
def cooccurrence(sections: DataFrame, nodes: DataFrame, min_count: int = 1, key: str = "section_id") -> DataFrame:
    """(a, b, n): in how many sections two nodes are both named (terms of 4+ characters).

    Nodes named in fewer than ``min_count`` sections cannot reach it in a pair
    and leave before pairing; sections that name the same set of nodes are
    counted together, so a large group of copies is paired once.
    """
    terms = alias_index(nodes, 4).select(F.col("id").alias("node"), "term")
    texts = sections.select(key, F.lower("content").alias("_low"))
    found = contained_terms(texts, "_low", terms, "term", [key]).select(key, "node").distinct()
    if min_count > 1:
        often = found.groupBy("node").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_count)
        found = found.join(often.select("node"), "node", "left_semi")
    sets = (
        found.groupBy(key).agg(F.sort_array(F.collect_set("node")).alias("nodes"))
        .filter(F.size("nodes") > 1)
        .groupBy("nodes").agg(F.count("*").alias("w"))
    )
    firsts = sets.select("w", "nodes", F.posexplode("nodes").alias("i", "a"))
    pairs = firsts.select(
        "a", F.explode(F.slice("nodes", F.col("i") + 2, F.size("nodes"))).alias("b"), "w"
    )
    return pairs.groupBy("a", "b").agg(F.sum("w").alias("n")).filter(F.col("n") >= min_count)


def relationship_for(a: Column, b: Column) -> tuple[Column, Column]:
    rules = [((a == x) & (b == y), (r, c)) for x, y, r, c in lx.INFERRED_RELATIONSHIP]
    return (
        first_match([(cond, v[0]) for cond, v in rules], lx.INFERRED_DEFAULT[0]),
        first_match([(cond, v[1]) for cond, v in rules], lx.INFERRED_DEFAULT[1]),
    )


def greedy_cap(pairs: DataFrame, per_node: int, total: int) -> DataFrame:
    """Accept pairs in order (n desc, a, b), at most ``per_node`` per endpoint, first ``total``.

    Whether a pair is accepted depends on those before it alone, so the pairs are taken in slices of their order: twice
    ``total`` first, then twice as many each time, until ``total`` are accepted. All that lies behind is never touched.
    """
    use_checkpoints(pairs.sparkSession)
    ordered = pairs.withColumn("o", F.struct((-F.col("n")).alias("n"), "a", "b"))
    accepted, last, size = None, None, 2 * total
    while True:
        rest = ordered if last is None else ordered.filter(F.col("o") > last)
        part = rest.orderBy("o").limit(size).checkpoint()
        end = part.agg(F.max("o").alias("o")).first()["o"]
        if end is None:
            break
        accepted = _accepted_in_slice(part, accepted, per_node)
        if accepted.count() >= total:
            break
        last = F.struct(F.lit(end["n"]).alias("n"), F.lit(end["a"]).alias("a"), F.lit(end["b"]).alias("b"))
        size *= 2
    return (part if accepted is None else accepted).orderBy("o").limit(total).drop("o")


def _accepted_in_slice(part: DataFrame, before: DataFrame | None, per_node: int) -> DataFrame:
    """``before`` and the accepted pairs of a slice that follows it.

    Rounds of an exact parallel greedy: an open pair is accepted once fewer than
    the remaining places of both endpoints can be taken by open pairs before it,
    and dropped once an endpoint is full. Only the first open pairs per endpoint
    matter, so a hub is pruned before the shuffle; each round is checkpointed.
    """
    accepted = part.limit(0) if before is None else before
    open_ = part

    def taken(rows: DataFrame) -> DataFrame:
        return rows.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("_used"))

    while True:
        full = taken(accepted).filter(F.col("_used") >= per_node).select("node")
        open_ = (
            open_.join(full.withColumnRenamed("node", "a"), "a", "left_anti").join(full.withColumnRenamed("node", "b"), "b", "left_anti")
            .select(*part.columns).checkpoint()
        )
        if open_.isEmpty():
            return accepted
        ends = open_.select("a", "b", "o", F.explode(F.array("a", "b")).alias("node"))
        near = (
            top_per(ends, ["node"], [F.col("o")], per_node).withColumn("_r", F.row_number().over(Window.partitionBy("node").orderBy("o")))
            .join(taken(accepted), "node", "left")
            .filter(F.col("_r") + F.coalesce("_used", F.lit(0)) <= per_node)
        )
        now = near.groupBy("a", "b").agg(F.count("*").alias("_ends")).filter("_ends = 2").select("a", "b")
        chosen = open_.join(now, ["a", "b"], "left_semi").select(*part.columns)
        accepted = accepted.select(*part.columns).unionByName(chosen).checkpoint()
        open_ = open_.join(accepted.select("a", "b"), ["a", "b"], "left_anti").select(*part.columns)


def infer_edges(
    pairs: DataFrame, nodes: DataFrame, edges: DataFrame, min_count: int = 3, per_node: int = 20, total: int = 2000
) -> DataFrame:
    """New edges from co-occurrence counts (a, b, n), capped per node and per run."""
    kinds = nodes.select("id", "type")
    typed = (
        pairs.filter(F.col("n") >= min_count)
        .join(kinds.select(F.col("id").alias("a"), F.col("type").alias("type_a")), "a")
        .join(kinds.select(F.col("id").alias("b"), F.col("type").alias("type_b")), "b")
    )
    for x, y in lx.INFER_SKIP_PAIRS:
        typed = typed.filter(~((F.col("type_a") == x) & (F.col("type_b") == y)))
    known = edges.select(
        F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")
    )
    fresh = typed.join(known, ["a", "b"], "left_anti")
    chosen = greedy_cap(fresh, per_node, total)
    relationship, category = relationship_for(F.col("type_a"), F.col("type_b"))
    return chosen.select(
        F.col("a").alias("source_id"), F.col("b").alias("target_id"), relationship.alias("relationship"),
        category.alias("category"), F.least(F.lit(1.0), F.lit(0.3) + F.col("n") * 0.05).alias("strength"),
        F.lit(0.5).alias("confidence"), F.lit("inferred").alias("confidence_basis"),
        F.concat(F.lit("Co-occurred in "), F.col("n").cast("string"), F.lit(" sections")).alias("context"),
    )
