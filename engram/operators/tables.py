"""Snapshot upserts, lookups and statistics of the memory tables.

Every change is ``new version = old version joined with the folded changes``.
Growing lists (sources of a node, links between episodes) are kept as link
tables, one row per link, so a hot node never becomes one giant array.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions.scores import timestamp
from engram.functions.text import no_strings
from engram.operators.matching import contained_terms



def _latest(col: str, order: str, keep: Column | None = None) -> Column:
    """Value of the last row, among rows where ``keep`` holds (partial max per key)."""
    ordered = F.col(order)
    return F.max_by(col, ordered if keep is None else F.when(keep, ordered))


# --- upserts --------------------------------------------------------------------
def upsert_nodes(old: DataFrame, new: DataFrame, as_of, order: str = "batch_order") -> DataFrame:
    """Upsert on (type, name). ``new`` may hold many rows per key, applied by ``order``.

    Aliases are replaced by the last non-empty list, attributes merged (last
    value per key wins), context and significance keep the last known value,
    confidence, basis and weight are always the last ones, missing ones meaning
    .5, assumed and 0.
    """
    key = ["type", "name"]
    filled = new.withColumns(
        {
            "confidence": F.coalesce("confidence", F.lit(0.5)),
            "confidence_basis": F.coalesce("confidence_basis", F.lit("assumed")),
            "emotional_weight": F.coalesce("emotional_weight", F.lit(0.0)),
        }
    )
    folded = filled.groupBy(*key).agg(
        _latest("aliases", order, F.size("aliases") > 0).alias("n_aliases"),
        _latest("context", order, F.length("context") > 0).alias("n_context"),
        _latest("significance", order, F.length("significance") > 0).alias("n_significance"),
        _latest("confidence", order).alias("n_confidence"),
        _latest("confidence_basis", order).alias("n_confidence_basis"),
        _latest("emotional_weight", order).alias("n_emotional_weight"),
    )
    pairs = (
        filled.select(*key, F.col(order), F.explode("attributes").alias("k", "v"))
        .groupBy(*key, "k")
        .agg(F.max_by("v", order).alias("v"))
    )
    attributes = pairs.groupBy(*key).agg(
        F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("n_attributes")
    )
    changes = folded.join(attributes, key, "left").withColumn("_new", F.lit(True))
    touched = F.coalesce(F.col("_new"), F.lit(False))
    empty = F.create_map().cast("map<string,string>")
    added = F.coalesce("n_attributes", empty)
    had = F.map_filter(
        F.coalesce("attributes", empty), lambda k, v: ~F.map_contains_key(added, k)
    )
    new_id = F.concat(F.lit("node:"), F.substring(F.sha2(F.concat_ws("\u0001", "type", "name"), 256), 1, 32))
    now = timestamp(as_of)
    return (
        old.join(changes, key, "full_outer")
        .withColumns(
            {
                "id": F.coalesce("id", new_id),
                "aliases": F.coalesce("n_aliases", "aliases", no_strings()),
                "attributes": F.map_concat(had, added),
                "context": F.coalesce("n_context", "context"),
                "significance": F.coalesce("n_significance", "significance"),
                "confidence": F.coalesce("n_confidence", "confidence"),
                "confidence_basis": F.coalesce("n_confidence_basis", "confidence_basis"),
                "emotional_weight": F.coalesce("n_emotional_weight", "emotional_weight"),
                "last_modified": F.when(touched, now).otherwise(F.col("last_modified")),
                "last_verified": F.coalesce("last_verified", now),
            }
        )
        .select(*old.columns)
    )


def upsert_identity(old: DataFrame, new: DataFrame, as_of, order: str = "batch_order") -> DataFrame:
    """Upsert on key: last value, greatest weight, one affirmation per further row."""
    folded = new.groupBy("key").agg(
        F.max_by("value", order).alias("n_value"),
        F.min_by("category", order).alias("n_category"),
        F.max(F.coalesce("emotional_weight", F.lit(0.5))).alias("n_weight"),
        F.count("*").alias("n"),
    )
    existed = F.col("id").isNotNull()
    return (
        old.join(folded, "key", "full_outer")
        .withColumns(
            {
                "times_affirmed": F.when(existed, F.col("times_affirmed") + F.coalesce("n", F.lit(0)))
                .otherwise(F.col("n") - 1)
                .cast("int"),
                "value": F.coalesce("n_value", "value"),
                "category": F.coalesce("category", "n_category"),
                "emotional_weight": F.greatest("emotional_weight", "n_weight"),
                "last_affirmed": F.when(F.col("n").isNotNull(), timestamp(as_of)).otherwise(
                    F.col("last_affirmed")
                ),
                "id": F.coalesce("id", F.concat(F.lit("identity:"), F.col("key"))),
            }
        )
        .select(*old.columns)
    )


def upsert_persons(old: DataFrame, new: DataFrame, as_of, order: str = "batch_order") -> DataFrame:
    """Upsert on name: every given field replaced, one interaction per row."""
    fields = [c for c in new.columns if c in old.columns and c not in ("name", "total_interactions", "last_interaction", "id")]
    plain = [c for c in fields if c != "semantic_node_id"]
    aggs = [F.max_by(c, order).alias(f"n_{c}") for c in plain]
    if "semantic_node_id" in fields:
        aggs.append(_latest("semantic_node_id", order, F.col("semantic_node_id").isNotNull()).alias("n_semantic_node_id"))
    folded = new.groupBy("name").agg(*aggs, F.count("*").alias("n"))
    touched = F.col("n").isNotNull()
    existed = F.col("total_interactions").isNotNull()
    out = old.join(folded, "name", "full_outer").withColumns(
        {c: F.when(touched, F.col(f"n_{c}")).otherwise(F.col(c)) for c in plain}
    )
    if "semantic_node_id" in fields:
        out = out.withColumn("semantic_node_id", F.coalesce("n_semantic_node_id", "semantic_node_id"))
    return (
        out.withColumn(
            "total_interactions",
            F.when(existed, F.col("total_interactions") + F.coalesce("n", F.lit(0))).otherwise(F.col("n")),
        )
        .withColumn(
            "last_interaction", F.when(touched, timestamp(as_of)).otherwise(F.col("last_interaction"))
        )
        .select(*old.columns)
    )


def upsert_procedures(old: DataFrame, new: DataFrame, order: str = "batch_order") -> DataFrame:
    """Upsert on name: type, triggers and steps replaced, confidence never lowered."""
    folded = new.groupBy("name").agg(
        F.max_by("type", order).alias("n_type"),
        F.max_by("trigger_phrases", order).alias("n_triggers"),
        F.max_by("steps", order).alias("n_steps"),
        F.max(F.coalesce("confidence", F.lit(0.5))).alias("n_confidence"),
    )
    out = old.join(folded, "name", "full_outer").withColumns(
        {
            "type": F.coalesce("n_type", "type"),
            "trigger_phrases": F.coalesce("n_triggers", "trigger_phrases"),
            "steps": F.coalesce("n_steps", "steps"),
            "confidence": F.greatest("confidence", "n_confidence"),
            "id": F.coalesce("id", F.concat(F.lit("p:"), F.col("name"))),
            "execution_count": F.coalesce("execution_count", F.lit(0)),
            "success_count": F.coalesce("success_count", F.lit(0)),
            "success_rate": F.coalesce("success_rate", F.lit(0.0)),
        }
    )
    return out.select(*old.columns)


def create_episodes(new: DataFrame) -> DataFrame:
    """Fill the neutral defaults of a new episode row."""
    neutral = F.struct(F.lit(0.0).alias("valence"), F.lit(0.3).alias("arousal"), F.lit("neutral").alias("label"))
    defaults = {
        "participants": no_strings(),
        "topics": no_strings(),
        "arc": F.struct(neutral.alias("start"), F.lit("stable").alias("trajectory"), neutral.alias("end")),
        "peak": neutral,
        "resolution": neutral,
        "outcome": F.struct(
            F.lit("informational").alias("type"), F.lit("").alias("description"), F.lit(False).alias("verified")
        ),
        "importance_score": F.lit(0.5),
        "decay_protected": F.lit(False),
        "access_count": F.lit(0),
    }
    return new.withColumns(
        {c: F.coalesce(F.col(c), d) if c in new.columns else d for c, d in defaults.items()}
    )


PATCHABLE = [
    "summary", "narrative", "initiator", "importance_score", "decay_protected", "session_id",
    "participants", "topics", "arc", "peak", "resolution", "outcome", "lessons", "decisions", "commitments",
]


def update_episodes(old: DataFrame, patch: DataFrame) -> DataFrame:
    """Overlay the non-null white-listed columns of ``patch`` by id."""
    fields = [c for c in patch.columns if c in PATCHABLE and c in old.columns]
    renamed = patch.select("id", *[F.col(c).alias(f"p_{c}") for c in fields])
    return (
        old.join(renamed, "id", "left")
        .withColumns({c: F.coalesce(f"p_{c}", c) for c in fields})
        .select(*old.columns)
    )


def create_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    filled = new.withColumns(
        {
            "strength": F.coalesce("strength", F.lit(0.5)),
            "confidence": F.coalesce("confidence", F.lit(0.5)),
        }
    )
    return old.unionByName(filled, allowMissingColumns=True)


# --- lookups ------------------------------------------------------------------------
def lookup(df: DataFrame, wanted: DataFrame, on: list[str], ignore_case: bool = False) -> DataFrame:
    """Batch keyed lookup; unmatched keys stay with nulls."""
    if not ignore_case:
        return wanted.join(df, on, "left")
    cond = reduce(lambda a, b: a & b, [F.lower(F.col(f"w.{c}")) == F.lower(F.col(f"d.{c}")) for c in on])
    rest = [F.col(f"d.{c}") for c in df.columns if c not in on]
    return wanted.alias("w").join(df.alias("d"), cond, "left").select("w.*", *rest)


def ranked(df: DataFrame, where: Column | None, order: list[Column]) -> DataFrame:
    return (df if where is None else df.filter(where)).orderBy(*order)


def node_edges(edges: DataFrame, nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges touching the given ids, either end, with both endpoints described."""
    wanted = ids.select(F.col("id").alias("node_id")).distinct()
    out = edges.join(wanted, F.col("source_id") == F.col("node_id"))
    inc = edges.join(wanted, F.col("target_id") == F.col("node_id")).filter("source_id <> target_id")
    ends = nodes.select("id", "name", "type")
    s = ends.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("type").alias("source_type"))
    t = ends.select(F.col("id").alias("target_id"), F.col("name").alias("target_name"), F.col("type").alias("target_type"))
    return out.unionByName(inc).join(s, "source_id").join(t, "target_id")


def query_episodes(
    episodes: DataFrame,
    start=None,
    end=None,
    participants: list[str] | None = None,
    topics: list[str] | None = None,
    min_importance: float | None = None,
    trajectory: str | None = None,
    limit: int = 20,
    offset: int = 0,
) -> DataFrame:
    df = episodes
    if start is not None:
        df = df.filter((F.col("created_at") >= timestamp(start)) & (F.col("created_at") <= timestamp(end)))
    if participants:
        df = df.filter(F.arrays_overlap("participants", F.array(*[F.lit(p) for p in participants])))
    if topics:
        df = df.filter(F.arrays_overlap("topics", F.array(*[F.lit(t) for t in topics])))
    if min_importance is not None:
        df = df.filter(F.col("importance_score") >= min_importance)
    if trajectory is not None:
        df = df.filter(F.col("arc.trajectory") == trajectory)
    return df.orderBy(
        F.col("importance_score").desc(), F.col("created_at").desc(), "id"
    ).offset(offset).limit(limit)


def bump_access(episodes: DataFrame, returned: DataFrame, as_of) -> DataFrame:
    """One access per returned row; ``returned`` has an ``id`` column."""
    counts = returned.groupBy("id").agg(F.count("*").alias("_hits"))
    out = episodes.join(counts, "id", "left").withColumn(
        "access_count", (F.col("access_count") + F.coalesce("_hits", F.lit(0))).cast("int")
    )
    old = F.col("last_accessed") if "last_accessed" in episodes.columns else F.lit(None).cast("timestamp")
    return out.withColumn(
        "last_accessed", F.when(F.col("_hits").isNotNull(), timestamp(as_of)).otherwise(old)
    ).drop("_hits")


def recent(episodes: DataFrame, n: int = 10) -> DataFrame:
    return episodes.orderBy(F.col("created_at").desc(), "id").limit(n)


def by_entity(episodes: DataFrame, links: DataFrame, entity_id: str, n: int = 10) -> DataFrame:
    """``links`` holds (episode_id, entity_id)."""
    wanted = links.filter(F.col("entity_id") == entity_id).select(F.col("episode_id").alias("id")).distinct()
    return recent(episodes.join(wanted, "id", "left_semi"), n)


def high_importance(episodes: DataFrame, threshold: float = 0.8, n: int = 20) -> DataFrame:
    return (
        episodes.filter((F.col("importance_score") >= threshold) | F.col("decay_protected"))
        .orderBy(F.col("importance_score").desc(), F.col("created_at").desc(), "id")
        .limit(n)
    )


def append_links(links: DataFrame, new: DataFrame) -> DataFrame:
    return links.unionByName(new)


# --- statistics ------------------------------------------------------------------------
def episode_stats(episodes: DataFrame) -> DataFrame:
    def non_empty(c):
        if c not in episodes.columns:
            return F.lit(0).cast("bigint")
        return F.count_if(F.coalesce(F.size(c), F.lit(0)) > 0)

    return episodes.agg(
        F.count("*").alias("total"),
        non_empty("participants").alias("with_participants"),
        non_empty("decisions").alias("with_decisions"),
        non_empty("lessons").alias("with_lessons"),
        non_empty("commitments").alias("with_commitments"),
        F.avg("importance_score").alias("avg_importance"),
        F.count_if("decay_protected").alias("protected"),
    )


def trajectory_histogram(episodes: DataFrame) -> DataFrame:
    return episodes.groupBy(F.coalesce(F.col("arc.trajectory"), F.lit("unknown")).alias("trajectory")).agg(
        F.count("*").alias("n")
    )


def identity_stats(identity: DataFrame) -> DataFrame:
    top = F.struct("times_affirmed", "key")
    return identity.agg(
        F.count("*").alias("total"),
        F.avg("emotional_weight").alias("avg_weight"),
        F.max_by("key", top).alias("most_affirmed"),
        F.max("times_affirmed").cast("bigint").alias("times"),
    )


def procedure_stats(procedures: DataFrame) -> DataFrame:
    return procedures.agg(
        F.count("*").alias("total"),
        F.avg("confidence").alias("avg_confidence"),
        F.avg("success_rate").alias("avg_success_rate"),
        F.sum("execution_count").alias("executions"),
    )


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def memory_stats(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def record_executions(procedures: DataFrame, events: DataFrame, chunk_seconds: int = 86_400) -> DataFrame:
    """Apply (name, ts, seq, success, outcome) in order.

    Confidence gains .02 or loses .05 per run and is cut at 1 after each. The
    cut fold equals min(start + total, 1 + total - greatest prefix sum), so it
    is computed from per-chunk sums and prefix maxima; no procedure's history
    is gathered in one task. Sums are whole hundredths, hence exact.
    """
    step = F.when(F.col("success"), 2).otherwise(-5)
    rows = events.withColumn("_d", step).withColumn(
        "_c", F.floor(F.unix_micros("ts") / F.lit(chunk_seconds * 1_000_000))
    )
    inside = Window.partitionBy("name", "_c").orderBy("ts", "seq")
    prefixed = rows.withColumn("_p", F.sum("_d").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.struct("ts", "seq")
    chunks = prefixed.groupBy("name", "_c").agg(
        F.sum("_d").alias("_sum"), F.max("_p").alias("_peak"), F.count("*").alias("_n"),
        F.count_if("success").alias("_ok"), F.max("ts").alias("_ts"), F.max_by("outcome", last).alias("_outcome"),
    )
    earlier = Window.partitionBy("name").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        chunks.withColumn("_base", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
        .groupBy("name")
        .agg(
            F.sum("_sum").alias("_total"), F.max(F.col("_base") + F.col("_peak")).alias("_max"),
            F.sum("_n").alias("_n"), F.sum("_ok").alias("_ok"), F.max("_ts").alias("_ts"),
            F.max_by("_outcome", "_c").alias("_outcome"),
        )
    )
    n = F.coalesce("_n", F.lit(0))
    ran = F.col("_n").isNotNull()
    confidence = F.least(
        F.col("confidence") + F.col("_total") / 100.0, F.lit(1.0) + (F.col("_total") - F.col("_max")) / 100.0
    )
    out = procedures.join(totals, "name", "left").withColumns(
        {
            "execution_count": F.col("execution_count") + n,
            "success_count": F.col("success_count") + F.coalesce("_ok", F.lit(0)),
            "confidence": F.when(ran, confidence).otherwise(F.col("confidence")),
            "last_executed": F.coalesce("_ts", "last_executed"),
        }
    )
    if "last_outcome" in procedures.columns:
        out = out.withColumn("last_outcome", F.when(ran, F.col("_outcome")).otherwise(F.col("last_outcome")))
    return out.withColumn(
        "success_rate",
        F.when(ran, F.col("success_count") / F.col("execution_count")).otherwise(F.col("success_rate")),
    ).select(*procedures.columns)


# --- writes derived from mentions -----------------------------------------------------------
def verify_mentioned(nodes: DataFrame, mentions: DataFrame, as_of) -> DataFrame:
    counts = (
        mentions.filter(F.col("node_id").isNotNull())
        .groupBy(F.col("node_id").alias("id"))
        .agg(F.count("*").alias("_m"))
    )
    return (
        nodes.join(counts, "id", "left")
        .withColumn(
            "last_verified", F.when(F.col("_m").isNotNull(), timestamp(as_of)).otherwise(F.col("last_verified"))
        )
        .withColumn("mentions", F.coalesce("_m", F.lit(0)))
        .drop("_m")
    )


def link_sources(nodes: DataFrame, mentions: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """(nodes with a higher source count and a new touch time, new link rows)."""
    links = mentions.filter(F.col("node_id").isNotNull()).select("node_id", "episode_id")
    counts = links.groupBy(F.col("node_id").alias("id")).agg(F.count("*").alias("_m"))
    updated = (
        nodes.join(counts, "id", "left")
        .withColumn("source_count", F.coalesce("source_count", F.lit(0)) + F.coalesce("_m", F.lit(0)))
        .withColumn(
            "last_modified", F.when(F.col("_m").isNotNull(), timestamp(as_of)).otherwise(F.col("last_modified"))
        )
        .drop("_m")
    )
    return updated, links


def boost_edges(edges: DataFrame, mentions: DataFrame, step: float = 0.05) -> DataFrame:
    """+.05 per mention of either endpoint (a self-loop counts once), at most 1."""
    counts = mentions.filter(F.col("node_id").isNotNull()).groupBy("node_id").agg(F.count("*").alias("n"))
    s = counts.select(F.col("node_id").alias("source_id"), F.col("n").alias("_s"))
    t = counts.select(F.col("node_id").alias("target_id"), F.col("n").alias("_t"))
    zero = F.lit(0)
    total = F.coalesce("_s", zero) + F.when(F.col("source_id") == F.col("target_id"), zero).otherwise(
        F.coalesce("_t", zero)
    )
    return (
        edges.join(s, "source_id", "left")
        .join(t, "target_id", "left")
        .withColumn("strength", F.least(F.lit(1.0), F.col("strength") + total * step))
        .select(*edges.columns)
    )


def bump_interactions(persons: DataFrame, mentions: DataFrame, as_of) -> DataFrame:
    """``mentions`` has one row per interaction with an ``entity`` name."""
    counts = mentions.groupBy(F.lower("entity").alias("_name")).agg(F.count("*").alias("_m"))
    return (
        persons.join(counts, F.lower("name") == F.col("_name"), "left")
        .withColumn("total_interactions", F.col("total_interactions") + F.coalesce("_m", F.lit(0)))
        .withColumn(
            "last_interaction", F.when(F.col("_m").isNotNull(), timestamp(as_of)).otherwise(F.col("last_interaction"))
        )
        .select(*persons.columns)
    )


def identity_phrases(identity: DataFrame) -> DataFrame:
    """(key, term): the key with dashes as blanks, and the first 30 characters of the value."""
    return identity.select(
        "key",
        F.explode(
            F.array_distinct(
                F.array(
                    F.lower(F.replace("key", F.lit("-"), F.lit(" "))), F.lower(F.substring("value", 1, 30))
                )
            )
        ).alias("term"),
    ).filter(F.length("term") > 0)


def affirm_from_text(identity: DataFrame, texts: DataFrame, key: list[str], as_of) -> DataFrame:
    """One affirmation per text that names the entry."""
    hits = contained_terms(
        texts.select(*key, F.lower("text").alias("_low")), "_low", identity_phrases(identity), "term", key
    )
    counts = hits.select("key", *key).distinct().groupBy("key").agg(F.count("*").alias("_n"))
    return apply_affirmations(identity, counts, as_of)


def apply_affirmations(identity: DataFrame, counts: DataFrame, as_of) -> DataFrame:
    out = identity.join(counts, "key", "left").withColumn(
        "times_affirmed", (F.col("times_affirmed") + F.coalesce("_n", F.lit(0))).cast("bigint")
    )
    if "last_affirmed" in identity.columns:
        out = out.withColumn(
            "last_affirmed", F.when(F.col("_n").isNotNull(), timestamp(as_of)).otherwise(F.col("last_affirmed"))
        )
    return out.select(*identity.columns)
