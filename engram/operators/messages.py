"""Message understanding as column expressions, plus transcript roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions import lexicons as lx
from engram.functions.scores import clamp, exact_avg
from engram.functions.text import (
    any_of, ascii_regex, contains_any, count_char, count_contained, first_match, js_trim,
    labels_where, matches, matches_any, no_strings,
)
from engram.operators.matching import alias_index, contained_terms, top_per
from engram.operators.ordering import greedy_heads, running_index
from engram.session import stored

SEQ_CHUNK = 4096


# --- column operators ---------------------------------------------------------
def classify_input(df: DataFrame) -> DataFrame:
    sender, text = F.col("sender"), F.col("text")
    return df.withColumn(
        "input_type",
        first_match(
            [
                (sender.isin("system", "heartbeat"), "system_event"),
                ((sender == "tool") | text.startswith("{") | text.startswith("```"), "tool_output"),
                (sender.isin("agent", "self"), "reflection"),
            ],
            "conversation",
        ),
    )


def extract_claims(df: DataFrame) -> DataFrame:
    text = F.col("text")
    patterns = [lx.CLAIM_MONEY, lx.CLAIM_PERCENT, lx.CLAIM_DATE, ascii_regex(lx.CLAIM_COUNT)]
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in patterns]
    return df.withColumn("claims", F.concat(*found))


def sentiment(
    df: DataFrame,
    positive: list[str] = lx.MESSAGE_POSITIVE,
    negative: list[str] = lx.MESSAGE_NEGATIVE,
    excitement: list[str] = lx.MESSAGE_EXCITEMENT,
    humor: list[str] = lx.MESSAGE_HUMOR,
) -> DataFrame:
    """Lexicon counts, valence, arousal, ordered emotion list, first emotion."""
    counted = df.withColumn("_low", F.lower("text")).withColumns(
        {
            "positive": count_contained(F.col("_low"), positive),
            "negative": count_contained(F.col("_low"), negative),
            "excitement": count_contained(F.col("_low"), excitement),
            "humor": count_contained(F.col("_low"), humor),
        }
    )
    low = F.col("_low")
    p, n, e, h = (F.col(c) for c in ("positive", "negative", "excitement", "humor"))
    emotions = labels_where(
        [
            (p > 2, "joy"),
            (e > 1, "excitement"),
            (n > 2, "frustration"),
            (h > 0, "humor"),
            (contains_any(low, ["thank", "appreciate", "grateful"]), "gratitude"),
            (contains_any(low, ["worried", "concerned"]), "concern"),
            (contains_any(low, ["proud", "amazing work"]), "pride"),
            ((e > 0) & (p > 0), "determination"),
        ]
    )
    scored = counted.withColumns(
        {
            "valence": (p - n) / F.greatest(p + n, F.lit(1)),
            "arousal": F.least(F.lit(1.0), e * 0.3 + count_char(F.col("text"), "!") * 0.1),
            "emotions": F.when(F.size(emotions) == 0, F.array(F.lit("neutral"))).otherwise(emotions),
        }
    )
    return scored.withColumn("dominant", F.element_at("emotions", 1)).drop("_low")


def urgency(
    df: DataFrame, high: list[str] = lx.URGENCY_HIGH, medium: list[str] = lx.URGENCY_MEDIUM
) -> DataFrame:
    text, low = F.col("text"), F.lower("text")
    base = F.when(contains_any(low, high), 0.85).when(contains_any(low, medium), 0.5).otherwise(0.2)
    shouted = F.when(
        (F.length(text) > 10) & (text == F.upper(text)), F.least(F.lit(1.0), base + 0.2)
    ).otherwise(base)
    return df.withColumn(
        "urgency",
        F.when(count_char(text, "!") > 2, F.least(F.lit(1.0), shouted + 0.1)).otherwise(shouted),
    )


def intent(df: DataFrame, families: list = lx.INTENT_FAMILIES) -> DataFrame:
    rules = [(matches_any(F.col("text"), p, ignore_case=True), name) for name, p in families]
    return df.withColumn("intent", first_match(rules, "inform"))


def routes(df: DataFrame) -> DataFrame:
    """Needs ``intent``, ``emotions`` and ``entities``; order is part of the result."""
    kind = F.col("intent")
    to_self = F.arrays_overlap("emotions", F.array(F.lit("gratitude"), F.lit("pride")))
    return df.withColumn(
        "routes",
        F.array_distinct(
            labels_where(
                [
                    (F.size("entities") > 0, "episodic"),
                    (kind.isin("inform", "decision", "directive"), "semantic"),
                    (kind == "feedback", "identity"),
                    (kind == "emotional", "relational"),
                    (kind.isin("request", "decision", "feedback", "emotional"), "episodic"),
                    ((kind == "emotional") & to_self, "identity"),
                    (kind == "directive", "procedural"),
                ]
            )
        ),
    )


def quality_gate(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "skipped", (F.length("text") < 20) & (F.coalesce(F.size("entities"), F.lit(0)) == 0)
    )


# --- entity dictionary ----------------------------------------------------------
def core_dictionary(nodes: DataFrame, core: list = lx.CORE_ENTITIES) -> DataFrame:
    """Core entries first; a node sharing any spelling with the core is left out."""
    spellings = [n for names, _ in core for n in names]
    names = F.transform(
        F.concat(F.array("name"), F.coalesce("aliases", no_strings())), lambda n: F.lower(n)
    )
    known = nodes.filter(
        ~F.arrays_overlap(names, F.array(*[F.lit(s) for s in spellings]))
    ).select(F.col("id"), F.col("type"), F.element_at(names, 1).alias("name"), names.alias("names"))
    fixed = nodes.sparkSession.createDataFrame(
        [(None, kind, list_[0], list_) for list_, kind in core],
        "id string, type string, name string, names array<string>",
    )
    return fixed.unionByName(known)


def entity_mentions(
    messages: DataFrame, nodes: DataFrame, key: list[str], core: list = lx.CORE_ENTITIES
) -> DataFrame:
    """One row per (message, canonical name): type, node id, confidence, context."""
    terms = core_dictionary(nodes, core).select(
        F.col("id").alias("node_id"), F.col("type").alias("entity_type"),
        F.col("name").alias("entity"), F.posexplode("names").alias("pos", "term"),
    ).filter(F.length("term") >= 3)
    # of the nodes that share a name and a spelling only the first can be chosen; the others need not meet the texts
    first = F.min(F.struct("pos", "node_id", "entity_type")).alias("_first")
    terms = terms.groupBy("entity", "term").agg(first).select("entity", "term", "_first.*")
    texts = messages.select(*key, "text", F.lower("text").alias("_low"))
    hits = contained_terms(texts, "_low", terms, "term", key)
    at = F.instr(F.col("_low"), F.col("term")) - 1
    start = F.greatest(F.lit(0), at - 50)
    end = F.least(F.length("text"), at + F.length("term") + 50)
    return (
        hits.withColumn("context", js_trim(F.substring(F.col("text"), start + 1, end - start)))
        .groupBy(*key, "entity")
        .agg(
            F.min_by(
                F.struct("entity_type", "node_id", "context"), F.struct("pos", "node_id", "entity_type")
            ).alias("m")
        )
        .select(*key, "entity", "m.*", F.lit(0.9).alias("confidence"), F.lit(True).alias("is_known"))
    )


def with_entities(messages: DataFrame, mentions: DataFrame, key: list[str]) -> DataFrame:
    """Attach the names as a sorted array; a message holds few of them."""
    grouped = mentions.groupBy(*key).agg(F.sort_array(F.collect_set("entity")).alias("entities"))
    return messages.join(grouped, key, "left").withColumn(
        "entities", F.coalesce("entities", no_strings())
    )


def ranked_mentions(messages: DataFrame, nodes: DataFrame, key: list[str]) -> DataFrame:
    """Light profile: name before aliases, one row per name, best confidence first."""
    terms = alias_index(nodes, 3).filter(F.length("name") >= 3).select(
        F.col("id").alias("node_id"), F.col("type").alias("entity_type"),
        F.col("name").alias("entity"), F.col("confidence").alias("node_confidence"),
        "pos", "spelling", "term",
    )
    # of the nodes that share a name and a spelling only the first can be chosen; the others need not meet the texts
    first = F.min(F.struct((-F.col("node_confidence")).alias("c"), "node_id", "pos", "spelling", "entity_type", "node_confidence")).alias("_first")
    terms = terms.groupBy("entity", "term").agg(first).select("entity", "term", "_first.*").drop("c")
    texts = messages.select(*key, F.lower("text").alias("_low"))
    hits = contained_terms(texts, "_low", terms, "term", key).withColumn(
        "matched_on",
        F.when(F.col("pos") == 0, "name").otherwise(F.concat(F.lit("alias:"), F.col("spelling"))),
    )
    order = F.struct((-F.col("node_confidence")).alias("c"), "node_id", "pos")
    return (
        hits.groupBy(*key, "entity")
        .agg(
            F.min_by(F.struct("entity_type", "node_id", "matched_on", "node_confidence"), order).alias("m")
        )
        .select(*key, "entity", "m.*")
    )


def expand_entities(
    extraction: DataFrame, nodes: DataFrame, edges: DataFrame, key: str = "message_id"
) -> DataFrame:
    """Explicit names, their neighbours of the implied type, then implied names."""
    names = (
        nodes.withColumn("_c", -F.col("confidence"))
        .groupBy(F.lower("name").alias("term"))
        .agg(F.min(F.struct("_c", "id")).alias("_n"))
        .select("term", F.col("_n.id").alias("id"))
    )
    index = (
        alias_index(nodes)
        .groupBy("term")
        .agg(F.min(F.struct((-F.col("confidence")).alias("c"), F.col("id").alias("id"))).alias("_n"))
        .select("term", F.col("_n.id").alias("id"))
    )
    described = nodes.select("id", "name", "type")
    wanted = extraction.select(key, F.explode("explicit").alias("n"), "implied_type")
    explicit = (
        wanted.join(index, F.lower("n") == F.col("term"))
        .join(described, "id")
        .select(key, "name", "type", F.col("id").alias("node_id"), "implied_type")
        .distinct()
    )
    both = edges.select("source_id", "target_id").unionByName(
        edges.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))
    )
    near = (
        explicit.filter(F.col("implied_type").isNotNull())
        .join(both, F.col("node_id") == F.col("source_id"))
        .select(key, "implied_type", F.col("target_id").alias("id"))
        .join(described, "id")
        .filter(F.col("type") == F.col("implied_type"))
    )
    implied = (
        extraction.select(key, F.explode("implied").alias("n"))
        .join(names, F.lower("n") == F.col("term"))
        .join(described, "id")
    )
    rows = (
        explicit.select(key, "name", "type", "node_id", F.lit(0).alias("o"), F.lit("name").alias("m"))
        .unionByName(
            near.select(
                key, "name", "type", F.col("id").alias("node_id"), F.lit(1).alias("o"),
                F.lit("llm-inferred").alias("m"),
            )
        )
        .unionByName(
            implied.select(
                key, "name", "type", F.col("id").alias("node_id"), F.lit(2).alias("o"),
                F.lit("llm-inferred").alias("m"),
            )
        )
    )
    return (
        rows.groupBy(key, "name")
        .agg(F.min_by(F.struct("type", "node_id", "m"), F.struct("o", "node_id")).alias("r"))
        .select(key, "name", "r.type", "r.node_id", F.col("r.m").alias("matched_on"))
    )


# --- light profile -------------------------------------------------------------
def classify_message(df: DataFrame) -> DataFrame:
    low = F.lower("text")
    rules = [(low.contains("?") | matches(low, lx.LIGHT_QUESTION), ("question", 0.9))]
    rules += [(matches(low, p), (name, conf)) for name, conf, p in lx.LIGHT_CLASSES]
    return df.withColumns(
        {
            "message_class": first_match([(c, v[0]) for c, v in rules], "statement"),
            "class_confidence": first_match([(c, v[1]) for c, v in rules], 0.7),
        }
    )


def sentiment_simple(df: DataFrame) -> DataFrame:
    text, low = F.col("text"), F.lower("text")
    score = (
        count_contained(low, lx.LIGHT_POSITIVE) - count_contained(low, lx.LIGHT_NEGATIVE)
    ) * 0.15
    marks = F.regexp_count(text, F.lit("[!?🔥💪❤]"))
    raw = df.withColumn("_v", clamp(score, -1.0, 1.0))
    return raw.withColumns(
        {
            "valence": F.round("_v", 2),
            "arousal": F.round(
                F.least(F.lit(1.0), marks * 0.15 + F.when(F.length(text) > 200, 0.3).otherwise(0.1)), 2
            ),
            "sentiment_label": F.when(F.col("_v") > 0.2, "positive")
            .when(F.col("_v") < -0.2, "negative")
            .otherwise("neutral"),
        }
    ).drop("_v")


def urgency_simple(df: DataFrame) -> DataFrame:
    """Needs ``message_class``."""
    low = F.lower("text")
    score = (
        F.lit(0.3)
        + count_contained(low, lx.LIGHT_URGENT) * 0.2
        + F.when(F.col("message_class") == "directive", 0.1).otherwise(0.0)
        + F.when(F.col("text").contains("!"), 0.1).otherwise(0.0)
    )
    return df.withColumn("_s", F.round(score, 9)).withColumns(
        {
            "urgency_score": F.round(F.least(F.lit(1.0), F.col("_s")), 2),
            "urgency_level": F.when(F.col("_s") > 0.7, "high").when(F.col("_s") > 0.4, "medium").otherwise("low"),
        }
    ).drop("_s")


def detect_intent(df: DataFrame) -> DataFrame:
    """Needs ``message_class``."""
    low = F.lower("text")
    rules = [(matches(low, p), (name, conf)) for name, conf, p in lx.LIGHT_INTENTS]
    rules += [
        (F.col("message_class") == "question", ("query", 0.75)),
        (F.col("message_class") == "reflection", ("reflect", 0.7)),
    ]
    return df.withColumns(
        {
            "intent": first_match([(c, v[0]) for c, v in rules], "communicate"),
            "intent_confidence": first_match([(c, v[1]) for c, v in rules], 0.6),
        }
    )


def routes_simple(df: DataFrame) -> DataFrame:
    """Needs ``intent`` and ``entity_types``."""
    kind, types = F.col("intent"), F.col("entity_types")
    has = lambda t: F.array_contains(types, t)
    return df.withColumn(
        "routes",
        F.array_distinct(
            labels_where(
                [
                    (F.lit(True), "semantic"),
                    (kind.isin("relational_query", "preference_query") | has("person"), "relational"),
                    (kind.isin("memory_write", "reflect", "record_decision"), "episodic"),
                    (kind.isin("create", "fix", "deploy"), "procedural"),
                    (kind.isin("reflect", "preference_query"), "identity"),
                    (has("project") | has("organization"), "episodic"),
                ]
            )
        ),
    )


def message_importance(df: DataFrame) -> DataFrame:
    """Needs ``intent``, ``valence`` and ``entities``."""
    score = F.least(
        F.lit(1.0),
        F.lit(0.3)
        + F.when(F.col("intent") == "record_decision", 0.4).otherwise(0.0)
        + F.when(F.col("intent") == "memory_write", 0.3).otherwise(0.0)
        + F.when(F.abs("valence") > 0.3, 0.2).otherwise(0.0)
        + F.when(F.size("entities") > 2, 0.1).otherwise(0.0),
    )
    return df.withColumn("importance_score", score).withColumn(
        "decay_protected", F.col("importance_score") > 0.7
    )


def understand(messages: DataFrame) -> DataFrame:
    """All entity-free columns of the full profile, one projection."""
    return intent(urgency(sentiment(extract_claims(classify_input(messages)))))


def understand_light(messages: DataFrame) -> DataFrame:
    return detect_intent(urgency_simple(sentiment_simple(classify_message(messages))))


# --- guard -----------------------------------------------------------------------
def guard_text(df: DataFrame) -> DataFrame:
    """Stateless verdict: system_message, too_short, contains_credentials or allowed."""
    text = F.col("text")
    clean = F.substring(text, 1, lx.GUARD_MAX_LENGTH)
    for pattern in lx.GUARD_REDACT:
        clean = F.regexp_replace(clean, pattern, "[REDACTED_PATH]")
    verdict = first_match(
        [
            (any_of([text.rlike(p) for p in lx.GUARD_SKIP]), "system_message"),
            (F.length(text) < lx.GUARD_MIN_LENGTH, "too_short"),
            (any_of([text.rlike(p) for p in lx.GUARD_CREDENTIALS]), "contains_credentials"),
        ],
        "allowed",
    )
    return df.withColumn("verdict", verdict).withColumn(
        "clean_text", F.when(F.col("verdict") == "allowed", clean)
    )


def min_interval_gate(
    df: DataFrame, keys: list[str], seconds: float, order: list[str], eligible: Column | None = None
) -> DataFrame:
    """``accepted``: first of its time and at least ``seconds`` after the last accepted.

    Rows that are not ``eligible`` never move the gate; ``since_accepted`` tells
    every row how many microseconds ago the gate last moved. A null key is a key like others. A row without a time
    is never accepted and has no ``since_accepted``. Every row comes out as often as it went in.
    """
    interval = int(seconds * 1_000_000)
    chunk = max(interval, 60_000_000) * 64
    ok = F.col("ts").isNotNull() if eligible is None else F.coalesce(eligible, F.lit(False)) & F.col("ts").isNotNull()
    # only what the gate looks at goes through its joins; the rows themselves are joined once at the end. Structs
    # with null fields are equal to each other, nulls are not
    narrow = list(dict.fromkeys([*keys, *order, "ts"]))
    whole = df.withColumn("_ok", ok).withColumn("_row", F.struct(*narrow, "_ok"))
    rows = whole.filter("ts is not null").select(
        F.struct(*keys).alias("_key"), "_row", "_ok", F.struct(*order).alias("_order"), F.unix_micros("ts").alias("_t")
    ).distinct()
    heads = greedy_heads(rows.filter("_ok"), ["_key"], "_t", interval, chunk)
    winner = rows.filter("_ok").groupBy("_key", "_t").agg(F.min("_order").alias("_w"))
    accepted = heads.join(winner.withColumnRenamed("_t", "t"), ["_key", "t"])
    last = _last_at_or_before(rows, heads, ["_key"], chunk)
    verdicts = last.join(accepted.withColumnRenamed("t", "_t"), ["_key", "_t"], "left").select(
        "_row", F.coalesce(F.col("_ok") & (F.col("_order") == F.col("_w")), F.lit(False)).alias("_accepted"),
        (F.col("_t") - F.col("_head")).alias("since_accepted"),
    )
    return whole.join(verdicts, "_row", "left").select(
        *df.columns, F.coalesce("_accepted", F.lit(False)).alias("accepted"), "since_accepted"
    )


def _last_at_or_before(rows: DataFrame, heads: DataFrame, keys: list[str], chunk: int) -> DataFrame:
    """Add ``_head``: the latest head not after the row, chunk by chunk with a carry."""
    from pyspark.sql import Window

    c = lambda col: F.floor(F.col(col) / F.lit(chunk))
    marks = heads.select(*keys, F.col("t").alias("_t"), F.col("t").alias("_h")).withColumn("_c", c("_t"))
    carry = (
        rows.select(*keys, c("_t").alias("_c"))
        .distinct()
        .join(marks.groupBy(*keys, "_c").agg(F.max("_h").alias("_max")), [*keys, "_c"], "left")
        .withColumn(
            "_carry",
            F.max("_max").over(
                Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
            ),
        )
        .drop("_max")
    )
    at = rows.withColumn("_c", c("_t")).join(marks.drop("_c"), [*keys, "_t"], "left")
    inside = Window.partitionBy(*keys, "_c").orderBy("_t")
    return (
        at.join(carry, [*keys, "_c"])
        .withColumn("_head", F.coalesce(F.max("_h").over(inside), F.col("_carry")))
        .drop("_c", "_h", "_carry")
    )


def guard(df: DataFrame, keys: list[str], order: list[str], seconds: float = lx.GUARD_INTERVAL_SECONDS) -> DataFrame:
    """Verdicts in order: system_message, too_short, rate_limited, contains_credentials."""
    checked = guard_text(df)
    gated = min_interval_gate(checked, keys, seconds, order, F.col("verdict") == "allowed")
    recent = F.col("since_accepted") < int(seconds * 1_000_000)
    limited = F.when(F.col("verdict") == "allowed", ~F.col("accepted")).when(
        F.col("verdict") == "contains_credentials", F.coalesce(recent, F.lit(False))
    )
    return (
        gated.withColumn(
            "verdict", F.when(F.coalesce(limited, F.lit(False)), "rate_limited").otherwise(F.col("verdict"))
        )
        .withColumn("clean_text", F.when(F.col("verdict") == "allowed", F.col("clean_text")))
        .drop("accepted", "since_accepted")
    )


def rate_counter(df: DataFrame, keys: list[str], order: list[str], seconds: float, limit: int) -> DataFrame:
    """Fixed windows that open at the first event after the last window ended.

    Places in a window are counted per slice of it, so one busy window is not one task's work. A null key is a key like
    others. A row without a time is in no window and not allowed. Every row comes out as often as it went in.
    """
    from pyspark.sql import Window

    interval = int(seconds * 1_000_000)
    chunk = max(interval, 60_000_000) * 64
    narrow = list(dict.fromkeys([*keys, *order, "ts"]))
    # rows that agree in all of these columns keep places of their own: they are numbered on both sides
    whole = df.withColumn("_row", F.struct(*narrow))
    whole = whole.withColumn("_same", F.row_number().over(Window.partitionBy("_row").orderBy(F.lit(1))))
    rows = whole.filter("ts is not null").select(
        F.struct(*keys).alias("_key"), "_row", "_same", F.struct(*order).alias("_order"), F.unix_micros("ts").alias("_t")
    )
    heads = greedy_heads(rows, ["_key"], "_t", interval, chunk)
    opened = _last_at_or_before(rows, heads, ["_key"], chunk)
    placed = running_index(opened, ["_key", "_head"], ["_t", "_order", "_same"], F.floor(F.col("_t") / max(interval // 64, 1)), "n_in_window")
    left = F.ceil((F.col("_head") + interval - F.col("_t")) / F.lit(1_000_000.0))
    counted = placed.select(
        "_row", "_same", F.col("n_in_window").cast("int").alias("n_in_window"), (F.col("n_in_window") <= limit).alias("_allowed"), left.alias("_left"),
        F.timestamp_micros("_head").alias("window_start"),
    )
    return whole.join(counted, ["_row", "_same"], "left").select(
        *df.columns, "n_in_window", F.coalesce("_allowed", F.lit(False)).alias("allowed"), F.when(~F.col("_allowed"), F.col("_left")).alias("retry_after"), "window_start"
    )


# --- transcripts --------------------------------------------------------------------
def filter_transcript(messages: DataFrame, max_messages: int | None = None) -> DataFrame:
    """Drop system and tool rows, short rows and JSON; name the sender."""
    if max_messages is not None:
        messages = running_index(
            messages, ["session_id"], ["seq"], F.floor(F.col("seq") / SEQ_CHUNK)
        ).filter(F.col("position") <= max_messages).drop("position")
    text = F.col("text")
    return messages.filter(
        ~F.col("role").isin("system", "tool")
        & (F.length(text) >= 10)
        & ~text.startswith("{")
        & ~text.startswith("[")
    ).withColumn("sender", F.when(F.col("role") == "user", "User").otherwise("Agent"))


def transcript_summary(processed: DataFrame, entity_counts: DataFrame | None = None) -> DataFrame:
    """Per session: counts, mean sentiment, intent histogram, five top emotions.

    Messages are read once: their counts per session, intent and emotions are written, and all parts are taken from there.
    """
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,15)"))
    kinds = processed.groupBy("session_id", "intent", "emotions").agg(
        F.count("*").alias("n"), F.sum(F.size("claims")).alias("claims"),
        exact("valence").alias("valence"), F.count("valence").alias("n_valence"),
        exact("arousal").alias("arousal"), F.count("arousal").alias("n_arousal"),
    )
    kinds = stored(kinds, "transcript-kinds")
    mean = lambda c: F.sum(c).cast("double") / F.sum(f"n_{c}")
    base = kinds.groupBy("session_id").agg(
        F.sum("n").alias("messages"),
        F.sum("claims").alias("claims"),
        mean("valence").alias("avg_valence"),
        mean("arousal").alias("avg_arousal"),
    )
    intents = (
        kinds.groupBy("session_id", "intent").agg(F.sum("n").alias("n"))
        .groupBy("session_id")
        .agg(F.sort_array(F.collect_list(F.struct("intent", "n"))).alias("intents"))
    )
    emotions = (
        kinds.select("session_id", "n", F.explode("emotions").alias("emotion"))
        .groupBy("session_id", "emotion").agg(F.sum("n").alias("n"))
    )
    best = (
        top_per(emotions, ["session_id"], [F.col("n").desc(), F.col("emotion")], 5)
        .groupBy("session_id")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "emotion"))).alias("e"))
        .select("session_id", F.col("e.emotion").alias("top_emotions"))
    )
    return base.join(intents, "session_id").join(best, "session_id")


def segment_episodes(processed: DataFrame, size: int = 10) -> DataFrame:
    """Every ``size`` messages of a session become one episode row.

    Needs the columns of ``understand`` and ``entities``.
    """
    indexed = running_index(
        processed, ["session_id"], ["seq"], F.floor(F.col("seq") / SEQ_CHUNK)
    ).withColumn("segment", F.floor((F.col("position") - 1) / size))
    line = F.concat(F.lit("["), F.col("sender"), F.lit("] "), F.substring("text", 1, 500))
    grouped = indexed.groupBy("session_id", "segment").agg(
        F.sort_array(
            F.collect_list(F.struct("position", line.alias("line"), "entities", "intent"))
        ).alias("m"),
        exact_avg("valence").alias("valence"),
        exact_avg("arousal").alias("arousal"),
    )
    names = F.array_distinct(F.flatten(F.col("m.entities")))
    kinds = F.array_distinct(F.col("m.intent"))
    return grouped.select(
        "session_id",
        "segment",
        F.concat(
            F.lit("Conversation segment: "), F.array_join(kinds, ", "),
            F.lit(" | Entities: "), F.array_join(F.slice(names, 1, 5), ", "),
        ).alias("summary"),
        F.substring(F.array_join(F.col("m.line"), "\n"), 1, 4000).alias("narrative"),
        F.slice(names, 1, 20).alias("topics"),
        F.least(F.lit(1.0), F.lit(0.3) + F.size(names) * 0.05).alias("importance_score"),
        "valence",
        "arousal",
        F.when(F.col("valence") > 0.3, "positive")
        .when(F.col("valence") < -0.3, "negative")
        .otherwise("stable")
        .alias("trajectory"),
    )


def mention_counts(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy(F.lower("entity").alias("entity")).agg(
        F.count("*").alias("mentions"), F.max("node_id").alias("node_id")
    )
