"""Turning understood messages into rows for each memory table."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions import lexicons as lx
from engram.functions.text import contains_any
from engram.operators.matching import top_per

MAX_PAIRS = 3
MAX_CLAIMS = 20


def category_of(relationship: Column) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(lx.RELATIONSHIP_CATEGORY.items())])
    return F.coalesce(F.try_element_at(table, relationship), F.lit("relational"))


def comention_relationship(type_a: Column, type_b: Column, text_lower: Column) -> Column:
    """Relationship of two entities named in one message, from types and cues."""
    def pair(x, y):
        return ((type_a == x) & (type_b == y)) | ((type_a == y) & (type_b == x))

    founded = contains_any(text_lower, ["founder", "founded"])
    built = contains_any(text_lower, ["built", "created", "building"])
    together = contains_any(text_lower, ["partner", "work with", "together"])
    taught = contains_any(text_lower, ["mentor", "teach"])
    return (
        F.when(pair("person", "organization"), F.when(founded, "created_by").otherwise("works_for"))
        .when(pair("person", "project"), F.when(built, "created_by").otherwise("responsible_for"))
        .when(pair("project", "tool"), "depends_on")
        .when(pair("person", "person"), F.when(~together & taught, "learned_from").otherwise("works_with"))
        .when(pair("project", "organization"), "owns")
        .otherwise("part_of")
    )


def to_episodes(messages: DataFrame, profile: str = "full") -> DataFrame:
    """Needs sentiment, intent and entities (and importance for the live profile)."""
    text = F.col("text")
    if profile == "live":
        point = F.struct("valence", "arousal", F.col("sentiment_label").alias("label"))
        sender = F.lower("sender")
        return messages.select(
            F.lit("live").alias("session_id"),
            F.substring(text, 1, 200).alias("summary"),
            text.alias("narrative"),
            F.when(sender == "agent", F.array(sender)).otherwise(F.array(sender, F.lit("agent"))).alias("participants"),
            F.slice("entities", 1, 5).alias("topics"),
            F.struct(point.alias("start"), F.lit("stable").alias("trajectory"), point.alias("end")).alias("arc"),
            "importance_score", "decay_protected", F.col("ts").alias("created_at"), "message_id",
        )
    short = F.when(F.length(text) > 300, F.concat(F.substring(text, 1, 297), F.lit("..."))).otherwise(text)
    flat = F.struct(F.col("dominant").alias("label"), "valence")
    peak = F.struct(F.col("dominant").alias("label"), "valence", "arousal")
    return messages.select(
        F.coalesce("session_id", F.lit("live-ingest")).alias("session_id"),
        F.concat(F.col("sender"), F.lit(": "), short).alias("summary"),
        text.alias("narrative"),
        F.array("sender").alias("participants"),
        F.struct(flat.alias("start"), peak.alias("peak"), flat.alias("end")).alias("arc"),
        peak.alias("peak"), flat.alias("resolution"),
        F.struct("intent", "urgency", "claims", "entities").alias("outcome"),
        F.col("ts").alias("created_at"), "message_id",
    )


def mentions_to_nodes(mentions: DataFrame, order: str) -> DataFrame:
    """Rows for the node upsert; unknown names below .6 confidence are left out."""
    return mentions.filter(F.col("is_known") | (F.col("confidence") >= 0.6)).select(
        F.col("entity_type").alias("type"), F.col("entity").alias("name"),
        F.array().cast("array<string>").alias("aliases"),
        F.create_map().cast("map<string,string>").alias("attributes"),
        "context", F.lit(None).cast("string").alias("significance"), "confidence",
        F.when(F.col("is_known"), "stated").otherwise("inferred").alias("confidence_basis"),
        F.lit(None).cast("double").alias("emotional_weight"), F.col(order).alias("batch_order"),
    )


def comention_edges(messages: DataFrame, mentions: DataFrame, key: str = "message_id") -> DataFrame:
    """The first three pairs (i < j by name) of resolved entities per message.

    Only the first four entities can take part, so no message is paired in full.
    """
    known = mentions.filter(
        F.col("node_id").isNotNull() & (F.col("is_known") | (F.col("confidence") >= 0.6))
    )
    few = top_per(known, [key], [F.col("entity"), F.col("node_id")], MAX_PAIRS + 1)
    item = F.struct("entity", "node_id", "entity_type", "confidence")
    lists = few.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("e")).filter(F.size("e") > 1)
    pair = lambda i, j: F.when(
        F.size("e") > j, F.struct(F.col("e")[i].alias("a"), F.col("e")[j].alias("b"))
    )
    pairs = F.slice(F.array_compact(F.array(pair(0, 1), pair(0, 2), pair(0, 3), pair(1, 2))), 1, MAX_PAIRS)
    rows = lists.select(key, F.explode(pairs).alias("p")).join(messages.select(key, "text"), key)
    relationship = comention_relationship(
        F.col("p.a.entity_type"), F.col("p.b.entity_type"), F.lower("text")
    )
    return rows.select(
        key,
        F.col("p.a.node_id").alias("source_id"), F.col("p.b.node_id").alias("target_id"),
        relationship.alias("relationship"), category_of(relationship).alias("category"),
        F.substring("text", 1, 200).alias("context"), F.lit(0.5).alias("strength"),
        F.least("p.a.confidence", "p.b.confidence").alias("confidence"),
    )


def attach_claims(nodes: DataFrame, messages: DataFrame, mentions: DataFrame, key: str = "message_id", order: str = "seq") -> DataFrame:
    """Append the claims of a message to the nodes it names: first kept, last 20.

    Returns the nodes with ``attributes['factual_claims']`` as a JSON list. At
    most 20 claims per node are ever gathered.
    """
    old = nodes.select(
        F.col("id").alias("node_id"),
        F.posexplode(F.from_json(F.try_element_at("attributes", F.lit("factual_claims")), "array<string>")).alias("pos", "claim"),
    ).select("node_id", "claim", F.struct(F.lit(0).alias("g"), F.lit(0).cast("bigint").alias("o"), "pos").alias("at"))
    new = (
        messages.select(key, F.col(order).cast("bigint").alias("o"), F.posexplode("claims").alias("pos", "claim"))
        .join(mentions.filter("is_known AND node_id IS NOT NULL").select(key, "node_id"), key)
        .select("node_id", "claim", F.struct(F.lit(1).alias("g"), "o", "pos").alias("at"))
    )
    first = old.unionByName(new).groupBy("node_id", "claim").agg(F.min("at").alias("at"))
    last = top_per(first, ["node_id"], [F.col("at").desc(), F.col("claim")], MAX_CLAIMS)
    lists = last.groupBy("node_id").agg(
        F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("at", "claim"))), lambda s: s["claim"])).alias("_claims")
    )
    empty = F.create_map().cast("map<string,string>")
    kept = F.map_filter(F.coalesce("attributes", empty), lambda k, v: k != "factual_claims")
    return (
        nodes.join(lists.withColumnRenamed("node_id", "id"), "id", "left")
        .withColumn(
            "attributes",
            F.when(
                F.col("_claims").isNotNull(), F.map_concat(kept, F.create_map(F.lit("factual_claims"), F.col("_claims")))
            ).otherwise(F.col("attributes")),
        )
        .drop("_claims")
    )


def to_identity(messages: DataFrame) -> DataFrame:
    """Self-knowledge rows: the last message of (category, intent_date) speaks."""
    rows = messages.filter((F.col("valence") != 0) | (F.col("intent") == "feedback")).select(
        F.when(F.col("intent") == "feedback", "capability").otherwise("emotional").alias("category"),
        F.concat_ws("_", "intent", F.date_format("ts", "yyyy-MM-dd")).alias("key"),
        F.to_json(
            F.struct(F.substring("text", 1, 500).alias("text"), "valence", "arousal", "emotions")
        ).alias("value"),
        F.when(F.col("arousal") > 0.5, 0.9).otherwise(0.6).alias("confidence"),
        F.struct("ts", "message_id").alias("at"),
    )
    return rows.groupBy("category", "key").agg(
        F.max_by("value", "at").alias("value"), F.max("confidence").alias("confidence")
    )


def to_procedures(messages: DataFrame) -> DataFrame:
    return messages.select(
        F.substring("text", 1, 200).alias("trigger"),
        F.when(F.col("intent") == "directive", "follow_directive").otherwise("store_procedure").alias("action"),
        F.col("text").alias("context"), F.lit(0.8).alias("confidence"), F.col("sender").alias("source"), "message_id",
    )


def route_table(messages: DataFrame) -> DataFrame:
    """One row per (message, target); trivial messages go to "skipped"."""
    trivial = (F.length("text") < 20) & (F.size("entities") == 0)
    targets = F.when(trivial, F.array(F.lit("skipped"))).otherwise(F.col("routes"))
    return messages.withColumn("route", F.explode(targets)).withColumn(
        "target", F.when(F.col("route") == "relational", "episodic").otherwise(F.col("route"))
    )


def router_stats(routed: DataFrame, edges: DataFrame, mentions: DataFrame) -> DataFrame:
    """Totals over one run: messages, episodes, node upserts, edges."""
    semantic = routed.filter("target = 'semantic'").select("message_id").distinct()
    base = routed.agg(
        F.count_distinct(F.when(F.col("route") != "skipped", F.col("message_id"))).alias("messages_routed"),
        F.count_if(F.col("target") == "episodic").alias("episodes_created"),
    )
    nodes = mentions.join(semantic, "message_id", "left_semi").agg(F.count("*").alias("nodes_upserted"))
    made = edges.join(semantic, "message_id", "left_semi").agg(F.count("*").alias("edges_created"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(base).join(one(nodes), "_one").join(one(made), "_one").drop("_one")
