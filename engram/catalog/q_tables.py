"""Registered queries: table upserts, lookups, statistics (U, L, A, S17, W11-W14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.catalog import fixtures as fx
from engram.catalog import oracles as o
from engram.catalog.q_messages import _CORE, _ENTITY_MESSAGES, _TERMS, _entity_messages, _r
from engram.catalog.registry import query
from engram.operators import messages as m
from engram.operators import tables as t


@query("episode_stats")
def episode_stats(spark, root):
    return t.episode_stats(fx.episodes_doc(spark, root, embeddings=False)).select(
        "total", "with_participants", *_r("avg_importance"), "protected"
    )


o.SQL["episode_stats"] = f"""
WITH {o.EPISODES} SELECT count(*) AS total, count(*) FILTER (len(participants) > 0) AS with_participants,
  round(avg(importance_score), 6) AS avg_importance, count(*) FILTER (decay_protected) AS protected FROM episodes"""


@query("episode_filter")
def episode_filter(spark, root):
    return t.query_episodes(
        fx.episodes_doc(spark, root, embeddings=False), start="2024-01-05 00:00:00", end="2024-12-31 00:00:00",
        topics=["que", "der"], min_importance=0.2, limit=20, offset=5,
    ).select("id", *_r("importance_score"), "access_count")


o.SQL["episode_filter"] = f"""
WITH {o.EPISODES} SELECT id, round(importance_score, 6) AS importance_score, access_count FROM episodes
WHERE created_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-12-31' AND list_has_any(topics, ['que','der']) AND importance_score >= 0.2
ORDER BY importance_score DESC, created_at DESC, id LIMIT 20 OFFSET 5"""


@query("recent_topk")
def recent_topk(spark, root):
    return t.recent(fx.episodes_doc(spark, root, embeddings=False), 10).select("id", "session_id")


o.SQL["recent_topk"] = f"WITH {o.EPISODES} SELECT id, session_id FROM episodes ORDER BY created_at DESC, id LIMIT 10"


@query("high_importance")
def high_importance(spark, root):
    return t.high_importance(fx.episodes_doc(spark, root, embeddings=False)).select("id", *_r("importance_score"))


o.SQL["high_importance"] = f"""
WITH {o.EPISODES} SELECT id, round(importance_score, 6) AS importance_score FROM episodes
WHERE importance_score >= 0.8 OR decay_protected ORDER BY importance_score DESC, created_at DESC, id LIMIT 20"""


@query("episodes_by_entity")
def episodes_by_entity(spark, root):
    links = fx.table(spark, root, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("episode_id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("entity_id")
    )
    episodes = fx.table(spark, root, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderdate").alias("created_at"))
    return t.by_entity(episodes, links, "s7", 10).select("id")


o.SQL["episodes_by_entity"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 7)
ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) LIMIT 10"""


@query("bump_access")
def bump_access(spark, root):
    ep = fx.episodes_doc(spark, root, embeddings=False)
    hits = fx.table(spark, root, "labels").select(F.col("doc_id").cast("string").alias("id"))
    return t.bump_access(ep, hits, fx.DOCS_AS_OF).select("id", "access_count", "last_accessed")


o.SQL["bump_access"] = f"""
WITH {o.EPISODES}, h AS (SELECT CAST(doc_id AS VARCHAR) AS id, count(*) AS n FROM labels GROUP BY 1)
SELECT e.id, CAST(access_count + coalesce(n, 0) AS INTEGER) AS access_count, CASE WHEN n IS NOT NULL THEN TIMESTAMP '2024-03-01' END AS last_accessed
FROM episodes e LEFT JOIN h ON h.id = e.id"""


@query("update_episodes")
def update_episodes(spark, root):
    ep = fx.episodes_doc(spark, root, embeddings=False)
    patch = fx.table(spark, root, "labels").select(
        F.col("doc_id").cast("string").alias("id"), F.col("quality").cast("double").alias("importance_score"),
        F.when(F.col("toxic") == 1, True).alias("decay_protected"),
    ).groupBy("id").agg(F.max("importance_score").alias("importance_score"), F.max("decay_protected").alias("decay_protected"))
    return t.update_episodes(ep, patch).select("id", *_r("importance_score"), "decay_protected")


o.SQL["update_episodes"] = f"""
WITH {o.EPISODES}, p AS (SELECT CAST(doc_id AS VARCHAR) AS id, max(quality)::DOUBLE AS q, max(CASE WHEN toxic = 1 THEN TRUE END) AS d FROM labels GROUP BY 1)
SELECT e.id, round(coalesce(q, importance_score), 6) AS importance_score, coalesce(d, decay_protected) AS decay_protected FROM episodes e LEFT JOIN p ON p.id = e.id"""


@query("create_episodes")
def create_episodes(spark, root):
    new = fx.messages_conv(spark, root).select(
        "session_id", F.substring("text", 1, 200).alias("summary"), F.col("text").alias("narrative"),
        F.when(F.col("role") == "user", 0.7).alias("importance_score"),
    )
    return t.create_episodes(new).groupBy("importance_score", F.col("arc.trajectory").alias("trajectory"), F.col("outcome.type").alias("outcome")).agg(
        F.count("*").alias("n"), F.sum("access_count").alias("accesses")
    )


o.SQL["create_episodes"] = """
SELECT CASE WHEN role='user' THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS importance_score, 'stable' AS trajectory, 'informational' AS outcome,
  count(*) AS n, 0::BIGINT AS accesses FROM conversations GROUP BY 1"""


@query("identity_stats")
def identity_stats(spark, root):
    seg = fx.table(spark, root, "customer").select(
        F.col("c_name").alias("key"), F.col("c_mktsegment").alias("category"),
        (F.col("c_nationkey") / 25.0).alias("emotional_weight"), F.col("c_custkey").alias("times_affirmed"),
    )
    return t.identity_stats(seg).select("total", *_r("avg_weight"), "most_affirmed", "times")


o.SQL["identity_stats"] = """
SELECT count(*) AS total, round(avg(c_nationkey / 25.0::DOUBLE), 6) AS avg_weight, max_by(c_name, c_custkey) AS most_affirmed, max(c_custkey) AS times FROM customer"""


@query("identity_by_category")
def identity_by_category(spark, root):
    return t.count_by(fx.table(spark, root, "customer"), "c_mktsegment")


o.SQL["identity_by_category"] = "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1"


def _executed(spark, root):
    ev = fx.table(spark, root, "events").select(
        "event_type", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"),
        (F.col("value") >= 10).alias("success"), F.col("props").alias("outcome"),
    )
    procs = fx.procedures_ev(spark, root)
    named = ev.join(procs.select("event_type", "name"), "event_type").drop("event_type")
    return t.record_executions(procs, named)


@query("record_executions")
def record_executions(spark, root):
    return _executed(spark, root).select(
        "name", "execution_count", "success_count", *_r("success_rate", "confidence"), "last_executed"
    )


_PROCS = (
    "procs(event_type, name, type, confidence) AS (VALUES "
    + ", ".join(f"({o.lit(p[0].split('-')[0])}, {o.lit(p[0])}, {o.lit(p[1])}, {p[4]}::DOUBLE)" for p in fx.EVENT_PROCEDURES)
    + ")"
)
_EXECUTED = f"""{_PROCS}, ev AS (SELECT name, ts, event_id, confidence, value >= 10 AS ok, CASE WHEN value >= 10 THEN 2 ELSE -5 END AS d FROM events JOIN procs USING (event_type)),
pre AS (SELECT *, sum(d) OVER (PARTITION BY name ORDER BY ts, event_id) AS p FROM ev),
done AS (SELECT name, count(*) AS execution_count, count(*) FILTER (ok) AS success_count,
  count(*) FILTER (ok) / count(*)::DOUBLE AS success_rate,
  least(max(confidence) + sum(d) / 100.0::DOUBLE, 1 + (sum(d) - max(p)) / 100.0::DOUBLE) AS confidence, max(ts) AS last_executed FROM pre GROUP BY name)"""
o.SQL["record_executions"] = f"""
WITH {_EXECUTED} SELECT name, execution_count, success_count, round(success_rate, 6) AS success_rate, round(confidence, 6) AS confidence, last_executed FROM done"""


@query("procedure_stats")
def procedure_stats(spark, root):
    return t.procedure_stats(_executed(spark, root)).select("total", *_r("avg_confidence", "avg_success_rate"), "executions")


o.SQL["procedure_stats"] = f"""
WITH {_EXECUTED} SELECT count(*) AS total, round(avg(confidence), 6) AS avg_confidence, round(avg(success_rate), 6) AS avg_success_rate, sum(execution_count)::BIGINT AS executions FROM done"""


@query("ranked_procedures")
def ranked_procedures(spark, root):
    done = _executed(spark, root)
    return t.ranked(done, F.col("confidence") >= 0.0, [F.col("success_rate").desc(), F.col("name")]).select("name", *_r("success_rate"))


o.SQL["ranked_procedures"] = f"WITH {_EXECUTED} SELECT name, round(success_rate, 6) AS success_rate FROM done WHERE confidence >= 0.0"


@query("memory_stats")
def memory_stats(spark, root):
    return t.memory_stats(
        {
            "semantic_nodes": fx.nodes(spark, root, embeddings=False).select("id"),
            "semantic_edges": fx.edges(spark, root).select("id"),
            "episodes": fx.episodes_doc(spark, root, embeddings=False).select("id"),
            "lessons": fx.lessons_bm(spark, root).select("id"),
        }
    )


o.SQL["memory_stats"] = f"""
WITH {o.NODES}, {o.EDGES} SELECT 'semantic_nodes' AS table_name, count(*) AS n FROM nodes UNION ALL SELECT 'semantic_edges', count(*) FROM edges
UNION ALL SELECT 'episodes', count(*) FROM documents UNION ALL SELECT 'lessons', count(*) FROM benchmark"""


@query("nodes_by_type")
def nodes_by_type(spark, root):
    return t.count_by(fx.nodes(spark, root, embeddings=False), "type")


o.SQL["nodes_by_type"] = f"WITH {o.NODES} SELECT type, count(*) AS n FROM nodes GROUP BY 1"


@query("lookup_nodes")
def lookup_nodes(spark, root):
    wanted = fx.table(spark, root, "customer").select(F.lit("person").alias("type"), F.upper("c_name").alias("name"))
    return t.lookup(fx.nodes(spark, root, embeddings=False).select("id", "type", "name"), wanted, ["type", "name"], ignore_case=True)


o.SQL["lookup_nodes"] = """SELECT 'person' AS type, upper(c_name) AS name, 'c' || c_custkey AS id FROM customer"""


@query("resolve_names")
def resolve_names(spark, root):
    from engram.operators.matching import resolve_names as resolve

    names = fx.table(spark, root, "part").select("p_partkey", F.upper("p_name").alias("spelling_in"))
    return resolve(names, fx.nodes(spark, root, embeddings=False), "spelling_in").select("p_partkey", "node_id")


o.SQL["resolve_names"] = "SELECT p_partkey, 't:' || p_name AS node_id FROM part"


@query("node_edges")
def node_edges(spark, root):
    ids = fx.table(spark, root, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"))
    return t.node_edges(fx.edges(spark, root), fx.nodes(spark, root, embeddings=False), ids).select(
        "node_id", "source_name", "target_name", "relationship", *_r("strength")
    )


o.SQL["node_edges"] = f"""
WITH {o.NODES}, {o.EDGES} SELECT 's' || s_suppkey AS node_id, s.name AS source_name, d.name AS target_name, relationship, round(strength, 6) AS strength
FROM supplier JOIN edges ON source_id = 's' || s_suppkey OR target_id = 's' || s_suppkey JOIN nodes s ON s.id = source_id JOIN nodes d ON d.id = target_id"""


@query("upsert_nodes")
def upsert_nodes(spark, root):
    """Every part row is one upsert of the node named by its part name."""
    old = fx.nodes(spark, root, embeddings=False)
    seed = fx.table(spark, root, "part").groupBy("p_type").agg(F.max("p_size").alias("s"))
    old = old.unionByName(
        seed.select(
            F.concat(F.lit("k:"), F.col("p_type")).alias("id"), F.lit("tool").alias("type"), F.lower("p_type").alias("name"),
            F.array(F.lit("old")).alias("aliases"), F.lit("from seed").alias("context"), F.lit(0.9).alias("confidence"),
            F.lit("1998-01-01 00:00:00").cast("timestamp").alias("last_verified"), F.lit(0).cast("bigint").alias("source_count"),
            F.lit("1998-01-01 00:00:00").cast("timestamp").alias("last_modified"), F.lit("kept").alias("significance"),
            F.create_map(F.lit("size"), F.lit("seed"), F.lit("seed"), F.lit("yes")).alias("attributes"),
            F.lit("stated").alias("confidence_basis"), F.lit(0.0).alias("emotional_weight"),
        )
    )
    part = fx.table(spark, root, "part")
    new = part.select(
        F.lit("tool").alias("type"), F.col("p_name").alias("name"),
        F.when(F.col("p_size") > 25, F.array("p_brand")).otherwise(fx.no_strings()).alias("aliases"),
        F.create_map(F.col("p_type"), F.col("p_size").cast("string")).alias("attributes"),
        F.when(F.col("p_size") > 40, F.col("p_brand")).alias("context"), F.lit(None).cast("string").alias("significance"),
        F.when(F.col("p_size") > 10, F.col("p_size") / 50.0).alias("confidence"), F.lit(None).cast("string").alias("confidence_basis"),
        F.lit(None).cast("double").alias("emotional_weight"), F.col("p_partkey").alias("batch_order"),
    ).unionByName(
        part.select(
            F.lit("tool").alias("type"), F.lower("p_type").alias("name"), fx.no_strings().alias("aliases"),
            F.create_map(F.lit("size"), F.col("p_size").cast("string")).alias("attributes"),
            F.lit(None).cast("string").alias("context"), F.lit(None).cast("string").alias("significance"),
            F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("confidence_basis"),
            F.lit(0.3).alias("emotional_weight"), F.col("p_partkey").alias("batch_order"),
        )
    )
    out = t.upsert_nodes(old, new, fx.ORDERS_AS_OF)
    entry = lambda e: F.concat(e["key"], F.lit("="), e["value"])
    return out.select(
        "type", "name", F.array_join("aliases", ",").alias("aliases"), "context", "significance", *_r("confidence", "emotional_weight"),
        "confidence_basis", F.array_join(F.sort_array(F.transform(F.map_entries("attributes"), entry)), ",").alias("attributes"),
        "last_modified",
    )


o.SQL["upsert_nodes"] = f"""
WITH {o.NODES}, seed AS (SELECT DISTINCT lower(p_type) AS name FROM part),
new AS (SELECT p_name AS name, CASE WHEN p_size > 25 THEN p_brand END AS alias, p_type AS k, CAST(p_size AS VARCHAR) AS v,
    CASE WHEN p_size > 40 THEN p_brand END AS context, coalesce(CASE WHEN p_size > 10 THEN p_size / 50.0::DOUBLE END, 0.5::DOUBLE) AS confidence, 0.0::DOUBLE AS w, p_partkey AS ord FROM part
  UNION ALL SELECT lower(p_type), NULL, 'size', CAST(p_size AS VARCHAR), NULL, 0.5::DOUBLE, 0.3::DOUBLE, p_partkey FROM part),
a AS (SELECT name, k, arg_max(v, ord) AS v FROM new GROUP BY 1, 2 UNION ALL SELECT name, 'seed', 'yes' FROM seed),
atts AS (SELECT name, string_agg(k || '=' || v, ',' ORDER BY k || '=' || v) AS attributes FROM a GROUP BY 1),
f AS (SELECT name, arg_max(alias, ord) FILTER (alias IS NOT NULL) AS alias, arg_max(context, ord) FILTER (context IS NOT NULL) AS context,
  arg_max(confidence, ord) AS confidence, arg_max(w, ord) AS w FROM new GROUP BY 1)
SELECT 'tool' AS type, name, coalesce(alias, CASE WHEN name IN (SELECT name FROM seed) THEN 'old' END, '') AS aliases,
  coalesce(context, CASE WHEN name IN (SELECT name FROM seed) THEN 'from seed' ELSE 'regular' END) AS context,
  CASE WHEN name IN (SELECT name FROM seed) THEN 'kept' END AS significance, round(confidence, 6) AS confidence, round(w, 6) AS emotional_weight,
  'assumed' AS confidence_basis, attributes, TIMESTAMP '2001-09-01' AS last_modified FROM f JOIN atts USING (name)
UNION ALL SELECT type, name, '', context, NULL, round(confidence, 6), 0.0, basis, '', last_verified FROM nodes WHERE type <> 'tool'"""


def _persons(spark, root):
    trust = F.struct(*[F.lit(v).alias(n) for n, v in [("ability", 0.7), ("benevolence", 0.8), ("integrity", 0.8), ("composite", 0.77)]])
    c = fx.table(spark, root, "customer")
    return c.select(
        F.concat(F.lit("pm:"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("relationship_type"), trust.alias("trust_from_them"),
        F.create_map(F.lit("segment"), F.col("c_mktsegment")).alias("preferences"),
        F.array(F.lit("Late delivery")).alias("frustrations"), fx.no_strings().alias("motivations"),
        F.lit(1).cast("bigint").alias("total_interactions"), F.lit(None).cast("timestamp").alias("last_interaction"),
        F.lit(None).cast("string").alias("semantic_node_id"),
    )


@query("upsert_persons")
def upsert_persons(spark, root):
    orders, customer = fx.table(spark, root, "orders"), fx.table(spark, root, "customer")
    new = orders.join(customer, orders.o_custkey == customer.c_custkey, "left").select(
        F.coalesce("c_name", F.concat(F.lit("New "), F.col("o_custkey").cast("string"))).alias("name"),
        F.col("o_orderpriority").alias("relationship_type"),
        F.when(F.col("o_totalprice") > 300000, F.concat(F.lit("n"), F.col("o_orderkey").cast("string"))).alias("semantic_node_id"),
        F.col("o_orderkey").alias("batch_order"),
    )
    return t.upsert_persons(_persons(spark, root), new, fx.ORDERS_AS_OF).select(
        "name", "relationship_type", "semantic_node_id", "total_interactions", "last_interaction"
    )


o.SQL["upsert_persons"] = """
WITH f AS (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS rt, arg_max('n' || o_orderkey, o_orderkey) FILTER (o_totalprice > 300000) AS sid, count(*) AS n FROM orders GROUP BY 1)
SELECT c_name AS name, coalesce(rt, c_mktsegment) AS relationship_type, sid AS semantic_node_id, 1 + coalesce(n, 0) AS total_interactions,
  CASE WHEN n IS NOT NULL THEN TIMESTAMP '2001-09-01' END AS last_interaction FROM customer LEFT JOIN f ON o_custkey = c_custkey"""


@query("upsert_identity")
def upsert_identity(spark, root):
    customer = fx.table(spark, root, "customer")
    old = fx.table(spark, root, "nation").select(
        F.concat(F.lit("i"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_nationkey").cast("string").alias("key"),
        F.col("n_name").alias("value"), F.lit("core").alias("category"), F.lit(0.5).alias("emotional_weight"),
        F.lit(2).alias("times_affirmed"), F.lit(None).cast("timestamp").alias("last_affirmed"),
    )
    new = customer.select(
        F.when(F.col("c_acctbal") > 9000, F.col("c_mktsegment")).otherwise(F.col("c_nationkey").cast("string")).alias("key"),
        F.col("c_name").alias("value"), F.lit("value").alias("category"), (F.col("c_acctbal") / 10000.0).alias("emotional_weight"),
        F.col("c_custkey").alias("batch_order"),
    )
    return t.upsert_identity(old, new, fx.ORDERS_AS_OF).select(
        "key", "value", "category", *_r("emotional_weight"), "times_affirmed", "last_affirmed"
    )


o.SQL["upsert_identity"] = """
WITH new AS (SELECT CASE WHEN c_acctbal > 9000 THEN c_mktsegment ELSE CAST(c_nationkey AS VARCHAR) END AS key, * FROM customer),
f AS (SELECT key, arg_max(c_name, c_custkey) AS v, max(c_acctbal / 10000.0::DOUBLE) AS w, count(*) AS n FROM new GROUP BY 1)
SELECT coalesce(f.key, CAST(n_nationkey AS VARCHAR)) AS key, coalesce(v, n_name) AS value, CASE WHEN n_nationkey IS NULL THEN 'value' ELSE 'core' END AS category,
  round(CASE WHEN n_nationkey IS NULL THEN w ELSE greatest(0.5, coalesce(w, 0.5)) END, 6) AS emotional_weight,
  CAST(CASE WHEN n_nationkey IS NULL THEN n - 1 ELSE 2 + coalesce(n, 0) END AS INTEGER) AS times_affirmed,
  CASE WHEN n IS NOT NULL THEN TIMESTAMP '2001-09-01' END AS last_affirmed
FROM nation FULL JOIN f ON f.key = CAST(n_nationkey AS VARCHAR)"""


@query("upsert_procedures")
def upsert_procedures(spark, root):
    old = fx.procedures_ev(spark, root).drop("event_type")
    new = fx.table(spark, root, "part").select(
        F.lower("p_type").alias("name"), F.lit("technical").alias("type"), F.array("p_name").alias("trigger_phrases"),
        F.array("p_brand").alias("steps"), (F.col("p_size") / 50.0).alias("confidence"), F.col("p_partkey").alias("batch_order"),
    )
    return t.upsert_procedures(old, new).select(
        "name", "type", *_r("confidence"), F.array_join("trigger_phrases", "|").alias("triggers"), "execution_count"
    )


_PROC_TRIGGERS = (
    "ptrig(name, triggers) AS (VALUES " + ", ".join(f"({o.lit(p[0])}, {o.lit('|'.join(p[2]))})" for p in fx.EVENT_PROCEDURES) + ")"
)
o.SQL["upsert_procedures"] = f"""
WITH {_PROCS}, {_PROC_TRIGGERS} SELECT name, type, round(confidence, 6) AS confidence, triggers, 0::BIGINT AS execution_count FROM procs JOIN ptrig USING (name) WHERE event_type IN (SELECT event_type FROM events)
UNION ALL SELECT lower(p_type), 'technical', round(max(p_size / 50.0::DOUBLE), 6), arg_max(p_name, p_partkey), 0 FROM part GROUP BY 1"""


@query("create_edges")
def create_edges(spark, root):
    new = fx.table(spark, root, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source_id"), F.lit("n0").alias("target_id"),
        F.lit("values").alias("relationship"), F.lit("emotional").alias("category"),
        F.when(F.col("o_totalprice") > 200000, 0.8).alias("strength"), F.lit(None).cast("double").alias("confidence"),
    )
    return t.create_edges(fx.edges(spark, root), new).groupBy("relationship").agg(
        F.count("*").alias("n"), F.round(F.sum("strength"), 3).alias("s"), F.round(F.avg("confidence"), 6).alias("c")
    )


o.SQL["create_edges"] = f"""
WITH {o.EDGES}, a AS (SELECT relationship, strength FROM edges UNION ALL SELECT 'values', CASE WHEN o_totalprice > 200000 THEN 0.8 ELSE 0.5 END::DOUBLE FROM orders)
SELECT relationship, count(*) AS n, round(sum(strength), 3) AS s, 0.5::DOUBLE AS c FROM a GROUP BY 1"""

_MENTIONS = f"{_ENTITY_MESSAGES}, {o.NODES}, {_TERMS}"


def _mentions(spark, root):
    nodes = fx.nodes(spark, root, embeddings=False)
    return nodes, m.entity_mentions(_entity_messages(spark, root), nodes, ["message_id"])


@query("link_sources")
def link_sources(spark, root):
    nodes, ment = _mentions(spark, root)
    updated, _ = t.link_sources(nodes, ment.withColumnRenamed("message_id", "episode_id"), fx.EVENTS_AS_OF)
    return updated.select("id", "source_count", "last_modified")


o.SQL["link_sources"] = f"""
WITH {_MENTIONS}, c AS (SELECT node_id, count(*) AS n FROM mentions WHERE node_id IS NOT NULL GROUP BY 1)
SELECT id, source_count + coalesce(n, 0) AS source_count, CASE WHEN n IS NULL THEN last_verified ELSE TIMESTAMP '2024-01-31' END AS last_modified FROM nodes LEFT JOIN c ON node_id = id"""


@query("boost_edges")
def boost_edges(spark, root):
    _, ment = _mentions(spark, root)
    return t.boost_edges(fx.edges(spark, root), ment).select("id", *_r("strength"))


o.SQL["boost_edges"] = f"""
WITH {_MENTIONS}, {o.EDGES}, c AS (SELECT node_id, count(*) AS n FROM mentions WHERE node_id IS NOT NULL GROUP BY 1)
SELECT e.id, round(least(1.0, strength + 0.05 * (coalesce(s.n, 0) + CASE WHEN source_id = target_id THEN 0 ELSE coalesce(d.n, 0) END)), 6) AS strength
FROM edges e LEFT JOIN c s ON s.node_id = source_id LEFT JOIN c d ON d.node_id = target_id"""


@query("bump_interactions")
def bump_interactions(spark, root):
    _, ment = _mentions(spark, root)
    return t.bump_interactions(_persons(spark, root), ment, fx.EVENTS_AS_OF).select("name", "total_interactions", "last_interaction")


o.SQL["bump_interactions"] = f"""
WITH {_MENTIONS}, c AS (SELECT entity, count(*) AS n FROM mentions GROUP BY 1)
SELECT c_name AS name, 1 + coalesce(n, 0) AS total_interactions, CASE WHEN n IS NOT NULL THEN TIMESTAMP '2024-01-31' END AS last_interaction
FROM customer LEFT JOIN c ON entity = lower(c_name)"""

_IDENTITY = (
    "identity(id, key, value, category, emotional_weight, times_affirmed) AS (VALUES "
    + ", ".join("(" + ", ".join(o.lit(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in fx.IDENTITY)
    + ")"
)


@query("affirm_from_text")
def affirm_from_text(spark, root):
    return t.affirm_from_text(fx.identity_rows(spark), fx.messages_ev(spark, root), ["message_id"], fx.EVENTS_AS_OF).select(
        "key", "times_affirmed"
    )


o.SQL["affirm_from_text"] = f"""
WITH {o.MESSAGES_EV}, {_IDENTITY} SELECT key, any_value(times_affirmed)::BIGINT + count(message_id) AS times_affirmed FROM identity
LEFT JOIN messages ON contains(lower(text), lower(replace(key, '-', ' '))) OR contains(lower(text), lower(substring(value, 1, 30))) GROUP BY key"""


@query("ranked_by_executions")
def ranked_by_executions(spark, root):
    order = [F.col("execution_count").desc(), F.col("name")]
    return t.ranked(_executed(spark, root), F.col("success_count") > 0, order).select("name", "execution_count", "success_count")


o.SQL["ranked_by_executions"] = f"WITH {_EXECUTED} SELECT name, execution_count, success_count FROM done WHERE success_count > 0 ORDER BY execution_count DESC, name"


@query("append_links")
def append_links(spark, root):
    """Customer links kept beside those of their orders."""
    old = fx.table(spark, root, "customer").select(F.col("c_custkey").alias("source"), F.col("c_nationkey").cast("bigint").alias("target"))
    new = fx.table(spark, root, "orders").select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("target"))
    return t.append_links(old, new)


o.SQL["append_links"] = "SELECT c_custkey AS source, CAST(c_nationkey AS BIGINT) AS target FROM customer UNION ALL SELECT o_custkey, o_orderkey FROM orders"
