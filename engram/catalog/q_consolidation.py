"""Registered queries: consolidation (C1-C22) and cross-layer edges (X1-X6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.catalog import fixtures as fx
from engram.catalog import oracles as o
from engram.catalog.q_messages import _ENTITY_MESSAGES, _entity_messages, _r
from engram.catalog.q_tables import _IDENTITY, _PROC_TRIGGERS, _PROCS, _persons
from engram.catalog.registry import query
from engram.functions import lexicons as lx
from engram.operators import consolidation as c
from engram.operators import crosslinks as x
from engram.operators import tables as t

EV = "2024-01-31"


@query("embedding_backlog")
def embedding_backlog(spark, root):
    ep, nodes = fx.episodes_doc(spark, root), fx.nodes(spark, root)
    return c.embedding_backlog(ep, nodes, limit=None).select("kind", "id", "text")


o.SQL["embedding_backlog"] = f"""
WITH {o.NODES}, {o.EPISODES} SELECT 'episode' AS kind, id, substring(summary || ' ' || substring(narrative, 1, 600), 1, 800) AS text FROM episodes WHERE embedding IS NULL
UNION ALL SELECT 'node', id, substring(type || ': ' || name || '. ', 1, 500) FROM nodes WHERE embedding IS NULL"""


@query("embed_text")
def embed_text(spark, root):
    nodes = fx.nodes(spark, root, embeddings=False).withColumns(
        {"aliases": F.when(F.col("type") == "place", F.array(F.upper("name"))).otherwise(F.col("aliases")),
         "attributes": F.create_map(F.lit("kind"), F.col("type"))}
    )
    return nodes.select("id", c.embed_text("full").alias("full_text"), c.embed_text("plain").alias("plain_text"))


o.SQL["embed_text"] = f"""
WITH {o.NODES}, b AS (SELECT *, type || ': ' || name || CASE WHEN type='place' THEN '. Also known as: ' || upper(name) ELSE '' END || '. ' || context AS p FROM nodes) SELECT id, p || '. kind: ' || type AS full_text, p AS plain_text FROM b"""


def _raw_insights(spark, root):
    """Model answers about orders: fenced, bare, broken."""
    orders = fx.table(spark, root, "orders")
    body = F.concat(
        F.lit('{"insights": [{"type": "decision", "content": "order '), F.col("o_orderkey").cast("string"),
        F.lit(' is '), F.col("o_orderpriority"), F.lit('", "severity": "minor", "related_entities": ["Customer#'),
        F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit('", "nation_'), (F.col("o_custkey") % 25).cast("string"),
        F.lit('"], "confidence": 0.5}]}'),
    )
    raw = (
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```")))
        .when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("Sure. "), body))
        .otherwise(F.concat(F.lit("{"), body))
    )
    return orders.select(F.col("o_orderkey").cast("string").alias("id"), raw.alias("raw"))


@query("parse_insights")
def parse_insights(spark, root):
    return c.parse_insights(_raw_insights(spark, root), ["id"]).select(
        "id", "type", "content", F.array_join("related_entities", ",").alias("entities"), *_r("confidence")
    )


o.SQL["parse_insights"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS id, 'decision' AS type, 'order ' || o_orderkey || ' is ' || o_orderpriority AS content,
  'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || ',nation_' || (o_custkey % 25) AS entities, 0.5::DOUBLE AS confidence FROM orders WHERE o_orderkey % 3 <> 2"""


@query("insight_counts")
def insight_counts(spark, root):
    return t.count_by(fx.insights_doc(spark, root), "type")


o.SQL["insight_counts"] = f"WITH {o.INSIGHTS} SELECT type, count(*) AS n FROM insights GROUP BY 1"

_MATCH = f"""{o.INSIGHTS}, {o.LESSONS},
iw AS (SELECT id, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (SELECT id, list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda w: length(w) > 4) AS ws FROM insights WHERE type='lesson')),
lw AS (SELECT DISTINCT id AS lesson_id, unnest(list_filter(regexp_split_to_array(lower(statement), '\\s+'), lambda w: length(w) > 4)) AS w FROM lessons),
pairw AS (SELECT DISTINCT a.w AS iw, b.lesson_id FROM (SELECT DISTINCT w FROM iw) a JOIN lw b ON contains(a.w, b.w) OR contains(b.w, a.w)),
ov AS (SELECT iw.id, any_value(n) AS n, lesson_id, count(*) AS k FROM iw JOIN pairw ON pairw.iw = iw.w GROUP BY iw.id, lesson_id),
match AS (SELECT id, min(lesson_id) AS lesson_id FROM ov WHERE k >= 3 OR (k >= 2 AND n <= 8) GROUP BY 1)"""


@query("lesson_reinforcement")
def lesson_reinforcement(spark, root):
    insights, lessons = fx.insights_doc(spark, root), fx.lessons_bm(spark, root)
    return c.reinforce_lessons(lessons, c.match_lessons(insights, lessons), fx.DOCS_AS_OF).select("id", "times_reinforced", "last_reinforced")


o.SQL["lesson_reinforcement"] = f"""
WITH {_MATCH} SELECT l.id, CAST(times_reinforced + coalesce(k, 0) AS INTEGER) AS times_reinforced, CASE WHEN k > 0 THEN TIMESTAMP '2024-03-01' END AS last_reinforced
FROM lessons l LEFT JOIN (SELECT lesson_id, count(*) AS k FROM match GROUP BY 1) m ON m.lesson_id = l.id"""


@query("new_lessons")
def new_lessons(spark, root):
    insights, lessons = fx.insights_doc(spark, root), fx.lessons_bm(spark, root)
    return c.new_lessons(insights, c.match_lessons(insights, lessons), fx.DOCS_AS_OF).select("id", "severity", "prevention_rule")


o.SQL["new_lessons"] = f"WITH {_MATCH} SELECT 'lesson:' || id AS id, severity, substring(content, 1, 200) AS prevention_rule FROM insights WHERE type='lesson' AND id NOT IN (SELECT id FROM match)"


@query("discover_edges")
def discover_edges(spark, root):
    insights = c.parse_insights(_raw_insights(spark, root), ["id"])
    return c.discover_edges(insights, fx.nodes(spark, root, embeddings=False), fx.edges(spark, root)).select(
        "source_id", "target_id", "relationship", "context"
    )


o.SQL["discover_edges"] = f"""
WITH {o.EDGES}, p AS (SELECT o_custkey, arg_min('order ' || o_orderkey || ' is ' || o_orderpriority, CAST(o_orderkey AS VARCHAR)) AS ctx FROM orders WHERE o_orderkey % 3 <> 2 GROUP BY 1),
q AS (SELECT 'c' || o_custkey AS s, 'n' || (o_custkey % 25) AS t, ctx FROM p JOIN customer ON c_custkey = o_custkey)
SELECT s AS source_id, t AS target_id, 'influences' AS relationship, ctx AS context FROM q WHERE NOT EXISTS (SELECT 1 FROM edges WHERE source_id = s AND target_id = t)"""


@query("affirm_from_insights")
def affirm_from_insights(spark, root):
    msgs = fx.messages_ev(spark, root).select(F.col("message_id").cast("string").alias("id"), F.col("text").alias("content"))
    return c.affirm_from_insights(fx.identity_rows(spark), msgs, fx.EVENTS_AS_OF).select("key", "times_affirmed")


o.SQL["affirm_from_insights"] = f"""
WITH {o.MESSAGES_EV}, {_IDENTITY}, w AS (SELECT key, unnest(list_concat(list_filter(string_split(replace(key, '-', ' '), ' '), lambda w: length(w) > 3), list_filter(string_split(substring(lower(value), 1, 100), ' '), lambda w: length(w) > 4))) AS term FROM identity),
h AS (SELECT DISTINCT key FROM w JOIN messages ON contains(lower(text), term))
SELECT key, (times_affirmed + CASE WHEN key IN (SELECT key FROM h) THEN 1 ELSE 0 END)::BIGINT AS times_affirmed FROM identity"""


def _message_episodes(spark, root):
    msgs = fx.messages_ev(spark, root)
    return msgs.select(
        F.col("message_id").cast("string").alias("id"), F.col("ts").alias("created_at"), "session_id",
        F.col("text").alias("summary"), F.col("text").alias("narrative"), F.array(F.concat(F.lit("user "), F.col("session_id"))).alias("participants"),
        (F.col("message_id") % 100 / 100.0).alias("importance_score"), (F.col("message_id") % 3).cast("int").alias("access_count"),
        (F.col("message_id") % 7 == 0).alias("decay_protected"),
    )


_MEPS = f"""{o.MESSAGES_EV}, meps AS (SELECT CAST(message_id AS VARCHAR) AS id, message_id, ts AS created_at, session_id, text AS summary, text AS narrative, lower(text || ' ' || text) AS low,
 (message_id % 100) / 100.0::DOUBLE AS importance_score, message_id % 3 AS access_count, message_id % 7 = 0 AS decay_protected FROM messages)"""


@query("affirm_from_episodes")
def affirm_from_episodes(spark, root):
    return c.affirm_from_episodes(fx.identity_rows(spark), _message_episodes(spark, root), "2024-01-30 20:00:00").select("key", "times_affirmed")


o.SQL["affirm_from_episodes"] = f"""
WITH {_MEPS}, {_IDENTITY}, h AS (SELECT DISTINCT key FROM identity JOIN meps ON created_at > TIMESTAMP '2024-01-29 20:00:00' AND (contains(low, replace(key, '-', ' ')) OR contains(low, lower(substring(value, 1, 30)))))
SELECT key, (times_affirmed + CASE WHEN key IN (SELECT key FROM h) THEN 1 ELSE 0 END)::BIGINT AS times_affirmed FROM identity"""


@query("interactions_from_episodes")
def interactions_from_episodes(spark, root):
    persons = _persons(spark, root).withColumn("name", F.concat(F.lit("User "), F.substring("id", 4, 20)))
    return c.interactions_from_episodes(persons, _message_episodes(spark, root), "2024-01-30 20:00:00").select("name", "total_interactions")


o.SQL["interactions_from_episodes"] = f"""
WITH {o.MESSAGES_EV} SELECT 'User ' || c_custkey AS name, CAST(1 + CASE WHEN CAST(c_custkey AS VARCHAR) IN (SELECT session_id FROM messages WHERE ts > TIMESTAMP '2024-01-29 20:00:00') THEN 1 ELSE 0 END AS BIGINT) AS total_interactions FROM customer"""


@query("person_updates")
def person_updates(spark, root):
    orders, customer = fx.table(spark, root, "orders"), fx.table(spark, root, "customer")
    sign = F.when(F.col("o_orderstatus") == "F", -0.02).otherwise(0.05)
    none = fx.no_strings()
    updates = orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.upper("c_name").alias("name"), F.col("o_orderkey").alias("batch_order"),
        F.struct(sign.alias("ability"), F.lit(0.01).alias("benevolence"), F.lit(None).cast("double").alias("integrity")).alias("trust_delta"),
        F.create_map(F.lit("priority"), F.col("o_orderpriority")).alias("new_preferences"),
        F.when(F.col("o_totalprice") > 400000, F.array(F.lit("LATE delivery"), F.lit("High price"))).otherwise(none).alias("new_frustrations"),
        F.when(F.col("o_totalprice") < 50000, F.array(F.lit("Savings"))).otherwise(none).alias("new_motivations"),
    )
    return c.apply_person_updates(_persons(spark, root), updates, fx.ORDERS_AS_OF).select(
        "name", F.round("trust_from_them.ability", 6).alias("ability"), F.round("trust_from_them.composite", 6).alias("composite"),
        F.try_element_at("preferences", F.lit("priority")).alias("priority"), F.array_join("frustrations", "|").alias("frustrations"),
        F.array_join("motivations", "|").alias("motivations"), "total_interactions",
    )


o.SQL["person_updates"] = """
WITH RECURSIVE u AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, CASE WHEN o_orderstatus = 'F' THEN -0.02 ELSE 0.05 END::DOUBLE AS d FROM orders),
f AS (SELECT c_custkey AS k, 0::BIGINT AS i, 0.7::DOUBLE AS a, 0.8::DOUBLE AS b FROM customer
  UNION ALL SELECT f.k, u.i, greatest(0, least(1, coalesce(nullif(a, 0), 0.5) + d)), greatest(0, least(1, b + 0.01)) FROM f JOIN u ON u.k = f.k AND u.i = f.i + 1),
l AS (SELECT k, arg_max(a, i) AS a, arg_max(b, i) AS b, max(i) AS n FROM f GROUP BY 1),
x AS (SELECT o_custkey AS k, arg_max(o_orderpriority, o_orderkey) AS p, bool_or(o_totalprice > 400000) AS hi, bool_or(o_totalprice < 50000) AS lo FROM orders GROUP BY 1)
SELECT c_name AS name, round(a, 6) AS ability, round(CASE WHEN n > 0 THEN coalesce(nullif(a, 0), 0.5) * 0.3 + b * 0.4 + 0.8 * 0.3 ELSE 0.77 END, 6) AS composite, p AS priority,
  CASE WHEN hi THEN 'Late delivery|High price' ELSE 'Late delivery' END AS frustrations, CASE WHEN lo THEN 'Savings' ELSE '' END AS motivations, 1 + n AS total_interactions
FROM customer JOIN l ON l.k = c_custkey LEFT JOIN x ON x.k = c_custkey"""

_TRIG = "trig(name, term) AS (VALUES " + ", ".join(f"({o.lit(p[0])}, {o.lit(q.lower())})" for p in fx.EVENT_PROCEDURES for q in p[2]) + ")"
_STEP = "stp(name, i, w) AS (VALUES " + ", ".join(
    f"({o.lit(p[0])}, {i}, {o.lit(w)})" for p in fx.EVENT_PROCEDURES for i, s in enumerate(p[3]) for w in [v for v in s.lower().split() if len(v) > 4][:3]
) + ")"


@query("track_executions")
def track_executions(spark, root):
    return c.track_executions(fx.procedures_ev(spark, root), _message_episodes(spark, root)).select("name", "ts", "seq", "outcome")


o.SQL["track_executions"] = f"""
WITH {_MEPS}, {_PROCS}, {_TRIG}, {_STEP}, h AS (SELECT DISTINCT trig.name, id, created_at, low FROM trig JOIN meps ON contains(low, term) WHERE trig.name IN (SELECT name FROM procs WHERE event_type IN (SELECT event_type FROM events))),
k AS (SELECT h.name, id, created_at, low, count(DISTINCT i) AS n FROM h JOIN stp ON stp.name = h.name AND contains(low, w) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY created_at DESC, id) AS rn FROM k WHERE n >= 2)
SELECT name, created_at AS ts, id AS seq, CASE WHEN contains(low, 'failed') OR contains(low, 'error') OR contains(low, 'broken') THEN 'failure' ELSE 'success' END AS outcome FROM r WHERE rn = 1"""


@query("track_executions_loose")
def track_executions_loose(spark, root):
    procs = fx.procedures_ev(spark, root)
    found = c.track_executions(procs, _message_episodes(spark, root), strict=False)
    return t.record_executions(procs, found).select("name", "execution_count", "success_count", *_r("confidence"))


o.SQL["track_executions_loose"] = f"""
WITH {_MEPS}, {_PROCS}, {_TRIG}, h AS (SELECT DISTINCT trig.name, id, created_at, NOT (contains(low, 'fail') OR contains(low, 'error') OR contains(low, 'broke')) AS ok FROM trig JOIN meps ON contains(low, term)),
pre AS (SELECT *, CASE WHEN ok THEN 2 ELSE -5 END AS d, sum(CASE WHEN ok THEN 2 ELSE -5 END) OVER (PARTITION BY name ORDER BY created_at, id) AS p FROM h),
g AS (SELECT name, count(*) AS n, count(*) FILTER (ok) AS s, sum(d) AS td, max(p) AS mp FROM pre GROUP BY 1)
SELECT name, coalesce(n, 0) AS execution_count, coalesce(s, 0) AS success_count, round(CASE WHEN n IS NULL THEN confidence ELSE least(confidence + td / 100.0::DOUBLE, 1 + (td - mp) / 100.0::DOUBLE) END, 6) AS confidence
FROM procs LEFT JOIN g USING (name) WHERE event_type IN (SELECT event_type FROM events)"""


@query("rollup_stale")
def rollup_stale(spark, root):
    summary, _ = c.rollup_stale(_message_episodes(spark, root), "2024-02-15 00:00:00")
    return summary.select("summary", "narrative", "rolled_up")


_STALE = f"{_MEPS}, st AS (SELECT * FROM meps WHERE NOT decay_protected AND importance_score < {{b}} AND created_at < TIMESTAMP '2024-02-15' - INTERVAL 30 DAY AND access_count = 0)"
o.SQL["rollup_stale"] = f"""
WITH {_STALE.replace('{b}', '0.25')} SELECT 'Consolidated ' || count(*) || ' low-importance memories' AS summary, substring(string_agg(summary, '; ' ORDER BY created_at, id), 1, 2000) AS narrative, count(*) AS rolled_up FROM st HAVING count(*) > 5"""


@query("rollup_marks")
def rollup_marks(spark, root):
    _, marks = c.rollup_stale(_message_episodes(spark, root), "2024-02-15 00:00:00")
    return marks


o.SQL["rollup_marks"] = f"WITH {_STALE.replace('{b}', '0.25')} SELECT id, 'rollup:2024-02-15' AS consolidated_into FROM st WHERE (SELECT count(*) FROM st) > 5"


@query("rollup_daily")
def rollup_daily(spark, root):
    rows, _ = c.rollup_daily(_message_episodes(spark, root), "2024-02-15 00:00:00", part=100)
    return rows.select("id", "summary", "narrative")


o.SQL["rollup_daily"] = f"""
WITH {_STALE.replace('{b}', '0.3')}, p AS (SELECT *, (row_number() OVER (ORDER BY created_at, id) - 1) // 100 AS part, count(*) OVER () AS n FROM st),
g AS (SELECT part, any_value(n) AS n, string_agg(summary, '; ' ORDER BY created_at, id) AS narrative FROM p WHERE n > 10 GROUP BY 1)
SELECT 'rollup:2024-02-15:' || part AS id, CASE WHEN part = 0 THEN 'Consolidated ' || n || ' low-importance episodes from 30+ days ago: ' || substring(narrative, 1, 500) ELSE 'Continued part ' || part END AS summary, narrative FROM g"""


@query("recent_window")
def recent_window(spark, root):
    return c.recent_window(_message_episodes(spark, root), "2024-01-30 20:00:00").select("id")


o.SQL["recent_window"] = f"WITH {_MEPS} SELECT id FROM meps WHERE created_at > TIMESTAMP '2024-01-29 20:00:00' ORDER BY created_at DESC, id LIMIT 30"


@query("backfill_batch")
def backfill_batch(spark, root):
    return c.backfill_batch(fx.episodes_doc(spark, root, embeddings=False), fx.DOCS_AS_OF).select("id")


o.SQL["backfill_batch"] = f"""
WITH {o.EPISODES} SELECT id FROM episodes WHERE length(narrative) > 100 AND created_at < TIMESTAMP '2024-02-29' ORDER BY importance_score DESC, created_at DESC, id LIMIT 20"""


@query("model_input")
def model_input(spark, root):
    return c.model_input(c.backfill_batch(fx.episodes_doc(spark, root, embeddings=False), fx.DOCS_AS_OF))


o.SQL["model_input"] = f"""
WITH {o.EPISODES}, b AS (SELECT * FROM episodes WHERE length(narrative) > 100 AND created_at < TIMESTAMP '2024-02-29' ORDER BY importance_score DESC, created_at DESC, id LIMIT 20),
n AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, id) AS i FROM b)
SELECT substring(string_agg('Episode ' || i || ' (' || participants[1] || '):' || chr(10) || summary || chr(10) || narrative, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY i), 1, 6000) AS insight_text,
  substring(string_agg('Episode ' || i || ': ' || summary || chr(10) || substring(narrative, 1, 500), chr(10) || chr(10) ORDER BY i), 1, 5000) AS person_text FROM n"""


@query("health_score")
def health_score(spark, root):
    tables = {
        "nodes": fx.nodes(spark, root), "edges": fx.edges(spark, root), "episodes": fx.episodes_doc(spark, root),
        "identity": fx.identity_rows(spark), "persons": _persons(spark, root), "procedures": fx.procedures_ev(spark, root),
        "lessons": fx.lessons_bm(spark, root),
    }
    return c.health(tables, as_of=fx.ORDERS_AS_OF).select(
        "score", "stale_nodes", "episodes_with_embedding", "episodes_with_lessons", "n_nodes", "n_edges", "n_episodes", "n_persons", "orphans", "duplicates", "protected", *_r("embedding_coverage", "avg_importance")
    )


o.SQL["health_score"] = f"""
WITH {o.NODES}, {o.EDGES}, {o.EPISODES}, {_IDENTITY}, m AS (SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(embedding) FROM nodes) AS ne, (SELECT count(*) FROM nodes WHERE last_verified < TIMESTAMP '{fx.ORDERS_AS_OF}' - INTERVAL 60 DAY) AS stale_nodes, (SELECT count(embedding) FROM episodes) AS ee, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM episodes) AS n_episodes,
 (SELECT count(*) FROM customer) AS n_persons, (SELECT count(*) FROM identity) AS n_identity, (SELECT count(DISTINCT event_type) FROM events) AS n_procs, (SELECT avg(emotional_weight) FROM identity)::DOUBLE AS w,
 (SELECT count(*) FROM nodes WHERE type='person' AND id NOT IN (SELECT source_id FROM edges UNION SELECT target_id FROM edges)) AS orphans, (SELECT count(*) FROM (SELECT summary FROM episodes GROUP BY 1 HAVING count(*) > 1)) AS duplicates,
 (SELECT count(*) FILTER (decay_protected) FROM episodes) AS protected, (SELECT avg(importance_score) FROM episodes) AS imp)
SELECT CAST(round(least(n_nodes / 100.0, 1) * 10 + least(n_edges / 500.0, 1) * 8 + least(n_episodes / 200.0, 1) * 8 + least(n_identity / 20.0, 1) * 5 + least(n_persons / 3.0, 1) * 4 + least(n_procs / 10.0, 1) * 5
  + ne / n_nodes::DOUBLE * 15 + 5 + 5 + greatest(0, 5 - orphans) + greatest(0, 5 - duplicates) + imp * 5 + least(protected / 30.0, 1) * 5 + w * 5) AS BIGINT) AS score,
 stale_nodes, ee AS episodes_with_embedding, CAST(0 AS BIGINT) AS episodes_with_lessons, n_nodes, n_edges, n_episodes, n_persons, orphans, duplicates, protected, round(ne / n_nodes::DOUBLE, 6) AS embedding_coverage, round(imp, 6) AS avg_importance FROM m"""


# --- cross-layer edges ---------------------------------------------------------------------------------
def _context_nodes(spark, root):
    """Parts as nodes; their context is a message of the user with the same number."""
    msgs = fx.messages_ev(spark, root).groupBy("session_id").agg(F.max_by("text", "message_id").alias("context"))
    part = fx.table(spark, root, "part")
    return part.join(msgs, F.col("p_partkey").cast("string") == F.col("session_id"), "left").select(
        F.concat(F.lit("pt"), F.col("p_partkey").cast("string")).alias("id"), F.lit("tool").alias("type"),
        F.concat(F.col("p_name"), F.lit(" rows "), F.col("p_partkey").cast("string")).alias("name"), "context",
    ).unionByName(
        fx.table(spark, root, "nation").select(
            F.concat(F.lit("w"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("concept").alias("type"),
            F.when(F.col("n_nationkey") == 0, "status").otherwise(F.col("n_name")).alias("name"), F.lit("order number of purchase").alias("context"),
        )
    )


_CNODES = f"""{o.MESSAGES_EV}, lastm AS (SELECT session_id, arg_max(text, message_id) AS context FROM messages GROUP BY 1),
cnodes AS (SELECT 'pt' || p_partkey AS id, p_name || ' rows ' || p_partkey AS name, context FROM part LEFT JOIN lastm ON session_id = CAST(p_partkey AS VARCHAR)
 UNION ALL SELECT 'w' || n_nationkey, CASE WHEN n_nationkey = 0 THEN 'status' ELSE n_name END, 'order number of purchase' FROM nation)"""
_SEEN = "WHERE name IN (SELECT name FROM procs WHERE event_type IN (SELECT event_type FROM events))"
_PW = "pw(name, w) AS (VALUES " + ", ".join(f"({o.lit(p[0])}, {o.lit(w)})" for p in fx.EVENT_PROCEDURES for w in p[0].split("-") if len(w) > 3) + ")"
_PS = "pstext(name, st) AS (VALUES " + ", ".join(f"({o.lit(p[0])}, {o.lit(str(p[3]).lower())})" for p in fx.EVENT_PROCEDURES) + ")"


@query("applies_in_context")
def applies_in_context(spark, root):
    return x.applies_in_context(fx.procedures_ev(spark, root), _context_nodes(spark, root)).select("source_id", "target_id", *_r("strength"))


o.SQL["applies_in_context"] = f"""
WITH {_CNODES}, {_PROCS}, {_TRIG}, {_PW}, {_PS}, pts AS (SELECT trig.name AS pn, id, 2 AS p FROM trig JOIN cnodes c ON contains(lower(context), term) UNION ALL SELECT trig.name, id, 3 FROM trig JOIN cnodes c ON contains(lower(c.name), term)
 UNION ALL SELECT pw.name, id, 1 FROM pw JOIN cnodes c ON contains(lower(context), w) UNION ALL SELECT ps.name, id, 2 FROM pstext ps JOIN cnodes c ON length(c.name) > 4 AND contains(st, lower(c.name)))
SELECT 'p:' || pn AS source_id, id AS target_id, round(least(0.5 + sum(p) * 0.05, 0.95)::DOUBLE, 6) AS strength FROM pts WHERE pn IN (SELECT name FROM procs WHERE event_type IN (SELECT event_type FROM events)) GROUP BY pn, id HAVING sum(p) >= 3"""


@query("cross_layer_edges")
def cross_layer_edges(spark, root):
    tables = {
        "procedures": fx.procedures_ev(spark, root), "nodes": _context_nodes(spark, root), "identity": fx.identity_rows(spark),
        "episodes": _message_episodes(spark, root),
        "lessons": fx.lessons_bm(spark, root).withColumn("statement", F.concat(F.lit("purchase of status: "), F.col("statement"))),
    }
    return x.build_cross_edges(tables).groupBy("relationship").agg(F.count("*").alias("n"), F.round(F.sum("strength"), 4).alias("s"))


_ID_TYPES = "idt(category, type) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, bs in lx.IDENTITY_PROCEDURE_TYPES.items() for b in bs) + ")"
_LF = "lf(name, ep) AS (VALUES " + ", ".join(f"({o.lit(p[0])}, '{e}')" for p in fx.EVENT_PROCEDURES for e in p[5]) + ")"
o.SQL["cross_layer_edges"] = f"""
WITH {_CNODES}, meps AS (SELECT CAST(message_id AS VARCHAR) AS id, ts AS created_at, lower(text || ' ' || text) AS low FROM messages),
{_PROCS}, live AS (SELECT * FROM procs WHERE event_type IN (SELECT event_type FROM events)), {_TRIG}, {_PW}, {_PS}, {_IDENTITY}, {_ID_TYPES}, {_LF},
pts AS (SELECT trig.name AS pn, id, 2 AS p FROM trig JOIN cnodes c ON contains(lower(context), term) UNION ALL SELECT trig.name, id, 3 FROM trig JOIN cnodes c ON contains(lower(c.name), term)
 UNION ALL SELECT pw.name, id, 1 FROM pw JOIN cnodes c ON contains(lower(context), w) UNION ALL SELECT ps.name, id, 2 FROM pstext ps JOIN cnodes c ON length(c.name) > 4 AND contains(st, lower(c.name))),
e1 AS (SELECT 'APPLIES_IN_CONTEXT' AS relationship, pn AS a, id AS b, least(0.5 + sum(p) * 0.05, 0.95)::DOUBLE AS s FROM pts WHERE pn IN (SELECT name FROM live) GROUP BY pn, id HAVING sum(p) >= 3),
top AS (SELECT * FROM meps ORDER BY created_at DESC, id LIMIT 100),
e2 AS (SELECT 'LEARNED_FROM', name, ep, max(s) FROM (SELECT name, ep, 0.9::DOUBLE AS s FROM lf WHERE name IN (SELECT name FROM live) UNION ALL SELECT pw.name, id, 0.6 FROM pw JOIN top ON contains(low, w) WHERE pw.name IN (SELECT name FROM live) GROUP BY pw.name, id HAVING count(*) >= 2) GROUP BY 1, 2, 3),
e3 AS (SELECT 'SHAPED_BY_IDENTITY', key, l.name, least(0.95, emotional_weight * CASE WHEN tm AND xm THEN 1.0 ELSE 0.7 END)::DOUBLE FROM (SELECT i.*, l.name, EXISTS (SELECT 1 FROM idt WHERE idt.category = i.category AND idt.type = l.type) AS tm,
   contains(lower(value), replace(l.name, '-', ' ')) OR contains(l.name, replace(key, '-', ' ')) AS xm FROM identity i, live l) l WHERE tm OR xm),
e4 AS (SELECT 'COMPOSED_OF', a.name, b.name, 0.8::DOUBLE FROM pstext a, live b WHERE a.name IN (SELECT name FROM live) AND a.name <> b.name AND length(b.name) > 5 AND contains(st, replace(b.name, '-', ' '))),
e5 AS (SELECT DISTINCT 'REFINED_BY_EXPERIENCE', CAST(item_id AS VARCHAR), pw.name, 0.75::DOUBLE FROM benchmark JOIN pw ON contains(lower('purchase of status: ' || text), w) WHERE CAST(item_id AS VARCHAR) IN (SELECT id FROM meps) AND pw.name IN (SELECT name FROM live))
SELECT relationship, count(*) AS n, round(sum(s), 4) AS s FROM (SELECT * FROM e1 UNION ALL SELECT * FROM e2 UNION ALL SELECT * FROM e3 UNION ALL SELECT * FROM e4 UNION ALL SELECT * FROM e5) GROUP BY 1"""
