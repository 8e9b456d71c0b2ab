"""Registered queries: routing (W1-W10), enrichment (E1-E11), graph (G1, G2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.catalog import fixtures as fx
from engram.catalog import oracles as o
from engram.catalog.q_messages import (
    _CORE, _ENTITY_MESSAGES, _INTENT, _RE2_CLAIMS, _ROUTED, _ROUTES, _SENT, _TERMS, _URG, _entity_messages, _r, _routed,
)
from engram.catalog.registry import query
from engram.functions import lexicons as lx
from engram.operators import enrichment as e
from engram.operators import graph as g
from engram.operators import messages as m
from engram.operators import routing as w
from engram.session import stored

_MENTIONS = f"{_ENTITY_MESSAGES}, {o.NODES}, {_TERMS}"


def _mentions(spark, root):
    nodes = fx.nodes(spark, root, embeddings=False)
    msgs = _entity_messages(spark, root)
    return nodes, msgs, m.entity_mentions(msgs, nodes, ["message_id"])


@query("message_episodes")
def message_episodes(spark, root):
    return w.to_episodes(_routed(spark, root)).select(
        "message_id", "session_id", "summary", F.col("peak.label").alias("label"), F.col("outcome.intent").alias("intent"), "created_at"
    )


o.SQL["message_episodes"] = f"""
WITH {_ENTITY_MESSAGES}, {_SENT} SELECT message_id, session_id, sender || ': ' || CASE WHEN length(text) > 300 THEN substring(text, 1, 297) || '...' ELSE text END AS summary,
  emotions[1] AS label, {_INTENT} AS intent, ts AS created_at FROM felt"""


@query("live_episodes")
def live_episodes(spark, root):
    from engram.catalog.q_messages import _light_routed

    return w.to_episodes(_light_routed(spark, root), profile="live").select(
        "message_id", "summary", F.array_join("participants", ",").alias("participants"), F.array_join("topics", ",").alias("topics")
    )


o.SQL["live_episodes"] = f"""
WITH {_ENTITY_MESSAGES}, {o.NODES}, t AS (SELECT message_id, name, row_number() OVER (PARTITION BY message_id ORDER BY name) AS rn FROM (
    SELECT DISTINCT message_id, name FROM messages JOIN nodes ON length(name) >= 3 AND contains(lower(text), lower(name)))),
k AS (SELECT message_id, string_agg(name, ',' ORDER BY name) AS topics FROM t WHERE rn <= 5 GROUP BY 1)
SELECT message_id, substring(text, 1, 200) AS summary, CASE WHEN sender='agent' THEN 'agent' ELSE lower(sender) || ',agent' END AS participants, coalesce(topics, '') AS topics
FROM messages LEFT JOIN k USING (message_id)"""


@query("mention_nodes")
def mention_nodes(spark, root):
    _, _, ment = _mentions(spark, root)
    return w.mentions_to_nodes(ment, "message_id").groupBy("type", "name", "confidence_basis").agg(
        F.count("*").alias("n"), F.max_by("context", "batch_order").alias("context")
    )


o.SQL["mention_nodes"] = f"""
WITH {_MENTIONS} SELECT etype AS type, entity AS name, 'stated' AS confidence_basis, count(*) AS n, arg_max(context, message_id) AS context FROM mentions GROUP BY 1, 2"""


def _named_parts(spark, root):
    """Orders as messages that list their parts; parts are typed by their noun."""
    sections = fx.order_sections(spark, root)
    msgs = sections.select(
        F.col("section_id").alias("message_id"), F.col("section_id").alias("seq"),
        F.concat(F.lit("We built and shipped: "), F.replace("content", F.lit("\n"), F.lit(", "))).alias("text"),
    )
    nodes = fx.part_entities(spark, root)
    return nodes, msgs, m.entity_mentions(msgs, nodes, ["message_id"])


_PARTS = """
pents AS (SELECT 't:' || p_name AS id, CASE WHEN noun IN ('anvil','bolt') THEN 'project' WHEN noun IN ('gear','gizmo') THEN 'tool'
   WHEN noun IN ('plate','ring') THEN 'concept' ELSE 'organization' END AS type, p_name AS name
  FROM (SELECT DISTINCT p_name, string_split(p_name, ' ')[-1] AS noun FROM part)),
sections AS (SELECT l_orderkey AS section_id, string_agg(p_name, chr(10) ORDER BY p_name) AS content
  FROM (SELECT DISTINCT l_orderkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY 1)
"""


@query("comention_edges")
def comention_edges(spark, root):
    _, msgs, ment = _named_parts(spark, root)
    return w.comention_edges(msgs, ment).groupBy("source_id", "target_id", "relationship", "category").agg(F.count("*").alias("n"))


o.SQL["comention_edges"] = f"""
WITH {_PARTS}, h AS (SELECT s.section_id, p.*, row_number() OVER (PARTITION BY section_id ORDER BY name, id) AS i FROM sections s JOIN pents p ON contains(content, name)),
pr AS (SELECT a.section_id, a.id AS source_id, b.id AS target_id, a.type AS ta, b.type AS tb, row_number() OVER (PARTITION BY a.section_id ORDER BY a.i, b.i) AS rn
  FROM h a JOIN h b ON a.section_id = b.section_id AND a.i < b.i),
x AS (SELECT *, CASE WHEN 'project' IN (ta, tb) AND 'tool' IN (ta, tb) THEN 'depends_on' WHEN 'project' IN (ta, tb) AND 'organization' IN (ta, tb) THEN 'owns' ELSE 'part_of' END AS relationship FROM pr WHERE rn <= 3)
SELECT source_id, target_id, relationship, CASE relationship WHEN 'depends_on' THEN 'functional' WHEN 'owns' THEN 'relational' ELSE 'structural' END AS category, count(*) AS n FROM x GROUP BY 1, 2, 3"""


@query("attach_claims")
def attach_claims(spark, root):
    nodes, msgs, ment = _mentions(spark, root)
    out = w.attach_claims(nodes, m.extract_claims(msgs), ment)
    claims = F.from_json(F.try_element_at("attributes", F.lit("factual_claims")), "array<string>")
    return out.select("id", F.array_join(claims, "|").alias("claims")).filter("claims IS NOT NULL")


o.SQL["attach_claims"] = f"""
WITH {_MENTIONS}, c AS (SELECT m.message_id, m.seq, list_concat({', '.join(f"regexp_extract_all(text, {o.lit(p)})" for p in _RE2_CLAIMS)}) AS cl FROM messages m),
x AS (SELECT node_id, c.seq, unnest(cl) AS claim, generate_subscripts(cl, 1) AS pos FROM c JOIN mentions k ON k.message_id = c.message_id WHERE node_id IS NOT NULL),
f AS (SELECT node_id, claim, min(seq * 1000 + pos) AS at0 FROM x GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY at0 DESC) AS rn FROM f)
SELECT node_id AS id, string_agg(claim, '|' ORDER BY at0) AS claims FROM r WHERE rn <= 20 GROUP BY 1"""


@query("message_identity")
def message_identity(spark, root):
    routed = w.route_table(_routed(spark, root)).filter("target = 'identity'")
    return w.to_identity(routed).select(
        "category", "key", F.get_json_object("value", "$.text").alias("text"), *_r("confidence")
    )


_ROUTED_ROWS = f"{_ROUTED}, rr AS (SELECT *, unnest(string_split({_ROUTES}, ',')) AS route FROM routed WHERE NOT (length(text) < 20 AND ne = 0))"
o.SQL["message_identity"] = f"""
WITH {_ROUTED_ROWS} SELECT CASE WHEN intent='feedback' THEN 'capability' ELSE 'emotional' END AS category, intent || '_' || strftime(ts, '%Y-%m-%d') AS key,
  arg_max(substring(text, 1, 500), (ts, message_id)) AS text, round(max(CASE WHEN arousal > 0.5 THEN 0.9 ELSE 0.6 END)::DOUBLE, 6) AS confidence
FROM rr WHERE route = 'identity' AND (valence <> 0 OR intent = 'feedback') GROUP BY 1, 2"""


@query("message_procedures")
def message_procedures(spark, root):
    routed = w.route_table(_routed(spark, root)).filter("target = 'procedural'")
    return w.to_procedures(routed).select("message_id", "trigger", "action", "source")


o.SQL["message_procedures"] = f"""
WITH {_ROUTED_ROWS} SELECT message_id, substring(text, 1, 200) AS trigger, 'follow_directive' AS action, sender AS source FROM rr WHERE route = 'procedural'"""


@query("route_table")
def route_table(spark, root):
    return w.route_table(_routed(spark, root)).groupBy("route", "target").agg(F.count("*").alias("n"))


o.SQL["route_table"] = f"""
WITH {_ROUTED_ROWS} SELECT route, CASE WHEN route='relational' THEN 'episodic' ELSE route END AS target, count(*) AS n FROM rr WHERE route <> '' GROUP BY 1
UNION ALL SELECT 'skipped', 'skipped', count(*) FROM routed WHERE length(text) < 20 AND ne = 0 HAVING count(*) > 0"""


@query("router_stats")
def router_stats(spark, root):
    msgs = m.understand(_entity_messages(spark, root))
    ment = m.entity_mentions(msgs, fx.nodes(spark, root, embeddings=False), ["message_id"])
    routed = w.route_table(m.routes(m.with_entities(msgs, ment, ["message_id"])))
    return w.router_stats(routed, w.comention_edges(msgs, ment), ment)


o.SQL["router_stats"] = f"""
WITH {_ROUTED_ROWS}, sem AS (SELECT DISTINCT message_id FROM rr WHERE route='semantic'), res AS (SELECT message_id, count(*) AS k FROM mentions WHERE node_id IS NOT NULL GROUP BY 1)
SELECT (SELECT count(DISTINCT message_id) FROM rr WHERE route <> '') AS messages_routed, (SELECT count(*) FROM rr WHERE route IN ('episodic','relational')) AS episodes_created,
 (SELECT count(*) FROM mentions WHERE message_id IN (SELECT message_id FROM sem)) AS nodes_upserted,
 (SELECT coalesce(sum(least(3, k * (k - 1) // 2)), 0)::BIGINT FROM res WHERE message_id IN (SELECT message_id FROM sem)) AS edges_created"""


# --- enrichment ---------------------------------------------------------------------------
def _episodes_all(spark, root):
    """Documents and customer-signed event messages as episodes."""
    docs = fx.episodes_doc(spark, root, embeddings=False).drop("doc_id")
    msgs = _entity_messages(spark, root).select(
        F.concat(F.lit("m"), F.col("message_id").cast("string")).alias("id"), F.col("ts").alias("created_at"), "session_id",
        F.concat(F.lit("note "), F.col("message_id").cast("string")).alias("summary"), F.col("text").alias("narrative"),
        fx.no_strings().alias("participants"), fx.no_strings().alias("topics"), F.lit(0.5).alias("importance_score"),
        F.lit(0).alias("access_count"), F.lit(False).alias("decay_protected"),
    )
    return docs.unionByName(msgs)


_EPISODES_ALL = f"""{_ENTITY_MESSAGES}, {o.EPISODES}, alls AS (SELECT id, summary || chr(10) || narrative AS text, participants FROM episodes
  UNION ALL SELECT 'm' || message_id, 'note ' || message_id || chr(10) || text, [] FROM messages)"""


@query("participants")
def participants(spark, root):
    return e.participants(_episodes_all(spark, root), fx.nodes(spark, root, embeddings=False))


o.SQL["participants"] = f"""
WITH {_EPISODES_ALL} SELECT DISTINCT id, lower(c_name) AS person FROM alls JOIN customer ON contains(lower(text), lower(c_name))
WHERE regexp_matches(lower(text), '\\b' || lower(c_name) || '\\b')"""


def _phrases_sql(patterns, longer, cap=None):
    pats = [p.replace("\\z", "$") for p in patterns]
    joined = ", ".join(f"regexp_extract_all(text, {o.lit(p)}, 1)" for p in pats)
    inner = (
        f"list_filter(list_transform(list_concat({joined}), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: length(x) > {longer})"
    )
    return inner, cap


def _phrase_query(name, patterns, longer, cap, fn):
    def run(spark, root):
        return _episodes_all(spark, root).select("id", F.array_join(fn(e.episode_text()), "|").alias("found"))

    query(name)(run)
    inner, _ = _phrases_sql(patterns, longer)
    cut = f"[1:{cap}]" if cap else ""
    o.SQL[name] = f"""
WITH {_EPISODES_ALL}, a AS (SELECT id, {inner} AS l FROM alls),
b AS (SELECT id, list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i) AS l FROM a)
SELECT id, array_to_string(l{cut}, '|') AS found FROM b"""


_phrase_query("decisions", lx.DECISION_PHRASES, 10, None, e.decisions)
_phrase_query("commitments", lx.COMMITMENT_PHRASES, 10, 10, e.commitments)
_phrase_query("lessons_in", lx.LESSON_PHRASES, 15, 5, e.lessons_in)


@query("episode_topics")
def episode_topics(spark, root):
    return _episodes_all(spark, root).select("id", F.array_join(e.topics(e.episode_text()), ",").alias("topics"))


_TOPICS = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {o.rx('text', p)} THEN {o.lit(l)} END" for p, l in lx.EPISODE_TOPICS) + "], lambda x: x IS NOT NULL), ',')"
o.SQL["episode_topics"] = f"WITH {_EPISODES_ALL} SELECT id, {_TOPICS} AS topics FROM alls"


@query("emotional_arc")
def emotional_arc(spark, root):
    df = _episodes_all(spark, root).select("id", e.episode_text().alias("text"))
    return e.emotional_arc(df, "text").select(
        "id", F.round("emotion.valence", 6).alias("valence"), F.round("emotion.arousal", 6).alias("arousal"),
        F.round("emotion.arc.start.valence", 6).alias("v1"), F.round("emotion.arc.end.valence", 6).alias("v2"),
        F.col("emotion.arc.trajectory").alias("trajectory"), F.col("emotion.arc.end.label").alias("end_label"),
        F.round("emotion.peak.valence", 6).alias("peak"), F.col("emotion.peak.label").alias("label"),
    )


def _valence(c):
    p, n = o.count_contained(c, lx.EPISODE_POSITIVE), o.count_contained(c, lx.EPISODE_NEGATIVE)
    return f"({p} - {n}) / greatest({p} + {n}, 1)::DOUBLE"


def _label(v, a):
    return f"""CASE WHEN {v} > .5 AND {a} > .5 THEN 'breakthrough_joy' WHEN {v} > .3 AND {a} > .3 THEN 'excited_progress' WHEN {v} > .3 THEN 'quiet_satisfaction'
 WHEN {v} > 0 AND {a} <= .3 THEN 'calm_positive' WHEN {v} < -.5 AND {a} > .5 THEN 'crisis_stress' WHEN {v} < -.3 AND {a} > .3 THEN 'frustrated_stuck'
 WHEN {v} < -.3 THEN 'quiet_disappointment' WHEN {v} < 0 AND {a} <= .3 THEN 'mild_concern' WHEN {a} > .6 THEN 'high_energy_neutral' ELSE 'neutral_steady' END"""


_ARC = f"""
w0 AS (SELECT id, text, lower(text) AS low, regexp_split_to_array(lower(text), '\\s+') AS ws FROM alls),
w1 AS (SELECT *, array_to_string(ws[1:len(ws) // 2], ' ') AS h1, array_to_string(ws[len(ws) // 2 + 1:], ' ') AS h2 FROM w0),
w2 AS (SELECT id, text, {_valence('low')} AS v, least({o.count_contained('low', lx.EPISODE_AROUSAL)} * 0.15::DOUBLE + 0.2::DOUBLE, 1.0) AS a, {_valence('h1')} AS v1, {_valence('h2')} AS v2 FROM w1)
"""
o.SQL["emotional_arc"] = f"""
WITH {_EPISODES_ALL}, {_ARC} SELECT id, round(v, 6) AS valence, round(a, 6) AS arousal, round(v1, 6) AS v1, round(v2, 6) AS v2,
  CASE WHEN v2 - v1 > .3 THEN 'ascending' WHEN v2 - v1 < -.3 THEN 'descending' ELSE 'stable' END AS trajectory, {_label('v2', 'a')} AS end_label,
  round(greatest(abs(v1), abs(v2)) * sign(v), 6) AS peak, {_label('v', 'a')} AS label FROM w2"""


@query("trajectory_histogram")
def trajectory_histogram(spark, root):
    from engram.operators.tables import trajectory_histogram as histogram

    felt = e.emotional_arc(_episodes_all(spark, root).withColumn("text", e.episode_text()), "text")
    return histogram(felt.select(F.col("emotion.arc").alias("arc")))


o.SQL["trajectory_histogram"] = f"""
WITH {_EPISODES_ALL}, {_ARC} SELECT CASE WHEN v2 - v1 > .3 THEN 'ascending' WHEN v2 - v1 < -.3 THEN 'descending' ELSE 'stable' END AS trajectory, count(*) AS n FROM w2 GROUP BY 1"""


@query("enrich_episodes")
def enrich_episodes(spark, root):
    out, _ = e.enrich(_episodes_all(spark, root), fx.nodes(spark, root, embeddings=False), vip="customer#000000001")
    return out.select("id", *_r("importance_score"), "decay_protected", F.size("participants").cast("bigint").alias("people"))


def _n(patterns, longer, cap=None):
    inner, _ = _phrases_sql(patterns, longer)
    n = f"len(list_distinct(list_transform({inner}, lambda x: lower(x))))"
    return f"least({cap}, {n})" if cap else n


_IMP = f"""
n0 AS (SELECT a.*, {_n(lx.DECISION_PHRASES, 10)} AS nd, {_n(lx.COMMITMENT_PHRASES, 10, 10)} AS nc, {_n(lx.LESSON_PHRASES, 15, 5)} AS nl,
  len(regexp_extract_all(text, {o.lit(lx.EPISODE_MONEY)})) AS nm FROM alls a),
pp AS (SELECT id, count(DISTINCT lower(c_name)) AS np, bool_or(lower(c_name) = 'customer#000000001') AS vip FROM alls JOIN customer ON contains(lower(text), lower(c_name))
   WHERE regexp_matches(lower(text), '\\b' || lower(c_name) || '\\b') GROUP BY 1),
n1 AS (SELECT n0.*, np, least(1.0::DOUBLE, 0.3::DOUBLE + least(nm * 0.1::DOUBLE, 0.2) + CASE WHEN vip THEN 0.15 ELSE 0 END + least(nd * 0.1::DOUBLE, 0.2) + least(nc * 0.05::DOUBLE, 0.1)
  + least(nl * 0.1::DOUBLE, 0.15) + CASE WHEN length(text) > 500 THEN 0.05 ELSE 0 END + CASE WHEN length(text) > 2000 THEN 0.05 ELSE 0 END
  + CASE WHEN {o.contains_any('lower(text)', lx.EPISODE_EMOTION_WORDS)} THEN 0.05 ELSE 0 END + CASE WHEN {o.contains_any('lower(text)', lx.EPISODE_PRIORITY_WORDS)} THEN 0.05 ELSE 0 END) AS imp
  FROM n0 LEFT JOIN pp USING (id))
"""
o.SQL["enrich_episodes"] = f"""
WITH {_EPISODES_ALL}, {_IMP} SELECT id, round(imp, 6) AS importance_score, imp >= 0.8 OR nd > 0 OR nl > 0 AS decay_protected, coalesce(np, len(participants)) AS people FROM n1"""


@query("enrich_counters")
def enrich_counters(spark, root):
    _, stats = e.enrich(_episodes_all(spark, root), fx.nodes(spark, root, embeddings=False), vip="customer#000000001")
    return stats.select("episodes_processed", "participants_added", "decisions_found", "commitments_found", "lessons_found", *_r("avg_importance"))


o.SQL["enrich_counters"] = f"""
WITH {_EPISODES_ALL}, {_IMP} SELECT count(*) AS episodes_processed, sum(coalesce(np, 0))::BIGINT AS participants_added, sum(nd)::BIGINT AS decisions_found,
  sum(nc)::BIGINT AS commitments_found, sum(nl)::BIGINT AS lessons_found, round(avg(imp), 6) AS avg_importance FROM n1"""


@query("link_related")
def link_related(spark, root):
    return e.link_related(fx.episodes_doc(spark, root, embeddings=False))


_KEYS = "k AS (SELECT DISTINCT id, session_id AS p, unnest(topics) AS t FROM episodes)"
o.SQL["link_related"] = f"""
WITH {o.EPISODES}, {_KEYS} SELECT DISTINCT a.id AS a_id, b.id AS b_id FROM k a JOIN k b ON a.p = b.p AND a.t = b.t AND a.id < b.id ORDER BY 1, 2 LIMIT 5000"""


@query("link_related_again")
def link_related_again(spark, root):
    """A second run: episodes whose numbers follow each other are linked already."""
    ep = fx.episodes_doc(spark, root, embeddings=False)
    links = ep.select(F.col("id").alias("episode_id"), (F.col("doc_id") + 1).cast("string").alias("related_id"))
    pairs = e.link_related(ep, links, limit=3000)
    return e.symmetric_links(pairs)


o.SQL["link_related_again"] = f"""
WITH {o.EPISODES}, {_KEYS}, pr AS (SELECT DISTINCT a.id AS a_id, b.id AS b_id FROM k a JOIN k b ON a.p = b.p AND a.t = b.t AND a.id < b.id
  WHERE abs(CAST(a.id AS BIGINT) - CAST(b.id AS BIGINT)) <> 1 ORDER BY 1, 2 LIMIT 3000)
SELECT a_id AS episode_id, b_id AS related_id FROM pr UNION ALL SELECT b_id, a_id FROM pr"""


@query("link_entities")
def link_entities(spark, root):
    orders, customer = fx.table(spark, root, "orders"), fx.table(spark, root, "customer")
    ep = orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").cast("string").alias("id"), F.array(F.upper("c_name"), F.lit("nobody")).alias("participants")
    )
    return e.link_entities(ep, fx.nodes(spark, root, embeddings=False)).select("episode_id", "entity_id")


o.SQL["link_entities"] = "SELECT CAST(o_orderkey AS VARCHAR) AS episode_id, 'c' || o_custkey AS entity_id FROM orders JOIN customer ON c_custkey = o_custkey"


# --- graph ------------------------------------------------------------------------------------
_UND = """und AS (SELECT source_id AS src, target_id AS dst, relationship, strength FROM edges UNION ALL SELECT target_id, source_id, relationship, strength FROM edges WHERE source_id <> target_id)"""


def _stored_edges(spark, root):
    """The derived edges are stored once, as they are in real use."""
    return stored(fx.edges(spark, root).select("source_id", "target_id", "relationship", "strength"), "edges")


@query("traverse_two_hop")
def traverse_two_hop(spark, root):
    starts = fx.table(spark, root, "supplier").select(F.col("s_name").alias("name"), F.lit("organization").alias("type"))
    out = g.traverse(fx.nodes(spark, root, embeddings=False), _stored_edges(spark, root), starts, counted=True)
    return out.groupBy("start_name", "endpoint", "relationship", "depth").agg(F.sum("n").alias("n"))


o.SQL["traverse_two_hop"] = f"""
WITH {o.NODES}, {o.EDGES}, {_UND}, h1 AS (SELECT s.name AS start_name, d.name AS endpoint, upper(relationship) AS relationship, strength, dst,
   row_number() OVER (PARTITION BY s.name ORDER BY strength DESC, d.name, upper(relationship), dst) AS rn
  FROM nodes s JOIN und ON src = s.id AND src <> dst JOIN nodes d ON d.id = dst WHERE s.type = 'organization'),
h2 AS (SELECT start_name, d.name AS endpoint, h1.relationship || ' → ' || upper(u.relationship) AS relationship
  FROM h1 JOIN nodes mid ON mid.name = h1.endpoint JOIN und u ON u.src = mid.id JOIN nodes d ON d.id = u.dst WHERE rn <= 10 AND d.name <> start_name)
SELECT start_name, endpoint, relationship, 1::INTEGER AS depth, count(*) AS n FROM h1 GROUP BY 1, 2, 3
UNION ALL SELECT start_name, endpoint, relationship, 2, count(*) FROM h2 GROUP BY 1, 2, 3"""


@query("neighbors_of_type")
def neighbors_of_type(spark, root):
    wanted = fx.table(spark, root, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node_id"), F.lit("person").alias("node_type")
    )
    return g.neighbors_of_type(fx.edges(spark, root), fx.nodes(spark, root, embeddings=False), wanted).select(
        "node_id", "id", "name", *_r("strength")
    )


o.SQL["neighbors_of_type"] = f"""
WITH {o.NODES}, {o.EDGES}, {_UND} SELECT src AS node_id, d.id, d.name, round(max(strength), 6) AS strength FROM und JOIN nodes d ON d.id = dst AND d.type = 'person'
WHERE src IN (SELECT 's' || s_suppkey FROM supplier) GROUP BY 1, 2, 3"""
