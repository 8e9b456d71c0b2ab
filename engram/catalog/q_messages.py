"""Registered queries: message understanding (M1-M23) and vectors (V1-V4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.catalog import fixtures as fx
from engram.catalog import oracles as o
from engram.catalog.registry import query
from engram.functions import lexicons as lx
from engram.operators import messages as m
from engram.operators import vectors as v


def _r(*names):
    return [F.round(n, 6).alias(n) for n in names]


@query("knn_topk")
def knn_topk(spark, root):
    q = fx.queries_bm(spark, root)
    items = fx.table(spark, root, "embeddings")
    return v.knn(q, items, 10, 0.2, item_id="vec_id").select(
        "query_id", F.col("item_id").alias("vec_id"), *_r("similarity"), F.col("rank").cast("bigint").alias("rank")
    )


o.SQL["knn_topk"] = f"""
WITH {o.QUERIES}, s AS (
  SELECT query_id, vec_id, {o.cosine('q.embedding', 'e.embedding')} AS similarity
  FROM queries q, embeddings e WHERE q.embedding IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s WHERE similarity >= 0.2)
SELECT query_id, vec_id, round(similarity, 6) AS similarity, rank FROM r WHERE rank <= 10"""


@query("similar_pairs")
def similar_pairs(spark, root):
    pairs = v.similar_pairs(fx.table(spark, root, "embeddings"), 0.35, key="vec_id")
    return pairs.select("a", "b", *_r("similarity"))


o.SQL["similar_pairs"] = f"""
WITH f AS (SELECT embedding, min(vec_id) AS a FROM embeddings GROUP BY embedding)
SELECT x.a AS a, y.a AS b, round({o.cosine('x.embedding', 'y.embedding')}, 6) AS similarity
FROM f x JOIN f y ON x.a < y.a WHERE {o.cosine('x.embedding', 'y.embedding')} > 0.35
UNION ALL SELECT f.a, e.vec_id, 1.0 FROM embeddings e JOIN f ON e.embedding = f.embedding WHERE e.vec_id <> f.a"""


@query("embedding_coverage")
def embedding_coverage(spark, root):
    return v.embedding_coverage(fx.episodes_doc(spark, root)).select("n", "with_embedding", *_r("coverage"))


o.SQL["embedding_coverage"] = f"""
WITH {o.EPISODES} SELECT count(*) AS n, count(embedding) AS with_embedding,
  round(avg(CASE WHEN embedding IS NULL THEN 0.0 ELSE 1.0 END), 6) AS coverage FROM episodes"""


@query("sensory_input_type")
def input_type(spark, root):
    return m.classify_input(fx.messages_ev(spark, root)).select("message_id", "input_type")


o.SQL["sensory_input_type"] = f"""
WITH {o.MESSAGES_EV} SELECT message_id, CASE WHEN sender IN ('system','heartbeat') THEN 'system_event'
  WHEN sender='tool' OR starts_with(text,'{{') OR starts_with(text,'```') THEN 'tool_output'
  WHEN sender IN ('agent','self') THEN 'reflection' ELSE 'conversation' END AS input_type FROM messages"""


@query("claims")
def claims(spark, root):
    return m.extract_claims(fx.messages_ev(spark, root)).select(
        "message_id", F.array_join("claims", "|").alias("claims")
    )


_RE2_CLAIMS = [lx.CLAIM_MONEY, lx.CLAIM_PERCENT, lx.CLAIM_DATE, lx.CLAIM_COUNT]
o.SQL["claims"] = f"""
WITH {o.MESSAGES_EV} SELECT message_id, array_to_string(list_concat({', '.join(f"regexp_extract_all(text, {o.lit(p)})" for p in _RE2_CLAIMS)}), '|') AS claims FROM messages"""

_SENT = f"""
sent AS (SELECT *, {o.count_contained('lower(text)', lx.MESSAGE_POSITIVE)} AS p, {o.count_contained('lower(text)', lx.MESSAGE_NEGATIVE)} AS n,
  {o.count_contained('lower(text)', lx.MESSAGE_EXCITEMENT)} AS e, {o.count_contained('lower(text)', lx.MESSAGE_HUMOR)} AS h,
  length(text) - length(replace(text, '!', '')) AS bang FROM messages),
emo AS (SELECT *, (p - n) / greatest(p + n, 1)::DOUBLE AS valence, least(1.0, e * 0.3 + bang * 0.1)::DOUBLE AS arousal,
  list_filter([CASE WHEN p > 2 THEN 'joy' END, CASE WHEN e > 1 THEN 'excitement' END, CASE WHEN n > 2 THEN 'frustration' END,
   CASE WHEN h > 0 THEN 'humor' END, CASE WHEN {o.contains_any('lower(text)', ['thank', 'appreciate', 'grateful'])} THEN 'gratitude' END,
   CASE WHEN {o.contains_any('lower(text)', ['worried', 'concerned'])} THEN 'concern' END,
   CASE WHEN {o.contains_any('lower(text)', ['proud', 'amazing work'])} THEN 'pride' END,
   CASE WHEN e > 0 AND p > 0 THEN 'determination' END], lambda x: x IS NOT NULL) AS emo0 FROM sent),
felt AS (SELECT *, CASE WHEN len(emo0) = 0 THEN ['neutral'] ELSE emo0 END AS emotions FROM emo)
"""


@query("sensory_sentiment")
def sensory_sentiment(spark, root):
    return m.sentiment(fx.messages_ev(spark, root)).select(
        "message_id", F.col("positive").cast("bigint").alias("positive"),
        F.col("negative").cast("bigint").alias("negative"), *_r("valence", "arousal"),
        F.array_join("emotions", ",").alias("emotions"), "dominant",
    )


o.SQL["sensory_sentiment"] = f"""
WITH {o.MESSAGES_EV}, {_SENT} SELECT message_id, p::BIGINT AS positive, n::BIGINT AS negative, round(valence, 6) AS valence,
  round(arousal, 6) AS arousal, array_to_string(emotions, ',') AS emotions, emotions[1] AS dominant FROM felt"""

_URG = f"""CASE WHEN bang > 2 THEN least(1.0, u1 + 0.1) ELSE u1 END"""


@query("sensory_urgency")
def sensory_urgency(spark, root):
    return m.urgency(fx.messages_ev(spark, root)).select("message_id", *_r("urgency"))


o.SQL["sensory_urgency"] = f"""
WITH {o.MESSAGES_EV}, b AS (SELECT *, length(text) - length(replace(text, '!', '')) AS bang,
  CASE WHEN {o.contains_any('lower(text)', lx.URGENCY_HIGH)} THEN 0.85 WHEN {o.contains_any('lower(text)', lx.URGENCY_MEDIUM)} THEN 0.5 ELSE 0.2 END AS u0 FROM messages),
c AS (SELECT *, CASE WHEN length(text) > 10 AND text = upper(text) THEN least(1.0, u0 + 0.2) ELSE u0 END AS u1 FROM b)
SELECT message_id, round({_URG}::DOUBLE, 6) AS urgency FROM c"""

_INTENT = (
    "CASE "
    + " ".join(
        f"WHEN {o.rx_any('text', [p.replace(chr(92) + 'z', '$') for p in ps], '(?i)')} THEN {o.lit(name)}"
        for name, ps in lx.INTENT_FAMILIES
    )
    + " ELSE 'inform' END"
)


@query("sensory_intent")
def sensory_intent(spark, root):
    return m.intent(fx.messages_ev(spark, root)).select("message_id", "intent")


o.SQL["sensory_intent"] = f"WITH {o.MESSAGES_EV} SELECT message_id, {_INTENT} AS intent FROM messages"

_CORE = (
    "core(id, type, name, pos, term) AS (VALUES "
    + ", ".join(
        f"(NULL::VARCHAR, {o.lit(t)}, {o.lit(ns[0])}, {i}, {o.lit(n)})"
        for ns, t in lx.CORE_ENTITIES
        for i, n in enumerate(ns)
    )
    + ")"
)
_TERMS = f"""
{_CORE},
dict AS (SELECT * FROM core UNION ALL SELECT id, type, lower(name), 0, lower(name) FROM nodes
  WHERE lower(name) NOT IN (SELECT term FROM core)),
hits AS (SELECT m.*, d.type AS etype, d.name AS entity, d.id AS node_id, d.pos, d.term,
  instr(lower(m.text), d.term) - 1 AS at0 FROM messages m JOIN dict d ON length(d.term) >= 3 AND contains(lower(m.text), d.term)),
ment AS (SELECT *, row_number() OVER (PARTITION BY message_id, entity ORDER BY pos, node_id, etype) AS rn,
   trim(substring(text, greatest(0, at0 - 50) + 1, least(length(text), at0 + length(term) + 50) - greatest(0, at0 - 50))) AS context FROM hits),
mentions AS (SELECT * FROM ment WHERE rn = 1)
"""


def _entity_messages(spark, root):
    """Every event message, signed with the customer and a part it names."""
    msgs = fx.messages_ev(spark, root)
    customer = fx.table(spark, root, "customer").select(F.col("c_custkey").cast("string").alias("session_id"), "c_name")
    return msgs.join(customer, "session_id", "left").withColumn(
        "text", F.concat(F.col("text"), F.lit(" for "), F.coalesce("c_name", F.lit("nobody")))
    ).drop("c_name")


_ENTITY_MESSAGES = o.MESSAGES_EV.replace("messages AS", "raw AS") + """,
messages AS (SELECT r.* REPLACE (text || ' for ' || coalesce(c_name, 'nobody') AS text) FROM raw r
  LEFT JOIN customer ON CAST(c_custkey AS VARCHAR) = session_id)
"""


@query("entities")
def entities(spark, root):
    nodes = fx.nodes(spark, root, embeddings=False)
    return m.entity_mentions(_entity_messages(spark, root), nodes, ["message_id"]).select(
        "message_id", "entity", "entity_type", "node_id", "context"
    )


o.SQL["entities"] = f"""
WITH {_ENTITY_MESSAGES}, {o.NODES}, {_TERMS} SELECT message_id, entity, etype AS entity_type, node_id, context FROM mentions"""


@query("entities_ranked")
def entities_ranked(spark, root):
    nodes = fx.nodes(spark, root, embeddings=False)
    return m.ranked_mentions(_entity_messages(spark, root), nodes, ["message_id"]).select(
        "message_id", "entity", "entity_type", "node_id", "matched_on"
    )


o.SQL["entities_ranked"] = f"""
WITH {_ENTITY_MESSAGES}, {o.NODES}, h AS (
 SELECT message_id, name AS entity, type AS entity_type, id AS node_id, 'name' AS matched_on,
  row_number() OVER (PARTITION BY message_id, name ORDER BY confidence DESC, id) AS rn
 FROM messages JOIN nodes ON length(name) >= 3 AND contains(lower(text), lower(name)))
SELECT message_id, entity, entity_type, node_id, matched_on FROM h WHERE rn = 1"""


def _routed(spark, root):
    msgs = m.understand(_entity_messages(spark, root))
    ment = m.entity_mentions(msgs, fx.nodes(spark, root, embeddings=False), ["message_id"])
    return m.routes(m.with_entities(msgs, ment, ["message_id"]))


_ROUTES = """array_to_string(list_filter([
  CASE WHEN ne > 0 THEN 'episodic' END, CASE WHEN intent IN ('inform','decision','directive') THEN 'semantic' END,
  CASE WHEN intent = 'feedback' THEN 'identity' END, CASE WHEN intent = 'emotional' THEN 'relational' END,
  CASE WHEN ne = 0 AND intent IN ('request','decision','feedback','emotional') THEN 'episodic' END,
  CASE WHEN intent = 'emotional' AND (list_contains(emotions,'gratitude') OR list_contains(emotions,'pride')) THEN 'identity' END,
  CASE WHEN intent = 'directive' THEN 'procedural' END], lambda x: x IS NOT NULL), ',')"""
_ROUTED = f"""{_ENTITY_MESSAGES}, {o.NODES}, {_TERMS}, {_SENT},
routed AS (SELECT f.*, {_INTENT} AS intent, coalesce(k.ne, 0) AS ne FROM felt f
  LEFT JOIN (SELECT message_id, count(*) AS ne FROM mentions GROUP BY 1) k USING (message_id))"""


@query("sensory_routes")
def sensory_routes(spark, root):
    return _routed(spark, root).select("message_id", "intent", F.array_join("routes", ",").alias("routes"))


o.SQL["sensory_routes"] = f"WITH {_ROUTED} SELECT message_id, intent, {_ROUTES} AS routes FROM routed"


@query("quality_gate")
def quality_gate(spark, root):
    msgs = fx.messages_ev(spark, root)
    ment = m.entity_mentions(msgs, fx.nodes(spark, root, embeddings=False), ["message_id"])
    gated = m.quality_gate(m.with_entities(msgs, ment, ["message_id"]))
    return gated.groupBy("skipped").agg(F.count("*").alias("n"))


o.SQL["quality_gate"] = f"""
WITH {o.MESSAGES_EV}, {o.NODES}, {_TERMS}
SELECT length(text) < 20 AND message_id NOT IN (SELECT message_id FROM mentions) AS skipped, count(*) AS n FROM messages GROUP BY 1"""

_LIGHT_CLASS = (
    f"CASE WHEN contains(lower(text),'?') OR {o.rx('lower(text)', lx.LIGHT_QUESTION)} THEN 'question' "
    + " ".join(f"WHEN {o.rx('lower(text)', p)} THEN {o.lit(n)}" for n, _, p in lx.LIGHT_CLASSES)
    + " ELSE 'statement' END"
)
_LIGHT_INTENT = (
    "CASE "
    + " ".join(f"WHEN {o.rx('lower(text)', p)} THEN {o.lit(n)}" for n, _, p in lx.LIGHT_INTENTS)
    + " WHEN message_class='question' THEN 'query' WHEN message_class='reflection' THEN 'reflect' ELSE 'communicate' END"
)
_LIGHT = f"""
c0 AS (SELECT *, {_LIGHT_CLASS} AS message_class,
  ({o.count_contained('lower(text)', lx.LIGHT_POSITIVE)} - {o.count_contained('lower(text)', lx.LIGHT_NEGATIVE)}) * 0.15::DOUBLE AS s0 FROM messages),
c1 AS (SELECT *, greatest(-1.0, least(1.0, s0)) AS v0, {_LIGHT_INTENT} AS intent,
  round((0.3 + {o.count_contained('lower(text)', lx.LIGHT_URGENT)} * 0.2 + CASE WHEN message_class='directive' THEN 0.1 ELSE 0 END + CASE WHEN contains(text,'!') THEN 0.1 ELSE 0 END)::DOUBLE, 9) AS u0 FROM c0),
light AS (SELECT *, round(v0, 2) AS valence, CASE WHEN v0 > 0.2 THEN 'positive' WHEN v0 < -0.2 THEN 'negative' ELSE 'neutral' END AS sentiment_label,
  round(least(1.0, len(regexp_extract_all(text, '[!?🔥💪❤]')) * 0.15 + CASE WHEN length(text) > 200 THEN 0.3 ELSE 0.1 END)::DOUBLE, 2) AS arousal,
  round(least(1.0, u0), 2) AS urgency_score, CASE WHEN u0 > 0.7 THEN 'high' WHEN u0 > 0.4 THEN 'medium' ELSE 'low' END AS urgency_level FROM c1)
"""


@query("message_profile")
def message_profile(spark, root):
    return m.understand_light(fx.messages_ev(spark, root)).select(
        "message_id", "message_class", "valence", "arousal", "sentiment_label", "urgency_score", "urgency_level", "intent"
    )


o.SQL["message_profile"] = f"""
WITH {o.MESSAGES_EV}, {_LIGHT} SELECT message_id, message_class, valence, arousal, sentiment_label, urgency_score, urgency_level, intent FROM light"""


def _light_routed(spark, root):
    nodes = fx.nodes(spark, root, embeddings=False)
    msgs = m.understand_light(_entity_messages(spark, root))
    ment = m.ranked_mentions(msgs, nodes, ["message_id"])
    per = ment.groupBy("message_id").agg(
        F.collect_set("entity_type").alias("entity_types"),
        F.sort_array(F.collect_set("entity")).alias("entities"),
    )
    return m.message_importance(
        m.routes_simple(
            msgs.join(per, "message_id", "left").withColumns(
                {
                    "entity_types": F.coalesce("entity_types", fx.no_strings()),
                    "entities": F.coalesce("entities", fx.no_strings()),
                }
            )
        )
    )


@query("routes_simple")
def routes_simple(spark, root):
    return _light_routed(spark, root).select(
        "message_id", F.array_join("routes", ",").alias("routes"), *_r("importance_score"), "decay_protected"
    )


o.SQL["routes_simple"] = f"""
WITH {_ENTITY_MESSAGES}, {o.NODES}, {_LIGHT},
t AS (SELECT message_id, list(DISTINCT type) AS types, count(DISTINCT name) AS ne FROM messages JOIN nodes ON length(name) >= 3 AND contains(lower(text), lower(name)) GROUP BY 1),
j AS (SELECT l.*, coalesce(types, []) AS types, coalesce(ne, 0) AS ne FROM light l LEFT JOIN t USING (message_id)),
k AS (SELECT *, least(1.0, 0.3 + CASE WHEN intent='record_decision' THEN 0.4 ELSE 0 END + CASE WHEN intent='memory_write' THEN 0.3 ELSE 0 END
   + CASE WHEN abs(valence) > 0.3 THEN 0.2 ELSE 0 END + CASE WHEN ne > 2 THEN 0.1 ELSE 0 END)::DOUBLE AS imp FROM j)
SELECT message_id, array_to_string(list_filter(['semantic',
  CASE WHEN intent IN ('relational_query','preference_query') OR list_contains(types,'person') THEN 'relational' END,
  CASE WHEN intent IN ('memory_write','reflect','record_decision') THEN 'episodic' END,
  CASE WHEN intent IN ('create','fix','deploy') THEN 'procedural' END,
  CASE WHEN intent IN ('reflect','preference_query') THEN 'identity' END,
  CASE WHEN intent NOT IN ('memory_write','reflect','record_decision') AND (list_contains(types,'project') OR list_contains(types,'organization')) THEN 'episodic' END
  ], lambda x: x IS NOT NULL), ',') AS routes, round(imp, 6) AS importance_score, imp > 0.7 AS decay_protected FROM k"""

_GUARD_SQL = [p.replace("\\z", "$") for p in lx.GUARD_SKIP]
_VERDICT = f"""CASE WHEN {o.rx_any('text', _GUARD_SQL)} THEN 'system_message' WHEN length(text) < 15 THEN 'too_short'
  WHEN {o.rx_any('text', lx.GUARD_CREDENTIALS)} THEN 'contains_credentials' ELSE 'allowed' END"""


def _gate_sql(source: str, keys: str, micros: int) -> str:
    """Greedy gate by recursion over the distinct times of each key."""
    return f"""
times AS (SELECT DISTINCT {keys} AS key, epoch_us(ts) AS t FROM {source}),
nxt AS (SELECT key, t, (SELECT min(u.t) FROM times u WHERE u.key = times.key AND u.t >= times.t + {micros}) AS n FROM times),
heads AS (SELECT key, min(t) AS t FROM times GROUP BY key
  UNION ALL SELECT h.key, x.n FROM heads h JOIN nxt x ON x.key = h.key AND x.t = h.t WHERE x.n IS NOT NULL)"""


@query("guard_verdicts")
def guard_verdicts(spark, root):
    out = m.guard(fx.messages_ev(spark, root), ["session_id"], ["message_id"], seconds=3 * 3600)
    return out.select("message_id", "verdict", "clean_text")


o.SQL["guard_verdicts"] = f"""
WITH RECURSIVE {o.MESSAGES_EV}, v AS (SELECT *, {_VERDICT} AS v0 FROM messages), okay AS (SELECT * FROM v WHERE v0='allowed'),
{_gate_sql('okay', 'session_id', 3 * 3600 * 1000000)},
w AS (SELECT v.*, (SELECT max(h.t) FROM heads h WHERE h.key = v.session_id AND h.t <= epoch_us(v.ts)) AS last,
   (SELECT min(message_id) FROM okay k WHERE k.session_id = v.session_id AND k.ts = v.ts) AS first_id FROM v),
x AS (SELECT *, CASE WHEN v0='allowed' AND NOT (last = epoch_us(ts) AND first_id = message_id) THEN 'rate_limited'
  WHEN v0='contains_credentials' AND last IS NOT NULL AND epoch_us(ts) - last < 10800000000 THEN 'rate_limited' ELSE v0 END AS verdict FROM w)
SELECT message_id, verdict, CASE WHEN verdict='allowed' THEN substring(text, 1, 2000) END AS clean_text FROM x"""


@query("min_interval_gate")
def min_interval_gate(spark, root):
    out = m.min_interval_gate(fx.messages_conv(spark, root), ["session_id"], 5, ["seq"])
    return out.select("session_id", "seq", "accepted")


o.SQL["min_interval_gate"] = f"""
WITH RECURSIVE {o.MESSAGES_CONV}, {_gate_sql('messages', 'session_id', 5000000)}
SELECT session_id, seq, epoch_us(ts) IN (SELECT t FROM heads h WHERE h.key = session_id)
  AND seq = min(seq) OVER (PARTITION BY session_id, ts) AS accepted FROM messages"""


@query("rate_counter")
def rate_counter(spark, root):
    out = m.rate_counter(fx.messages_ev(spark, root), ["session_id"], ["message_id"], 86400, 3)
    return out.select(
        "message_id", F.col("n_in_window").cast("bigint").alias("n_in_window"), "allowed",
        F.coalesce(F.col("retry_after").cast("bigint"), F.lit(0)).alias("retry_after"),
    )


o.SQL["rate_counter"] = f"""
WITH RECURSIVE {o.MESSAGES_EV}, {_gate_sql('messages', 'session_id', 86400 * 1000000)},
w AS (SELECT m.*, (SELECT max(h.t) FROM heads h WHERE h.key = m.session_id AND h.t <= epoch_us(m.ts)) AS head FROM messages m),
x AS (SELECT *, row_number() OVER (PARTITION BY session_id, head ORDER BY ts, message_id) AS n_in_window FROM w)
SELECT message_id, n_in_window, n_in_window <= 3 AS allowed,
  CASE WHEN n_in_window > 3 THEN CAST(ceil((head + 86400000000 - epoch_us(ts)) / 1000000.0) AS BIGINT) ELSE 0 END AS retry_after FROM x"""


def _processed_conv(spark, root):
    msgs = m.filter_transcript(fx.messages_conv(spark, root))
    return m.understand(msgs)


_PROC = f"""kept AS (SELECT * REPLACE (CASE WHEN role='user' THEN 'User' ELSE 'Agent' END AS sender) FROM messages
  WHERE role NOT IN ('system','tool') AND length(text) >= 10 AND NOT starts_with(text,'{{') AND NOT starts_with(text,'['))"""
_SENT_KEPT = _SENT.replace("FROM messages", "FROM kept")


@query("transcript_filter")
def transcript_filter(spark, root):
    return m.filter_transcript(fx.messages_conv(spark, root), max_messages=5).select("session_id", "seq", "sender")


o.SQL["transcript_filter"] = f"""
WITH {o.MESSAGES_CONV.replace('FROM conversations', 'FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations) WHERE rn <= 5')}, {_PROC}
SELECT session_id, seq, sender FROM kept"""


@query("transcript_summary")
def transcript_summary(spark, root):
    return m.transcript_summary(m.understand(m.filter_transcript(fx.messages_ev(spark, root)))).select(
        "session_id", "messages", "claims", *_r("avg_valence", "avg_arousal"),
        F.array_join(F.transform("intents", lambda s: F.concat(s["intent"], F.lit(":"), s["n"].cast("string"))), ",").alias("intents"),
        F.array_join("top_emotions", ",").alias("top_emotions"),
    )


_RE2_COUNT = " + ".join(f"len(regexp_extract_all(text, {o.lit(p)}))" for p in _RE2_CLAIMS)
o.SQL["transcript_summary"] = f"""
WITH {o.MESSAGES_EV}, {_PROC}, {_SENT_KEPT}, z AS (SELECT *, {_INTENT} AS intent, {_RE2_COUNT} AS nc FROM felt),
i AS (SELECT session_id, string_agg(intent || ':' || n, ',' ORDER BY intent) AS intents FROM (SELECT session_id, intent, count(*) AS n FROM z GROUP BY 1, 2) GROUP BY 1),
e AS (SELECT session_id, emotion, n, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, emotion) AS rn FROM
  (SELECT session_id, emotion, count(*) AS n FROM (SELECT session_id, unnest(emotions) AS emotion FROM z) GROUP BY 1, 2)),
t AS (SELECT session_id, string_agg(emotion, ',' ORDER BY rn) AS top_emotions FROM e WHERE rn <= 5 GROUP BY 1)
SELECT b.*, intents, top_emotions FROM (SELECT session_id, count(*) AS messages, sum(nc)::BIGINT AS claims, round((CAST(sum(CAST(valence AS DECIMAL(38,15))) AS DOUBLE) / count(valence)), 6) AS avg_valence, round((CAST(sum(CAST(arousal AS DECIMAL(38,15))) AS DOUBLE) / count(arousal)), 6) AS avg_arousal FROM z GROUP BY 1) b
JOIN i USING (session_id) JOIN t USING (session_id)"""


@query("segment_episodes")
def segment_episodes(spark, root):
    msgs = m.understand(m.filter_transcript(_entity_messages(spark, root)))
    ment = m.entity_mentions(msgs, fx.nodes(spark, root, embeddings=False), ["message_id"])
    seg = m.segment_episodes(m.with_entities(msgs, ment, ["message_id"]))
    return seg.select(
        "session_id", "segment", "narrative", F.size("topics").cast("bigint").alias("n_topics"),
        *_r("importance_score", "valence", "arousal"), "trajectory",
    )


o.SQL["segment_episodes"] = f"""
WITH {_ENTITY_MESSAGES}, {_PROC}, {o.NODES}, {_TERMS}, {_SENT_KEPT},
n AS (SELECT f.*, (row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1) // 10 AS segment FROM felt f),
k AS (SELECT n.session_id, segment, count(DISTINCT entity) AS ne FROM n JOIN mentions USING (message_id) GROUP BY 1, 2),
g AS (SELECT session_id, segment, string_agg('[' || sender || '] ' || substring(text, 1, 500), chr(10) ORDER BY seq) AS nar, (CAST(sum(CAST(valence AS DECIMAL(38,15))) AS DOUBLE) / count(valence)) AS v, (CAST(sum(CAST(arousal AS DECIMAL(38,15))) AS DOUBLE) / count(arousal)) AS a FROM n GROUP BY 1, 2)
SELECT g.session_id, g.segment, substring(nar, 1, 4000) AS narrative, least(20, coalesce(ne, 0)) AS n_topics,
  round(least(1.0, 0.3 + coalesce(ne, 0) * 0.05)::DOUBLE, 6) AS importance_score, round(v, 6) AS valence, round(a, 6) AS arousal,
  CASE WHEN v > 0.3 THEN 'positive' WHEN v < -0.3 THEN 'negative' ELSE 'stable' END AS trajectory
FROM g LEFT JOIN k ON k.session_id = g.session_id AND k.segment = g.segment"""


@query("verify_mentioned")
def verify_mentioned(spark, root):
    from engram.operators.tables import verify_mentioned as verify

    nodes = fx.nodes(spark, root, embeddings=False)
    ment = m.entity_mentions(_entity_messages(spark, root), nodes, ["message_id"])
    return verify(nodes, ment, fx.EVENTS_AS_OF).select("id", "mentions", "last_verified")


o.SQL["verify_mentioned"] = f"""
WITH {_ENTITY_MESSAGES}, {o.NODES}, {_TERMS}, c AS (SELECT lower(entity) AS e, max(node_id) AS node_id, count(*) AS mentions FROM mentions GROUP BY 1)
SELECT n.id, coalesce(c.mentions, 0) AS mentions, CASE WHEN c.node_id IS NULL THEN n.last_verified ELSE TIMESTAMP '2024-01-31' END AS last_verified
FROM nodes n LEFT JOIN c ON c.node_id = n.id"""


@query("expand_entities")
def expand_entities(spark, root):
    nodes, edges = fx.nodes(spark, root, embeddings=False), fx.edges(spark, root)
    supplier = fx.table(spark, root, "supplier")
    rows = supplier.select(
        F.col("s_suppkey").alias("message_id"), F.array(F.upper("s_name")).alias("explicit"),
        F.array(F.concat(F.lit("nation_"), F.col("s_nationkey").cast("string"))).alias("implied"),
        F.when(F.col("s_suppkey") % 2 == 0, "person").otherwise("place").alias("implied_type"),
    )
    return m.expand_entities(rows, nodes, edges).select("message_id", "name", "type", "node_id", "matched_on")


o.SQL["expand_entities"] = f"""
WITH {o.NODES}, {o.EDGES}, x AS (SELECT s_suppkey AS message_id, 's' || s_suppkey AS sid, s_nationkey, CASE WHEN s_suppkey % 2 = 0 THEN 'person' ELSE 'place' END AS it FROM supplier),
u AS (SELECT source_id AS a, target_id AS b FROM edges UNION ALL SELECT target_id, source_id FROM edges),
r AS (SELECT message_id, sid AS id, 0 AS o, 'name' AS m FROM x
  UNION ALL SELECT message_id, n.id, 1, 'llm-inferred' FROM x JOIN u ON u.a = sid JOIN nodes n ON n.id = u.b AND n.type = it
  UNION ALL SELECT message_id, 'n' || s_nationkey, 2, 'llm-inferred' FROM x),
d AS (SELECT r.message_id, n.name, n.type, n.id AS node_id, m AS matched_on, row_number() OVER (PARTITION BY message_id, n.name ORDER BY o, n.id) AS rn FROM r JOIN nodes n ON n.id = r.id)
SELECT message_id, name, type, node_id, matched_on FROM d WHERE rn = 1"""
