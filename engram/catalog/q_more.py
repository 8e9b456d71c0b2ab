"""Registered queries: deeper walks, seeding, vectors that come back, logs and exports, weekly cycles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from engram.catalog import fixtures as fx
from engram.catalog import oracles as o
from engram.catalog import q_consolidation as qc
from engram.catalog import q_enrich as qe
from engram.catalog import q_maintenance as qm
from engram.catalog import q_retrieval as qr
from engram.catalog.q_messages import _INTENT, _r
from engram.catalog.q_tables import _EXECUTED, _IDENTITY, _executed, _persons
from engram.catalog.registry import query
from engram.functions.scores import cosine
from engram.operators import consolidation as c
from engram.operators import graph as g
from engram.operators import messages as m
from engram.operators import retrieval as r
from engram.operators import routing as w
from engram.operators import tables as t
from engram.operators import vectors as v
from engram.plans import cycles
from engram.plans.seed import seed_layers as seed
from engram.session import use_checkpoints
from engram.sources import tables as st
from engram.sources import transcripts as tr


def _folder(spark, name: str) -> str:
    use_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4()}"


# --- graph -------------------------------------------------------------------------
@query("traverse_three_hop")
def traverse_three_hop(spark, root):
    starts = fx.table(spark, root, "supplier").select(F.col("s_name").alias("name"), F.lit("organization").alias("type"))
    out = g.traverse(fx.nodes(spark, root, embeddings=False), qe._stored_edges(spark, root), starts, max_hops=3, counted=True)
    return out.groupBy("start_name", "endpoint", "relationship", "depth").agg(F.sum("n").alias("n"))


def _hop(k: int) -> str:
    """Hop k from the first ten rows of the hop before, by strength, name, chain, path and id."""
    fresh = "d.name <> start_name" if k == 2 else "NOT list_contains(h.path, d.name)"
    return f"""
h{k} AS (SELECT start_name, h.path || [d.name] AS path, h.chain || ' → ' || upper(u.relationship) AS chain, d.name AS endpoint, u.strength, u.dst FROM
  (SELECT *, row_number() OVER (PARTITION BY start_name ORDER BY strength DESC, endpoint, chain, path, dst) AS rn FROM h{k - 1}) h
  JOIN nodes mid ON mid.name = h.endpoint JOIN und u ON u.src = mid.id JOIN nodes d ON d.id = u.dst WHERE rn <= 10 AND {fresh})"""


o.SQL["traverse_three_hop"] = f"""
WITH {o.NODES}, {o.EDGES}, {qe._UND}, h1 AS (SELECT s.name AS start_name, [s.name, d.name] AS path, upper(relationship) AS chain, d.name AS endpoint, strength, dst
  FROM nodes s JOIN und ON src = s.id AND src <> dst JOIN nodes d ON d.id = dst WHERE s.type = 'organization'), {_hop(2)}, {_hop(3)}
SELECT start_name, endpoint, chain AS relationship, 1::INTEGER AS depth, count(*) AS n FROM h1 GROUP BY 1, 2, 3
UNION ALL SELECT start_name, endpoint, chain, 2, count(*) FROM h2 GROUP BY 1, 2, 3 UNION ALL SELECT start_name, endpoint, chain, 3, count(*) FROM h3 GROUP BY 1, 2, 3"""


# the capped greedy rule one pair after the other, as a recursion over the pairs in order
_RELATION = "CASE " + " ".join(f"WHEN ta = '{a}' AND tb = '{b}' THEN '{rel}:{cat}'" for a, b, rel, cat in qm.lx.INFERRED_RELATIONSHIP) + f" ELSE '{':'.join(qm.lx.INFERRED_DEFAULT)}' END"
_SKIP = " AND ".join(f"NOT (x.type = '{a}' AND y.type = '{b}')" for a, b in qm.lx.INFER_SKIP_PAIRS)
o.SQL["infer_edges"] = f"""
WITH RECURSIVE {qm._COOC}, types AS (SELECT id, type FROM pents), cand AS (SELECT a, b, n, x.type AS ta, y.type AS tb, row_number() OVER (ORDER BY n DESC, a, b) AS i
  FROM cooc JOIN types x ON x.id = a JOIN types y ON y.id = b WHERE n >= 3 AND {_SKIP}),
walk AS (SELECT 0::BIGINT AS i, CAST([] AS VARCHAR[]) AS ends, 0 AS taken, false AS ok
  UNION ALL SELECT cand.i, CASE WHEN fits THEN list_concat(ends, [s.a, s.b]) ELSE ends END, taken + CASE WHEN fits THEN 1 ELSE 0 END, fits
  FROM (SELECT walk.*, cand.i AS j, a, b, len(list_filter(ends, lambda e: e = a)) < 20 AND len(list_filter(ends, lambda e: e = b)) < 20 AS fits FROM walk JOIN cand ON cand.i = walk.i + 1 WHERE taken < 2000) s JOIN cand ON cand.i = s.j)
SELECT a AS source_id, b AS target_id, split_part({_RELATION}, ':', 1) AS relationship, split_part({_RELATION}, ':', 2) AS category, round(least(1.0, 0.3 + n * 0.05)::DOUBLE, 6) AS strength
FROM walk JOIN cand USING (i) WHERE ok"""


# --- vectors --------------------------------------------------------------------------
@query("knn_blocks")
def knn_blocks(spark, root):
    """The nearest vectors with more queries than one block takes."""
    near = v.knn(fx.queries_bm(spark, root), fx.table(spark, root, "embeddings"), 10, 0.2, item_id="vec_id", query_block=16)
    return near.select("query_id", F.col("item_id").alias("vec_id"), *_r("similarity"), F.col("rank").cast("bigint").alias("rank"))


o.SQL["knn_blocks"] = o.SQL["knn_topk"]


@query("cosine_next")
def cosine_next(spark, root):
    """Every vector beside the next one."""
    e = fx.table(spark, root, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


o.SQL["cosine_next"] = """
SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""


@query("lesson_vectors")
def lesson_vectors(spark, root):
    """Lessons matched by their vectors first, then by words."""
    e = fx.table(spark, root, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding")
    insights, lessons = fx.insights_doc(spark, root).join(e, "id", "left"), fx.lessons_bm(spark, root).join(e, "id", "left")
    return c.match_lessons(insights, lessons, 0.3)


o.SQL["lesson_vectors"] = f"""
WITH {qc._MATCH}, near AS (SELECT i.id, min(l.id) AS lesson_id FROM insights i JOIN embeddings a ON CAST(a.vec_id AS VARCHAR) = i.id, lessons l JOIN embeddings b ON CAST(b.vec_id AS VARCHAR) = l.id
  WHERE i.type = 'lesson' AND {o.cosine('a.embedding', 'b.embedding')} > 0.3 GROUP BY 1)
SELECT id, lesson_id FROM near UNION ALL SELECT id, lesson_id FROM match WHERE id NOT IN (SELECT id FROM near)"""


@query("attach_vectors")
def attach_vectors(spark, root):
    """Rows of the backlog with the vectors that a model gave for half of them."""
    e = fx.table(spark, root, "embeddings").select(F.col("vec_id").alias("v"), "embedding")
    episodes = fx.episodes_doc(spark, root).withColumn("embedding", F.when(F.col("doc_id") % 3 == 0, F.col("embedding")))
    lacking = c.embedding_backlog(episodes, fx.nodes(spark, root).limit(0), limit=None)
    answers = lacking.withColumn("v", F.col("id").cast("bigint")).filter("v % 2 = 0").join(e, "v").select("kind", "id", "embedding")
    return c.attach_vectors(episodes, "episode", answers).select("id", F.col("embedding").isNotNull().alias("embedded"), F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


o.SQL["attach_vectors"] = """
SELECT CAST(doc_id AS VARCHAR) AS id, embedding IS NOT NULL AND (doc_id % 3 = 0 OR doc_id % 2 = 0) AS embedded,
  CASE WHEN doc_id % 3 = 0 OR doc_id % 2 = 0 THEN round(embedding[1]::DOUBLE, 6) END AS first FROM documents LEFT JOIN embeddings ON vec_id = doc_id"""


# --- seeding ------------------------------------------------------------------------------
def _seeded(spark, root):
    nation, customer, part = (fx.table(spark, root, n) for n in ("nation", "customer", "part"))
    seeds = {
        "identity": nation.select(
            F.concat(F.lit("home-"), F.lower("n_name")).alias("key"), F.concat(F.lit("ships to "), F.col("n_name")).alias("value"),
            F.when(F.col("n_regionkey") < 2, "core").otherwise("preference").alias("category"), F.lit(0.8).alias("emotional_weight"), F.col("n_nationkey").alias("batch_order"),
        ),
        "persons": customer.select(
            F.concat(F.lit("Friend "), F.col("c_custkey").cast("string")).alias("name"), F.col("c_mktsegment").alias("relationship_type"),
            F.when(F.col("c_custkey") % 2 == 0, F.upper("c_name")).otherwise("nobody").alias("node_name"), F.col("c_custkey").alias("batch_order"),
        ),
        "procedures": part.select(
            F.concat(F.lit("make "), F.col("p_name")).alias("name"), F.when(F.col("p_size") > 25, "technical").otherwise("social").alias("type"),
            F.array("p_brand").alias("trigger_phrases"), F.array("p_type").alias("steps"), F.lit(0.6).alias("confidence"), F.col("p_partkey").alias("batch_order"),
        ),
    }
    tables = {
        "nodes": fx.nodes(spark, root, embeddings=False), "persons": _persons(spark, root),
        "identity": fx.identity_rows(spark).withColumn("last_affirmed", F.lit(None).cast("timestamp")), "procedures": fx.procedures_ev(spark, root),
    }
    return seed(tables, seeds, fx.ORDERS_AS_OF)


@query("seed_layers")
def seed_layers(spark, root):
    after, _ = _seeded(spark, root)
    one = after["identity"].select(F.lit("identity").alias("layer"), F.col("key").alias("name"), "category", F.col("times_affirmed").cast("bigint").alias("n"))
    two = after["persons"].select(F.lit("persons").alias("layer"), "name", F.col("semantic_node_id").alias("category"), F.col("total_interactions").alias("n"))
    three = after["procedures"].select(F.lit("procedures").alias("layer"), "name", F.col("type").alias("category"), F.size("steps").cast("bigint").alias("n"))
    return one.unionByName(two).unionByName(three)


o.SQL["seed_layers"] = f"""
WITH {_IDENTITY}, {qc._PROCS}, mk AS (SELECT 'make ' || p_name AS name, arg_max(CASE WHEN p_size > 25 THEN 'technical' ELSE 'social' END, p_partkey) AS type FROM part GROUP BY 1)
SELECT 'identity' AS layer, key AS name, category, CAST(times_affirmed AS BIGINT) AS n FROM identity
UNION ALL SELECT 'identity', 'home-' || lower(n_name), CASE WHEN n_regionkey < 2 THEN 'core' ELSE 'preference' END, 0 FROM nation
UNION ALL SELECT 'persons', c_name, NULL, 1 FROM customer UNION ALL SELECT 'persons', 'Friend ' || c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'c' || c_custkey END, 1 FROM customer
UNION ALL SELECT 'procedures', name, type, 1 FROM mk UNION ALL SELECT 'procedures', name, type, 2 FROM procs WHERE event_type IN (SELECT event_type FROM events)"""


@query("seed_counts")
def seed_counts(spark, root):
    return _seeded(spark, root)[1]


o.SQL["seed_counts"] = """
SELECT 'identity' AS layer, CASE WHEN n_regionkey < 2 THEN 'core' ELSE 'preference' END AS category, count(*) AS seeded FROM nation GROUP BY 2
UNION ALL SELECT 'persons', CASE WHEN c_custkey % 2 = 0 THEN 'linked' ELSE 'alone' END, count(*) FROM customer GROUP BY 2
UNION ALL SELECT 'procedures', CASE WHEN p_size > 25 THEN 'technical' ELSE 'social' END, count(*) FROM part GROUP BY 2"""


# --- sources, logs, exports ----------------------------------------------------------------
@query("memory_table")
def memory_table(spark, root):
    """A stored version read back with a filter and two columns."""
    folder = _folder(spark, "memory")
    st.write_version(fx.nodes(spark, root, embeddings=False), folder, "nodes", "v1")
    st.publish(spark, folder, "v1", {"nodes": "v1"})
    return st.read_current(spark, folder)["nodes"].filter("type = 'person' and confidence > 0.5").select("id", "name")


o.SQL["memory_table"] = f"WITH {o.NODES} SELECT id, name FROM nodes WHERE type = 'person' AND confidence > 0.5"


def _transcript_lines(spark, root):
    """Conversations as JSON lines: parts in a list, plain text, the other shape, and broken lines."""
    said = fx.table(spark, root, "conversations")
    part = lambda c: F.struct(F.lit("text").alias("type"), c.alias("text"))
    body = F.col("conv_id") % 4
    listed = F.to_json(F.struct(F.lit("message").alias("type"), F.struct("role", F.array(part(F.col("text")), part(F.lit("end"))).alias("content")).alias("message")))
    plain = F.to_json(F.struct(F.lit("message").alias("type"), F.struct("role", F.col("text").alias("content")).alias("message")))
    flat = F.to_json(F.struct("role", F.col("text").alias("content")))
    folder = _folder(spark, "transcripts")
    said.select(F.when(body == 0, listed).when(body == 1, plain).when(body == 2, flat).otherwise(F.substring(flat, 1, 20)).alias("value")).write.text(folder)
    return folder


@query("transcripts")
def transcripts(spark, root):
    read = tr.read_transcripts(spark, _transcript_lines(spark, root))
    return read.groupBy("role", "sender", "text").agg(F.count("*").alias("n"))


o.SQL["transcripts"] = r"""
SELECT role, CASE WHEN role = 'user' THEN 'User' ELSE 'Agent' END AS sender, CASE WHEN conv_id % 4 = 0 THEN text || chr(10) || 'end' ELSE text END AS text, count(*) AS n
FROM conversations WHERE conv_id % 4 < 3 AND length(text) > 0 GROUP BY ALL"""


@query("transcripts_live")
def transcripts_live(spark, root):
    read = tr.read_transcripts(spark, _transcript_lines(spark, root), mode="live")
    return read.groupBy("role", "sender", "text").agg(F.count("*").alias("n"))


o.SQL["transcripts_live"] = r"""
SELECT role, CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'agent' ELSE 'system' END AS sender, CASE WHEN conv_id % 4 = 0 THEN text || ' end' ELSE text END AS text, count(*) AS n
FROM conversations WHERE conv_id % 4 < 2 AND length(CASE WHEN conv_id % 4 = 0 THEN text || ' end' ELSE text END) >= 5 GROUP BY ALL"""


@query("run_log")
def run_log(spark, root):
    """Log rows of two runs, added one run after the other."""
    folder = _folder(spark, "log")
    orders = fx.table(spark, root, "orders")
    for status in ("F", "O"):
        rows = orders.filter(F.col("o_orderstatus") == status).groupBy(F.col("o_orderstatus").alias("mode"), F.col("o_orderpriority").alias("details")).agg(F.max("o_orderdate").cast("timestamp").alias("run_at"))
        st.append_log(rows, folder)
    return spark.read.parquet(f"{folder}/consolidation_log")


o.SQL["run_log"] = "SELECT o_orderstatus AS mode, o_orderpriority AS details, CAST(max(o_orderdate) AS TIMESTAMP) AS run_at FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2"


def _eval(spark, root):
    tables = qr._tables(spark, root)
    hits = r.hybrid_search(fx.queries_bm(spark, root), tables, qr.AS_OF, limit=5, memory_types=["lesson", "identity", "procedure"])
    cases = fx.table(spark, root, "benchmark").select(
        F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 2 == 0, "retrieval").otherwise("identity").alias("category"),
        F.slice(F.split("text", " "), 8, 3).alias("expected_keywords"),
        F.when(F.col("item_id") % 4 == 0, F.array(F.lit("Lesson"))).otherwise(fx.no_strings()).alias("expected_entities"),
    )
    return r.evaluate_retrieval(hits, cases)


@query("retrieval_summary")
def retrieval_summary(spark, root):
    """The summary per category, written as JSON and read back."""
    folder = _folder(spark, "results")
    st.write_results_json(_eval(spark, root)[1], folder)
    return spark.read.schema("category string, cases bigint, avg_keywords double, fitness double").json(folder).select("category", "cases", *_r("avg_keywords", "fitness"))


o.SQL["retrieval_summary"] = f"""
SELECT coalesce(category, 'overall') AS category, count(*) AS cases, round(avg(keyword_hit_rate), 6) AS avg_keywords, round(avg(keyword_hit_rate) * 0.7 + 0.3, 6) AS fitness
FROM ({o.SQL["retrieval_eval"]}) GROUP BY ROLLUP (category)"""


# --- ranked lists ---------------------------------------------------------------------------
@query("ranked_nodes")
def ranked_nodes(spark, root):
    return t.ranked(fx.nodes(spark, root, embeddings=False), F.col("type") == "organization", [F.col("confidence").desc(), F.col("name")]).limit(50).select("name", *_r("confidence"))


o.SQL["ranked_nodes"] = f"WITH {o.NODES} SELECT name, round(confidence, 6) AS confidence FROM nodes WHERE type = 'organization' ORDER BY nodes.confidence DESC, name LIMIT 50"


@query("ranked_procedures_by_type")
def ranked_procedures_by_type(spark, root):
    typed = fx.procedures_ev(spark, root).select("name", "type")
    done = _executed(spark, root).drop("type").join(typed, "name")
    return t.ranked(done, F.col("type") == "technical", [F.col("confidence").desc(), F.col("name")]).limit(2).select("name", *_r("confidence"))


o.SQL["ranked_procedures_by_type"] = f"""
WITH {_EXECUTED} SELECT name, round(d.confidence, 6) AS confidence FROM done d JOIN procs USING (name) WHERE type = 'technical' ORDER BY d.confidence DESC, name LIMIT 2"""


@query("ranked_persons")
def ranked_persons(spark, root):
    met = fx.table(spark, root, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("met"))
    persons = _persons(spark, root).withColumn("k", F.substring("id", 4, 20).cast("bigint")).join(met, "k", "left").withColumn("total_interactions", F.coalesce("met", F.lit(0)))
    return t.ranked(persons, None, [F.col("total_interactions").desc(), F.col("name")]).limit(20).select("name", "total_interactions")


o.SQL["ranked_persons"] = """
SELECT c_name AS name, count(o_orderkey) AS total_interactions FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"""


@query("ranked_identity")
def ranked_identity(spark, root):
    return t.ranked(_seeded(spark, root)[0]["identity"], None, [F.col("category"), F.col("emotional_weight").desc(), F.col("key")]).limit(12).select("category", "key", *_r("emotional_weight"))


o.SQL["ranked_identity"] = f"""
WITH {_IDENTITY}, every AS (SELECT key, category, emotional_weight FROM identity UNION ALL SELECT 'home-' || lower(n_name), CASE WHEN n_regionkey < 2 THEN 'core' ELSE 'preference' END, 0.8 FROM nation)
SELECT category, key, round(emotional_weight::DOUBLE, 6) AS emotional_weight FROM every ORDER BY category, every.emotional_weight DESC, key LIMIT 12"""


# --- directives ------------------------------------------------------------------------------
@query("directive_procedures")
def directive_procedures(spark, root):
    """Orders as messages, some of which are rules: each of these becomes a procedure."""
    told = fx.table(spark, root, "orders").select(
        F.col("o_orderkey").alias("message_id"), F.lit("user").alias("sender"),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("From now on check order "), F.col("o_orderkey").cast("string"), F.lit(" before it leaves, "), F.col("o_orderpriority")))
        .otherwise(F.concat(F.lit("The order "), F.col("o_orderkey").cast("string"), F.lit(" is here"))).alias("text"),
    )
    routed = w.route_table(m.routes(m.understand(told).withColumn("entities", fx.no_strings()))).filter("target = 'procedural'")
    return w.to_procedures(routed).select("message_id", "trigger", "action", *_r("confidence"), "source")


o.SQL["directive_procedures"] = f"""
WITH told AS (SELECT o_orderkey AS message_id, CASE WHEN o_orderstatus = 'F' THEN 'From now on check order ' || o_orderkey || ' before it leaves, ' || o_orderpriority ELSE 'The order ' || o_orderkey || ' is here' END AS text FROM orders)
SELECT message_id, substring(text, 1, 200) AS trigger, 'follow_directive' AS action, 0.8::DOUBLE AS confidence, 'user' AS source FROM told WHERE {_INTENT} = 'directive'"""


# --- whole consolidations -----------------------------------------------------------------------
SESSION_END = "2024-01-30 20:00:00"


def _memory(spark, root):
    persons = _persons(spark, root).withColumn("name", F.concat(F.lit("User "), F.substring("id", 4, 20)))
    return {
        "nodes": fx.nodes(spark, root), "edges": fx.edges(spark, root), "lessons": fx.lessons_bm(spark, root), "identity": fx.identity_rows(spark),
        "episodes": qc._message_episodes(spark, root).withColumn("embedding", F.lit(None).cast("array<float>")),
        "procedures": fx.procedures_ev(spark, root), "persons": persons, "insights": fx.insights_doc(spark, root),
    }


def _changed(after):
    one = after["identity"].select(F.lit("identity").alias("kind"), "key", F.col("times_affirmed").cast("bigint").alias("times"))
    two = after["persons"].select(F.lit("person").alias("kind"), F.col("name").alias("key"), F.col("total_interactions").alias("times"))
    three = after["backlog"].groupBy(F.concat(F.lit("backlog "), F.col("kind")).alias("key")).agg(F.count("*").alias("times")).select(F.lit("counter").alias("kind"), "key", "times")
    return one.unionByName(two).unionByName(three)


_BACKLOG = """
SELECT 'counter' AS kind, 'backlog episode' AS key, count(*) AS times FROM events
UNION ALL SELECT 'counter', 'backlog node', count(*) FROM nodes WHERE embedding IS NULL"""


@query("consolidate_session_end")
def consolidate_session_end(spark, root):
    """Identity, persons and the embedding backlog after a session."""
    after, _ = cycles.consolidate(spark, _memory(spark, root), "session_end", SESSION_END)
    return _changed(after)


o.SQL["consolidate_session_end"] = f"""
WITH {o.NODES} SELECT 'identity' AS kind, key, times_affirmed AS times FROM ({o.SQL["affirm_from_episodes"]}) UNION ALL SELECT 'person', name, total_interactions FROM ({o.SQL["interactions_from_episodes"]})
UNION ALL {_BACKLOG}"""
