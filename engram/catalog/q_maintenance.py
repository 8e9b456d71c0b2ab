"""Registered queries: maintenance (N1-N15)."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.catalog import fixtures as fx
from engram.catalog import oracles as o
from engram.catalog.q_enrich import _PARTS
from engram.catalog.q_messages import _r
from engram.catalog.registry import query
from engram.functions import lexicons as lx
from engram.operators import maintenance as mt

AS = "2001-09-01"


@query("effective_confidence")
def effective_confidence(spark, root):
    return mt.with_effective(fx.nodes(spark, root, embeddings=False), fx.ORDERS_AS_OF).select("id", *_r("effective_confidence"))


o.SQL["effective_confidence"] = f"WITH {o.NODES} SELECT id, round({o.effective('confidence', 'last_verified', AS)}, 6) AS effective_confidence FROM nodes"


@query("decay_report")
def decay_report(spark, root):
    return mt.decay_report(fx.nodes(spark, root, embeddings=False), fx.ORDERS_AS_OF).select("processed", "decayed", "stale", *_r("avg_effective"))


o.SQL["decay_report"] = f"""
WITH {o.NODES}, e AS (SELECT *, {o.effective('confidence', 'last_verified', AS)} AS eff FROM nodes)
SELECT count(*) AS processed, count(*) FILTER (eff < confidence * 0.9) AS decayed, count(*) FILTER (eff < 0.3) AS stale, round(avg(eff), 6) AS avg_effective FROM e"""


@query("stalest_nodes")
def stalest_nodes(spark, root):
    return mt.stalest(fx.nodes(spark, root, embeddings=False), 10, fx.ORDERS_AS_OF).select("id", *_r("effective_confidence"), "days_since_verified")


o.SQL["stalest_nodes"] = f"""
WITH {o.NODES} SELECT id, round({o.effective('confidence', 'last_verified', AS)}, 6) AS effective_confidence, CAST(round({o.days('last_verified', AS)}) AS BIGINT) AS days_since_verified
FROM nodes ORDER BY last_verified, id LIMIT 10"""


@query("verify_nodes")
def verify_nodes(spark, root):
    verdicts = fx.table(spark, root, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("id"),
        F.when(F.col("o_orderstatus") == "F", 0.95).alias("new_confidence"),
    )
    return mt.verify_nodes(fx.nodes(spark, root, embeddings=False), verdicts, fx.ORDERS_AS_OF).select("id", *_r("confidence"), "last_verified")


o.SQL["verify_nodes"] = f"""
WITH {o.NODES}, v AS (SELECT 'c' || o_custkey AS id, max(CASE WHEN o_orderstatus = 'F' THEN 0.95 END) AS c FROM orders GROUP BY 1)
SELECT n.id, round(coalesce(c, confidence), 6) AS confidence, CASE WHEN v.id IS NULL THEN last_verified ELSE TIMESTAMP '{AS}' END AS last_verified FROM nodes n LEFT JOIN v ON v.id = n.id"""


def _attribute_rows(spark, root):
    """Per user: the attributes known before and told on the last event of each type."""
    ev = fx.table(spark, root, "events").select(
        F.col("user_id").cast("string").alias("id"), "event_type", F.col("event_id"),
        F.get_json_object("props", "$.k").alias("k"),
    )
    per = ev.groupBy("id", "event_type").agg(F.min_by("k", "event_id").alias("first"), F.max_by("k", "event_id").alias("last"))
    as_map = lambda c: F.map_from_entries(F.collect_list(F.struct("event_type", c)))
    both = per.groupBy("id").agg(as_map("first").alias("first"), as_map("last").alias("last"))
    return (
        both.select("id", F.concat(F.lit("user "), F.col("id")).alias("name"), F.col("first").alias("attributes")),
        both.select("id", F.col("last").alias("attributes")),
    )


_ATTR = """per AS (SELECT CAST(user_id AS VARCHAR) AS id, event_type AS field, arg_min(props->>'$.k', event_id) AS old_value, arg_max(props->>'$.k', event_id) AS new_value FROM events GROUP BY 1, 2),
rec AS (SELECT * FROM per WHERE old_value <> new_value)"""


@query("contradictions")
def contradictions(spark, root):
    nodes, updates = _attribute_rows(spark, root)
    return mt.check_contradictions(nodes, updates, fx.EVENTS_AS_OF).select("id", "field", "old_value", "new_value", "resolved")


o.SQL["contradictions"] = f"WITH {_ATTR} SELECT id, field, old_value, new_value, FALSE AS resolved FROM rec"


def _resolved(spark, root):
    nodes, updates = _attribute_rows(spark, root)
    records = mt.check_contradictions(nodes, updates, fx.EVENTS_AS_OF)
    plan = records.select(
        "id", "field", F.when(F.col("field") == "click", "accepted_new").when(F.col("field") == "error", "kept_old").alias("resolution"), "new_value",
    ).filter("resolution IS NOT NULL")
    return mt.resolve_contradictions(nodes, records, plan)


@query("resolve_contradictions")
def resolve_contradictions(spark, root):
    nodes, _ = _resolved(spark, root)
    return nodes.select("id", F.explode("attributes").alias("field", "value"))


o.SQL["resolve_contradictions"] = f"WITH {_ATTR} SELECT id, field, CASE WHEN field = 'click' THEN new_value ELSE old_value END AS value FROM per"


@query("contradiction_scan")
def contradiction_scan(spark, root):
    _, records = _resolved(spark, root)
    return mt.scan_contradictions(records)


o.SQL["contradiction_scan"] = f"""
WITH {_ATTR} SELECT count(DISTINCT id) AS nodes_scanned, count(*) FILTER (field NOT IN ('click','error')) AS found, count(*) FILTER (field IN ('click','error')) AS resolved FROM rec"""


@query("open_contradictions")
def open_contradictions(spark, root):
    nodes, records = _resolved(spark, root)
    return mt.open_contradictions(records, nodes)


o.SQL["open_contradictions"] = f"WITH {_ATTR} SELECT 'user ' || id AS name, field, old_value, new_value FROM rec WHERE field NOT IN ('click','error')"


def _big_edges(spark, root):
    return fx.table(spark, root, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source_id"),
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("target_id"),
    )


@query("drop_orphans")
def drop_orphans(spark, root):
    persons = fx.table(spark, root, "customer").select(F.when(F.col("c_acctbal") > 9000, F.col("c_name")).otherwise(F.col("c_mktsegment")).alias("name"))
    return mt.drop_orphans(fx.nodes(spark, root, embeddings=False), _big_edges(spark, root), persons).select("id")


o.SQL["drop_orphans"] = f"""
WITH {o.NODES} SELECT id FROM nodes WHERE NOT (type = 'person' AND confidence < 1.0 AND id NOT IN (SELECT 'c' || o_custkey FROM orders)
  AND name NOT IN (SELECT CASE WHEN c_acctbal > 9000 THEN c_name ELSE c_mktsegment END FROM customer))"""


@query("duplicate_persons")
def duplicate_persons(spark, root):
    return mt.duplicate_candidates(fx.nodes(spark, root), 0.3).select("name1", "name2", *_r("similarity"))


o.SQL["duplicate_persons"] = f"""
WITH p AS (SELECT c_name AS name, 'c' || c_custkey AS id, embedding FROM customer JOIN embeddings ON vec_id = c_custkey), f AS (SELECT embedding, min(id) AS id FROM p GROUP BY 1),
g AS (SELECT f.*, name FROM f JOIN p USING (id))
SELECT least(a.name, b.name) AS name1, greatest(a.name, b.name) AS name2, round({o.cosine('a.embedding', 'b.embedding')}, 6) AS similarity FROM g a JOIN g b ON a.id < b.id WHERE {o.cosine('a.embedding', 'b.embedding')} > 0.3
UNION ALL SELECT least(g.name, p.name), greatest(g.name, p.name), 1.0 FROM p JOIN g ON p.embedding = g.embedding WHERE p.id <> g.id"""


def _name_nodes(spark, root):
    """Part names as two-word persons, their nouns as one-word persons, edges by brand."""
    part = fx.table(spark, root, "part")
    noun = F.element_at(F.split("p_name", " "), -1)
    name = part.select(F.col("p_name").alias("name")).distinct().unionByName(part.select(noun.alias("name")).distinct())
    nodes = name.select(
        F.concat(F.lit("x:"), F.col("name")).alias("id"), F.lit("person").alias("type"), "name",
        fx.no_strings().alias("aliases"), F.lit(0.5).alias("confidence"),
    )
    edges = part.select(
        F.concat(F.lit("x:"), noun).alias("source_id"), F.concat(F.lit("x:"), F.col("p_name")).alias("target_id"), F.col("p_brand").alias("relationship")
    )
    persons = spark.createDataFrame([("ring",)], "name string")
    return nodes, edges, persons


@query("merge_aliases")
def merge_aliases(spark, root):
    nodes, _ = mt.merge_aliases(*_name_nodes(spark, root))
    return nodes.select("id", F.array_join("aliases", ",").alias("aliases"))


_MERGE = """
nm AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT string_split(p_name, ' ')[-1] FROM part),
full_ AS (SELECT name, unnest(string_split(name, ' ')) AS w FROM nm WHERE len(string_split(name, ' ')) >= 2),
mg AS (SELECT w AS short_name, arg_min(name, (-length(name), name)) AS full_name FROM full_ WHERE w IN (SELECT name FROM nm WHERE len(string_split(name, ' ')) = 1) AND w <> 'ring' GROUP BY 1)"""
o.SQL["merge_aliases"] = f"""
WITH {_MERGE} SELECT 'x:' || name AS id, coalesce((SELECT string_agg(short_name, ',' ORDER BY short_name) FROM mg WHERE full_name = name), '') AS aliases FROM nm WHERE name NOT IN (SELECT short_name FROM mg)"""


@query("merge_aliases_edges")
def merge_aliases_edges(spark, root):
    _, edges = mt.merge_aliases(*_name_nodes(spark, root))
    return edges.groupBy("source_id", "target_id").agg(F.count("*").alias("n"))


o.SQL["merge_aliases_edges"] = f"""
WITH {_MERGE} SELECT 'x:' || coalesce(full_name, noun) AS source_id, 'x:' || p_name AS target_id, count(*) AS n FROM (SELECT p_name, string_split(p_name, ' ')[-1] AS noun FROM part) LEFT JOIN mg ON short_name = noun GROUP BY 1, 2"""


@query("reweight_edges")
def reweight_edges(spark, root):
    return mt.reweight_edges(fx.edges(spark, root), fx.nodes(spark, root, embeddings=False), "2001-08-05 00:00:00").select("id", *_r("strength"))


_FLAGS = f"""fl AS (SELECT id, {o.contains_any('lower(context)', lx.STATUS_DOWN)} AS down, {o.contains_any('lower(context)', lx.STATUS_UP)} AND NOT {o.contains_any('lower(context)', lx.STATUS_DOWN)} AS up,
  source_count AS n, last_verified > TIMESTAMP '2001-08-05' - INTERVAL 7 DAY AS fresh FROM nodes)"""
o.SQL["reweight_edges"] = f"""
WITH {o.NODES}, {o.EDGES}, {_FLAGS}, a AS (SELECT e.id, s.down OR t.down AS d, s.up OR t.up AS u, greatest(s.n, t.n) AS n, s.fresh OR t.fresh AS r FROM edges e JOIN fl s ON s.id = source_id JOIN fl t ON t.id = target_id),
b AS (SELECT *, least(1.0::DOUBLE, CASE WHEN u THEN 0.6 WHEN d THEN 0.3 ELSE 0.5 END::DOUBLE + 0.04::DOUBLE * n) AS s1 FROM a), c AS (SELECT *, CASE WHEN r THEN least(1.0, s1 + 0.1) ELSE s1 END AS s2 FROM b)
SELECT id, round(CASE WHEN d THEN least(0.35, s2) ELSE s2 END, 6) AS strength FROM c"""

_COOC = f"""{_PARTS}, f AS (SELECT section_id, id FROM sections JOIN pents ON length(name) >= 4 AND contains(content, lower(name))),
cooc AS (SELECT x.id AS a, y.id AS b, count(*) AS n FROM f x JOIN f y ON x.section_id = y.section_id AND x.id < y.id GROUP BY 1, 2)"""


@query("cooccurrence")
def cooccurrence(spark, root):
    return mt.cooccurrence(fx.order_sections(spark, root), fx.part_entities(spark, root))


o.SQL["cooccurrence"] = f"WITH {_COOC} SELECT a, b, n FROM cooc"


@query("infer_edges")
def infer_edges(spark, root):
    nodes = fx.part_entities(spark, root)
    pairs = mt.cooccurrence(fx.order_sections(spark, root), nodes, min_count=3)
    known = fx.table(spark, root, "part").select(
        F.lit("t:none").alias("source_id"), F.concat(F.lit("t:"), F.col("p_name")).alias("target_id")
    )
    return mt.infer_edges(pairs, nodes, known).select("source_id", "target_id", "relationship", "category", *_r("strength"))


@query("maintenance_suite")
def maintenance_suite(spark, root):
    from engram.plans.cycles import maintain

    tables = {
        "nodes": fx.nodes(spark, root), "edges": _big_edges(spark, root).withColumn("relationship", F.lit("values")),
        "persons": fx.table(spark, root, "customer").select(F.when(F.col("c_acctbal") > 9000, F.col("c_name")).otherwise(F.col("c_mktsegment")).alias("name")),
    }
    return maintain(tables, fx.ORDERS_AS_OF)[1]


o.SQL["maintenance_suite"] = f"""
WITH {o.NODES}, k AS (SELECT * FROM nodes WHERE NOT (type = 'person' AND confidence < 1.0 AND id NOT IN (SELECT 'c' || o_custkey FROM orders)
  AND name NOT IN (SELECT CASE WHEN c_acctbal > 9000 THEN c_name ELSE c_mktsegment END FROM customer))), e AS (SELECT *, {o.effective('confidence', 'last_verified', AS)} AS eff FROM k)
SELECT (SELECT count(*) FROM nodes WHERE type='person') AS persons_before, count(*) FILTER (type='person') AS persons_after, count(*) AS processed, count(*) FILTER (eff < confidence * 0.9) AS decayed, count(*) FILTER (eff < 0.3) AS stale FROM e"""
