"""Registered queries: ingestion (I1-I16) and code graph (K1-K11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.catalog import fixtures as fx
from engram.catalog import oracles as o
from engram.catalog.q_enrich import _PARTS
from engram.catalog.q_messages import _r
from engram.catalog.q_retrieval import FILES, _ROLE, sections, sections_sql
from engram.catalog.registry import query
from engram.functions import lexicons as lx
from engram.operators import codegraph as k
from engram.operators import ingestion as i


def _sec(spark, root):
    return sections(spark, root, 6)


_SEC = f"{FILES}, {sections_sql(6)}, sec AS (SELECT *, {_ROLE} AS role FROM sections6)"


@query("seed_graph")
def seed_graph(spark, root):
    customer, nation = fx.table(spark, root, "customer"), fx.table(spark, root, "nation")
    rels = customer.select(
        F.col("c_name").alias("source"), F.concat(F.lit("NATION_"), (F.col("c_nationkey") + F.when(F.col("c_acctbal") < 0, 100).otherwise(0)).cast("string")).alias("target"),
        F.lit("located_in").alias("relationship"), F.lit("structural").alias("category"), F.lit(0.9).alias("strength"), F.lit("seed").alias("context"),
    )
    edges, errors = i.seed_graph(rels, fx.nodes(spark, root, embeddings=False))
    return edges.groupBy("relationship").agg(F.count("*").alias("n")).unionByName(errors.groupBy(F.lit("unresolved").alias("relationship")).agg(F.count("*").alias("n")))


o.SQL["seed_graph"] = """
SELECT 'located_in' AS relationship, count(*) FILTER (c_acctbal >= 0) AS n FROM customer UNION ALL SELECT 'unresolved', count(*) FILTER (c_acctbal < 0) FROM customer"""


@query("seed_nodes")
def seed_nodes(spark, root):
    from engram.operators.tables import upsert_nodes

    old = fx.nodes(spark, root, embeddings=False)
    rows = fx.table(spark, root, "supplier").select(
        F.lit("organization").alias("type"), F.col("s_name").alias("name"), F.array(F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))).alias("aliases"),
        F.lit("curated").alias("context"), F.col("s_suppkey").alias("batch_order"),
    )
    return upsert_nodes(old, i.seed_nodes(rows), fx.ORDERS_AS_OF).groupBy("type", "context").agg(F.count("*").alias("n"), *[F.round(F.avg("emotional_weight"), 6).alias("w")])


o.SQL["seed_nodes"] = f"""
WITH {o.NODES} SELECT type, CASE WHEN type='organization' THEN 'curated' ELSE context END AS context, count(*) AS n, CASE WHEN type='organization' THEN 0.3 ELSE 0.0 END::DOUBLE AS w FROM nodes GROUP BY ALL"""


@query("discover_people")
def discover_people(spark, root):
    return i.discover_people(_sec(spark, root), fx.nodes(spark, root, embeddings=False))


o.SQL["discover_people"] = f"""
WITH {_SEC}, b AS (SELECT unnest(regexp_extract_all(content, {o.lit(lx.BOLD_NAME)}, 1)) AS nm, 'Discovered in ' || name || ': ' || heading AS context, path, line_start FROM sec)
SELECT nm AS name, arg_min(context, (path, line_start)) AS context FROM b WHERE nm NOT IN ('Build Agent') GROUP BY 1"""


@query("section_lessons")
def section_lessons(spark, root):
    return i.lessons_from_sections(_sec(spark, root)).select("path", "statement", "severity", "prevention_rule")


o.SQL["section_lessons"] = f"""
WITH {_SEC} SELECT path, heading || ': ' || CASE WHEN regexp_extract(content, '\\*\\*(?:Mistake|Problem):\\*\\*\\s*(.+?)(?:\\n|$)', 1) <> '' THEN regexp_extract(content, '\\*\\*(?:Mistake|Problem):\\*\\*\\s*(.+?)(?:\\n|$)', 1) ELSE substring(content, 1, 200) END AS statement,
 'minor' AS severity, regexp_extract(content, '\\*\\*(?:Rule|Fix):\\*\\*\\s*(.+?)(?:\\n|$)', 1) AS prevention_rule FROM sec WHERE contains(content, 'Mistake:') OR contains(content, 'Problem:') OR contains(content, 'Rule:')"""


@query("section_lessons_relaxed")
def section_lessons_relaxed(spark, root):
    return i.lessons_from_sections(_sec(spark, root), strict=False).select("path", "line_start", "statement", "severity")


o.SQL["section_lessons_relaxed"] = f"""
WITH {_SEC} SELECT path, line_start, heading || ': ' || substring(content, 1, 200) AS statement, CASE WHEN contains(heading, 'CRITICAL') OR contains(content, 'CRITICAL') THEN 'critical' WHEN contains(heading, 'RECURRING') THEN 'important' ELSE 'minor' END AS severity FROM sec WHERE length(content) >= 50"""

_IMP = """least(1.0, 0.5 + CASE WHEN regexp_matches(heading, '[🚨💰💎🪨]') THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(heading, '[✅🔥🧠]') THEN 0.1 ELSE 0 END
 + CASE WHEN contains(lower(content), 'critical') OR contains(lower(content), 'decision') THEN 0.1 ELSE 0 END + CASE WHEN contains(lower(content), 'deployed') OR contains(lower(content), 'live') THEN 0.1 ELSE 0 END
 + CASE WHEN contains(lower(content), 'covenant') OR contains(lower(content), 'partnership') THEN 0.15 ELSE 0 END + CASE WHEN length(content) > 2000 THEN 0.1 ELSE 0 END + CASE WHEN length(content) > 5000 THEN 0.1 ELSE 0 END)::DOUBLE"""


@query("daily_episodes")
def daily_episodes(spark, root):
    return i.daily_episodes(_sec(spark, root), "model").select("id", "session_id", "summary", *_r("importance_score"), F.length("narrative").cast("bigint").alias("chars"))


o.SQL["daily_episodes"] = f"""
WITH {_SEC} SELECT 'md:' || path || ':' || line_start AS id, 'daily-' || regexp_extract(name, '\\d{{4}}-\\d{{2}}-\\d{{2}}') AS session_id, heading AS summary, round({_IMP}, 6) AS importance_score, length(substring(content, 1, 4000)) AS chars
FROM sec WHERE role='daily' AND length(content) > 100 AND contains(heading || substring(content, 1, 50), '🔥')"""


@query("section_importance")
def section_importance(spark, root):
    return _sec(spark, root).select("path", "line_start", F.round(i.section_importance("model"), 6).alias("importance"))


o.SQL["section_importance"] = f"WITH {_SEC} SELECT path, line_start, round({_IMP}, 6) AS importance FROM sec"


@query("section_topics")
def section_topics(spark, root):
    return _sec(spark, root).select(
        "path", "line_start", F.array_join(i.section_topics("words"), ",").alias("words"), F.array_join(i.section_topics("patterns"), ",").alias("patterns")
    )


_TW = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(lower(content), {o.lit(w)}) THEN {o.lit(w)} END" for w in lx.SECTION_TOPIC_WORDS) + "], lambda x: x IS NOT NULL), ',')"
_TP = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {o.rx('content', p)} THEN {o.lit(l)} END" for p, l in lx.SECTION_TOPICS) + "], lambda x: x IS NOT NULL), ',')"
o.SQL["section_topics"] = f"WITH {_SEC} SELECT path, line_start, {_TW} AS words, {_TP} AS patterns FROM sec"


def _customers(spark, root):
    return fx.table(spark, root, "customer").select(F.col("c_name").alias("name"), fx.no_strings().alias("aliases"))


@query("entity_topics")
def entity_topics(spark, root):
    return i.entity_topics(_sec(spark, root), _customers(spark, root)).select("path", "line_start", F.array_join("topics", ",").alias("topics"))


_NAMED = "nm AS (SELECT path, line_start, c_name, row_number() OVER (PARTITION BY path, line_start ORDER BY c_name) AS rn, count(*) OVER (PARTITION BY path, line_start) AS n, length(content) AS len FROM sec JOIN customer ON contains(lower(content), lower(c_name)))"
o.SQL["entity_topics"] = f"WITH {_SEC}, {_NAMED} SELECT path, line_start, string_agg(c_name, ',' ORDER BY c_name) AS topics FROM nm WHERE rn <= 20 GROUP BY 1, 2"


@query("relation_candidates")
def relation_candidates(spark, root):
    return i.relation_candidates(_sec(spark, root), _customers(spark, root)).select("path", "line_start", F.array_join("names", ",").alias("names"))


o.SQL["relation_candidates"] = f"WITH {_SEC}, {_NAMED} SELECT path, line_start, string_agg(c_name, ',' ORDER BY c_name) AS names FROM nm WHERE rn <= 30 AND n >= 2 AND len >= 100 GROUP BY 1, 2"


def _doc_sections(spark, root):
    """Documents as sections of one file per source and language."""
    d = fx.table(spark, root, "documents")
    return d.select(
        F.concat("source", F.lit("/"), "lang").alias("path"), F.col("doc_id").cast("int").alias("line_start"),
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("heading"), F.col("text").alias("content"),
    )


@query("pack_batches")
def pack_batches(spark, root):
    return i.pack_batches(_doc_sections(spark, root))


o.SQL["pack_batches"] = """
WITH RECURSIVE s AS (SELECT source || '/' || lang AS path, doc_id AS line_start, length(text) AS chars, length('doc ' || doc_id) + length(text) + 6 AS full_,
   row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS i FROM documents WHERE length(text) > 200),
f AS (SELECT path, i, line_start, full_ AS size, 1 AS n, 0 AS batch FROM s WHERE i = 1
 UNION ALL SELECT s.path, s.i, s.line_start, CASE WHEN f.size + s.chars > 2500 OR n >= 3 THEN s.full_ ELSE f.size + s.full_ END, CASE WHEN f.size + s.chars > 2500 OR n >= 3 THEN 1 ELSE n + 1 END,
   CASE WHEN f.size + s.chars > 2500 OR n >= 3 THEN batch + 1 ELSE batch END FROM f JOIN s ON s.path = f.path AND s.i = f.i + 1)
SELECT path, CAST(line_start AS INTEGER) AS line_start, CAST(batch AS INTEGER) AS batch FROM f"""


def _raw(spark, root):
    """Model answers built from parts: an entity and a relationship each."""
    part = fx.table(spark, root, "part")
    ent = F.concat(
        F.lit('{"entities": [{"name": " '), F.col("p_name"), F.lit(' ", "type": "'), F.when(F.col("p_size") % 5 == 0, "gadget").otherwise("tool"),
        F.lit('", "aliases": ["'), F.upper("p_name"), F.lit('", " "], "context": "'), F.col("p_brand"), F.lit('", "emotional_weight": '), (F.col("p_size") / 20.0).cast("string"), F.lit("}]}"),
    )
    rel = F.concat(
        F.lit('{"relationships": [{"source": "'), F.upper("p_name"), F.lit('", "target": "'), F.element_at(F.split("p_name", " "), -1),
        F.lit('", "relationship": "'), F.when(F.col("p_size") % 4 == 0, "likes").otherwise("part_of"), F.lit('", "category": "'), F.when(F.col("p_size") % 3 == 0, "odd").otherwise("causal"),
        F.lit('", "strength": '), (F.col("p_size") / 20.0).cast("string"), F.lit(', "context": "'), F.col("p_brand"), F.lit('"}]}'),
    )
    return part.select("p_partkey", F.concat(F.lit("```json\n"), ent, F.lit("\n```")).alias("ent"), rel.alias("rel"))


def _entities(spark, root):
    return i.clean_entities(_raw(spark, root).select("p_partkey", F.col("ent").alias("raw")), ["p_partkey"])


@query("clean_entities")
def clean_entities(spark, root):
    return _entities(spark, root).select("p_partkey", "name", F.array_join("aliases", ",").alias("aliases"), "context", *_r("emotional_weight"))


o.SQL["clean_entities"] = "SELECT p_partkey, p_name AS name, upper(p_name) AS aliases, p_brand AS context, round(least(1.0, p_size / 20.0::DOUBLE), 6) AS emotional_weight FROM part WHERE p_size % 5 <> 0"


def _relationships(spark, root):
    part = fx.table(spark, root, "part")
    noun = F.element_at(F.split("p_name", " "), -1)
    names = part.select(F.col("p_name").alias("name")).unionByName(part.filter("p_partkey > 0").select(noun.alias("name"))).filter("name <> 'ring'")
    return i.clean_relationships(_raw(spark, root).select("p_partkey", F.col("rel").alias("raw")), names, ["p_partkey"])


@query("clean_relationships")
def clean_relationships(spark, root):
    return _relationships(spark, root).select("p_partkey", "source", "target", "relationship", "category", *_r("strength"))


_RELS = """rels AS (SELECT p_partkey, p_name AS source, string_split(p_name, ' ')[-1] AS target, 'part_of' AS relationship, CASE WHEN p_size % 3 = 0 THEN 'relational' ELSE 'causal' END AS category,
  greatest(0.1, least(1.0, p_size / 20.0::DOUBLE)) AS strength, p_brand AS context FROM part WHERE p_size % 4 <> 0 AND string_split(p_name, ' ')[-1] <> 'ring')"""
o.SQL["clean_relationships"] = f"WITH {_RELS} SELECT p_partkey, source, target, relationship, category, round(strength, 6) AS strength FROM rels"


@query("relationship_merge")
def relationship_merge(spark, root):
    return i.merge_relationships(_relationships(spark, root)).select("source", "target", "relationship", *_r("strength"), "context")


o.SQL["relationship_merge"] = f"WITH {_RELS} SELECT source, target, relationship, round(max(strength), 6) AS strength, arg_max(context, (length(context), context)) AS context FROM rels GROUP BY 1, 2, 3"


@query("match_names")
def match_names(spark, root):
    part = fx.table(spark, root, "part")
    given = part.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("the "), F.col("p_name"), F.lit("s"))).otherwise(F.element_at(F.split("p_name", " "), 1)).alias("given"))
    names = part.select(F.col("p_name").alias("name")).distinct()
    return i.match_names(given, names).select("p_partkey", "matched")


o.SQL["match_names"] = """
WITH g AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN lower(p_name) WHEN p_partkey % 3 = 0 THEN 'the ' || p_name || 's' ELSE string_split(p_name, ' ')[1] END AS g FROM part), n AS (SELECT DISTINCT p_name FROM part),
d AS (SELECT g, min(p_name) FILTER (p_name = g) AS e, min(p_name) AS p FROM (SELECT DISTINCT g FROM g) JOIN n ON p_name = g OR contains(p_name, g) OR contains(g, p_name) GROUP BY 1)
SELECT p_partkey, coalesce(e, p, g.g) AS matched FROM g LEFT JOIN d ON d.g = g.g"""


@query("entity_merge")
def entity_merge(spark, root):
    """Part names, their nouns and their colours: short forms fold into long ones."""
    ents = _entities(spark, root).select("name", "type", fx.no_strings().alias("aliases"), "context", "emotional_weight")
    noun = F.element_at(F.split("name", " "), -1)
    all_ = ents.unionByName(ents.withColumn("name", noun))
    return i.merge_entities(all_).select("name", F.array_join("aliases", ",").alias("aliases"), "context", *_r("emotional_weight"))


o.SQL["entity_merge"] = """
WITH e AS (SELECT p_name AS name, p_brand AS context, least(1.0, p_size / 20.0::DOUBLE) AS w FROM part WHERE p_size % 5 <> 0), a AS (SELECT * FROM e UNION ALL SELECT string_split(name, ' ')[-1], context, w FROM e),
nm AS (SELECT DISTINCT name FROM a), par AS (SELECT s.name, arg_min(l.name, (-length(l.name), l.name)) AS root FROM nm s JOIN nm l ON contains(l.name, s.name) AND length(l.name) > length(s.name) GROUP BY 1),
r AS (SELECT a.*, coalesce(root, a.name) AS root FROM a LEFT JOIN par USING (name))
SELECT root AS name, coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (name <> root), '') AS aliases, arg_max(context, (length(context), context)) AS context, round(max(w), 6) AS emotional_weight FROM r GROUP BY 1"""


@query("ingest_corpus")
def ingest_corpus(spark, root):
    from engram.plans.ingest import ingest_corpus as run

    tables = run(fx.files_nation(spark, root), None, None, fx.nodes(spark, root, embeddings=False), fx.edges(spark, root), fx.DOCS_AS_OF)
    out = None
    for name in ("nodes", "edges", "episodes", "lessons"):
        part = tables[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


o.SQL["ingest_corpus"] = f"""
WITH {_SEC}, {o.NODES}, {o.EDGES} SELECT 'nodes' AS table_name, (SELECT count(*) FROM nodes) + 2 AS n UNION ALL SELECT 'edges', count(*) FROM edges
UNION ALL SELECT 'episodes', count(*) FROM sec WHERE role='daily' AND length(content) > 100 AND contains(heading || substring(content, 1, 50), '🔥')
UNION ALL SELECT 'lessons', count(*) FROM sec WHERE role='lesson' AND (contains(content, 'Mistake:') OR contains(content, 'Problem:') OR contains(content, 'Rule:'))"""


# --- code graph ------------------------------------------------------------------------------
def _calls(spark, root):
    return fx.table(spark, root, "lineitem").select(
        F.col("l_partkey").alias("caller"), F.col("l_suppkey").alias("callee"),
        F.when(F.col("l_returnflag") == "R", "IMPORTS").otherwise("CALLS").alias("type"),
    )


@query("critical_symbols")
def critical_symbols(spark, root):
    return k.critical_symbols(_calls(spark, root))


o.SQL["critical_symbols"] = """
SELECT name, incoming_calls, CASE WHEN incoming_calls >= 50 THEN 'critical' WHEN incoming_calls >= 20 THEN 'high' ELSE 'medium' END AS risk_level FROM (
 SELECT l_suppkey AS name, count(*) AS incoming_calls FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25) WHERE incoming_calls >= 5"""


def _flows(spark, root):
    """Per order the nations of its suppliers, in line order."""
    line, supplier = fx.table(spark, root, "lineitem"), fx.table(spark, root, "supplier")
    return line.join(supplier, line.l_suppkey == supplier.s_suppkey).groupBy(F.col("l_orderkey").alias("id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("s_nationkey").cast("string").alias("n")))), lambda s: s["n"]).alias("communities"),
        F.count("*").alias("step_count"),
    )


@query("cross_calls")
def cross_calls(spark, root):
    return k.cross_calls(_flows(spark, root), top_groups=None).select("source", "target", "call_count", *_r("strength"))


_FLOWS = "fl AS (SELECT l_orderkey AS id, list(CAST(s_nationkey AS VARCHAR) ORDER BY l_linenumber, CAST(s_nationkey AS VARCHAR)) AS c, count(*) AS step_count FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1)"
o.SQL["cross_calls"] = f"""
WITH {_FLOWS}, g AS (SELECT c[1] AS source, c[-1] AS target, count(*) AS call_count FROM fl WHERE len(c) >= 2 GROUP BY 1, 2) SELECT *, round(call_count / max(call_count) OVER ()::DOUBLE, 6) AS strength FROM g"""


@query("top_flows")
def top_flows(spark, root):
    return k.top_flows(_flows(spark, root)).select("id", "step_count")


o.SQL["top_flows"] = f"WITH {_FLOWS} SELECT id, step_count FROM fl ORDER BY step_count DESC, id LIMIT 50"


@query("communities")
def communities(spark, root):
    customer, orders = fx.table(spark, root, "customer"), fx.table(spark, root, "orders")
    symbols = customer.select(F.col("c_custkey").alias("symbol"), F.col("c_nationkey").cast("string").alias("community"))
    calls = orders.select(F.col("o_custkey").alias("caller"), (F.col("o_orderkey") % 1000).alias("callee"))
    return k.communities(symbols, calls).select("community", "symbol_count", *_r("cohesion"))


o.SQL["communities"] = """
WITH p AS (SELECT a.c_nationkey AS x, b.c_nationkey AS y FROM orders JOIN customer a ON a.c_custkey = o_custkey JOIN customer b ON b.c_custkey = o_orderkey % 1000),
t AS (SELECT x AS c, x = y AS inn FROM p UNION ALL SELECT y, FALSE FROM p WHERE x <> y), u AS (SELECT c, count(*) AS a, count(*) FILTER (inn) AS i FROM t GROUP BY 1)
SELECT CAST(c_nationkey AS VARCHAR) AS community, count(*) AS symbol_count, round(coalesce(any_value(i / a::DOUBLE), 0), 6) AS cohesion FROM customer LEFT JOIN u ON c = c_nationkey GROUP BY c_nationkey ORDER BY 2 DESC, 1 LIMIT 50"""


@query("repo_stats")
def repo_stats(spark, root):
    nation, customer = fx.table(spark, root, "nation"), fx.table(spark, root, "customer")
    label = F.when(F.col("c_mktsegment") == "BUILDING", "Community").when(F.col("c_mktsegment") == "MACHINERY", "File").otherwise("Function")
    symbols = customer.select(F.col("c_nationkey").alias("repo"), label.alias("label"))
    orders = fx.table(spark, root, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("repo"))
    flows = fx.table(spark, root, "supplier").select(F.col("s_nationkey").alias("repo"))
    return k.repo_stats(symbols, orders, flows)


o.SQL["repo_stats"] = """
SELECT c_nationkey AS repo, count(*) FILTER (c_mktsegment <> 'BUILDING') AS symbols, count(*) FILTER (c_mktsegment = 'BUILDING') AS communities, count(*) FILTER (c_mktsegment = 'MACHINERY') AS files,
 coalesce((SELECT count(*) FROM orders JOIN customer d ON d.c_custkey = o_custkey WHERE d.c_nationkey = c.c_nationkey), 0) AS edges, coalesce((SELECT count(*) FROM supplier WHERE s_nationkey = c.c_nationkey), 0) AS flows FROM customer c GROUP BY c_nationkey"""


def _snapshots(spark, root):
    """Per nation and year: orders as symbols, segments as communities, segment→priority as relations."""
    j = fx.table(spark, root, "orders").join(fx.table(spark, root, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.lit("repo"), F.col("c_nationkey").cast("string")).alias("repo_name"), F.year("o_orderdate").alias("y"), "c_mktsegment", "o_orderpriority"
    )
    key = ["repo_name", "y"]
    comm = j.groupBy(*key, "c_mktsegment").agg(F.count("*").alias("n")).groupBy(*key).agg(
        F.sort_array(F.collect_list(F.struct(F.col("c_mktsegment").alias("id"), F.col("c_mktsegment").alias("label"), F.col("n").alias("symbol_count"), F.lit(0.5).alias("cohesion")))).alias("communities"),
        F.sum("n").alias("total"),
    )
    rel = j.groupBy(*key, "c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n")).groupBy(*key).agg(
        F.sort_array(F.collect_list(F.struct(F.col("c_mktsegment").alias("source"), F.col("o_orderpriority").alias("target"), F.col("n").alias("call_count"), F.lit(0.5).alias("strength")))).alias("relations")
    )
    flow = j.select(*key, F.col("o_orderpriority").alias("summary")).distinct().groupBy(*key).agg(
        F.sort_array(F.collect_list(F.struct(F.col("summary").alias("id"), "summary", F.lit(1).alias("step_count")))).alias("flows")
    )
    n = lambda v: v.cast("bigint")
    return comm.join(rel, key).join(flow, key).select(
        F.concat_ws(":", "repo_name", "y").alias("id"), "repo_name", F.concat(F.lit("c"), F.col("y").cast("string")).alias("commit_hash"),
        F.to_timestamp(F.concat(F.col("y").cast("string"), F.lit("-01-01"))).alias("ts"),
        F.struct(n(F.col("total")).alias("total_symbols"), n(F.size("relations")).alias("total_edges"), n(F.size("communities")).alias("total_communities"), n(F.size("flows")).alias("total_flows")).alias("stats"),
        "communities", "relations", "flows",
        F.transform("communities", lambda c: F.struct(c["label"].alias("name"), c["symbol_count"].alias("incoming_calls"), k.risk_level(c["symbol_count"]).alias("risk_level"))).alias("critical"),
    )


_SNAP = """j AS (SELECT 'repo' || c_nationkey AS repo_name, year(o_orderdate) AS y, c_mktsegment AS seg, o_orderpriority AS pri FROM orders JOIN customer ON o_custkey = c_custkey),
tot AS (SELECT repo_name, y, count(*) AS n, lag(y) OVER (PARTITION BY repo_name ORDER BY y) AS py, lag(count(*)) OVER (PARTITION BY repo_name ORDER BY y) AS pn FROM j GROUP BY 1, 2),
cm AS (SELECT repo_name, y, seg, count(*) AS n FROM j GROUP BY 1, 2, 3), rl AS (SELECT repo_name, y, seg, pri, count(*) AS n FROM j GROUP BY 1, 2, 3, 4), fw AS (SELECT DISTINCT repo_name, y, pri FROM j),
d AS (SELECT t.*, (SELECT count(*) FROM cm a WHERE a.repo_name = t.repo_name AND a.y = t.y AND NOT EXISTS (SELECT 1 FROM cm b WHERE b.repo_name = a.repo_name AND b.y = t.py AND b.seg = a.seg)) AS added,
 (SELECT count(*) FROM cm a WHERE a.repo_name = t.repo_name AND a.y = t.py AND NOT EXISTS (SELECT 1 FROM cm b WHERE b.repo_name = a.repo_name AND b.y = t.y AND b.seg = a.seg)) AS removed,
 (SELECT count(*) FROM cm a JOIN cm b ON b.repo_name = a.repo_name AND b.y = t.py AND b.seg = a.seg WHERE a.repo_name = t.repo_name AND a.y = t.y AND a.n > b.n) AS grown,
 (SELECT count(*) FROM cm a JOIN cm b ON b.repo_name = a.repo_name AND b.y = t.py AND b.seg = a.seg WHERE a.repo_name = t.repo_name AND a.y = t.y AND a.n > b.n * 1.3) AS jumped,
 (SELECT count(*) FROM rl a JOIN rl b ON b.repo_name = a.repo_name AND b.y = t.py AND b.seg = a.seg AND b.pri = a.pri WHERE a.repo_name = t.repo_name AND a.y = t.y AND a.n > b.n) AS coupling_up,
 (SELECT count(*) FROM rl a WHERE a.repo_name = t.repo_name AND a.y = t.y AND NOT EXISTS (SELECT 1 FROM rl b WHERE b.repo_name = a.repo_name AND b.y = t.py AND b.seg = a.seg AND b.pri = a.pri)) AS new_dependencies,
 (SELECT count(*) FROM fw a WHERE a.repo_name = t.repo_name AND a.y = t.py AND NOT EXISTS (SELECT 1 FROM fw b WHERE b.repo_name = a.repo_name AND b.y = t.y AND b.pri = a.pri)) AS gone
 FROM tot t WHERE py IS NOT NULL),
e AS (SELECT *, CASE WHEN added > 2 OR removed > 2 THEN 'restructuring' WHEN n - pn > pn * 0.1 THEN 'growing' WHEN n - pn < pn * -0.05 THEN 'shrinking' ELSE 'stable' END AS drift,
 (coupling_up > 3)::INT + jumped + (new_dependencies > 2)::INT + (gone > 5)::INT AS flags FROM d)"""


@query("snapshot_diff")
def snapshot_diff(spark, root):
    return k.diff_snapshots(_snapshots(spark, root)).select(
        "repo_name", "to_commit", "symbols_delta", F.size("added").cast("bigint").alias("added"), F.size("grown").cast("bigint").alias("grown"),
        F.col("coupling_up").cast("bigint").alias("coupling_up"), F.col("new_dependencies").cast("bigint").alias("new_dependencies"), "drift", F.size("risk_flags").cast("bigint").alias("flags"),
    )


o.SQL["snapshot_diff"] = f"WITH {_SNAP} SELECT repo_name, 'c' || y AS to_commit, n - pn AS symbols_delta, added, grown, coupling_up, new_dependencies, drift, flags FROM e"


@query("diff_episodes")
def diff_episodes(spark, root):
    return k.diff_episodes(k.diff_snapshots(_snapshots(spark, root))).select(
        "repo_name", "to_commit", *_r("importance_score"), F.regexp_extract("summary", r"Overall drift: (\w+)", 1).alias("drift"),
        F.regexp_extract("summary", r"^(\S+ architecture evolved \(\S+ → \S+\):)", 1).alias("head"),
    )


o.SQL["diff_episodes"] = f"""
WITH {_SNAP} SELECT repo_name, 'c' || y AS to_commit, CASE WHEN flags > 0 THEN 0.8 ELSE 0.5 END::DOUBLE AS importance_score, drift, repo_name || ' architecture evolved (c' || py || ' → c' || y || '):' AS head FROM e"""


@query("latest_snapshots")
def latest_snapshots(spark, root):
    return k.latest_snapshot(_snapshots(spark, root)).select("repo_name", "commit_hash")


o.SQL["latest_snapshots"] = f"WITH {_SNAP} SELECT repo_name, 'c' || max(y) AS commit_hash FROM tot GROUP BY 1"


@query("snapshot_history")
def snapshot_history(spark, root):
    return k.snapshot_history(_snapshots(spark, root), 3).select("repo_name", "commit_hash")


o.SQL["snapshot_history"] = f"WITH {_SNAP} SELECT repo_name, 'c' || y AS commit_hash FROM (SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY y DESC) AS rn FROM tot) WHERE rn <= 3"


@query("store_snapshot")
def store_snapshot(spark, root):
    snaps = _snapshots(spark, root)
    old = snaps.filter("commit_hash <= 'c1998'")
    new = snaps.filter("commit_hash >= 'c1998'").withColumn("id", F.concat(F.lit("new:"), F.col("id")))
    return k.store_snapshot(old, new).select("repo_name", "commit_hash", "id", F.col("stats.total_symbols").alias("symbols"))


o.SQL["store_snapshot"] = f"WITH {_SNAP} SELECT repo_name, 'c' || y AS commit_hash, CASE WHEN y <= 1998 THEN '' ELSE 'new:' END || repo_name || ':' || y AS id, n AS symbols FROM tot"


@query("snapshot_memory")
def snapshot_memory(spark, root):
    nodes, edges, episodes = k.snapshot_to_memory(_snapshots(spark, root))
    part = lambda df, name, col: df.groupBy(F.col(col).alias("kind")).agg(F.count("*").alias("n")).select(F.lit(name).alias("rows"), "kind", "n")
    return part(nodes, "nodes", "significance").unionByName(part(edges, "edges", "relationship")).unionByName(part(episodes, "episodes", "session_id"))


o.SQL["snapshot_memory"] = f"""
WITH {_SNAP}, big AS (SELECT * FROM cm WHERE n >= 10), x AS (SELECT 'nodes' AS rows, CASE WHEN n >= 100 THEN 'major_module' WHEN n >= 50 THEN 'significant_module' ELSE 'minor_module' END AS kind FROM big
 UNION ALL SELECT 'nodes', 'active_project' FROM tot UNION ALL SELECT 'nodes', CASE WHEN n >= 50 THEN 'critical_symbol' ELSE 'important_symbol' END FROM cm WHERE n >= 5
 UNION ALL SELECT 'edges', 'part_of' FROM big UNION ALL SELECT 'edges', 'depends_on' FROM rl UNION ALL SELECT 'episodes', 'code-sync' FROM tot)
SELECT rows, kind, count(*) AS n FROM x GROUP BY 1, 2"""


@query("sync_repos")
def sync_repos(spark, root):
    from engram.plans.ingest import sync_snapshots

    snaps = _snapshots(spark, root)
    old, new = snaps.filter("commit_hash < 'c2000'"), snaps.filter("commit_hash >= 'c2000'")
    out = sync_snapshots(old, new, fx.nodes(spark, root, embeddings=False), fx.ORDERS_AS_OF)
    result = None
    for name in ("snapshots", "nodes", "edges", "episodes"):
        p = out[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("rows"), "n")
        result = p if result is None else result.unionByName(p)
    return result
