"""Registered queries: markdown sources (S4-S14) and hybrid retrieval (R1-R25)."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.catalog import fixtures as fx
from engram.catalog import oracles as o
from engram.catalog.q_messages import _r
from engram.catalog.q_tables import _EXECUTED, _IDENTITY, _PROC_TRIGGERS, _executed
from engram.catalog.registry import query
from engram.functions import lexicons as lx
from engram.operators import retrieval as r
from engram.session import use_checkpoints
from engram.sources import markdown as md

AS_OF = fx.DOCS_AS_OF
_AS = "2024-03-01"

FILES = """
files AS (
  SELECT 'memory/' || name AS path, name, content, length(content) AS size, modified FROM (
    SELECT CASE WHEN n_nationkey = 0 THEN 'MEMORY.md' WHEN n_nationkey = 1 THEN 'lessons.md'
      WHEN n_nationkey % 3 = 0 THEN '2024-02-' || lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') || '.md' ELSE lower(n_name) || '.md' END AS name,
    'opening words that come before any heading' || chr(10) || '# ' || n_name || chr(10) || 'The home of ' || n || ' customers, see below.' || chr(10) || '## Customers 🔥' || chr(10)
      || lines || chr(10) || '### Notes' || chr(10) || '**Mistake:** late delivery to Ann Marsh' || chr(10) || '**Rule:** ship early' || chr(10)
      || '**Ann Marsh** and **Build Agent** met **Tom Fielding**' || chr(10) || '#### Detail CRITICAL' || chr(10) || 'short' || chr(10)
      || '## Decision' || chr(10) || 'We decided that the decision is live and deployed for ' || n_name || '.' || chr(10) AS content,
    TIMESTAMP '2024-02-01' + to_days(CAST(n_nationkey AS INTEGER)) AS modified
    FROM nation JOIN (SELECT c_nationkey, count(*) AS n, string_agg('- **' || c_mktsegment || '** ' || c_name || ' balance $' || printf('%.2f', c_acctbal), chr(10) ORDER BY c_custkey) AS lines
      FROM customer GROUP BY 1) ON c_nationkey = n_nationkey))
"""


def sections_sql(level: int) -> str:
    return f"""
lines{level} AS (SELECT path, name, modified, unnest(string_split(content, chr(10))) AS t, generate_subscripts(string_split(content, chr(10)), 1) AS ln, len(string_split(content, chr(10))) AS nl FROM files),
isl{level} AS (SELECT *, CASE WHEN regexp_matches(t, '^#{{1,{level}}}\\s+.+$') THEN 1 ELSE 0 END AS h, sum(CASE WHEN regexp_matches(t, '^#{{1,{level}}}\\s+.+$') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY ln) AS k FROM lines{level}),
sec{level} AS (SELECT path, any_value(name) AS name, any_value(modified) AS modified, k,
   coalesce(max(CASE WHEN h = 1 THEN regexp_replace(t, '^#+\\s*', '') END), replace(any_value(name), '.md', '')) AS heading,
   coalesce(max(CASE WHEN h = 1 THEN length(regexp_extract(t, '^#+')) END), 1) AS level,
   trim(coalesce(string_agg(t, chr(10) ORDER BY ln) FILTER (h = 0), ''), chr(10) || ' ') AS content, min(ln) AS line_start, max(ln) AS line_end FROM isl{level} GROUP BY path, k),
sections{level} AS (SELECT * FROM sec{level} WHERE length(content) > 20)"""


def sections(spark, root, level=3):
    return md.split_sections(md.with_file_role(fx.files_nation(spark, root)), max_level=level)


@query("section_split")
def section_split(spark, root):
    return sections(spark, root, 6).select("path", "heading", F.col("level").cast("int").alias("level"), "content", "line_start", "line_end")


o.SQL["section_split"] = f"WITH {FILES}, {sections_sql(6)} SELECT path, heading, level, content, line_start, line_end FROM sections6"


@query("section_split_search")
def section_split_search(spark, root):
    return sections(spark, root, 3).select("path", "heading", "content", "line_start", "line_end")


o.SQL["section_split_search"] = f"WITH {FILES}, {sections_sql(3)} SELECT path, heading, content, line_start, line_end FROM sections3"

_ROLE = """CASE WHEN lower(name)='memory.md' THEN 'memory' WHEN lower(name)='lessons.md' THEN 'lesson'
  WHEN regexp_matches(lower(name), '^\\d{4}-\\d{2}-\\d{2}\\.md$') THEN 'daily' WHEN contains(path, 'research') THEN 'research' ELSE 'other' END"""


@query("corpus_stats")
def corpus_stats(spark, root):
    return md.corpus_stats(md.with_file_role(fx.files_nation(spark, root)))


o.SQL["corpus_stats"] = f"WITH {FILES} SELECT {_ROLE} AS role, count(*) AS files, CAST(round(sum(size) / 1024.0) AS BIGINT) AS size_kb FROM files GROUP BY 1"


@query("select_files")
def select_files(spark, root):
    return md.select_files(md.with_file_role(fx.files_nation(spark, root)), skip=["other"], order=lx.ROLE_ORDER_MODEL).select("path", "role", "role_order")


o.SQL["select_files"] = f"""
WITH {FILES} SELECT path, role, CASE role WHEN 'memory' THEN 4 WHEN 'lesson' THEN 6 WHEN 'daily' THEN 7 ELSE 8 END AS role_order FROM (SELECT path, {_ROLE} AS role FROM files) WHERE role <> 'other'"""


@query("triage")
def triage(spark, root):
    docs = fx.table(spark, root, "documents")
    rows = docs.select(
        F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("file"), F.col("n_chars").alias("size"),
        F.when(F.col("doc_id") % 4 == 0, "INGEST").when(F.col("doc_id") % 4 == 1, "SKIP").when(F.col("doc_id") % 4 == 2, "SKIM").otherwise("MAYBE").alias("priority"),
    )
    return md.triage_summary(rows)


o.SQL["triage"] = """
WITH t AS (SELECT CASE doc_id % 4 WHEN 0 THEN 'INGEST' WHEN 1 THEN 'SKIP' ELSE 'SKIM' END AS priority, n_chars FROM documents),
g AS (SELECT priority, count(*) AS files, CAST(sum(CASE priority WHEN 'INGEST' THEN ceil(n_chars / 2000.0) WHEN 'SKIM' THEN ceil(n_chars / 4000.0) ELSE 0 END) AS BIGINT) AS sections FROM t GROUP BY 1)
SELECT *, round(CASE priority WHEN 'INGEST' THEN sections * 2200 / 1e6 * 15 + sections * 200 / 1e6 * 75 WHEN 'SKIM' THEN sections * 1500 / 1e6 * 3 + sections * 150 / 1e6 * 15 ELSE 0 END, 2) AS cost FROM g"""


@query("manifest_filter")
def manifest_filter(spark, root):
    manifest = fx.table(spark, root, "nation").select(
        F.concat(F.lit("corpus/"), F.lower("n_name"), F.lit(".md")).alias("file"),
        F.when(F.col("n_regionkey") == 0, "INGEST").when(F.col("n_regionkey") == 1, "SKIM").otherwise("SKIP").alias("priority"),
    )
    return md.filter_by_manifest(fx.files_nation(spark, root), manifest).select("path")


o.SQL["manifest_filter"] = f"WITH {FILES} SELECT path FROM files WHERE name IN (SELECT lower(n_name) || '.md' FROM nation WHERE n_regionkey IN (0, 1))"


@query("file_previews")
def file_previews(spark, root):
    done = fx.table(spark, root, "region").select(F.concat(F.lit("nation_"), F.col("r_regionkey").cast("string"), F.lit(".md")).alias("name"))
    return md.file_previews(fx.files_nation(spark, root), done).select("path", "batch", "preview")


o.SQL["file_previews"] = f"""
WITH {FILES} SELECT path, (row_number() OVER (ORDER BY path) - 1) // 5 AS batch,
 'HEADERS:' || chr(10) || array_to_string(list_filter(string_split(content, chr(10)), lambda x: starts_with(x, '#'))[1:15], chr(10)) || chr(10) || chr(10) || 'PREVIEW:' || chr(10) || substring(content, 1, 500) AS preview
FROM files WHERE name NOT IN (SELECT 'nation_' || r_regionkey || '.md' FROM region)"""


# --- query side -----------------------------------------------------------------------------------
def _all_texts(spark, root):
    """Benchmark questions, nation questions and every message as queries."""
    q = fx.queries_bm(spark, root).select("query_id", "text")
    msgs = fx.messages_ev(spark, root).select((F.col("message_id") + 2_000_000).alias("query_id"), "text")
    return q.unionByName(msgs)


_ALL_TEXTS = f"{o.QUERIES}, {o.MESSAGES_EV}, texts AS (SELECT query_id, text FROM queries UNION ALL SELECT message_id + 2000000, text FROM messages)"
_SUMS = {
    k: "(" + " + ".join(f"CASE WHEN {o.rx('lower(text)', p)} THEN {w} ELSE 0 END" for t, w, p in lx.QUERY_SIGNALS if t == k) + ")"
    for k in lx.QUERY_TYPES
}


def classified_sql(source: str) -> str:
    best = f"greatest({', '.join('s_' + k for k in lx.QUERY_TYPES)})"
    total = " + ".join("s_" + k for k in lx.QUERY_TYPES)
    winner = "CASE " + " ".join(f"WHEN s_{k} = best AND best > 0 THEN '{k}'" for k in lx.QUERY_TYPES) + " ELSE 'conceptual' END"
    return f"""
cl0 AS (SELECT *, {', '.join(f'{e} AS s_{k}' for k, e in _SUMS.items())} FROM {source}),
cl1 AS (SELECT *, {best} AS best, {total} AS total FROM cl0),
classified AS (SELECT *, {winner} AS query_type, CASE WHEN total > 0 THEN best / total::DOUBLE ELSE 0.2 END AS type_confidence FROM cl1)"""


@query("query_classify")
def query_classify(spark, root):
    return r.classify_queries(_all_texts(spark, root)).select("query_id", "query_type", *_r("type_confidence"))


o.SQL["query_classify"] = f"WITH {_ALL_TEXTS}, {classified_sql('texts')} SELECT query_id, query_type, round(type_confidence, 6) AS type_confidence FROM classified"


def weights_sql() -> str:
    cols = []
    for i, s in enumerate(lx.SCORES):
        own = "CASE query_type " + " ".join(f"WHEN '{k}' THEN {w[i]}" for k, w in lx.WEIGHTS.items()) + " END"
        cols.append(f"(({own})::DOUBLE * bl + {lx.DEFAULT_WEIGHTS[i]} * (1 - bl)) AS w_{s}")
    return f"weighted AS (SELECT *, {', '.join(cols)} FROM (SELECT *, least(1.0, type_confidence * 1.5) AS bl FROM classified))"


@query("query_weights")
def query_weights(spark, root):
    return r.query_weights(r.classify_queries(_all_texts(spark, root))).select("query_id", *_r(*[f"w_{s}" for s in lx.SCORES]))


o.SQL["query_weights"] = f"WITH {_ALL_TEXTS}, {classified_sql('texts')}, {weights_sql()} SELECT query_id, {', '.join(f'round(w_{s}, 6) AS w_{s}' for s in lx.SCORES)} FROM weighted"

_IMPLIED = "list_filter([" + ", ".join(f"CASE WHEN {o.contains_any('lower(text)', ws)} THEN '{k}' END" for k, ws in lx.TYPE_KEYWORDS) + "], lambda x: x IS NOT NULL)"
_BOOSTS = f"""
mentioned AS (SELECT query_id, id AS node_id, type AS node_type FROM queries JOIN nodes ON length(name) >= 3 AND contains(lower(text), lower(name))),
mt AS (SELECT query_id, list(DISTINCT node_type) AS ts FROM mentioned GROUP BY 1),
impl AS (SELECT query_id, coalesce(list_filter(im, lambda x: NOT list_contains(coalesce(ts, []), x))[1], im[1]) AS implied_type FROM (SELECT q.query_id, {_IMPLIED} AS im, ts FROM queries q LEFT JOIN mt USING (query_id))),
und AS (SELECT source_id AS src, target_id AS dst, relationship, strength FROM edges UNION ALL SELECT target_id, source_id, relationship, strength FROM edges WHERE source_id <> target_id),
boosts AS (SELECT query_id, id, max(boost) AS boost FROM (SELECT query_id, node_id AS id, 1.0::DOUBLE AS boost FROM mentioned
  UNION ALL SELECT m.query_id, n.id, coalesce(nullif(strength, 0), 0.5) FROM mentioned m JOIN impl i ON i.query_id = m.query_id JOIN und ON src = node_id JOIN nodes n ON n.id = dst AND n.type = implied_type
    WHERE node_type IN ('person','organization')) GROUP BY 1, 2)"""


@query("routing_boosts")
def routing_boosts(spark, root):
    return r.routing_boosts(fx.queries_bm(spark, root), fx.nodes(spark, root, embeddings=False), fx.edges(spark, root)).select("query_id", "id", *_r("boost"))


o.SQL["routing_boosts"] = f"WITH {o.QUERIES}, {o.NODES}, {o.EDGES}, {_BOOSTS} SELECT query_id, id, round(boost, 6) AS boost FROM boosts"

_WORDS = """qw AS (SELECT query_id, lower(text) AS ql, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: length(w) > 2) AS ws FROM queries)"""


def text_match_sql(fields: list[str]) -> str:
    def one(f):
        return (
            f"CASE WHEN length({f}) > 0 THEN greatest(CASE WHEN contains(lower({f}), ql) THEN 0.9 ELSE 0.0 END,"
            f" len(list_filter(ws, lambda w: contains(lower({f}), w))) / greatest(len(ws), 1)::DOUBLE * 0.8) END"
        )
    return f"coalesce(greatest({', '.join(one(f) for f in fields)}), 0.0)"


def any_word(expr: str) -> str:
    return f"len(list_filter(ws, lambda w: contains({expr}, w))) > 0"


_SEC_PRIORITY = """CASE WHEN path = 'MEMORY.md' THEN 1.0 WHEN regexp_matches(path, '\\d{4}-\\d{2}-\\d{2}') THEN
   CASE WHEN age < 1 THEN 0.95 WHEN age < 2 THEN 0.85 WHEN age < 7 THEN 0.7 ELSE 0.5 END
  WHEN contains(path, 'research') THEN 0.6 WHEN contains(path, 'journey') OR contains(path, 'lesson') THEN 0.75 ELSE 0.5 END::DOUBLE"""
_SECTION_SCORES = f"""
ss0 AS (SELECT s.*, 'md:' || path || ':' || line_start AS id, lower(heading || ' ' || content) AS low, {o.recency('modified', _AS, 14.0)} AS rec,
   (epoch_us(TIMESTAMP '{_AS}') - epoch_us(try_cast(nullif(regexp_extract(path, '\\d{{4}}-\\d{{2}}-\\d{{2}}'), '') AS TIMESTAMP))) / 86400000000.0 AS age FROM sections3 s),
ss1 AS (SELECT *, {_SEC_PRIORITY} AS pri FROM ss0),
ss2 AS (SELECT q.query_id, ql, ws, s.*, list_filter(ws, lambda w: contains(low, w)) AS mw, len(list_filter(ws, lambda w: contains(lower(heading), w))) AS hw FROM qw q, ss1 s),
ss3 AS (SELECT *, greatest(CASE WHEN contains(low, ql) THEN 0.95 ELSE 0 END, len(mw) / greatest(len(ws), 1)::DOUBLE * 0.85) AS b,
   list_max(list_transform(mw, lambda w: instr(low, w))) - list_min(list_transform(mw, lambda w: instr(low, w))) AS spread FROM ss2),
ss4 AS (SELECT *, least(1.0, CASE WHEN len(mw) >= 2 AND spread < 200 THEN least(1.0, b + 0.1) ELSE b END + hw * 0.05) AS s_text, least(1.0, hw * 0.3) AS s_header FROM ss3),
ss5 AS (SELECT *, s_text * 0.5 + s_header * 0.2 + (pri * 0.15 + rec * 0.15) AS s_total FROM ss4),
sect AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s_total, 9) DESC, id) AS rn FROM ss5 WHERE s_total >= 0.15) WHERE rn <= {{k}})"""


@query("section_search")
def section_search(spark, root):
    found = r.search_sections(fx.queries_bm(spark, root), sections(spark, root), AS_OF, 10)
    return found.select("query_id", "id", *_r("s_text", "s_header", "s_priority", "s_recency", "s_total"))


o.SQL["section_search"] = f"""
WITH {o.QUERIES}, {_WORDS}, {FILES}, {sections_sql(3)}, {_SECTION_SCORES.replace("{k}", "10")}
SELECT query_id, id, round(s_text, 6) AS s_text, round(s_header, 6) AS s_header, round(pri, 6) AS s_priority, round(rec, 6) AS s_recency, round(s_total, 6) AS s_total FROM sect"""


def _tables(spark, root):
    """The derived graph tables are stored once, as they are in real use."""
    use_checkpoints(spark)
    return {
        "nodes": fx.nodes(spark, root).checkpoint(), "edges": fx.edges(spark, root).checkpoint(),
        "episodes": fx.episodes_doc(spark, root), "lessons": fx.lessons_bm(spark, root),
        "identity": fx.identity_rows(spark), "procedures": _executed(spark, root).checkpoint(),
        "sections": sections(spark, root),
    }


def _hits_sql(limit: int) -> str:
    node_text = "lower(name || chr(1) || context || chr(1) || '{{}}')"
    ncontent = "'[' || type || '] ' || name || chr(10) || context"
    steps = (
        "psteps(name, steps) AS (VALUES "
        + ", ".join(f"({o.lit(p[0])}, [{', '.join(o.lit(s) for s in p[3])}])" for p in fx.EVENT_PROCEDURES)
        + ")"
    )
    return f"""
{o.QUERIES}, {o.NODES}, {o.EDGES}, {o.EPISODES}, {o.LESSONS}, {_IDENTITY}, {_EXECUTED}, {_PROC_TRIGGERS}, {steps}, {FILES}, {sections_sql(3)}, {_WORDS}, {_SECTION_SCORES.replace("{k}", str(2 * limit))}, {_BOOSTS},
nk AS (SELECT * FROM (SELECT query_id, n.id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, n.id) AS rk FROM (
   SELECT q.query_id, n.id, {o.cosine('q.embedding', 'n.embedding')} AS sim FROM queries q, nodes n WHERE q.embedding IS NOT NULL AND n.embedding IS NOT NULL) n WHERE sim >= 0.2) WHERE rk <= {2 * limit}),
nw AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, id) AS rk FROM qw, nodes WHERE {any_word(node_text)}) WHERE rk <= {3 * limit}),
nm AS (SELECT coalesce(nk.query_id, nw.query_id) AS query_id, coalesce(nk.id, nw.id) AS id, sim, nk.rk AS r1, nw.rk AS r2 FROM nk FULL JOIN nw ON nk.query_id = nw.query_id AND nk.id = nw.id),
nodesx AS (SELECT *, {o.effective('confidence', 'last_verified', _AS)} AS eff, {o.recency('last_verified', _AS)} AS rec, {ncontent} AS content FROM nodes),
hn AS (SELECT nm.query_id, 'semantic' AS memory_type, n.id, n.name, n.type, content,
   CASE WHEN r1 IS NOT NULL AND r2 IS NOT NULL THEN greatest(sim, {text_match_sql(['n.name', 'context'])}) WHEN r1 IS NOT NULL THEN sim ELSE {text_match_sql(['n.name', 'context'])} END AS tm,
   CASE WHEN r1 IS NOT NULL THEN eff ELSE confidence END AS imp, rec, CASE WHEN r1 IS NOT NULL THEN eff ELSE confidence END AS conf, r1 IS NOT NULL AND basis = 'stated' AS stated, 0 AS ec, 0.0::DOUBLE AS sr, 0 AS g, coalesce(r1, r2 + 1000000)::DOUBLE AS fr
  FROM nm JOIN qw USING (query_id) JOIN nodesx n ON n.id = nm.id),
ek AS (SELECT * FROM (SELECT query_id, id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rk FROM (
   SELECT q.query_id, e.id, {o.cosine('q.embedding', 'e.embedding')} AS sim FROM queries q, episodes e WHERE q.embedding IS NOT NULL AND e.embedding IS NOT NULL) WHERE sim >= 0.25) WHERE rk <= {2 * limit}),
ew AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY importance_score DESC, id) AS rk FROM qw, episodes WHERE {any_word("lower(summary || chr(1) || narrative)")}) WHERE rk <= {2 * limit}),
em AS (SELECT coalesce(ek.query_id, ew.query_id) AS query_id, coalesce(ek.id, ew.id) AS id, sim, ek.rk AS r1, ew.rk AS r2 FROM ek FULL JOIN ew ON ek.query_id = ew.query_id AND ek.id = ew.id),
he AS (SELECT em.query_id, 'episode', e.id, NULL, NULL, '[Episode] ' || summary || chr(10) || substring(narrative, 1, 200), CASE WHEN r1 IS NOT NULL THEN sim ELSE {text_match_sql(['summary', 'narrative'])} END,
   importance_score, {o.recency('created_at', _AS)}, importance_score, FALSE, 0, 0.0::DOUBLE, 1, coalesce(r1, r2 + 1000000)::DOUBLE FROM em JOIN qw USING (query_id) JOIN episodes e ON e.id = em.id),
hl AS (SELECT query_id, 'lesson', id, NULL, NULL, '[Lesson - ' || severity || '] ' || statement || chr(10) || 'Prevention: ' || prevention_rule, {text_match_sql(['statement', 'prevention_rule'])},
   CASE severity WHEN 'critical' THEN 1.0 WHEN 'important' THEN 0.7 ELSE 0.4 END, {o.recency('created_at', _AS)}, least(1.0, 0.3 + times_reinforced * 0.1), FALSE, 0, 0.0::DOUBLE, 2, 0.0
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'important' THEN 1 ELSE 2 END, times_reinforced DESC, id) AS rk FROM qw, lessons WHERE {any_word("lower(statement || chr(1) || prevention_rule)")}) WHERE rk <= {limit}),
hi AS (SELECT query_id, 'identity', id, NULL, NULL, '[Identity - ' || category || '] ' || key || ': ' || value, {text_match_sql(['key', 'value'])},
   CASE category WHEN 'core' THEN 1.0 WHEN 'value' THEN 0.9 ELSE 0.7 END, 1.0, least(1.0, 0.5 + times_affirmed * 0.05), FALSE, 0, 0.0::DOUBLE, 3, 0.0 FROM qw, identity WHERE {any_word("lower(key || chr(1) || value || chr(1) || category)")}),
px AS (SELECT 'p:' || d.name AS id, d.*, p.type, ps.steps, triggers, array_to_string(ps.steps, '. ') AS st FROM done d JOIN procs p USING (name) JOIN psteps ps USING (name) JOIN ptrig USING (name)),
hp AS (SELECT query_id, 'procedure', id, name, type, '[Procedure - ' || type || '] ' || name || chr(10) || 'Steps: ' || substring(st, 1, 300), {text_match_sql(['name', 'st'])}, confidence, {o.recency('last_executed', _AS)}, confidence, FALSE, execution_count, success_count / execution_count::DOUBLE, 4, 0.0
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, id) AS rk FROM qw, px WHERE {any_word("lower(name || chr(1) || array_to_string(steps, chr(1)) || chr(1) || 'phrases' || triggers)")}) WHERE rk <= {limit}),
hs AS (SELECT query_id, 'markdown', id, heading, path, '[' || path || '] ' || heading || chr(10) || CASE WHEN length(content) > 500 THEN substring(content, 1, 500) || '...' ELSE content END, s_text, pri, rec, pri, FALSE, 0, 0.0::DOUBLE, 5, 0.0 FROM sect),
h0 AS (SELECT * FROM hn UNION ALL SELECT * FROM he UNION ALL SELECT * FROM hl UNION ALL SELECT * FROM hi UNION ALL SELECT * FROM hp UNION ALL SELECT * FROM hs),
h1 AS (SELECT h0.* REPLACE (greatest(tm, coalesce(boost, 0) * 0.7) AS tm), coalesce(boost, 0.0) AS gp, boost IS NOT NULL AS routed FROM h0 LEFT JOIN boosts USING (query_id, id)
  UNION ALL SELECT b.query_id, 'semantic', n.id, n.name, n.type, content, 0.0, eff, rec, eff, FALSE, 0, 0.0, 6, -boost, boost, TRUE FROM boosts b JOIN nodesx n ON n.id = b.id
   WHERE NOT EXISTS (SELECT 1 FROM h0 WHERE h0.query_id = b.query_id AND h0.id = b.id))"""


def _prox_sql(source: str, p: str = "") -> str:
    return f"""
seed{p} AS (SELECT * FROM (SELECT query_id, id, name, row_number() OVER (PARTITION BY query_id ORDER BY g, fr, id) AS rn FROM {source} WHERE memory_type='semantic') WHERE rn <= 5),
near{p} AS (SELECT s.query_id, s.id AS seed, s.name AS sname, n.name AS endpoint, row_number() OVER (PARTITION BY s.query_id, s.id ORDER BY strength DESC, n.name, upper(relationship), dst) AS rn
  FROM seed{p} s JOIN und ON src = s.id AND src <> dst JOIN nodes n ON n.id = dst),
conn{p} AS (SELECT query_id, seed, endpoint, min(depth) AS depth FROM (SELECT query_id, seed, endpoint, 1 AS depth FROM near{p}
   UNION ALL SELECT query_id, seed, d.name, 2 FROM (SELECT DISTINCT query_id, seed, sname, endpoint FROM near{p} WHERE rn <= 10) t JOIN nodes m ON m.name = endpoint JOIN und u ON u.src = m.id JOIN nodes d ON d.id = u.dst WHERE d.name <> sname) GROUP BY 1, 2, 3),
tgt{p} AS (SELECT query_id, id, memory_type, 1.0 / min(depth) AS p FROM (SELECT c.query_id, h.id, h.memory_type, h.routed, c.depth, row_number() OVER (PARTITION BY c.query_id, c.seed, c.endpoint ORDER BY g, fr, h.id) AS rn
   FROM conn{p} c JOIN {source} h ON h.query_id = c.query_id AND h.name = c.endpoint AND h.id <> c.seed) WHERE rn = 1 AND NOT routed GROUP BY 1, 2, 3),
prox{p} AS (SELECT h.* REPLACE (greatest(gp, coalesce(p, 0)) AS gp) FROM {source} h LEFT JOIN tgt{p} USING (query_id, id, memory_type))"""


_AFF = "CASE " + " ".join(
    f"WHEN query_type='{q}' AND memory_type='{t}' THEN {a}" for q, row in lx.LAYER_AFFINITY.items() for t, a in zip(lx.MEMORY_TYPES, row)
) + " ELSE 1.0 END"


def _fuse_sql(source: str, limit: int, min_score: float, p: str = "") -> str:
    return f"""
f0{p} AS (SELECT h.*, query_type, {_AFF} * CASE WHEN memory_type = 'procedure' AND query_type = 'procedural' AND ec > 0 THEN 1 + least(ec, 10) / 10.0 * 0.15 * sr ELSE 1 END *
  CASE WHEN memory_type='markdown' THEN tm * (w_text_match + w_graph_proximity * 0.6) + imp * w_importance + rec * (w_recency + w_graph_proximity * 0.4) + conf * w_confidence
  ELSE (tm * w_text_match + gp * w_graph_proximity + imp * w_importance + rec * w_recency + conf * w_confidence)
   * CASE WHEN length(content) < 50 THEN 0.6 WHEN length(content) < 100 THEN 0.8 ELSE 1 END * CASE WHEN stated THEN 1.05 ELSE 1 END END AS t0 FROM {source} h JOIN weighted USING (query_id)),
f1{p} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(t0::DOUBLE, 9) DESC, memory_type, id) AS rank FROM f0{p} WHERE round(t0::DOUBLE, 9) >= {min_score}),
final{p} AS (SELECT * FROM f1{p} WHERE rank <= {limit})"""


@query("hybrid_search")
def hybrid_search(spark, root):
    out = r.hybrid_search(fx.queries_bm(spark, root), _tables(spark, root), AS_OF)
    return out.select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "memory_type", "id", "query_type",
        *_r("total_score", "text_match", "graph_proximity", "importance", "recency", "confidence"),
    )


o.SQL["hybrid_search"] = f"""
WITH {_hits_sql(10)}, {classified_sql('queries')}, {weights_sql()}, {_prox_sql('h1')}, {_fuse_sql('prox', 10, 0.1)}
SELECT query_id, rank, memory_type, id, query_type, round(t0, 6) AS total_score, round(tm, 6) AS text_match, round(gp, 6) AS graph_proximity, round(imp, 6) AS importance, round(rec, 6) AS recency, round(conf, 6) AS confidence FROM final"""


@query("hybrid_search_default_weights")
def hybrid_search_default_weights(spark, root):
    tables = _tables(spark, root)
    out = r.hybrid_search(fx.queries_bm(spark, root), tables, AS_OF, limit=5, weights={}, memory_types=["lesson", "identity", "procedure"])
    return out.select("query_id", F.col("rank").cast("bigint").alias("rank"), "memory_type", "id", *_r("total_score"))


_DEFAULT_WEIGHTED = "weighted AS (SELECT *, " + ", ".join(f"{w}::DOUBLE AS w_{s}" for s, w in zip(lx.SCORES, lx.DEFAULT_WEIGHTS)) + " FROM classified)"
o.SQL["hybrid_search_default_weights"] = f"""
WITH {_hits_sql(5)}, {classified_sql('queries')}, {_DEFAULT_WEIGHTED}, few AS (SELECT * FROM h1 WHERE memory_type IN ('lesson','identity','procedure')), {_fuse_sql('few', 5, 0.1)}
SELECT query_id, rank, memory_type, id, round(t0, 6) AS total_score FROM final"""


@query("compare_search")
def compare_search(spark, root):
    return r.compare_search(fx.queries_bm(spark, root), _tables(spark, root), AS_OF).select(
        "query_id", "system", "results", "markdown_results", F.array_join("sources", ",").alias("sources"), *_r("top_score")
    )


def _cmp(system, final, src):
    return f"SELECT query_id, '{system}' AS system, count(*) AS results, count(*) FILTER (memory_type='markdown') AS markdown_results, string_agg(DISTINCT {src}, ',' ORDER BY {src}) AS sources, round(max(t0), 6) AS top_score FROM {final} GROUP BY 1"


o.SQL["compare_search"] = f"""
WITH {_hits_sql(5)}, {classified_sql('queries')}, {weights_sql()}, hb AS (SELECT * FROM h1 WHERE memory_type <> 'markdown'), hm AS (SELECT * FROM h1 WHERE memory_type = 'markdown'),
{_prox_sql('hb', 'b')}, {_prox_sql('h1', 'u')}, {_fuse_sql('proxb', 5, 0.05, 'b')}, {_fuse_sql('hm', 5, 0.05, 'm')}, {_fuse_sql('proxu', 5, 0.05, 'u')}
{_cmp('brain', 'finalb', 'memory_type')} UNION ALL {_cmp('markdown', 'finalm', 'type')} UNION ALL {_cmp('unified', 'finalu', 'memory_type')}"""


@query("retrieval_eval")
def retrieval_eval(spark, root):
    tables = _tables(spark, root)
    hits = r.hybrid_search(fx.queries_bm(spark, root), tables, AS_OF, limit=5, memory_types=["lesson", "identity", "procedure"])
    bm = fx.table(spark, root, "benchmark")
    cases = bm.select(
        F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 2 == 0, "retrieval").otherwise("identity").alias("category"),
        F.slice(F.split("text", " "), 8, 3).alias("expected_keywords"),
        F.when(F.col("item_id") % 4 == 0, F.array(F.lit("Lesson"))).otherwise(fx.no_strings()).alias("expected_entities"),
    )
    per_case, _ = r.evaluate_retrieval(hits, cases)
    return per_case.select("query_id", "category", *_r("keyword_hit_rate", "entity_hit_rate", "top_score"), F.col("result_count").cast("bigint").alias("result_count"))


o.SQL["retrieval_eval"] = f"""
WITH {_hits_sql(5)}, {classified_sql('queries')}, {weights_sql()}, few AS (SELECT * FROM h1 WHERE memory_type IN ('lesson','identity','procedure')), {_fuse_sql('few', 5, 0.1)},
allc AS (SELECT query_id, lower(string_agg(content, ' ' ORDER BY rank)) AS a, count(*) AS n, max(t0) AS top FROM final GROUP BY 1),
cases AS (SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN 'retrieval' ELSE 'identity' END AS category, string_split(text, ' ')[8:10] AS kw, item_id % 4 = 0 AS want FROM benchmark)
SELECT c.query_id, category, round(CASE WHEN len(kw) > 0 THEN len(list_filter(kw, lambda k: contains(coalesce(a, ''), lower(k)))) / len(kw)::DOUBLE ELSE 0 END, 6) AS keyword_hit_rate,
  CASE WHEN want THEN CASE WHEN contains(coalesce(a, ''), 'lesson') THEN 1.0 ELSE 0.0 END ELSE 1.0 END::DOUBLE AS entity_hit_rate, round(coalesce(top, 0), 6) AS top_score, coalesce(n, 0) AS result_count
FROM cases c LEFT JOIN allc a ON a.query_id = c.query_id"""
