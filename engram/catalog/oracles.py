"""DuckDB SQL for the registered queries, on the same Parquet tables."""

from __future__ import annotations

from engram.functions import lexicons as lx


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def count_contained(expr: str, words: list[str]) -> str:
    return "(" + " + ".join(f"CASE WHEN contains({expr}, {lit(w)}) THEN 1 ELSE 0 END" for w in words) + ")"


def contains_any(expr: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({expr}, {lit(w)})" for w in words) + ")"


def re2(pattern: str) -> str:
    return pattern


def rx(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {lit(pattern)})"


def rx_any(expr: str, patterns: list[str], prefix: str = "") -> str:
    return "(" + " OR ".join(rx(expr, prefix + p) for p in patterns) + ")"


MESSAGES_EV = """
messages AS (
  SELECT event_id AS message_id, CAST(user_id AS VARCHAR) AS session_id, event_id AS seq, ts,
    CASE WHEN event_type='view' THEN 'system' WHEN event_type='click' THEN 'agent' ELSE 'user' END AS sender,
    CASE WHEN event_type='view' THEN 'system' WHEN event_type='click' THEN 'assistant' ELSE 'user' END AS role,
    CASE WHEN event_id % 103 = 0 THEN 'ok' WHEN event_id % 101 = 0 THEN 'HEARTBEAT_OK'
         WHEN event_id % 97 = 0 THEN body || ' password: p' || event_id || 'abcdefgh' ELSE body END AS text
  FROM (SELECT *, CASE event_type
      WHEN 'error' THEN 'The build failed with an error, please fix it now! It cost $' || printf('%.2f', value) || ' at ' || k || '% load.'
      WHEN 'signup' THEN 'Thank you! User ' || user_id || ' says this is amazing work and we are grateful.'
      WHEN 'purchase' THEN 'We decided to buy ' || k || ' rows for $' || printf('%.2f', value) || ' since Jan 3, 2024.'
      WHEN 'click' THEN 'What is the status of order ' || k || '?'
      ELSE 'User ' || user_id || ' looked at ' || k || ' rows' END AS body
    FROM (SELECT *, CAST(props->>'$.k' AS BIGINT) AS k FROM events)))
"""

MESSAGES_CONV = """
messages AS (
  SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS seq,
    TIMESTAMP '2024-01-01' + to_seconds(conv_id*3600 + turn*4) AS ts, role AS sender, role, text
  FROM conversations)
"""

_STATUS = "CASE WHEN {b} < 0 THEN 'account paused' WHEN {b} > 8000 THEN 'active priority' ELSE 'regular' END"

NODES = f"""
nodes AS (
  SELECT 'c' || c_custkey AS id, 'person' AS type, c_name AS name, {_STATUS.format(b='c_acctbal')} AS context,
    0.3 + (c_custkey % 8) / 10.0::DOUBLE AS confidence, coalesce(seen, TIMESTAMP '1998-01-01') AS last_verified,
    coalesce(sources, 0) AS source_count, 'observed' AS basis, e.embedding
  FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS seen, count(*) AS sources FROM orders GROUP BY 1) ON o_custkey = c_custkey
  LEFT JOIN embeddings e ON e.vec_id = c_custkey
  UNION ALL
  SELECT 's' || s_suppkey, 'organization', s_name, {_STATUS.format(b='s_acctbal')},
    0.3 + (s_suppkey % 8) / 10.0::DOUBLE, coalesce(seen, TIMESTAMP '1998-01-01'), coalesce(sources, 0), 'observed', NULL
  FROM supplier LEFT JOIN (SELECT l_suppkey, max(l_shipdate) AS seen, count(*) AS sources FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey
  UNION ALL SELECT 'n' || n_nationkey, 'place', n_name, 'regular', 0.9::DOUBLE, TIMESTAMP '1998-01-01', 0, 'stated', NULL FROM nation
  UNION ALL SELECT 'r' || r_regionkey, 'place', r_name, 'regular', 0.9::DOUBLE, TIMESTAMP '1998-01-01', 0, 'stated', NULL FROM region
  UNION ALL SELECT 't:' || p_name, 'tool', p_name, 'regular', 0.9::DOUBLE, TIMESTAMP '1998-01-01', 0, 'observed', NULL FROM (SELECT DISTINCT p_name FROM part))
"""

EDGES = """
edges AS (
  SELECT *, source_id || ':' || target_id || ':' || relationship AS id FROM (
    SELECT 'c' || c_custkey AS source_id, 'n' || c_nationkey AS target_id, 'located_in' AS relationship, 0.9::DOUBLE AS strength FROM customer
    UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'located_in', 0.9::DOUBLE FROM supplier
    UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'part_of', 0.9::DOUBLE FROM nation
    UNION ALL SELECT 'c' || o_custkey, 's' || l_suppkey, 'works_with', least(1.0::DOUBLE, 0.3::DOUBLE + count(*) * 0.05::DOUBLE)
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_suppkey))
"""

EPISODES = """
episodes AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, d.doc_id, TIMESTAMP '2024-01-01' + to_hours(d.doc_id) AS created_at,
    source AS session_id, substring(text, 1, 100) AS summary, text AS narrative, [source] AS participants,
    list_filter(['que','der','and','los','the'], lambda t: contains(lower(text), t)) AS topics,
    ((d.doc_id * 37) % 100) / 100.0::DOUBLE AS importance_score, CAST(d.doc_id % 3 AS INTEGER) AS access_count,
    d.doc_id % 7 = 0 AS decay_protected, e.embedding
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id)
"""

QUERIES = """
queries AS (
  SELECT q.query_id, q.text, e.embedding FROM (
    SELECT item_id AS query_id, text FROM benchmark
    UNION ALL SELECT n_nationkey + 1000000, 'Which people are working with ' || s_name || ' in ' || n_name
      FROM nation JOIN (SELECT s_nationkey, min(s_name) AS s_name FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey) q
  LEFT JOIN embeddings e ON e.vec_id = q.query_id % 1000000)
"""

LESSONS = """
lessons AS (
  SELECT CAST(item_id AS VARCHAR) AS id, text AS statement, text AS prevention_rule,
    CASE item_id % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'important' ELSE 'minor' END AS severity,
    CAST(item_id % 5 AS INTEGER) AS times_reinforced, TIMESTAMP '2024-01-15' AS created_at,
    CAST(item_id AS VARCHAR) AS learned_from
  FROM benchmark)
"""

INSIGHTS = """
insights AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, ['lesson','pattern','preference','decision','emotional_moment'][doc_id % 5 + 1] AS type,
    text AS content, CASE WHEN doc_id % 3 = 0 THEN 'critical' ELSE 'minor' END AS severity
  FROM documents)
"""


def days(ts: str, as_of: str) -> str:
    return f"((epoch_us(TIMESTAMP '{as_of}') - epoch_us({ts})) / 86400000000.0)"


def recency(ts: str, as_of: str, half: float = 30.0) -> str:
    return f"exp(-0.693 * {days(ts, as_of)} / {half})"


def effective(conf: str, ts: str, as_of: str) -> str:
    return f"greatest(0.1, {conf} * exp(-0.02 * {days(ts, as_of)}))"


def cosine(a: str, b: str) -> str:
    return f"round(list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]), 9)"


SQL: dict[str, str] = {}
