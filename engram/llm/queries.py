"""Registered queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s
  FROM words),
flat AS (SELECT doc_id, unnest(s) AS g FROM sets),
both_have AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM flat x JOIN flat y ON x.g = y.g AND x.doc_id < y.doc_id
  GROUP BY ALL),
links AS (
  SELECT a, b FROM both_have JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b
  WHERE 100 * c >= 75 * (len(p.s) + len(q.s) - c)),
either AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT reach.a, either.b FROM reach JOIN either ON reach.b = either.a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c.component_id
FROM sets JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = doc_id
"""


@query("op9_jaccard_join", OP9_SQL)
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engram.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


@query("op8_language_filters")
def op8_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engram.llm.language_id import identify_languages

    return identify_languages(table(spark, sf_dir, "documents"))


@query("op10_bm25_leaks")
def op10_bm25_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engram.llm.decontamination import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _in_order(spans, kinds):
    """Spans by kind as listed, then start."""
    rank = lambda kind: F.array_position(F.array(*map(F.lit, kinds)), kind)
    keyed = F.transform(spans, lambda s: F.struct(rank(s["kind"]).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_sort(keyed)


@query("op1_crf_personal_data")
def op1_crf_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engram.llm.pii import KINDS, find_personal_data

    found = find_personal_data(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint) as n_{k}") for k in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(_joined(_in_order(F.col("base"), KINDS)), 256).alias("base_sha256"),
        _joined(_in_order(F.concat("base", "added"), KINDS)).alias("spans"), F.size("added").cast("bigint").alias("n_added"),
    )


@query("op6_byte_bpe")
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engram.llm.byte_bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"))


@query("op7_gear_chunks")
def op7_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engram.llm.substring_dedup import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


@query("op2_cap_filters")
def op2_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engram.llm.cap_filters import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


@query("op3_random_secrets")
def op3_random_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engram.llm.secrets import KINDS, find_secrets, in_order

    found = find_secrets(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint) as n_{k}") for k in KINDS[:3]]
    return found.select(
        "doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(in_order(F.concat("base", "added"))).alias("spans"), F.size("added").cast("bigint").alias("n_added"),
    )


@query("op4_factorization_machine")
def op4_factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engram.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_block_labeller")
def op5_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engram.llm.html_text import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


#: CRC32 in SQL: a table of 256 steps, then one step per digit
OP13_SQL = r"""
WITH RECURSIVE steps(i, k, v) AS (
  SELECT CAST(i AS BIGINT), 0, CAST(i AS BIGINT) FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM steps WHERE k < 8),
crc(c, k, v) AS (
  SELECT DISTINCT conv_id, 0, CAST(4294967295 AS BIGINT) FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL
  SELECT c, crc.k + 1, xor(s.v, crc.v >> 8) FROM crc JOIN steps s
    ON s.k = 8 AND s.i = xor(crc.v & 255, CAST(ascii(substr(CAST(c AS VARCHAR), crc.k + 1, 1)) AS BIGINT))
  WHERE crc.k < length(CAST(c AS VARCHAR))),
heads AS (SELECT c, xor(v, 4294967295) % 9 AS h FROM crc WHERE k = length(CAST(c AS VARCHAR))),
said AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, sha256(length(r) || ':' || r || t)) - 1 AS i,
    {'r': r, 't': t} AS s
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL)),
lists AS (SELECT conv_id AS c, list(s ORDER BY i) AS l FROM said GROUP BY conv_id),
rebuilt AS (
  SELECT lists.c, list_concat(coalesce(o.l, [])[1:h], lists.l[h + 1:]) AS l
  FROM lists JOIN heads USING (c) LEFT JOIN lists o ON o.c = lists.c - lists.c % 5),
prefixes AS (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM rebuilt),
nodes AS (
  SELECT l[1:d] AS p, d, min(c) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE len(l) = d), '')) AS ends_sha256
  FROM prefixes GROUP BY ALL),
children AS (SELECT p[1:d - 1] AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
measured AS (
  SELECT nodes.*, coalesce(n, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * strlen(p[d].t) END AS saved
  FROM nodes LEFT JOIN children USING (p)),
spread AS (SELECT p, n_children, saved, unnest(range(0, d + 1)) AS e FROM measured),
subtrees AS (SELECT p[1:e] AS p, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM spread GROUP BY ALL)
SELECT m.conv_id, m.d AS depth, parent.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves,
  CAST(saved_tokens AS BIGINT) AS saved_tokens, m.ends_sha256
FROM measured m JOIN subtrees USING (p) LEFT JOIN nodes parent ON m.d > 0 AND parent.p = m.p[1:m.d - 1]
"""


@query("op13_conversation_trie", OP13_SQL)
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engram.llm.prefix_trie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"))


def _op12_sql() -> str:
    """Every window of every template against the whole texts, without filters."""
    from engram.llm.licenses import PHRASES, TEMPLATES, THRESHOLD

    phrases = ", ".join(f"('{phrase}', '{label}')" for phrase, label in PHRASES)
    templates = ", ".join(f"('{label}', list_distinct(string_split('{words}', ' ')))" for label, words in TEMPLATES)
    return rf"""
WITH phrases(p, label) AS (SELECT string_split(p, ' '), label FROM (VALUES {phrases}) t(p, label)),
templates(label, w) AS (VALUES {templates}),
words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
places AS (
  SELECT doc_id, label, pos FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS pos FROM words) x
  JOIN phrases ON x.w[pos + 1] = p[1] AND x.w[pos + 1:pos + len(p)] = p),
base AS (
  SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM places GROUP BY doc_id),
windows AS (
  SELECT doc_id, label, templates.w AS t, unnest(range(0, len(words.w), len(templates.w))) AS pos, words.w AS w FROM words, templates),
shares AS (SELECT doc_id, label, len(list_intersect(t, w[pos + 1:pos + 2 * len(t)])) / len(t) AS share FROM windows),
held AS (
  SELECT doc_id, list_sort(list(DISTINCT label)) AS labels, max(share) AS score FROM shares WHERE share >= {THRESHOLD} - 1e-9 GROUP BY doc_id)
SELECT words.doc_id, CAST(len(words.w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  array_to_string(coalesce(base.labels, []), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(held.labels, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(score, 0.0) END::DOUBLE AS score
FROM words LEFT JOIN base USING (doc_id) LEFT JOIN held USING (doc_id)
"""


@query("op12_license_templates", _op12_sql())
def op12_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engram.llm.licenses import find_licenses

    found = find_licenses(table(spark, sf_dir, "documents"))
    every = F.array_sort(F.array_union("base_labels", "template_labels"))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"), "score",
    )


@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from engram.llm.token_alignment import alignment_counts

    return alignment_counts(table(spark, sf_dir, "documents"))
