"""The pipeline stage by stage beside brute force, and the registered queries beside their SQL."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from engram.llm import byte_bpe, pii
from engram.llm.queries import SQL
from tests.llm.test_pairs import components, shingles
from tools.check import rows

ROOT = "/root/testdata/sf0.001"


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    all_rows = sorted(docs.collect(), key=lambda r: r["doc_id"])
    bench = [r["text"] for r in spark.read.parquet(f"{ROOT}/benchmark.parquet").collect()]
    sets = {r["doc_id"]: shingles(r["text"]) for r in all_rows}
    ids = [i for i in sets if sets[i]]
    links = [
        (a, b) for k, a in enumerate(ids) for b in ids[k + 1 :]
        if 4 * min(len(sets[a]), len(sets[b])) >= 3 * max(len(sets[a]), len(sets[b])) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    first = components(sets, links)
    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    kept = [r for r in all_rows if first[r["doc_id"]] == r["doc_id"] and not any(plain(b) in plain(r["text"]) for b in bench)]
    codec = byte_bpe.Codec(byte_bpe.read_ranks(byte_bpe.default_ranks()), byte_bpe.default_pattern())
    field = pii.ChainField().fit(pii.labelled_rows())
    want = {}
    for r in kept:
        base = pii.base_spans(r["text"])
        clean = pii.redacted(r["text"], base + pii._clear_of(field.spans([r["text"]])[0], base))
        want[r["doc_id"]] = len(codec.encode(clean))
    got = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, ROOT).collect()}
    assert got == want


def test_stages_keep_columns_and_survive_odd_rows(spark):
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "12345 !!", "en", "s", 8), (None, "The text of this and that", None, "s", 25), (4, "this and that is in the text", "en", "s", 28)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    for docs_in in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs_in, ROOT)
            assert out.columns == docs.columns, name
            assert out.count() <= 5
        assert corpus_pipeline.STAGES[-1][1](spark, docs_in, ROOT).count() == docs_in.count()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(ROOT):
        con.execute(f"create view {f[:-8]} as select * from '{ROOT}/{f}'")
    assert rows(entry.queries()[name](spark, ROOT).toPandas()) == rows(con.execute(SQL[name]).df())
