"""Registered queries beside their SQL on the smallest data."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import rows

ROOT = "/root/testdata/sf0.001"
FEW = [
    "episode_stats", "sensory_intent", "decay_report", "link_related", "cooccurrence", "query_weights", "section_split",
    "record_executions", "contradictions", "cross_calls", "pack_batches", "knn_topk",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(ROOT):
        c.execute(f"create view {f[:-8]} as select * from '{ROOT}/{f}'")
    return c


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 120


@pytest.mark.parametrize("name", FEW)
def test_query_equals_sql(spark, con, name):
    got = entry.queries()[name](spark, ROOT).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert rows(got) == rows(want)
