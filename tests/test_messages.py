"""Hand rows with expected values for the message operators."""

import random

import pytest
from pyspark.sql import functions as F

from engram.operators import messages as m
from engram.operators.ordering import greedy_heads, running_index

SHIPPED = "We shipped the portal, amazing work! Thank you all, I am proud of this."
DECIDED = "We decided to use Postgres at $95/hr, up 12% since Mar 3, 2026 across 40 nodes."
URGENT = "URGENT: PRODUCTION IS DOWN!!!"
PLAIN = "The rate table has ten columns"


@pytest.fixture(scope="module")
def understood(spark):
    rows = [(i, t, "user") for i, t in enumerate([SHIPPED, DECIDED, URGENT, PLAIN, "", "   "])]
    df = spark.createDataFrame(rows, "message_id long, text string, sender string")
    return {r["message_id"]: r for r in m.understand(df).collect()}


def test_sentiment_counts(understood):
    r = understood[0]
    assert (r["positive"], r["negative"], r["excitement"], r["humor"]) == (3, 0, 1, 0)
    assert r["valence"] == 1.0 and r["arousal"] == pytest.approx(0.4)
    assert r["emotions"] == ["joy", "gratitude", "pride", "determination"]
    u = understood[2]
    assert u["valence"] == -1.0 and u["arousal"] == pytest.approx(0.9) and u["emotions"] == ["excitement"]


def test_urgency_and_intent(understood):
    assert [round(understood[i]["urgency"], 6) for i in range(4)] == [0.2, 0.2, 1.0, 0.2]
    assert [understood[i]["intent"] for i in range(4)] == ["emotional", "decision", "inform", "inform"]


def test_claims_in_order(understood):
    assert understood[1]["claims"] == ["$95/hr", "12%", "Mar 3, 2026", "40 nodes"]


def test_empty_text_is_neutral(understood):
    assert understood[4]["emotions"] == ["neutral"] and understood[4]["valence"] == 0.0


def test_guard_text(spark):
    texts = [
        ("HEARTBEAT_OK", "system_message"), ("   ", "system_message"), ("short", "too_short"),
        ("my password: hunter2hunter2 is here", "contains_credentials"),
        ("a perfectly normal message", "allowed"), ("HEARTBEAT_OK\nplus more text here", "allowed"),
    ]
    df = spark.createDataFrame([(t,) for t, _ in texts], "text string")
    assert [r["verdict"] for r in m.guard_text(df).collect()] == [v for _, v in texts]
    path = spark.createDataFrame([("see ~/.agent/secrets/key.txt for the rest",)], "text string")
    assert m.guard_text(path).first()["clean_text"] == "see [REDACTED_PATH] for the rest"


def test_mentions_prefer_core_and_first_spelling(spark):
    nodes = spark.createDataFrame(
        [("1", "person", "Ada Byron", ["ada"], 0.9), ("2", "tool", "Docker", [], 0.5), ("3", "place", "Rome", ["Roma"], 0.4)],
        "id string, type string, name string, aliases array<string>, confidence double",
    )
    msgs = spark.createDataFrame([(1, "ada ran docker in ROMA 🔥 é")], "message_id long, text string")
    rows = {r["entity"]: r for r in m.entity_mentions(msgs, nodes, ["message_id"]).collect()}
    assert set(rows) == {"ada byron", "docker", "rome"}
    assert rows["docker"]["node_id"] is None and rows["rome"]["node_id"] == "3"
    assert rows["ada byron"]["context"] == "ada ran docker in ROMA 🔥 é"


def greedy(times, interval):
    out, last = [], None
    for t in sorted(set(times)):
        if last is None or t - last >= interval:
            out.append(t)
            last = t
    return out


@pytest.mark.parametrize("fold_limit", [20_000, 3])
def test_gate_equals_sequential_rule(spark, fold_limit):
    rng = random.Random(7)
    data = {k: [rng.randrange(0, 4000) for _ in range(n)] for k, n in [("hot", 600), ("b", 40), ("c", 1)]}
    df = spark.createDataFrame([(k, t) for k, ts in data.items() for t in ts], "k string, t0 long")
    heads = greedy_heads(df.repartition(7), ["k"], "t0", 25, 400, fold_limit=fold_limit)
    got = {k: sorted(r["t"] for r in heads.collect() if r["k"] == k) for k in data}
    assert got == {k: greedy(ts, 25) for k, ts in data.items()}


def test_running_index_is_position(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 3).repartition(5)
    out = running_index(df, ["k"], ["id"], F.floor(F.col("id") / 17))
    assert all(r["position"] == r["id"] // 3 + 1 for r in out.collect())


def test_gates_keep_rows_without_key_order_or_time(spark):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    rows = [(None, 1, t0), (None, 2, t0 + timedelta(seconds=1)), ("a", None, t0), ("a", 3, t0 + timedelta(seconds=9)), ("a", 4, None), (None, None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "who string, seq int, ts timestamp")
    gated = m.min_interval_gate(df, ["who"], 5, ["seq"]).collect()
    assert sorted(((r["who"], r["seq"], r["accepted"]) for r in gated), key=str) == sorted(
        [(None, 1, True), (None, 2, False), ("a", None, True), ("a", 3, True), ("a", 4, False), (None, None, False), (None, None, False)], key=str
    )
    assert {r["since_accepted"] for r in gated if r["ts"] is None} == {None}
    counted = m.rate_counter(df, ["who"], ["seq"], 60, 1).collect()
    assert sorted(((r["who"], r["seq"], r["n_in_window"], r["allowed"]) for r in counted), key=str) == sorted(
        [(None, 1, 1, True), (None, 2, 2, False), ("a", None, 1, True), ("a", 3, 2, False), ("a", 4, None, False), (None, None, None, False), (None, None, None, False)], key=str
    )
    texts = df.withColumn("text", F.lit("a message that is long enough")).drop("seq").withColumn("seq", F.monotonically_increasing_id())
    assert m.guard(texts, ["who"], ["seq"]).count() == len(rows)


def test_a_transcript_summary_reads_its_messages_once(spark, tmp_path):
    """Counts, means, intents and emotions come from one pass over the messages, null values among them."""
    rows = [("a", "ask", ["joy", "pride"], ["x", "y"], 0.1, 0.5), ("a", "ask", ["joy", "pride"], [], 0.2, 0.5), ("a", "tell", ["joy"], ["z"], None, 0.0),
            ("b", "ask", None, [], 1.0, 1.0), ("c", "tell", ["neutral"], [], None, None), ("c", None, ["neutral"], [], None, None), (None, "ask", ["joy"], [], 0.0, 0.0)]
    spark.createDataFrame(rows, "session_id string, intent string, emotions array<string>, claims array<string>, valence double, arousal double").write.parquet(str(tmp_path / "said"))
    processed = spark.read.parquet(str(tmp_path / "said"))
    summary = m.transcript_summary(processed)
    assert "said" not in " ".join(summary.inputFiles())
    got = {r["session_id"]: (r["messages"], r["claims"], r["avg_valence"], r["avg_arousal"], [tuple(i) for i in r["intents"]], r["top_emotions"]) for r in summary.collect()}
    assert got == {
        "a": (3, 3, 0.15, 1 / 3, [("ask", 2), ("tell", 1)], ["joy", "pride"]),
        "c": (2, 0, None, None, [(None, 1), ("tell", 1)], ["neutral"]),
    }
