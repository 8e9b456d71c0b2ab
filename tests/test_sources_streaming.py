"""Files, transcripts, streams against their batch twins, cycles on disk."""

import json

import pytest
from pyspark.sql import functions as F

from engram.catalog import fixtures as fx
from engram.operators import messages as m
from engram.plans import cycles
from engram.sources import markdown as md
from engram.sources import transcripts as tr
from engram.streaming import messages as sm

ROOT = "/root/testdata/sf0.001"


def test_markdown_scan_and_sections(spark, tmp_path):
    files = {
        "MEMORY.md": "start text that is long enough\n# One\nbody of the first section here\n##### Deep\nanother body of some length",
        "memory/2024-02-01.md": "# Day\nnothing much happened on this day", "data/skip.md": "# no\nnever read this file please",
        ".hidden/x.md": "# no\nnever read this file please", "notes.txt": "no",
    }
    for name, text in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    found = md.with_file_role(md.read_markdown(spark, str(tmp_path)))
    assert {(x["path"], x["role"]) for x in found.collect()} == {("MEMORY.md", "memory"), ("memory/2024-02-01.md", "daily")}
    heads = [(x["heading"], x["level"], x["line_start"], x["line_end"]) for x in md.split_sections(found.filter("role = 'memory'")).collect()]
    assert heads == [("MEMORY", 1, 1, 1), ("One", 1, 2, 3), ("Deep", 5, 4, 5)]
    assert md.split_sections(found.filter("role = 'memory'"), 3).count() == 2
    search = md.read_markdown(spark, str(tmp_path), profile="search")
    assert {x["path"] for x in search.collect()} == {"MEMORY.md", "memory/2024-02-01.md"}


def test_transcripts(spark, tmp_path):
    lines = [
        {"type": "message", "message": {"role": "user", "content": [{"type": "text", "text": "one"}, {"type": "image"}, {"type": "text", "text": "two"}]}},
        {"type": "message", "message": {"role": "assistant", "content": "plain answer"}}, {"role": "user", "content": "simple line", "name": "Ann"},
        {"type": "other"},
    ]
    (tmp_path / "t.jsonl").write_text("\n".join(json.dumps(x) for x in lines) + "\nnot json\n")
    rows = [(x["role"], x["sender"], x["text"]) for x in tr.read_transcripts(spark, str(tmp_path)).collect()]
    assert rows == [("user", "User", "one\ntwo"), ("assistant", "Agent", "plain answer"), ("user", "Ann", "simple line")]
    live = [(x["sender"], x["text"]) for x in tr.read_transcripts(spark, str(tmp_path), mode="live").collect()]
    assert live == [("User", "one two"), ("agent", "plain answer")]


def _stream(spark, tmp_path, df, chunks=3):
    """Time-ordered chunks of files, read one per trigger."""
    src = tmp_path / "src"
    bounds = [b["t"] for b in df.select(F.unix_micros("ts").alias("t")).orderBy("t").collect()]
    cuts = [bounds[len(bounds) * i // chunks] for i in range(1, chunks)] + [bounds[-1] + 1]
    low = 0
    for i, high in enumerate(cuts):
        part = df.filter((F.unix_micros("ts") >= low) & (F.unix_micros("ts") < high))
        part.coalesce(1).write.mode("append").parquet(str(src))
        low = high
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(src))


def _run(stream, name, tmp_path, spark):
    q = (
        stream.writeStream.format("memory").queryName(name).outputMode("append")
        .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.table(name)


def test_stream_understanding_equals_batch(spark, tmp_path):
    df = fx.messages_ev(spark, ROOT)
    out = _run(sm.observe_router(sm.understand_stream(_stream(spark, tmp_path, df))), "understood", tmp_path, spark)
    pick = lambda d: sorted(tuple(x) for x in d.select("message_id", "verdict", "intent", "urgency", "dominant").collect())
    assert pick(out) == pick(m.understand(m.guard_text(df)))


def test_stream_gate_equals_batch(spark, tmp_path):
    df = fx.messages_ev(spark, ROOT).select("session_id", "message_id", "ts")
    out = _run(sm.min_interval_gate_stream(_stream(spark, tmp_path, df), "session_id", 3 * 3600, late="30 days"), "gated", tmp_path, spark)
    batch = m.min_interval_gate(df, ["session_id"], 3 * 3600, ["message_id"])
    pick = lambda d: sorted((x["message_id"], x["accepted"]) for x in d.collect())
    assert pick(out) == pick(batch)


def test_stream_rate_counter_equals_batch(spark, tmp_path):
    df = fx.messages_ev(spark, ROOT).select("session_id", "message_id", "ts")
    out = _run(sm.rate_counter_stream(_stream(spark, tmp_path, df), "session_id", 86400, 3, late="30 days"), "rated", tmp_path, spark)
    batch = m.rate_counter(df, ["session_id"], ["message_id"], 86400, 3)
    pick = lambda d: sorted((x["message_id"], x["n_in_window"], x["allowed"]) for x in d.collect())
    assert pick(out) == pick(batch)


def test_stream_segments_equal_full_batch_segments(spark, tmp_path):
    df = fx.messages_ev(spark, ROOT)
    stream = m.understand(_stream(spark, tmp_path, df))
    out = _run(sm.segment_stream(stream, 5, late="30 days"), "segmented", tmp_path, spark)
    batch = m.segment_episodes(m.understand(df).withColumn("entities", fx.no_strings()), 5)
    full = batch.filter(F.size(F.split("narrative", "\n")) == 5)
    key = lambda d: sorted((x["session_id"], x["segment"], x["narrative"], round(x["valence"], 6)) for x in d.collect())
    got = key(out.filter("n_messages = 5"))
    assert got == key(full)


def test_stream_rolling_window_and_sink(spark, tmp_path):
    df = m.sentiment(fx.messages_ev(spark, ROOT)).select("session_id", "message_id", "ts", "valence")
    stream = _stream(spark, tmp_path, df)
    out = _run(sm.rolling_24h(stream, "session_id"), "rolling", tmp_path, spark)
    assert out.count() > 0


def test_idle_sessions_leave_the_state(spark, tmp_path):
    """Sessions of an hour each, days apart: what is open is emitted, and the state holds the last ones only."""
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    rows = [(f"s{i}", i * 10 + k, t0 + timedelta(days=i, minutes=k)) for i in range(8) for k in range(3)]
    df = spark.createDataFrame(rows, "session_id string, seq long, ts timestamp").withColumns(
        {"text": F.lit("a line of text"), "sender": F.lit("user"), "intent": F.lit("inform"), "valence": F.lit(0.5), "arousal": F.lit(0.0)}
    )
    src = tmp_path / "days"
    for i in range(8):
        df.filter(F.col("session_id") == f"s{i}").coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(src))
    out = sm.segment_stream(stream, 10, late="1 minute", keep_ms=36 * 3_600_000)
    q = out.writeStream.format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["session_id"], r["segment"], r["n_messages"], r["trajectory"]) for r in spark.table("idle").collect()}
    assert got == {(f"s{i}", 0, 3, "positive") for i in range(7)}
    state = q.recentProgress[-1].stateOperators[0]
    assert state.numRowsTotal < 20


def test_stream_gate_keeps_null_keys(spark, tmp_path):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    rows = [(k, i, t0 + timedelta(seconds=7 * i)) for i, k in enumerate([None, "a", None, "a", None])]
    df = spark.createDataFrame(rows, "who string, message_id long, ts timestamp")
    out = _run(sm.min_interval_gate_stream(_stream(spark, tmp_path, df), "who", 20, late="30 days"), "nulls", tmp_path, spark)
    assert {(r["who"], r["message_id"], r["accepted"]) for r in out.collect()} == {
        (r["who"], r["message_id"], r["accepted"]) for r in m.min_interval_gate(df, ["who"], 20, ["message_id"]).collect()
    }


def test_upserts_survive_a_crash_between_tables_and_replays(spark, tmp_path):
    from engram.catalog.q_streaming import message_changes, message_upserts
    from engram.streaming import sink

    df = m.sentiment(m.intent(fx.messages_ev(spark, ROOT))).checkpoint()
    ids = sorted(r[0] for r in df.select("message_id").collect())
    thirds = [df.filter((F.col("message_id") >= lo) & (F.col("message_id") <= hi)) for lo, hi in [(ids[0], ids[len(ids) // 3]), (ids[len(ids) // 3] + 1, ids[2 * len(ids) // 3]), (ids[2 * len(ids) // 3] + 1, ids[-1])]]
    upserts = message_upserts(spark)
    root, whole = str(tmp_path / "parts"), str(tmp_path / "whole")
    sink.committing_writer(whole, "events", message_changes)(df, 0)

    def crash(batch):
        changed = message_changes(batch)
        return {**changed, "zz": changed["nodes"].withColumn("x", F.raise_error(F.lit("power cut")).cast("string"))}

    run = sink.committing_writer(root, "events", message_changes)
    run(thirds[0], 0)
    with pytest.raises(Exception, match="power cut"):
        sink.committing_writer(root, "events", crash)(thirds[1], 1)
    # the tables before the crash are written, and count for nothing
    assert sink.commits(spark, root).count() == 1
    before = sink.read_merged(spark, root, "episodes", upserts["episodes"]).count()
    run(thirds[1], 1)
    assert sink.read_merged(spark, root, "episodes", upserts["episodes"]).count() > before
    sink.compact(spark, root, upserts)
    for batch in (0, 1, 2, 2):
        run(thirds[batch], batch)
    assert sink.commits(spark, root).count() == 3
    for name, upsert in upserts.items():
        parts = sink.read_merged(spark, root, name, upsert)
        columns = sorted(parts.columns)
        rows = lambda d, columns=columns: sorted(str(r) for r in d.select(*columns).collect())
        assert rows(parts) == rows(sink.read_merged(spark, whole, name, upsert)), name


def test_nightly_cycle_runs_twice_on_one_root(spark, tmp_path):
    from engram.catalog.q_consolidation import _message_episodes
    from engram.catalog.q_tables import _persons
    from engram.sources.tables import current_versions, read_current

    tables = {
        "nodes": fx.nodes(spark, ROOT), "edges": fx.edges(spark, ROOT), "episodes": _message_episodes(spark, ROOT),
        "lessons": fx.lessons_bm(spark, ROOT), "identity": fx.identity_rows(spark), "procedures": fx.procedures_ev(spark, ROOT),
        "persons": _persons(spark, ROOT), "insights": fx.insights_doc(spark, ROOT),
    }
    root = str(tmp_path)
    after, details = cycles.run_cycle(spark, tables, "nightly", "2024-01-31 00:00:00", root=root)
    assert details["enrich"]["episodes_processed"] == tables["episodes"].count()
    assert after["lessons"].count() == tables["lessons"].count() + details["lessons"]["lessons_learned"]
    assert {"decay", "contradictions", "backlog"} <= set(details) and details["decay"]["processed"] == after["nodes"].count()
    first = current_versions(spark, root)
    lessons = after["lessons"].count()

    def bad(tables, keep):
        raise ValueError("no")

    with pytest.raises(ValueError):
        cycles.run_stages(spark, [*cycles.backfill_stages("2024-02-01 00:00:00")[:1], ("bad", bad)], after, root, "broken")
    assert current_versions(spark, root) == first
    current = read_current(spark, root)
    assert current["lessons"].count() == lessons and current["edges"].filter("id is null").count() == 0

    again, _ = cycles.run_cycle(spark, {**tables, **current}, "nightly", "2024-02-01 00:00:00", root=root)
    second = current_versions(spark, root)
    assert all(second[t] != first[t] for t in ("lessons", "episodes", "edges"))
    assert after["lessons"].count() == lessons and again["lessons"].count() == read_current(spark, root)["lessons"].count()
    assert spark.read.parquet(f"{root}/consolidation_log").count() == 2


def test_daily_rollup_reaches_the_episodes(spark, tmp_path):
    episodes = fx.episodes_doc(spark, ROOT)
    stages = [s for s in cycles.consolidation_stages("daily", fx.DOCS_AS_OF) if s[0] == "rollup"]
    after, details = cycles.run_stages(spark, stages, {"episodes": episodes})
    done = details["rollup"]["memories_consolidated"]
    assert done > 0 and after["episodes"].filter("consolidated_into is not null").count() == done
    again, details = cycles.run_stages(spark, stages, after)
    assert details["rollup"]["memories_consolidated"] == 0 and again["episodes"].count() == after["episodes"].count()


def test_failed_stage_is_noted_on_request(spark):
    def bad(tables, keep):
        raise ValueError("no")

    stages = [("bad", bad), ("same", lambda t, keep: (t, {}))]
    with pytest.raises(ValueError):
        cycles.run_stages(spark, stages, {"x": spark.range(1)})
    tables, details = cycles.run_stages(spark, stages, {"x": spark.range(1)}, keep_going=True)
    assert details == {"bad": {"error": "no"}, "same": {}} and set(tables) == {"x"}


def test_containment_of_a_stream_beyond_the_broadcast(spark, tmp_path):
    """A stream can't fetch its texts back by key; with more terms than may be broadcast it takes them along."""
    from engram.operators.matching import contained_terms

    spark.createDataFrame([("user 7 is grateful.",), ("user 71",), ("nothing",)], "_low string").write.parquet(f"{tmp_path}/in")
    terms = spark.createDataFrame([("a", "user 7"), ("b", "grateful."), ("c", "grateful."), ("d", "user 71"), ("e", "gone")], "key string, term string")
    for limit in (4, 1):
        stream = spark.readStream.schema("_low string").parquet(f"{tmp_path}/in")
        hits = contained_terms(stream, "_low", terms, "term", [], broadcast_terms=limit).select("key", "_low")
        run = hits.writeStream.format("parquet").option("path", f"{tmp_path}/out{limit}").option("checkpointLocation", f"{tmp_path}/state{limit}").trigger(availableNow=True).start()
        run.awaitTermination()
        got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out{limit}").collect())
        assert got == [("a", "user 7 is grateful."), ("a", "user 71"), ("b", "user 7 is grateful."), ("c", "user 7 is grateful."), ("d", "user 71")]
