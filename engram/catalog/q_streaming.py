"""Registered queries: streams over the events table, drained into a folder (T1-T5)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.catalog import fixtures as fx
from engram.catalog import oracles as o
from engram.catalog.q_messages import _INTENT, _SENT, _VERDICT, _r
from engram.catalog.registry import query
from engram.operators import messages as m
from engram.operators import tables as t
from engram.session import use_checkpoints
from engram.streaming import messages as sm
from engram.streaming import sink


def _events(spark: SparkSession, root: str) -> DataFrame:
    schema = fx.table(spark, root, "events").schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(root)
    return fx.messages_ev(spark, root, files)


def _drain(stream: DataFrame) -> DataFrame:
    """Run the stream over all present input into the shared checkpoint folder."""
    spark = stream.sparkSession
    use_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4()}"
    run = (
        stream.writeStream.format("parquet").option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


@query("stream_understand")
def stream_understand(spark, root):
    return _drain(sm.understand_stream(_events(spark, root)).select("message_id", "verdict", "intent"))


o.SQL["stream_understand"] = f"WITH {o.MESSAGES_EV} SELECT message_id, {_VERDICT} AS verdict, {_INTENT} AS intent FROM messages"


@query("stream_gate")
def stream_gate(spark, root):
    gated = sm.min_interval_gate_stream(_events(spark, root), "session_id", 3 * 3600)
    return _drain(gated).select("message_id", "accepted")


@query("stream_rate_counter")
def stream_rate_counter(spark, root):
    return _drain(sm.rate_counter_stream(_events(spark, root), "session_id", 86400, 3)).select("message_id", "n_in_window", "allowed")


@query("stream_segments")
def stream_segments(spark, root):
    """Ten messages each, and what idle sessions have left when the stream ends."""
    out = _drain(sm.segment_stream(m.understand(_events(spark, root)), 10))
    return out.select(
        "session_id", "segment", "summary", "narrative", F.size("topics").cast("bigint").alias("n_topics"), *_r("importance_score", "valence", "arousal"),
        "trajectory", "n_messages", "first_ts", "last_ts",
    )


_WATERMARK = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM messages)"
o.SQL["stream_segments"] = f"""
WITH {o.MESSAGES_EV}, {_SENT}, z AS (SELECT *, {_INTENT} AS intent FROM felt),
n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, seq) - 1 AS i, max(ts) OVER (PARTITION BY session_id) AS seen FROM z),
s AS (SELECT session_id, i // 10 AS segment, list(intent ORDER BY i) AS kinds, any_value(seen) AS seen, count(*) AS n_messages, min(ts) AS first_ts, max(ts) AS last_ts,
  substring(string_agg('[' || sender || '] ' || substring(text, 1, 500), chr(10) ORDER BY i), 1, 4000) AS narrative, avg(valence) AS v, avg(arousal) AS a FROM n GROUP BY 1, 2)
SELECT session_id, segment, 'Conversation segment: ' || array_to_string(list_transform(list_filter(range(1, len(kinds) + 1), lambda k: list_position(kinds, kinds[k]) = k), lambda k: kinds[k]), ', ') || ' | Entities: ' AS summary,
  narrative, 0 AS n_topics, 0.3::DOUBLE AS importance_score, round(v, 6) AS valence, round(a, 6) AS arousal,
  CASE WHEN v > 0.3 THEN 'positive' WHEN v < -0.3 THEN 'negative' ELSE 'stable' END AS trajectory, n_messages, first_ts, last_ts
FROM s WHERE n_messages = 10 OR seen + INTERVAL 1 HOUR <= {_WATERMARK}"""


@query("stream_interactions")
def stream_interactions(spark, root):
    """People who sent a message, once per day: users bear the names of customers."""
    people = fx.table(spark, root, "customer").select("c_name", "c_custkey")
    named = _events(spark, root).join(people, F.col("session_id") == F.col("c_custkey").cast("string")).select("ts", F.array(F.upper("c_name"), F.lit("nobody")).alias("participants"))
    return _drain(sm.interactions_stream(named, people.select(F.col("c_name").alias("name")))).select("name", F.col("day").cast("string").alias("day"))


o.SQL["stream_interactions"] = "SELECT DISTINCT c_name AS name, strftime(ts, '%Y-%m-%d') AS day FROM events JOIN customer ON c_custkey = user_id"


@query("stream_affirmations")
def stream_affirmations(spark, root):
    """Identity rows about customers that a message confirms, once per day."""
    about = fx.table(spark, root, "customer").select(
        F.concat(F.lit("user-"), F.col("c_custkey").cast("string")).alias("key"), F.when(F.col("c_custkey") % 9 == 0, "Grateful.").otherwise("Nothing to add").alias("value")
    )
    return _drain(sm.affirmations_stream(_events(spark, root), about)).select("key", F.col("day").cast("string").alias("day"))


o.SQL["stream_affirmations"] = f"""
WITH {o.MESSAGES_EV}, p AS (SELECT 'user-' || c_custkey AS key, 'user ' || c_custkey AS term FROM customer UNION SELECT 'user-' || c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'grateful.' ELSE 'nothing to add' END FROM customer)
SELECT DISTINCT key, strftime(ts, '%Y-%m-%d') AS day FROM messages JOIN p ON contains(lower(text), term)"""


@query("stream_rolling")
def stream_rolling(spark, root):
    """Activity per session over the last day, for the windows that the watermark has passed."""
    out = _drain(sm.rolling_24h(m.sentiment(_events(spark, root)), "session_id"))
    return out.select(F.col("window.start").alias("start"), "session_id", "messages", *_r("avg_valence"))


o.SQL["stream_rolling"] = f"""
WITH {o.MESSAGES_EV}, {_SENT}, h AS (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS hour FROM felt),
w AS (SELECT *, hour - to_hours(k) AS start FROM h, range(24) t(k))
SELECT start, session_id, count(*) AS messages, round(avg(valence), 6) AS avg_valence FROM w
WHERE start + INTERVAL 24 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM messages) GROUP BY 1, 2"""


@query("stream_router_stats")
def stream_router_stats(spark, root):
    """Counters of the passing micro-batches, summed as the listener does."""
    use_checkpoints(spark)
    seen = sm.observe_router(sm.understand_stream(_events(spark, root)), "router")
    run = seen.writeStream.format("noop").option("checkpointLocation", f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4()}").trigger(availableNow=True).start()
    run.awaitTermination()
    stats = sm.RouterStats("router")
    for progress in run.recentProgress:
        stats.add(progress)
    names = ["messages", "short", "episodes"]
    return spark.createDataFrame([tuple(stats.totals.get(n, 0) for n in names)], ", ".join(f"{n} bigint" for n in names))


o.SQL["stream_router_stats"] = f"""
WITH {o.MESSAGES_EV}, z AS (SELECT *, {_INTENT} AS intent FROM messages)
SELECT count(*) AS messages, count(*) FILTER (length(text) < 20) AS short, count(*) FILTER (intent IN ('request', 'decision', 'feedback', 'emotional')) AS episodes FROM z"""


NODE_COLUMNS = "id string, type string, name string, aliases array<string>, attributes map<string,string>, context string, significance string, confidence double, " \
    "confidence_basis string, emotional_weight double, last_verified timestamp, last_modified timestamp"


def message_changes(batch: DataFrame) -> dict[str, DataFrame]:
    """Changed rows of a micro-batch of understood messages: a node per session, an episode per lasting message, and links."""
    session = F.concat(F.lit("session "), F.col("session_id"))
    nodes = batch.select(
        F.lit("session").alias("type"), session.alias("name"), fx.no_strings().alias("aliases"), F.create_map(F.col("intent"), F.col("message_id").cast("string")).alias("attributes"),
        F.when(F.col("intent") != "inform", F.col("text")).alias("context"), F.lit(None).cast("string").alias("significance"), F.lit(0.7).alias("confidence"),
        F.lit("stated").alias("confidence_basis"), F.col("arousal").alias("emotional_weight"), F.col("message_id").alias("batch_order"),
    )
    told = batch.filter(F.col("intent").isin("request", "decision", "feedback", "emotional"))
    episodes = told.select(F.concat(F.lit("e"), F.col("message_id")).alias("id"), F.col("text").alias("summary"), "session_id", F.col("ts").alias("created_at"), F.col("message_id").alias("batch_order"))
    links = told.select(F.concat(F.lit("e"), F.col("message_id")).alias("episode_id"), session.alias("node_name"), F.col("message_id").alias("batch_order"))
    edges = batch.select(
        session.alias("source"), F.concat(F.lit("day "), F.to_date("ts").cast("string")).alias("target"), F.lit("active_on").alias("relationship"),
        F.col("message_id").alias("last_message"), F.col("message_id").alias("batch_order"),
    )
    return {"nodes": nodes, "episodes": episodes, "links": links, "edges": edges}


def message_upserts(spark: SparkSession) -> dict[str, sink.Upsert]:
    def nodes(old, new):
        return t.upsert_nodes(spark.createDataFrame([], NODE_COLUMNS) if old is None else old, new, fx.EVENTS_AS_OF)

    return {
        "nodes": nodes, "episodes": sink.keep_last(["id"]), "links": sink.keep_last(["episode_id", "node_name"]),
        "edges": sink.keep_last(["source", "target", "relationship"]),
    }


@query("stream_upserts")
def stream_upserts(spark, root):
    """Memory tables after the events came in several micro-batches, some before and some after a compaction."""
    use_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/sink-{uuid.uuid4()}"
    events = fx.table(spark, root, "events")
    middle = events.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    parts = [F.col("event_id") <= middle, F.col("event_id") > middle]
    upserts = message_upserts(spark)
    for part in parts:
        events.filter(part).repartitionByRange(3, "event_id").write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
        told = m.sentiment(m.intent(fx.messages_ev(spark, root, stream)))
        run = (
            told.writeStream.foreachBatch(sink.committing_writer(f"{folder}/tables", "events", message_changes))
            .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        )
        run.awaitTermination()
        if part is parts[0]:
            sink.compact(spark, f"{folder}/tables", upserts)
    now = {name: sink.read_merged(spark, f"{folder}/tables", name, upsert) for name, upsert in upserts.items()}
    keys = F.array_join(F.array_sort(F.transform(F.map_entries("attributes"), lambda e: e["key"])), ",")
    none = F.lit(None).cast("string")
    out = now["nodes"].select(F.lit("node").alias("kind"), F.col("name").alias("key"), keys.alias("value"), "confidence_basis")
    out = out.unionByName(now["episodes"].select(F.lit("episode").alias("kind"), F.col("id").alias("key"), F.col("summary").alias("value"), none.alias("confidence_basis")))
    out = out.unionByName(now["links"].select(F.lit("link").alias("kind"), F.col("episode_id").alias("key"), F.col("node_name").alias("value"), none.alias("confidence_basis")))
    return out.unionByName(now["edges"].select(F.lit("edge").alias("kind"), F.concat_ws(" ", "source", "target").alias("key"), F.lit("active_on").alias("value"), none.alias("confidence_basis")))


o.SQL["stream_upserts"] = f"""
WITH {o.MESSAGES_EV}, z AS (SELECT *, 'session ' || session_id AS node, {_INTENT} AS intent FROM messages), told AS (SELECT * FROM z WHERE intent IN ('request', 'decision', 'feedback', 'emotional'))
SELECT 'node' AS kind, node AS key, string_agg(DISTINCT intent, ',' ORDER BY intent) AS value, 'stated' AS confidence_basis FROM z GROUP BY node
UNION ALL SELECT 'episode', 'e' || message_id, text, NULL FROM told
UNION ALL SELECT 'link', 'e' || message_id, node, NULL FROM told
UNION ALL SELECT DISTINCT 'edge', node || ' day ' || CAST(ts AS DATE), 'active_on', NULL FROM z"""

o.SQL["stream_rate_counter"] = o.SQL["rate_counter"].replace(
    "SELECT message_id, n_in_window, n_in_window <= 3 AS allowed,", "SELECT message_id, n_in_window, n_in_window <= 3 AS allowed FROM x --"
).split("--")[0]
o.SQL["stream_gate"] = o.SQL["min_interval_gate"].replace(o.MESSAGES_CONV, o.MESSAGES_EV).replace(" 5000000", " 10800000000").replace("+ 5000000", "+ 10800000000").replace("SELECT session_id, seq,", "SELECT message_id,")
