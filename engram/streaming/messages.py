"""Message understanding as Structured Streaming jobs.

Stateless columns are the batch functions themselves. Stateful operators keep a
few values per key, take late rows up to a watermark and drop idle state on an
event-time timer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from engram.functions.text import no_strings
from engram.operators import messages as m
from engram.operators.matching import contained_terms
from engram.operators.tables import identity_phrases
from engram.streaming import state

IDLE_MS = 3_600_000
KEEP_MS = 30 * 24 * 3_600_000


def understand_stream(stream: DataFrame) -> DataFrame:
    """Guard text, full profile: the same columns as the batch job."""
    return m.understand(m.guard_text(stream))


def min_interval_gate_stream(stream: DataFrame, key: str, seconds: float, late: str = "10 minutes", keep_ms: int = IDLE_MS) -> DataFrame:
    """(key, message_id, ts, accepted): state is the last accepted time per key, until it is idle for ``keep_ms`` beyond the interval."""
    types = {c: stream.schema[c].dataType.simpleString() for c in (key, "message_id")}
    rows = stream.withWatermark("ts", late).select(key, "message_id", "ts")
    schema = f"{key} {types[key]}, message_id {types['message_id']}, ts timestamp, accepted boolean"
    return state.with_state(rows, key, state.Gate(key, int(seconds * 1_000_000), keep_ms), schema)


def rate_counter_stream(stream: DataFrame, key: str, seconds: float, limit: int, late: str = "10 minutes", keep_ms: int = IDLE_MS) -> DataFrame:
    """(key, message_id, ts, n_in_window, allowed): state is window start and count per key, until the window is over for ``keep_ms``."""
    types = {c: stream.schema[c].dataType.simpleString() for c in (key, "message_id")}
    rows = stream.withWatermark("ts", late).select(key, "message_id", "ts")
    schema = f"{key} {types[key]}, message_id {types['message_id']}, ts timestamp, n_in_window bigint, allowed boolean"
    return state.with_state(rows, key, state.Counter(key, int(seconds * 1_000_000), limit, keep_ms), schema)


def segment_stream(stream: DataFrame, size: int = 10, late: str = "10 minutes", idle_ms: int = IDLE_MS, keep_ms: int = KEEP_MS) -> DataFrame:
    """Emit an episode per ``size`` processed messages of a session; the open rest
    is emitted when the session has been idle for ``idle_ms`` of event time.

    ``stream`` carries the columns of ``understand`` and, if names are wanted, ``entities``. State holds fewer than
    ``size`` message lines, after an idle time one number per session, and nothing ``keep_ms`` after its last message; a session that
    goes on later starts from segment 0 again, and first_ts tells the two apart.
    """
    line = F.concat(F.lit("["), F.col("sender"), F.lit("] "), F.substring("text", 1, 500))
    names = F.col("entities") if "entities" in stream.columns else no_strings()
    rows = stream.withWatermark("ts", late).select(
        "session_id", "seq", "ts", line.alias("line"), names.alias("entities"), "intent", "valence", "arousal"
    )
    return state.with_state(rows, "session_id", state.Segments(size, idle_ms, keep_ms), state.SEGMENT)


def rolling_24h(stream: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """Activity per key over the last day, advancing each hour."""
    return (
        stream.withWatermark("ts", late)
        .groupBy(F.window("ts", "24 hours", "1 hour"), key)
        .agg(F.count("*").alias("messages"), F.avg("valence").alias("avg_valence"))
    )


def interactions_stream(stream: DataFrame, persons: DataFrame, late: str = "1 hour") -> DataFrame:
    """(name, day, ts): persons that take part in an episode of the stream, once per person and day.

    ``stream`` has ts and participants. The days that the watermark has passed leave the state.
    """
    people = persons.select("name", F.lower("name").alias("_name")).distinct()
    met = stream.withWatermark("ts", late).select("ts", F.explode("participants").alias("_p"))
    named = met.join(people, F.lower("_p") == F.col("_name")).select("name", F.to_date("ts").alias("day"), "ts")
    return named.dropDuplicatesWithinWatermark(["name", "day"])


def affirmations_stream(stream: DataFrame, identity: DataFrame, late: str = "1 hour") -> DataFrame:
    """(key, day, ts): identity rows whose phrases a text of the stream contains, once per row and day.

    A phrase that many rows share is met once per day, and then by its rows.
    """
    phrases = identity_phrases(identity)
    rows = stream.withWatermark("ts", late).select("ts", F.lower("text").alias("_low"))
    hits = contained_terms(rows, "_low", phrases.select("term").distinct(), "term", []).select("term", F.to_date("ts").alias("day"), "ts")
    said = hits.dropDuplicatesWithinWatermark(["term", "day"])
    return said.join(phrases, "term").select("key", "day", "ts").dropDuplicatesWithinWatermark(["key", "day"])


def observe_router(stream: DataFrame, name: str = "router") -> DataFrame:
    """Count messages, skipped ones and episodes of every micro-batch as it passes."""
    return stream.observe(
        name,
        F.count(F.lit(1)).alias("messages"),
        F.count(F.when(F.length("text") < 20, 1)).alias("short"),
        F.count(F.when(F.col("intent").isin("request", "decision", "feedback", "emotional"), 1)).alias("episodes"),
    )


class RouterStats(StreamingQueryListener):
    """Sums the observed counters over all micro-batches."""

    def __init__(self, name: str = "router") -> None:
        self.name = name
        self.totals: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.add(event.progress)

    def add(self, progress) -> None:
        row = progress.observedMetrics.get(self.name)
        if row is not None:
            for key, value in row.asDict().items():
                self.totals[key] = self.totals.get(key, 0) + (value or 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
