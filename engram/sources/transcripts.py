"""Chat transcripts in JSON lines, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLAIN = "type string, role string, content string, timestamp string, name string, message string"
NESTED = "role string, content string, name string, timestamp string"
PARTS = "array<struct<type:string,text:string>>"


def parse_lines(lines: DataFrame, mode: str = "transcript") -> DataFrame:
    """``value`` holds one JSON line; both shapes are read, malformed lines dropped.

    ``{"type": "message", "message": {"role", "content": text or parts}}`` and,
    in transcript mode only, ``{"role", "content"}``. Parts of type text are
    joined by a newline, in live mode by a blank.
    """
    joiner = " " if mode == "live" else "\n"
    plain = F.from_json("value", PLAIN)
    read = lines.withColumn("_p", plain).withColumn("_m", F.from_json(F.col("_p.message"), NESTED))
    body = F.col("_m.content")
    parts = F.from_json(body, PARTS)
    listed = F.array_join(
        F.transform(F.filter(parts, lambda c: c["type"] == "text"), lambda c: c["text"]), joiner
    )
    nested_text = F.when(body.startswith("["), F.coalesce(listed, F.lit(""))).otherwise(body)
    nested = (F.col("_p.type") == "message") & F.col("_m.role").isNotNull() & body.isNotNull()
    nested = F.coalesce(nested, F.lit(False))
    if mode == "live":
        role = F.when(F.col("_p.type") == "message", F.coalesce("_m.role", F.lit("unknown")))
        text, keep = nested_text, F.length(nested_text) >= 5
        sender = F.when(role == "user", "User").when(role == "assistant", "agent").otherwise("system")
    else:
        role = F.when(nested, F.col("_m.role")).otherwise(F.col("_p.role"))
        text = F.when(nested, nested_text).otherwise(F.col("_p.content"))
        keep = F.length(text) > 0
        sender = F.when(role == "user", F.coalesce("_m.name", "_p.name", F.lit("User"))).otherwise("Agent")
    return (
        read.withColumns({"role": role, "text": text, "sender": sender})
        .withColumn("ts", F.try_to_timestamp(F.coalesce("_p.timestamp", "_m.timestamp")))
        .filter(keep & F.col("role").isNotNull())
        .drop("_p", "_m", "value")
    )


def read_transcripts(spark: SparkSession, path: str, mode: str = "transcript") -> DataFrame:
    """One row per message; the file is the session, the byte order its sequence."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("session_id"),
        (F.col("_metadata.file_block_start") + F.monotonically_increasing_id() % F.lit(1 << 33)).alias("seq"),
    )
    return parse_lines(lines, mode)


def stream_transcripts(spark: SparkSession, path: str, mode: str = "live") -> DataFrame:
    lines = spark.readStream.text(path).select("value", F.col("_metadata.file_path").alias("session_id"))
    return parse_lines(lines, mode)
