"""Upserts of micro-batches into the memory tables, safe against replays and crashes.

A micro-batch writes its changed rows as new files, one folder per table, and then one commit row that names
them. Nothing reads a folder that no commit names, so a crash between two tables leaves nothing behind that
counts, and a batch that is committed already is skipped when it comes again. Tables are never
rewritten by a micro-batch: readers fold the committed changes into the current version, in the order of the batches, by the same
upserts as in batch jobs, and ``compact`` now and then writes the result as the new version.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.sources.tables import append_log, exists, folded_batches, publish, read_current, write_version

CHANGES, COMMITS = "_changes", "_commits"
_COMMIT = "stream string, batch bigint, attempt string, tables array<string>"
Upsert = Callable[[DataFrame | None, DataFrame], DataFrame]


def commits(spark: SparkSession, root: str) -> DataFrame:
    if not exists(spark, f"{root}/{COMMITS}"):
        return spark.createDataFrame([], _COMMIT)
    return spark.read.schema(_COMMIT).parquet(f"{root}/{COMMITS}")


def committing_writer(root: str, stream: str, write: Callable[[DataFrame], dict[str, DataFrame]]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: ``write`` turns a micro-batch into changed rows per table, each with ``batch_order``."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if not commits(spark, root).filter((F.col("stream") == stream) & (F.col("batch") == batch_id)).isEmpty():
            return
        attempt = uuid.uuid4().hex[:12]
        batch.persist()
        try:
            changed = write(batch)
            for name, rows in sorted(changed.items()):
                rows.withColumn("_batch", F.lit(batch_id).cast("bigint")).write.mode("errorifexists").parquet(_folder(root, name, stream, batch_id, attempt))
        finally:
            batch.unpersist()
        append_log(spark.createDataFrame([(stream, batch_id, attempt, sorted(changed))], _COMMIT).coalesce(1), root, COMMITS)

    return run


def _folder(root: str, name: str, stream: str, batch_id: int, attempt: str) -> str:
    return f"{root}/{CHANGES}/{name}/{stream}-{batch_id}-{attempt}"


def committed_changes(spark: SparkSession, root: str, name: str, upto: dict[str, int] | None = None) -> DataFrame | None:
    """Changed rows of a table that its current version does not hold yet, ``batch_order`` over all of them; None without any.

    ``upto`` leaves out the batches of each stream that follow the one it names.
    """
    done = folded_batches(spark, root, name)
    found = commits(spark, root).filter(F.array_contains("tables", name)).collect()  # one row per batch since the last compaction
    open_ = [r for r in found if r["batch"] > done.get(r["stream"], -1) and (upto is None or r["batch"] <= upto.get(r["stream"], -1))]
    if not open_:
        return None
    rows = spark.read.parquet(*(_folder(root, name, r["stream"], r["batch"], r["attempt"]) for r in open_))
    return rows.withColumn("batch_order", F.struct("_batch", "batch_order")).drop("_batch")


def read_merged(spark: SparkSession, root: str, name: str, upsert: Upsert, upto: dict[str, int] | None = None) -> DataFrame | None:
    """A table as it is now: ``upsert(current version or None, changed rows)``."""
    base = read_current(spark, root).get(name)
    changes = committed_changes(spark, root, name, upto)
    return base if changes is None else upsert(base, changes)


def compact(spark: SparkSession, root: str, upserts: dict[str, Upsert], run_id: str | None = None) -> dict[str, str]:
    """Write every changed table as a new version and make all of them current at once."""
    run_id = run_id or f"compact-{uuid.uuid4().hex[:12]}"
    # batches that are committed while this runs are left to the next time
    upto = {r["stream"]: r["batch"] for r in commits(spark, root).groupBy("stream").agg(F.max("batch").alias("batch")).collect()}
    versions = {}
    for name, upsert in upserts.items():
        if committed_changes(spark, root, name, upto) is not None:
            write_version(read_merged(spark, root, name, upsert, upto), root, name, run_id)
            versions[name] = run_id
    publish(spark, root, run_id, versions, upto)
    return versions


def keep_last(keys: list[str]) -> Upsert:
    """The upsert of tables whose rows replace each other: the last row of a key, by ``batch_order``."""

    def upsert(old: DataFrame | None, new: DataFrame) -> DataFrame:
        columns = [c for c in new.columns if c != "batch_order"]
        last = new.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch_order").alias("_r")).select("_r.*")
        return last if old is None else old.join(last, keys, "left_anti").select(*columns).unionByName(last)

    return upsert
