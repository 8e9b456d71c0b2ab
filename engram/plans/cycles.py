"""Pipelines: maintenance suite, sleep cycles, consolidation, backfill.

A stage takes the tables and a way to keep an intermediate one, and returns new tables
and counters. With a ``root``, the changed tables of every stage are written as new
versions under names of this run alone and read back, so lineage ends there; without, they
are checkpointed. Only when all stages are done do the new versions become the current
ones. Counters are read from what was kept, so nothing is computed for them again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.functions.scores import timestamp
from engram.operators import consolidation as co
from engram.operators import crosslinks, enrichment
from engram.operators import maintenance as mt
from engram.operators.tables import record_executions
from engram.session import use_checkpoints
from engram.sources.tables import append_log, current_versions, publish, read_current, read_table, write_version

Tables = dict[str, DataFrame]
Keep = Callable[[DataFrame, str], DataFrame]
Stage = Callable[[Tables, Keep], tuple[Tables, dict[str, DataFrame]]]


def _one(df: DataFrame) -> DataFrame:
    return df.withColumn("_one", F.lit(1))


def maintain(tables: Tables, as_of) -> tuple[Tables, DataFrame]:
    """Duplicates, then the decay report, then the contradiction scan."""
    nodes, edges, persons = tables["nodes"], tables["edges"], tables["persons"]
    kept = mt.drop_orphans(nodes, edges, persons)
    kept, moved = mt.merge_aliases(kept, edges, persons)
    before = nodes.agg(F.count_if(F.col("type") == "person").alias("persons_before"))
    after = kept.agg(F.count_if(F.col("type") == "person").alias("persons_after"))
    report = mt.decay_report(kept, as_of).drop("avg_effective")
    stats = _one(before).join(_one(after), "_one").join(_one(report), "_one").drop("_one")
    if "contradictions" in tables:
        scan = mt.scan_contradictions(tables["contradictions"])
        stats = _one(stats).join(_one(scan), "_one").drop("_one")
    return {**tables, "nodes": kept, "edges": moved}, stats


# --- stages ---------------------------------------------------------------------
def enrich_stage(tables: Tables, keep: Keep):
    episodes, stats = enrichment.enrich(tables["episodes"], tables["nodes"], keep=lambda df: keep(df, "enriched"))
    return {**tables, "episodes": episodes}, {"enrich": stats}


def with_edge_ids(edges: DataFrame) -> DataFrame:
    """Edges found by a stage, with an id from their natural key."""
    key = F.concat_ws("\u0001", "source_id", "target_id", "relationship")
    return edges.withColumn("id", F.concat(F.lit("edge:"), F.substring(F.sha2(key, 256), 1, 32)))


def backlog_stage(tables: Tables, keep: Keep):
    """Vectors that a model has given since are joined back; texts of rows that still lack one, all of them, are a table for the model."""
    if not all("embedding" in tables[t].columns for t in ("episodes", "nodes")):
        return tables, {}
    counters, out = {}, dict(tables)
    if "vectors" in tables:
        for table, kind in (("episodes", "episode"), ("nodes", "node")):
            out[table] = keep(co.attach_vectors(tables[table], kind, tables["vectors"]), f"{table}-vectors")
            before = tables[table].agg(F.count_if(F.col("embedding").isNull()).alias("n"))
            after = out[table].agg(F.count_if(F.col("embedding").isNull()).alias("m"))
            counters[f"{table}_embedded"] = _one(before).join(_one(after), "_one").select((F.col("n") - F.col("m")).alias(f"{table}_embedded"))
    backlog = keep(co.embedding_backlog(out["episodes"], out["nodes"], limit=None), "backlog")
    return {**out, "backlog": backlog}, {**counters, "backlog": backlog.agg(F.count("*").alias("embedding_backlog"))}


def decay_stage(as_of) -> Stage:
    def run(tables: Tables, keep: Keep):
        return tables, {"decay": mt.decay_report(tables["nodes"], as_of)}

    return run


def contradiction_stage(tables: Tables, keep: Keep):
    if "contradictions" not in tables:
        return tables, {}
    return tables, {"contradictions": mt.scan_contradictions(tables["contradictions"])}


def reweight_stage(as_of) -> Stage:
    def run(tables: Tables, keep: Keep):
        edges = mt.reweight_edges(tables["edges"], tables["nodes"], as_of)
        return {**tables, "edges": edges}, {}

    return run


def person_stage(as_of) -> Stage:
    def run(tables: Tables, keep: Keep):
        if "person_updates" not in tables:
            return tables, {}
        updates = tables["person_updates"]
        persons = co.apply_person_updates(tables["persons"], updates, as_of)
        hit = updates.select(F.lower("name").alias("n")).distinct().join(
            tables["persons"].select(F.lower("name").alias("n")), "n", "left_semi"
        )
        return {**tables, "persons": persons}, {"person_model_updates": hit.agg(F.count("*").alias("person_model_updates"))}

    return run


def lesson_stage(as_of) -> Stage:
    def run(tables: Tables, keep: Keep):
        insights, lessons = tables["insights"], tables["lessons"]
        matches = keep(co.match_lessons(insights, lessons), "matches")
        fresh = keep(co.new_lessons(insights, matches, as_of), "fresh")
        known = co.reinforce_lessons(lessons, matches, as_of)
        counts = {
            "lessons_reinforced": matches.agg(F.count("*").alias("lessons_reinforced")),
            "lessons_learned": fresh.agg(F.count("*").alias("lessons_learned")),
        }
        return {**tables, "lessons": known.unionByName(fresh, allowMissingColumns=True)}, counts

    return run


def affirm_stage(as_of) -> Stage:
    def run(tables: Tables, keep: Keep):
        identity = co.affirm_from_insights(tables["identity"], tables["insights"], as_of)
        return {**tables, "identity": identity}, {}

    return run


def discover_stage(tables: Tables, keep: Keep):
    if "related_entities" not in tables["insights"].columns:
        return tables, {}
    found = keep(with_edge_ids(co.discover_edges(tables["insights"], tables["nodes"], tables["edges"])), "found")
    edges = tables["edges"].unionByName(found, allowMissingColumns=True)
    return {**tables, "edges": edges}, {"new_relationships": found.agg(F.count("*").alias("new_relationships"))}


def procedure_stage(as_of) -> Stage:
    def run(tables: Tables, keep: Keep):
        recent = co.recent_window(tables["episodes"], as_of)
        strict = co.track_executions(tables["procedures"], recent)
        once = record_executions(tables["procedures"], strict)
        loose = keep(co.track_executions(tables["procedures"], recent, strict=False), "executions")
        return {**tables, "procedures": record_executions(once, loose)}, {
            "procedures_tracked": loose.agg(F.count("*").alias("procedures_tracked"))
        }

    return run


def cross_stage(tables: Tables, keep: Keep):
    return {**tables, "cross_edges": crosslinks.build_cross_edges(tables, tables.get("cross_edges"))}, {}


def link_stage(tables: Tables, keep: Keep):
    pairs = enrichment.link_related(tables["episodes"], tables.get("episode_links"))
    new = enrichment.symmetric_links(pairs)
    old = tables.get("episode_links")
    return {**tables, "episode_links": new if old is None else old.unionByName(new)}, {}


def rolled_up(episodes: DataFrame, rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Episodes with the marks set and the summary rows added."""
    marked = (
        episodes.join(marks.withColumnRenamed("consolidated_into", "_into"), "id", "left")
        .withColumn("consolidated_into", F.coalesce("consolidated_into", "_into")).drop("_into")
    )
    rows = rows.drop("rolled_up", "part").withColumn("access_count", F.lit(0))
    return marked.unionByName(rows, allowMissingColumns=True)


def rollup_stage(as_of) -> Stage:
    def run(tables: Tables, keep: Keep):
        episodes = tables["episodes"]
        if "consolidated_into" not in episodes.columns:
            episodes = episodes.withColumn("consolidated_into", F.lit(None).cast("string"))
        summary, marks = co.rollup_stale(episodes, as_of)
        summary = keep(summary, "summary")
        return {**tables, "episodes": rolled_up(episodes, summary, marks)}, {
            "memories_consolidated": summary.agg(F.coalesce(F.sum("rolled_up"), F.lit(0)).alias("memories_consolidated"))
        }

    return run


def dedup_stage(as_of) -> Stage:
    def run(tables: Tables, keep: Keep):
        out, stats = maintain(tables, as_of)
        return out, {"dedup": stats}

    return run


def infer_stage(tables: Tables, keep: Keep):
    pairs = mt.cooccurrence(tables["sections"], tables["nodes"], min_count=3)
    found = keep(with_edge_ids(mt.infer_edges(pairs, tables["nodes"], tables["edges"])), "found")
    return {**tables, "edges": tables["edges"].unionByName(found, allowMissingColumns=True)}, {
        "edges_inferred": found.agg(F.count("*").alias("edges_inferred"))
    }


def daily_rollup_stage(as_of) -> Stage:
    def run(tables: Tables, keep: Keep):
        episodes = tables["episodes"]
        if "consolidated_into" not in episodes.columns:
            episodes = episodes.withColumn("consolidated_into", F.lit(None).cast("string"))
        rows, marks = co.rollup_daily(episodes, as_of)
        rows = keep(rows, "rollups")
        return {**tables, "episodes": rolled_up(episodes, rows, marks)}, {
            "memories_consolidated": rows.agg(F.coalesce(F.max("rolled_up"), F.lit(0)).alias("memories_consolidated"))
        }

    return run


def session_end_stage(as_of) -> Stage:
    def run(tables: Tables, keep: Keep):
        identity = co.affirm_from_episodes(tables["identity"], tables["episodes"], as_of)
        persons = co.interactions_from_episodes(tables["persons"], tables["episodes"], as_of)
        return {**tables, "identity": identity, "persons": persons}, {}

    return run


def entity_link_stage(tables: Tables, keep: Keep):
    return {**tables, "entity_links": enrichment.link_entities(tables["episodes"], tables["nodes"])}, {}


def health_stage(as_of) -> Stage:
    def run(tables: Tables, keep: Keep):
        return tables, {"health": co.health(tables, tables.get("contradictions"), as_of)}

    return run


# --- cycles -------------------------------------------------------------------------
def cycle_stages(kind: str, as_of) -> list[tuple[str, Stage]]:
    session = [("enrich", enrich_stage), ("reweight", reweight_stage(as_of)), ("backlog", backlog_stage)]
    nightly = session + [
        ("persons", person_stage(as_of)), ("lessons", lesson_stage(as_of)), ("affirm", affirm_stage(as_of)),
        ("discover", discover_stage), ("procedures", procedure_stage(as_of)), ("cross", cross_stage),
        ("link", link_stage), ("rollup", rollup_stage(as_of)), ("decay", decay_stage(as_of)), ("contradictions", contradiction_stage),
    ]
    weekly = nightly + [("dedup", dedup_stage(as_of)), ("reweight_again", reweight_stage(as_of))]
    return {"session": session, "nightly": nightly, "weekly": weekly}[kind]


def consolidation_stages(mode: str, as_of) -> list[tuple[str, Stage]]:
    end = [("enrich", enrich_stage), ("session_end", session_end_stage(as_of)), ("backlog", backlog_stage)]
    daily = end + [
        ("link", link_stage), ("entity_links", entity_link_stage), ("rollup", daily_rollup_stage(as_of)),
        ("decay", decay_stage(as_of)), ("contradictions", contradiction_stage), ("health", health_stage(as_of)),
    ]
    weekly = daily + [("dedup", dedup_stage(as_of)), ("infer", infer_stage), ("audit", health_stage(as_of))]
    return {"session_end": end, "daily": daily, "weekly": weekly}[mode]


def backfill_stages(as_of) -> list[tuple[str, Stage]]:
    return [
        ("lessons", lesson_stage(as_of)), ("persons", person_stage(as_of)), ("discover", discover_stage), ("affirm", affirm_stage(as_of)),
    ]


def run_stages(
    spark: SparkSession, stages: list[tuple[str, Stage]], tables: Tables, root: str | None = None, run_id: str = "run", keep_going: bool = False
) -> tuple[Tables, dict[str, dict]]:
    """Run stages in order; counters are single rows, read when a stage is done.

    A failing stage ends the run with its error, and the current versions stay what they were. With
    ``keep_going`` it is noted instead and later stages work on the tables before it.
    """
    details: dict[str, dict] = {}
    versions: dict[str, str] = {}
    use_checkpoints(spark)
    for number, (name, stage) in enumerate(stages):
        version = f"{run_id}-{number:02d}-{name}"

        def keep(df: DataFrame, what: str, version: str = version) -> DataFrame:
            if root is None:
                return df.checkpoint()
            write_version(df, root, f"intermediate/{what}", version)
            return read_table(spark, root, f"intermediate/{what}", version)

        try:
            after, counters = stage(tables, keep)
            changed = [t for t in after if after[t] is not tables.get(t)]
            for table in changed:
                if root is None:
                    after[table] = after[table].checkpoint()
                else:
                    write_version(after[table], root, table, version)
                    after[table] = read_table(spark, root, table, version)
            found: dict = {}
            for row in counters.values():
                found.update(row.first().asDict())
        except Exception as error:  # noqa: BLE001 - only noted if the caller asked for that
            if not keep_going:
                raise
            details[name] = {"error": str(error)[:500]}
            continue
        details[name] = found
        versions |= {table: version for table in changed}
        tables = after
    if root is not None:
        publish(spark, root, run_id, versions)
    return tables, details


def _run(spark: SparkSession, kind: str, stages, tables: Tables | None, as_of, root: str | None, keep_going: bool) -> tuple[Tables, dict]:
    """Stages under a run id of their own; without tables, on the current versions below ``root``."""
    if tables is None:
        if root is None or not current_versions(spark, root):
            raise ValueError("no tables: pass some, or a root with current versions")
        tables = read_current(spark, root)
    run_id = f"{kind}-{str(as_of)[:10]}-{uuid.uuid4().hex[:12]}"
    after, details = run_stages(spark, stages, tables, root, run_id, keep_going)
    _log(spark, details, kind, as_of, root)
    return after, details


def run_cycle(spark: SparkSession, tables: Tables | None, kind: str, as_of, root: str | None = None, keep_going: bool = False) -> tuple[Tables, dict]:
    """Session, nightly or weekly cycle; with a root its log row is appended."""
    return _run(spark, kind, cycle_stages(kind, as_of), tables, as_of, root, keep_going)


def consolidate(spark: SparkSession, tables: Tables | None, mode: str, as_of, root: str | None = None, keep_going: bool = False) -> tuple[Tables, dict]:
    return _run(spark, mode, consolidation_stages(mode, as_of), tables, as_of, root, keep_going)


def run_backfill(spark: SparkSession, tables: Tables | None, as_of, root: str | None = None, keep_going: bool = False) -> tuple[Tables, dict]:
    return _run(spark, "backfill", backfill_stages(as_of), tables, as_of, root, keep_going)


def _log(spark: SparkSession, details: dict, mode: str, as_of, root: str | None) -> None:
    if root is None:
        return
    import json

    row = spark.createDataFrame([(mode, json.dumps(details, default=str, sort_keys=True))], "mode string, details string")
    append_log(row.withColumn("run_at", timestamp(as_of)), root)
