"""Pipelines: markdown corpus to memory tables, snapshots to memory tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.functions import lexicons as lx
from engram.functions.text import no_strings
from engram.operators import codegraph, ingestion as ing
from engram.operators.tables import create_edges, upsert_nodes
from engram.sources.markdown import select_files, split_sections, with_file_role

EMPTY_MAP = "map<string,string>"


def _node_rows(df: DataFrame, confidence: float, basis: str) -> DataFrame:
    """Fill the columns the node upsert reads."""
    have = df.columns
    give = {
        "aliases": no_strings(), "attributes": F.create_map().cast(EMPTY_MAP),
        "significance": F.lit(None).cast("string"), "emotional_weight": F.lit(None).cast("double"),
        "batch_order": F.xxhash64("name"), "confidence": F.lit(confidence), "confidence_basis": F.lit(basis),
    }
    return df.select(
        "type", "name", *[(F.col(c) if c in have else v).alias(c) for c, v in give.items()], "context"
    )


def ingest_corpus(
    files: DataFrame,
    entity_answers: DataFrame | None,
    relation_answers: DataFrame | None,
    nodes: DataFrame,
    edges: DataFrame,
    as_of,
    variant: str = "curated",
    skip_roles: list[str] | None = None,
) -> dict[str, DataFrame]:
    """New versions of nodes and edges, new episodes and lessons.

    ``curated`` discovers people in bold type and reads lessons strictly; ``auto``
    and ``model`` take extracted entities and relationships (answers: raw) and
    the relaxed lesson rule.
    """
    order = lx.ROLE_ORDER_MODEL if variant == "model" else lx.ROLE_ORDER_AUTO
    chosen = select_files(with_file_role(files), skip=skip_roles, order=order)
    sections = split_sections(chosen)
    if variant == "curated":
        people = ing.discover_people(sections, nodes).withColumn("type", F.lit("person"))
        nodes = upsert_nodes(nodes, _node_rows(people, 0.5, "observed"), as_of)
    if entity_answers is not None:
        merged = ing.merge_entities(ing.clean_entities(entity_answers, []))
        nodes = upsert_nodes(nodes, _node_rows(merged, 0.9, "llm-extracted"), as_of)
        if relation_answers is not None:
            names = merged.select("name").unionByName(merged.select(F.explode("aliases").alias("name")))
            rels = ing.merge_relationships(ing.clean_relationships(relation_answers, names, []))
            found, _ = ing.resolve_edges(rels, nodes, 0.8, ignore_case=True)
            edges = create_edges(edges, found)
    topics = "words" if variant == "curated" else "patterns"
    lessons = ing.lessons_from_sections(sections.filter("role = 'lesson'"), strict=variant == "curated")
    return {
        "nodes": nodes, "edges": edges, "sections": sections,
        "episodes": ing.daily_episodes(sections, variant, topics), "lessons": lessons,
    }


def sync_snapshots(old: DataFrame, new: DataFrame, nodes: DataFrame, as_of) -> dict[str, DataFrame]:
    """Store new snapshots, write their entities, describe what changed."""
    stored = codegraph.store_snapshot(old, new)
    rows, links, episodes = codegraph.snapshot_to_memory(new)
    upserted = upsert_nodes(nodes, _node_rows(rows, 0.9, "code_analysis"), as_of)
    known = upserted.groupBy("name").agg(F.min("id").alias("id"))
    s = known.select(F.col("name").alias("source"), F.col("id").alias("source_id"))
    t = known.select(F.col("name").alias("target"), F.col("id").alias("target_id"))
    edges = links.join(s, "source").join(t, "target").select(
        "source_id", "target_id", "relationship", "category", "strength", "confidence"
    )
    fresh = new.select("repo_name", F.col("commit_hash").alias("to_commit"))
    diffs = codegraph.diff_snapshots(stored).join(fresh, ["repo_name", "to_commit"], "left_semi")
    told = codegraph.diff_episodes(diffs).select(
        F.concat_ws(":", F.lit("diff"), "repo_name", "to_commit").alias("id"), F.lit("code-sync").alias("session_id"),
        "summary", "importance_score", F.array(F.lit("architecture-evolution"), F.col("repo_name")).alias("topics"), "created_at",
    )
    return {"snapshots": stored, "nodes": upserted, "edges": edges, "episodes": episodes.unionByName(told)}
