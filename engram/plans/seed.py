"""A memory's first identity, people and procedures, from rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.operators.tables import upsert_identity, upsert_persons, upsert_procedures


def person_node_links(persons: DataFrame, nodes: DataFrame) -> DataFrame:
    """``persons`` with semantic_node_id: the first person node, by id, that bears ``node_name``, whatever its case."""
    known = nodes.filter("type = 'person'").groupBy(F.lower("name").alias("_node")).agg(F.min("id").alias("semantic_node_id"))
    columns = [c for c in persons.columns if c not in ("node_name", "semantic_node_id")]
    linked = persons.withColumn("_node", F.lower("node_name")).join(known, "_node", "left")
    return linked.select(*columns, "semantic_node_id")


def seed_layers(tables: dict[str, DataFrame], seeds: dict[str, DataFrame], as_of) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables after the seeds are upserted, and (layer, category, seeded): how many rows of each kind there were.

    ``seeds`` may hold identity (key, value, category, emotional_weight), persons (the columns of persons that are
    given, and node_name) and procedures (name, type, trigger_phrases, steps, confidence), each with batch_order. Seeding
    twice affirms identity and meets persons again, and leaves procedures as they are.
    """
    out, counts = dict(tables), []

    def count(layer: str, rows: DataFrame, category) -> None:
        counts.append(rows.groupBy(category.alias("category")).agg(F.count("*").alias("seeded")).select(F.lit(layer).alias("layer"), "category", "seeded"))

    if "identity" in seeds:
        out["identity"] = upsert_identity(tables["identity"], seeds["identity"], as_of)
        count("identity", seeds["identity"], F.col("category"))
    if "persons" in seeds:
        linked = person_node_links(seeds["persons"], tables["nodes"])
        out["persons"] = upsert_persons(tables["persons"], linked, as_of)
        count("persons", linked, F.when(F.col("semantic_node_id").isNotNull(), "linked").otherwise("alone"))
    if "procedures" in seeds:
        out["procedures"] = upsert_procedures(tables["procedures"], seeds["procedures"])
        count("procedures", seeds["procedures"], F.col("type"))
    stats = counts[0]
    for more in counts[1:]:
        stats = stats.unionByName(more)
    return out, stats
