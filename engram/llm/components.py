"""Connected components of a link table, by repeated contraction.

In each round every node points at its smallest neighbour if that is smaller
than itself, links are rewritten to the pointed-at nodes, and loops and repeats
go. The smallest node of a component never points anywhere, so it is what
remains. A hub is met by an aggregate (min, combined before the shuffle) and by
joins whose skewed side can be split; no group of links is gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.scratch import Scratch


def connected_components(links: DataFrame, a: str, b: str, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for every node that occurs in ``links``; component is its smallest node.

    Nulls and loops are ignored. An empty table gives an empty table.
    """
    edges = (
        links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
        .filter(F.col("u") < F.col("v"))
        .distinct()
    )
    edges = scratch.keep(edges, f"{name}-edges-0")
    labels = None
    rounds = 0
    while not edges.isEmpty():
        rounds += 1
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        point = both.groupBy("u").agg(F.min("v").alias("low")).select(
            F.col("u").alias("node"), F.least("u", "low").alias("up")
        )
        point = scratch.keep(point, f"{name}-point-{rounds}")
        jump = point.select(F.col("node").alias("up"), F.col("up").alias("upper"))
        for _ in range(2):
            point = point.join(jump, "up", "left").select("node", F.coalesce("upper", "up").alias("up"))
        point = scratch.keep(point, f"{name}-jump-{rounds}")
        if labels is None:
            labels = point.select("node", F.col("up").alias("component"))
        else:
            labels = labels.join(point.withColumnRenamed("node", "component"), "component", "left").select(
                "node", F.coalesce("up", "component").alias("component")
            )
        labels = scratch.keep(labels, f"{name}-labels-{rounds}")
        left = point.select(F.col("node").alias("u"), F.col("up").alias("uu"))
        right = point.select(F.col("node").alias("v"), F.col("up").alias("vv"))
        edges = (
            edges.join(left, "u").join(right, "v")
            .select(F.least("uu", "vv").alias("u"), F.greatest("uu", "vv").alias("v"))
            .filter(F.col("u") < F.col("v"))
            .distinct()
        )
        edges = scratch.keep(edges, f"{name}-edges-{rounds}")
        scratch.drop(f"{name}-point-{rounds}", f"{name}-jump-{rounds}", f"{name}-edges-{rounds - 1}",
                     f"{name}-labels-{rounds - 1}")
    if labels is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels
