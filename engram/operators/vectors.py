"""Vector search: nearest rows per query and all pairs above a threshold.

The products are dense matrix products inside Arrow batches; Spark partitions
the rows and only results leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.operators.matching import top_per
from engram.operators.ordering import places
from engram.session import use_checkpoints

QUERY_BLOCK = 4096
PAIR_BLOCK = 2000
PAIR_COPIES = 32
PAIR_BYTES = 32_000_000


def _unit(vectors) -> np.ndarray:
    matrix = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


class _Running:
    """The k best items per query of what a task has seen, ties by item id."""

    def __init__(self, query_ids, k: int, min_sim: float):
        self.query_ids, self.k, self.min_sim = np.asarray(query_ids), k, min_sim
        self.bar = np.full(len(self.query_ids), min_sim)
        self.held: list[pd.DataFrame] = []
        self.size = 0

    def add(self, sims: np.ndarray, item_ids) -> None:
        rows, cols = np.nonzero(sims >= self.bar)
        self.held.append(pd.DataFrame({"at": cols, "item_id": pd.Series(np.asarray(item_ids, dtype=object)[rows], dtype=object), "similarity": sims[rows, cols]}))
        self.size += len(rows)
        if self.size > max(100_000, 4 * self.k * len(self.query_ids)):
            self._prune()

    def _prune(self) -> pd.DataFrame:
        best = pd.concat(self.held, ignore_index=True).sort_values(["at", "similarity", "item_id"], ascending=[True, False, True])
        place = best.groupby("at").cumcount()
        best = best[place < self.k]
        full = best.groupby("at")["similarity"].agg(["size", "min"])
        full = full[full["size"] == self.k]
        self.bar[full.index.to_numpy()] = full["min"].to_numpy()
        self.held, self.size = [best], len(best)
        return best

    def rows(self) -> pd.DataFrame:
        if not self.held:
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "item_id": pd.Series(dtype=object), "similarity": np.zeros(0)})
        best = self._prune()
        items = pd.Series(best["item_id"].to_numpy(object), dtype=object)
        return pd.DataFrame({"query_id": self.query_ids[best["at"].to_numpy()], "item_id": items, "similarity": best["similarity"].to_numpy()})


def knn(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    min_similarity: float,
    item_id: str = "id",
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """Top k items by cosine per query: (query_id, item_id, similarity, rank).

    Exact. Queries travel to the tasks as matrices of about ``query_block`` rows; every matrix
    goes over the items once, and a task passes on the k best items per query that it has seen. Items never move.
    """
    spark = items.sparkSession
    queries = queries.filter(F.col("embedding").isNotNull()).select("query_id", "embedding")
    items = items.filter(F.col("embedding").isNotNull()).select(
        F.col(item_id).alias("item_id"), "embedding"
    )
    id_type = items.schema["item_id"].dataType.simpleString()
    schema = f"query_id bigint, item_id {id_type}, similarity double"
    rows = queries.limit(query_block + 1).collect()
    if len(rows) <= query_block:
        blocks = [rows]
    else:
        n = math.ceil(queries.count() / query_block)
        of = F.pmod(F.xxhash64("query_id"), F.lit(n))
        blocks = (queries.filter(of == i).collect() for i in range(n))

    def scored(rows: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(([r["query_id"] for r in rows], _unit([r["embedding"] for r in rows]) if rows else None))

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            query_ids, query_matrix = shared.value
            best = _Running(query_ids, k, min_similarity)
            for batch in batches:
                if query_matrix is not None and len(batch):
                    best.add(np.round(_unit(batch["embedding"]) @ query_matrix.T, 9), batch["item_id"].to_numpy())
            yield best.rows()

        return items.mapInPandas(score, schema)

    every = reduce(DataFrame.unionByName, [scored(b) for b in blocks])
    order = [F.col("similarity").desc(), F.col("item_id")]
    best = top_per(every, ["query_id"], order, k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return best.withColumn("rank", rank)


def first_above(items: DataFrame, others: DataFrame, threshold: float, item_id: str = "id", other_id: str = "id", block: int = QUERY_BLOCK) -> DataFrame:
    """(item_id, first_id): the first row of ``others``, by id, with a cosine above the threshold, for items that have one.

    ``others`` travel in blocks in the order of their ids; an item that has found its row meets no further block.
    """
    spark = items.sparkSession
    use_checkpoints(spark)
    left = items.filter(F.col("embedding").isNotNull()).select(F.col(item_id).alias("item_id"), "embedding")
    right = others.filter(F.col("embedding").isNotNull()).select(F.col(other_id).alias("first_id"), "embedding")
    order = places(right.select("first_id").distinct(), ["first_id"]).checkpoint()
    placed = right.join(order, "first_id")
    types = [x.schema[c].dataType.simpleString() for x, c in ((left, "item_id"), (right, "first_id"))]
    found = spark.createDataFrame([], f"item_id {types[0]}, first_id {types[1]}")
    for lo in range(0, order.count(), block):
        rows = placed.filter((F.col("place") > lo) & (F.col("place") <= lo + block)).orderBy("place").collect()
        shared = spark.sparkContext.broadcast(([r["first_id"] for r in rows], _unit([r["embedding"] for r in rows])))

        def score(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, matrix = shared.value
            for batch in batches:
                if len(batch):
                    above = np.round(_unit(batch["embedding"]) @ matrix.T, 9) > threshold
                    hit = above.any(axis=1)
                    first = np.asarray(ids, dtype=object)[above[hit].argmax(axis=1)]
                    yield pd.DataFrame({"item_id": pd.Series(batch["item_id"].to_numpy(object)[hit], dtype=object), "first_id": pd.Series(first, dtype=object)})

        now = left.join(found, "item_id", "left_anti").mapInPandas(score, f"item_id {types[0]}, first_id {types[1]}")
        found = found.unionByName(now).checkpoint()
    return found


def _pivots(vectors: DataFrame, count: int, sample: int) -> np.ndarray:
    """Unit vectors far from each other, out of a bounded sample: they only decide which blocks are compared."""
    square = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    rows = vectors.filter(square > 0).orderBy(F.xxhash64("embedding"), "embedding").limit(sample).select("embedding").collect()
    if not rows:
        return np.zeros((0, 0))
    unit = _unit([r["embedding"] for r in rows])
    chosen, nearest = [0], unit @ unit[0]
    while len(chosen) < min(count, len(unit)):
        far = int(np.argmin(nearest))
        chosen.append(far)
        nearest = np.maximum(nearest, unit @ unit[far])
    return unit[chosen]


def _with_angles(vectors: DataFrame, pivots: np.ndarray, key_type: str) -> DataFrame:
    """(a, embedding, angles): the angle of every vector other than zero to each pivot."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            unit = _unit(batch["embedding"]) if len(batch) else np.zeros((0, 1))
            real = np.linalg.norm(unit, axis=1) > 0
            angles = np.arccos(np.clip(unit[real] @ shared.value.T, -1, 1)) if real.any() else np.zeros((0, len(shared.value)))
            yield batch[real].assign(angles=list(angles))[["a", "embedding", "angles"]]

    return vectors.mapInPandas(measure, f"a {key_type}, embedding {vectors.schema['embedding'].dataType.simpleString()}, angles array<double>")


def block_pairs(placed: DataFrame, pivots: int, angle: float) -> tuple[DataFrame, DataFrame]:
    """Blocks with the least and greatest angle to each pivot, and the pairs of blocks (x, y), x <= y, that can hold a close pair.

    Two vectors within ``angle`` of each other differ by no more in their angle to any direction. So two blocks are
    skipped if their ranges lie further apart for one pivot. Blocks meet by the bands that they cover for the first.
    """
    ranges = [F.struct(F.min(F.col("angles")[i]).alias("lo"), F.max(F.col("angles")[i]).alias("hi")) for i in range(pivots)]
    blocks = placed.groupBy("block").agg(F.count("*").alias("size"), F.array(*ranges).alias("ranges"))
    band = lambda v: F.floor(v / F.lit(angle)).cast("int")
    first = F.col("ranges")[0]
    left = blocks.select(F.col("block").alias("x"), F.col("ranges").alias("rx"), F.explode(F.sequence(band(first["lo"]), band(first["hi"]))).alias("band"))
    wide = F.sequence(band(F.greatest(first["lo"] - angle, F.lit(0.0))), band(first["hi"] + angle))
    right = blocks.select(F.col("block").alias("y"), F.col("ranges").alias("ry"), F.explode(wide).alias("band"))
    apart = F.exists(F.zip_with("rx", "ry", lambda p, q: (p["lo"] > q["hi"] + angle) | (q["lo"] > p["hi"] + angle)), lambda v: v)
    pairs = left.join(right, "band").filter((F.col("x") <= F.col("y")) & ~apart).select("x", "y").distinct()
    return blocks, pairs


def similar_pairs(
    df: DataFrame, threshold: float, key: str = "id", block: int = PAIR_BLOCK, pivots: int = 8, sample: int = 2000
) -> DataFrame:
    """All pairs a < b with cosine above ``threshold``: (a, b, similarity). Exact.

    Equal vectors are one row here, with their smallest key, and are compared once; (smallest key, copy) rows
    tell which keys are members of it, and a pair of smallest keys stands for all pairs between their members. Vectors are put into blocks by their nearest pivot and their angle to the first one; blocks that the
    angles to the pivots keep apart are never compared (see ``block_pairs``). Zero vectors are similar to nothing but their copies.
    """
    use_checkpoints(df.sparkSession)
    vectors = df.filter(F.col("embedding").isNotNull()).select(F.col(key).alias("k"), "embedding")
    first = vectors.groupBy("embedding").agg(F.min("k").alias("a"))
    copies = (
        vectors.join(first, "embedding")
        .filter(F.col("k") != F.col("a"))
        .select("a", F.col("k").alias("b"), F.lit(1.0).alias("similarity"))
    )
    id_type = vectors.schema["k"].dataType.simpleString()
    placed, pairs = _placed_pairs(first, threshold, id_type, block, pivots, sample)
    if placed is None:
        return copies
    width = placed.select(F.size("embedding")).first()[0]
    pairs = grouped_pairs(pairs, PAIR_BYTES // (block * width * 8))
    members = placed.select(F.col("block").alias("at"), "a", "embedding")
    ahead = pairs.groupBy("gx", "gy", F.col("x").alias("at")).agg(F.sort_array(F.collect_set("ny")).alias("others"), F.min("nx").alias("n"))
    behind = pairs.groupBy("gx", "gy", F.col("y").alias("at")).agg(F.min("ny").alias("n")).withColumn("others", F.lit(None).cast("array<int>"))
    sides = ahead.unionByName(behind, allowMissingColumns=True)

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        is_behind = group["others"].isna()
        right = {n: (own["a"].to_numpy(object), _unit(own["embedding"])) for n, own in group[is_behind].groupby("n")}
        found = [pd.DataFrame({"a": pd.Series(dtype=object), "b": pd.Series(dtype=object), "similarity": np.zeros(0)})]
        for n, own in group[~is_behind].groupby("n"):
            ids, unit = own["a"].to_numpy(object), _unit(own["embedding"])
            for m in own["others"].iloc[0]:
                other_ids, other = right[m]
                sims = np.round(unit @ other.T, 9)
                i, j = np.nonzero(sims > threshold)
                a, b, sim = ids[i], other_ids[j], sims[i, j]
                keep = a < b if n == m else a != b
                a, b, sim = a[keep], b[keep], sim[keep]
                swap = a > b
                found.append(pd.DataFrame({"a": pd.Series(np.where(swap, b, a), dtype=object), "b": pd.Series(np.where(swap, a, b), dtype=object), "similarity": sim}))
        return pd.concat(found, ignore_index=True)

    found = members.join(sides, "at").select("gx", "gy", "n", "others", "a", "embedding")
    found = found.groupBy("gx", "gy").applyInPandas(compare, f"a {id_type}, b {id_type}, similarity double")
    return found.unionByName(copies)


def grouped_pairs(pairs: DataFrame, most: int) -> DataFrame:
    """(x, y, nx, ny, gx, gy): pairs of blocks with the numbers of the blocks and of groups of neighbouring blocks.

    A vector travels once to each pair of groups that it has a block pair in, not to each block pair, so it is copied about
    PAIR_COPIES times however many blocks there are, as long as a group has no more than ``most`` blocks.
    """
    blocks = pairs.select(F.col("x").alias("at")).unionByName(pairs.select(F.col("y").alias("at"))).distinct()
    numbered = blocks.withColumn("n", F.row_number().over(Window.orderBy("at"))).checkpoint()  # as many rows as blocks
    per_group = max(1, min(most, math.ceil(numbered.count() / PAIR_COPIES)))
    group = F.floor((F.col("n") - 1) / per_group).cast("int")
    side = lambda c: numbered.select(F.col("at").alias(c), F.col("n").alias(f"n{c}"), group.alias(f"g{c}"))
    # x comes before y in the order of blocks, so its group does too
    return pairs.join(side("x"), "x").join(side("y"), "y").checkpoint()


def _placed_pairs(first: DataFrame, threshold: float, id_type: str, block: int, pivots: int, sample: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Vectors with their block, and the pairs of blocks to compare; None without a vector other than zero."""
    chosen = _pivots(first, pivots, sample)
    if not len(chosen):
        return None, None
    angle = max(math.acos(max(-1.0, min(1.0, threshold))), 0.01) + 1e-9
    measured = _with_angles(first.select("a", "embedding"), chosen, id_type)
    nearest = F.array_position("angles", F.array_min("angles")).cast("int")
    cells = measured.withColumn("cell", F.struct(nearest.alias("near"), F.floor(F.col("angles")[0] / angle).cast("int").alias("band"))).checkpoint()
    sizes = cells.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("chunks"))
    # neighbours within a cell stay together: chunks are cut along the angle to the nearest pivot, not at random
    along = F.array_min("angles")
    bounds = cells.join(F.broadcast(sizes), "cell").groupBy("cell", "chunks").agg(F.percentile_approx(along, F.array(*[F.lit(i / 64) for i in range(1, 64)])).alias("cuts"))
    at = F.size(F.filter("cuts", lambda c: c < along))
    spread = F.pmod(F.xxhash64("a"), F.greatest(F.lit(1), F.ceil(F.col("chunks") / 64)).cast("bigint"))
    chunk = F.struct(F.floor(at * F.least(F.col("chunks"), F.lit(64)) / 64).cast("int").alias("slice"), spread.cast("int").alias("part"))
    placed = cells.join(bounds, "cell").withColumn("block", F.struct("cell.near", "cell.band", chunk["slice"].alias("slice"), chunk["part"].alias("part"))).select("a", "embedding", "angles", "block")
    placed = placed.checkpoint()
    return placed, block_pairs(placed, len(chosen), angle)[1]


def embedding_coverage(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("n"),
        F.count("embedding").alias("with_embedding"),
        F.avg(F.col("embedding").isNotNull().cast("double")).alias("coverage"),
    )
