"""Near-duplicate vectors by spherical-cap filters from random product codes.

The directions of the filters are all combinations of one code vector per block of
coordinates, after a random rotation: BLOCKS small random codes stand for CODES **
BLOCKS directions. A vector is decoded to the list of all directions whose inner
product with it reaches the level: a combination is only extended while the best rest can
still reach it. Where fewer than LEAST directions do, the level is lowered step by step. Vectors that share a direction
(and the label) meet in its bucket, and every pair there is checked exactly.

Equal vectors are folded into one with a weight first. A bucket is cut into parts of
bounded size and every two parts meet in a task of their own. A pair counts in the smallest
direction it shares and in no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.components import connected_components
from engram.llm.scratch import Scratch

COSINE = 0.93
BLOCKS, CODES = 3, 96
LEVEL = 4.2  # of a filter, in standard deviations of the product with a random direction
LEAST, STEP = 16, 0.2  # a vector with fewer directions of one code gets a level lower by such steps
ROTATIONS = 2  # independent codes, which make a pair without a shared direction rarer
PART = 1024
_SMALL = 96


class ProductCode:
    def __init__(self, dim: int, blocks: int = BLOCKS, codes: int = CODES, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        self.splits = np.array_split(np.arange(dim), min(blocks, dim))
        self.codes = [c / np.linalg.norm(c, axis=1, keepdims=True) for c in (rng.normal(size=(codes, len(s))) for s in self.splits)]
        self.size = codes ** len(self.splits)

    def decode(self, units: np.ndarray, level: float, least: int = 0, step: float = 0.0) -> list[np.ndarray]:
        """Per unit vector the sorted numbers of all directions it exceeds.

        A vector that exceeds fewer than ``least`` gets a level lower by ``step``, as often as needed.
        """
        lists = self._exceeded(units, level)
        few = np.flatnonzero([len(x) < min(least, self.size) for x in lists])
        if len(few) and step > 0:
            for i, x in zip(few, self.decode(units[few], level - step, least, step), strict=True):
                lists[i] = x
        return lists

    def _exceeded(self, units: np.ndarray, level: float) -> list[np.ndarray]:
        rotated = units @ self.rotation
        # a block enters with its share of the coordinates, so that a direction is a unit vector
        products = [rotated[:, s] @ c.T * np.sqrt(len(s) / units.shape[1]) for s, c in zip(self.splits, self.codes, strict=True)]
        rest = np.zeros((len(products) + 1, len(units)))
        for k in range(len(products) - 1, -1, -1):
            rest[k] = rest[k + 1] + products[k].max(axis=1)
        row, number, total = np.arange(len(units)), np.zeros(len(units), dtype=np.int64), np.zeros(len(units))
        for k, p in enumerate(products):
            total = total[:, None] + p[row]
            keep, code = np.nonzero(total + rest[k + 1][row][:, None] >= level)
            total = total[keep, code]
            row, number = row[keep], number[keep] * p.shape[1] + code
        order = np.lexsort((number, row))
        bounds = np.searchsorted(row[order], np.arange(len(units) + 1))
        return [number[order][s:e] for s, e in zip(bounds[:-1], bounds[1:], strict=True)]


def _decoder(dim: int, level: float, rotations: int):
    codes = [ProductCode(dim, seed=5 + r) for r in range(rotations)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                if not part.num_rows:
                    continue
                flat = np.stack([np.frombuffer(v, dtype=np.float64) for v in part.column("vector").to_pylist()])
                units = flat / np.linalg.norm(flat, axis=1, keepdims=True)
                each = [c.decode(units, level / np.sqrt(dim), LEAST, STEP / np.sqrt(dim)) for c in codes]
                offset = np.cumsum([0, *(c.size for c in codes)])
                lists = [np.concatenate([e[i] + o for e, o in zip(each, offset[:-1], strict=True)]) for i in range(len(flat))]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in ("key", "label", "weight", "vector")), pa.array([x.astype(np.int64) for x in lists], pa.list_(pa.int64()))],
                    names=["key", "label", "weight", "vector", "filters"],
                )

    return run


def _pairs_within(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j inside following groups of the given sizes."""
    start = np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.arange(sizes.sum()) - start
    j = np.repeat(np.arange(sizes.sum()), place)
    i = np.arange(place.sum()) - np.repeat(np.cumsum(place) - place, place) + np.repeat(start, place)
    return i, j


def _linked(cosine: float):
    """Per member of a bucket part: the weight of its links that count here, and the smallest member it reaches."""
    fields = ["label", "filter", "x", "y"]

    def reaches(unit, i, j):
        some = [np.einsum("ij,ij->i", unit[i[k : k + 20_000]], unit[j[k : k + 20_000]]) >= cosine for k in range(0, len(i), 20_000)]
        return np.concatenate(some) if some else np.zeros(0, dtype=bool)

    def check(unit, lists, filters, i, j):
        """Of the pairs, those that reach the cosine and share no smaller filter."""
        near = reaches(unit, i, j)
        i, j = i[near], j[near]
        ok = np.ones(len(i), dtype=bool)
        for lo in range(0, len(i), 20_000):
            a, b = lists[i[lo : lo + 20_000]], lists[j[lo : lo + 20_000]]
            limit = filters[i[lo : lo + 20_000]][:, None]
            smaller = np.zeros(len(a), dtype=bool)
            for k in range(a.shape[1]):
                one = a[:, k : k + 1]
                smaller |= ((one == b) & (one < limit)).any(axis=1)
            ok[lo : lo + 20_000] = ~smaller
        return i[ok], j[ok]

    def links(c) -> pa.RecordBatch:
        width = max(map(len, c["filters"]))
        lists = np.full((len(c["key"]), width), np.iinfo(np.int64).max)
        for r, f in enumerate(c["filters"]):
            lists[r, : len(f)] = f
        # past the end of a list its own number, which no other list has
        pad = lists == np.iinfo(np.int64).max
        lists[pad] = -1 - np.repeat(np.arange(len(lists)), width).reshape(lists.shape)[pad]
        flat = np.stack([np.frombuffer(v, dtype=np.float64) for v in c["vector"]])
        unit = flat / np.linalg.norm(flat, axis=1, keepdims=True)
        new = np.ones(len(flat), dtype=bool)
        new[1:] = np.any([c[f][1:] != c[f][:-1] for f in fields], axis=0)
        start = np.flatnonzero(new)
        sizes = np.diff(np.concatenate((start, [len(flat)])))
        found = []
        small = sizes <= _SMALL
        rows = np.flatnonzero(np.repeat(small, sizes))
        i, j = _pairs_within(sizes[small])
        i, j = rows[i], rows[j]
        # a bucket part of two different parts: only pairs across
        across = (c["x"] != c["y"])[i] & (c["part"][i] == c["part"][j])
        found.append(check(unit, lists, c["filter"], i[~across], j[~across]))
        for s, n in zip(start[~small], sizes[~small], strict=True):
            own = np.arange(s, s + n)
            left = own if c["x"][s] == c["y"][s] else own[c["part"][own] == c["x"][s]]
            right = own if c["x"][s] == c["y"][s] else own[c["part"][own] == c["y"][s]]
            near = unit[left] @ unit[right].T >= cosine - 1e-9
            values = np.unique(lists[own])
            values = values[(values >= 0) & (values < c["filter"][s])]
            if len(values):
                has = np.zeros((len(lists[own]), len(values) + 1), dtype=np.float32)
                at = np.searchsorted(values, lists[own])
                fits = (lists[own] >= 0) & (lists[own] < c["filter"][s])
                has[np.nonzero(fits)[0], at[fits]] = 1
                near &= ~((has[left - s] @ has[right - s].T) > 0)
            i, j = np.nonzero(near)
            i, j = left[i], right[j]
            if c["x"][s] == c["y"][s]:
                i, j = i[i < j], j[i < j]
            exact = reaches(unit, i, j)
            found.append((i[exact], j[exact]))
        i, j = (np.concatenate(p) for p in zip(*found, strict=True))
        count = np.bincount(i, c["weight"][j], minlength=len(flat)) + np.bincount(j, c["weight"][i], minlength=len(flat))
        order = np.argsort(c["key"], kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        low = rank.copy()
        while True:
            before = low.copy()
            np.minimum.at(low, i, before[j])
            np.minimum.at(low, j, before[i])
            low = np.minimum(low, low[order[low]])
            if np.array_equal(low, before):
                break
        some = count > 0
        return pa.RecordBatch.from_arrays(
            [pa.array(c["key"][some]), pa.array(count[some].astype(np.int64)), pa.array(c["key"][order][low[some]])],
            names=["key", "n", "root"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = {f: batch.column(f).to_numpy(zero_copy_only=False) for f in (*fields, "part", "key", "weight")}
            now["vector"] = np.array([*batch.column("vector").to_pylist(), None], dtype=object)[:-1]
            now["filters"] = np.array([*batch.column("filters").to_pylist(), None], dtype=object)[:-1]
            held = now if held is None else {f: np.concatenate([held[f], now[f]]) for f in now}
            last = np.all([held[f] == held[f][-1] for f in fields], axis=0)
            cut = int(np.argmax(last))
            if cut:
                yield links({f: v[:cut] for f, v in held.items()})
                held = {f: v[cut:] for f, v in held.items()}
        if held is not None:
            yield links(held)

    return run


def near_vectors(
    vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", level: float = LEVEL, rotations: int = ROTATIONS
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors``.

    Two rows of one label that is not null link if their cosine, in double precision,
    is at least ``cosine``. n_links counts the other rows a row links with, component_id is
    the smallest id it reaches and kept says that this is its own. A vector that is null, empty or
    zero, or holds a null or a value that is not finite, a row with a null label and a row with a null id
    link with nothing. Vectors of another length than the most frequent one are compared
    among themselves in the same way. Rows that repeat with one id count as several rows of it. Links are exact where found; what is found is
    the pairs that share a direction.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "caps")
    rows = vectors.select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v")
    )
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite)
        & F.exists("v", lambda x: x != 0)
    )
    rows = rows.withColumn("ok", F.coalesce(usable, F.lit(False)))
    folded = scratch.keep(
        rows.filter("ok").groupBy("label", "v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"))
        .withColumn("key", F.monotonically_increasing_id()), "folded",
    )
    dims = [r["d"] for r in folded.select(F.size("v").alias("d")).distinct().collect()]
    found = spark.createDataFrame([], "key bigint, n bigint, root bigint")
    for dim in dims:
        own = folded.filter(F.size("v") == dim).select("key", "label", "weight", _packed(F.col("v")).alias("vector"))
        found = found.unionByName(_links_of(own, dim, cosine, level, rotations, scratch))
    found = scratch.keep(found, "found")
    labels = connected_components(found, "key", "root", scratch, "cc").withColumnRenamed("node", "key")
    sums = found.groupBy("key").agg(F.sum("n").alias("n"))
    named = scratch.keep(
        folded.join(labels, "key", "left").withColumn("component", F.coalesce("component", "key")).join(sums, "key", "left").select(
            "label", "v", "vec_id", "component", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links")
        ), "named",
    )
    smallest = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    # every copy of a vector links with the other copies, and with what their first one links with
    first = named.join(smallest, "component").select("label", "v", "n_links", "component_id")
    linked = rows.filter("ok").join(first, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not ok").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    result = linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    result = scratch.keep(result, "result")
    scratch.drop("folded", "found", "named", *(f"{n}-{d}" for d in dims for n in ("coded", "met")))
    return result


def _packed(v):
    """Doubles as bytes."""

    @F.pandas_udf("binary")
    def pack(s):
        return s.map(lambda x: np.asarray(x, dtype=np.float64).tobytes())

    return pack(v)


def _links_of(own: DataFrame, dim: int, cosine: float, level: float, rotations: int, scratch: Scratch) -> DataFrame:
    coded = scratch.keep(
        own.mapInArrow(_decoder(dim, level, rotations), "key bigint, label string, weight bigint, vector binary, filters array<bigint>"), f"coded-{dim}"
    )
    each = coded.select("key", "label", F.explode("filters").alias("filter"))
    buckets = each.groupBy("label", "filter").count().filter("count > 1").select(
        "label", "filter", F.ceil(F.col("count") / PART).cast("int").alias("parts")
    )
    # a part meets itself and every other part of its bucket
    met = each.join(buckets, ["label", "filter"]).withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "key", "label", "filter", "part", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y")
    )
    met = scratch.keep(met.join(coded.select("key", "weight", "vector", "filters"), "key"), f"met-{dim}")
    width = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["label", "filter", "x", "y"]
    return met.repartition(width, *keys).sortWithinPartitions(*keys).mapInArrow(_linked(cosine), "key bigint, n bigint, root bigint")
