"""Ordered computations that never gather one key in one task.

A key may hold a third of all rows, so positions and greedy gates are computed
per (key, chunk) first; only one small row per chunk is then ordered per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.session import use_checkpoints


def running_index(
    df: DataFrame, keys: list[str], order: list[str], chunk: Column, name: str = "position"
) -> DataFrame:
    """1-based position of each row within its key.

    ``chunk`` must not decrease along ``order``; a chunk is what one task sorts.
    """
    tagged = df.withColumn("_chunk", chunk)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(*keys, "_chunk")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    return (
        tagged.withColumn("_local", F.row_number().over(inside))
        .join(offsets, [*keys, "_chunk"])
        .withColumn(name, F.col("_before") + F.col("_local"))
        .drop("_chunk", "_local", "_before")
    )


def places(df: DataFrame, columns: list[str], name: str = "place") -> DataFrame:
    """1-based position of each row of a whole table, by columns that tell its rows apart: ranges of values are sorted side by side."""
    use_checkpoints(df.sparkSession)
    ranged = df.repartitionByRange(*columns).withColumn("_range", F.spark_partition_id()).checkpoint()
    return running_index(ranged, [], columns, F.col("_range"), name).drop("_range")


def _fold_heads(times: Column, start: Column, interval: Column) -> Column:
    """Greedy heads of a sorted array of times, given the last head before it."""
    empty = F.array().cast("array<bigint>")
    state = F.struct(start.cast("bigint").alias("last"), empty.alias("heads"))

    def step(acc, t):
        take = acc["last"].isNull() | (t - acc["last"] >= interval)
        return F.struct(
            F.when(take, t).otherwise(acc["last"]).alias("last"),
            F.when(take, F.array_append(acc["heads"], t)).otherwise(acc["heads"]).alias("heads"),
        )

    return F.aggregate(times, state, step)


def greedy_heads(
    df: DataFrame, keys: list[str], micros: str, interval: int, chunk: int, fold_limit: int = 20_000
) -> DataFrame:
    """Times accepted by "at least ``interval`` after the last accepted one", per key.

    A gap of ``interval`` in the input forgets all history, so runs between such
    gaps are independent. Short runs are folded at once. In a run longer than
    ``fold_limit`` every time gets a pointer to the first one that may follow it,
    and the pointers are followed from its start in a logarithmic number of rounds.
    """
    spark = df.sparkSession
    gap = F.lit(interval)
    use_checkpoints(spark)
    # narrow and read by several steps below, so it is computed once
    times = df.select(*keys, F.col(micros).alias("t")).distinct().checkpoint()
    times = times.withColumn("_c", F.floor(F.col("t") / F.lit(chunk)))
    inside = Window.partitionBy(*keys, "_c").orderBy("t")
    by_chunk = Window.partitionBy(*keys).orderBy("_c")
    earlier = by_chunk.rowsBetween(Window.unboundedPreceding, -1)

    last_before = (
        times.groupBy(*keys, "_c")
        .agg(F.max("t").alias("_max"))
        .withColumn("_carry", F.max("_max").over(earlier))
        .drop("_max")
    )
    breaks = (
        times.join(last_before, [*keys, "_c"])
        .withColumn("_prev", F.coalesce(F.lag("t").over(inside), F.col("_carry")))
        .withColumn(
            "_break",
            F.when(F.col("_prev").isNull() | (F.col("t") - F.col("_prev") >= gap), F.col("t")),
        )
        .drop("_carry", "_prev")
    )
    run_before = (
        breaks.groupBy(*keys, "_c")
        .agg(F.max("_break").alias("_max"))
        .withColumn("_carry", F.max("_max").over(earlier))
        .drop("_max")
    )
    runs = (
        breaks.join(run_before, [*keys, "_c"])
        .withColumn("_run", F.coalesce(F.max("_break").over(inside), F.col("_carry")))
        .drop("_break", "_carry")
    )
    sizes = runs.groupBy(*keys, "_run").agg(F.count("*").alias("_size"))
    sized = runs.join(sizes, [*keys, "_run"]).checkpoint()

    def heads_of(blocks: DataFrame) -> DataFrame:
        return blocks.select(*keys, F.explode("_fold.heads").alias("t"))

    def blocks_of(rows: DataFrame, group: list[str]) -> DataFrame:
        return rows.groupBy(*group).agg(F.sort_array(F.collect_list("t")).alias("_times"))

    short = blocks_of(sized.filter(F.col("_size") <= fold_limit), [*keys, "_run"]).withColumn(
        "_fold", _fold_heads(F.col("_times"), F.lit(None), gap)
    )
    heads = heads_of(short)
    long_rows = sized.filter(F.col("_size") > fold_limit)
    if long_rows.limit(1).count() == 0:
        return heads

    starts = long_rows.groupBy(*keys, "_run").agg(F.min("t").alias("t"))
    jumps = _next_at_or_after(long_rows.select(*keys, "_run", "t"), [*keys, "_run"], interval, chunk).checkpoint()
    return heads.unionByName(follow_pointers(starts, jumps, [*keys, "_run"]).select(*keys, "t"))


def _next_at_or_after(rows: DataFrame, group: list[str], interval: int, chunk: int) -> DataFrame:
    """(group, t, next): the first time of the group that is at least ``interval`` after t.

    Looked up within chunks of time; a chunk without one takes the first time of the
    next chunk that has any, from one small row per chunk.
    """
    targets = rows.select(*group, F.col("t").alias("_x"), F.col("t").alias("_target"), F.lit(None).cast("bigint").alias("t"))
    probes = rows.select(*group, (F.col("t") + F.lit(interval)).alias("_x"), F.lit(None).cast("bigint").alias("_target"), "t")
    both = targets.unionByName(probes).withColumn("_c", F.floor(F.col("_x") / F.lit(chunk)))
    after = Window.partitionBy(*group).orderBy("_c").rowsBetween(1, Window.unboundedFollowing)
    later = (
        both.groupBy(*group, "_c").agg(F.min("_target").alias("_first"))
        .withColumn("_later", F.min("_first").over(after)).drop("_first")
    )
    # from the latest time to the earliest, and times before probes of the same moment
    inside = Window.partitionBy(*group, "_c").orderBy(F.col("_x").desc(), F.col("_target").isNull())
    so_far = F.min("_target").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return (
        both.withColumn("_near", so_far).filter("t is not null").join(later, [*group, "_c"])
        .select(*group, "t", F.coalesce("_near", "_later").alias("next")).filter("next is not null")
    )


def follow_pointers(starts: DataFrame, jumps: DataFrame, group: list[str]) -> DataFrame:
    """All (group, t) that the starts reach by jumps, in as many rounds as the logarithm of the longest way.

    Jumps are doubled until none is left; then every doubled jump, the longest
    first, is applied once to all that has been reached.
    """
    levels = []
    while not jumps.isEmpty():
        levels.append(jumps)
        onward = jumps.select(*group, F.col("t").alias("next"), F.col("next").alias("_then"))
        jumps = jumps.join(onward, [*group, "next"]).select(*group, "t", F.col("_then").alias("next")).checkpoint()
    reached = starts.select(*group, "t")
    for level in reversed(levels):
        reached = reached.unionByName(reached.join(level, [*group, "t"]).select(*group, F.col("next").alias("t"))).checkpoint()
    return reached.distinct()
