"""Prefix trie of conversations, by ROLLUP over positional turn-id columns.

A conversation is one row of turn-id columns t1, t2, ...: a digest of role and
text per position. ``GROUP BY node, ROLLUP (t1, ..., tw)`` meets every prefix of every row
at once, and grouping_id tells how long the prefix is. A row has a bounded number of columns, so
conversations that go on beyond the last one continue in a further block, whose rows are
grouped under the node that the block before ended in.

A node is known by its depth and its smallest member, so a conversation owns
its nodes from some depth on: from there it shares its turns with larger ids only. The first
rollup of a block finds the owners. What the subtrees need is then a fact of a single
conversation: the bytes that it shares with a smaller one, and whether its last turn is a leaf. The
second rollup adds these up. A conversation that is alone at the end of a block owns
all its further turns; they are listed without a further block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.llm.scratch import Scratch
from engram.operators.ordering import running_index

WIDTHS = (8, 16)  #: turn-id columns of the first block, and of all others
SHARED, HEADS = 5, 9
HEAVY = 1000  #: nodes with one member in so many are looked up by broadcast: at most so many a level
ORDER_CHUNK = 4096
ID_CHUNK = 512
TAIL_CHUNK = 4096


def turn_id(role: Column, text: Column) -> Column:
    """16 bytes of SHA-256 over both; the length of role keeps the two apart."""
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.unhex(F.sha2(said, 256)), 1, 16)


def numbered_turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, i, tid, bytes): turns in order from 0; equal turn numbers go by role, then by turn id."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = conversations.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"), role.alias("role"),
        turn_id(role, text).alias("tid"), F.octet_length(text).cast("bigint").alias("bytes"),
    )
    chunk = F.coalesce(F.floor(F.col("turn") / ORDER_CHUNK), F.lit(-(1 << 62)))
    placed = running_index(rows, ["conv_id"], ["turn", "role", "tid"], chunk, "i")
    return placed.select("conv_id", (F.col("i") - 1).cast("int").alias("i"), "tid", "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, length) and turns (conv_id, pos from 1, tid, bytes) after the shared openings.

    Conversation c opens with the first h turns of conversation c - c % 5, h = crc32(c) % 9; its own turns
    after its first h follow.
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").cast("int").alias("n"))
    convs = sizes.select(
        "conv_id", "n", (F.col("conv_id") - F.col("conv_id") % SHARED).alias("opener"),
        (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int").alias("h"),
    )
    opening = sizes.select(F.col("conv_id").alias("opener"), F.col("n").alias("opener_n"))
    convs = convs.join(opening, "opener", "left").withColumn("k", F.least("h", F.coalesce("opener_n", F.lit(0))))
    own = turns.join(convs.select("conv_id", "h", "k"), "conv_id").filter("i >= h").select(
        "conv_id", (F.col("i") - F.col("h") + F.col("k") + 1).alias("pos"), "tid", "bytes"
    )
    heads = turns.filter(F.col("i") < HEADS - 1).select(F.col("conv_id").alias("opener"), "i", "tid", "bytes")
    opened = heads.join(convs.select("conv_id", "opener", "h"), "opener").filter("i < h").select(
        "conv_id", (F.col("i") + 1).alias("pos"), "tid", "bytes"
    )
    length = F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return convs.select("conv_id", length.alias("length")), own.unionByName(opened)


def _wide(live: DataFrame, turns: DataFrame, start: int, width: int) -> DataFrame:
    """A row per live conversation: node, length, turn ids t1.. and bytes up to each position p0.."""
    cells = []
    for j in range(1, width + 1):
        here = F.col("pos") == start + j
        cells += [F.max(F.when(here, F.col("tid"))).alias(f"t{j}"), F.max(F.when(here, F.col("bytes"))).alias(f"b{j}")]
    rows = turns.filter((F.col("pos") > start) & (F.col("pos") <= start + width)).groupBy("conv_id").agg(*cells)
    joined = live.join(rows, "conv_id", "left")
    upto = [F.col("base").alias("p0")]
    total = F.col("base")
    for j in range(1, width + 1):
        total = total + F.coalesce(F.col(f"b{j}"), F.lit(0))
        upto.append(total.alias(f"p{j}"))
    return joined.select("conv_id", "node", "length", *(f"t{j}" for j in range(1, width + 1)), *upto)


def _path(width: int) -> str:
    return f"filter(array({', '.join(f't{j}' for j in range(1, width + 1))}), t -> t is not null)"


def _rollup(block: DataFrame, width: int, aggregates: str) -> DataFrame:
    """All prefixes of the rows of a block: node, path, d (its length), and the aggregates."""
    ids = ", ".join(f"t{j}" for j in range(1, width + 1))
    # a grouping that is longer than a row has fewer turn ids than columns, and is no prefix
    return block.sparkSession.sql(
        f"""SELECT * FROM (
              SELECT node, {_path(width)} AS path, {width} - cast(bit_count(grouping_id()) AS int) AS d, {aggregates}
              FROM {{block}} GROUP BY node, ROLLUP ({ids}))
            WHERE size(path) = d""",
        block=block,
    )


def _look_up(asked: DataFrame, nodes: DataFrame, total: int) -> DataFrame:
    """``asked`` with owner, the owner of the node at its (node, path).

    Any number of rows may ask for one node. Those that many can ask for have many members, so there are at
    most HEAVY of them a level; they are broadcast, and only rows of the others are shuffled.
    """
    shared = nodes.filter("n_convs > 1").select("node", "path", F.col("conv_id").alias("owner"), "n_convs")
    heavy = shared.filter(F.col("n_convs") * HEAVY >= total).drop("n_convs")
    light = shared.filter(F.col("n_convs") * HEAVY < total).drop("n_convs")
    first = asked.join(F.broadcast(heavy), ["node", "path"], "left")
    rest = first.filter("owner is null").drop("owner").join(light, ["node", "path"])
    return first.filter("owner is not null").unionByName(rest)


_NO = "cast(null as bigint)"


def _end_digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of the nodes in which a conversation ends.

    A digest reads all ids of its node in order, and that is one task's work; so the ids are joined to strings of
    at most ID_CHUNK before, and the task keeps one running digest, never a list.
    """
    parts = ends.groupBy("owner", "depth", F.floor(F.col("conv_id") / ID_CHUNK).alias("part")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running = None, None
        for batch in batches:
            done = []
            for *now, ids in zip(*(batch.column(c).to_pylist() for c in ("owner", "depth", "ids")), strict=True):
                if now == key:
                    running.update(b"," + ids.encode())
                    continue
                if key is not None:
                    done.append((*key, running.hexdigest()))
                key, running = now, hashlib.sha256(ids.encode())
            yield _digest_rows(done)
        if key is not None:
            yield _digest_rows([(*key, running.hexdigest())])

    ordered = parts.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "part")
    return ordered.select("owner", "depth", "ids").mapInArrow(digest, "conv_id bigint, depth int, ends_sha256 string")


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    owner, depth, digest = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(owner, pa.int64()), pa.array(depth, pa.int32()), pa.array(digest, pa.string())], names=["conv_id", "depth", "ends_sha256"]
    )


def conversation_trie(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    widths: tuple[int, int] = WIDTHS, rebuild: bool = True,
) -> DataFrame:
    """One row per node of the prefix trie of all conversations.

    conv_id (smallest member) and depth name a node; parent_conv_id is the conv_id of its parent, null for the root;
    n_convs members, n_children, n_leaves (childless nodes of its subtree, itself included), saved_tokens (over its
    subtree: n_convs - 1 times the UTF-8 bytes of the node's last text) and ends_sha256 over the members with
    no further turn.

    With ``rebuild`` conversations open with turns of another one, see ``rebuilt``; else they are taken as they are.
    Turns go by their number, null first, equal ones by role and then turn id; a null role or text is empty. Rows without a
    conversation id belong to none and are left out. Repeated rows are turns of their own. Texts of any
    length count by their digest and size alone. Other columns are ignored. An empty table has no node, not even a root.
    """
    spark = conversations.sparkSession
    scratch = Scratch(spark, "trie")
    turns = scratch.keep(numbered_turns(conversations, conv_col, turn_col, role_col, text_col), "numbered")
    if rebuild:
        convs, turns = rebuilt(turns)
    else:
        convs = turns.groupBy("conv_id").agg(F.count("*").cast("int").alias("length"))
        turns = turns.select("conv_id", (F.col("i") + 1).alias("pos"), "tid", "bytes")
    convs, turns = scratch.keep(convs, "convs"), scratch.keep(turns, "turns")
    whole = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("root")).first()
    total = whole["n"]

    live = convs.select("conv_id", F.lit(whole["root"]).cast("bigint").alias("node"), "length", F.lit(0).cast("bigint").alias("base"))
    start, k = 0, 0
    blocks, facts, ends, tails = [], [], [], []
    while k == 0 or not live.isEmpty():
        width = widths[min(k, 1)]
        block = scratch.keep(_wide(live, turns, start, width), f"block-{k}")
        nodes = scratch.keep(_rollup(block, width, "min(conv_id) AS conv_id, count(*) AS n_convs, max(length) AS longest"), f"nodes-{k}")
        owned = nodes.filter("d > 0").groupBy("conv_id").agg(
            F.min("d").alias("s"), F.max(F.when(F.col("longest") == start + F.col("d"), 1).otherwise(0)).alias("leaf"),
            F.max(F.when(F.col("d") == width, F.col("n_convs"))).alias("n_last"),
        )
        rows = block.withColumn("path", F.expr(_path(width))).withColumn("p", F.array(*(f"p{j}" for j in range(width + 1)))).select(
            "conv_id", "node", "length", "path", "p"
        ).join(owned, "conv_id", "left").withColumn("goes_on", F.col("length") > start + width)
        old = F.col("node") == F.col("conv_id")  # owns the node that the block starts from
        # one look-up at most: of the parent where a conversation branches off, else of the last node of one that owns none
        at = F.when(old, F.lit(0)).when(F.col("s").isNotNull(), F.col("s") - 1).otherwise(F.size("path"))
        rows = scratch.keep(rows.withColumn("old", old).withColumn("at", at), f"rows-{k}")
        asked = rows.filter("at > 0").select("conv_id", "node", F.expr("slice(path, 1, at) as path"))
        found = _look_up(asked, nodes, total).select("conv_id", "owner")
        rows = scratch.keep(
            rows.join(found, "conv_id", "left").withColumn("owner", F.coalesce("owner", "node")).withColumn(
                "last", F.when(F.col("old") | F.col("s").isNotNull(), F.col("conv_id")).otherwise(F.col("owner"))
            ).withColumn("alone", F.coalesce(F.col("n_last") == 1, F.lit(False)) & (F.col("last") == F.col("conv_id"))), f"found-{k}",
        )
        branch = "s is not null and not old"
        facts.append(rows.selectExpr(
            "conv_id", f"case when {branch} then s + {start} when old and {k} = 0 then 0 end as s",
            f"case when {branch} then owner end as parent",
            f"case when {branch} then p[s - 1] when old and {k} = 0 then 0 when not old and not goes_on then p[size(path)] end as shared",
            "cast(case when goes_on then alone else coalesce(leaf, 0) = 1 end as int) as leaf",
        ))
        ends.append(rows.filter("not goes_on").select(F.col("last").alias("owner"), F.col("length").alias("depth"), "conv_id"))
        tails.append(rows.filter("goes_on and alone").select("conv_id", F.lit(start + width).alias("upto"), "length"))
        live = rows.filter("goes_on and not alone").select("conv_id", F.col("last").alias("node"), "length", F.expr(f"p[{width}]").alias("base"))
        blocks.append((block, start, width))
        scratch.drop(f"nodes-{k}", f"rows-{k}")
        scratch.tidy()
        start, k = start + width, k + 1

    def union(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for frame in frames[1:]:
            out = out.unionByName(frame)
        return out

    tails = union(tails)
    facts = scratch.keep(
        union(facts).groupBy("conv_id").agg(F.max("s").alias("s"), F.max("parent").alias("parent"), F.max("shared").alias("shared"), F.max("leaf").alias("leaf")),
        "facts",
    )
    sums = ", ".join([
        "min(conv_id) AS conv_id", "count(*) AS n_convs", "sum(shared) AS all_shared", "sum(leaf) AS n_leaves", "min_by(s, conv_id) AS s",
        "min_by(shared, conv_id) AS own_shared", "min_by(parent, conv_id) AS parent", "min_by(length, conv_id) AS own_length",
    ])
    found = []
    for k, (block, at, width) in enumerate(blocks):
        upto = ", ".join(f"max(p{j}) AS p{j}" for j in range(width))
        # the members of a node have its bytes in common
        before = "CASE d " + " ".join(f"WHEN {j} THEN p{j - 1}" for j in range(1, width + 1)) + " ELSE 0 END"
        rolled = _rollup(block.join(facts, "conv_id"), width, f"{sums}, {upto}").filter(F.col("d") >= (1 if k else 0))
        rolled = rolled.selectExpr(
            "conv_id", f"d + {at} AS depth", f"CASE WHEN d + {at} = 0 THEN {_NO} WHEN d + {at} > s THEN conv_id ELSE parent END AS parent_conv_id",
            "n_convs", "n_leaves", f"all_shared - own_shared - (n_convs - 1) * ({before}) AS saved_tokens", "own_length",
        )
        found.append(scratch.keep(rolled, f"trie-{k}"))
        scratch.drop(f"block-{k}")
        scratch.tidy()
    chunks = tails.withColumn("lo", F.explode(F.sequence(F.col("upto") + 1, F.col("length"), F.lit(TAIL_CHUNK))))
    alone = chunks.withColumn("depth", F.explode(F.sequence("lo", F.least(F.col("lo") + TAIL_CHUNK - 1, F.col("length")))))
    found.append(alone.selectExpr(
        "conv_id", "depth", "conv_id AS parent_conv_id", "1L AS n_convs", "1L AS n_leaves", "0L AS saved_tokens", "length AS own_length"
    ))
    ends = union(ends).unionByName(tails.select(F.col("conv_id").alias("owner"), F.col("length").alias("depth"), "conv_id"))
    # an owner's own next node is a child, and so is the first node of each that branches off here
    branches = facts.filter("parent is not null").groupBy(F.col("parent").alias("conv_id"), (F.col("s") - 1).alias("depth")).agg(F.count("*").alias("off"))
    nodes = union(found).join(branches, ["conv_id", "depth"], "left").join(_end_digests(ends), ["conv_id", "depth"], "left")
    result = scratch.keep(
        nodes.select(
            "conv_id", F.col("depth").cast("bigint").alias("depth"), "parent_conv_id", "n_convs",
            (F.coalesce("off", F.lit(0)) + F.when(F.col("own_length") > F.col("depth"), 1).otherwise(0)).cast("bigint").alias("n_children"),
            F.col("n_leaves").cast("bigint").alias("n_leaves"), F.col("saved_tokens").cast("bigint").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        ), "result",
    )
    scratch.drop("numbered", "convs", "turns", "facts", *(f"{name}-{i}" for name in ("trie", "found") for i in range(len(blocks))))
    return result
