"""Analytics over a generic call graph: symbols, calls, flows, snapshots and their drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.operators.matching import top_per

HIDDEN_LABELS = ["Community", "Process", "Folder"]


def repo_stats(symbols: DataFrame, calls: DataFrame, flows: DataFrame) -> DataFrame:
    """``symbols``: repo, label. ``calls`` and ``flows``: repo."""
    label = F.col("label")
    s = symbols.groupBy("repo").agg(
        F.count_if(~label.isin(HIDDEN_LABELS)).alias("symbols"),
        F.count_if(label == "Community").alias("communities"), F.count_if(label == "File").alias("files"),
    )
    c = calls.groupBy("repo").agg(F.count("*").alias("edges"))
    f = flows.groupBy("repo").agg(F.count("*").alias("flows"))
    zero = {"edges": 0, "flows": 0}
    return s.join(c, "repo", "left").join(f, "repo", "left").fillna(zero)


def communities(symbols: DataFrame, calls: DataFrame, top: int = 50) -> DataFrame:
    """Largest communities with cohesion = inner edges / all edges touching them.

    ``symbols``: symbol, community. ``calls``: caller, callee.
    """
    size = symbols.groupBy("community").agg(F.count("*").alias("symbol_count"))
    of = symbols.select("symbol", "community")
    placed = (
        calls.join(of.select(F.col("symbol").alias("caller"), F.col("community").alias("x")), "caller")
        .join(of.select(F.col("symbol").alias("callee"), F.col("community").alias("y")), "callee")
        .groupBy("x", "y").agg(F.count("*").alias("n"))
    )
    inner = F.col("x") == F.col("y")
    touch = placed.select(
        F.explode(F.array_distinct(F.array("x", "y"))).alias("community"), "n", inner.alias("inner")
    ).groupBy("community").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("inner"), F.col("n")).otherwise(0)).alias("in"))
    return (
        size.join(touch, "community", "left")
        .select("community", "symbol_count", F.coalesce(F.col("in") / F.col("all"), F.lit(0.0)).alias("cohesion"))
        .orderBy(F.col("symbol_count").desc(), "community").limit(top)
    )


def cross_calls(flows: DataFrame, top_groups: int | None = 30) -> DataFrame:
    """First and last community of each crossing flow, counted; strength = n / max.

    ``flows``: communities (array). Only the most frequent ``top_groups`` lists count.
    """
    lists = flows.filter(F.size("communities") >= 2).groupBy("communities").agg(F.count("*").alias("n"))
    if top_groups is not None:
        lists = lists.orderBy(F.col("n").desc(), "communities").limit(top_groups)
    pairs = lists.groupBy(
        F.element_at("communities", 1).alias("source"), F.element_at("communities", -1).alias("target")
    ).agg(F.sum("n").alias("call_count"))
    most = pairs.agg(F.max("call_count").alias("_max"), F.lit(1).alias("_one"))
    return pairs.withColumn("_one", F.lit(1)).join(F.broadcast(most), "_one").select(
        "source", "target", "call_count", (F.col("call_count") / F.greatest("_max", F.lit(1))).alias("strength")
    )


def parse_communities(text: Column) -> Column:
    """The quoted names of a list literal such as ['a','b']."""
    return F.regexp_extract_all(text, F.lit("'([^']+)'"), F.lit(1))


def risk_level(n: Column) -> Column:
    return F.when(n >= 50, "critical").when(n >= 20, "high").when(n >= 5, "medium").otherwise("low")


def critical_symbols(calls: DataFrame, top: int = 25, min_calls: int = 5) -> DataFrame:
    """Most called symbols. ``calls``: callee, type."""
    fan_in = calls.filter("type = 'CALLS'").groupBy(F.col("callee").alias("name")).agg(F.count("*").alias("incoming_calls"))
    best = fan_in.orderBy(F.col("incoming_calls").desc(), "name").limit(top)
    return best.filter(F.col("incoming_calls") >= min_calls).withColumn("risk_level", risk_level(F.col("incoming_calls")))


def top_flows(flows: DataFrame, top: int = 50) -> DataFrame:
    return flows.orderBy(F.col("step_count").desc(), "id").limit(top)


# --- snapshots -------------------------------------------------------------------------
def store_snapshot(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert on (repo_name, commit_hash); the id of a known commit stays."""
    key = ["repo_name", "commit_hash"]
    latest = new.groupBy(*key).agg(F.max_by(F.struct(*[c for c in new.columns if c not in key]), "ts").alias("n"))
    rest = [c for c in old.columns if c not in key]
    joined = old.join(latest, key, "full_outer")
    value = lambda c: F.coalesce(c, f"n.{c}") if c == "id" else F.coalesce(f"n.{c}", c)
    return joined.select(*key, *[value(c).alias(c) for c in rest]).select(*old.columns)


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    return top_per(snapshots, ["repo_name"], [F.col("ts").desc(), F.col("id")], 1)


def snapshot_history(snapshots: DataFrame, n: int = 20) -> DataFrame:
    return top_per(snapshots, ["repo_name"], [F.col("ts").desc(), F.col("id")], n)


def snapshot_to_memory(snapshots: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node rows, edge rows by name, episode rows) of each snapshot."""
    big = F.filter("communities", lambda c: c["symbol_count"] >= 10)
    keyed = F.transform(
        big, lambda c: F.struct((-c["symbol_count"]).alias("o"), c["label"].alias("l"), c.alias("c"))
    )
    s = snapshots.withColumn("_ranked", F.slice(F.sort_array(keyed), 1, 20))
    pairs = F.transform("_ranked", lambda r: F.struct(r["c"]["id"].alias("k"), r["c"]["label"].alias("v")))
    s = s.withColumn("_names", F.map_from_entries(F.array_distinct(pairs)))
    comm = s.select("repo_name", "stats", F.explode("_ranked.c").alias("c"))
    n, label = F.col("c.symbol_count"), F.col("c.label")
    scoped = F.concat(F.col("repo_name"), F.lit(":"), label)
    significance = F.when(n >= 100, "major_module").when(n >= 50, "significant_module").otherwise("minor_module")
    percent = F.format_string("%.0f", F.col("c.cohesion") * 100)
    node_cols = lambda df, **k: df.select(*[v.alias(c) for c, v in k.items()])
    repo_nodes = node_cols(
        s, type=F.lit("project"), name=F.col("repo_name"),
        context=F.concat(
            F.lit("Codebase with "), F.col("stats.total_symbols").cast("string"), F.lit(" symbols across "),
            F.col("stats.total_communities").cast("string"), F.lit(" communities and "),
            F.col("stats.total_flows").cast("string"), F.lit(" execution flows"),
        ),
        significance=F.lit("active_project"), confidence=F.lit(1.0),
    )
    comm_nodes = node_cols(
        comm, type=F.lit("concept"), name=scoped,
        context=F.concat(
            F.lit("Code community in "), F.col("repo_name"), F.lit(" with "), n.cast("string"), F.lit(" symbols and "),
            percent, F.lit("% internal cohesion"),
        ),
        significance=significance, confidence=F.lit(0.9),
    )
    part_of = comm.select(
        scoped.alias("source"), F.col("repo_name").alias("target"), F.lit("part_of").alias("relationship"),
        F.lit("structural").alias("category"), (n / F.col("stats.total_symbols")).alias("strength"), F.lit(0.95).alias("confidence"),
    )
    rel = s.select("repo_name", "_names", F.explode("relations").alias("r"))
    named = lambda c: F.concat(
        F.col("repo_name"), F.lit(":"), F.coalesce(F.try_element_at("_names", F.col(f"r.{c}")), F.col(f"r.{c}"))
    )
    depends = rel.select(
        named("source").alias("source"), named("target").alias("target"), F.lit("depends_on").alias("relationship"),
        F.lit("functional").alias("category"), F.col("r.strength").alias("strength"), F.lit(0.85).alias("confidence"),
    )
    crit = s.select(
        "repo_name",
        F.explode(F.slice(F.filter("critical", lambda c: c["risk_level"] != "low"), 1, 15)).alias("c"),
    )
    crit_nodes = node_cols(
        crit, type=F.lit("concept"), name=F.concat(F.col("repo_name"), F.lit(":"), F.col("c.name")),
        context=F.concat(F.col("c.risk_level"), F.lit(" risk symbol in "), F.col("repo_name"), F.lit(" — "), F.col("c.incoming_calls").cast("string"), F.lit(" callers")),
        significance=F.when(F.col("c.risk_level") == "critical", "critical_symbol").otherwise("important_symbol"), confidence=F.lit(0.9),
    )
    t = lambda c: F.col(f"stats.{c}").cast("string")
    episodes = s.select(
        F.concat(F.lit("snapshot:"), F.col("id")).alias("id"), F.lit("code-sync").alias("session_id"),
        F.concat(
            F.lit("Indexed "), F.col("repo_name"), F.lit(": "), t("total_symbols"), F.lit(" symbols, "), t("total_edges"),
            F.lit(" edges, "), t("total_communities"), F.lit(" communities, "), t("total_flows"),
            F.lit(" execution flows at commit "), F.col("commit_hash"),
        ).alias("summary"),
        F.lit(0.6).alias("importance_score"), F.array(F.lit("architecture"), F.col("repo_name")).alias("topics"),
        F.col("ts").alias("created_at"),
    )
    return repo_nodes.unionByName(comm_nodes).unionByName(crit_nodes), part_of.unionByName(depends), episodes


def diff_snapshots(snapshots: DataFrame) -> DataFrame:
    """Each snapshot against the one before it of the same repo."""
    w = Window.partitionBy("repo_name").orderBy("ts", "id")
    prev = lambda c: F.lag(c).over(w)
    both = snapshots.select(
        "repo_name", F.col("commit_hash").alias("to_commit"), "ts", F.col("stats.total_symbols").alias("now"),
        "communities", "relations", "flows",
        prev("commit_hash").alias("from_commit"), prev(F.col("stats.total_symbols")).alias("was"),
        prev("communities").alias("p_comm"), prev("relations").alias("p_rel"), prev("flows").alias("p_flows"),
    ).filter("from_commit IS NOT NULL AND from_commit <> to_commit")
    labels = lambda c: F.array_distinct(F.transform(c, lambda x: x["label"]))
    size_of = lambda c: F.map_from_entries(F.transform(c, lambda x: F.struct(x["label"], x["symbol_count"])))
    edge = lambda x: F.concat(x["source"], F.lit("→"), x["target"])
    calls_of = lambda c: F.map_from_entries(F.transform(c, lambda x: F.struct(edge(x), x["call_count"])))
    staged = both.withColumns(
        {
            "added": F.array_except(labels("communities"), labels("p_comm")),
            "removed": F.array_except(labels("p_comm"), labels("communities")),
            "_sizes": size_of("p_comm"), "_calls": calls_of("p_rel"),
            "symbols_delta": F.col("now") - F.col("was"),
            "new_flows": F.size(F.array_except(F.transform("flows", lambda f: f["summary"]), F.transform("p_flows", lambda f: f["summary"]))),
            "gone_flows": F.size(F.array_except(F.transform("p_flows", lambda f: f["summary"]), F.transform("flows", lambda f: f["summary"]))),
        }
    )
    changed = F.transform(
        "communities",
        lambda c: F.struct(
            c["label"].alias("label"), F.try_element_at("_sizes", c["label"]).alias("old"), c["symbol_count"].alias("new")
        ),
    )
    before = lambda r: F.try_element_at("_calls", edge(r))
    staged = staged.withColumns(
        {
            "grown": F.filter(changed, lambda c: c["new"] > c["old"]),
            "shrunk": F.filter(changed, lambda c: c["new"] < c["old"]),
            "coupling_up": F.size(F.filter("relations", lambda r: r["call_count"] > before(r))),
            "coupling_down": F.size(F.filter("relations", lambda r: r["call_count"] < before(r))),
            "new_dependencies": F.size(F.filter("relations", lambda r: before(r).isNull())),
        }
    )
    drift = (
        F.when((F.size("added") > 2) | (F.size("removed") > 2), "restructuring")
        .when(F.col("symbols_delta") > F.col("was") * 0.1, "growing")
        .when(F.col("symbols_delta") < F.col("was") * -0.05, "shrinking")
        .otherwise("stable")
    )
    text = lambda c: F.col(c).cast("string")
    jumps = F.transform(
        F.filter("grown", lambda g: g["new"] > g["old"] * 1.3),
        lambda g: F.concat(
            g["label"], F.lit(" grew "), F.format_string("%.0f", (g["new"] / g["old"] - 1) * 100),
            F.lit("% — may need decomposition"),
        ),
    )
    flags = F.concat(
        F.array_compact(F.array(F.when(F.col("coupling_up") > 3, F.concat(F.lit("Cross-community coupling increasing in "), text("coupling_up"), F.lit(" relationships — watch for spaghetti"))))),
        jumps,
        F.array_compact(
            F.array(
                F.when(F.col("new_dependencies") > 2, F.concat(text("new_dependencies"), F.lit(" new cross-community dependencies introduced"))),
                F.when(F.col("gone_flows") > 5, F.concat(text("gone_flows"), F.lit(" execution flows disappeared — potential broken paths"))),
            )
        ),
    )
    return staged.withColumns({"drift": drift, "risk_flags": flags}).drop(
        "communities", "relations", "flows", "p_comm", "p_rel", "p_flows", "_sizes", "_calls"
    )


def diff_episodes(diffs: DataFrame) -> DataFrame:
    """One sentence per diff, as an episode row."""
    delta = F.col("symbols_delta")
    sign = F.when(delta >= 0, "+").otherwise("")
    some = lambda c: F.size(c) > 0
    grown = F.array_join(
        F.transform("grown", lambda g: F.concat(g["label"], F.lit(" ("), g["old"].cast("string"), F.lit("→"), g["new"].cast("string"), F.lit(")"))), ", "
    )
    sentence = F.concat_ws(
        ". ",
        F.concat(F.col("repo_name"), F.lit(" architecture evolved ("), F.col("from_commit"), F.lit(" → "), F.col("to_commit"), F.lit("):")),
        F.when(delta != 0, F.concat(sign, delta.cast("string"), F.lit(" symbols"))),
        F.when(some("added"), F.concat(F.lit("new communities: "), F.array_join("added", ", "))),
        F.when(some("removed"), F.concat(F.lit("removed communities: "), F.array_join("removed", ", "))),
        F.when(some("grown"), F.concat(F.lit("growing: "), grown)),
        F.when(F.col("new_flows") > 0, F.concat(F.col("new_flows").cast("string"), F.lit(" new execution flows"))),
        F.when(some("risk_flags"), F.concat(F.lit("⚠️ "), F.array_join("risk_flags", "; "))),
        F.concat(F.lit("Overall drift: "), F.col("drift")),
    )
    flagged = some("risk_flags")
    return diffs.select(
        "repo_name", "to_commit", sentence.alias("summary"),
        F.when(flagged, -0.1).otherwise(0.3).alias("valence"), F.when(flagged, 0.8).otherwise(0.5).alias("importance_score"),
        F.col("ts").alias("created_at"),
    )
