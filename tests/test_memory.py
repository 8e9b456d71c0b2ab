"""Episodes, tables, maintenance, ingestion and retrieval on small rows."""

import random

import pytest
from pyspark.sql import functions as F

from engram.functions.scores import effective_confidence, recency
from engram.operators import consolidation as co
from engram.operators import enrichment as en
from engram.operators import ingestion as ing
from engram.operators import maintenance as mt
from engram.operators import retrieval as r
from engram.operators import tables as t

AS_OF = "2024-03-01 00:00:00"


def test_emotional_arcs(spark):
    rows = [
        ("the build broke and everything failed but then we fixed it and shipped the milestone", 0.2, 0.5, "ascending"),
        ("all fine working and shipped then the server crash lost data", 0.0, 0.35, "descending"),
        ("nothing to report", 0.0, 0.2, "stable"),
    ]
    df = spark.createDataFrame([(x[0],) for x in rows], "text string")
    for got, want in zip(en.emotional_arc(df, "text").collect(), rows):
        e = got["emotion"]
        assert (round(e["valence"], 6), round(e["arousal"], 6), e["arc"]["trajectory"]) == want[1:]


def test_phrases_are_deduplicated_ignoring_case(spark):
    text = "We decided to keep the Blue Whale. Later: decided to keep THE blue whale. decision: buy forty more anvils."
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(en.decisions(F.col("text")).alias("d")).first()["d"] == ["to keep the Blue Whale", "buy forty more anvils"]


def test_participants_need_word_edges(spark):
    nodes = spark.createDataFrame(
        [("1", "person", "Ann", ["annie"], 0.5), ("2", "tool", "Bolt", [], 0.5)],
        "id string, type string, name string, aliases array<string>, confidence double",
    )
    ep = spark.createDataFrame([("a", "Annual plan", "bolt"), ("b", "with ann.", "é ann")], "id string, summary string, narrative string")
    assert [(x["id"], x["person"]) for x in en.participants(ep, nodes).collect()] == [("b", "ann")]


def brute_links(rows, linked, limit):
    out = []
    for a, pa, ta in rows:
        for b, pb, tb in rows:
            if a < b and set(pa) & set(pb) and set(ta) & set(tb) and (a, b) not in linked:
                out.append((a, b))
    return sorted(out)[:limit]


def test_enrich_counters_do_not_read_the_texts_again(spark):
    from engram.plans.cycles import enrich_stage

    said = F.concat(F.lit("we decided to ship the second half together with person "), F.col("id").cast("string"))
    episodes = spark.range(3).select(F.col("id").cast("string").alias("id"), said.alias("summary"), said.alias("narrative"), F.array(F.lit("x")).alias("participants"))
    nodes = spark.createDataFrame([("p1", "person", "Person 1", [], 0.5)], "id string, type string, name string, aliases array<string>, confidence double")
    kept = []

    def keep(df, what):
        kept.append(what)
        return df.checkpoint()

    after, counters = enrich_stage({"episodes": episodes, "nodes": nodes}, keep)
    row = counters["enrich"].first()
    assert kept == ["enriched"] and (row["episodes_processed"], row["participants_added"]) == (3, 1)
    assert "Range (" not in counters["enrich"]._jdf.queryExecution().optimizedPlan().toString()
    assert {x["id"]: x["participants"] for x in after["episodes"].collect()} == {"0": ["x"], "1": ["person 1"], "2": ["x"]}


def test_link_related_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [
        (f"e{i:03d}", ["hot"] if i % 3 == 0 else rng.sample("pqrs", 2), rng.sample(["t", "u", "v"], rng.randint(0, 2)))
        for i in range(70)
    ]
    linked = {(f"e{i:03d}", f"e{i + 3:03d}") for i in range(0, 60, 3)}
    df = spark.createDataFrame(rows, "id string, participants array<string>, topics array<string>")
    links = spark.createDataFrame([x for x in linked], "episode_id string, related_id string")
    for limit in (5, 50, 5000):
        got = [(x["a_id"], x["b_id"]) for x in en.link_related(df, links, limit).collect()]
        assert sorted(got) == brute_links(rows, linked, limit)


def test_formulas(spark):
    df = spark.createDataFrame([(0,), (35,), (120,)], "d int").withColumn(
        "ts", F.timestamp_micros(F.unix_micros(F.lit(AS_OF).cast("timestamp")) - F.col("d").cast("long") * 86_400_000_000)
    )
    rows = df.select(
        F.round(effective_confidence(F.lit(0.9), F.col("ts"), AS_OF), 6).alias("c"), F.round(recency(F.col("ts"), AS_OF), 6).alias("r")
    ).collect()
    assert [x["c"] for x in rows] == [0.9, 0.446927, 0.1]
    assert [x["r"] for x in rows] == [1.0, 0.445526, 0.062537]


def test_record_executions_equals_fold(spark):
    rng = random.Random(11)
    for start in (0.2, 0.97):
        events = [(f"2024-01-{1 + i // 20:02d} 00:00:{i % 20:02d}", i, rng.random() < 0.8) for i in range(300)]
        want = start
        for _, _, ok in events:
            want = min(1.0, want + (0.02 if ok else -0.05))
        procs = spark.createDataFrame(
            [("p", 0, 0, 0.0, start, None)],
            "name string, execution_count long, success_count long, success_rate double, confidence double, last_executed timestamp",
        )
        ev = spark.createDataFrame(events, "ts string, seq int, success boolean").select(
            F.lit("p").alias("name"), F.col("ts").cast("timestamp").alias("ts"), "seq", "success", F.lit("x").alias("outcome")
        )
        got = t.record_executions(procs, ev.repartition(5)).first()
        assert got["confidence"] == pytest.approx(want) and got["execution_count"] == 300


def brute_cap(pairs, per_node, total):
    used, out = {}, []
    for a, b, n in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if len(out) >= total:
            break
        if used.get(a, 0) >= per_node or used.get(b, 0) >= per_node:
            continue
        used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
        out.append((a, b))
    return sorted(out)


def test_greedy_cap_equals_sequential_rule(spark):
    rng = random.Random(2)
    nodes = [f"n{i:02d}" for i in range(14)]
    pairs = [(a, b, rng.randint(3, 9)) for a in nodes for b in nodes if a < b and (a == "n00" or rng.random() < 0.6)]
    df = spark.createDataFrame(pairs, "a string, b string, n long")
    for per_node, total in ((3, 1000), (2, 9)):
        got = sorted((x["a"], x["b"]) for x in mt.greedy_cap(df, per_node, total).collect())
        assert got == brute_cap(pairs, per_node, total)


def test_reweight_rule(spark):
    nodes = spark.createDataFrame(
        [("d", "was paused", 0, "2023-01-01"), ("u", "active now", 5, "2024-02-28"), ("x", None, 20, "2023-01-01"), ("i", "inactive", 0, "2023-01-01")],
        "id string, context string, source_count long, m string",
    ).withColumn("last_modified", F.col("m").cast("timestamp"))
    edges = spark.createDataFrame([("1", "d", "i"), ("2", "u", "u"), ("3", "d", "u"), ("4", "x", "i")], "id string, source_id string, target_id string").withColumn("strength", F.lit(0.0))
    got = {e["id"]: round(e["strength"], 6) for e in mt.reweight_edges(edges, nodes, AS_OF).collect()}
    assert got == {"1": 0.3, "2": 0.9, "3": 0.35, "4": 0.35}


def test_trust_fold_treats_zero_as_half(spark):
    trust = "struct<ability:double,benevolence:double,integrity:double,composite:double>"
    persons = spark.createDataFrame(
        [("Ann", (0.01, 0.8, 0.8, 0.0), {"a": "1"}, ["Late"], [], 1, None)],
        f"name string, trust_from_them {trust}, preferences map<string,string>, frustrations array<string>, motivations array<string>, total_interactions int, last_interaction timestamp",
    )
    updates = spark.createDataFrame(
        [("ANN", 1, (-0.05, None, None), {"a": "2"}, ["LATE", "New"], []), ("ann", 2, (0.1, None, None), {"b": "3"}, [], ["x"])],
        "name string, batch_order int, trust_delta struct<ability:double,benevolence:double,integrity:double>, new_preferences map<string,string>, new_frustrations array<string>, new_motivations array<string>",
    )
    got = co.apply_person_updates(persons, updates, AS_OF).first()
    assert got["trust_from_them"]["ability"] == pytest.approx(0.6)
    assert got["preferences"] == {"a": "2", "b": "3"} and got["frustrations"] == ["Late", "New"] and got["total_interactions"] == 3


def test_broken_model_answers_yield_nothing(spark):
    raw = spark.createDataFrame([("a", "no json"), ("b", '{"insights": [{"type": "lesson", "content": "x"}]}'), ("c", "```json\n{broken\n```")], "id string, raw string")
    assert [x["id"] for x in co.parse_insights(raw, ["id"]).collect()] == ["b"]


def test_rollup_needs_more_than_the_bound(spark):
    rows = [(f"e{i}", f"s{i}", 0.1, 0, False) for i in range(6)]
    df = spark.createDataFrame(rows, "id string, summary string, importance_score double, access_count int, decay_protected boolean")
    df = df.withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    assert co.rollup_stale(df.limit(5), AS_OF)[0].count() == 0
    summary, marks = co.rollup_stale(df, AS_OF)
    assert summary.first()["narrative"] == "s0; s1; s2; s3; s4; s5" and marks.count() == 6


def test_entity_merge_does_not_glue_long_names(spark):
    rows = [("John", "person", [], "c", 0.1), ("John Smith", "person", [], "longer", 0.4), ("John Smithson", "person", ["JS"], "x", 0.2), ("js", "person", [], "z", 0.9)]
    df = spark.createDataFrame(rows, "name string, type string, aliases array<string>, context string, emotional_weight double")
    got = {x["name"]: sorted(x["aliases"]) for x in ing.merge_entities(df).collect()}
    assert got == {"John Smithson": ["JS", "John", "John Smith", "js"]}


def test_query_weights_are_the_profile_when_sure(spark):
    q = spark.createDataFrame([(1, "what rate and how much is the salary")], "query_id long, text string")
    got = r.query_weights(r.classify_queries(q)).first()
    assert got["query_type"] == "factual" and got["w_text_match"] == pytest.approx(0.45)


def test_upsert_keeps_known_context(spark):
    cols = "id string, type string, name string, aliases array<string>, attributes map<string,string>, context string, significance string, confidence double, confidence_basis string, emotional_weight double, last_modified timestamp, last_verified timestamp"
    old = spark.createDataFrame([("1", "tool", "Bolt", ["b"], {"a": "1", "k": "1"}, "old", None, 0.9, "stated", 0.4, None, None)], cols)
    new = spark.createDataFrame(
        [("tool", "Bolt", [], {"k": "2"}, None, None, None, None, None, 1), ("tool", "Nut", [], {}, "c", None, 0.7, "stated", None, 2)],
        "type string, name string, aliases array<string>, attributes map<string,string>, context string, significance string, confidence double, confidence_basis string, emotional_weight double, batch_order int",
    )
    got = {x["name"]: x for x in t.upsert_nodes(old, new, AS_OF).collect()}
    bolt = got["Bolt"]
    assert (bolt["aliases"], bolt["attributes"], bolt["context"]) == (["b"], {"a": "1", "k": "2"}, "old")
    assert (bolt["confidence"], bolt["confidence_basis"]) == (0.5, "assumed") and got["Nut"]["id"].startswith("node:")


def test_counted_paths_are_those_of_traverse(spark):
    from engram.operators import graph

    names = ["A", "A", "A", "B", "B", "C", "D", "D", "E", "F"]
    nodes = spark.createDataFrame([(str(i), "org" if n == "A" else "x", n) for i, n in enumerate(names)], "id string, type string, name string")
    links = [(str(a), str(b), "knows" if (a + b) % 3 else "Owns", ((a * 7 + b * 5) % 4) / 4) for a in range(10) for b in range(a, 10) if (a * b) % 4 != 3]
    edges = spark.createDataFrame(links, "source_id string, target_id string, relationship string, strength double")
    starts = spark.createDataFrame([("A", "org"), ("C", "x")], "name string, type string")
    for hops in (1, 2, 3):
        for fan_out in (2, 5):
            want: dict = {}
            for r in graph.traverse(nodes, edges, starts, hops, fan_out).collect():
                key = (r["start_name"], tuple(r["path"]), r["relationship"], r["depth"])
                want[key] = want.get(key, 0) + 1
            rows = graph.traverse(nodes, edges, starts, hops, fan_out, counted=True).collect()
            assert len(rows) == len(want)
            assert {(r["start_name"], tuple(r["path"]), r["relationship"], r["depth"]): r["n"] for r in rows} == want


def test_the_first_hop_is_counted_once_from_the_edges_of_its_nodes(spark, tmp_path):
    """Many nodes of one name: their rows are counted, written once and not made again from the edges for the second hop."""
    from engram.operators import graph
    from engram.operators.matching import may_be_among

    nodes = spark.createDataFrame([(f"a{i}", "org", "A") for i in range(50)] + [(f"b{i}", "x", "B") for i in range(50)] + [("c", "x", "C")], "id string, type string, name string")
    links = [(f"a{i}", f"b{i}", "knows", 0.5) for i in range(50)] + [("b0", "c", "has", None), ("a1", "c", "has", 0.1), (None, "c", "has", 0.2)]
    spark.createDataFrame(links, "source_id string, target_id string, relationship string, strength double").write.parquet(str(tmp_path / "edges-in"))
    edges = spark.read.parquet(str(tmp_path / "edges-in"))
    starts = spark.createDataFrame([("A", "org")], "name string, type string")
    paths = graph.count_paths(nodes, edges, starts, 2, fan_out=3)
    assert len(paths.inputFiles()) and any("first-hop" in f for f in paths.inputFiles())
    assert paths._jdf.queryExecution().analyzed().toString().count("Relation [source_id") == 2  # the edges of the second hop, both ways
    got = {("/".join(r["path"]), r["relationship"], r["depth"]): r["n"] for r in paths.collect()}
    # the first three of fifty rows go on, from every node of the name
    assert got == {("A/B", "KNOWS", 1): 50, ("A/C", "HAS", 1): 1, ("A/B/C", "KNOWS → HAS", 2): 3}
    ids = nodes.select(F.col("id").alias("src")).filter("src like 'b%'")
    assert {r["src"] for r in may_be_among(graph.undirected(edges), "src", ids, 50).collect()} >= {f"b{i}" for i in range(50)}
