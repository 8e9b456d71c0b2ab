"""Containment join and vector search against brute force."""

import numpy as np
from pyspark.sql import functions as F

from engram.operators import vectors as v
from engram.operators.matching import contained_terms, resolve_names


def _texts(spark):
    texts = ["the quick brown fox", "brown bear", "éclair for brunch 🔥 at ten", "", "a", "foxfoxfox the"]
    terms = ["brown", "fox", "the quick", "éclair", "🔥 a", "a", "at", "missing", "brown bear and more", ""]
    t = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    w = spark.createDataFrame([(x,) for x in terms], "term string")
    want = sorted((i, x) for i, s in enumerate(texts) for x in terms if x and x in s)
    return t, w, want


def test_containment_join_both_ways(spark):
    t, w, want = _texts(spark)
    for limit in (100_000, 0):
        got = contained_terms(t, "text", w, "term", ["id"], broadcast_terms=limit)
        assert sorted((r["id"], r["term"]) for r in got.collect()) == want


def test_containment_join_beyond_the_broadcast(spark):
    """Many rows of few terms, and more distinct terms than may be broadcast; texts whose key repeats or is null."""
    t, w, _ = _texts(spark)
    t = t.unionByName(spark.createDataFrame([(None, "brown fox"), (7, "at"), (7, "a fox")], "id int, text string"))
    w = w.unionByName(w).withColumn("who", F.monotonically_increasing_id())
    rows = [(r["id"], r["text"]) for r in t.collect()]
    want = sorted((str(i), x["term"], x["who"]) for i, s in rows for x in w.collect() if x["term"] and x["term"] in s)
    few = contained_terms(t, "text", w, "term", ["id"], broadcast_terms=12)
    assert sorted((str(r["id"]), r["term"], r["who"]) for r in few.collect()) == want
    many = contained_terms(t, "text", w, "term", ["id"], broadcast_terms=3)
    assert sorted((str(r["id"]), r["term"], r["who"]) for r in many.collect()) == want
    none = contained_terms(t, "text", w, "term", [], broadcast_terms=3)
    assert sorted((str(r["id"]), r["term"], r["who"]) for r in none.collect()) == want
    for limit in (100_000, 12, 3):
        got = contained_terms(t, "text", w, "term", ["id"], broadcast_terms=limit, windowed=True)
        assert sorted((str(r["id"]), r["term"], r["who"]) for r in got.collect()) == want


def test_windows_find_what_lies_across_their_ends(spark):
    text = "".join(f"<{i}>" for i in range(9000)) + "🔥 end"
    t = spark.createDataFrame([(1, text), (2, "short <7>")], "id int, text string")
    terms = [f"<{i}>" for i in range(0, 9000, 7)] + ["<1><2", "🔥 end", "<9001>"]
    w = spark.createDataFrame([(x,) for x in terms], "term string")
    got = contained_terms(t, "text", w, "term", ["id"], windowed=True)
    want = sorted([(1, x) for x in terms if x in text] + [(2, "<7>")])
    assert sorted((r["id"], r["term"]) for r in got.collect()) == want


def test_resolve_names_prefers_names_then_smallest_id(spark):
    nodes = spark.createDataFrame(
        [("2", "tool", "Ring", ["gear"], 0.5), ("1", "tool", "Gear", [], 0.5), ("3", "tool", "Bolt", ["ring"], 0.5)],
        "id string, type string, name string, aliases array<string>, confidence double",
    )
    names = spark.createDataFrame([("GEAR",), ("ring",), ("none",)], "n string")
    got = {r["n"]: r["node_id"] for r in resolve_names(names, nodes, "n").collect()}
    assert got == {"GEAR": "1", "ring": "2", "none": None}


def _vectors(spark, n=60, d=8):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(n, d))
    m[5] = m[2]
    m[9] = 0.0
    rows = [(i, [float(x) for x in m[i]]) for i in range(n)]
    rows[7] = (7, None)
    return spark.createDataFrame(rows, "id long, embedding array<double>"), m


def test_knn_blocks_equal_matrix(spark):
    items, m = _vectors(spark)
    queries = items.select(F.col("id").alias("query_id"), "embedding")
    small = v.knn(queries, items, 4, 0.1)
    blocks = v.knn(queries, items, 4, 0.1, query_block=10)
    key = lambda df: sorted((r["query_id"], r["item_id"], round(r["similarity"], 6), r["rank"]) for r in df.collect())
    got = key(small)
    assert got == key(blocks)
    norm = np.linalg.norm(m, axis=1)
    for q in (0, 2, 11):
        sims = [(-round(float(m[q] @ m[i] / (norm[q] * norm[i])), 9), i) for i in range(60) if i not in (7, 9)]
        want = [i for s, i in sorted(sims)[:4] if -s >= 0.1]
        assert [g[1] for g in sorted(got, key=lambda g: g[3]) if g[0] == q] == want


def test_similar_pairs_equal_brute_force(spark):
    items, m = _vectors(spark)
    for threshold in (0.3, 0.7, 0.95):
        got = sorted((r["a"], r["b"]) for r in v.similar_pairs(items, threshold, block=7).collect())
        norm = np.linalg.norm(m, axis=1)
        ids = [i for i in range(60) if i not in (5, 7, 9)]
        want = [(a, b) for a in ids for b in ids if a < b and m[a] @ m[b] / (norm[a] * norm[b]) > threshold]
        assert got == sorted(want + [(2, 5)])


def test_heads_of_long_runs_follow_pointers(spark):
    import random

    from engram.operators.ordering import greedy_heads

    rng = random.Random(6)
    rows, want = [], []
    for key in ("a", "b"):
        t, last = 0, None
        for _ in range(3000):
            t += rng.randrange(1, 9)
            rows.append((key, t))
            if last is None or t - last >= 20:
                last = t
                want.append((key, t))
    df = spark.createDataFrame(rows, "k string, t long")
    for limit in (0, 20_000):
        got = greedy_heads(df, ["k"], "t", 20, 64 * 20, fold_limit=limit).select("k", "t").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_posting_lists_pass_on_k_rows_per_word(spark):
    """Words that every text has: what goes on is words x k, whatever the number of texts and queries."""
    from engram.operators import postings

    rng = np.random.default_rng(1)
    every = ["alpha", "beta", "gammas", "x1"]
    rows = [(i, float(rng.integers(0, 9)), " ".join(["alpha", "beta-alpha", "gammas"] + [f"w{rng.integers(0, 50)}" for _ in range(6)])) for i in range(400)]
    texts = spark.createDataFrame(rows, "id long, weight double, text string")
    words = [(q, w) for q in range(30) for w in [*every[:3], f"w{q}"]] + [(99, "nowhere")]
    asked = spark.createDataFrame(words, "query_id long, word string")
    order = [F.col("weight").desc(), F.col("id")]
    lists = postings.posting_lists(texts, F.col("text"), asked, ["id", "weight"], order, 5)
    assert lists.filter(F.col("word").isin(every)).count() == 3 * 5
    got = {(r["query_id"], r["id"], r["place"]) for r in postings.rows_of_queries(texts, F.col("text"), asked, ["id", "weight"], order, 5).collect()}
    want = set()
    for q in {q for q, _ in words}:
        own = [w for p, w in words if p == q]
        hits = sorted((-weight, i) for i, weight, text in rows if any(w in text for w in own))
        want |= {(q, i, k + 1) for k, (_, i) in enumerate(hits[:5])}
    assert got == want
    whole = {(r["query_id"], r["id"]) for r in postings.rows_of_queries(texts, F.col("text"), asked, ["id"]).collect()}
    assert whole == {(q, i) for q, w in words for i, _, text in rows if w in text}


def test_sections_that_contend_are_enough(spark):
    """The bound from posting lists leaves the same best sections as scoring every section."""
    import itertools
    from datetime import datetime

    from engram.operators import retrieval as r

    rng = np.random.default_rng(2)
    vocabulary = ["ship", "shipment", "late", "customer", "balance", "the", "delivery", "order"]
    say = lambda n: " ".join(rng.choice(vocabulary, n)) + " filler" * int(rng.integers(0, 60)) + " " + " ".join(rng.choice(vocabulary, 2))
    rows = [(f"memory/{i % 7}.md", int(i), say(1), say(int(rng.integers(1, 9))), datetime(2024, 2, 1 + i % 28)) for i in range(120)]
    sections = spark.createDataFrame(rows, "path string, line_start int, heading string, content string, modified timestamp")
    asked = ["late delivery", "the the customer", "ship", "order balance late", "a", "nothing here"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    as_of = F.lit("2024-03-01").cast("timestamp")
    got = {(x["query_id"], x["id"], round(x["s_total"], 9)) for x in r.search_sections(queries, sections, as_of, 4, min_score=0.0).collect()}
    scored = r.section_scores(sections, as_of).crossJoin(
        queries.select("query_id", F.lower("text").alias("query_low"), r.query_words(F.lower("text")).alias("words"))
    )
    head = F.least(F.lit(1.0), F.size(F.filter("words", lambda w: F.lower("heading").contains(w))) * 0.3)
    total = F.round(r.section_text_score() * 0.5 + head * 0.2 + F.col("_base"), 9)
    every = sorted((x["query_id"], -x["t"], x["id"]) for x in scored.select("query_id", "id", total.alias("t")).collect())
    want = {(q, i, -t) for _, group in itertools.groupby(every, key=lambda x: x[0]) for q, t, i in list(group)[:4]}
    assert got == want


def test_searches_are_planned_step_by_step(spark):
    """What a search hands on no longer holds the plans of its sources, which the driver would describe anew at every stage."""
    from engram.operators import retrieval as r

    as_of = F.lit("2024-03-01").cast("timestamp")
    sections = spark.range(9).select(
        F.concat(F.lit("memory/"), F.col("id").cast("string")).alias("path"), F.col("id").cast("int").alias("line_start"), F.lit("late order").alias("heading"),
        F.concat(F.lit("delivery of ship "), F.col("id").cast("string")).alias("content"), F.lit("2024-02-01").cast("timestamp").alias("modified"),
    )
    queries = spark.range(3).select(F.col("id").alias("query_id"), F.concat(F.lit("late ship "), F.col("id").cast("string")).alias("text"))
    sources = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Range (")
    found = r.search_sections(queries, sections, as_of, 4)
    assert found.count() == 12 and sources(found) == 0
    nodes = spark.range(4).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"), F.concat(F.lit("name "), F.col("id").cast("string")).alias("name"))
    edges = spark.range(3).select(
        F.concat(F.lit("n"), F.col("id").cast("string")).alias("source_id"), F.concat(F.lit("n"), (F.col("id") + 1).cast("string")).alias("target_id"),
        F.lit("knows").alias("relationship"), F.lit(0.5).alias("strength"),
    )
    hits = nodes.select(
        F.lit(1).alias("query_id"), "id", "name", F.when(F.col("id") == "n0", "semantic").otherwise("markdown").alias("memory_type"), F.lit(False).alias("routed"),
        F.struct(F.lit(0).alias("g"), F.lit(0.0).alias("r")).alias("found"), F.lit(0.0).alias("graph_proximity"),
    )
    near = r.graph_proximity(hits, nodes, edges)
    assert {x["id"]: x["graph_proximity"] for x in near.collect()} == {"n0": 0.0, "n1": 1.0, "n2": 0.5, "n3": 0.0}
    assert sources(near) == 2  # the hits, and the hits that are linked


def test_blocks_of_clusters_are_skipped(spark):
    """Clustered vectors: most pairs of blocks are never compared. Random ones: none may be lost."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 24))
    clustered = np.concatenate([c + 0.05 * rng.normal(size=(40, 24)) for c in centres])
    for m, most in ((clustered, 0.3), (rng.normal(size=(480, 24)), 1.0)):
        items = spark.createDataFrame([(i, [float(x) for x in m[i]]) for i in range(len(m))], "id long, embedding array<double>")
        unit = m / np.linalg.norm(m, axis=1, keepdims=True)
        sims = np.round(unit @ unit.T, 9)
        for threshold in (0.92, 0.5):
            want = sorted((int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(sims > threshold, 1)), strict=True))
            got = sorted((r["a"], r["b"]) for r in v.similar_pairs(items, threshold, block=20).collect())
            assert got == want
        first = items.select(F.col("id").alias("a"), "embedding")
        placed, pairs = v._placed_pairs(first, 0.92, "bigint", 20, 8, 2000)
        blocks = placed.select("block").distinct().count()
        assert pairs.count() <= most * blocks * (blocks + 1) / 2


def test_first_above_takes_the_first_id(spark):
    items, m = _vectors(spark)
    others = items.select(F.lpad(F.col("id").cast("string"), 3, "0").alias("id"), "embedding")
    unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    sims = np.round(unit @ unit.T, 9)
    rows = [i for i in range(len(m)) if i != 7]
    want = {}
    for i in rows:
        close = [j for j in rows if sims[i, j] > 0.5]
        if close:
            want[i] = f"{close[0]:03d}"
    got = {r["item_id"]: r["first_id"] for r in v.first_above(items, others, 0.5, block=9).collect()}
    assert got == want


def _broadcasts(frame):
    """The lines below every broadcast of the plan."""
    lines = frame._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda s: len(s) - len(s.lstrip(" :+-"))
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = []
            for other in lines[i + 1:]:
                if depth(other) <= depth(line):
                    break
                below.append(other)
            yield below


def test_spans_and_tokens_are_not_broadcast(spark):
    """A few rows that make many: Spark sizes them by the few, so nothing that is exploded may be sent to every task."""
    from engram.operators import postings
    from engram.operators.matching import words_within

    words = spark.createDataFrame([("w" * 40 + str(i),) for i in range(5)], "w string")
    parts = spark.createDataFrame([(f"part{i:04d}",) for i in range(400)] + [("www",), ("w3",), ("",), (None,)], "p string")
    met = words_within(words, "w", parts, "p")
    assert list(_broadcasts(met)) and not [x for below in _broadcasts(met) for x in below if "Generate" in x]
    assert sorted((r["w"][-1], r["p"]) for r in met.collect()) == sorted([(str(i), "www") for i in range(5)] + [("3", "w3")])
    rows = spark.createDataFrame([(i, f"{'w' * 40} part000{i} tail") for i in range(5)], "id int, text string")
    asked = parts.select(F.lit(1).alias("query_id"), F.col("p").alias("word"))
    lists = postings.posting_lists(rows, F.col("text"), asked, ["id"])
    assert not [x for below in _broadcasts(lists) for x in below if "Generate" in x]
    assert {(r["id"], r["word"]) for r in lists.collect()} == {(i, w) for i in range(5) for w in ("www", f"part000{i}")}


def test_many_terms_are_met_by_longer_grams(spark):
    """Beyond the broadcast a long term has a long gram, which few texts have; terms of every length are found."""
    from engram.operators.matching import may_be_among

    terms = [f"customer#{i:09d}" for i in range(300)] + ["a", "b1", "abcde", "123456789", "🔥 at ten..", "customer#00000012", "fifteen letters", "sixteen letters!"]
    texts = [f"note of customer#{i:09d} and b1" for i in range(0, 600, 7)] + ["🔥 at ten...", "fifteen letterssixteen letters!", "123456789", "customer#00000012", "", None]
    t = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    w = spark.createDataFrame([(x,) for x in terms], "term string")
    found = contained_terms(t, "text", w, "term", ["id"], broadcast_terms=3)
    plan = found._jdf.queryExecution().analyzed().toString()
    assert ".{16}" in plan and ".{10}" in plan
    want = sorted((i, x) for i, s in enumerate(texts) if s for x in terms if x in s)
    assert sorted((r["id"], r["term"]) for r in found.collect()) == want
    among = spark.range(2000).selectExpr("concat('k', id) as v")
    others = spark.range(100_000).selectExpr("concat('k', id + 1000) as v")
    assert 1000 <= may_be_among(others, "v", among, 2000).count() < 1000 + 3000


def test_a_vector_travels_to_pairs_of_groups(spark):
    """However many blocks there are: with all of them paired a block is copied about once per group, and the pairs stay exact."""
    blocks = spark.range(128).selectExpr("struct(cast(id as int) as near) as block")
    pairs = blocks.selectExpr("block as x").crossJoin(blocks.selectExpr("block as y")).filter("x <= y")
    met = v.grouped_pairs(pairs, 1000)
    assert met.count() == 128 * 129 // 2 and met.filter("gx > gy").count() == 0
    assert met.select("gx", "gy", "x").distinct().count() <= 128 * 33
    assert v.grouped_pairs(pairs, 0).select("gx", "gy").distinct().count() == 128 * 129 // 2  # blocks too large to meet others
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(150, 6)).astype("float32")
    items = spark.createDataFrame([(i, [float(x) for x in vec]) for i, vec in enumerate(vectors)], "id long, embedding array<float>")
    unit = v._unit(vectors)
    sims = np.round(unit @ unit.T, 9)
    want = sorted((i, j, sims[i, j]) for i in range(150) for j in range(i + 1, 150) if sims[i, j] > 0.2)
    got = sorted(map(tuple, v.similar_pairs(items, 0.2, block=2).collect()))
    assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want])


def test_a_handful_of_terms_is_looked_for_one_by_one(spark):
    """No grams are made of the texts then; texts and terms that repeat, and null texts, are as with grams."""
    t = spark.createDataFrame([(1, "brown fox"), (1, "brown fox"), (2, None), (3, "foxes 🔥 at"), (None, "at")], "id int, text string")
    w = spark.createDataFrame([("fox", 1), ("fox", 2), ("🔥 a", 3), ("", 4), (None, 5), ("at", 6)], "term string, who int")
    found = contained_terms(t, "text", w, "term", ["id"])
    assert "regexp_extract_all" not in found._jdf.queryExecution().analyzed().toString() and found.columns == ["id", "text", "term", "who"]
    got = sorted((str(r["id"]), r["term"], r["who"]) for r in found.collect())
    assert got == sorted([("1", "fox", 1), ("1", "fox", 2)] * 2 + [("3", "fox", 1), ("3", "fox", 2), ("3", "🔥 a", 3), ("3", "at", 6), ("None", "at", 6)])


def test_words_of_a_long_insight_are_counted_in_one_pass(spark):
    import time

    from engram.operators.consolidation import match_lessons

    long = " ".join(f"word{i:06d}" for i in range(40_000)) + " alpha bravo"
    insights = spark.createDataFrame(
        [("1", "lesson", long), ("2", "lesson", "alpha ALPHA"), ("3", "lesson", "alpha"), ("4", "lesson", "alpha charlie zulus " + "other " * 7), ("5", "lesson", ""), ("6", "lesson", None)],
        "id string, type string, content string",
    )
    lessons = spark.createDataFrame([("a", "alpha bravo charlie"), ("b", "alpha word039999 bravo")], "id string, statement string")
    begun = time.time()
    got = {r["id"]: r["lesson_id"] for r in match_lessons(insights, lessons).collect()}
    assert got == {"1": "b", "2": "a"}
    assert time.time() - begun < 60  # comparing every word with every other took minutes
