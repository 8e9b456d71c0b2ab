"""Near-duplicate operators, chunks and leaks beside brute force."""

import itertools
import random
import re

import numpy as np
import pytest

from engram.llm.cap_filters import near_vectors
from engram.llm.components import connected_components
from engram.llm.decontamination import count_leaks, find_leaks
from engram.llm.jaccard_join import jaccard_components
from engram.llm.scratch import Scratch
from engram.llm.substring_dedup import cut_positions, repeated_passages

WORDS = [a + b for a in "bcdfglmnprst" for b in ("a", "en", "or", "ist", "u")]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(WORDS).upper()
    return words


def components(ids, links):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def shingles(t):
    words = re.findall(r"[^ \t\n\x0b\x0c\r]+", re.sub("[A-Z]+", lambda m: m.group().lower(), t or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


@pytest.fixture(scope="module")
def near_documents():
    """Groups of copies and near copies, one of them large, shared passages, and odd texts."""
    rng = random.Random(4)
    rows = [(None, "a b c d e f"), (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE  two"), (6, "one two three"), (7, "x" * 3000)]
    nxt = itertools.count(10)
    passage = text(rng, 60)
    for size in (1, 2, 3, 12, 60):
        base = text(rng, 120).split()
        for _ in range(size):
            rows.append((next(nxt), " ".join(edited(rng, base, rng.randrange(0, 5)))))
    for _ in range(25):
        rows.append((next(nxt), text(rng, rng.randrange(5, 90)) + " " + passage))
    chain = text(rng, 100).split()
    for _ in range(15):
        chain = edited(rng, chain, 2)
        rows.append((next(nxt), " ".join(chain)))
    rows += [(next(nxt), rows[-1][1])] + [rows[-3]] * 2
    rng.shuffle(rows)
    return rows


def test_jaccard_components_equal_brute_force(spark, near_documents):
    df = spark.createDataFrame(near_documents, "doc_id long, text string").selectExpr(
        "doc_id", "text", "1 as component_id", "'x' as digest", "2 as a", "3 as n_shingles"
    ).repartition(5)
    sets = {i: shingles(t) for i, t in near_documents if i is not None}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert len(links) > 300
    want = components(sets, links)
    got = jaccard_components(df).collect()
    assert len(got) == len(near_documents)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]]), r
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]


def test_jaccard_of_no_rows(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only = jaccard_components(spark.createDataFrame([(None, None), (1, None)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in only) == [(0, 0, None), (1, 0, 1)] or len(only) == 2


def test_components_of_chain_and_hub(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(1000, i) for i in range(200, 260)] + [(7, 7), (None, 3)]
    scratch = Scratch(spark, "test")
    got = dict(connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b", scratch, "t").collect())
    assert got == {i: 100 for i in range(100, 141)} | {i: 200 for i in [*range(200, 260), 1000]}
    none = connected_components(spark.createDataFrame([], "a long, b long"), "a", "b", scratch, "none")
    assert none.count() == 0 and none.columns == ["node", "component"]


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    rows, at = [], itertools.count(1)
    for label in (0, 1):
        for size in (1, 1, 2, 5, 150):
            centre = rng.normal(size=24)
            for _ in range(size):
                rows.append((next(at), (centre + rng.normal(size=24) * rng.uniform(0, 0.3)).tolist(), label))
    same = rows[30][1]
    rows += [(next(at), same, 1) for _ in range(40)] + [(next(at), same, 0)]
    odd = [
        (next(at), None, 1), (next(at), [0.0] * 24, 1), (next(at), [None] + same[1:], 1), (next(at), [float("nan")] + same[1:], 1), (next(at), [float("inf")] + same[1:], 1),
        (next(at), same, None), (next(at), [], 1), (None, same, 1),
    ]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as key", "2 as component", "'v' as v", "3 as n_links")
    ids, m, labels = [r[0] for r in rows], np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    near = (m @ m.T >= 0.93) & (labels[:, None] == labels[None])
    np.fill_diagonal(near, False)
    i, j = np.nonzero(np.triu(near))
    want = components(ids, [(ids[a], ids[b]) for a, b in zip(i, j)])
    got = {r["vec_id"]: r for r in near_vectors(df).collect()}
    assert len(got) == len(rows) + len(odd)
    found = sum(got[v]["n_links"] for v in ids)
    assert found <= near.sum() and found >= 0.99 * near.sum()
    for k, v in enumerate(ids):
        assert got[v]["n_links"] <= near[k].sum()
        assert got[v]["component_id"] == want[v]
        assert got[v]["kept"] == (want[v] == v)
    for v, *_ in odd:
        assert got[v]["n_links"] == 0 and got[v]["component_id"] == v and got[v]["kept"]
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_cuts_resist_insertions():
    rng = random.Random(9)
    data = text(rng, 400).encode()
    cuts = set(cut_positions(np.frombuffer(data, np.uint8)).tolist())
    moved = b"something new: " + data
    later = {c - 15 for c in cut_positions(np.frombuffer(moved, np.uint8)).tolist()}
    assert {c for c in cuts if c > 16} == {c for c in later if c > 16} and len(cuts) > 30


def test_repeated_passages(spark):
    rng = random.Random(12)
    passage, short = text(rng, 70), text(rng, 8)
    rows = [(i, f"{text(rng, 40)} {passage} {text(rng, 30)}") for i in range(6)]
    rows += [(i, f"{text(rng, 40)} {short} é世界 {text(rng, 30)}") for i in range(10, 20)]
    rows += [(30, None), (31, ""), (None, text(rng, 80)), (32, "la " * 3000), (33, "a" * 5000), (33, "a" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as digest", "2 as place", "3 as first")
    got = repeated_passages(df).collect()
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None and r["doc_id"] < 30}
    assert set(by) == set(range(6)) and [by[i]["is_first"] for i in range(6)] == [True] + [False] * 5
    texts = dict(rows)
    for i, r in by.items():
        found = texts[i][r["start"] : r["end"]]
        assert found in passage or passage in found or len(set(found.split()) & set(passage.split())) > 20
        assert r["first_doc_id"] == 0 and r["occurrences"] == 6
    assert 32 in {r["doc_id"] for r in got}
    assert repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_leaks_equal_brute_force(spark):
    rng = random.Random(3)
    items = [(i, text(rng, rng.randrange(12, 60))) for i in range(40)] + [(50, None), (51, ""), (52, "What is it? bordelais"), (53, "What is it? bordelais")]
    docs, want = [], set()
    for d in range(80):
        words = text(rng, rng.randrange(0, 400))
        if d % 4 == 0:
            k = rng.randrange(40)
            words = f"{words} {items[k][1].upper() if d % 8 else items[k][1]}, {text(rng, 20)}"
            want.add((d, k))
        docs.append((d, words))
    docs += [(100, None), (101, ""), (None, items[3][1]), (102, "so: what is it, bordelais!"), (103, " ".join(reversed(items[0][1].split())))]
    want |= {(None, 3), (102, 52), (102, 53)}
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as score")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id")
    assert {(r["doc_id"], r["item_id"]) for r in find_leaks(df, bench).collect()} == want
    counts = count_leaks(df, bench, keep=["item_id"]).collect()
    assert len(counts) == len(docs) and sum(r["n_items"] for r in counts) == len(want)
    empty = spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(df, empty).count() == 0 and find_leaks(df.limit(0), bench).count() == 0


def test_one_document_of_each_group_stays(spark):
    """Rows with one id and different texts are different documents; rows that repeat are one; nothing else is lost."""
    from engram.llm.jaccard_join import without_near_duplicates

    rng = random.Random(12)
    a, b, c = text(rng, 80), text(rng, 80), text(rng, 80)
    near = " ".join(edited(rng, a.split(), 1))
    rows = [
        (1, a, "x"), (1, b, "x"), (2, c, "x"), (3, near, "x"), (4, c, "y"), (1, a, "w"), (5, None, "x"), (5, None, "x"), (6, "", "x"),
        (None, a, "x"), (None, None, "x"), (7, " ".join(edited(rng, b.split(), 1)), "x"), (8, text(rng, 60), "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "3 as digest", "4 as component").repartition(4)
    want = [(1, a, "w"), (1, b, "x"), (2, c, "x"), (5, None, "x"), (6, "", "x"), (None, a, "x"), (None, None, "x"), (8, rows[-1][1], "x")]
    order = lambda found: sorted(found, key=str)
    for removed in (1000, 0):
        got = without_near_duplicates(df, removed=removed)
        assert got.columns == df.columns
        assert order((r["doc_id"], r["text"], r["lang"]) for r in got.collect()) == order(want)
    assert without_near_duplicates(df.limit(0)).collect() == []


def test_pairs_across_a_tile_are_bounded_in_its_task():
    """A pair of which the bitmaps say that it can't be similar does not leave the task that looks at the tile."""
    import numpy as np
    import pyarrow as pa

    from engram.llm import jaccard_join as j

    rng = np.random.default_rng(1)
    bits = rng.integers(-(2**63), 2**63 - 1, size=(3, j.SIGNATURE))
    bits[1] = bits[0]
    bits[1, 3] ^= 5
    rows = {
        "tile": [1, 1, 1], "x": [0, 0, 0], "y": [0, 0, 0], "rep": [10, 30, 20], "n": [100, 100, 100], "at": [0, 0, 0], "component": [10, 30, 20],
        "minor": [False, False, True], "signature": [bits[0].tolist(), bits[2].tolist(), bits[1].tolist()],
    }
    got = [r for b in j._across(75)(iter([pa.RecordBatch.from_pydict(rows)])) for r in b.to_pylist()]
    assert got == [{"a": 10, "b": 20}]


def test_pairs_of_a_tile_are_made_in_parts_that_leave_none_out():
    """The rounds together make every pair once, the first of them only a small part of the pairs of a large tile."""
    import numpy as np
    import pyarrow as pa

    from engram.llm import jaccard_join as j

    n = 400
    rep = np.random.default_rng(3).integers(-(2**62), 2**62, n)
    bits = np.zeros((n, j.SIGNATURE), dtype=np.int64)
    rows = {
        "tile": [1] * 2 * n, "x": [0] * 2 * n, "y": [0] * 2 * n, "rep": [*rep, *rep], "n": [100] * 2 * n, "at": [0] * 2 * n,
        "component": [*rep, *rep], "minor": [False] * n + [True] * n, "signature": [*bits.tolist(), *bits.tolist()],
    }
    batch = pa.RecordBatch.from_pydict(rows)
    made = []
    for k, parts in enumerate(j.ROUNDS):
        found = j._across(75, parts, j.ROUNDS[k - 1] if k else 0)(iter([batch]))
        made.append({(r["a"], r["b"]) for b in found for r in b.to_pylist()})
    every = {(min(a, b), max(a, b)) for a, b in itertools.combinations(rep.tolist(), 2)}
    assert set().union(*made) == every and sum(map(len, made)) == len(every)
    assert 0 < len(made[0]) < len(every) / 32
