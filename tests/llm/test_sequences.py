"""Token alignment, license templates and the conversation trie beside brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from engram.llm import licenses, prefix_trie, token_alignment


def key(r):
    return [(v is None, v) for v in r]


# --- conversation trie ---------------------------------------------------------------
TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_of(rows, rebuild=True):
    convs = defaultdict(list)
    for c, t, role, said in rows:
        if c is not None:
            role, said = role or "", said or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{said}".encode()).digest()[:16]
            convs[c].append(((t is not None, t or 0, role.encode(), tie), (role, said)))
    plain = {c: [s for _, s in sorted(v)] for c, v in convs.items()}
    full = plain
    if rebuild:
        full = {}
        for c in plain:
            h = zlib.crc32(str(c).encode()) % 9
            full[c] = plain.get(c - int(math.fmod(c, 5)), [])[:h] + plain[c][h:]
    members, children = defaultdict(list), defaultdict(list)
    for c, s in full.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    below = {}
    for p in sorted(members, key=len, reverse=True):
        saved = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        below[p] = (sum(below[q][0] for q in children[p]) or 1, saved + sum(below[q][1] for q in children[p]))
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(full[c]) == len(p))
        up = min(members[p[:-1]]) if p else None
        out.append((min(m), len(p), up, len(m), len(children[p]), *below[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=key)


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as node", "2 as path", "'x' as tid").repartition(3)


@pytest.fixture(scope="module")
def odd_conversations():
    rng = random.Random(3)
    rows = []
    for c in [*range(-12, 30), None]:
        for _ in range(rng.choice([0, 1, 3, 9, 20])):
            rows.append((c, rng.choice([None, *range(9)]), rng.choice([None, "u", "a"]), rng.choice([None, "", "x", "é"])))
    rows += [(c, t, "u", "same") for c in range(100, 140) for t in range(30)]
    rows += [(c, t, "u", "same" if t < 50 else str(c)) for c in range(200, 203) for t in range(60)]
    return [*rows, *rows[:5]]


@pytest.mark.parametrize("widths", [(8, 16), (3, 2)])
def test_trie_equals_brute_force(spark, odd_conversations, widths):
    got = prefix_trie.conversation_trie(conversations(spark, odd_conversations), widths=widths).select(*TRIE)
    assert sorted([tuple(r) for r in got.collect()], key=key) == trie_of(odd_conversations)


def test_trie_of_hot_nodes(spark, monkeypatch):
    """One opening for most conversations, many ends in one node: looked up by broadcast and by join, digests in parts."""
    monkeypatch.setattr(prefix_trie, "HEAVY", 4)
    monkeypatch.setattr(prefix_trie, "ID_CHUNK", 7)
    rows = [(c, t, "u", "open" if t == 0 else str(c % 60 // (4 - t))) for c in range(300) for t in range(c % 4)]
    got = prefix_trie.conversation_trie(conversations(spark, rows), widths=(2, 1), rebuild=False).select(*TRIE)
    assert sorted([tuple(r) for r in got.collect()], key=key) == trie_of(rows, rebuild=False)


def test_trie_of_nothing(spark):
    assert prefix_trie.conversation_trie(conversations(spark, [(None, 1, "u", "x")])).collect() == []


# --- license templates -----------------------------------------------------------------
def licenses_of(text, templates, phrases, threshold):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))
    starts, base = [], set()
    for phrase, label in phrases:
        p = phrase.split(" ")
        here = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += here
        base |= {label} if here else set()
    found, score = set(), 0.0
    for label, template in templates:
        wanted = set(template.split(" "))
        n = len(wanted)
        for at in range(0, len(words), n):
            share = len(wanted & set(words[at : at + 2 * n])) / n
            if share >= threshold - 1e-9:
                found.add(label)
                score = max(score, share)
    starts.sort()
    return (len(words), len(starts), starts[0] if starts else None, starts[-1] if starts else None, sorted(base), sorted(found), 1.0 if starts else score)


def test_licenses_equal_brute_force(spark):
    rng = random.Random(8)
    pool = [w for _, t in licenses.TEMPLATES for w in t.split(" ")]
    texts = [None, "", "...", "MIT license, mit License;MIT\nLicense", "gnu general public  license", "mitlicense mit licenses", "x" * 50_000, "Apache-License é mİt license"]
    texts += [t.title() for _, t in licenses.TEMPLATES]
    for _ in range(60):
        words = []
        for _ in range(rng.randrange(1, 8)):
            part = rng.choice(licenses.TEMPLATES)[1].split(" ")
            part = [w for w in part if rng.random() > rng.choice([0, 0.1, 0.3])]
            words += [rng.choice(["foo", "Bär", rng.choice(pool)]) for _ in range(rng.randrange(0, 40))] + part
        texts.append(rng.choice([" ", "\n", ", "]).join(words))
    texts.append(" ".join(rng.choice(pool) for _ in range(20_000)))
    rows = [*enumerate(texts), (None, "released under the MIT license"), (3, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as row", "2 as words", "3 as score").repartition(3)
    for threshold in (0.8, 0.5):
        got = licenses.find_licenses(docs, threshold).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "template_labels", "score")
        want = [(i, *licenses_of(t, licenses.TEMPLATES, licenses.PHRASES, threshold)) for i, t in rows]
        plain = lambda found: sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in found], key=key)
        assert plain(got.collect()) == plain(want)
    assert licenses.find_licenses(docs.limit(0)).collect() == []


def test_license_query_uses_no_python_workers(spark):
    docs = spark.createDataFrame([(1, "released under the mit license")], "doc_id long, text string")
    plan = licenses.find_licenses(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- token alignment --------------------------------------------------------------------
ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def aligner():
    import public_tokenizers as P

    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as a, open(P.path("piece_bpe_32k.model"), "rb") as b:
        return token_alignment.Aligner(a.read(), b.read())


def alignments_of(aligner, rows):
    docs = []
    for i, text in rows:
        data = (" " + (text or "")).encode()
        a = aligner.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = aligner.b.encode(text) if text else []
        if not text or b"".join(aligner.a_bytes[x] for x in a) != data or b"".join(aligner.b_bytes[x] for x in b) != data:
            docs.append((i, None))
            continue
        # the token of either side at every byte
        at_a = [k for k, x in enumerate(a) for _ in aligner.a_bytes[x]]
        at_b = [k for k, x in enumerate(b) for _ in aligner.b_bytes[x]]
        met = list(dict.fromkeys(zip(at_a, at_b, strict=True)))
        groups, last = [], (-1, -1)
        for k in range(len(data)):
            if k + 1 == len(data) or (at_a[k] != at_a[k + 1] and at_b[k] != at_b[k + 1]):
                groups.append(",".join(map(str, a[last[0] + 1 : at_a[k] + 1])) + "|" + ",".join(map(str, b[last[1] + 1 : at_b[k] + 1])))
                last = (at_a[k], at_b[k])
        docs.append((i, (len(a), len(b), len(groups), [(a[x], b[y]) for x, y in met], ";".join(groups))))
    counts = Counter(link for _, d in docs if d for link in d[3])
    top = defaultdict(int)
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    out = []
    for i, d in docs:
        if d is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, n, links, text = d
            best, total = sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links)
            out.append((i, n_a, n_b, n, len(links), best, total, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=key)


def test_alignment_equals_brute_force(spark, aligner, monkeypatch):
    rng = random.Random(6)
    bits = ["a", "the", " ", "  ", "   ", "\n", "\t", " ", "　", "é", "漢", "😀", "1", "23", "'s", ".", "!!", "▁", "<s>", "<|endoftext|>", "<0x41>", "ﬁ", "é", "\u0085",
            "\x1c", "\x00", "Word", "x" * 40, "​", "İ", "क्षि"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 30)))) for i in range(800)]
    rows += [(7, None), (8, ""), (None, "no id"), (9, " "), (10, "x" * 20_000), (11, "ab " * 30_000), (12, " lead"), (13, "trail "), (14, "same same"), (14, "same same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as row", "2 as a", "3 as pair").repartition(3)
    want = alignments_of(aligner, rows)
    for heavy in (token_alignment.HEAVY, 40, 0):
        got = token_alignment.alignment_counts(docs, heavy=heavy).select(*ALIGNED)
        assert sorted([tuple(r) for r in got.collect()], key=key) == want
    assert token_alignment.alignment_counts(docs.limit(0)).collect() == []
    listed = {r["doc_id"]: r for r in token_alignment.align_tokens(docs.filter("doc_id > 100")).collect()}
    for i, n_a, n_b, n_groups, *_ in want:
        if i is not None and i > 100:
            r = listed[i]
            assert (len(r["a"]), len(r["b"]), len(set(r["a_ends"]) & set(r["b_ends"]))) == (n_a, n_b, n_groups)


def test_segments_change_nothing(aligner, monkeypatch):
    rng = random.Random(9)
    for _ in range(300):
        text = "".join(rng.choice(["ab", "x,", " ", "  ", "\n", "\n ", "Été", "漢", " \t", "9"]) for _ in range(rng.randrange(1, 25)))
        numbers = aligner.look_up([aligner.segments(text)])[0]
        good, a, b, groups, n = aligner.learn([text])[0]
        assert all(aligner.good[s] for s in numbers) == good
        if good:
            assert b"".join(aligner.a_ids[s] for s in numbers) == a and b"".join(aligner.b_ids[s] for s in numbers) == b
            assert "".join(aligner.groups[s] for s in numbers) == groups and sum(aligner.n_groups[s] for s in numbers) == n
    monkeypatch.setattr(token_alignment, "KNOWN", 3)
    for parts in ([["p", "q"], ["r", "s", "p"]], [["p"], ["t", "u"]], [["p", "v" * 300]]):
        numbers = aligner.look_up(parts)
        for text, found in zip(parts, numbers, strict=True):
            for part, k in zip(text, found, strict=True):
                assert (aligner.good[k], aligner.a_ids[k], aligner.b_ids[k], aligner.groups[k], aligner.n_groups[k]) == aligner.learn([part])[0]
