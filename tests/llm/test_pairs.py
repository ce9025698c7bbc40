"""Near-duplicates, leaks and encoding, against brute force."""

import random

import numpy as np
import pytest

from lectern.llm.leaks import RUN, leaked
from lectern.llm.near import BLOCK, LEAF, Tree, dual, groups, near_duplicates
from lectern.llm import near

WORDS = [f"w{i}" for i in range(60)]


def shingles(t, n):
    w = t.lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def corpus(n, seed):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        if out and r.random() < 0.6:
            w = r.choice(out).split() + ["w0"]
            for _ in range(r.randint(0, 3)):
                k = r.randrange(len(w))
                w[k : k + 1] = r.choice([[], [r.choice(WORDS)], [w[k], r.choice(WORDS)]])
            out.append(" ".join(w) or "w1")
        else:
            out.append(" ".join(r.choice(WORDS) for _ in range(r.randint(3, 40))))
    return out


def pairs_of(spark, texts, width, threshold, **kw):
    df = spark.createDataFrame([(f"k{i:03}", t, i) for i, t in enumerate(texts)], "key string, text string, cls int")
    pairs, members = near_duplicates(df.unionByName(df), "key", width=width, threshold=threshold, **kw)
    of = {}
    for m in members.collect():
        of.setdefault(bytes(m.cls), []).append(m.key)
    got = {frozenset((x, y)) for p in pairs.collect() for x in of[bytes(p.a)] for y in of[bytes(p.b)]}
    return got | {frozenset((x, y)) for v in of.values() for x in v for y in v if x < y}, pairs, members


@pytest.mark.parametrize("width,threshold,block", [(3, 0.6, 4096), (5, 0.8, 4096), (3, 0.6, 8)])
def test_all_pairs(spark, monkeypatch, width, threshold, block):
    monkeypatch.setattr(near, "BLOCK", block)
    texts = corpus(120, width) + ["  ", "A b", "a  B", "", "alone", "日本語 文章"]
    got, _, _ = pairs_of(spark, texts, width, threshold)
    sets = [shingles(t, width) for t in texts]
    want = {frozenset((f"k{i:03}", f"k{j:03}")) for i in range(len(texts)) for j in range(i) if sets[i] == sets[j] or (sets[i] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9)}
    assert got == want


def test_groups(spark):
    texts = corpus(60, 9)
    got, pairs, members = pairs_of(spark, texts, 3, 0.6)
    rows = groups(pairs, members, "key").collect()
    label = {f"k{i:03}": i for i in range(len(texts))}
    changed = True
    while changed:
        changed = False
        for p in got:
            a, b = p
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    linked = {k for p in got for k in p}
    assert {r.key for r in rows} == linked
    assert len({(r.group_id, label[r.key]) for r in rows}) == len({r.group_id for r in rows}) == len({label[k] for k in linked})
    assert all(r.links == sum(r.key in p for p in got) for r in rows)


def test_dirt(spark):
    df = spark.createDataFrame([(None, "a b c"), ("x", None), ("y", "short")], "key string, text string")
    pairs, members = near_duplicates(df, "key", least_chars=3)
    assert pairs.count() == 0 and [m.key for m in members.collect()] == ["y"]
    pairs, members = near_duplicates(df.limit(0), "key")
    assert pairs.count() == 0 and members.count() == 0


def test_trees_lose_nothing():
    r = np.random.default_rng(3)
    base = [set(r.integers(0, 1 << 62, 40).tolist()) for _ in range(12)]
    sets = [set(list(base[i % 12])[: r.integers(25, 41)]) | set(r.integers(0, 1 << 62, r.integers(0, 8)).tolist()) for i in range(LEAF * 9)]
    bits = np.zeros((len(sets), 4), dtype=np.uint64)
    for i, s in enumerate(sets):
        for x in s:
            bits[i, x >> 60 & 3] |= np.uint64(1) << np.uint64(x >> 20 & 63)
    t = Tree(bits, np.array([len(s) for s in sets]), np.array([min(s) for s in sets]))
    got = {frozenset(p) for p in zip(*(v.tolist() for v in dual(t, t, 0.6, True)))}
    assert got >= {frozenset((i, j)) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j])}
    assert BLOCK > LEAF


def test_leaks(spark):
    r = random.Random(4)
    passage = lambda: " ".join(r.choice(WORDS) for _ in range(40))
    held = [(f"q{i}", passage()) for i in range(20)] + [("none", None), ("short", "a b c"), ("empty", "")]
    held.append(("twin", held[0][1]))
    docs = []
    for i in range(120):
        w = [r.choice(WORDS) for _ in range(r.randint(0, 60))]
        p = r.choice(held[:20])[1].split()
        n, at = r.randint(0, 25), r.randint(0, 15)
        w[len(w) // 2 : len(w) // 2] = [x.upper() + r.choice(["", ",", "."]) for x in p[at : at + n]]
        docs.append((i, " ".join(w)))
    docs += [(900, None), (901, ""), (902, "x " * 3000), (903, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(held, "question_id string, passage string")
    found = leaked(df.unionByName(df), q, "doc_id", "question_id").where(f"run >= {RUN}").select("doc_id", "question_id").distinct().collect()
    grams = lambda t: {tuple(x) for x in zip(*([w.strip(".,").lower() for w in (t or "").split()][k:] for k in range(RUN)))}
    assert {tuple(x) for x in found} == {(d, k) for d, t in docs for k, p in held if grams(t) & grams(p)}
    assert leaked(df, q.limit(0), "doc_id", "question_id").count() == 0
    near_copy = " ".join(x if i % 13 else "changed" for i, x in enumerate(held[3][1].split()))
    fuzzy = leaked(spark.createDataFrame([(1, near_copy)], "doc_id long, text string"), q, "doc_id", "question_id", most_edits=3)
    assert {x.question_id for x in fuzzy.collect()} >= {"q3"}


def edited_share(doc, passage, most):
    """Brute force: some stretch of 12 words or more of the passage is in doc with most / 16 edits a word."""
    for j in range(len(passage) - RUN + 1):
        row = [0] * (len(doc) + 1)
        for n, w in enumerate(passage[j:], 1):
            new = [n]
            for c, x in enumerate(doc, 1):
                new.append(min(row[c - 1] + (x != w), row[c] + 1, new[-1] + 1))
            row = new
            if n >= RUN and min(row) * 16 <= most * n:
                return True
    return False


def test_edited_passages_are_all_found(spark):
    r = random.Random(11)
    words = [f"v{i}" for i in range(400)]
    held = [(f"q{i}", [r.choice(words) for _ in range(n)]) for i, n in enumerate([12, 12, 14, 16, 16, 25, 25, 40, 40, 60])]
    docs = []
    for i in range(150):
        p = list(r.choice(held)[1])
        every, kind = r.randint(3, 10), r.randrange(3)
        for k in reversed(range(r.randrange(every), len(p), every)):
            p[k : k + 1] = [[r.choice(words)], [], [p[k], r.choice(words)]][kind]
        docs.append((i, [r.choice(words) for _ in range(r.randint(0, 9))] + p + [r.choice(words) for _ in range(r.randint(0, 9))]))
    one = list(held[0][1])
    one[6] = "changed"
    docs.append((900, one))
    d = spark.createDataFrame([(k, " ".join(w)) for k, w in docs], "doc_id long, text string")
    q = spark.createDataFrame([(k, " ".join(w)) for k, w in held], "question_id string, passage string")
    for most in (2, 4):
        got = {tuple(x) for x in leaked(d, q, "doc_id", "question_id", most_edits=most).select("doc_id", "question_id").collect()}
        assert got == {(k, n) for k, w in docs for n, p in held if edited_share(w, p, most)}
        assert (900, "q0") in got


def test_every_segment_has_a_group(spark, tmp_path):
    texts = ["a b c d e f", "a b c d e f", "g h i j k l", "m"]
    spark.createDataFrame([(f"s{i}", t) for i, t in enumerate([*texts, None, " "])], "segment_id string, text string").write.parquet(str(tmp_path / "segments.parquet"))
    rows = {r.segment_id: r for r in near.p7_groups(spark, str(tmp_path)).collect()}
    assert {k: (r.copies, r.links) for k, r in rows.items()} == {"s0": (2, 1), "s1": (2, 1), "s2": (1, 0), "s3": (1, 0)}
    assert len({r.group_id for r in rows.values()}) == 3
