import math
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import retrieval
from lectern.operators.search import Index, phrases_of, search

COLUMNS = "segment_id string, segment_index int, object_sha256 string, source_name string, media_type string, kind string, locator_json string, text string"


def segments(spark, texts):
    return spark.createDataFrame([(f"s{i:04}", i, f"o{i % 7}", f"n{i % 7}.txt", "text/plain", "txt" if i % 2 else "md", "{}", t) for i, t in enumerate(texts)], COLUMNS)


def test_like_full_text_search_of_sqlite(spark):
    r = random.Random(5)
    words = ["alpha", "beta", "gamma", "délta", "a", "b", "x1", "ÉCOLE"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(1, 14))) for _ in range(150)] + ["a a a a", "the-end", "3.14 snake_case"]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(t, tokenize='unicode61')")
    con.executemany("insert into f(rowid, t) values (?, ?)", [(i + 1, t) for i, t in enumerate(texts)])
    asked = ["a a", "alpha", "beta gamma", "delta", "ecole a", "snake case", "a b alpha", "end", "zeta"]
    got = {(x.phrase, x.segment_id): x.rank for x in Index.build(segments(spark, texts)).match(phrases_of(spark, *asked)).collect()}
    want = {(p, f"s{i - 1:04}"): b for p in asked for i, b in con.execute("select rowid, bm25(f) from f where f match ?", [f'"{p}"'])}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-12) for k in want)


def test_filters_limits_ties_and_dirt(spark):
    rows = segments(spark, ["rule one", "rule one", None, "", "  ", "rule"])
    i = Index.build(rows.unionByName(rows))
    assert [x.segment_id for x in search(i, "rule one", 10).collect()] == ["s0000", "s0001"]
    assert [x.segment_id for x in search(i, "rule one", 10, kind="txt").collect()] == ["s0001"]
    assert search(i, "?!", 10).count() == 0
    for bad in ("", "  "):
        with pytest.raises(ValueError):
            search(i, bad)
    with pytest.raises(ValueError):
        search(i, "rule", 101)
    with pytest.raises(ValueError):
        search(i, "rule", 10, text="x")
    assert search(Index.build(rows.limit(0)), "rule", 5).count() == 0


def test_variants():
    got = retrieval.derive("Which humidity deadline of the cold-store team was approved?")
    assert got[0] == ("exact", "Which humidity deadline of the cold-store team was approved?", 120)
    assert ("phrase", "humidity deadline cold-store", 80) in got and ("term", "cold-store", 60) in got
    assert ("concept", "due on", 90) in got and ("concept", "humidity chart", 90) in got
    assert len(retrieval.derive(" ".join(f"w{i}" for i in range(40)))) <= 24
    assert retrieval.derive("  ") == []
    assert len({q.casefold() for _, q, _ in got}) == len(got)


def test_retrieval_by_brute_force(spark):
    r = random.Random(2)
    words = "budget risk decision deadline pump schedule owner moved approved".split()
    texts = [" ".join(r.choice(words) for _ in range(r.randint(3, 12))) for _ in range(60)]
    index = Index.build(segments(spark, texts))
    q = spark.createDataFrame([("q1", "Which budget risk moved the pump schedule?"), ("q2", None), ("q3", "owner approved")], "question_id string, question string")
    asked = retrieval.variants(q)
    got = retrieval.retrieve(index, asked, limit=3).collect()
    rank = {(x.phrase, x.segment_id): x.rank for x in index.match(asked.select("phrase")).collect()}
    for qid in ("q1", "q3"):
        variants = sorted((x.variant_no, x.phrase, x.weight) for x in asked.where(F.col("question_id") == qid).collect())
        score, best, matched = {}, {}, {}
        for _, p, w in variants:
            hits = sorted((v, s) for (ph, s), v in rank.items() if ph == p)[:40]
            first = {}
            for pos, (_, s) in enumerate(hits, 1):
                o = int(s[1:]) % 7
                first.setdefault(o, pos)
                matched.setdefault(o, set()).add(p.lower())
                value = w + 1 / pos + min(len(texts[int(s[1:])]), 400) / 1000
                if o not in best or value > best[o][0]:
                    best[o] = (value, s)
            for o, pos in first.items():
                score[o] = score.get(o, 0.0) + w + 1 / pos
        want = sorted(score, key=lambda o: (-score[o], f"n{o}.txt", best[o][1]))[:3]
        mine = sorted((x for x in got if x.question_id == qid), key=lambda x: x.evidence_no)
        assert [x.segment_id for x in mine] == [best[o][1] for o in want]
        assert [x.score for x in mine] == [round(score[o], 6) for o in want]
        assert [set(x.matched) for x in mine] == [matched[o] for o in want]


def test_text_functions(spark):
    rows = spark.createDataFrame([("a/b.TXT", "  x   y ", '{"b":1,"page":2}'), (None, None, None), (".hidden", "z" * 300, "{}")], "n string, t string, l string")
    got = rows.select(T.suffix(F.col("n")), T.collapse(F.col("t")), F.length(T.excerpt(F.col("t"))), T.format_locator(F.col("l")), T.format_locator_short(F.col("l")), T.is_blank(F.col("t"))).collect()
    assert [tuple(x) for x in got] == [(".txt", "x y", 3, "page 2, b 1", "b 1, page 2", False), (None, None, None, "document", "source", True), ("", "z" * 300, 180, "document", "source", False)]
    told = spark.createDataFrame([('x ```json\n{"a": 1}\n``` y',), ('see {"a": {"b": 2}} end',), ("none",), (None,)], "r string").select(T.json_payload(F.col("r"))).collect()
    assert [x[0] for x in told] == ['{"a": 1}', '{"a": {"b": 2}}', None, None]
    paths = spark.createDataFrame([("/a/b/c",), ("/a/bc",), ("/a/b",), (None,)], "p string").select(T.relocate(F.col("p"), "/a/b", "/n")).collect()
    assert [x[0] for x in paths] == ["/n/c", "/a/bc", "/n", None]
