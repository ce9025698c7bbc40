import random

from pyspark.sql import functions as F

from lectern.functions.edits import edit_counts, measure, nfkc, similarity
from lectern.operators import citations, grounding, ledger, scores, snapshots


def naive(a, b):
    d = [[(i or j, 0, i, j) if not (i and j) else None for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = (min(d[i - 1][j][0] + 1, d[i][j - 1][0] + 1, d[i - 1][j - 1][0] + (a[i - 1] != b[j - 1])),)
    return d[-1][-1][0]


def test_edit_counts():
    assert edit_counts(list("abc"), list("adcX")) == (1, 0, 1)
    assert edit_counts([], []) == (0, 0, 0) and edit_counts(list("ab"), []) == (0, 2, 0) and edit_counts([], list("ab")) == (0, 0, 2)
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.choice("abc") for _ in range(r.randint(0, 9))] for _ in range(2))
        s, d, n = edit_counts(a, b)
        assert s + d + n == naive(a, b) and len(a) - d + n == len(b)


def test_measures(spark):
    m = measure("abc", "adcX")
    assert m[6] == 0.666667 and m[3] == 3
    assert measure(None, None)[6] == 0.0 and measure("", "x")[6] == 1.0
    rows = spark.createDataFrame([("f1", "en", ["printed"], "abc", "adcX", 1.0, 5), ("f2", "en", None, None, None, None, None)], "fixture_id string, language string, tags array<string>, reference string, hypothesis string, elapsed double, peak_rss long")
    one = scores.micro(scores.recognition(rows, "fixture_id"), "language").first()
    assert (one.fixtures, one.cer, one.peak_rss, one.elapsed) == (2, 0.666667, 5, 1.0)
    assert scores.routes(scores.recognition(rows, "fixture_id")).count() == 1
    t = spark.createDataFrame([("ﬁ", "fi"), (None, "x")], "a string, b string").select(nfkc("a"), similarity("a", "b")).collect()
    assert t[0][0] == "fi" and t[1][0] is None and t[1][1] is None


def test_retrieval_scores(spark):
    rows = spark.createDataFrame([("a", ["x", "y"], ["z", "y"]), ("b", [], ["z"]), ("c", ["x"], None), ("d", None, None)], "q string, expected array<string>, retrieved array<string>")
    got = {r.q: (r.recall, r.ranks, r.irrelevant, r.displaced) for r in scores.retrieval(rows, "q").collect()}
    assert got == {"a": (0.5, [0, 2], 1, True), "b": (1.0, [], 1, False), "c": (0.0, [0], 0, False), "d": (1.0, [], 0, False)}


def test_answers(spark):
    schema = "q string, answer string, facts array<struct<id:string,terms:array<string>>>, forbidden array<string>, expected_contradiction boolean, accept_insufficient boolean, contradictions int"
    rows = spark.createDataFrame([("a", "The Pump moved", [("f", ["pump", "MOVED"]), ("g", ["x"])], ["moved"], None, None, 0), ("b", None, None, None, True, True, 0), ("c", "ok", [], [], True, False, 1)], schema)
    got = {r.q: (r.completeness, r.honest, r.contradiction_handled) for r in scores.answers(rows, "q").collect()}
    assert got == {"a": (0.25, False, True), "b": (1.0, False, False), "c": (1.0, True, True)}


def test_medians_and_modes(spark):
    rows = spark.createDataFrame([("a", v) for v in (5, 1, 3, 9)] + [("b", None), ("b", 2)], "g string, v int")
    assert {r.g: r.upper_median for r in scores.upper_medians(rows, "v", "g").collect()} == {"a": 5, "b": 2}
    r = random.Random(4)
    many = [(g, r.choice([r.randint(0, 50), r.randint(0, 10**6)])) for g in "xyz" for _ in range(r.randint(1, 400))]
    got = {x.g: (x.upper_median, x.n) for x in scores.upper_medians(spark.createDataFrame(many, "g string, v int"), "v", "g").collect()}
    assert got == {g: (sorted(v for k, v in many if k == g)[sum(k == g for k, _ in many) // 2], sum(k == g for k, _ in many)) for g in "xyz"}
    seen = spark.sql("select * from values ('g','y',timestamp'2024-01-02'),('g','x',timestamp'2024-01-01'),('g','y',timestamp'2024-01-03'),('g','x',timestamp'2024-01-04') t(g, v, at)")
    assert scores.mode_first(seen, "v", "at", "g").first().mode == "x"


def test_ledger(spark):
    rows = spark.sql("select * from values ('1','a',timestamp'2024-01-02'),('2','a',null),('3','a',timestamp'2024-01-01'),('4','b',null) t(id, sha256, at)")
    assert {r.id: r.duplicate for r in ledger.with_duplicates(rows, "sha256", "at", "id").collect()} == {"3": False, "1": True, "2": True, "4": False}
    assert ledger.new_content(rows.select("sha256", "id"), rows.where("sha256 = 'a'")).first().id == "4"
    assert [r.rule for r in ledger.violations("ingestions", spark.sql("select 'i' ingestion_id, 'zz' object_sha256, 'odd' status"), "ingestion_id").orderBy("rule").collect()] == ["digest", "status"]
    exports = ledger.text_exports(spark.sql("select * from values ('o',0,'s0','a'),('o',0,'s0','a'),('o',1,'s1',null),('o',1000,'s2','b'),('o',2,'s3','c') t(object_sha256, segment_index, segment_id, text)"))
    assert {(r.part, r.segments, r.text) for r in exports.collect()} == {(0, 2, "a\nc"), (1, 1, "b")}


def test_differences(spark):
    a, b = (spark.createDataFrame(x, "k string, v int") for x in ([("1", 1), ("2", None), ("3", 3)], [("1", 2), ("2", None), ("4", 4)]))
    assert {(r.k, r.difference) for r in snapshots.differences(a, b, "k", "v").collect()} == {("1", "changed"), ("3", "missing"), ("4", "unexpected")}
    assert tuple(snapshots.compare_maps(a, b, "k", "v").first()) == (2, 1, 1, 1, 1)
    assert snapshots.differences(a.limit(0), b.limit(0), "k", "v").count() == 0


def test_grounding(spark):
    raw = [("1", '```json\n{"paragraphs":[{"text":"x","citation_ids":["CIT-1","CIT-7"]}]}\n```'), ("2", "nothing"), ("3", '{"mood":1}'), ("4", None), ("5", '{"paragraphs":[{"text":"x"}]}')]
    rows = grounding.parsed(spark.createDataFrame(raw, "q string, raw string")).withColumn("allowed_ids", F.array(F.lit("CIT-1")))
    assert {r.q: r.parse_error for r in rows.collect()} == {"1": None, "2": "no json", "3": "unknown keys", "4": "no json", "5": None}
    assert {(r.q, r.missing, r.malformed, r.unknown) for r in citations.structure(rows, "q").collect()} >= {("1", False, 0, 1), ("5", True, 0, 0)}
    src = spark.sql("select 'o1' object_sha256, 's1' segment_id, -2.0 rank, 'n' source_name, '{\"line\":1}' locator_json, 'text one' text")
    report = grounding.report("T", src)
    assert grounding.report_errors(report).count() == 0
    assert "section is missing: Sources" in {r.error for r in grounding.report_errors(report.where("section <> 'Sources'")).collect()}
