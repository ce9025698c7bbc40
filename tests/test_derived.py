"""Derived tables and trials on small rows with every kind of dirt."""

from pyspark.sql import functions as F

from lectern.operators import derived, trial

SEGMENTS = "object_sha256 string, segment_index int, segment_id string, locator_json string, text string, cells string"


def test_rows_of_sheets(spark):
    cell = lambda c, s="S": f'{{"cell":"{c}","sheet":"{s}"}}'
    rows = [("o", 0, "a", cell("B1"), "two", "x"), ("o", 1, "b", cell("A1"), "one", None), ("o", 2, "c", cell("AA1"), "last", None), ("o", 3, "d", cell("B1"), "again", None),
            ("o", 4, "e", cell("A2"), "  ", None), ("o", 5, "f", cell("A2"), None, None), ("o", 6, "g", '{"line":1}', "no cell", None), ("o", 7, "h", None, "none", None), (None, 8, "i", cell("A3"), "lost", None), ("o", 9, "j", cell("A1", "T"), "x", None),
            ("q", 0, "k", '{"column":10,"row":3,"sheet":"U"}', "ten", None), ("q", 1, "l", '{"column":9,"row":3,"sheet":"U"}', "nine", None), ("q", 2, "m", '{"column":"x","row":3,"sheet":"U"}', "none", None)]
    df = spark.createDataFrame(rows + rows, SEGMENTS)
    got = {(r.sheet, r.row): [(c.column, c.text) for c in r.cells] for r in derived.table_rows(df).collect()}
    assert got == {("S", 1): [("A", "one"), ("B", "two"), ("AA", "last")], ("T", 1): [("A", "x")], ("U", 3): [("9", "nine"), ("10", "ten")]}
    assert derived.table_rows(df.limit(0)).count() == 0


def test_previews_and_transcripts(spark):
    df = spark.createDataFrame([("o", 1, "b", None, "second", None), ("o", 0, "a", None, " ", None), ("o", 2, "c", None, "x" * 500, None), (None, 0, "d", None, "y", None), ("p", 0, "e", None, "y" * 500, None)], SEGMENTS)
    got = {r.object_sha256: (r.segments, r.preview) for r in derived.previews(df.unionByName(df)).collect()}
    assert got == {"o": (2, "second"), "p": (1, "y" * 179 + "…")}
    objects = spark.createDataFrame([("o", "audio/wav"), ("q", "audio/wav"), ("p", "text/plain"), ("r", None)], "sha256 string, media_type string")
    assert {tuple(r) for r in derived.transcripts(objects, df).collect()} == {("o", "available"), ("q", "not_available")}


def test_engines(spark):
    f = spark.createDataFrame([("1", ["printed"], "abc def"), ("2", None, "xyz"), ("2", None, "xyz"), ("3", [], None)], "fixture_id string, tags array<string>, reference string")
    o = spark.createDataFrame([("a", "1", "abc def", 1.0, 5), ("a", "2", "xyz", None, None), ("a", "3", "q", 1.0, 1), ("b", "1", " ", 1.0, 1), ("b", "9", "zz", 1.0, 1), ("c", "1", "abc", 1.0, 1)], "engine string, fixture_id string, hypothesis string, elapsed double, peak_rss long")
    runs = trial.engine_runs(f, o, ("a", "b"))
    assert {(r.engine, r.fixture_id, r.status) for r in runs.collect()} == {("a", "1", "succeeded"), ("a", "2", "succeeded"), ("a", "3", "succeeded"), ("b", "1", "failed"), ("b", "2", "failed"), ("b", "3", "failed")}
    got = {r.engine: (r.fixtures, r.failed, r.place) for r in trial.engine_ranking(runs).collect()}
    assert got == {"a": (3, 0, 1), "b": (3, 3, None)}


def test_questions_and_passages(spark):
    q = spark.createDataFrame([("1", ["s"], [("f", ["pump"])], None, None, None), ("2", ["s"], None, None, None, True), ("3", None, None, ["bad"], None, None)], "q string, expected array<string>, facts array<struct<id:string,terms:array<string>>>, forbidden array<string>, expected_contradiction boolean, accept_insufficient boolean")
    found = spark.createDataFrame([("1", ["s"])], "q string, retrieved array<string>")
    said = spark.createDataFrame([("1", "no such thing", 0, 0, 0), ("3", "bad", 0, 0, 1)], "q string, answer string, contradictions int, insufficient int, bad_citations int")
    got = {r.q: r.failure for r in trial.question_trial(q, found, said, "q").collect()}
    assert got == {"1": "incomplete answer", "2": "query construction", "3": "citation"}
    s = spark.createDataFrame([("x", "A  b"), ("x", "a B"), ("x", None), ("x", " "), ("y", "c")], "k string, text string")
    assert {tuple(r) for r in trial.repeated_passages(s, "k").collect()} == {("x", 2, 1, 1), ("y", 1, 1, 0)}
    m = trial.report_manifest(spark.createDataFrame([("S", 1, "a"), ("S", 2, None)], "section string, ordinal int, text string"))
    assert m.first()["rows"] == 2 and m.select(trial.unchanged(m, m, "section", "sha256")).first()[0]
    assert not m.select(trial.unchanged(m, m.withColumn("sha256", F.lit("x")), "section", "sha256")).first()[0]


def test_corpus_manifests(spark):
    import json

    from lectern.sources.records import corpus_fixtures

    good = {"fixture_id": "f1", "language": "eng", "ground_truth": "a", "image_path": "p/a.png", "source_kind": "own", "expected_lines": ["a"], "lawful_basis": "own", "generation_method": "scan"}
    bad = [good | {"fixture_id": "f2", "language": " "}, good | {"fixture_id": "f3", "image_path": "p/../../x"}, good | {"fixture_id": "f4", "image_path": "/x"}, good | {"fixture_id": "f5", "expected_lines": []}, good | {"fixture_id": "f6", "lawful_basis": None}, good]
    files = [("m", json.dumps({"schema_version": "1", "fixtures": [good, *bad]})), ("v", json.dumps({"schema_version": "2", "fixtures": []})), ("n", "no json"), ("z", None), ("e", '{"schema_version":"1","fixtures":[]}')]
    got = {(r.path, r.fixture_id, r.error) for r in corpus_fixtures(spark.createDataFrame(files, "path string, value string")).collect()}
    assert got == {("m", "f1", "fixture id is given twice"), ("m", "f2", "language is missing"), ("m", "f3", "image path leaves the corpus"), ("m", "f4", "image path leaves the corpus"), ("m", "f5", "expected lines are missing"), ("m", "f6", "lawful basis and generation method are missing"),
                   ("v", None, "not a manifest of version 1"), ("n", None, "not a manifest of version 1"), ("z", None, "not a manifest of version 1")}
