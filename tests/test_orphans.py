import datetime as dt

from pyspark.sql import functions as F

from lectern.operators.orphans import clean_digest, orphan_references, orphans_by_month

T0, T1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)


def frames(spark, refs, parents, removed):
    return (
        spark.createDataFrame(refs, "table_name string, record_id string, digest string, at timestamp"),
        spark.createDataFrame(parents, "digest string, created_at timestamp"),
        spark.createDataFrame(removed, "digest string"),
    )


def test_each_reason(spark):
    refs = [("t", "ok", "a", T1), ("t", "late", "b", T0), ("t", "untimed", "b", None), ("t", "gone", "c", T0), ("t", "never", "d", T0), ("t", "null", None, T0), ("t", "blank", "", T0), ("t", "ok", "a", T1)]
    got = {(r.record_id, r.reason) for r in orphan_references(*frames(spark, refs, [("a", T0), ("b", T1), ("b", T1), (None, T0)], [("c",), ("a",), (None,)])).collect()}
    assert got == {("late", "late"), ("gone", "deleted"), ("never", "missing"), ("blank", "missing")}


def test_hot_key_and_repeats(spark):
    refs = [("t", f"r{i}", "hot" if i % 3 else f"k{i}", T0) for i in range(900)]
    got = orphan_references(*frames(spark, refs * 2, [(f"k{i}", T0) for i in range(0, 900, 6)], []))
    assert got.count() == len({r[1] for r in refs if r[2] == "hot" or int(r[1][1:]) % 6})


def test_empty_tables(spark):
    assert orphan_references(*frames(spark, [], [], [])).count() == 0
    assert orphan_references(*frames(spark, [("t", "x", "a", None)], [], [])).first().reason == "missing"


def test_months(spark):
    rows = spark.createDataFrame([("t", "a", T0, "late"), ("t", "a", T0, "late"), ("t", "b", None, "late")], "table_name string, record_id string, at timestamp, reason string")
    assert {(r.month, r.orphans) for r in orphans_by_month(rows).collect()} == {("2024-01", 1), (None, 1)}


def test_spellings_of_digests(spark):
    d = "ab" * 32
    rows = spark.createDataFrame([(d,), (f" {d.upper()} ",), (f"sha256:{d}",), (f"SHA256: {d}\t",)], "x string")
    assert {r[0] for r in rows.select(clean_digest(F.col("x"))).collect()} == {d}
