"""Trials: engines over fixtures, questions end to end, repeated passages, report manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, is_blank
from . import scores


def engine_runs(fixtures: DataFrame, outputs: DataFrame, engines: tuple[str, ...]) -> DataFrame:
    """One row per fixture and engine: ``status`` is ``failed`` where an engine has no output, or a blank
    one; it then counts as an empty text.

    ``fixtures`` has ``fixture_id``, ``tags``, ``reference``; ``outputs`` has ``engine``, ``fixture_id``,
    ``hypothesis``, ``elapsed``, ``peak_rss``. Of several outputs of an engine for a fixture the first by
    text counts; outputs of other engines and for other fixtures are left out.
    """
    due = fixtures.dropDuplicates(["fixture_id"]).withColumn("engine", F.explode(F.array(*map(F.lit, engines))))
    one = outputs.where(F.col("engine").isin(*engines)).groupBy("engine", "fixture_id").agg(F.min(F.struct("hypothesis", "elapsed", "peak_rss")).alias("x")).select("engine", "fixture_id", "x.*")
    runs = due.join(one, ["engine", "fixture_id"], "left")
    return runs.withColumn("status", F.when(is_blank(F.col("hypothesis")), "failed").otherwise("succeeded")).withColumn("hypothesis", F.coalesce("hypothesis", F.lit("")))


def engine_ranking(runs: DataFrame) -> DataFrame:
    """Micro averages of each engine, its failures, and its ``place`` among those without any."""
    measured = scores.micro(scores.recognition(runs.drop("status"), "fixture_id"), "engine")
    failed = runs.groupBy("engine").agg(F.count_if(F.col("status") == "failed").alias("failed"))
    by = measured.join(failed, "engine")
    return scores.ranked(by, "engine", F.col("failed") == 0)


def question_trial(questions: DataFrame, retrieved: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Each question end to end: recall of its sources, completeness and honesty of its answer, and what
    failed first.

    ``retrieved`` has ``key`` and ``retrieved`` (source names in order); ``answers`` has ``key``,
    ``answer``, ``contradictions``, ``insufficient`` and ``bad_citations`` (counts). A question without
    either has retrieved nothing and answered nothing.
    """
    q = questions.dropDuplicates([key])
    found = scores.retrieval(q.select(key, "expected").join(retrieved, key, "left"), key).select(key, "recall", "irrelevant")
    told = q.select(key, "facts", "forbidden", "expected_contradiction", "accept_insufficient").join(answers, key, "left").fillna(0, ["contradictions", "insufficient", "bad_citations"])
    judged = scores.answers(told, key).join(told.select(key, (F.col("bad_citations") == 0).alias("citations_ok")), key)
    out = found.join(judged, key)
    return out.select(key, "recall", "irrelevant", "completeness", "honest", "citations_ok", scores.failure(F.col("recall"), F.col("citations_ok"), F.col("completeness"), F.col("honest")).alias("failure"))


def repeated_passages(selection: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Per selection: passages, different ones (by lower-case text with single blanks) and repeated ones.
    Null and blank passages do not count."""
    rows = selection.where(~is_blank(F.col(text))).select(key, F.sha2(F.lower(collapse(F.col(text))), 256).alias("digest"))
    per = rows.groupBy(key, "digest").agg(F.count("*").alias("c"))
    return per.groupBy(key).agg(F.sum("c").alias("passages"), F.count("*").alias("different"), (F.sum("c") - F.count("*")).alias("repeated"))


def report_manifest(report: DataFrame) -> DataFrame:
    """What a report consists of: per section its rows and a digest of their texts in order."""
    rows = F.array_sort(F.collect_list(F.struct("ordinal", "text")))
    return report.groupBy("section").agg(F.count("*").alias("rows"), F.sha2(F.array_join(F.transform(rows, lambda x: F.concat_ws("\t", x["ordinal"].cast("string"), F.coalesce(x["text"], F.lit("")))), "\n"), 256).alias("sha256"))


def unchanged(before: DataFrame, after: DataFrame, *columns: str) -> Column:
    """Whether two manifests are equal, as a scalar."""
    a, b = (df.select(*columns) for df in (before, after))
    return a.exceptAll(b).unionByName(b.exceptAll(a)).agg((F.count("*") == 0).alias("x")).scalar()
