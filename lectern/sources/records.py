"""JSON records of the workflow: citation files, tasks, benchmarks; and redaction by key."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CITATION = "segment_id string, segment_index int, object_sha256 string, source_name string, media_type string, kind string, locator map<string,string>, normalized_path string, normalized_sha256 string, text_sha256 string"
#: The fields of a task with their defaults; a query must be given.
TASK = {"schema_version": "1", "task": "cross-file-report", "query": None, "title": "Report", "output_name": "cross-file-report.docx", "max_sources": 8, "render": True, "model_policy": "disabled"}
LEAST_QUESTIONS = 20


def citation_files(files: DataFrame, number: int = 1) -> DataFrame:
    """The ``number``-th citation of each JSON file (a list, a list under ``retrieved_citations`` or
    ``sources``, or one object; each may wrap it as ``citation``): ``path``, ``citation``, ``error``.

    ``files`` has ``path`` and ``value``. A number below 1 is an error of the call; a file that is no
    JSON, or too short, is an error of its row.
    """
    if number < 1:
        raise ValueError("citation number must be at least 1")

    one = f"struct<{CITATION.replace(' string', ':string').replace(' int', ':int').replace(' map', ':map')}>"
    wrapped = f"array<struct<citation:{one},{one[7:-1]}>>"
    body = F.trim("value")
    text = F.when(body.startswith("["), body).otherwise(
        F.coalesce(F.get_json_object("value", "$.retrieved_citations"), F.get_json_object("value", "$.sources"), F.when(F.json_object_keys("value").isNotNull(), F.concat(F.lit("["), F.col("value"), F.lit("]"))))
    )
    rows = files.withColumn("list", F.from_json(text, wrapped)).withColumn("x", F.try_element_at("list", F.lit(number)))
    flat = F.struct(*(F.col(f"x.{c.split()[0]}") for c in CITATION.split(", ")))
    citation = F.when(F.col("x.citation").isNotNull(), F.col("x.citation")).when(F.col("x").isNotNull(), flat)
    error = F.when(F.col("list").isNull(), "not a citation file").when(F.col("x").isNull(), "citation number is out of range").when(citation["segment_id"].isNull(), "citation is invalid")
    return rows.select("path", F.when(error.isNull(), citation).alias("citation"), error.alias("error"))


def task(text: str) -> dict:
    """A task from its JSON text: unknown fields, other types and values out of range are errors."""
    try:
        given = json.loads(text)
    except json.JSONDecodeError as e:
        raise ValueError(f"task is not JSON: {e}") from e
    if not isinstance(given, dict) or set(given) - set(TASK):
        raise ValueError("task is no object, or has unknown fields")
    t = TASK | given
    types = all(type(t[k]) is type(v) for k, v in TASK.items() if v is not None)
    if not types or not isinstance(t["query"], str) or not t["query"].strip() or not 1 <= t["max_sources"] <= 50 or t["task"] != TASK["task"] or t["model_policy"] not in ("disabled", "configured-local"):
        raise ValueError("task has a field out of range")
    return t


FIXTURE = "fixture_id string, language string, ground_truth string, image_path string, source_kind string, expected_lines array<string>, tags array<string>, lawful_basis string, generation_method string"


def corpus_fixtures(files: DataFrame, private: bool = True) -> DataFrame:
    """The fixtures of corpus manifests: ``path``, the fields of each fixture, and ``error``, the first rule
    that it breaks (null if none).

    ``files`` has ``path`` and ``value``, JSON with ``schema_version`` 1 and ``fixtures``; a file that is none
    has one row with its error, one without fixtures none. Numbers are read as their texts. An id given
    twice in a file is an error of each of its fixtures; ``private`` ones have to say on which basis they
    are held and how they were made.
    """
    read = files.select("path", F.from_json("value", f"schema_version string, fixtures array<struct<{FIXTURE.replace(' string', ':string').replace(' array', ':array')}>>").alias("m"))
    sound = (F.col("m.schema_version") == "1") & F.col("m.fixtures").isNotNull()
    broken = read.where(~F.coalesce(sound, F.lit(False))).select("path", F.lit("not a manifest of version 1").alias("error"))
    rows = read.where(sound).select("path", F.inline("m.fixtures"))
    times = rows.where("fixture_id is not null").groupBy("path", "fixture_id").agg(F.count("*").alias("times"))
    rows = rows.join(times, ["path", "fixture_id"], "left")
    empty = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    error = None
    for c in ("fixture_id", "language", "ground_truth", "image_path", "source_kind"):
        what = F.lit(f"{c.replace('_', ' ')} is missing")
        error = F.when(empty(c), what) if error is None else error.when(empty(c), what)
    error = error.when(F.col("image_path").startswith("/") | F.array_contains(F.split("image_path", "/"), ".."), "image path leaves the corpus")
    error = error.when(F.coalesce((F.size("expected_lines") == 0) | F.exists("expected_lines", empty), F.lit(True)), "expected lines are missing")
    if private:
        error = error.when(empty("lawful_basis") | empty("generation_method"), "lawful basis and generation method are missing")
    error = error.when(F.col("times") > 1, "fixture id is given twice")
    return rows.withColumn("error", error).drop("times").unionByName(broken, allowMissingColumns=True)


def benchmark_errors(questions: DataFrame, corpus: DataFrame) -> DataFrame:
    """What is wrong with a benchmark: too few questions, ids given twice, sources that are not there."""
    few = questions.agg(F.countDistinct("question_id").alias("n")).where(F.col("n") < LEAST_QUESTIONS).select(F.lit("too few questions").alias("error"))
    twice = questions.groupBy("question_id").count().where("count > 1").select(F.concat(F.lit("question id given twice: "), "question_id").alias("error"))
    strange = questions.select(F.explode("expected").alias("source_name")).distinct().join(corpus.select("source_name").distinct(), "source_name", "left_anti").select(F.concat(F.lit("unknown source: "), "source_name").alias("error"))
    return few.unionByName(twice).unionByName(strange)


def redact(value, keys: frozenset[str], secrets: tuple[str, ...] = ()):
    """A JSON value with the values of private keys, given secrets and home paths replaced."""
    if isinstance(value, dict):
        return {k: "[redacted]" if k.casefold() in keys else redact(v, keys, secrets) for k, v in value.items()}
    if isinstance(value, list):
        return [redact(v, keys, secrets) for v in value]
    if isinstance(value, str):
        for s in filter(None, secrets):
            value = value.replace(s, "[redacted]")
        return re.sub(r"/(?:home|Users)/[^/\s]+/\S*", "[redacted-path]", value)
    return value


def redacted(rows: DataFrame, column: str, keys: tuple[str, ...], secrets: tuple[str, ...] = ()) -> DataFrame:
    """A JSON column redacted at any depth; what is no JSON is redacted as plain text."""
    private = frozenset(k.casefold() for k in keys)

    @F.pandas_udf(T.StringType())
    def clean(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            try:
                return json.dumps(redact(json.loads(t), private, secrets), ensure_ascii=False, sort_keys=True)
            except ValueError:
                return redact(t, private, secrets)

        return texts.map(one)

    return rows.withColumn(column, clean(F.col(column)))


def leaking(rows: DataFrame, column: str, forbidden: tuple[str, ...]) -> DataFrame:
    """Rows whose text still holds a forbidden value or a home path."""
    bad = F.col(column).rlike(r"/(?:home|Users)/[^\s/]+/")
    for f in forbidden:
        bad = bad | F.contains(F.col(column), F.lit(f))
    return rows.where(bad)


def pages_without_text(pages: DataFrame) -> DataFrame:
    """Pages that recognition has to read: numbers up to each document's count that have no text.

    ``pages`` has ``object_sha256``, ``page_count`` and ``pages_with_text`` (array).
    """
    every = F.when(F.col("page_count") > 0, F.sequence(F.lit(1), F.col("page_count"))).otherwise(F.array().cast("array<int>"))
    return pages.select("object_sha256", F.explode(F.array_except(every, F.coalesce("pages_with_text", F.array().cast("array<int>")))).alias("page"))


def recognition_languages(available: list[str], wanted: str = "") -> tuple[list[str], list[str]]:
    """Languages to recognise with, and wanted ones that are not there."""
    asked = [w.strip() for w in re.split(r"[,+]", wanted) if w.strip()]
    if asked:
        return asked, [w for w in asked if w not in available]
    urdu = next((u for u in ("urd_naw", "urd") if u in available), None)
    chosen = [x for x in ("eng", urdu, "ara") if x in available]
    return chosen or [x for x in available if x != "osd"][:1], []
