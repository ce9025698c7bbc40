"""Grounded answers: numbered evidence, prompt, strict parsing, report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import excerpt, format_locator, json_payload

RESPONSE = "paragraphs array<struct<text:string,citation_ids:array<string>>>, claims array<struct<text:string,citation_ids:array<string>>>, insufficient_evidence array<string>, contradictions array<string>"
#: The sections of a report, in order.
SECTIONS = ("Summary", "Findings", "Sources", "Evidence")


def numbered(evidence: DataFrame, key: str, *order: str) -> DataFrame:
    """Evidence with ``citation_id`` CIT-1, CIT-2, ... in the given order."""
    w = W.partitionBy(key).orderBy(*order)
    return evidence.withColumn("citation_no", F.row_number().over(w)).withColumn("citation_id", F.concat(F.lit("CIT-"), F.col("citation_no")))


def prompts(questions: DataFrame, evidence: DataFrame, key: str, text: str = "question") -> DataFrame:
    """The prompt of each question: the rules, the allowed ids in lexical order, the evidence."""
    line = F.concat(F.lit("["), F.col("citation_id"), F.lit("] "), F.coalesce("source_name", F.lit("?")), F.lit(" ("), format_locator(F.col("locator_json")), F.lit("): "), excerpt(F.col("text"), 400))
    packed = evidence.groupBy(key).agg(
        F.array_join(F.array_sort(F.collect_list("citation_id")), ", ").alias("allowed"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("citation_no", line.alias("line")))), lambda x: x["line"]), "\n").alias("evidence"),
    )
    rules = "Answer as one JSON object with paragraphs, claims, insufficient_evidence and contradictions. Cite with the allowed ids only."
    return questions.select(key, text).join(packed, key, "left").select(
        key,
        F.concat_ws("\n", F.lit(rules), F.concat(F.lit("Question: "), F.coalesce(text, F.lit(""))), F.concat(F.lit("Allowed ids: "), F.coalesce("allowed", F.lit("none"))), F.lit("Evidence:"), F.coalesce("evidence", F.lit("none"))).alias("prompt"),
    )


def parsed(answers: DataFrame, raw: str = "raw") -> DataFrame:
    """Answers read from a model's text: ``response`` (null if it cannot be read), ``citation_ids``
    and ``parse_error`` (``no json``, ``malformed``, ``unknown keys`` or null)."""
    payload = json_payload(F.col(raw))
    response = F.from_json(payload, RESPONSE, {"mode": "PERMISSIVE"})
    keys = F.json_object_keys(payload)
    known = F.array(*map(F.lit, ("paragraphs", "claims", "insufficient_evidence", "contradictions")))
    error = F.when(payload.isNull(), "no json").when(keys.isNull(), "malformed").when(F.size(F.array_except(keys, known)) > 0, "unknown keys")
    rows = answers.withColumn("parse_error", error).withColumn("response", F.when(error.isNull(), response))
    ids = lambda c: F.flatten(F.transform(F.coalesce(F.col(f"response.{c}"), F.from_json(F.lit("[]"), "array<struct<text:string,citation_ids:array<string>>>")), lambda p: F.coalesce(p["citation_ids"], F.array().cast("array<string>"))))
    return rows.withColumn("citation_ids", F.array_distinct(F.concat(ids("paragraphs"), ids("claims"))))


def state(model_enabled: bool, evidence: Column, parse_error: Column, strange: Column) -> Column:
    """The state of a run, by the first rule that fits."""
    if not model_enabled:
        return F.lit("blocked_by_policy")
    return F.when(evidence == 0, "succeeded").when(parse_error.isNotNull() | (strange > 0), "partially_produced_but_invalid").otherwise("succeeded")


def first_per_source(hits: DataFrame, most: int) -> DataFrame:
    """The best hit of each object, in rank order, at most ``most`` (1 to 50)."""
    if not 1 <= most <= 50:
        raise ValueError("a report has 1 to 50 sources")
    w = W.partitionBy("object_sha256").orderBy("rank", "segment_id")
    return hits.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n").orderBy("rank", "segment_id").limit(most)


def report(title: str, sources: DataFrame) -> DataFrame:
    """A report as rows ``section``, ``ordinal``, ``text``: what a document writer renders.

    ``sources`` has few rows by construction; they are numbered in rank order.
    """
    w = W.orderBy("rank", "segment_id")
    s = sources.withColumn("number", F.row_number().over(w))
    mark = F.concat(F.lit("["), F.col("number"), F.lit("]"))
    summary = s.agg(F.count("*").alias("n")).select(F.lit(SECTIONS[0]).alias("section"), F.lit(1).alias("ordinal"), F.concat(F.lit(f"{title}: "), F.col("n"), F.lit(" sources")).alias("text"))
    rows = [
        s.select(F.lit(SECTIONS[1]).alias("section"), F.col("number").alias("ordinal"), F.concat_ws(" ", excerpt(F.col("text")), mark).alias("text")),
        s.select(F.lit(SECTIONS[2]).alias("section"), F.col("number").alias("ordinal"), F.concat(mark, F.lit(" "), F.coalesce("source_name", F.lit("?")), F.lit(", "), format_locator(F.col("locator_json")), F.lit(", sha256 "), F.col("object_sha256")).alias("text")),
        s.select(F.lit(SECTIONS[3]).alias("section"), F.col("number").alias("ordinal"), F.col("text")),
    ]
    for r in rows:
        summary = summary.unionByName(r)
    return summary


def report_errors(rows: DataFrame) -> DataFrame:
    """What is wrong with a report: missing sections, findings without a mark, marks without source,
    gaps in the numbers. One row per error."""
    there = rows.agg(F.collect_set("section").alias("s"))
    missing = there.select(F.explode(F.array_except(F.array(*map(F.lit, SECTIONS)), F.col("s"))).alias("x")).select(F.concat(F.lit("section is missing: "), F.col("x")).alias("error"))
    findings = rows.where(F.col("section") == SECTIONS[1]).withColumn("marks", F.regexp_extract_all("text", F.lit(r"\[(\d+)\]"), F.lit(1)))
    bare = findings.where(F.size("marks") == 0).select(F.concat(F.lit("finding without citation: "), F.col("ordinal")).alias("error"))
    known = rows.where(F.col("section") == SECTIONS[2]).select(F.col("ordinal").cast("string").alias("mark"))
    strange = findings.select(F.explode("marks").alias("mark")).distinct().join(known, "mark", "left_anti").select(F.concat(F.lit("citation without source: "), F.col("mark")).alias("error"))
    gaps = rows.where(F.col("section") == SECTIONS[2]).agg((F.max("ordinal") != F.count("*")).alias("x")).where("x").select(F.lit("source numbers are not contiguous").alias("error"))
    return missing.unionByName(bare).unionByName(strange).unionByName(gaps)
