"""Citations: exact references to segments, checked against what the archive holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import segment_id

#: What a citation says; the first two find the segment.
FIELDS = ("object_sha256", "segment_index", "segment_id", "source_name", "media_type", "kind", "locator_json", "normalized_path", "normalized_sha256", "text_sha256")


def normalized_path(digest):
    return F.concat(F.lit("derived/"), digest, F.lit("/normalized.json"))


def validate(citations: DataFrame, objects: DataFrame, documents: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """``key``, ``valid`` and ``errors`` of each citation, in the order of the checks.

    ``objects`` has ``sha256``, and ``content_sha256``, the digest of the bytes as they are now, if these are to
    be checked too; ``documents`` has the normalized documents (with ``document_object_sha256`` if what a
    document says it is of is to be checked): ``object_sha256``,
    ``source_name``, ``media_type``, ``kind``, ``normalized_sha256``, ``segment_count``; ``segments``
    has ``object_sha256``, ``segment_index``, ``locator_json``, ``text``. A missing document or a
    wrong document hash ends the checks, as does an index out of range. Null fields of a citation
    agree with nothing but null. Each citation is looked up by joins on keys; whatever the number of
    citations, no original is read twice.
    """
    docs = documents.select("object_sha256", *(F.col(c).alias(f"d_{c}") for c in ("source_name", "media_type", "kind", "normalized_sha256", "segment_count"))).withColumn("d_held", F.lit(True))
    now = F.min("content_sha256") if "content_sha256" in objects.columns else F.first("sha256")
    held = objects.groupBy(F.col("sha256").alias("object_sha256")).agg(now.alias("o_content")).withColumn("o_held", F.lit(True))
    says = F.col("document_object_sha256") if "document_object_sha256" in documents.columns else F.col("object_sha256")
    docs = docs.join(documents.select("object_sha256", says.alias("d_says")), "object_sha256") if "document_object_sha256" in documents.columns else docs.withColumn("d_says", says)
    segs = segments.select("object_sha256", "segment_index", F.col("locator_json").alias("s_locator"), F.sha2("text", 256).alias("s_text"))
    rows = citations.join(held, "object_sha256", "left").join(docs, "object_sha256", "left").join(segs, ["object_sha256", "segment_index"], "left")
    differs = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    told = lambda cond, text: F.when(F.coalesce(cond, F.lit(True)), text)
    first = [
        told(F.col("o_held").isNull(), "canonical original is missing"),
        F.when(F.col("o_held") & ~F.col("o_content").eqNullSafe(F.col("object_sha256")), "canonical original hash mismatch"),
        told(~F.col("normalized_path").eqNullSafe(normalized_path(F.col("object_sha256"))), "normalized path is not canonical for the object"),
    ]
    no_document = F.array(*first, F.lit("normalized document is missing"))
    other_document = F.array(*first, F.lit("normalized document hash mismatch"))
    about = [told(~F.col("d_says").eqNullSafe(F.col("object_sha256")), "normalized object digest mismatch")]
    about += [told(differs(c, f"d_{c}"), t) for c, t in (("source_name", "source name mismatch"), ("media_type", "media type mismatch"), ("kind", "kind mismatch"))]
    outside = F.array(*first, *about, F.lit("segment index is out of range"))
    expected = segment_id(F.col("object_sha256"), F.col("segment_index"), F.col("s_locator"), F.col("s_text"))
    rest = [
        told(differs("locator_json", "s_locator"), "segment locator mismatch"),
        told(differs("text_sha256", "s_text"), "segment text hash mismatch"),
        told(~expected.eqNullSafe(F.col("segment_id")), "segment identifier mismatch"),
    ]
    errors = (
        F.when(F.col("d_held").isNull(), no_document)
        .when(differs("normalized_sha256", "d_normalized_sha256"), other_document)
        .when(F.col("segment_index").isNull() | (F.col("segment_index") >= F.col("d_segment_count")) | F.col("s_text").isNull(), outside)
        .otherwise(F.array(*first, *about, *rest))
    )
    return rows.select(key, F.array_compact(errors).alias("errors")).withColumn("valid", F.size("errors") == 0)


def excerpts(valid: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """The texts of citations that passed validation."""
    return valid.where("valid").select(key).join(segments, key)


def locations(citations: DataFrame, objects: DataFrame) -> DataFrame:
    """Where the originals of cited objects lie; null for an object that is not held."""
    return citations.join(objects.select(F.col("sha256").alias("object_sha256"), "storage_path"), "object_sha256", "left")


def unknown(answers: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Cited ids that the evidence of an answer does not have: one row each."""
    cited = answers.select(key, F.explode("citation_ids").alias("citation_id")).distinct()
    return cited.join(allowed.select(key, "citation_id"), [key, "citation_id"], "left_anti")


def structure(answers: DataFrame, key: str) -> DataFrame:
    """Structural faults of the cited ids of answers: ``missing``, ``malformed``, ``unknown``."""
    ids = F.coalesce("citation_ids", F.array().cast("array<string>"))
    shape = lambda x: x.rlike("^CIT-[1-9][0-9]*$")
    bad = F.filter(ids, lambda x: ~F.coalesce(shape(x), F.lit(False)))
    strange = F.array_except(F.filter(ids, shape), F.col("allowed_ids"))
    return answers.select(key, (F.size(ids) == 0).alias("missing"), F.size(bad).alias("malformed"), F.size(strange).alias("unknown"))
