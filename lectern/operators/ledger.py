"""The archive's ledgers: content-addressed storing, duplicates, states, counts, constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import is_digest, suffix

#: Formats that can be read, with the media types that are named outright.
FORMATS = """
.txt text/plain|.md text/markdown|.pdf application/pdf|.docx application/vnd.openxmlformats-officedocument.wordprocessingml.document|.xlsx application/vnd.openxmlformats-officedocument.spreadsheetml.sheet|.pptx application/vnd.openxmlformats-officedocument.presentationml.presentation
.odt application/vnd.oasis.opendocument.text|.ott application/vnd.oasis.opendocument.text-template|.odm application/vnd.oasis.opendocument.text-master|.otm application/vnd.oasis.opendocument.text-master-template
.ods application/vnd.oasis.opendocument.spreadsheet|.ots application/vnd.oasis.opendocument.spreadsheet-template|.odp application/vnd.oasis.opendocument.presentation|.otp application/vnd.oasis.opendocument.presentation-template
.odg application/vnd.oasis.opendocument.graphics|.otg application/vnd.oasis.opendocument.graphics-template|.odf application/vnd.oasis.opendocument.formula|.odb application/vnd.oasis.opendocument.base
.fodt text/xml|.fods text/xml|.fodp text/xml|.fodg text/xml|.inp application/x-inpage|.png image/png|.jpg image/jpeg|.jpeg image/jpeg|.wav audio/wav
"""
MEDIA_TYPES = dict(cell.split(" ") for line in FORMATS.strip().splitlines() for cell in line.split("|"))
STATES = {"ingestions": ("pending", "succeeded", "failed"), "processing_runs": ("succeeded", "failed", "skipped")}


def media_type(name: Column) -> Column:
    """The media type by a name's suffix; null for a format that cannot be read."""
    table = F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv])
    return F.try_element_at(table, suffix(name))


def kind(name: Column) -> Column:
    """The kind of a segment's document: its suffix without dot, but for images and sound."""
    s = suffix(name)
    return F.when(s.isin(".png", ".jpg", ".jpeg"), "image").when(s == ".wav", "audio").when(s != "", F.substring(s, 2, 16))


def new_content(incoming: DataFrame, stored: DataFrame, digest: str = "sha256") -> DataFrame:
    """Incoming rows whose content is not stored, once per digest: what a store has to append.

    The first row by the remaining columns is kept; null digests are left out.
    """
    others = [c for c in incoming.columns if c != digest]
    first = incoming.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.min(F.struct(*others)).alias("x")).select(digest, "x.*")
    return first.join(stored.select(digest).distinct(), digest, "left_anti")


def with_duplicates(rows: DataFrame, digest: str, *order: str) -> DataFrame:
    """``duplicate``: whether the same content came before, in the given order (nulls last)."""
    first = rows.groupBy(digest).agg(F.min(F.struct(*(F.struct(F.col(c).isNull(), F.col(c)) for c in order))).alias("first"))
    here = F.struct(*(F.struct(F.col(c).isNull(), F.col(c)) for c in order))
    return rows.join(first, digest).withColumn("duplicate", here != F.col("first")).drop("first")


def canonical_names(ingestions: DataFrame) -> DataFrame:
    """The name under which each object first came in with success, by time (nulls last) and id."""
    ok = ingestions.where((F.col("status") == "succeeded") & F.col("object_sha256").isNotNull())
    order = F.struct(F.col("imported_at").isNull(), "imported_at", "ingestion_id")
    return ok.groupBy("object_sha256").agg(F.min_by("source_name", order).alias("source_name"))


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key."""
    w = W.partitionBy(key).orderBy(*(F.col(c).desc_nulls_last() for c in order))
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def violations(table: str, rows: DataFrame, key: str) -> DataFrame:
    """Rows that break the ledger's constraints, one row per broken rule."""
    rules = {
        "status": ~F.coalesce(F.col("status").isin(*STATES[table]), F.lit(False)),
        "digest": F.col("object_sha256").isNotNull() & ~is_digest(F.col("object_sha256")),
        "key": F.col(key).isNull(),
    }
    broken = F.array_compact(F.array(*(F.when(cond, name) for name, cond in rules.items())))
    return rows.distinct().select(F.lit(table).alias("table_name"), F.col(key).alias("record_id"), F.explode(broken).alias("rule"))


def archive_status(objects: DataFrame, ingestions: DataFrame, runs: DataFrame) -> DataFrame:
    """Counts of an archive, one pass per table: one row."""
    a = objects.agg(F.countDistinct("sha256").alias("objects"))
    b = ingestions.agg(F.countDistinct("ingestion_id").alias("ingestions"), F.countDistinct(F.when(F.col("status") == "failed", F.col("ingestion_id"))).alias("failed_ingestions"))
    c = runs.agg(F.countDistinct("processing_id").alias("processing_runs"), F.countDistinct(F.when(F.col("status") == "failed", F.col("processing_id"))).alias("failed_runs"))
    return a.select("objects", *(x.select(n).scalar().alias(n) for x in (b, c) for n in x.columns))


def run_counts(runs: DataFrame) -> DataFrame:
    return runs.groupBy("processor", "status").agg(F.countDistinct("processing_id").alias("runs"))


def add_summary(ingestions: DataFrame) -> DataFrame:
    """New, duplicate and skipped (failed or unreadable) files: one row."""
    bad = (F.col("status") == "failed") | media_type(F.col("source_name")).isNull()
    rows = ingestions.dropDuplicates(["ingestion_id"])
    return rows.agg(
        F.count_if(~bad & ~F.coalesce("duplicate", F.lit(False))).alias("added"),
        F.count_if(~bad & F.coalesce("duplicate", F.lit(False))).alias("duplicates"),
        F.count_if(bad).alias("skipped"),
    )


def with_success(objects: DataFrame, ingestions: DataFrame) -> DataFrame:
    """Objects of which some ingestion succeeded."""
    ok = ingestions.where(F.col("status") == "succeeded").select(F.col("object_sha256").alias("sha256"))
    return objects.join(ok, "sha256", "left_semi")


def text_exports(segments: DataFrame, size: int = 1000) -> DataFrame:
    """The joined text of each object in parts of ``size`` segment numbers, so that no object, however
    large, is one group: ``object_sha256``, ``part``, ``segments``, ``text``. Empty segments are left
    out."""
    rows = segments.where(F.col("text").isNotNull() & (F.col("text") != "")).dropDuplicates(["segment_id"])
    rows = rows.withColumn("part", F.floor(F.col("segment_index") / size).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct("segment_index", "segment_id", "text")))
    return rows.groupBy("object_sha256", "part").agg(parts.alias("x")).select("object_sha256", "part", F.size("x").alias("segments"), F.array_join("x.text", "\n").alias("text"))
