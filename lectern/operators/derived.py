"""What is derived from segments: rows of sheets, previews, the state of transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import excerpt, is_blank


def table_rows(segments: DataFrame) -> DataFrame:
    """Rows of spreadsheets put together from their cells: ``object_sha256``, ``sheet``, ``row`` and ``cells``
    (column and text, in the order of the columns).

    A cell is known by the ``cell`` of its locator (``B7``) or its ``column`` and ``row`` numbers. Segments
    without either, blank cells and segments repeated in full take no part; a cell given twice keeps the
    text of its lowest segment number.
    """
    cell = F.get_json_object("locator_json", "$.cell")
    number = lambda k: F.get_json_object("locator_json", f"$.{k}").try_cast("int")
    column = F.coalesce(F.nullif(F.regexp_extract(cell, r"^([A-Z]+)[0-9]+$", 1), F.lit("")), number("column").cast("string"))
    row = F.coalesce(F.regexp_extract(cell, r"^[A-Z]+([0-9]+)$", 1).try_cast("int"), number("row"))
    rows = segments.where(~is_blank(F.col("text")) & F.col("object_sha256").isNotNull()).select(
        "object_sha256", F.get_json_object("locator_json", "$.sheet").alias("sheet"), column.alias("column"), row.alias("row"), "segment_index", "segment_id", "text"
    ).where("row is not null and column is not null")
    one = rows.groupBy("object_sha256", "sheet", "row", "column").agg(F.min(F.struct("segment_index", "segment_id", "text")).alias("x"))
    # a row of a sheet has at most as many cells as a sheet has columns
    cells = F.array_sort(F.collect_list(F.struct(F.length("column").alias("width"), "column", F.col("x.text").alias("text"))))
    return one.groupBy("object_sha256", "sheet", "row").agg(F.transform(cells, lambda c: F.struct(c["column"].alias("column"), c["text"].alias("text"))).alias("cells"))


def previews(segments: DataFrame, most: int = 180) -> DataFrame:
    """Per object how many segments have text, and the beginning of the first of them."""
    rows = segments.where(~is_blank(F.col("text")) & F.col("object_sha256").isNotNull()).dropDuplicates(["segment_id"])
    first = rows.groupBy("object_sha256").agg(F.count("*").alias("segments"), F.min(F.struct("segment_index", "segment_id", "text")).alias("x"))
    return first.select("object_sha256", "segments", excerpt(F.col("x.text"), most).alias("preview"))


def transcripts(objects: DataFrame, segments: DataFrame) -> DataFrame:
    """The state of the transcript of each sound file: ``available`` if it has segments with text, else
    ``not_available``."""
    sound = objects.where(F.col("media_type").startswith("audio/")).select("sha256").distinct()
    told = segments.where(~is_blank(F.col("text"))).select(F.col("object_sha256").alias("sha256"), F.lit(True).alias("told")).distinct()
    return sound.join(told, "sha256", "left").select("sha256", F.when(F.col("told"), "available").otherwise("not_available").alias("transcript"))
