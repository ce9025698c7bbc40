"""Plans of what is derived from segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import derived
from ..session import table
from .quality import _WHITE, _collapsed


def table_rows(spark, d):
    rows = derived.table_rows(table(spark, d, "segments"))
    told = F.array_join(F.transform("cells", lambda c: F.concat_ws("=", c["column"], c["text"])), " | ")
    return rows.select("object_sha256", "sheet", "row", F.size("cells").alias("cells"), F.sha2(told, 256).alias("digest"))


def previews(spark, d):
    return derived.previews(table(spark, d, "segments"))


def transcripts(spark, d):
    """Half of the objects taken for sound files."""
    objects = table(spark, d, "objects").select("sha256", F.when(F.ascii(F.right("sha256", F.lit(1))) % 2 == 0, "audio/wav").otherwise(F.col("media_type")).alias("media_type"))
    return derived.transcripts(objects, table(spark, d, "segments"))


_TEXT = f"text IS NOT NULL AND regexp_replace(text, '{_WHITE}+', '', 'g') <> ''"
QUERIES = {f.__name__: f for f in (table_rows, previews, transcripts)}
SQL = {
    "table_rows": f"""
WITH c AS (SELECT object_sha256, locator_json ->> '$.sheet' AS sheet, coalesce(nullif(regexp_extract(locator_json ->> '$.cell', '^([A-Z]+)[0-9]+$', 1), ''), try_cast(locator_json ->> '$.column' AS int)::varchar) AS col, coalesce(try_cast(regexp_extract(locator_json ->> '$.cell', '^[A-Z]+([0-9]+)$', 1) AS int), try_cast(locator_json ->> '$.row' AS int)) AS row, segment_index, segment_id, text FROM segments WHERE {_TEXT} AND object_sha256 IS NOT NULL),
o AS (SELECT * FROM c WHERE row IS NOT NULL AND col IS NOT NULL QUALIFY row_number() OVER (PARTITION BY object_sha256, sheet, row, col ORDER BY segment_index, segment_id) = 1)
SELECT object_sha256, sheet, row, count(*)::int AS cells, sha256(string_agg(col || '=' || text, ' | ' ORDER BY length(col), col)) AS digest FROM o GROUP BY 1, 2, 3""",
    "previews": f"SELECT object_sha256, segments, CASE WHEN length(t) <= 180 THEN t ELSE rtrim(substr(t, 1, 179)) || '…' END AS preview FROM (SELECT object_sha256, count(*) OVER (PARTITION BY object_sha256) AS segments, {_collapsed('text')} AS t, row_number() OVER (PARTITION BY object_sha256 ORDER BY segment_index, segment_id) AS n FROM (SELECT DISTINCT ON (segment_id) * FROM segments WHERE {_TEXT} AND object_sha256 IS NOT NULL)) WHERE n = 1",
    "transcripts": f"SELECT sha256, CASE WHEN sha256 IN (SELECT object_sha256 FROM segments WHERE {_TEXT} AND object_sha256 IS NOT NULL) THEN 'available' ELSE 'not_available' END AS transcript FROM (SELECT DISTINCT sha256 FROM objects WHERE CASE WHEN ascii(right(sha256, 1)) % 2 = 0 THEN 'audio/wav' ELSE media_type END LIKE 'audio/%')",
}
