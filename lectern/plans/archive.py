"""Plans over the archive tables: references to objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.orphans import clean_digest, orphan_references, orphans_by_month
from ..session import table

#: table, id, time
REFERRERS = (
    ("ingestions", "ingestion_id", "imported_at"),
    ("processing_runs", "processing_id", "started_at"),
    ("segments", "segment_id", "indexed_at"),
)


def _references(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        table(spark, d, t).select(F.lit(t).alias("table_name"), F.col(i).alias("record_id"), clean_digest(F.col("object_sha256")).alias("digest"), F.col(at).alias("at"))
        for t, i, at in REFERRERS
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    parents = table(spark, d, "objects").select(clean_digest(F.col("sha256")).alias("digest"), "created_at")
    removed = table(spark, d, "removals").select(clean_digest(F.col("object_sha256")).alias("digest"))
    return orphan_references(_references(spark, d), parents, removed)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("table_name", "record_id", "reason").distinct()


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans_by_month(_orphans(spark, d))


_BLANK = "[\\s\u00a0\u3000\ufeff]"


def _clean(c: str) -> str:
    ends = f"'^{_BLANK}+|{_BLANK}+$'"
    return f"regexp_replace(regexp_replace(regexp_replace(lower({c}), {ends}, '', 'g'), '^sha256:', ''), {ends}, '', 'g')"


_P4 = f"""
WITH refs AS (
  {" UNION ALL ".join(f"SELECT '{t}' AS table_name, {i} AS record_id, {_clean('object_sha256')} AS digest, {at} AS moment FROM {t} WHERE object_sha256 IS NOT NULL" for t, i, at in REFERRERS)}),
o AS (SELECT {_clean('sha256')} AS digest, min(created_at) AS created_at FROM objects WHERE sha256 IS NOT NULL GROUP BY 1),
r AS (SELECT DISTINCT {_clean('object_sha256')} AS digest FROM removals WHERE object_sha256 IS NOT NULL),
found AS (
  SELECT DISTINCT table_name, record_id, moment,
    CASE WHEN o.digest IS NULL AND r.digest IS NOT NULL THEN 'deleted' WHEN o.digest IS NULL THEN 'missing' ELSE 'late' END AS reason
  FROM refs LEFT JOIN o USING (digest) LEFT JOIN r USING (digest)
  WHERE o.digest IS NULL OR o.created_at > refs.moment)
"""

QUERIES = {"p4_found": p4_found, "p4_report": p4_report}
SQL = {
    "p4_found": _P4 + "SELECT DISTINCT table_name, record_id, reason FROM found",
    "p4_report": _P4 + "SELECT table_name, strftime(moment AT TIME ZONE 'UTC', '%Y-%m') AS month, reason, count(DISTINCT record_id) AS orphans FROM found GROUP BY 1, 2, 3",
}
