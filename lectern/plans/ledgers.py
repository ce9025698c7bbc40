"""Plans over the ledgers: storing, duplicates, states, counts, snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ledger, snapshots
from ..session import table

ROOT, NEW_ROOT = "/import/batch-8", "/restored/batch-8"


def media_types(spark, d):
    rows = table(spark, d, "ingestions").dropDuplicates(["ingestion_id"])
    return rows.groupBy(T.suffix(F.col("source_name")).alias("suffix"), ledger.kind(F.col("source_name")).alias("kind"), ledger.media_type(F.col("source_name")).alias("media_type")).agg(F.count("*").alias("files"))


def dedupe_objects(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select(F.sha2("text", 256).alias("sha256"), "doc_id", F.octet_length("text").alias("size"))
    stored = table(spark, d, "objects").select("sha256")
    return ledger.new_content(rows, stored)


def duplicate_flags(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("sha256"), "received_at")
    return ledger.with_duplicates(rows, "sha256", "received_at", "doc_id").select("doc_id", "sha256", "duplicate")


def canonical_source_name(spark, d):
    return ledger.canonical_names(table(spark, d, "ingestions"))


def latest_ingestion(spark, d):
    rows = table(spark, d, "ingestions").where("object_sha256 is not null").select("object_sha256", "ingestion_id", "imported_at", "status").distinct()
    return ledger.latest(rows, "object_sha256", "imported_at", "ingestion_id").select("object_sha256", "ingestion_id", "status")


def ledger_violations(spark, d):
    a = ledger.violations("ingestions", table(spark, d, "ingestions").select("ingestion_id", "object_sha256", "status"), "ingestion_id")
    return a.unionByName(ledger.violations("processing_runs", table(spark, d, "processing_runs").select("processing_id", "object_sha256", "status"), "processing_id"))


def archive_status(spark, d):
    return ledger.archive_status(table(spark, d, "objects"), table(spark, d, "ingestions"), table(spark, d, "processing_runs"))


def run_status_counts(spark, d):
    return ledger.run_counts(table(spark, d, "processing_runs"))


def add_summary(spark, d):
    return ledger.add_summary(table(spark, d, "ingestions"))


def semi_succeeded(spark, d):
    return ledger.with_success(table(spark, d, "objects"), table(spark, d, "ingestions")).select("sha256", "size")


def orphan_ledger_rows(spark, d):
    runs = table(spark, d, "processing_runs").where("object_sha256 is not null").select("processing_id", F.col("object_sha256").alias("sha256"))
    return runs.join(table(spark, d, "objects").select("sha256"), "sha256", "left_anti").distinct()


def text_exports(spark, d):
    out = ledger.text_exports(table(spark, d, "segments").where("object_sha256 is not null").select("segment_id", "segment_index", "object_sha256", "text"), 200)
    return out.select("object_sha256", "part", "segments", F.sha2("text", 256).alias("text_sha256"))


def archive_member_diff(spark, d):
    declared = table(spark, d, "objects").select(F.col("storage_path").alias("path"), "size", "sha256")
    h = F.conv(F.substring("sha256", 1, 2), 16, 10).cast("int") % 10
    actual = declared.where(h != 0).select(F.when(h == 1, F.concat("path", F.lit(".new"))).otherwise(F.col("path")).alias("path"), F.when(h == 2, F.col("size") + 1).otherwise(F.col("size")).alias("size"), "sha256")
    return snapshots.differences(declared, actual, "path", "size", "sha256")


def snapshot_manifest(spark, d):
    rows = table(spark, d, "objects")
    return rows.select(F.col("storage_path").alias("path"), "size", "sha256").orderBy("path")


def restored_paths(spark, d):
    rows = table(spark, d, "ingestions").select("ingestion_id", "source_path").distinct()
    return rows.select("ingestion_id", T.relocate(F.col("source_path"), ROOT, NEW_ROOT).alias("source_path"))


def source_hash_diff(spark, d):
    before = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    after = table(spark, d, "documents").select("doc_id", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.upper("text")).otherwise(F.col("text")), 256).alias("digest"))
    return snapshots.differences(before, after, "doc_id", "digest")


def row_set_diff(spark, d):
    """What succeeded ingestions name against what the archive holds, as bags of digests."""
    a = table(spark, d, "ingestions").where("status = 'succeeded'").select("object_sha256")
    return snapshots.same_rows(a, table(spark, d, "objects").select(F.col("sha256").alias("object_sha256")))


def mapping_compare(spark, d):
    a = table(spark, d, "objects").select("sha256", T.suffix(F.col("source_extension")).alias("x"), F.lower("source_extension").alias("suffix")).drop("x")
    b = ledger.canonical_names(table(spark, d, "ingestions")).select(F.col("object_sha256").alias("sha256"), T.suffix(F.col("source_name")).alias("suffix"))
    return snapshots.compare_maps(a, b, "sha256", "suffix")


def redact_paths(spark, d):
    rows = table(spark, d, "ingestions").select("ingestion_id", F.concat(F.lit("read /home/"), F.coalesce("source_name", F.lit("x")), F.coalesce("source_path", F.lit("")), F.lit(" by key-1")).alias("message")).distinct()
    return rows.select("ingestion_id", T.redact(F.col("message"), ("key-1",)).alias("message"))


_MEDIA = ", ".join(f"('{s}', '{m}')" for s, m in ledger.MEDIA_TYPES.items())
_SUFFIX = "lower(regexp_extract(regexp_extract({}, '([^/]*)$', 1), '[^.](\\.[^.]+)$', 1))"
_NAMES = "SELECT object_sha256, arg_min(source_name, k) AS source_name FROM (SELECT *, struct_pack(a := imported_at IS NULL, b := coalesce(imported_at, timestamptz '1970-01-01'), c := ingestion_id) AS k FROM ingestions WHERE status = 'succeeded' AND object_sha256 IS NOT NULL) GROUP BY 1"
_DIFF = "SELECT {k}, CASE WHEN b.inb IS NULL THEN 'missing' WHEN a.ina IS NULL THEN 'unexpected' ELSE 'changed' END AS difference FROM a FULL JOIN b USING ({k}) WHERE a.ina IS NULL OR b.inb IS NULL OR {c}"

QUERIES = {f.__name__: f for f in (media_types, dedupe_objects, duplicate_flags, canonical_source_name, latest_ingestion, ledger_violations, archive_status, run_status_counts, add_summary, semi_succeeded, orphan_ledger_rows, text_exports, archive_member_diff, snapshot_manifest, restored_paths, source_hash_diff, row_set_diff, mapping_compare, redact_paths)}
SQL = {
    "media_types": f"WITH m AS (SELECT * FROM (VALUES {_MEDIA}) v(suffix, media_type)), i AS (SELECT DISTINCT ON (ingestion_id) coalesce({_SUFFIX.format('source_name')}, NULL) AS suffix FROM ingestions) SELECT i.suffix, CASE WHEN i.suffix IN ('.png', '.jpg', '.jpeg') THEN 'image' WHEN i.suffix = '.wav' THEN 'audio' WHEN i.suffix <> '' THEN substr(i.suffix, 2) END AS kind, media_type, count(*) AS files FROM i LEFT JOIN m USING (suffix) GROUP BY ALL",
    "dedupe_objects": "SELECT sha256, doc_id, size::int AS size FROM (SELECT sha256(text) AS sha256, doc_id, octet_length(encode(text)) AS size FROM documents WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1) x WHERE sha256 NOT IN (SELECT sha256 FROM objects)",
    "duplicate_flags": "SELECT doc_id, sha256(text) AS sha256, row_number() OVER (PARTITION BY sha256(text) ORDER BY received_at NULLS LAST, doc_id) > 1 AS duplicate FROM documents WHERE text IS NOT NULL",
    "canonical_source_name": _NAMES,
    "latest_ingestion": "SELECT object_sha256, ingestion_id, status FROM (SELECT DISTINCT object_sha256, ingestion_id, imported_at, status FROM ingestions WHERE object_sha256 IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY object_sha256 ORDER BY imported_at DESC NULLS LAST, ingestion_id DESC NULLS LAST) = 1",
    "ledger_violations": " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, {k} AS record_id, rule FROM (SELECT {k}, unnest(list_filter([CASE WHEN status IS NULL OR status NOT IN {s} THEN 'status' END, CASE WHEN object_sha256 IS NOT NULL AND NOT regexp_full_match(object_sha256, '[0-9a-f]{{64}}') THEN 'digest' END, CASE WHEN {k} IS NULL THEN 'key' END], lambda x: x IS NOT NULL)) AS rule FROM (SELECT DISTINCT {k}, object_sha256, status FROM {t}))"
        for t, k, s in (("ingestions", "ingestion_id", "('pending', 'succeeded', 'failed')"), ("processing_runs", "processing_id", "('succeeded', 'failed', 'skipped')"))
    ),
    "archive_status": "SELECT (SELECT count(DISTINCT sha256) FROM objects) AS objects, (SELECT count(DISTINCT ingestion_id) FROM ingestions) AS ingestions, (SELECT count(DISTINCT ingestion_id) FROM ingestions WHERE status = 'failed') AS failed_ingestions, (SELECT count(DISTINCT processing_id) FROM processing_runs) AS processing_runs, (SELECT count(DISTINCT processing_id) FROM processing_runs WHERE status = 'failed') AS failed_runs",
    "run_status_counts": "SELECT processor, status, count(DISTINCT processing_id) AS runs FROM processing_runs GROUP BY 1, 2",
    "add_summary": f"WITH i AS (SELECT DISTINCT ON (ingestion_id) coalesce(status = 'failed' OR {_SUFFIX.format('source_name')} NOT IN (SELECT s FROM (VALUES {_MEDIA}) v(s, m)), true) AS bad, coalesce(duplicate, false) AS dup FROM ingestions) SELECT count(*) FILTER (NOT bad AND NOT dup) AS added, count(*) FILTER (NOT bad AND dup) AS duplicates, count(*) FILTER (bad) AS skipped FROM i",
    "semi_succeeded": "SELECT sha256, size FROM objects WHERE sha256 IN (SELECT object_sha256 FROM ingestions WHERE status = 'succeeded')",
    "orphan_ledger_rows": "SELECT DISTINCT object_sha256 AS sha256, processing_id FROM processing_runs WHERE object_sha256 IS NOT NULL AND object_sha256 NOT IN (SELECT sha256 FROM objects)",
    "text_exports": "SELECT object_sha256, (segment_index // 200)::int AS part, count(*)::int AS segments, sha256(string_agg(text, chr(10) ORDER BY segment_index, segment_id)) AS text_sha256 FROM (SELECT DISTINCT ON (segment_id) * FROM segments WHERE object_sha256 IS NOT NULL AND text IS NOT NULL AND text <> '') GROUP BY 1, 2",
    "archive_member_diff": "WITH a AS (SELECT storage_path AS path, size, sha256, true AS ina FROM objects), b AS (SELECT CASE WHEN h = 1 THEN path || '.new' ELSE path END AS path, CASE WHEN h = 2 THEN size + 1 ELSE size END AS size, sha256, true AS inb FROM (SELECT *, ('0x' || substr(sha256, 1, 2))::int % 10 AS h FROM a) WHERE h <> 0) " + _DIFF.format(k="path", c="a.size IS DISTINCT FROM b.size OR a.sha256 IS DISTINCT FROM b.sha256"),
    "snapshot_manifest": "SELECT storage_path AS path, size, sha256 FROM objects",
    "restored_paths": f"SELECT ingestion_id, CASE WHEN starts_with(source_path, '{ROOT}/') OR source_path = '{ROOT}' THEN '{NEW_ROOT}' || substr(source_path, {len(ROOT) + 1}) ELSE source_path END AS source_path FROM (SELECT DISTINCT ingestion_id, source_path FROM ingestions)",
    "source_hash_diff": "SELECT doc_id, 'changed' AS difference FROM documents WHERE text IS NOT NULL AND doc_id % 7 = 0 AND upper(text) <> text",
    "row_set_diff": "WITH a AS (SELECT object_sha256 FROM ingestions WHERE status = 'succeeded'), b AS (SELECT sha256 AS object_sha256 FROM objects) (SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) UNION ALL (SELECT *, 'right' AS side FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))",
    "mapping_compare": f"WITH n AS ({_NAMES}), a AS (SELECT sha256, min(lower(source_extension)) AS x, true AS ina FROM objects GROUP BY 1), b AS (SELECT object_sha256 AS sha256, min({_SUFFIX.format('source_name')}) AS y, true AS inb FROM n GROUP BY 1) SELECT count(*) FILTER (ina AND inb) AS overlap, count(*) FILTER (ina AND inb AND x IS NOT DISTINCT FROM y) AS agree, count(*) FILTER (ina AND inb AND x IS DISTINCT FROM y) AS conflict, count(*) FILTER (inb IS NULL) AS left_only, count(*) FILTER (ina IS NULL) AS right_only FROM a FULL JOIN b USING (sha256)",
    "redact_paths": "SELECT ingestion_id, replace(regexp_replace('read /home/' || coalesce(source_name, 'x') || coalesce(source_path, '') || ' by key-1', '/(home|Users)/[^/\\s\"'']+', '<home>', 'g'), 'key-1', '<redacted>') AS message FROM (SELECT DISTINCT ingestion_id, source_name, source_path FROM ingestions)",
}
