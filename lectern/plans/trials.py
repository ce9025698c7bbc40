"""Plans of trials: engines over fixtures, questions end to end, policies of sources, report manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths
from ..operators import grounding, scores, trial
from ..session import table
from .evidence import _ONE, PHRASE, _index
from .quality import _LINE_ENDS, _SCORED, _WHITE, _collapsed, _runs

ROOTS, KINDS = ("/import", "/restored"), ("txt", "md", "docx", "pdf", "odt")
ENGINES = ("first", "second", "third")


def cer_distance(spark, d):
    rows = table(spark, d, "ocr_pairs")
    from ..functions import text as T

    a, b = T.collapse(F.coalesce("reference", F.lit(""))), T.collapse(F.coalesce("hypothesis", F.lit("")))
    return rows.select("fixture_id", F.levenshtein(a, b).alias("distance"), F.length(a).alias("characters"))


def ocr_aggregate(spark, d):
    return scores.micro(_runs(spark, d), "language")


def route_best(spark, d):
    by = scores.micro(scores.routes(_runs(spark, d)), "route", "language")
    return by.groupBy("route").agg(F.min(F.struct("cer", "wer", "language")).alias("x")).select("route", F.col("x.language").alias("language"), F.col("x.cer").alias("cer"), F.col("x.wer").alias("wer"))


def _engine_runs(spark, d):
    """Three engines made of the scans: one as it is, one that takes e for c and leaves every seventh
    page out, one that knows the fixtures of one language only."""
    f = table(spark, d, "ocr_pairs")
    n = F.regexp_extract("fixture_id", r"(\d+)$", 1).cast("int")
    one = lambda name, text, rows: rows.select(F.lit(name).alias("engine"), "fixture_id", text.alias("hypothesis"), "elapsed", "peak_rss")
    outputs = one("first", F.col("hypothesis"), f).unionByName(one("second", F.replace(F.col("reference"), F.lit("e"), F.lit("c")), f.where(n % 7 != 0))).unionByName(one("third", F.col("hypothesis"), f.where("language = 'eng'")))
    return trial.engine_runs(f.select("fixture_id", "language", "tags", "reference"), outputs, ENGINES)


def engine_runs(spark, d):
    return _engine_runs(spark, d).select("engine", "fixture_id", "status", F.length("hypothesis").alias("characters"))


def candidate_ranking(spark, d):
    return trial.engine_ranking(_engine_runs(spark, d)).select("engine", "fixtures", "failed", "cer", "wer", "line_error_rate", "place")


def failure_categories(spark, d):
    """Questions whose retrieval misses a source for every second one, and whose answer is the passage,
    cut to its first half for every third and wrongly cited for every fifth."""
    q = table(spark, d, "questions").dropDuplicates(["question_id"])
    n = F.regexp_extract("question_id", r"(\d+)$", 1).cast("int")
    empty = F.array().cast("array<string>")
    retrieved = q.select("question_id", F.when(n % 2 == 0, F.slice(F.coalesce("expected", empty), 2, 100)).otherwise(F.coalesce("expected", empty)).alias("retrieved"))
    half = F.substring(F.col("passage"), F.lit(1), F.floor(F.length("passage") / 2).cast("int"))
    answers = q.select("question_id", F.when(n % 3 == 0, half).otherwise(F.col("passage")).alias("answer"), F.lit(0).alias("contradictions"), F.lit(0).alias("insufficient"), F.when(n % 5 == 0, 1).otherwise(0).alias("bad_citations"))
    return trial.question_trial(q, retrieved, answers, "question_id")


def repeated_passages(spark, d):
    rows = table(spark, d, "segments").where("object_sha256 is not null").dropDuplicates(["segment_id"])
    return trial.repeated_passages(rows, "object_sha256")


def _strange_paths(spark, d):
    """Paths of the ledger, some written with steps up, doubled slashes or no root."""
    h = F.conv(F.substring("ingestion_id", 1, 2), 16, 10).cast("int") % 6
    p, name = F.col("source_path"), F.coalesce("source_name", F.lit("x"))
    path = F.when(h == 1, F.concat(p, F.lit("/../x/../"), name)).when(h == 2, F.concat(F.lit("/import/../../etc/"), name)).when(h == 3, F.concat(F.lit("import/"), name)).when(h == 4, F.replace(p, F.lit("/import/"), F.lit("//import/./"))).otherwise(p)
    return table(spark, d, "ingestions").select("ingestion_id", "source_path", "source_name").distinct().select("ingestion_id", "source_name", path.alias("path"))


def bounded_paths(spark, d):
    rows = _strange_paths(spark, d)
    return rows.select("ingestion_id", paths.resolved(F.col("path")).alias("resolved"), paths.bounded(F.col("path"), ROOTS).alias("inside"))


def source_policy(spark, d):
    rows = _strange_paths(spark, d)
    why = paths.refusal(F.col("path"), F.col("source_name"), ROOTS, KINDS)
    return rows.groupBy(F.coalesce(why, F.lit("allowed")).alias("verdict")).agg(F.count("*").alias("sources"))


def pages_due(spark, d):
    """Pages of PDF files that have no text yet and wait for recognition."""
    from ..functions import text as T
    from ..sources.records import pages_without_text

    page = F.get_json_object("locator_json", "$.page").cast("int")
    rows = table(spark, d, "segments").where("kind = 'pdf' and object_sha256 is not null").select("object_sha256", page.alias("page"), (~T.is_blank(F.col("text"))).alias("filled")).where("page is not null")
    per = rows.groupBy("object_sha256").agg(F.max("page").alias("page_count"), F.collect_set(F.when(F.col("filled"), F.col("page"))).alias("pages_with_text"))
    return pages_without_text(per)


def leaks_left(spark, d):
    """Messages in which a private value or a home path is left; every third was not redacted."""
    from ..functions import text as T
    from ..sources.records import leaking

    h = F.conv(F.substring("ingestion_id", 1, 2), 16, 10).cast("int") % 3
    message = F.concat(F.lit("read /home/"), F.coalesce("source_name", F.lit("x")), F.coalesce("source_path", F.lit("")), F.lit(" by key-1"))
    rows = table(spark, d, "ingestions").select("ingestion_id", F.when(h == 0, message).otherwise(T.redact(message, ("key-1",))).alias("message")).distinct()
    return leaking(rows, "message", ("key-1",)).select("ingestion_id").distinct()


def corpus_fixtures(spark, d):
    """Manifests made of the scans, one a language, with a fault in five of seven fixtures."""
    from ..sources.records import corpus_fixtures as read

    n = F.regexp_extract("fixture_id", r"(\d+)$", 1).cast("int") % 7
    one = F.struct(
        "fixture_id", F.when(n == 1, " ").otherwise(F.col("language")).alias("language"), F.col("reference").alias("ground_truth"), F.when(n == 2, "scans/../../x.png").otherwise(F.concat(F.lit("scans/"), "fixture_id")).alias("image_path"),
        F.lit("own").alias("source_kind"), F.when(n == 3, F.array().cast("array<string>")).otherwise(F.array("reference")).alias("expected_lines"), F.when(n == 4, F.lit(None).cast("string")).otherwise("contract").alias("lawful_basis"), F.lit("scan").alias("generation_method"),
    )
    version = F.when(F.col("language") == "rus", "2").otherwise("1")
    files = table(spark, d, "ocr_pairs").groupBy(F.col("language").alias("path"), version.alias("schema_version")).agg(F.sort_array(F.collect_list(one)).alias("fixtures"))
    return read(files.select("path", F.to_json(F.struct("schema_version", "fixtures")).alias("value"))).select("path", "fixture_id", "error")


def _report(spark, d):
    from ..operators.search import search

    return grounding.report("Retention", grounding.first_per_source(search(_index(spark, d), PHRASE, None), 10))


def report_rows(spark, d):
    return _report(spark, d)


def report_manifest(spark, d):
    return trial.report_manifest(_report(spark, d))


def report_validation(spark, d):
    rows = _report(spark, d)
    broken = rows.where("not (section = 'Sources' and ordinal = 2)").withColumn("text", F.when((F.col("section") == "Findings") & (F.col("ordinal") == 3), F.lit("no mark")).otherwise(F.col("text"))).where("section <> 'Summary'")
    return grounding.report_errors(rows).select(F.lit("whole").alias("report"), "error").unionByName(grounding.report_errors(broken).select(F.lit("broken").alias("report"), "error"))


def redacted_locators(spark, d):
    from ..sources.records import redacted

    rows = redacted(table(spark, d, "segments").select("segment_id", "locator_json").distinct(), "locator_json", ("engine", "Sheet"))
    # without the blanks between keys and values
    return rows.select("segment_id", F.replace(F.replace("locator_json", F.lit('": '), F.lit('":')), F.lit(', "'), F.lit(',"')).alias("locator_json"))


def _edits(a: str, b: str) -> str:
    """The edit distance of two lists of strings: each different string of both becomes one character."""
    as_chars = lambda x: f"array_to_string(list_transform({x}, lambda v: chr(list_position(list_distinct(list_concat({a}, {b})), v)::int)), '')"
    return f"levenshtein({as_chars(a)}, {as_chars(b)})"


def _of(c: str, chars: str) -> str:
    return f"list_filter(string_split({c}, ''), lambda v: regexp_full_match(v, '\\p{{{chars}}}'))"


def _measured(pairs: str, *keep: str) -> str:
    """Edits and counts of pairs of ``reference`` and ``hypothesis``: what the aggregates are made of."""
    clean = lambda c: f"trim(regexp_replace(coalesce({c}, ''), '{_WHITE}+', ' ', 'g'))"
    lines = lambda c: f"list_transform(list_filter(regexp_split_to_array(coalesce({c}, ''), '{_LINE_ENDS}'), lambda v: regexp_replace(v, '{_WHITE}+', '', 'g') <> ''), lambda v: trim(regexp_replace(v, '{_WHITE}+', ' ', 'g')))"
    kept = ", ".join(keep)
    return f"""
t AS (SELECT {kept}, elapsed, peak_rss, {clean('reference')} AS a, {clean('hypothesis')} AS b, {lines('reference')} AS la, {lines('hypothesis')} AS lb FROM ({pairs})),
l AS (SELECT *, string_split(a, '') AS ca, string_split(b, '') AS cb, list_filter(string_split(a, ' '), lambda v: v <> '') AS wa, list_filter(string_split(b, ' '), lambda v: v <> '') AS wb, {_of('a', 'P')} AS pa, {_of('b', 'P')} AS pb, {_of('a', 'N')} AS na, {_of('b', 'N')} AS nb FROM t),
m AS (SELECT {kept}, elapsed, peak_rss, length(a) AS characters, len(wa) AS words, len(la) AS lines, len(pa) AS punctuation, len(na) AS numerals,
  {_edits('ca', 'cb')} AS ce, {_edits('wa', 'wb')} AS we, {_edits('la', 'lb')} AS le,
  round(CASE WHEN len(pa) = 0 THEN CASE WHEN len(pb) = 0 THEN 1.0::double ELSE 0.0::double END ELSE greatest(0.0::double, 1.0::double - {_edits('pa', 'pb')}::double / len(pa)) END, 6) AS pacc,
  round(CASE WHEN len(na) = 0 THEN CASE WHEN len(nb) = 0 THEN 1.0::double ELSE 0.0::double END ELSE greatest(0.0::double, 1.0::double - {_edits('na', 'nb')}::double / len(na)) END, 6) AS nacc FROM l)"""


def _ratio(a: str, b: str) -> str:
    return f"round(sum({a})::double / greatest(1, sum({b})), 6)"


_ROUTES = " UNION ALL ".join("SELECT '{}' AS route, [{}] AS need".format(n, ", ".join(f"'{t}'" for t in tags)) for n, tags in scores.ROUTES.items())
_N = "regexp_extract(fixture_id, '([0-9]+)$', 1)::int"
_DUE = f"""e AS (SELECT fixture_id, language, reference, unnest(['first', 'second', 'third']) AS engine FROM (SELECT DISTINCT ON (fixture_id) * FROM ocr_pairs)),
o AS (SELECT 'first' AS engine, fixture_id, hypothesis, elapsed, peak_rss FROM ocr_pairs UNION ALL SELECT 'second', fixture_id, replace(reference, 'e', 'c'), elapsed, peak_rss FROM ocr_pairs WHERE {_N} % 7 <> 0 UNION ALL SELECT 'third', fixture_id, hypothesis, elapsed, peak_rss FROM ocr_pairs WHERE language = 'eng'),
r AS (SELECT engine, fixture_id, reference, coalesce(hypothesis, '') AS hypothesis, elapsed, peak_rss, CASE WHEN hypothesis IS NULL OR regexp_replace(hypothesis, '{_WHITE}+', '', 'g') = '' THEN 'failed' ELSE 'succeeded' END AS status FROM e LEFT JOIN o USING (engine, fixture_id))"""
_Q = "regexp_extract(question_id, '([0-9]+)$', 1)::int"
_TRIAL = _SCORED.replace("lower(coalesce(passage, '')) AS t", f"lower(coalesce(CASE WHEN {_Q} % 3 = 0 THEN substr(passage, 1, length(passage) // 2) ELSE passage END, '')) AS t")
_PATHS = """p AS (SELECT ingestion_id, source_name, CASE h WHEN 1 THEN source_path || '/../x/../' || coalesce(source_name, 'x') WHEN 2 THEN '/import/../../etc/' || coalesce(source_name, 'x') WHEN 3 THEN 'import/' || coalesce(source_name, 'x') WHEN 4 THEN replace(source_path, '/import/', '//import/./') ELSE source_path END AS path
  FROM (SELECT DISTINCT ingestion_id, source_path, source_name, ('0x' || substr(ingestion_id, 1, 2))::int % 6 AS h FROM ingestions)),
s AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(path, '/\\./', '/', 'g'), '/+', '/', 'g'), '/[^/]+/\\.\\.(/|$)', '/'), '/[^/]+/\\.\\.(/|$)', '/'), '/[^/]+/\\.\\.(/|$)', '/') AS x FROM p),
q AS (SELECT *, CASE WHEN starts_with(path, '/') AND NOT contains(x, '/..') AND NOT starts_with(path, '/import/../../') THEN x END AS resolved FROM s),
i AS (SELECT *, coalesce(""" + " OR ".join(f"resolved = '{r}' OR starts_with(resolved, '{r}/')" for r in ROOTS) + ", false) AS inside FROM q)"
_CITED = f"""hit AS (SELECT *, row_number() OVER (ORDER BY rank, segment_id) AS number FROM (SELECT object_sha256, segment_id, hits.rank AS rank, source_name, locator_json, text FROM hits JOIN seg USING (segment_id) QUALIFY row_number() OVER (PARTITION BY object_sha256 ORDER BY hits.rank, segment_id) = 1) ORDER BY rank, segment_id LIMIT 10),
x AS (SELECT *, {_collapsed('text')} AS c, json_keys(locator_json) AS ks FROM hit),
rep AS (SELECT 'Summary' AS section, 1 AS ordinal, 'Retention: ' || count(*) || ' sources' AS text FROM x
  UNION ALL SELECT 'Findings', number, CASE WHEN length(c) <= 180 THEN c ELSE rtrim(substr(c, 1, 179)) || '…' END || ' [' || number || ']' FROM x
  UNION ALL SELECT 'Sources', number, '[' || number || '] ' || coalesce(source_name, '?') || ', ' || coalesce(told, 'document') || ', sha256 ' || object_sha256 FROM (SELECT x.*, (SELECT string_agg(replace(k, '_', ' ') || ' ' || coalesce(locator_json ->> ('$."' || k || '"'), 'null'), ', ' ORDER BY coalesce(list_position(KEYS, k), 99), k) FROM (SELECT unnest(ks) AS k)) AS told FROM x)
  UNION ALL SELECT 'Evidence', number, text FROM x)"""
_KEYS = "['page', 'paragraph', 'line', 'sheet', 'cell', 'slide', 'shape', 'bounding_box', 'timestamp_ms', 'start_ms', 'end_ms', 'metadata_chunk']"
_REPORT = f"WITH {_ONE}, {_CITED.replace('KEYS', _KEYS)}"
_BROKEN = "b AS (SELECT section, ordinal, CASE WHEN section = 'Findings' AND ordinal = 3 THEN 'no mark' ELSE text END AS text FROM rep WHERE NOT (section = 'Sources' AND ordinal = 2) AND section <> 'Summary')"


def _faults(of: str, name: str) -> str:
    return f"""SELECT '{name}' AS report, 'section is missing: ' || s AS error FROM (SELECT unnest(['Summary', 'Findings', 'Sources', 'Evidence']) AS s) WHERE s NOT IN (SELECT section FROM {of})
UNION ALL SELECT '{name}', 'finding without citation: ' || ordinal FROM {of} WHERE section = 'Findings' AND NOT regexp_matches(text, '\\[\\d+\\]')
UNION ALL SELECT '{name}', 'citation without source: ' || m FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '\\[(\\d+)\\]', 1)) AS m FROM {of} WHERE section = 'Findings') WHERE m NOT IN (SELECT ordinal::varchar FROM {of} WHERE section = 'Sources')
UNION ALL SELECT '{name}', 'source numbers are not contiguous' FROM (SELECT max(ordinal) AS o, count(*) AS c FROM {of} WHERE section = 'Sources') WHERE o <> c"""


QUERIES = {f.__name__: f for f in (cer_distance, ocr_aggregate, route_best, engine_runs, candidate_ranking, failure_categories, repeated_passages, bounded_paths, source_policy, pages_due, leaks_left, corpus_fixtures, report_rows, report_manifest, report_validation, redacted_locators)}
SQL = {
    "cer_distance": "WITH " + _measured("SELECT * FROM ocr_pairs", "fixture_id") + " SELECT fixture_id, ce::int AS distance, characters::int AS characters FROM m",
    "ocr_aggregate": "WITH " + _measured("SELECT * FROM ocr_pairs", "fixture_id", "language") + f" SELECT language, count(*) AS fixtures, {_ratio('ce', 'characters')} AS cer, {_ratio('we', 'words')} AS wer, {_ratio('le', 'lines')} AS line_error_rate, {_ratio('pacc * punctuation', 'punctuation')} AS punctuation_accuracy, {_ratio('nacc * numerals', 'numerals')} AS numeral_accuracy, round(coalesce(sum(elapsed), 0), 6) AS elapsed, max(peak_rss) AS peak_rss FROM m GROUP BY 1",
    "route_best": "WITH " + _measured("SELECT * FROM ocr_pairs", "fixture_id", "language", "tags") + f", rt AS ({_ROUTES}), g AS (SELECT route, language, {_ratio('ce', 'characters')} AS cer, {_ratio('we', 'words')} AS wer FROM m JOIN rt ON list_has_all(coalesce(tags, []), need) GROUP BY 1, 2) SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY route ORDER BY cer, wer, language) = 1",
    "engine_runs": f"WITH {_DUE} SELECT engine, fixture_id, status, length(hypothesis)::int AS characters FROM r",
    "candidate_ranking": f"WITH {_DUE}, " + _measured("SELECT * FROM r", "engine", "status") + f", g AS (SELECT engine, count(*) AS fixtures, count(*) FILTER (status = 'failed') AS failed, {_ratio('ce', 'characters')} AS cer, {_ratio('we', 'words')} AS wer, {_ratio('le', 'lines')} AS line_error_rate, round(coalesce(sum(elapsed), 0), 6) AS elapsed FROM m GROUP BY 1) SELECT engine, fixtures, failed, cer, wer, line_error_rate, CASE WHEN failed = 0 THEN row_number() OVER (PARTITION BY failed = 0 ORDER BY cer, wer, line_error_rate, elapsed, engine)::int END AS place FROM g",
    "failure_categories": f"""WITH {_TRIAL},
k AS (SELECT question_id, n, list_distinct(e) AS want, CASE WHEN n % 2 = 0 THEN e[2:] ELSE e END AS got FROM (SELECT DISTINCT ON (question_id) question_id, coalesce(expected, []) AS e, {_Q} AS n FROM questions)),
f AS (SELECT question_id, round(CASE WHEN len(want) = 0 THEN 1.0::double ELSE len(list_intersect(want, got))::double / len(want) END, 6) AS recall, len(list_filter(list_distinct(got), lambda v: NOT list_contains(want, v)))::int AS irrelevant, n % 5 <> 0 AS citations_ok FROM k)
SELECT question_id, recall, irrelevant, completeness, honest, citations_ok, CASE WHEN recall < 1 THEN 'query construction' WHEN NOT citations_ok THEN 'citation' WHEN completeness < 1 THEN 'incomplete answer' WHEN NOT honest THEN 'dishonest answer' ELSE 'none' END AS failure FROM f JOIN v USING (question_id)""",
    "repeated_passages": f"SELECT object_sha256, sum(c)::bigint AS passages, count(*) AS different, (sum(c) - count(*))::bigint AS repeated FROM (SELECT object_sha256, lower({_collapsed('text')}) AS t, count(*) AS c FROM (SELECT DISTINCT ON (segment_id) * FROM segments WHERE object_sha256 IS NOT NULL) WHERE text IS NOT NULL AND regexp_replace(text, '{_WHITE}+', '', 'g') <> '' GROUP BY 1, 2) GROUP BY 1",
    "bounded_paths": f"WITH {_PATHS} SELECT ingestion_id, resolved, inside FROM i",
    "source_policy": f"WITH {_PATHS} SELECT CASE WHEN path IS NULL THEN 'no path' WHEN NOT inside THEN 'outside the allowed folders' WHEN coalesce(lower(regexp_extract(source_name, '[^./]\\.([^./]+)$', 1)), '') NOT IN ({', '.join(repr(k) for k in KINDS)}) THEN 'kind is not allowed' ELSE 'allowed' END AS verdict, count(*) AS sources FROM i GROUP BY 1",
    "pages_due": f"WITH p AS (SELECT object_sha256, (locator_json ->> '$.page')::int AS page, text IS NOT NULL AND regexp_replace(text, '{_WHITE}+', '', 'g') <> '' AS filled FROM segments WHERE kind = 'pdf' AND object_sha256 IS NOT NULL AND (locator_json ->> '$.page') IS NOT NULL), e AS (SELECT object_sha256, unnest(range(1, max(page) + 1))::int AS page FROM p GROUP BY 1) SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM p WHERE filled AND p.object_sha256 = e.object_sha256 AND p.page = e.page)",
    "leaks_left": "SELECT DISTINCT ingestion_id FROM ingestions WHERE ('0x' || substr(ingestion_id, 1, 2))::int % 3 = 0",
    "corpus_fixtures": f"SELECT language AS path, fixture_id, CASE {_N} % 7 WHEN 1 THEN 'language is missing' WHEN 2 THEN 'image path leaves the corpus' WHEN 3 THEN 'expected lines are missing' WHEN 4 THEN 'lawful basis and generation method are missing' END AS error FROM ocr_pairs WHERE language <> 'rus' UNION ALL SELECT DISTINCT 'rus', NULL::varchar, 'not a manifest of version 1' FROM ocr_pairs WHERE language = 'rus'",
    "report_rows": f"{_REPORT} SELECT section, ordinal::int AS ordinal, text FROM rep",
    "report_manifest": f"{_REPORT} SELECT section, count(*) AS rows, sha256(string_agg(ordinal || chr(9) || coalesce(text, ''), chr(10) ORDER BY ordinal, text)) AS sha256 FROM rep GROUP BY 1",
    "report_validation": f"{_REPORT}, {_BROKEN} {_faults('rep', 'whole')} UNION ALL {_faults('b', 'broken')}",
    "redacted_locators": "SELECT DISTINCT segment_id, CASE WHEN locator_json IS NULL THEN NULL ELSE '{' || coalesce((SELECT string_agg(to_json(k)::varchar || ':' || CASE WHEN lower(k) IN ('engine', 'sheet') THEN '\"[redacted]\"' ELSE json_extract(locator_json, '$.\"' || k || '\"')::varchar END, ',' ORDER BY k) FROM (SELECT unnest(json_keys(locator_json)) AS k)), '') || '}' END AS locator_json FROM segments",
}
