"""Plans of scoring retrieval, answers and recognised text, of grounding, and of text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.edits import similarity
from ..operators import citations, grounding, scores
from ..session import table


def _durations(spark, d):
    rows = table(spark, d, "processing_runs").where("started_at is not null and finished_at is not null").dropDuplicates(["processing_id"])
    return rows.select("processor", (F.unix_micros("finished_at") - F.unix_micros("started_at")).alias("micros"))


def upper_median_duration(spark, d):
    return scores.upper_medians(_durations(spark, d), "micros", "processor")


def failure_histogram(spark, d):
    rows = table(spark, d, "processing_runs").where("status = 'failed'").dropDuplicates(["processing_id"])
    return rows.groupBy("processor", F.coalesce("error", F.lit("none given")).alias("error")).agg(F.count("*").alias("failures"))


def mode_first_seen(spark, d):
    rows = table(spark, d, "processing_runs").where("started_at is not null").select("processing_id", "processor", "status", "started_at").distinct()
    return scores.mode_first(rows, "status", "started_at", "processor")


def _answers(spark, d):
    q = table(spark, d, "questions").dropDuplicates(["question_id"])
    return q.select("question_id", F.col("passage").alias("answer"), "facts", "forbidden", "expected_contradiction", "accept_insufficient", F.lit(0).alias("contradictions"), F.lit(0).alias("insufficient"))


def answer_scoring(spark, d):
    return scores.answers(_answers(spark, d), "question_id")


def trial_aggregate(spark, d):
    s = scores.answers(_answers(spark, d), "question_id")
    return s.agg(F.count("*").alias("questions"), F.round(F.avg("completeness"), 6).alias("mean_completeness"), F.count_if(F.col("completeness") == 1).alias("complete"), F.count_if("honest").alias("honest"), F.sum("forbidden_claims").alias("forbidden_claims"))


def _runs(spark, d):
    return scores.recognition(table(spark, d, "ocr_pairs").select("fixture_id", "language", "tags", "reference", "hypothesis", "elapsed", "peak_rss"), "fixture_id")


def ocr_metrics(spark, d):
    return _runs(spark, d).drop("tags")


def line_counts(spark, d):
    rows = table(spark, d, "ocr_pairs")
    seen = lambda c: F.size(F.filter(T.lines(F.coalesce(c, F.lit(""))), lambda x: T.strip(x) != ""))
    return rows.select("fixture_id", seen("reference").alias("reference_lines"), seen("hypothesis").alias("hypothesis_lines"), F.abs(F.col("observed_lines") - F.col("expected_lines")).alias("line_error"))


def char_counts(spark, d):
    rows = table(spark, d, "segments").dropDuplicates(["segment_id"])
    c = F.col("text")
    return rows.groupBy("kind").agg(
        F.sum(F.coalesce(F.length(c), F.lit(0))).alias("characters"),
        F.sum(T.count_class(c, T.ARABIC)).alias("arabic"),
        F.sum(T.count_class(c, r"[\x00-\x7f]")).alias("ascii"),
        F.sum(T.count_class(c, r"\x{FFFD}")).alias("replaced"),
        F.sum(T.count_class(c, r"[0-9]")).alias("digits"),
    )


def locator_format(spark, d):
    rows = table(spark, d, "segments").select("segment_id", "locator_json").distinct()
    return rows.select("segment_id", T.format_locator(F.col("locator_json")).alias("told"), T.format_locator_short(F.col("locator_json")).alias("short"))


def excerpt_180(spark, d):
    return table(spark, d, "segments").select("segment_id", T.excerpt(F.col("text")).alias("excerpt")).distinct()


def _raw_answers(spark, d):
    """Model answers made of the questions: fenced, bare, with strange ids, broken, by turns."""
    q = table(spark, d, "questions").select("question_id", "question").distinct()
    n = F.regexp_extract("question_id", r"(\d+)$", 1).cast("int") % 5
    body = F.to_json(F.struct(F.array(F.struct(F.col("question").alias("text"), F.when(n == 3, F.array(F.lit("CIT-9"), F.lit("X-1"))).otherwise(F.array(F.lit("CIT-1"))).alias("citation_ids"))).alias("paragraphs")))
    raw = F.when(n == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```"))).when(n == 1, F.concat(F.lit("Sure. "), body, F.lit(" Done."))).when(n == 2, F.lit("no json here")).when(n == 4, F.lit('{"paragraphs": [], "mood": "good"}')).otherwise(body)
    return q.select("question_id", raw.alias("raw"), F.array(F.lit("CIT-1"), F.lit("CIT-2")).alias("allowed_ids"))


def parsed_answers(spark, d):
    rows = grounding.parsed(_raw_answers(spark, d))
    return rows.select("question_id", "parse_error", F.size("citation_ids").alias("cited"), F.size(F.coalesce("response.paragraphs", F.from_json(F.lit("[]"), "array<struct<text:string,citation_ids:array<string>>>"))).alias("paragraphs"))


def unknown_citations(spark, d):
    rows = grounding.parsed(_raw_answers(spark, d))
    return citations.unknown(rows, rows.select("question_id", F.explode("allowed_ids").alias("citation_id")), "question_id")


def citation_structure(spark, d):
    return citations.structure(grounding.parsed(_raw_answers(spark, d)), "question_id")


def run_states(spark, d):
    rows = citations.structure(grounding.parsed(_raw_answers(spark, d)), "question_id").join(grounding.parsed(_raw_answers(spark, d)).select("question_id", "parse_error"), "question_id")
    return rows.select("question_id", grounding.state(True, F.lit(1), F.col("parse_error"), F.col("unknown") + F.col("malformed")).alias("state"))


def prompts(spark, d):
    from .evidence import _retrieved

    q, i, _, chosen = _retrieved(spark, d)
    ev = chosen.join(i.segments.select("segment_id", "locator_json", "text"), "segment_id")
    return grounding.prompts(q.dropDuplicates(["question_id"]), grounding.numbered(ev, "question_id", "evidence_no"), "question_id")


def external_links(spark, d):
    """References of documents made of their titles: to other hosts, within the document, to files."""
    n = F.col("doc_id") % 5
    href = F.when(n == 0, F.concat(F.lit("https://host-"), F.col("source"), F.lit("/"), F.coalesce("title", F.lit("")))).when(n == 1, F.concat(F.lit("#"), "title")).when(n == 2, F.concat(F.lit("//"), F.col("source"), F.lit("/x"))).when(n == 3, F.concat(F.lit("file:///"), "title")).otherwise(F.col("title"))
    rows = table(spark, d, "documents").select("source", href.alias("href"))
    return rows.where(T.is_external(F.col("href"))).groupBy("source").agg(F.count("*").alias("links"))


def ocr_tsv_lines(spark, d):
    """Recognised words laid out as an engine tells them, and put together again."""
    from ..sources.scan import tsv_lines

    words = table(spark, d, "ocr_pairs").where("hypothesis is not null").select("fixture_id", F.posexplode(T.lines(F.col("hypothesis"))).alias("row", "line")).select("fixture_id", "row", F.posexplode(F.split(T.collapse(F.col("line")), " ")).alias("at", "text"))
    page = F.regexp_extract("fixture_id", r"(\d+)$", 1).cast("int")
    tsv = words.select("fixture_id", F.lit(5).alias("level"), page.alias("page_num"), F.lit(1).alias("block_num"), F.lit(1).alias("par_num"), F.col("row").alias("line_num"), F.col("at").alias("word_num"), (F.col("at") * 50).alias("left"), (F.col("row") * 20).alias("top"), (F.length("text") * 8).alias("width"), F.lit(16).alias("height"), F.when(F.length("text") > 2, F.length("text").cast("double")).otherwise(-1.0).alias("conf"), "text")
    return tsv_lines(tsv, "fixture_id").select("fixture_id", "page_num", "line", "text", "x", "y", "width", "height", "confidence")


def normal_forms(spark, d):
    """How texts of Arabic script compare under each way of normalizing."""
    from ..functions.edits import MODES, normalized

    rows = table(spark, d, "ocr_pairs").where(F.col("language").isin("ara", "urd"))
    out = None
    for m in MODES:
        a, b = normalized(F.col("reference"), m), normalized(F.col("hypothesis"), m)
        part = rows.select("fixture_id", F.lit(m).alias("mode"), F.sha2(a, 256).alias("reference_sha256"), F.length(a).alias("reference_length"), (F.length(b) - F.length(a)).alias("length_delta"), F.round(similarity(a, b), 6).alias("ratio"))
        out = part if out is None else out.unionByName(part)
    return out


def benchmark_checks(spark, d):
    from ..sources.records import benchmark_errors

    return benchmark_errors(table(spark, d, "questions"), table(spark, d, "segments"))


_WHITE = "[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_LINE_ENDS = "\\r\\n|[\\n\\r\\x{0b}\\x{0c}\\x{1c}\\x{1d}\\x{1e}\\x{85}\\x{2028}\\x{2029}]"
_ARABIC = "[\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}\\x{08A0}-\\x{08FF}\\x{FB50}-\\x{FDFF}\\x{FE70}-\\x{FEFF}]"


def _collapsed(c: str) -> str:
    return f"trim(regexp_replace({c}, '{_WHITE}+', ' ', 'g'))"


def _lines(c: str) -> str:
    return f"len(list_filter(regexp_split_to_array(coalesce({c}, ''), '{_LINE_ENDS}'), lambda x: regexp_replace(x, '{_WHITE}+', '', 'g') <> ''))::int"


def _count(chars: str) -> str:
    return f"sum(coalesce(length(text) - length(regexp_replace(text, '{chars}', '', 'g')), 0))::bigint"


_KEYS = "[" + ", ".join(f"'{k}'" for k in T.LOCATOR_KEYS) + "]"
_ANS = "SELECT question_id, lower(coalesce(passage, '')) AS t, coalesce(facts, []) AS facts, coalesce(forbidden, []) AS forbidden, coalesce(expected_contradiction, false) AS c, coalesce(accept_insufficient, false) AS a FROM (SELECT DISTINCT ON (question_id) * FROM questions)"
_SCORED = f"s AS (SELECT question_id, len(facts)::int AS facts, len(list_filter(facts, lambda f: len(list_filter(f.terms, lambda x: contains(t, lower(x)))) = len(f.terms)))::int AS facts_met, len(list_filter(forbidden, lambda x: contains(t, lower(x))))::int AS forbidden_claims, NOT c AS contradiction_handled, (t = '' AND NOT a) AS silent FROM ({_ANS})), v AS (SELECT question_id, facts, facts_met, forbidden_claims, round(greatest(0.0::double, CASE WHEN facts = 0 THEN 1.0::double ELSE facts_met::double / facts END - CASE WHEN forbidden_claims > 0 THEN 0.25::double ELSE 0.0::double END), 6) AS completeness, forbidden_claims = 0 AND contradiction_handled AND NOT silent AS honest, contradiction_handled FROM s)"

_RAW = """raw AS (SELECT question_id, CASE n WHEN 0 THEN 'Here:' || chr(10) || '```json' || chr(10) || body || chr(10) || '```' WHEN 1 THEN 'Sure. ' || body || ' Done.' WHEN 2 THEN 'no json here' WHEN 4 THEN '{"paragraphs": [], "mood": "good"}' ELSE body END AS raw
  FROM (SELECT question_id, n, to_json({'paragraphs': [{'text': question, 'citation_ids': CASE WHEN n = 3 THEN ['CIT-9', 'X-1'] ELSE ['CIT-1'] END}]})::varchar AS body FROM (SELECT DISTINCT question_id, question, regexp_extract(question_id, '(\\d+)$', 1)::int % 5 AS n FROM questions))),
pay AS (SELECT question_id, CASE WHEN fenced <> '' THEN fenced WHEN bare <> '' THEN bare END AS payload FROM (SELECT question_id, regexp_extract(raw, '(?s)```(?:json)?\\s*(\\{.*?\\})\\s*```', 1) AS fenced, regexp_extract(raw, '(?s)(\\{.*\\})', 1) AS bare FROM raw)),
told AS (SELECT question_id, payload, CASE WHEN payload IS NULL THEN 'no json' WHEN NOT json_valid(payload) THEN 'malformed' WHEN len(list_filter(json_keys(payload), lambda k: NOT list_contains(['paragraphs', 'claims', 'insufficient_evidence', 'contradictions'], k))) > 0 THEN 'unknown keys' END AS parse_error FROM pay),
ids AS (SELECT question_id, parse_error, CASE WHEN parse_error IS NULL THEN coalesce(json_array_length(payload, '$.paragraphs'), 0) ELSE 0 END::int AS paragraphs, CASE WHEN parse_error IS NULL THEN list_distinct(list_concat(coalesce(json_extract_string(payload, '$.paragraphs[*].citation_ids[*]'), []), coalesce(json_extract_string(payload, '$.claims[*].citation_ids[*]'), []))) ELSE [] END AS cited FROM told)"""

QUERIES = {f.__name__: f for f in (upper_median_duration, failure_histogram, mode_first_seen, answer_scoring, trial_aggregate, ocr_metrics, line_counts, char_counts, locator_format, excerpt_180, parsed_answers, unknown_citations, citation_structure, run_states, prompts, external_links, ocr_tsv_lines, normal_forms, benchmark_checks)}
SQL = {
    "benchmark_checks": "SELECT 'too few questions' AS error FROM (SELECT count(DISTINCT question_id) AS n FROM questions) WHERE n < 20 UNION ALL SELECT 'question id given twice: ' || question_id FROM questions GROUP BY question_id HAVING count(*) > 1 UNION ALL SELECT 'unknown source: ' || s FROM (SELECT DISTINCT unnest(expected) AS s FROM questions) WHERE s NOT IN (SELECT source_name FROM segments WHERE source_name IS NOT NULL)",
    "ocr_tsv_lines": f"""
WITH l AS (SELECT fixture_id, i - 1 AS r, string_split({_collapsed('x[i]')}, ' ') AS w FROM (SELECT fixture_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT fixture_id, regexp_split_to_array(hypothesis, '{_LINE_ENDS}') AS x FROM ocr_pairs WHERE hypothesis IS NOT NULL))),
w AS (SELECT fixture_id, regexp_extract(fixture_id, '([0-9]+)$', 1)::int AS page_num, r, k - 1 AS n, w[k] AS text FROM (SELECT *, unnest(range(1, len(w) + 1)) AS k FROM l))
SELECT fixture_id, page_num, row_number() OVER (PARTITION BY fixture_id ORDER BY r)::int AS line, string_agg(text, ' ' ORDER BY n) AS text, (min(n) * 50)::int AS x, (r * 20)::int AS y, (max(n * 50 + length(text) * 8) - min(n) * 50)::int AS width, 16 AS height, round(avg(length(text)) FILTER (length(text) > 2), 3) AS confidence
FROM w WHERE text <> '' GROUP BY fixture_id, page_num, r""",
    "upper_median_duration": "SELECT processor, l[len(l) // 2 + 1] AS upper_median, len(l) AS n FROM (SELECT processor, list_sort(list(m)) AS l FROM (SELECT DISTINCT ON (processing_id) processor, epoch_us(finished_at) - epoch_us(started_at) AS m FROM processing_runs WHERE started_at IS NOT NULL AND finished_at IS NOT NULL) GROUP BY 1)",
    "failure_histogram": "SELECT processor, coalesce(error, 'none given') AS error, count(*) AS failures FROM (SELECT DISTINCT ON (processing_id) * FROM processing_runs WHERE status = 'failed') GROUP BY 1, 2",
    "mode_first_seen": "SELECT processor, c AS n, status AS mode FROM (SELECT processor, status, count(*) AS c, min(started_at) AS s FROM (SELECT DISTINCT processing_id, processor, status, started_at FROM processing_runs WHERE started_at IS NOT NULL AND status IS NOT NULL) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY processor ORDER BY c DESC, s, status DESC) = 1",
    "answer_scoring": f"WITH {_SCORED} SELECT * FROM v",
    "trial_aggregate": f"WITH {_SCORED} SELECT count(*) AS questions, round(avg(completeness), 6) AS mean_completeness, count(*) FILTER (completeness = 1) AS complete, count(*) FILTER (honest) AS honest, sum(forbidden_claims)::bigint AS forbidden_claims FROM v",
    "line_counts": f"SELECT fixture_id, {_lines('reference')} AS reference_lines, {_lines('hypothesis')} AS hypothesis_lines, abs(observed_lines - expected_lines) AS line_error FROM ocr_pairs",
    "char_counts": f"SELECT kind, sum(coalesce(length(text), 0))::bigint AS characters, {_count(_ARABIC)} AS arabic, {_count('[\\x00-\\x7f]')} AS ascii, {_count('\\x{FFFD}')} AS replaced, {_count('[0-9]')} AS digits FROM (SELECT DISTINCT ON (segment_id) * FROM segments) GROUP BY 1",
    "excerpt_180": f"SELECT DISTINCT segment_id, CASE WHEN length(t) <= 180 THEN t ELSE rtrim(substr(t, 1, 179)) || '…' END AS excerpt FROM (SELECT segment_id, {_collapsed('text')} AS t FROM segments)",
    "locator_format": f"""
WITH l AS (SELECT DISTINCT segment_id, locator_json FROM segments),
k AS (SELECT segment_id, locator_json, json_keys(locator_json) AS ks FROM l),
v AS (SELECT segment_id, ks, lambda_keys, locator_json FROM (SELECT *, list_concat(list_filter({_KEYS}, lambda x: list_contains(ks, x)), list_sort(list_filter(ks, lambda x: NOT list_contains({_KEYS}, x)))) AS lambda_keys FROM k))
SELECT segment_id,
  CASE WHEN ks IS NULL OR len(ks) = 0 THEN 'document' ELSE array_to_string(list_transform(lambda_keys, lambda x: replace(x, '_', ' ') || ' ' || coalesce(locator_json ->> ('$."' || x || '"'), 'null')), ', ') END AS told,
  CASE WHEN ks IS NULL OR len(ks) = 0 THEN 'source' ELSE array_to_string(list_transform(list_sort(ks), lambda x: x || ' ' || coalesce(locator_json ->> ('$."' || x || '"'), 'null')), ', ') END AS short
FROM v""",
    "unknown_citations": f"WITH {_RAW} SELECT question_id, c AS citation_id FROM (SELECT question_id, unnest(cited) AS c FROM ids) WHERE c NOT IN ('CIT-1', 'CIT-2')",
    "parsed_answers": f"WITH {_RAW} SELECT question_id, parse_error, len(cited)::int AS cited, paragraphs FROM ids",
    "citation_structure": f"WITH {_RAW} SELECT question_id, len(cited) = 0 AS missing, len(list_filter(cited, lambda c: NOT regexp_matches(c, '^CIT-[1-9][0-9]*$')))::int AS malformed, len(list_filter(cited, lambda c: regexp_matches(c, '^CIT-[1-9][0-9]*$') AND c NOT IN ('CIT-1', 'CIT-2')))::int AS unknown FROM ids",
    "run_states": f"WITH {_RAW} SELECT question_id, CASE WHEN parse_error IS NOT NULL OR len(list_filter(cited, lambda c: NOT regexp_matches(c, '^CIT-[1-9][0-9]*$') OR c NOT IN ('CIT-1', 'CIT-2'))) > 0 THEN 'partially_produced_but_invalid' ELSE 'succeeded' END AS state FROM ids",
    "external_links": "SELECT source, count(*) AS links FROM (SELECT source, CASE doc_id % 5 WHEN 0 THEN 'https://host-' || source || '/' || coalesce(title, '') WHEN 1 THEN '#' || title WHEN 2 THEN '//' || source || '/x' WHEN 3 THEN 'file:///' || title ELSE title END AS href FROM documents) WHERE regexp_matches(href, '^([a-zA-Z][a-zA-Z0-9+.-]*:|//)') GROUP BY 1",
}
