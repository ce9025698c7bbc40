"""Plans of segmenting, indexing, searching, retrieving and citing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import citations, grounding, retrieval, search
from ..session import cut, stamp, table

PHRASE, COMMON, LONG = "retention rule", "the", "and the shelf mark was changed"
PHRASES = ("retention rule", "shelf mark", "procès-verbal de réception", "the the", "review panel", "nach zweiter Lesung", "?!", "site engineer", "re-sealed")
#: A question as literal variants, with weights.
LITERAL = ((0, "humidity chart", 120), (1, "retention rule", 80), (2, "harbour", 60), (3, "site engineer", 60), (4, "spring audit", 90))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "segments")


#: Indexes written in this application, by the state of the table that they are of.
_built: dict[tuple, search.Index] = {}


def _index(spark: SparkSession, d: str) -> search.Index:
    """The index of a folder's segments, built once for an application and read from disk from then on."""
    key = (spark.sparkContext.applicationId, *stamp(spark, f"{d}/segments.parquet"))
    if key not in _built:
        rows = _segments(spark, d).select("segment_id", "segment_index", "object_sha256", "source_name", "media_type", "kind", "locator_json", "text")
        _built[key] = search.Index.build(rows)
    return _built[key]


def segment_lines(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("pos", "line")).where("line <> ''")
    return rows.select("doc_id", (F.col("pos") + 1).alias("line_no"), F.to_json(F.struct((F.col("pos") + 1).alias("line"))).alias("locator_json"), F.sha2("line", 256).alias("text_sha256"))


def blank_filter(spark, d):
    rows = _segments(spark, d).dropDuplicates(["segment_id"])
    return rows.groupBy("kind").agg(F.count_if(T.is_blank(F.col("text"))).alias("blank"), F.count_if(~T.is_blank(F.col("text"))).alias("kept"))


def segment_ids(spark, d):
    rows = _segments(spark, d).where("text is not null and object_sha256 is not null and locator_json is not null")
    made = T.segment_id(F.col("object_sha256"), F.col("segment_index"), F.col("locator_json"), F.sha2("text", 256))
    return rows.select("segment_id", made.alias("computed_id"), F.sha2("text", 256).alias("text_sha256")).distinct()


def token_counts(spark, d):
    return _index(spark, d).segments.select("segment_id", "dl", F.sha2(F.array_join(T.tokens(F.col("text")), " "), 256).alias("tokens_sha256"))


def index_stats(spark, d):
    i = _index(spark, d)
    return i.segments.agg(F.count("*").alias("n"), F.sum("dl").alias("total_tokens"), F.round(F.avg("dl"), 6).alias("average"), F.countDistinct("object_sha256").alias("objects"))


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("segment_id", "source_name", "locator_json", "tf", F.round("rank", 6).alias("rank"))


def phrase_search_topk(spark, d):
    return _shown(search.search(_index(spark, d), PHRASE, 20))


def phrase_search_filtered(spark, d):
    return _shown(search.search(_index(spark, d), PHRASE, 50, kind="docx", media_type="application/vnd.openxmlformats-officedocument.wordprocessingml.document"))


def bm25_all(spark, d):
    return _index(spark, d).match(search.phrases_of(spark, *PHRASES, COMMON, LONG)).select("phrase", "segment_id", "tf", "df", F.round("rank", 6).alias("rank"))


def _variants(spark) -> DataFrame:
    return spark.createDataFrame([("q", n, p, w) for n, p, w in LITERAL], "question_id string, variant_no int, phrase string, weight int")


def variant_positions(spark, d):
    return search.positions(_index(spark, d).match(search.phrases_of(spark, *PHRASES)), 40).select("phrase", "segment_id", "position", F.round("rank", 6).alias("rank"))


def _literal_hits(spark, d):
    i = _index(spark, d)
    return i, retrieval.found(i, _variants(spark), columns=("object_sha256", "source_name", "text"))


def source_scores(spark, d):
    return retrieval.source_scores(_literal_hits(spark, d)[1], "question_id").select("object_sha256", F.round("score", 6).alias("score"))


def best_passage(spark, d):
    return retrieval.best_passages(_literal_hits(spark, d)[1], "question_id").select("object_sha256", "segment_id", "variant_no", "position", F.round("value", 6).alias("value"))


def retrieve_evidence_topk(spark, d):
    return retrieval.retrieve(_index(spark, d), _variants(spark)).select("evidence_no", "segment_id", "source_name", "score", F.array_join("matched", "|").alias("matched"))


def query_variants(spark, d):
    return retrieval.variants(table(spark, d, "questions"))


def _retrieved(spark, d):
    q = table(spark, d, "questions")
    i = _index(spark, d)
    asked = cut(retrieval.variants(q))
    return q, i, asked, retrieval.retrieve(i, asked)


def retrieve_questions(spark, d):
    return _retrieved(spark, d)[3]


def retrieval_diagnostics(spark, d):
    q, i, asked, chosen = _retrieved(spark, d)
    return retrieval.diagnostics(q, asked, retrieval.found(i, asked), chosen)


def retrieval_recall(spark, d):
    from ..operators import scores

    q, _, _, chosen = _retrieved(spark, d)
    got = chosen.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("evidence_no", "source_name"))), lambda x: x["source_name"]).alias("retrieved"))
    return scores.retrieval(q.select("question_id", "expected").distinct().join(got, "question_id", "left"), "question_id")


def distinct_source_topk(spark, d):
    hits = search.search(_index(spark, d), PHRASE, None)
    return grounding.first_per_source(hits, 10).select("object_sha256", "segment_id", F.round("rank", 6).alias("rank"))


def _citations(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Citations of all stored segments, some damaged by rule: each check meets wrong ones."""
    rows = _segments(spark, d).where("object_sha256 is not null and text is not null").dropDuplicates(["segment_id"])
    segs = rows.groupBy("object_sha256", "segment_index").agg(F.min(F.struct("segment_id", "locator_json", "text", "source_name", "media_type", "kind", "normalized_path", "normalized_sha256")).alias("x")).select("object_sha256", "segment_index", "x.*")
    docs = segs.groupBy("object_sha256").agg(F.min("source_name").alias("source_name"), F.min("media_type").alias("media_type"), F.min("kind").alias("kind"), F.min("normalized_sha256").alias("normalized_sha256"), (F.max("segment_index") + 1).alias("segment_count"))
    cites = segs.withColumn("citation", F.col("segment_id")).withColumn("segment_id", T.segment_id(F.col("object_sha256"), F.col("segment_index"), F.col("locator_json"), F.sha2("text", 256))).withColumn("text_sha256", F.sha2("text", 256))
    h = F.conv(F.substring("citation", 1, 2), 16, 10).cast("int") % 16
    cites = (
        cites.withColumn("text_sha256", F.when(h == 1, F.sha2("source_name", 256)).otherwise(F.col("text_sha256")))
        .withColumn("segment_index", F.when(h == 2, F.col("segment_index") + 100000).otherwise(F.col("segment_index")))
        .withColumn("source_name", F.when(h == 3, F.lit("other.txt")).otherwise(F.col("source_name")))
        .withColumn("normalized_path", F.when(h == 4, F.lit("derived/other.json")).otherwise(F.col("normalized_path")))
        .withColumn("locator_json", F.when(h == 5, F.lit("{}")).otherwise(F.col("locator_json")))
        .withColumn("normalized_sha256", F.when(h == 6, F.lit("0")).otherwise(F.col("normalized_sha256")))
    )
    # bytes that changed on disk, and documents of another object, by the last character of the digest
    last = lambda c: F.ascii(F.right(c, F.lit(1))) % 16
    objects = table(spark, d, "objects").withColumn("content_sha256", F.when(last(F.col("sha256")) == 7, F.sha2("sha256", 256)).otherwise(F.col("sha256")))
    docs = docs.withColumn("document_object_sha256", F.when(last(F.col("object_sha256")) == 3, F.lit("other")).otherwise(F.col("object_sha256")))
    return cites.select("citation", *citations.FIELDS), objects, docs, segs


def citation_validate(spark, d):
    cites, objects, docs, segs = _citations(spark, d)
    return citations.validate(cites, objects, docs, segs, "citation").select(F.col("citation"), "valid", F.array_join("errors", "; ").alias("errors"))


def source_locations(spark, d):
    cites = _segments(spark, d).where("object_sha256 is not null").select("segment_id", "object_sha256").distinct()
    return citations.locations(cites, table(spark, d, "objects"))


#: Letters with one accent and what is left without it, told by DuckDB's own rules.
_FOLD = "fold AS (SELECT string_agg(c, '' ORDER BY i) AS f, string_agg(strip_accents(c), '' ORDER BY i) AS t FROM (SELECT i, chr(i::int) AS c FROM range(192, 592) r(i)) WHERE lower(c) = c AND strip_accents(c) <> c AND regexp_full_match(strip_accents(c), '[a-z]'))"
_TOK = "regexp_extract_all(translate(lower(text), (SELECT f FROM fold), (SELECT t FROM fold)), '[\\p{L}\\p{N}\\p{Co}]+')"
_W = "[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_SEG = f"{_FOLD}, seg AS (SELECT *, len(tokens) AS dl FROM (SELECT DISTINCT ON (segment_id) *, {_TOK} AS tokens FROM segments WHERE segment_id IS NOT NULL AND text IS NOT NULL AND regexp_replace(text, '{_W}+', '', 'g') <> ''))"


def _bm25(phrases, name="hits") -> str:
    values = ", ".join("('{}')".format(p.replace("'", "''")) for p in phrases)
    return f"""{_SEG},
st AS (SELECT count(*)::double AS n, sum(dl)::double / count(*) AS average FROM seg),
ph AS (SELECT phrase, terms, len(terms) AS k FROM (SELECT phrase, {_TOK.replace('lower(text)', 'lower(phrase)')} AS terms FROM (VALUES {values}) v(phrase)) WHERE len(terms) > 0),
tf AS (SELECT phrase, segment_id, dl, len(list_filter(range(1, len(tokens) - k + 2), lambda i: list_slice(tokens, i, i + k - 1) = terms)) AS tf FROM seg JOIN ph ON list_has_all(tokens, terms)),
df AS (SELECT phrase, count(*)::double AS df FROM tf WHERE tf > 0 GROUP BY 1),
{name} AS (SELECT phrase, segment_id, tf, df::bigint AS df, -greatest(ln((n - df + 0.5::double) / (df + 0.5::double)), 1e-6::double) * (tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * dl / average))) AS rank FROM tf JOIN df USING (phrase) CROSS JOIN st WHERE tf > 0)"""


_POS = "pos AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY rank, segment_id) AS position FROM hits) WHERE position <= 40)"
_LIT = "lit AS (SELECT * FROM (VALUES " + ", ".join(f"({n}, '{p}', {w})" for n, p, w in LITERAL) + ") v(variant_no, phrase, weight)), h AS (SELECT pos.*, variant_no, weight, object_sha256, source_name, text FROM pos JOIN lit USING (phrase) JOIN seg USING (segment_id))"
_SCORE = "sc AS (SELECT object_sha256, list_sum(list_transform(list_sort(list(struct_pack(variant_no := variant_no, x := weight + 1.0::double / first))), lambda p: p.x)) AS score FROM (SELECT object_sha256, variant_no, weight, min(position) AS first FROM h GROUP BY ALL) GROUP BY 1)"
_BEST = f"b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY object_sha256 ORDER BY value DESC, variant_no, position) AS nr FROM (SELECT *, weight + 1.0::double / position + least(length(trim(regexp_replace(text, '{_W}+', ' ', 'g'))), 400) / 1000.0::double AS value FROM h)) WHERE nr = 1)"
_LITERAL_SQL = "WITH " + _bm25([p for _, p, _ in LITERAL]) + f", {_POS}, {_LIT}"
_ONE = _bm25([PHRASE])

QUERIES = {f.__name__: f for f in (segment_lines, blank_filter, segment_ids, token_counts, index_stats, phrase_search_topk, phrase_search_filtered, bm25_all, variant_positions, source_scores, best_passage, retrieve_evidence_topk, query_variants, retrieve_questions, retrieval_diagnostics, retrieval_recall, distinct_source_topk, citation_validate, source_locations)}
SQL = {
    "segment_lines": """
SELECT doc_id, i::int AS line_no, '{"line":' || i || '}' AS locator_json, sha256(l[i]) AS text_sha256
FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x{0b}\\x{0c}\\x{1c}\\x{1d}\\x{1e}\\x{85}\\x{2028}\\x{2029}]') AS l FROM documents WHERE text IS NOT NULL))
WHERE l[i] <> ''""",
    "blank_filter": f"SELECT kind, count(*) FILTER (b) AS blank, count(*) FILTER (NOT b) AS kept FROM (SELECT DISTINCT ON (segment_id) kind, text IS NULL OR regexp_replace(text, '{_W}+', '', 'g') = '' AS b FROM segments) GROUP BY 1",
    "segment_ids": "SELECT DISTINCT segment_id, sha256(object_sha256 || chr(0) || segment_index || chr(0) || locator_json || chr(0) || sha256(text)) AS computed_id, sha256(text) AS text_sha256 FROM segments WHERE text IS NOT NULL AND object_sha256 IS NOT NULL AND locator_json IS NOT NULL",
    "token_counts": f"WITH {_SEG} SELECT segment_id, dl::int AS dl, sha256(array_to_string(tokens, ' ')) AS tokens_sha256 FROM seg",
    "index_stats": f"WITH {_SEG} SELECT count(*) AS n, sum(dl)::bigint AS total_tokens, round(avg(dl), 6) AS average, count(DISTINCT object_sha256) AS objects FROM seg",
    "phrase_search_topk": f"WITH {_ONE} SELECT segment_id, source_name, locator_json, tf, round(rank, 6) AS rank FROM hits JOIN seg USING (segment_id) ORDER BY hits.rank, segment_id LIMIT 20",
    "phrase_search_filtered": f"WITH {_ONE} SELECT segment_id, source_name, locator_json, tf, round(rank, 6) AS rank FROM hits JOIN seg USING (segment_id) WHERE kind = 'docx' AND media_type = 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' ORDER BY hits.rank, segment_id LIMIT 50",
    "bm25_all": "WITH " + _bm25([*PHRASES, COMMON, LONG]) + " SELECT phrase, segment_id, tf, df, round(rank, 6) AS rank FROM hits",
    "variant_positions": "WITH " + _bm25(PHRASES) + f", {_POS} SELECT phrase, segment_id, position::int AS position, round(rank, 6) AS rank FROM pos",
    "source_scores": f"{_LITERAL_SQL}, {_SCORE} SELECT object_sha256, round(score, 6) AS score FROM sc",
    "best_passage": f"{_LITERAL_SQL}, {_BEST} SELECT object_sha256, segment_id, variant_no, position::int AS position, round(value, 6) AS value FROM b",
    "retrieve_evidence_topk": f"{_LITERAL_SQL}, {_SCORE}, {_BEST}, m AS (SELECT object_sha256, array_to_string(list_sort(list(DISTINCT lower(phrase))), '|') AS matched FROM h GROUP BY 1) SELECT row_number() OVER (ORDER BY score DESC, lower(source_name) NULLS FIRST, segment_id)::int AS evidence_no, segment_id, source_name, round(score, 6) AS score, matched FROM b JOIN sc ON b.object_sha256 IS NOT DISTINCT FROM sc.object_sha256 JOIN m ON b.object_sha256 IS NOT DISTINCT FROM m.object_sha256 WHERE b.object_sha256 IS NOT NULL QUALIFY evidence_no <= 8",
    "distinct_source_topk": f"WITH {_ONE} SELECT object_sha256, segment_id, round(rank, 6) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY object_sha256 ORDER BY rank, segment_id) AS nr FROM hits JOIN seg USING (segment_id)) WHERE nr = 1 ORDER BY rank, segment_id LIMIT 10",
    "source_locations": "SELECT DISTINCT segment_id, s.object_sha256, storage_path FROM segments s LEFT JOIN objects o ON s.object_sha256 = o.sha256 WHERE s.object_sha256 IS NOT NULL",
}
SQL["citation_validate"] = """
WITH r AS (SELECT DISTINCT ON (segment_id) * FROM segments WHERE object_sha256 IS NOT NULL AND text IS NOT NULL),
s AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY object_sha256, segment_index ORDER BY segment_id) = 1),
d AS (SELECT object_sha256, min(source_name) AS dn, min(media_type) AS dm, min(kind) AS dk, min(normalized_sha256) AS dh, max(segment_index) + 1 AS many FROM s GROUP BY 1),
c AS (SELECT s.*, sha256(text) AS st, locator_json AS sl, ('0x' || substr(segment_id, 1, 2))::int % 16 AS h,
  sha256(object_sha256 || chr(0) || segment_index || chr(0) || locator_json || chr(0) || sha256(text)) AS made FROM s),
e AS (SELECT c.segment_id AS citation, o.sha256 IS NULL AS e1, (o.sha256 IS NOT NULL AND ascii(right(o.sha256, 1)) % 16 = 7) AS e1b, (ascii(right(c.object_sha256, 1)) % 16 = 3) AS e2b,
  (h = 4 OR normalized_path IS DISTINCT FROM 'derived/' || c.object_sha256 || '/normalized.json') AS e2,
  (h = 6 OR normalized_sha256 IS DISTINCT FROM dh) AS stop1,
  (CASE WHEN h = 3 THEN 'other.txt' ELSE source_name END IS DISTINCT FROM dn) AS e3, (c.media_type IS DISTINCT FROM dm) AS e4, (kind IS DISTINCT FROM dk) AS e5,
  (h = 2) AS stop2, (CASE WHEN h = 5 THEN '{}' ELSE locator_json END IS DISTINCT FROM sl) AS e6,
  (h = 1 AND sha256(source_name) IS DISTINCT FROM st) AS e7
  FROM c JOIN d USING (object_sha256) LEFT JOIN objects o ON o.sha256 = c.object_sha256),
l AS (SELECT citation, list_filter([
  CASE WHEN e1 THEN 'canonical original is missing' END, CASE WHEN e1b THEN 'canonical original hash mismatch' END, CASE WHEN e2 THEN 'normalized path is not canonical for the object' END,
  CASE WHEN stop1 THEN 'normalized document hash mismatch' END,
  CASE WHEN NOT stop1 AND e2b THEN 'normalized object digest mismatch' END, CASE WHEN NOT stop1 AND e3 THEN 'source name mismatch' END, CASE WHEN NOT stop1 AND e4 THEN 'media type mismatch' END, CASE WHEN NOT stop1 AND e5 THEN 'kind mismatch' END,
  CASE WHEN NOT stop1 AND stop2 THEN 'segment index is out of range' END,
  CASE WHEN NOT stop1 AND NOT stop2 AND e6 THEN 'segment locator mismatch' END, CASE WHEN NOT stop1 AND NOT stop2 AND e7 THEN 'segment text hash mismatch' END], lambda x: x IS NOT NULL) AS x FROM e)
SELECT citation, len(x) = 0 AS valid, array_to_string(x, '; ') AS errors FROM l"""
