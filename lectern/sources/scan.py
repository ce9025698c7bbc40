"""Directory scan and dispatch: files to objects, segments and honest failures."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.ledger import MEDIA_TYPES, kind, media_type
from . import inpage, packages

#: A file larger than this is reported, not read.
MOST_BYTES = 256 << 20
OUT = "path string, source_name string, sha256 string, media_type string, kind string, status string, error string, segments array<struct<segment_index:int,locator_json:string,text:string>>, metadata string"


def normalize(name: str, data: bytes) -> tuple[list[tuple[dict, str]], dict]:
    """Segments and metadata of one file; ValueError for what cannot be read."""
    suffix = "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""
    kind_ = suffix[1:]
    if suffix not in MEDIA_TYPES:
        raise ValueError(f"unsupported file type: {suffix or '<none>'}")
    if kind_ in ("txt", "md"):
        try:
            text = data.decode("utf-8")
        except UnicodeDecodeError as e:
            raise ValueError("text is not UTF-8") from e
        return [({"line": i}, line) for i, line in enumerate(text.splitlines(), 1) if line], {}
    if kind_ in ("docx", "xlsx", "pptx"):
        return getattr(packages, kind_)(data), {}
    if kind_ == "odb":
        named = packages.odb(data, MEDIA_TYPES[suffix])
        return named, packages.odb_counts(named)
    if kind_ in packages.BODIES or kind_ == "odf":
        root = packages.content_of(data, kind_, MEDIA_TYPES[suffix])
        return packages.segments_in(root, kind_), {"external_links": packages.external_links(root)}
    if kind_ == "inp":
        return inpage.read(data), {"classification": inpage.classify(name, data)}
    if kind_ == "wav":
        return [], packages.wav(data)
    if kind_ == "pdf":
        return pdf(data), {}
    return [], packages.image(data)


def pdf(data: bytes) -> list[tuple[dict, str]]:
    """A segment per page, empty ones kept; needs an optional library, and says so without it."""
    if not data.startswith(b"%PDF-") or b"%%EOF" not in data[-2048:]:
        raise ValueError("malformed PDF")
    try:
        from pypdf import PdfReader
    except ImportError:
        raise NotImplementedError("no PDF library is installed") from None
    import io

    return [({"page": n}, (p.extract_text() or "").strip()) for n, p in enumerate(PdfReader(io.BytesIO(data), strict=True).pages, 1)]


def canonical(locator: dict) -> str:
    """JSON with sorted keys, no blanks and ASCII only: the form that ids are made of."""
    return json.dumps(locator, sort_keys=True, separators=(",", ":"))


def contents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file below ``path`` with its bytes; null for what is unsupported or too large, which is
    not opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    content = F.when(media_type(name).isNotNull() & (F.col("length") <= MOST_BYTES), F.col("content"))
    return files.select("path", name.alias("source_name"), media_type(name).alias("media_type"), kind(name).alias("kind"), content.alias("content")).withColumn("sha256", F.sha2("content", 256))


def scan(spark: SparkSession, path: str) -> DataFrame:
    """One row per file below ``path``: what it is, its segments, or why it could not be read.

    ``status`` is ``succeeded``, ``failed`` (malformed or unsupported) or ``skipped`` (an optional
    library is missing). A failing file never stops the others. Unsupported files are not opened.
    """
    return read_contents(contents(spark, path))


def read_contents(rows: DataFrame) -> DataFrame:
    """Files read from their bytes: rows as of ``contents``, result as of ``scan``."""
    struct = pa.list_(pa.struct([("segment_index", pa.int32()), ("locator_json", pa.string()), ("text", pa.string())]))
    names = ["path", "source_name", "sha256", "media_type", "kind", "status", "error", "segments", "metadata"]

    def run(batches):
        for b in batches:
            # one file at a time: a batch may hold many large ones
            for i in range(b.num_rows):
                r = {n: b.column(n)[i].as_py() for n in names[:5]}
                r |= {"segments": [], "metadata": None, "status": "failed", "error": None}
                try:
                    content = b.column("content")[i].as_py()
                    if content is None:
                        raise ValueError("unsupported or too large")
                    segments, about = normalize(r["source_name"], content)
                    r["segments"] = [{"segment_index": k, "locator_json": canonical(x), "text": t} for k, (x, t) in enumerate(segments)]
                    r["metadata"], r["status"] = canonical(about), "succeeded"
                except NotImplementedError as e:
                    r["status"], r["error"] = "skipped", str(e)
                except Exception as e:  # noqa: BLE001 - whatever a parser meets, the file is malformed
                    r["error"] = str(e)
                yield pa.RecordBatch.from_arrays([pa.array([r[n]], struct if n == "segments" else pa.string()) for n in names], names=names)

    return rows.select(*names[:5], "content").mapInArrow(run, OUT)


def segments_of(files: DataFrame) -> DataFrame:
    """The segments of scanned files with their ids; blank ones are left out, numbers stay.

    Content that several files have gives its segments once, under the first name by path.
    """
    first = files.where("status = 'succeeded'").groupBy("sha256").agg(F.min_by(F.struct("source_name", "media_type", "kind", "segments"), "path").alias("x"))
    rows = first.select(F.col("sha256").alias("object_sha256"), "x.source_name", "x.media_type", "x.kind", F.explode("x.segments").alias("s")).select("object_sha256", "source_name", "media_type", "kind", "s.*")
    rows = rows.where(~T.is_blank(F.col("text"))).withColumn("text_sha256", F.sha2("text", 256))
    return rows.withColumn("segment_id", T.segment_id(F.col("object_sha256"), F.col("segment_index"), F.col("locator_json"), F.col("text_sha256")))


def summary(files: DataFrame) -> DataFrame:
    """Files by status and kind."""
    return files.groupBy("status", "kind").agg(F.count("*").alias("files"))


def tsv_lines(words: DataFrame, *document: str) -> DataFrame:
    """Recognised lines from word rows of an engine's TSV: ``page_num``, ``line`` (from 1), ``text``,
    the box around the words and their mean confidence (null if none is known).

    ``document`` names the columns that tell documents apart; without any, all rows are of one.
    Only rows of level 5 with text count; a negative confidence is none.
    """
    w = words.where((F.col("level") == 5) & (F.trim("text") != ""))
    page, inner = [*document, "page_num"], ["block_num", "par_num", "line_num"]
    out = w.groupBy(*page, *inner).agg(
        F.min("left").alias("x"), F.min("top").alias("y"),
        (F.max(F.col("left") + F.col("width")) - F.min("left")).alias("width"),
        (F.max(F.col("top") + F.col("height")) - F.min("top")).alias("height"),
        F.round(F.avg(F.when(F.col("conf") >= 0, F.col("conf"))), 3).alias("confidence"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_num", F.trim("text").alias("t")))), lambda x: x["t"]), " ").alias("text"),
    )
    return out.withColumn("line", F.row_number().over(W.partitionBy(*page).orderBy(*inner))).drop(*inner)
