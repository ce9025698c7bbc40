"""An archive in a folder of Parquet tables: adding, searching, asking, reporting, snapshots.

``objects``, ``ingestions``, ``processing_runs`` and ``runs`` are durable, and so are ``originals``: the
bytes of every object under its digest, in partitions by the digest's first two characters. Sources may
move or vanish after they were added. ``segments`` and their index are derived: they are rebuilt from the
originals into a new version beside the old one, and a pointer file then names it, so a reader never meets
half a table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths
from .operators import citations, grounding, ledger, retrieval, search, snapshots, trial
from .operators.ledger import kind, media_type
from .sources import records
from .sources import scan as sources

DURABLE = ("objects", "ingestions", "processing_runs", "runs", "originals")
STATES = ("succeeded", "failed", "cancelled", "waiting_for_approval", "partially_produced_but_invalid", "blocked_by_policy")


class Archive:
    def __init__(self, spark: SparkSession, home: str, roots: tuple[str, ...] = ()) -> None:
        """``roots`` are the folders that sources may come from; without any, all may."""
        self.spark, self.home, self.roots = spark, home.rstrip("/"), roots

    # tables

    def _files(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.home)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _there(self, name: str) -> bool:
        fs, path = self._files()
        return fs.exists(path(f"{self.home}/{name}"))

    def table(self, name: str) -> DataFrame:
        if name == "segments":
            return self.spark.read.parquet(f"{self.home}/{self._pointer()}/segments").drop("part", "doc", "dl")
        return self.spark.read.parquet(f"{self.home}/{name}")

    def _pointer(self) -> str:
        if not self._there("segments.current"):
            raise FileNotFoundError("the index has not been built")
        return self.spark.read.text(f"{self.home}/segments.current").first()[0]

    def _append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.home}/{name}")

    # adding

    def add(self, path: str) -> dict:
        """Ingest all files below a path. A malformed file leaves no object, only its failed row."""
        files = sources.scan(self.spark, path)
        if self.roots:
            # whatever steps a path takes, it has to end below an allowed folder
            outside = ~paths.bounded(F.regexp_replace("path", "^[a-zA-Z][a-zA-Z0-9+.-]*:/*", "/"), self.roots)
            files = files.withColumn("status", F.when(outside, "failed").otherwise(F.col("status"))).withColumn("error", F.when(outside, "outside the allowed folders").otherwise(F.col("error")))
        files = self.spark.read.parquet(self._staged(files))
        stored = self.table("objects").select("sha256") if self._there("objects") else files.select("sha256").limit(0)
        good = files.where("status <> 'failed'")
        held = good.join(stored.distinct(), "sha256", "left_semi").select("path").withColumn("held", F.lit(True))
        marked = ledger.with_duplicates(good.select("path", "sha256"), "sha256", "path").join(held, "path", "left")
        flags = marked.select("path", (F.col("duplicate") | F.coalesce("held", F.lit(False))).alias("duplicate"))
        log = files.join(flags, "path", "left").select(
            F.expr("replace(uuid(), '-', '')").alias("ingestion_id"), F.col("sha256").alias("object_sha256"), F.col("path").alias("source_path"), "source_name",
            # of equal files of one call the first by path came first
            F.when(F.coalesce("duplicate", F.lit(False)), F.current_timestamp() + F.expr("interval 1 microsecond")).otherwise(F.current_timestamp()).alias("imported_at"), F.coalesce("duplicate", F.lit(False)).alias("duplicate"),
            F.when(F.col("status") == "failed", "failed").otherwise("succeeded").alias("status"), "error",
        )
        log = self.spark.read.parquet(self._staged(log))
        new = ledger.new_content(good.select("sha256", "source_name", "media_type", "path", "segments"), stored)
        new = self.spark.read.parquet(self._staged(new.select("sha256", "media_type", F.lower(F.element_at(F.split("path", r"\."), -1)).alias("source_extension"), "path")))
        # bytes first: an object is named only when its bytes are held under its digest
        self._store(new, path)
        held = self.table("originals").select("sha256", "prefix")
        self._append("objects", new.join(held, "sha256").select("sha256", "media_type", "source_extension", F.concat(F.lit("originals/prefix="), "prefix", F.lit("/"), "sha256").alias("storage_path"), F.current_timestamp().alias("created_at")))
        self._append("processing_runs", files.select(F.expr("replace(uuid(), '-', '')").alias("processing_id"), F.col("sha256").alias("object_sha256"), F.lit("normalizer").alias("processor"), "status", "error", F.current_timestamp().alias("started_at")))
        self._append("ingestions", log)
        return ledger.add_summary(log).first().asDict()

    def _staged(self, rows: DataFrame) -> str:
        name = f"{self.home}/staged/{uuid.uuid4().hex}"
        rows.write.parquet(name)
        return name

    def _store(self, new: DataFrame, path: str) -> None:
        """Append the bytes of new objects. A file that changed since it was read has other bytes than its
        digest says and is not stored."""
        bytes_ = sources.contents(self.spark, path).select("path", F.col("sha256").alias("now"), "content")
        rows = new.select("sha256", "path").join(bytes_, "path").where(F.col("now") == F.col("sha256"))
        rows = rows.select("sha256", "content", F.substring("sha256", 1, 2).alias("prefix"))
        rows.write.mode("append").partitionBy("prefix").parquet(f"{self.home}/originals")
        if not self._files_in("originals"):
            rows.limit(0).write.mode("overwrite").parquet(f"{self.home}/originals")

    def _files_in(self, name: str) -> int:
        fs, path = self._files()
        return fs.getContentSummary(path(f"{self.home}/{name}")).getLength()

    def rebuild(self, reuse: bool = False, only: DataFrame | None = None) -> dict:
        """Read the originals again and write segments and index in a new version.

        With ``only`` (a table with ``sha256``) just these objects are read; with ``reuse`` just those whose
        present segments are missing or have other texts than their digests say. The segments of all
        other objects are taken over.
        """
        objects = self.table("objects").select("sha256", "source_extension").dropDuplicates(["sha256"])
        kept = None
        if (reuse or only is not None) and self._there("segments.current"):
            old = self.table("segments")
            sound = old.groupBy(F.col("object_sha256").alias("sha256")).agg(F.min((F.sha2("text", 256) == F.col("text_sha256")).cast("int")).alias("sound")).where("sound = 1").select("sha256")
            if only is not None:
                sound = sound.join(only.select("sha256").distinct(), "sha256", "left_anti")
            sound = self.spark.read.parquet(self._staged(sound.join(objects, "sha256", "left_semi")))
            kept = old.join(sound.withColumnRenamed("sha256", "object_sha256"), "object_sha256", "left_semi").drop("source_name")
            objects = objects.join(sound, "sha256", "left_anti")
        name = F.concat("sha256", F.lit("."), "source_extension")
        originals = self.table("originals").join(objects, "sha256")
        files = originals.select(name.alias("path"), name.alias("source_name"), media_type(name).alias("media_type"), kind(name).alias("kind"), "sha256", "content")
        segments = sources.segments_of(sources.read_contents(files)).drop("source_name")
        if kept is not None:
            segments = segments.unionByName(kept.select(*segments.columns))
        names = ledger.canonical_names(self.table("ingestions").dropDuplicates(["ingestion_id"]))
        version = f"versions/{uuid.uuid4().hex}"
        search.Index.build(segments.join(names, "object_sha256", "left"), f"{self.home}/{version}")
        self.spark.createDataFrame([(version,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.home}/segments.current")
        return self.table("segments").agg(F.countDistinct("object_sha256").alias("objects"), F.count("*").alias("segments")).first().asDict()

    def damaged(self) -> DataFrame:
        """Objects whose bytes are missing or have another digest than they are stored under."""
        bytes_ = self.table("originals").select("sha256", (F.sha2("content", 256) == F.col("sha256")).alias("sound"))
        seen = self.table("objects").select("sha256").distinct().join(bytes_, "sha256", "left")
        return seen.where(~F.coalesce("sound", F.lit(False))).select("sha256", F.when(F.col("sound").isNull(), "missing").otherwise("hash mismatch").alias("fault")).distinct()

    # searching

    def index(self) -> search.Index:
        return search.Index(self.spark, f"{self.home}/{self._pointer()}")

    def find(self, phrase: str, limit: int = 20, **equal: str) -> DataFrame:
        return search.search(self.index(), phrase, limit, **equal)

    def evidence(self, question: str, limit: int = retrieval.EVIDENCE) -> DataFrame:
        asked = retrieval.variants(self.spark.createDataFrame([("q", question)], "question_id string, question string"))
        index = self.index()
        chosen = retrieval.retrieve(index, asked, limit=limit)
        return grounding.numbered(chosen.join(index.segments.select("segment_id", "locator_json", "text"), "segment_id"), "question_id", "evidence_no")

    def ask(self, question: str, model: Callable[[str], str] | None = None) -> dict:
        """Answer with a model that is handed in; without one nothing is asked of any. The run is kept."""
        run = {"run_id": uuid.uuid4().hex, "question": question, "state": "blocked_by_policy", "citations": 0, "answer": None}
        if model is not None:
            evidence = self.spark.read.parquet(self._staged(self.evidence(question)))
            run["citations"] = evidence.count()
            if not run["citations"]:
                run |= {"state": "succeeded", "answer": json.dumps({"insufficient_evidence": [question]})}
            else:
                q = self.spark.createDataFrame([("q", question)], "question_id string, question string")
                try:
                    run["answer"] = model(grounding.prompts(q, evidence, "question_id").first()["prompt"])
                    rows = self.spark.createDataFrame([("q", run["answer"])], "question_id string, raw string")
                    told = grounding.parsed(rows).withColumn("allowed_ids", F.array(*(F.lit(r[0]) for r in evidence.select("citation_id").collect())))
                    seen = citations.structure(told, "question_id").join(told.select("question_id", "parse_error"), "question_id")
                    run["state"] = seen.select(grounding.state(True, F.lit(run["citations"]), F.col("parse_error"), F.col("unknown") + F.col("malformed"))).first()[0]
                except Exception as e:  # noqa: BLE001 - a failing model is a failed run
                    run |= {"state": "failed", "answer": str(e)}
        self._append("runs", self.spark.createDataFrame([tuple(run.values())], "run_id string, question string, state string, citations int, answer string"))
        return run

    def report(self, title: str, phrase: str, most: int = 10) -> tuple[DataFrame, DataFrame]:
        """Rows of a report on a phrase, and what is wrong with them."""
        rows = self.spark.read.parquet(self._staged(grounding.report(title, grounding.first_per_source(search.search(self.index(), phrase, None), most))))
        return rows, grounding.report_errors(rows)

    def run_task(self, text: str) -> dict:
        """Run a task given as JSON: a report of its query, written with its manifest and what the
        archive held before and after. The state is ``succeeded`` only if the report has no fault and no
        original changed meanwhile."""
        task = records.task(text)
        run = {"run_id": uuid.uuid4().hex, "question": task["query"], "state": "succeeded", "citations": 0, "answer": None}
        folder = f"{self.home}/tasks/{run['run_id']}"
        self.manifest().write.parquet(f"{folder}/before")
        rows, errors = self.report(task["title"], task["query"], task["max_sources"])
        rows.write.parquet(f"{folder}/report")
        trial.report_manifest(rows).write.parquet(f"{folder}/manifest")
        self.manifest().write.parquet(f"{folder}/after")
        faults = [r["error"] for r in errors.limit(100).collect()] + self._moved(folder)
        run["citations"] = rows.where("section = 'Sources'").count()
        if not run["citations"]:
            faults.append("no source holds the query")
        if faults:
            run |= {"state": "partially_produced_but_invalid", "answer": "; ".join(faults)}
        self._append("runs", self.spark.createDataFrame([tuple(run.values())], "run_id string, question string, state string, citations int, answer string"))
        return run | {"report": folder}

    def _moved(self, folder: str) -> list[str]:
        before, after = (self.spark.read.parquet(f"{folder}/{x}").where("path <> 'runs'") for x in ("before", "after"))
        return [f"{r['path']}: {r['difference']}" for r in snapshots.differences(before, after, "path", "size", "sha256").collect()]

    def verify_task(self, run_id: str) -> list[str]:
        """What is wrong with a task's output now: a report that differs from its manifest or has faults,
        sources it names that the archive lacks, originals that changed while it ran."""
        folder = f"{self.home}/tasks/{run_id}"
        if not self._there(f"tasks/{run_id}"):
            return ["no such task"]
        rows, told = (self.spark.read.parquet(f"{folder}/{x}") for x in ("report", "manifest"))
        out = [f"{r['section']}: {r['difference']}" for r in snapshots.differences(told, trial.report_manifest(rows), "section", "rows", "sha256").collect()]
        out += [r["error"] for r in grounding.report_errors(rows).collect()]
        cited = rows.where("section = 'Sources'").select(F.regexp_extract("text", r"sha256 ([0-9a-f]{64})$", 1).alias("sha256"))
        out += [f"source is missing: {r['sha256']}" for r in cited.join(self.table("objects"), "sha256", "left_anti").collect()]
        return out + self._moved(folder)

    def doctor(self) -> list[str]:
        """What is wrong with the archive: damaged originals, broken ledgers, an index not built."""
        out = [f"{r['fault']}: {r['sha256']}" for r in self.damaged().limit(1000).collect()] if self._there("originals") else ["nothing has been added"]
        for name, key in (("ingestions", "ingestion_id"), ("processing_runs", "processing_id")):
            if self._there(name):
                out += [f"{name} {r['record_id']}: {r['rule']}" for r in ledger.violations(name, self.table(name).select(key, "object_sha256", "status"), key).limit(1000).collect()]
        return out if self._there("segments.current") else [*out, "the index has not been built"]

    def status(self) -> dict:
        return ledger.archive_status(*(self.table(t) for t in DURABLE[:3])).first().asDict()

    # snapshots

    def manifest(self) -> DataFrame:
        """Rows and a digest of the content of each durable table."""
        out = None
        for t in DURABLE:
            if self._there(t):
                rows = self.table(t)
                # bytes tell themselves apart by their digest, which ``damaged`` verifies
                rows = rows.drop("content")
                part = rows.agg(F.lit(t).alias("path"), F.count("*").alias("size"), F.coalesce(F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sha256"))
                out = part if out is None else out.unionByName(part)
        return out

    def backup(self, target: str) -> None:
        """Copy the durable tables and their manifest; never onto something that is there."""
        for t in DURABLE:
            if self._there(t):
                self._copy(self.table(t), f"{target}/{t}", t)
        self.manifest().write.mode("errorifexists").parquet(f"{target}/manifest")

    @classmethod
    def restore(cls, spark: SparkSession, source: str, home: str) -> Archive:
        """Fill an empty home from a backup that is as its manifest says and whose bytes are sound, and
        rebuild what is derived. Paths of storage are relative to the home, so none has to move."""
        new = cls(spark, home)
        if any(new._there(t) for t in DURABLE):
            raise FileExistsError("the target is not empty")
        old = cls(spark, source)
        bad = snapshots.differences(spark.read.parquet(f"{source}/manifest"), old.manifest(), "path", "size", "sha256")
        if not bad.isEmpty():
            raise ValueError("the backup differs from its manifest")
        if old._there("originals") and not old.damaged().isEmpty():
            raise ValueError("the backup holds damaged originals")
        for t in DURABLE:
            if old._there(t):
                new._copy(old.table(t), f"{home}/{t}", t)
        if new._there("originals"):
            new.rebuild()
        return new

    @staticmethod
    def _copy(rows: DataFrame, to: str, name: str) -> None:
        out = rows.write.mode("errorifexists")
        (out.partitionBy("prefix") if name == "originals" else out).parquet(to)
