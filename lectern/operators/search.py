"""Full-text index and search: phrases, BM25, many phrases at a time.

An index is a folder: the segments with their lengths, one row of statistics, and the postings of term,
segment and position. Postings are partitioned by a hash of the term and ordered by term, so a search
reads the partitions of its terms, and of these the row groups that hold them. Each phrase starts from the
postings of its rarest term; the postings of its other terms tell which of the starts are whole. Any
number of phrases is searched in one plan. Statistics are those of the whole corpus, whatever is filtered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import is_blank, tokens
from ..session import cut, shared_folder, stamp

#: Parameters of BM25, and the least inverse document frequency.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
MOST_RESULTS = 100
FILTERS = ("source_name", "media_type", "kind", "object_sha256")
#: Partitions of the postings by term.
BUCKETS = 64
#: Up to so many terms are named in the scan's filter; more are joined, to the same result.
MOST_NAMED = 5000


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _part(doc: Column) -> Column:
    return F.shiftright(doc, 33)


def _written(spark: SparkSession, folder: str, rows: DataFrame, by: str) -> DataFrame:
    """A folder of partitions as it was written; where no row was, with the columns at least."""
    if stamp(spark, folder)[1] == 0:
        rows.limit(0).withColumn(by, F.lit(0)).write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


class Index:
    """An index in a folder: ``segments`` (the distinct non-blank ones with ``doc``, a number, and
    ``dl``), ``postings`` (``term``, ``doc``, ``pos``, ``dl``), ``n`` and ``average``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.segments = spark.read.parquet(f"{folder}/segments")
        self.postings = spark.read.parquet(f"{folder}/postings")
        about = spark.read.parquet(f"{folder}/statistics").first()
        self.n, self.total, self.average = about["n"], about["total"], about["average"]

    @classmethod
    def build(cls, segments: DataFrame, folder: str | None = None) -> Index:
        """Write the index of ``segments`` to a folder that is not there yet (by default a new one in the
        shared folder) and open it. Repeated rows count once; no segments give an empty index."""
        spark = segments.sparkSession
        folder = folder or shared_folder(spark, "index")
        seen = segments.where(F.col("segment_id").isNotNull() & ~is_blank(F.col("text"))).dropDuplicates(["segment_id"])
        numbered = seen.withColumn("doc", F.monotonically_increasing_id()).withColumn("dl", F.size(tokens(F.col("text"))))
        # numbers of one writer share their high bits: hits name the files that hold their segments
        numbered = numbered.withColumn("part", _part(F.col("doc")))
        numbered.write.partitionBy("part").parquet(f"{folder}/segments")
        kept = _written(spark, f"{folder}/segments", numbered, "part")
        rows = kept.select("doc", "dl", F.posexplode(tokens(F.col("text"))).alias("pos", "term")).withColumn("bucket", _bucket(F.col("term")))
        # a term of a third of all segments makes a large bucket, which is then split
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "doc").write.partitionBy("bucket").parquet(f"{folder}/postings")
        about = kept.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total"), F.avg("dl").alias("average"))
        about.write.parquet(f"{folder}/statistics")
        _written(spark, f"{folder}/postings", rows, "bucket")
        return cls(spark, folder)

    def match(self, phrases: DataFrame, *columns: str) -> DataFrame:
        """``phrase``, ``segment_id``, ``tf``, ``df``, ``rank`` for ``phrases`` (a column ``phrase``), and the
        given columns of the segments.

        Phrases without tokens match nothing. Overlapping occurrences count. Lower ranks are better.
        """
        asked = phrases.where(F.col("phrase").isNotNull()).select("phrase").distinct().withColumn("terms", tokens(F.col("phrase"))).where(F.size("terms") > 0)
        terms = asked.select("phrase", F.size("terms").alias("k"), F.posexplode("terms").alias("at", "term")).withColumn("bucket", _bucket(F.col("term")))
        few = terms.limit(MOST_NAMED + 1).collect()
        named = len(few) <= MOST_NAMED
        if named:
            # what is asked, and one row a phrase or term of it, goes to every executor
            terms = F.broadcast(self.spark.createDataFrame(few, terms.schema))
            postings = self.postings.where(F.col("bucket").isin(sorted({r["bucket"] for r in few})) & F.col("term").isin(sorted({r["term"] for r in few})))
        else:
            postings = self.postings.join(terms.select("term", "bucket").distinct(), ["bucket", "term"], "left_semi")
        postings, terms = postings.drop("bucket"), terms.drop("bucket")

        def told(df: DataFrame) -> DataFrame:
            return F.broadcast(self.spark.createDataFrame(df.collect(), df.schema)) if named else df

        # each phrase starts from its rarest term; a term that nowhere occurs ends it
        often = postings.groupBy("term").agg(F.count("*").alias("often"))
        rare = terms.join(often, "term", "left").groupBy("phrase", "k").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "at", "term")).alias("rare")).where("rare.often > 0").select("phrase", "k", "rare.at", "rare.term")
        starts = postings.join(told(rare), "term").withColumn("start", F.col("pos") - F.col("at")).where((F.col("start") >= 0) & (F.col("start") + F.col("k") <= F.col("dl"))).select("phrase", "k", "doc", "dl", "start")
        due = starts.where("k > 1").join(terms.select("phrase", "at", "term"), "phrase").withColumn("pos", F.col("start") + F.col("at"))
        whole = due.join(postings.select("term", "doc", "pos"), ["term", "doc", "pos"]).groupBy("phrase", "k", "doc", "dl", "start").agg(F.count("*").alias("held")).where("held = k")
        hits = starts.where("k = 1").select("phrase", "doc", "dl").unionByName(whole.select("phrase", "doc", "dl"))
        tf = cut(hits.groupBy("phrase", "doc", "dl").agg(F.count("*").alias("tf")))
        df = told(tf.groupBy("phrase").agg(F.count("*").alias("df")))
        idf = F.greatest(F.log((F.lit(self.n) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
        weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(self.average or 1.0)))
        ranked = tf.join(df, "phrase").withColumn("rank", -idf * weight).withColumn("part", _part(F.col("doc"))).drop("dl")
        about = self.segments.select("part", "doc", *dict.fromkeys(("segment_id", *columns)))
        return ranked.join(about, ["part", "doc"]).drop("part", "doc")


def phrases_of(spark: SparkSession, *phrases: str) -> DataFrame:
    return spark.createDataFrame([(p,) for p in phrases], "phrase string")


def search(index: Index, phrase: str, limit: int | None = 20, **equal: str) -> DataFrame:
    """Segments that hold a literal phrase, best first; ties by ``segment_id``.

    ``equal`` filters by exact metadata, after the statistics. A blank phrase and a limit outside 1 to
    100 are errors; a phrase of punctuation only finds nothing. Without a limit all hits come back.
    """
    if not phrase.strip():
        raise ValueError("search query must not be blank")
    if limit is not None and not 1 <= limit <= MOST_RESULTS:
        raise ValueError("search limit must be between 1 and 100")
    hits = index.match(phrases_of(index.spark, phrase), *(c for c in index.segments.columns if c not in ("part", "doc"))).drop("phrase")
    for name, value in equal.items():
        if name not in FILTERS:
            raise ValueError(f"no such filter: {name}")
        hits = hits.where(F.col(name) == value)
    return hits.orderBy("rank", "segment_id").limit(limit) if limit else hits


def positions(hits: DataFrame, most: int = 40, by: str = "phrase") -> DataFrame:
    """The best ``most`` hits of each phrase with their ``position`` from 1."""
    w = W.partitionBy(by).orderBy("rank", "segment_id")
    return hits.withColumn("position", F.row_number().over(w)).where(F.col("position") <= most)
