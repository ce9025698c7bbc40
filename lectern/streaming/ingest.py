"""Continuous ingestion: a stream of files or rows, appended once per content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ledger import new_content
from ..session import exists


def append_new(store: str, digest: str = "sha256"):
    """A ``foreachBatch`` function that appends the rows whose content the store lacks.

    A batch that is run again after a failure appends nothing twice, as its content is there.
    """

    def step(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        batch = batch.where(F.col(digest).isNotNull())
        # partitions by the digest's first characters: a batch reads those that it has digests in
        batch = batch.withColumn("prefix", F.substring(digest, 1, 2))
        stored = spark.read.parquet(store).select(digest, "prefix") if exists(spark, store) else batch.select(digest, "prefix").limit(0)
        named = [r["prefix"] for r in batch.select("prefix").distinct().limit(257).collect()]
        if len(named) <= 256:
            stored = stored.where(F.col("prefix").isin(named))
        new_content(batch, stored, digest).write.mode("append").partitionBy("prefix").parquet(store)

    return step


def ingest_stream(rows: DataFrame, store: str, checkpoint: str, available_now: bool = True):
    """Start a stream of rows with ``sha256`` into the store; with ``available_now`` it ends when all
    that is there has been taken."""
    writer = rows.writeStream.foreachBatch(append_new(store)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def late_counts(events: DataFrame, time: str, delay: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events per window and status; those later than ``delay`` are dropped by the watermark."""
    return events.withWatermark(time, delay).groupBy(F.window(time, width), "status").agg(F.count("*").alias("events"))
