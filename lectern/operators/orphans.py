"""Orphan references: rows whose key names no valid parent.

A Bloom filter over the parent keys is built with a distributed aggregate and broadcast. Its size is
fixed by a bit budget, not by the data. A reference that misses the filter is a definite orphan and
takes no part in any join; only references that hit the filter are verified by an exact join.

The budget holds some 5.6 million parents at 12 bits each. Beyond that the filter lets more references
through, and the exact join decides more of them: it is on distinct digests, which are partitioned by
digest already, so the cost stays in proportion to the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Spark's own limit for its Bloom filter aggregate: 8 MiB is the most that is ever broadcast.
MAX_BITS = 67_108_864
BITS_PER_KEY = 12


def clean_digest(c: Column) -> Column:
    """A digest without outer blanks, a leading ``sha256:`` and letter case; blank becomes null."""
    blank = r"^[\s 　﻿]+|[\s 　﻿]+$"
    d = F.lower(F.regexp_replace(c, blank, ""))
    d = F.regexp_replace(F.regexp_replace(d, r"^sha256:", ""), blank, "")
    return d


def bloom_of(keys: DataFrame, column: str, expected: int) -> Column:
    """The Bloom filter of a key column, as a scalar subquery; null if there is no key.

    ``expected`` sizes it, up to ``MAX_BITS``. More keys than that only let more references through
    to the exact join; no result changes.
    """
    jvm = keys.sparkSession._jvm
    expr = jvm.org.apache.spark.sql.classic.ExpressionUtils
    node = jvm.org.apache.spark.sql.catalyst.expressions.aggregate.BloomFilterAggregate
    bits = max(1 << 16, min(MAX_BITS, BITS_PER_KEY * expected))
    items = max(1000, min(4_000_000, expected))
    size = [expr.expression(F.lit(n).cast("long")._jc) for n in (items, bits)]
    agg = node(expr.expression(F.xxhash64(F.col(column))._jc), *size)
    return keys.where(F.col(column).isNotNull()).agg(Column(expr.column(agg.toAggregateExpression())).alias("bloom")).scalar()


def might_contain(bloom: Column, c: Column, spark) -> Column:
    """False where ``c`` is surely not in the filter, or the filter is empty."""
    jvm = spark._jvm
    expr = jvm.org.apache.spark.sql.classic.ExpressionUtils
    node = jvm.org.apache.spark.sql.catalyst.expressions.BloomFilterMightContain
    return F.coalesce(Column(expr.column(node(expr.expression(bloom._jc), expr.expression(F.xxhash64(c)._jc)))), F.lit(False))


def orphan_references(
    refs: DataFrame,
    parents: DataFrame,
    removed: DataFrame,
    salts: int = 8,
) -> DataFrame:
    """References without a valid parent.

    ``refs`` has ``table_name``, ``record_id``, ``digest``, ``at``; ``parents`` has ``digest``,
    ``created_at``; ``removed`` has ``digest``. Result: ``table_name``, ``record_id``, ``at``,
    ``reason`` with reason ``missing``, ``deleted`` or ``late``.

    Defined cases: a null digest is no reference and yields no row; a blank or damaged one is
    ``missing``; a row repeated in full counts once; a parent listed more than once counts from its
    first ``created_at``; a null time on either side is never ``late``; an empty parent table makes
    every reference an orphan.

    The verdict is taken once per distinct digest, after a partial aggregate, so a digest that a
    third of all rows name costs one row. Rows meet their verdict in a salted join that a second
    Bloom filter, of the bad digests, has thinned out.
    """
    spark = refs.sparkSession
    refs = refs.where(F.col("digest").isNotNull())
    parents = parents.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("created_at").alias("created_at"))
    removed = removed.where(F.col("digest").isNotNull()).select("digest").distinct().withColumn("was_removed", F.lit(True))
    expected = parents.count()
    bloom = bloom_of(parents, "digest", expected)
    named = refs.groupBy("digest").agg(F.min("at").alias("first_at"))
    # written once: each later use of a filter in a plan would build it again
    named = cut(named.withColumn("maybe", might_contain(bloom, F.col("digest"), spark)))
    definite = named.where(~F.col("maybe")).select("digest", F.lit(None).cast("timestamp").alias("created_at"), F.lit(False).alias("held"))
    verified = (
        named.where(F.col("maybe"))
        .join(parents.withColumn("held", F.lit(True)), "digest", "left")
        .where(F.col("held").isNull() | (F.col("created_at") > F.col("first_at")))
        .select("digest", "created_at", F.coalesce("held", F.lit(False)).alias("held"))
    )
    bad = (
        definite.unionByName(verified)
        .join(removed, "digest", "left")
        .select("digest", "created_at", F.when(F.col("held"), "late").when(F.col("was_removed"), "deleted").otherwise("missing").alias("reason"))
    )
    bad = cut(bad)
    thin = refs.where(might_contain(bloom_of(bad, "digest", max(1000, bad.count())), F.col("digest"), spark))
    thin = thin.withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(salts)).cast("int"))
    spread = bad.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (
        thin.join(spread, ["digest", "salt"])
        .where((F.col("reason") != "late") | (F.col("created_at") > F.col("at")))
        .select("table_name", "record_id", "at", "reason")
        .distinct()
    )


def orphans_by_month(found: DataFrame) -> DataFrame:
    """Orphan records per table, month of the row's time (null where it is null) and reason."""
    month = F.date_format("at", "yyyy-MM").alias("month")
    return found.groupBy("table_name", month, "reason").agg(F.countDistinct("record_id").alias("orphans"))
