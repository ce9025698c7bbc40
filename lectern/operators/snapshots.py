"""Snapshots of an archive, and differences between what is declared and what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def differences(declared: DataFrame, actual: DataFrame, key: str, *values: str) -> DataFrame:
    """Members that differ: ``key`` and ``difference`` (``missing``, ``unexpected`` or ``changed``).

    Null values agree with null. Members that are equal have no row; two empty sides have none.
    """
    left = declared.select(key, F.struct(*values).alias("a"), F.lit(True).alias("in_a"))
    right = actual.select(key, F.struct(*values).alias("b"), F.lit(True).alias("in_b"))
    state = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "unexpected").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return left.join(right, key, "full_outer").select(key, state.alias("difference")).where("difference is not null")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, with the side."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def compare_maps(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Counts of two maps held against each other; the least value of a key that has several counts."""
    a = left.groupBy(key).agg(F.min(value).alias("x"), F.lit(True).alias("in_a"))
    b = right.groupBy(key).agg(F.min(value).alias("y"), F.lit(True).alias("in_b"))
    both = F.col("in_a") & F.col("in_b")
    return a.join(b, key, "full_outer").agg(
        F.count_if(both).alias("overlap"),
        F.count_if(both & F.col("x").eqNullSafe(F.col("y"))).alias("agree"),
        F.count_if(both & ~F.col("x").eqNullSafe(F.col("y"))).alias("conflict"),
        F.count_if(F.col("in_b").isNull()).alias("left_only"),
        F.count_if(F.col("in_a").isNull()).alias("right_only"),
    )
