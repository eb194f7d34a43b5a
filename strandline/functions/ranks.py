"""Exact order statistics for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS = 64

# Digits after the point that sums keep.
SUM_TYPE = "decimal(28,9)"


def exact_sum(value: Column) -> Column:
    """Sum as a decimal: the same whatever the order in which partitions add up."""
    return F.sum(value.cast(SUM_TYPE))


def exact_mean(value: Column) -> Column:
    """Mean from an exact sum; null without values."""
    return exact_sum(value).cast("double") / F.nullif(F.count(value), F.lit(0))


def values_at(df: DataFrame, keys: Sequence[str], value: str, picks: dict[str, Column]) -> DataFrame:
    """Values at 0-based sorted positions; each pick is an expression of the group size ``n``.

    Equal values collapse to a counted row first. Approximate quantiles (bounded, mergeable)
    then give every group equal-depth buckets, exact bucket counts locate the wanted ranks,
    and only rows of those buckets are put in order. The result is exact.
    """
    keys = list(keys)
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    steps = F.lit([i / CUTS for i in range(1, CUTS)])
    cuts = counted.groupBy(*keys).agg(
        F.percentile_approx(value, steps, F.lit(1000)).alias("__cuts"), F.sum("__c").alias("n")
    )
    placed = counted.join(cuts, keys).withColumn(
        "__b", F.size(F.filter("__cuts", lambda c: c < F.col(value)))
    ).drop("__cuts")
    buckets = placed.groupBy(*keys, "__b").agg(F.sum("__c").alias("__bc"), F.first("n").alias("n"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("__start", F.coalesce(F.sum("__bc").over(before), F.lit(0)))
    wanted = F.array(*[p.cast("bigint") for p in picks.values()])
    buckets = buckets.withColumn("__wanted", wanted).filter(
        F.exists("__wanted", lambda w: (w >= F.col("__start")) & (w < F.col("__start") + F.col("__bc")))
    )
    inside = placed.drop("n").join(buckets.select(*keys, "__b", "__start", "__wanted", "n"), [*keys, "__b"])
    order = Window.partitionBy(*keys, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("__end", F.col("__start") + F.sum("__c").over(order))
    first = F.col("__end") - F.col("__c")
    return inside.groupBy(*keys).agg(
        *[
            F.max(F.when((F.col("__wanted")[i] >= first) & (F.col("__wanted")[i] < F.col("__end")), F.col(value))).alias(n)
            for i, n in enumerate(picks)
        ]
    )


def median_and_p99(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Interpolated median, and the nearest-rank 99th percentile at position floor(0.99 n)."""
    n = F.col("n")
    got = values_at(
        df, keys, value,
        {
            "__low": F.floor((n - 1) / 2),
            "__high": F.floor(n / 2),
            "p99": F.least(F.floor(n * F.lit(0.99)), n - 1),
        },
    )
    return got.select(*keys, ((F.col("__low") + F.col("__high")) / 2).alias("p50"), "p99")
