"""Joins over text keys: blanks never match, sanity and overlap reports, rank fusion inputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clean import blank_to_null


def join_nonblank(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], how: str = "inner") -> DataFrame:
    """Equi-join by (left, right) column pairs; blank keys count as null and so match nothing."""
    on = reduce(lambda a, b: a & b, (blank_to_null(left[a]) == blank_to_null(right[b]) for a, b in keys))
    return left.join(right, on, how)


def recall_link(recalls: DataFrame, complaints: DataFrame, keys: list[str], notified: str, failed: str, measures: list[str]) -> DataFrame:
    """Recalls with the number of complaints on the same keys, how many failed after the notice, and summed measures.

    Complaints are pre-aggregated by key and failure date before the join.
    Unmatched recalls keep 0 counts and null sums.
    """
    fewer = complaints.groupBy(*keys, failed).agg(F.count("*").alias("_n"), *[F.sum(m).alias(m) for m in measures])
    renamed = fewer.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(failed).alias("_failed"), "_n", *measures)
    on = reduce(lambda a, b: a & b, (F.col(k) == renamed[f"_{k}"] for k in keys))
    later = F.when(F.col("_failed") > F.col(notified), F.col("_n")).otherwise(0)
    # equal recall rows are linked once and then repeated as often as they occur
    rows = recalls.groupBy(*recalls.columns).agg(F.count("*").alias("_times"))
    linked = rows.join(renamed, on, "left").groupBy(*recalls.columns, "_times").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_complaints"), F.coalesce(F.sum(later), F.lit(0)).alias("n_after"), *[F.sum(m).alias(f"sum_{m}") for m in measures])
    return linked.withColumn("_times", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_times")))).drop("_times")


def join_sanity(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """One row: rows and distinct keys by side, matched keys, joined rows and the most rows of a key."""
    a = left.where(F.col(left_key).isNotNull()).groupBy(F.col(left_key).alias("k")).agg(F.count("*").alias("l"))
    b = right.where(F.col(right_key).isNotNull()).groupBy(F.col(right_key).alias("k")).agg(F.count("*").alias("r"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return a.join(b, "k", "full").agg(
        zero(F.sum("l")).alias("left_rows"), zero(F.sum("r")).alias("right_rows"), F.count("l").alias("left_keys"), F.count("r").alias("right_keys"),
        F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("matched_keys"), zero(F.sum(F.col("l") * F.col("r"))).alias("joined_rows"),
        F.max("l").alias("left_fan_out"), F.max("r").alias("right_fan_out"), zero(F.sum(F.when(F.col("r").isNotNull(), F.col("l")))).alias("left_matched"),
    )


def key_overlap(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Containment of distinct keys both ways: do two columns hold the same entity?"""
    s = join_sanity(left, right, left_key, right_key)
    return s.select("left_keys", "right_keys", "matched_keys", F.round(F.col("matched_keys") / F.nullif(F.col("left_keys"), F.lit(0)), 6).alias("left_contained"), F.round(F.col("matched_keys") / F.nullif(F.col("right_keys"), F.lit(0)), 6).alias("right_contained"))
