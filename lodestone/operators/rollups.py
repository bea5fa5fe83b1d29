"""Grouped reports and profiles; names of make, component, year and flags are parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import blank_to_null, digits_or, excerpt, ymd_to_date, ymd_valid, ymd_year
from .joins import join_nonblank


def complaints_by_component_year(df: DataFrame, component: str, year_col: str, year: str, k: int = 25) -> DataFrame:
    named = df.where((F.col(year_col) == year) & blank_to_null(component).isNotNull())
    return named.groupBy(component).agg(F.count("*").alias("n")).orderBy(F.desc("n"), component).limit(k)


def fire_crash_by_make(df: DataFrame, make: str, date_col: str, fire: Column, crash: Column, since: str, k: int = 25) -> DataFrame:
    recent = df.where(ymd_valid(date_col) & (ymd_year(date_col) >= since))
    out = recent.groupBy(make).agg(F.count("*").alias("n"), F.count_if(fire).alias("fires"), F.count_if(crash).alias("crashes")).where("fires > 0")
    return out.orderBy(F.desc("fires"), F.desc("n"), make).limit(k)


def harm_components(df: DataFrame, make_col: str, make: str, component: str, deaths: str, injured: str, k: int = 25) -> DataFrame:
    own = df.where(F.col(make_col) == make.strip(" ").upper())
    out = own.groupBy(component).agg(F.count("*").alias("n"), F.sum(digits_or(deaths)).alias("deaths"), F.sum(digits_or(injured)).alias("injured"))
    return out.orderBy(F.desc("deaths"), F.desc("injured"), F.desc("n"), component).limit(k)


def kpi_k_anon(df: DataFrame, keys: list[str], fire: Column, k: int = 5) -> DataFrame:
    """Counts and fire rate by key; groups of fewer than k rows are withheld."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(fire).alias("fires")).where(F.col("n") >= k)
    return out.withColumn("fire_rate_pct", F.round(100.0 * F.col("fires") / F.col("n"), 2))


def counts_by_each_date(df: DataFrame, dates: list[str], first: str, last: str) -> DataFrame:
    """The same period counted by each date column, with the blanks of each, in one pass."""
    aggs = [x for d in dates for x in (F.count_if(F.col(d).between(first, last)).alias(f"{d}_in_period"), F.count_if(blank_to_null(d).isNull()).alias(f"{d}_blank"))]
    return df.agg(*aggs)


def detect_grain(df: DataFrame, candidates: list[list[str]]) -> DataFrame:
    """Rows against distinct values of candidate keys; more rows than keys: the grain is finer than the key."""
    n = df.agg(F.count("*").alias("n_rows"), *[F.count_distinct(F.struct(*c)).alias("+".join(c)) for c in candidates])
    out = n.select("n_rows", F.explode(F.map_from_arrays(F.array(*[F.lit("+".join(c)) for c in candidates]), F.array(*[F.col("`" + "+".join(c) + "`") for c in candidates]))).alias("candidate", "n_keys"))
    return out.select("candidate", "n_rows", "n_keys", (F.col("n_rows") == F.col("n_keys")).alias("is_key"))


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows and blanks by column, in one pass."""
    one = df.agg(F.count("*").alias("n_rows"), *[F.count_if(blank_to_null(F.col(c).cast("string")).isNull()).alias(c) for c in columns])
    return one.unpivot(["n_rows"], columns, "column_name", "n_blank").select("column_name", "n_rows", "n_blank")


def profile_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Min, max, mean, distinct and blank counts of digits-only text by column."""
    number = lambda c: digits_or(c, None)
    aggs = [x for c in columns for x in (F.min(number(c)).alias(f"{c}_min"), F.max(number(c)).alias(f"{c}_max"), F.round(F.avg(number(c)), 6).alias(f"{c}_mean"), F.count_distinct(c).alias(f"{c}_distinct"), F.count_if(blank_to_null(c).isNull()).alias(f"{c}_blank"))]
    return df.agg(*aggs)


def profile_dates(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column of yyyyMMdd text: first and last date, blank and malformed counts, in one pass."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in columns])).alias("c")
    on = ymd_to_date("value")
    blank = blank_to_null("value").isNull()
    return df.select(each).select("c.*").groupBy("column_name").agg(F.count("*").alias("n_rows"), F.min(on).alias("first_date"), F.max(on).alias("last_date"), F.count_if(blank).alias("n_blank"), F.count_if(~blank & on.isNull()).alias("n_malformed"))


def text_samples(df: DataFrame, column: str, key: str, k: int = 5, width: int = 80) -> DataFrame:
    """The k texts with the smallest hash of their key: the same ones on every run, without a sort of the table."""
    some = df.where(blank_to_null(column).isNotNull())
    return some.orderBy(F.xxhash64(key), key).limit(k).select(key, F.length(column).alias("n_text"), excerpt(column, width).alias("beginning"))


def top_values(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(k)


def date_histogram(df: DataFrame, date_col: str) -> DataFrame:
    """Rows by well-formed yyyyMMdd date."""
    return df.where(ymd_valid(date_col)).groupBy(date_col).agg(F.count("*").alias("n"))


def by_component_year(facts: DataFrame) -> DataFrame:
    """Counts, fires, crashes, injured and killed by component and model year, over de-identified facts."""
    return facts.where("component IS NOT NULL").groupBy("component", "model_year").agg(F.count("*").alias("n"), F.count_if("fire").alias("fires"), F.count_if("crash").alias("crashes"), F.sum("injured").alias("injured"), F.sum("killed").alias("killed"))


def by_make_year(facts: DataFrame) -> DataFrame:
    """Counts, fires, crashes and the first and last failure by make and model year, over de-identified facts."""
    return facts.where("make IS NOT NULL").groupBy("make", "model_year").agg(F.count("*").alias("n"), F.count_if("fire").alias("fires"), F.count_if("crash").alias("crashes"), F.min("failed_on").alias("first_failure"), F.max("failed_on").alias("last_failure"))


def distinct_counts(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """Distinct values by column, exact or by sketches of bounded size."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(F.count("*").alias("n_rows"), *[count(F.col(c)).alias(c) for c in columns])


def recalls_by_component(investigations: DataFrame, recalls: DataFrame, campaign: tuple[str, str], component: str, k: int = 25) -> DataFrame:
    """Investigations that led to a recall, by the recall's component: joined rows and distinct campaigns, which differ where a campaign has many rows.

    Both sides are counted by campaign before they meet, so a frequent campaign costs no more than a rare one.
    """
    left = investigations.groupBy(F.col(campaign[0]).alias("_campaign")).agg(F.count("*").alias("_l"))
    right = recalls.groupBy(F.col(campaign[1]).alias("_recalled"), F.col(component).alias("component")).agg(F.count("*").alias("_r"))
    joined = join_nonblank(left, right, [("_campaign", "_recalled")])
    return joined.groupBy("component").agg(F.sum(F.col("_l") * F.col("_r")).alias("n_rows"), F.count_distinct("_campaign").alias("n_campaigns")).orderBy(F.desc("n_rows"), F.asc_nulls_last("component")).limit(k)


def complaints_under_investigation(complaints: DataFrame, investigations: DataFrame, make_col: str, make: str, keys: list[tuple[str, str]], subject: str) -> DataFrame:
    """For one make: complaints by model and year, and each subject of an investigation of the same vehicle. Complaints are counted first."""
    left = [a for a, _ in keys]
    counted = complaints.where(F.col(make_col) == make).groupBy(*left).agg(F.count("*").alias("n_complaints"))
    subjects = investigations.select(*[F.col(b).alias(f"_{a}") for a, b in keys], F.col(subject).alias("subject")).distinct()
    return join_nonblank(counted, subjects, [(a, f"_{a}") for a in left]).select(*left, "n_complaints", "subject")


def assert_scalars(facts: dict[str, tuple[DataFrame, Column, object]]) -> DataFrame:
    """(name, expected, found, holds) for each named aggregate: does the data say what a test was written for?"""
    rows = [df.agg(value.cast("string").alias("found")).select(F.lit(name).alias("name"), F.lit(str(expected)).alias("expected"), "found") for name, (df, value, expected) in facts.items()]
    return reduce(DataFrame.unionByName, rows).withColumn("holds", F.col("found").eqNullSafe(F.col("expected")))


def assert_scalar(facts: dict[str, tuple[DataFrame, Column, object]]) -> DataFrame:
    """One row: do all of them hold?"""
    return assert_scalars(facts).agg(F.bool_and("holds").alias("holds"))


def newest_per_key(df: DataFrame, key: str, at: str, id_col: str) -> DataFrame:
    """The newest row's id of each key; of equal times the larger id."""
    return df.groupBy(key).agg(F.max(F.struct(at, id_col)).alias("_n")).select(key, F.col(f"_n.{id_col}").alias(id_col))


def counts_by_json(df: DataFrame, column: str, path: str, keys: list[str]) -> DataFrame:
    """Rows by a whole number inside JSON text, and by other columns."""
    return df.groupBy(F.get_json_object(column, path).cast("bigint").alias("k"), *keys).agg(F.count("*").alias("n"))
