"""Column expressions for all-text tables: blanks, sentinels, digits, dates, flags and excerpts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: str | Column, trim: bool = True) -> Column:
    return F.nullif(F.btrim(col(c)) if trim else col(c), F.lit(""))


def sentinel_to_null(c: str | Column, sentinel: str = "9999") -> Column:
    return F.nullif(col(c), F.lit(sentinel))


def digits_or(c: str | Column, default: int | None = 0) -> Column:
    """The number if the text is digits only; text that is not never aborts a job."""
    return F.when(col(c).rlike("^[0-9]+$"), col(c).try_cast("bigint")).otherwise(F.lit(default).cast("bigint"))


def ymd_to_date(c: str | Column) -> Column:
    """yyyyMMdd text as a date; blank and impossible dates are null."""
    return F.to_date(F.try_to_timestamp(F.nullif(col(c), F.lit("")), F.lit("yyyyMMdd")))


def ymd_valid(c: str | Column) -> Column:
    return col(c).rlike("^[0-9]{8}$")


def ymd_year(c: str | Column) -> Column:
    return F.substring(col(c), 1, 4)


def ymd_between(c: str | Column, first: str, last: str) -> Column:
    return ymd_valid(c) & col(c).between(first, last)


def flag_true(c: str | Column) -> Column:
    return col(c) == "Y"


def not_flagged(c: str | Column) -> Column:
    return F.coalesce(col(c), F.lit("N")) != "Y"


def text_length(c: str | Column) -> Column:
    return F.length(F.coalesce(col(c), F.lit("")))


def excerpt(c: str | Column, n: int) -> Column:
    return F.left(F.regexp_replace(col(c), r"\s+", " "), F.lit(n))


def whole_number(c: str | Column) -> Column:
    """The number of a text, null where it is none."""
    return F.nullif(F.btrim(col(c)), F.lit("")).try_cast("bigint")


def typed_complaints(df: DataFrame, ids: dict[str, str], numbers: dict[str, str], dates: dict[str, str], flags: dict[str, str], texts: dict[str, str]) -> DataFrame:
    """A typed view of an all-text table: friendly name -> source column, by kind. Flags are true, false, or null where blank."""
    kinds = ((ids, whole_number), (numbers, digits_or), (dates, ymd_to_date), (flags, lambda c: flag_true(blank_to_null(c))), (texts, blank_to_null))
    return df.select(*[as_type(c).alias(name) for columns, as_type in kinds for name, c in columns.items()])


def exclude_columns(df: DataFrame, denied: list[str]) -> DataFrame:
    """A copy without the denied columns; a name that is not there is an error, so that a misspelt one does not leave data in."""
    unknown = sorted(set(denied) - set(df.columns))
    if unknown:
        raise ValueError(f"no such columns: {', '.join(unknown)}")
    return df.drop(*denied)


def distinct_literals(df: DataFrame, column: str, term: str, k: int = 20) -> DataFrame:
    """The stored values that contain a term, in any case; % and _ of the term are taken literally."""
    literal = term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return df.where(F.col(column).ilike(f"%{literal}%")).select(F.col(column).alias("value")).distinct().orderBy("value").limit(k)


def clock(c: str | Column) -> Column:
    """A time as HH:mm:ss.SSS."""
    return F.date_format(col(c), "HH:mm:ss.SSS")
