"""Landing delimited text without losing or shifting a value, and writing it idempotently."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.clean import blank_to_null

#: cp1252's characters for bytes 0x80 to 0x9F that it defines (fixed values).
CP1252 = {0x80: "€", 0x82: "‚", 0x83: "ƒ", 0x84: "„", 0x85: "…", 0x86: "†", 0x87: "‡", 0x88: "ˆ", 0x89: "‰", 0x8A: "Š", 0x8B: "‹", 0x8C: "Œ", 0x8E: "Ž", 0x91: "‘", 0x92: "’", 0x93: "“", 0x94: "”", 0x95: "•", 0x96: "–", 0x97: "—", 0x98: "˜", 0x99: "™", 0x9A: "š", 0x9B: "›", 0x9C: "œ", 0x9E: "ž", 0x9F: "Ÿ"}
UNDEFINED = "\x81\x8d\x8f\x90\x9d"


class FieldCountError(ValueError):
    """A file has rows with another number of fields than its schema."""


def resolve_parts(spark: SparkSession, candidates: list[str]) -> list[str]:
    """Those of the candidate files that exist, in order; none is an error that names all."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    found = [c for c in candidates if path(c).getFileSystem(hadoop).exists(path(c))]
    if not found:
        raise FileNotFoundError(f"none of {', '.join(candidates)} exists")
    return found


def decode_fallback(raw: Column) -> tuple[Column, Column]:
    """Text by UTF-8, else cp1252, else latin-1; and whether it needed a fallback."""
    latin = F.decode(raw.cast("binary"), "ISO-8859-1")
    mapped = F.translate(latin, "".join(map(chr, CP1252)), "".join(CP1252.values()))
    good = F.is_valid_utf8(raw)
    text = F.when(good, raw).when(latin.rlike(f"[{UNDEFINED}]"), latin).otherwise(mapped)
    return text, ~good


def read_lines(spark: SparkSession, paths: list[str], separator: str = "\t") -> DataFrame:
    """(file, line text without its CR, fields, fallback, blank), split on LF only; quotes mean nothing."""
    raw = spark.read.option("lineSep", "\n").text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    text, fallback = decode_fallback(F.col("value"))
    lines = raw.select("file", F.regexp_replace(text, r"\r$", "").alias("line"), fallback.alias("fallback"))
    return lines.select("file", "line", "fallback", F.split("line", separator, -1).alias("fields"), (F.btrim(F.regexp_replace("line", r"\s", "")) == "").alias("blank"))


def check_field_count(lines: DataFrame, expected: int) -> None:
    wrong = lines.where(~F.col("blank") & (F.size("fields") != expected)).groupBy("file", F.size("fields").alias("found")).count().orderBy("file", "found").limit(20).collect()
    if wrong:
        raise FieldCountError("; ".join(f"{r['file']}: {r['count']} rows with {r['found']} fields, expected {expected}" for r in wrong))


def land_delimited(spark: SparkSession, paths: list[str], schema: T.StructType, separator: str = "\t") -> DataFrame:
    """All fields as text, '' kept; a wrong field count refuses the load before anything is written."""
    lines = read_lines(spark, resolve_parts(spark, paths), separator)
    check_field_count(lines, len(schema))
    return lines.where(~F.col("blank")).select(*[F.col("fields")[i].alias(f.name) for i, f in enumerate(schema)])


def line_report(lines: DataFrame) -> DataFrame:
    """Lines, blank lines and decoded-by-fallback lines by file."""
    return lines.groupBy("file").agg(F.count("*").alias("lines"), F.count_if("blank").alias("blank_lines"), F.count_if("fallback").alias("fallback_lines"))


def most_recent_n(df: DataFrame, date_col: str, n: int, tie: list[str]) -> DataFrame:
    """The n newest rows by yyyyMMdd text, blanks about it aside; malformed dates are left out. Two passes and a histogram, no global sort.

    The histogram has a row a day. The first pass runs when this is called: it tells the day at which the n-th
    row lies, and how many rows of that day are taken, each task's first ones by ``tie`` being merged.
    """
    day = F.btrim(F.col(date_col))
    valid = df.where(day.rlike("^[0-9]{8}$"))
    newest = Window.orderBy(F.col("_day").desc()).rowsBetween(Window.unboundedPreceding, 0)
    days = valid.groupBy(day.alias("_day")).agg(F.count("*").alias("_n")).withColumn("_sum", F.sum("_n").over(newest))
    cut = days.where(F.col("_sum") - F.col("_n") < n).orderBy("_day").first()
    if cut is None:
        return valid.limit(0)
    at = valid.where(day == cut["_day"]).orderBy(*tie).limit(n - cut["_sum"] + cut["_n"])
    return valid.where(day > cut["_day"]).unionByName(at)


def load_summary(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows and the range of non-blank dates by table."""
    parts = [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"), F.min(blank_to_null(c)).alias("first_date"), F.max(blank_to_null(c)).alias("last_date")) for name, (df, c) in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def overwrite_table(df: DataFrame, path: str, partition_by: list[str] | None = None, sort_by: list[str] | None = None) -> None:
    """Replace a table, so that reruns do not double it; sorted files let readers skip by their ranges."""
    out = df.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by) if sort_by else df
    writer = out.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_layout(df: DataFrame, path: str, order: list[str], partition: list[str] | None = None, blooms: list[str] | None = None, row_group_bytes: int = 128 << 20) -> None:
    """Write a table for selective reads: folders by ``partition``, rows in ranges of ``order`` and sorted, so that the smallest and largest values of files and row groups exclude most of them, and bloom filters for columns that are looked up but not sorted by."""
    keys = [*(partition or []), *order]
    writer = df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").option("parquet.block.size", row_group_bytes)
    for c in blooms or []:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def append_report(df: DataFrame, path: str, purposes: list[str]) -> None:
    """Append rows, stamped with writer and time; a purpose out of the list or missing text fails the job."""
    ok = F.col("purpose").isin(purposes) & F.col("title").isNotNull() & F.col("findings").isNotNull()
    checked = df.where(F.assert_true(F.coalesce(ok, F.lit(False)), F.lit("purpose, title or findings not allowed")).isNull())
    checked.withColumn("written_by", F.current_user()).withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(path)


def sample_narratives(df: DataFrame, text_col: str, want: int, rows: int, seed: int = 42, least: int = 40) -> DataFrame:
    """A sample of at most ``want`` longer texts: a share of three times that, within 1 and 100 percent, then a limit.

    ``sample_report`` tells whether it came to less than half of what was wanted.
    """
    share = min(100.0, max(1.0, want * 300.0 / max(rows, 1))) / 100.0
    return df.sample(share, seed).where(F.length(F.btrim(F.col(text_col))) > least).limit(want)


def sample_report(sample: DataFrame, want: int) -> DataFrame:
    n = F.count("*")
    return sample.agg(n.alias("n_rows"), F.lit(want).alias("wanted"), (n * 2 < want).alias("too_few"))


def with_identity(df: DataFrame, keys: list[str], name: str = "id") -> DataFrame:
    """A repeatable surrogate key from the natural one."""
    return df.withColumn(name, F.xxhash64(*keys))
