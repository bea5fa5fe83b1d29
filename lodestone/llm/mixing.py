"""Mixing sources to target weights by systematic sampling; DataFrame functions only.

Every document of a source expects target / source_size copies. Within a
source the documents stand in a fixed order (size class, hash of the id, id, size, hash of the text);
the expected copies are prefix-summed along it, one offset is added, and a
document is taken once for each integer boundary that its stretch crosses. The
order by size class makes the words that are taken come near the target. The
offset and the order depend on ids and sources only, so reruns agree.

A null source is a source of its own and the last; a null text has size 0.
Sources without words have target 0 and nothing is taken from them. Repeated
rows are documents of their own, and stand side by side. Ids keep their type. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import distributed_rank, stored

#: A target stops at so many times its source's size.
CAP = 3
WEIGHTS = (5, 2, 1)


def n_words(text_col: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple = WEIGHTS, cap: float = CAP) -> DataFrame:
    """Adds ``target`` to (source, source_size): shares by weight of the whole, none above ``cap`` times its size.

    Reshare until none is above means: the sources that stop are those with the
    least room by weight, and the others share what is left. Sorted by room,
    one pass of running sums finds where that ends. The windows run over
    sources, not documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    everything = Window.partitionBy()
    by_room = Window.orderBy("_room", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    t = sources.withColumn("_w", w).withColumn("_cap", cap * F.col("source_size").cast("double"))
    t = t.withColumn("_room", F.col("_cap") / F.col("_w")).withColumn("_all", F.sum("source_size").over(everything).cast("double")).withColumn("_weights", F.sum("_w").over(everything))
    t = t.withColumn("_level", (F.col("_all") - F.coalesce(F.sum("_cap").over(by_room), F.lit(0.0))) / (F.col("_weights") - F.coalesce(F.sum("_w").over(by_room), F.lit(0.0))))
    # a source that stops raises the level of the rest, one that need not would lower it: the highest is where stopping ends
    t = t.withColumn("_final", F.max("_level").over(everything))
    return t.select("source", "source_size", F.least("_cap", F.col("_w") * F.col("_final")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, cap: float = CAP, key_col: str | None = None, rows_per_cell: int = 1_000_000) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) for every row of ``docs``, and its ``key_col`` where ids do not tell rows apart.

    A source's rows are ranked in cells: size class, first digit of the id's hash, and where a table has
    more than ``rows_per_cell`` rows, ranges of whole-number ids, which follow the order within a digit.
    """
    key = [key_col] if key_col else []
    tie = F.xxhash64(F.col(text_col).cast("string"))
    sized = docs.select(*key, F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(text_col).alias("size"), tie.alias("tie"))
    digest = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"))
    bits = "length(bin(size))"
    sized = stored(sized.select(*key, "id", "source", "size", "tie", F.expr(f"cast({bits} * 32 + shiftright(size, greatest({bits} - 5, 0)) as long)").alias("size_class"), F.substring(digest, 1, 1).alias("part")), "sized")
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap).withColumnRenamed("source", "_source")
    place = [F.lpad(F.col("size_class").cast("string"), 6, "0"), F.col("part")]
    cells = min(64, sized.count() // rows_per_cell)
    if cells and sized.schema["id"].dataType.typeName() in ("integer", "long"):
        edges = sized.agg(F.approx_percentile("id", [k / (cells + 1) for k in range(1, cells + 1)])).first()[0] or []
        place.append(F.lpad(sum((F.coalesce((F.col("id") > e).cast("int"), F.lit(0)) for e in edges), F.lit(0)).cast("string"), 2, "0"))
    ranked = sized.withColumn("place", F.concat(*place))
    ranked = distributed_rank(ranked, ["source"], "place", ["id", "size", "tie", *key], "rank")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = (F.conv(F.substring(F.md5(F.coalesce(F.col("source"), F.lit("")).cast("binary")), 1, 6), 16, 10).cast("double") + 0.5) / 16777216.0
    joined = ranked.join(targets, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_rate", rate).withColumn("_u", offset)
    copies = F.least(F.floor(F.col("_rate") * (F.col("rank") + 1) + F.col("_u")) - F.floor(F.col("_rate") * F.col("rank") + F.col("_u")), F.ceil(F.lit(cap))).cast("long")
    return joined.select(*key, "id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


#: DuckDB SQL for op7's result.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 1) AS part
  FROM documents),
classed AS (SELECT *, length(bin(size)) * 32 + (size >> greatest(length(bin(size)) - 5, 0)) AS size_class FROM sized),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST([5, 2, 1][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER)] AS DOUBLE) AS w,
         3.0::DOUBLE * source_size AS cap, sum(source_size) OVER () :: DOUBLE AS everything FROM sources),
levels AS (
  SELECT *, (everything - coalesce(sum(cap) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, least(cap, w * max(level) OVER ()) AS target FROM levels),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size_class, part, doc_id) - 1 AS r,
         (CAST('0x' || substr(md5(coalesce(source, '')), 1, 6) AS INTEGER) + 0.5::DOUBLE) / 16777216.0::DOUBLE AS u
  FROM classed),
rated AS (
  SELECT doc_id, size, source_size, target, r, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
  FROM ranked JOIN targets ON ranked.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target,
       CAST(least(floor(rate * (r + 1) + u) - floor(rate * r + u), 3) AS BIGINT) * size AS taken
FROM rated"""
