"""Relationships between tables as edges: upsert, join paths, suggestions, subgraphs and checks against data.

Edges: id, left_object, left_columns, right_object, right_columns, kind, confidence, and if given source and description.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import HashingEmbedder
from . import catalog
from .joins import join_sanity

IDENTITY = ["left_object", "left_columns", "right_object", "right_columns", "kind"]


def join_expression(left: str, left_columns, right: str, right_columns):
    each = F.zip_with(left_columns, right_columns, lambda a, b: F.concat(F.col(left), F.lit("."), a, F.lit(" = "), F.col(right), F.lit("."), b))
    return F.array_join(each, " AND ")


def upsert(edges: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges after the upsert, and (identity, action): rows of one identity replace the older one."""
    keyed = new.withColumn("id", F.xxhash64(*IDENTITY)).dropDuplicates(["id"])
    action = keyed.join(edges.select("id", F.lit(True).alias("_old")), "id", "left").select("id", F.when(F.col("_old"), "updated").otherwise("inserted").alias("action"))
    return edges.join(keyed, "id", "left_anti").unionByName(keyed.select(*edges.columns)), action


def listed(edges: DataFrame, source: str | None = None) -> DataFrame:
    """Edges with their rendered condition, of one source if asked."""
    own = edges if source is None else edges.where(F.col("source") == source)
    return own.withColumn("on", join_expression("left_object", "left_columns", "right_object", "right_columns"))


def deleted(edges: DataFrame, ids: list[int]) -> DataFrame:
    return edges.where(~F.col("id").isin(ids))


def crawl_foreign_keys(keys: DataFrame) -> DataFrame:
    """Edges of declared keys (constraint, position, left_object, left_column, right_object, right_column): columns of one constraint stay together, in order."""
    each = keys.groupBy("constraint", "left_object", "right_object").agg(F.sort_array(F.collect_list(F.struct("position", "left_column", "right_column"))).alias("c"))
    columns = lambda side: F.transform("c", lambda x: x[side])
    edges = each.select("left_object", columns("left_column").alias("left_columns"), "right_object", columns("right_column").alias("right_columns"), F.lit("foreign key").alias("kind"), F.lit(1.0).alias("confidence"), F.lit("crawl").alias("source"))
    return edges.withColumn("id", F.xxhash64(*IDENTITY))


def inclusions(tables: dict[str, DataFrame], columns: dict[str, list[str]] | None = None, kinds: tuple = ("bigint", "int", "smallint", "string", "date")) -> DataFrame:
    """(left_object, left_column, right_object, right_column, left_keys, right_keys, matched_keys, containment) of all pairs of columns that share a value.

    One pass over all tables: distinct values by column, then the set of columns of each value, and pairs of that set,
    which has at most as many members as there are columns. Whole numbers are compared with whole numbers alone.
    """
    number = lambda kind: kind in ("bigint", "int", "smallint")
    parts = []
    for name, df in sorted(tables.items()):
        own = [(c, k) for c, k in df.dtypes if k in kinds and (columns is None or c in columns.get(name, []))]
        if own:
            cells = F.array(*[F.struct(F.lit(c).alias("column"), F.lit("number" if number(k) else k).alias("kind"), F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).alias("value")) for c, k in own])
            parts.append(df.select(F.lit(name).alias("object"), F.explode(cells).alias("x")).select("object", "x.*").where("value is not null").distinct())
    values = reduce(DataFrame.unionByName, parts)
    sets = values.groupBy("kind", "value").agg(F.sort_array(F.collect_list(F.struct("object", "column"))).alias("s"))
    pairs = sets.select(F.explode("s").alias("l"), "s").select("l", F.explode("s").alias("r")).groupBy("l", "r").agg(F.count("*").alias("matched_keys"))
    sizes = pairs.where("l = r").select(F.col("l").alias("_c"), F.col("matched_keys").alias("_n"))
    found = pairs.where("l <> r").join(sizes.toDF("l", "left_keys"), "l").join(sizes.toDF("r", "right_keys"), "r")
    return found.select(F.col("l.object").alias("left_object"), F.col("l.column").alias("left_column"), F.col("r.object").alias("right_object"), F.col("r.column").alias("right_column"), "left_keys", "right_keys", "matched_keys", F.round(F.col("matched_keys") / F.col("left_keys"), 6).alias("containment"))


def candidate_keys(tables: dict[str, DataFrame], columns: dict[str, list[str]] | None = None, at_least: float = 1.0) -> DataFrame:
    """Edges that the data suggests: columns whose values a unique column of another table contains, to the share ``at_least``."""
    found = inclusions(tables, columns).where((F.col("containment") >= at_least) & (F.col("left_object") != F.col("right_object")))
    rows = reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("_rows")).select(F.lit(name).alias("right_object"), "_rows") for name, df in sorted(tables.items())])
    unique = found.join(rows, "right_object").where("right_keys = _rows")
    edges = unique.select("left_object", F.array("left_column").alias("left_columns"), "right_object", F.array("right_column").alias("right_columns"), F.lit("candidate").alias("kind"), F.col("containment").alias("confidence"), F.lit("data").alias("source"))
    return edges.withColumn("id", F.xxhash64(*IDENTITY))


def subgraph_of(edges: DataFrame, kb: DataFrame, query: str, embedder: HashingEmbedder, top_k: int = 5, max_hops: int = 2, decay: float = 0.5) -> DataFrame:
    """(a, b, on, kind, confidence, hop, score): edges within hops of the tables that a question means.

    Seeds are the relations of the catalogue rows that ``catalog.search`` ranks best, with their scores; an object that a hop
    reaches gets the best score that leads to it, times ``decay`` and the edge's confidence.
    """
    seeds = catalog.search(kb, query, embedder, top_k).where("relation_name is not null").groupBy(F.col("relation_name").alias("object")).agg(F.max("rrf_score").alias("score"))
    steps, seen, frontier, out = both_ways(edges), seeds, seeds, None
    for hop in range(1, max_hops + 1):
        met = steps.join(frontier, steps.a == frontier.object).select("a", "b", "on", "kind", "confidence", F.lit(hop).alias("hop"), "score")
        out = met if out is None else out.unionByName(met)
        if hop < max_hops:
            reached = met.groupBy(F.col("b").alias("object")).agg(F.max(F.col("score") * decay * F.col("confidence")).alias("score"))
            frontier = reached.join(seen, "object", "left_anti")
            seen = seen.unionByName(frontier)
    return out.withColumn("score", F.round("score", 9))


def catalogue_rows(edges: DataFrame) -> DataFrame:
    """Edges as catalogue rows, so that a description finds them: `left -> right [kind]`."""
    name = F.concat_ws(" ", F.concat_ws(" -> ", "left_object", "right_object"), F.concat(F.lit("["), "kind", F.lit("]")))
    return listed(edges).select(F.lit("relationship").alias("source_type"), F.lit("relationship").alias("entity_type"), F.col("left_object").alias("relation_name"), F.lit(None).cast("string").alias("column_name"), name.alias("object_ref"), F.col("on").alias("definition"), F.col("description").alias("comment"))


def search(edges: DataFrame, query: str, embedder: HashingEmbedder, top_k: int = 10, min_similarity: float = 0.0) -> DataFrame:
    """Edges by what their descriptions mean."""
    rows = catalog.embed_catalog(catalogue_rows(edges), embedder)
    return catalog.search(rows, query, embedder, top_k, ["relationship"], min_similarity).select("object_ref", "definition", "comment", "rrf_score")


def both_ways(edges: DataFrame) -> DataFrame:
    there = edges.select(F.col("left_object").alias("a"), F.col("right_object").alias("b"), join_expression("left_object", "left_columns", "right_object", "right_columns").alias("on"), "kind", "confidence")
    return there.unionByName(there.select(F.col("b").alias("a"), F.col("a").alias("b"), "on", "kind", "confidence"))


def suggest_joins(edges: DataFrame, objects: list[str]) -> DataFrame:
    return both_ways(edges).where(F.col("a").isin(objects))


def find_join_path(edges: DataFrame, start: str, end: str, max_hops: int = 4) -> DataFrame:
    """Simple routes by hops, then confidence; the frontier grows by one join a hop."""
    steps = both_ways(edges)
    frontier = steps.where(F.col("a") == start).select(F.array("a", "b").alias("route"), F.array("on").alias("ons"), F.array("kind").alias("kinds"), F.col("confidence").alias("weight"), F.col("b").alias("at"))
    found = frontier.where(F.col("at") == end)
    for _ in range(max_hops - 1):
        frontier = frontier.where(F.col("at") != end).join(steps, F.col("at") == F.col("a")).where(~F.array_contains("route", F.col("b")))
        frontier = frontier.select(F.concat("route", F.array("b")).alias("route"), F.concat("ons", F.array("on")).alias("ons"), F.concat("kinds", F.array("kind")).alias("kinds"), (F.col("weight") * F.col("confidence")).alias("weight"), F.col("b").alias("at"))
        found = found.unionByName(frontier.where(F.col("at") == end))
    out = found.select((F.size("route") - 1).alias("hops"), F.array_join("route", " -> ").alias("route"), F.array_join("kinds", ", ").alias("kinds"), "weight", F.array_join("ons", " ; ").alias("on_clauses"))
    order = ("hops", F.desc("weight"), "route", "on_clauses")  # routes between two tables of a schema are few
    return out.withColumn("rank", F.row_number().over(Window.orderBy(*order))).orderBy(*order)


def subgraph(edges: DataFrame, seeds: DataFrame, max_hops: int = 2) -> DataFrame:
    """Edges within hops of the seed objects (object); a hop goes on from the objects that the last one found."""
    steps = both_ways(edges)
    seen = frontier = seeds.select("object").distinct()
    for _ in range(max_hops - 1):
        frontier = steps.join(frontier, steps.a == frontier.object, "left_semi").select(F.col("b").alias("object")).distinct().join(seen, "object", "left_anti")
        seen = seen.union(frontier)
    return steps.join(seen, steps.a == seen.object, "left_semi")


def verify(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Cardinality by data, and the share of left rows with no key, and with a key that the right side lacks."""
    s = join_sanity(left, right, left_key, right_key)
    many = F.concat(F.when(F.col("left_fan_out") > 1, "n").otherwise("1"), F.lit("-"), F.when(F.col("right_fan_out") > 1, "n").otherwise("1"))
    rows = left.agg(F.count("*").alias("_rows"))
    share = lambda n: F.coalesce(F.round(n / F.nullif(F.col("_rows"), F.lit(0)), 6), F.lit(0.0))
    return s.crossJoin(rows).select(many.alias("cardinality"), "matched_keys", "left_keys", "right_keys", "joined_rows", share(F.col("_rows") - F.col("left_rows")).alias("blank_share"), share(F.col("left_rows") - F.col("left_matched")).alias("unmatched_share"))  # one row each
