"""Queries that clients ask first: catalogue searches, context of a question, saved queries, relationships by words; with their DuckDB SQL.

Catalogue rows are documents with the vectors that the tables have, so that SQL can rank every arm.
``registry`` imports this module last, so one dictionary holds all queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexical
from ..functions.vectors import HashingEmbedder
from ..operators import aliases, catalog, relations, search, store
from . import lexical_sql, registry
from .registry import query, t

ASKED, FLOOR = "thention ershan theing", 0.1


class Given:
    """An embedder whose question has a vector already."""

    def __init__(self, vector: list[float]):
        self.vector = vector

    def encode_query(self, text: str) -> list[float]:
        return self.vector


def vector_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh document is a saved query, others are tables, views and columns; every fifth has no comment."""
    doc_id = F.col("doc_id")
    alias = doc_id % 7 == 0
    kind = F.when(alias, "alias").when(doc_id % 3 == 0, "table").when(doc_id % 3 == 1, "view").otherwise("column")
    rows = t(spark, sf_dir, "documents").join(t(spark, sf_dir, "embeddings"), F.col("vec_id") == doc_id, "left")
    return rows.select(
        F.when(alias, "alias").otherwise("schema").alias("source_type"), kind.alias("entity_type"), F.col("source").alias("relation_name"), F.col("lang").alias("column_name"),
        F.concat(F.lit("d"), doc_id.cast("string")).alias("object_ref"), F.col("text").alias("definition"), F.when(doc_id % 5 > 0, F.concat_ws(" ", "source", "lang")).alias("comment"),
        F.col("embedding").alias("definition_vec"), F.reverse("embedding").alias("comment_vec"),
    )


KB = """kb AS MATERIALIZED (SELECT CASE WHEN doc_id % 7 = 0 THEN 'alias' ELSE 'schema' END AS source_type, CASE WHEN doc_id % 7 = 0 THEN 'alias' WHEN doc_id % 3 = 0 THEN 'table' WHEN doc_id % 3 = 1 THEN 'view' ELSE 'column' END AS entity_type,
 source AS relation_name, lang AS column_name, 'd' || doc_id AS object_ref, text AS definition, CASE WHEN doc_id % 5 > 0 THEN concat_ws(' ', source, lang) END AS comment,
 CAST(embedding AS DOUBLE[]) AS definition_vec, list_reverse(CAST(embedding AS DOUBLE[])) AS comment_vec FROM documents LEFT JOIN embeddings ON vec_id = doc_id)"""
_TEXTS = "kbt AS (SELECT object_ref AS doc_id, '' AS lang, concat_ws(' ', regexp_replace(object_ref, '[._]', ' ', 'g'), definition, comment) AS text FROM kb)"


def _words(asked: str) -> str:
    return f"{_TEXTS}, {lexical_sql.covers(lexical.parse_web_query(' OR '.join(asked.split())), 'kbt')}"


def _best(name: str, k: int, where: str = "true", arms: tuple = ("definition", "comment", "words"), offset: int = 0) -> str:
    """A CTE (object_ref, ranks, rrf_score): every row that an arm finds is ranked in it, and the fused rows are cut."""
    near = "round(list_cosine_similarity({}, (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 12)"
    floored = lambda c, also: f"CASE WHEN {near.format(c)} >= {FLOOR} AND {also} THEN {near.format(c)} END"
    score = {"definition": floored("definition_vec", "true"), "comment": floored("comment_vec", "comment IS NOT NULL"), "words": "round(score, 6)"}
    scores = ", ".join(f"{score[a]} AS {a}" for a in arms)
    ranks = ", ".join(f"CASE WHEN {a} IS NOT NULL THEN rank() OVER (ORDER BY {a} DESC NULLS LAST) END AS {a}_rank" for a in arms)
    total = " + ".join(f"coalesce(1.0::DOUBLE / (60 + {a}_rank), 0.0::DOUBLE)" for a in arms)
    found = " OR ".join(f"{a}_rank IS NOT NULL" for a in arms)
    words = "LEFT JOIN m ON m.doc_id = object_ref" if "words" in arms else ""
    return f"{name} AS (SELECT *, {total} AS rrf_score FROM (SELECT object_ref, {ranks} FROM (SELECT object_ref, {scores} FROM kb {words} WHERE {where})) WHERE {found} ORDER BY rrf_score DESC, object_ref LIMIT {k} OFFSET {offset})"


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str, Given]:
    return vector_catalog(spark, sf_dir), ASKED, Given(registry.query_vector(spark, sf_dir))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("rrf_score", F.round("rrf_score", 9))


@query(f"WITH {KB}, {_words(ASKED)}, {_best('b', 50)} SELECT object_ref, entity_type, definition_rank, comment_rank, words_rank, round(rrf_score, 9) AS rrf_score FROM b JOIN kb USING (object_ref)")
def kb_search(spark, sf_dir):
    """Three arms over the whole catalogue, fused."""
    found = catalog.search(*_asked(spark, sf_dir), 50, min_similarity=FLOOR)
    return _rounded(found).select("object_ref", "entity_type", "definition_rank", "comment_rank", "words_rank", "rrf_score")


@query(f"WITH {KB}, {_words(ASKED)}, {_best('b', 40, "entity_type = 'column'", ('definition', 'words'), 5)} SELECT object_ref, definition FROM b JOIN kb USING (object_ref)")
def column_definitions(spark, sf_dir):
    return catalog.column_definitions(*_asked(spark, sf_dir), FLOOR, 40, 5)


@query(f"WITH {KB}, {_words(ASKED)}, {_best('b', 40, "entity_type IN ('table', 'view')")} SELECT object_ref, entity_type, definition, comment, round(rrf_score, 9) AS rrf_score FROM b JOIN kb USING (object_ref)")
def entity_definitions(spark, sf_dir):
    return _rounded(catalog.entity_definitions(*_asked(spark, sf_dir), FLOOR, 40))


@query(f"WITH {KB}, {_best('b', 40, arms=('comment',), offset=3)} SELECT object_ref, entity_type, comment, round(rrf_score, 9) AS rrf_score FROM b JOIN kb USING (object_ref)")
def search_by_comment(spark, sf_dir):
    return _rounded(catalog.search_by_comment(*_asked(spark, sf_dir), FLOOR, 40, 3))


@query(f"WITH {KB}, {_best('b', 40, arms=('definition',))} SELECT object_ref, source_type, entity_type, relation_name, column_name, round(rrf_score, 9) AS rrf_score FROM b JOIN kb USING (object_ref)")
def object_metadata(spark, sf_dir):
    return _rounded(catalog.metadata(*_asked(spark, sf_dir), FLOOR, 40))


@query(f"WITH {KB}, {_words(ASKED)}, {_best('b', 25, "source_type = 'schema'")}, {_best('c', 25, "source_type = 'alias'")} SELECT part, object_ref, entity_type, definition, comment, round(rrf_score, 9) AS rrf_score FROM (SELECT 'schema' AS part, object_ref, rrf_score FROM b UNION ALL SELECT 'alias', object_ref, rrf_score FROM c) JOIN kb USING (object_ref)")
def discover_context(spark, sf_dir):
    """Schema matches and saved queries for one question."""
    return _rounded(catalog.discover_context(*_asked(spark, sf_dir), FLOOR, 25))


@query(f"WITH {KB} SELECT 'documents' AS name, 64 AS dimension, entity_type, count(*) AS n FROM kb GROUP BY entity_type")
def catalogues(spark, sf_dir):
    """Two catalogues are stored and one dropped; another session opens the folder, and the one that is left needs no name."""
    rows, path = vector_catalog(spark, sf_dir), store.new_folder(spark, "catalogues")
    kept = catalog.Catalogues(spark, path)
    kept.add("old", rows.where("entity_type = 'alias'"), HashingEmbedder(64), ["documents"])
    kept.drop("old")
    kept.add("documents", rows, HashingEmbedder(64), ["documents"])
    again = catalog.Catalogues(spark, path)
    return again.list().select("name", "dimension").join(again.get().groupBy("entity_type").agg(F.count("*").alias("n")))


@query(f"WITH {KB}, c AS (SELECT object_ref, comment, CASE object_ref WHEN 'd1' THEN 'amount due' WHEN 'd2' THEN NULL WHEN 'd5' THEN NULL ELSE comment END AS later FROM kb) SELECT object_ref, 'update' AS change FROM c WHERE comment IS DISTINCT FROM later")
def changed_comments(spark, sf_dir):
    """Of a comment set, one removed and one that was not there, the catalogue has to take two up."""
    rows = vector_catalog(spark, sf_dir).drop("definition_vec", "comment_vec")
    later = catalog.remove_comment(catalog.remove_comment(catalog.set_comment(rows, "d1", "amount due"), "d2"), "d5")
    return catalog.changes(rows.withColumn("hash", catalog.definition_hash()), later)


@query("""SELECT 'orders_by_status' AS name, 1 AS n_params, 'customers with orders of a status' AS description, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'F') AS n
 UNION ALL SELECT 'orders_of_priority', 0, 'all customers with orders', (SELECT count(DISTINCT o_custkey) FROM orders)""")
def saved_queries(spark, sf_dir):
    """Saved, changed and dropped; listed and run by another session that opens the folder."""
    t(spark, sf_dir, "orders").createOrReplaceTempView("saved_orders")
    path = store.new_folder(spark, "aliases")
    first = aliases.Aliases(spark, path=path)
    first.save("orders_by_status", "customers with orders of a status", "SELECT DISTINCT o_custkey FROM saved_orders WHERE o_orderstatus = ${status}", [("status", "text", "F, O or P")])
    first.save("orders_of_priority", "to be changed", "SELECT 1 AS one")
    first.save("mistake", "to be dropped", "SELECT 1 AS one")
    first.update("orders_of_priority", description="all customers with orders", sql="SELECT DISTINCT o_custkey FROM saved_orders")
    first.drop("mistake")
    saved = aliases.Aliases(spark, path=path)
    runs = [saved.run(name, args).agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, args in (("orders_by_status", {"status": "F"}), ("orders_of_priority", {}))]
    return saved.list("orders").select("name", "n_params", "description").join(runs[0].unionByName(runs[1]), "name")


_RELATIONS = """kb AS (SELECT 'part' || p_partkey || ' -> ' || p_brand || ' [' || p_type || ']' AS object_ref, 'part' || p_partkey || '.k = ' || p_brand || '.k' AS definition, p_name AS comment FROM part)"""


@query(f"WITH {_RELATIONS}, {_words('cold widget promo')}, {_best('b', 100, arms=('words',))} SELECT object_ref, definition, comment, round(rrf_score, 9) AS rrf_score FROM b JOIN kb USING (object_ref)")
def relationship_search(spark, sf_dir):
    """Relationships by the words of their names and descriptions; a floor above 1 leaves the vectors out."""
    p = t(spark, sf_dir, "part")
    k = F.array(F.lit("k"))
    edges = p.select(F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("left_object"), k.alias("left_columns"), F.col("p_brand").alias("right_object"), k.alias("right_columns"), F.col("p_type").alias("kind"), F.lit(1.0).alias("confidence"), F.col("p_name").alias("description"))
    return _rounded(relations.search(edges, "cold widget promo", HashingEmbedder(16), 100, 2.0))


@query(f"WITH {registry._LEX}, {registry._QUERIES}, c AS (SELECT query_id, vec_id, {registry._ALL} AS s FROM embeddings e, q), v AS (SELECT query_id, vec_id AS doc_id, {registry._BEST} AS rank FROM c QUALIFY rank <= 100) SELECT query_id, doc_id FROM v UNION SELECT query_id, doc_id FROM lx, q")
def candidate_ids_every(spark, sf_dir):
    """What either arm finds, for every query vector; the words' arm, at most 300 rows, is the same for all."""
    queries = registry.query_vectors(spark, sf_dir)
    v = search.knn_every(t(spark, sf_dir, "embeddings"), "embedding", queries, 100, "vec_id").select("query_id", F.col("vec_id").alias("doc_id"))
    w = search.lexical_search(t(spark, sf_dir, "documents"), lexical.candidates("text", registry.WEB_QUERY), registry.WEB_QUERY, 300, "doc_id", F.col("lang") == "en")
    return v.union(queries.select("query_id").crossJoin(w.select("doc_id"))).distinct()
