"""Vector, lexical and hybrid search. Cuts come before windows, so a rank runs over the cut, not the table."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lexical import WebQuery, cover_densities, entries
from ..functions.vectors import cosine


#: Rows that a block of queries meets in one task.
STRETCH = 1 << 16


def ranked(df: DataFrame, score: str, id_col: str, k: int, out: str = "rank") -> DataFrame:
    """The k best by score, ties by id, with ranks from 1."""
    best = df.orderBy(F.desc(score), id_col).limit(k)
    return best.withColumn(out, F.row_number().over(Window.orderBy(F.desc(score), id_col)))


def knn_cosine(df: DataFrame, vector: str, query: list[float], k: int, id_col: str, pre_filter: Column | None = None) -> DataFrame:
    """Exact nearest rows by cosine; the predicate holds before ranking and null vectors are out."""
    some = df if pre_filter is None else df.where(pre_filter)
    scored = some.where(F.col(vector).isNotNull()).select(id_col, cosine(vector, query).alias("similarity")).where("similarity is not null")
    return ranked(scored, "similarity", id_col, k)


def _packed(df: DataFrame, vector: str, id_col: str, size: int, names: tuple[str, str]) -> DataFrame:
    """Unit vectors and ids in blocks of at most ``size`` rows; null and zero vectors are out."""

    def run(batches):
        for batch in batches:
            v = batch.column(1)
            for i in range(0, len(v), size):
                part = v.slice(i, size)
                x = part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
                length = np.linalg.norm(x, axis=1)
                some = length > 0
                x = x[some] / length[some, None]
                ids = batch.column(0).slice(i, size).to_numpy()[some]
                if len(ids):
                    yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()]), pa.array([x.tobytes()])], list(names))

    rows = df.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, f"{names[0]} binary, {names[1]} binary")


def _block_best(k: int):
    """Pairs of blocks to the k best rows of each query, ties by id. Of a block of queries that meets one of rows after the other only the best so far are held."""

    def unit(raw: bytes, n: int) -> np.ndarray:
        return np.frombuffer(raw, np.float64).reshape(n, -1)

    def merged(held: tuple, more: tuple) -> tuple:
        at, ids, score = (np.concatenate(x) for x in zip(held, more, strict=True))
        order = np.lexsort((ids, -score, at))
        at = at[order]
        first = np.flatnonzero(np.diff(at, prepend=-1))
        order = order[np.arange(len(at)) - np.repeat(first, np.diff([*first, len(at)])) < k]
        return tuple(np.concatenate(x)[order] for x in zip(held, more, strict=True))

    def least_of(held: tuple, n: int) -> np.ndarray:
        """The score that a row needs: the k-th of its query, if there are so many."""
        counts = np.bincount(held[0], minlength=n)
        least = np.full(n, -np.inf)
        full = counts >= k
        least[full] = held[2][np.cumsum(counts)[full] - 1]
        return least

    def shown(queries: np.ndarray, held: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(queries[held[0]]), pa.array(held[1]), pa.array(held[2])], ["query_id", "id", "similarity"])

    def run(batches):
        now, queries, held = None, None, None
        for batch in batches:
            for qi, qx, ri, rx in zip(*(batch.column(c) for c in ("qi", "qx", "ri", "rx")), strict=True):
                qi = qi.as_py()
                if qi != now:
                    if now is not None:
                        yield shown(queries, held)
                    now, queries = qi, np.frombuffer(qi, np.int64)
                    vectors = unit(qx.as_py(), len(queries))
                    held, least = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)), np.full(len(queries), -np.inf)
                rows = np.frombuffer(ri.as_py(), np.int64)
                # equal vectors must tie in any block, whatever the order of a product's sum
                score = (vectors @ unit(rx.as_py(), len(rows)).T).round(12)
                if len(rows) > k:
                    least = np.maximum(least, -np.partition(-score, k - 1, axis=1)[:, k - 1]) if np.isinf(least).any() else least
                at, col = np.nonzero(score >= least[:, None])
                if len(at):
                    held = merged(held, (at, rows[col], score[at, col]))
                    least = least_of(held, len(queries))
        if now is not None:
            yield shown(queries, held)

    return run


def best_of_each(df: DataFrame, score: str, id_col: str, k: int, out: str = "rank") -> DataFrame:
    """The k best rows of each query_id, ties by id, with ranks from 1."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), id_col))).where(F.col(out) <= k)


def knn_every(df: DataFrame, vector: str, queries: DataFrame, k: int, id_col: str, pre_filter: Column | None = None) -> DataFrame:
    """(query_id, id, similarity, rank): the exact nearest rows of every query (query_id, vector); ids are numbers.

    Blocks of queries meet stretches of about ``STRETCH`` rows; a stretch's k best a query go into the shuffle, and no side is broadcast.
    """
    from .catalog import _checkpoint

    some = df if pre_filter is None else df.where(pre_filter)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q = _checkpoint(_packed(queries.select("query_id", vector).repartition(queries.count() // 128 + 1), vector, "query_id", 256, ("qi", "qx")))
    r = _checkpoint(_packed(some.select(id_col, vector).repartition(n), vector, id_col, 4096, ("ri", "rx")))
    rows = (r.agg(F.sum(F.length("ri"))).first()[0] or 0) // 8  # an id has eight bytes
    both = q.hint("shuffle_replicate_nl").join(r.coalesce(rows // STRETCH + 1).hint("shuffle_replicate_nl"))
    best = both.mapInArrow(_block_best(k), "query_id long, id long, similarity double")
    return best_of_each(best.withColumnRenamed("id", id_col), "similarity", id_col, k)


def knn_approx(df: DataFrame, vector: str, queries: DataFrame, k: int, id_col: str, path: str, pre_filter: Column | None = None, **index) -> DataFrame:
    """As ``knn_every`` through an inverted file written to ``path`` (see ``ivf``); keep that and open it to search again."""
    from .ivf import IvfIndex

    some = df if pre_filter is None else df.where(pre_filter)
    return IvfIndex.build(some, vector, id_col, path, **index).search(queries, vector, k, id_col)


def with_words(df: DataFrame, words: Column, name: str = "_words") -> DataFrame:
    """Adds the words of a row, extracted once: filters that name a plain column's words several times would each extract them again, but none moves below an explode."""
    return df.withColumn(name, F.explode(F.array(words)))


def matched(df: DataFrame, words: Column, query: WebQuery, id_col: str) -> DataFrame:
    """(id, score): the rows that satisfy a query, by cover density. ``words`` as in ``lexical.entries``."""
    return cover_densities(entries(df, id_col, words, query), id_col, query)


def store_words(df: DataFrame, words: Column, path: str, name: str = "words") -> DataFrame:
    """Write the words beside the rows, for many searches to read."""
    with_words(df, words, name).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def lexical_search(df: DataFrame, words: Column, query: WebQuery, k: int, id_col: str, pre_filter: Column | None = None) -> DataFrame:
    """The k best rows that satisfy the query, by cover density, ties by id."""
    some = df if pre_filter is None else df.where(pre_filter)
    scored = matched(some, words, query, id_col).select(id_col, F.round("score", 6).alias("lexical_score"))
    return ranked(scored, "lexical_score", id_col, k)


def tied_ranks(df: DataFrame, score: str, out: str) -> DataFrame:
    """Adds the rank from 1 by score over all rows that have one: 1 and the number of rows with a better score, so ties share it.

    Rows are counted by score and scores by stretches of a ten-thousandth, whose counts are prefix-summed: for cosines
    20,001 rows at most meet in one task.
    """
    stretch = F.floor(F.col(score) * 10_000)
    counts = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.count("*").alias("_n")).withColumn("_at", stretch)
    above = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stretches = counts.groupBy("_at").agg(F.sum("_n").alias("_n")).select("_at", above(Window.orderBy(F.desc("_at"))).alias("_above"))
    inner = counts.withColumn("_in", above(Window.partitionBy("_at").orderBy(F.desc(score))))
    ranks = inner.join(stretches, "_at").select(score, (F.col("_above") + F.col("_in") + 1).alias(out))
    return df.where(F.col(score).isNotNull()).join(ranks, score)


def rrf(arms: list[DataFrame], id_col: str, k: int = 60, rank: str = "rank") -> DataFrame:
    """Reciprocal rank fusion of any number of (id, rank) arms."""
    parts = reduce(DataFrame.union, (a.select(id_col, (1.0 / (k + F.col(rank))).alias("_s")) for a in arms))
    return parts.groupBy(id_col).agg(F.sum("_s").alias("rrf_score"))


def hybrid_search(df: DataFrame, vector: str, query_vector: list[float], words: Column, query: WebQuery, id_col: str, pre_filter: Column | None = None, candidates: int = 300, k: int = 20, show: list[str] | None = None, base: DataFrame | None = None) -> DataFrame:
    """Both arms under one predicate, fused, cut to k, then joined with the base for what is shown.

    ``df`` has the vectors; ``base``, if given, has the words and what is shown, and is read for those instead.
    """
    texts = df if base is None else base
    v = knn_cosine(df, vector, query_vector, candidates, id_col, pre_filter).withColumnRenamed("rank", "vector_rank")
    w = lexical_search(texts, words, query, candidates, id_col, pre_filter).withColumnRenamed("rank", "lexical_rank")
    fused = v.join(w, id_col, "full")
    part = lambda c: F.coalesce(1.0 / (60 + F.col(c)), F.lit(0.0))
    best = fused.withColumn("rrf_score", F.round(part("vector_rank") + part("lexical_rank"), 8)).orderBy(F.desc("rrf_score"), id_col).limit(k)
    return texts.select(id_col, *(show or [])).join(F.broadcast(best), id_col)  # at most k rows


def semantic_only(df: DataFrame, vector: str, query_vector: list[float], words: Column, query: WebQuery, id_col: str, k: int = 10) -> DataFrame:
    """Nearest rows that do not match the words."""
    others = df.select(id_col, vector).join(matched(df, words, query, id_col), id_col, "left_anti")
    return knn_cosine(others, vector, query_vector, k, id_col)


def hybrid_every(df: DataFrame, vector: str, queries: DataFrame, words: Column, query: WebQuery, id_col: str, pre_filter: Column | None = None, candidates: int = 300, k: int = 20, show: list[str] | None = None, base: DataFrame | None = None) -> DataFrame:
    """``hybrid_search`` for every query vector, with one query of words."""
    texts = df if base is None else base
    v = knn_every(df, vector, queries, candidates, id_col, pre_filter).withColumnRenamed("rank", "vector_rank")
    w = lexical_search(texts, words, query, candidates, id_col, pre_filter).withColumnRenamed("rank", "lexical_rank")
    fused = v.join(queries.select("query_id").crossJoin(w), ["query_id", id_col], "full")
    part = lambda c: F.coalesce(1.0 / (60 + F.col(c)), F.lit(0.0))
    best = best_of_each(fused.withColumn("rrf_score", F.round(part("vector_rank") + part("lexical_rank"), 8)), "rrf_score", id_col, k)
    return texts.select(id_col, *(show or [])).join(best, id_col)


def candidate_ids(arms: list[DataFrame], id_col: str) -> DataFrame:
    """The ids that any arm found, once each."""
    return reduce(DataFrame.union, (a.select(id_col) for a in arms)).distinct()
