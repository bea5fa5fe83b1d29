import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import search
from lodestone.operators.ivf import IvfIndex
from lodestone.plans import registry


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), v) for i, v in zip(ids if ids is not None else range(len(x)), x.tolist(), strict=True)], "id long, v array<float>")


def pairs(df):
    return {(r.query_id, r.id) for r in df.where("query_id <> id AND rank <= 20").collect()}


@pytest.fixture(scope="module")
def grouped(spark, tmp_path_factory):
    """6,000 vectors about 60 centres, a third of them one vector; the index over them; the queries."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(60, 64))
    x = centres[np.arange(6000) % 60] + rng.normal(scale=0.35, size=(6000, 64))
    x[rng.permutation(6000)[:2000]] = centres[0]
    df = frame(spark, x)
    queries = df.where("id % 50 = 0").select(F.col("id").alias("query_id"), "v")
    return df, queries, IvfIndex.build(df, "v", "id", f"file://{tmp_path_factory.mktemp('ivf')}/index")


def test_recall_and_share_where_vectors_are_grouped(spark, grouped):
    df, queries, index = grouped
    exact, found = search.knn_every(df, "v", queries, 40, "id"), index.search(queries, "v", 21)
    best = exact.where("query_id <> id").select("query_id", "id", F.col("similarity").alias("s"))
    twentieth = {r.query_id: r.s for r in best.groupBy("query_id").agg(F.sort_array(F.collect_list("s"), False)[19].alias("s")).collect()}
    got = found.where("query_id <> id").collect()
    hits = sum(r.similarity >= twentieth[r.query_id] - 2e-6 for r in got if r.rank <= 21)  # equal vectors stand for each other
    recall, share = min(1, hits / (20 * len(twentieth))), index.share_scanned(queries.where("query_id % 7 > 0"), "v")
    print("recall", recall, "share", share, "cells", len(index.model.centres), "probes", index.model.probes)
    assert recall >= 0.9 and share < 0.2


def test_every_row_is_indexed_once_and_large_cells_are_split(spark, grouped):
    df, _, index = grouped
    stored = spark.read.parquet(f"{index.path}/vectors")
    assert stored.count() == stored.select("id").distinct().count() == 6000
    assert spark.read.parquet(f"{index.path}/codes").agg(F.sum(F.length("ids") / 8)).first()[0] == 6000


def test_an_opened_index_answers_alike_and_reads_only_probed_cells(spark, grouped):
    df, queries, index = grouped
    again = IvfIndex(spark, index.path)
    key = lambda d: sorted((r.query_id, r.id, r.similarity, r["rank"]) for r in d.collect())
    assert key(again.search(queries, "v", 5)) == key(index.search(queries, "v", 5))
    one = queries.where("query_id = 50")
    assert again.share_scanned(one, "v") < 0.5
    plan = again.search(one, "v", 5)._jdf.queryExecution().toString()
    assert "cell" in plan and "PartitionFilters" in plan


def test_all_cells_and_all_candidates_are_the_exact_search(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16)).round(3)
    df = frame(spark, np.vstack([x, x[:5], np.zeros((1, 16))]), [*range(300), *range(300, 305), 900]).union(spark.createDataFrame([(901, None)], "id long, v array<float>"))
    queries = df.where("id % 50 = 0").select(F.col("id").alias("query_id"), "v")
    index = IvfIndex.build(df, "v", "id", f"file://{tmp_path}/i", cells=7, parts=4)
    key = lambda d: sorted((r.query_id, r["rank"], r.id, round(r.similarity, 5)) for r in d.collect())
    assert key(index.search(queries, "v", 10, probes=7, over=400)) == key(search.knn_every(df, "v", queries, 10, "id"))
    allowed = df.where("id % 3 = 0").select("id")
    some = index.search(queries, "v", 5, probes=7, over=400, allowed=allowed)
    assert key(some) == key(search.knn_every(df.where("id % 3 = 0"), "v", queries, 5, "id"))
    with pytest.raises(ValueError, match="no row"):
        IvfIndex.build(df.where("id = 901"), "v", "id", f"file://{tmp_path}/none")


def test_share_of_rows_scanned_on_the_tables(spark, sf_dir, tmp_path):
    """Vectors that point everywhere alike: the index keeps its recall by probing many cells."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    index = IvfIndex.build(e, "embedding", "vec_id", f"file://{tmp_path}/i")
    print("share", index.share_scanned(registry.query_vectors(spark, sf_dir), "embedding"), index.model.probes, len(index.model.centres))
    assert index.rows == e.count()
