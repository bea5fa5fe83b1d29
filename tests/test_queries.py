import pytest

from lodestone.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(name, spark, sf_dir, duck, rows_of):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    if name in registry.ORACLES:
        assert rows_of(got) == rows_of(duck.sql(registry.ORACLES[name]).df())
    else:
        assert len(got)


def test_approximate_neighbours_find_the_nearest(spark, sf_dir):
    exact = registry.QUERIES["knn_cosine"](spark, sf_dir).where("rank = 1").first()["vec_id"]
    assert exact in {r["vec_id"] for r in registry.QUERIES["knn_approx"](spark, sf_dir).collect()}


def test_link_filters_reach_the_scan(spark, sf_dir):
    plan = registry.QUERIES["recall_to_complaint_link"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_linenumber), GreaterThan(l_linenumber,1)" in plan


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_of_approximate_neighbours_over_every_query(spark, sf):
    d = f"/root/testdata/{sf}"
    n = spark.read.parquet(f"{d}/embeddings.parquet").where("vec_id % 50 = 0").count()
    pairs = lambda name: {(r.query_id, r.vec_id) for r in registry.QUERIES[name](spark, d).where("rank <= 20 AND query_id <> vec_id").collect()}
    exact, approx = pairs("knn_cosine_every"), pairs("knn_approx")
    assert len({q for q, _ in exact}) == len({q for q, _ in approx}) == n
    recall = len(exact & approx) / len(exact)
    print("recall", sf, n, recall)
    assert recall >= 0.9


def test_link_takes_every_recall_and_complaint(spark, tmp_path):
    import datetime as dt

    day = dt.datetime(1996, 1, 1)
    spark.createDataFrame([(k, day) for k in range(1, 9)], "o_orderkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(k, n, day + dt.timedelta(days=30 * n), 2.0 * n) for k in (3, 7, 8) for n in (1, 2, 3)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_shipdate timestamp, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.o_orderkey: (r.n_complaints, r.n_after, r.sum_l_quantity) for r in registry.QUERIES["recall_to_complaint_link_whole"](spark, str(tmp_path)).collect()}
    assert got == {k: (3, 2, 12) if k in (3, 7, 8) else (0, 0, None) for k in range(1, 9)}


def test_link_counts_every_row(spark, sf_dir):
    r = registry.QUERIES["recall_to_complaint_link_whole"](spark, sf_dir).selectExpr("count(*) AS n", "sum(n_complaints) AS lines").first()
    assert (r.n, r.lines) == tuple(spark.read.parquet(f"{sf_dir}/{x}.parquet").count() for x in ("orders", "lineitem"))
