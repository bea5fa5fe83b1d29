"""Catalogues and saved queries are shared by sessions through a folder."""

import tempfile

import pytest

from lodestone.functions import vectors
from lodestone.operators import aliases, catalog, store


def _folder():
    return tempfile.mkdtemp(prefix="spark-") + "/kept"


def test_newest_row_of_a_name_counts(spark):
    path, schema = _folder(), spark.createDataFrame([], "name string, n int, `some.words` array<string>").schema
    one, two = store.Records(spark, path, schema), store.Records(spark, path, schema)
    assert one.rows().count() == 0
    one.put(spark.createDataFrame([("a", 1, ["x"]), ("b", None, None)], schema))
    two.put(spark.createDataFrame([("a", 2, [])], schema))
    assert sorted((r["name"], r.n, str(r["some.words"])) for r in one.rows().collect()) == [("a", 2, "[]"), ("b", None, "None")]
    two.drop("b")
    assert [r["name"] for r in one.rows().collect()] == ["a"] and one.rows("b").count() == 0
    with pytest.raises(KeyError):
        one.drop("b")
    two.put(spark.createDataFrame([("b", 3, None)], schema))
    assert {(r["name"], r.n) for r in one.rows().collect()} == {("a", 2), ("b", 3)}


def test_catalogues_of_another_session(spark):
    path, model = _folder(), vectors.HashingEmbedder(16)
    rows = catalog.embed_catalog(spark.createDataFrame([("schema", "table", "t", None, "t", "t(a)", "things")], catalog.COLUMNS), model)
    catalog.Catalogues(spark, path).add("one", rows, model, ["t"])
    other = catalog.Catalogues(spark.newSession(), path)
    assert other.get().first().object_ref == "t" and [tuple(r) for r in other.list().collect()] == [("one", model.name, 16, ["t"])]
    with pytest.raises(ValueError, match="t already in one"):
        other.add("two", rows, model, ["t", "u"])
    with pytest.raises(KeyError):
        other.get("two")
    other.add("one", rows.where("false"), model, ["t"])
    assert catalog.Catalogues(spark, path).get("one").count() == 0


def test_saved_queries_of_another_session(spark):
    path = _folder()
    a, b = (aliases.Aliases(s, vectors.HashingEmbedder(64), path) for s in (spark, spark.newSession()))
    a.save("fires", "engine fire reports by year", "SELECT CAST(${n} AS INT) AS n", [("n", "int", "a number")])
    with pytest.raises(aliases.AliasError, match="exists"):
        b.save("fires", "", "SELECT 1")
    assert b.run("fires", {"n": "4"}).first().n == 4 and b.find("engine fire", 1).first().object_ref == "fires"
    b.update("fires", description="money of orders")
    assert a.get("fires") == aliases.Alias("fires", "money of orders", "SELECT CAST(${n} AS INT) AS n", [("n", "int", "a number")])
    assert a.near_duplicates("engine fire reports by year", 0.9).count() == 0
    plan = a.embedded()._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan  # vectors are read, not computed again
    a.drop("fires")
    with pytest.raises(aliases.AliasError, match="no alias fires"):
        b.run("fires", {"n": "1"})
