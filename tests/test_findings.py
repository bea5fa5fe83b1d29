import datetime as dt
import json
import random
import tempfile
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.vectors import HashingEmbedder
from lodestone.operators import catalog, governed, relations, similar, trace
from lodestone.streaming import upkeep


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("distance", [1, 2])
def test_near_words_are_those_of_all_pairs(spark, distance):
    random.seed(distance)
    words = sorted({"".join(random.choices("abc", k=random.randint(0, 5))) for _ in range(120)})
    got = {(r.a, r.b, r.edits) for r in catalog.near_words(spark.createDataFrame([(w,) for w in words], "w string"), "w", distance).collect()}
    assert got == {(a, b, edits(a, b)) for a in words for b in words if a < b and edits(a, b) <= distance}


def test_deletions_are_never_broadcast(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_name")
    plan = catalog.near_words(names, "c_name", 1)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_variants_with_another_first_letter(spark):
    names = spark.createDataFrame([("orders",), ("borders",), ("orders_old",), ("0rders",), ("parts",)], "name string")
    assert {tuple(r.names) for r in catalog.name_variants(names, 1).collect()} == {("orders", "orders_old"), ("borders", "orders", "orders_old"), ("0rders", "orders", "orders_old")}


def test_candidate_keys_are_found_in_the_data(spark):
    people = spark.createDataFrame([(k, f"n{k}", k % 3) for k in range(10)], "id int, name string, city int")
    cities = spark.createDataFrame([(k, f"c{k}") for k in range(5)], "city_id bigint, label string")
    notes = spark.createDataFrame([(k % 4, "n1" if k else " ") for k in range(8)] + [(None, None)], "person int, who string")
    tables = {"people": people, "cities": cities, "notes": notes}
    found = {(r.left_object, r.left_columns[0], r.right_object, r.right_columns[0]) for r in relations.candidate_keys(tables).collect()}
    assert {("people", "city", "cities", "city_id"), ("notes", "person", "people", "id"), ("notes", "who", "people", "name")} <= found
    assert not any(r == "notes" for _, _, r, _ in found)
    each = {(r.left_object, r.left_column, r.right_object, r.right_column): (r.left_keys, r.right_keys, r.matched_keys, r.containment) for r in relations.inclusions(tables).collect()}
    assert each["people", "id", "cities", "city_id"] == (10, 5, 5, 0.5) and each["notes", "who", "people", "name"] == (1, 10, 1, 1.0)


def test_lineage_follows_what_values_come_from(spark, tmp_path):
    spark.createDataFrame([(1, "vin1", "ann", 3)], "id int, vin string, name string, n int").write.parquet(f"{tmp_path}/cmpl.parquet")
    base, other = spark.read.parquet(f"{tmp_path}/cmpl.parquet"), spark.createDataFrame([(1, "x")], "id int, note string")
    vin = {("cmpl", "vin")}
    at = lambda df, c: governed.lineage(df)[c]
    assert at(base.withColumnRenamed("vin", "key"), "key") == vin
    assert at(base.select(F.upper("vin").alias("u")), "u") == vin
    assert at(base.select(F.concat("name", F.lit("-"), "vin").alias("c")), "c") == vin | {("cmpl", "name")}
    assert at(base.groupBy("name").agg(F.max("vin").alias("m")), "m") == vin
    assert at(base.join(other, "id").select(F.col("vin").alias("v"), "note"), "v") == vin
    assert at(base.select(F.col("vin").alias("v")).union(other.select("note")), "v") >= vin
    assert at(base.select(F.explode(F.split("vin", "")).alias("letter")), "letter") == vin
    assert at(base.withColumn("f", F.first("vin").over(Window.partitionBy("name"))), "f") == vin
    assert at(base.withColumn("vin", F.lit("vin")), "vin") == set()
    assert at(base.where("vin IS NOT NULL").select("n"), "n") == {("cmpl", "n")}
    base.createOrReplaceTempView("lineage_cmpl")
    assert at(spark.sql("SELECT n, (SELECT max(vin) FROM lineage_cmpl) AS s FROM lineage_cmpl"), "s") == vin
    assert at(base.mapInPandas(lambda rows: rows, base.schema), "n") >= vin  # opaque
    views = {"ok": base.select("n", F.lit("vin").alias("vin")), "bad": base.select(F.lower(F.trim("vin")).alias("code"))}
    assert governed.reachable_columns(views, ["vin", "name"]) == [("bad", "code", "cmpl", "vin")]


def test_similar_pairs_are_those_of_all_pairs(spark):
    random.seed(9)
    common, rare = [f"w{k}" for k in range(20)], [f"r{k}" for k in range(3000)]
    texts = [" ".join(random.choices(common, k=4) + random.choices(rare, k=12)) for _ in range(1500)]
    texts += [" ".join([*t.split()[:-2], random.choice(rare)]) for t in texts[:450]] + ["", None] + texts[:50]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, c string")
    counts = {}
    for k, t in enumerate(texts):
        if t and t not in texts[:k]:
            counts[k] = Counter(t.split())
    length = {k: sum(n * n for n in c.values()) for k, c in counts.items()}
    want = {}
    keys = sorted(counts)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            small, large = sorted((counts[a], counts[b]), key=len)
            s = round(sum(n * large[w] for w, n in small.items()) / (length[a] ** 0.5 * length[b] ** 0.5), 9)
            if s >= 0.8:
                want[a, b] = s
    assert len(want) > 300
    assert {(r.a, r.b): r.similarity for r in similar.similar_pairs(df, "id", "c", 0.8).collect()} == want
    met = similar.candidate_pairs(similar.word_counts(df.dropDuplicates(["c"]), "id", "c"), 0.8).count()
    print("pairs met", met, "of", len(keys) * (len(keys) - 1) // 2)
    assert met < len(keys) * (len(keys) - 1) // 2 / 20


def test_texts_of_few_words_meet_in_blocks(spark, monkeypatch):
    """Nearly all of these share a word that is kept, so all pairs would be rows of a join; here blocks of texts are."""
    monkeypatch.setattr(similar, "BLOCK", 64)
    monkeypatch.setattr(similar, "OWN", 5)
    monkeypatch.setattr(similar, "SHARED", 3)
    random.seed(4)
    texts = sorted({" ".join(random.choices([f"w{k}" for k in range(12)], k=random.randint(1, 9))) for _ in range(400)})
    counts = [Counter(t.split()) for t in texts]
    cosine = lambda x, y: round(sum(n * y[w] for w, n in x.items()) / (sum(n * n for n in x.values()) ** 0.5 * sum(n * n for n in y.values()) ** 0.5), 9)
    want = {(a, b) for b in range(len(texts)) for a in range(b) if cosine(counts[a], counts[b]) >= 0.8}
    found = similar.similar_pairs(spark.createDataFrame(list(enumerate([*texts, "", None])), "id int, c string"), "id", "c", 0.8)
    assert {(r.a, r.b) for r in found.collect()} == want
    assert "CartesianProduct" in found._jdf.queryExecution().executedPlan().toString()


def test_tiles_of_unlike_texts_need_few_coordinates(spark, monkeypatch):
    """Texts of six tongues in any order: like ones come into one tile, and the others are told apart by a few coordinates, not by all of them."""
    monkeypatch.setattr(similar, "BLOCK", 64)
    random.seed(6)
    tongues = [[f"t{k}w{j}" for j in range(2000)] for k in range(6)]
    texts = [" ".join(random.choices(random.choice(tongues), [1 / (j + 9) for j in range(2000)], k=random.randint(1, 60))) for _ in range(1400)]
    texts += [" ".join([*t.split()[1:], "t3w9"]) for t in texts[:150]]
    texts += ["", None, "t0w0 " * 5000, "t0w0 " * 4000 + "t0w1", "t1w0", "T1W0 t1w0 t1w1", *texts[:9]]
    ids = [f"{k % 7}-{k}" for k in range(len(texts))]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "id string, c string")
    first = {}
    for k, t in zip(ids, texts, strict=True):
        first[t] = min(k, first.get(t, k))
    counts = {k: Counter(t.lower().split()) for t, k in first.items() if t}
    length = {k: sum(n * n for n in c.values()) for k, c in counts.items()}
    want, keys = {}, sorted(counts)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            small, large = sorted((counts[a], counts[b]), key=len)
            s = round(sum(n * large[w] for w, n in small.items()) / (length[a] ** 0.5 * length[b] ** 0.5), 9)
            if s >= 0.8:
                want[a, b] = s
    found = similar.similar_pairs(df, "id", "c", 0.8).collect()
    assert len(want) > 100 and len(found) == len(want)
    assert {(r.a, r.b): r.similarity for r in found} == want

    lists = similar.word_lists(df.groupBy("c").agg(F.min("id").alias("id")), "id", "c")
    blocks = similar._packed(similar._placed(lists, similar._leaders(lists)).orderBy("place", "id").coalesce(1).drop("place"), 512).collect()
    raw = [(r["first"], bytes(r["block"])) for r in blocks]
    met = pa.RecordBatch.from_pylist([{"x": x, "xs": xs, "y": y, "ys": ys} for x, xs in raw for y, ys in raw if x <= y])
    work, bound = [], similar._Side.bound

    class Seen(np.ndarray):
        def __matmul__(self, other):
            work.append(len(self) * other.size)
            return np.asarray(self) @ np.asarray(other)

    monkeypatch.setattr(similar._Side, "bound", lambda *args: bound(*args).view(Seen))
    near = similar._near(0.8, similar.OWN, similar.SHARED, 256)
    again = [r for batch in near([met]) for r in batch.to_pylist()]
    assert {(r["a"], r["b"]): r["similarity"] for r in again} == want
    print("coordinates a pair", sum(work) / (len(keys) ** 2 / 2))
    assert sum(work) < 200 * len(keys) ** 2 / 2  # 512 for every pair before


def test_streamed_trace_equals_the_whole_one(spark):
    d = tempfile.mkdtemp(prefix="spark-")
    schema = "id long, task_id string, conversation_id string, sequence_id string, action_type string, status string, error string, request_payload string, response_payload string, created_at timestamp, completed_at timestamp"
    start, rows = dt.datetime(2024, 1, 1), []
    random.seed(2)
    for k in range(60):
        at = start + dt.timedelta(seconds=k // 3)  # three rows of one time
        rows.append((k, f"t{k % 4}", f"c{k % 3}", f"s{random.randint(0, k // 8)}", random.choice(["tool_call", "answer", "user_prompt", "error"]), "done", f"e{k}", json.dumps({"tool_name": "q", "prompt": f"p {k}", "arguments": {"a": k}}), json.dumps({"text": f"x  {k}"}), at, at + dt.timedelta(milliseconds=k)))
    for batch in (rows[:21], rows[21:42], [*rows[30:42], *rows[42:]], rows[50:]):  # later batches repeat rows
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{d}/log")
        upkeep.stream_trace(spark.readStream.schema(schema).parquet(f"{d}/log"), f"{d}/flat", f"{d}/cp").awaitTermination()
    got = spark.read.parquet(f"{d}/flat")
    columns = ["conversation_id", "step", "round", "task_id", "action_type", "tool", "ms", "status", "text"]
    whole = trace.full_trace(spark.createDataFrame(rows, schema)).select(*columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)
    assert got.count() == 60 == got.select("id").distinct().count()


def test_subgraph_of_a_question(spark):
    model = HashingEmbedder()
    rows = [("schema", "table", name, None, name, f"create table {name}", comment) for name, comment in [("engine", "engine fires and heat"), ("recall", "campaigns of makers"), ("weather", "rain and wind")]]
    kb = catalog.embed_catalog(spark.createDataFrame(rows, "source_type string, entity_type string, relation_name string, column_name string, object_ref string, definition string, comment string"), model)
    edge = lambda k, a, b, c: (k, a, ["x"], b, ["y"], "key", c)
    edges = spark.createDataFrame([edge(1, "engine", "complaint", 1.0), edge(2, "complaint", "recall", 0.5), edge(3, "recall", "maker", 1.0), edge(4, "weather", "place", 1.0)], "id long, left_object string, left_columns array<string>, right_object string, right_columns array<string>, kind string, confidence double")
    found = relations.subgraph_of(edges, kb, "engine fires", model, top_k=1, max_hops=2)
    first = {(r.a, r.b): r.score for r in found.where("hop = 1").collect()}
    second = {(r.a, r.b): r.score for r in found.where("hop = 2").collect()}
    assert set(first) == {("engine", "complaint")} and set(second) == {("complaint", "engine"), ("complaint", "recall")}
    assert second["complaint", "recall"] == pytest.approx(first["engine", "complaint"] * 0.5, abs=1e-8)
    assert {r.b for r in relations.subgraph_of(edges, kb, "engine fires", model, 1, 3).where("hop = 3").collect()} == {"complaint", "maker"}
