import hashlib
import math
import random

import numpy as np
import pytest

from lodestone.llm import clusters, queries
from lodestone.llm.shared import stored


def brute(rows, size, k, rounds, seed=1):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [max(-clusters.BOUND, min(clusters.BOUND, math.floor(64 * x))) for x in v]))
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))
    c = [q for _, q in first[:k]]
    of = lambda q: min(range(len(c)), key=lambda j: (sum((a - b) ** 2 for a, b in zip(q, c[j], strict=True)), j))
    for _ in range(rounds):
        own = [of(q) for _, q in kept]
        c = [[sum(col) // len(m) for col in zip(*m, strict=True)] if (m := [q for (_, q), o in zip(kept, own, strict=True) if o == j]) else c[j] for j in range(len(c))]
    out = []
    for i, q in kept:
        j = of(q)
        out.append((i, j, sum((a - b) ** 2 for a, b in zip(q, c[j], strict=True))))
    by = {j: sum(d for _, o, d in out if o == j) for j in range(len(c))}
    name = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted((str(i), j, d, by[j], sum(by.values()), name[j]) for i, j, d in out)


def got(df):
    return sorted((str(r[0]), *r[1:]) for r in df.collect())


def test_query_equals_its_sql(spark, sf_dir, duck, rows_of):
    result = queries.QUERIES["op13_clustering"](spark, sf_dir).toPandas()
    assert rows_of(result) == rows_of(duck.sql(queries.ORACLES["op13_clustering"]).df())


@pytest.mark.parametrize(("n", "size", "k", "block"), [(300, 3, 5, 8), (40, 2, 16, 7), (5, 4, 16, 64)])
def test_awkward_vectors(spark, n, size, k, block):
    random.seed(n)
    rows = [(i, [random.gauss(i % 4, 0.2) for _ in range(size)]) for i in range(n)]
    rows += [(n + 1, None), (n + 2, []), (n + 3, [0.5] * (size - 1) + [None]), (n + 4, [float("nan")] * size), (n + 5, [float("inf")] * size), (None, [0.25] * size), (7, rows[4][1]), (7, rows[4][1]), (n + 6, [1e300] * size), (n + 7, [-1e300] * size), (n + 8, [0.0] * (size + 1))]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, q string, block int")
    assert got(clusters.cluster(df, size=size, k=k, block=block)) == brute(rows, size, k, 3)
    empty = clusters.cluster(df.where("vec_id < 0"), size=size)
    assert empty.collect() == [] and empty.columns == ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_equal_vectors_spread_and_ties_go_to_the_smaller_number(spark):
    rows = [(i, [1.0, 1.0]) for i in range(500)] + [(1000 + i, [float(i % 3), 0.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert got(clusters.cluster(df, size=2, k=6)) == brute(rows, 2, 6, 3)
    z = clusters.zoned(clusters.quantised(df, "vec_id", "embedding", 2), 2)
    from pyspark.sql import functions as F

    sizes = [r["count"] for r in z.where(F.col("q") == F.lit(np.array([64, 64], "<i4").tobytes())).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 300


def test_hilbert_neighbours_differ_by_one_step():
    cells = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    keys = [bytes(b) for b in clusters.hilbert(cells, 3)]
    assert len(set(keys)) == 512
    path = cells[sorted(range(512), key=keys.__getitem__)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_candidates_hold_the_nearest_of_every_vector():
    rng = np.random.default_rng(3)
    dropped = 0
    for _ in range(300):
        c = rng.integers(-20, 20, (6, 3))
        low = rng.integers(-20, 20, 3)
        high = low + rng.integers(0, 8, 3)
        able = clusters.candidates(np.concatenate([low, high]), c)
        x = rng.integers(low, high + 1, (200, 3))
        assert set(np.square(x[:, None] - c).sum(axis=2).argmin(axis=1)) <= set(able)
        dropped += 6 - len(able)
    assert dropped > 300


def test_boxes_spare_most_comparisons_where_vectors_are_grouped(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(16, 64))
    rows = [(i, (centres[i % 16] + rng.normal(scale=0.05, size=64)).tolist()) for i in range(4000)]
    q = stored(clusters.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", 64), "q")
    z = stored(clusters.zoned(q, 64), "z")
    _, pairs = clusters.summed(z, np.floor(64 * centres).astype(np.int64))
    print("share of pairs compared", pairs / (4000 * 16))
    assert pairs < 0.5 * 4000 * 16
