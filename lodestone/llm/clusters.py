"""Centroid clustering over zone maps: vectors in the order of a space-filling curve, in blocks with boxes.

1. Vectors become integers (``quantised``) and are written once in the order of
   their Hilbert index, ``block`` at a time with the smallest and largest of each
   component: the zone map, in the block's first row (``zoned``). Ranges are cut
   by (index, hash of the id), so equal vectors spread over many tasks.
2. Each round broadcasts the centroids (k rows, the proven bound). Over a box the
   difference of two squared distances has an exact bound, at a corner; centroids
   that are farther than the box's own one all over the box are out. The others
   are compared with all the block's vectors, in exact integers (``_nearest``).
3. Tasks sum vectors, counts and distances by cluster; k rows a task are
   shuffled, summed as decimals, and k rows come back to the driver.

Defined results: vectors of another length, with a null or a non-finite component
are left out; null ids stay, hashed as an empty id; repeated rows are rows.
Components beyond 2^27 either way are set to that bound, so that distances fit
64 bits; a sum of distances beyond 2^63 - 1 is returned as that. Fewer than k
vectors give as many centroids, an empty table an empty result. Other columns
are not read. Equal distances go to the smaller centroid.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .shared import shuffle_partitions, stored

BOUND = 1 << 27
LARGEST = (1 << 63) - 1


def quantised(df: DataFrame, id_col: str, vector_col: str, size: int, scale: float = 64.0) -> DataFrame:
    """(id, q): floor(scale * x) of the vectors with ``size`` finite components, as 32-bit little-endian integers."""

    def run(batches):
        for batch in batches:
            v = batch.column(1)
            lengths = pc.fill_null(pc.list_value_length(v), 0).to_numpy()
            begin = np.cumsum(lengths) - lengths
            x = v.flatten().to_numpy(zero_copy_only=False)  # a null component is a NaN here
            rows = np.flatnonzero(lengths == size)
            x = x[begin[rows, None] + np.arange(size)]
            some = np.isfinite(x).all(axis=1)
            q = np.clip(np.floor(scale * x[some]), -BOUND, BOUND).astype("<i4")
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[some])), _binary(q)], ["id", "q"])

    some = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return some.mapInArrow(run, f"id {some.schema['id'].dataType.simpleString()}, q binary")


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row's bytes as one binary value."""
    rows = np.ascontiguousarray(rows)
    width = rows.dtype.itemsize * rows.shape[1]
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(rows)])
    return fixed.cast(pa.binary())


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """The rows of a binary column, all of one width, as a matrix."""
    if not len(column):
        return np.empty((0, width), kind)
    _, offsets, data = column.buffers()
    begin = np.frombuffer(offsets, np.int32)[column.offset]
    return np.frombuffer(data, kind, len(column) * width, begin).reshape(len(column), width)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of each row of cells (0 to 2^bits - 1), as big-endian bytes: axes are turned back to their place from the highest bit on, then Gray-coded."""
    x = cells.T.astype(np.int64)
    size = len(x)
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(size):
            high = (x[i] >> bit & 1).astype(bool)
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, size):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] >> bit & 1, (1 << bit) - 1, 0)
    x ^= turn
    planes = [x >> bit & 1 for bit in range(bits - 1, -1, -1)]
    return np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)


def zoned(q: DataFrame, size: int, block: int = 64, bits: int = 4, sample: int = 4096) -> DataFrame:
    """(id, q, block, box): the vectors in Hilbert order; a block's first row has its box, the least and the largest component by component.

    Cells lie between the hundredths at both ends of a component in ``sample`` rows, those of the smallest hashes; this
    bounded sample decides how close a block's vectors are and no result.
    """
    spark = q.sparkSession
    seen = q.orderBy(F.xxhash64("id", "q"), "q").limit(sample).select("q").collect()
    some = np.stack([np.frombuffer(r.q, "<i4") for r in seen]) if seen else np.zeros((1, size), "<i4")
    low, high = np.quantile(some, 0.01, axis=0), np.quantile(some, 0.99, axis=0)
    step = np.maximum(high - low, 1) / (1 << bits)

    def index(batches):
        for batch in batches:
            x = _matrix(batch.column(1), "<i4", size)
            cells = np.clip((x - low) / step, 0, (1 << bits) - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, _binary(hilbert(cells, bits))], ["id", "q", "at"])

    def cut(batches):
        task, number, held, n = TaskContext.get().partitionId() << 32, 0, [], 0

        def blocks(rows: pa.Table, whole: bool):
            nonlocal number
            for i in range(0, len(rows) if whole else len(rows) - len(rows) % block, block):
                part = rows.slice(i, block).combine_chunks()
                x = _matrix(part.column("q").chunk(0), "<i4", size)
                box = [np.concatenate([x.min(axis=0), x.max(axis=0)]).astype("<i4").tobytes()]
                out = pa.table({"id": part.column("id"), "q": part.column("q"), "block": np.full(len(x), task + number), "box": pa.array(box + [None] * (len(x) - 1), pa.binary())})
                number += 1
                yield from out.to_batches()

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= block:
                rows = pa.Table.from_batches(held).select(["id", "q"])
                yield from blocks(rows, False)
                held, n = [b.select(["id", "q"]) for b in rows.slice(n - n % block).to_batches()], n % block
            else:
                held[-1] = batch.select(["id", "q"])
        if n:
            yield from blocks(pa.Table.from_batches(held), True)

    kind = q.schema["id"].dataType.simpleString()
    indexed = q.mapInArrow(index, f"id {kind}, q binary, at binary").withColumn("_salt", F.xxhash64("id", F.monotonically_increasing_id()))
    ordered = indexed.repartitionByRange(shuffle_partitions(spark), "at", "_salt").sortWithinPartitions("at", "_salt").select("id", "q")
    return ordered.mapInArrow(cut, f"id {kind}, q binary, block long, box binary")


def candidates(box: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Which centroids can be nearest to some vector in the box (least, then largest components).

    The centroid nearest to the box's middle leads. What another is farther than the leader is linear in each component, so
    it is least at a corner of the box; where it is above 0 even there, or 0 and the leader has the smaller number, the other is out.
    """
    low, high = box[: centroids.shape[1]].astype(np.int64), box[centroids.shape[1] :].astype(np.int64)
    lead = int(np.square(low + high - 2 * centroids).sum(axis=1).argmin())
    towards = centroids - centroids[lead]
    corner = np.where(towards > 0, high, low)
    farther = ((centroids + centroids[lead] - 2 * corner) * towards).sum(axis=1)
    return np.flatnonzero((farther < 0) | ((farther == 0) & (np.arange(len(centroids)) <= lead)))


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances; components below 2^20 keep every term of the expanded square under 2^53."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) < 1 << 20:
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return (np.square(a).sum(axis=1)[:, None] - 2 * (a @ b.T) + np.square(b).sum(axis=1)).astype(np.int64)
    return np.stack([np.square(x.astype(np.int64) - c).sum(axis=1) for c in centroids], axis=1)


def _nearest(batches, centroids: np.ndarray):
    """For each batch: ids, vectors, cluster, squared distance, and how many pairs were compared."""
    size, current, able = centroids.shape[1], None, None
    everyone = np.arange(len(centroids))
    for batch in batches:
        x, block = _matrix(batch.column(1), "<i4", size), batch.column(2).to_numpy()
        box, cluster, distance, compared = batch.column(3), np.empty(len(x), np.int32), np.empty(len(x), np.int64), 0
        begin = np.flatnonzero(np.diff(block, prepend=block[:1] - 1)) if len(block) else []
        for i, j in zip(begin, [*begin[1:], len(block)], strict=True):
            if box[i].is_valid:
                able = candidates(np.frombuffer(box[i].as_py(), "<i4"), centroids)
            elif block[i] != current:
                able = everyone  # a read that begins inside a block has no box
            current = block[i]
            found = _distances(x[i:j], centroids[able])
            best = found.argmin(axis=1)
            cluster[i:j], distance[i:j] = able[best], found[np.arange(j - i), best]
            compared += found.size
        yield batch.column(0), x, cluster, distance, compared


def summed(rows: DataFrame, centroids: np.ndarray) -> tuple[list, int]:
    """(count, component sums, distance sum) of each centroid, and the number of compared pairs."""
    k, size = centroids.shape

    def run(batches):
        count, total, inertia, pairs = np.zeros(k, np.int64), np.zeros((k, size), np.int64), [0] * k, 0
        for _, x, cluster, distance, compared in _nearest(batches, centroids):
            count += np.bincount(cluster, minlength=k)
            for c in np.unique(cluster):
                total[c] += x[cluster == c].sum(axis=0, dtype=np.int64)
                inertia[c] += sum(distance[cluster == c].tolist())
            pairs += compared
        numbers = [pa.array([str(n) for n in inertia]), pa.array([pairs] + [0] * (k - 1), pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(count), pa.array(total.tolist(), pa.list_(pa.int64())), *numbers], ["cluster", "n", "total", "inertia", "pairs"])

    exact = lambda c: F.sum(c.cast("decimal(38,0)"))
    parts = rows.mapInArrow(run, "cluster int, n long, total array<long>, inertia string, pairs long")
    totals = [exact(F.col("total")[i]).alias(f"t{i}") for i in range(size)]
    found = {r.cluster: r for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), exact(F.col("inertia")).alias("inertia"), F.sum("pairs").alias("pairs"), *totals).collect()}
    out = [(int(found[c].n), [int(found[c][f"t{i}"]) for i in range(size)], int(found[c].inertia)) if c in found else (0, [0] * size, 0) for c in range(k)]
    return out, sum(int(r.pairs) for r in found.values())


def first_centroids(q: DataFrame, k: int, seed: int, size: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``seed:id``, in that order; equal ids by their vectors."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = q.select(key.alias("key"), "q").orderBy("key", "q").limit(k).collect()
    return np.array([np.frombuffer(r.q, "<i4") for r in first], np.int64).reshape(-1, size)


def fit(rows: DataFrame, centroids: np.ndarray, rounds: int) -> np.ndarray:
    """Centroids after so many rounds; one without vectors stays where it is."""
    for _ in range(rounds):
        sums, _ = summed(rows, centroids)
        centroids = np.array([[t // n for t in total] if n else old.tolist() for (n, total, _), old in zip(sums, centroids, strict=True)], np.int64)
    return centroids


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = 64, k: int = 16, rounds: int = 3, seed: int = 1, block: int = 64) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that is kept."""
    spark = df.sparkSession
    q = stored(quantised(df, id_col, vector_col, size), "quantised")
    centroids = first_centroids(q, k, seed, size)
    fields = [("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string")]
    kind = q.schema["id"].dataType
    if not len(centroids):
        return spark.createDataFrame([], StructType([StructField("id", kind)])).select("id", *[F.lit(None).cast(t).alias(n) for n, t in fields])
    rows = stored(zoned(q, size, block), "zoned")
    centroids = fit(rows, centroids, rounds)
    sums, _ = summed(rows, centroids)
    inertia = np.array([min(s, LARGEST) for _, _, s in sums], np.int64)
    total = min(sum(s for _, _, s in sums), LARGEST)
    names = np.array([hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids], object)

    def run(batches):
        for ids, _, own, distance, _ in _nearest(batches, centroids):
            yield pa.RecordBatch.from_arrays([ids, pa.array(own), pa.array(distance), pa.array(inertia[own]), pa.array(np.full(len(own), total)), pa.array(names[own], pa.string())], ["id", *[n for n, _ in fields]])

    return rows.mapInArrow(run, f"id {kind.simpleString()}, " + ", ".join(f"{n} {t}" for n, t in fields))


def oracle() -> str:
    """The contract in SQL: three rounds and the last assignment, vector ids being unique."""
    distance = "CAST(list_sum(list_transform(range(1, 65), lambda i: (q[i] - m[i]) * (q[i] - m[i]))) AS BIGINT)"
    parts = ["""WITH kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
 WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, q AS m FROM kept QUALIFY c < 16)"""]
    for r in range(4):
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(q) AS q, arg_min(c, (s, c)) AS cluster, min(s) AS distance FROM (SELECT vec_id, q, c, {distance} AS s FROM kept, c{r}) GROUP BY vec_id)")
        if r < 3:
            floor = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
            parts.append(f"""s{r} AS (SELECT cluster, i, {floor} AS m FROM (SELECT cluster, i, sum(q[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{r}, range(1, 65) t(i) GROUP BY 1, 2)),
c{r + 1} AS MATERIALIZED (SELECT c, coalesce(new.m, old.m) AS m FROM c{r} old LEFT JOIN (SELECT cluster, list(m ORDER BY i) AS m FROM s{r} GROUP BY 1) new ON c = cluster)""")
    return ",\n".join(parts) + """
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a3 JOIN c3 ON c = cluster"""


CLUSTER_SQL = oracle()
