"""An approximate index of vectors: an inverted file with product-quantised residuals, stored as Parquet.

Cells and codebooks are fitted by k-means on at most ``sample`` rows, those with the smallest hashes of their ids. Every
row is then assigned to its nearest cell, and what is left of it becomes a code of ``parts`` bytes. Cells are partitions of
two tables: ``codes``, rows packed in blocks, and ``vectors``, which only the re-ranking reads. A search probes the cells
nearest to a query, ranks their rows by code, and ranks the best of those by their exact cosine.

How many cells a query probes is measured on the sample when the index is built: the fewest that hold ``target`` of the
nearest neighbours of up to 64 of its rows. Where vectors form groups that is a few; where they point everywhere alike
it is most of them, and ``probes`` says so.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import best_of_each

BLOCK, QUERIES = 4096, 64


def unit_vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a list column that are neither null nor zero, and these at length 1."""
    rows = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(rows), -1) if len(rows) else np.empty((0, 0), np.float32)
    length = np.linalg.norm(x, axis=1)
    some = length > 0
    return rows[some], x[some] / length[some, None]


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centres of the rows; a centre without rows moves to the row that is farthest from its own."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        far = np.square(x).sum(axis=1)[:, None] - 2 * x @ centres.T + np.square(centres).sum(axis=1)
        own, least = far.argmin(axis=1), far.min(axis=1)
        sums, count = np.zeros_like(centres), np.bincount(own, minlength=k)
        np.add.at(sums, own, x)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
        empty = np.flatnonzero(count == 0)
        centres[empty] = x[np.argsort(-least, kind="stable")[: len(empty)]]
    return centres


@dataclass
class Model:
    """Centres of the cells, codebooks of the parts, and the number of cells that a query probes."""

    centres: np.ndarray
    books: np.ndarray
    probes: int

    def cells(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.centres.T - np.square(self.centres).sum(axis=1) / 2).argmax(axis=1)

    def codes(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        parts, _, width = self.books.shape
        rest = (x - self.centres[cell]).reshape(len(x), parts, width)
        return np.stack([(rest[:, p] @ b.T - np.square(b).sum(axis=1) / 2).argmax(axis=1) for p, b in enumerate(self.books)], axis=1).astype(np.uint8)

    def nearest_cells(self, x: np.ndarray, n: int) -> np.ndarray:
        score = x @ self.centres.T
        return np.argsort(-score, axis=1, kind="stable")[:, :n]


def fit(x: np.ndarray, cells: int, parts: int, target: float, k: int = 20) -> Model:
    """Cells, codebooks and probes from unit vectors."""
    centres = k_means(x, min(cells, len(x)))
    model = Model(centres, np.empty(0), 1)
    own = model.cells(x)
    rest = (x - centres[own]).reshape(len(x), parts, -1)
    books = np.stack([k_means(np.ascontiguousarray(rest[:, p]), min(256, len(x))) for p in range(parts)])
    ask = np.linspace(0, len(x) - 1, min(64, len(x))).astype(int)
    score = x[ask] @ x.T
    score[np.arange(len(ask)), ask] = -2
    near = np.argsort(-score, axis=1, kind="stable")[:, : min(k, max(len(x) - 1, 1))]
    order = model.nearest_cells(x[ask], len(centres))
    place = np.argsort(order, axis=1)  # of each cell in a query's order
    needed = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    return Model(centres, books, int(needed[math.ceil(target * len(needed)) - 1]) + 1)


class IvfIndex:
    """A stored index. ``build`` writes one, the constructor opens it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        m = spark.read.parquet(f"{path}/model").first()
        self.model = Model(np.array(m.centres, np.float32), np.array(m.books, np.float32), m.probes)
        self.rows = m.rows

    @staticmethod
    def build(df: DataFrame, vector: str, id_col: str, path: str, cells: int | None = None, parts: int = 16, sample: int = 65536, target: float = 0.97) -> IvfIndex:
        """Index every row with a vector; ids are whole numbers. ``cells``: by default the root of the number of rows, 4,096 at most."""
        spark = df.sparkSession
        rows = df.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"))
        n = rows.count()
        seen = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()
        _, x = unit_vectors(pa.array([r.v for r in seen], pa.list_(pa.float32())))
        if not len(x):
            raise ValueError("no row has a vector")
        model = fit(x, cells or max(1, min(4096, math.isqrt(n))), parts, target)

        def assign(batches):
            for batch in batches:
                at, x = unit_vectors(batch.column(1))
                if len(at):
                    cell = model.cells(x)
                    codes = np.ascontiguousarray(model.codes(x, cell))
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array([c.tobytes() for c in codes])], ["cell", "id", "v", "code"])

        # a cell is one partition unless it is large: adaptive execution splits those, so a common vector is no single task's
        dealt = rows.mapInArrow(assign, "cell int, id long, v array<float>, code binary").hint("rebalance", "cell")
        dealt.sortWithinPartitions("cell", "id").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")

        def pack(batches):
            for batch in batches:
                cell = batch.column(2).to_numpy()
                cut = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]])
                for i, end in zip(cut[:-1], cut[1:], strict=True):
                    for k in range(i, end, BLOCK):
                        part = slice(k, min(k + BLOCK, end))
                        ids, codes = batch.column(0).to_numpy()[part], batch.column(1)[part.start : part.stop]
                        yield pa.RecordBatch.from_arrays([pa.array([int(cell[k])], pa.int32()), pa.array([ids.tobytes()]), pa.array([b"".join(codes.to_pylist())])], ["cell", "ids", "codes"])

        stored = spark.read.parquet(f"{path}/vectors").select("id", "code", "cell")
        stored.sortWithinPartitions("cell", "id").mapInArrow(pack, "cell int, ids binary, codes binary").hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/codes")
        spark.createDataFrame([(model.centres.tolist(), model.books.tolist(), model.probes, n)], "centres array<array<float>>, books array<array<array<float>>>, probes int, rows long").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
        return IvfIndex(spark, path)

    def _probed(self, queries: DataFrame, vector: str, probes: int) -> DataFrame:
        """Queries (query_id, vector) packed by the cell that they probe, at most QUERIES in a row."""
        model = self.model

        def probe(batches):
            for batch in batches:
                at, x = unit_vectors(batch.column(1))
                if len(at):
                    cells = model.nearest_cells(x, probes)
                    n = cells.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array(cells.ravel().astype(np.int32)), batch.column(0).take(pa.array(np.repeat(at, n))), pa.array([v for r in x for v in [r.tobytes()] * n])], ["cell", "query_id", "x"])

        each = queries.select(F.col("query_id").cast("long"), F.col(vector).cast("array<float>").alias("v")).mapInArrow(probe, "cell int, query_id long, x binary")
        salt = F.pmod(F.xxhash64("query_id"), F.greatest(F.lit(1), F.ceil(F.col("_n") / QUERIES)))
        sized = each.join(each.groupBy("cell").agg(F.count("*").alias("_n")), "cell").withColumn("_part", salt)
        return sized.groupBy("cell", "_part").agg(F.collect_list(F.struct("query_id", "x")).alias("asked")).select("cell", "asked")

    def search(self, queries: DataFrame, vector: str, k: int, id_col: str = "id", probes: int | None = None, over: int = 8, allowed: DataFrame | None = None) -> DataFrame:
        """(query_id, id, similarity, rank): the k nearest rows that the probed cells have, ties by id.

        ``allowed`` (id) is a predicate over the candidates, k * over a query, so few may be left, as with any index.
        """
        model, most = self.model, k * over

        def compare(batches):
            for batch in batches:
                for cell, ids, codes, asked in zip(*(batch.column(c) for c in ("cell", "ids", "codes", "asked")), strict=True):
                    rows, asked = np.frombuffer(ids.as_py(), np.int64), asked.as_py()
                    code = np.frombuffer(codes.as_py(), np.uint8).reshape(len(rows), -1)
                    x = np.stack([np.frombuffer(a["x"], np.float32) for a in asked])
                    table = np.einsum("qpw,pcw->qpc", x.reshape(len(x), *model.books.shape[::2]), model.books)
                    score = np.repeat((x @ model.centres[cell.as_py()])[:, None], len(rows), axis=1)
                    for p in range(code.shape[1]):
                        score += table[:, p, code[:, p]]
                    n = min(most, len(rows))
                    best = np.argpartition(-score, n - 1, axis=1)[:, :n]
                    query = np.repeat([a["query_id"] for a in asked], n)
                    yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(rows[best.ravel()]), pa.array(np.full(len(query), cell.as_py(), np.int32)), pa.array(np.take_along_axis(score, best, axis=1).ravel().astype(np.float64))], ["query_id", "id", "cell", "score"])

        codes = self.spark.read.parquet(f"{self.path}/codes")
        met = codes.join(self._probed(queries, vector, probes or model.probes), "cell").select("cell", "ids", "codes", "asked")
        near = best_of_each(met.mapInArrow(compare, "query_id long, id long, cell int, score double"), "score", "id", most).select("query_id", "id", "cell")
        if allowed is not None:
            near = near.join(allowed.select(F.col(allowed.columns[0]).cast("long").alias("id")), "id", "left_semi")
        stored = self.spark.read.parquet(f"{self.path}/vectors").select("cell", "id", F.col("v").alias("_r"))
        asked = queries.select(F.col("query_id").cast("long"), F.transform(vector, lambda x: x.cast("double")).alias("_q"))
        both = near.join(stored, ["cell", "id"]).join(asked, "query_id")
        add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
        dot = lambda a, b: add(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
        cosine = F.round(dot("_r", "_q") / F.sqrt(dot("_r", "_r") * dot("_q", "_q")), 12)
        return best_of_each(both.select("query_id", "id", cosine.alias("similarity")), "similarity", "id", k).withColumnRenamed("id", id_col)

    def share_scanned(self, queries: DataFrame, vector: str, probes: int | None = None) -> float:
        """Pairs of a query and a row whose codes meet, as a share of all pairs."""
        sizes = self.spark.read.parquet(f"{self.path}/vectors").groupBy("cell").agg(F.count("*").alias("n"))
        asked = self._probed(queries, vector, probes or self.model.probes).select("cell", F.size("asked").alias("q"))
        met, n = asked.join(sizes, "cell").agg(F.sum(F.col("q") * F.col("n"))).first()[0] or 0, queries.count()
        return met / max(1, n * self.rows)
