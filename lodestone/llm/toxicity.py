"""Toxicity: logistic regression over hashed word n-grams and skip-grams, learned by FTRL-proximal.

Words are runs of letters, digits and non-ASCII bytes without case. A text's
features are the distinct hashed words, word pairs and pairs that skip one
word, each with value 1. FTRL-proximal has a learning rate by coordinate, and
its L1 term leaves most weights exactly 0: what is broadcast is the few
thousand pairs of coordinate and weight, at most ``1 << bits`` of them.

The classifier is fitted on at most ``max_rows`` labelled rows, the ones with
the smallest hash of their id; executors extract their features and one task
runs the passes. Of several labels of one id the highest counts; null labels
and labels without a text row are ignored. Without any labelled row every score
is 0.5. Null and empty texts have no features and get the bias alone; repeated
rows are scored each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .shared import remainder


@dataclass(frozen=True)
class Model:
    bits: int
    bias: float
    coordinates: np.ndarray
    weights: np.ndarray

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << self.bits, np.float32)
        w[self.coordinates] = self.weights
        return w


def hashed_features(column, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, coordinate) of words, pairs and skip pairs, with repeats, in no order."""
    t = tx.Tokens(*tx.buffers(column), tx.ALNUM_LOWER)
    h, row = t.hashes(), t.row()
    rows, values = [row], [tx.mix(h)]
    for gap in (1, 2):
        if len(h) > gap:
            same = row[gap:] == row[:-gap]
            rows.append(row[gap:][same])
            values.append(tx.pair(h[:-gap][same] + np.uint64(gap), h[gap:][same]))
    return np.concatenate(rows), np.concatenate(values) >> np.uint64(64 - bits)


def ftrl(examples: list[tuple[np.ndarray, int]], bits: int, alpha: float, beta: float, l1: float, l2: float, passes: int) -> Model:
    """FTRL-proximal over (distinct coordinates, label) examples, in the order given. The last coordinate is the bias, without L1."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(zi, ni, bare):
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2)
        w[np.abs(zi) <= l1] = 0.0
        if bare:
            w[-1] = -zi[-1] / ((beta + np.sqrt(ni[-1])) / alpha)
        return w

    for _ in range(passes):
        for features, label in examples:
            at = np.append(features, size)
            zi, ni = z[at], n[at]
            w = weights(zi, ni, True)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[at] = ni + g * g
    w = weights(z, n, True)
    kept = np.flatnonzero(w[:-1])
    return Model(bits, float(w[-1]), kept.astype(np.uint32), w[kept].astype(np.float32))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bits: int = 20, alpha: float = 4.0, beta: float = 1.0, l1: float = 5.0, l2: float = 0.1, passes: int = 3) -> Model:
    """Fit on all rows of ``labelled``, which the caller bounds: one task holds their features."""

    def extract(batches):
        for batch in batches:
            for i, j in tx.row_slices(batch.column(2)):
                row, at = hashed_features(batch.column(2).slice(i, j - i), bits)
                key = np.unique(row.astype(np.uint64) << np.uint64(32) | at)
                edge = np.searchsorted(key >> np.uint64(32), np.arange(j - i + 1))
                packed = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                out = [packed[edge[k] : edge[k + 1]].tobytes() for k in range(j - i)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(out, pa.binary())], ["place", "label", "features"])

    def train(table):
        table = table.sort_by([("place", "ascending"), ("label", "ascending")])
        examples = [(np.frombuffer(f.as_py(), np.uint32), y) for f, y in zip(table.column("features"), table.column("label").to_pylist(), strict=True)]
        m = ftrl(examples, bits, alpha, beta, l1, l2, passes)
        return pa.table({"bias": [m.bias], "coordinates": pa.array([m.coordinates.tobytes()], pa.binary()), "weights": pa.array([m.weights.tobytes()], pa.binary())})

    rows = labelled.select(F.xxhash64(F.col(id_col)).alias("place"), F.col(label_col).cast("int").alias("label"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(extract, "place long, label int, features binary").withColumn("one", F.lit(0)).groupBy("one").applyInArrow(train, "bias double, coordinates binary, weights binary").collect()
    if not found:
        return Model(bits, 0.0, np.empty(0, np.uint32), np.empty(0, np.float32))
    return Model(bits, found[0].bias, np.frombuffer(found[0].coordinates, np.uint32), np.frombuffer(found[0].weights, np.float32))


def score_column(model: Model, dense: np.ndarray, column) -> np.ndarray:
    row, at = hashed_features(column, model.bits)
    w = dense[at]
    some = np.flatnonzero(w)
    key, first = np.unique(row[some].astype(np.uint64) << np.uint64(32) | at[some], return_index=True)
    total = model.bias + np.bincount((key >> np.uint64(32)).astype(np.int64), w[some][first], len(column))
    return 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int) -> DataFrame:
    """At most ``max_rows`` labelled rows (place by hash of the id), by a join with their ids, which that number bounds."""
    one = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias(label_col))
    chosen = one.orderBy(F.xxhash64(id_col), id_col).limit(max_rows)
    return docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """The id, the columns ``keep`` and ``score`` of every row's whole text."""
    from pyspark.sql.pandas.types import to_arrow_schema

    columns = docs.select(id_col, *keep)
    types = [f.type for f in to_arrow_schema(columns.schema)]
    names = [*columns.columns, "score"]

    def run(batches):
        dense = model.dense()
        for batch in batches:
            text = batch.column(len(types))
            for i, j in tx.row_slices(text):
                arrays = [batch.column(k).slice(i, j - i).cast(t) for k, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(score_column(model, dense, text.slice(i, j - i)))], names)

    return docs.select(id_col, *keep, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, columns.schema.add("score", "double"))


def learn(docs: DataFrame, labels: DataFrame, divisor: int = 3, held_out: int = 1, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from labelled rows whose crc32(id) mod ``divisor`` is not ``held_out``."""
    own = labels.where(remainder(id_col, divisor) != held_out)
    return fit(labelled_rows(docs, own, id_col, text_col, label_col, max_rows), id_col, text_col, label_col)


def score_held_out(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, divisor: int = 3, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) for every row of ``docs``."""
    model = learn(docs, labels, divisor, held_out, id_col=id_col, text_col=text_col)
    scored = score(docs, model, id_col, text_col)
    return scored.select(id_col, (remainder(id_col, divisor) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
