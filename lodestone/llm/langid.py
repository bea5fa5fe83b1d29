"""Language ID: multinomial naive Bayes over hashed character n-grams.

Characters are code points, A-Z without case; n-grams of one to three
characters are hashed into ``1 << bits`` columns. Every task counts its rows
into dense rows by language, cut into blocks of columns; these merge by language, block and a
salt, then by language and block, so that no task gets a share of all tasks' rows. Only the log-probability
matrix, languages x columns in float32, reaches the driver and is broadcast.
Its size is checked against ``max_matrix_mb``. Scoring gathers matrix rows for
whole batches of texts in numpy.

Training rows need text and a non-null language; they are all used, with no
sample. Null, empty and letterless texts (no character of Unicode's category L) are ``und`` with score 0. Ties go to
the language that sorts first. With nothing to learn from, all are ``und``.
Repeated rows count and are predicted each.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .shared import remainder

ORDERS = (1, 2, 3)
UNKNOWN = "und"
#: Letters, and numbers that are no decimal digits, which ``has_letter`` leaves out.
_LETTER = re.compile(r"[^\W\d_]")
#: Columns of one block.
BLOCK = 4096


def has_letter(text: str | None) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text or ""))


@dataclass(frozen=True)
class Model:
    languages: tuple
    #: columns x languages, log probabilities; and the log priors.
    matrix: np.ndarray
    prior: np.ndarray


def hashed_ngrams(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns of all n-grams of texts, text by text for each order, and the text of each."""
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) for t in texts])
    lower = (code + np.where((code >= 65) & (code <= 90), 32, 0)).astype(np.uint64)
    columns, rows, h = [], [], lower * np.uint64(0x9E3779B97F4A7C15)
    for n in ORDERS:
        if len(lower) < n:
            break
        if n > 1:
            h = h[:-1] * np.uint64(0x9DDFEA08EB382D69) + lower[n - 1 :]
        same = row[n - 1 :] == row[: len(row) - n + 1]
        columns.append((tx.mix(h + np.uint64(n)) >> np.uint64(64 - bits))[same].astype(np.int64))
        rows.append(row[n - 1 :][same])
    return (np.concatenate(columns), np.concatenate(rows)) if columns else (np.empty(0, np.int64), np.empty(0, np.int32))


def _count(bits: int):
    def run(batches):
        counts: dict[str, np.ndarray] = {}
        texts_of: dict[str, int] = {}
        for batch in batches:
            for i, j in tx.row_slices(batch.column(1)):
                langs = np.array(batch.column(0).slice(i, j - i).to_pylist(), object)
                texts = batch.column(1).slice(i, j - i).to_pylist()
                for lang in sorted(set(langs)):
                    own = [texts[k] for k in np.flatnonzero(langs == lang)]
                    found = np.bincount(hashed_ngrams(own, bits)[0], minlength=1 << bits)
                    counts[lang] = counts.get(lang, 0) + found
                    texts_of[lang] = texts_of.get(lang, 0) + len(own)
        step = min(BLOCK, 1 << bits)
        for lang, found in counts.items():
            rows = found.astype(np.int64).reshape(-1, step)
            n = len(rows)
            arrays = [pa.array([lang] * n), pa.array(np.arange(n, dtype=np.int32)), pa.array([texts_of[lang]] + [0] * (n - 1), pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["lang", "block", "texts", "counts"])

    return run


def _merge(key, table):
    total = np.zeros(len(table.column("counts")[0].as_py()) // 8, np.int64)
    for c in table.column("counts"):
        total += np.frombuffer(c.as_buffer(), np.int64)
    return pa.table({"lang": [key[0].as_py()], "block": pa.array([key[1].as_py()], pa.int32()), "texts": pa.array([sum(table.column("texts").to_pylist())], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", bits: int = 16, smoothing: float = 0.5, max_matrix_mb: int = 256) -> Model:
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    schema = "lang string, block int, texts long, counts binary"
    salts = max(8, math.isqrt(docs.count() // 1000))
    salted = rows.mapInArrow(_count(bits), schema).withColumn("salt", F.pmod(F.xxhash64("counts"), F.lit(salts)))
    counted = salted.groupBy("lang", "block", "salt").applyInArrow(_merge, schema)
    found = counted.groupBy("lang", "block").applyInArrow(_merge, schema).orderBy("lang", "block")
    languages, texts, columns, parts = [], [], [], []
    for r in found.toLocalIterator():  # one block at a time
        if not r.block:
            if (len(languages) + 1 << bits) * 4 > max_matrix_mb << 20:
                raise ValueError(f"the matrix of more than {len(languages)} languages is larger than {max_matrix_mb} MB; use fewer bits")
            languages.append(r.lang)
            texts.append(r.texts)
        parts.append(np.frombuffer(r.counts, np.int64))
        if sum(map(len, parts)) == 1 << bits:
            c = np.concatenate(parts) + smoothing
            columns.append(np.log(c / c.sum()).astype(np.float32))
            parts = []
    if not languages:
        return Model((), np.zeros((1 << bits, 0), np.float32), np.zeros(0))
    return Model(tuple(languages), np.ascontiguousarray(np.stack(columns, 1)), np.log(np.array(texts) / sum(texts)))


def predict_texts(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and its posterior probability by text."""
    letters = np.array([has_letter(t) for t in texts], bool)
    if not model.languages or not letters.any():
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    at, row = hashed_ngrams([t or "" for t in texts], int(len(model.matrix)).bit_length() - 1)
    total = np.stack([np.bincount(row, model.matrix[:, k][at], len(texts)) for k in range(len(model.languages))], 1) + model.prior
    best = total.argmax(1)
    p = 1.0 / np.exp(total - total.max(1, keepdims=True)).sum(1)
    return [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)], np.where(letters, p, 0.0)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row of ``docs``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ids = docs.select(id_col).schema
    id_type = to_arrow_schema(ids).field(0).type
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            for i, j in tx.row_slices(batch.column(1), 1 << 19):
                lang, p = predict_texts(m, batch.column(1).slice(i, j - i).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(id_type), pa.array(lang), pa.array(p)], [id_col, "lang_pred", "score"])

    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(run, ids.add("lang_pred", "string").add("score", "double"))


def predict_held_out(docs: DataFrame, divisor: int = 3, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from rows whose crc32(id) mod ``divisor`` is not ``held_out``; (id, held_out, lang_pred, score) for all."""
    fold = remainder(id_col, divisor)
    model = fit(docs.where(fold != held_out), text_col, lang_col)
    return predict(docs, model, id_col, text_col).select(id_col, (fold == held_out).alias("held_out"), "lang_pred", "score")
