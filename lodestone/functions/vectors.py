"""Vectors: a deterministic hashing embedder, cosine similarity and dimension checks."""

from __future__ import annotations

import re
import time
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

#: Bytes of words: letters, digits, and all bytes beyond ASCII, of which ``_OTHER`` leaves letters and digits alone.
_INSIDE = np.array([b > 127 or chr(b).isalnum() for b in range(256)])
_OTHER = re.compile(r"[\W_]+")
SLICE, LONG = 4 << 20, 64


def _crc_table() -> np.ndarray:
    """The 256 steps of CRC-32, from its polynomial."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1).astype(np.uint32)
    return out


_CRC = _crc_table()


def crc32s(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """CRC-32 of many stretches of bytes at once, a byte of all of them a step; each goes on from ``before``. Stretches of over LONG bytes are done one by one."""
    length = end - start
    state = ~(np.zeros(len(start), np.uint32) if before is None else before)
    short = np.flatnonzero(length <= LONG)
    order = short[np.argsort(-length[short], kind="stable")]
    now, at, sizes = state[order], start[order], -length[order]
    for k in range(int(-sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(sizes, -k, "left"))  # those that have a byte k
        now[:n] = _CRC[(now[:n] ^ data[at[:n] + k]) & 255] ^ (now[:n] >> 8)
    state[order] = now
    out = ~state
    for w in np.flatnonzero(length > LONG):
        out[w] = zlib.crc32(data[start[w] : end[w]], 0 if before is None else int(before[w]))
    return out


class HashingEmbedder:
    """Signed feature hashing of words and word pairs, L2-normalised. Repeatable, without a model file; it knows no synonyms.

    Hashes are CRC-32 of a word, and of two with a blank between, taken for all words of a batch at once.
    """

    #: Characters that the embedder can read; None is the whole text. Only one with a context window sets it.
    max_chars: int | None = None

    def __init__(self, dimension: int = 128):
        self.dimension, self.name = dimension, f"hashing-{dimension}"

    def _slice(self, rows: list[bytes]) -> np.ndarray:
        lengths = np.array([len(r) + 1 for r in rows])
        data = np.frombuffer(b"\0".join([*rows, b""]), np.uint8)
        inside = np.concatenate([[False], _INSIDE[data], [False]])
        start, end = np.flatnonzero(inside[1:-1] & ~inside[:-2]), np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
        row = np.searchsorted(np.cumsum(lengths), start, "right")
        word = crc32s(data, start, end)
        next_to = np.flatnonzero(row[1:] == row[:-1])
        blank = crc32s(np.frombuffer(b" ", np.uint8), np.zeros(len(next_to), np.int64), np.ones(len(next_to), np.int64), word[next_to])
        pair = crc32s(data, start[next_to + 1], end[next_to + 1], blank)
        feature, at = np.concatenate([word, pair]), np.concatenate([row, row[next_to]])
        cell = at * self.dimension + ((feature >> 1) % self.dimension).astype(np.int64)
        sign = (feature & 1).astype(np.float64) * 2 - 1
        return np.bincount(cell, sign, len(rows) * self.dimension).reshape(len(rows), self.dimension)

    def matrix(self, texts: list[str | None]) -> np.ndarray:
        """A row a text; texts are taken in slices of SLICE bytes, or one by one if longer."""
        lower = [(t or "").lower() for t in texts]
        rows = [(t if t.isascii() else _OTHER.sub(" ", t)).encode("utf-8", "ignore") for t in lower]
        ends, parts, i = np.cumsum([len(r) + 1 for r in rows]), [np.zeros((0, self.dimension))], 0
        while i < len(rows):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + SLICE, "right")))
            parts.append(self._slice(rows[i:j]))
            i = j
        out = np.concatenate(parts).astype(np.float32)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, np.float32(1))

    def encode(self, texts: list[str | None]) -> list[list[float]]:
        return self.matrix(texts).tolist()

    def encode_query(self, text: str) -> list[float]:
        return self.encode([text])[0]


def embed_batch(df: DataFrame, text_col: str, vector_col: str = "vec", embedder: HashingEmbedder | None = None, batch_size: int = 128) -> DataFrame:
    """Fill missing vectors, ``batch_size`` texts at a time; rows with a vector keep it."""
    model = embedder or HashingEmbedder()

    def load():
        return lambda texts: np.asarray(model.encode(list(texts)), np.float32).reshape(len(texts), model.dimension)

    encode = predict_batch_udf(load, return_type=ArrayType(FloatType()), batch_size=batch_size)
    if vector_col not in df.columns:
        text = F.coalesce(F.col(text_col), F.lit(""))
        return df.withColumn(vector_col, encode(text if model.max_chars is None else F.substring(text, 1, model.max_chars)))
    there, missing = df.where(F.col(vector_col).isNotNull()), df.where(F.col(vector_col).isNull())
    return there.unionByName(embed_batch(missing.drop(vector_col), text_col, vector_col, model, batch_size).select(*df.columns))


def cosine(vector: str | Column, query: list[float]) -> Column:
    """Cosine similarity to a literal vector, in doubles; null for a null or zero vector."""
    v = F.transform(F.col(vector) if isinstance(vector, str) else vector, lambda x: x.cast("double"))
    norm = float(np.sqrt(sum(float(x) * float(x) for x in query)))
    q = F.array(*[F.lit(float(x)) for x in query])
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    length = F.sqrt(add(F.transform(v, lambda x: x * x)))
    return F.when(length > 0, add(F.zip_with(v, q, lambda a, b: a * b)) / (length * F.lit(norm)))


def check_dimension(df: DataFrame, vector_col: str, dimension: int) -> DataFrame:
    """Fails a row whose vector has another dimension."""
    return df.where(F.col(vector_col).isNull() | F.assert_true(F.size(vector_col) == dimension, F.lit(f"{vector_col} must have {dimension} numbers")).isNull())


class RateLimited(Exception):
    """Raised by a remote embedder that asks for patience."""


def with_retry(call: Callable, attempts: int = 8, first: float = 1.0, longest: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """Repeat a call that is rate-limited, waiting twice as long each time; other errors, and the last one, are raised."""

    def run(*args, **kwargs):
        for n in range(attempts):
            try:
                return call(*args, **kwargs)
            except RateLimited:
                if n == attempts - 1:
                    raise
                sleep(min(longest, first * 2**n))
        raise ValueError("attempts must be positive")

    return run


class RetryingEmbedder:
    """An embedder whose batches are repeated while a remote model limits its rate."""

    def __init__(self, embedder, **retry):
        self.embedder, self.retry, self.dimension, self.name = embedder, retry, embedder.dimension, embedder.name
        self.max_chars = getattr(embedder, "max_chars", None)

    def encode(self, texts: list[str | None]) -> list[list[float]]:
        return with_retry(self.embedder.encode, **self.retry)(texts)

    def encode_query(self, text: str) -> list[float]:
        return self.encode([text])[0]
