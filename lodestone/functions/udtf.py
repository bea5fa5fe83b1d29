"""Table functions for SQL: a text's lexemes with their positions, called laterally, and a table with vectors added."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, FloatType, IntegerType, Row, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .lexical import STOP_WORDS, WORD
from .stemmer import remembered_stem
from .vectors import HashingEmbedder

_STOP = frozenset(STOP_WORDS)


class LexemePositions:
    """(pos, lexeme) of a text; ``stemming`` is a constant."""

    @staticmethod
    def analyze(text: AnalyzeArgument, stemming: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not isinstance(text.dataType, StringType):
            raise ValueError("the first argument must be a text")
        return AnalyzeResult(StructType([StructField("pos", IntegerType()), StructField("lexeme", StringType())]))

    def eval(self, text: str, stemming: bool = True):
        for k, word in enumerate(re.findall(WORD, (text or "").lower()), 1):
            if word not in _STOP:
                yield k, remembered_stem(word) if stemming else word


class EncodeBatch:
    """The rows of a table and a vector of a text column, ``batch_size`` texts at a time. Rows stay in their tasks unless PARTITION BY gives each key a batch of its own."""

    def __init__(self):
        self.rows, self.model, self.column, self.most = [], None, None, 128

    @staticmethod
    def analyze(rows: AnalyzeArgument, column: AnalyzeArgument, dimension: AnalyzeArgument | None = None, batch_size: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not rows.isTable or column.value not in rows.dataType.names:
            raise ValueError(f"the first argument must be a table with the column {column.value}")
        return AnalyzeResult(StructType([*rows.dataType.fields, StructField("vec", ArrayType(FloatType()))]))

    def eval(self, rows: Row, column: str, dimension: int = 128, batch_size: int = 128):
        if self.model is None:
            self.model, self.column, self.most = HashingEmbedder(dimension), column, batch_size
        self.rows.append(rows)
        if len(self.rows) >= self.most:
            yield from self.flush()

    def flush(self):
        vectors = self.model.encode([r[self.column] for r in self.rows])
        yield from ((*r, v) for r, v in zip(self.rows, vectors, strict=True))
        self.rows = []

    def terminate(self):
        if self.rows:
            yield from self.flush()


def register(spark: SparkSession) -> None:
    # deterministic, so that a filter on the other columns goes below the call and only its rows are read into Python
    spark.udtf.register("lexeme_positions", udtf(LexemePositions).asDeterministic())
    spark.udtf.register("encode_batch", udtf(EncodeBatch))
