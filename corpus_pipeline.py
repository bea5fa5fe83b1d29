"""The corpus pipeline: toxicity, exact dedup, SimHash near-dedup, mixing and packing.

Each stage gets the documents that the one before kept, and its decisions take
effect. Every stage but the last returns the columns of ``documents``; mixing
repeats a document as often as it is taken, and packing returns the pieces with
their places in sequences. Decisions apply to rows: repeated rows are copies, and
null ids, which are larger than any id, neither keep a row nor multiply it. Tables
need doc_id, text and source; other columns go along, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import exact, mixing, packing, simhash, toxicity
from lodestone.llm.shared import new_dir, stored

NEEDED = ("doc_id", "text", "source")
THRESHOLD = 0.7


def _own(docs: DataFrame) -> DataFrame:
    """NEEDED, and all other columns in one, so that their names meet none of a stage's."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in NEEDED]
    return docs.select(*NEEDED, F.struct(*(others or [F.lit(True)])).alias("others"))


def _as(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of ``_own`` with the columns that ``docs`` has."""
    return rows.select(*[F.col(c) if c in NEEDED else F.col("others").getField(c).alias(c) for c in docs.columns])


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labels and drop documents that score THRESHOLD or more. No document's own columns but its text count."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(_own(docs), model, keep=("text", "source", "others"))
    return _as(docs, scored.where(F.col("score") < THRESHOLD))


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows with a number of their own, written down so that it stays: ids may repeat or be null."""
    return stored(_own(docs).withColumn("row_key", F.monotonically_increasing_id()), "rows")


def _first_rows(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Of each group (_of, _group) the row with the smallest id, null ids last, and of those one."""
    ids = rows.select("row_key", "doc_id").join(groups, F.col("row_key") == F.col("_of"))
    first = ids.groupBy("_group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("_first"))
    return rows.join(first.select(F.col("_first.row_key").alias("_kept")), F.col("row_key") == F.col("_kept"), "left_semi")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id stays."""
    rows = _keyed(docs)
    return _as(docs, _first_rows(rows, exact.exact_duplicates(rows, "row_key").select(F.col("doc_id").alias("_of"), F.col("keep_id").alias("_group"))))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the row with the smallest id stays."""
    rows = _keyed(docs)
    return _as(docs, _first_rows(rows, simhash.near_duplicates(rows, "row_key").select(F.col("doc_id").alias("_of"), F.col("component_id").alias("_group"))))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each row as often as the mix takes it."""
    rows = _keyed(docs)
    taken = mixing.mix(rows, key_col="row_key").where("copies > 0").select(F.col("row_key").alias("_of"), "copies")
    joined = rows.join(taken, F.col("row_key") == F.col("_of"))
    return _as(docs, joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise and pack what is left; (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier, fingerprints and tokens are not SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_dir(spark, f"pipeline-{uuid.uuid4().hex[:8]}")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
    return docs
