"""Exact dedup by content sort.

The normalised bytes are range-partitioned by sampled splitters, each
partition is sorted externally, so that equal texts are neighbours, and full
comparisons of neighbours find the runs of equal texts. Splitters are cut on
(first bytes, hash, id) of a text: samples stay small however long the texts
are, and the id lets a text with very many copies span several partitions. A
run that reaches a partition's edge is joined with its continuation by the
texts' digests; there are at most two such runs a partition.

Null and empty texts are equal to each other; white space alone normalises to
one space and so differs from empty. Repeated rows are copies: each returns its
own row, and of rows with the same smallest id all are kept. Null ids are larger
than any id. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

_RUNS = "doc_id long, keep_id long, group_size long, text_sha256 string, edge boolean"


def normalised(text_col: str):
    """White-space runs become one space; null is empty."""
    return F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _runs(batches):
    """Rows sorted by (first, hash, text, id), null ids last, in; out come the same rows with their run's smallest id, size and digest.

    A run's ids are held until it ends; of texts, only the last one is.
    """
    first_key = text = digest = key = None
    ids: list[pa.Array] = []
    pending: list = []  # runs that may reach the partition's end

    done: list = []
    for batch in batches:
        column, own = batch.column("norm").cast(pa.large_string()), batch.column("id")
        n = len(column)
        if not n:
            continue
        equal = np.concatenate([[False], pc.equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)])
        at = np.append(np.flatnonzero(~equal), n)
        for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            value = column[i].as_py()
            if value == text and text is not None:
                ids.append(own.slice(i, j - i))
                continue
            if text is not None:
                run = pa.concat_arrays(ids), digest, key
                if key == first_key:
                    pending.append(run)
                else:
                    done.append(run)
            text, ids, digest = value, [own.slice(i, j - i)], hashlib.sha256(value.encode()).hexdigest()
            key = (batch.column("first")[i].as_py(), batch.column("hash")[i].as_py())
            first_key = first_key if first_key is not None else key
        # a run ends for good when the next key has begun
        last = [r for r in done if r[2] == key]
        yield from _records([r for r in done if r[2] != key], False)
        done = last
    if text is not None:
        done.append((pa.concat_arrays(ids), digest, key))
        yield from _records(pending + done, True)


def _records(runs: list, edge: bool):
    if not runs:
        return
    sizes = np.array([len(r[0]) for r in runs])
    rows = np.repeat(np.arange(len(runs)), sizes)
    least = pa.array([r[0][0].as_py() for r in runs], pa.int64())  # null if the run has no id
    arrays = [pa.concat_arrays([r[0] for r in runs]), least.take(pa.array(rows)), pa.array(sizes[rows]), pa.array([r[1] for r in runs]).take(pa.array(rows)), pa.array(np.full(len(rows), edge))]
    yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "keep_id", "group_size", "text_sha256", "edge"])


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, prefix: int = 16) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs``."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), normalised(text_col).alias("norm"))
    keyed = rows.select("id", "norm", F.substring("norm", 1, prefix).alias("first"), F.xxhash64("norm").alias("hash"))
    ordered = keyed.repartitionByRange(n, "first", "hash", "id").sortWithinPartitions("first", "hash", "norm", F.asc_nulls_last("id"))
    runs = stored(ordered.mapInArrow(_runs, _RUNS), "runs")
    # pieces of one text at the edges of partitions become one group; a row is in one run, so rows
    # give the size. There are at most two such texts a partition, which bounds the broadcast
    whole = runs.where("edge").groupBy("text_sha256").agg(F.min("keep_id").alias("_keep"), F.count("*").alias("_size"))
    out = runs.join(F.broadcast(whole), "text_sha256", "left").select(
        "doc_id", F.coalesce("_keep", "keep_id").alias("keep_id"), F.coalesce("_size", "group_size").alias("group_size"), "text_sha256"
    )
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
