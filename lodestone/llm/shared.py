"""What several operators share: the cluster's shared folder, checkpoints, distributed ranks and components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset a local master, as in tests, gets one; a cluster gets an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local") and not spark.sparkContext.getCheckpointDir():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = spark.sparkContext.getCheckpointDir() or "file://" + tempfile.mkdtemp(prefix="spark-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path if "://" in path or path.startswith("file:") else "file://" + path


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: compressed, columnar, and free of lineage."""
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(id_col: str, divisor: int):
    """crc32(id as text) mod divisor; a null id has the remainder 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % divisor, F.lit(0))


def power_of_two(n: float) -> int:
    return max(0, (max(1, int(n)) - 1).bit_length())


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def distributed_rank(df: DataFrame, keys: list[str], bucket: str, order: list, out: str) -> DataFrame:
    """Adds ``out``: the rank from 0 within ``keys`` by (bucket, *order), without a key's rows meeting in one task.

    ``bucket`` names a column that spreads a key over many values. Rows are
    counted by (keys, bucket); the counts' prefix sums and row_number within a
    bucket, which share one partitioning, give the rank. Null keys are a key.
    """
    cells = df.groupBy(*keys, bucket).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*[F.col(k).alias(f"_k_{k}") for k in [*keys, bucket]], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = df.withColumn("_row", F.row_number().over(Window.partitionBy(*keys, bucket).orderBy(*order)))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in [*keys, bucket]]
    joined = inner.join(cells, same)
    return joined.withColumn(out, F.col("_before") + F.col("_row") - 1).drop("_before", "_row", *[f"_k_{k}" for k in [*keys, bucket]])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, of the nodes that edges (a, b) name.

    Alternating large-star and small-star steps; minima are aggregated map-side,
    and a hub is only ever a join key, which adaptive execution splits. Each
    round's edges are stored in the shared folder. Null ends are ignored.
    """
    e = stored(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = None
    for _ in range(rounds):
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        e = stored(small.where("a <> b").distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b").cast("decimal(38,0)"))).first()
        if now == last:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
        last = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def open_files(uri: str):
    """A pyarrow filesystem and path for a folder's URI."""
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(uri)


def save_array(uri: str, name: str, array) -> None:
    """Write an array as .npy: under a temporary name first, so that a repeated task replaces whole files only."""
    import io

    import numpy as np

    files, path = open_files(uri)
    files.create_dir(path, recursive=True)
    head = io.BytesIO()
    np.lib.format.write_array_header_1_0(head, np.lib.format.header_data_from_array_1_0(array))
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with files.open_output_stream(part) as out:
        out.write(head.getvalue())
        out.write(np.ascontiguousarray(array).data if array.size else b"")
    files.move(part, f"{path}/{name}.npy")


def map_array(uri: str, name: str):
    """Memory-map a saved array; from a store that cannot be mapped it is read."""
    import io

    import numpy as np
    import pyarrow.fs as fs

    files, path = open_files(uri)
    if isinstance(files, fs.LocalFileSystem):
        return np.load(f"{path}/{name}.npy", mmap_mode="r")
    with files.open_input_stream(f"{path}/{name}.npy") as src:
        return np.load(io.BytesIO(src.read()))
