"""Vectors kept current by Structured Streaming: new rows are embedded and upserted by key."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..functions.clean import excerpt
from ..functions.vectors import HashingEmbedder, embed_batch
from ..operators.trace import seconds_between, steps


def upsert_versions(spark: SparkSession, new: DataFrame, path: str, key: str, version: int) -> None:
    """Write the rows of a version; readers take the newest version of a key, so replaying a batch changes nothing."""
    new.withColumn("version", F.lit(version).cast("long")).write.mode("overwrite").parquet(f"{path}/version={version:010d}")


def current(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The newest row of each key."""
    rows = spark.read.option("recursiveFileLookup", "true").parquet(path)
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), "version").alias("r"))
    return newest.select("r.*").drop("version")


def compact(spark: SparkSession, path: str, key: str, target: str) -> None:
    """Write the newest rows as version 0 of another folder, so that reads cost what the table holds and not its history."""
    upsert_versions(spark, current(spark, path, key), target, key, 0)


def newest_of_batch(batch: DataFrame, key: str, at: str | None) -> DataFrame:
    """One row of each key: that of the latest source time, else the largest row, so that replays agree."""
    order = F.struct(*([at] if at else []), *[c for c in batch.columns if c != at])
    return batch.groupBy(key).agg(F.max(order).alias("_r")).select("_r.*").select(*batch.columns)


def stream_log(source: DataFrame, target: str, checkpoint: str, live: bool = False) -> StreamingQuery:
    """Append an action log, as it grows, as flat rows: the action, its tool, milliseconds and one line of text."""
    request = lambda p: F.get_json_object("request_payload", p)
    text = F.coalesce(F.get_json_object("response_payload", "$.text"), request("$.prompt"), F.col("response_payload"), F.col("request_payload"))
    rows = source.select("id", "conversation_id", "action_type", request("$.tool_name").alias("tool"), F.round(seconds_between("created_at", "completed_at") * 1000, 3).alias("ms"), "status", excerpt(text, 120).alias("text"))
    writer = rows.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint)
    return (writer if live else writer.trigger(availableNow=True)).start()


TRACE = "conversation_id string, id string, step long, round long, task_id string, action_type string, tool string, ms double, status string, text string"


class Numbering(StatefulProcessor):
    """Steps and rounds of a conversation, continued from batch to batch. The state has the last numbers, each sequence's round and the ids that were seen."""

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "step long, round long")
        self.rounds = handle.getMapState("rounds", "sequence string", "round long")
        self.seen = handle.getMapState("seen", "id string", "there boolean")

    def handleInputRows(self, key, rows, timerValues):
        df = pd.concat(list(rows)).drop_duplicates("id")
        df = df[[not self.seen.containsKey((i,)) for i in df["id"]]].sort_values(["created_at", "order", "id"])
        if not len(df):
            return
        step, number = self.last.get() if self.last.exists() else (0, 0)
        first = df.groupby("sequence_id", sort=False)["created_at"].min()
        for _, sequence in sorted((at, s) for s, at in first.items()):
            if not self.rounds.containsKey((sequence,)):
                number += 1
                self.rounds.updateValue((sequence,), (number,))
        for i in df["id"]:
            self.seen.updateValue((i,), (True,))
        self.last.update((step + len(df), number))
        own = {s: self.rounds.getValue((s,))[0] for s in first.index}
        yield df.assign(step=range(step + 1, step + len(df) + 1), round=df["sequence_id"].map(own))[[c.split()[0] for c in TRACE.split(", ")]]

    def close(self) -> None:
        pass


def stream_trace(source: DataFrame, target: str, checkpoint: str, live: bool = False) -> StreamingQuery:
    """Append an action log, as it grows, as the rows of ``full_trace`` with their ids, in the order of arrival, times and ids within a batch.

    Rows that come again are known by their id. A row that comes after later ones gets the next number: what was written stays.
    The state grows with the log's ids; it needs the RocksDB store, which is set here.
    """
    spark = source.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    shown = steps(source)
    number = F.col("id").cast("long") if dict(source.dtypes)["id"] in ("bigint", "int") else F.lit(0).cast("long")
    rows = shown.select(F.coalesce(F.col("conversation_id").cast("string"), F.lit("")).alias("conversation_id"), F.coalesce(F.col("sequence_id").cast("string"), F.lit("")).alias("sequence_id"), "created_at", number.alias("order"), F.col("id").cast("string").alias("id"), F.col("task_id").cast("string").alias("task_id"), "action_type", "tool", "ms", "status", "text")
    numbered = rows.groupBy("conversation_id").transformWithStateInPandas(statefulProcessor=Numbering(), outputStructType=TRACE, outputMode="Append", timeMode="None")
    writer = numbered.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint)
    return (writer if live else writer.trigger(availableNow=True)).start()


def maintain_embeddings(spark: SparkSession, source: DataFrame, target: str, checkpoint: str, text_col: str, key: str, embedder: HashingEmbedder | None = None, live: bool = False, at: str | None = None) -> StreamingQuery:
    """Background: handle what is there and stop (availableNow). Live: keep running. ``at``: the column of a row's source time."""

    def write(batch: DataFrame, number: int) -> None:
        newest = newest_of_batch(batch, key, at)
        upsert_versions(spark, embed_batch(newest, text_col, "vec", embedder), target, key, number)

    writer = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer if live else writer.trigger(availableNow=True)).start()
