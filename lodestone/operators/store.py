"""Named records in a folder that sessions share: every change adds a row, and the newest row of a name counts."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def new_folder(spark: SparkSession, kind: str) -> str:
    """A new folder that all executors share; a local one under a local master without a checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


class Records:
    """Rows (name, ...) of one schema under ``path``.

    A change is a folder of its own and overwrites none, so sessions that write at once lose nothing of each other's;
    of two changes of one name the later by the writers' clocks counts.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.fields = spark, path, [f.name for f in schema if f.name != "name"]
        marks = [T.StructField("_at", T.LongType()), T.StructField("_by", T.StringType()), T.StructField("_dropped", T.BooleanType())]
        self.schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema] + marks)
        spark.createDataFrame([], self.schema).write.mode("ignore").parquet(f"{path}/none")

    def put(self, rows: DataFrame, dropped: bool = False) -> None:
        """Add or replace the names of ``rows``."""
        by = uuid.uuid4().hex
        marked = rows.withColumns({"_at": F.lit(time.time_ns()), "_by": F.lit(by), "_dropped": F.lit(dropped)})
        marked.select(*[f"`{c}`" for c in self.schema.names]).coalesce(1).write.parquet(f"{self.path}/{by}")

    def drop(self, name: str) -> None:
        found = self.rows(name)
        if not found.head(1):
            raise KeyError(name)
        self.put(found, dropped=True)

    def rows(self, name: str | None = None) -> DataFrame:
        """What counts now, of all names or of one."""
        every = self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.path)
        some = every if name is None else every.where(F.col("name") == name)
        newest = some.groupBy("name").agg(F.max_by(F.struct("_dropped", *[f"`{c}`" for c in self.fields]), F.struct("_at", "_by")).alias("_r"))
        return newest.where("NOT _r._dropped").select("name", *[F.col("_r").getField(c).alias(c) for c in self.fields])
