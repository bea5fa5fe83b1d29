"""Saved queries: one read-only SELECT with named text parameters, validated by Spark's own analysis."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import HashingEmbedder, cosine
from . import catalog, store


class AliasError(ValueError):
    pass


@dataclass
class Alias:
    name: str
    description: str
    sql: str
    params: list[tuple[str, str, str]] = field(default_factory=list)

    def bound(self) -> str:
        return re.sub(r"\$\{(\w+)\}", r":\1", self.sql)


class Aliases:
    """Saved queries in a folder that sessions share; texts and descriptions are embedded when a query is saved."""

    def __init__(self, spark: SparkSession, embedder: HashingEmbedder | None = None, path: str | None = None):
        self.spark, self.embedder = spark, embedder or HashingEmbedder()
        self._kept = store.Records(spark, path or store.new_folder(spark, "aliases"), self._row(Alias("", "", "")).schema)

    def _row(self, a: Alias) -> DataFrame:
        row = [(a.name, a.params, "alias", "alias", None, None, a.name, a.sql, a.description)]
        return catalog.embed_catalog(self.spark.createDataFrame(row, f"name string, params array<struct<name:string,type:string,text:string>>, {catalog.COLUMNS}"), self.embedder)

    def get(self, name: str) -> Alias:
        found = self._kept.rows(name).select("name", "comment", "definition", "params").first()
        if found is None:
            raise AliasError(f"no alias {name}")
        return Alias(found["name"], found["comment"], found["definition"], [tuple(p) for p in found["params"]])

    def save(self, name: str, description: str, sql: str, params: list[tuple[str, str, str]] | None = None, replace: bool = False) -> Alias:
        if not replace and self._kept.rows(name).head(1):
            raise AliasError(f"alias {name} exists")
        alias = Alias(name, description, sql, params or [])
        try:  # as a subquery, only one SELECT is left that analyses
            self.spark.sql(f"SELECT * FROM ({alias.bound()}) t", args={p[0]: "1" for p in alias.params}).schema
        except (ParseException, AnalysisException) as e:
            raise AliasError(f"alias {name}: {str(e).splitlines()[0]}") from e
        self._kept.put(self._row(alias))
        return alias

    def run(self, name: str, args: dict[str, str]) -> DataFrame:
        """Every argument is text and is bound, not pasted."""
        return self.spark.sql(self.get(name).bound(), args={k: str(v) for k, v in args.items()})

    def as_function(self, name: str) -> None:
        """Make a saved query a table function of the session, ``SELECT * FROM name('value')``; LATERAL gives it the values of a row."""
        alias = self.get(name)
        columns = self.spark.sql(alias.bound(), args={p[0]: "1" for p in alias.params}).schema
        returns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
        body = re.sub(r"\$\{(\w+)\}", rf"{name}.\1", alias.sql)
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(f'{p[0]} STRING' for p in alias.params)}) RETURNS TABLE ({returns}) RETURN {body}")

    def update(self, name: str, **changes) -> Alias:
        old = self.get(name)
        return self.save(name, changes.get("description", old.description), changes.get("sql", old.sql), changes.get("params", old.params), replace=True)

    def drop(self, name: str) -> None:
        self._kept.drop(name)

    def list(self, prefix: str = "") -> DataFrame:
        excerpt = F.left(F.btrim(F.regexp_replace("definition", r"\s+", " ")), F.lit(80))
        return self._kept.rows().where(F.col("name").startswith(prefix)).select("name", F.size("params").alias("n_params"), F.col("comment").alias("description"), excerpt.alias("excerpt"))

    def embedded(self) -> DataFrame:
        """The saved queries as catalogue rows with vectors of their texts and descriptions, so that search finds them by meaning."""
        return self._kept.rows().drop("name", "params")

    def find(self, question: str, top_k: int = 5, min_similarity: float = 0.0) -> DataFrame:
        """Saved queries by meaning."""
        return catalog.search(self.embedded(), question, self.embedder, top_k, ["alias"], min_similarity).select("object_ref", "definition", "comment", "rrf_score")

    def near_duplicates(self, description: str, at_least: float = 0.8) -> DataFrame:
        """Saved queries whose description says about the same: to be looked at before another one is saved."""
        similarity = F.round(cosine("comment_vec", self.embedder.encode_query(description)), 6)
        return self.embedded().select("object_ref", "comment", similarity.alias("similarity")).where(F.col("similarity") >= at_least).orderBy(F.desc("similarity"), "object_ref")


def history_rows(statements: DataFrame) -> DataFrame:
    """Statements that succeeded (statement, status), once each with how often, as catalogue rows of the source `history`."""
    once = statements.where("status = 'done' AND statement IS NOT NULL").groupBy(F.btrim(F.regexp_replace("statement", r"\s+", " ")).alias("s")).agg(F.count("*").alias("n"))
    return once.select(F.lit("history").alias("source_type"), F.lit("query").alias("entity_type"), F.lit(None).cast("string").alias("relation_name"), F.lit(None).cast("string").alias("column_name"), F.concat(F.lit("history."), F.left(F.sha2("s", 256), F.lit(16))).alias("object_ref"), F.col("s").alias("definition"), F.concat(F.lit("run "), F.col("n").cast("string"), F.lit(" times")).alias("comment"))
