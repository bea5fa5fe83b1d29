"""Scores of test verdicts: column choice in statements, verdict values, means, arm differences."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_choice(statements: DataFrame, rules: DataFrame, most_rules: int = 1000) -> DataFrame:
    """Statements (conversation_id, statement), rules (test, word, required): over all statements of a conversation, every required word occurs and no forbidden one, as whole words. One aggregate over the statements; rules are a written list, whose number is checked."""
    held = rules.select("test", "word", "required").distinct().limit(most_rules + 1).collect()
    if len(held) > most_rules:
        raise ValueError(f"more than {most_rules} rules; they become columns of one aggregate")
    tests = sorted({r.test for r in held})
    said = lambda word: F.bool_or(F.lower("statement").rlike(rf"\b{re.escape(word.lower())}\b"))
    right = {t: [said(r.word) == F.lit(r.required) for r in held if r.test == t] for t in tests}
    one = statements.groupBy("conversation_id").agg(*[reduce(lambda a, b: a & b, right[t]).alias(f"t{i}") for i, t in enumerate(tests)])
    pairs = F.array(*[F.struct(F.lit(t).alias("test"), F.col(f"t{i}").alias("passed")) for i, t in enumerate(tests)]) if tests else F.array().cast("array<struct<test:string,passed:boolean>>")
    return one.select("conversation_id", F.explode(pairs).alias("r")).select("conversation_id", "r.test", "r.passed")


def verdict_score(verdicts: DataFrame) -> DataFrame:
    """Yes 1, Maybe 0.5, No 0; a failed validation or an error forces No."""
    forced = ~F.coalesce("valid", F.lit(True)) | F.coalesce("error", F.lit(False))
    return verdicts.withColumn("score", F.when(forced, 0.0).when(F.col("verdict") == "Yes", 1.0).when(F.col("verdict") == "Maybe", 0.5).otherwise(0.0))


def aggregate_score(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    mean = scored.groupBy("arm").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))
    return mean.join(thresholds, "arm").withColumn("passed", F.col("mean_score") >= F.col("threshold"))


def arm_delta(scored: DataFrame, treatment: str, control: str, by: list[str] | None = None) -> DataFrame:
    mean = lambda arm: F.avg(F.when(F.col("arm") == arm, F.col("score")))
    out = scored.groupBy(*(by or [])).agg(mean(treatment).alias("t"), mean(control).alias("c"))
    return out.select(*(by or []), F.round(F.col("t") - F.col("c"), 6).alias("delta"))


def arms_comparable(tests: DataFrame) -> DataFrame:
    """Tests (arm, test, definition) that some arm lacks or defines differently; none: the arms are comparable."""
    arms = tests.agg(F.count_distinct("arm").alias("arms"))
    each = tests.groupBy("test").agg(F.count_distinct("arm").alias("has"), F.count_distinct(F.sha2("definition", 256)).alias("definitions"))
    return each.crossJoin(arms).where("has < arms OR definitions > 1").select("test", "has", "definitions")
