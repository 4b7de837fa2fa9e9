"""Turning a language model's answer into records: strict JSON, known types, clamped numbers. The model is a callable of the user's."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..plans.schema import TYPES

ANSWER = "struct<thoughts:array<struct<thought_type:string,content:string,importance:double,confidence:double,tags:array<string>,concepts:array<string>>>>"


def validate(answers: DataFrame, column: str = "answer") -> DataFrame:
    """One row for each usable thought of each answer; answers that are no JSON, unknown types and blank contents give none."""
    rows = answers.withColumn("t", F.explode(F.from_json(F.col(column), ANSWER, {"mode": "PERMISSIVE"})["thoughts"])).drop(column)
    clamp = lambda c: F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))
    rows = rows.where(F.col("t.thought_type").isin(*TYPES) & (F.trim("t.content") != ""))
    empty = F.array().cast("array<string>")
    others = [c for c in rows.columns if c != "t"]
    return rows.select(*others, "t.thought_type", F.trim("t.content").alias("content"), F.coalesce(clamp(F.col("t.importance")), F.lit(0.5)).alias("importance"), clamp(F.col("t.confidence")).alias("confidence"), F.coalesce("t.tags", empty).alias("tags"), F.coalesce("t.concepts", empty).alias("concepts"))


def extract(texts: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """validate() of what model answers to each text."""
    @F.pandas_udf(StringType())
    def ask(s: pd.Series) -> pd.Series:
        return s.map(model)

    return validate(texts.withColumn("answer", ask("text")).drop("text"))
