"""Official data sets in the form that prompts and evaluation expect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def medical(df: DataFrame) -> DataFrame:
    """Four option columns as ``choices``, the number of the right one as ``answer``; null options stay in place."""
    return df.withColumn("choices", F.array("opa", "opb", "opc", "opd")).withColumnRenamed("cop", "answer").drop("opa", "opb", "opc", "opd")


def yes_no(df: DataFrame) -> DataFrame:
    """``answer`` as text in ``answer_str``; its number among ``choices``: 0 for yes, 1 for anything else."""
    out = df.withColumnRenamed("answer", "answer_str")
    return out.withColumn("answer", F.when(F.col("answer_str") == "yes", 0).otherwise(1)).withColumn("choices", F.array(F.lit("yes"), F.lit("no")))


def recipes(df: DataFrame) -> DataFrame:
    """``response``: ingredients and steps as one text."""
    return df.withColumn("response", F.concat(F.lit("Ingredients:\n"), F.col("ingredients"), F.lit("\nSteps:\n"), F.col("steps")))


def summaries(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("highlights", "response")
