"""Predictions from letter log-probabilities, accuracy and win rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LETTERS, strip
from .prompts import judge_prompt

MISSING = float("-inf")
MOST_METRICS = 1000


def predicted(text: Column, logprobs: Column, choices: Column) -> Column:
    """Index of the best of the first size(choices) letters, ties to the first; -1 without text or any letter; NaN is none."""
    lp = F.array(*[F.coalesce(F.nanvl(logprobs[x], F.lit(MISSING)), F.lit(MISSING)) for x in LETTERS])
    lp = F.slice(lp, 1, F.least(F.size(choices), F.lit(len(LETTERS))))
    best = F.array_max(lp)
    return F.when((F.coalesce(F.length(text), F.lit(0)) == 0) | best.isNull() | (best == MISSING), -1).otherwise((F.array_position(lp, best) - 1).cast("int"))


def said_letter(answer: Column, choices: Column) -> Column:
    """The letter that an answer starts with, if it is one of the first ``choices``; else N/A."""
    first = F.upper(F.substring(strip(answer), 1, 1))
    place = F.array_position(F.array(*[F.lit(x) for x in LETTERS]), first)
    return F.when((place > 0) & (place <= choices), first).otherwise("N/A")


def letter(prediction: Column) -> Column:
    return F.when(prediction == -1, "N/A").otherwise(F.element_at(F.array(*[F.lit(x) for x in LETTERS]), prediction + 1))


def accuracy(prediction: Column, label: Column) -> Column:
    """Right ones among all labels; a missing prediction is wrong."""
    return F.sum(F.coalesce((prediction == label).cast("double"), F.lit(0.0))) / F.count("*")


def metric_object(rows: DataFrame) -> DataFrame:
    """One row whose columns are the metrics of (metric, value), as many as a metrics file has."""
    entries = rows.select("metric", "value").orderBy("metric").limit(MOST_METRICS + 1).collect()
    if len(entries) > MOST_METRICS:
        raise ValueError(f"more than {MOST_METRICS} metrics")
    return rows.sparkSession.range(1).select(*[F.lit(r["value"]).cast("double").alias(r["metric"]) for r in entries])


def win_rate(swapped: Column, preference: Column) -> Column:
    won = F.when((swapped & (preference == 1)) | (~swapped & (preference == 2)), 1.0).otherwise(0.0)
    return F.avg(won)


def swap(df: DataFrame, mask: Column) -> DataFrame:
    a, b = F.col("output_1"), F.col("output_2")
    return df.withColumns({"output_1": F.when(mask, b).otherwise(a), "output_2": F.when(mask, a).otherwise(b), "swapped": mask})


def preference(output: Column) -> Column:
    """1 or 2 as the judge's text names it first, else null."""
    return F.nullif(F.regexp_extract(output, r"\b([12])\b", 1), F.lit("")).cast("int")


def by_row(prompts: DataFrame, predictions: DataFrame, references: DataFrame, key: str = "row_id") -> DataFrame:
    """key, instruction, prediction, reference of the rows that all three have: (key, prompt), (key, prediction), (key, reference)."""
    rows = prompts.select(key, F.col("prompt").alias("instruction")).join(predictions.select(key, "prediction"), key).join(references.select(key, "reference"), key)
    return rows.select(key, "instruction", "prediction", "reference")


def pairwise(references: DataFrame, predictions: DataFrame, mask: Column, key: str = "row_id") -> DataFrame:
    """The judge's table: (key, instruction, reference) and (key, prediction) side by side, swapped where the mask says so, with the prompt."""
    rows = references.select(key, "instruction", F.col("reference").alias("output_1")).join(predictions.select(key, F.col("prediction").alias("output_2")), key)
    return swap(rows, mask).withColumn("prompt", judge_prompt(F.col("instruction"), F.col("output_1"), F.col("output_2")))
