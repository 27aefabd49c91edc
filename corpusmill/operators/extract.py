"""Structured samples out of generated text, with the first failed check of each bad row.

Candidates are the pieces that end in a closing brace.  They are tried in order;
the first that passes all checks of its task wins, else the row's error is that
of its last candidate.  Values must have the right JSON type; a string in place
of a list is an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

NO_JSON = "No JSON found."
BAD_JSON = "Invalid JSON."
SCHEMA = "question string, statement string, options array<string>, answer string, instruction string, ingredients array<string>, steps array<string>, summary string, long_but_clean_text string"


def candidates(c: Column) -> Column:
    return F.transform(F.filter(F.split(c, "[}]"), lambda x: x != ""), lambda x: F.concat(x, F.lit("}")))


def _tried(c: Column) -> Column:
    """What the checks need of a candidate: its fields, and its JSON value for their types (null if it is none)."""
    return F.struct(F.from_json(c, SCHEMA, {"allowSingleQuotes": "false"}).alias("p"), F.try_parse_json(c).alias("v"), c.alias("raw"))


def _is(t: Column, key: str, kind: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(F.try_variant_get(t["v"], f"$.{key}", "variant")), F.lit(kind)), F.lit(False))


def _first_failure(*checks: tuple[Column, str]) -> Column:
    out = F.lit(None).cast("string")
    for ok, error in reversed(checks):
        out = F.when(~F.coalesce(ok, F.lit(False)), F.lit(error)).otherwise(out)
    return out


def _lists(t: Column, key: str) -> Column:
    return F.transform(F.filter(t["p"][key], lambda x: x.isNotNull() & (x != "")), strip)


def _answer(t: Column) -> Column:
    a = F.when(_is(t, "answer", "ARRAY"), F.get_json_object(t["raw"], "$.answer[0]")).otherwise(t["p"]["answer"])
    return F.substring(strip(a), 1, 1)


def _qa(t: Column, options: int, letters: str, statement: bool) -> tuple[Column, Column]:
    question = strip(F.coalesce(t["p"]["question"], t["p"]["statement"]) if statement else t["p"]["question"])
    asked = _is(t, "question", "STRING") | _is(t, "statement", "STRING") if statement else _is(t, "question", "STRING")
    listed, answer = _lists(t, "options"), _answer(t)
    error = _first_failure(
        (t["v"].isNotNull(), BAD_JSON),
        (asked & (F.length(question) > 15), "QuestionLengthError"),
        (_is(t, "options", "ARRAY") & (F.size(listed) == options), "OptionsNumberError"),
        ((F.length(answer) > 0) & F.lit(letters).contains(answer), "AnswerFormatError"),
    )
    return F.struct(question.alias("question"), listed.alias("options"), answer.alias("answer")), error


def qa_mc(t: Column) -> tuple[Column, Column]:
    return _qa(t, 4, "ABCD", False)


def qa_yn(t: Column) -> tuple[Column, Column]:
    return _qa(t, 2, "AB", True)


def recipe(t: Column) -> tuple[Column, Column]:
    instruction, ingredients, steps = strip(t["p"]["instruction"]), _lists(t, "ingredients"), _lists(t, "steps")
    error = _first_failure(
        (t["v"].isNotNull(), BAD_JSON),
        (_is(t, "instruction", "STRING") & (F.length(instruction) > 15), "InstructionLengthError"),
        (_is(t, "ingredients", "ARRAY") & (F.size(ingredients) >= 1), "IngredientsNumberError"),
        (_is(t, "steps", "ARRAY") & (F.size(steps) >= 1), "StepsNumberError"),
    )
    return F.struct(instruction.alias("instruction"), ingredients.alias("ingredients"), steps.alias("steps")), error


def summary(t: Column) -> tuple[Column, Column]:
    fields = {k: strip(t["p"][k]) for k in ("instruction", "summary", "long_but_clean_text")}
    least = {"instruction": (15, "InstructionLengthError"), "summary": (100, "SummaryLengthError"), "long_but_clean_text": (500, "TextLengthError")}
    error = _first_failure((t["v"].isNotNull(), BAD_JSON), *((_is(t, k, "STRING") & (F.length(v) > least[k][0]), least[k][1]) for k, v in fields.items()))
    return F.struct(*[v.alias(k) for k, v in fields.items()]), error


TASKS: dict[str, Callable[[Column], tuple[Column, Column]]] = {"bioqa": qa_mc, "medqa": qa_mc, "csqa": qa_yn, "recipegen": recipe, "summarization": summary}


def extract(samples: DataFrame, task: str, column: str = "task_sample") -> DataFrame:
    """The samples with ``sample`` (struct or null) and ``exception`` (null if there is a sample)."""

    def checked(t: Column) -> Column:
        value, error = TASKS[task](t)
        return F.struct(value.alias("value"), error.alias("error"))

    tries = F.transform(F.transform(candidates(F.col(column)), _tried), checked)
    out = samples.withColumn("_tries", F.when(F.contains(F.col(column), F.lit("}")), tries))
    good = F.get(F.filter("_tries", lambda t: t["error"].isNull()), 0)["value"]
    last = F.element_at(F.col("_tries"), -1)["error"]
    return out.withColumn("sample", good).withColumn("exception", F.when(F.col("sample").isNull(), F.coalesce(last, F.lit(NO_JSON)))).drop("_tries")
