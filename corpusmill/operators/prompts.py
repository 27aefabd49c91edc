"""Prompt assembly, fine-tuning texts and evaluation prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LETTERS, instruct, lettered, strip
from .sampling import coin

#: What the model is told it is, by task.
SYSTEM = {
    "bioqa": "You are an expert biologist. Select the correct answer from the questions below. Answer only with the corresponding letter label.",
    "medqa": "You are a medical expert. Select the correct answer from the questions below. Answer only with the corresponding letter label.",
    "csqa": "You are an expert in common-sense reasoning. Select the correct answer from the questions below. Answer only with the corresponding letter label.",
    "recipegen": "You are an expert chef. Directly answer what is asked without additional opening and closing remarks.",
    "summarization": "You are an expert summarizer. Directly answer what is asked without additional opening and closing remarks.",
}
# What a generator is asked for, by task, and the JSON form of its answer.
_QUESTION = 'Please carefully read the text below. Then, generate exactly one question along with four answer choices designated as A, B, C, and D based on the provided text. Then, respond to the question with the correct answer using only the corresponding letter label. Return the output only as a JSON structure in this format: {"question": "<question here>", "options": ["A. <option A here>", "B. <option B here>", "C. <option C here>", "D. <option D here>"], "answer": "<letter label of correct answer here>"}'
INSTRUCTIONS: dict[str, str | tuple[str, str]] = {
    "bioqa": _QUESTION,
    "medqa": _QUESTION,
    "csqa": (
        'Please carefully read the text below. Then, generate exactly one question that is answerable with yes or no based on the provided text. Then, respond to the question with the correct answer using only the corresponding letter label. Return the output only as a JSON structure in this format: {"question": "<question here>", "options": ["A. Yes", "B. No"], "answer": "<letter label of correct answer here>"}',
        'Please carefully read the text below. Then, generate exactly one statement that is answerable with yes or no based on the provided text. Then, respond to the statement with the correct answer using only the corresponding letter label. Return the output only as a JSON structure in this format: {"statement": "<statement here>", "options": ["A. Yes", "B. No"], "answer": "<letter label of correct answer here>"}',
    ),
    "recipegen": 'Please carefully read the text below. Then, generate exactly one short one-sentence instruction to prepare the dish named in the text. Then, generate a detailed recipe for the dish by listing the required ingredients and steps. Return the output only as a JSON structure in this format: {"instruction": "<short one-sentence cooking instruction here>", "ingredients": ["<ingredient one here>", "<ingredient two here>", "< ... >", "<continue until end>"], "steps": ["<step one here>", "<step two here>", "< ... >", "<continue until end>"]}',
    "summarization": 'Please carefully read the text below. Then, generate exactly one instruction for summarizing the text below. Then, generate the summary. Afterwards, extract a long but clean version of the initial text that encompasses the summary, but keeps almost all details from the initial text. Return the output only as a JSON structure in this format: {"instruction": "<summary instruction here>", "summary": "<summary here>", "long_but_clean_text": "<long but clean text that encompasses the summary but keeps almost all details from the initial text here>"} ',
}
#: The request for summaries and the end of a shot.
SUMMARIZE = "Please summarize the text below:\n"
EOS = "</s>"
RULE = " \n\n___________\nText: "


def chat(instruction: Column, system: str) -> Column:
    """A system and a user turn with role headers."""
    turn = lambda role, *body: [F.lit(f"<|start_header_id|>{role}<|end_header_id|>\n\n"), *body]
    return F.concat(*turn("system", F.lit(f"{system}<|eot_id|>")), *turn("user", instruction, F.lit("<|eot_id|>")), *turn("assistant"))


def shot_qa(instruction: Column, output: Column) -> Column:
    lines = F.split(instruction, "\n")
    options = F.transform(F.filter(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1))), lambda x: x != ""), strip)
    return F.struct(strip(lines[0]).alias("question"), options.alias("options"), strip(F.substring(output, 1, 1)).alias("answer"))


def shot_recipe(instruction: Column, output: Column) -> Column:
    parts = F.split(output, "Steps:")
    items = lambda c: F.transform(F.filter(c, lambda x: x != ""), strip)
    first = F.split(parts[0], "\n")
    return F.struct(strip(instruction).alias("instruction"), items(F.slice(first, 2, F.greatest(F.size(first) - 1, F.lit(1)))).alias("ingredients"), items(F.split(F.get(parts, 1), "\n")).alias("steps"))


def shot_summary(instruction: Column, output: Column) -> Column:
    lines = F.transform(F.filter(F.split(instruction, "\n"), lambda x: x != ""), strip)
    return F.struct(F.get(lines, 0).alias("instruction"), strip(output).alias("summary"), F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1))), "\n").alias("long_but_clean_text"))


MOST_SHOTS = 1024
MOST_SHOT_CHARS = 4 << 20


def _shot_rows(shots: DataFrame) -> list:
    rows = shots.limit(MOST_SHOTS + 1).collect()
    if len(rows) > MOST_SHOTS:
        raise ValueError(f"more than {MOST_SHOTS} shots")
    if sum(len(x) for r in rows for x in r if isinstance(x, str)) > MOST_SHOT_CHARS:
        raise ValueError(f"shots of more than {MOST_SHOT_CHARS} characters")
    return rows


def _turns(doc: str, ids: list, n: int, seed: str) -> Column:
    """The first ``n`` shot ids of a document in order of the md5 of seed, document and shot; settled inside the row."""
    first = ([F.lit(seed)] if seed else []) + [F.col(doc).cast("string")]
    each = F.transform(F.array(*[F.lit(i) for i in ids]), lambda i: F.struct(F.md5(F.concat_ws(":", *first, i.cast("string"))).alias("k"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(each), 1, n), lambda x: x["i"])


def choose_shots(documents: DataFrame, shots: DataFrame, doc: str, shot: str, n: int = 3, seed: str = "") -> DataFrame:
    """``n`` of the shots (a checked handful) for each document, with their turn; no shuffle, and no text is repeated but for the n."""
    ids = [r[shot] for r in _shot_rows(shots.select(shot))]
    chosen = documents.select("*", F.posexplode(_turns(doc, ids, n, seed)).alias("turn", "_shot")) if ids else documents.select("*", F.lit(0).alias("turn"), F.lit(None).cast(shots.schema[shot].dataType).alias("_shot")).limit(0)
    return chosen.withColumn("turn", F.col("turn") + 1).join(F.broadcast(shots), F.col("_shot") == F.col(shot)).drop("_shot")


def few_shot_prompts(documents: DataFrame, shots: DataFrame, doc: str, text: str, shot: str, shot_text: str, shot_json: str, instruction: str | Column, n: int = 3, seed: str = "") -> DataFrame:
    """doc and prompt: a document's ``n`` shots in turn, each answered, then its own text; built inside the row."""
    ask = F.lit(instruction) if isinstance(instruction, str) else instruction
    asked = lambda c: F.concat(F.lit("[INST] "), ask, F.lit(RULE), strip(c), F.lit(" [/INST] "))
    rows = _shot_rows(shots.select(shot, strip(F.col(shot_text)).alias("t"), F.col(shot_json).alias("j")))
    texts, answers = (F.create_map(*[x for r in rows for x in (F.lit(r[shot]), F.lit(r[k]))]) if rows else F.create_map() for k in ("t", "j"))
    said = F.transform(_turns(doc, [r[shot] for r in rows], n, seed), lambda i: F.concat(asked(texts[i]), answers[i], F.lit(f"{EOS} "))) if rows else F.array().cast("array<string>")
    return documents.select(doc, F.concat(F.array_join(said, ""), asked(F.col(text))).alias("prompt"))


def choose_instruction(task: str, key: Column, seed: str = "1234") -> Column:
    """The task's instruction; of a task that has two, one by the coin of the key."""
    own = INSTRUCTIONS[task]
    return F.lit(own) if isinstance(own, str) else F.when(coin(key, seed), own[0]).otherwise(own[1])


def finetune_qa(question: Column, options: Column, answer: Column) -> Column:
    return F.concat(instruct(F.concat(question, F.lit("\n"), F.array_join(options, "\n"))), answer)


def finetune_recipe(instruction: Column, ingredients: Column, steps: Column) -> Column:
    return F.concat(instruct(instruction), F.lit("Ingredients:\n"), F.array_join(ingredients, "\n"), F.lit("\nSteps:\n"), F.array_join(steps, "\n"))


def finetune_summary(instruction: Column, text: Column, summary: Column) -> Column:
    return F.concat(instruct(F.concat(instruction, F.lit("\n"), text)), summary)


def eval_mc(question: Column, choices: Column) -> Column:
    return F.concat(question, F.lit("\n"), lettered(choices))


def finetune_mc(question: Column, choices: Column, answer: Column) -> Column:
    return F.concat(instruct(eval_mc(question, choices)), F.element_at(F.array(*[F.lit(x) for x in LETTERS]), answer + 1))


def finetune_recipe_official(instruction: Column, response: Column) -> Column:
    return F.concat(instruct(instruction), response)


def finetune_summary_official(article: Column, highlights: Column) -> Column:
    return F.concat(instruct(eval_summary(article)), highlights)


def eval_yes_no(question: Column) -> Column:
    return F.concat(question, F.lit("\nA. yes\nB. no"))


def finetune_yes_no(question: Column, answer: Column) -> Column:
    return F.concat(instruct(eval_yes_no(question)), F.when(answer == "yes", "A").when(answer == "no", "B"))


def eval_summary(article: Column) -> Column:
    return F.concat(F.lit(SUMMARIZE), article)


def eval_recipe(instruction: Column) -> Column:
    return instruction


def judge_prompt(instruction: Column, first: Column, second: Column) -> Column:
    """Asks a judge which of two outputs answers an instruction better; ``evaluate.preference`` reads the answer."""
    ask = "Which of the two outputs answers the instruction better? Reply with 1 or 2 only."
    return F.concat(F.lit(f"{ask}\n\nInstruction:\n"), instruction, F.lit("\n\nOutput 1:\n"), first, F.lit("\n\nOutput 2:\n"), second, F.lit("\n\nBetter output: "))


def with_eos(text: Column, model: str, eos: str = "<|end_of_text|>") -> Column:
    return F.concat(text, F.lit(eos)) if "Llama" in model else text


def default_token_count(text: Column) -> Column:
    """A stand-in for a tokenizer: words and punctuation marks."""
    return F.regexp_count(text, F.lit(r"\w+|[^\w\s]"))


def fits(df: DataFrame, prompt: str, most: int, token_count=default_token_count) -> DataFrame:
    return df.filter(token_count(F.col(prompt)) <= most)
