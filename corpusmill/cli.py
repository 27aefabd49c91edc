"""Command line: embed, index, retrieve, create-tasks, finetune, evaluate and winrate over files.

Options may stand in a file that is named with @: one option and its value a line.  Each command takes the option
names that existing option files have, and shorter ones of its own.  Options that only concern model weights, training,
sampling of tokens or compression are accepted by name and passed over (``PASSED_OVER``); any other is refused.

Models are functions from texts to texts that ``--generator module:function`` makes (it is called once a task), with
stand-ins where none is named.  ``--answers_path`` keeps answers by prompt, so that a rerun asks for what is missing.
"""

from __future__ import annotations

import argparse
import importlib
import shlex
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas, session
from .functions.text import instruct
from .operators import dedup, evaluate, extract, prompts, retrieve, sampling
from .plans import models, tokens
from .sources import files, streams
from .streaming import incremental

ROOTS = ("c4_path", "wikipedia_path", "stackexchange_path", "wikihow_path")


class Options(argparse.ArgumentParser):
    def convert_arg_line_to_args(self, line: str) -> list[str]:
        return shlex.split(line)


# Options of existing option files that have no meaning here, by command; those in FLAGS have no value.
FLAGS = ("use_amp_fp16", "merge_adapters", "do_sample", "use_bf16", "save_only_model", "group_by_length")
PASSED_OVER = {
    "embed": ("model_name", "compression", "compression_opts", "device", "use_amp_fp16"),
    "retrieve": ("model_name", "device", "use_amp_fp16", "sim_threshold"),
    "create-tasks": ("temperature", "top_p", "top_k", "max_new_tokens"),
    "finetune": ("cache_dir", "hf_token_path", "lora_r", "lora_alpha", "lora_dropout", "lora_bias", "batch_size", "use_bf16", "learning_rate", "grad_acc_steps", "num_epochs", "logging_strategy", "logging_steps", "save_strategy", "save_only_model", "optim", "warmup_ratio", "weight_decay", "num_workers", "save_total_limit", "lr_scheduler_type", "group_by_length", "random_seed"),
    "evaluate": ("cache_dir", "adapters_path", "merge_adapters", "hf_token_path", "temperature", "do_sample", "top_p", "top_k", "max_new_tokens", "logprobs", "max_model_len"),
    "winrate": (),
    "index": (),
}
OFFICIAL = "official"


def parser() -> argparse.ArgumentParser:
    top = Options(prog="corpusmill", fromfile_prefix_chars="@", allow_abbrev=False)
    sub = top.add_subparsers(dest="command", required=True, parser_class=lambda **k: Options(fromfile_prefix_chars="@", allow_abbrev=False, **k))

    def command(name: str, **options) -> None:
        p = sub.add_parser(name)
        for key, given in options.items():
            kind = dict(given)
            p.add_argument(f"--{key}", *[f"--{x}" for x in kind.pop("also", ())], dest=key, **kind)
        for key in PASSED_OVER[name]:
            p.add_argument(f"--{key}", **({"action": "store_true"} if key in FLAGS else {}))

    need, text, task = {"required": True}, {"default": None}, {"choices": sorted(extract.TASKS), "required": True}
    asking = {"generator": text, "answers_path": text}
    number = lambda default=None, **more: {"type": int, "default": default, **more}
    command("embed", data_path=need, group_name=need, saving_path=need, saving_file=text, batch_size=number(512))
    command("retrieve", few_shot_path=need, embeddings_path={**need, "also": ["database_path"]}, output_path={**need, "also": ["saving_path"]}, num_docs=number(200, also=["num_samples_to_retrieve"]), top_p={"type": float, "default": 0.05, "also": ["top_p_percentile"]}, index_path=text, **dict.fromkeys(ROOTS, need))
    command("create-tasks", model_name_or_path={"default": ""}, few_shot_path=need, corpus_samples_path=need, task=task, num_shots=number(3), deduplication_ratio=number(85), num_final_task_samples=number(required=True), output_path_raw=need, output_path_clean=need, output_path_error_msgs=need, output_path_final=need, max_tokenization_length=number(), tokenizer_path=text, **asking)
    command("finetune", train_dataset_path={**need, "also": ["task_samples_path"]}, official_path=text, few_shots_only={"action": "store_true"}, task=task, model_name_or_path={"default": ""}, max_rows=number(25_000), output_path={**need, "also": ["output_dir"]})
    command("evaluate", model_name_or_path={"default": ""}, task={**task, "required": False}, input_path=text, output_path_annotator=text, is_llama_3_chat_official={"action": "store_true"}, predictions_path=text, references_path=text, official_path=text, result_path=need, output_path=text, **asking)
    command("winrate", annotated_path=need, outputs_path=text, result_path=need, **asking)
    command("index", data_path=need, output_path=need, every=number(streams.EVERY))
    return top


def embed(spark: SparkSession, o: argparse.Namespace) -> None:
    """Embeds the files of a group that are not stored yet; a split is a file's name."""
    docs = files.jsonl(spark, o.data_path, schemas.DOCUMENT, numbered=True)
    docs = docs.select(F.lit(o.group_name).alias("group"), files.split_of(F.col("file")).alias("split"), "doc_idx", "text")
    store = f"{o.saving_path.rstrip('/')}/{o.saving_file}" if o.saving_file else o.saving_path
    root = spark._jvm.org.apache.hadoop.fs.Path(store)
    if root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        docs = incremental.pending(docs, files.vector_store(spark, store, [o.group_name]), ["group", "split"])
    files.write_vectors(models.embed(docs, ("group", "split", "doc_idx"), batch=o.batch_size), store)


def fetch_mixed(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    shots = files.jsonl(spark, o.few_shot_path, schemas.FEW_SHOT, numbered=True)
    queries = models.embed(shots.select(F.col("doc_idx").alias("fs_id"), F.col("Text").alias("text")), ("fs_id",))
    corpus = files.vector_store(spark, o.embeddings_path).withColumn("part", F.concat_ws("/", "group", "split"))
    hits = retrieve.retrieve(corpus, queries, "part", "doc_idx", o.top_p, o.num_docs)
    hits = hits.select(F.split("part", "/")[0].alias("group"), F.split("part", "/")[1].alias("split"), "doc_idx")
    root = F.lit(o.wikihow_path)
    for group, at in (("c4", o.c4_path), ("wikipedia", o.wikipedia_path), ("stackexchange", o.stackexchange_path)):
        root = F.when(F.col("group") == group, at).otherwise(root)
    hits = session.keep(hits.withColumn("path", F.concat(F.rtrim(root, F.lit("/")), F.lit("/"), files.split_file(F.col("group"), F.col("split")))))
    paths = [r[0] for r in hits.select("path").distinct().collect()]  # the files that hold hits
    if not paths:
        return spark.createDataFrame([], "file string, doc_idx long, raw string")
    of_name = lambda c: F.element_at(F.split(c, "/"), -1)
    here = streams.listed(spark, paths).select("path", of_name("path").alias("name"))
    at = F.broadcast(here).join(hits.select(of_name("path").alias("name"), "doc_idx").distinct(), "name").select(F.col("path").alias("file"), "doc_idx")
    index = spark.read.schema("file string, block long, offset long").parquet(o.index_path) if o.index_path else None
    return streams.lines_at(spark, at, index).select("file", "doc_idx", "raw")


def asked(rows: DataFrame, o: argparse.Namespace, stand_in: models.Generate) -> DataFrame:
    """``rows`` with the model's answer (task_sample) to their ``prompt``."""

    def load() -> models.Generate:
        if not o.generator:
            return stand_in
        module, _, function = o.generator.partition(":")
        return getattr(importlib.import_module(module), function)()

    store = o.answers_path or f"{session.shared_dir(rows.sparkSession)}/corpusmill/answers-{uuid.uuid4().hex}"
    return models.answers(rows, "prompt", store, load)


def index(spark: SparkSession, o: argparse.Namespace) -> None:
    """Where every few thousandth line of plain files starts, for ``retrieve --index_path``."""
    streams.line_index(spark, o.data_path, o.every).write.mode("overwrite").parquet(o.output_path)


def create_tasks(spark: SparkSession, o: argparse.Namespace) -> None:
    shots = files.jsonl(spark, o.few_shot_path, schemas.FEW_SHOT, numbered=True)
    shape = {"recipegen": prompts.shot_recipe, "summarization": prompts.shot_summary}.get(o.task, prompts.shot_qa)
    shots = session.keep(shots.withColumn("sample", shape(F.col("Instruction"), F.col("Output"))))
    docs = files.jsonl(spark, o.corpus_samples_path, schemas.DOCUMENT, numbered=True)
    wanted = prompts.few_shot_prompts(docs, shots.withColumn("json", F.to_json("sample")), "doc_idx", "text", "doc_idx", "Text", "json", prompts.choose_instruction(o.task, F.col("doc_idx")), o.num_shots)
    most = models.model_length(o.max_tokenization_length, o.model_name_or_path)
    fitting = tokens.counted(wanted, "prompt", o.tokenizer_path).filter(F.col("n_tokens") <= most).drop("n_tokens") if o.tokenizer_path else prompts.fits(wanted, "prompt", most)
    raw = session.keep(asked(fitting, o, models.templated_answer).drop("prompt"))
    files.write_jsonl(raw.select(F.col("doc_idx").alias("idx"), "task_sample"), o.output_path_raw)
    said = session.keep(extract.extract(raw, o.task))
    files.write_errors(said.filter("sample is null").select(F.col("doc_idx").alias("index"), "exception"), o.output_path_error_msgs)
    good = said.filter("sample is not null").select("doc_idx", "sample", F.to_json("sample").alias("said"))
    known = shots.select("doc_idx", F.to_json("sample").alias("said"), "sample")
    clean = session.keep(dedup.greedy(dedup.against(good, known, "said", o.deduplication_ratio), "doc_idx", "said", o.deduplication_ratio))
    files.write_jsonl(clean.select("sample.*"), o.output_path_clean)
    final = sampling.final_dataset(clean.select("doc_idx", "sample"), known.select("doc_idx", "sample"), o.num_final_task_samples, "doc_idx")
    files.write_dataset(final.select("sample.*", "is_few_shot"), o.output_path_final)


def finetune(spark: SparkSession, o: argparse.Namespace) -> None:
    """The texts that a model is trained on, a sample of at most ``max_rows`` of them; training itself is left to a trainer.

    They come from task samples (``few_shots_only``: of these the few-shots), or from the task's official rows where the
    samples' path is the word "official" and ``official_path`` names the rows.
    """
    col = F.col
    if o.train_dataset_path == OFFICIAL:
        if not o.official_path:
            raise ValueError("--official_path must name the official rows")
        rows = files.official(spark, o.task, o.official_path)
        forms = {
            "csqa": lambda: prompts.finetune_yes_no(col("question"), col("answer_str")),
            "recipegen": lambda: prompts.finetune_recipe_official(col("instruction"), col("response")),
            "summarization": lambda: prompts.finetune_summary_official(col("article"), col("response")),
        }
        text = forms.get(o.task, lambda: prompts.finetune_mc(col("question"), col("choices"), col("answer")))()
        key = {"recipegen": "instruction", "summarization": "article"}.get(o.task, "question")
    else:
        rows = spark.read.parquet(o.train_dataset_path)
        if o.few_shots_only:
            rows = rows.filter("is_few_shot = 1")
        if o.task == "recipegen":
            text, key = prompts.finetune_recipe(col("instruction"), col("ingredients"), col("steps")), "instruction"
        elif o.task == "summarization":
            text, key = prompts.finetune_summary(col("instruction"), col("long_but_clean_text"), col("summary")), "long_but_clean_text"
        else:
            text, key = prompts.finetune_qa(col("question"), col("options"), col("answer")), "question"
    files.write_jsonl(sampling.exact(rows, o.max_rows, key).select(prompts.with_eos(text, o.model_name_or_path).alias("text")), o.output_path)


def evaluate_finished(spark: SparkSession, o: argparse.Namespace) -> None:
    """Accuracy and letters of finished predictions with log-probabilities."""
    said = spark.read.schema(schemas.GENERATION).json(o.predictions_path)
    right = spark.read.schema("row_id long, instruction string, answer int").json(o.references_path)
    both = right.join(said, "row_id", "left").withColumn("prediction", evaluate.predicted(F.col("text"), F.col("logprobs"), F.col("choices")))
    files.write_metric(both.agg(evaluate.accuracy(F.col("prediction"), F.col("answer")).alias("accuracy")), o.result_path)
    files.write_jsonl(both.filter("text is not null").select("instruction", evaluate.letter(F.col("prediction")).alias("prediction"), evaluate.letter(F.col("answer")).alias("reference")), o.output_path)


def evaluate_task(spark: SparkSession, o: argparse.Namespace) -> None:
    """A model's answers to a task's official rows beside the right ones; the accuracy of tasks that are answered by letters."""
    if o.predictions_path and o.references_path and o.output_path:
        return evaluate_finished(spark, o)
    if not (o.task and o.official_path and o.output_path):
        raise ValueError("either --predictions_path and --references_path or --task and --official_path must be given, and --output_path")
    rows, col = files.official(spark, o.task, o.official_path), F.col
    if letters := o.task in ("bioqa", "medqa", "csqa"):
        text = prompts.eval_yes_no(col("question")) if o.task == "csqa" else prompts.eval_mc(col("question"), col("choices"))
        rows = rows.select(text.alias("instruction"), evaluate.letter(col("answer")).alias("reference"), F.size("choices").alias("n"))
    else:
        text = prompts.eval_recipe(col("instruction")) if o.task == "recipegen" else prompts.eval_summary(col("article"))
        rows = rows.select(text.alias("instruction"), col("response").alias("reference"))
    prompt = prompts.chat(col("instruction"), prompts.SYSTEM[o.task]) if o.is_llama_3_chat_official else instruct(col("instruction"))
    said = session.keep(asked(rows.withColumn("prompt", prompt), o, models.digest_letter if letters else models.templated_answer))
    if letters:
        said = said.withColumn("task_sample", evaluate.said_letter(col("task_sample"), col("n")))
        files.write_metric(said.agg(evaluate.accuracy(col("task_sample"), col("reference")).alias("accuracy")), o.result_path)
    files.write_jsonl(said.select("instruction", col("task_sample").alias("prediction"), "reference"), o.output_path)


def winrate(spark: SparkSession, o: argparse.Namespace) -> None:
    """How often a judge prefers predictions to references; with ``outputs_path`` (as evaluate writes them) it is asked first."""
    if o.outputs_path:
        rows = files.jsonl(spark, o.outputs_path, schemas.EVAL_OUTPUT).filter("prediction is not null and reference is not null")
        rows = evaluate.swap(rows.select("instruction", F.col("reference").alias("output_1"), F.col("prediction").alias("output_2")), sampling.coin(F.col("instruction")))
        rows = rows.withColumn("prompt", prompts.judge_prompt(F.col("instruction"), F.col("output_1"), F.col("output_2")))
        rows = asked(rows, o, models.digest_judge).withColumn("model_preference", evaluate.preference(F.col("task_sample")))
        files.write_jsonl(rows.drop("prompt", "task_sample"), o.annotated_path)
    rows = spark.read.schema(schemas.PAIRWISE).json(o.annotated_path)
    files.write_metric(rows.agg(evaluate.win_rate(F.col("swapped"), F.col("model_preference")).alias("win_rate")), o.result_path)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    o = parser().parse_args(args)
    spark = spark or session.build()
    if o.command == "retrieve":
        files.write_lines(fetch_mixed(spark, o), o.output_path, "file", "doc_idx")
    else:
        {"embed": embed, "create-tasks": create_tasks, "finetune": finetune, "evaluate": evaluate_task, "winrate": winrate, "index": index}[o.command](spark, o)


if __name__ == "__main__":
    main()
