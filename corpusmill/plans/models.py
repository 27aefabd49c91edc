"""Plug-in points for models, with deterministic stand-ins."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Embed = Callable[[list[str]], np.ndarray]
Generate = Callable[[list[str]], list[str]]


def model_length(requested: int | None, model: str) -> int:
    """Tokens a model is run with: what is asked for up to 8192, else 8192 or, for models that are not llamas, 16384."""
    return min(requested, 8192) if requested is not None else 8192 if "llama" in model else 16384


def hashed_embedding(texts: list[str], width: int = 64) -> np.ndarray:
    """Counts of hashed words, normalised: a stand-in for a text encoder."""
    out = np.zeros((len(texts), width), dtype=np.float32)
    for k, text in enumerate(texts):
        for w in (text or "").lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            out[k, h % width] += 1.0 if h >> 63 else -1.0
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def embed(df: DataFrame, keys: tuple[str, ...], load: Callable[[], Embed] = lambda: hashed_embedding, batch: int = 512) -> DataFrame:
    """Keys and ``embedding`` of ``text``; the model is loaded once a task and fed in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                part = b.slice(lo, batch)
                v = model(part.column(len(keys)).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(list(v), pa.list_(pa.float32()))], names=[*keys, "embedding"])

    kept = df.select(*keys, "text")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{types}, embedding array<float>")


def templated_answer(prompts: list[str]) -> list[str]:
    """A well-formed sample made from the prompt's digest: a stand-in for a generator."""
    return [f'{{"question": "What does digest {hashlib.md5(p.encode()).hexdigest()} stand for?", "options": ["A. a", "B. b", "C. c", "D. d"], "answer": "A"}}' for p in prompts]


def digest_letter(prompts: list[str]) -> list[str]:
    """A or B by the prompt's digest: a stand-in for a model that answers with a letter."""
    return ["AB"[hashlib.md5(p.encode()).digest()[0] & 1] for p in prompts]


def digest_judge(prompts: list[str]) -> list[str]:
    """1 or 2 by the prompt's digest: a stand-in for a judge."""
    return ["12"[hashlib.md5(p.encode()).digest()[0] & 1] for p in prompts]


def generate(df: DataFrame, keys: tuple[str, ...], load: Callable[[], Generate] = lambda: templated_answer) -> DataFrame:
    """Keys and stripped ``task_sample`` of ``prompt``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([t.strip() for t in model(b.column(len(keys)).to_pylist())], pa.string())], names=[*keys, "task_sample"])

    kept = df.select(*keys, "prompt")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{types}, task_sample string")


def answers(df: DataFrame, prompt: str, store: str, load: Callable[[], Generate] = lambda: templated_answer, rounds: int = 16, batch: int = 64) -> DataFrame:
    """``df`` with ``task_sample``; answers are kept at ``store`` by their prompt's digest, so no stored prompt is asked again.

    Prompts are asked in ``rounds`` parts of the digests' range, each written when it is done: a run that is ended
    loses one part at most, and a rerun asks for what is missing.  Equal prompts are asked once.  Within a part prompts
    are range-sorted by length, so that a batch holds prompts of like length and needs little padding.  A null prompt
    has no answer.
    """
    spark, digest = df.sparkSession, F.sha2(prompt, 256)
    schema = "digest string, task_sample string"

    def stored() -> DataFrame:
        at = spark._jvm.org.apache.hadoop.fs.Path(store)
        there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
        return spark.read.schema(f"{schema}, part int").parquet(store) if there else spark.createDataFrame([], f"{schema}, part int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                own = b.slice(lo, batch)
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array([t.strip() for t in model(own.column(1).to_pylist())], pa.string())], names=["digest", "task_sample"])

    part = F.pmod(F.xxhash64(digest), F.lit(rounds)).cast("int")
    asked = df.filter(F.col(prompt).isNotNull()).select(digest.alias("digest"), F.col(prompt).alias("prompt"), part.alias("part"))
    for k in range(rounds):
        missing = asked.filter(F.col("part") == k).join(stored().select("digest"), "digest", "left_anti").dropDuplicates(["digest"])
        sized = missing.repartitionByRange(F.length("prompt"), "digest").sortWithinPartitions(F.length("prompt"), "digest")
        sized.select("digest", "prompt").mapInArrow(run, schema).write.mode("append").parquet(f"{store}/part={k}")
    known = stored().select("digest", "task_sample").dropDuplicates(["digest"])
    return df.join(known, digest == known["digest"], "left").drop("digest")
