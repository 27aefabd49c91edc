"""From raw documents to a training mix, in five stages.

Each stage reads what its predecessor wrote, whole; each but the last returns
the columns of ``documents``.  Stage by stage: texts of no recognisable language
go; of each group of near copies (five-word shingles, Jaccard 0.8) the one with
the smallest id stays; documents with a benchmark passage go; personal data are
masked in the text; sources are mixed to their target weights.

Defined cases, for every stage: an empty table gives an empty table; a null,
empty or letterless text goes in the first stage; rows with a null doc_id are
linked with nothing and stay; repeated rows are treated alike, and are one
group in the second stage; columns of any name are kept as they are, and the
last stage's new ones get another name where theirs is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import decontam, jaccard, langid, mixing, pii
from corpusmill.llm.common import Scratch, tune


def recognise_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return langid.recognised(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return jaccard.one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return pii.masked(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


STAGES = [
    ("language", recognise_language),
    ("near_copies", drop_near_copies),
    ("benchmark", drop_benchmark_leaks),
    ("personal_data", mask_personal_data),
    ("mix", mix_sources),
]

#: Language models, q-gram alignment and bootstrapped patterns have no SQL form; tests compare each stage's rows with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage keeps for itself in the shared folder is deleted once its result is written."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        mark = len(Scratch.opened)
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        Scratch.close_since(mark)
    return docs
