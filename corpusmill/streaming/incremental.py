"""Incremental embedding: only what is not stored yet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..plans import models
from ..sources import files
from ..sources.files import split_number


def pending(documents: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of splits that have no stored vectors; splits that failed before are tried again."""
    return documents.join(stored.select(*keys).distinct(), keys, "left_anti")


def next_split(stored: DataFrame, split: str = "split") -> int:
    """The number to go on with: one more than the last split that is stored, 0 if none is."""
    last = stored.agg(F.max(split_number(F.col(split)))).first()[0]
    return 0 if last is None else last + 1


def embed_new_files(spark: SparkSession, source: str, sink: str, checkpoint: str, schema: str = "doc_id long, text string") -> None:
    """Embed the Parquet files that came since the last run, exactly once, then stop."""
    stream = spark.readStream.schema(schema).parquet(source)
    vectors = models.embed(stream, ("doc_id",))
    vectors.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


FILE = "path string, modificationTime timestamp, length long, content binary"


def embed_new_splits(spark: SparkSession, source: str, group: str, store: str, checkpoint: str, files_a_batch: int = 1000) -> None:
    """Embed the JSON-lines files that came since the last run, each a split of the store, then stop.

    The stream tells the names of new files, no contents; a batch reads them with the damage rule of ``files.jsonl``.
    A split is written in whole and replaces what is there of it, so a batch that is run again, after a kill or with
    a lost checkpoint, leaves each split once.
    """

    def write(batch: DataFrame, _: int) -> None:
        paths = [r["path"] for r in batch.select("path").collect()]  # at most files_a_batch
        if paths:
            docs = files.jsonl(batch.sparkSession, paths, schemas.DOCUMENT, numbered=True)
            docs = docs.select(F.lit(group).alias("group"), files.split_of(F.col("file")).alias("split"), "doc_idx", "text")
            files.write_vectors(models.embed(docs, ("group", "split", "doc_idx")), store)

    new = spark.readStream.format("binaryFile").schema(FILE).option("maxFilesPerTrigger", files_a_batch).load(source)
    new.select("path").writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
