"""Readers and writers for corpora, samples and metrics.

Schemas are given, never inferred (``schemas``).  Defined cases: an empty file has no rows; a file with a damaged line,
and a compressed one that is cut off or fails its checksum, is left out whole (``streams.ledger`` lists them); a blank
line is no record but keeps its number; fields that a record lacks, or has in another type, are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import strip
from ..operators import official as forms
from ..operators.clean import numbered, unused
from ..session import keep
from . import quoted, streams

# Where each corpus keeps its files; others are taken for how-to articles.
CORPUS_ROOTS = {"c4": "c4", "wikipedia": "wikipedia", "stackexchange": "stackexchange", "wikihow": "wikihow"}


#: Rows of one file block each that are broadcast at most.
MOST_BLOCKS = 100_000
#: Compressed files cannot be shared by tasks and are read one by one (``streams``); Spark leaves them out of its scan.
PLAIN = "not endswith(_metadata.file_name, '.gz')"


def numbered_lines(spark: SparkSession, paths: str | list[str], plain: bool = False) -> DataFrame:
    """file, doc_idx (the line's number within its file, from 0) and raw.

    Lines are numbered inside each block of a file, and the counts of earlier blocks are added: files of any size are
    read by as many tasks as they have blocks.
    """
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id")]
    lines = spark.read.text(paths)
    lines = (lines.filter(PLAIN) if plain else lines).select(F.col("value").alias("raw"), *where)
    blocks = lines.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    few = blocks.limit(MOST_BLOCKS + 1).count() <= MOST_BLOCKS
    return lines.join(F.broadcast(blocks) if few else blocks, ["file", "_block"]).select("file", (F.col("_before") + F.col("_id") - F.col("_first")).alias("doc_idx"), "raw")


def jsonl(spark: SparkSession, paths: str | list[str], schema: str = "text string", raw: bool = False, numbered: bool = False) -> DataFrame:
    """JSON lines, plain or gzip; a file with any damaged line is left out whole. ``raw`` adds the line itself, ``numbered`` its number (doc_idx)."""
    lines = numbered_lines(spark, paths, plain=True) if numbered else spark.read.text(paths).filter(PLAIN).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw"))
    lines = lines.filter(F.trim("raw") != "")
    value = F.try_parse_json("raw")
    bad = lines.filter(value.isNull() | ~F.startswith(F.schema_of_variant(value), F.lit("OBJECT"))).select("file").distinct()
    parts = [lines.join(bad, "file", "left_anti")]
    if streams.listed(spark, paths, "*.gz").limit(1).count():
        zipped = streams.whole_files(spark, paths, "*.gz")
        parts.append(zipped if numbered else zipped.drop("doc_idx"))
    good = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    good = good.withColumn("r", F.from_json("raw", schema, {"allowSingleQuotes": "false"}))
    return good.select("file", *(["doc_idx"] if numbered else []), *(["raw"] if raw else []), "r.*")


def record_string(*columns: str) -> Column:
    """"key: value" of the columns, blank lines between."""
    return F.concat_ws("\n\n", *[F.concat(F.lit(f"{c}: "), F.col(c)) for c in columns])


def howto_csv(spark: SparkSession, path: str, null: str = "", line_end: str | None = None) -> DataFrame:
    """headline, title, text; rows with another number of fields are skipped; a file is read by as many tasks as it has blocks."""
    return quoted.rows(spark, path, "headline string, title string, text string", null=null, line_end=line_end)


def titles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(strip(F.col("value")).alias("title_key")).distinct()


def matching(spark: SparkSession, folder: str, pattern: str = "wiki_*.jsonl") -> DataFrame:
    return spark.read.option("pathGlobFilter", pattern).text(folder)


def many(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The bag of several JSON files."""
    return spark.read.schema(schema).json(paths)


def official(spark: SparkSession, task: str, path: str, topic: str = "biology") -> DataFrame:
    """The official training rows of a task (JSON lines) in the form that prompts and texts expect."""
    read = lambda schema: jsonl(spark, path, schema).drop("file")
    if task == "bioqa":
        return read(schemas.OFFICIAL_MC).filter(F.col("topic") == topic)
    if task == "medqa":
        return forms.medical(read(schemas.OFFICIAL_MEDICAL))
    if task == "csqa":
        return forms.yes_no(read(schemas.OFFICIAL_YES_NO))
    return forms.recipes(read(schemas.OFFICIAL_RECIPE)) if task == "recipegen" else forms.summaries(read(schemas.OFFICIAL_SUMMARY))


def vector_store(spark: SparkSession, path: str, groups: list[str] | None = None, splits: list[str] | None = None) -> DataFrame:
    """Stored vectors; groups and splits are folders, so those that are not asked for are not listed or read."""
    rows = spark.read.schema(schemas.EMBEDDING).parquet(path)
    rows = rows if groups is None else rows.filter(F.col("group").isin(groups))
    return rows if splits is None else rows.filter(F.col("split").isin(splits))


def web_split(number: Column) -> Column:
    """Name of a shard of the web corpus."""
    return F.format_string("train.%05d", number.cast("int"))


def split_number(split: Column) -> Column:
    """The number at the end of a split's name, null without one."""
    return F.nullif(F.regexp_extract(split, r"([0-9]+)$", 1), F.lit("")).cast("int")


def split_of(file: Column) -> Column:
    """The split that a file holds, by its name."""
    return F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"^c4-|-of-[0-9]+\.json\.gz$|\.jsonl$", "")


def split_file(group: Column, split: Column) -> Column:
    """File name of a split: numbered shards for the web corpus, plain names otherwise."""
    return F.when(group == "c4", F.format_string("c4-%s-of-01024.json.gz", split)).otherwise(F.concat(split, F.lit(".jsonl")))


def corpus_root(group: Column) -> Column:
    out = F.lit(CORPUS_ROOTS["wikihow"])
    for name, root in CORPUS_ROOTS.items():
        out = F.when(group == name, root).otherwise(out)
    return out


def write_lines(df: DataFrame, path: str, *order: str, column: str = "raw") -> None:
    df.orderBy(*order).select(column).write.mode("overwrite").text(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_double_encoded(df: DataFrame, path: str) -> None:
    """Each row's JSON as a JSON string."""
    inner = F.to_json(F.struct(*df.columns))
    df.select(F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(inner, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"')).alias("value")).write.mode("overwrite").text(path)


def write_errors(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_dataset(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_vectors(df: DataFrame, path: str) -> None:
    """Each split of a group is a folder; a split that is written again replaces what a run before has left of it."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("group", "split").option("compression", "zstd").parquet(path)


def write_chunks(df: DataFrame, path: str, order: str, rows: int = 350_000, append: bool = False) -> int:
    """Folders chunk=0, chunk=1, ... of one JSON-lines file each, all but the last of exactly ``rows`` rows, in order of a key; how many there are.

    ``append`` goes on after what is there: a last chunk that is not full is filled first.
    """
    spark, start = df.sparkSession, 0
    if append:
        held = spark.read.schema("chunk long").json(path).groupBy("chunk").count().orderBy(F.desc("chunk")).limit(1).collect()
        if held and held[0]["count"] < rows:
            start = held[0]["chunk"] * rows + held[0]["count"]
        elif held:
            start = (held[0]["chunk"] + 1) * rows
    names = [c for c in df.columns if c != "chunk"]
    placed = numbered(df.select(*names), order, place := unused(df, "_place")).withColumn(place, F.col(place) + start)
    made = placed.withColumn("chunk", F.floor(F.col(place) / rows).cast("long"))
    if start % rows:  # the rows of the open chunk, copied first, as its file is written anew
        open_ = keep(spark.read.schema(df.select(*names).schema).json(f"{path}/chunk={start // rows}"))
        made = made.unionByName(open_.withColumn(place, F.lit(-1).cast("long")).withColumn(f"{place}_total", F.lit(0).cast("long")).withColumn("chunk", F.lit(start // rows).cast("long")))
    made = keep(made.drop(f"{place}_total"))
    made.repartition("chunk").sortWithinPartitions("chunk", place).drop(place).write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if append else "static").partitionBy("chunk").json(path)
    last = made.agg(F.max("chunk")).first()[0]
    return -(-start // rows) if last is None else last + 1


def write_metric(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Name, size and SHA-256 of every file, of any size."""
    return streams.digests(spark, path).select("name", "bytes", "sha256")


def folder_size(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg(F.sum("length").alias("bytes"))
