"""Corpus cleaning: paragraphs, how-to articles with held-out titles, questions with answers, chunks.

Defined cases: null texts and titles are outside every length band and match no title; rows with a null order key
come first in chunks, in any order among themselves; rows with equal keys follow each other; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import keep


def clean_paragraphs(df: DataFrame, column: str = "text") -> DataFrame:
    return df.withColumn(column, T.paragraphs(F.col(column))).filter(T.in_band(F.col(column)))


def held_out(df: DataFrame, titles: DataFrame) -> DataFrame:
    """Rows whose title is held out, as test rows; length does not matter."""
    keyed = df.withColumn("title_key", T.alphanumeric(T.strip(F.col("title"))))
    return keyed.join(titles.select("title_key").distinct(), "title_key", "left_semi").select(T.strip(F.col("title")).alias("instruction"), T.strip(F.col("headline")).alias("reference"))


def train_articles(df: DataFrame, titles: DataFrame) -> DataFrame:
    """Other rows whose body alone is in the length band, as title and body."""
    keyed = df.withColumn("title_key", T.alphanumeric(T.strip(F.col("title")))).filter(T.in_band(T.strip(F.col("text"))))
    return keyed.join(titles.select("title_key").distinct(), "title_key", "left_anti").withColumn("text", T.joined(F.col("title"), F.col("text"), "\n"))


def question_answers(df: DataFrame, question: str = "title_body", answer: str = "upvoted_answer") -> DataFrame:
    gone = [c for c in (question, answer) if c != "text"]
    return df.withColumn("text", T.joined(F.col(question), F.col(answer), "\n\n")).drop(*gone).filter(T.in_band(F.col("text")))


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores after it as it takes to clash with no column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


PLACE_BITS = 33


def numbered(df: DataFrame, order: str, name: str, group: str | None = None) -> DataFrame:
    """``name``: the place (from 0) of every row in order of a key of any type, and ``name``_total: how many there are.

    Rows are range-partitioned by group and key, with a digest of the row to part equal keys, sorted in their partition
    and written once; a row's place is its place in the partition and what the partitions before it hold.  The driver
    sees one row a partition.  Places within a group start from the group's first place.
    """
    keys = [group] if group else []
    at, tie = unused(df, "_at"), F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if f.dataType.typeName() not in ("map", "variant")])
    by = [*[F.col(k).asc_nulls_first() for k in keys], F.col(order).asc_nulls_first(), tie]
    rows = keep(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(at, F.monotonically_increasing_id()))
    part = F.shiftright(F.col(at), PLACE_BITS)
    sizes = sorted((r["p"], r["n"]) for r in rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, total = [], 0
    for p, n in sizes:
        before.append((p, total))
        total += n
    own, base = unused(df, "_own"), unused(df, "_base")
    offsets = df.sparkSession.createDataFrame(before, f"`{own}` long, `{base}` long")
    out = rows.join(F.broadcast(offsets), part == F.col(own)).withColumn(name, F.col(base) + F.col(at).bitwiseAND((1 << PLACE_BITS) - 1))
    out = out.select(*df.columns, name)
    if not group:
        return out.withColumn(f"{name}_total", F.lit(total).cast("long"))
    firsts = out.groupBy(F.col(group).alias(own)).agg(F.min(name).alias(base), F.count(F.lit(1)).alias(f"{name}_total"))
    return out.join(firsts, F.col(group).eqNullSafe(F.col(own))).withColumn(name, F.col(name) - F.col(base)).select(*df.columns, name, f"{name}_total")


def chunks(df: DataFrame, order: str, rows: int = 350_000, group: str | None = None, drop_remainder: bool = False) -> DataFrame:
    """A chunk number for every ``rows`` rows in order of a key; ``drop_remainder`` leaves out a last chunk that is not full."""
    place = unused(df, "_place")
    out = numbered(df, order, place, group).withColumn("chunk", F.floor(F.col(place) / rows).cast("long"))
    if drop_remainder:
        out = out.filter((F.col("chunk") + 1) * rows <= F.col(f"{place}_total"))
    return out.drop(place, f"{place}_total")


MOST_FILES = 1_000_000


def file_chunks(df: DataFrame, file: str = "file", rows: int = 350_000) -> DataFrame:
    """A chunk number for whole input files: in order of name, a chunk ends with the file that brings it to ``rows`` rows or more.

    Files after the last full chunk are left out.  The driver sees one row a file (a checked number of them).
    """
    sizes = df.groupBy(file).count().orderBy(file).limit(MOST_FILES + 1).collect()
    if len(sizes) > MOST_FILES:
        raise ValueError(f"more than {MOST_FILES} input files")
    open_, full, held, chunk = [], [], 0, 0
    for r in sizes:
        open_.append(r[0])
        held += r["count"]
        if held >= rows:
            full += [(f, chunk) for f in open_]
            open_, held, chunk = [], 0, chunk + 1
    of = df.sparkSession.createDataFrame(full, df.select(F.col(file).alias("_file")).schema.add("chunk", "long"))
    return df.join(of, F.col(file).eqNullSafe(F.col("_file"))).drop("_file")
