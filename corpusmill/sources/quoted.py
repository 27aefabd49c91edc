"""CSV files with line breaks inside quotes, read by as many tasks as they have blocks.

Whether a line starts inside quotes depends on all lines before it.  But a line does one
of four things to that state, whatever it is: leaves it, turns it round, or ends inside
or outside.  So does a block of lines, which a task reads in order: the state before a block
is that of the last block that fixed it, turned round as often as blocks have since, told
from one row a block.  A record starts at each line that starts outside.  Records that end
in their block are put together where they are read; only the first and last piece of a
block may belong to others and are shuffled.

Defined cases: an empty file has no records; quotes inside a field that does not start
with one are letters; a quote that is never closed holds what is left of its file, as one
field; line ends inside quotes become a line feed, unless ``line_end`` names the only one.
A record is one row, so one of over 2 GB is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import keep

MOST_LINES = 100_000
MOST_BLOCKS = 100_000


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line that starts inside or outside quotes ends inside."""
    i = 0
    while True:
        if not inside:
            if line.startswith('"', i):
                i += 1
            else:
                i = line.find(",", i) + 1
                if not i:
                    return False
                continue
        i = line.find('"', i)
        while i >= 0 and line.startswith('""', i):
            i = line.find('"', i + 2)
        if i < 0:
            return True
        inside, i = False, line.find(",", i + 1) + 1
        if not i:
            return False


def _stretches(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that are of one file and block each."""
    if b.num_rows:
        file, block = b.column(0), b.column(1)
        new = pc.or_(pc.not_equal(file.slice(1), file.slice(0, b.num_rows - 1)), pc.not_equal(block.slice(1), block.slice(0, b.num_rows - 1)))
        cuts = [0, *(np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            yield b.slice(lo, hi - lo)


def _quoted(raw: pa.Array) -> tuple[list[int], list[str]]:
    """The lines that may change the state: a line without quotes leaves it as it is."""
    at = np.flatnonzero(pc.match_substring(raw, '"').to_numpy(zero_copy_only=False))
    return at.tolist(), raw.take(pa.array(at)).to_pylist()


def _blocks(lines: DataFrame) -> DataFrame:
    """One row a block: for each state that it may start in, the state it ends in and the last of its lines that starts outside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, done, state, start = None, 0, [], []

        def told() -> pa.RecordBatch:
            longs = {f"start_{x}": pa.array([v], pa.int64()) for x, v in zip(("out", "in"), start, strict=True)}
            return pa.record_batch({"file": pa.array([key[0]], pa.string()), "block": pa.array([key[1]], pa.int64())} | longs | {"ends_out": [state[0]], "ends_in": [state[1]]})

        for b in batches:
            for part in _stretches(b):
                now = (part.column(0)[0].as_py(), part.column(1)[0].as_py())
                if now != key:
                    if key:
                        yield told()
                    key, done, state, start = now, 0, [False, True], [None, None]
                before = 0  # lines whose start is told
                for k, line in [*zip(*_quoted(part.column(2)), strict=True), (part.num_rows, None)]:
                    last = min(k, part.num_rows - 1)
                    start = [done + last if not s and last >= before else x for s, x in zip(state, start, strict=True)]
                    if line is not None:
                        state = [ends_inside(line, s) for s in state]
                        before = k + 1
                done += part.num_rows
        if key:
            yield told()

    return lines.mapInArrow(run, "file string, block long, start_out long, start_in long, ends_out boolean, ends_in boolean")


def _pieces(lines: DataFrame) -> DataFrame:
    """The records that start and end within a block, whole, and what a block has of others, with the record (its block and line) that it belongs to.

    What a block has of a record goes in pieces of at most ``MOST_LINES`` lines each, told apart by their first lines.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "block", "from_block", "from_line", "line", "whole", "value"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
        key, record, done, inside, held, out = None, None, 0, False, [], []

        def told(ends: bool) -> None:
            if held:
                at = done - len(held)
                out.append((*key, *record, at, ends and record == (key[1], at), "\n".join(held)))

        for b in batches:
            for part in _stretches(b):
                now = (part.column(0)[0].as_py(), part.column(1)[0].as_py())
                if now != key:
                    told(False)
                    key, done, held = now, 0, []
                    inside = part.column(3)[0].as_py()
                    record = (part.column(4)[0].as_py(), part.column(5)[0].as_py())
                for line in part.column(2).to_pylist():
                    if not inside or len(held) >= MOST_LINES:
                        told(not inside)
                        held = []
                    if not inside:
                        record = (key[1], done)
                    held.append(line)
                    done += 1
                    if '"' in line:
                        inside = ends_inside(line, inside)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)
            out.clear()
        told(False)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)

    return lines.mapInArrow(run, "file string, block long, from_block long, from_line long, line long, whole boolean, value string")


def _state(before, first: Column) -> Column:
    """The state that the rows of a window frame lead to from ``first``: the last one fixed, turned round since."""
    fixed = F.last("fixes", ignorenulls=True).over(before)
    turned = F.coalesce(F.sum("turns").over(before), F.lit(0)) - F.coalesce(F.last(F.when(F.col("fixes").isNotNull(), F.col("turned")), ignorenulls=True).over(before), F.lit(0))
    return F.coalesce(fixed, first) != (turned % 2 == 1)


def records(spark: SparkSession, paths: str | list[str], line_end: str | None = None) -> DataFrame:
    """file, first (whether it is its file's first record), value: records of any number of lines, which end as ``line_end`` says or in any way."""
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    lines = spark.read.text(paths, lineSep=line_end).select(*where, F.col("value").alias("raw"))
    ends = F.col("ends_out"), F.col("ends_in")
    blocks = keep(_blocks(lines)).select("file", "block", "start_out", "start_in", F.when(ends[0] == ends[1], ends[0]).alias("fixes"), (ends[0] & ~ends[1]).cast("int").alias("turns"))
    of_file = Window.partitionBy("file").orderBy("block")
    blocks = blocks.withColumn("turned", F.sum("turns").over(of_file.rowsBetween(Window.unboundedPreceding, 0)))
    earlier = of_file.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("inside", _state(earlier, F.lit(False)))
    begun = F.when(F.col("inside"), F.col("start_in")).otherwise(F.col("start_out"))
    blocks = blocks.withColumn("begun", F.when(begun.isNotNull(), F.struct(F.col("block").alias("block"), begun.alias("line"))))
    blocks = blocks.withColumn("open", F.last("begun", ignorenulls=True).over(earlier))
    blocks = keep(blocks.select("file", "block", "inside", F.col("open.block").alias("from_block"), F.col("open.line").alias("from_line")))
    few = blocks.limit(MOST_BLOCKS + 1).count() <= MOST_BLOCKS
    if few:
        told = lines.join(F.broadcast(blocks), ["file", "block"])
    else:
        numbered = lines.withColumn("id", F.monotonically_increasing_id()).join(blocks, ["file", "block"])
        told = numbered.repartition("file", "block").sortWithinPartitions("file", "block", "id")
    pieces = _pieces(told.select("file", "block", "raw", "inside", "from_block", "from_line"))
    parts, record = keep(pieces.filter("not whole")), ["file", "from_block", "from_line"]
    joined = parts.groupBy(*record).agg(F.array_sort(F.collect_list(F.struct("block", "line", "value"))).alias("parts"))
    joined = joined.select(*record, F.array_join(F.transform("parts", lambda x: x["value"]), "\n").alias("value"))
    first = (F.col("from_block") == 0) & (F.col("from_line") == 0)
    return pieces.filter("whole").select(*record, "value").union(joined).select("file", first.alias("first"), "value")


def rows(spark: SparkSession, paths: str | list[str], schema: str, header: bool = True, null: str = "", line_end: str | None = None) -> DataFrame:
    """The records as columns; records with another number of fields, and each file's first one as ``header``, are left out.

    A field that is ``null``, quoted or not, is a null.
    """
    found = records(spark, paths, line_end)
    found = found.filter(~F.col("first")) if header else found
    # the default for charToEscapeQuoteEscaping, NUL, would be dropped from quoted fields
    options = {"columnNameOfCorruptRecord": "_corrupt", "escape": '"', "charToEscapeQuoteEscaping": '"', "nullValue": null, "mode": "PERMISSIVE"}
    parsed = found.select(F.from_csv("value", f"{schema}, _corrupt string", options).alias("r"))
    return parsed.filter("r is not null and r._corrupt is null").select("r.*").drop("_corrupt")
