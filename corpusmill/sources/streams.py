"""Files read as streams inside tasks: one file, one verdict; lines by position; digests.

A compressed file cannot be shared between tasks, and when it is damaged Spark's own
text reader either ends the job or keeps what came before the damage.  Here a task
opens the file itself and reads it as a stream of blocks, so memory does not depend
on the file's size: once to reach a verdict, once more to give the lines of a file
that is whole.  The files themselves are listed by Spark and dealt out to tasks.

Lines of plain files are found by a sparse index, the byte offset of each
``EVERY``-th line: a reader seeks to the block of a hit and stops after the last hit
in it.  A compressed file has no such offsets, so it is read until its last hit.

Paths of local files and of the stores that Arrow's file systems reach are opened by
the task; files in any other store come through Spark's binary source, each in whole,
which bounds them to 2 GB.

Defined cases: an empty file, or one of blank lines, has no lines and the verdict
``empty``; blank lines hold no record but keep their number; a line that is not UTF-8
or not a JSON object damages its file; a hit beyond the end of its file is not found;
a null file or position is none.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 1 << 20
EVERY = 4096
BATCH_LINES = 1024
BATCH_BYTES = 8 << 20
FILES_PER_TASK = 1
MOST_TASKS = 10_000
STREAMED = ("", "file", "hdfs", "s3", "s3a", "s3n", "gs", "gcs", "abfs", "abfss")
WHOLE, EMPTY, DAMAGED = "whole", "empty", "damaged"


class Damage(Exception):
    """Why a file cannot be taken."""


def _opened(path: str, content: bytes | None) -> io.IOBase | pa.NativeFile:
    """A file that can be read and sought in."""
    if content is not None:
        return io.BytesIO(content)
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return open(unquote(parts.path), "rb")  # noqa: SIM115
    scheme = {"s3a": "s3", "s3n": "s3"}.get(parts.scheme, parts.scheme)
    system, at = fs.FileSystem.from_uri(scheme + path[len(parts.scheme) :])
    return system.open_input_file(at)


def blocks(stream) -> Iterator[bytes]:
    while block := stream.read(BLOCK):
        yield block


def inflated(packed: Iterator[bytes]) -> Iterator[bytes]:
    """Blocks of a gzip file of any number of members; raises where it is cut off or its checksum is wrong."""
    inflate, open_, seen = zlib.decompressobj(31), False, False
    for block in packed:
        while block:
            if not open_ and seen:
                block = block.lstrip(b"\0")  # padding between and after members
                if not block:
                    break
            open_ = seen = True
            try:
                out = inflate.decompress(block, BLOCK)
            except zlib.error as e:
                raise Damage(str(e)) from e
            if out:
                yield out
            block = inflate.unconsumed_tail
            if inflate.eof:
                block, inflate, open_ = inflate.unused_data, zlib.decompressobj(31), False
    if open_:
        raise Damage("the file ends within a gzip member")


def lines(parts: Iterator[bytes]) -> Iterator[bytes]:
    """Lines without their ends; the last one need not have any."""
    held: list[bytes] = []
    for part in parts:
        first, *more = part.split(b"\n")
        held.append(first)
        if more:
            yield b"".join(held).removesuffix(b"\r")
            yield from (x.removesuffix(b"\r") for x in more[:-1])
            held = [more[-1]]
    if last := b"".join(held):
        yield last.removesuffix(b"\r")


def lines_of(path: str, stream) -> Iterator[bytes]:
    return lines(inflated(blocks(stream)) if path.endswith(".gz") else blocks(stream))


def _no_constant(name: str) -> None:
    raise ValueError(name)


def verdict(path: str, content: bytes | None) -> tuple[int, str, str | None]:
    """Records, verdict and, of a damaged file, what is wrong with it."""
    n = k = 0
    try:
        with _opened(path, content) as stream:
            for k, line in enumerate(lines_of(path, stream)):
                if line.strip():
                    if not isinstance(json.loads(line, parse_constant=_no_constant), dict):
                        raise Damage(f"line {k} is no object")
                    n += 1
    except Damage as e:
        return n, DAMAGED, str(e)
    except (ValueError, RecursionError) as e:  # not UTF-8, not JSON, or nested too deep
        return n, DAMAGED, f"after {n} records: {e}"
    return n, WHOLE if n else EMPTY, None


def listed(spark: SparkSession, paths: str | list[str], pattern: str | None = None) -> DataFrame:
    """path, length and content (null for what tasks can open themselves) of files, folders or globs; Spark lists them."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    found = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(paths)
    scheme = F.lower(F.regexp_extract("path", r"^([A-Za-z0-9+.-]+):", 1))
    other = found.select(scheme.alias("s")).distinct().filter(~F.col("s").isin(*STREAMED)).limit(1).count()
    rows = found.select("path", "length", "content" if other else F.lit(None).cast("binary").alias("content"))
    names = [re.sub("^file:/+", "file:/", unquote(f)) for f in found.inputFiles()]  # Spark's index has files of no bytes, its scan has not
    if len(names) == rows.select("path").count():
        return rows
    none = spark.createDataFrame([(n,) for n in names], "path string").join(rows.select("path"), "path", "left_anti")
    return rows.unionByName(none.select("path", F.lit(0).cast("long").alias("length"), F.lit(b"" if other else None).cast("binary").alias("content")))


def _dealt(found: DataFrame) -> DataFrame:
    """Files dealt out one by one, so that none waits behind another."""
    n = found.select("path").count()
    return found.repartition(max(1, min(MOST_TASKS, -(-n // FILES_PER_TASK))))


def _batches(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType], size: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += size(row)
        if len(held) >= BATCH_LINES or weight >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


def ledger(spark: SparkSession, paths: str | list[str], pattern: str | None = None) -> DataFrame:
    """file, bytes, records, verdict (whole, empty or damaged) and detail: one row a file of JSON lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, length, content in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                n, said, detail = verdict(path, content)
                yield pa.record_batch({"file": [path], "bytes": pa.array([length], pa.int64()), "records": pa.array([n], pa.int64()), "verdict": [said], "detail": pa.array([detail], pa.string())})

    return _dealt(listed(spark, paths, pattern)).mapInArrow(run, "file string, bytes long, records long, verdict string, detail string")


def whole_files(spark: SparkSession, paths: str | list[str], pattern: str | None = None) -> DataFrame:
    """file, doc_idx (the line's number, from 0) and raw of the files of JSON lines that are whole; of damaged ones nothing."""

    def rows(b: pa.RecordBatch) -> Iterator[tuple]:
        for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if verdict(path, content)[1] == WHOLE:
                with _opened(path, content) as stream:
                    for k, line in enumerate(lines_of(path, stream)):
                        if line.strip():
                            yield path, k, line.decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _batches(rows(b), ["file", "doc_idx", "raw"], [pa.string(), pa.int64(), pa.string()], lambda r: len(r[2]))

    return _dealt(listed(spark, paths, pattern)).select("path", "content").mapInArrow(run, "file string, doc_idx long, raw string")


def line_index(spark: SparkSession, paths: str | list[str], every: int = EVERY, pattern: str | None = None) -> DataFrame:
    """file, block, offset: where each ``every``-th line of the plain files starts."""

    def rows(path: str, content: bytes | None) -> Iterator[tuple]:
        yield path, 0, 0
        at, n = 0, 0
        with _opened(path, content) as stream:
            for block in blocks(stream):
                ends = block.count(b"\n")
                want = every - n % every  # line ends until the next entry
                place = -1
                while want <= ends:
                    for _ in range(want):
                        place = block.index(b"\n", place + 1)
                    n, ends = n + want, ends - want
                    yield path, n // every, at + place + 1
                    want = every
                n, at = n + ends, at + len(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield from _batches(rows(path, content), ["file", "block", "offset"], [pa.string(), pa.int64(), pa.int64()], lambda r: 16)

    plain = listed(spark, paths, pattern).filter(~F.col("path").endswith(".gz"))
    return _dealt(plain).select("path", "content").mapInArrow(run, "file string, block long, offset long")


def lines_at(spark: SparkSession, hits: DataFrame, index: DataFrame | None = None, every: int = EVERY) -> DataFrame:
    """file, doc_idx, raw of the lines that ``hits`` (file, doc_idx) name; ``bytes``: what was read of the file since the hit before.

    ``file`` is a path as ``listed`` gives it, which a task can open.  A file with an index is read from the blocks
    that hold hits alone, any other from its start to its last hit.
    """
    keyed = hits.select("file", F.col("doc_idx").cast("long").alias("doc_idx")).filter("file is not null and doc_idx >= 0").distinct().withColumn("block", F.floor(F.col("doc_idx") / every))
    if index is None:
        found = keyed.withColumn("offset", F.lit(None).cast("long"))
    else:
        found = keyed.join(index.select("file", "block", "offset"), ["file", "block"], "left")
    start = F.when(F.col("offset").isNull(), 0).otherwise(F.col("block") * every)
    jobs = found.select("file", start.alias("start"), F.coalesce("offset", F.lit(0)).cast("long").alias("offset"), "doc_idx").groupBy("file", "start", "offset").agg(F.sort_array(F.collect_set("doc_idx")).alias("wanted"))

    def rows(path: str, start: int, offset: int, wanted: list[int]) -> Iterator[tuple]:
        read = told = 0
        left = iter(wanted)
        want = next(left)

        def counted(stream) -> Iterator[bytes]:
            nonlocal read
            for block in blocks(stream):
                read += len(block)
                yield block

        with _opened(path, None) as stream:
            stream.seek(offset)
            for k, line in enumerate(lines(inflated(counted(stream)) if path.endswith(".gz") else counted(stream)), start):
                if k == want:
                    yield path, k, line.decode(errors="replace"), read - told
                    told, want = read, next(left, None)
                    if want is None:
                        return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for job in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                yield from _batches(rows(*job), ["file", "doc_idx", "raw", "bytes"], [pa.string(), pa.int64(), pa.string(), pa.int64()], lambda r: len(r[2]))

    return jobs.mapInArrow(run, "file string, doc_idx long, raw string, bytes long")


def digests(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """name, file, bytes, sha256 of files of any size, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, length, content in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                total = hashlib.sha256()
                with _opened(path, content) as stream:
                    for block in blocks(stream):
                        total.update(block)
                yield pa.record_batch({"name": [unquote(path).rsplit("/", 1)[-1]], "file": [path], "bytes": pa.array([length], pa.int64()), "sha256": [total.hexdigest()]})

    return _dealt(listed(spark, paths)).mapInArrow(run, "name string, file string, bytes long, sha256 string")


def checked_digests(spark: SparkSession, paths: str | list[str], sums: str | list[str]) -> DataFrame:
    """name, sha256, expected, state: ``same``, ``differs``, ``missing`` (no such file) or ``unlisted``; sums are lines "digest  name"."""
    told = spark.read.text(sums).filter(F.trim("value") != "").select(F.lower(F.regexp_extract("value", r"^\s*\\?([0-9A-Fa-f]{64})", 1)).alias("expected"), F.regexp_extract("value", r"^\s*\\?[0-9A-Fa-f]{64}\s+\*?(?:.*/)?([^/]+?)\s*$", 1).alias("name"))
    state = F.when(F.col("sha256").isNull(), "missing").when(F.col("expected").isNull(), "unlisted").when(F.col("sha256") == F.col("expected"), "same").otherwise("differs")
    return digests(spark, paths).select("name", "sha256").join(told.filter("name <> ''"), "name", "full_outer").select("name", "sha256", "expected", state.alias("state"))
