"""Shared parts of the operators: shared-folder tables, driver sums, Bloom pruning, components."""

from __future__ import annotations

import gc
import threading
import uuid
from collections.abc import Callable, Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from . import textcols as tc

BROADCAST_BYTES = 16 << 20
ROW_BYTES = 64
BATCH_ROWS = "1024"


def tune(spark: SparkSession) -> None:
    """Arrow batches of a size that keeps Python workers small with texts of any length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


class Opened(threading.local):
    """The scratches of the thread that looks: queries that run side by side in one session do not close each other's."""

    def __init__(self):
        self.items: list[Scratch] = []

    def __len__(self) -> int:
        return len(self.items)


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive executors."""

    opened: ClassVar[Opened] = Opened()

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/corpusmill/{uuid.uuid4().hex}"
        Scratch.opened.items.append(self)

    @classmethod
    def close_since(cls, mark: int) -> None:
        """Delete what this thread has opened since there were ``mark`` scratches, once all results of that time are written."""
        for x in cls.opened.items[mark:]:
            x.close()
        del cls.opened.items[mark:]

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def counted(self, df: DataFrame, name: str = "t", **more: Column) -> tuple[DataFrame, dict[str, int]]:
        """The kept table with its number of rows (``rows``) and of those where a condition holds; no second job counts them."""
        seen = Observation()
        held = {k: F.count_if(c) for k, c in more.items()} | {"rows": F.count(F.lit(1))}
        return self.keep(df.observe(seen, *[c.alias(k) for k, c in held.items()]), name), seen.get

    def small(self, df: DataFrame, name: str = "t", most: int = BROADCAST_BYTES) -> DataFrame:
        """The kept table, to be broadcast where ``checked_broadcast`` would; it is measured as it is written, by no job of its own."""
        size, seen = _row_bytes(df), Observation()
        if size is None:
            return self.keep(df, name)
        kept = self.keep(df.observe(seen, F.sum(size).alias("bytes")), name)
        return F.broadcast(kept) if (seen.get["bytes"] or 0) <= most else kept

    def tidy(self) -> None:
        """Have the driver collect its garbage: plans, shuffle files and broadcasts of finished queries go only then, and its
        heap, which grows with the queries in between, is given back."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *kept: DataFrame) -> None:
        """Delete kept tables that nothing will read again."""
        for df in kept:
            for f in df.inputFiles()[:1]:
                self._delete(self.spark._jvm.org.apache.hadoop.fs.Path(f).getParent())

    def close(self) -> None:
        """Delete all tables of this scratch, once what was made of them is written."""
        self._delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.root))

    def _delete(self, path) -> None:
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores after it as it takes to clash with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def one_text_per_id(documents: DataFrame, *more: str) -> DataFrame:
    """The columns an operator needs; other columns, whatever their names, are left behind."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(c) for c in more])


def remainder(column: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n


def _row_bytes(df: DataFrame) -> Column | None:
    """Bytes that a row takes in a broadcast, with its strings; None for rows with arrays or maps, which are never broadcast."""
    if any(f.dataType.typeName() in ("array", "map") for f in df.schema.fields):
        return None
    size = F.lit(ROW_BYTES)
    for f in df.schema.fields:
        if f.dataType.typeName() in ("string", "binary", "struct"):
            size = size + F.coalesce(F.octet_length(F.to_json(f.name) if f.dataType.typeName() == "struct" else f.name), F.lit(0))
    return size


def checked_broadcast(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast a kept table if its rows, with their strings, take at most ``most`` bytes; else leave the shuffle join.

    The driver holds a broadcast table as well, so the bound does not grow with the cluster.
    """
    size = _row_bytes(df)
    if size is None:
        return df
    if not any(f.dataType.typeName() in ("string", "binary", "struct") for f in df.schema.fields):
        return F.broadcast(df) if df.limit(most // ROW_BYTES + 1).count() * ROW_BYTES <= most else df
    return F.broadcast(df) if (df.select(F.sum(size)).first()[0] or 0) <= most else df


def summed_arrays(df: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None]) -> np.ndarray | None:
    """Sum over partitions of one fixed-size array each, by a tree so that no node holds many of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = partial(batches)
        if out is not None:
            yield pa.record_batch({"a": pa.array([out.tobytes()], pa.binary()), "d": [out.dtype.str]})

    parts = df.mapInArrow(run, "a binary, d string").rdd.map(lambda r: np.frombuffer(bytes(r["a"]), dtype=r["d"]))
    return tree_reduced(parts, _add)


def tree_reduced(values: RDD, add: Callable, fan: int = 8):
    """One value from all partitions (None if there is none); the driver gets the last alone, no task over ``fan`` partitions'."""

    def own(rows: Iterator) -> Iterator:
        total = None
        for x in rows:
            total = add(total, x)
        yield total

    n, values = values.getNumPartitions(), values.mapPartitions(own)
    while n > 1:
        n = -(-n // fan)
        values = values.mapPartitionsWithIndex(lambda i, rows, n=n: ((i % n, x) for x in rows)).reduceByKey(add, n).values()
    out = values.collect()
    return out[0] if out else None


def _add(x: np.ndarray | None, y: np.ndarray | None) -> np.ndarray | None:
    return y if x is None else x if y is None else x + y


BLOOM_BITS = 25


def bloom(ids: DataFrame, column: str) -> np.ndarray:
    """A bitmap of fixed size (4 MB) over the ids; it only prunes, an exact join follows."""

    def build(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        bits = np.zeros(1 << BLOOM_BITS, dtype=bool)
        for b in batches:
            for at in _bloom_slots(b.column(0).drop_null().to_numpy(zero_copy_only=False)):
                bits[at] = True
        return np.packbits(bits)

    def merge(x: np.ndarray | None, y: np.ndarray | None) -> np.ndarray | None:
        return y if x is None else x if y is None else x | y

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch({"a": pa.array([build(batches).tobytes()], pa.binary())})

    rows = ids.select(F.col(column).cast("long")).mapInArrow(run, "a binary").rdd
    out = tree_reduced(rows.map(lambda r: np.frombuffer(bytes(r["a"]), np.uint8)), merge)
    return np.zeros(1 << (BLOOM_BITS - 3), np.uint8) if out is None else out


def _bloom_slots(ids: np.ndarray) -> list[np.ndarray]:
    h = tc.mix(tc.unsigned(ids))
    return [(h >> np.uint64(64 - BLOOM_BITS)).astype(np.int64), (h & np.uint64((1 << BLOOM_BITS) - 1)).astype(np.int64)]


def bloom_has(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    out = np.ones(len(ids), dtype=bool)
    for at in _bloom_slots(ids):
        out &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return out


def pruned(df: DataFrame, key: str, ids: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` that may have a key among ``ids``: cut at the scan, so that wide rows are not shuffled in vain."""
    shared = df.sparkSession.sparkContext.broadcast(bloom(ids, column))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(b.schema.get_field_index(key))
            has = np.zeros(len(keys), bool)
            there = keys.is_valid().to_numpy(zero_copy_only=False)
            has[there] = bloom_has(shared.value, keys.drop_null().to_numpy(zero_copy_only=False))
            yield b.filter(pa.array(has))

    return df.mapInArrow(run, df.schema)


COMPONENT_ROUNDS = 100
EDGES_OF_A_TASK = 1 << 18


def stars(batches: Iterator[pa.RecordBatch], most: int = 2 * EDGES_OF_A_TASK) -> Iterator[pa.RecordBatch]:
    """(a, b): each node of the edges with the smallest node that they reach, if it is another; joined whole for up to ``most`` nodes."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    def told() -> pa.RecordBatch:
        nodes = [x for x in root if find(x) != x]
        out = pa.record_batch({"a": pa.array(nodes, pa.int64()), "b": pa.array([find(x) for x in nodes], pa.int64())})
        root.clear()
        return out

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
        if len(root) > most:  # bounds the memory of a partition of any size
            yield told()
    yield told()


def components(edges: DataFrame, scratch: Scratch, most: int = EDGES_OF_A_TASK, rows: int | None = None) -> DataFrame:
    """(node, component): the smallest node that edges (a, b) reach; alternating large-star and small-star steps.

    Up to ``most`` edges are joined by a single task at once, which takes tens of megabytes; where ``rows``, the
    number of edges in a kept table, says so beforehand, nothing else is run.

    Each step is a grouped minimum and a join, so a node with any number of neighbours is spread over tasks.
    Partitions join what they can on their own before each round, which saves rounds.  Rounds go on until the
    edges, told by their number and the sum of their 64-bit fingerprints, no longer change.
    """
    if rows is not None and rows <= most <= EDGES_OF_A_TASK:
        return edges.select("a", "b").coalesce(1).mapInArrow(stars, "a long, b long").toDF("node", "component")

    def large_star(e: DataFrame) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        return down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))

    def kept(e: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        e = e.filter("a <> b").distinct().observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s"))
        return scratch.keep(e, "edges"), tuple(seen.get.values())

    now, before = kept(edges.select("a", "b").mapInArrow(stars, "a long, b long"))
    for _ in range(COMPONENT_ROUNDS):
        if not before[0]:
            break
        then = now
        if before[0] <= most:
            now, _ = kept(then.coalesce(1).mapInArrow(stars, "a long, b long"))
            scratch.drop(then)
            break
        now, after = kept(small_star(large_star(then)).mapInArrow(stars, "a long, b long"))
        scratch.drop(then)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {COMPONENT_ROUNDS} rounds")
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))


FILL_BITS = 12


def most_frequent(counts: DataFrame, column: str, most: int) -> DataFrame:
    """The rows of largest ``column``, at most ``most``: whole bins of its logarithm, and of the bin that the bound cuts
    those of the smallest hashes, as many ranges of hashes as fit; so no ranking is gathered anywhere."""
    bin_of = F.floor(F.log2(F.col(column).cast("double")) * 64)
    bins = sorted(((r["b"], r["n"]) for r in counts.groupBy(bin_of.alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True)
    total, cut = 0, None
    for b, n in bins:
        if total + n > most:
            break
        total, cut = total + n, b
    else:
        return counts
    whole = F.lit(False) if cut is None else bin_of >= cut
    hashed = F.shiftrightunsigned(F.xxhash64(*[f.name for f in counts.schema.fields if f.dataType.typeName() != "map"]), 64 - FILL_BITS)
    ranges = sorted((r["h"], r["n"]) for r in counts.filter(bin_of == b).groupBy(hashed.alias("h")).agg(F.count("*").alias("n")).collect())
    last = -1
    for h, n in ranges:
        if total + n > most:
            break
        total, last = total + n, h
    return counts.filter(whole | ((bin_of == b) & (hashed <= last)))
