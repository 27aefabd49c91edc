"""Mixed similarity retrieval: nearest to each query and to their mean, per split, then over all.

``retrieve`` scans the vectors once: each task keeps the best rows of every split it meets, for each query and for the
mean, and only those leave it; the lists of tasks are merged by salts first, so that no task gets all lists of a split.

Defined cases: vectors that are null, of another length than the queries' or with a null, NaN or infinite component
take no part, nor do such queries; zero vectors have similarity 0; in ``retrieve`` rows without a split or a position
take no part; without queries nothing is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import keep

MOST_QUERIES = 4096
SALTS = 64
#: Bins of similarities for each unit of them.
BINS = 1 << 13
#: Pairs of a split and a query whose ends are broadcast at most.
MOST_ENDS = 1 << 18
MEAN = -1


def finite(embedding: str) -> Column:
    return F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def query_matrix(queries: DataFrame) -> np.ndarray:
    """The queries' unit vectors in order of fs_id (a checked handful); none if there is no usable query."""
    rows = queries.filter(F.col("embedding").isNotNull() & finite("embedding")).orderBy("fs_id").limit(MOST_QUERIES + 1).collect()
    if len(rows) > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} queries: retrieve in blocks of queries")
    q = np.array([r["embedding"] for r in rows], dtype=np.float64)
    return q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12) if len(rows) else np.zeros((0, 0))


def cosines(column: pa.Array, q: np.ndarray) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x @ q.T / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def similarities(corpus: DataFrame, queries: DataFrame, keys: tuple[str, ...], digits: int = 6) -> DataFrame:
    """Keys, sims (one per query in order of fs_id) and mean; the queries are a checked handful, the corpus is scanned once."""
    q = query_matrix(queries)
    if not len(q):
        return corpus.select(*keys, F.array().cast("array<double>").alias("sims"), F.lit(None).cast("double").alias("mean")).limit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = cosines(b.column(b.num_columns - 1), q)
            flat = pa.array(s.ravel())
            sims = pa.ListArray.from_arrays(pa.array(np.arange(0, s.size + 1, len(q)), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], sims, pa.array(s.mean(axis=1))], names=[*keys, "sims", "mean"])

    kept = corpus.filter((F.size("embedding") == q.shape[1]) & finite("embedding")).select(*keys, "embedding")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    out = kept.mapInArrow(run, f"{types}, sims array<double>, mean double")
    return out.select(*keys, F.transform("sims", lambda s: F.round(s, digits)).alias("sims"), F.round("mean", digits).alias("mean"))


def split_sizes(corpus: DataFrame, split: str) -> DataFrame:
    return corpus.groupBy(split).agg(F.count("*").cast("long").alias("n"))


def mixed_bounds(k: int, queries: int) -> tuple[int, int]:
    """Rows per query and rows of the mean that a request for k documents asks for."""
    total = int(k / 2 * 1.2)
    return total // queries, total


def per_query(sims: DataFrame, sizes: DataFrame, split: str, doc: str, queries: int, p: float) -> DataFrame:
    """fs, split, doc, sim: best of each query within splits, a share p of them, with no other bound.

    Similarities are counted by bins first, which gives for each split and query the bin in which its share ends; rows
    in better bins are taken where they are, and only those of that bin are ranked.  So what leaves the scan are the
    rows taken and one bin, and no split is ranked whole.
    """
    bin_of = lambda sim: F.floor((1 - sim) * BINS).cast("int")
    long = sims.select(split, F.posexplode(F.transform("sims", bin_of)).alias("fs", "bin"))
    counts = long.groupBy(split, "fs", "bin").agg(F.count(F.lit(1)).alias("c")).join(F.broadcast(sizes), split)
    upto = F.sum("c").over(Window.partitionBy(split, "fs").orderBy("bin"))
    counts = counts.withColumn("before", upto - F.col("c")).withColumn("share", F.floor(F.lit(float(p)) * F.col("n") / queries / 2))
    # the last bin of which a share takes anything; one entry a query, those without any are null
    ends = counts.filter(F.col("before") < F.col("share")).groupBy(split, "fs").agg(F.max(F.struct("bin", (F.col("share") - F.col("before")).alias("left"))).alias("end"))
    ends = keep(ends.groupBy(split).agg(F.map_from_entries(F.collect_list(F.struct("fs", "end"))).alias("_ends")))
    few = ends.count() * queries <= MOST_ENDS
    each = F.transform("sims", lambda sim, f: F.struct(f.alias("fs"), sim.alias("sim"), F.col("_ends")[f].alias("end")))
    near = F.filter(each, lambda x: bin_of(x["sim"]) <= x["end"]["bin"])
    rows = sims.join(F.broadcast(ends) if few else ends, split).select(split, doc, F.explode(near).alias("x"))
    rows = keep(rows.select("x.fs", split, doc, "x.sim", (bin_of(F.col("x.sim")) == F.col("x.end.bin")).alias("last"), F.col("x.end.left").alias("left")))
    inside = Window.partitionBy(split, "fs").orderBy(F.desc("sim"), doc)
    edge = rows.filter("last").withColumn("rn", F.row_number().over(inside)).filter(F.col("rn") <= F.col("left"))
    return rows.filter(~F.col("last")).select("fs", split, doc, "sim").union(edge.select("fs", split, doc, "sim"))


def ranked(rows: DataFrame, split: str, doc: str, k: int) -> DataFrame:
    over = Window.partitionBy("fs").orderBy(F.desc("sim"), split, doc)
    return rows.withColumn("rank", F.row_number().over(over).cast("int")).filter(F.col("rank") <= k)


def rounded(s: np.ndarray, digits: int) -> np.ndarray:
    """Half away from zero, as Spark and SQL round."""
    return np.sign(s) * np.floor(np.abs(s) * 10.0**digits + 0.5) / 10.0**digits


class Best:
    """The ``most[f]`` best (similarity, position) of each ranking f of one split; equal ones go to the smaller position."""

    def __init__(self, most: list[int]):
        self.most = most
        self.held: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0, np.int64)) for _ in most]

    def add(self, sims: np.ndarray, docs: np.ndarray) -> None:
        """sims: rows x rankings."""
        for f, k in enumerate(self.most):
            s, d = sims[:, f], docs
            old, where = self.held[f]
            if len(old) == k:
                better = s >= (old[-1] if k else np.inf)
                s, d = s[better], d[better]
            if len(s):
                s, d = np.concatenate([old, s]), np.concatenate([where, d])
                top = np.lexsort((d, -s))[:k]
                self.held[f] = s[top], d[top]


def best_rows(corpus: DataFrame, queries: DataFrame, split: str, doc: str, each: int, total: int, digits: int = 6) -> DataFrame:
    """fs, split, doc, sim: of every split the ``each`` best of each query and the ``total`` best by mean (fs -1), from one scan.

    A task holds at most these rows for each split of its partition; ``doc`` is a number.
    """
    q, kind = query_matrix(queries), corpus.schema[split].dataType
    types = f"fs int, `{split}` {kind.simpleString()}, `{doc}` long, sim double"
    if not len(q):
        return corpus.sparkSession.createDataFrame([], types)
    most = [each] * len(q) + [total]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        arrow = None
        for b in batches:
            arrow = b.column(0).type
            s = cosines(b.column(2), q)
            s = rounded(np.concatenate([s, s.mean(axis=1, keepdims=True)], axis=1), digits)
            docs, names = b.column(1).to_numpy(zero_copy_only=False), b.column(0).dictionary_encode()
            codes = names.indices.to_numpy(zero_copy_only=False)
            for c, name in enumerate(names.dictionary.to_pylist()):
                own = codes == c
                best.setdefault(name, Best(most)).add(s[own], docs[own])
        for name, x in best.items():
            sizes = [len(d) for _, d in x.held]
            fs = np.repeat(np.array([*range(len(q)), MEAN], np.int32), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(fs), pa.array([name] * len(fs), arrow), pa.array(np.concatenate([d for _, d in x.held])), pa.array(np.concatenate([v for v, _ in x.held]))], names=["fs", split, doc, "sim"])

    kept = corpus.filter((F.size("embedding") == q.shape[1]) & finite("embedding") & F.col(split).isNotNull() & F.col(doc).isNotNull())
    tops = kept.select(split, F.col(doc).cast("long").alias(doc), "embedding").mapInArrow(run, types).withColumn("salt", F.spark_partition_id() % SALTS)
    bound = F.when(F.col("fs") == MEAN, total).otherwise(each)
    for keys in (("fs", split, "salt"), ("fs", split)):
        inside = Window.partitionBy(*keys).orderBy(F.desc("sim"), doc)
        tops = tops.withColumn("rn", F.row_number().over(inside)).filter((F.col("rn") <= max(each, total)) & (F.col("rn") <= bound))
    return tops.select("fs", split, doc, "sim", "rn")


def within_share(tops: DataFrame, corpus: DataFrame, split: str, queries: int, p: float) -> DataFrame:
    """Of ``best_rows`` those within a share of their split: p over all queries and the mean, half of it for the mean."""
    share = F.floor(F.lit(float(p)) * F.col("n") / F.when(F.col("fs") == MEAN, 1).otherwise(queries) / 2)
    return tops.join(F.broadcast(split_sizes(corpus, split)), split).filter(F.col("rn") <= share).drop("n", "rn")


def retrieve(corpus: DataFrame, queries: DataFrame, split: str, doc: str, p: float, k: int) -> DataFrame:
    """(split, doc) of the union of both rankings; as many as they hold, never cut to k."""
    n = len(query_matrix(queries))
    if not n:
        return corpus.select(split, doc).limit(0)
    each, total = mixed_bounds(k, n)
    tops = within_share(keep(best_rows(corpus, queries, split, doc, each, total)), corpus, split, n, p)
    near = ranked(tops.filter(F.col("fs") != MEAN), split, doc, each).select(split, doc)
    return near.union(tops.filter(F.col("fs") == MEAN).orderBy(F.desc("sim"), split, doc).limit(total).select(split, doc)).distinct()


def fetch(documents: DataFrame, hits: DataFrame, keys: list[str]) -> DataFrame:
    """The documents at the hits' positions; hits number about the k that was asked for."""
    return documents.join(hits.select(*keys).distinct(), keys, "left_semi")
