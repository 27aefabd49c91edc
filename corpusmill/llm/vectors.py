"""Approximate nearest neighbours by additive quantisation.

A vector is coded as a sum of ``codebooks`` full-dimensional codewords, one of
each codebook.  Codebooks are fitted on residuals of a bounded sample
(``max_fit`` vectors, chosen by a hash of the id), then each anew in turn on what
the others leave of the sample's beam-searched codes; encoding searches a beam
over the codebooks in order.  Two norms are stored with a code: of the vector and
of its decoded form.  For a query the inner products with all codewords form a
lookup table; an approximate score is a sum of ``codebooks`` look-ups, times the
ratio of the norms, which gives the decoded vector its true length.  The
``rerank`` best per block are scored exactly in double precision.

Every vector is coded and lies in one coarse cell, that of the centroid with the
largest inner product less half its square.  A query looks into the cells whose
centroids have the largest inner products with it, as many as hold ``TARGET`` of
the exact neighbours of ``PROBED`` of the sample's vectors within the sample, and
on until they hold k + 1 candidates, so that no query is left short.  Real
neighbours are nearer than a sample's, so the share that is found does not fall
as the table grows.  There is a cell for each ``CELL_ROWS`` vectors, at most one
for each ``FIT_ROWS`` of the sample; beyond that, cells grow with the table.  A
cell is dealt in blocks of ``BLOCK_ROWS`` candidates and ``QUERY_ROWS`` queries,
whatever it holds, and the lists of blocks are merged per query; no list grows
with the table.  ``exhaustive`` looks into all cells; with a ``rerank`` of a
block's rows or more as well, the search is exact.

Equal vectors are one candidate with its k + 1 smallest ids, and one query; so
copies neither crowd out other neighbours nor make work.  Results go back to the
copies of a query by a join whose hot keys are broadcast: ``HOT_SHARE`` bounds
their number.

Defined cases: vectors that are null, zero, or hold null or non-finite
components take no part; a null id takes no part; vectors of another length than
most take no part; ties go to the smaller id; with fewer than k candidates all
are returned; rows of equal id
and vector are one row, rows of one id with other vectors are queries and
candidates each; an empty table gives no rows; other
columns, whatever their names, are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

K = 20
CODEBOOKS = 16
CODEWORDS = 256
BEAM = 4
RERANK = 512
MAX_FIT = 16384
BLOCK_ROWS = 16384
QUERY_ROWS = 1024
CELL_ROWS = 8192
FIT_ROWS = 16
PROBED = 512
TARGET = 0.98
HOT_SHARE = 1000


def _means(x: np.ndarray, group: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The mean of each group's vectors; a group without vectors keeps what it had before."""
    order, out = np.argsort(group, kind="stable"), before.copy()
    own, first, n = np.unique(group[order], return_index=True, return_counts=True)
    out[own] = np.add.reduceat(x[order], first, axis=0) / n[:, None]
    return out


@dataclass
class Quantiser:
    books: np.ndarray  # codebooks x codewords x dim, float32

    def encode(self, x: np.ndarray, beam: int = BEAM, rows: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes by beam search over residuals; norms of the vectors, and of the decoded ones."""
        m, c, dim = self.books.shape
        codes, norms, lengths = np.empty((len(x), m), np.uint8), np.empty(len(x), np.float32), np.empty(len(x), np.float32)
        square = (self.books**2).sum(axis=2)
        for lo in range(0, len(x), rows):
            part = x[lo : lo + rows].astype(np.float32)
            n = len(part)
            residual, error, path = part[:, None, :], np.zeros((n, 1), np.float32), np.zeros((n, 1, 0), np.uint8)
            for k in range(m):
                gain = error[:, :, None] + square[k] - 2 * residual @ self.books[k].T
                flat = gain.reshape(n, -1)
                width = min(beam, flat.shape[1])
                top = np.argpartition(flat, width - 1, axis=1)[:, :width]
                parent, word = top // c, top % c
                at = np.arange(n)[:, None]
                error = flat[at, top]
                residual = residual[at, parent] - self.books[k][word]
                path = np.concatenate([path[at, parent], word[:, :, None].astype(np.uint8)], axis=2)
            best = error.argmin(axis=1)
            codes[lo : lo + n] = path[np.arange(n), best]
            decoded = part - residual[np.arange(n), best]
            norms[lo : lo + n], lengths[lo : lo + n] = np.linalg.norm(part, axis=1), np.linalg.norm(decoded, axis=1)
        return codes, norms, lengths

    def scores(self, queries: np.ndarray, codes: np.ndarray, norms: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Approximate inner products, by lookup tables; queries x candidates."""
        out, rows = np.zeros((len(codes), len(queries)), np.float32), np.empty((len(codes), len(queries)), np.float32)
        for k, book in enumerate(self.books):
            np.take(book @ queries.astype(np.float32).T, codes[:, k], axis=0, out=rows, mode="clip")  # whole rows of the table
            out += rows
        out *= (norms / np.maximum(lengths, np.float32(1e-30)))[:, None]
        return np.ascontiguousarray(out.T)

    def refit(self, x: np.ndarray) -> None:
        """Each codebook in turn: the means of what the others leave of the vectors coded with a codeword."""
        codes, _, _ = self.encode(x)
        left = x.astype(np.float32) - sum(book[codes[:, k]] for k, book in enumerate(self.books))
        for k, book in enumerate(self.books):
            own = left + book[codes[:, k]]
            self.books[k] = _means(own, codes[:, k], book)
            left = own - self.books[k][codes[:, k]]


def fit(x: np.ndarray, codebooks: int = CODEBOOKS, codewords: int = CODEWORDS, rounds: int = 6, refits: int = 2, seed: int = 11) -> Quantiser:
    """Residual codebooks by k-means, then refitted on the beam's codes."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    words = min(codewords, max(1, len(x)))
    books = np.zeros((codebooks, words, x.shape[1]), np.float32)
    residual = x.copy()
    for k in range(codebooks):
        centres = residual[rng.choice(len(x), words, replace=False)].copy()
        for _ in range(rounds):
            near = ((centres**2).sum(axis=1) - 2 * residual @ centres.T).argmin(axis=1)
            centres = _means(residual, near, centres)
        near = ((centres**2).sum(axis=1) - 2 * residual @ centres.T).argmin(axis=1)
        books[k] = centres
        residual = residual - centres[near]
    out = Quantiser(books)
    for _ in range(refits):
        out.refit(x)
    return out


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest, all of the last rank's ties cut in order of place."""
    if len(scores) <= k:
        return np.arange(len(scores))
    if len(scores) >= 8 * k:  # an edge that some more than k are expected to pass, from every eighth
        some, m = scores[::8], k // 6 + 8
        passed = np.flatnonzero(scores >= np.partition(some, len(some) - m)[len(some) - m])
        if len(passed) >= k:
            return passed[_edge(scores[passed], k)]
    return _edge(scores, k)


def _edge(scores: np.ndarray, k: int) -> np.ndarray:
    if len(scores) <= k:
        return np.arange(len(scores))
    edge = -np.partition(-scores, k - 1)[k - 1]
    above = np.flatnonzero(scores > edge)
    return np.concatenate([above, np.flatnonzero(scores == edge)[: k - len(above)]])


def search_block(book: Quantiser, queries: np.ndarray, ids: list[np.ndarray], vectors: np.ndarray, codes: np.ndarray, norms: np.ndarray, lengths: np.ndarray, k: int, rerank: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each query the k nearest of a block of distinct vectors with their ids: (candidate ids, exact scores, whether the vector is the query's)."""
    out = []
    exact, size = vectors.astype(np.float64), np.array([len(i) for i in ids], np.int64)
    for lo in range(0, len(queries), 64):
        part = queries[lo : lo + 64]
        rough = book.scores(part, codes, norms, lengths)
        for q in range(len(part)):
            near = _top(rough[q], rerank)
            s = exact[near] @ part[q].astype(np.float64)
            if len(s) > k:
                near, s = near[wide := s >= -np.partition(-s, k - 1)[k - 1]], s[wide]
            found, score = np.concatenate([ids[g] for g in near]), np.repeat(s, size[near])
            same = np.repeat((exact[near] == part[q]).all(axis=1), size[near])
            best = np.lexsort((found, -score))[:k]
            out.append((found[best], score[best], same[best]))
    return out


@dataclass
class Cells:
    centroids: np.ndarray  # cells x dim, float32
    probes: int

    def of(self, x: np.ndarray) -> np.ndarray:
        return (x.astype(np.float32) @ self.centroids.T - (self.centroids**2).sum(axis=1) / 2).argmax(axis=1).astype(np.int32)

    def ranked(self, queries: np.ndarray) -> np.ndarray:
        """All cells in each query's order; queries x cells."""
        return np.argsort(-(queries.astype(np.float32) @ self.centroids.T), axis=1, kind="stable").astype(np.int32)

    def asked(self, queries: np.ndarray, held: np.ndarray, least: int) -> list[np.ndarray]:
        """The cells that each query looks into: ``probes``, or as many as it takes until they hold ``least`` candidates."""
        order = self.ranked(queries)
        short = (np.cumsum(held[order], axis=1) < least).sum(axis=1) + 1
        return [row[:n] for row, n in zip(order, np.maximum(short, self.probes), strict=True)]


def fit_cells(x: np.ndarray, cells: int, k: int, rounds: int = 10, seed: int = 13) -> Cells:
    """Centroids by k-means, and how many of them a query needs: enough for ``TARGET`` of the sample's own neighbours."""
    x = x.astype(np.float32)
    cells = max(1, min(cells, len(x)))
    out = Cells(x[np.random.default_rng(seed).choice(len(x), cells, replace=False)].copy(), cells)
    for _ in range(rounds if cells > 1 else 0):
        out.centroids = _means(x, out.of(x), out.centroids)
    if cells > 1 and len(x) > 1:
        near, some = out.of(x), np.arange(min(PROBED, len(x)))
        s = x[some] @ x.T
        s[some, some] = -np.inf
        best = np.argsort(-s, axis=1)[:, : min(k, len(x) - 1)]
        place = np.argsort(out.ranked(x[some]), axis=1)  # of each cell in the query's order
        need = np.sort(np.take_along_axis(place, near[best], axis=1).ravel())
        out.probes = int(need[min(len(need) - 1, int(np.ceil(TARGET * len(need))))]) + 1
    return out


def usable(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, v) of the rows that take part, and how many they are."""
    e = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    e = e.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0))
    sizes = e.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    return (e.filter(F.size("v") == sizes[0]["dim"]), sizes[0]["count"]) if sizes else (e.limit(0), 0)


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _first_ids(rows: DataFrame, n: int) -> DataFrame:
    """h, v, ids: each distinct vector with its ``n`` smallest ids; a vector's rows are cut to n before they are shuffled."""
    rows = rows.select(F.xxhash64("v").alias("h"), F.transform("v", lambda x: x + F.lit(0.0)).alias("v"), "vec_id")
    few = rows.withColumn("r", F.dense_rank().over(Window.partitionBy("h", "v").orderBy("vec_id"))).filter(F.col("r") <= n)
    return few.groupBy("h", "v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))


def nearest(embeddings: DataFrame, k: int = K, every: int = 20, rerank: int = RERANK, max_fit: int = MAX_FIT, exhaustive: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by inner product of each row whose id is divisible by ``every``."""
    spark = embeddings.sparkSession
    rows, n = usable(embeddings)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    scratch = Scratch(spark)
    sample = np.unique(_matrix(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max_fit).select("v").toArrow()["v"]), axis=0)
    sample = sample[np.random.default_rng(7).permutation(len(sample))]
    cells = fit_cells(sample, min(n // CELL_ROWS, len(sample) // FIT_ROWS), k)
    if exhaustive:
        cells.probes = len(cells.centroids)
    shared = spark.sparkContext.broadcast((fit(sample), cells))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, cells = shared.value
        for b in batches:
            x = _matrix(b.column(0))
            codes, norms, lengths = book.encode(x)
            yield pa.record_batch({"cell": cells.of(x), "v": b.column(0), "ids": b.column(1), "code": pa.array([c.tobytes() for c in codes], pa.binary()), "norm": norms, "length": lengths})

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked = shared.value[1].asked(_matrix(b.column(1)), held, k + 1)
            yield pa.record_batch({"h": b.column(0), "v": b.column(1), "query": b.column(2), "cells": pa.array(asked, pa.list_(pa.int32()))})

    coded = scratch.keep(_first_ids(rows, k + 1).select("v", "ids").mapInArrow(encode, "cell int, v array<double>, ids array<long>, code binary, norm float, length float"), "coded")
    held = np.zeros(len(cells.centroids), np.int64)  # candidates of each cell; one row a cell reaches the driver
    for r in coded.groupBy("cell").agg(F.sum(F.size("ids")).alias("n")).collect():
        held[r["cell"]] = r["n"]
    queries = rows.filter(F.col("vec_id") % every == 0).select("vec_id", F.xxhash64("v").alias("h"), F.transform("v", lambda x: x + F.lit(0.0)).alias("v")).distinct()
    distinct = queries.groupBy("h", "v").agg(F.min("vec_id").alias("query"), F.count("*").alias("copies"))
    asks = scratch.keep(distinct.select("h", "v", "query").mapInArrow(ask, "h long, v array<double>, query long, cells array<int>"), "asks")

    # blocks of both kinds in each cell; as many rows as there are cells, at most max_fit / FIT_ROWS
    sizes = coded.groupBy("cell").count().select("cell", F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("blocks"))
    asked = asks.select(F.explode("cells").alias("cell")).groupBy("cell").count().select("cell", F.ceil(F.col("count") / QUERY_ROWS).cast("int").alias("parts"))
    grid = F.broadcast(spark.createDataFrame(sizes.join(asked, "cell").collect(), "cell int, blocks int, parts int"))
    # within its cell every candidate goes once to each part of the queries, every query once to each block of candidates
    base = coded.join(grid, "cell").withColumn("block", F.pmod(F.xxhash64(F.col("ids")[0], F.lit(1)), F.col("blocks")).cast("int"))
    base = base.select("cell", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("query"), F.lit(None).cast("long").alias("h"), "v", "ids", "code", "norm", "length")
    turn = asks.select("query", "h", "v", F.explode("cells").alias("cell")).join(grid, "cell").withColumn("part", F.pmod(F.xxhash64("query", F.lit(2)), F.col("parts")).cast("int"))
    turn = turn.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "part", "query", "h", "v", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("binary").alias("code"), F.lit(0.0).cast("float").alias("norm"), F.lit(1.0).cast("float").alias("length"))

    def scan(table: pa.Table) -> pa.Table:
        asks = table["query"].is_valid().to_numpy()
        here, v = table.filter(pa.array(~asks)), _matrix(table["v"])
        who, found = table.filter(pa.array(asks)).select(["query", "h"]), []
        if len(who) and len(here):
            codes = np.frombuffer(b"".join(here["code"].to_pylist()), np.uint8).reshape(len(here), -1)
            ids = [np.array(i, np.int64) for i in here["ids"].to_pylist()]
            found = search_block(shared.value[0], v[asks], ids, v[~asks], codes, here["norm"].to_numpy(), here["length"].to_numpy(), k + 1, rerank)
        return pa.table({"query": who["query"][: len(found)], "h": who["h"][: len(found)], "ids": pa.array([i for i, _, _ in found], pa.list_(pa.int64())), "scores": pa.array([s for _, s, _ in found], pa.list_(pa.float64())), "same": pa.array([e for _, _, e in found], pa.list_(pa.bool_()))})

    lists = base.union(turn).groupBy("cell", "block", "part").applyInArrow(scan, "query long, h long, ids array<long>, scores array<double>, same array<boolean>")
    hits = lists.select("query", "h", F.explode(F.arrays_zip("ids", "scores", "same")).alias("x")).select("query", "h", F.col("x.ids").alias("i"), F.col("x.scores").alias("s"), F.col("x.same").alias("same"))
    best = hits.withColumn("r", F.row_number().over(Window.partitionBy("query", "h").orderBy(F.desc("s"), "i", "same"))).filter(F.col("r") <= k + 1)
    best = best.groupBy("query", "h").agg(F.sort_array(F.collect_list(F.struct("r", "i", "s", "same"))).alias("best"))

    # every copy of a query gets its list without its own id; vectors of over a thousandth of all queries are at most a thousand
    hot = F.col("copies") * HOT_SHARE > F.lit(-(-n // every))
    found = scratch.keep(distinct.join(best, ["query", "h"]).select("h", "v", hot.alias("hot"), "best"), "found")
    often = F.broadcast(found.filter("hot").select("h", "v", "best"))
    rest = queries.join(often.select("h", "v"), ["h", "v"], "left_anti").join(found.filter(~F.col("hot")).select("h", "v", "best"), ["h", "v"])
    every_one = queries.join(often, ["h", "v"]).unionByName(rest)
    own = F.slice(F.filter("best", lambda x: (x["i"] != F.col("vec_id")) | ~x["same"]), 1, k)
    listed = every_one.select(F.col("vec_id").alias("query_id"), F.posexplode(own).alias("place", "x"))
    return listed.select("query_id", (F.col("place") + 1).alias("rank"), F.col("x.i").alias("vec_id"), F.col("x.s").alias("score"))
