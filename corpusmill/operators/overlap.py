"""n-gram overlap of texts with a test set.

A small test set's n-grams are broadcast, and each text's are looked up where the text is.  Of a larger one a bitmap
of its n-grams' fingerprints is broadcast: only n-grams that may be in the test set leave a text, and they alone are
joined with it.  A bitmap's size is bounded; a test set too large for one is taken in parts, each with a pass of its own
over the texts.

Defined cases: null and short texts have no n-grams and are left out; rows with one
key count together; an empty test set gives no hits; other columns are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import hashed_ngrams

#: Fingerprints of a test set that are broadcast at most: 8 bytes each, some 64 MB as a hash table.
KNOWN = 2_000_000
#: Bits of a bitmap at most, 64 MB; and bits for each fingerprint, two of which it sets: about one in 30 others passes.
MAP_BITS = 29
BITS_EACH = 10


def _slots(g: np.ndarray, bits: int) -> list[np.ndarray]:
    h = g.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return [(h >> np.uint64(64 - bits)).astype(np.int64), (h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.int64)]


def bitmap(known: DataFrame, bits: int) -> np.ndarray:
    """A bit for each place that a fingerprint of ``known`` has; parts of it are put together by bitwise or, range by range."""
    words = 1 << max(0, bits - 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(np.concatenate(_slots(b.column(0).to_numpy(), bits)))
            block, place = at >> min(bits, 16), at & ((1 << min(bits, 16)) - 1)
            for k in np.unique(block):
                part = np.zeros(1 << min(bits, 16), bool)
                part[place[block == k]] = True
                yield pa.record_batch({"block": pa.array([k], pa.int64()), "part": pa.array([np.packbits(part).tobytes()], pa.binary())})

    def merged(parts: pa.Table) -> pa.Table:
        whole = np.bitwise_or.reduce([np.frombuffer(p, np.uint8) for p in parts["part"].to_pylist()])
        return pa.table({"block": parts["block"][:1], "part": pa.array([whole.tobytes()], pa.binary())})

    # fingerprints of a block meet in one task first, so that there is a part for each block and not for each batch
    dealt = known.select("g").repartition(max(1, min(words, 512)), F.shiftright("g", 40)) if words > 1 else known.select("g")
    out = np.zeros((words, (1 << min(bits, 16)) >> 3), np.uint8)
    for r in dealt.mapInArrow(run, "block long, part binary").groupBy("block").applyInArrow(merged, "block long, part binary").toLocalIterator():
        out[r["block"]] = np.frombuffer(r["part"], np.uint8)
    return out.ravel()


def may_be_known(texts: DataFrame, key: str, bits_of: np.ndarray, bits: int) -> DataFrame:
    """key, g: the n-grams (array g of texts) whose bits are set."""
    shared = texts.sparkSession.sparkContext.broadcast(bits_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = b.column(1)
            g = grams.flatten().to_numpy(zero_copy_only=False)
            has = np.ones(len(g), bool)
            for at in _slots(g, bits):
                has &= (shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
            at = np.flatnonzero(has)
            owner = np.searchsorted(grams.offsets.to_numpy() - grams.offsets[0].as_py(), at, "right") - 1
            yield pa.record_batch([b.column(0).take(pa.array(owner)), pa.array(g[at])], names=["key", "g"])

    return texts.select(F.col(key).alias("key"), "g").mapInArrow(run, f"key {texts.schema[key].dataType.simpleString()}, g long")


def ngram_hits(texts: DataFrame, tests: DataFrame, key: str, n: int = 5, text: str = "text") -> DataFrame:
    """key, n_grams, n_hits (distinct n-grams that the test set has); texts without n-grams are left out."""
    known = tests.select(F.explode(hashed_ngrams(F.col(text), n)).alias("g")).distinct()
    held = known.limit(KNOWN + 1).count()
    grams = texts.select(F.col(key), hashed_ngrams(F.col(text), n).alias("g"))
    if held <= KNOWN:
        told = F.broadcast(known.withColumn("hit", F.lit(1)))
        long = grams.select(key, F.explode("g").alias("g"))
        return long.join(told, "g", "left").groupBy(key).agg(F.count("*").alias("n_grams"), F.coalesce(F.sum("hit"), F.lit(0)).cast("long").alias("n_hits"))
    held = known.count()
    bits = min(MAP_BITS, int(np.ceil(np.log2(BITS_EACH * held))))
    passes = -(-BITS_EACH * held // (1 << bits))
    parts = [grams.filter(F.size("g") > 0).select(key, F.size("g").cast("long").alias("n_grams"), F.lit(0).cast("long").alias("n_hits"))]
    for k in range(passes):
        own = known.filter(F.pmod(F.xxhash64("g"), F.lit(passes)) == k)
        maybe = may_be_known(grams, key, bitmap(own, bits), bits).join(own, "g")
        parts.append(maybe.select(F.col("key").alias(key), F.lit(0).cast("long").alias("n_grams"), F.lit(1).cast("long").alias("n_hits")))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy(key).agg(F.sum("n_grams").alias("n_grams"), F.sum("n_hits").alias("n_hits"))


def overlap_rate(hits: DataFrame) -> DataFrame:
    """Share of texts with any hit, in percent."""
    return hits.agg(F.round(100.0 * F.avg((F.col("n_hits") > 0).cast("double")), 6).alias("overlap_percent"), F.count("*").alias("n_texts"))
