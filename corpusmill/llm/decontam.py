"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and benchmark items are normalised: ASCII lower case, runs of anything
but letters, digits and other scripts become one blank.  An item of m characters
may be matched with up to e = floor(``edit_rate`` m) edits (fewer if the lemma
would give nothing).  By the q-gram lemma a text region within e edits shares at
least m - q + 1 - q e q-grams with the item, all on diagonals at most e apart.
Shared q-grams are counted in diagonal bands 2 (e + 1) wide that overlap by half,
bands that reach the bound are retained, and each is verified by a banded
alignment; an item's edits in a text are the least of its bands.  Items of fewer
than q characters have no q-gram: they are matched verbatim, at word ends.

The benchmark is handled in blocks of ``block_bytes``, each broadcast and done
with before the next, so memory is bounded whatever the benchmark's size;
q-grams that many items share are counted in slices of ``POSTINGS``.

Defined cases: null and empty texts match nothing; items that are null or have
nothing left when normalised match nothing; an item is matched wherever it
stands in a text of any length; repeated rows and items are each reported; an
empty benchmark leaves all documents; other columns, whatever their names, are
left behind (``without_leaks`` keeps them all).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcols as tc
from .common import Scratch, checked_broadcast, fresh

Q = 12
EDIT_RATE = 0.05
BLOCK_BYTES = 2 << 20
POSTINGS = 1 << 21
TABLE_BITS = 22

_KEEP = np.zeros(256, dtype=bool)
_KEEP[ord("a") : ord("z") + 1] = True
_KEEP[ord("0") : ord("9") + 1] = True
_KEEP[0x80:] = True


def normalise(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes and offsets; every row ends in a blank unless it is empty."""
    low = tc.lower_ascii(raw)
    solid = _KEEP[low]
    low = np.where(solid, low, np.uint8(32))
    keep = solid.copy()
    keep[1:] |= solid[:-1]
    if len(raw):
        inner = at[(at > 0) & (at < len(raw))]
        keep[inner] = solid[inner]
    kept = np.concatenate([[0], np.cumsum(keep)])
    return low[keep], kept[at]


def characters(norm: np.ndarray) -> np.ndarray:
    """Where each character begins, and the end."""
    return np.append(np.flatnonzero((norm & 0xC0) != 0x80), len(norm))


@dataclass
class Index:
    ids: np.ndarray
    items: list[str]
    edits: np.ndarray
    bound: np.ndarray
    table: np.ndarray  # which slots of hashes any q-gram has
    grams: tc.HashIndex
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    short: dict[int, tuple[tc.HashIndex, list[list[int]]]]  # by length: short items' hashes and the items that have each


def build(items: list[tuple[int, str]], q: int = Q, edit_rate: float = EDIT_RATE) -> Index:
    ids, texts = [], []
    for k, text in items:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        norm, _ = normalise(raw, np.array([0, len(raw)]))
        if norm := norm.tobytes().decode().strip():
            ids.append(k)
            texts.append(norm)
    size = np.array([len(t) for t in texts], dtype=np.int64)
    edits = np.minimum((size * edit_rate).astype(np.int64), np.maximum(0, (size - q) // q))
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    at, begin = characters(raw), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    many = np.maximum(size - q + 1, 0)
    item = np.repeat(np.arange(len(texts)), many)
    place = np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
    pos, sums = begin[item] + place, tc.prefix_hash(raw)
    h = tc.span_hash(sums, at[pos], at[pos + q])
    order = np.argsort(h, kind="stable")
    keys, first = np.unique(h[order], return_index=True)
    table = np.zeros(1 << TABLE_BITS, dtype=bool)
    table[(keys >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
    short = {}
    for n in np.unique(size[size < q]):
        which = np.flatnonzero(size == n)
        own, back = np.unique(tc.span_hash(sums, at[begin[which]], at[begin[which] + n]), return_inverse=True)
        short[int(n)] = (tc.HashIndex(own), [which[back == k].tolist() for k in range(len(own))])
    return Index(np.array(ids, dtype=np.int64), texts, edits, size - q + 1 - q * edits, table, tc.HashIndex(keys), np.append(first, len(h)), item[order], place[order], short)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def aligned(item: str, region: str, edits: int) -> tuple[int, int] | None:
    """Edits and end of the best place of the item in the region, if within the budget.

    The region holds the diagonals of one band and the budget at either side, so
    the table is banded by its width; places may begin and end anywhere in it.
    It is shorter where the text begins or ends, down to too short for any place.
    """
    if len(region) < len(item) - edits:
        return None
    at = region.find(item)
    if at >= 0:
        return 0, at + len(item)
    if not edits:
        return None
    r = _codes(region)
    width = len(region) - len(item) + 2 * edits + 1  # diagonals from the budget below the first place to that above the last
    step = np.arange(width)
    big = 1 << 20
    row = np.zeros(width, dtype=np.int64)
    row[: edits] = big
    for i, ch in enumerate(_codes(item)):
        at = step - edits + i  # place in the region of each diagonal at this row
        ok = (at >= 0) & (at < len(r))
        same = np.where(ok, r[np.clip(at, 0, max(len(r) - 1, 0))] == ch, False)
        new = np.where(ok, row + ~same, big)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        row = np.minimum(np.minimum.accumulate(new - step) + step, big)
        row[at >= len(r)] = big  # past the region's end
        if row.min() > edits:
            return None
    best = int(row.argmin())
    return (int(row[best]), min(len(region), best - edits + len(item))) if row[best] <= edits else None


def matches(index: Index, raw: np.ndarray, at: np.ndarray, q: int = Q) -> list[tuple[int, int, int]]:
    """(row, item number, least edits) of all items found in the rows of a chunk."""
    norm, start = normalise(raw, at)
    if not len(norm) or not index.items:
        return []
    char, sums = characters(norm), tc.prefix_hash(norm)
    start = np.searchsorted(char, start)
    out = _short_matches(index, norm, char, sums, start)
    pos = np.arange(len(char) - q)
    h = tc.span_hash(sums, char[pos], char[pos + q])
    pos = np.flatnonzero(index.table[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
    gram = index.grams.find(h[pos])
    pos, gram = pos[gram >= 0], gram[gram >= 0]
    row = np.searchsorted(start, pos, "right") - 1
    inside = pos + q <= start[row + 1]
    least: dict[tuple[int, int], int] = {}
    for r, i, b in _bands(index, pos[inside], gram[inside], row[inside], start).T:
        if least.get((r, i)) == 0:
            continue
        e = int(index.edits[i])
        low = int(b) * (e + 1) - e
        high = (int(b) + 2) * (e + 1) + len(index.items[i]) + e
        lo, hi = start[r] + max(0, low), min(start[r + 1], start[r] + high)
        if (found := aligned(index.items[i], norm[char[lo] : char[hi]].tobytes().decode(), e)) is not None:
            least[r, i] = min(found[0], least.get((r, i), found[0]))
    return out + [(int(r), int(i), e) for (r, i), e in least.items()]


def _bands(index: Index, pos: np.ndarray, gram: np.ndarray, row: np.ndarray, start: np.ndarray) -> np.ndarray:
    """(row, item, band) that reach the bound; postings are counted in slices, and what a slice leaves of its last row goes on."""
    n = (index.first[gram + 1] - index.first[gram]).astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(n)])
    done, keys, count, lo = [], np.empty((3, 0), np.int64), np.empty(0, np.int64), 0
    while lo < len(pos):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + POSTINGS, "right")) - 1)
        m, g = n[lo:hi], gram[lo:hi]
        post = np.repeat(index.first[g], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        item, own = index.item[post], np.repeat(row[lo:hi], m)
        band = np.floor_divide(np.repeat(pos[lo:hi], m) - start[own] - index.place[post], index.edits[item] + 1)
        here = np.stack([np.concatenate([own, own]), np.concatenate([item, item]), np.concatenate([band, band - 1])])
        keys, count = _counted(np.concatenate([keys, here], axis=1), np.concatenate([count, np.ones(here.shape[1], np.int64)]))
        over = keys[0] < row[hi] if hi < len(pos) else np.ones(len(count), bool)
        done.append(keys[:, over & (count >= index.bound[keys[1]])])
        keys, count, lo = keys[:, ~over], count[~over], hi
    return np.concatenate([np.empty((3, 0), np.int64), *done], axis=1)


def _counted(keys: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort(keys[::-1])
    keys = keys[:, order]
    new = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
    return keys[:, new], np.add.reduceat(count[order], new)


def _short_matches(index: Index, norm: np.ndarray, char: np.ndarray, sums: np.ndarray, start: np.ndarray) -> list[tuple[int, int, int]]:
    if not index.short:
        return []
    blank = np.append(norm[char[:-1]] == 32, True)
    edge = np.zeros(len(blank), bool)
    edge[start] = True
    begins = np.flatnonzero(~blank[:-1] & (edge[:-1] | np.concatenate([[True], blank[:-2]])))
    row, out = np.searchsorted(start, begins, "right") - 1, set()
    for n, (hashes, items) in index.short.items():
        ok = begins + n <= start[row + 1]
        p, r = begins[ok], row[ok]
        whole = blank[p + n] | (p + n == start[r + 1])
        p, r = p[whole], r[whole]
        found = hashes.find(tc.span_hash(sums, char[p], char[p + n]))
        out |= {(int(x), k) for x, f in zip(r[found >= 0], found[found >= 0], strict=True) for k in items[f]}
    return [(r, k, 0) for r, k in sorted(out)]


def indexes(benchmark: DataFrame, q: int = Q, edit_rate: float = EDIT_RATE, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[Index, int]]:
    """Indices over blocks of items of bounded size, and the number of blocks."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes)
    for k in range(blocks):
        part = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield build([tuple(r) for r in part.toLocalIterator()], q, edit_rate), blocks


def find_leaks(documents: DataFrame, benchmark: DataFrame, q: int = Q, edit_rate: float = EDIT_RATE, key: str = "doc_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """key (doc_id), item_id, edits: each benchmark item found in each document."""
    spark, parts, scratch = documents.sparkSession, [], Scratch(documents.sparkSession)
    docs = documents.select(F.col(key).cast("long") if key == "doc_id" else F.col(key), F.col("text").cast("string").alias("text"))
    types = f"`{key}` {docs.schema[0].dataType.simpleString()}, item_id long, edits int"
    for index, blocks in indexes(benchmark, q, edit_rate, block_bytes):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i, _, raw, at in tc.row_chunks(b.column(1)):
                    hits = matches(shared.value, raw, at, q)
                    if hits:
                        rows, items, edits = map(np.array, zip(*hits, strict=True))
                        yield pa.record_batch({key: b.column(0).take(pa.array(rows + i)), "item_id": pa.array(shared.value.ids[items]), "edits": pa.array(edits.astype(np.int32))})

        found = docs.mapInArrow(run, types)
        if blocks > 1:  # one block's index at a time
            found = scratch.keep(found, "leaks")
            shared.destroy()
        parts.append(found)
    if not parts:
        return spark.createDataFrame([], types)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def leaked_documents(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per contaminated document: doc_id, item_ids (sorted), least edits."""
    return find_leaks(documents, benchmark).groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.min("edits").alias("least_edits"))


def without_leaks(documents: DataFrame, benchmark: DataFrame, q: int = Q, edit_rate: float = EDIT_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents in which no benchmark item is found, all columns kept; a scan without shuffle if the benchmark is one block.

    With more blocks, digests of texts with leaks are joined back.
    """
    spark = documents.sparkSession
    for index, blocks in indexes(benchmark, q, edit_rate, block_bytes):
        if blocks > 1:
            scratch, name = Scratch(spark), fresh(documents, "leaked")
            texts = documents.select(F.md5(F.col("text").cast("string")).alias("digest"), "text").filter("digest is not null")
            leaked = find_leaks(texts, benchmark, q, edit_rate, "digest", block_bytes).select(F.col("digest").alias(name)).distinct()
            leaked = checked_broadcast(scratch.keep(leaked, "leaked"))
            return documents.join(leaked, F.md5(F.col("text").cast("string")) == F.col(name), "left_anti")
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, dtype=bool)
                for i, _, raw, at in tc.row_chunks(b.column(b.schema.get_field_index("text"))):
                    for r, _, _ in matches(shared.value, raw, at, q):
                        keep[i + r] = False
                yield b.filter(pa.array(keep))

        return documents.mapInArrow(run, documents.schema)
    return documents
