"""Removal of repeated byte strings by longest-previous-factor arrays.

A byte goes if a string of ``length`` bytes covers it that also starts earlier.
In suffix order the previous and the next suffix with a smaller position give a
suffix's longest previous factor; the byte's string is repeated if that factor
has ``length`` bytes or more.

One suffix array over the corpus would not fit a machine, so suffixes are dealt
to groups.  Every ``length``-byte string holds an anchor: the leftmost smallest
fingerprint among its ``GRAM``-byte strings.  Equal strings have equal anchors
at equal places, so all suffixes that can match meet in their anchor's group,
and about one position in 35 is an anchor.

1.  Anchors are shuffled by fingerprint with a fingerprint of their context (all
    ``length``-byte strings around them).  Alone, nothing repeats.  A later
    anchor with an equal context is covered whole, by streaming over sorted
    rows, so exact copies of any number are settled here.  Anchors that a sample
    shows to be hot are settled as far as a task can on its own before they are
    shuffled, and dealt by context as well; the sample only decides where rows go.
2.  First holders of contexts in groups with different contexts get their bytes
    back from the text.  The suffixes of a group are put in suffix order to depth
    ``length``; the array of longest common prefixes and the previous and next
    smaller positions give each suffix's longest previous factor.
3.  A group of over ``SPLIT`` contexts is split by content first: strings at
    ``BLOCK`` neighbouring places before the anchor have a stretch in common, and
    equal strings have equal stretches.  Copies of all that a block spans are
    settled by a grouped minimum; what is left goes, by stretch, through step 2.
    A stretch that more than ``SPLIT`` blocks share is split into its strings,
    for which the grouped minimum settles everything.
4.  Covered runs are merged per document and cut out.

Defined cases: null and empty texts lose nothing; texts are compared as UTF-8
bytes and never across documents; where ids repeat or are null, rows count as
separate documents in the order of id (null first), then text; an empty table
gives no rows; other columns, whatever their names, are left behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcols as tc
from .common import Scratch, one_text_per_id, pruned

LENGTH = 100
GRAM = 32
SPLIT = 512
BLOCK = 8
RANGE_CHARS = 64
SAMPLE = 64
HOT = 64
SALTS = 64
MOST_HOT = 4096
COMBINE = 1 << 18
SORT_CONTEXTS = 1024
SEGMENT = 1 << 21


def _window_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minima of all runs of ``size`` values."""
    out, width = x, 1
    while width * 2 <= size:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return out if width == size else np.minimum(out[: len(x) - size + 1], out[size - width :][: len(x) - size + 1])


def anchors(sums: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all anchors in a chunk of rows, and their fingerprints."""
    total = len(sums) - 1
    span = length - gram + 1
    if total < length:
        return np.empty(0, np.int64), tc.EMPTY_HASH
    marks = np.zeros(total, dtype=bool)
    low = np.uint64((1 << 22) - 1)
    for lo in range(0, total - length + 1, SEGMENT):
        hi = min(total - gram + 1, lo + SEGMENT + span - 1)
        pos = np.arange(lo, hi)
        key = (tc.span_hash(sums, pos, pos + gram) & ~low) | (pos - lo).astype(np.uint64)
        found = lo + (_window_min(key, span) & low).astype(np.int64)
        start = np.arange(lo, lo + len(found))
        row = np.searchsorted(at, start, "right") - 1
        marks[found[start + length <= at[row + 1]]] = True
    pos = np.flatnonzero(marks)
    return pos, tc.span_hash(sums, pos, pos + gram)


def _context(pos: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    row = np.searchsorted(at, pos, "right") - 1
    return row, np.maximum(at[row], pos + gram - length), np.minimum(at[row + 1], pos + length)


Batches = Iterator[pa.RecordBatch]


def _anchor_rows(docs: DataFrame, length: int, gram: int, salted: Callable[[Batches], Batches] | None = None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, _, raw, at in tc.row_chunks(b.column(1)):
                sums = tc.prefix_hash(raw)
                pos, h = anchors(sums, at, length, gram)
                if not len(pos):
                    continue
                row, start, end = _context(pos, at, length, gram)
                context = tc.mix(tc.span_hash(sums, start, end) + (pos - start).astype(np.uint64))
                yield pa.record_batch({"h": pa.array(tc.signed(h)), "context": pa.array(tc.signed(context)), "doc": b.column(0).take(pa.array(row + i)), "pos": pa.array((pos - at[row]).astype(np.int32)), "left": pa.array((pos - start).astype(np.int32)), "right": pa.array((end - pos).astype(np.int32))})

    types = "h long, context long, doc long, pos int, left int, right int"
    if salted is None:
        return docs.select("doc", "text").mapInArrow(run, types)
    return docs.select("doc", "text").mapInArrow(lambda batches: salted(run(batches)), f"{types}, salt long")


def _hot_anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Anchors that stand out in one of ``SAMPLE`` documents' texts, ``MOST_HOT`` at most: they are dealt to more tasks."""
    some = docs.filter(F.pmod(F.xxhash64("doc"), F.lit(SAMPLE)) == 0)
    counts = _anchor_rows(some, length, gram).groupBy("h").count().filter(F.col("count") >= HOT)
    return counts.orderBy(F.desc("count"), "h").limit(MOST_HOT).select("h")


def _dealt(docs: DataFrame, hot: DataFrame, length: int, gram: int) -> DataFrame:
    """Anchor rows with a salt, sorted in their tasks: -1; of hot anchors one by context, or under -1 for holders of a
    context that a task has seen earlier, which are covered for sure."""
    shared = docs.sparkSession.sparkContext.broadcast(tc.HashIndex(tc.unsigned(np.array([r["h"] for r in hot.collect()], np.int64))))

    def settled(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        h, context, doc, pos = (b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        order = np.lexsort((pos, doc, context, h))
        later = np.zeros(len(h), bool)
        later[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (context[order[1:]] == context[order[:-1]])
        spread = (tc.mix(tc.unsigned(doc)) % np.uint64(SALTS)).astype(np.int64)
        return b.append_column("salt", pa.array(np.where(later, -2 - spread, context % SALTS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            found = shared.value.find(tc.unsigned(b.column(0).to_numpy())) >= 0
            cold = b.filter(pa.array(~found))
            yield cold.append_column("salt", pa.array(np.full(cold.num_rows, -1)))
            if found.any():
                held.append(b.filter(pa.array(found)))
            if sum(x.num_rows for x in held) >= COMBINE:
                yield settled(held)
                held = []
        if held:
            yield settled(held)

    return _anchor_rows(docs, length, gram, run).repartition("h", "salt").sortWithinPartitions("h", "context", "doc", "pos")


def _settle(rows: DataFrame) -> DataFrame:
    """Over rows sorted by (h, context, doc, pos): later holders of a context as covered runs, first holders among
    different contexts as open, as those of hot anchors; both as (h, doc, pos, start, end, open)."""
    names = ["h", "context", "doc", "pos", "left", "right", "salt"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple[int, int] | None = None  # h and context of the last row
        kept: list[np.ndarray] | None = None  # the last first holder, whose successor is not known yet
        kept_open = False

        def told(cols: list[np.ndarray], open_: np.ndarray) -> pa.RecordBatch:
            h, _, doc, pos, left, right, _ = cols
            return pa.record_batch({"h": pa.array(h), "doc": pa.array(doc), "pos": pa.array(pos), "start": pa.array(pos - left), "end": pa.array(pos + right), "open": pa.array(open_)})

        for b in batches:
            cols = [b.column(b.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in names]
            if (sure := cols[6] < -1).any():
                yield told([c[sure] for c in cols], np.zeros(int(sure.sum()), bool))
                cols = [c[~sure] for c in cols]
            if not len(cols[0]):
                continue
            h, context = cols[0], cols[1]
            first = np.ones(len(h), dtype=bool)
            first[1:] = (h[1:] != h[:-1]) | (context[1:] != context[:-1])
            if before is not None:
                first[0] = (h[0], context[0]) != before
            before = (h[-1], context[-1])
            later = ~first
            if later.any():
                yield told([c[later] for c in cols], np.zeros(int(later.sum()), bool))
            firsts = [c[first] for c in cols]
            if kept is not None:
                firsts = [np.concatenate([k, c]) for k, c in zip(kept, firsts, strict=True)]
            if not len(firsts[0]):
                continue
            fh = firsts[0]
            same_next = np.append(fh[1:] == fh[:-1], False)
            open_ = same_next | np.concatenate([[kept_open], same_next[:-1]]) if kept is not None else same_next | np.concatenate([[False], same_next[:-1]])
            open_ |= firsts[6] >= 0
            sure = open_[:-1]
            if sure.any():
                yield told([c[:-1][sure] for c in firsts], np.ones(int(sure.sum()), bool))
            kept, kept_open = [c[-1:] for c in firsts], bool(open_[-1])
        if kept is not None and kept_open:
            yield told(kept, np.ones(1, bool))

    return rows.select(*names).mapInArrow(run, "h long, doc long, pos int, start int, end int, open boolean")


def longest_previous_factors(place: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """For each suffix, in suffix order, the longest prefix that it has in common with one at a smaller place.

    ``lcp`` is that with the suffix before.  The previous and the next smaller place are found by pointers that skip
    what others have skipped; a pointer stops once its common prefix is under ``least``, so factors shorter than that
    are told as 0.
    """
    n = len(place)
    best = np.zeros(n, np.int64)
    for step in (-1, 1):
        to = np.arange(n) + step
        common = lcp.copy() if step < 0 else np.append(lcp[1:], 0)
        live = np.flatnonzero((to >= 0) & (to < n) & (common >= least))
        dead = np.ones(n, bool)
        dead[live] = False
        while len(live):
            smaller = place[to[live]] < place[live]
            found = live[smaller]
            best[found] = np.maximum(best[found], common[found])
            live = live[~smaller]
            # pointers of suffixes that have stopped lead to prefixes under the least, and so do those that pass them
            via = to[live]
            ok = ~dead[via]
            gone, live, via = live[~ok], live[ok], via[ok]
            dead[gone] = True
            common[live], to[live] = np.minimum(common[live], common[via]), to[via]
    return best


def repeated_windows(group: np.ndarray, doc: np.ndarray, start: np.ndarray, texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start) of the strings that start earlier in their group; ``start`` is where each context begins.

    All suffixes of the contexts with ``length`` bytes left are put in order to
    that depth, groups apart and positions breaking ties.  Those whose longest
    previous factor has ``length`` bytes are repeated.
    """
    size = np.array([len(t) for t in texts], dtype=np.int64)
    fits = np.maximum(0, size - length + 1)
    if not fits.sum():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    raw = np.frombuffer(b"".join(texts), np.uint8) + np.uint8(1)  # UTF-8 never has 0xFF, so no byte becomes 0
    begin = np.concatenate([[0], np.cumsum(size)])[:-1]
    own = np.repeat(np.arange(len(texts)), fits)
    shift = np.arange(len(own)) - np.repeat(np.cumsum(fits) - fits, fits)
    _, number = np.unique(group, return_inverse=True)
    place = start[own] + shift
    by_place = np.lexsort((place, doc[own], number[own]))
    g, d, s = number[own][by_place], doc[own][by_place], place[by_place]
    new = np.ones(len(s), dtype=bool)  # contexts of one document overlap and share suffixes
    new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1]) | (s[1:] != s[:-1])
    by_place = by_place[new]
    key = np.empty((len(by_place), length + 4), dtype=np.uint8)
    for k in range(4):
        key[:, k] = number[own[by_place]] // 250 ** (3 - k) % 250 + 1
    key[:, 4:] = np.lib.stride_tricks.sliding_window_view(raw, length)[begin[own[by_place]] + shift[by_place]]
    order = np.argsort(key.view(f"S{length + 4}").ravel(), kind="stable")
    key = key[order]
    differ = key[1:] != key[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), length + 4) - 4
    factor = longest_previous_factors(order, np.concatenate([[0], np.maximum(lcp, 0)]), length)
    repeated = by_place[order[factor >= length]]
    return doc[own][repeated], place[repeated]


def _runs(doc: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merged runs of strings from (doc, start)."""
    order = np.lexsort((start, doc))
    d, s = doc[order], start[order]
    new = np.ones(len(d), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] > s[:-1] + length)
    first = np.flatnonzero(new)
    return d[first], s[first], s[np.append(first[1:], len(d)) - 1] + length


def _compare(contexts: DataFrame, length: int) -> DataFrame:
    """(doc, start, end) covered within groups; rows (h, doc, start, bytes) sorted by h."""

    def flush(held: list[tuple]) -> pa.RecordBatch | None:
        h, doc, start = (np.array(x, dtype=np.int64) for x in list(zip(*held, strict=True))[:3])
        d, s = repeated_windows(h, doc, start, [x[3] for x in held], length)
        if not len(d):
            return None
        d, s, e = _runs(d, s, length)
        return pa.record_batch({"doc": pa.array(d), "start": pa.array(s.astype(np.int32)), "end": pa.array(e.astype(np.int32))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if len(held) >= SORT_CONTEXTS and row[0] != held[-1][0]:
                    out = flush(held)
                    held = []
                    if out is not None:
                        yield out
                held.append(row)
        if held and (out := flush(held)) is not None:
            yield out

    return contexts.mapInArrow(run, "doc long, start int, end int")


def _places(docs: DataFrame, open_: DataFrame) -> DataFrame:
    """doc, text and the open contexts (h, start, end, pos) in it."""
    wanted = open_.groupBy("doc").agg(F.collect_list(F.struct("h", "start", "end", "pos")).alias("at"))
    return pruned(docs.select("doc", "text"), "doc", open_, "doc").join(wanted, "doc").select("doc", "text", "at")


def _own_places(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """Row, h, start, end, pos of the contexts of a batch, in pieces."""
    flat = b.column(2).flatten()
    columns = [flat.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("h", "start", "end", "pos")]
    own = np.repeat(np.arange(b.num_rows), b.column(2).value_lengths().to_numpy(zero_copy_only=False))
    for lo in range(0, len(own), 1 << 13):
        yield own[lo : lo + (1 << 13)], *(c[lo : lo + (1 << 13)] for c in columns)


def _contexts(docs: DataFrame, open_: DataFrame) -> DataFrame:
    """Bytes of open contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at = tc.text_buffers(b.column(1))
            for own, h, start, end, _ in _own_places(b):
                texts = [raw[at[r] + x : at[r] + y].tobytes() for r, x, y in zip(own, start, end, strict=True)]
                yield pa.record_batch({"h": pa.array(h), "doc": b.column(0).take(pa.array(own)), "start": pa.array(start), "bytes": pa.array(texts, pa.binary())})

    return _places(docs, open_).mapInArrow(run, "h long, doc long, start long, bytes binary")


def blocks_of(raw: np.ndarray, pos: np.ndarray, start: np.ndarray, end: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Blocks of the strings around anchors of one text; a string at place k starts k bytes before its anchor.

    Per block: number of its context, first place, number of strings, fingerprint of what its places have in common,
    that of what they span, whether all its places are there.
    """
    low, high = np.maximum(0, length - (end - pos)), np.minimum(length - gram, pos - start)
    n = np.where(low <= high, high // BLOCK - low // BLOCK + 1, 0)
    which = np.repeat(np.arange(len(pos)), n)
    number = low[which] // BLOCK + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    first, last = number * BLOCK, np.minimum(number * BLOCK + BLOCK - 1, length - gram)
    own_first, own_last = np.maximum(first, low[which]), np.minimum(last, high[which])
    p, whole, count = pos[which], (own_first == first) & (own_last == last), own_last - own_first + 1
    sums = tc.prefix_hash(raw)
    common = tc.mix(tc.span_hash(sums, p - first, p - last + length) + number.astype(np.uint64))
    # blocks at the end of a text have no whole stretch; theirs is not used
    spanned = tc.mix(tc.span_hash(sums, np.where(whole, p - last, p), np.where(whole, p - first + length, p)) + number.astype(np.uint64))
    return which, own_first, count, common, spanned, whole


def _blocks(docs: DataFrame, open_: DataFrame, length: int, gram: int) -> DataFrame:
    """common, spanned (null if not all there), doc, pos, start and bytes of each block; its strings start at its first bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, at = tc.text_buffers(b.column(1))
            for own, _, start, end, pos in _own_places(b):
                for r in np.unique(own):
                    mine = np.flatnonzero(own == r)
                    text = raw[at[r] : at[r + 1]]
                    which, first, count, common, spanned, whole = blocks_of(text, pos[mine], start[mine], end[mine], length, gram)
                    begin = pos[mine][which] - first - count + 1
                    held = [text[x : x + k - 1 + length].tobytes() for x, k in zip(begin, count, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(tc.signed(common)), pa.array(tc.signed(spanned), mask=~whole), b.column(0).take(pa.array(np.full(len(which), r))), pa.array(pos[mine][which]), pa.array(begin), pa.array(held, pa.binary())],
                        names=["common", "spanned", "doc", "pos", "start", "bytes"],
                    )

    return _places(docs, open_).mapInArrow(run, "common long, spanned long, doc long, pos long, start long, bytes binary")


def _split_runs(docs: DataFrame, open_: DataFrame, scratch: Scratch, length: int, gram: int) -> DataFrame:
    """(doc, start, end) covered within groups of any size, split by content."""
    blocks = scratch.keep(_blocks(docs, open_, length, gram), "blocks")
    here = F.struct("doc", "pos")
    holder = blocks.filter("spanned is not null").groupBy("spanned").agg(F.min(here).alias("holder"))
    marked = blocks.join(holder, "spanned", "left").withColumn("later", F.coalesce(here > F.col("holder"), F.lit(False)))
    marked = scratch.keep(marked.select("common", "doc", "start", "bytes", "later"), "marked")
    whole = marked.filter("later").select("doc", F.col("start").cast("int"), (F.col("start") + F.octet_length("bytes")).cast("int").alias("end"))
    # a later block has its holder among the others, so what they have in common is counted without it
    others = marked.filter("not later")
    shared = others.groupBy("common").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    others = scratch.keep(others.join(shared, "common").select("common", "doc", "start", "bytes", "k"), "others")
    compared = _compare(others.filter(F.col("k") <= SPLIT).select(F.col("common").alias("h"), "doc", "start", "bytes").repartition("h").sortWithinPartitions("h"), length)
    large = others.filter(F.col("k") > SPLIT)
    if not large.limit(1).count():
        return whole.union(compared)
    places = F.sequence(F.lit(0), F.octet_length("bytes") - length)
    single = large.select("doc", "start", F.posexplode(F.transform(places, lambda k: F.xxhash64(F.substring(F.col("bytes"), k + 1, length)))).alias("k", "h"))
    single = single.select("h", "doc", (F.col("start") + F.col("k")).alias("start")).distinct()
    first = single.groupBy("h").agg(F.min(F.struct("doc", "start")).alias("first"))
    again = single.join(first, "h").filter(F.struct("doc", "start") > F.col("first"))
    return whole.union(compared).union(again.select("doc", F.col("start").cast("int"), (F.col("start") + length).cast("int")))


def covered(docs: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc, start, end): runs of bytes that are repeated, possibly overlapping; docs: (doc, text) with unique doc."""
    rows = _dealt(docs, _hot_anchors(docs, length, gram), length, gram)
    settled = scratch.keep(_settle(rows), "settled")
    plain = settled.filter("not open and end - start >= {}".format(length)).select("doc", "start", "end")
    open_ = settled.filter("open and end - start >= {}".format(length)).select("h", "doc", "start", "end", "pos")
    heavy = open_.groupBy("h").count().filter(F.col("count") > SPLIT).select("h")
    few = open_.join(heavy, "h", "left_anti")
    many = open_.join(heavy, "h", "left_semi")
    compared = _compare(_contexts(docs, few).repartition("h").sortWithinPartitions("h"), length)
    parts = plain.union(compared)
    if heavy.limit(1).count():
        parts = parts.union(_split_runs(docs, many, scratch, length, gram))
    return parts


def _cut(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, bytes]:
    """Removed bytes, maximal removed runs, and what stays."""
    edge = np.zeros(len(raw) + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    gone = np.cumsum(edge[:-1]) > 0
    spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0]) if len(gone) else 0
    return int(gone.sum()), spans, np.frombuffer(raw, np.uint8)[~gone].tobytes()


def _unique(documents: DataFrame) -> DataFrame:
    """(doc, doc_id, text): doc is doc_id where ids are unique, else the place in the order of id, then text."""
    docs = one_text_per_id(documents)
    odd = docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1).count()
    if not odd:
        return docs.withColumn("doc", F.col("doc_id"))
    # ids of rows that are range-sorted rise from task to task and row to row; ranges are drawn by the beginnings of
    # texts, which have the order of the texts, so that no whole text is among the rows that are sampled for their bounds
    ranked = docs.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.substring("text", 1, RANGE_CHARS).asc_nulls_first())
    ranked = ranked.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return Scratch(docs.sparkSession).keep(ranked.withColumn("doc", F.monotonically_increasing_id()), "ranked")


def removals(documents: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    docs = _unique(documents)
    scratch = Scratch(docs.sparkSession)
    runs = scratch.keep(covered(docs, scratch, length, gram), "runs")
    per_doc = runs.groupBy("doc").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    rows = pruned(docs.select("doc", "text"), "doc", runs, "doc").join(per_doc, "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [_cut((t or "").encode(), s.values.to_numpy(), e.values.to_numpy()) for t, s, e in zip(b.column(1).to_pylist(), b.column(2), b.column(3), strict=True)]
            yield pa.record_batch({"cut_doc": b.column(0), "n_removed": pa.array([x[0] for x in out], pa.int64()), "n_spans": pa.array([x[1] for x in out], pa.int64()), "sha": [hashlib.sha256(x[2]).hexdigest() for x in out]})

    cut = rows.select("doc", "text", "starts", "ends").mapInArrow(run, "cut_doc long, n_removed long, n_spans long, sha string")
    text = F.coalesce("text", F.lit(""))
    main = docs.select("doc", "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("whole"))
    out = main.join(cut, F.col("doc") == F.col("cut_doc"), "left")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"))
