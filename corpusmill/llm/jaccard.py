"""N-gram Jaccard join: linked texts by a prefix-tree join over globally ordered shingle sets.

A document's set holds its distinct ``size``-word shingles.  All sets are put in
one global order, rare shingles first: a count of all shingles in 2^20 slots
gives each shingle a level, and within a level the fingerprint decides.

1.  Equal sets form classes; only the smallest id of each class goes on.
2.  Similar sets share a shingle among their first |x| - ceil(t |x|) + 1 ones,
    so sets meet in the groups of these prefix shingles.  With each set goes an
    odd sketch: bits that hold the parity of the shingles hashed to them.  The
    bits in which two sketches differ are never more than the shingles in which
    the sets differ, so a pair with too many of them is dissimilar for sure.
3.  Neighbours within groups, a few in hash order, not pairs, are candidates.
    Candidate clusters, in chunks of bounded size, are loaded into tries over
    their globally ordered sets; every member walks the trie, sharing the
    overlap counted on common stems, and leaves a subtree as soon as the
    remaining lengths cannot reach the required overlap.
4.  Groups whose members are not all joined by then are looked into: sets
    outside a group's main component are held against all its sets.  Groups of
    up to ``SMALL`` sets give their pairs, of which sketches leave few; in larger
    groups sketches are compared in memory, and pairs become rows only if these
    allow it, of each set the ``NEAREST`` ones outside its component.  Of these
    the nearest go through the tries, which joins most of what is left; then all
    that are still apart do, and groups that had more candidates are looked into
    again, with ``WIDER`` times that limit, until no group has more.  So the rows
    of a pass grow with the sets that meet, not with their square.

Step 4 misses no pair: step 3 only saves work, and groups whose members are all
joined vanish before it, so a group of copies of any size costs its length, not
its square.  Groups over ``CELL`` rows are dealt to cells of at most that many
sets on either side.  Components come from alternating star steps on the links.

Defined cases: null and blank texts have an empty set and are linked with
nothing; fewer than ``size`` words give one shingle of the whole sequence;
rows with one doc_id are one node with the links of each of its texts; a row
with a null doc_id has a null component; an empty table gives no rows; other
columns, whatever their names, are left behind (``one_of_each`` keeps them all).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcols as tc
from .common import EDGES_OF_A_TASK, Scratch, bloom, bloom_has, components, fresh, one_text_per_id, stars, summed_arrays

SLOT_BITS = 20
CHAIN_RANK = 8
CHAIN_LAGS = 3
CHUNK_DOCS = 128
SMALL = 16
CELL = 4096
NEAREST = 4
WIDER = 16
SEGMENT = 64
SHINGLE_BYTES = 1 << 19
#: Bits of an odd sketch, and the largest set that is given so many.
SKETCHES = ((512, 150), (2048, 1000), (8192, 1 << 62))
NARROW, WIDE = SKETCHES[0][0], SKETCHES[-1][0]


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _batch_shingles(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for i, j, raw, at in tc.row_chunks(column, SHINGLE_BYTES):
        h, rows = tc.words(tc.lower_ascii(raw), at)
        s, owner = tc.shingles(h, rows, size)
        yield i, j, owner, s


def levels(documents: DataFrame, size: int) -> np.ndarray:
    """Per slot, how many times six standard deviations its count is over the mean, as a power of two; 1 MB whatever the input.

    Slots of rare shingles only are about Poisson, so a shingle stands out once its own count is six times the
    root of the mean; the mean of slots grows with the input, that bound with its root.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(1 << SLOT_BITS, dtype=np.float32)
        for b in batches:
            for _, _, _, s in _batch_shingles(b.column(0), size):
                total += np.bincount(_slots(s), minlength=1 << SLOT_BITS)
        return total

    total = summed_arrays(documents.select("text"), count)
    if total is None:
        return np.zeros(1 << SLOT_BITS, np.uint8)
    mean = max(4.0, float(np.median(total)))
    out = np.empty(len(total), np.uint8)
    for lo in range(0, len(total), 1 << 16):  # piece by piece, as this runs in the driver
        over = (total[lo : lo + (1 << 16)].astype(np.float64) - mean) / (6 * np.sqrt(mean))
        out[lo : lo + (1 << 16)] = np.where(over < 1, 0, np.log2(np.maximum(over, 1)).astype(np.int64) + 1)
    del total
    tc.release()
    return out


def _ordered(owner: np.ndarray, s: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row in global order."""
    owner, s = tc.distinct_pairs(owner, s)
    lev = level[_slots(s)]
    if lev.any():
        order = np.argsort(owner * 256 + lev, kind="stable")
        owner, s = owner[order], s[order]
    return owner, s


def odd_sketches(owner: np.ndarray, s: np.ndarray, rows: int, n: np.ndarray) -> list[bytes]:
    """A bit for each slot that an odd number of the row's shingles has; large sets have more slots."""
    slot = ((s >> np.uint64(20)) & np.uint64(WIDE - 1)).astype(np.int64)
    out: list[bytes] = [b""] * rows
    least = -1
    for bits, most in SKETCHES:
        mine = (n > least) & (n <= most)
        least = most
        which = np.flatnonzero(mine)
        place = np.cumsum(mine) - 1
        here = mine[owner]
        own, at = place[owner[here]], slot[here] % bits
        step = max(1, (1 << 19) // bits)
        for lo in range(0, len(which), step):
            part = which[lo : lo + step]
            i, j = np.searchsorted(own, [lo, lo + len(part)])
            odd = np.bincount((own[i:j] - lo) * bits + at[i:j], minlength=len(part) * bits) & 1
            packed = np.packbits(odd.astype(bool).reshape(len(part), bits), axis=1)
            for r, x in zip(part, packed, strict=True):
                out[r] = x.tobytes()
    return out


def profiles(documents: DataFrame, level, size: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, two fingerprints of the whole set, the set's prefix in global order and its odd sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, owner, s in _batch_shingles(b.column(1), size):
                owner, s = _ordered(owner, s, level.value)
                n = np.bincount(owner, minlength=j - i)
                first = np.concatenate([[0], np.cumsum(n)])
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(tc.mix(s * np.uint64(k)))]) for k in (3, 5)]
                a, c = (x[first[1:]] - x[first[:-1]] for x in sums)
                length = np.minimum(n, n - -(-percent * n // 100) + 1)
                keep = np.arange(len(s)) - first[owner] < length[owner]
                offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(tc.signed(s[keep])))
                sketch = pa.array(odd_sketches(owner, s, j - i, n), pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(tc.signed(a)), pa.array(tc.signed(c)), prefix, sketch], names=["doc_id", "n_shingles", "sig_a", "sig_b", "prefix", "sketch"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, sig_a long, sig_b long, prefix array<long>, sketch binary")


class Sets:
    """Sizes and sketches of sets that meet in a group."""

    def __init__(self, doc: np.ndarray, n: np.ndarray, sketch: pa.Array):
        self.doc, self.n = doc, n
        raw, at = tc.text_buffers(sketch.cast(pa.binary()))
        self.bits = np.diff(at) * 8
        self.tables: list[np.ndarray] = []  # by size of sketch: those of all sets with as many bits or more, folded
        self.rows: list[np.ndarray] = []
        for bits, _ in SKETCHES:
            here = np.flatnonzero(self.bits >= bits)
            table = np.zeros((len(here), bits // 8), np.uint8)
            for own in np.unique(self.bits[here]):  # slots of few bits are those of many bits folded
                which = np.flatnonzero(self.bits[here] == own)
                whole = raw[at[here[which]][:, None] + np.arange(own // 8)]
                table[which] = np.bitwise_xor.reduce(whole.reshape(len(which), -1, bits // 8), axis=1)
            rows = np.full(len(n), -1, np.int64)
            rows[here] = np.arange(len(here))
            self.tables.append(table.view(np.uint64))
            self.rows.append(rows)

    @property
    def narrow(self) -> np.ndarray:
        return self.tables[0]


def sketch_distance(x: Sets, i: np.ndarray, y: Sets, j: np.ndarray) -> np.ndarray:
    """At most the number of shingles in which sets i of x and j of y differ, pair by pair."""
    out = np.zeros(len(i), np.int64)
    for level, (bits, _) in enumerate(SKETCHES):
        both = np.flatnonzero(np.minimum(x.bits[i], y.bits[j]) == bits)
        for lo in range(0, len(both), 1 << 12):
            k = both[lo : lo + (1 << 12)]
            out[k] = np.bitwise_count(x.tables[level][x.rows[level][i[k]]] ^ y.tables[level][y.rows[level][j[k]]]).sum(axis=1, dtype=np.int64)
    return out


def _allowed(n1: np.ndarray, n2: np.ndarray, percent: int) -> np.ndarray:
    """Shingles in which sets of these sizes may differ; -1 where the sizes alone forbid a link."""
    fits = 100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)
    return np.where(fits, (n1 + n2) * (100 - percent) // (100 + percent), -1)


def close_pairs(probe: Sets, other: Sets, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in probe, place in other, sketch distance) of all pairs whose sizes and sketches allow a link."""
    order, by_n = np.argsort(probe.n, kind="stable"), np.argsort(other.n, kind="stable")
    sizes, found = other.n[by_n], []
    for lo in range(0, len(order), 64):
        p = order[lo : lo + 64]
        least, most = -(-percent * probe.n[p[0]] // 100), probe.n[p[-1]] * 100 // percent
        o = by_n[np.searchsorted(sizes, least) : np.searchsorted(sizes, most, "right")]
        if not len(o):
            continue
        d = np.bitwise_count(probe.narrow[p][:, None, :] ^ other.narrow[o][None, :, :]).sum(axis=2, dtype=np.int16)
        i, j = np.nonzero(d <= _allowed(probe.n[p][:, None], other.n[o][None, :], percent))
        found.append((p[i], o[j]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    d = sketch_distance(probe, i, other, j)
    ok = d <= _allowed(probe.n[i], other.n[j], percent)
    return i[ok], j[ok], d[ok]


class Trie:
    """Ordered sets as paths of segments; ``least`` and ``most`` bound the set sizes below a node."""

    def __init__(self):
        self.segment: list[np.ndarray] = [np.empty(0, np.int64)]
        self.kids: list[list[int]] = [[]]
        self.ends: list[list[int]] = [[]]
        self.least, self.most = [1 << 60], [0]

    def _node(self, segment: np.ndarray, n: int) -> int:
        self.segment.append(segment)
        self.kids.append([])
        self.ends.append([])
        self.least.append(n)
        self.most.append(n)
        return len(self.segment) - 1

    def add(self, path: np.ndarray, doc: int) -> None:
        n, at, done = len(path), 0, 0
        while True:
            self.least[at], self.most[at] = min(self.least[at], n), max(self.most[at], n)
            if done == n:
                self.ends[at].append(doc)
                return
            for place, k in enumerate(self.kids[at]):
                if self.segment[k][0] == path[done]:
                    break
            else:
                for stop in range(done, n, SEGMENT):
                    kid = self._node(path[stop : stop + SEGMENT], n)
                    self.kids[at].append(kid)
                    at = kid
                self.ends[at].append(doc)
                return
            seg = self.segment[k]
            m = min(len(seg), n - done)
            differ = np.flatnonzero(seg[:m] != path[done : done + m])
            same = int(differ[0]) if len(differ) else m
            if same < len(seg):
                top = self._node(seg[:same], self.least[k])
                self.most[top] = self.most[k]
                self.segment[k] = seg[same:]
                self.kids[top] = [k]
                self.kids[at][place] = top
                k = top
            at, done = k, done + same

    def walk(self, mask: np.ndarray, n: int, percent: int) -> list[int]:
        """Documents whose set has with ``mask`` (n set bits) a Jaccard similarity of percent / 100 or more."""
        found, stack = [], [(0, 0, 0)]
        while stack:
            at, overlap, depth = stack.pop()
            for doc in self.ends[at]:
                if overlap * (100 + percent) >= percent * (n + depth):
                    found.append(doc)
            for k in self.kids[at]:
                most, least = self.most[k], self.least[k]
                if most * 100 < percent * n or least * percent > n * 100:
                    continue
                seg = self.segment[k]
                o, d = overlap + int(np.count_nonzero(mask[seg])), depth + len(seg)
                if (o + min(most - d, n - o)) * (100 + percent) >= percent * (n + least):
                    stack.append((k, o, d))
        return found


def trie_links(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect whatever similar sets connect, one less than each group's members."""
    _, local = np.unique(np.concatenate(sets), return_inverse=True)
    cut = np.cumsum([len(s) for s in sets])[:-1]
    paths = np.split(local, cut)
    root = list(range(len(paths)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    trie, mask, out = Trie(), np.zeros(int(local.max()) + 1, dtype=bool), []
    for k, path in enumerate(paths):
        mask[path] = True
        for other in trie.walk(mask, len(path), percent):
            a, b = find(k), find(other)
            if a != b:
                root[a] = b
                out.append((int(ids[k]), int(ids[other])))
        mask[path] = False
        trie.add(path, k)
    return out


def _named_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, cluster and the cluster's number of other nodes, of all pairs at once."""
    links = pa.Table.from_batches(stars(batches))
    node, cluster = (links[k].to_numpy() for k in "ab")
    top, many = np.unique(cluster, return_counts=True)
    node, cluster = np.concatenate([node, top]), np.concatenate([cluster, top])
    yield pa.record_batch({"node": pa.array(node), "cluster": pa.array(cluster), "others": pa.array(many[np.searchsorted(top, cluster)])})


def _chunks(pairs: DataFrame, rows: int, scratch: Scratch, most: int = EDGES_OF_A_TASK) -> DataFrame:
    """node, cluster and chunk of the sets in candidate pairs; up to ``most`` pairs are named by one task, as in ``components``."""
    if rows <= most:
        nodes = pairs.select("a", "b").coalesce(1).mapInArrow(_named_chunks, "node long, cluster long, others long")
    else:
        cluster = scratch.keep(components(pairs, scratch), "cluster")
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        nodes = nodes.join(cluster, "node", "left").select("node", F.coalesce("component", "node").alias("cluster"))
        nodes = nodes.join(cluster.groupBy(F.col("component").alias("cluster")).agg(F.count(F.lit(1)).alias("others")), "cluster")
    return scratch.keep(nodes.select("node", "cluster", F.pmod(F.xxhash64("node"), F.ceil((F.col("others") + 1) / CHUNK_DOCS)).alias("chunk")), "nodes")


def _verified(pairs: DataFrame, documents: DataFrame, level, size: int, percent: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """Links (a, b) among the candidate pairs (a, b), through tries over chunks of their clusters, and their number."""
    pairs, seen = scratch.counted(pairs, "pairs")
    if not seen["rows"]:
        return pairs, 0
    nodes = _chunks(pairs, seen["rows"], scratch)
    left, right = (nodes.select(F.col("node").alias(x), F.col("chunk").alias(f"chunk_{x}"), F.col("cluster").alias(f"cluster_{x}")) for x in "ab")
    keyed = pairs.join(left, "a").join(right.drop("cluster_b"), "b").select("a", "b", F.col("cluster_a").alias("cluster"), F.least("chunk_a", "chunk_b").alias("i"), F.greatest("chunk_a", "chunk_b").alias("j"))
    members = keyed.select("cluster", "i", "j", F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    wanted = documents.sparkSession.sparkContext.broadcast(bloom(nodes, "node"))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            there = b.column(0).is_valid().to_numpy(zero_copy_only=False)
            has = np.zeros(b.num_rows, bool)
            has[there] = bloom_has(wanted.value, b.column(0).drop_null().to_numpy(zero_copy_only=False))
            b = b.filter(pa.array(has))
            for i, j, owner, s in _batch_shingles(b.column(1), size):
                owner, s = _ordered(owner, s, level.value)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=j - i))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(offsets), pa.array(tc.signed(s)))], names=["doc_id", "shingles"])

    sets = documents.select("doc_id", "text").mapInArrow(load, "doc_id long, shingles array<long>")

    def join(table: pa.Table) -> pa.Table:
        links = trie_links(table["doc_id"].to_numpy(), [s.values.to_numpy() for s in table["shingles"]], percent) if table.num_rows > 1 else []
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    grouped = sets.join(members, "doc_id").filter(F.size("shingles") > 0).groupBy("cluster", "i", "j")
    links, seen = scratch.counted(grouped.applyInArrow(join, "a long, b long").filter("a <> b"), "links")
    wanted.destroy()
    return links, seen["rows"]


def _meetings(heads: DataFrame) -> DataFrame:
    """Rows (h, doc_id, n, rank) of prefix shingles that more than one set may have.

    Rows are range-sorted by (h, doc_id), so a shingle of any frequency is spread over tasks; rows at the ends of a
    range are kept as well, as their neighbours are elsewhere.
    """
    rows = heads.select(F.posexplode("prefix").alias("rank", "h"), "doc_id", F.col("n").cast("int").alias("n"))
    rows = rows.repartitionByRange("h", "doc_id").sortWithinPartitions("h", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None  # a row whose successor is not known yet, and whether it has met its predecessor
        met = True
        for b in batches:
            if not b.num_rows:
                continue
            if last is not None:
                b = pa.Table.from_batches([last, b]).combine_chunks().to_batches()[0]
            h = b.column(0).to_numpy()
            same = np.concatenate([[met], h[1:] == h[:-1]])
            keep = same.copy()
            keep[:-1] |= same[1:]
            last, met = b.slice(b.num_rows - 1), bool(same[-1])
            yield b.slice(0, b.num_rows - 1).filter(pa.array(keep[:-1]))
        if last is not None:
            yield last

    return rows.select("h", "doc_id", "n", "rank").mapInArrow(run, "h long, doc_id long, n int, rank int")


def _chain(met: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets that stand next to each other in a group, in a hash order of its own, and whose sizes allow a link."""
    rows = met.filter(F.col("rank") < CHAIN_RANK).withColumn("at", F.xxhash64("h", "doc_id"))
    rows = rows.repartitionByRange("h", "at").sortWithinPartitions("h", "at", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for b in batches:
            cols = [b.column(k).to_numpy() for k in range(3)]
            new = 0 if tail is None else len(tail[0])
            h, doc, n = cols if tail is None else [np.concatenate(x) for x in zip(tail, cols, strict=True)]
            tail = [x[-CHAIN_LAGS:] for x in (h, doc, n)]
            found = []
            for lag in range(1, CHAIN_LAGS + 1):
                j = np.arange(max(lag, new), len(h))
                j = j[(h[j] == h[j - lag]) & (doc[j] != doc[j - lag]) & (_allowed(n[j], n[j - lag], percent) >= 0)]
                found.append((doc[j], doc[j - lag]))
            x, y = (np.concatenate(v) for v in zip(*found, strict=True))
            yield pa.record_batch({"a": pa.array(np.minimum(x, y)), "b": pa.array(np.maximum(x, y))})

    return rows.select("h", "doc_id", "n").mapInArrow(run, "a long, b long").distinct()


def _likely(pairs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, ...) with their sketch distance d, those only whose sketches allow a link."""
    x, y = (heads.select(F.col("doc_id").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"sketch_{k}")) for k in "ab")
    own = pairs.columns
    both = pairs.join(x, "a").join(y, "b").select(*own, "n_a", "n_b", "sketch_a", "sketch_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = lambda name: b.column(b.schema.get_field_index(name))
            one, two = (Sets(col(k).to_numpy(), col(f"n_{k}").to_numpy(), col(f"sketch_{k}")) for k in "ab")
            every = np.arange(b.num_rows)
            d = sketch_distance(one, every, two, every)
            ok = pa.array(d <= _allowed(one.n, two.n, percent))
            yield pa.RecordBatch.from_arrays([*(col(c).filter(ok) for c in own), pa.array(d).filter(ok)], names=[*own, "d"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return both.mapInArrow(run, f"{types}, d long")


def _by_key(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, from batches sorted by it."""
    held: list[pa.Table] = []
    key = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(b.schema.get_field_index(x)).to_numpy() for x in names])
        cuts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [b.num_rows]])
        table = pa.Table.from_batches([b])
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(keys[:, lo])
            if now != key and held:
                yield pa.concat_tables(held)
                held = []
            key = now
            held.append(table.slice(lo, hi - lo))
    if held:
        yield pa.concat_tables(held)


PAIR = "a long, b long, ca long, cb long"


def _small_groups(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, ca, cb) of sets in different components that meet in groups of up to ``SMALL`` sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for b in batches:
            cols = [b.column(k).to_numpy() for k in range(4)]
            new = 0 if tail is None else len(tail[0])
            h, doc, n, c = cols if tail is None else [np.concatenate(x) for x in zip(tail, cols, strict=True)]
            tail = [x[-SMALL:] for x in (h, doc, n, c)]
            found = []
            for lag in range(1, SMALL):
                j = np.arange(max(lag, new), len(h))
                j = j[h[j] == h[j - lag]]
                if not len(j):
                    break
                j = j[(c[j] != c[j - lag]) & (_allowed(n[j], n[j - lag], percent) >= 0)]
                i = j - lag
                i, j = np.where(doc[i] < doc[j], i, j), np.where(doc[i] < doc[j], j, i)
                found.append((doc[i], doc[j], c[i], c[j]))
            if found:
                four = np.unique(np.stack([np.concatenate(v) for v in zip(*found, strict=True)]), axis=1)
                yield pa.record_batch({k: pa.array(v) for k, v in zip(("a", "b", "ca", "cb"), four, strict=True)})

    rows = rows.select("h", "doc_id", "n", "c").repartition("h").sortWithinPartitions("h", "doc_id")
    return rows.mapInArrow(run, PAIR).filter("a <> b").distinct()


def _large_groups(rows: DataFrame, heads: DataFrame, percent: int, most: int) -> DataFrame:
    """Pairs (a, b, ca, cb, d) whose sketches allow a link, of sets in different components that meet in larger groups.

    Each set outside a group's main component is held against all its sets, in cells of at most ``CELL`` sets on either
    side, and gives its ``most`` nearest outside its component.  Groups with more have a row that names them (cut).
    """
    rows = rows.withColumn("at", F.xxhash64("doc_id")).join(heads.select("doc_id", F.col("n").cast("int").alias("n"), "sketch"), ["doc_id", "n"])
    sides = ["h", "doc_id", "n", "c", "sketch"]
    zero = F.lit(0).cast("long")
    copies = lambda x, many: F.explode(F.sequence(zero, x - 1)) if many else zero
    parts = []
    for many in (False, True):
        own = rows.filter("segments > 1" if many else "segments = 1")
        parts.append(own.filter("c <> main").select(*sides, F.lit(True).alias("probe"), F.pmod("at", "blocks").alias("i"), copies(F.col("segments"), many).alias("j")))
        parts.append(own.select(*sides, F.lit(False).alias("probe"), copies(F.col("blocks"), many).alias("i"), F.pmod("at", "segments").alias("j")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _by_key(batches, ["h", "i", "j"]):
            doc, n, c = (cell[x].to_numpy() for x in ("doc_id", "n", "c"))
            probe, sketch = cell["probe"].to_numpy(), cell["sketch"].combine_chunks()
            x, y = (Sets(doc[m], n[m], sketch.filter(pa.array(m))) for m in (probe, ~probe))
            cx, cy = c[probe], c[~probe]
            i, j, d = close_pairs(x, y, percent)
            ok = cx[i] != cy[j]
            i, j, d = i[ok], j[ok], d[ok]
            order = np.lexsort((y.doc[j], d, i))
            i, j, d = i[order], j[order], d[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < most
            cut = [] if keep.all() else [cell["h"][0].as_py()]
            i, j, d = i[keep], j[keep], d[keep]
            a, b, up = x.doc[i], y.doc[j], x.doc[i] < y.doc[j]
            six = [np.where(up, a, b), np.where(up, b, a), np.where(up, cx[i], cy[j]), np.where(up, cy[j], cx[i]), d]
            none = pa.nulls(len(cut), pa.int64())
            yield pa.record_batch({k: pa.concat_arrays([pa.array(v, pa.int64()), none]) for k, v in zip(("a", "b", "ca", "cb", "d"), six, strict=True)} | {"cut": pa.array([None] * len(i) + cut, pa.int64())})

    cells = parts[0]
    for part in parts[1:]:
        cells = cells.unionByName(part)
    cells = cells.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j")
    return cells.mapInArrow(run, f"{PAIR}, d long, cut long").filter("a is null or a <> b").distinct()


def _apart(met: DataFrame, heads: DataFrame, joined: DataFrame, percent: int, most: int, scratch: Scratch) -> tuple[DataFrame, dict[str, int]]:
    """Candidate pairs (a, b, ca, cb, d) of sets in different components ca and cb, and the groups that have more (cut); the
    number of all these rows and of the groups' (cuts).

    Only groups with more than one component count; the largest component of a large group meets the others, but not itself.
    """
    rows = _named(met, "doc_id", joined, "c").select("h", "doc_id", "n", "c")
    share = rows.groupBy("h", "c").agg(F.count(F.lit(1)).alias("k"))
    groups = share.groupBy("h").agg(F.count(F.lit(1)).alias("parts"), F.sum("k").alias("size"), F.max(F.struct("k", "c")).alias("top")).filter("parts > 1")
    groups = groups.select("h", "size", F.col("top.c").alias("main"), F.ceil(F.col("size") / CELL).alias("segments"), F.ceil((F.col("size") - F.col("top.k")) / CELL).alias("blocks"))
    rows, seen = scratch.counted(rows.join(groups, "h"), "open", large=F.col("size") > SMALL)
    pairs = _likely(_small_groups(rows.filter(F.col("size") <= SMALL), percent), heads, percent).withColumn("cut", F.lit(None).cast("long"))
    if seen["large"]:
        pairs = pairs.unionByName(_large_groups(rows.filter(F.col("size") > SMALL), heads, percent, most))
    return scratch.counted(pairs, "close", cuts=F.col("cut").isNotNull())


def _named(df: DataFrame, column: str, joined: DataFrame, name: str) -> DataFrame:
    """``df`` with the component of a column's sets; ``joined`` is kept, and marked for broadcast if it is small."""
    of = joined.select(F.col("node").alias(f"{name}_node"), F.col("component").alias(f"{name}_part"))
    out = df.join(of, F.col(column) == F.col(f"{name}_node"), "left")
    return out.withColumn(name, F.coalesce(f"{name}_part", column)).drop(f"{name}_node", f"{name}_part")


def link_components(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), one row per input row."""
    docs = one_text_per_id(documents)
    spark = docs.sparkSession
    scratch = Scratch(spark)
    level = spark.sparkContext.broadcast(levels(docs, size))
    profile = scratch.keep(profiles(docs, level, size, percent), "profiles")
    full = profile.filter("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("n_shingles", "sig_a", "sig_b").agg(F.min("doc_id").alias("rep"))
    same = full.select("doc_id", "n_shingles", "sig_a", "sig_b").join(classes, ["n_shingles", "sig_a", "sig_b"])
    same = scratch.keep(same.select("doc_id", "rep", "n_shingles", "sig_a", "sig_b"), "classes")
    reps = same.filter("doc_id = rep").select("doc_id", "n_shingles", "sig_a", "sig_b").distinct()
    # a doc_id with two rows of one class is one head: rows of a class have equal prefixes and sketches
    heads = full.join(reps, ["doc_id", "n_shingles", "sig_a", "sig_b"], "left_semi").dropDuplicates(["doc_id", "n_shingles", "sig_a", "sig_b"])
    heads = scratch.keep(heads.select("doc_id", F.col("n_shingles").alias("n"), "prefix", "sketch"), "heads")
    scratch.tidy()

    met = scratch.keep(_meetings(heads), "met")
    links, n = _verified(_likely(_chain(met, percent), heads, percent).select("a", "b"), docs, level, size, percent, scratch)
    joined, most = scratch.small(components(links, scratch, rows=n), "joined"), NEAREST
    scratch.tidy()
    close, seen = _apart(met, heads, joined, percent, most, scratch)
    scratch.tidy()
    if seen["rows"]:
        pairs = close.filter("cut is null").select("a", "b", "ca", "cb", "d")
        one = pairs.groupBy("a", "cb").agg(F.min(F.struct("d", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
        two = pairs.groupBy("b", "ca").agg(F.min(F.struct("d", "a")).alias("x")).select(F.col("x.a").alias("a"), "b")
        new, k = _verified(one.union(two).distinct(), docs, level, size, percent, scratch)
        links, n = links.union(new), n + k
        if k:
            joined = scratch.small(components(links, scratch, rows=n), "joined")
        rest = _named(_named(pairs.select("a", "b"), "a", joined, "ca"), "b", joined, "cb").filter("ca <> cb").select("a", "b")
        while seen["cuts"]:
            most *= WIDER
            cut = close.filter("cut is not null").select(F.col("cut").alias("h")).distinct()
            close, seen = _apart(met.join(cut, "h", "left_semi"), heads, joined, percent, most, scratch)
            rest = rest.union(close.filter("cut is null").select("a", "b"))
            if seen["cuts"]:
                new, k = _verified(rest.distinct(), docs, level, size, percent, scratch)
                links, n = links.union(new), n + k
                joined, rest = scratch.small(components(links, scratch, rows=n), "joined"), rest.limit(0)
        new, k = _verified(rest.distinct(), docs, level, size, percent, scratch)
        links, n = links.union(new), n + k
    level.destroy()  # all that reads it is written
    scratch.tidy()

    edges = same.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).union(links)
    found = components(edges, scratch)
    return profile.select("doc_id", "n_shingles").join(found, profile.doc_id == found.node, "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that are linked to one with a smaller id; of rows with one id, all stay or go."""
    gone_id = fresh(documents, "gone_id")
    gone = link_components(documents, size, percent).filter("doc_id <> component_id").select(F.col("doc_id").alias(gone_id)).distinct()
    gone = Scratch(documents.sparkSession).small(gone, "gone")
    return documents.join(gone, F.col("doc_id").cast("long") == F.col(gone_id), "left_anti")


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, hash(unnest(sh)) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
"""
ORACLE_SQL = "WITH RECURSIVE " + ORACLE_SQL.strip().removeprefix("WITH ") + r"""
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, u.b FROM r JOIN u ON r.reach = u.a)
SELECT n.doc_id, n.n AS n_shingles, min(reach) AS component_id FROM n JOIN r USING (doc_id) GROUP BY ALL
"""
