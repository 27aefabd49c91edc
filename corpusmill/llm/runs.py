"""Periodic stretches of words by Crochemore's partition refinement.

Positions of a text are in one class of level L if the L words from there on are
the same.  Level L + 1 follows from level L by splitting the classes of the
positions before those of the small classes: of the parts that a class has split
into, the largest needs no work, so every position is touched a logarithmic
number of times.  Each position knows the next one of its class; where that is
exactly L further on at level L, a square of period L starts there, and as no
member stands between, the period is the smallest.  Squares of one period that
start one after the other are one run.

Distances to the next member only grow with the level, so a square is noted when
the neighbour changes: it was one if its distance lies among the levels that it
lasted.  Classes are stretches of one array; a split moves what was touched to
the stretch's end.  Texts of an Arrow batch are refined together, each with an end
mark of its own, so no class reaches over two texts.  Levels that touch few
positions go position by position, others as whole numpy arrays.

Memory is some 60 bytes a word of ``BATCH_WORDS`` words, or of the longest text.
Words are compared by 64-bit fingerprints (``textcols``).

Defined cases: a null, empty or blank text has no words, no runs and an empty
collapsed text; rows with equal ids, or a null one, are handled each on its own;
an empty table gives no rows; ``find_runs`` leaves other columns behind.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textcols as tc
from .common import one_text_per_id
from .mixing import WORD

LEAST_WORDS = 12
BATCH_WORDS = 1 << 19
FEW = 24


def _spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... for ``size`` of each."""
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def _edges(*keys: np.ndarray) -> np.ndarray:
    """True where any key differs from the entry before."""
    new = np.ones(len(keys[0]), bool)
    if len(new) > 1:
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new


class Refinement:
    """Classes of positions of ``symbols``; equal symbols are equal words, and every text ends with a symbol of its own."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.members = np.argsort(symbols, kind="stable")
        new = _edges(symbols[self.members])
        first = np.flatnonzero(new)
        self.cls, self.slot = np.empty(n, np.int64), np.empty(n, np.int64)
        self.cls[self.members], self.slot[self.members] = np.cumsum(new) - 1, np.arange(n)
        self.first, self.size = np.zeros(n, np.int64), np.zeros(n, np.int64)  # classes never end, so there are n at most
        self.first[: len(first)], self.size[: len(first)] = first, np.diff(np.append(first, n))
        self.classes, self.level = len(first), 1
        self.next, self.prev, self.since = np.full(n, -1), np.full(n, -1), np.ones(n, np.int64)
        same = ~new[1:]
        self.next[self.members[:-1][same]], self.prev[self.members[1:][same]] = self.members[1:][same], self.members[:-1][same]
        self.plural = int((self.size[: self.classes] > 1).sum())
        self.small = np.arange(n)
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def squares(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and periods of all squares of smallest period."""
        while self.plural and len(self.small):
            x = self.small[self.small > 0] - 1
            x = x[self.size[self.cls[x]] > 1]
            self._few(x.tolist()) if len(x) <= FEW else self._many(x)
            self.level += 1
        if not self.found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([s for s, _ in self.found]), np.concatenate([p for _, p in self.found])

    def _note(self, at: np.ndarray) -> None:
        """The neighbours of these positions end with this level."""
        d = self.next[at] - at
        was = (d > 0) & (self.since[at] <= d) & (d <= self.level)
        if was.any():
            self.found.append((at[was], d[was]))

    def _many(self, x: np.ndarray) -> None:
        x = np.sort(x)
        c, after = self.cls[x], self.cls[x + 1]
        order = np.lexsort((after, c))  # stable: positions rise within a group
        x, c, after = x[order], c[order], after[order]
        head = _edges(c, after)
        group = np.cumsum(head) - 1
        start = np.flatnonzero(head)
        size, owner = np.diff(np.append(start, len(x))), c[start]
        own = _edges(owner)  # the first group of each class
        of = np.cumsum(own) - 1
        touched = np.add.reduceat(size, np.flatnonzero(own))
        rest = self.size[owner[own]] - touched
        # a class touched as a whole keeps its largest group as what is left
        by_size = np.lexsort((size, of))
        largest = by_size[np.flatnonzero(np.append(of[by_size][1:] != of[by_size][:-1], True))]
        stays = np.zeros(len(size), bool)
        stays[largest[rest == 0]] = True
        moves = ~stays[group]
        if not moves.any():
            self.small = x[:0]
            return
        x, group = x[moves], group[moves]
        groups = np.flatnonzero(~stays)
        size, owner, of = size[groups], owner[groups], of[groups]
        new = self.classes + np.arange(len(groups))
        self._unlink(x)
        head = _edges(group)
        self.next[x], self.prev[x] = -1, -1
        same = ~head[1:]
        self.next[x[:-1][same]], self.prev[x[1:][same]] = x[1:][same], x[:-1][same]
        self.since[x] = self.level + 1
        # what was touched goes to the end of its class, group by group
        parts = np.flatnonzero(_edges(of))
        gone, old = np.add.reduceat(size, parts), owner[parts]
        tail, place = self.first[old] + self.size[old] - gone, np.cumsum(gone) - gone
        target = _spans(tail, gone)
        into = self.slot[x] - np.repeat(tail, gone)
        here = np.zeros(len(target), bool)
        here[(np.repeat(place, gone) + into)[into >= 0]] = True
        stay, free = self.members[target[~here]], self.slot[x[into < 0]]
        self.members[free], self.slot[stay] = stay, free
        self.members[target], self.slot[x] = x, target
        self.cls[x] = np.repeat(new, size)
        n_parts, before = np.diff(np.append(parts, len(size))), np.cumsum(size) - size
        self.first[new], self.size[new] = np.repeat(tail - before[parts], n_parts) + before, size
        self.size[old] -= gone
        self.classes += len(groups)
        self.plural += int((size > 1).sum()) - int((self.size[old] == 1).sum())
        # of each split class all parts but the largest
        most = np.maximum.reduceat(size, parts)
        out = self.size[old] < most
        skip = np.zeros(len(size), bool)
        ranked = np.lexsort((size, of))
        last = ranked[np.flatnonzero(np.append(of[ranked][1:] != of[ranked][:-1], True))]
        skip[last[out]] = True
        self.small = np.concatenate([x[np.repeat(~skip, size)], self.members[_spans(self.first[old[out]], self.size[old[out]])]])

    def _unlink(self, x: np.ndarray) -> None:
        """Take positions out of their classes' chains, noting the neighbours that end."""
        self._note(x)
        x = x[np.lexsort((x, self.cls[x]))]
        joined = self.next[x[:-1]] == x[1:]
        before, after = self.prev[x[np.append(True, ~joined)]], self.next[x[np.append(~joined, True)]]
        there = before >= 0
        self._note(before[there])
        self.next[before[there]], self.since[before[there]] = after[there], self.level + 1
        self.prev[after[after >= 0]] = before[after >= 0]

    def _few(self, x: list[int]) -> None:
        cls, size, members, slot, nxt, prev, since, level = self.cls, self.size, self.members, self.slot, self.next, self.prev, self.since, self.level
        by: dict[int, dict[int, list[int]]] = {}
        for i in sorted(x):
            by.setdefault(int(cls[i]), {}).setdefault(int(cls[i + 1]), []).append(i)
        small: list[int] = []
        starts, periods = [], []

        def note(i: int) -> None:
            d = int(nxt[i]) - i
            if d > 0 and since[i] <= d <= level:
                starts.append(i)
                periods.append(d)

        for c, groups in by.items():
            parts = sorted(groups.values(), key=len)
            whole = int(size[c])
            left = whole - sum(map(len, parts))
            if not left:
                left = len(parts.pop())
            if not parts:
                continue
            self.plural -= left == 1
            for p in parts:
                new, self.classes = self.classes, self.classes + 1
                for i in p:
                    a, b = int(prev[i]), int(nxt[i])
                    note(i)
                    if a >= 0:
                        note(a)
                        nxt[a], since[a] = b, level + 1
                    if b >= 0:
                        prev[b] = a
                    end = int(self.first[c] + size[c]) - 1
                    other, at = int(members[end]), int(slot[i])
                    members[at], slot[other], members[end], slot[i] = other, at, i, end
                    size[c] -= 1
                    cls[i], since[i] = new, level + 1
                self.first[new], size[new] = self.first[c] + size[c], len(p)
                self.plural += len(p) > 1
                for i, j in itertools.pairwise([-1, *p, -1]):
                    if i >= 0:
                        nxt[i] = j
                    if j >= 0:
                        prev[j] = i
            if left >= len(parts[-1]):
                small += [i for p in parts for i in p]
            else:
                small += [i for p in parts[:-1] for i in p] + members[self.first[c] : self.first[c] + left].tolist()
        self.small = np.array(small, np.int64)
        if starts:
            self.found.append((np.array(starts), np.array(periods)))


def runs_of(symbols: np.ndarray, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and smallest periods of the runs of ``least`` symbols or more, by start and period."""
    at, period = Refinement(symbols).squares()
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    new = np.ones(len(at), bool)
    new[1:] = (period[1:] != period[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(at)))
    start, period = at[first], period[first]
    length = 2 * period + size - 1
    keep = np.flatnonzero(length >= least)
    keep = keep[np.lexsort((period[keep], start[keep]))]
    return start[keep], length[keep], period[keep]


def _symbols(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each (text, word), one more after each text; and where each text starts."""
    n, counts = len(rows) - 1, np.diff(rows)
    text = np.repeat(np.arange(n), counts)
    order = np.lexsort((words, text))
    number = np.empty(len(words), np.int64)
    number[order] = np.cumsum(_edges(text[order], words[order]))
    out = np.empty(len(words) + n, np.int64)
    at = rows + np.arange(n + 1)
    ends = at[1:] - 1
    out[ends] = -np.arange(1, n + 1)
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = number
    return out, at[:-1]


def _pieces(column: pa.Array, most: int = BATCH_WORDS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows from, to, their words and each row's first word; about ``most`` words, whole rows."""
    words, bounds, begin, held = [], [0], 0, 0
    for lo, hi, raw, at in tc.row_chunks(column):
        h, rows = tc.words(raw, at)
        if held and held + len(h) > most:
            yield begin, lo, np.concatenate(words), np.array(bounds)
            words, bounds, begin, held = [], [0], lo, 0
        words.append(h)
        bounds += (rows[1:] + held).tolist()
        held += len(h)
        if hi == len(column):
            yield begin, hi, np.concatenate(words), np.array(bounds)


def find_runs(documents: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), kept (the text without what a run repeats, words joined by a blank)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, words, rows in _pieces(b.column(1)):
                symbols, at = _symbols(words, rows)
                start, length, period = runs_of(symbols, least)
                drop = np.zeros(len(symbols) + 1, np.int64)
                np.add.at(drop, start + period, 1)
                np.add.at(drop, start + length, -1)
                stays = np.cumsum(drop[:-1]) == 0
                owner = np.searchsorted(at, start, "right") - 1
                offsets = np.searchsorted(owner, np.arange(hi - lo + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(start - at[owner]), pa.array(length), pa.array(period)], names=["start", "length", "period"]))
                texts = b.column(1).slice(lo, hi - lo).to_pylist()
                counts, kept = np.diff(rows), []
                for k, t in enumerate(texts):
                    own = (t or "").encode().split()
                    if offsets[k] < offsets[k + 1]:
                        own = itertools.compress(own, stays[at[k] : at[k] + counts[k]])
                    kept.append(b" ".join(own).decode())
                yield pa.record_batch({"doc_id": b.column(0).slice(lo, hi - lo), "n_words": pa.array(counts, pa.int64()), "runs": lists, "kept": pa.array(kept, pa.string())})
            tc.release()

    return one_text_per_id(documents).mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, kept string")


def planted(documents: DataFrame) -> DataFrame:
    """doc_id, text: in every document whose id's crc32 is divisible by ten, the words from a place on repeat a period; both follow from the crc32."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def periodic(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.when(n > 0, F.array_join(F.transform(w, lambda x, i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")).otherwise("")

    # the words are the one element of an array, so that they are split once a text and not once a word
    changed = F.element_at(F.transform(F.array(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))), periodic), 1)
    return one_text_per_id(documents).select("doc_id", F.when(h % 10 == 0, changed).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Per document: number of runs, the longest one (ties: smallest start, then period), digests of all runs and of what is kept."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    out = found.withColumn("best", longest)
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("kept", 256).alias("collapsed_sha256"),
    )
