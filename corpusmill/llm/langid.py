"""Language identification, word first: known words, then ever shorter character n-grams.

A word is a run of letters (ASCII letters, lower-cased, or characters outside
ASCII).  Training counts, per language and over all training rows, words and
the n-grams of 1 to ``GRAMS`` characters inside words, with a mark at either end
of a word.  A word that training has seen adds its log frequency in each
language.  In an unseen word every position adds the log frequency of the
longest n-gram there that training has seen, and the word adds the mean over its
positions.

No word or n-gram is dropped.  The ``WORDS`` most frequent words and ``NGRAMS``
most frequent n-grams are broadcast, tables of bounded size; other words of a
text are joined with the counts by a shuffle, distinct unseen words are scored
once, and their n-grams outside the broadcast are looked up by a join as well.
Words and n-grams are told apart by 64-bit fingerprints of their bytes, and an
n-gram never leaves its word.  Log frequencies are whole numbers of millionths,
so sums do not depend on the order of rows or partitions.

Defined cases: null, empty and letterless texts give ``und`` with score 0;
rows whose language is null teach nothing; if no row has a language every text
gives ``und``; equal scores go to the language first in code-point order; an
empty table gives no rows; repeated rows count and are predicted each; other
columns, whatever their names, are left behind (``recognised`` keeps them all).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textcols as tc
from .common import Scratch, fresh, most_frequent, one_text_per_id, remainder

UND = "und"
GRAMS = 4
WORDS = 400_000
NGRAMS = 200_000
UNIT = 1_000_000
#: A text's evidence counts as that of so many words at most, so that scores of long texts are not all 1.
EVIDENCE = 30.0
HELD = 1 << 17
PIECE = 1 << 13

_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[0x80:] = True
_ASCII_LETTER = _LETTER.copy()
_ASCII_LETTER[0x80:] = False


@dataclass
class Lookup:
    """The part of the model that is broadcast: frequent words and n-grams with their logs (millionths) by language."""

    words: tc.HashIndex
    word_logs: np.ndarray
    grams: tc.HashIndex
    gram_logs: np.ndarray
    whole: bool  # whether all n-grams are here


@dataclass
class Model:
    langs: list[str]
    counts: DataFrame | None  # n (0: word), key, by (language number to count)
    mass: np.ndarray  # by n and language: what to divide counts by
    lookup: Lookup | None


def _letter_words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes with all but letters blanked, starts and ends of runs of letters, and each row's first run."""
    low = tc.lower_ascii(raw)
    low = np.where(_LETTER[low], low, np.uint8(32))
    return low, *tc.word_bounds(low, at)


def _marked(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words one after another, each between two marks, and where each begins (one entry more than words)."""
    size = ends - starts
    begin = np.concatenate([[0], np.cumsum(size + 2)])
    out = np.full(begin[-1], 32, dtype=np.uint8)
    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(begin[:-1] + 1, size) + step] = low[np.repeat(starts, size) + step]
    return out, begin


class Characters:
    """Characters of marked words, and their n-grams."""

    def __init__(self, buf: np.ndarray, begin: np.ndarray):
        first = np.flatnonzero((buf & 0xC0) != 0x80)
        self.at = np.append(first, len(buf))
        self.word_first = np.searchsorted(first, begin)
        self.word = np.repeat(np.arange(len(begin) - 1), np.diff(self.word_first))
        self.mark = buf[first] == 32
        self.sums = tc.prefix_hash(buf)
        # every character but the mark at the end is a position
        self.positions = np.setdiff1d(np.arange(len(first)), self.word_first[1:] - 1, assume_unique=True)

    def fits(self, p: np.ndarray, n: int) -> np.ndarray:
        return (p + n <= self.word_first[self.word[p] + 1]) & ((n > 1) | ~self.mark[p])

    def keys(self, p: np.ndarray, n: int) -> np.ndarray:
        return tc.span_hash(self.sums, self.at[p], self.at[p + n])


def _count(labelled: DataFrame, number: dict[str, int]) -> DataFrame:
    """n, key, lang, c: words (n = 0) and n-grams of all rows, added up as far as tasks can on their own."""
    L = len(number)

    def added(key: np.ndarray, lang: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
        u, first, back = np.unique(tc.combine([key, lang.astype(np.uint64)]), return_index=True, return_inverse=True)
        return first, np.bincount(back, weights=c, minlength=len(u)).astype(np.int64)

    def told(n: int, key: np.ndarray, lang: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch({"n": pa.array(np.full(len(key), n, np.int32)), "key": pa.array(tc.signed(key)), "lang": pa.array(lang.astype(np.int32)), "c": pa.array(c)})

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        h, lang, c, size = (np.concatenate([x[k] for x in held]) for k in range(4))
        raw = np.concatenate([x[4] for x in held])
        first, c = added(h, lang, c)
        yield told(0, h[first], lang[first], c)
        start, of = (np.cumsum(size) - size)[first], lang[first]
        parts: list[list[tuple]] = [[] for _ in range(GRAMS + 1)]
        for lo in range(0, len(first), PIECE):
            own = slice(lo, lo + PIECE)
            chars = Characters(*_marked(raw, start[own], start[own] + size[first[own]]))
            for n in range(1, GRAMS + 1):
                p = chars.positions[chars.fits(chars.positions, n)]
                key, at = chars.keys(p, n), of[own][chars.word[p]]
                once, total = added(key, at, c[own][chars.word[p]])
                parts[n].append((key[once], at[once], total))
        for n in range(1, GRAMS + 1):
            key, at, total = (np.concatenate(x) for x in zip(*parts[n], strict=True))
            once, total = added(key, at, total)
            yield told(n, key[once], at[once], total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            lang = np.array([number[x] for x in b.column(1).to_pylist()], dtype=np.int64)
            for i, j, raw, at in tc.row_chunks(b.column(0)):
                low, starts, ends, rows = _letter_words(raw, at)
                if not len(starts):
                    continue
                h = tc.span_hash(tc.prefix_hash(low), starts, ends)
                own = np.repeat(lang[i:j], np.diff(rows)) if L > 1 else np.zeros(len(h), np.int64)
                first, c = added(h, own, np.ones(len(h)))
                buf, begin = _marked(low, starts[first], ends[first])
                inner = np.ones(len(buf), dtype=bool)
                inner[begin[:-1]] = inner[begin[1:] - 1] = False
                held.append((h[first], own[first], c, np.diff(begin) - 2, buf[inner]))
                if sum(len(x[0]) for x in held) >= HELD:
                    yield from flush(held)
                    held = []
        if held:
            yield from flush(held)

    return labelled.select("text", "lang").mapInArrow(run, "n int, key long, lang int, c long")


def train(labelled: DataFrame, scratch: Scratch) -> Model:
    """The model of rows (text, lang); counts are a table, the driver gets bounded parts of it only."""
    rows = labelled.filter("text is not null and lang is not null")
    langs = sorted(r[0] for r in rows.select("lang").distinct().collect())
    if not langs:
        return Model([], None, np.zeros((0, 0)), None)
    # rows come added up by task; dealt by key once, they are grouped twice
    counts = _count(rows, {x: k for k, x in enumerate(langs)}).repartition("n", "key").groupBy("n", "key", "lang").agg(F.sum("c").alias("c"))
    counts = scratch.keep(counts.groupBy("n", "key").agg(F.sum("c").alias("total"), F.map_from_entries(F.collect_list(F.struct("lang", "c"))).alias("by")), "counts")
    types, mass = np.zeros(GRAMS + 1), np.zeros((GRAMS + 1, len(langs)))
    for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("k"), *[F.sum(F.element_at("by", F.lit(k))).alias(f"c{k}") for k in range(len(langs))]).collect():
        types[r["n"]] = r["k"]
        mass[r["n"]] = [r[f"c{k}"] or 0 for k in range(len(langs))]
    mass += 0.5 * types[:, None] + 1

    def table(some: DataFrame) -> tuple[tc.HashIndex, np.ndarray]:
        got = some.select("n", "key", *[F.coalesce(F.element_at("by", F.lit(k)), F.lit(0)).alias(f"c{k}") for k in range(len(langs))]).toArrow()
        n, keys = got["n"].to_numpy(), tc.unsigned(got["key"].to_numpy())
        logs = np.empty((len(n), len(langs)), np.int32)
        for k in range(len(langs)):  # a language at a time, as the driver's memory is bounded too
            logs[:, k] = np.round(np.log((got[f"c{k}"].to_numpy() + 0.5) / mass[n, k]) * UNIT)
        del got
        tc.release()
        return tc.HashIndex(keys), logs

    share = max(1, len(langs) // 8)  # the broadcast stays as large with many languages
    grams = table(most_frequent(counts.filter("n > 0"), "total", NGRAMS // share))
    return Model(langs, counts, mass, Lookup(*table(most_frequent(counts.filter("n = 0"), "total", WORDS // share)), *grams, len(grams[1]) == types[1:].sum()))


def _backoff(lookup: Lookup, buf: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, int, np.ndarray]]]:
    """Each position's word and place among the known n-grams (-1: none); and (positions, n, keys) of longer ones that are not there."""
    chars = Characters(buf, begin)
    p = chars.positions
    found, left, ask = np.full(len(p), -1, np.int64), np.arange(len(p)), []
    for n in range(GRAMS, 0, -1):
        here = left[chars.fits(p[left], n)]
        key = chars.keys(p[here], n)
        at = lookup.grams.find(key)
        found[here[at >= 0]] = at[at >= 0]
        if not lookup.whole:
            ask.append((here[at < 0], n, key[at < 0]))
        left = left[found[left] < 0]
    return chars.word[p], found, ask


def _position_logs(lookup: Lookup, found: np.ndarray) -> np.ndarray:
    return np.where(found[:, None] >= 0, lookup.gram_logs[np.maximum(found, 0)], 0) if len(lookup.gram_logs) else np.zeros((len(found), lookup.gram_logs.shape[1]), np.int64)


def _unseen_words(words: DataFrame, model: Model, shared: Broadcast) -> DataFrame:
    """h and logs (by language) of the unseen words (h, w)."""
    L = len(model.langs)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            h = b.column(0).to_numpy()
            for i, j, raw, at in tc.row_chunks(b.column(1), 1 << 16):
                buf, begin = _marked(raw, at[:-1], at[1:])
                yield h[i:j], *_backoff(shared.value, buf, begin)

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, word, found, _ in pieces(batches):
            sums = np.zeros((len(h), L), np.int64)
            np.add.at(sums, word, _position_logs(shared.value, found))
            yield pa.record_batch({"h": pa.array(h), "logs": _lists(sums // np.bincount(word, minlength=len(h))[:, None])})

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, word, found, ask in pieces(batches):
            where, keys = np.concatenate([x[0] for x in ask]), np.concatenate([x[2] for x in ask])
            n = np.concatenate([np.full(len(x[0]), x[1], np.int32) for x in ask])
            order = np.argsort(where, kind="stable")
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(where, minlength=len(word)))]).astype(np.int32))
            asked = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(n[order]), pa.array(tc.signed(keys[order]))], names=["n", "key"]))
            yield pa.record_batch({"h": pa.array(h[word]), "place": pa.array(np.arange(len(word)) - np.searchsorted(word, word)), "logs": _lists(_position_logs(shared.value, found)), "ask": asked})

    if model.lookup.whole:
        return words.select("h", "w").mapInArrow(means, "h long, logs array<long>")
    rows = words.select("h", "w").mapInArrow(positions, "h long, place long, logs array<long>, ask array<struct<n: int, key: long>>")
    rare = model.counts.filter("n > 0").select("n", "key", _logs(model, F.col("by"), F.col("n")).alias("found"))
    asked = rows.select("h", "place", F.inline("ask")).join(rare, ["n", "key"])
    longest = asked.groupBy("h", "place").agg(F.max(F.struct("n", "found"))["found"].alias("found"))
    best = rows.join(longest, ["h", "place"], "left").select("h", F.coalesce("found", "logs").alias("logs"))
    mean = [F.floor(F.sum(F.col("logs")[k]) / F.count(F.lit(1))).cast("long") for k in range(L)]
    return best.groupBy("h").agg(F.array(*mean).alias("logs"))


def _lists(table: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(table) + 1) * table.shape[1], pa.int32()), pa.array(table.ravel(), pa.int64()))


def _logs(model: Model, by: Column, n: Column) -> Column:
    """Logs by language, in millionths, of a word's or n-gram's counts."""
    mass = lambda k: F.element_at(F.array(*[F.lit(float(m)) for m in model.mass[:, k]]), n + 1)
    return F.array(*[F.round(F.log((F.coalesce(F.element_at(by, F.lit(k)), F.lit(0)) + 0.5) / mass(k)) * UNIT).cast("long") for k in range(len(model.langs))])


def _has_letter(low: bytes) -> bool:
    """Whether a text whose letters are all outside ASCII has a letter in Unicode's sense."""
    return any(ch.isalpha() for ch in low.decode("utf-8", "replace"))


def _known_words(documents: DataFrame, shared: Broadcast, keep: tuple[str, ...]) -> DataFrame:
    """Columns ``keep`` and row, letter (whether there is one), n_words, sums of known words' logs, and the other words with their number."""
    kept = documents.select(*keep, F.monotonically_increasing_id().alias("row"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for i, j, raw, at in tc.row_chunks(b.column(b.num_columns - 1)):
                low, starts, ends, rows = _letter_words(raw, at)
                h = tc.span_hash(tc.prefix_hash(low), starts, ends) if len(starts) else tc.EMPTY_HASH
                found = m.words.find(h)
                logs = np.zeros((len(h) + 1, m.word_logs.shape[1]), np.int64)
                logs[1:][found >= 0] = m.word_logs[found[found >= 0]]
                sums = np.cumsum(logs, axis=0)
                marks = np.concatenate([[0], np.cumsum(_ASCII_LETTER[low])])
                letter = marks[at[1:]] > marks[at[:-1]]
                for r in np.flatnonzero(~letter & (np.diff(rows) > 0)):
                    letter[r] = _has_letter(raw[at[r] : at[r + 1]].tobytes())
                new = np.flatnonzero(found < 0)
                own = np.repeat(np.arange(j - i), np.diff(rows))[new]
                _, first, back = np.unique(tc.combine([h[new], own.astype(np.uint64)]), return_index=True, return_inverse=True)
                many, order = np.bincount(back, minlength=len(first)), np.argsort(own[first], kind="stable")
                first, many = first[order], many[order]
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(own[first], minlength=j - i))]).astype(np.int32))
                buf = low.tobytes()
                words = pa.array([buf[s:e] for s, e in zip(starts[new[first]], ends[new[first]], strict=True)], pa.binary())
                rest = pa.StructArray.from_arrays([pa.array(tc.signed(h[new[first]])), words, pa.array(many)], names=["h", "w", "k"])
                out = [b.column(k).slice(i, j - i) for k in range(len(keep) + 1)]
                out += [pa.array(letter), pa.array(np.diff(rows)), _lists(sums[rows[1:]] - sums[rows[:-1]]), pa.ListArray.from_arrays(offsets, rest)]
                yield pa.RecordBatch.from_arrays(out, names=[*keep, "row", "letter", "n_words", "sums", "rest"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{types}, letter boolean, n_words long, sums array<long>, rest array<struct<h: long, w: binary, k: long>>")


def predict(documents: DataFrame, model: Model, scratch: Scratch, keep: tuple[str, ...] = ("doc_id",), shared: Broadcast | None = None) -> DataFrame:
    """Columns ``keep`` of each row with lang_pred and score, the share of the best language in all.

    ``shared``: the model's tables, from a caller who destroys them once the result is written.
    """
    if not model.langs:
        return documents.select(*keep, F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"))
    L = len(model.langs)
    shared = shared or documents.sparkSession.sparkContext.broadcast(model.lookup)  # once: the driver keeps each broadcast in memory
    rows = scratch.keep(_known_words(documents, shared, keep), "known")
    rest = rows.select("row", F.inline("rest"))
    words = rest.groupBy("h").agg(F.first("w").alias("w"))
    words = scratch.keep(words.join(model.counts.filter("n = 0").select(F.col("key").alias("h"), "by"), "h", "left"), "words")
    seen = words.filter("by is not null").select("h", _logs(model, F.col("by"), F.lit(0)).alias("logs"))
    logs = seen.union(_unseen_words(words.filter("by is null"), model, shared))
    added = rest.select("row", "h", "k").join(logs, "h").groupBy("row").agg(F.array(*[F.sum(F.col("k") * F.col("logs")[k]) for k in range(L)]).alias("added"))
    out = rows.drop("rest").join(added, "row", "left")
    out = out.withColumn("sums", F.when(F.col("added").isNull(), F.col("sums")).otherwise(F.zip_with("sums", "added", lambda x, y: x + y)))
    weight = F.least(F.lit(1.0), EVIDENCE / F.greatest(F.col("n_words"), F.lit(1))) / UNIT
    top = F.array_max("sums")
    share = 1.0 / F.aggregate("sums", F.lit(0.0), lambda acc, x: acc + F.exp((x - top) * weight))
    best = F.element_at(F.array(*[F.lit(x) for x in model.langs]), F.array_position("sums", top).cast("int"))
    return out.select(*keep, F.when(F.col("letter"), best).otherwise(UND).alias("lang_pred"), F.when(F.col("letter"), share).otherwise(0.0).alias("score"))


def identify(documents: DataFrame, fold: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from rows outside the held-out fold."""
    scratch = Scratch(documents.sparkSession)
    docs = one_text_per_id(documents, "lang").withColumn("lang", F.col("lang").cast("string")).withColumn("held_out", remainder(F.col("doc_id"), fold) == held)
    return predict(docs, train(docs.filter("not held_out"), scratch), scratch, ("doc_id", "held_out"))


def recognised(documents: DataFrame) -> DataFrame:
    """The documents whose language the model, learned from their own ``lang``, can tell: all but ``und``.

    A prediction depends on the text alone, so it is joined back by the text's digest; only digests of rejected
    texts are joined, and texts are not shuffled while these are few.
    """
    scratch = Scratch(documents.sparkSession)
    texts = documents.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).withColumn("digest", F.md5("text"))
    model = train(texts, scratch)
    scratch.tidy()
    shared = documents.sparkSession.sparkContext.broadcast(model.lookup)
    said = predict(texts, model, scratch, ("digest",), shared)
    name = fresh(documents, "rejected")
    rejected = scratch.small(said.filter((F.col("lang_pred") == UND) & F.col("digest").isNotNull()).select(F.col("digest").alias(name)).distinct(), "rejected")
    shared.destroy()  # the later stages have the driver's memory to themselves
    del model, said
    tc.release()
    return documents.filter(F.col("text").isNotNull()).join(rejected, F.md5(F.col("text").cast("string")) == F.col(name), "left_anti")
