"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

A token's probability is that of its class given the history times that of the
token given class and history.  The ``HEAD`` most frequent words fill classes of
at most ``WIDTH`` words with like neighbours; other words fall in tail classes by
their last bytes; the end of text is a class of its own.  Class scores sum
hashed weights of n-gram features (previous word, previous two) and skip
features (the word before the previous; first and third before); word scores
within a head class sum hashed weights of the previous word and the one before.
Within a tail class a word has its training share, less a discount that is left
to words training has not seen, so probabilities add up to at most 1.

Weights are trained by distributed gradient updates: in each round every
partition adds up gradients (observed less expected counts) and expected counts
over its share of the positions of every training text, those whose place in the
text has the round's residue modulo the number of rounds, so that the rounds
together take each position once; sums meet in a tree and each weight moves by
its gradient over its curvature.  Texts are tokenised once into word numbers, and scored in numpy
batches of ``BATCH`` tokens over the sparse sets of active feature rows.

Word counts, N and V cover all training texts.  Only tables of fixed size are
broadcast (weights, the ``KNOWN`` most frequent words); counts of other words
reach their tokens by a shuffle join.

Defined cases: null and empty texts hold only the end token; with no training
rows the base counts are all 0, and the score is uniform over classes; an empty
table gives no rows; repeated rows are trained on and scored each; other
columns, whatever their names, are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcols as tc
from .common import Scratch, most_frequent, one_text_per_id, remainder, summed_arrays

KNOWN = 1 << 16
HEAD = 4096
WIDTH = 64
TAILS = 32
ROWS = 1 << 13
ROUNDS = 3
BATCH = 1 << 10
PIECE = 1 << 17
DISCOUNT = 0.5
CLASSES = HEAD // WIDTH + TAILS + 1
COLUMNS = CLASSES + CLASSES % 2  # a last one of no class, so that rows are whole pairs of weights
END = CLASSES - 1
FIRST_TAIL = HEAD // WIDTH
BOS = HEAD + TAILS
COUNT_TOKENS = 1 << 21
TASK_TOKENS = 1 << 23


def _tail_class(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    last = raw[ends - 1].astype(np.int64)
    before = np.where(ends - starts > 1, raw[np.maximum(ends - 2, 0)], 0).astype(np.int64)
    return (last * 37 + before * 101) % TAILS


def _chunk_words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    for i, j, raw, at in tc.row_chunks(column):
        raw = tc.lower_ascii(raw)
        starts, ends, rows = tc.word_bounds(raw, at)
        h = tc.span_hash(tc.prefix_hash(raw), starts, ends) if len(starts) else tc.EMPTY_HASH
        yield i, j, h, _tail_class(raw, starts, ends) if len(starts) else np.empty(0, np.int64), rows


def count_words(texts: DataFrame) -> DataFrame:
    """h, k (tail class), c over all words of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            h, k = (np.concatenate(x) for x in zip(*held, strict=True))
            u, first, c = np.unique(h, return_index=True, return_counts=True)
            held.clear()
            return pa.record_batch({"h": pa.array(tc.signed(u)), "k": pa.array(k[first].astype(np.int32)), "c": pa.array(c.astype(np.int64))})

        for b in batches:
            for _, _, h, k, _ in _chunk_words(b.column(0)):
                held.append((h, k.astype(np.int8)))
                if sum(len(x) for x, _ in held) >= COUNT_TOKENS:
                    yield flush()
        if held:
            yield flush()

    return texts.select("text").mapInArrow(run, "h long, k int, c long").groupBy("h").agg(F.first("k").alias("k"), F.sum("c").alias("c"))


def number_words(docs: DataFrame, known: np.ndarray) -> DataFrame:
    """The texts as word numbers: a known word's place, or KNOWN + tail class; the others' fingerprints beside."""
    index = tc.HashIndex(known)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, h, k, rows in _chunk_words(b.column(2)):
                at = shared.value.find(h)
                rare = np.flatnonzero(at < 0)
                ids = np.where(at < 0, KNOWN + k, at).astype(np.uint32)
                own = np.searchsorted(rows, rare, "right") - 1
                offsets = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=j - i))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(i, j - i),
                        b.column(1).slice(i, j - i),
                        pa.array([ids[rows[r] : rows[r + 1]].tobytes() for r in range(j - i)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(tc.signed(h[rare]))),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(k[rare].astype(np.int32))),
                    ],
                    names=["doc_id", "held_out", "ids", "rare", "rare_k"],
                )

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, ids binary, rare array<long>, rare_k array<int>")


@dataclass
class Model:
    tail_of: np.ndarray  # tail class of each known word (by number)
    known: int  # known words
    classes: np.ndarray  # class of each head word
    slots: np.ndarray  # place within its class
    class_bias: np.ndarray  # unused columns very low
    class_rows: np.ndarray  # ROWS x COLUMNS
    word_bias: np.ndarray  # head classes x WIDTH; unused places very low
    word_rows: np.ndarray  # ROWS x WIDTH


def _context(ids: np.ndarray, tail_of: np.ndarray) -> np.ndarray:
    """Numbers as they stand in histories: head words as they are, others by tail class."""
    head = min(HEAD, len(tail_of))
    out = np.where(ids < head, ids, 0).astype(np.int64)
    mid = (ids >= head) & (ids < KNOWN)
    out[mid] = HEAD + tail_of[ids[mid]]
    far = ids >= KNOWN
    out[far] = HEAD + (ids[far].astype(np.int64) - KNOWN)
    return out


def _bucket(kind: int, *parts: np.ndarray) -> np.ndarray:
    h = np.full(len(parts[0]), kind * 0x9E3779B1 % (1 << 64), dtype=np.uint64)
    for p in parts:
        h = (h ^ p.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(20)).astype(np.int64) & (ROWS - 1)


def histories(batches: Iterator[pa.RecordBatch], column: int, tail_of: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]]:
    """Pieces of whole rows: first and last row, numbers, context numbers, the three before each, row starts.

    Every row ends in the end token, numbered -1 among context numbers.
    """
    for b in batches:
        raw, at = tc.text_buffers(b.column(column))
        at = at // 4
        ids = raw.view(np.uint32) if len(raw) else np.empty(0, np.uint32)
        n, i = len(at) - 1, 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE, "right")) - 1)
            size = at[i + 1 : j + 1] - at[i:j]
            starts = np.concatenate([[0], np.cumsum(size + 1)])
            total = int(starts[-1])
            own = np.full(total, KNOWN + TAILS, dtype=np.uint32)
            word = np.ones(total, dtype=bool)
            word[starts[1:] - 1] = False
            own[word] = ids[at[i] : at[j]]
            ctx = np.full(total, -1, dtype=np.int64)
            ctx[word] = _context(own[word], tail_of)
            before = []
            for back in (1, 2, 3):
                p = np.full(total, BOS, dtype=np.int64)
                p[back:] = ctx[:-back] if back < total else p[back:]
                for k in range(back):
                    place = starts[:-1] + k
                    p[place[place < starts[1:]]] = BOS
                before.append(p)
            yield i, j, own, ctx, before, starts
            i = j


def _classes(model: Model, ctx: np.ndarray) -> np.ndarray:
    out = np.full(len(ctx), END, dtype=np.int64)
    head = (ctx >= 0) & (ctx < HEAD)
    out[head] = model.classes[ctx[head]]
    tail = ctx >= HEAD
    out[tail] = FIRST_TAIL + ctx[tail] - HEAD
    return out


def _features(p: list[np.ndarray]) -> list[np.ndarray]:
    return [_bucket(1, p[0]), _bucket(2, p[0], p[1]), _bucket(3, p[1]), _bucket(4, p[0], p[2])]


def _word_features(p: list[np.ndarray], classes: np.ndarray) -> list[np.ndarray]:
    return [_bucket(5, p[0], classes), _bucket(6, p[1], classes)]


def _softmax(bias: np.ndarray, rows: np.ndarray, features: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores, their exponentials, and log normalisers.

    Biases are logs of shares and each row's weights are clipped, so no exponential can overflow.
    """
    z = rows.take(features[0], axis=0, mode="clip")
    z += bias
    part = np.empty_like(z)
    for f in features[1:]:
        z += rows.take(f, axis=0, out=part, mode="clip")
    e = np.exp(z, out=part)
    return z, e, np.log(e @ np.ones(e.shape[1], e.dtype))


def log_probabilities(m: Model, ctx: np.ndarray, before: list[np.ndarray]) -> np.ndarray:
    """Natural log of class probability, times word probability for head words, of each token."""
    out = np.empty(len(ctx))
    for lo in range(0, len(ctx), BATCH):
        c, p = ctx[lo : lo + BATCH], [x[lo : lo + BATCH] for x in before]
        k = _classes(m, c)
        z, _, norm = _softmax(m.class_bias, m.class_rows, _features(p))
        lp = (z[np.arange(len(c)), k] - norm).astype(np.float64)
        head = np.flatnonzero((c >= 0) & (c < HEAD))
        if len(head):
            kh = k[head]
            z, _, norm = _softmax(m.word_bias[kh], m.word_rows, _word_features([x[head] for x in p], kh))
            lp[head] += z[np.arange(len(head)), m.slots[c[head]]] - norm
        out[lo : lo + BATCH] = lp
    return out


def _scatter(expected: np.ndarray, features: list[np.ndarray], e: np.ndarray) -> None:
    """Add rows of probabilities to the rows of ``expected`` that the features name, two weights at once: as complex numbers."""
    pairs = e.view(np.complex64)  # add.at is fast on numpy's own dtype object only, not on an unpickled one
    width = pairs.shape[1]
    across, flat = np.arange(width), pairs.ravel()
    for f in features:
        np.add.at(expected, ((f * width)[:, None] + across).ravel(), flat)


def _true_places(features: list[np.ndarray], places: np.ndarray, width: int) -> np.ndarray:
    """How often each feature stood before each true place."""
    return np.bincount(np.concatenate([f * width + places for f in features]), minlength=ROWS * width)


def _turn(starts: np.ndarray, turn: int, rounds: int) -> np.ndarray:
    """Positions whose place in their row has the round's residue: of each row, wherever pieces begin."""
    place = np.arange(starts[-1]) - np.repeat(starts[:-1], np.diff(starts))
    return np.flatnonzero(place % rounds == turn)


def _round(m: Model, numbered: DataFrame, turn: int, rounds: int) -> np.ndarray | None:
    """Gradient and expected counts of both weight tables, over one residue of positions of all training texts."""
    shared = numbered.sparkSession.sparkContext.broadcast(m)
    sizes = (ROWS * COLUMNS, ROWS * WIDTH)

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        m = shared.value
        co, wo = (np.zeros(n, np.float32) for n in sizes)
        ce, we = (np.zeros(n // 2, np.complex64) for n in sizes)

        def expect(expected: np.ndarray, bias: np.ndarray, rows: np.ndarray, features: list[np.ndarray]) -> None:
            _, e, norm = _softmax(bias, rows, features)
            e *= np.exp(-norm)[:, None]
            _scatter(expected, features, e)

        for _, _, _, ctx, around, starts in histories(batches, 0, m.tail_of):
            at = _turn(starts, turn, rounds)
            c, p = ctx[at], [x[at] for x in around]
            k, f = _classes(m, c), _features(p)
            co += _true_places(f, k, COLUMNS)
            for lo in range(0, len(c), BATCH):
                expect(ce, m.class_bias, m.class_rows, [x[lo : lo + BATCH] for x in f])
            head = np.flatnonzero((c >= 0) & (c < HEAD))
            kh = k[head]
            f = _word_features([x[head] for x in p], kh)
            wo += _true_places(f, m.slots[c[head]], WIDTH)
            for lo in range(0, len(head), BATCH):
                expect(we, m.word_bias[kh[lo : lo + BATCH]], m.word_rows, [x[lo : lo + BATCH] for x in f])
        ce, we = ce.view(np.float32), we.view(np.float32)
        return np.concatenate([co - ce, ce, wo - we, we])

    out = summed_arrays(numbered.select("ids"), run)
    return None if out is None else np.split(out, np.cumsum([sizes[0], sizes[0], sizes[1]]))


def _like_neighbours(numbered: DataFrame, tail_of: np.ndarray) -> np.ndarray:
    """Order of head words in which those with like preceding and following words stand together.

    The counts behind it are HEAD x 2 (TAILS + 64): of tail classes and the 64 most frequent words beside each.
    """
    side = TAILS + 64

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(HEAD * 2 * side, dtype=np.int64)
        for _, _, _, ctx, before, _ in histories(batches, 0, tail_of):
            p = before[0]
            group = lambda x: np.where(x >= HEAD, x - HEAD, np.where(x < 64, TAILS + x, -1))
            ok = (ctx >= 0) & (ctx < HEAD) & (p != BOS) & (group(p) >= 0)
            total += np.bincount(ctx[ok] * 2 * side + group(p)[ok], minlength=len(total))
            ok = (p < HEAD) & (ctx >= 0) & (group(ctx) >= 0)
            total += np.bincount(p[ok] * 2 * side + side + group(ctx)[ok], minlength=len(total))
        return total

    counts = summed_arrays(numbered.select("ids"), run)
    x = np.sqrt((np.zeros(HEAD * 2 * side) if counts is None else counts).reshape(HEAD, -1).astype(float))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    x -= x.mean(axis=0)
    _, vectors = np.linalg.eigh(x.T @ x)
    y = x @ vectors[:, -4:][:, ::-1]
    # halve along the widest direction until groups have the size of a class
    groups = [np.arange(HEAD)]
    while len(groups[0]) > WIDTH:
        groups = [half for g in groups for half in np.array_split(g[np.argsort(y[g, y[g].var(axis=0).argmax()], kind="stable")], 2)]
    return np.concatenate(groups)


def score(documents: DataFrame, fold: int = 7, held: int = 2, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of whole texts)."""
    docs = one_text_per_id(documents).withColumn("held_out", remainder(F.col("doc_id"), fold) == held)
    scratch = Scratch(docs.sparkSession)
    learn = docs.filter("not held_out")
    counts = scratch.keep(count_words(learn), "counts")
    ends = learn.count()
    spread = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, vocabulary = int(spread[0]) + ends, int(spread[1]) + (ends > 0)
    known = most_frequent(counts, "c", KNOWN).toPandas().sort_values(["c", "h"], ascending=[False, True])
    known_c, tail_of = known["c"].to_numpy(np.float64), known["k"].to_numpy(np.int64)
    numbered = scratch.keep(number_words(docs, tc.unsigned(known["h"].to_numpy(np.int64))).withColumn("row", F.monotonically_increasing_id()), "numbered")
    # sums are tables of a fixed size per task, so small partitions are read together
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_TOKENS))
    train = numbered.filter("not held_out").coalesce(tasks)

    order = _like_neighbours(train, tail_of)
    classes, slots = np.empty(HEAD, np.int64), np.empty(HEAD, np.int64)
    classes[order], slots[order] = np.arange(HEAD) // WIDTH, np.arange(HEAD) % WIDTH
    head_c = np.zeros(HEAD)
    head_c[: min(HEAD, len(known_c))] = known_c[:HEAD]
    mass, types = np.zeros(TAILS), np.zeros(TAILS)
    for r in counts.groupBy("k").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        mass[r["k"]], types[r["k"]] = r["c"], r["n"]
    mass -= np.bincount(tail_of[:HEAD], weights=known_c[:HEAD], minlength=TAILS)
    types -= np.bincount(tail_of[:HEAD], minlength=TAILS)
    class_mass = np.concatenate([np.bincount(classes, weights=head_c, minlength=FIRST_TAIL), mass, [ends]])
    class_bias = np.log((class_mass + 0.5) / (class_mass + 0.5).sum())
    word_bias = np.full((FIRST_TAIL, WIDTH), -1e9, np.float32)
    real = head_c > 0
    word_bias[classes[real], slots[real]] = np.log(head_c[real] / np.maximum(1.0, class_mass[classes[real]]))
    model = Model(tail_of, len(known), classes, slots, np.pad(class_bias, (0, COLUMNS - CLASSES), constant_values=-1e9).astype(np.float32), np.zeros((ROWS, COLUMNS), np.float32), word_bias, np.zeros((ROWS, WIDTH), np.float32))
    for turn in range(rounds):
        sums = _round(model, train, turn, rounds)
        if sums is None:
            break
        cg, ce, wg, we = sums
        rate = 1.0 / (1 + 0.5 * turn)
        model.class_rows = model.class_rows + np.clip(rate * 0.5 * cg / (ce + 8.0), -1.5, 1.5).reshape(ROWS, COLUMNS).astype(np.float32)
        model.word_rows = model.word_rows + np.clip(rate * 0.5 * wg / (we + 8.0), -1.5, 1.5).reshape(ROWS, WIDTH).astype(np.float32)

    # tail words: share of their class less the discount; what is discounted belongs to unseen words
    known_word = np.log10(np.maximum(known_c - DISCOUNT, 1e-9) / np.maximum(mass[tail_of], 1e-9))
    known_word[:HEAD] = 0.0
    known_base = np.log10((known_c + 1) / (total + vocabulary + 1))
    end_base = float(np.log10((ends + 1) / (total + vocabulary + 1)))
    shared = docs.sparkSession.sparkContext.broadcast((model, known_word, known_base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, word, base = shared.value
        for b in batches:
            for i, j, own, ctx, before, starts in histories([b], 3, m.tail_of):
                lp = log_probabilities(m, ctx, before) / np.log(10.0)
                there = own < KNOWN
                lb = np.zeros(len(own))
                lb[there] = base[own[there]]
                lp[there] += word[own[there]]
                lb[starts[1:] - 1] = end_base
                rows = [np.add.reduceat(x, starts[:-1]) for x in (lp, lb, there.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(k).slice(i, j - i) for k in range(3)), pa.array((starts[1:] - starts[:-1]).astype(np.int64)), pa.array(rows[2] + (ends > 0)), pa.array(rows[1]), pa.array(rows[0])],
                    names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )

    main = numbered.select("row", "doc_id", "held_out", "ids").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    rare = numbered.select("row", F.explode(F.arrays_zip("rare", "rare_k")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.rare_k").alias("k"))
    found = rare.join(counts.select("h", "c"), "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    at = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("k") + 1)
    unseen = np.where(mass > 0, DISCOUNT * types / np.maximum(mass, 1e-9), 1.0)
    word = F.when(F.col("c") > 0, F.log10((F.col("c") - DISCOUNT) / at(np.maximum(mass, 1.0)))).otherwise(F.log10(at(unseen)))
    added = found.groupBy("row").agg(F.sum((F.col("c") > 0).cast("long")).alias("k2"), F.sum(F.log10((F.col("c") + 1) / float(total + vocabulary + 1))).alias("b2"), F.sum(word).alias("s2"))
    out = main.join(added, "row", "left")
    zero = F.lit(0.0)
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k2", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base_score") + F.coalesce("b2", zero)).alias("base_score"), (F.col("score") + F.coalesce("s2", zero)).alias("score"))
