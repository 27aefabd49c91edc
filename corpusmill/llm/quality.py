"""Quality classifier: a linear hinge-loss model on n-gram indicators scaled by class log-count ratios.

Indicators: byte trigrams (hashed to 2^16 slots) that occur in a text, and for
each byte the power of two of its share in the text.  Log-count ratios come from
all training rows.  The hinge-loss weights are fitted by dual coordinate descent
on at most ``max_fit_rows`` training rows (a documented bound, chosen by a hash
of the id), a third of which set the slope that turns margins into probabilities.

Defined cases: null and empty texts have no trigrams and score by the bias;
with no training rows, or one class only, every score is the class share (0.5
without rows); labels that are null teach nothing, repeated labels of one id
count as their rounded mean; an empty table gives no rows; other
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
from .common import checked_broadcast, one_text_per_id, remainder, summed_arrays

SLOTS = 1 << 16
SHARES = 12
WIDTH = SLOTS + 256 * SHARES
MAX_FIT_ROWS = 8_000
THRESHOLD = 0.3


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float


def indicators(raw: np.ndarray) -> np.ndarray:
    """Sorted indices of the indicators of one text's bytes."""
    if not len(raw):
        return np.empty(0, np.int64)
    counts = np.bincount(raw, minlength=256)
    there = np.flatnonzero(counts)
    share = np.minimum(SHARES - 1, np.log2(len(raw) / counts[there]).astype(np.int64))
    out = [SLOTS + there * SHARES + share]
    if len(raw) > 2:
        x = raw.astype(np.uint32)
        h = (x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]) * np.uint32(0x9E3779B1) >> np.uint32(16)
        mark = np.zeros(SLOTS, dtype=bool)
        mark[h] = True
        out.insert(0, np.flatnonzero(mark))
    return np.concatenate(out)


def _rows(batch: pa.RecordBatch, column: int) -> Iterator[np.ndarray]:
    raw, at = tc.text_buffers(batch.column(column))
    for k in range(len(at) - 1):
        yield raw[at[k] : at[k + 1]]


def descend(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L2-regularised hinge loss; a constant indicator carries the bias."""
    w, bias = np.zeros(WIDTH), 0.0
    alpha = np.zeros(len(rows))
    values = [scale[r] for r in rows]
    size = np.array([v @ v + 1.0 for v in values])
    upper = cost * np.where(y > 0, (y < 0).sum() / max(1, (y > 0).sum()), 1.0) / np.median(size) if len(rows) else np.zeros(0)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for k in rng.permutation(len(rows)):
            r, v = rows[k], values[k]
            g = y[k] * (w[r] @ v + bias) - 1.0
            new = min(max(alpha[k] - g / size[k], 0.0), upper[k])
            step = (new - alpha[k]) * y[k]
            if step:
                alpha[k] = new
                w[r] += step * v
                bias += step
                moved = max(moved, abs(step) * size[k])
        if moved < 1e-3:
            break
    return w * scale, bias


def _calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through the margins, by Newton steps on smoothed targets."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, float(np.log((pos + 1) / (neg + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        d, s = p - t, p * (1 - p)
        g = np.array([(d * margin).sum(), d.sum()])
        h = np.array([[(s * margin * margin).sum() + 1e-6, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
        if np.abs(step).max() < 1e-6:
            break
    return max(a, 1e-3), b


def train(labelled: DataFrame, max_fit_rows: int = MAX_FIT_ROWS) -> Model:
    """``labelled`` has (doc_id, text, y) with y 0 or 1."""

    def classes(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((2, WIDTH + 1), dtype=np.int64)
        for b in batches:
            for raw, y in zip(_rows(b, 0), b.column(1).to_pylist(), strict=True):
                total[y, indicators(raw)] += 1
                total[y, WIDTH] += 1
        return total.ravel()

    counts = summed_arrays(labelled.select("text", "y"), classes)
    neg, pos = (np.zeros(WIDTH + 1), np.zeros(WIDTH + 1)) if counts is None else counts.reshape(2, -1).astype(float)
    n_neg, n_pos = neg[-1], pos[-1]
    if not n_neg or not n_pos:
        share = 0.5 if not n_neg + n_pos else (n_pos + 1) / (n_neg + n_pos + 2)
        return Model(np.zeros(WIDTH), 0.0, 1.0, float(np.log(share / (1 - share))))
    p, q = pos[:-1] + 1.0, neg[:-1] + 1.0
    ratio = np.log((p / (n_pos + 2)) / (q / (n_neg + 2)))
    ratio[(pos[:-1] + neg[:-1]) < 2] = 0.0

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, ys = [], []
        for b in batches:
            rows += [indicators(raw).astype(np.int32) for raw in _rows(b, 0)]
            ys += b.column(1).to_pylist()
        y = np.where(np.array(ys) > 0, 1.0, -1.0)
        cut = max(1, len(rows) * 2 // 3)
        w, bias = descend(rows[:cut], y[:cut], ratio)
        rest = range(cut, len(rows)) if len(rows) - cut >= 20 and 0 < (y[cut:] > 0).sum() < len(rows) - cut else range(len(rows))
        a, b0 = _calibrate(np.array([w[rows[k]].sum() + bias for k in rest]), y[list(rest)])
        yield pa.record_batch({"w": pa.array([w.tobytes()], pa.binary()), "m": [[bias, a, b0]]})

    # a share by hash, a little under the bound, so that the one task that fits reads no more than it needs
    share = min(1.0, 0.95 * max_fit_rows / (n_neg + n_pos))
    sample = labelled.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(max_fit_rows).select("text", "y").coalesce(1)
    r = sample.mapInArrow(fit, "w binary, m array<double>").first()
    return Model(np.frombuffer(bytes(r["w"])), *r["m"])


def score(documents: DataFrame, model: Model, threshold: float = THRESHOLD, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            z = np.array([m.weights[indicators(raw)].sum() for raw in _rows(b, b.num_columns - 1)], dtype=float)
            p = 1 / (1 + np.exp(-np.clip(m.slope * (z + m.bias) + m.offset, -500, 500)))
            out = [b.column(k) for k in range(len(keep))] + [pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(out, names=[*keep, "score", "predicted"])

    kept = documents.select(*keep, "text")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{types}, score double, predicted int")


def classify(documents: DataFrame, labels: DataFrame, fold: int = 5, held: int = 0, max_fit_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted; learns ``labels.quality`` of rows outside the held-out fold."""
    docs = one_text_per_id(documents)
    marks = labels.filter("doc_id is not null and quality is not null").filter(remainder(F.col("doc_id"), fold) != held)
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.round(F.avg(F.least(F.greatest(F.col("quality"), F.lit(0)), F.lit(1)))).cast("int").alias("y"))
    model = train(docs.join(checked_broadcast(marks), "doc_id"), max_fit_rows)
    return score(docs.withColumn("held_out", remainder(F.col("doc_id"), fold) == held), model, keep=("doc_id", "held_out"))
