"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

A word is a run of ASCII letters and digits or bytes of other scripts, lower-cased.  Inverse document frequencies
of all template words are counted over all files.  Templates are of two kinds:
notices, standard headers and short licences are looked for anywhere in a file;
long licences are compared with whole files only.  A template's anchors are its
rarest words, chosen so that a text without any anchor cannot reach the
threshold (the other words' share of the template's length is below it).  Every
place of an anchor in a file, wherever it stands, proposes the window that lines
the anchor up with the template; the best cosine over windows is the file's
header score.  The cosine of the whole file decides whether it is a licence file.

Files without a licence of their own inherit that of the nearest ancestor
directory with a licence file: paths of distinct directories are joined to the
directories of licence files, the deepest wins, and files get it by directory.

Defined cases: null and empty texts have no own licence but may inherit; a null
path is in no directory; equal scores go to the template first in name order,
equal licence files of a directory likewise; repeated rows are returned each; other
columns, whatever their names, are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcols as tc
from .common import Scratch, checked_broadcast, summed_arrays
from .decontam import normalise

THRESHOLD = 0.8
FILE_THRESHOLD = 0.8
FILE_NAMES = r"(?i)^(licen[cs]e|copying|notice|unlicense)([.\-_].*)?$"

# One-sentence notices of common public licences; whole texts and standard headers are in licence_texts.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Cosines that differ by less are equal, and go to the first template.
TIE = 1e-12


def licence_texts(kind: str) -> dict[str, str]:
    """Standard headers and short licences (kind header), or long licences (kind file); what follows # tells versions of a text apart."""
    folder = resources.files(__package__) / "licence_texts" / kind
    return {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in folder.iterdir() if f.name.endswith(".txt")}


@dataclass
class Model:
    names: list[str]
    paths: list[np.ndarray]  # term ids of each template, in order
    terms: tc.HashIndex
    idf: np.ndarray  # one more entry: words of no template
    anchors: list[dict[int, list[int]]]  # per template: term -> places
    long_names: list[str]
    long: np.ndarray  # long licences x terms, of length 1
    strong: np.ndarray  # whether a term is an anchor of any template
    placed: np.ndarray  # whether it is one of a template that is looked for anywhere


def _template_terms(templates: dict[str, str]) -> list[np.ndarray]:
    out = []
    for name in sorted(templates):
        raw = np.frombuffer(templates[name].encode(), np.uint8)
        out.append(tc.words(*normalise(raw, np.array([0, len(raw)])))[0])
    return out


def train(files: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> Model:
    """Templates as given, all looked for anywhere, or all that are built in."""
    whole = licence_texts("file") if templates is None else {}
    if templates is None:
        templates = {**{f"{k}#notice": v for k, v in TEMPLATES.items()}, **licence_texts("header")}
    hashes = _template_terms(templates) + _template_terms(whole)
    terms = np.unique(np.concatenate(hashes))
    index = tc.HashIndex(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        df = np.zeros(len(terms) + 1, dtype=np.int64)
        for b in batches:
            for i, j, raw, at in tc.row_chunks(b.column(0)):
                h, rows = tc.words(*normalise(raw, at))
                found = index.find(h)
                own = np.flatnonzero(found >= 0)
                _, term = tc.distinct_pairs(np.searchsorted(rows, own, "right") - 1, found[own])
                df[:-1] += np.bincount(term, minlength=len(terms))
                df[-1] += j - i
        return df

    df = summed_arrays(files.select("text"), count)
    df = np.zeros(len(terms) + 1, dtype=np.int64) if df is None else df
    idf = np.log((df[-1] + 1.0) / (np.append(df[:-1], 0) + 1.0)) + 1.0
    paths, anchors = [index.find(h) for h in hashes], []
    for path in paths:
        u, tf = np.unique(path, return_counts=True)
        mass = (tf * idf[u]) ** 2
        order = np.argsort(-idf[u], kind="stable")
        rest = 1 - np.cumsum(mass[order]) / mass.sum()
        need = int(np.argmax(rest < threshold**2)) + 1
        anchors.append({int(t): np.flatnonzero(path == t).tolist() for t in u[order[:need]]})
    n = len(templates)
    strong, placed = np.zeros(len(idf), dtype=bool), np.zeros(len(idf), dtype=bool)
    for k, a in enumerate(anchors):
        strong[list(a)] = True
        if k < n:
            placed[list(a)] = True
    long = np.array([np.bincount(p, minlength=len(terms)) * idf[:-1] for p in paths[n:]]).reshape(-1, len(terms))
    long /= np.linalg.norm(long, axis=1, keepdims=True)
    base = lambda x: [k.split("#")[0] for k in sorted(x)]
    return Model(base(templates), paths[:n], index, idf, anchors[:n], base(whole), long, strong, placed)


def cosine(m: Model, template: np.ndarray, window: np.ndarray) -> float:
    """TF-IDF cosine; ``window`` has term ids, unknown words are -1 and count as different words of highest idf."""
    a, b = (np.bincount(x[x >= 0], minlength=len(m.idf) - 1) * m.idf[:-1] for x in (template, window))
    other = np.count_nonzero(window < 0) * m.idf[-1] ** 2
    norm = np.sqrt((a @ a) * (b @ b + other))
    return float(a @ b / norm) if norm else 0.0


def _best_window(m: Model, path: np.ndarray, ids: np.ndarray, starts: np.ndarray, least: float) -> float:
    """The largest cosine of a template with the windows from these starts, or ``least`` if none is larger.

    Running sums give each window's product with the template, and its length at least, as if no word came twice; that
    bounds the cosine.  Windows of equal words are tried once, likeliest first, until no bound is larger.
    """
    ends = np.minimum(starts + len(path), len(ids))
    weight = np.append(np.bincount(path, minlength=len(m.idf) - 1) * m.idf[:-1], 0.0)
    sums = lambda x: np.concatenate([[0.0], np.cumsum(x)])
    product, mass = sums(weight[ids] * m.idf[ids]), sums(m.idf[ids] ** 2)
    bound = (product[ends] - product[starts]) / (np.linalg.norm(weight) * np.sqrt(mass[ends] - mass[starts]))
    open_ = bound > least + TIE
    starts, ends, bound = starts[open_], ends[open_], bound[open_]
    if not len(starts):
        return least
    powers, _ = tc._powers(len(ids) + 1)
    hashes = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(tc.mix(ids.astype(np.int64).view(np.uint64)) * powers[: len(ids)], out=hashes[1:])
    _, once = np.unique(tc.span_hash(hashes, starts, ends), return_index=True)
    for k in once[np.argsort(-bound[once], kind="stable")]:
        if bound[k] <= least + TIE or least >= 1 - TIE:
            break
        least = max(least, cosine(m, path, ids[starts[k] : ends[k]]))
    return least


def _best(m: Model, ids: np.ndarray) -> tuple[str | None, float, str | None, float]:
    """Best licence and cosine over windows, and over the whole file."""
    header, file = (None, 0.0), (None, 0.0)
    at = np.flatnonzero(m.placed[ids])
    at = at[np.argsort(ids[at], kind="stable")]
    terms, first = np.unique(ids[at], return_index=True)
    there = dict(zip(terms.tolist(), np.split(at, first[1:]), strict=True)) if len(at) else {}
    for k, path in enumerate(m.paths):
        near = [np.maximum(0, there[t][:, None] - np.array(places)).ravel() for t, places in m.anchors[k].items() if t in there]
        if not near:
            continue
        c = _best_window(m, path, ids, np.unique(np.concatenate(near)), header[1])
        if c > header[1] + TIE:
            header = (m.names[k], c)
        if (c := cosine(m, path, ids)) > file[1] + TIE:
            file = (m.names[k], c)
    if len(m.long):
        b = np.bincount(ids[ids >= 0], minlength=len(m.idf) - 1) * m.idf[:-1]
        c = m.long @ b / np.sqrt(b @ b + np.count_nonzero(ids < 0) * m.idf[-1] ** 2)
        k = int(c.argmax())
        if c[k] > file[1] + TIE:
            file = (m.long_names[k], float(c[k]))
    return *header, *file


def own_licences(files: DataFrame, m: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Columns of files without text, with own (licence or null), cosine, file_cosine; files: (doc_id, path, text)."""
    shared = files.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            own, cos, whole = [None] * b.num_rows, [0.0] * b.num_rows, [0.0] * b.num_rows
            for i, _, raw, at in tc.row_chunks(b.column(2)):
                h, rows = tc.words(*normalise(raw, at))
                ids = m.terms.find(h)
                hit = np.flatnonzero(m.strong[ids])
                for r in np.unique(np.searchsorted(rows, hit, "right") - 1):
                    k, c, fk, fc = _best(m, ids[rows[r] : rows[r + 1]])
                    if max(c, fc) >= threshold:
                        own[i + r] = k if c >= fc else fk
                    cos[i + r], whole[i + r] = max(c, fc), fc
            yield pa.record_batch({"doc_id": b.column(0), "path": b.column(1), "own": pa.array(own, pa.string()), "cosine": cos, "file_cosine": whole})

    return files.mapInArrow(run, "doc_id long, path string, own string, cosine double, file_cosine double")


def scan(files: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, path, license, cosine, origin (header, file, inherited, none), license_dir."""
    files = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    own = own_licences(files, train(files, templates, threshold), threshold)
    parts = F.split("path", "/")
    own = own.withColumn("dir", F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/"))
    scratch = Scratch(files.sparkSession)
    own = scratch.keep(own.withColumn("is_file", (F.col("file_cosine") >= FILE_THRESHOLD) | (F.element_at(parts, -1).rlike(FILE_NAMES) & F.col("own").isNotNull())), "own")
    best = F.max_by("own", F.struct("cosine", F.transform(F.split("own", ""), lambda c: -F.ascii(c))))
    places = own.filter("is_file and own is not null and path is not null").groupBy(F.col("dir").alias("license_dir")).agg(best.alias("inherited"))
    dirs = own.filter("own is null and path is not null").select("dir").distinct().withColumn("steps", F.split("dir", "/"))
    up = dirs.select("dir", F.explode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size("steps")), lambda k: F.array_join(F.slice("steps", 1, k), "/")))).alias("license_dir")).distinct()
    near = up.join(places, "license_dir").groupBy(F.col("dir").alias("of_dir")).agg(F.max_by(F.struct("license_dir", "inherited"), F.length("license_dir")).alias("near"))
    near = scratch.keep(near, "near")
    out = own.join(checked_broadcast(near), (own.dir == near.of_dir) & own.own.isNull(), "left")
    origin = F.when(F.col("own").isNotNull() & F.coalesce("is_file", F.lit(False)), "file").when(F.col("own").isNotNull(), "header").when(F.col("near").isNotNull(), "inherited").otherwise("none")
    return out.select("doc_id", "path", F.coalesce("own", "near.inherited").alias("license"), "cosine", origin.alias("origin"), F.when(F.col("own").isNull(), F.col("near.license_dir")).alias("license_dir"))


def scan_documents(documents: DataFrame) -> DataFrame:
    """Documents as files: source / language / id."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt")))
    return scan(documents.select("doc_id", path.alias("path"), "text"))
