"""Personal data: base patterns, and bootstrapped contextual extraction of further identifiers.

Base kinds are e-mail, IP address, payment card and phone number by fixed
patterns.  Identifier-like tokens (8 or more of ``[0-9A-Za-z_-]`` with at least 4
digits, or of a seed's shape and with a digit) are instances; the two and three lexemes in the
``CONTEXT_CHARS`` characters before one, and on to the start of a lexeme there, are its patterns.  Seeds are instances
that base spans cover, that have the shape of a well-known key or digest, or that
a text assigns to a name such as "password".  Spark counts the pattern-instance
graph over all documents and scores it in ``rounds``: a pattern by the mean score
of its instances, shrunk by ``shrink``; an unknown instance by the chance that
any of its patterns is right.  Patterns with a score of ``confidence`` and
``support`` distinct instances or more then mark their instances everywhere;
seeds that no base span covers are marked as well.

Up to ``PATTERNS`` patterns are broadcast.  Beyond that the contexts of all
instances are joined with the patterns, by digest of the text.

Defined cases: null and empty texts have no spans; spans of one kind never
overlap, learned spans overlap no base span; with no seeds nothing is learned;
an empty table gives no rows; repeated rows are counted and returned each; other
columns, whatever their names, are left behind (``masked`` keeps them all).
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fresh, one_text_per_id

# The base patterns' alphabets and forms.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Public forms of digests and access keys, and names of secrets.
SEED_SHAPES = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z-]{10,})\Z")
SEED_NAME = re.compile(r"(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\s*[:=]\s*[\"']?\Z", re.IGNORECASE)
KINDS = ("email", "ip", "card", "phone")
LEARNED = "identifier"

_DIGIT = re.compile(r"[0-9]")
_TOKEN_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")
_TOKEN = re.compile(r"[0-9A-Za-z_-]+")
_LEXEME = re.compile(r"\w+|[^\w\s]")
_WORD_CHAR = re.compile(r"\w")
_NOT_DIGIT = re.compile(r"[^0-9]+")
CONTEXT_CHARS = 64
PATTERNS = 200_000


def _luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches; only what stands around an @ is looked at."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = EMAIL.match(text, start) if start < at else None
        if found:
            out.append((start, end := found.end()))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    out["email"] = emails(text)
    if _DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
                out["ip"].append(m.span())
        for m in CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out["card"].append(m.span())
        for m in PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out["phone"].append(m.span())
    return out


def instances(text: str) -> Iterator[tuple[int, int]]:
    """Spans of identifier-like tokens, found from their digits."""
    end, m = 0, _DIGIT.search(text)
    while m:
        start = m.start()
        while start > end and text[start - 1] in _TOKEN_CHARS:
            start -= 1
        end = _TOKEN.match(text, start).end()
        token = text[start:end]
        if len(token) >= 8 and (sum("0" <= ch <= "9" for ch in token) >= 4 or SEED_SHAPES.match(token)):
            yield start, end
        m = _DIGIT.search(text, end)


def _short(lexeme: str) -> str:
    """A lexeme over the bound as a digest of it, so that patterns stay short."""
    return lexeme if len(lexeme) <= CONTEXT_CHARS else hashlib.blake2b(lexeme.encode(), digest_size=16).hexdigest()


def contexts(text: str, start: int) -> list[str]:
    """The patterns of an instance: the three and the two lexemes before it, digits as 0."""
    at = max(0, start - CONTEXT_CHARS)
    if at and _WORD_CHAR.match(text, at):
        while at and _WORD_CHAR.match(text, at - 1):  # to the start of the lexeme that the bound cuts
            at -= 1
    lexemes = [_short(_DIGIT.sub("0", x.lower())) for x in _LEXEME.findall(text, at, start)]
    return [" ".join(lexemes[-n:]) for n in (3, 2) if len(lexemes) >= n]


class Cover:
    """What the base spans of a text cover."""

    def __init__(self, spans: dict[str, list[tuple[int, int]]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(x for own in spans.values() for x in own):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, span: tuple[int, int]) -> bool:
        k = bisect.bisect_left(self.starts, span[1]) - 1
        return k >= 0 and self.ends[k] > span[0]


def is_seed(text: str, span: tuple[int, int]) -> bool:
    """Whether an instance is one by its own shape or by the name it is assigned to."""
    return bool(SEED_SHAPES.match(text[slice(*span)]) or SEED_NAME.search(text, max(0, span[0] - CONTEXT_CHARS), span[0]))


def graph(documents: DataFrame) -> DataFrame:
    """pattern, instance (a digest), known: one row for each met pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: dict[tuple[str, str], int] = {}
            for text in b.column(0).to_pylist():
                if not text or not _DIGIT.search(text):
                    continue
                spans = None
                for span in instances(text):
                    spans = Cover(base_spans(text)) if spans is None else spans
                    token = text[slice(*span)]
                    known = int(spans.meets(span) or is_seed(text, span))
                    digest = hashlib.blake2b(token.encode("utf-8", "replace"), digest_size=8).hexdigest()
                    for p in contexts(text, span[0]):
                        rows[p, digest] = max(known, rows.get((p, digest), 0))
            if rows:
                yield pa.record_batch({"pattern": [k[0] for k in rows], "instance": [k[1] for k in rows], "known": pa.array(list(rows.values()), pa.int32())})

    met = documents.select("text").mapInArrow(run, "pattern string, instance string, known int")
    return met.groupBy("pattern", "instance").agg(F.max("known").alias("known"))


def learn(documents: DataFrame, rounds: int = 3, confidence: float = 0.6, support: int = 3, shrink: float = 1.0) -> DataFrame:
    """High-confidence patterns (column pattern), by scores passed over the pattern-instance graph."""
    scratch = Scratch(documents.sparkSession)
    edges = scratch.keep(graph(documents), "graph")
    known = edges.groupBy("instance").agg(F.max("known").cast("double").alias("score"))
    for _ in range(rounds):
        pattern = edges.join(known, "instance").groupBy("pattern").agg((F.sum("score") / (F.count("*") + shrink)).alias("trust"), F.count("*").alias("n"))
        pattern = scratch.keep(pattern, "patterns")
        reached = edges.join(pattern.filter(F.col("n") >= support), "pattern").groupBy("instance").agg((1 - F.exp(F.sum(F.log(1.0 - F.least("trust", F.lit(0.999)))))).alias("reach"))
        seeds = edges.groupBy("instance").agg(F.max("known").cast("double").alias("own"))
        known = seeds.join(reached, "instance", "left").select("instance", F.greatest("own", F.coalesce("reach", F.lit(0.0))).alias("score"))
    return scratch.keep(pattern.filter((F.col("trust") >= confidence) & (F.col("n") >= support)).select("pattern"), "best")


Learned = frozenset | list  # patterns, or the spans that they mark


def all_spans(text: str, learned: Learned) -> list[tuple[str, int, int]]:
    """Spans of all kinds in the order of kinds, then start."""
    if not text:
        return []
    base = base_spans(text)
    out = [(kind, a, b) for kind in KINDS for a, b in base[kind]]
    if _DIGIT.search(text):
        cover, marked = Cover(base), None if isinstance(learned, frozenset) else set(learned)
        for span in instances(text):
            if not cover.meets(span) and (is_seed(text, span) or (span in marked if marked is not None else any(p in learned for p in contexts(text, span[0])))):
                out.append((LEARNED, *span))
    return out


def _marked(documents: DataFrame, patterns: DataFrame) -> DataFrame:
    """digest and spans [(start, end)] of texts in which patterns mark instances, for more patterns than can be broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for digest, text in zip(*(b.column(k).to_pylist() for k in range(2)), strict=True):
                cover = Cover(base_spans(text)) if text and _DIGIT.search(text) else None
                for span in instances(text) if cover else ():
                    if not cover.meets(span):
                        rows += [(digest, *span, p) for p in contexts(text, span[0])]
            digests, starts, ends, met = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.record_batch({"digest": pa.array(digests, pa.string()), "start": pa.array(starts, pa.int32()), "end": pa.array(ends, pa.int32()), "pattern": pa.array(met, pa.string())})

    met = documents.select(F.md5("text").alias("digest"), "text").mapInArrow(run, "digest string, start int, end int, pattern string")
    return met.join(patterns, "pattern").groupBy("digest").agg(F.collect_set(F.struct("start", "end")).alias("at"))


def _with_learned(documents: DataFrame, patterns: DataFrame, text: str, name: str) -> tuple[DataFrame, frozenset | None]:
    """The documents and the patterns; or, where these are too many, with the spans that they mark in a column ``name``."""
    got = patterns.limit(PATTERNS + 1).collect()
    if len(got) <= PATTERNS:
        return documents.withColumn(name, F.lit(None).cast("array<struct<start: int, end: int>>")), frozenset(r["pattern"] for r in got)
    marks = Scratch(documents.sparkSession).keep(_marked(documents.select(F.col(text).cast("string").alias("text")), patterns), "marks")
    digest = fresh(documents, "digest")
    marks = marks.select(F.col("digest").alias(digest), F.col("at").alias(name))
    return documents.join(marks, F.md5(F.col(text).cast("string")) == F.col(digest), "left").drop(digest), None


def _learned(column: pa.Array, patterns: frozenset | None) -> list[Learned]:
    if patterns is not None:
        return [patterns] * len(column)
    return [[(x["start"], x["end"]) for x in own or ()] for own in column.to_pylist()]


def scan(documents: DataFrame, patterns: DataFrame) -> DataFrame:
    """doc_id, counts per base kind, n_identifier, n_spans (of all kinds), base_sha256, spans."""
    rows, known = _with_learned(documents.select("doc_id", "text"), patterns, "text", "at")
    shared = documents.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [all_spans(t, p) for t, p in zip(b.column(1).to_pylist(), _learned(b.column(2), shared.value), strict=True)]
            columns: dict[str, pa.Array] = {"doc_id": b.column(0)}
            for kind in (*KINDS, LEARNED):
                columns[f"n_{kind}"] = pa.array([sum(s[0] == kind for s in x) for x in found], pa.int64())
            columns["n_spans"] = pa.array([len(x) for x in found], pa.int64())
            said = [[f"{k}:{a}:{z}" for k, a, z in x] for x in found]
            base = [[s for s, x in zip(own, spans, strict=True) if x[0] != LEARNED] for own, spans in zip(said, found, strict=True)]
            columns["base_sha256"] = pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in base], pa.string())
            columns["spans"] = pa.array([",".join(x) for x in said], pa.string())
            yield pa.record_batch(columns)

    return rows.select("doc_id", "text", "at").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_identifier long, n_spans long, base_sha256 string, spans string")


def find(documents: DataFrame) -> DataFrame:
    docs = one_text_per_id(documents)
    return scan(docs, learn(docs))


def mask(text: str | None, learned: Learned) -> str | None:
    """The text with each span (overlapping ones as one) replaced by its kind in brackets."""
    if not text:
        return text
    out, end = [], 0
    for kind, a, b in sorted(all_spans(text, learned), key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]]) if out else text


def masked(documents: DataFrame) -> DataFrame:
    """The documents with personal data masked in ``text`` and ``n_chars`` (if there) brought up to date; a scan without
    shuffle while the patterns can be broadcast."""
    at = fresh(documents, "marks")
    rows, known = _with_learned(documents, learn(documents.select(F.col("text").cast("string").alias("text"))), "text", at)
    shared = documents.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks, b = b.column(b.num_columns - 1), b.select(b.schema.names[:-1])
            k = b.schema.get_field_index("text")
            old = b.column(k).to_pylist()
            new = [mask(t, p) for t, p in zip(old, _learned(marks, shared.value), strict=True)]
            columns = [*b.columns]
            columns[k] = pa.array(new, b.schema.field(k).type)
            n = b.schema.get_field_index("n_chars")
            if n >= 0:
                kept = columns[n].to_pylist()
                columns[n] = pa.array([c if x == y else len(y) for c, x, y in zip(kept, old, new, strict=True)], b.schema.field(n).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return rows.mapInArrow(run, documents.schema)
