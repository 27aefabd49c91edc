"""Subword tokens of texts by a vocabulary file; nothing is trained here.

The file is read once, by the driver, and reaches the tasks as a broadcast of its bytes (their number is checked).  Its
name tells the kind: ``.json`` (byte-pair merges and their rules), ``.tiktoken`` (ranked byte strings) or ``.model``
(sentence pieces).  Texts are encoded ``PART_BYTES`` at a time, or one text, as tokens take some hundred times a
character's memory while a library holds them.

Defined cases: a null text has no tokens and the count 0; the strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

MOST_BYTES = 64 << 20
PART_BYTES = 1 << 18
#: Fixed value: how byte-pair vocabularies of ranked strings part a text before they merge.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

Encode = Callable[[list[str]], list[list[int]]]
Decode = Callable[[list[int]], str]


def loaded(name: str, data: bytes, pattern: str = PATTERN) -> tuple[Encode, Decode]:
    """Encodes texts, decodes tokens."""
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(data.decode())
        t.encode_special_tokens = True
        t.no_padding()
        t.no_truncation()
        return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)], lambda ids: t.decode(ids, skip_special_tokens=False)
    if name.endswith(".tiktoken"):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [own.encode_ordinary(t) for t in texts], own.decode
    if name.endswith(".model"):
        import sentencepiece

        piece = sentencepiece.SentencePieceProcessor(model_proto=data)
        return lambda texts: piece.encode(texts, num_threads=1), piece.decode
    raise ValueError(f"not a vocabulary file: {name}")


def _parts(b: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``PART_BYTES`` of text, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < b.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PART_BYTES, "right")))
        yield b.slice(lo, hi - lo)
        lo = hi


def _mapped(df: DataFrame, column: str, path: str, name: str, kind: str, make: Callable[[Encode, list[str]], pa.Array]) -> DataFrame:
    data = Path(path).read_bytes()
    if len(data) > MOST_BYTES:
        raise ValueError(f"{path} is over {MOST_BYTES} bytes")
    shared = df.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, _ = loaded(path, shared.value)
        for b in (part for whole in batches for part in _parts(whole, column)):
            texts = [t or "" for t in b.column(b.schema.get_field_index(column)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, make(encode, texts)], names=[*b.schema.names, name])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{types}, `{name}` {kind}")


def counted(df: DataFrame, column: str, path: str, name: str = "n_tokens") -> DataFrame:
    """``df`` with the number of tokens of a text."""
    return _mapped(df, column, path, name, "int", lambda encode, texts: pa.array([len(x) for x in encode(texts)], pa.int32()))


def encoded(df: DataFrame, column: str, path: str, name: str = "tokens") -> DataFrame:
    """``df`` with the tokens of a text."""
    return _mapped(df, column, path, name, "array<int>", lambda encode, texts: pa.array(encode(texts), pa.list_(pa.int32())))


def decoded(df: DataFrame, column: str, path: str, name: str = "text") -> DataFrame:
    """``df`` with the text of tokens."""
    data = df.sparkSession.sparkContext.broadcast(Path(path).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decode = loaded(path, data.value)
        for b in batches:
            texts = [None if ids is None else decode(ids) for ids in b.column(b.schema.get_field_index(column)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, name])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{types}, `{name}` string")
