"""Column functions on text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that count as white space at the ends of a text.
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LETTERS = ("A", "B", "C", "D", "E")


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def paragraphs(c: Column, most: int = 30) -> Column:
    """The first ``most`` lines joined by blanks."""
    return F.array_join(F.slice(F.split(strip(c), "\n"), 1, most), " ")


def alphanumeric(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}]", "")


def joined(first: Column, second: Column, by: str) -> Column:
    """Both stripped; null if either is."""
    return F.concat(strip(first), F.lit(by), strip(second))


def in_band(c: Column, least: int = 200, most: int = 25_000) -> Column:
    return F.length(c).between(least, most)


def lettered(choices: Column) -> Column:
    """Lines "A. first", at most five."""
    letters = F.array(*[F.lit(x) for x in LETTERS])
    return F.array_join(F.transform(F.slice(choices, 1, len(LETTERS)), lambda x, i: F.concat(F.element_at(letters, i + 1), F.lit(". "), x)), "\n")


def instruct(c: Column) -> Column:
    return F.concat(F.lit("[INST] "), strip(c), F.lit(" [/INST]"))


def _ngrams(c: Column, n: int, of: Callable[..., Column], kind: str) -> Column:
    """Distinct n-grams of lower-cased letter and digit runs; a null text has none.

    The words are the one element of an array, so that they are split once a text and not once an n-gram.
    """
    words = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    grams = F.transform(F.array(words), lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: of(*[F.get(w, i + k) for k in range(n)]))))
    return F.coalesce(F.array_distinct(F.element_at(grams, 1)), F.array().cast(f"array<{kind}>"))


def word_ngrams(c: Column, n: int) -> Column:
    """Distinct n-grams as strings, words joined by blanks."""
    return _ngrams(c, n, lambda *w: F.concat_ws(" ", *w), "string")


def hashed_ngrams(c: Column, n: int) -> Column:
    """Distinct n-grams as 64-bit fingerprints; x of them meet y others by chance x y / 2^64 times."""
    return _ngrams(c, n, F.xxhash64, "bigint")
