"""Samples of exact size that every run repeats: rows in the order of a digest of seed and key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import numbered, unused


def order_key(seed: str, key: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), key.cast("string")))


def exact(df: DataFrame, n: int, key: str, seed: str = "1234", strict: bool = False) -> DataFrame:
    """The first ``n`` rows in order of the digest, then key.

    Digests and keys alone are ranked, and rows up to the n-th are taken where they are; only where keys repeat at the
    edge, so that these are more than n, are whole rows ranked.
    """
    rank = F.struct(order_key(seed, F.col(key)).alias("digest"), F.col(key).alias("key"))
    first = df.select(rank.alias("rank")).orderBy("rank").limit(n)
    edge = first.agg(F.max("rank").alias("rank"), F.count(F.lit(1)).alias("n")).first()
    if strict and edge["n"] < n:
        raise ValueError(f"fewer than {n} rows to draw from")
    if edge["n"] < n or not n:
        return df if n else df.limit(0)
    kind = df.schema[key].dataType
    last = F.struct(F.lit(edge["rank"]["digest"]).alias("digest"), F.lit(edge["rank"]["key"]).cast(kind).alias("key"))
    drawn = df.filter(rank <= last)
    return drawn if drawn.count() == n else df.orderBy(order_key(seed, F.col(key)), key).limit(n)


def coin(key: Column, seed: str = "1234") -> Column:
    """True for about half of the keys."""
    return F.substring(order_key(seed, key), 1, 1).isin(*"01234567")


def even_parts(df: DataFrame, n: int, key: str) -> DataFrame:
    """``part``: n nearly equal ranges in key order, the first ones longer by a row (one, if there are no more rows than parts)."""
    rows = df.count()
    if n >= rows:
        return df.withColumn("part", F.lit(1))
    size, over = divmod(rows, n)
    name = unused(df, "_place")
    place = F.col(name)
    part = F.when(place < over * (size + 1), F.floor(place / (size + 1))).otherwise(over + F.floor((place - over * (size + 1)) / size))
    return numbered(df, key, name).withColumn("part", (part + 1).cast("int")).drop(name, f"{name}_total")


def final_dataset(samples: DataFrame, shots: DataFrame, n: int, key: str, seed: str = "1234") -> DataFrame:
    """n rows: the few-shots, and as many samples as are left, tagged; raises if there are too few samples."""
    drawn = exact(samples, max(0, n - shots.count()), key, seed, strict=True)
    return drawn.withColumn("is_few_shot", F.lit(0)).unionByName(shots.withColumn("is_few_shot", F.lit(1)))
