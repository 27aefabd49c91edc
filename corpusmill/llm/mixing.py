"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Every source has a target number of words.  Its documents are put in a shuffled
order; a document's virtual finish time is the source's running word count after
it, divided by the target.  All documents are then put in the order of finish
times and taken until the total budget is used.  Sources whose target is over
their own size pass through up to ``passes`` times, shuffled anew each time.

Running sums never need one task for a source: the shuffled order is cut into
``buckets`` equal ranges of the hash, sums of ranges are added up first (a few
thousand rows), then each range is summed on its own.  The global order is cut
likewise, twice.

The rows with their sizes and the queue are written once to the shared folder;
everything else reads these narrow tables.

Defined cases: a null or blank text has size 0 and is never taken; an empty
table gives no rows; a null source is a source of its own, last in order; equal
finish times go by source order, pass, doc_id, size, then copy.  Every row is a
document of its own: rows with equal doc_id, source and size are numbered as
copies, so each has its own place in the queue and its own words taken, and
which of them is which makes no difference.  Other columns, whatever their
names, are left behind by ``mix_sources`` and kept by ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, checked_broadcast, fresh

WORD = r"[^\x20\x09-\x0D]+"
PASSES = 3
BUCKETS = 4096
LINEAR = 4


def word_count(text: Column) -> Column:
    """Words of a text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), passes: int = PASSES) -> DataFrame:
    """Per source: size, weight and target; ``sizes`` has (source, source_size).

    Targets are min(passes x size, level x weight) at the one level where they
    add up to the total of all sizes.  Sources sorted by cap / weight reach
    their caps in that order, so the level is that of the first source whose
    cap is not reached.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "place")
    every = Window.partitionBy()
    s = sizes.withColumn("place", F.row_number().over(order))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") - 1) % len(weights) + 1))
    s = s.withColumn("cap", F.col("source_size") * float(passes)).withColumn("ratio", F.col("cap") / F.col("weight"))
    s = s.withColumn("capped", F.sum("cap").over(by_ratio) - F.col("cap")).withColumn("total", F.sum("source_size").over(every))
    s = s.withColumn("open_weight", F.sum("weight").over(every) - F.sum("weight").over(by_ratio) + F.col("weight"))
    s = s.withColumn("level", (F.col("total") - F.col("capped")) / F.col("open_weight"))
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(every)["level"])
    return s.select("source", "place", "source_size", "total", F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target"))


def _hash_range(column: Column) -> Column:
    """The first three hex digits of a digest: 4096 equal ranges in digest order."""
    return F.substring(column, 1, 3)


def mix_sources(documents: DataFrame, weights: tuple[int, ...] = (1, 2, 3), passes: int = PASSES, seed: str = "mix") -> DataFrame:
    """Per row: doc_id, source, size, copy, source_size, target, taken (words taken, repeats counted)."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    return mix_sizes(docs, weights, passes, seed)


def mix_sizes(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), passes: int = PASSES, seed: str = "mix") -> DataFrame:
    """``mix_sources`` for rows that already have (doc_id, source, size)."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("copies"))
    rows = scratch.keep(rows.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")), "rows")
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, passes)
    targets = scratch.small(targets.withColumnRenamed("source", "t_source"), "targets")
    known = rows.join(targets, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    turns = known.filter("size > 0").select("doc_id", "copy", "place", "size", "source_size", "total", "target", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("turn"))
    turns = turns.filter(F.col("turn") * F.col("source_size") < F.col("target"))
    turns = turns.withColumn("key", F.md5(F.concat_ws(":", F.lit(seed), "turn", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "copy")))
    turns = turns.withColumn("range", _hash_range(F.col("key")))
    inside = Window.partitionBy("place", "turn", "range").orderBy("key", "doc_id", "size", "copy").rowsBetween(Window.unboundedPreceding, 0)
    queue = turns.withColumn("run", F.sum("size").over(inside)).drop("key")
    queue = scratch.keep(queue.select("doc_id", "copy", "place", "size", "turn", "range", "source_size", "total", "target", "run"), "queue")
    scratch.tidy()
    ranges = queue.groupBy("place", "turn", "range").agg(F.sum("size").alias("range_size"))
    earlier = Window.partitionBy("place", "turn").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # at most BUCKETS rows a source and pass
    ranges = scratch.small(ranges.select("place", "turn", "range", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)).alias("base")), "ranges")
    queue = queue.join(ranges, ["place", "turn", "range"])
    queue = queue.withColumn("finish", (F.col("turn") * F.col("source_size") + F.col("base") + F.col("run")) / F.col("target"))
    none = known.select("doc_id", "copy", "place", "size", F.lit(0).cast("long").alias("took"))
    taken = _truncated(queue, scratch).select("doc_id", "copy", "place", "size", F.col("size").alias("took")).union(none)
    out = taken.groupBy("doc_id", "copy", "place", "size").agg(F.sum("took").alias("taken"))
    named = targets.select(F.col("place"), F.col("t_source").alias("source"), F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"))
    return out.join(named, "place").select("doc_id", "source", F.col("size").cast("long").alias("size"), F.col("copy").cast("long").alias("copy"), "source_size", "target", F.col("taken").cast("long").alias("taken"))


def _truncated(queue: DataFrame, scratch: Scratch) -> DataFrame:
    """The head of the queue, in order of finish time, whose sizes add up to at most the total."""
    # two digits of the finish time, each of BUCKETS ranges; only the range that holds the end of the budget is looked into.
    # Ranges are of equal length up to LINEAR budgets and of equal ratio beyond, so there are some hundred thousand at most.
    far = LINEAR * (1 + F.log2(F.greatest(F.col("finish"), F.lit(float(LINEAR))) / LINEAR))
    q = queue.withColumn("digits", F.when(F.col("finish") <= LINEAR, F.col("finish")).otherwise(far) * BUCKETS).withColumn("hi", F.floor("digits"))
    hi = q.groupBy("hi").agg(F.sum("size").alias("s"), F.first("total").alias("total"))
    order = Window.orderBy("hi")
    hi = hi.withColumn("upto", F.sum("s").over(order)).filter(F.col("upto") - F.col("s") <= F.col("total"))
    end = hi.agg(F.max(F.when(F.col("upto") <= F.col("total"), F.col("hi"))).alias("whole"), F.max(F.when(F.col("upto") > F.col("total"), F.struct("hi", F.col("upto") - F.col("s")))).alias("cut")).first()
    whole = q.filter(F.col("hi") <= (-1 if end["whole"] is None else end["whole"]))
    if end["cut"] is None:
        return whole
    at, base = end["cut"]
    part = q.filter(F.col("hi") == at).withColumn("lo", F.floor((F.col("digits") - F.col("hi")) * BUCKETS))
    part = scratch.keep(part.select("doc_id", "copy", "place", "size", "turn", "total", "finish", "lo"), "end")
    before = Window.orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    lo = scratch.small(part.groupBy("lo").agg(F.sum("size").alias("s")).select("lo", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("before")), "digits")
    exact = Window.partitionBy("lo").orderBy("finish", "place", "turn", "doc_id", "size", "copy").rowsBetween(Window.unboundedPreceding, 0)
    part = part.join(lo, "lo").withColumn("cum", F.lit(base) + F.col("before") + F.sum("size").over(exact)).filter(F.col("cum") <= F.col("total"))
    columns = ["doc_id", "copy", "place", "size"]
    return whole.select(*columns).union(part.select(*columns))


def mixed(documents: DataFrame) -> DataFrame:
    """The documents that the mix takes, with ``mix_size`` (words) and ``mix_taken`` (words taken, repeats counted).

    The documents' columns come first; where one of them has such a name already, the new one gets an underscore
    at its end.  What is taken is joined back by doc_id, source and size, by broadcast while it is small, by
    shuffle beyond that; only rows that repeat these three are numbered before.
    """
    scratch = Scratch(documents.sparkSession)
    names = {k: fresh(documents, f"mix_{k}") for k in ("size", "taken", "id", "source", "copy", "words", "copies", "number")}
    mix = scratch.small(mix_sources(documents).filter("taken > 0"), "mix")
    scratch.tidy()
    own = [F.col(c) for c in documents.columns]
    sized = documents.withColumn(names["size"], word_count(F.col("text")))
    key = F.col("doc_id").cast("long").eqNullSafe(F.col(names["id"])) & F.col("source").cast("string").eqNullSafe(F.col(names["source"])) & (F.col(names["size"]) == F.col(names["words"]))

    def joined(rows: DataFrame, taken: DataFrame, on: Column) -> DataFrame:
        side = taken.select(F.col("doc_id").alias(names["id"]), F.col("source").alias(names["source"]), F.col("size").alias(names["words"]), F.col("copy").alias(names["copy"]), F.col("taken").alias(names["taken"]))
        return rows.join(side, on).select(*own, names["size"], names["taken"])

    again, seen = scratch.counted(_repeated(documents), "again")
    if not seen["rows"]:
        return joined(sized, mix, key)
    side = again.select(F.col("doc_id").alias(names["id"]), F.col("source").alias(names["source"]), F.col("size").alias(names["words"]))
    repeats = Window.partitionBy(F.col("doc_id"), F.col("source"), F.col(names["size"])).orderBy(F.xxhash64("text"))
    many = sized.join(checked_broadcast(side), key, "left_semi").withColumn(names["number"], F.row_number().over(repeats))
    once = sized.join(checked_broadcast(side), key, "left_anti")
    return joined(once, mix, key).union(joined(many, mix, key & (F.col(names["number"]) == F.col(names["copy"]))))


def _repeated(documents: DataFrame) -> DataFrame:
    """(doc_id, source, size) of rows that share all three."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    return rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("doc_id", "source", "size")


ORACLE_SQL = r"""
WITH z AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
d AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size) AS copy FROM z),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM s),
w AS (SELECT *, CAST((place - 1) % 3 + 1 AS DOUBLE) AS weight, CAST(source_size AS DOUBLE) * 3.0 AS cap FROM p),
r AS (SELECT *, cap / weight AS ratio, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM w),
c AS (SELECT *, sum(cap) OVER (ORDER BY ratio, place) - cap AS capped,
             sum(weight) OVER () - sum(weight) OVER (ORDER BY ratio, place) + weight AS open_weight FROM r),
l AS (SELECT *, (total - capped) / open_weight AS lev FROM c),
g AS (SELECT lev FROM l WHERE lev <= ratio ORDER BY ratio, place LIMIT 1),
t AS (SELECT l.source, place, source_size, total, least(cap, g.lev * weight) AS target FROM l, g),
x AS (SELECT d.doc_id, d.copy, t.place, d.size, t.source_size, t.total, t.target, turn,
             md5(concat_ws(':', 'mix', turn, coalesce(CAST(d.doc_id AS VARCHAR), '-'), d.copy)) AS key
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source, (SELECT unnest([0, 1, 2]) AS turn)
      WHERE d.size > 0 AND turn * t.source_size < t.target),
f AS (SELECT *, CAST(turn * source_size + sum(size) OVER (PARTITION BY place, turn ORDER BY key, doc_id NULLS FIRST, size, copy ROWS UNBOUNDED PRECEDING) AS DOUBLE) / target AS finish FROM x),
u AS (SELECT *, sum(size) OVER (ORDER BY finish, place, turn, doc_id NULLS FIRST, size, copy ROWS UNBOUNDED PRECEDING) AS cum FROM f),
k AS (SELECT doc_id, copy, place, size, sum(size) AS taken FROM u WHERE cum <= total GROUP BY ALL)
SELECT d.doc_id, d.size, CAST(t.source_size AS BIGINT) AS source_size, t.target, CAST(coalesce(k.taken, 0) AS BIGINT) AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source 
LEFT JOIN k ON k.doc_id IS NOT DISTINCT FROM d.doc_id AND k.place = t.place AND k.size = d.size AND k.copy = d.copy
"""
