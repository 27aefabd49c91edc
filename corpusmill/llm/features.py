"""Point-in-time features of every sale, from running sums over signed events.

What a window of ``d`` days counts at time t is what is active at t: a click or
sale from max(event, arrival + lag) until event + d, a line from max(its sale's
event, arrival + lag, shipping) until its sale's event + d.  So each gives a plus
row at its start and a minus row at each window's end, and each sale a probe row
at its own t; all go into one stream, and running sums in order of time, changes
before probes, hold every count at every probe.  The label is a count as well: a
sale is ahead from ``label_days`` before it until it happens.  Distinct items are
counted over stretches of time that an item's lines leave uncovered so far: the
running maximum of its sales' times tells where they end.  The last click is the
running maximum of (time, id); as windows have one length, it is in the window or
no click is.

A row of the stream is narrow: client, time, kind, a bit for each window it counts
in, a count and cents.  Changes of lines, whose times are few, are added up per
client and time before they are shuffled together.  Clients (and pairs of client
and item) of many rows are cut into chunks of time of about ``chunk_rows`` rows,
however they are spread over time; running sums are taken in each chunk, and the
totals of the earlier chunks are added.  So no task holds a client, only chunks and,
``SLOTS`` for each chunk, the counts of one hot client's slots of time.  A chunk has
the square root of all rows, so both grow as that; ``HOT_ROWS`` at least.  The stream
is written once to the shared folder.

Defined cases: times are UTC whatever the session's zone; rows without client,
event time or arrival are not counted, lines without sale, shipping or item are no
items; a sale without arrival is not counted but has its features and is ahead for
others; a null sale_id adds no seconds; repeated sales and lines count each time,
also each sale row of one id with that id's lines; fully equal clicks count once,
and those without id are never the last;
amounts that are null, not finite or of 10^13 and more are 0 cents; empty tables
give no rows or zeros; other columns are left behind, but tell clicks apart.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Scratch, checked_broadcast

WINDOWS = (2, 14)
LABEL_DAYS = 7
LAG_MINUTES = 240
SPREAD_SECONDS = 259_200
HOT_ROWS = 1 << 14
SLOTS = 16
SECOND = 1_000_000
DAY = 86_400 * SECOND
CLICK, PURCHASE, SALE, LINE, ITEM, AHEAD, PROBE = range(7)  # probes come last among equal times
STREAM = ("client_id", "at", "kind", "mask", "n", "cents", "ref", "id")


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a time that is UTC, with or without a zone of its type."""
    c, session = F.col(name), df.sparkSession.conf.get("spark.sql.session.timeZone")
    if df.schema[name].dataType.typeName() == "timestamp" or session in ("UTC", "Etc/UTC", "GMT", "Z"):
        return F.unix_micros(c.cast("timestamp"))
    seconds = F.unix_date(c.cast("date")).cast("long") * 86_400 + F.hour(c) * 3600 + F.minute(c) * 60
    return seconds * SECOND + (F.date_part(F.lit("SECOND"), c) * SECOND).cast("long")


def cents(amount: Column) -> Column:
    return F.when(F.abs(amount) < 1e13, F.floor(100 * amount.cast("double") + 0.5)).otherwise(0).cast("long")


def _bits(windows: tuple[int, ...], condition) -> Column:
    return reduce(add, [F.when(condition(d), 1 << k).otherwise(0) for k, d in enumerate(windows)])


def _stream(rows: DataFrame, kind: Column, changes: list[Column], money: Column | None = None, ref: Column | None = None, id_: Column | None = None) -> DataFrame:
    """Rows of the stream: each change is a struct (at, n, mask); those that count in no window are left out."""
    none = F.lit(None).cast("long")
    told = rows.select("client_id", kind.cast("int").alias("kind"), (F.lit(0) if money is None else money).cast("long").alias("money"), (none if ref is None else ref).alias("ref"), (none if id_ is None else id_).alias("id"), F.explode(F.filter(F.array(*changes), lambda x: x["mask"] != 0)).alias("x"))
    plus = F.col("x.n") > 0
    return told.select("client_id", F.col("x.at").alias("at"), "kind", F.col("x.mask").alias("mask"), F.col("x.n").alias("n"), (F.col("x.n") * F.col("money")).alias("cents"), F.when(plus, F.col("ref")).alias("ref"), F.when(plus, F.col("id")).alias("id"))


def _change(at: Column, n: int, mask: Column | int) -> Column:
    return F.struct(at.cast("long").alias("at"), F.lit(n).cast("long").alias("n"), (F.lit(mask) if isinstance(mask, int) else mask).cast("int").alias("mask"))


def _while_active(start: str, event: str, windows: tuple[int, ...]) -> list[Column]:
    """Plus at the start in the windows that it is in at all, minus at each such window's end."""
    ends = lambda d: F.col(event) + d * DAY
    return [_change(F.col(start), 1, _bits(windows, lambda d: F.col(start) < ends(d))), *[_change(ends(d), -1, F.when(F.col(start) < ends(d), 1 << k).otherwise(0)) for k, d in enumerate(windows)]]


def _same(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k) == F.col(f"hot_{k}") for k in keys])


def hot_chunks(rows: DataFrame, keys: list[str], at: str, most: int, scratch: Scratch) -> DataFrame:
    """Keys of over ``most`` rows (renamed hot_...), their first time, the width of their slots of time and each slot's chunk.

    A hot key has ``SLOTS`` slots for each ``most`` rows; chunks are slots one after the other that hold ``most`` rows.
    Every row goes through the join, hot or not, and is counted where it is.
    """
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("lo"), F.max(at).alias("hi")).filter(F.col("n") > most)
    slots = (SLOTS * F.ceil(F.col("n") / most)).cast("int")
    wide = n.select(*[F.col(k).alias(f"hot_{k}") for k in keys], "lo", slots.alias("slots"), F.ceil((F.col("hi") - F.col("lo") + 1) / slots).cast("long").alias("width"))
    wide, named = scratch.keep(wide, "wide"), [f"hot_{k}" for k in keys]
    slot = F.floor((F.col(at) - F.col("lo")) / F.col("width")).cast("int")
    counts = rows.join(checked_broadcast(wide), _same(keys), "left").groupBy(*named, slot.alias("slot")).agg(F.count(F.lit(1)).alias("rows"), F.max("slots").alias("hot"))
    # written, so that no condition of the next join is moved before this one
    counts = scratch.keep(counts.filter("hot is not null").select(*[F.col(c).alias(f"c_{c}") for c in (*named, "slot")], "rows"), "counts")
    every = wide.select(*named, "lo", "width", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"))
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"c_{c}") for c in (*named, "slot")])
    earlier = Window.partitionBy(*named).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    chunk = F.floor(F.coalesce(F.sum("rows").over(earlier), F.lit(0)) / most).cast("int")
    told = every.join(counts, same, "left").select(*named, "lo", "width", "slot", chunk.alias("chunk"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("slot", "chunk"))), lambda x: x["chunk"])
    return scratch.keep(told.groupBy(*named).agg(F.first("lo").alias("lo"), F.first("width").alias("width"), listed.alias("chunks")), "hot")


def chunked(rows: DataFrame, keys: list[str], at: str, hot: DataFrame) -> DataFrame:
    """``rows`` with ``chunk``: the chunk of time of a hot key, null for others."""
    slots = hot.agg(F.sum(F.size("chunks"))).first()[0] or 0  # at most SLOTS for each chunk
    side = F.broadcast(hot) if slots * 8 <= BROADCAST_BYTES else hot
    slot = F.least(F.greatest(F.floor((F.col(at) - F.col("lo")) / F.col("width")), F.lit(0)), F.size("chunks") - 1).cast("int")
    return rows.join(side, _same(keys), "left").withColumn("chunk", F.get("chunks", slot).cast("long")).drop(*[f"hot_{k}" for k in keys], "lo", "width", "chunks")


def _before(totals: DataFrame, keys: list[str], sums: dict[str, Column], scratch: Scratch) -> DataFrame:
    """Of each chunk of a hot key (renamed hot_..., base_...) what the chunks before it come to; one row a chunk."""
    earlier = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    out = totals.select(*[F.col(k).alias(f"hot_{k}") for k in keys], F.col("chunk").alias("hot_chunk"), *[f.over(earlier).alias(f"base_{name}") for name, f in sums.items()])
    return scratch.keep(out, "base")


def distinct_clicks(clicks: DataFrame) -> DataFrame:
    """client_id, click_id, ts, arrived, kind, money; fully equal rows once."""
    known = ("click_id", "ts", "arrived_at", "client_id", "kind", "value")
    rest = [c for c in clicks.columns if c not in known]
    told = F.xxhash64(*[F.col(f"`{c}`") for c in rest], *[F.col(f"`{c}`").isNull() for c in rest]) if rest else F.lit(0)
    rows = clicks.filter("client_id is not null and ts is not null and arrived_at is not null")
    rows = rows.select(F.col("client_id").cast("long").alias("client_id"), F.col("click_id").cast("long").alias("click_id"), micros(clicks, "ts").alias("ts"), micros(clicks, "arrived_at").alias("arrived"), "kind", "value", told.alias("rest")).distinct()
    return rows.select("client_id", "click_id", "ts", "arrived", F.when(F.col("kind") == "purchase", PURCHASE).otherwise(CLICK).alias("kind"), cents(F.col("value")).alias("money"))


def dated_sales(sales: DataFrame) -> DataFrame:
    """sale_id, client_id, sold, arrived (may be null), t, money of the sales with client and time."""
    rows = sales.filter("client_id is not null and sold_at is not null")
    later = F.coalesce(F.crc32(F.col("sale_id").cast("string").cast("binary")) % SPREAD_SECONDS, F.lit(0)) * SECOND
    sold = micros(sales, "sold_at")
    return rows.select("sale_id", F.col("client_id").cast("long").alias("client_id"), sold.alias("sold"), micros(sales, "arrived_at").alias("arrived"), (sold + later).alias("t"), cents(F.col("total")).alias("money"))


def chunk_rows(*tables: DataFrame) -> int:
    """Rows of a hot key's chunk: with the square root of all rows, chunks and the list of a key's chunks grow alike."""
    return max(HOT_ROWS, math.isqrt(sum(t.count() for t in tables)))


def item_changes(lines: DataFrame, windows: tuple[int, ...], most: int, scratch: Scratch) -> DataFrame:
    """Plus and minus rows of the distinct items of clients, from lines (client_id, item_id, start, sold)."""
    keys, lines = ["client_id", "item_id"], lines.filter("item_id is not null").select("client_id", "item_id", "start", "sold")
    hot = hot_chunks(lines, keys, "start", most, scratch)
    once = scratch.keep(chunked(lines, keys, "start", hot).groupBy(*keys, "chunk", "start").agg(F.max("sold").alias("sold")), "once")
    base = _before(once.filter("chunk is not null").groupBy(*keys, "chunk").agg(F.max("sold").alias("sold")), keys, {"sold": F.max("sold")}, scratch)
    earlier = Window.partitionBy(*keys, "chunk").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    rows = once.withColumn("own", F.max("sold").over(earlier))
    rows = rows.join(checked_broadcast(base), _same([*keys, "chunk"]), "left").withColumn("reach", F.greatest("own", "base_sold"))  # null: nothing before
    changes = []
    opens = {d: F.greatest(F.col("start"), F.col("reach") + d * DAY) for d in windows}  # greatest passes over nulls
    lasts = {d: opens[d] < F.col("sold") + d * DAY for d in windows}
    changes.append(_change(F.col("start"), 1, _bits(windows, lambda d: lasts[d] & (opens[d] == F.col("start")))))
    for k, d in enumerate(windows):
        changes.append(_change(opens[d], 1, F.when(lasts[d] & (opens[d] > F.col("start")), 1 << k).otherwise(0)))
        changes.append(_change(F.col("sold") + d * DAY, -1, F.when(lasts[d], 1 << k).otherwise(0)))
    return _stream(rows, F.lit(ITEM), changes)


def events(clicks: DataFrame, sales: DataFrame, lines: DataFrame, windows: tuple[int, ...], lag_minutes: int, label_days: int, scratch: Scratch) -> DataFrame:
    """The stream: plus and minus rows of clicks, sales, lines, items and sales ahead, and the probes; with chunks of hot clients."""
    lag, every, most = lag_minutes * 60 * SECOND, (1 << len(windows)) - 1, chunk_rows(clicks, sales, lines)
    seen = distinct_clicks(clicks).withColumn("start", F.greatest(F.col("ts"), F.col("arrived") + lag))
    told = dated_sales(sales)
    known = told.filter("arrived is not null").withColumn("start", F.greatest(F.col("sold"), F.col("arrived") + lag))
    shipped = lines.filter("sale_id is not null and shipped_at is not null").select("sale_id", F.col("item_id").cast("long").alias("item_id"), micros(lines, "shipped_at").alias("shipped"), cents(F.col("amount")).alias("money"))
    sent = shipped.join(known.select("sale_id", "client_id", "sold", F.col("start").alias("known")), "sale_id")
    sent = sent.select("client_id", "item_id", F.greatest("known", "shipped").alias("start"), "sold", "money").filter(F.col("start") < F.col("sold") + max(windows) * DAY)
    sent = scratch.keep(sent, "lines")
    few = _stream(sent, F.lit(LINE), _while_active("start", "sold", windows), F.col("money")).unionByName(item_changes(sent, windows, most, scratch))
    few = few.groupBy("client_id", "at", "kind", "mask").agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"), F.first("ref").alias("ref"), F.first("id").alias("id"))
    ahead = [_change(F.col("sold") - label_days * DAY, 1, every), _change(F.col("sold"), -1, every)]
    parts = [
        _stream(seen, F.col("kind"), _while_active("start", "ts", windows), F.col("money"), F.col("ts"), F.col("click_id")),
        _stream(known, F.lit(SALE), _while_active("start", "sold", windows), F.col("money")),
        _stream(told, F.lit(AHEAD), ahead),
        _stream(told, F.lit(PROBE), [_change(F.col("t"), 1, every)], None, None, F.col("sale_id").cast("long")),
        few,
    ]
    stream = reduce(DataFrame.unionByName, [p.select(*STREAM) for p in parts])
    # about where the stream's rows are: a click, sale or line changes counts at its time and when it leaves each window
    times = reduce(DataFrame.union, [clicks.filter("client_id is not null and ts is not null").select(F.col("client_id").cast("long").alias("client_id"), micros(clicks, "ts").alias("at")), told.select("client_id", "sold"), sent.select("client_id", "start")])
    times = times.select("client_id", F.explode(F.array(*[F.col("at") + d * DAY for d in (0, *windows)])).alias("at"))
    return chunked(stream, ["client_id"], "at", hot_chunks(times, ["client_id"], "at", most, scratch))


def _sums(windows: tuple[int, ...]) -> dict[str, Column]:
    kind, out = F.col("kind"), {"ahead": F.sum(F.when(F.col("kind") == AHEAD, F.col("n")))}
    for k in range(len(windows)):
        of = lambda what, *kinds, k=k: F.sum(F.when(kind.isin(*kinds) & (F.col("mask").bitwiseAND(1 << k) != 0), F.col(what)))
        out |= {f"n_clicks_{k}": of("n", CLICK, PURCHASE), f"n_purchases_{k}": of("n", PURCHASE), f"click_cents_{k}": of("cents", CLICK, PURCHASE), f"n_sales_{k}": of("n", SALE), f"sale_cents_{k}": of("cents", SALE), f"n_lines_{k}": of("n", LINE), f"n_items_{k}": of("n", ITEM), f"line_cents_{k}": of("cents", LINE)}
    return out


def features(clicks: DataFrame, sales: DataFrame, lines: DataFrame, windows: tuple[int, ...] = WINDOWS, lag_minutes: int = LAG_MINUTES, label_days: int = LABEL_DAYS) -> DataFrame:
    """Per sale (with client and time) and window: sale_id, d, t_us, label and the counts, cents and last click of that window at t."""
    scratch, keys = Scratch(clicks.sparkSession), ["client_id"]
    stream = scratch.keep(events(clicks, sales, lines, windows, lag_minutes, label_days, scratch), "stream")
    sums, click = _sums(windows), F.when(F.col("kind").isin(CLICK, PURCHASE) & (F.col("n") > 0) & F.col("id").isNotNull(), F.struct("ref", "id"))
    totals = stream.filter("chunk is not null").groupBy(*keys, "chunk").agg(*[f.alias(name) for name, f in sums.items()], F.max(click).alias("last"))
    base = _before(totals, keys, {name: F.sum(name) for name in sums} | {"last": F.max("last")}, scratch)
    upto = Window.partitionBy(*keys, "chunk").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    local = stream.select("client_id", "chunk", "at", "kind", "id", *[f.over(upto).alias(name) for name, f in sums.items()], F.max(click).over(upto).alias("last")).filter(F.col("kind") == PROBE)
    found = local.join(checked_broadcast(base), _same([*keys, "chunk"]), "left")
    now = lambda name: F.coalesce(F.col(name), F.lit(0)) + F.coalesce(F.col(f"base_{name}"), F.lit(0))
    last = F.greatest("last", "base_last")
    measures = ("n_clicks", "n_purchases", "click_cents", "n_sales", "sale_cents", "n_lines", "n_items", "line_cents")
    of = lambda k, d: F.struct(F.lit(d).alias("d"), *[now(f"{m}_{k}").alias(m) for m in measures], F.when(last["ref"] + d * DAY > F.col("at"), last["id"]).alias("last_click_id"))
    out = found.select(F.col("id").alias("sale_id"), F.col("at").alias("t_us"), (now("ahead") > 0).alias("label"), F.explode(F.array(*[of(k, d) for k, d in enumerate(windows)])).alias("x"))
    return out.select("sale_id", "x.d", "t_us", "label", "x.n_clicks", "x.n_purchases", "x.click_cents", "x.last_click_id", "x.n_sales", "x.sale_cents", "x.n_lines", "x.n_items", "x.line_cents")


_CENTS = "CAST(coalesce(sum(floor(100 * {x} + 0.5)), 0) AS BIGINT)"
ORACLE_SQL = f"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_of),
h AS (SELECT sale_id, client_id, sold_at, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(sale_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, crc_of[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM sales, crc WHERE client_id IS NOT NULL AND sold_at IS NOT NULL),
p AS (SELECT row_number() OVER () AS k, sale_id, client_id, sold_at + to_seconds(h % {SPREAD_SECONDS}) AS t FROM h),
w AS (SELECT unnest([{', '.join(map(str, WINDOWS))}]) AS d),
c AS (SELECT DISTINCT * FROM clicks),
fc AS (SELECT p.k, d, count(*) AS n_clicks, count(*) FILTER (WHERE kind = 'purchase') AS n_purchases, {_CENTS.format(x='value')} AS click_cents, arg_max(click_id, (ts, click_id)) AS last_click_id
  FROM p JOIN c ON c.client_id = p.client_id AND c.ts <= t AND c.arrived_at + INTERVAL {LAG_MINUTES} MINUTE <= t, w WHERE c.ts > t - to_days(d) GROUP BY p.k, d),
a AS (SELECT p.k, d, s.sale_id, s.total, p.t FROM p JOIN sales s ON s.client_id = p.client_id AND s.sold_at <= t AND s.arrived_at + INTERVAL {LAG_MINUTES} MINUTE <= t, w WHERE s.sold_at > t - to_days(d)),
fs AS (SELECT k, d, count(*) AS n_sales, {_CENTS.format(x='total')} AS sale_cents FROM a GROUP BY k, d),
fl AS (SELECT k, d, count(*) AS n_lines, count(DISTINCT item_id) AS n_items, {_CENTS.format(x='amount')} AS line_cents FROM a JOIN sale_lines l ON l.sale_id = a.sale_id AND l.shipped_at <= a.t GROUP BY k, d),
l AS (SELECT DISTINCT p.k FROM p JOIN sales s ON s.client_id = p.client_id AND s.sold_at > t AND s.sold_at <= t + to_days({LABEL_DAYS}))
SELECT p.sale_id, w.d, epoch_us(t) AS t_us, l.k IS NOT NULL AS label, coalesce(n_clicks, 0) AS n_clicks, coalesce(n_purchases, 0) AS n_purchases, coalesce(click_cents, 0) AS click_cents, last_click_id,
  coalesce(n_sales, 0) AS n_sales, coalesce(sale_cents, 0) AS sale_cents, coalesce(n_lines, 0) AS n_lines, coalesce(n_items, 0) AS n_items, coalesce(line_cents, 0) AS line_cents
FROM p CROSS JOIN w LEFT JOIN fc ON fc.k = p.k AND fc.d = w.d LEFT JOIN fs ON fs.k = p.k AND fs.d = w.d LEFT JOIN fl ON fl.k = p.k AND fl.d = w.d LEFT JOIN l ON l.k = p.k
"""
