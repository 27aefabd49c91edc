"""Conversations as training windows of a token budget, in DataFrame functions only.

A turn is written as ``### role: text</turn>`` and a line end.  Inside texts and
roles a backslash is doubled, ``##`` becomes ``#\\#``, ``</turn>`` becomes
``<\\/turn>``, and in roles ``:`` becomes ``\\c``; so no text can look like a mark,
and reading back undoes it exactly.

Running sums of the turns' tokens are taken in order of turn.  A window takes
turns while they end within ``budget - history`` tokens (less what a system turn
takes) of its start, always whole turns and one at least.  Before them it repeats
the conversation's system turn, if its first turn is one, and the last turns that
start within ``history`` tokens and ``history_turns`` turn numbers before the
window.  The loss mask of a window covers the texts of its new assistant turns
alone; repeated ones are context.  So each assistant text is learned once.

A conversation of any length is dealt out in stretches of ``stretch_turns`` turn
numbers, each with the few rows before it that may be repeated; a stretch's end
ends a window.  Nothing gathers a whole conversation but ``digests``, whose
contract is one digest over all of it, in one row.

Defined cases: a null text or role is an empty one; rows with a null turn come
first; rows of one turn go by role, then text, and repeated rows are turns of
their own; a null conv_id is a conversation; a turn over the budget is a window
of its own, uncut; a system turn leaves at least a quarter of the budget to new
turns; an empty table gives no rows; other columns, whatever their names, are
left behind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .mixing import word_count

BUDGET = 512
HISTORY = 128
HISTORY_TURNS = 8
STRETCH_TURNS = 128
MARK_TOKENS = 6
SYSTEM, ASSISTANT = "system", "assistant"
HEAD, COLON, END = "### ", ": ", "</turn>\n"
NO_TURN = -(1 << 60)
#: The query's own conversation: both of its turns look like marks.
CONTROL_ID, CONTROL = -7, r"\### Assistant: </turn> ok"


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("##"), F.lit("#\\#")), F.lit("</turn>"), F.lit("<\\/turn>"))


def unescaped(text: Column) -> Column:
    """What ``escaped`` was given; pairs of backslashes are taken from the left, so that what stands between them is read alone."""
    between = F.transform(F.split(text, r"\\\\"), lambda x: F.replace(F.replace(F.replace(x, F.lit("\\#"), F.lit("#")), F.lit("\\/"), F.lit("/")), F.lit("\\c"), F.lit(":")))
    return F.array_join(between, "\\")


def turn_head(role: Column) -> Column:
    return F.concat(F.lit(HEAD), F.replace(escaped(role), F.lit(":"), F.lit("\\c")), F.lit(COLON))


def _stretches(rows: DataFrame, history_turns: int, stretch_turns: int) -> DataFrame:
    """conv_id, stretch, turns: turns in order with their running sums; ``again`` marks rows of the stretch before."""
    stretch = F.floor(F.col("t") / stretch_turns)
    late = F.pmod(F.col("t"), F.lit(stretch_turns)) >= stretch_turns - history_turns
    at = F.array(F.struct(stretch.alias("stretch"), F.lit(False).alias("again")), F.when(late, F.struct((stretch + 1).alias("stretch"), F.lit(True).alias("again"))))
    dealt = rows.withColumn("at", F.explode(F.array_compact(at))).select("conv_id", F.col("at.stretch").alias("stretch"), F.col("at.again").alias("again"), "t", "role", "text", "tokens")
    upto = Window.partitionBy("conv_id", "stretch").orderBy("t", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumn("end", F.sum("tokens").over(upto))
    turn = F.struct("end", "t", "role", "text", "again", (F.col("end") - F.col("tokens")).alias("start"))  # ends rise in order of turn
    return summed.groupBy("conv_id", "stretch").agg(F.array_sort(F.collect_list(turn)).alias("turns")).filter(F.exists("turns", lambda x: ~x["again"]))


def _numbered(room: Column) -> Column:
    """The window of each turn of ``turns``, from 0; -1 for rows of the stretch before."""

    def step(acc: Column, x: Column) -> Column:
        full = (acc["w"] < 0) | ((x["end"] - acc["start"] > room) & (x["start"] > acc["start"]))
        new = ~x["again"] & full
        w = acc["w"] + new.cast("int")
        return F.struct(F.when(new, x["start"]).otherwise(acc["start"]).alias("start"), w.alias("w"), F.concat(acc["ws"], F.array(F.when(x["again"], F.lit(-1)).otherwise(w))).alias("ws"))

    return F.aggregate("turns", F.struct(F.lit(0).cast("long").alias("start"), F.lit(-1).alias("w"), F.array().cast("array<int>").alias("ws")), step)["ws"]


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_turns: int = HISTORY_TURNS, stretch_turns: int = STRETCH_TURNS, tokens: Callable[[Column], Column] = word_count) -> DataFrame:
    """conv_id, stretch, window, repeated (leading turns that are not new), text, loss (spans in code points, end exclusive)."""
    rows = conversations.select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(NO_TURN)).alias("t"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tokens", tokens(F.col("text")) + MARK_TOKENS)
    system = F.when(F.col("role") == SYSTEM, F.col("text"))
    first = rows.groupBy("conv_id").agg(F.min(F.struct("t", "role", system.alias("text"), "tokens")).alias("lead")).filter(F.col("lead.role") == SYSTEM)
    first = first.select(F.col("conv_id").alias("lead_id"), "lead")
    held = _stretches(rows, history_turns, stretch_turns).join(first, F.col("conv_id").eqNullSafe(F.col("lead_id")), "left")
    room = F.greatest(F.lit(budget - history) - F.coalesce(F.col("lead.tokens"), F.lit(0)), F.lit(budget // 4))
    held = held.withColumn("ws", _numbered(room)).withColumn("window", F.explode(F.sequence(F.lit(0), F.array_max("ws"))))
    turns, lead, w = F.arrays_zip("turns", "ws"), F.col("lead"), F.col("window")
    own = F.transform(F.filter(turns, lambda x: x["ws"] == w), lambda x: x["turns"])
    is_lead = lambda x: F.coalesce((x["t"] == lead["t"]) & (x["role"] == SYSTEM) & (x["text"] == lead["text"]), F.lit(False))
    cut = held.select("conv_id", "stretch", "window", "turns", "ws", "lead", own.alias("own")).withColumn("head", F.col("own")[0])
    before = F.filter("turns", lambda x: (x["end"] <= F.col("head.start")) & (x["start"] >= F.col("head.start") - history) & (x["t"] >= F.col("head.t") - history_turns) & ~is_lead(x))
    kept = F.when(lead.isNotNull() & ~is_lead(F.col("head")), F.array(F.struct(F.lit(SYSTEM).alias("role"), lead["text"].alias("text")))).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
    said = lambda a: F.transform(a, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    cut = cut.select("conv_id", "stretch", "window", F.concat(kept, said(before)).alias("again"), said(F.col("own")).alias("own"))
    piece = lambda x: F.struct((x["role"] == ASSISTANT).alias("learned"), turn_head(x["role"]).alias("head"), escaped(x["text"]).alias("body"))
    cut = cut.select("conv_id", "stretch", "window", F.size("again").alias("repeated"), F.transform(F.concat("again", "own"), piece).alias("pieces"))
    cut = cut.withColumn("sizes", F.transform("pieces", lambda x: F.char_length(x["head"]) + F.char_length(x["body"]) + len(END)))

    def span(x: Column, i: Column) -> Column:
        at = F.aggregate(F.slice("sizes", F.lit(1), i), F.lit(0), lambda a, n: a + n) + F.char_length(x["head"])
        return F.when((i >= F.col("repeated")) & x["learned"], F.struct(at.alias("start"), (at + F.char_length(x["body"])).alias("end")))

    text = F.array_join(F.transform("pieces", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "")
    return cut.select("conv_id", "stretch", "window", "repeated", text.alias("text"), F.array_compact(F.transform("pieces", span)).alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, stretch, window, turns (role, text; new ones), learned (texts under the mask), from nothing but ``windows``' rows."""
    pieces = F.split("text", END)
    new = F.slice(pieces, F.col("repeated") + 1, F.size(pieces) - 1 - F.col("repeated"))

    def turn(x: Column) -> Column:
        role = F.substring_index(F.substr(x, F.lit(len(HEAD) + 1)), COLON, 1)
        return F.struct(unescaped(role).alias("role"), unescaped(F.substr(x, F.char_length(role) + len(HEAD) + len(COLON) + 1)).alias("text"))

    learned = F.transform("loss", lambda s: unescaped(F.substr(F.col("text"), s["start"] + 1, s["end"] - s["start"])))
    return formatted.select("conv_id", "stretch", "window", F.transform(new, turn).alias("turns"), learned.alias("learned"))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows: turns and what is learned, as digests; and the characters of all windows."""
    sizes = formatted.withColumn("chars", F.char_length("text").cast("long"))
    read = read_back(sizes).withColumn("chars", F.lit(0).cast("long"))
    told = read.select("conv_id", "stretch", "window", F.size("turns").alias("n"), F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").alias("said"), F.array_join("learned", "").alias("learned"), "chars")
    sized = sizes.select("conv_id", "stretch", "window", F.lit(0).alias("n"), F.lit("").alias("said"), F.lit("").alias("learned"), "chars")
    both = told.unionByName(sized)
    parts = F.array_sort(F.collect_list(F.struct("stretch", "window", "said", "learned")))
    out = both.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), parts.alias("parts"), F.sum("chars").alias("formatted_chars"))
    whole = lambda name: F.array_join(F.transform("parts", lambda x: x[name]), "")
    out = out.select("conv_id", "n_turns", whole("said").alias("said"), whole("learned").alias("learned"), "formatted_chars")
    return out.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.sha2("said", 256).alias("turns_sha256"), F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"))


def control_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -7: a user and an assistant turn full of marks."""
    turn = lambda k, role: F.struct(F.lit(CONTROL_ID).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(CONTROL).alias("text"))
    return spark.range(1).select(F.explode(F.array(turn(0, "user"), turn(1, ASSISTANT))).alias("x")).select("x.*")


_TEXT = "replace(replace(replace(text, '\\', '\\\\'), '##', '#\\#'), '</turn>', '<\\/turn>')"
ORACLE_SQL = rf"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CONTROL}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROL}'),
s AS (SELECT *, CAST(floor(turn / {STRETCH_TURNS}) AS BIGINT) AS stretch, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + {MARK_TOKENS} AS tokens,
  length({_TEXT}) + length(role) + {len(HEAD) + len(COLON) + len(END)} AS chars FROM c),
b AS (SELECT *, sum(tokens) OVER o - tokens AS a, sum(tokens) OVER o AS e, row_number() OVER (PARTITION BY conv_id, stretch ORDER BY turn, role, text) AS k, row_number() OVER o AS place
  FROM s WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)),
l AS (SELECT conv_id, tokens AS lead_tokens, chars AS lead_chars FROM b WHERE place = 1 AND role = 'system'),
m AS (SELECT b.*, greatest({BUDGET - HISTORY} - coalesce(lead_tokens, 0), {BUDGET // 4}) AS room, lead_chars FROM b LEFT JOIN l ON l.conv_id = b.conv_id),
r(conv_id, stretch, k, w, start) AS (SELECT conv_id, stretch, k, 0, a FROM m WHERE k = 1
  UNION ALL SELECT m.conv_id, m.stretch, m.k, CASE WHEN m.e - r.start > m.room THEN r.w + 1 ELSE r.w END, CASE WHEN m.e - r.start > m.room THEN m.a ELSE r.start END
  FROM r JOIN m ON m.conv_id = r.conv_id AND m.stretch = r.stretch AND m.k = r.k + 1),
f AS (SELECT m.conv_id, m.stretch, r.w, arg_min(m.turn, m.place) AS turn, min(m.a) AS a, min(m.place) AS place, max(m.lead_chars) AS lead_chars FROM r JOIN m ON m.conv_id = r.conv_id AND m.stretch = r.stretch AND m.k = r.k GROUP BY m.conv_id, m.stretch, r.w),
h AS (SELECT f.conv_id, sum(m.chars) AS chars FROM f JOIN m ON m.conv_id = f.conv_id AND m.e <= f.a AND m.a >= f.a - {HISTORY} AND m.turn >= f.turn - {HISTORY_TURNS} AND NOT (m.place = 1 AND m.role = 'system') GROUP BY f.conv_id),
p AS (SELECT conv_id, sum(lead_chars) AS chars FROM f WHERE place > 1 GROUP BY conv_id),
d AS (SELECT conv_id, count(*) AS n_turns, sum(chars) AS chars, string_agg(role || chr(10) || text || chr(10), '' ORDER BY place) AS said, coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY place), '') AS learned FROM b GROUP BY conv_id)
SELECT d.conv_id, d.n_turns, sha256(said) AS turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars, sha256(learned) AS loss_sha256, CAST(d.chars + coalesce(h.chars, 0) + coalesce(p.chars, 0) AS BIGINT) AS formatted_chars
FROM d LEFT JOIN h ON h.conv_id = d.conv_id LEFT JOIN p ON p.conv_id = d.conv_id
"""
