"""Chat windows, periodic runs and point-in-time features against brute force, with nulls, ties, repeats, long rows and clashing columns."""

import datetime as dt
import hashlib
import random
import re
import threading
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import chat, common, features, licenses, mixing, pii, registry, runs, vectors

from ..oracle import DATA, rows, spark_rows, sql_rows

SF = DATA / "sf0.001"

# ---- chat windows

TURNS = "conv_id long, turn long, role string, text string, window int, lead string"
MANY = [(3, k, ("user", "assistant")[k % 2], f"t{k} " * (k % 23), 1, "x") for k in range(700)]
ODD_TURNS = [
    (1, 0, "system", "be brief ## </turn>", 1, "x"),
    (1, 1, "user", None, None, None),
    (1, 1, "user", None, None, None),
    (1, 2, None, "who: \\c \\\\ \\/turn> ###", 1, "x"),
    (1, 3, "assistant", "</turn>\n### user: x\\", 1, "x"),
    (1, None, "assistant", "", 1, "x"),
    (2, 5, "a: b\\", "word " * 3000, 1, "x"),
    (2, 6, "assistant", "é😀 " * 900, 1, "x"),
    (None, 1, "assistant", "no id", 1, "x"),
    *MANY,
    (4, 0, "system", "rule " * 450, 1, "x"),
    *[(4, k, ("user", "assistant")[k % 2], "w " * 60, 1, "x") for k in range(1, 40)],
]


def in_order(turns):
    return sorted(turns, key=lambda r: (chat.NO_TURN if r[1] is None else r[1], r[2] or "", r[3] or ""))


def test_windows_give_every_turn_back_once_and_keep_their_budget(spark):
    formatted = chat.windows(spark.createDataFrame(ODD_TURNS, TURNS)).cache()
    read = {(r.conv_id, r.stretch, r.window): r for r in chat.read_back(formatted).collect()}
    for conv in {r[0] for r in ODD_TURNS}:
        own = in_order([r for r in ODD_TURNS if r[0] == conv])
        got = [read[k] for k in sorted((k for k in read if k[0] == conv), key=lambda k: k[1:])]
        assert [(t.role, t.text) for r in got for t in r.turns] == [(r[2] or "", r[3] or "") for r in own]
        assert [t for r in got for t in r.learned] == [r[3] or "" for r in own if r[2] == "assistant"]
    tokens = lambda text: len(text.split()) + chat.MARK_TOKENS
    for r in formatted.collect():
        pieces = r.text.split(chat.END)[:-1]
        assert all(p.startswith(chat.HEAD) for p in pieces) and len(pieces) > r.repeated
        texts = [p[len(chat.HEAD) :].split(chat.COLON, 1)[1] for p in pieces]
        if len(pieces) - r.repeated > 1:
            assert sum(map(tokens, texts)) <= chat.BUDGET + (tokens("rule " * 450) if r.conv_id == 4 else 0)
        if r.conv_id == 4:
            assert pieces[0].startswith("### system: rule")
        assert len(texts[: r.repeated]) <= 1 + chat.HISTORY_TURNS
    again = [r for r in formatted.collect() if r.conv_id == 3]
    assert len(again) > 10 and sum(r.repeated > 0 for r in again) > len(again) / 2  # history is repeated, also over stretches
    formatted.unpersist()


def test_windows_are_those_of_a_loop(spark):
    formatted = chat.windows(spark.createDataFrame(MANY, TURNS)).orderBy("stretch", "window").collect()
    sizes = [len(r[3].split()) + chat.MARK_TOKENS for r in MANY]
    start, want = 0, []
    for k in range(1, len(MANY) + 1):
        if k == len(MANY) or k % chat.STRETCH_TURNS == 0 or sum(sizes[start : k + 1]) > chat.BUDGET - chat.HISTORY:
            back = start
            while back > 0 and sum(sizes[back - 1 : start]) <= chat.HISTORY and start - (back - 1) <= chat.HISTORY_TURNS:
                back -= 1
            want.append((start - back, "".join(f"### {r[2]}: {r[3]}</turn>\n" for r in MANY[back:k])))
            start = k
    assert [(r.repeated, r.text) for r in formatted] == want


def test_digests_of_odd_tables(spark):
    df = spark.createDataFrame(ODD_TURNS, TURNS)
    got = {r.conv_id: r for r in chat.digests(chat.windows(df)).collect()}
    for conv in {r[0] for r in ODD_TURNS}:
        own = in_order([r for r in ODD_TURNS if r[0] == conv])
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        learned = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat.digests(chat.windows(df.limit(0))).collect() == []


def test_control_conversation_stays_two_turns(spark):
    got = chat.digests(chat.windows(chat.control_conversation(spark))).collect()
    assert [(r.conv_id, r.n_turns, r.loss_sha256) for r in got] == [(-7, 2, hashlib.sha256(chat.CONTROL.encode()).hexdigest())]


def test_chat_plans_have_no_python(spark):
    df = registry.queries()["op11_chat_formatting"](spark, str(SF))
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


# ---- periodic runs


def brute_runs(w, least=runs.LEAST_WORDS):
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            s, n = i, j + q - i
            if n >= max(least, 2 * q) and not any(all(w[k] == w[k + r] for k in range(s, s + n - r)) for r in range(1, q)):
                out.append((s, n, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_kept(w, found):
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_planted(doc_id, text):
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    w = split(text)
    if h is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


@pytest.mark.parametrize("few", [0, 24, 1 << 30])
def test_refinement_is_brute_force(monkeypatch, few):
    monkeypatch.setattr(runs, "FEW", few)
    rng = random.Random(few)
    for _ in range(250):
        texts = []
        for _ in range(rng.randint(1, 4)):
            n, k = rng.randint(0, 60), rng.choice([1, 2, 3, 8])
            d = [rng.randrange(k) for _ in range(n)]
            if n > 3 and rng.random() < 0.5:
                p, a = rng.randint(1, n // 2), rng.randrange(n)
                d = [d[i] if i < a else d[a + (i - a) % min(p, n - a)] for i in range(n)]
            texts.append(d)
        symbols, at = runs._symbols(np.array([x for d in texts for x in d], np.uint64), np.cumsum([0, *map(len, texts)]))
        for least in (2, 12):
            start, length, period = runs.runs_of(symbols, least)
            own = np.searchsorted(at, start, "right") - 1
            got = [[(int(s - at[o]), int(n), int(p)) for s, n, p, o in zip(start, length, period, own, strict=True) if o == k] for k in range(len(texts))]
            assert got == [brute_runs(d, least) for d in texts]


ODD_TEXTS = [
    (1, None, "en"),
    (2, "", "en"),
    (3, " \t\n", "en"),
    (4, "a b " * 3000 + "A", None),
    (5, "x\x0bx\x0cx x\x00x x x " * 9, "en"),
    (6, "tick " * 11, "en"),
    (7, "tick " * 12, "en"),
    (7, "tick " * 12, "en"),
    (8, "é😀 ü " * 7 + "end", "en"),
    (None, "n m o " * 5, "en"),
    (9, "the cat sat on the mat " * 2 + "and left", "en"),
    (0, " ".join(f"w{k}" for k in range(400)), "en"),
]


@pytest.mark.parametrize("most", [runs.BATCH_WORDS, 10])
def test_runs_of_odd_texts(spark, monkeypatch, most):
    monkeypatch.setattr(runs._pieces, "__defaults__", (most,))
    df = spark.createDataFrame(ODD_TEXTS, "doc_id long, text string, runs string")
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.kept) for r in runs.find_runs(df).collect()), key=repr)
    want = []
    for i, t, _ in ODD_TEXTS:
        w = split(t)
        found = brute_runs(w) if len(w) < 1000 else [(0, 6000, 2)]
        want.append((i, len(w), found, brute_kept(w, found)))
    assert got == sorted(want, key=repr)
    assert runs.find_runs(df.limit(0)).collect() == []


def test_digests_of_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    short = docs.filter(F.length("text") < 2500)
    got = {r.doc_id: r for r in registry.runs.digests(runs.find_runs(runs.planted(short))).collect()}
    seen = 0
    for d in short.collect():
        w = brute_planted(d.doc_id, d.text)
        found, r = brute_runs(w), got[d.doc_id]
        seen += bool(found)
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(brute_kept(w, found).encode()).hexdigest()
    assert seen > 5


def test_long_planted_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    long = docs.filter((F.length("text") >= 2500) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0)).orderBy(F.desc(F.length("text"))).limit(5)
    texts = {r.doc_id: r.text for r in runs.planted(long).collect()}
    for d in long.collect():
        assert split(texts[d.doc_id]) == brute_planted(d.doc_id, d.text)
    for r in runs.find_runs(runs.planted(long)).collect():
        w = brute_planted(r.doc_id, {d.doc_id: d.text for d in long.collect()}[r.doc_id])
        assert r.kept == brute_kept(w, [tuple(x) for x in r.runs])
        for s, n, q in r.runs:  # each is a run: periodic, cannot be extended, no smaller period
            assert n >= max(12, 2 * q) and all(w[k] == w[k + q] for k in range(s, s + n - q))
            assert (s == 0 or w[s - 1] != w[s + q - 1]) and (s + n == len(w) or w[s + n] != w[s + n - q])
            assert all(w[s : s + n - k] != w[s + k : s + n] for k in range(1, q))


# ---- point-in-time features

CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, start long"
SALES = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int, t long"
LINES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz, chunk long"
DAY = dt.timedelta(days=1)
T0 = dt.datetime(2024, 1, 10)


def shop(rng, n=260, clients=(1, 1, 1, 2, 3, None)):
    when = lambda none=0.05: None if rng.random() < none else T0 + dt.timedelta(seconds=rng.choice([0, 3600 * rng.randrange(0, 700), rng.randrange(0, 2_500_000)]))
    after = lambda t: None if rng.random() < 0.05 else (t or T0) + dt.timedelta(seconds=rng.choice([0, 60, 4000, 90_000, 900_000]))
    money = lambda: rng.choice([None, 0.0, -3.335, 1.005, 12.345, 2.0e14, float("nan"), float("inf"), 99.99])
    clicks, sales, lines = [], [], []
    for k in range(n):
        t = when()
        clicks.append((rng.choice([k, k // 2, None]), t, after(t), rng.choice(clients), rng.choice(["purchase", "click", None]), money(), rng.choice([None, "{}"]), 5))
    clicks += rng.choices(clicks, k=40) + [(*c[:6], "other", 5) for c in clicks[:10]]
    for k in range(n // 2):
        t = when()
        sales.append((rng.choice([k, k, k, None]), rng.choice(clients), "done", money(), t, after(t), 1, 6))
    sales += rng.choices(sales, k=10)
    for _ in range(2 * n):
        t = when()
        lines.append((rng.choice([None, 7, *range(n // 2)]), 1, rng.choice([None, 1, 1, 1, 2, 3]), 1, 1, money(), 0.0, "kept", t, 9))
    lines += rng.choices(lines, k=30)
    return clicks, sales, lines


def brute_features(clicks, sales, lines, windows, lag, label_days):
    """By loops over all rows, from the contract's words."""
    cents = lambda xs: sum(int(np.floor(100 * x + 0.5)) for x in xs if x is not None and abs(x) < 1e13)
    same = lambda c: tuple("nan" if isinstance(x, float) and x != x else x for x in c)
    once = list({same(c): c for c in clicks}.values())
    out = []
    for s in sales:
        if s[1] is None or s[4] is None:
            continue
        t = s[4] + dt.timedelta(seconds=0 if s[0] is None else zlib.crc32(str(s[0]).encode()) % 259200)
        label = any(o[1] == s[1] and o[4] is not None and t < o[4] <= t + label_days * DAY for o in sales)
        for d in windows:
            c = [c for c in once if c[3] == s[1] and c[1] and c[2] and t - d * DAY < c[1] <= t and c[2] + lag <= t]
            o = [o for o in sales if o[1] == s[1] and o[4] and o[5] and t - d * DAY < o[4] <= t and o[5] + lag <= t]
            li = [x for q in o for x in lines if q[0] is not None and x[0] == q[0] and x[8] and x[8] <= t]
            last = max((x for x in c if x[0] is not None), key=lambda x: (x[1], x[0]), default=(None,))[0]
            out.append((s[0], d, int((t - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1)), label, len(c), sum(x[4] == "purchase" for x in c), cents(x[5] for x in c), last, len(o), cents(x[3] for x in o), len(li), len({x[2] for x in li} - {None}), cents(x[5] for x in li)))
    return sorted(out, key=repr)


NAMES = ["sale_id", "d", "t_us", "label", "n_clicks", "n_purchases", "click_cents", "last_click_id", "n_sales", "sale_cents", "n_lines", "n_items", "line_cents"]


@pytest.mark.parametrize(("hot", "windows"), [(1 << 16, (2, 14)), (40, (2, 14)), (3, (2, 14)), (40, (1, 3, 30))])
def test_features_are_those_of_loops(spark, monkeypatch, hot, windows):
    monkeypatch.setattr(features, "chunk_rows", lambda *tables: hot)
    made = shop(random.Random(hot))
    tables = [spark.createDataFrame(x, kind) for x, kind in zip(made, (CLICKS, SALES, LINES), strict=True)]
    got = features.features(*tables, windows=windows)
    assert got.columns == NAMES
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_features(*made, windows, dt.timedelta(minutes=240), 7)


def test_features_of_empty_tables(spark):
    made = shop(random.Random(1), 60)
    tables = [spark.createDataFrame(x, kind) for x, kind in zip(made, (CLICKS, SALES, LINES), strict=True)]
    none = [t.limit(0) for t in tables]
    assert features.features(none[0], none[1], none[2]).collect() == []
    assert features.features(tables[0], none[1], tables[2]).collect() == []
    got = features.features(none[0], tables[1], none[2])
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_features([], made[1], [], (2, 14), dt.timedelta(minutes=240), 7)


def test_features_do_not_depend_on_the_session_zone(spark):
    made = shop(random.Random(2), 80)
    tables = [spark.createDataFrame(x, kind) for x, kind in zip(made, (CLICKS, SALES, LINES), strict=True)]
    want = brute_features(*made, (2, 14), dt.timedelta(minutes=240), 7)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert sorted((tuple(r) for r in features.features(*tables).collect()), key=repr) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_no_window_of_features_lacks_a_key(spark):
    plan = registry.queries()["op13_point_in_time"](spark, str(SF))._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


@pytest.mark.parametrize("name", ["op11_chat_formatting", "op13_point_in_time"])
def test_same_rows_at_a_hundredth(spark, name):
    sf = DATA / "sf0.01"
    assert spark_rows(registry.queries()[name](spark, str(sf))) == sql_rows(registry.oracle_sql()[name], sf)


def test_sql_agrees_with_loops(tmp_path, spark):
    """The SQL itself, on rows that the given tables do not have."""
    made = shop(random.Random(5), 120)
    finite = [[tuple(None if isinstance(v, float) and not abs(v) < 1e13 else v for v in r) for r in t] for t in made]
    con = duckdb.connect()
    for name, data, kind in zip(("clicks", "sales", "sale_lines"), finite, (CLICKS, SALES, LINES), strict=True):
        spark.createDataFrame(data, kind).drop("start", "t", "chunk").write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    got = con.sql(features.ORACLE_SQL)
    known = [r for r in brute_features(*finite, (2, 14), dt.timedelta(minutes=240), 7) if r[0] is not None]
    order = sorted(range(len(NAMES)), key=lambda k: NAMES[k])
    assert [r for r in rows(got.columns, got.fetchall()) if r[NAMES_SORTED.index("sale_id")] is not None] == sorted((tuple(r[k] for k in order) for r in known), key=repr)


NAMES_SORTED = sorted(NAMES)


# ---- bounds that older operators keep


def test_neighbours_are_never_short(spark, monkeypatch):
    """Cells smaller than k, very uneven ones, and unclustered vectors: min(k, candidates) rows for each query."""
    monkeypatch.setattr(vectors, "CELL_ROWS", 100)
    rng = np.random.default_rng(17)
    sizes = [2000, 700, *[5] * 60, 3, 1, 1]
    centres = rng.normal(size=(len(sizes), 32)) * 10
    x = np.concatenate([c + 0.05 * rng.normal(size=(n, 32)) for c, n in zip(centres, sizes, strict=True)] + [rng.normal(size=(400, 32))])
    x = x[rng.permutation(len(x))]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(-1, [float("inf")] * 32), (20, [float("-inf")] + [0.0] * 31)]
    got = vectors.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    queries = [i for i in range(len(x)) if i % 20 == 0]
    assert sorted(by) == queries and all(sorted(k for k, _ in v) == list(range(1, 21)) for v in by.values())
    found = 0
    for q in queries:
        s = x @ x[q]
        s[q] = -np.inf
        found += len({i for _, i in by[q]} & set(np.argsort(-s)[:20].tolist()))
    assert found >= 0.9 * 20 * len(queries)
    few = vectors.nearest(spark.createDataFrame(rows[:7], "vec_id long, embedding array<double>")).collect()
    assert sorted((r.query_id, r.rank) for r in few) == [(0, k) for k in range(1, 7)]


def test_the_largest_scores_are_those_of_a_sort():
    rng = np.random.default_rng(2)
    for n in (5, 100, 5000):
        for k in (1, 20, 512):
            for scores in (rng.normal(size=n), rng.integers(0, 4, n).astype(float), np.zeros(n), np.sort(rng.normal(size=n)), np.tile([9.0] + [0.0] * 7, n)[:n]):
                top = vectors._top(scores, k)
                assert len(set(top.tolist())) == min(n, k) and sorted(scores[top]) == sorted(np.sort(scores)[-k:])


@pytest.mark.parametrize("n", [0, 10, 3000])
def test_as_many_frequent_rows_as_fit(spark, n):
    rows = [(k, 7) for k in range(3000)] + [(-k, 100 + k) for k in range(1, 41)]
    df = spark.createDataFrame(rows, "h long, c long")
    got = [r.c for r in common.most_frequent(df, "c", 40 + n).collect()]
    assert sum(c > 7 for c in got) == 40 and 0.5 * n - 1 <= len(got) - 40 <= n
    assert common.most_frequent(df, "c", 5000).count() == 3040 and common.most_frequent(df.limit(0), "c", 5).count() == 0
    assert len({r.c for r in common.most_frequent(df, "c", 20).collect()}) >= 18


def test_scratches_of_threads_are_apart(spark):
    mine = common.Scratch(spark)
    seen = []
    t = threading.Thread(target=lambda: (common.Scratch.close_since(0), seen.append(len(common.Scratch.opened))))
    t.start()
    t.join()
    kept = mine.keep(spark.range(3))
    assert seen == [0] and kept.count() == 3 and common.Scratch.opened.items[-1] is mine
    common.Scratch.close_since(len(common.Scratch.opened) - 1)


def test_large_licence_files_take_little_time(spark):
    m = licenses.train(spark.createDataFrame([("x",)], "text string"))
    body = licenses.licence_texts("header")["MIT"]
    words = [f"name{k}" for k in range(3000)]
    rng = random.Random(4)
    texts = {"copies": (body + "\n") * (5_000_000 // len(body)), "notices": "".join(f"{rng.choice(words)} {rng.choice(words)}\n{body}\n" for _ in range(4_500_000 // len(body)))}
    for text in texts.values():
        raw = np.frombuffer(text.encode(), np.uint8)
        h, _ = licenses.tc.words(*licenses.normalise(raw, np.array([0, len(raw)])))
        ids, began = m.terms.find(h), time.process_time()
        header = licenses._best(m, ids)
        assert header[0] == "MIT" and header[1] == pytest.approx(1, abs=1e-6) and time.process_time() - began < 10


def test_licences_of_the_odd_table(spark):
    long = " ".join(f"w{k % 97}" for k in range(9000))
    rows = [(1, None, None, "a"), (2, "", None, "a"), (3, " ", "a/b", "a"), (4, "Released under the MIT License.", None, "a"), (4, "Released under the MIT License.", "x/LICENSE", "a"), (5, long, "x/y", "a"), (None, long + " Released under the MIT License.", "x/z/q", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, path string, own string")
    got = sorted(((r.doc_id, r.path, r.license, r.origin) for r in licenses.scan(df).collect()), key=repr)
    assert got == sorted([(1, None, None, "none"), (2, None, None, "none"), (3, "a/b", None, "none"), (4, None, "MIT", "file"), (4, "x/LICENSE", "MIT", "file"), (5, "x/y", "MIT", "inherited"), (None, "x/z/q", "MIT", "header")], key=repr)
    assert licenses.scan(df.limit(0)).count() == 0


def test_contexts_tell_long_lexemes_apart():
    tail = "x" * 80
    one, two = (pii.contexts(f"see {c}{tail} is 12345678", len(f"see {c}{tail} is ")) for c in "ab")
    assert one != two and len(one) == len(two) == 1 and all(len(p) < 200 for p in one + two)
    assert pii.contexts(f"see {'y' * 64} is 12345678", 72)== [f"{'y' * 64} is"]
    assert pii.contexts("a b c 1", 6) == ["a b c", "b c"] and pii.contexts("12", 0) == []


@pytest.mark.parametrize("linear", [4, 0.001])
def test_mix_with_very_many_sources(spark, monkeypatch, linear):
    """Finish times far beyond the budget: the end of the mix is found in few bins, and in order."""
    monkeypatch.setattr(mixing, "LINEAR", linear)
    rng = random.Random(6)
    rows = [(k, "w " * rng.randint(1, 30), "big" if k % 2 else f"s{k % 600}") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df.createOrReplaceTempView("documents")
    got = mixing.mix_sources(df).select("doc_id", "size", "source_size", "target", "taken")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows[:3000])
    want = con.sql(mixing.ORACLE_SQL)
    plain = lambda data: sorted((a, b, c, round(d, 6), e) for a, b, c, d, e in data)
    assert plain(tuple(r) for r in got.collect()) == plain(want.fetchall())
    assert sum(r.taken for r in got.collect()) <= sum(len(r[1].split()) for r in rows)
