"""Sources, sinks, models, streaming, command line and the fuzzy rules, against plain Python."""

import collections
import gzip
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from corpusmill import cli, session
from corpusmill.functions import fuzzy
from corpusmill.functions import text as T
from corpusmill.operators import clean, dedup, overlap, prompts, retrieve, sampling
from corpusmill.plans import models
from corpusmill.sources import files
from corpusmill.streaming import incremental

from .oracle import DATA


def lines_of(path):
    return [x for f in sorted(path.glob("part-*")) for x in f.read_text().splitlines()]


def test_jsonl_leaves_out_damaged_files_whole(spark, tmp_path):
    good, bad, zipped = tmp_path / "a.jsonl", tmp_path / "b.jsonl", tmp_path / "c.json.gz"
    good.write_text('{"text": "one", "more": 1}\n{"other": 2}\n')
    bad.write_text('{"text": "two"}\n{"text": \n')
    zipped.write_bytes(gzip.compress('{"text": "dr\u00ee"}\n'.encode()))
    got = files.jsonl(spark, str(tmp_path), raw=True, numbered=True).orderBy("file", "doc_idx").collect()
    assert [(r.file.rsplit("/", 1)[1], r.doc_idx, r.text) for r in got] == [("a.jsonl", 0, "one"), ("a.jsonl", 1, None), ("c.json.gz", 0, "dr\u00ee")]
    assert got[0].raw == '{"text": "one", "more": 1}'
    assert files.many(spark, [str(good)], "text string").count() == 2


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    want = {}
    for name, n in (("x.txt", 3000), ("y.txt", 1), ("z.txt", 2500)):
        want |= {(name, k): f"{name} {k} {'p' * (k % 40)}" for k in range(n)}
        (tmp_path / name).write_text("".join(f"{want[name, k]}\n" for k in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = files.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {(r.file.rsplit("/", 1)[1], r.doc_idx): r.raw for r in got} == want and len(got) == len(want)


def test_howto_csv_skips_rows_of_another_width(spark, tmp_path):
    (tmp_path / "h.csv").write_text('headline,title,text\n"a","b","line\nline ""q"""\nx,y\n1,2,3,4\nu,v,w\n')
    rows = files.howto_csv(spark, str(tmp_path / "h.csv"))
    assert sorted(map(tuple, rows.collect())) == [("a", "b", 'line\nline "q"'), ("u", "v", "w")] and rows.select("title").count() == 2


def test_titles_listing_and_names(spark, tmp_path):
    (tmp_path / "wiki_00.jsonl").write_text("x\n")
    (tmp_path / "other.jsonl").write_text("y\n")
    (tmp_path / "t.txt").write_text(" Tea\nTea \n\n")
    assert [r[0] for r in files.matching(spark, str(tmp_path)).collect()] == ["x"]
    assert sorted(r[0] for r in files.titles(spark, str(tmp_path / "t.txt")).collect()) == ["", "Tea"]
    row = spark.range(1).select(files.web_split(F.lit(7)).alias("s"), files.split_number(F.lit("train.00012")).alias("n"), files.split_number(F.lit("wiki")).alias("none"), files.split_file(F.lit("c4"), F.lit("train.00007")).alias("f"), files.split_file(F.lit("wikipedia"), F.lit("wiki_01")).alias("g"), files.corpus_root(F.lit("foo")).alias("r")).first()
    assert tuple(row) == ("train.00007", 12, None, "c4-train.00007-of-01024.json.gz", "wiki_01.jsonl", "wikihow")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, 'a "q" \\ b'), (1, "z")], "idx long, s string")
    files.write_lines(df.withColumn("raw", F.to_json(F.struct("idx"))), str(tmp_path / "v"), "idx")
    assert lines_of(tmp_path / "v") == ['{"idx":1}', '{"idx":2}']
    files.write_jsonl(df, str(tmp_path / "j"))
    assert {json.loads(x)["s"] for x in lines_of(tmp_path / "j")} == {'a "q" \\ b', "z"}
    files.write_double_encoded(df, str(tmp_path / "d"))
    assert {json.loads(json.loads(x))["s"] for x in lines_of(tmp_path / "d")} == {'a "q" \\ b', "z"}
    files.write_errors(df.select(F.col("idx").alias("index"), F.lit("No, none").alias("exception")), str(tmp_path / "e"))
    assert spark.read.csv(str(tmp_path / "e"), header=True).filter("exception = 'No, none'").count() == 2
    files.write_dataset(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    files.write_metric(df.agg(F.avg("idx").alias("accuracy")), str(tmp_path / "m"))
    assert json.loads("".join(lines_of(tmp_path / "m"))) == {"accuracy": 1.5}
    vectors = spark.createDataFrame([("g", "s1", 0, [1.0])], "`group` string, split string, doc_idx long, embedding array<float>")
    for _ in range(2):
        files.write_vectors(vectors, str(tmp_path / "x"))
    assert spark.read.parquet(str(tmp_path / "x")).filter("`group` = 'g' and split = 's1'").count() == 1
    one = next((tmp_path / "m").glob("part-*"))
    entry = files.manifest(spark, str(one)).first()
    assert (entry.name, entry.bytes, entry.sha256) == (one.name, one.stat().st_size, hashlib.sha256(one.read_bytes()).hexdigest())
    assert files.folder_size(spark, str(tmp_path / "m")).first().bytes == sum(f.stat().st_size for f in (tmp_path / "m").iterdir() if not f.name.startswith((".", "_")))


def test_models_and_length(spark):
    rows = models.embed(spark.createDataFrame([(1, "a b"), (2, None), (3, "a b")], "doc_id long, text string"), ("doc_id",), batch=2).orderBy("doc_id").collect()
    assert rows[0].embedding == rows[2].embedding and set(rows[1].embedding) == {0.0}
    said = models.generate(spark.createDataFrame([(1, "p")], "doc_id long, prompt string"), ("doc_id",)).first()
    assert json.loads(said.task_sample)["answer"] == "A"
    assert [models.model_length(*x) for x in ((None, "llama-3"), (None, "mistral"), (16384, "x"), (100, "x"))] == [8192, 16384, 8192, 100]


def test_incremental_embedding_runs_once_a_file(spark, tmp_path):
    src, out, at = (str(tmp_path / x) for x in ("src", "out", "at"))
    for n in (1, 2):
        spark.createDataFrame([(n, "some text")], "doc_id long, text string").write.mode("append").parquet(src)
        incremental.embed_new_files(spark, src, out, at)
        incremental.embed_new_files(spark, src, out, at)
        assert spark.read.parquet(out).count() == n
    stored = spark.createDataFrame([("train.00003",), ("train.00011",)], "split string")
    assert incremental.next_split(stored) == 12 and incremental.next_split(stored.limit(0)) == 0


def test_chunks_keep_rows_without_a_key(spark):
    df = spark.createDataFrame([(None,), (5,), (5,), (1,), (None,), (900_000,)], "k long")
    assert sorted((r.chunk, r.k or 0) for r in clean.chunks(df, "k", 2).collect()) == [(0, 0), (0, 0), (1, 1), (1, 5), (2, 5), (2, 900_000)]
    grouped = df.withColumn("g", F.when(F.col("k") == 5, "x"))
    assert clean.chunks(grouped, "k", 2, "g").count() == 6
    parts = collections.Counter(r.part for r in sampling.even_parts(spark.range(10), 4, "id").collect())
    assert parts == {1: 3, 2: 3, 3: 2, 4: 2} and {r.part for r in sampling.even_parts(spark.range(3), 4, "id").collect()} == {1}
    of = clean.file_chunks(spark.createDataFrame([(f, k) for f, n in (("a", 3), ("b", 4), ("c", 5), ("d", 1)) for k in range(n)], "file string, k int"), "file", 5)
    assert {(r.file, r.chunk) for r in of.collect()} == {("a", 0), ("b", 0), ("c", 1)}


def test_final_dataset_raises_when_rows_are_too_few(spark):
    with pytest.raises(ValueError):
        sampling.final_dataset(spark.range(3), spark.range(2), 10, "id")


def test_odd_vectors_take_no_part_in_retrieval(spark):
    corpus = spark.createDataFrame([("s", 1, [1.0, 0.0]), ("s", 2, [1.0]), ("s", 3, None), ("s", 4, [float("nan"), 1.0]), ("s", 5, [None, 1.0]), ("s", 6, [0.0, 0.0])], "label string, vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(0, [2.0, 0.0])], "fs_id long, embedding array<float>")
    assert {r.vec_id: r["mean"] for r in retrieve.similarities(corpus, queries, ("vec_id",)).collect()} == {1: 1.0, 6: 0.0}
    assert retrieve.similarities(corpus, queries.limit(0), ("vec_id",)).count() == 0


def brute_ratio(x, y):
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for c in a:
            new = [0]
            for k, d in enumerate(b):
                new.append(row[k] + 1 if c == d else max(row[k + 1], new[-1]))
            row = new
        return row[-1]

    def ratio(a, b):
        return 100 * 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 100

    a, b = (set("".join(c if c.isalnum() else " " for c in t).lower().split()) for t in (x, y))
    if not a or not b:
        return 0
    both, left, right = " ".join(sorted(a & b)), " ".join(sorted(a - b)), " ".join(sorted(b - a))
    if both and (not left or not right):
        return 100
    p, q = (both + " " + left).strip(), (both + " " + right).strip()
    return round(max(ratio(p, q), *((ratio(both, p), ratio(both, q)) if both else (0, 0))))


TEXTS = ["the quick brown fox", "quick the brown fox!", "the quick brown foxes", "a slow red dog", "colour", "color", "", "fox", "slow red dogs a", "the quick brown fox", "unrelated words here", "colours"]


def test_ratio_is_that_of_the_definition():
    for x in TEXTS:
        for y in TEXTS:
            assert fuzzy.token_set_ratio(x, y) == brute_ratio(x, y), (x, y)


def test_common_words_alone():
    sets = [frozenset(fuzzy.tokens(t)) for t in hard_texts(random.Random(5), 60)]
    for least in (55, 85, 86, 100):
        for x in sets:
            for y in sets:
                both = len(" ".join(sorted(x & y)))
                whole = [round(200 * both / (both + len(" ".join(z)))) if both else 0 for z in (x, y)]
                assert fuzzy.covers(x, y, least) == (bool(x & y) and (x <= y or y <= x or max(whole) >= least))


@pytest.mark.parametrize("rows", [2, 2000])
def test_greedy_rule(spark, rows):
    texts = TEXTS + [f"{t} {k}" for k, t in enumerate(TEXTS)]
    kept: list[tuple[int, str]] = []
    for i, t in enumerate(texts):
        if t in {u for _, u in kept} or all(brute_ratio(t, u) < 85 for _, u in kept):
            kept.append((i, t))
    pairs = {(r.a, r.b) for r in dedup.similar_pairs(spark.createDataFrame([(i, t) for i, t in enumerate(dict.fromkeys(texts))], "idx long, text string"), 85, rows).collect()}
    once = list(dict.fromkeys(texts))
    assert pairs == {(i, j) for j in range(len(once)) for i in range(j) if brute_ratio(once[i], once[j]) >= 85}
    df = spark.createDataFrame(list(enumerate(texts)), "idx long, text string")
    assert sorted(map(tuple, dedup.greedy(df, "idx", "text", block_rows=rows).collect())) == kept
    shots = df.filter("idx in (0, 3)")
    assert {r.idx for r in dedup.against(df, shots, "text").collect()} == {i for i, t in enumerate(texts) if max(brute_ratio(t, texts[0]), brute_ratio(t, texts[3])) < 85}


def hard_texts(rng, n):
    """Words that nearly repeat, one word that is most of a text, texts within texts, no common word, long and short ones."""
    words = ["a", "an", "and", "ant", "band", "bands", "colour", "colours", "color", "internationalisation", "x" * 40, "é", "fox", "foxes", *(f"w{k}" for k in range(12))]
    out = []
    for _ in range(n):
        t = rng.sample(words, rng.randint(1, rng.choice([2, 5, 12, 20])))
        out.append(" ".join(t))
        if rng.random() < 0.7:
            u = list(" ".join(t))
            for _ in range(rng.randint(0, 1 + len(u) // 8)):
                k = rng.randrange(len(u))
                u[k] = rng.choice(["", u[k] + rng.choice("abx "), rng.choice("abx ")])
            out.append("".join(u))
        if rng.random() < 0.3:
            out.append(" ".join(f"{w}{rng.choice('sz')}" for w in t))
        if rng.random() < 0.2:
            out.append(" ".join(t + [f"v{k}" for k in range(rng.randint(1, 60))]))
    return list(dict.fromkeys(out))


@pytest.mark.parametrize(("least", "limits"), [(85, {}), (85, {"LONG_WORDS": 4, "RARITY_BITS": 2, "BAND": 3.0}), (70, {"RARITY_BITS": 1, "BAND": 1.02}), (96, {"LONG_WORDS": 1}), (55, {})])
def test_no_similar_pair_is_lost(spark, monkeypatch, least, limits):
    for k, v in limits.items():
        monkeypatch.setattr(dedup, k, v)
    texts = hard_texts(random.Random(least), 45)
    want = {(i, j) for j in range(len(texts)) for i in range(j) if brute_ratio(texts[i], texts[j]) >= least}
    df = spark.createDataFrame(list(enumerate(texts)), "idx long, text string")
    assert {(r.a, r.b) for r in dedup.similar_pairs(df, least, 16).collect()} == want and len(want) > 20


def test_each_kind_of_candidate_is_lossless(spark):
    texts = [t for t in hard_texts(random.Random(1), 60) if fuzzy.tokens(t)]
    sets = list(dict.fromkeys(" ".join(sorted(fuzzy.tokens(t))) for t in texts))
    df = spark.createDataFrame(list(enumerate(sets)), "node long, words string")
    covered = {(r.a, r.b) for r in dedup.covering(df, 85).collect()}
    near = {(r.a, r.b) for r in dedup.alike(df, 85, 20).collect()}
    for j in range(len(sets)):
        for i in range(j):
            x, y = set(sets[i].split(" ")), set(sets[j].split(" "))
            both = len(" ".join(sorted(x & y)))
            if both and max(200 * both / (both + len(sets[k])) for k in (i, j)) >= 84.5:
                assert (i, j) in covered
            elif brute_ratio(sets[i], sets[j]) >= 85:
                assert (i, j) in near


@pytest.mark.parametrize("words", [(3, 5), (8, 12), (25, 35), (70, 90)])
def test_unlike_strings_are_no_candidates(spark, words):
    rng = random.Random(words[0])
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(3, 8)))
    common, base_of = [word() for _ in range(30)], {}
    for k in range(60):
        base = [word() if rng.random() < 0.7 else rng.choice(common) for _ in range(rng.randint(*words))]
        for share in (0, 0.2, 0.4, 0.6):
            edited = [w[:at] + rng.choice(["", "x", w[at] + "y"]) + w[at + 1 :] if rng.random() < share else w for w in base for at in [rng.randrange(len(w))]]
            base_of[" ".join(sorted(set(edited)))] = k
    sets = list(base_of)
    df = spark.createDataFrame(list(enumerate(sets)), "node long, words string")
    near, covered = ({(r.a, r.b) for r in f.collect()} for f in (dedup.alike(df, 85, 64), dedup.covering(df, 85)))
    of = [frozenset(s.split(" ")) for s in sets]
    true = {(i, j) for j in range(len(sets)) for i in range(j) if fuzzy.set_ratio(of[i], of[j]) >= 85}
    assert true <= near | covered and len(true - covered) > 5
    assert sum(base_of[sets[i]] != base_of[sets[j]] for i, j in near - true) < 0.001 * len(sets) ** 2


def test_greedy_with_repeated_and_null_ids(spark):
    rows = [(1, "alpha beta gamma delta", 1), (1, "alpha beta gamma delta epsilon", 2), (2, "zeta eta", 3), (None, "alpha beta gamma delta", 4), (None, "iota kappa", 5), (None, None, 6), (3, "", 7), (3, "zeta eta", 8), (4, "eta zeta", 9), (5, "!!", 10)]
    df = spark.createDataFrame(rows, "idx long, text string, _words int")
    # equal ids go by text, null ids come last, texts without words stay
    assert sorted(r._words for r in dedup.greedy(df, "idx", "text").collect()) == [1, 3, 4, 5, 6, 7, 8, 10]
    assert sorted(r._words for r in dedup.greedy(df, "idx", "text", drop_exact=True).collect() if r.text) == [1, 3, 5, 10]
    assert dedup.greedy(df.limit(0), "idx", "text").collect() == [] and dedup.greedy(df, "idx", "text").columns == df.columns


def test_few_pairs_of_sentences_are_compared(spark):
    said = spark.read.parquet(str(DATA / "sf0.001" / "documents.parquet")).select(F.explode(F.split("text", r"[.!?\n]+")).alias("text"))
    sets = dedup.with_words(said.distinct().limit(3000), "text", "words").filter("words <> ''").select("words").distinct().withColumn("node", F.monotonically_increasing_id()).cache()
    n = sets.count()
    few = dedup.covering(sets, 85).union(dedup.alike(sets, 85)).distinct().count()
    sets.unpersist()
    assert few < 0.05 * n * (n - 1) / 2


def test_fuzzy_queries_follow_the_rule(spark):
    from corpusmill.plans import registry

    sf = str(DATA / "sf0.001")
    b = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {}
    for i, t in b:
        best = max(fuzzy.token_set_ratio(t, u) for j, u in b if j < 8)
        if i >= 8 and best < 85:
            want[i] = best
    assert {r.idx: r.best_ratio for r in registry.queries()["fuzzy_vs_fewshots"](spark, sf).collect()} == want
    parts = sorted((r.p_partkey, r.p_name) for r in spark.read.parquet(f"{sf}/part.parquet").collect())
    kept = []
    for i, t in parts:
        if all(u == t or fuzzy.token_set_ratio(t, u) < 85 for _, u in kept):
            kept.append((i, t))
    assert sorted(map(tuple, registry.queries()["fuzzy_dedup"](spark, sf).select("idx", "text").collect())) == kept


def test_ngrams_of_odd_texts(spark):
    df = spark.createDataFrame([(1, "A b c d E f"), (1, "a b c d e"), (2, None), (3, "a b"), (None, "a b c d e")], "k long, text string")
    assert df.select(T.word_ngrams(F.col("text"), 5)).collect()[0][0] == ["a b c d e", "b c d e f"]
    hits = overlap.ngram_hits(df, df.filter("k = 1").limit(1), "k")
    assert sorted(map(tuple, hits.collect()), key=repr) == [(1, 3, 3), (None, 1, 1)]
    assert overlap.overlap_rate(hits).first().overlap_percent == 100.0 and overlap.ngram_hits(df, df.limit(0), "k").filter("n_hits > 0").count() == 0


@pytest.mark.parametrize("limits", [{"KNOWN": 3}, {"KNOWN": 0, "MAP_BITS": 9}, {"KNOWN": 0, "MAP_BITS": 20, "BITS_EACH": 400}])
def test_overlap_with_large_test_sets(spark, monkeypatch, limits):
    sf = DATA / "sf0.001"
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    docs = docs.select("doc_id", "text").union(spark.createDataFrame([(0, "a b c d e f"), (None, "one two three four five"), (None, None)], "doc_id long, text string"))
    bench = bench.select("text").union(spark.createDataFrame([("b c d e f",)], "text string"))
    want = sorted(map(tuple, overlap.ngram_hits(docs, bench, "doc_id").collect()), key=repr)
    for k, v in limits.items():
        monkeypatch.setattr(overlap, k, v)
    got = overlap.ngram_hits(docs, bench, "doc_id")
    assert sorted(map(tuple, got.collect()), key=repr) == want and sum(r[2] for r in want) > 10 and got.columns == ["doc_id", "n_grams", "n_hits"]


def test_shots_of_all_tasks_and_prompts(spark):
    row = spark.createDataFrame([("Make tea", "Ingredients:\nwater\n\nleaves\nSteps:\nboil\npour", "Sum it up\n\nlong\ntext", " short ")], "i string, o string, j string, s string")
    r, s = row.select(prompts.shot_recipe(F.col("i"), F.col("o")), prompts.shot_summary(F.col("j"), F.col("s"))).first()
    assert (r.instruction, r.ingredients, r.steps) == ("Make tea", ["water", "leaves"], ["boil", "pour"]) and (s.instruction, s.summary, s.long_but_clean_text) == ("Sum it up", "short", "long\ntext")
    docs = spark.createDataFrame([(1, " x "), (2, None)], "d long, text string")
    shots = spark.createDataFrame([(7, " t ", "{}")], "s long, t string, j string")
    got = {r.d: r.prompt for r in prompts.few_shot_prompts(docs, shots, "d", "text", "s", "t", "j", "Ask.").collect()}
    assert got == {1: f"[INST] Ask.{prompts.RULE}t [/INST] {{}}</s> [INST] Ask.{prompts.RULE}x [/INST] ", 2: None}
    assert prompts.choose_shots(docs, shots, "d", "s").count() == 2 and prompts.choose_shots(docs, shots.limit(0), "d", "s").count() == 0
    assert spark.range(1).select(prompts.with_eos(F.lit("a"), "Meta-Llama-3"), prompts.with_eos(F.lit("a"), "mistral"), prompts.eval_yes_no(F.lit("q")), prompts.eval_recipe(F.lit("r"))).first()[:] == ("a<|end_of_text|>", "a", "q\nA. yes\nB. no", "r")


def test_shared_folder_is_asked_for_on_a_cluster():
    class Conf:
        get = staticmethod(lambda *a: None)

    class Cluster:
        conf, sparkContext = Conf, type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        session.shared_dir(Cluster)


def test_command_line_from_corpus_to_metrics(spark, tmp_path):
    at = lambda *x: str(tmp_path.joinpath(*x))
    for name in ("c4", "wikipedia", "stackexchange", "wikihow"):
        (tmp_path / name).mkdir()
    (tmp_path / "wikipedia" / "wiki_00.jsonl").write_text("".join(json.dumps({"text": f"tea and water number {k}"}) + "\n" for k in range(60)))
    (tmp_path / "c4" / "c4-train.00000-of-01024.json.gz").write_bytes(gzip.compress("".join(json.dumps({"text": f"web page {k} on coffee", "url": "u"}) + "\n" for k in range(60)).encode()))
    for group in ("wikipedia", "c4"):
        for _ in range(2):
            cli.main(["embed", "--data_path", at(group), "--group_name", group, "--saving_path", at("vectors"), "--device", "cpu"], spark)
    assert spark.read.parquet(at("vectors")).count() == 120
    (tmp_path / "shots.jsonl").write_text("".join(json.dumps({"Text": f"tea and water {k}", "Instruction": f"What is it that number {k} asks?\nA. a\nB. b\nC. c\nD. d", "Output": "A"}) + "\n" for k in range(3)))
    (tmp_path / "r.cfg").write_text(f"--few_shot_path {at('shots.jsonl')}\n--embeddings_path {at('vectors')}\n--output_path {at('docs')}\n--num_docs 40\n--top_p 0.9\n" + "".join(f"--{x}_path {at(x)}/\n" for x in ("c4", "wikipedia", "stackexchange", "wikihow")))
    cli.main(["retrieve", f"@{at('r.cfg')}"], spark)
    docs = [json.loads(x)["text"] for x in lines_of(tmp_path / "docs")]
    assert len(docs) >= 20 and sum("tea" in d for d in docs) > len(docs) / 2
    cli.main(["create-tasks", "--few_shot_path", at("shots.jsonl"), "--corpus_samples_path", at("docs"), "--task", "medqa", "--num_final_task_samples", "5", "--deduplication_ratio", "100", "--max_new_tokens", "256", *[x for k in ("raw", "clean", "error_msgs", "final") for x in (f"--output_path_{k}", at(f"out_{k}"))]], spark)
    final = spark.read.parquet(at("out_final"))
    assert final.count() == 5 and final.filter("is_few_shot = 1").count() == 3 and len(lines_of(tmp_path / "out_raw")) == len(docs)
    cli.main(["finetune", "--train_dataset_path", at("out_final"), "--task", "medqa", "--model_name_or_path", "Llama", "--max_rows", "4", "--output_path", at("texts"), "--lora_r", "8"], spark)
    assert len(lines_of(tmp_path / "texts")) == 4 and all(json.loads(x)["text"].startswith("[INST] What") and json.loads(x)["text"].endswith("[/INST]A<|end_of_text|>") for x in lines_of(tmp_path / "texts"))
    (tmp_path / "said.json").write_text('{"row_id": 0, "text": "A", "logprobs": {"A": -0.1, "B": -2.0}, "choices": ["x", "y"]}\n{"row_id": 1, "text": "", "logprobs": {}, "choices": ["x", "y"]}\n')
    (tmp_path / "right.json").write_text("".join(json.dumps({"row_id": k, "instruction": "i", "answer": 0}) + "\n" for k in range(3)))
    cli.main(["evaluate", "--predictions_path", at("said.json"), "--references_path", at("right.json"), "--result_path", at("acc"), "--output_path", at("outputs")], spark)
    assert json.loads("".join(lines_of(tmp_path / "acc")))["accuracy"] == pytest.approx(1 / 3)
    assert sorted(json.loads(x)["prediction"] for x in lines_of(tmp_path / "outputs")) == ["A", "N/A"]
    (tmp_path / "pairs.json").write_text('{"row_id": 0, "swapped": true, "model_preference": 1}\n{"row_id": 1, "swapped": false, "model_preference": 1}\n')
    cli.main(["winrate", "--annotated_path", at("pairs.json"), "--result_path", at("win")], spark)
    assert json.loads("".join(lines_of(tmp_path / "win"))) == {"win_rate": 0.5}


def test_sets_of_one_length_meet_in_few_blocks(spark):
    sets = spark.range(9_000).select(F.col("id").alias("node"), F.format_string("w%06d", "id").alias("words"))
    assert dedup.dealt(sets, 0.155).count() == 9_000
