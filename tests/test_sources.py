"""Damaged files, positions, digests, chunk files, splits written again, options: against plain Python."""

import gzip
import hashlib
import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill import cli
from corpusmill.operators import clean, evaluate, prompts, retrieve, sampling
from corpusmill.plans import models, registry, tokens
from corpusmill.sources import files, quoted, streams
from corpusmill.streaming import incremental


def packed(records, **more):
    return gzip.compress("".join(json.dumps(r) + "\n" for r in records).encode(), **more)


def name(path):
    return path.rsplit("/", 1)[-1]


@pytest.fixture
def corpus(tmp_path):
    rng = random.Random(3)
    rows = [{"text": " ".join(str(rng.random()) for _ in range(20)), "k": k} for k in range(2000)]
    whole = packed(rows)
    (tmp_path / "good.json.gz").write_bytes(whole)
    (tmp_path / "two_members.json.gz").write_bytes(packed(rows[:10]) + packed(rows[10:20]) + b"\0" * 512)
    (tmp_path / "cut.json.gz").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "cut_at_trailer.json.gz").write_bytes(whole[:-3])
    wrong = bytearray(whole)
    wrong[-6] ^= 1  # the checksum
    (tmp_path / "checksum.json.gz").write_bytes(bytes(wrong))
    flipped = bytearray(whole)
    flipped[len(whole) // 3] ^= 64
    (tmp_path / "flipped.json.gz").write_bytes(bytes(flipped))
    (tmp_path / "line.json.gz").write_bytes(packed(rows[:5]) + gzip.compress(b'{"text": \n') + packed(rows[5:9]))
    (tmp_path / "array.json.gz").write_bytes(gzip.compress(b'{"text": "a"}\n[1]\n'))
    (tmp_path / "utf8.json.gz").write_bytes(gzip.compress(b'{"text": "\xff"}\n'))
    (tmp_path / "not_gzip.json.gz").write_bytes(b'{"text": "plain"}\n')
    (tmp_path / "empty.json.gz").write_bytes(b"")
    (tmp_path / "blank.json.gz").write_bytes(gzip.compress(b"\n \n"))
    (tmp_path / "plain.jsonl").write_text('{"text": "p"}\n\n{"text": "q", "k": "x"}\n')
    (tmp_path / "plain_bad.jsonl").write_text('{"text": "p"}\n{"text"\n')
    (tmp_path / "no_rows.jsonl").write_text("")
    return tmp_path, rows


def test_damaged_files_are_left_out_whole_and_told_apart(spark, corpus):
    at, rows = corpus
    got = files.jsonl(spark, str(at), "text string, k long", numbered=True).collect()
    by = {}
    for r in got:
        by.setdefault(name(r.file), []).append((r.doc_idx, r.text, r.k))
    assert sorted(by) == ["good.json.gz", "plain.jsonl", "two_members.json.gz"]
    assert sorted(by["good.json.gz"]) == [(k, r["text"], r["k"]) for k, r in enumerate(rows)]
    assert sorted(by["two_members.json.gz"]) == [(k, r["text"], r["k"]) for k, r in enumerate(rows[:20])]
    assert sorted(by["plain.jsonl"]) == [(0, "p", None), (2, "q", None)]
    assert files.jsonl(spark, str(at / "cut.json.gz")).count() == 0
    told = {name(r.file): (r.verdict, r.records) for r in streams.ledger(spark, str(at)).collect()}
    assert {k for k, v in told.items() if v[0] == "damaged"} == {f"{x}.json.gz" for x in ("cut", "cut_at_trailer", "checksum", "flipped", "line", "array", "utf8", "not_gzip")} | {"plain_bad.jsonl"}
    assert {k for k, v in told.items() if v[0] == "empty"} == {"empty.json.gz", "blank.json.gz", "no_rows.jsonl"}
    assert told["good.json.gz"] == ("whole", 2000) and told["plain.jsonl"] == ("whole", 2)
    details = {name(r.file): r.detail for r in streams.ledger(spark, str(at)).filter("verdict = 'damaged'").collect()}
    assert all(details.values()) and "within a gzip member" in details["cut.json.gz"]


def test_blocks_and_lines_do_not_depend_on_block_sizes(monkeypatch):
    import io

    data = b"".join(b"x" * (k % 37) + (b"\r\n" if k % 5 == 0 else b"\n") for k in range(500)) + b"end"
    want = [x.removesuffix(b"\r") for x in data.split(b"\n")]
    for size in (1, 7, 4096):
        monkeypatch.setattr(streams, "BLOCK", size)
        assert list(streams.lines(streams.blocks(io.BytesIO(data)))) == want
        assert list(streams.lines(streams.inflated(streams.blocks(io.BytesIO(gzip.compress(data)))))) == want


def test_lines_by_position_read_blocks_with_hits_alone(spark, tmp_path):
    rng = random.Random(5)
    held = {}
    for k, n in enumerate((5000, 1, 777)):
        lines = [json.dumps({"text": "t" * rng.randrange(200, 400), "n": i}) for i in range(n)]
        (tmp_path / f"f{k}.jsonl").write_text("\n".join(lines) + ("\n" if k else ""))
        held[f"f{k}.jsonl"] = lines
    zipped = [json.dumps({"text": str(rng.random()), "n": i}) for i in range(3000)]
    (tmp_path / "z.json.gz").write_bytes(gzip.compress("\n".join(zipped).encode()))
    held["z.json.gz"] = zipped
    where = {name(r.path): r.path for r in streams.listed(spark, str(tmp_path)).collect()}
    wanted = {("f0.jsonl", i) for i in (0, 99, 100, 2000, 2001, 4999, 5000, 10**9)} | {("f1.jsonl", 0), ("f2.jsonl", 776), ("z.json.gz", 10)}
    hits = spark.createDataFrame([(where[f], i) for f, i in wanted] + [(where["f0.jsonl"], 99), (None, 1), (where["f0.jsonl"], None)], "file string, doc_idx long")
    want = {(f, i, held[f][i]) for f, i in wanted if i < len(held[f])}
    index = streams.line_index(spark, str(tmp_path), 100)
    entries = {(name(r.file), r.block): r.offset for r in index.collect()}
    for f in ("f0.jsonl", "f1.jsonl", "f2.jsonl"):
        data = (tmp_path / f).read_bytes()
        for block in range(len(held[f]) // 100 + (len(held[f]) % 100 > 0)):
            assert data[entries[f, block] :].split(b"\n", 1)[0].decode() == held[f][block * 100]
    streams_block, streams.BLOCK = streams.BLOCK, 4096
    try:
        for how in (index, None):
            got = streams.lines_at(spark, hits, how, 100).collect()
            assert {(name(r.file), r.doc_idx, r.raw) for r in got} == want and len(got) == len(want)
    finally:
        streams.BLOCK = streams_block
    read = lambda how: sum(r.bytes for r in streams.lines_at(spark, hits.filter("doc_idx between 2000 and 2001"), how, 100).collect())
    size = (tmp_path / "f0.jsonl").stat().st_size
    assert read(index) <= max(streams.BLOCK, size // 4) and read(None) > size // 3


def test_digests_of_files_and_their_check(spark, tmp_path):
    (tmp_path / "data").mkdir()
    contents = {"a b.bin": b"\0" * (3 << 20) + b"x", "b.txt": b"", "c.txt": b"c"}
    for n, c in contents.items():
        (tmp_path / "data" / n).write_bytes(c)
    sums = {n: hashlib.sha256(c).hexdigest() for n, c in contents.items()}
    assert {(r.name, r.bytes, r.sha256) for r in files.manifest(spark, str(tmp_path / "data")).collect()} == {(n, len(c), sums[n]) for n, c in contents.items()}
    (tmp_path / "all.sha256").write_text(f"{sums['a b.bin']}  ./data/a b.bin\n{'0' * 64} *b.txt\n\n{'1' * 64}  gone.txt\n")
    got = {r.name: r.state for r in streams.checked_digests(spark, str(tmp_path / "data"), str(tmp_path / "all.sha256")).collect()}
    assert got == {"a b.bin": "same", "b.txt": "differs", "c.txt": "unlisted", "gone.txt": "missing"}


def chunk_files(at):
    return {int(d.name.split("=")[1]): [[json.loads(x)["id"] for x in f.read_text().splitlines()] for f in d.glob("part-*")] for d in at.glob("chunk=*")}


def test_chunk_files_are_full_and_go_on(spark, tmp_path):
    at = tmp_path / "c"
    assert files.write_chunks(spark.range(95).repartition(7), str(at), "id", 10) == 10
    assert {k: v for k, v in chunk_files(at).items()} == {k: [list(range(10 * k, min(95, 10 * k + 10)))] for k in range(10)}
    assert files.write_chunks(spark.range(100, 128).repartition(3), str(at), "id", 10, append=True) == 13
    every = [*range(95), *range(100, 128)]
    assert chunk_files(at) == {k: [every[10 * k : 10 * k + 10]] for k in range(13)}
    assert files.write_chunks(spark.range(200, 207), str(at), "id", 10, append=True) == 13
    assert chunk_files(at)[12] == [[*every[120:], *range(200, 207)]]
    assert files.write_chunks(spark.range(300, 301), str(at), "id", 10, append=True) == 14
    assert files.write_chunks(spark.range(0), str(at), "id", 10, append=True) == 14


def test_splits_written_again_are_there_once(spark, tmp_path):
    rows = lambda split, n: spark.range(n).select(F.lit("g").alias("group"), F.lit(split).alias("split"), F.col("id").alias("doc_idx"), F.array(F.lit(1.0).cast("float")).alias("embedding"))
    at = str(tmp_path / "v")
    for split, n in (("a", 3), ("b", 2), ("a", 4), ("a", 4)):
        files.write_vectors(rows(split, n), at)
    assert sorted((r.split, r["count"]) for r in files.vector_store(spark, at).groupBy("split").count().collect()) == [("a", 4), ("b", 2)]
    some = files.vector_store(spark, at, ["g"], ["b"])
    assert some.count() == 2 and "PartitionFilters: [" in (plan := some._jdf.queryExecution().executedPlan().toString()) and "split" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert files.vector_store(spark, at, ["none"]).count() == 0


@pytest.mark.parametrize("key", ["s", "d", "k", "same"])
def test_places_in_order_of_any_key(spark, key):
    rng = random.Random(7)
    rows = [(rng.choice([None, *"abcdefg"]), rng.random(), rng.choice([None, 1, 2, 10**15, -5]), 1, k, "x") for k in range(400)]
    df = spark.createDataFrame(rows, "s string, d double, k long, same int, _place int, _before string")
    got = clean.numbered(df, key, "p").collect()
    assert sorted(r.p for r in got) == list(range(400)) and {r.p_total for r in got} == {400}
    order = sorted(got, key=lambda r: r.p)
    values = [(r[key] is not None, r[key] or 0) if key != "s" else (r.s is not None, r.s or "") for r in order]
    assert values == sorted(values)
    grouped = clean.numbered(df, key, "p", "s").collect()
    for g in {r[0] for r in rows}:
        own = sorted((r.p, r[key] is not None, r[key] or 0) if key != "s" else (r.p, True, 0) for r in grouped if r.s == g)
        assert [p for p, *_ in own] == list(range(len(own))) and [v for _, *v in own] == sorted(v for _, *v in own)
        assert {r.p_total for r in grouped if r.s == g} == {len(own)}
    assert clean.chunks(df, key, 150).columns == [*df.columns, "chunk"]
    assert sorted(r["count"] for r in clean.chunks(df, key, 150).groupBy("chunk").count().collect()) == [100, 150, 150]


def test_no_window_over_all_rows(spark):
    for df in (clean.numbered(spark.range(1000), "id", "p"), sampling.even_parts(spark.range(1000), 7, "id")):
        plan = df._jdf.queryExecution().toString()
        assert "SinglePartition" not in plan and "Window" not in plan


def test_exact_samples_with_repeated_keys(spark):
    df = spark.range(100).select((F.col("id") % 10).alias("k"), F.lit("text").alias("t"))
    for n in (0, 1, 15, 20, 99, 100, 200):
        got = sampling.exact(df, n, "k").collect()
        assert len(got) == min(n, 100)
    order = [r.k for r in df.select("k").distinct().orderBy(sampling.order_key("1234", F.col("k"))).collect()]
    assert sorted(r.k for r in sampling.exact(df, 15, "k").collect()) == sorted(order[:1] * 10 + order[1:2] * 5)


def test_best_rows_are_those_of_a_sort(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), rng.choice([k, None, k]), [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)]) for k in range(500)]
    rows += [("a", 900, [float("inf"), 0.0, 0.0]), ("a", 901, [float("nan"), 0.0, 0.0]), ("b", 902, None), ("b", 903, [1.0])]
    corpus = spark.createDataFrame(rows, "label string, vec_id long, embedding array<double>").repartition(9)
    queries = spark.createDataFrame([(0, [1.0, 0.5, 0.0]), (1, [float("inf"), 0.0, 0.0]), (2, [0.0, -1.0, 1.0])], "fs_id long, embedding array<double>")
    import numpy as np

    q = np.array([[1.0, 0.5, 0.0], [0.0, -1.0, 1.0]])
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    usable = [r for r in rows if r[0] is not None and r[1] is not None and r[2] and len(r[2]) == 3 and all(np.isfinite(r[2]))]
    want = set()
    for label in ("a", "b"):
        own = [r for r in usable if r[0] == label]
        s = np.array([r[2] for r in own]) @ q.T / np.maximum(np.linalg.norm([r[2] for r in own], axis=1, keepdims=True), 1e-12)
        s = np.concatenate([s, s.mean(axis=1, keepdims=True)], axis=1)
        for f, k in ((0, 4), (1, 4), (2, 11)):
            ranked = sorted((-retrieve.rounded(v, 6), r[1]) for v, r in zip(s[:, f], own, strict=True))[:k]
            want |= {(f if f < 2 else retrieve.MEAN, label, d, i + 1) for i, (_, d) in enumerate(ranked)}
    got = retrieve.best_rows(corpus, queries, "label", "vec_id", 4, 11)
    assert {(r.fs, r.label, r.vec_id, r.rn) for r in got.collect()} == want
    assert retrieve.best_rows(corpus, queries.limit(0), "label", "vec_id", 4, 11).count() == 0
    assert retrieve.retrieve(corpus, queries.filter("fs_id = 1"), "label", "vec_id", 0.5, 40).count() == 0


@pytest.mark.parametrize(("bins", "most"), [(1, 1 << 18), (7, 0), (1 << 13, 1 << 18)])
@pytest.mark.parametrize("p", [0.0, 0.1, 0.9, 5.0])
def test_shares_of_splits_are_those_of_a_sort(spark, monkeypatch, bins, most, p):
    monkeypatch.setattr(retrieve, "BINS", bins)
    monkeypatch.setattr(retrieve, "MOST_ENDS", most)
    rng = random.Random(13)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), k, [rng.choice([-1.0, -0.25, 0.0, 0.999999, 1.0, round(rng.uniform(-1, 1), 6)]) for _ in range(3)]) for k in range(300)] + [("one", 900, [0.5, 0.5, 0.5])]
    sims = spark.createDataFrame(rows, "label string, vec_id long, sims array<double>").repartition(5)
    want = set()
    for label in ("hot", "a", "b", "one"):
        own = [r for r in rows if r[0] == label]
        for f in range(3):
            want |= {(f, label, k, s[f]) for _, k, s in sorted(own, key=lambda r: (-r[2][f], r[1]))[: int(p * len(own) / 3 / 2)]}
    got = retrieve.per_query(sims, retrieve.split_sizes(sims, "label"), "label", "vec_id", 3, p).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_nan_is_no_prediction_and_metrics_are_one_object(spark):
    rows = spark.createDataFrame([("x", {"A": -1.0, "B": float("nan")}), ("x", {"A": float("nan")}), ("x", {"A": -2.0, "B": -1.0})], "text string, lp map<string,double>")
    assert [r[0] for r in rows.select(evaluate.predicted(F.col("text"), F.col("lp"), F.array(F.lit("a"), F.lit("b")))).collect()] == [0, -1, 1]
    metrics = spark.createDataFrame([("accuracy-a", 0.5), ("accuracy", 1.0)], "metric string, value double")
    assert evaluate.metric_object(metrics).toJSON().collect() == ['{"accuracy":1.0,"accuracy-a":0.5}']


OPTIONS = {
    "embed": "--data_path a\n--group_name c4\n--saving_path datasets/\n--saving_file embeddings.h5\n--model_name m\n--compression gzip\n--compression_opts 4\n--device cuda\n--batch_size 512\n--use_amp_fp16",
    "retrieve": "--database_path e\n--few_shot_path f\n--c4_path a\n--stackexchange_path b\n--wikipedia_path c\n--wikihow_path d\n--saving_path s\n--top_p_percentile 0.2\n--num_samples_to_retrieve 50_000\n--sim_threshold 0.98\n--model_name m\n--device cuda\n--use_amp_fp16",
    "create-tasks": "--model_name_or_path m\n--few_shot_path f\n--corpus_samples_path c\n--num_shots 3\n--task bioqa\n--deduplication_ratio 85\n--num_final_task_samples 500\n--output_path_raw a\n--output_path_clean b\n--output_path_error_msgs c\n--output_path_final d\n--temperature 0.7\n--top_p 0.9\n--top_k 40\n--max_new_tokens 256\n--max_tokenization_length 16384",
    "finetune": "--model_name_or_path m\n--cache_dir c\n--task bioqa\n--few_shots_only\n--task_samples_path t/\n--output_dir o/\n--lora_r 64\n--lora_alpha 64\n--lora_dropout 0.1\n--lora_bias none\n--batch_size 2\n--use_bf16\n--weight_decay 0.05\n--learning_rate 1e-4\n--grad_acc_steps 1\n--num_epochs 3\n--logging_strategy steps\n--logging_steps 1\n--save_strategy epoch\n--save_only_model\n--optim adamw_torch\n--warmup_ratio 0.1\n--num_workers 8\n--save_total_limit 1\n--random_seed 9999\n--hf_token_path k",
    "evaluate": "--model_name_or_path m\n--cache_dir c\n--adapters_path a\n--merge_adapters\n--task medqa\n--result_path r.json\n--output_path o.jsonl\n--hf_token_path k\n--temperature 0.0\n--top_p 1.0\n--top_k -1\n--max_new_tokens 1\n--logprobs 10\n--max_model_len 8192",
}


@pytest.mark.parametrize("command", sorted(OPTIONS))
def test_option_files(tmp_path, command):
    (tmp_path / "o.cfg").write_text(OPTIONS[command])
    o = cli.parser().parse_args([command, f"@{tmp_path / 'o.cfg'}"])
    if command == "retrieve":
        assert (o.num_docs, o.top_p, o.embeddings_path, o.output_path) == (50_000, 0.2, "e", "s")
    if command == "finetune":
        assert o.few_shots_only and o.train_dataset_path == "t/" and o.output_path == "o/"
    (tmp_path / "o.cfg").write_text(OPTIONS[command] + "\n--no_such_option 1")
    with pytest.raises(SystemExit):
        cli.parser().parse_args([command, f"@{tmp_path / 'o.cfg'}"])


def test_finetune_texts_of_few_shots_and_official_rows(spark, tmp_path):
    at = lambda *x: str(tmp_path.joinpath(*x))
    said = lambda folder: sorted(json.loads(x)["text"] for f in (tmp_path / folder).glob("part-*") for x in f.read_text().splitlines())
    samples = spark.createDataFrame([(f"Question number {k} of all?", ["A. a", "B. b"], "A", int(k < 2)) for k in range(6)], "question string, options array<string>, answer string, is_few_shot int")
    samples.write.parquet(at("samples"))
    cli.main(["finetune", "--task_samples_path", at("samples"), "--few_shots_only", "--task", "csqa", "--output_dir", at("few")], spark)
    assert said("few") == [f"[INST] Question number {k} of all?\nA. a\nB. b [/INST]A" for k in range(2)]
    official = {
        "bioqa": [{"question": "Q?", "choices": ["x", "y"], "answer": 1, "topic": "biology"}, {"question": "R?", "choices": ["x"], "answer": 0, "topic": "history"}],
        "medqa": [{"question": "Q?", "opa": "1", "opb": "2", "opc": "3", "opd": "4", "cop": 2}],
        "csqa": [{"question": "Q?", "answer": "no"}],
        "recipegen": [{"instruction": "Cook.", "ingredients": "egg\nsalt", "steps": "boil"}],
        "summarization": [{"article": "Long.", "highlights": "Short."}],
    }
    want = {
        "bioqa": "[INST] Q?\nA. x\nB. y [/INST]B",
        "medqa": "[INST] Q?\nA. 1\nB. 2\nC. 3\nD. 4 [/INST]C",
        "csqa": "[INST] Q?\nA. yes\nB. no [/INST]B",
        "recipegen": "[INST] Cook. [/INST]Ingredients:\negg\nsalt\nSteps:\nboil",
        "summarization": f"[INST] {prompts.SUMMARIZE}Long. [/INST]Short.",
    }
    for task, rows in official.items():
        (tmp_path / f"{task}.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
        cli.main(["finetune", "--task_samples_path", "official", "--official_path", at(f"{task}.jsonl"), "--task", task, "--output_dir", at(f"out_{task}")], spark)
        assert said(f"out_{task}") == [want[task]]
    with pytest.raises(ValueError):
        cli.main(["finetune", "--task_samples_path", "official", "--task", "csqa", "--output_dir", at("none")], spark)



FIELDS = ["a", "", '"q"', '"a, b"', '"say ""hi"""', '"line\nline"', '"\n\n"', 'in "the" middle', '"x" tail', '""', '"""\n"""', "\u00e9\u00fc", '"long ' + "words, \n" * 30 + '"']


def records_of(text):
    """Records by going through the letters one by one."""
    out, start, state = [], 0, "field"
    for k, c in enumerate(text):
        if state == "quoted":
            if c == '"':
                state = "closed"
        elif state == "closed" and c == '"':
            state = "quoted"
        elif state == "field" and c == '"':
            state = "quoted"
        elif c == ",":
            state = "field"
        elif c == "\n":
            out.append(text[start:k])
            start, state = k + 1, "field"
        elif state in ("closed", "field"):
            state = "letters"
    return out + ([text[start:]] if start < len(text) else [])


def test_records_over_block_ends(spark, tmp_path):
    rng = random.Random(11)
    want = {}
    for f in range(3):
        text = "headline,title,text\n" + "".join(",".join(rng.choice(FIELDS) for _ in range(rng.choice([3, 3, 3, 2, 4]))) + "\n" for _ in range(200))
        (tmp_path / f"{f}.csv").write_text(text)
        want[f"{f}.csv"] = records_of(text)
    (tmp_path / "empty.csv").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = quoted.records(spark, str(tmp_path)).collect()
        read = sorted(map(tuple, files.howto_csv(spark, str(tmp_path)).collect()), key=repr)
        assert quoted.records(spark, str(tmp_path / "0.csv"))._jdf.rdd().getNumPartitions() >= 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    by = {}
    for r in got:
        by.setdefault(name(r.file), []).append(r.value)
    assert {k: sorted(v) for k, v in by.items()} == {k: sorted(v) for k, v in want.items()}
    assert sorted(name(r.file) for r in got if r.first) == sorted(want) and all(r.value == "headline,title,text" for r in got if r.first)
    whole = spark.read.schema("headline string, title string, text string").option("columnPruning", "false").csv(str(tmp_path), header=True, multiLine=True, escape='"', mode="DROPMALFORMED", enforceSchema=True)
    assert read == sorted(map(tuple, whole.collect()), key=repr) and len(read) > 300


def test_every_text_comes_back_from_csv_as_it_was(spark, tmp_path):
    texts = ["a", None, "", " a", "a ", "\tx\n", "\n", "a\r\nb", "a\rb", "\r", "\\", '"', '""', 'a"\n', "\x00", "a\x00b", "\x1f", '","', '"\n"', "\\N", "\ufeffx"]
    rows = [(k, t, "en") for k, t in enumerate(texts)] + [(k, "x", lang) for k, lang in enumerate([None, "", " de "], 100)] + [(None, "x", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.queries()["howto_csv_read"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((lang, None if k is None else str(k), t) for k, t, lang in rows), key=repr)


def test_records_within_a_block_are_not_shuffled(spark, tmp_path, monkeypatch):
    kept, keep = [], quoted.keep
    monkeypatch.setattr(quoted, "keep", lambda df: kept.append(keep(df)) or kept[-1])
    monkeypatch.setattr(quoted, "MOST_BLOCKS", 1)
    (tmp_path / "x.csv").write_text("h,t,x\n" + "".join(f'"a{k}","b\n\nc","{"d" * (k % 7)}"\n' for k in range(900)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = sorted(tuple(r) for r in files.howto_csv(spark, str(tmp_path / "x.csv")).collect())
        blocks, parts = kept[1].count(), kept[2].count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == sorted((f"a{k}", "b\n\nc", "d" * (k % 7) or None) for k in range(900))
    assert blocks > 3 and parts <= 2 * blocks


def test_tokens_are_counted_in_parts_of_bounded_size(spark, tmp_path, monkeypatch):
    made = []
    monkeypatch.setattr(tokens, "loaded", lambda name, data: (lambda texts: made.append(sum(map(len, texts))) or [list(t.encode()) for t in texts], None))
    (tmp_path / "v.json").write_text("{}")
    texts = ["ab" * (k % 50) if k % 9 else None for k in range(300)] + ["x" * 900]

    class Rows:  # what a task does, in this process
        sparkSession, schema = spark, spark.createDataFrame([], "id long, text string").schema

        def mapInArrow(self, run, schema):
            return pa.Table.from_batches(run(iter([pa.record_batch({"id": pa.array(range(301)), "text": pa.array(texts)})])))

    monkeypatch.setattr(tokens, "PART_BYTES", 500)
    got = tokens.counted(Rows(), "text", str(tmp_path / "v.json"))
    assert got["id"].to_pylist() == list(range(301)) and got["n_tokens"].to_pylist() == [len(t or "") for t in texts]
    assert max(made[:-1]) <= 500 and made[-1] == 900


def test_a_quote_that_is_never_closed(spark, tmp_path, monkeypatch):
    (tmp_path / "x.csv").write_text("h,t,x\na,b,c\n\"open,\n" + "more\n" * 50)
    monkeypatch.setattr(quoted, "MOST_LINES", 20)
    assert [tuple(r) for r in files.howto_csv(spark, str(tmp_path / "x.csv")).collect()] == [("a", "b", "c")]


def test_records_of_any_number_of_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quoted, "MOST_LINES", 20)
    want = [(f"{k}", "b", "\n".join(f"{k} {j}" for j in range(n))) for k, n in enumerate([1, 19, 20, 21, 22, 40, 41, 500, 3])]
    (tmp_path / "x.csv").write_text("h,t,x\n" + "".join(f'"{h}","{t}","{x}"\n' for h, t, x in want))
    for size in ("100m", "300"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            assert sorted(map(tuple, files.howto_csv(spark, str(tmp_path / "x.csv")).collect())) == sorted(want)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("line", ["", "a,b", '"', '""', '"a', 'a"', '"a"b', '"a""', '"a"",b', 'x,"', 'x,"y",', '"",""', '"",""","', ',"a""b"",'])
def test_states_of_lines(line):
    for inside in (False, True):
        text = ('"' if inside else "") + line + "\nz"
        assert quoted.ends_inside(line, inside) == (len(records_of(text)) == 1)


VOCABULARIES = "/opt/tokenizers"


@pytest.mark.parametrize("vocabulary", ["byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"])
def test_tokens_come_back_as_text(spark, vocabulary):
    pytest.importorskip("tokenizers")
    path = f"{VOCABULARIES}/{vocabulary}"
    texts = ["The cat, the mat: 1234!", "\u00dcber \u00e9t\u00e9 \u4f60\u597d \U0001f600", "", None, "<|endoftext|> is text", "tail \n\t x" * 50]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "k long, text string, n_tokens int").drop("n_tokens")
    back = {r.k: (r.tokens, r.again) for r in tokens.decoded(tokens.encoded(df, "text", path), "tokens", path, "again").collect()}
    counts = {r.k: r.n_tokens for r in tokens.counted(df, "text", path).collect()}
    for k, t in enumerate(texts):
        assert counts[k] == len(back[k][0]) and (counts[k] == 0) == (not t)
        assert back[k][1] == (t or "")
    if vocabulary.endswith(".tiktoken"):
        same = {r.k: r.tokens for r in tokens.encoded(df, "text", f"{VOCABULARIES}/byte_bpe_50k.json").collect()}
        assert all(same[k] == back[k][0] for k in same if k != 4)
    with pytest.raises(ValueError):
        tokens.loaded("x.bin", b"")


def test_no_prompt_is_asked_twice(spark, tmp_path):
    log, store = tmp_path / "log", str(tmp_path / "store")
    log.mkdir()

    def model():
        import uuid

        def say(prompts):
            if any("poison" in p for p in prompts):
                raise RuntimeError("ended")
            (log / uuid.uuid4().hex).write_text(json.dumps(prompts))
            return [f" {p.upper()} " for p in prompts]

        return say

    rows = [(k, f"prompt {k % 30} " + "x" * (k % 7)) for k in range(100)] + [(100, None)]
    df = spark.createDataFrame(rows, "k long, prompt string")
    ended = df.union(spark.createDataFrame([(101, "poison")], "k long, prompt string"))
    with pytest.raises(Exception, match="ended"):
        models.answers(ended, "prompt", store, model, rounds=8, batch=5)
    done = [p for f in log.iterdir() for p in json.loads(f.read_text())]
    kept = {r.task_sample for r in spark.read.parquet(store).collect()} if (tmp_path / "store").exists() else set()
    got = models.answers(df, "prompt", store, model, rounds=8, batch=5)
    assert {(r.k, r.task_sample) for r in got.collect()} == {(k, None if p is None else p.upper().strip()) for k, p in rows} and got.columns == ["k", "prompt", "task_sample"]
    every = [p for f in log.iterdir() for p in json.loads(f.read_text())]
    assert sorted(set(every)) == sorted({p for _, p in rows if p}) and all(every.count(p) == 1 or p.upper().strip() not in kept for p in done)
    before = len(every)
    models.answers(df, "prompt", store, model, rounds=8, batch=5).count()
    assert len([p for f in log.iterdir() for p in json.loads(f.read_text())]) == before
    batches = [json.loads(f.read_text()) for f in log.iterdir()]
    assert max(max(map(len, b)) - min(map(len, b)) for b in batches) <= 6


def first_choice():
    """A generator for ``--generator``: always A, with a remark."""
    return lambda prompts: [f" a. as in {p[:3]}" for p in prompts]


def second_output():
    return lambda prompts: ["Output 2 is better" for _ in prompts]


def test_evaluation_and_judging_with_models(spark, tmp_path):
    at = lambda *x: str(tmp_path.joinpath(*x))
    said = lambda folder: [json.loads(x) for f in sorted((tmp_path / folder).glob("part-*")) for x in f.read_text().splitlines()]
    (tmp_path / "med.jsonl").write_text("".join(json.dumps({"question": f"Q{k}?", "opa": "1", "opb": "2", "opc": "3", "opd": "4", "cop": k % 4}) + "\n" for k in range(8)))
    cli.main(["evaluate", "--task", "medqa", "--official_path", at("med.jsonl"), "--generator", "tests.test_sources:first_choice", "--answers_path", at("store"), "--result_path", at("acc"), "--output_path", at("out"), "--is_llama_3_chat_official"], spark)
    assert said("acc") == [{"accuracy": 0.25}]
    assert sorted((r["instruction"], r["prediction"], r["reference"]) for r in said("out")) == [(f"Q{k}?\nA. 1\nB. 2\nC. 3\nD. 4", "A", "ABCD"[k % 4]) for k in range(8)]
    (tmp_path / "sum.jsonl").write_text('{"article": "Long.", "highlights": "Short."}\n{"article": "Other.", "highlights": "It."}\n')
    cli.main(["evaluate", "--task", "summarization", "--official_path", at("sum.jsonl"), "--result_path", at("none"), "--output_path", at("sums")], spark)
    assert sorted(r["reference"] for r in said("sums")) == ["It.", "Short."] and all("digest" in r["prediction"] for r in said("sums"))
    cli.main(["winrate", "--outputs_path", at("out"), "--annotated_path", at("judged"), "--generator", "tests.test_sources:second_output", "--result_path", at("win")], spark)
    judged = said("judged")
    assert len(judged) == 8 and all(r["model_preference"] == 2 for r in judged)
    assert said("win") == [{"win_rate": sum(not r["swapped"] for r in judged) / 8}]
    cli.main(["winrate", "--outputs_path", at("sums"), "--annotated_path", at("judged2"), "--result_path", at("win2")], spark)
    assert {r["model_preference"] for r in said("judged2")} <= {1, 2}
    with pytest.raises(ValueError):
        cli.main(["evaluate", "--task", "medqa", "--result_path", at("x")], spark)
    cli.main(["index", "--data_path", at("sum.jsonl"), "--output_path", at("index")], spark)
    assert [(r.block, r.offset) for r in spark.read.parquet(at("index")).collect()] == [(0, 0)]


def test_new_splits_are_embedded_once(spark, tmp_path):
    src, store = tmp_path / "src", str(tmp_path / "v")
    src.mkdir()
    put = lambda n, k: (src / f"wiki_{n:02d}.jsonl").write_text("".join(json.dumps({"text": f"t {n} {i}"}) + "\n" for i in range(k)))
    held = lambda: sorted((r.split, r["count"]) for r in files.vector_store(spark, store, ["wikipedia"]).groupBy("split").count().collect())
    put(0, 3)
    (src / "wiki_09.jsonl").write_text('{"text": \n')
    (src / "c4-train.00001-of-01024.json.gz").write_bytes(packed([{"text": "a"}])[:-4])
    run = lambda at: incremental.embed_new_splits(spark, str(src), "wikipedia", store, str(tmp_path / at), 2)
    run("one")
    assert held() == [("wiki_00", 3)]
    run("one")
    put(1, 2)
    run("one")
    assert held() == [("wiki_00", 3), ("wiki_01", 2)]
    run("lost")  # everything again, by another checkpoint
    assert held() == [("wiki_00", 3), ("wiki_01", 2)]
