"""Named queries over the driver's tables and the same questions in SQL.

Tables stand in for corpora: ``documents`` is a corpus whose ``source`` is the
split and ``doc_id`` the position; ``embeddings`` is the vector store with
``label`` as split and its lowest ids as few-shot queries; ``benchmark`` is the
test set.  Records that no table has (raw samples, log-probabilities,
preferences) are built from documents by the same expression in both engines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session
from ..functions import text as T
from ..operators import clean, dedup, evaluate, extract, official, overlap, prompts, retrieve, sampling
from ..sources import files, streams
from ..streaming import incremental
from . import models, tokens

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
WS = T.WHITESPACE
FEW, P, K = 4, 0.5, 40


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = _table(spark, sf_dir, "embeddings")
    return e.select("label", "vec_id", "embedding"), e.filter(F.col("vec_id") < FEW).select(F.col("vec_id").alias("fs_id"), "embedding")


# ---- retrieval

_SIMS = f"""fs AS (SELECT vec_id AS fs_id, embedding::DOUBLE[] AS fe FROM embeddings WHERE vec_id < {FEW}),
s AS (SELECT label, vec_id, fs_id AS fs, list_cosine_similarity(embedding::DOUBLE[], fe) AS raw FROM embeddings, fs),
n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
m AS (SELECT label, vec_id, round(avg(raw), 6) AS sim FROM s GROUP BY label, vec_id)"""
_EACH = f"""a AS (SELECT fs, label, vec_id, round(raw, 6) AS sim, row_number() OVER (PARTITION BY label, fs ORDER BY round(raw, 6) DESC, vec_id) AS rn FROM s),
b AS (SELECT a.* FROM a JOIN n USING (label) WHERE rn <= floor(CAST({P} AS DOUBLE) * n / {FEW} / 2)),
c AS (SELECT fs, label, vec_id, sim, row_number() OVER (PARTITION BY fs ORDER BY sim DESC, label, vec_id) AS rank FROM b)"""
_MEAN = f"""d AS (SELECT label, vec_id, sim, row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id) AS rn FROM m),
e AS (SELECT label, vec_id, sim FROM d JOIN n USING (label) WHERE rn <= floor(CAST({P} AS DOUBLE) * n / 2) ORDER BY sim DESC, label, vec_id LIMIT {int(K / 2 * 1.2)})"""
_EACH_K = int(K / 2 * 1.2) // FEW


@_query(f"WITH {_SIMS}, {_EACH}, {_MEAN} SELECT label, vec_id FROM c WHERE rank <= {_EACH_K} UNION SELECT label, vec_id FROM e")
def retrieve_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, queries = _vectors(spark, sf_dir)
    return retrieve.retrieve(corpus, queries, "label", "vec_id", P, K)


@_query(f"WITH {_SIMS}, {_EACH} SELECT CAST(fs AS INTEGER) AS fs, label, vec_id, CAST(rank AS INTEGER) AS rank FROM c WHERE rank <= {_EACH_K}")
def cosine_topk_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, queries = _vectors(spark, sf_dir)
    tops = retrieve.within_share(retrieve.best_rows(corpus, queries, "label", "vec_id", _EACH_K, 0), corpus, "label", FEW, P)
    return retrieve.ranked(tops, "label", "vec_id", _EACH_K).select("fs", "label", "vec_id", "rank")


@_query(f"WITH {_SIMS}, {_MEAN} SELECT label, vec_id FROM e")
def cosine_topk_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, queries = _vectors(spark, sf_dir)
    k = int(K / 2 * 1.2)
    tops = retrieve.within_share(retrieve.best_rows(corpus, queries, "label", "vec_id", 0, k), corpus, "label", FEW, P)
    return tops.orderBy(F.desc("sim"), "label", "vec_id").limit(k).select("label", "vec_id")


@_query(f"WITH {_SIMS}, {_EACH} SELECT CAST(fs AS INTEGER) AS fs, label, vec_id FROM b")
def top_p_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, queries = _vectors(spark, sf_dir)
    sims = retrieve.similarities(corpus, queries, ("label", "vec_id"))
    sizes = retrieve.split_sizes(corpus, "label")
    return retrieve.per_query(sims, sizes, "label", "vec_id", FEW, P).select("fs", "label", "vec_id")


@_query("SELECT source, count(*) AS n, CAST(max(doc_id) AS BIGINT) AS last_id FROM documents GROUP BY source")
def split_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.max("doc_id").alias("last_id"))


@_query(f"WITH {_SIMS}, {_EACH}, {_MEAN}, h AS (SELECT vec_id FROM c WHERE rank <= {_EACH_K} UNION SELECT vec_id FROM e) SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT vec_id FROM h)")
def fetch_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieve_mixed(spark, sf_dir).select(F.col("vec_id").alias("doc_id"))
    return retrieve.fetch(_table(spark, sf_dir, "documents").select("doc_id", "text"), hits, ["doc_id"])


@_query("SELECT DISTINCT source, CASE WHEN source IN ('c4', 'wikipedia', 'stackexchange') THEN source ELSE 'wikihow' END AS root, source || '.jsonl' AS file FROM documents")
def path_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("source")
    return _table(spark, sf_dir, "documents").select("source").distinct().select("source", files.corpus_root(s).alias("root"), files.split_file(s, s).alias("file"))


# ---- cleaning

_PARAGRAPHS = f"array_to_string(string_split(trim(text, '{WS}'), chr(10))[1:30], ' ')"
_TITLE = "string_split(text, chr(10))[1]"


@_query(f"SELECT doc_id, {_PARAGRAPHS} AS text FROM documents WHERE length({_PARAGRAPHS}) BETWEEN 200 AND 25000")
def clean_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_paragraphs(_table(spark, sf_dir, "documents").select("doc_id", "text"))


@_query("SELECT doc_id, length(text) BETWEEN 200 AND 25000 AS in_band FROM documents")
def length_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", T.in_band(F.col("text")).alias("in_band"))


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as how-to rows: the first line is the title, the language the headline."""
    return _table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("headline"), F.split("text", "\n")[0].alias("title"), "text")


_KEY = f"regexp_replace(trim({_TITLE}, '{WS}'), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_BENCH = f"SELECT DISTINCT regexp_replace(trim({_TITLE}, '{WS}'), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS title_key FROM documents WHERE doc_id % 10 = 0"


def _held_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _articles(spark, sf_dir).filter("doc_id % 10 = 0").select(T.alphanumeric(T.strip(F.col("title"))).alias("title_key")).distinct()


@_query(f"SELECT doc_id, {_KEY} AS title_key FROM documents")
def title_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _articles(spark, sf_dir).select("doc_id", T.alphanumeric(T.strip(F.col("title"))).alias("title_key"))


@_query(f"SELECT trim({_TITLE}, '{WS}') AS instruction, lang AS reference FROM documents WHERE {_KEY} IN ({_BENCH})")
def holdout_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.held_out(_articles(spark, sf_dir), _held_titles(spark, sf_dir))


@_query(f"SELECT doc_id, trim({_TITLE}, '{WS}') || chr(10) || trim(text, '{WS}') AS text FROM documents WHERE length(trim(text, '{WS}')) BETWEEN 200 AND 25000 AND {_KEY} NOT IN ({_BENCH})")
def holdout_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.train_articles(_articles(spark, sf_dir), _held_titles(spark, sf_dir)).select("doc_id", "text")


@_query(f"WITH q AS (SELECT doc_id, trim({_TITLE}, '{WS}') || chr(10) || chr(10) || trim(text, '{WS}') AS text FROM documents) SELECT * FROM q WHERE length(text) BETWEEN 200 AND 25000")
def concat_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.question_answers(_articles(spark, sf_dir).select("doc_id", "title", "text"), "title", "text").select("doc_id", "text")


@_query("SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 350) AS BIGINT) AS chunk FROM documents")
def chunk_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.chunks(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 350)


@_query("WITH c AS (SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 350) AS BIGINT) AS chunk FROM documents) SELECT * FROM c WHERE (chunk + 1) * 350 <= (SELECT count(*) FROM c)")
def chunk_full_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.chunks(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 350, drop_remainder=True)


@_query("SELECT conv_id, turn, 'role: ' || role || chr(10) || chr(10) || 'text: ' || text AS record FROM conversations")
def jsonl_record_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", files.record_string("role", "text").alias("record"))


# ---- extraction and validation

# the whole text as the inside of a JSON string: quotes, backslashes and line ends escaped, braces as they are
_SNIP = "substr(CAST(to_json(text) AS VARCHAR), 2, length(CAST(to_json(text) AS VARCHAR)) - 2)"


def _snippet() -> Column:
    whole = F.to_json(F.struct("text"))
    return F.when(F.col("text").isNotNull(), F.substr(whole, F.lit(len('{"text":"') + 1), F.length(whole) - len('{"text":""}')))


def _samples(spark: SparkSession, sf_dir: str, cases: list[tuple[str, ...]]) -> DataFrame:
    """Raw samples: case k of a document with doc_id % len(cases) = k, its parts around the snippet."""
    body: Column = F.lit(None).cast("string")
    for k, (head, tail) in enumerate(cases):
        body = F.when(F.col("doc_id") % len(cases) == k, F.concat(F.lit(head), _snippet(), F.lit(tail))).otherwise(body)
    return _table(spark, sf_dir, "documents").select("doc_id", body.alias("task_sample"))


def _samples_sql(cases: list[tuple[str, ...]]) -> str:
    whens = " ".join(f"WHEN {k} THEN '{h}' || {_SNIP} || '{t}'" for k, (h, t) in enumerate(cases))
    return f"raw AS (SELECT doc_id, CASE doc_id % {len(cases)} {whens} END AS task_sample FROM documents), cand AS (SELECT doc_id, i, x || '}}' AS c FROM (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, string_split(task_sample, '}}') AS p FROM raw WHERE task_sample LIKE '%}}%')) WHERE x <> ''), js AS (SELECT doc_id, i, CASE WHEN json_valid(c) THEN c::JSON END AS j FROM cand)"


_OPTS = '"options": ["A. a", "B. b", "C. c", "D. d"]'
_MC = [
    ('{"question": "', f'", {_OPTS}, "answer": "B. b"}}'),
    ('Sure! {"question": "', f'", {_OPTS}, "answer": "B"}}'),
    ('{"question": "', '", "options": ["A. a", "B. b", "C. c"], "answer": "B"}'),
    ("no structure ", ""),
    ('{"question": "', f'", {_OPTS}, "answer": "E"}}'),
    ('{"question": {"a": "', f'"}}, {_OPTS}, "answer": "A"}}'),
    ('{"question": "short", "options": [], "answer": "A"}{"question": "', f'", {_OPTS}, "answer": " C"}}'),
]
_YN = [
    ('{"question": "', '", "options": ["A. Yes", "B. No"], "answer": "A"}'),
    ('{"statement": "', '", "options": ["A. Yes", "B. No"], "answer": "B. No"}'),
    ('{"claim": "', '", "options": ["A. Yes", "B. No"], "answer": "A"}'),
    ('{"question": "', '", "options": ["A. Yes"], "answer": "A"}'),
]
_RECIPE = [
    ('{"instruction": "', '", "ingredients": ["egg ", "flour"], "steps": ["mix", "bake"]}'),
    ('{"instruction": "', '", "ingredients": [], "steps": ["mix"]}'),
    ('{"instruction": "', '", "ingredients": ["egg"], "steps": "mix"}'),
]
_LONG = "word " * 110
_SUMMARY = [
    ('{"instruction": "Summarize the following text", "summary": "', f' {_LONG[:100]}", "long_but_clean_text": "{_LONG}"}}'),
    ('{"instruction": "Summarize the following text", "summary": "', f'", "long_but_clean_text": "{_LONG}"}}'),
    ('{"instruction": "Summarize", "summary": "', f' {_LONG[:100]}", "long_but_clean_text": "{_LONG}"}}'),
]
_STR = lambda k: f"json_type(j, '$.{k}') = 'VARCHAR'"
_ARR = lambda k: f"json_type(j, '$.{k}') = 'ARRAY'"
_LST = lambda k: f"list_transform(list_filter(CAST(j->'$.{k}' AS VARCHAR[]), lambda x: x <> ''), lambda x: trim(x, '{WS}'))"
_TXT = lambda k: f"trim(j->>'$.{k}', '{WS}')"
_FIRST = "SELECT * EXCLUDE (i, err, r) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM e WHERE err IS NULL) WHERE r = 1"


def _qa_sql(cases: list[tuple[str, ...]], options: int, letters: str, statement: bool) -> str:
    q = f"CASE WHEN {_STR('question')} THEN {_TXT('question')}" + (f" WHEN {_STR('statement')} THEN {_TXT('statement')}" if statement else "") + " END"
    return f"""{_samples_sql(cases)},
f AS (SELECT doc_id, i, j, {q} AS question, CASE WHEN {_ARR('options')} THEN {_LST('options')} END AS options, substr({_TXT('answer')}, 1, 1) AS answer FROM js),
e AS (SELECT doc_id, i, question, options, answer, CASE WHEN j IS NULL THEN 'Invalid JSON.' WHEN coalesce(length(question), 0) <= 15 THEN 'QuestionLengthError'
  WHEN coalesce(len(options), 0) <> {options} THEN 'OptionsNumberError' WHEN coalesce(answer, '') = '' OR NOT contains('{letters}', answer) THEN 'AnswerFormatError' END AS err FROM f)"""


def _extracted(spark: SparkSession, sf_dir: str, cases: list[tuple[str, ...]], task: str) -> DataFrame:
    return extract.extract(_samples(spark, sf_dir, cases), task)


@_query(f"WITH {_qa_sql(_MC, 4, 'ABCD', False)} {_FIRST}")
def extract_qa_mc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir, _MC, "medqa").filter("sample is not null").select("doc_id", "sample.*")


@_query(f"WITH {_qa_sql(_YN, 2, 'AB', True)} {_FIRST}")
def extract_qa_yn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir, _YN, "csqa").filter("sample is not null").select("doc_id", "sample.*")


@_query(f"""WITH {_samples_sql(_RECIPE)}, e AS (SELECT doc_id, i, {_TXT('instruction')} AS instruction, CASE WHEN {_ARR('ingredients')} THEN {_LST('ingredients')} END AS ingredients,
  CASE WHEN {_ARR('steps')} THEN {_LST('steps')} END AS steps, CASE WHEN coalesce(length({_TXT('instruction')}), 0) <= 15 OR coalesce(len(ingredients), 0) < 1 OR coalesce(len(steps), 0) < 1 THEN 'x' END AS err FROM js) {_FIRST}""")
def extract_recipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir, _RECIPE, "recipegen").filter("sample is not null").select("doc_id", "sample.*")


@_query(f"""WITH {_samples_sql(_SUMMARY)}, f AS (SELECT doc_id, i, {_TXT('instruction')} AS instruction, {_TXT('summary')} AS summary, {_TXT('long_but_clean_text')} AS long_but_clean_text FROM js),
e AS (SELECT *, CASE WHEN coalesce(length(instruction), 0) <= 15 OR coalesce(length(summary), 0) <= 100 OR coalesce(length(long_but_clean_text), 0) <= 500 THEN 'x' END AS err FROM f) {_FIRST}""")
def extract_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir, _SUMMARY, "summarization").filter("sample is not null").select("doc_id", "sample.*")


@_query(f"""WITH {_qa_sql(_MC, 4, 'ABCD', False)}, l AS (SELECT doc_id, arg_max(err, i) AS err, bool_or(err IS NULL) AS ok, count(*) AS n FROM (SELECT doc_id, i, coalesce(err, 'ok') AS err0, err FROM e) GROUP BY doc_id),
m AS (SELECT doc_id, i, err, row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) AS r FROM e)
SELECT raw.doc_id AS "index", coalesce(m.err, 'No JSON found.') AS exception FROM raw LEFT JOIN l ON l.doc_id = raw.doc_id LEFT JOIN m ON m.doc_id = raw.doc_id AND m.r = 1 WHERE coalesce(l.ok, false) = false""")
def format_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir, _MC, "medqa").filter("sample is null").select(F.col("doc_id").alias("index"), "exception")


_LAST = 'SELECT raw.doc_id AS "index", coalesce(m.err, \'No JSON found.\') AS exception FROM raw LEFT JOIN (SELECT doc_id, bool_or(err IS NULL) AS ok FROM e GROUP BY doc_id) l ON l.doc_id = raw.doc_id LEFT JOIN (SELECT doc_id, err, row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) AS r FROM e) m ON m.doc_id = raw.doc_id AND m.r = 1 WHERE coalesce(l.ok, false) = false'
_BAD_RECIPE = [*_RECIPE, ("none ", ""), ('{"instruction": 5, "ingredients": ["a"], "steps": ["b"], "x": "', '"}'), ('{"instruction": "short", "more": "', '", "ingredients": ["a"], "steps": ["b"]}'), ('{"instruction": "', '", "ingredients": ["a"]}'), ("oh ", "}")]
_BAD_SUMMARY = [*_SUMMARY, ("none ", ""), ('{"instruction": "Summarize the following text", "summary": "' + _LONG + '", "long_but_clean_text": "', '", "x": 1'), (f'{{"instruction": "Summarize the following text", "summary": "{_LONG}", "long_but_clean_text": 7, "x": "', '"}'), (f'{{"instruction": "Summarize the following text", "summary": "{_LONG}", "long_but_clean_text": "short", "x": "', '"}')]


@_query(f"""WITH {_samples_sql(_BAD_RECIPE)}, f AS (SELECT doc_id, i, j, CASE WHEN {_STR('instruction')} THEN {_TXT('instruction')} END AS instruction, CASE WHEN {_ARR('ingredients')} THEN {_LST('ingredients')} END AS ingredients, CASE WHEN {_ARR('steps')} THEN {_LST('steps')} END AS steps FROM js),
e AS (SELECT doc_id, i, CASE WHEN j IS NULL THEN 'Invalid JSON.' WHEN coalesce(length(instruction), 0) <= 15 THEN 'InstructionLengthError' WHEN coalesce(len(ingredients), 0) < 1 THEN 'IngredientsNumberError' WHEN coalesce(len(steps), 0) < 1 THEN 'StepsNumberError' END AS err FROM f) {_LAST}""")
def format_errors_recipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir, _BAD_RECIPE, "recipegen").filter("sample is null").select(F.col("doc_id").alias("index"), "exception")


@_query(f"""WITH {_samples_sql(_BAD_SUMMARY)}, f AS (SELECT doc_id, i, j, {', '.join(f"CASE WHEN {_STR(k)} THEN {_TXT(k)} END AS {k}" for k in ('instruction', 'summary', 'long_but_clean_text'))} FROM js),
e AS (SELECT doc_id, i, CASE WHEN j IS NULL THEN 'Invalid JSON.' WHEN coalesce(length(instruction), 0) <= 15 THEN 'InstructionLengthError' WHEN coalesce(length(summary), 0) <= 100 THEN 'SummaryLengthError' WHEN coalesce(length(long_but_clean_text), 0) <= 500 THEN 'TextLengthError' END AS err FROM f) {_LAST}""")
def format_errors_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir, _BAD_SUMMARY, "summarization").filter("sample is null").select(F.col("doc_id").alias("index"), "exception")


# ---- prompts and texts

_SHOT_TEXT = f"trim(text, '{WS}')"


@_query(f"""WITH s AS (SELECT item_id, text AS shot FROM benchmark WHERE item_id < 8), x AS (SELECT doc_id, d.text, item_id, shot, row_number() OVER (PARTITION BY doc_id ORDER BY md5(concat_ws(':', doc_id, item_id)), item_id) AS turn FROM documents d, s)
SELECT doc_id, string_agg('[INST] Ask.' || ' ' || chr(10) || chr(10) || '___________' || chr(10) || 'Text: ' || trim(shot, '{WS}') || ' [/INST] ' || 'A</s> ', '' ORDER BY turn) || '[INST] Ask.' || ' ' || chr(10) || chr(10) || '___________' || chr(10) || 'Text: ' || trim(first(text), '{WS}') || ' [/INST] ' AS prompt FROM x WHERE turn <= 3 GROUP BY doc_id""")
def fewshot_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    shots = _table(spark, sf_dir, "benchmark").filter("item_id < 8").select("item_id", F.col("text").alias("shot"))
    return prompts.few_shot_prompts(_table(spark, sf_dir, "documents"), shots.withColumn("answer", F.lit("A")), "doc_id", "text", "item_id", "shot", "answer", "Ask.")


@_query("SELECT doc_id, CAST(item_id AS BIGINT) AS item_id, CAST(turn AS INTEGER) AS turn FROM (SELECT doc_id, item_id, row_number() OVER (PARTITION BY doc_id ORDER BY md5(concat_ws(':', doc_id, item_id)), item_id) AS turn FROM documents, (SELECT item_id FROM benchmark WHERE item_id < 8)) WHERE turn <= 3")
def choose_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    shots = _table(spark, sf_dir, "benchmark").filter("item_id < 8").select("item_id")
    return prompts.choose_shots(_table(spark, sf_dir, "documents").select("doc_id"), shots, "doc_id", "item_id")


_LETTERED = "array_to_string(list_transform(range(1, least(len(ws), 5) + 1), lambda i: ['A','B','C','D','E'][i] || '. ' || ws[i]), chr(10))"


def _choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    return d.select("doc_id", "lang", F.split("text", " ").alias("ws"), F.col("text").alias("question"))


_CHOICES = "w AS (SELECT doc_id, lang, string_split(text, ' ') AS ws, text AS question FROM documents)"


@_query(f"WITH {_CHOICES} SELECT doc_id, {_LETTERED} AS options FROM w")
def mc_lettering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _choices(spark, sf_dir).select("doc_id", T.lettered(F.col("ws")).alias("options"))


@_query(f"WITH {_CHOICES} SELECT doc_id, '[INST] ' || trim(question || chr(10) || {_LETTERED}, '{WS}') || ' [/INST]' || ['A','B','C','D','E'][CAST(doc_id % 4 AS INTEGER) + 1] AS text FROM w")
def finetune_text_official_mc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _choices(spark, sf_dir).select("doc_id", prompts.finetune_mc(F.col("question"), F.col("ws"), (F.col("doc_id") % 4).cast("int")).alias("text"))


@_query(f"WITH {_CHOICES} SELECT doc_id, '[INST] ' || trim(question || chr(10) || 'A. yes' || chr(10) || 'B. no', '{WS}') || ' [/INST]' || CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'B' END AS text FROM w")
def finetune_text_yes_no(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("doc_id") % 2 == 0, "yes").otherwise("no")
    return _choices(spark, sf_dir).select("doc_id", prompts.finetune_yes_no(F.col("question"), said).alias("text"))


@_query(f"WITH {_CHOICES} SELECT doc_id, '[INST] ' || trim(question || chr(10) || array_to_string(ws, chr(10)), '{WS}') || ' [/INST]' || 'B' AS text FROM w")
def finetune_text_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _choices(spark, sf_dir).select("doc_id", prompts.finetune_qa(F.col("question"), F.col("ws"), F.lit("B")).alias("text"))


@_query(f"WITH {_CHOICES} SELECT doc_id, '[INST] ' || trim(question, '{WS}') || ' [/INST]' || 'Ingredients:' || chr(10) || array_to_string(ws, chr(10)) || chr(10) || 'Steps:' || chr(10) || array_to_string(ws, chr(10)) AS text FROM w")
def finetune_text_recipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _choices(spark, sf_dir).select("doc_id", prompts.finetune_recipe(F.col("question"), F.col("ws"), F.col("ws")).alias("text"))


@_query(f"SELECT doc_id, '[INST] ' || trim({_TITLE} || chr(10) || text, '{WS}') || ' [/INST]' || lang AS text FROM documents")
def finetune_text_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _articles(spark, sf_dir).select("doc_id", prompts.finetune_summary(F.col("title"), F.col("text"), F.col("headline")).alias("text"))


@_query(f"SELECT doc_id, '[INST] ' || trim({_TITLE}, '{WS}') || ' [/INST]' || 'Ingredients:' || chr(10) || text || chr(10) || 'Steps:' || chr(10) || lang AS text FROM documents")
def finetune_text_official_recipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = official.recipes(_articles(spark, sf_dir).select("doc_id", "title", F.col("text").alias("ingredients"), F.col("headline").alias("steps")))
    return rows.select("doc_id", prompts.finetune_recipe_official(F.col("title"), F.col("response")).alias("text"))


@_query(f"SELECT doc_id, '[INST] ' || trim('Please summarize the text below:' || chr(10) || text, '{WS}') || ' [/INST]' || lang AS text FROM documents")
def finetune_text_official_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = official.summaries(_table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("article"), F.col("lang").alias("highlights")))
    return rows.select("doc_id", prompts.finetune_summary_official(F.col("article"), F.col("response")).alias("text"))


@_query(f"WITH {_CHOICES} SELECT doc_id, question || chr(10) || {_LETTERED} AS prompt FROM w")
def eval_prompt_mc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _choices(spark, sf_dir).select("doc_id", prompts.eval_mc(F.col("question"), F.col("ws")).alias("prompt"))


@_query("SELECT doc_id, 'Please summarize the text below:' || chr(10) || text AS prompt FROM documents")
def eval_prompt_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", prompts.eval_summary(F.col("text")).alias("prompt"))


@_query(f"SELECT conv_id, turn, '[INST] ' || trim(text, '{WS}') || ' [/INST]' AS prompt FROM conversations")
def inst_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", T.instruct(F.col("text")).alias("prompt"))


@_query(f"SELECT conv_id, turn, '<|start_header_id|>system<|end_header_id|>' || chr(10) || chr(10) || '{prompts.SYSTEM['csqa']}' || '<|eot_id|><|start_header_id|>user<|end_header_id|>' || chr(10) || chr(10) || text || '<|eot_id|><|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10) AS prompt FROM conversations")
def chat_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", prompts.chat(F.col("text"), prompts.SYSTEM["csqa"]).alias("prompt"))


_SYSTEMS = list(prompts.SYSTEM.values())


@_query(f"SELECT conv_id, turn, '<|start_header_id|>system<|end_header_id|>' || chr(10) || chr(10) || {[*_SYSTEMS]}[CAST(turn % {len(_SYSTEMS)} AS INTEGER) + 1] || '<|eot_id|><|start_header_id|>user<|end_header_id|>' || chr(10) || chr(10) || text || '<|eot_id|><|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10) AS prompt FROM conversations")
def chat_prompt_of_each_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.lit(None).cast("string")
    for k, system in enumerate(_SYSTEMS):
        own = F.when(F.col("turn") % len(_SYSTEMS) == k, prompts.chat(F.col("text"), system)).otherwise(own)
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", own.alias("prompt"))


@_query("SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_\\s]')) <= 400")
def token_length_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.fits(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 400).select("doc_id")


@_query(f"""WITH b AS (SELECT item_id, string_split(text, chr(10)) AS ls, text FROM benchmark) SELECT item_id, trim(ls[1], '{WS}') AS question,
list_transform(list_filter(ls[2:], lambda x: x <> ''), lambda x: trim(x, '{WS}')) AS options, substr(text, 1, 1) AS answer FROM b""")
def few_shot_to_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select("item_id", prompts.shot_qa(F.col("text"), F.col("text")).alias("s")).select("item_id", "s.*")


# ---- fuzzy deduplication


def _benchmark_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("idx"), "text")


@_query()
def fuzzy_vs_fewshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _benchmark_texts(spark, sf_dir)
    return dedup.against(b.filter("idx >= 8"), b.filter("idx < 8"), "text", 85).select("idx", "best_ratio")


@_query()
def fuzzy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), F.col("p_name").alias("text"))
    return dedup.greedy(parts, "idx", "text", 85).select("idx", "text")


_END = r"[.!?\n]+"


@_query()
def fuzzy_dedup_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of all documents, each once, less those that are near an earlier one."""
    said = _table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", _END)).alias("text"))
    once = said.select("doc_id", T.strip(F.col("text")).alias("text")).filter("text <> ''").groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    return dedup.greedy(once, "doc_id", "text", 85).select("doc_id", "text")


# ---- evaluation

_GEN = "g AS (SELECT doc_id, quality, toxic, CASE WHEN doc_id % 11 = 0 THEN '' ELSE 'x' END AS text, [CASE WHEN doc_id % 5 = 0 THEN NULL ELSE -CAST((doc_id * 7) % 13 AS DOUBLE) END, -CAST((doc_id * 5) % 13 AS DOUBLE), -CAST((doc_id * 3) % 13 AS DOUBLE)][1:2] AS lp FROM labels)"
_PRED = f"{_GEN}, h AS (SELECT *, list_transform(lp, lambda x: coalesce(x, CAST('-infinity' AS DOUBLE))) AS l2 FROM g), p AS (SELECT doc_id, quality, toxic, CAST(CASE WHEN text = '' OR list_max(l2) = CAST('-infinity' AS DOUBLE) THEN -1 ELSE list_position(l2, list_max(l2)) - 1 END AS INTEGER) AS prediction FROM h)"


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    lp = lambda k: -((d * k) % 13).cast("double")
    probs = F.map_from_arrays(F.array(*[F.lit(x) for x in "ABC"]), F.array(F.when(d % 5 != 0, lp(7)), lp(5), lp(3)))
    text = F.when(d % 11 == 0, "").otherwise("x")
    return _table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", evaluate.predicted(text, probs, F.array(F.lit("yes"), F.lit("no"))).alias("prediction"))


@_query(f"WITH {_PRED} SELECT doc_id, prediction FROM p")
def constrained_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predictions(spark, sf_dir).select("doc_id", "prediction")


@_query(f"WITH {_PRED} SELECT doc_id, CASE WHEN prediction = -1 THEN 'N/A' ELSE ['A','B','C','D','E'][prediction + 1] END AS letter FROM p")
def letter_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predictions(spark, sf_dir).select("doc_id", evaluate.letter(F.col("prediction")).alias("letter"))


@_query(f"WITH {_PRED} SELECT round(sum(CASE WHEN prediction = quality THEN 1.0 ELSE 0.0 END)::DOUBLE / count(*), 9) AS accuracy FROM p")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predictions(spark, sf_dir).agg(F.round(evaluate.accuracy(F.col("prediction"), F.col("quality")), 9).alias("accuracy"))


@_query(f"WITH {_PRED} SELECT 'accuracy-' || toxic AS metric, round(sum(CASE WHEN prediction = quality THEN 1.0 ELSE 0.0 END)::DOUBLE / count(*), 9) AS value FROM p GROUP BY toxic")
def ood_accuracy_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = _predictions(spark, sf_dir).groupBy("toxic").agg(F.round(evaluate.accuracy(F.col("prediction"), F.col("quality")), 9).alias("value"))
    return by.select(F.concat(F.lit("accuracy-"), F.col("toxic").cast("string")).alias("metric"), "value")


_COIN = "substr(md5('1234:' || doc_id), 1, 1) <= '7'"


@_query(f"SELECT doc_id, {_COIN} AS swapped, CASE WHEN {_COIN} THEN source ELSE lang END AS output_1, CASE WHEN {_COIN} THEN lang ELSE source END AS output_2 FROM documents")
def swap_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("output_1"), F.col("source").alias("output_2"))
    return evaluate.swap(d, sampling.coin(F.col("doc_id"))).select("doc_id", "swapped", "output_1", "output_2")


@_query(f"SELECT round(avg(CASE WHEN ({_COIN} AND doc_id % 3 = 1) OR (NOT {_COIN} AND doc_id % 3 = 2) THEN 1.0 ELSE 0.0 END), 9) AS win_rate FROM documents")
def win_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = evaluate.preference(F.concat(F.lit("Output "), (F.col("doc_id") % 3).cast("string")))
    return _table(spark, sf_dir, "documents").agg(F.round(evaluate.win_rate(sampling.coin(F.col("doc_id")), said), 9).alias("win_rate"))


# ---- sampling, overlap, resume


@_query("SELECT doc_id FROM documents ORDER BY md5('1234:' || doc_id), doc_id LIMIT 100")
def sample_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.exact(_table(spark, sf_dir, "documents").select("doc_id"), 100, "doc_id")


@_query("SELECT doc_id, CAST(ntile(7) OVER (ORDER BY doc_id) AS INTEGER) AS part FROM documents")
def even_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.even_parts(_table(spark, sf_dir, "documents").select("doc_id"), 7, "doc_id")


@_query("SELECT item_id, text FROM benchmark WHERE item_id < 8")
def first_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").filter("item_id < 8").select("item_id", "text")


@_query("SELECT id, text, CAST(is_few_shot AS INTEGER) AS is_few_shot FROM ((SELECT doc_id AS id, text, 0 AS is_few_shot FROM documents ORDER BY md5('1234:' || doc_id), doc_id LIMIT 92) UNION ALL SELECT item_id, text, 1 FROM benchmark WHERE item_id < 8)")
def final_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return sampling.final_dataset(docs, first_shots(spark, sf_dir).withColumnRenamed("item_id", "id"), 100, "id")


def _grams_sql(table: str, key: str) -> str:
    return f"(SELECT {key}, unnest(list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))) AS g FROM (SELECT {key}, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ws FROM {table}) WHERE len(ws) >= 5)"


_OVERLAP = f"d AS {_grams_sql('documents', 'doc_id')}, b AS (SELECT DISTINCT g, 1 AS hit FROM {_grams_sql('benchmark', 'item_id')}), o AS (SELECT doc_id, count(*) AS n_grams, CAST(coalesce(sum(hit), 0) AS BIGINT) AS n_hits FROM d LEFT JOIN b USING (g) GROUP BY doc_id)"


@_query(f"WITH {_OVERLAP} SELECT * FROM o")
def ngram_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.ngram_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), "doc_id")


@_query(f"WITH {_OVERLAP} SELECT round(100.0 * avg(CASE WHEN n_hits > 0 THEN 1.0 ELSE 0.0 END), 6) AS overlap_percent, count(*) AS n_texts FROM o")
def ngram_overlap_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_rate(ngram_overlap(spark, sf_dir))


@_query("SELECT doc_id, source FROM documents WHERE source NOT IN (SELECT DISTINCT source FROM documents WHERE doc_id % 40 = 0)")
def resume_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select("doc_id", "source")
    return incremental.pending(d, d.filter("doc_id % 40 = 0"), ["source"])


@_query("SELECT count(*) AS before, count(*) FILTER (WHERE length(text) BETWEEN 200 AND 25000) AS after, count(*) - count(*) FILTER (WHERE length(text) BETWEEN 200 AND 25000) AS removed FROM documents")
def removal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.count(F.when(T.in_band(F.col("text")), 1))
    return _table(spark, sf_dir, "documents").agg(F.count("*").alias("before"), ok.alias("after"), (F.count("*") - ok).alias("removed"))


@_query("SELECT doc_id, text, 'pending' AS state FROM documents WHERE lang = 'en'")
def equality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id", "text", F.lit("pending").alias("state"))


# ---- official sets, instructions, rows side by side


@_query("SELECT c_custkey AS id, [c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR), c_name] AS choices, c_nationkey AS answer FROM customer")
def official_medical(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.col("c_nationkey")
    return official.medical(_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("opa"), F.col("c_mktsegment").alias("opb"), nation.cast("string").alias("opc"), F.col("c_name").alias("opd"), nation.alias("cop")))


@_query("SELECT doc_id, CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END AS answer_str, CASE WHEN quality = 1 THEN 0 ELSE 1 END AS answer, ['yes', 'no'] AS choices FROM labels")
def official_yes_no(spark: SparkSession, sf_dir: str) -> DataFrame:
    return official.yes_no(_table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "yes").otherwise("no").alias("answer")))


@_query("SELECT doc_id, text AS ingredients, lang AS steps, 'Ingredients:' || chr(10) || text || chr(10) || 'Steps:' || chr(10) || lang AS response FROM documents")
def official_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return official.recipes(_table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("ingredients"), F.col("lang").alias("steps")))


@_query("SELECT doc_id, text AS article, lang AS response FROM documents")
def official_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return official.summaries(_table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("article"), F.col("lang").alias("highlights")))


_YES_NO = [x.replace("'", "''") for x in prompts.INSTRUCTIONS["csqa"]]


@_query(f"SELECT doc_id, CASE WHEN substr(md5('1234:' || doc_id), 1, 1) IN ('0','1','2','3','4','5','6','7') THEN '{_YES_NO[0]}' ELSE '{_YES_NO[1]}' END AS instruction FROM documents")
def instruction_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", prompts.choose_instruction("csqa", F.col("doc_id")).alias("instruction"))


@_query("SELECT d.doc_id, d.text AS instruction, CAST(l.quality AS VARCHAR) AS prediction, d.lang AS reference FROM documents d JOIN labels l ON l.doc_id = d.doc_id")
def outputs_by_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, said = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return evaluate.by_row(d.select("doc_id", F.col("text").alias("prompt")), said.select("doc_id", F.col("quality").cast("string").alias("prediction")), d.select("doc_id", F.col("lang").alias("reference")), "doc_id")


_SWAP = "substr(md5('1234:' || d.doc_id), 1, 1) IN ('0','1','2','3','4','5','6','7')"


@_query(f"""WITH p AS (SELECT d.doc_id, d.text AS instruction, {_SWAP} AS swapped, CASE WHEN {_SWAP} THEN d.source ELSE d.lang END AS output_1, CASE WHEN {_SWAP} THEN d.lang ELSE d.source END AS output_2 FROM documents d)
SELECT *, 'Which of the two outputs answers the instruction better? Reply with 1 or 2 only.' || chr(10) || chr(10) || 'Instruction:' || chr(10) || instruction || chr(10) || chr(10) || 'Output 1:' || chr(10) || output_1 || chr(10) || chr(10) || 'Output 2:' || chr(10) || output_2 || chr(10) || chr(10) || 'Better output: ' AS prompt FROM p""")
def judge_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    return evaluate.pairwise(d.select("doc_id", F.col("text").alias("instruction"), F.col("lang").alias("reference")), d.select("doc_id", F.col("source").alias("prediction")), sampling.coin(F.col("doc_id")), "doc_id")


@_query("SELECT DISTINCT doc_id, printf('train.%05d', doc_id) AS split, CAST(doc_id AS INTEGER) AS number, printf('c4-train.%05d-of-01024.json.gz', doc_id) AS file FROM documents")
def web_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents").select("doc_id").distinct().withColumn("split", files.web_split(F.col("doc_id")))
    return d.select("doc_id", "split", files.split_number(F.col("split")).alias("number"), files.split_file(F.lit("c4"), F.col("split")).alias("file"))


def _folded(rows: str) -> str:
    return f"WITH RECURSIVE s AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY source) AS k FROM documents GROUP BY source), f(k, source, held, chunk) AS (SELECT 0, CAST(NULL AS VARCHAR), CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION ALL SELECT s.k, s.source, CASE WHEN f.held >= {rows} THEN s.n ELSE f.held + s.n END, CASE WHEN f.held >= {rows} THEN f.chunk + 1 ELSE f.chunk END FROM f JOIN s ON s.k = f.k + 1)"


@_query(f"{_folded('200')}, c AS (SELECT chunk FROM f WHERE held >= 200 GROUP BY chunk) SELECT d.doc_id, d.source, f.chunk FROM documents d JOIN f ON f.source = d.source JOIN c ON c.chunk = f.chunk")
def chunks_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.file_chunks(_table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 200)


# ---- files: what Spark writes of the tables, read again as a corpus is

CHUNK = 250
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def _place(spark: SparkSession) -> str:
    return f"{session.shared_dir(spark)}/corpusmill/{uuid.uuid4().hex}"


def _chunk_files(spark: SparkSession, sf_dir: str) -> str:
    """Documents in order of id as JSON-lines files of ``CHUNK`` lines."""
    at = _place(spark)
    files.write_chunks(_table(spark, sf_dir, "documents").select("doc_id", "text"), at, "doc_id", CHUNK)
    return at


def _chunk_number() -> Column:
    return F.regexp_extract("file", r"chunk=([0-9]+)", 1).cast("long")


@_query(f"SELECT CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / {CHUNK}) AS BIGINT) AS chunk, doc_id, text FROM documents")
def chunk_files_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.jsonl(spark, _chunk_files(spark, sf_dir), "doc_id long, text string").select(_chunk_number().alias("chunk"), "doc_id", "text")


@_query(f"SELECT chunk, count(*) AS records, 'whole' AS verdict FROM (SELECT CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / {CHUNK}) AS BIGINT) AS chunk FROM documents) GROUP BY chunk")
def chunk_files_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.ledger(spark, _chunk_files(spark, sf_dir)).select(_chunk_number().alias("chunk"), "records", "verdict")


@_query(f"""WITH {_SIMS}, {_EACH}, {_MEAN}, h AS (SELECT vec_id FROM c WHERE rank <= {_EACH_K} UNION SELECT vec_id FROM e), placed AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS place FROM documents)
SELECT place, doc_id, text FROM placed WHERE place IN (SELECT vec_id FROM h)""")
def fetch_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents at the retrieved positions, by seeking in their files."""
    at, place = _chunk_files(spark, sf_dir), F.col("vec_id")
    paths = streams.listed(spark, at, "part-*").select(F.col("path").alias("file")).withColumn("chunk", _chunk_number())
    hits = retrieve_mixed(spark, sf_dir).select(F.floor(place / CHUNK).alias("chunk"), (place % CHUNK).alias("doc_idx")).join(paths, "chunk")
    lines = streams.lines_at(spark, hits.select("file", "doc_idx"), streams.line_index(spark, at, 50), 50)
    found = lines.select((_chunk_number() * CHUNK + F.col("doc_idx")).alias("place"), F.from_json("raw", "doc_id long, text string").alias("r"))
    return found.select("place", "r.doc_id", "r.text")


@_query("SELECT lang AS headline, CAST(doc_id AS VARCHAR) AS title, text FROM documents")
def howto_csv_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, d = _place(spark), _table(spark, sf_dir, "documents")
    null = uuid.uuid4().hex  # no text is a null by chance, and an empty one is not
    rows = d.select(F.col("lang").alias("headline"), F.col("doc_id").cast("string").alias("title"), "text")
    rows.write.csv(at, header=True, escape='"', quoteAll=True, nullValue=null, lineSep="\n", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return files.howto_csv(spark, at, null, "\n")


@_query()
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.counted(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", VOCABULARY).select("doc_id", "n_tokens")


@_query("""SELECT doc_id, '{"question": "What does digest ' || md5('[INST] ' || trim(text, '""" + WS + """') || ' [/INST]') || ' stand for?", "options": ["A. a", "B. b", "C. c", "D. d"], "answer": "A"}' AS task_sample FROM documents""")
def resumable_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _table(spark, sf_dir, "documents").select("doc_id", T.instruct(F.col("text")).alias("prompt"))
    return models.answers(asked, "prompt", _place(spark), rounds=4).select("doc_id", "task_sample")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
