"""Catalogue: sources/sinks shapes, coverage, resume, requests, errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradewise.functions.text import path_stem
from gradewise.operators import outcomes as oc
from gradewise.operators import reduce as rd
from gradewise.operators import requests as rq
from gradewise.plans import common as cm
from gradewise.plans.registry import big, query, rnd
from gradewise.sources import fixtures as fx
from gradewise.sources.tables import table

# Raw language labels of the fixture cases by case_id % 8 (fixed values).
RAW_LANGS = ["python", "js", "c++/c", "cs", "ts", "r", "go", "kotlin"]


def _raw_lang(col):
    e = None
    for i, v in enumerate(RAW_LANGS):
        e = F.when(col % 8 == i, v) if e is None else e.when(col % 8 == i, v)
    return e


_RAW_SQL = "CASE case_id % 8 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(RAW_LANGS)) + " END"
_ALIAS_SQL = "CASE raw_lang " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in oc.LANG_ALIASES.items()) + " END"


@query("lang_alias", fx.with_views("cases_v", extra={"rl": f"SELECT case_id, {_RAW_SQL} AS raw_lang FROM cases_v"}) +
       f"SELECT case_id, raw_lang, {_ALIAS_SQL} AS lang, ({_ALIAS_SQL}) IS NULL AS is_error, "
       f"CAST(CASE {_ALIAS_SQL} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in oc.DEFAULT_TIMEOUT.items()) +
       " END AS DOUBLE) AS timeout FROM rl")
def lang_alias(spark, sf):
    c = fx.cases_v(spark, sf).select("case_id", _raw_lang(F.col("case_id")).alias("raw_lang"))
    lang = oc.canonical_lang(F.col("raw_lang"))
    return c.select("case_id", "raw_lang", lang.alias("lang"), lang.isNull().alias("is_error"),
                    oc.default_timeout(lang).alias("timeout"))


@query("error_rows", fx.with_views("cases_v", extra={"rl": f"SELECT case_id, {_RAW_SQL} AS raw_lang FROM cases_v"}) +
       f"SELECT case_id, 'unit_test' AS stage, 'unsupported language: ' || raw_lang AS reason FROM rl WHERE ({_ALIAS_SQL}) IS NULL")
def error_rows(spark, sf):
    c = fx.cases_v(spark, sf).select("case_id", _raw_lang(F.col("case_id")).alias("raw_lang"))
    bad = c.where(oc.canonical_lang(F.col("raw_lang")).isNull())
    return bad.select("case_id", F.lit("unit_test").alias("stage"),
                      F.concat(F.lit("unsupported language: "), F.col("raw_lang")).alias("reason"))


@query("case_stem", fx.with_views("cases_v") +
       "SELECT case_id, split_part(string_split('cases_dev/sub/eval_' || case_id || '-' || lang || '.v2.yaml', '/')[-1], '.', 1) AS stem FROM cases_v")
def case_stem(spark, sf):
    c = fx.cases_v(spark, sf)
    path = F.concat(F.lit("cases_dev/sub/eval_"), F.col("case_id").cast("string"), F.lit("-"), F.col("lang"), F.lit(".v2.yaml"))
    return c.select("case_id", path_stem(path).alias("stem"))


@query("union_parts", "SELECT doc_id, NULL AS source, CAST(length(text) AS BIGINT) AS n_chars FROM documents WHERE lang = 'en' "
       "UNION ALL SELECT doc_id, source, CAST(length(text) AS BIGINT) AS n_chars FROM documents WHERE lang <> 'en'")
def union_parts(spark, sf):
    d = table(spark, sf, "documents")
    a = d.where(F.col("lang") == "en").select("doc_id", "text")
    b = d.where(F.col("lang") != "en").select("doc_id", "text", "source")
    u = a.unionByName(b, allowMissingColumns=True)
    return u.select("doc_id", "source", big(F.length("text")).alias("n_chars"))


CHUNK = 5


@query("array_responses", fx.with_views("responses_v", extra={
    "ch": f"SELECT case_id, sample_no, text, floor(sample_no / {CHUNK}) AS chunk FROM responses_v",
    "last": "SELECT case_id, max(chunk) AS chunk FROM ch GROUP BY case_id"}) +
       f"SELECT 'eval_' || ch.case_id AS filename, CAST(ch.sample_no - {CHUNK} * ch.chunk AS BIGINT) AS j, "
       "CAST(length(ch.text) AS BIGINT) AS n_chars FROM ch JOIN last ON last.case_id = ch.case_id AND last.chunk = ch.chunk")
def array_responses(spark, sf):
    r = fx.responses_v(spark, sf)
    chunk = F.floor(F.col("sample_no") / F.lit(CHUNK)).cast("long")
    # Batch-result rows: one per (case, chunk of <= CHUNK samples).
    rows = r.groupBy("case_id", chunk.alias("idx")).agg(
        F.array_sort(F.collect_list(F.struct("sample_no", "text"))).alias("s")).select(
        F.array(F.concat(F.lit("eval_"), F.col("case_id").cast("string"))).alias("filename"),
        F.transform("s", lambda x: x["text"]).alias("responses"), "idx")
    # Unpack: first filename; a repeated case keeps its last row.
    last = rows.groupBy(F.element_at("filename", 1).alias("filename")).agg(
        F.max_by("responses", "idx").alias("responses"))
    return last.select("filename", F.posexplode("responses").alias("j", "text")).select(
        "filename", big("j").alias("j"), big(F.length("text")).alias("n_chars"))


@query("null_completion_stats", fx.with_views("turns_v") +
       "SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (WHERE completion IS NULL) AS BIGINT) AS n_null, "
       "CAST(count(DISTINCT conv_id) FILTER (WHERE completion IS NULL) AS BIGINT) AS n_conv_null, "
       "CAST(sum(length(coalesce(completion, ''))) AS BIGINT) AS n_chars FROM turns_v")
def null_completion_stats(spark, sf):
    t = fx.completions(spark, sf)
    return t.agg(big(F.count(F.lit(1))).alias("n_rows"), big(F.count_if(F.col("completion").isNull())).alias("n_null"),
                 big(F.count_distinct(F.when(F.col("completion").isNull(), F.col("conv_id")))).alias("n_conv_null"),
                 big(F.sum(F.length(F.coalesce("completion", F.lit(""))))).alias("n_chars"))


_TOK = "len(list_filter(string_split(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> ''))"
_PROMPT_SQL = (
    "SELECT case_id AS idx, 'eval_' || case_id || '.yaml' AS filename, qtype AS question_type, "
    f"CASE WHEN qtype = 'knowledge question-answering' THEN '{rq.QA_SYSTEM_PROMPT}' ELSE '{rq.CODE_SYSTEM_PROMPT}' END AS system_prompt, "
    f"(CASE WHEN qtype = 'knowledge question-answering' THEN '{rq.QA_SYSTEM_PROMPT}' ELSE '{rq.CODE_SYSTEM_PROMPT}' END) || chr(10) || ref_text AS prompt "
    "FROM cases_v")


def _prompts(spark, sf):
    c = fx.cases_v(spark, sf)
    keys = F.when(F.col("qtype") == "knowledge question-answering", F.array(F.lit("similarity"))) \
        .otherwise(F.array(F.lit("keywords"), F.lit("unit_test")))
    c = c.select(F.col("case_id").alias("idx"), F.concat(F.lit("eval_"), F.col("case_id").cast("string"), F.lit(".yaml")).alias("filename"),
                 F.col("qtype").alias("question_type"), rq.is_qa(keys).alias("qa"), "ref_text")
    return rq.prompt_table(c, F.col("qa"), F.col("ref_text"))


@query("prompt_table", fx.with_views("cases_v", extra={"p": _PROMPT_SQL}) +
       f"SELECT idx, filename, question_type, system_prompt, prompt, CAST({_TOK.format(c='prompt')} AS BIGINT) AS n_token FROM p")
def prompt_table(spark, sf):
    p = _prompts(spark, sf)
    return p.select("idx", "filename", "question_type", "system_prompt", "prompt", big("n_token").alias("n_token"))


@query("prompt_token_stats", fx.with_views("cases_v", extra={"p": _PROMPT_SQL}) +
       f"SELECT CAST(max({_TOK.format(c='prompt')}) AS BIGINT) AS max_tokens, round(avg({_TOK.format(c='prompt')}), 6) AS mean_tokens FROM p")
def prompt_token_stats(spark, sf):
    p = _prompts(spark, sf)
    return p.agg(big(F.max("n_token")).alias("max_tokens"), rnd(F.avg("n_token")).alias("mean_tokens"))


def _labelled(spark, sf):
    r = fx.sample_keys(spark, sf).select("doc_id", "case_id", "sample_no")
    return r, table(spark, sf, "labels").select("doc_id")


@query("coverage_semi_anti", fx.with_views("responses_v", "cases_v", extra={
    "se": "SELECT case_id, count(*) AS n FROM responses_v r WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY case_id",
    "an": "SELECT case_id, count(*) AS n FROM responses_v r WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY case_id"}) +
       "SELECT c.case_id, CAST(coalesce(se.n, 0) AS BIGINT) AS n_labelled, CAST(coalesce(an.n, 0) AS BIGINT) AS n_unlabelled, "
       "se.n IS NULL AS no_labels FROM cases_v c LEFT JOIN se ON se.case_id = c.case_id LEFT JOIN an ON an.case_id = c.case_id")
def coverage_semi_anti(spark, sf):
    r, l = _labelled(spark, sf)
    se = r.join(l, "doc_id", "left_semi").groupBy("case_id").agg(F.count(F.lit(1)).alias("n_l"))
    an = r.join(l, "doc_id", "left_anti").groupBy("case_id").agg(F.count(F.lit(1)).alias("n_u"))
    c = fx.cases_v(spark, sf).select("case_id")
    j = c.join(se, "case_id", "left").join(an, "case_id", "left")
    return j.select("case_id", big(F.coalesce("n_l", F.lit(0))).alias("n_labelled"),
                    big(F.coalesce("n_u", F.lit(0))).alias("n_unlabelled"), F.col("n_l").isNull().alias("no_labels"))


RESUME_N = 10
# Wanted samples that no labelled response has.
_MISSING_SQL = (f"SELECT c.case_id, w.sample_no FROM cases_v c, (SELECT unnest(range({RESUME_N})) AS sample_no) w WHERE NOT EXISTS "
                "(SELECT 1 FROM responses_v r JOIN labels l ON l.doc_id = r.doc_id WHERE r.case_id = c.case_id AND r.sample_no = w.sample_no)")


@query("resume_anti", fx.with_views("responses_v", "cases_v", extra={"ms": _MISSING_SQL}) +
       "SELECT case_id, lang FROM cases_v WHERE case_id IN (SELECT case_id FROM ms)")
def resume_anti(spark, sf):
    r, l = _labelled(spark, sf)
    have = r.join(l, "doc_id", "left_semi")
    return rq.to_resume(fx.cases_v(spark, sf).select("case_id", "lang"), have, RESUME_N)


@query("request_table", fx.with_views("responses_v", "cases_v", extra={"ms": _MISSING_SQL}) +
       "SELECT c.case_id, CAST(s.sample_no AS BIGINT) AS sample_no, CAST(floor(s.sample_no / 2) AS BIGINT) AS batch_no, "
       f"CASE WHEN c.qtype = 'knowledge question-answering' THEN '{rq.QA_SYSTEM_PROMPT}' ELSE '{rq.CODE_SYSTEM_PROMPT}' END AS system_prompt, "
       f"round(CAST({rq.TEMPERATURE} AS DOUBLE), 6) AS temperature, round(CAST({rq.TOP_P} AS DOUBLE), 6) AS top_p "
       "FROM cases_v c JOIN ms s ON s.case_id = c.case_id")
def request_table(spark, sf):
    r, l = _labelled(spark, sf)
    have = r.join(l, "doc_id", "left_semi")
    c = fx.cases_v(spark, sf).select("case_id", (F.col("qtype") == "knowledge question-answering").alias("is_qa"))
    t = rq.request_table(c, have, n=RESUME_N)
    return t.select("case_id", big("sample_no").alias("sample_no"), "batch_no", "system_prompt",
                    rnd("temperature").alias("temperature"), rnd("top_p").alias("top_p"))


@query("consistency_check", cm.sql_with("case_scores", extra={
    "bk": f"SELECT s.model, s.case_id, floor(s.sample_no / {cm.K}) AS bucket, greatest(max(s.score), 0.0) AS best, "
          "max(coalesce(p.max_score, s.tot)) AS tc FROM kw_scores s JOIN case_params p ON p.case_id = s.case_id "
          "WHERE p.min_score IS NULL GROUP BY ALL",
    "re": "SELECT model, case_id, avg(least(best, tc) / tc) AS again FROM bk GROUP BY ALL"}) +
       "SELECT re.model, CAST(count(*) AS BIGINT) AS n_checked, CAST(count(*) FILTER (WHERE abs(re.again - cs.now_score) > 1e-9) AS BIGINT) AS n_mismatch "
       "FROM re JOIN case_scores cs ON cs.model = re.model AND cs.case_id = re.case_id GROUP BY re.model")
def consistency_check(spark, sf):
    s = cm.kw_scores(spark, sf).join(cm.case_params(spark, sf), "case_id").where(F.col("min_score").isNull())
    b = s.groupBy("model", "case_id", F.floor(F.col("sample_no") / cm.K).alias("bucket")).agg(
        F.greatest(F.max("score"), F.lit(0.0)).alias("best"),
        F.max(F.coalesce(F.col("max_score"), F.col("tot"))).alias("tc"))
    again = b.groupBy("model", "case_id").agg(F.avg(F.least("best", "tc") / F.col("tc")).alias("again"))
    cs = rd.reduce_samples(cm.sample_now(spark, sf), f"avg_max_{cm.K}")
    j = again.join(cs, ["model", "case_id"])
    return j.groupBy("model").agg(big(F.count(F.lit(1))).alias("n_checked"),
                                  big(F.count_if(F.abs(F.col("again") - F.col("now_score")) > 1e-9)).alias("n_mismatch"))
