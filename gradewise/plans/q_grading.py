"""Catalogue: handlers by name, relabelled metrics, alternatives of blanks, arrival
order over files, stored results, ordered completions, report order and warnings."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradewise.operators import blanks as bl
from gradewise.operators import hooks as hk
from gradewise.operators import keywords as kw
from gradewise.operators import outcomes as oc
from gradewise.operators import report as rp
from gradewise.operators import requests as rq
from gradewise.plans import common as cm
from gradewise.plans import q_blanks as qb
from gradewise.plans import q_io as qi
from gradewise.plans import q_scoring as qs
from gradewise.plans.registry import big, query, rnd
from gradewise.sources import fixtures as fx
from gradewise.sources import readers, results, writers
from gradewise.sources.tables import scratch_path, table

KEYS = ("model", "case_id", "sample_no")


def _halved(score, tot, statuses):
    """Post-handler of the fixture: half the score where any rule is unmatched."""
    some = F.exists(statuses, lambda s: s == "unmatch")
    return F.struct(F.when(some, score / 2).otherwise(score).alias("score"), tot.alias("tot"),
                    F.when(some, F.lit("halved")).otherwise(F.lit("whole")).alias("detail"))


# Post-handler named by each case of the fixture.
_KW_POST = "CASE case_id % 3 WHEN 0 THEN 'require_all' WHEN 1 THEN 'halved' END"


@query("kw_post_handler", cm.sql_with("kw_scores", extra={
    "al": "SELECT model, case_id, sample_no, bool_and(m) AS every FROM kw_eff GROUP BY ALL",
    "ps": f"SELECT k.*, a.every, {_KW_POST.replace('case_id', 'k.case_id')} AS post FROM kw_scores k JOIN al a ON a.model = k.model AND a.case_id = k.case_id AND a.sample_no = k.sample_no"}) +
       "SELECT model, case_id, sample_no, round(CASE post WHEN 'require_all' THEN (CASE WHEN every THEN tot ELSE 0.0 END) "
       "WHEN 'halved' THEN (CASE WHEN every THEN score ELSE score / 2 END) ELSE score END, 6) AS score, round(tot, 6) AS tot, "
       "CASE post WHEN 'require_all' THEN (CASE WHEN every THEN 'all matched' ELSE 'missing keywords' END) "
       "WHEN 'halved' THEN (CASE WHEN every THEN 'whole' ELSE 'halved' END) END AS detail FROM ps")
def kw_post_handler(spark, sf):
    """Keyword scores replaced by the post-handler that the case names, if any."""
    s = kw.keyword_scores(fx.responses_base(spark, sf), cm.rules(spark, sf), keys=("doc_id", "model", "case_id"))
    done = hk.after(F.col("score"), F.col("tot"), F.col("statuses"), F.expr(_KW_POST), {**hk.POST, "halved": _halved})
    s = fx.numbered(s.select("doc_id", "model", "case_id", done.alias("p")))
    return s.select(*KEYS, rnd("p.score").alias("score"), rnd("p.tot").alias("tot"), F.col("p.detail").alias("detail"))


@query("blank_post_handler", qb._BASE + "SELECT doc_id, case_id, round(CAST(CASE WHEN case_id % 2 = 0 THEN least(CASE WHEN contains(fill, 'e') THEN 2.0 ELSE 0.0 END + "
       "CASE WHEN contains(fill, 'a') AND contains(fill, 'n') THEN 1.0 ELSE 0.0 END, 2.0) WHEN fill = w2 THEN 3.0 ELSE 0.0 END AS DOUBLE), 6) AS score, "
       "round(CAST(CASE WHEN case_id % 2 = 0 THEN 2.0 ELSE 3.0 END AS DOUBLE), 6) AS tot FROM bf")
def blank_post_handler(spark, sf):
    """Blank scores; cases with an even id name a post-handler that scores the
    text in the blank: +2 for 'e', +1 for both 'a' and 'n', at most 2."""
    s = qb._scores(spark, sf, qb._w2(), weight=3.0)
    name = F.when(F.col("case_id") % 2 == 0, F.lit("letters"))
    done = hk.after(F.col("score"), F.col("tot"), F.col("details"), name, {"letters": hk.fill_points("e", ["a", "n"])})
    return s.select("doc_id", "case_id", done.alias("p")).select("doc_id", "case_id", rnd("p.score").alias("score"), rnd("p.tot").alias("tot"))


_ALT_RX = "'^' || lower(substr(regexp_replace(w2, '[^A-Za-z]', '', 'g'), 1, 1)) || '.*[aeiou]$'"


@query("blank_alternatives", qb._BASE + "SELECT doc_id, case_id, CASE WHEN contains(lower(fill), lower(substr(w2, 2, 3))) THEN 1 "
       f"WHEN regexp_matches(lower(fill), {_ALT_RX}) THEN 2 WHEN contains(lower(fill), 'e') THEN 3 ELSE 0 END AS answer FROM bf")
def blank_alternatives(spark, sf):
    """Three alternatives of one target, searched in the lowered fill (F9, J3):
    a part of the word, a regex, a letter. ``answer``: the first that matches, 0 for none."""
    c = fx.cases_v(spark, sf)
    w = qb._w2()
    first = F.lower(F.substring(F.regexp_replace(w, "[^A-Za-z]", ""), 1, 1))
    alts = [(F.substring(w, 2, 3), False), (F.concat(F.lit("^"), first, F.lit(".*[aeiou]$")), True), (F.lit("e"), False)]
    packed = F.array(*[F.struct(p.alias("pattern"), F.lit(r).alias("is_regex"), F.lit(None).cast("string").alias("cond")) for p, r in alts])
    targets = c.select("case_id", F.lit(0).alias("target_no"), F.lit(1.0).alias("weight"), F.lit(True).alias("to_lower"),
                       F.lit(True).alias("substr_match"), packed.alias("alternatives"))
    s = bl.blank_scores(fx.blank_responses(spark, sf), fx.blank_templates(spark, sf), targets)
    detail = F.element_at("details", 1)
    ans = F.regexp_extract(detail, r"(?s), ans: (.*)$", 1)
    j = s.join(c.select("case_id", F.array(*[p for p, _ in alts]).alias("alts")), "case_id")
    return j.select("doc_id", "case_id", F.when(F.startswith(detail, F.lit("matched")), F.array_position("alts", ans)).otherwise(0)
                    .cast("int").alias("answer"))


# ------------------------------------------------------------- named metrics
_NAMED_CTES = {
    **qs._METRIC_CTES,
    "ms": "SELECT model, case_id, sample_no, 'keywords' AS metric, score, tot FROM kw_scores UNION ALL "
          "SELECT model, case_id, sample_no, CASE WHEN case_id % 3 = 0 THEN 'placement' WHEN case_id % 3 = 1 THEN 'order' ELSE 'custom' END AS metric, "
          "CASE WHEN contains(text, 'th') AND contains(text, ', ') AND strpos(text, 'th') < strpos(text, ', ') THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END, "
          "CAST(1.0 AS DOUBLE) FROM responses_v",
    "best": f"SELECT model, case_id, CAST(floor(sample_no / {cm.K}) AS BIGINT) AS bucket, arg_max(sample_no, (raw, sample_no)) AS sample_no FROM raw GROUP BY ALL"}


def _order(text):
    return hk.order_handler(text, "th", ", ")


def _order_named(text):
    return hk.order_handler(text, "th", ", ")


_order_named.metric = "order"


@query("report_by_metric_named", cm.sql_with("kw_scores", "case_params", views=("responses_v", "keyword_rules_v", "cases_v"), extra=_NAMED_CTES) +
       "SELECT s.model, s.metric, round(mean, 6) AS mean, round(std, 6) AS std, CAST(n_buckets AS BIGINT) AS n_buckets, "
       "round(full_total, 6) AS full_total, CAST(freq AS BIGINT) AS freq FROM stm s JOIN fum f ON f.model = s.model AND f.metric = s.metric")
def report_by_metric_named(spark, sf):
    """The metric section with custom metrics under their own names (J8, H1): given by
    the case (``placement``), by the handler (``order``), or neither (``custom``)."""
    handlers = {"m.plain": _order, "m.named": _order_named}
    r = fx.responses_base(spark, sf)
    name = F.when(F.col("case_id") % 3 == 1, F.lit("m.named")).otherwise(F.lit("m.plain"))
    given = F.when(F.col("case_id") % 3 == 0, F.lit("placement"))
    c = r.select("doc_id", "model", "case_id", hk.metric_name(name, given, handlers).alias("metric"),
                 hk.dispatch(name, handlers, F.col("text")).alias("c"))
    c = fx.numbered(c).select(*KEYS, "metric", "c.score", "c.tot")
    k = cm.kw_scores(spark, sf).select(*KEYS, F.lit("keywords").alias("metric"), "score", "tot")
    m = rp.by_metric(k.unionByName(c), cm.case_params(spark, sf), cm.K)
    return m.select("model", "metric", rnd("mean").alias("mean"), rnd("std").alias("std"),
                    big("n_buckets").alias("n_buckets"), rnd("full_total").alias("full_total"), big("freq").alias("freq"))


# ---------------------------------------------------------------- file order
CSV_FILES = 3


def _batch_files(d) -> int:
    """``CSV_FILES``, and more where the table's scan has more tasks: a CSV file with line
    breaks in its cells is written and read by one task, so files must not grow with the table."""
    try:
        return max(CSV_FILES, d.rdd.getNumPartitions())
    except Exception:  # noqa: BLE001 - no RDD view (e.g. a Connect session)
        return CSV_FILES


@query("arrival_index", "SELECT source AS filename, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS sample_no, "
       "md5(coalesce(text, '')) AS completion_md5, text IS NULL OR text = '' AS was_null FROM documents")
def arrival_index(spark, sf):
    """Sample numbers of batch results that come in several CSV files: written
    in ranges of doc_id (file names and rows ascend), read back, numbered by arrival."""
    d = table(spark, sf, "documents").select("doc_id", "source", "text")
    d = d.repartitionByRange(_batch_files(d), "doc_id").sortWithinPartitions("doc_id")
    path = scratch_path(spark, "batch-csv")
    writers.write_csv(d.select(F.col("source").alias("filename"), F.nullif("text", F.lit("")).alias("completion")), path)
    r = readers.unpack_batch_csv(readers.read_batch_csv(spark, path))
    return r.select(F.col("case_path").alias("filename"), big("sample_no").alias("sample_no"), F.md5("text").alias("completion_md5"), "was_null")


# -------------------------------------------------------------- stored results
def _stored(spark, sf):
    path = scratch_path(spark, "runs")
    scores = cm.kw_scores(spark, sf).select(*KEYS, F.lit("keywords").alias("metric"), "score", "tot")
    cases = cm.case_params(spark, sf).withColumn("case_no", F.col("case_id"))
    results.store_run(path, "a", scores, cases)
    results.store_run(path, "b", scores.withColumn("score", F.lit(0.0)), cases)
    return results.read_runs(spark, path, runs=["a"])


@query("report_from_store", cm.sql_with("case_scores", extra=qs._ROLLUP_CTES) +
       "SELECT model, dimension, key, round(mean, 6) AS mean, round(std, 6) AS std, CAST(n_buckets AS BIGINT) AS n_buckets, "
       "round(full_total, 6) AS full_total, CAST(freq AS BIGINT) AS freq FROM rep")
def report_from_store(spark, sf):
    """Two runs stored by run and model; the report of one, from its folders (S7)."""
    r = results.stored_report(_stored(spark, sf), cm.K)
    return r.select("model", "dimension", "key", rnd("mean").alias("mean"), rnd("std").alias("std"),
                    big("n_buckets").alias("n_buckets"), rnd("full_total").alias("full_total"), big("freq").alias("freq"))


# ------------------------------------------------------------ completions (O2)
COMPLETIONS_PER_ROW = 8


@query("completions_in_order", fx.with_views("outcomes_v") +
       f"SELECT case_id, CAST(floor(sample_no / {COMPLETIONS_PER_ROW}) AS BIGINT) AS block, CAST(min(sample_no) AS BIGINT) AS first_id, "
       "CAST(max(sample_no) AS BIGINT) AS last_id, string_agg(sample_no || ':' || (return_code = 0 AND NOT timed_out), ',' ORDER BY sample_no) AS completions "
       "FROM outcomes_v GROUP BY ALL")
def completions_in_order(spark, sf):
    o = fx.outcomes_v(spark, sf).withColumn("passed", (F.col("return_code") == 0) & ~F.col("timed_out"))
    c = oc.completions_in_order(o, block=COMPLETIONS_PER_ROW)
    text = F.array_join(F.transform("completions", lambda x: F.concat_ws(":", x["id"].cast("string"), x["passed"].cast("string"))), ",")
    return c.select("case_id", "block", big("first_id").alias("first_id"), big("last_id").alias("last_id"), text.alias("completions"))


# ----------------------------------------------------------------- report order
_CASE_NO = "(case_id * 7919) % 1000003"


@query("report_in_order", cm.sql_with("case_scores", extra={
    **qs._ROLLUP_CTES,
    "cj": f"SELECT s.model, c.lang, c.qtype, c.full_score, {_CASE_NO.replace('case_id', 'c.case_id')} AS case_no FROM case_scores s JOIN cases_v c ON c.case_id = s.case_id",
    "fu": qs._ROLLUP_CTES["fu"].replace("count(*) AS freq", "count(*) AS freq, min(case_no) AS first_case"),
    "rep": "SELECT model, dimension, key, full_total, first_case FROM fu"}) +
       "SELECT model, dimension, key, CAST(row_number() OVER (PARTITION BY model ORDER BY CASE dimension WHEN 'total' THEN 0 WHEN 'lang' THEN 1 ELSE 2 END, "
       "full_total DESC, first_case, key) AS BIGINT) AS place FROM rep")
def report_in_order(spark, sf):
    """Order of a report's rows: section, full score, first appearance in the suite (O1)."""
    s = cm.sample_now(spark, sf)
    cases = fx.cases_v(spark, sf).withColumn("case_no", F.expr(_CASE_NO))
    r = rp.rollup(qs.rd.bucket_best(s, cm.K), qs.rd.reduce_samples(s, f"avg_max_{cm.K}"), cases)
    return rp.in_order(r).select("model", "dimension", "key", big("place").alias("place"))


@query("report_pivot_all", "SELECT * FROM (PIVOT (" + cm.sql_with("case_scores", extra=qs._ROLLUP_CTES) +
       "SELECT dimension, key, model, round(mean, 6) AS mean FROM rep) ON model USING max(mean) GROUP BY dimension, key)")
def report_pivot_all(spark, sf):
    """The report with a column per model of the data (U3)."""
    report = qs._rollup(spark, sf).select("model", "dimension", "key", rnd("mean").alias("mean"))
    return rp.pivot_models(report, rp.model_names(table(spark, sf, "documents").select(F.col("source").alias("model"))))


# -------------------------------------------------------------------- the rest
@query("negative_score_warnings", cm.sql_with("sample_now") + "SELECT model, case_id, sample_no, 'negative score' AS warning FROM sample_now WHERE ans < 0")
def negative_score_warnings(spark, sf):
    w = readers.score_warnings(cm.sample_now(spark, sf))
    return w.select(*KEYS, F.split_part("warning", F.lit(":"), F.lit(1)).alias("warning"))


@query("lang_workers", fx.with_views("cases_v", extra={"rl": f"SELECT case_id, {qi._RAW_SQL} AS raw_lang FROM cases_v"}) +
       f"SELECT case_id, raw_lang, CAST(CASE {qi._ALIAS_SQL} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in oc.DEFAULT_WORKERS.items()) +
       " END AS INTEGER) AS workers FROM rl")
def lang_workers(spark, sf):
    c = fx.cases_v(spark, sf).select("case_id", qi._raw_lang(F.col("case_id")).alias("raw_lang"))
    return c.select("case_id", "raw_lang", oc.default_workers(oc.canonical_lang(F.col("raw_lang"))).cast("int").alias("workers"))


@query("prompt_table_bare", fx.with_views("cases_v", extra={"p": qi._PROMPT_SQL}) +
       "SELECT p.idx, p.filename, p.question_type, p.system_prompt, c.ref_text AS prompt, "
       f"CAST({qi._TOK.format(c='p.prompt')} AS BIGINT) AS n_token FROM p JOIN cases_v c ON c.case_id = p.idx")
def prompt_table_bare(spark, sf):
    """Prompts for Parquet: the bare content, the system prompt beside it (K2)."""
    c = fx.cases_v(spark, sf)
    qa = F.col("qtype") == "knowledge question-answering"
    p = rq.bare_prompt_table(c.select(F.col("case_id").alias("idx"), F.concat(F.lit("eval_"), F.col("case_id").cast("string"), F.lit(".yaml")).alias("filename"),
                                      F.col("qtype").alias("question_type"), qa.alias("qa"), "ref_text"), F.col("qa"), F.col("ref_text"))
    return p.select("idx", "filename", "question_type", "system_prompt", "prompt", big("n_token").alias("n_token"))


@query("manifest_by_idx", fx.with_views("responses_v") +
       "SELECT model, CAST(case_id AS BIGINT) AS idx, string_agg(case_id || '_' || sample_no || '.txt', ',' ORDER BY sample_no) AS files FROM responses_v GROUP BY ALL")
def manifest_by_idx(spark, sf):
    """File names of a run's samples in the naming of Parquet results (K3)."""
    r = fx.sample_keys(spark, sf).select("model", F.col("case_id").alias("idx"), "sample_no", F.col("case_id").cast("string").alias("case_path"))
    m = writers.manifest(r, "idx").groupBy("model", "case_path").agg(F.array_sort(F.collect_list(F.struct("block", "files"))).alias("b"))
    return m.select("model", F.col("case_path").cast("long").alias("idx"), F.array_join(F.flatten(F.transform("b", lambda x: x["files"])), ",").alias("files"))
