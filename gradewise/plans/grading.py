"""End-to-end grading of a run from files: suite -> cases -> responses ->
scores of all five grading kinds -> clip/normalise -> sample reduction ->
totals, with a row for everything that cannot be graded.

The case files are read in one pass into a table of one row per case (``sources.specs``),
which is written, with the references of similarity rules packed beside the rules. A
response is scanned once and meets its whole case in one join; keyword trees, blanks,
similarity, custom metrics and post-handlers are evaluated in that row. What comes out, a
few narrow rows per response, is written; scores, totals, reports and errors read it from
there. Errors travel as rows the whole way: nothing is joined away.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from gradewise.operators import blanks as bl
from gradewise.operators import hooks as hk
from gradewise.operators import keywords as kw
from gradewise.operators import outcomes as oc
from gradewise.operators import reduce as rd
from gradewise.operators import rouge as rg
from gradewise.sources import readers, specs
from gradewise.sources.tables import stored

KEYS = ("model", "case_id", "sample_no")
METRIC = "array<struct<metric:string,score:double,tot:double,detail:string,error:string>>"


class Graded(NamedTuple):
    """case_scores: model, case_id, now_score, now_std, ... of graded cases;
    totals: one row per model; metric_scores: model, case_id, sample_no, metric,
    score, tot, detail, error; errors: model (null: all), case_path, case_id, stage, reason;
    cases: one row per suite entry; counts: rows written by kind, counted while writing."""

    case_scores: DataFrame
    totals: DataFrame
    metric_scores: DataFrame
    errors: DataFrame
    cases: DataFrame
    counts: dict


def _below(path: str) -> str:
    """The folder of a suite file, as files report it: scheme, host and all,
    without its first slashes."""
    return re.escape(re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:/*", "", path.rsplit("/", 1)[0] if "/" in path else "").strip("/"))


def load_cases(spark: SparkSession, suite_path: str, case_paths, select: list[str] | None = None, custom=(),
               post_handlers=()) -> tuple[DataFrame, str]:
    """(one row per suite entry: case_no, case_weight and the columns of
    ``specs.CASE`` with the suite's defaults filled in; the suite's reduction mode).
    An entry without a file, or with one that cannot be used, has stage and reason."""
    suite, entries = readers.read_suite(spark, suite_path)
    if select:
        entries = entries.where(F.col("case_path").isin(*select))
    base = _below(suite_path)
    below = F.regexp_extract("case_path", f"{base}/(.*)$" if base else "([^/]+(?:/[^/]+)?)$", 1)
    found = specs.read_cases(spark, case_paths, custom, post_handlers).withColumn("case_path", below)
    s = suite.first()  # one row: the suite's settings
    absent = F.col("stage").isNull() & F.col("case_id").isNull()
    cases = entries.join(found, "case_path", "left")
    return stored(cases.withColumns({
        "full_score": F.coalesce("full_score", F.lit(s.full_score_per_question)),
        "null_score": F.coalesce("null_score", F.lit(s.null_score_per_question)),
        "reason": F.when(absent, F.lit("case file not found")).otherwise(F.col("reason")),
        "stage": F.when(absent, F.lit("load")).otherwise(F.col("stage"))}), "cases"), s.attempt_reduce_mode


def pack_cases(cases: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """The sound cases as responses meet them: prepared rules, template, targets
    and packed references. files (references by path): path, text."""
    refs = cases.where("stage is null").select("case_id", "sims", F.explode("refs").alias("r")).select(
        "case_id", F.get("sims", F.col("r.rule_no"))["metric"].alias("metric"), "r.*")
    if files is not None:
        refs = refs.join(files.select("path", F.col("text").alias("__text")), "path", "left").withColumn(
            "text", F.coalesce("text", "__text"))
    t = bl.prepare_templates(cases.where("stage is null and blank is not null").select("case_id", "blank.*"))
    sound = cases.where("stage is null").select(
        "case_path", "case_id", kw.prepared_rules(F.col("rules")).alias("rules"), "rules_post", F.transform("targets", lambda x: F.struct(
            x["target_no"].alias("target_no"), x["weight"].alias("weight"), x["to_lower"].alias("to_lower"),
            x["substr_match"].alias("substr_match"), bl.prepared_alternatives(x["alts"]).alias("alts"))).alias("targets"),
        F.col("blank.post").alias("blank_post"), "sims", F.col("custom.name").alias("custom"), F.col("custom.metric").alias("custom_metric"))
    return stored(sound.join(rg.pack_rule_references(refs), "case_id", "left").join(t, "case_id", "left"), "packed-cases")


def _metric(metric, score, tot, detail=None, error=None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct((metric if isinstance(metric, Column) else F.lit(metric)).alias("metric"), score.cast("double").alias("score"),
                    tot.cast("double").alias("tot"), (none if detail is None else detail).alias("detail"),
                    (none if error is None else error).alias("error"))


def score_in_row(responses: DataFrame, packed: DataFrame, custom: dict, post_handlers: dict) -> DataFrame:
    """KEYS and the metric columns, one row per response and grading kind of its
    case but unit tests. responses: model, case_path, sample_no, text, and optionally
    error (a response that could not be read: one row with that error)."""
    lost = F.col("error") if "error" in responses.columns else F.lit(None).cast("string")
    j = responses.select("model", "case_path", "sample_no", "text", F.coalesce(lost, F.when(
        F.col("text").isNull(), F.lit("no response text"))).alias("__lost")).join(packed, "case_path")
    j = j.withColumn("__lt", F.when(F.col("rules").isNotNull(), F.lower("text")))
    j = rg.rules_in_row(bl.fill_columns(j, F.col("text")), F.col("text"))
    j = j.withColumns({"__k": F.when(F.col("rules").isNotNull(), kw.fold_trees(F.col("rules"), F.col("text"), F.col("__lt"))),
                       "__b": F.when(F.col("template").isNotNull(), bl.fold_targets(F.col("targets"), F.col("fills"), F.col("rate")))})
    j = j.withColumns({
        "__kh": hk.after(F.col("__k.score"), F.col("__k.tot"), F.col("__k.statuses"), F.col("rules_post"), post_handlers),
        "__bh": hk.after(F.col("__b.score"), F.col("__b.tot"), F.col("__b.details"), F.col("blank_post"), post_handlers),
        "__c": hk.dispatch(F.col("custom"), custom, F.col("text"))})
    none = F.lit(None)
    bad_k = F.when(kw.bad_trees(F.col("rules")), F.lit(kw.BAD_CONDITION))
    bad_b = bl.target_error(F.col("targets"), F.col("n_blank"))

    def guarded(error, c):
        return F.when(error.isNull(), c)

    def no_result(c):
        return F.when(F.col(c)["score"].isNull() | F.col(c)["tot"].isNull(), F.lit("handler gave no score"))
    parts = [
        F.when(F.col("rules").isNotNull(), _metric("keywords", guarded(bad_k, F.col("__kh.score")), guarded(bad_k, F.col("__kh.tot")),
                                                   F.col("__kh.detail"), F.coalesce(bad_k, no_result("__kh")))),
        F.when(F.col("template").isNotNull(), _metric("blank_filling", guarded(bad_b, F.col("__bh.score")),
                                                      guarded(bad_b, F.col("__bh.tot")), F.col("__bh.detail"),
                                                      F.coalesce(bad_b, no_result("__bh")))),
        F.when(F.col("refs").isNotNull(), _metric("similarity", guarded(F.col("sim.error"), F.col("sim.score")),
                                                  guarded(F.col("sim.error"), F.col("sim.tot")), error=F.col("sim.error"))),
        F.when(F.col("custom").isNotNull(), _metric(
            hk.metric_name(F.col("custom"), F.col("custom_metric"), custom), F.col("__c.score"), F.col("__c.tot"),
            F.col("__c.detail"), no_result("__c")))]
    rows = F.filter(F.array(*parts), lambda m: m.isNotNull())
    unread = F.array(_metric("response", none, none, error=F.col("__lost")))
    rows = F.when(F.col("__lost").isNotNull(), unread).otherwise(rows)
    return j.select(*KEYS, F.inline(rows.cast(METRIC)))


def unit_test_rows(responses: DataFrame, cases: DataFrame, outcomes: DataFrame | None) -> DataFrame:
    """Unit tests of each response with the sandbox's outcome, as ``score_in_row``
    gives its metrics; a test without an outcome is an error, a language without a
    runner too. Texts are not read."""
    tests = cases.where("stage is null and tests is not null").select(
        "case_path", "case_id", F.col("lang").alias("case_lang"), F.explode("tests").alias("t")).select(
        "case_path", "case_id", "t.test_no", "t.weight", oc.canonical_lang(F.coalesce("t.lang", "case_lang")).alias("lang"))
    tests = responses.select("model", "case_path", "sample_no").join(tests, "case_path").drop("case_path")
    if outcomes is None:
        tests = tests.select("*", F.lit(None).cast("int").alias("return_code"), F.lit("").alias("stdout"),
                             F.lit("").alias("stderr"), F.lit(False).alias("timed_out"))
    else:
        tests = tests.join(outcomes, [*KEYS, "test_no"], "left")
    status = oc.exec_status(F.col("return_code"), F.col("stdout"), F.col("stderr"),
                            F.coalesce("timed_out", F.lit(False)), F.col("lang"))
    tests = tests.withColumn("status", status).withColumn("passed", oc.passed(F.col("status")))
    error = F.max(F.when(F.col("lang").isNull(), F.lit("unsupported language"))
                  .when(F.startswith("status", F.lit("error")), F.col("status")))
    p, w = F.col("passed").cast("double"), F.col("weight")
    scored = tests.groupBy(*KEYS).agg(F.sum(p * w).alias("score"), F.sum(w).alias("tot"), error.alias("error"))
    return scored.select(*KEYS, F.lit("unit_test").alias("metric"), "score", "tot", F.lit(None).cast("string").alias("detail"), "error")


def metric_scores(responses: DataFrame, cases: DataFrame, outcomes: DataFrame | None = None, files: DataFrame | None = None,
                  custom: dict[str, Callable] | None = None, post_handlers: dict[str, Callable] | None = None) -> DataFrame:
    """Long table KEYS, metric, score, tot, detail, error over all grading kinds.

    cases: as from ``load_cases``. outcomes (unit tests): model, case_id, sample_no,
    test_no, return_code, stdout, stderr, timed_out. custom, post_handlers: handlers by
    name (``operators.hooks``)."""
    rows = score_in_row(responses, pack_cases(cases, files), custom or {}, post_handlers or {})
    return rows.unionByName(unit_test_rows(responses, cases, outcomes))


def grade_suite(spark: SparkSession, suite_path: str, case_paths, responses: DataFrame, mode: str | None = None,
                select: list[str] | None = None, outcomes: DataFrame | None = None, files: DataFrame | None = None,
                custom: dict | None = None, post_handlers: dict | None = None) -> Graded:
    """Grade the responses of one or more models against a suite.

    Every suite entry counts as a case. A case that cannot be loaded, read or
    graded is an error row; it adds neither score nor full score, as do all
    samples of a (model, case) with an erroneous one (a total of zero, a response
    file that is not there, a test without outcome, a handler without result). A case without
    responses gives its own ``null_score``, or else the suite's. ``select``: case paths
    of the suite to keep. Per model, n_cases = n_graded + n_unanswered + n_errors."""
    custom, post_handlers = custom or {}, {**hk.POST, **(post_handlers or {})}
    cases, suite_mode = load_cases(spark, suite_path, case_paths, select, custom, post_handlers)
    seen = Observation("graded")
    rows = metric_scores(responses, cases, outcomes, files, custom, post_handlers)
    rows = rows.observe(seen, F.count("*").alias("metric_rows"), F.count_if(F.col("error").isNotNull()).alias("error_rows"))
    metrics = stored(rows, "metric-scores")
    sound = cases.where("stage is null").select("case_path", "case_id", "full_score", "null_score", "max_score", "min_score")
    per_sample = rd.clip_normalise(rd.combine_metrics(metrics), sound)
    results = rd.reduce_samples(per_sample, mode or suite_mode)
    counted = Observation("cases")
    results = stored(results.observe(counted, F.count_if(F.col("error").isNull()).alias("graded"),
                                     F.count_if(F.col("error").isNotNull()).alias("failed")), "case-results")
    scores = results.where("error is null").drop("error")
    errors = cases.where("stage is not null").select(
        F.lit(None).cast("string").alias("model"), "case_path", "case_id", "stage", "reason").unionByName(
        results.where("error is not null").join(sound, "case_id").select(
            "model", "case_path", "case_id", F.lit("grade").alias("stage"), F.concat_ws(": ", "model", "error").alias("reason")))
    totals = case_totals(results, cases, responses)
    return Graded(scores, totals, metrics, errors, cases, {**seen.get, **counted.get})


def case_totals(results: DataFrame, cases: DataFrame, responses: DataFrame) -> DataFrame:
    """Totals per model from case results (model, case_id, now_score, now_std, error).
    What all sound cases would give unanswered, less what the answered ones would, is
    what the unanswered ones give: no grid of models and cases is built."""
    sound = F.col("stage").isNull()
    suite = cases.agg(F.count("*").alias("n_cases"), F.count_if(~sound).alias("n_unfit"),
                      F.sum(F.when(sound, F.col("null_score")).otherwise(0.0)).alias("null_all"),
                      F.sum(F.when(sound, F.col("full_score")).otherwise(0.0)).alias("full_all"))
    n, unfit, null_all, full_all = (suite.select(F.coalesce(c, F.lit(0))).scalar() for c in suite.columns)
    worth = cases.where(sound).select("case_id", "full_score", "null_score")
    failed = F.col("error").isNotNull()
    got = results.join(worth, "case_id").groupBy("model").agg(
        F.sum("now_score").alias("now"), F.sum("now_std").alias("std"), F.sum("null_score").alias("null_answered"),
        F.sum(F.when(failed, F.col("full_score")).otherwise(0.0)).alias("lost_full"),
        F.count_if(~failed).alias("graded"), F.count_if(failed).alias("failed"))
    answered = responses.join(cases.select("case_path", sound.alias("sound")), "case_path").groupBy("model", "case_path").agg(
        F.first("sound").alias("sound")).groupBy("model").agg(
        F.count("*").alias("n_with_response"), F.count_if("sound").alias("n_sound"))
    models = responses.select("model").distinct()
    j = models.join(answered, "model", "left").join(got, "model", "left").na.fill(0)
    return j.select(
        "model", (F.col("now") + null_all - F.col("null_answered")).alias("total_score"),
        (full_all - F.col("lost_full")).alias("total_full"), F.col("std").alias("sum_of_case_std"),
        n.alias("n_cases"), "n_with_response", F.col("graded").alias("n_graded"),
        (n - unfit - F.col("n_sound")).alias("n_unanswered"), (F.col("failed") + unfit).alias("n_errors"))


def grade(spark: SparkSession, suite_path: str, case_paths, responses: DataFrame, mode: str | None = None,
          **inputs) -> tuple[DataFrame, DataFrame]:
    """(case_scores, totals) of ``grade_suite``."""
    g = grade_suite(spark, suite_path, case_paths, responses, mode, **inputs)
    return g.case_scores, g.totals
