"""Per-sample score assembly and sample reduction.

metric_scores (long: one row per sample and metric)
  -> combine (A5) -> clip/normalise (A6, A7)
  -> reduce samples per case: avg | max | min | avg_max_<k> (A8, A9)
  -> suite totals (A11) and running totals (A12).

All reductions are algebraic aggregates, so Spark combines them map-side
before the shuffle: a case holding a third of the samples is pre-aggregated
per partition and never lands whole in one task.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from gradewise.operators.indexing import running_sum

SAMPLE_KEYS = ("model", "case_id", "sample_no")
CASE_KEYS = ("model", "case_id")


def combine_metrics(metric_scores: DataFrame, keys=SAMPLE_KEYS) -> DataFrame:
    """Sum of metric scores and of metric totals per sample; with an ``error``
    of its metrics where the column exists."""
    error = [F.max("error").alias("error")] if "error" in metric_scores.columns else []
    return metric_scores.groupBy(*keys).agg(
        F.sum("score").alias("ans"), F.sum("tot").alias("tot"), *error)


def clip_normalise(sample_scores: DataFrame, cases: DataFrame, keys=SAMPLE_KEYS) -> DataFrame:
    """``max_score`` replaces the total and caps the score, ``min_score``
    floors it, then ``now = ans / tot * full_score``.

    ``cases`` carries case_id, full_score and optional max_score/min_score.
    A zero total yields ``now = null`` and ``error = 'zero_total'``; an
    ``error`` that the samples have already stays."""
    cols = set(cases.columns)
    mx = F.col("max_score") if "max_score" in cols else F.lit(None).cast("double")
    mn = F.col("min_score") if "min_score" in cols else F.lit(None).cast("double")
    c = cases.select("case_id", F.col("full_score").cast("double").alias("full_score"),
                     mx.cast("double").alias("max_score"), mn.cast("double").alias("min_score"))
    j = sample_scores.join(c, "case_id")
    tot = F.coalesce(F.col("max_score"), F.col("tot"))
    ans = F.when(F.col("max_score").isNotNull(), F.least(F.col("ans"), F.col("max_score"))).otherwise(F.col("ans"))
    ans = F.when(F.col("min_score").isNotNull(), F.greatest(ans, F.col("min_score"))).otherwise(ans)
    now = F.try_divide(ans, tot) * F.col("full_score")
    error = F.when(tot == 0, F.lit("zero_total"))
    if "error" in sample_scores.columns:
        error = F.coalesce(F.col("error"), error)
    return j.select(*keys, ans.alias("ans"), tot.alias("tot"), now.alias("now"), "full_score", error.alias("error"))


def parse_mode(mode: str):
    """'avg' | 'max' | 'min' | 'avg_max_<k>' -> (kind, k)."""
    m = re.fullmatch(r"avg_max_(\d+)", mode)
    if m:
        return "avg_max", int(m.group(1))
    if mode in ("avg", "max", "min"):
        return mode, None
    raise ValueError(f"unsupported score reduction mode: {mode}")


def bucket_col(k: int, sample_col: str = "sample_no"):
    """Bucket of consecutive samples: floor(sample_no / k)."""
    return F.floor(F.col(sample_col) / F.lit(k)).cast("long")


def bucket_best(scores: DataFrame, k: int, value: str = "now", keys=CASE_KEYS) -> DataFrame:
    """Best value per bucket of k consecutive samples."""
    return scores.groupBy(*keys, bucket_col(k).alias("bucket")).agg(F.max(value).alias("best"))


def reduce_samples(scores: DataFrame, mode: str = "avg", value: str = "now",
                   keys=CASE_KEYS) -> DataFrame:
    """Reduce per-sample scores to one score and std per case. Where the samples
    have an ``error``, so has their case (the last by name), and no score or std."""
    kind, k = parse_mode(mode)
    failed = "error" in scores.columns
    error = [F.max("error").alias("error")] if failed else []
    if kind == "avg_max":
        b = scores.groupBy(*keys, bucket_col(k).alias("bucket")).agg(F.max(value).alias("best"), *error)
        out = b.groupBy(*keys).agg(
            F.avg("best").alias("now_score"),
            F.coalesce(F.stddev_samp("best"), F.lit(0.0)).alias("now_std"),
            F.count(F.lit(1)).alias("n_buckets"), *error)
    else:
        agg = {"avg": F.avg, "max": F.max, "min": F.min}[kind]
        out = scores.groupBy(*keys).agg(
            agg(value).alias("now_score"), F.lit(0.0).alias("now_std"),
            F.count(F.lit(1)).alias("n_samples"), *error)
    if not failed:
        return out
    sound = F.col("error").isNull()
    return out.withColumns({c: F.when(sound, F.col(c)) for c in ("now_score", "now_std")})


def weighted_totals(case_scores: DataFrame, cases: DataFrame) -> DataFrame:
    """Suite entries carry a weight that the published totals ignore; this
    opt-in view weights each case's score and full score by it.

    cases: case_id, full_score, case_weight."""
    c = cases.select("case_id", "full_score", F.coalesce("case_weight", F.lit(1.0)).alias("w"))
    j = case_scores.join(c, "case_id")
    return j.groupBy("model").agg(F.sum(F.col("now_score") * F.col("w")).alias("weighted_score"),
                                  F.sum(F.col("full_score") * F.col("w")).alias("weighted_full"))


def suite_totals(case_scores: DataFrame, cases: DataFrame, null_score: float = 0.0) -> DataFrame:
    """Per model: total score, total full score, sum of per-case stds,
    number of cases in the suite and number with a response.

    Missing cases add ``null_score`` and their full score; the suite-wide
    numbers are scalar subqueries, so no models x cases grid is built."""
    n_cases = cases.select(F.count(F.lit(1))).scalar()
    full = cases.select(F.sum("full_score")).scalar()
    return case_scores.groupBy("model").agg(
        F.sum("now_score").alias("resp_score"),
        F.sum("now_std").alias("sum_of_case_std"),
        F.count(F.lit(1)).alias("n_with_response"),
    ).select(
        "model",
        (F.col("resp_score") + F.lit(null_score) * (n_cases - F.col("n_with_response"))).alias("total_score"),
        full.alias("total_full"), "sum_of_case_std",
        n_cases.alias("n_cases"), "n_with_response")


def running_totals(case_scores: DataFrame, order_col: str = "case_id") -> DataFrame:
    """Running score and full score per model in suite order (A12)."""
    d = running_sum(case_scores, ["model"], order_col, "now_score", "running_score")
    return running_sum(d, ["model"], order_col, "full_score", "running_full")
