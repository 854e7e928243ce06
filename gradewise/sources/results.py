"""Stored results of graded runs, and reports made from them without grading.

A store is a folder of two Parquet tables, ``metric_scores`` (model, case_id,
sample_no, metric, score, tot) partitioned by run and model, and ``cases`` (case_id,
case_no, lang, qtype, full_score, max_score, min_score) partitioned by run. A report
of some runs or models reads their folders only.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradewise.operators import reduce as rd
from gradewise.operators import report as rp

SCORES = "model string, case_id string, sample_no int, metric string, score double, tot double, error string"
CASES = ("case_id string, case_no int, lang string, qtype string, full_score double, max_score double, min_score double")


class Stored(NamedTuple):
    metric_scores: DataFrame
    cases: DataFrame


def _shaped(df: DataFrame, schema: str, run: str) -> DataFrame:
    """The columns of ``schema`` in its types (missing ones null) and the run."""
    cols = []
    for name, dtype in (c.split() for c in schema.split(", ")):
        cols.append((F.col(name) if name in df.columns else F.lit(None)).cast(dtype).alias(name))
    return df.select(F.lit(run).alias("run"), *cols)


def store_run(path: str, run: str, metric_scores: DataFrame, cases: DataFrame) -> None:
    """Write a run; a run of that name is replaced, model by model."""
    for name, df, schema, by in (("metric_scores", metric_scores, SCORES, ["run", "model"]), ("cases", cases, CASES, ["run"])):
        _shaped(df, schema, run).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
            .partitionBy(*by).parquet(f"{path}/{name}")


def read_runs(spark: SparkSession, path: str, runs: list[str] | None = None, models: list[str] | None = None) -> Stored:
    """The stored tables; runs and models are filters on folders."""
    scores = spark.read.schema(f"{SCORES}, run string").parquet(f"{path}/metric_scores")
    cases = spark.read.schema(f"{CASES}, run string").parquet(f"{path}/cases")
    if runs is not None:
        scores, cases = (d.where(F.col("run").isin(*runs)) for d in (scores, cases))
    if models is not None:
        scores = scores.where(F.col("model").isin(*models))
    return Stored(scores, cases)


def sample_scores(stored: Stored) -> DataFrame:
    """Clipped and normalised scores of one run's samples; cases with an error are left out."""
    return rd.clip_normalise(rd.combine_metrics(stored.metric_scores), stored.cases)


def stored_report(stored: Stored, k: int) -> DataFrame:
    """Sections total, language and type of one run (``report.rollup``) from its stored scores."""
    s = sample_scores(stored)
    failed = s.where("error is not null").select("model", "case_id").distinct()
    s = s.drop("error").join(failed, ["model", "case_id"], "left_anti")
    return rp.rollup(rd.bucket_best(s, k), rd.reduce_samples(s, f"avg_max_{k}"), stored.cases)


def stored_by_metric(stored: Stored, k: int) -> DataFrame:
    """The metric section (``report.by_metric``) of one run from its stored scores."""
    return rp.by_metric(stored.metric_scores.where("error is null"), stored.cases, k)
