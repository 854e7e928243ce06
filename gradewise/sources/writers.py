"""Sinks: prompt tables, unpacked responses, per-case results, summary,
report. Every writer is a DataFrame write; only the rendered report (a few
dozen rows) is collected to format it as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gradewise.functions.text import path_stem
from gradewise.operators import report as rp


def write_prompts_csv(prompts: DataFrame, path: str) -> None:
    """``requests.prompt_table`` as CSV; quotes in texts are doubled, blanks kept."""
    cols = ["idx", "filename", "question_type", "system_prompt", "content_prompt", "prompt", "n_token"]
    write_csv(prompts.select(*[c for c in cols if c in prompts.columns]), path)


def write_prompts_parquet(prompts: DataFrame, path: str) -> None:
    """``requests.bare_prompt_table`` as Parquet."""
    cols = ["idx", "filename", "question_type", "system_prompt", "prompt", "n_token"]
    write_parquet(prompts.select(*[c for c in cols if c in prompts.columns]), path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"') \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by=None) -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_responses(responses: DataFrame, path: str) -> None:
    """Per-sample responses, partitioned by model (so a model filter prunes
    whole folders)."""
    write_parquet(responses, path, ["model"])


MANIFEST_BLOCK = 1 << 12


def file_name(by: str = "stem") -> Column:
    """Name of a sample's file: ``stem`` (CSV results): <stem of the case
    path>_<sample_no>.txt; ``idx`` (Parquet results): <idx>_<sample_no>.txt."""
    if by not in ("stem", "idx"):
        raise ValueError(f"unknown naming: {by}")
    return F.concat(path_stem(F.col("case_path")) if by == "stem" else F.col("idx").cast("string"),
                    F.lit("_"), F.col("sample_no").cast("string"), F.lit(".txt"))


def manifest(responses: DataFrame, by: str = "stem") -> DataFrame:
    """case_path -> ordered list of sample file names, per model, in rows of at most
    MANIFEST_BLOCK numbers (``block``), so a case with very many samples is many rows.
    responses: model, case_path, sample_no, and idx for the naming ``idx``."""
    block = F.floor(F.col("sample_no") / F.lit(MANIFEST_BLOCK)).cast("long").alias("block")
    return responses.groupBy("model", "case_path", block).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("sample_no", file_name(by).alias("f")))), lambda x: x["f"]).alias("files"))


def summary(totals: DataFrame) -> DataFrame:
    """Summary text per model: total +- sum of case stds / full, counts."""
    txt = F.format_string("Total score: %s ± %s / %s\nTotal cases: %d\nTotal cases with response: %d\n",
                          F.col("total_score"), F.col("sum_of_case_std"), F.col("total_full"),
                          F.col("n_cases"), F.col("n_with_response"))
    return totals.select("model", txt.alias("summary"))


def write_summary(totals: DataFrame, path: str) -> None:
    summary(totals).write.mode("overwrite").json(path)


def render_report(report: DataFrame, models, csv: bool = False) -> str:
    """Rows ordered: overall, languages, types, metrics; within a section by
    full score descending, ties by first appearance in the suite (``first_case``,
    where the report has it) and then by key. Collects the report (tens of rows)."""
    order = rp.section_order(F.col("dimension"))
    if "first_case" not in report.columns:
        report = report.withColumn("first_case", F.lit(0))
    first = models[0]
    piv = report.where(F.col("model").isin(list(models))).groupBy("dimension", "key").pivot("model", list(models)).agg(
        F.first("mean").alias("mean"), F.first("std").alias("std"))
    base = report.where(F.col("model") == first).select("dimension", "key", "full_total", "allocation", "first_case")
    rows = piv.join(base, ["dimension", "key"]).orderBy(order, F.desc("full_total"), "first_case", "key").collect()
    return rp.to_text([r.asDict() for r in rows], models, csv)
