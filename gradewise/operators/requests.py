"""Coverage, resume and inference-request tables (the data side of the
response-collection stage; no network client lives here)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradewise.functions.text import rouge_tokens

# ---------------------------------------------------------------- fixed values
# Sampling parameters of the published runs.
TEMPERATURE = 0.2
TOP_P = 0.9
SAMPLES_PER_CASE = 30
REQUEST_BATCH = 2
# ------------------------------------------------------------ end fixed values

QA_SYSTEM_PROMPT = "Answer the question about code clearly and concisely."
CODE_SYSTEM_PROMPT = "You are a helpful programming assistant. Answer with code where useful."


def coverage(cases: DataFrame, have: DataFrame, key: str = "case_id") -> DataFrame:
    """Semi/anti join counts: ``have`` rows per case that are in ``cases``,
    and the cases of the suite with nothing in ``have``."""
    present = have.join(cases.select(key), key, "left_semi")
    missing = cases.join(have.select(key), key, "left_anti")
    return present, missing


def missing_samples(cases: DataFrame, samples: DataFrame, n: int, key: str = "case_id") -> DataFrame:
    """``cases`` with one row per sample number of 0..n-1 that was not
    collected: the wanted (case, sample_no) less those at hand. Numbers
    outside that range neither count nor matter."""
    wanted = cases.withColumn("sample_no", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    have = samples.select(key, F.col("sample_no").cast("int").alias("sample_no"))
    return wanted.join(have, [key, "sample_no"], "left_anti")


def to_resume(cases: DataFrame, samples: DataFrame, n: int, key: str = "case_id") -> DataFrame:
    """Cases that miss at least one of the samples 0..n-1."""
    missing = missing_samples(cases.select(key), samples, n, key).select(key).distinct()
    return cases.join(missing, key, "left_semi")


def request_table(cases: DataFrame, samples: DataFrame, n: int = SAMPLES_PER_CASE,
                  batch: int = REQUEST_BATCH, key: str = "case_id") -> DataFrame:
    """One request row per (case, missing sample index), with the system
    prompt chosen by the grading kind and the sampling parameters; samples
    are grouped into request batches of ``batch``.

    cases: key, is_qa. samples: key, sample_no (already collected)."""
    r = missing_samples(cases.select(key, "is_qa"), samples, n, key)
    return r.select(
        key, "sample_no",
        F.floor(F.col("sample_no") / F.lit(batch)).cast("long").alias("batch_no"),
        F.when(F.col("is_qa"), F.lit(QA_SYSTEM_PROMPT)).otherwise(F.lit(CODE_SYSTEM_PROMPT)).alias("system_prompt"),
        F.lit(TEMPERATURE).alias("temperature"), F.lit(TOP_P).alias("top_p"))


def is_qa(grading_keys) -> F.Column:
    """Similarity is the only grading kind -> question-answering prompt."""
    return (F.size(grading_keys) == 1) & F.array_contains(grading_keys, "similarity")


def prompt_table(cases: DataFrame, qa: F.Column, content: F.Column, end_newline: bool = False,
                 tokenizer=rouge_tokens) -> DataFrame:
    """Prompt rows for CSV: system prompt, ``content_prompt`` (the content alone),
    ``prompt`` = system prompt + newline + content (+ newline), and the number of
    tokens of system prompt + newline + content."""
    d = bare_prompt_table(cases, qa, content, tokenizer).withColumnRenamed("prompt", "content_prompt")
    prompt = F.concat("system_prompt", F.lit("\n"), "content_prompt", F.lit("\n" if end_newline else ""))
    return d.select(*cases.columns, "system_prompt", "content_prompt", prompt.alias("prompt"), "n_token")


def bare_prompt_table(cases: DataFrame, qa: F.Column, content: F.Column, tokenizer=rouge_tokens) -> DataFrame:
    """Prompt rows for Parquet: the system prompt apart and ``prompt`` the bare
    content; ``n_token`` counts both."""
    system = F.when(qa, F.lit(QA_SYSTEM_PROMPT)).otherwise(F.lit(CODE_SYSTEM_PROMPT))
    d = cases.select(*cases.columns, system.alias("system_prompt"), content.alias("prompt"))
    return d.withColumn("n_token", F.size(tokenizer(F.concat("system_prompt", F.lit("\n"), "prompt"))))
