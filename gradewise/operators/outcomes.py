"""Execution outcomes -> status, pass flags, unit-test score, pass@k.

Programs are not run here: the sandbox's results arrive as a table
(return code, stdout, stderr, timed_out) and everything after that is
expressions and aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gradewise.functions.text import as_col

# ---------------------------------------------------------------- fixed values
# Default test timeout (seconds) per language.
DEFAULT_TIMEOUT = {"python": 10, "cpp": 60, "javascript": 10, "typescript": 20, "java": 10,
                   "go": 20, "rust": 300, "sql": 10, "c#": 20, "r": 20}
# Default number of parallel test workers per language.
DEFAULT_WORKERS = {"python": 4, "cpp": 4, "javascript": 4, "typescript": 4, "java": 1,
                   "go": 4, "rust": 1, "sql": 1, "c#": 4, "r": 4}
# Language aliases accepted by the unit-test grader, and their canonical name.
LANG_ALIASES = {
    "python": "python",
    "c": "cpp", "c++": "cpp", "cpp": "cpp", "c/c++": "cpp", "c++/c": "cpp", "cpp/c": "cpp", "c/cpp": "cpp",
    "js": "javascript", "javascript": "javascript",
    "java": "java",
    "c#": "c#", "c-sharp": "c#", "csharp": "c#", "cs": "c#",
    "ts": "typescript", "typescript": "typescript",
    "r": "r",
    "go": "go",
}
# ------------------------------------------------------------ end fixed values


def canonical_lang(lang) -> Column:
    """Canonical language name, or null when unsupported (an error row)."""
    m = F.create_map(*[F.lit(x) for kv in LANG_ALIASES.items() for x in kv])
    return F.element_at(m, as_col(lang))


def default_timeout(lang) -> Column:
    m = F.create_map(*[F.lit(x) for kv in DEFAULT_TIMEOUT.items() for x in kv])
    return F.element_at(m, as_col(lang)).cast("double")


def default_workers(lang) -> Column:
    m = F.create_map(*[F.lit(x) for kv in DEFAULT_WORKERS.items() for x in kv])
    return F.element_at(m, as_col(lang))


def exec_status(return_code, stdout, stderr, timed_out, lang) -> Column:
    """Status string of one run: ``time out``, ``failed: returncode: N msg``
    or ``passed msg`` where msg prefers stderr over stdout; Go reports only
    ``passed`` / ``failed: <stderr or stdout>``. A run without a return code
    that did not time out proves nothing: ``error: no return code``."""
    rc, out, err = as_col(return_code), F.coalesce(as_col(stdout), F.lit("")), F.coalesce(as_col(stderr), F.lit(""))
    msg = (F.when(err != "", F.concat(F.lit("stderr: "), err))
            .when(out != "", F.concat(F.lit("stdout: "), out)).otherwise(F.lit("")))
    generic = F.when(rc == 0, F.concat(F.lit("passed "), msg)) \
        .otherwise(F.concat(F.lit("failed: returncode: "), rc.cast("string"), F.lit(" "), msg))
    go = F.when(rc == 0, F.lit("passed")).otherwise(
        F.concat(F.lit("failed: "), F.when(err != "", err).otherwise(out)))
    return (F.when(as_col(timed_out), F.lit("time out")).when(rc.isNull(), F.lit("error: no return code"))
            .when(as_col(lang) == "go", go).otherwise(generic))


def passed(status) -> Column:
    return F.startswith(as_col(status), F.lit("passed"))


def unit_test_scores(outcomes: DataFrame, keys=("case_id", "sample_no")) -> DataFrame:
    """Weighted pass score per sample: sum(passed * weight), sum(weight)."""
    w = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in outcomes.columns else F.lit(1.0)
    p = F.col("passed").cast("double")
    return outcomes.groupBy(*keys).agg(F.sum(p * w).alias("score"), F.sum(w).alias("tot"),
                                       F.avg(p).alias("pass_rate"))


def pass_at_k_estimate(n: Column, c: Column, k: int) -> Column:
    """1 - C(n-c, k) / C(n, k) as the product over i = n-c+1..n of (1 - k/i);
    1.0 when n - c < k. The ``c == 0`` guard keeps ``sequence`` from
    counting down."""
    prod = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda a, i: a * (F.lit(1.0) - F.lit(float(k)) / i))
    return (F.when(n - c < k, F.lit(1.0)).when(c == 0, F.lit(0.0))
            .otherwise(F.lit(1.0) - prod))


def pass_at_k(outcomes: DataFrame, ks=(1, 10, 100), task: str = "case_id") -> DataFrame:
    """Mean pass@k over tasks for each k that every task has samples for.

    outcomes: task, passed. Counting per task is an algebraic aggregate
    (map-side combined); the estimate runs on one row per task."""
    per_task = outcomes.groupBy(task).agg(F.count(F.lit(1)).alias("n"),
                                          F.count_if(F.col("passed")).alias("c"))
    ests = [F.struct(F.lit(k).alias("k"), pass_at_k_estimate(F.col("n"), F.col("c"), k).alias("est"))
            for k in ks]
    e = per_task.select("n", F.explode(F.array(*ests)).alias("e"))
    return (e.groupBy(F.col("e.k").alias("k"))
            .agg(F.avg("e.est").alias("pass_at_k"), F.min("n").alias("min_n"))
            .where(F.col("min_n") >= F.col("k")).select("k", "pass_at_k"))


COMPLETION_BLOCK = 1 << 12


def completions_in_order(outcomes: DataFrame, task: str = "case_id", completion: str = "sample_no",
                         value: str = "passed", block: int = COMPLETION_BLOCK) -> DataFrame:
    """The completions of each task in order of their id, in lists of at most
    ``block`` ids: task, block, first_id, last_id, completions (array of struct(id, value)).

    Ids are cut into ranges of ``block`` values; a (task, range) is a group of its own, so a
    task with most of the completions is many rows, sorted in many tasks, never one."""
    at = F.floor(F.col(completion) / F.lit(block)).cast("long").alias("block")
    item = F.struct(F.col(completion).alias("id"), F.col(value).alias(value))
    d = outcomes.groupBy(task, at).agg(F.array_sort(F.collect_list(item)).alias("completions"))
    return d.select(task, "block", F.element_at("completions", 1)["id"].alias("first_id"),
                    F.element_at("completions", -1)["id"].alias("last_id"), "completions")


def preview(result, n: int = 40) -> Column:
    """First ``n`` characters of an execution result (log preview)."""
    return F.left(as_col(result), F.lit(n))
