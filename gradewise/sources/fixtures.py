"""Domain views derived from the driver's tables (cases, responses, rules,
outcomes, turns, code-bearing responses, blank templates).

Each view exists twice: as a lazy DataFrame built with the DataFrame API
(what the library runs) and as SQL text (what the DuckDB oracle runs).
Both define the same rows. All work grows with ``benchmark``,
``documents``, ``labels`` and ``conversations``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradewise.operators.indexing import ordered_index, previous_in_order
from gradewise.sources.tables import spread, table

NL = "\n"
BT3 = "```"

# Fixed mappings of the fixture (must be identical in the SQL below).
LANG_BY_MOD5 = ["python", "javascript", "java", "go", "r"]
QTYPE_BY_MOD4 = ["code completion", "code debugging",
                 "knowledge question-answering", "non-code debugging"]


def _case_expr(col, values, mod):
    expr = None
    for i, v in enumerate(values):
        cond = (col % mod) == i
        expr = F.when(cond, v) if expr is None else expr.when(cond, v)
    return expr


def cases_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(
        F.col("item_id").alias("case_id"),
        _case_expr(F.col("item_id"), LANG_BY_MOD5, 5).alias("lang"),
        _case_expr(F.col("item_id"), QTYPE_BY_MOD4, 4).alias("qtype"),
        F.lit(1.0).cast("double").alias("full_score"),
        F.col("text").alias("ref_text"),
    )


def n_cases(spark: SparkSession, sf_dir: str):
    """Scalar subquery: number of cases (lazy, evaluated by the planner)."""
    return table(spark, sf_dir, "benchmark").select(F.count(F.lit(1))).scalar()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def responses_base(spark: SparkSession, sf_dir: str, spread_rows: bool = True) -> DataFrame:
    """``responses_v`` without the sample index (doc_id, case_id, model, text)."""
    d = documents(spark, sf_dir) if spread_rows else table(spark, sf_dir, "documents")
    return d.select("doc_id", (F.col("doc_id") % n_cases(spark, sf_dir)).alias("case_id"),
                    F.col("source").alias("model"), "text")


def numbered(rows: DataFrame) -> DataFrame:
    """Rows of ``responses_base`` (one per doc_id, any columns besides) with
    their sample number. Numbering shuffles: project texts away before."""
    return ordered_index(rows, ["case_id"], "doc_id", "sample_no")


def responses_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All responses with text and number. Only for what keeps the texts
    (files, arrays): scoring takes ``responses_base`` and numbers its result."""
    d = numbered(responses_base(spark, sf_dir, spread_rows=False))
    return d.select("doc_id", "case_id", F.col("sample_no").cast("long"), "model", "text")


def sample_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, model, case_id, sample_no: the numbers alone."""
    return numbered(responses_base(spark, sf_dir, spread_rows=False).drop("text"))


def keyword_rules_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cases_v(spark, sf_dir)
    r = c.select("case_id", "ref_text",
                 F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("rule_no"))
    return r.select(
        "case_id", "rule_no",
        F.split_part(F.col("ref_text"), F.lit(" "), F.col("rule_no") + 1).alias("pattern"),
        (F.lit(1) + F.col("rule_no") % 2).alias("weight"),
        (F.col("rule_no") == 3).alias("neg"),
        F.col("rule_no").isin(1, 3).alias("to_lower"),
        (F.col("rule_no") == 2).alias("cond_prev_match"),
    )


def outcomes_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = sample_keys(spark, sf_dir)
    l = table(spark, sf_dir, "labels")
    return r.join(l, "doc_id").select(
        r.case_id, r.sample_no, F.lit(0).alias("test_no"),
        (F.lit(1) - l.quality).alias("return_code"),
        (l.toxic == 1).alias("timed_out"),
    )


def _completion():
    return F.when(F.length("text") % 5 == 0, F.lit(None).cast("string")).otherwise(F.col("text"))


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, completion of ``turns_v``, without the turn before."""
    c = table(spark, sf_dir, "conversations")
    return c.where(F.col("role") == "assistant").select("conv_id", "turn", _completion().alias("completion"))


def turns_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    t = previous_in_order(c.select("conv_id", "turn", "role", "text"),
                          ["conv_id"], "turn", ["text"])
    return t.where(F.col("role") == "assistant").select(
        "conv_id", "turn", F.col("prev_text").alias("prompt"),
        _completion().alias("completion"),
    )


def fenced_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = responses_base(spark, sf_dir)
    bt = F.lit(BT3)
    nl = F.lit(NL)
    half = F.floor(F.length("text") / 2).cast("int")
    odd_tail = F.when(F.col("doc_id") % 3 == 0,
                      F.concat(nl, bt, nl, F.lit("odd tail"))).otherwise(F.lit(""))
    txt = F.concat(
        F.lit("intro"), nl, bt, F.lit("py"), nl, F.left("text", half), nl,
        bt, nl, F.lit("mid"), nl, bt, nl, F.substring(F.col("text"), half + 1, F.length("text")), nl,
        F.lit("x = "), (F.col("doc_id") % 7).cast("string"), nl, bt, odd_tail)
    return r.select("doc_id", "case_id", txt.alias("txt"))


def braced_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = responses_base(spark, sf_dir)
    txt = F.concat(F.lit("if (a) { "), F.col("text"), F.lit(" }"),
                   F.when(F.col("doc_id") % 2 == 0, F.lit(" } rest { x }"))
                    .otherwise(F.lit(" tail")))
    return r.select("doc_id", "case_id", txt.alias("txt"))


def blank_responses(spark: SparkSession, sf_dir: str, whole_text: bool = False) -> DataFrame:
    """doc_id, case_id, response to the case's blank template: the reference's
    second word in the blank and, for odd ids, the model's name behind the
    end -- or, with ``whole_text``, the response's own text."""
    r = responses_base(spark, sf_dir)
    c = cases_v(spark, sf_dir)
    tail = F.concat(F.lit("\n"), r.text) if whole_text else r.model
    response = F.concat(
        F.lit('Use "'), F.split_part(c.ref_text, F.lit(" "), F.lit(2)), F.lit('" with '),
        c.ref_text, F.lit(" done."), F.when(r.doc_id % 2 == 1, tail).otherwise(F.lit("")))
    return r.join(c, "case_id").select(r.doc_id, r.case_id, response.alias("response"))


def blank_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``blank_responses`` with the whole response text behind the end, for
    every id. No SQL: it is beyond what the oracle can align."""
    r = responses_base(spark, sf_dir)
    c = cases_v(spark, sf_dir)
    response = F.concat(
        F.lit('Use "'), F.split_part(c.ref_text, F.lit(" "), F.lit(2)), F.lit('" with '),
        c.ref_text, F.lit(" done.\n"), F.coalesce(r.text, F.lit("")))
    return r.join(c, "case_id").select(r.doc_id, r.case_id, response.alias("response"))


def blank_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One blank template per case (default blank string and escape)."""
    c = cases_v(spark, sf_dir)
    return c.select("case_id", F.concat(F.lit("Use [blank] with "), F.col("ref_text"), F.lit(" done.")).alias("template"))


# ---------------------------------------------------------------------------
# The same views as SQL text for the DuckDB oracle (FIXTURES.md section 2).
# ---------------------------------------------------------------------------
SQL_VIEWS = {
    "cases_v": "SELECT item_id AS case_id, CASE item_id % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'java' WHEN 3 THEN 'go' ELSE 'r' END AS lang, CASE item_id % 4 WHEN 0 THEN 'code completion' WHEN 1 THEN 'code debugging' WHEN 2 THEN 'knowledge question-answering' ELSE 'non-code debugging' END AS qtype, CAST(1.0 AS DOUBLE) AS full_score, text AS ref_text FROM benchmark",
    "responses_v": "SELECT doc_id, doc_id % (SELECT count(*) FROM benchmark) AS case_id, row_number() OVER (PARTITION BY doc_id % (SELECT count(*) FROM benchmark) ORDER BY doc_id) - 1 AS sample_no, source AS model, text FROM documents",
    "keyword_rules_v": "SELECT c.case_id, r.rule_no, split_part(c.ref_text, ' ', r.rule_no + 1) AS pattern, 1 + r.rule_no % 2 AS weight, r.rule_no = 3 AS neg, r.rule_no IN (1, 3) AS to_lower, r.rule_no = 2 AS cond_prev_match FROM cases_v c CROSS JOIN (VALUES (0), (1), (2), (3)) r(rule_no)",
    "outcomes_v": "SELECT r.case_id, r.sample_no, 0 AS test_no, 1 - l.quality AS return_code, l.toxic = 1 AS timed_out FROM responses_v r JOIN labels l ON l.doc_id = r.doc_id",
    "turns_v": "SELECT conv_id, turn, prompt, CASE WHEN length(text) % 5 = 0 THEN NULL ELSE text END AS completion FROM (SELECT conv_id, turn, role, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prompt FROM conversations) t WHERE role = 'assistant'",
    "fenced_v": "SELECT doc_id, case_id, sample_no, concat('intro', chr(10), repeat(chr(96),3), 'py', chr(10), left(text, length(text) // 2), chr(10), repeat(chr(96),3), chr(10), 'mid', chr(10), repeat(chr(96),3), chr(10), substr(text, length(text) // 2 + 1), chr(10), 'x = ', doc_id % 7, chr(10), repeat(chr(96),3), CASE WHEN doc_id % 3 = 0 THEN concat(chr(10), repeat(chr(96),3), chr(10), 'odd tail') ELSE '' END) AS txt FROM responses_v",
    "braced_v": "SELECT doc_id, case_id, sample_no, concat('if (a) { ', text, ' }', CASE WHEN doc_id % 2 = 0 THEN ' } rest { x }' ELSE ' tail' END) AS txt FROM responses_v",
    "blank_v": "SELECT r.doc_id, concat('Use [blank] with ', c.ref_text, ' done.') AS template, concat('Use ', chr(34), split_part(c.ref_text,' ',2), chr(34), ' with ', c.ref_text, ' done.', CASE WHEN r.doc_id % 2 = 1 THEN r.model ELSE '' END) AS response FROM responses_v r JOIN cases_v c ON c.case_id = r.case_id",
}

_DEPENDS = {
    "keyword_rules_v": ["cases_v"],
    "outcomes_v": ["responses_v"],
    "fenced_v": ["responses_v"],
    "braced_v": ["responses_v"],
    "blank_v": ["responses_v", "cases_v"],
}


def with_views(*names: str, extra: dict | None = None) -> str:
    """``WITH`` prefix holding the named views and their dependencies,
    plus ``extra`` (name -> SQL) CTEs appended in order."""
    order: list[str] = []

    def add(n):
        for dep in _DEPENDS.get(n, []):
            add(dep)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [f"{n} AS ({SQL_VIEWS[n]})" for n in order]
    for n, q in (extra or {}).items():
        parts.append(f"{n} AS ({q})")
    return "WITH " + ",\n".join(parts) + "\n" if parts else ""
