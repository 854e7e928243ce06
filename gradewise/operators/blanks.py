"""Blank filling: align a response to a template with blanks, cut out what
stands in each blank, and match it against the target answers.

Plan: blank positions are found once per case on the (small) template
table; templates join the responses; the character alignment runs in an Arrow
UDF (one call per batch); fills, strip, gate and the ordered target fold are
native expressions.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradewise.session import ship_package

from gradewise.functions import lcs as kernels
from gradewise.functions.keywords import INVALID, cond_holds, cond_kind
from gradewise.functions.text import let, py_regex

DEFAULT_BLANK = "[blank]"
DEFAULT_ESCAPE = " '\"`"
RATE_GATE = 0.8


@functools.cache
def _align_udf():
    return F.arrow_udf(kernels.grader_alignment_batch, "matched int, spans array<int>")


def align(template: Column, response: Column) -> Column:
    """struct<matched int, spans array<int>> (see ``lcs.align_chars``)."""
    ship_package(SparkSession.getActiveSession())
    return _align_udf()(template, response)


def blank_positions(template: Column, blank: Column) -> Column:
    """Every 0-based offset where ``blank`` starts (overlaps included)."""
    chars = F.split(template, "", -1)
    hits = F.transform(chars, lambda c, i: F.when(
        F.substring(template, i + 1, F.length(blank)) == blank, i))
    return F.filter(hits, lambda x: x.isNotNull())


def prepare_templates(templates: DataFrame) -> DataFrame:
    """case_id, template, blank_str, escape, prefix -> + places, n_blank, denom."""
    cols = set(templates.columns)
    blank = F.coalesce(F.col("blank_str"), F.lit(DEFAULT_BLANK)) if "blank_str" in cols else F.lit(DEFAULT_BLANK)
    esc = F.coalesce(F.col("escape"), F.lit(DEFAULT_ESCAPE)) if "escape" in cols else F.lit(DEFAULT_ESCAPE)
    pre = F.coalesce(F.col("prefix"), F.lit("")) if "prefix" in cols else F.lit("")
    t = templates.select("case_id", "template", blank.alias("blank_str"), esc.alias("escape"), pre.alias("prefix"))
    t = t.withColumn("places", blank_positions(F.col("template"), F.col("blank_str")))
    return t.withColumn("n_blank", F.size("places")).withColumn(
        "denom", F.length("template") - F.col("n_blank") * F.length("blank_str"))


def fill_columns(j: DataFrame, text: Column) -> DataFrame:
    """``j`` (the columns of ``prepare_templates`` beside a response) with
    ``matched_len``, ``rate``, ``fills`` and ``end_blank``; null without a template.

    A blank that ends the template takes the rest of the response
    (``end_blank`` flags it)."""
    resp = F.concat(F.col("prefix"), text)
    j = j.withColumn("resp", F.when(F.col("template").isNull(), F.lit(None)).when(resp == "", F.lit(" ")).otherwise(resp))
    # One alignment per row (a column of its own; its fields are read many times).
    j = j.withColumn("al", align(F.col("template"), F.col("resp")))
    s = F.col("al.spans")
    n_t = F.length("template")
    lb = F.length("blank_str")

    def cut(bp):
        start = F.when(bp == 0, F.element_at(s, bp + 1)).otherwise(F.element_at(s, bp) + 1)
        end_idx = bp + lb
        end = F.when(end_idx < n_t, F.element_at(s, end_idx + 1)).otherwise(F.length("resp"))
        raw = F.substring(F.col("resp"), start + 1, F.greatest(end - start, F.lit(0)))
        return F.btrim(raw, F.col("escape"))

    return j.withColumns({
        "matched_len": F.col("al.matched"), "rate": F.try_divide(F.col("al.matched"), F.col("denom")),
        "fills": F.transform("places", cut), "end_blank": F.exists("places", lambda bp: bp + lb >= n_t)}).drop("al", "resp")


def fills(responses: DataFrame, templates: DataFrame, key: str = "doc_id",
          text_col: str = "response") -> DataFrame:
    """Per response: matched length, template-following rate and the
    stripped text standing in each blank (array, in blank order)."""
    j = responses.select(key, "case_id", text_col).join(prepare_templates(templates), "case_id")
    return fill_columns(j, F.col(text_col)).select(key, "case_id", "matched_len", "rate", "fills", "end_blank", "n_blank")


def prepared_alternatives(alternatives: Column) -> Column:
    return F.transform(alternatives, lambda a: F.struct(
        a["pattern"].alias("pattern"), F.coalesce(a["is_regex"], F.lit(False)).alias("is_regex"),
        cond_kind(a["cond"]).alias("cond")))


def pack_targets(targets: DataFrame) -> DataFrame:
    """targets: case_id, target_no, weight, to_lower, substr_match,
    alternatives array<struct<pattern, is_regex, cond>> -> one sorted array
    per case."""
    t = targets.select(
        "case_id", F.col("target_no").cast("int").alias("target_no"),
        F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("weight"),
        F.coalesce(F.col("to_lower"), F.lit(False)).alias("to_lower"),
        F.coalesce(F.col("substr_match"), F.lit(False)).alias("substr_match"),
        prepared_alternatives(F.col("alternatives")).alias("alts"))
    return t.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(
        "target_no", "weight", "to_lower", "substr_match", "alts"))).alias("targets"))


def _alt_match(a: Column, fill: Column, tg: Column, prev_matched: Column) -> Column:
    f = F.when(tg["to_lower"], F.lower(fill)).otherwise(fill)
    p = F.when(tg["to_lower"], F.lower(a["pattern"])).otherwise(a["pattern"])
    full = F.regexp_like(f, py_regex(F.concat(F.lit("^(?:"), p, F.lit(")\\z"))))
    search = F.regexp_like(f, py_regex(p))
    exact = F.when(a["is_regex"], full).otherwise(f == p)
    sub = F.when(a["is_regex"], search).otherwise(F.contains(f, p))
    ok = F.coalesce(cond_holds(a["cond"], prev_matched), F.lit(False))
    return F.when(tg["substr_match"], sub).otherwise(exact) & ok


def fold_targets(targets: Column, fills: Column, rate: Column, gate: float = RATE_GATE) -> Column:
    """Ordered evaluation of packed targets against the fills: struct(prev,
    score, tot, flags, details)."""
    pairs = F.arrays_zip(targets.alias("tg"), fills.alias("fill"))
    init = F.struct(F.lit(False).alias("prev"), F.lit(0.0).alias("score"), F.lit(0.0).alias("tot"),
                    F.array().cast("array<boolean>").alias("flags"),
                    F.array().cast("array<string>").alias("details"))
    gate_ok = rate >= F.lit(gate)

    def step(acc, x):
        tg, fill = x["tg"], x["fill"]
        # Position of the first alternative that matches (0: none), once.
        first = F.array_position(F.transform(tg["alts"], lambda a: _alt_match(a, fill, tg, acc["prev"])), True)

        def emit(pos):
            m = gate_ok & (pos > 0)
            ans = F.when(pos > 0, F.element_at(tg["alts"], F.greatest(pos, F.lit(1)).cast("int"))["pattern"]) \
                .otherwise(F.element_at(tg["alts"], -1)["pattern"])
            body = F.concat(F.lit("response string: "), fill, F.lit(", ans: "), ans)
            detail = (F.when(~gate_ok, F.concat(F.lit("unmatched: match rate too low - "), rate.cast("string")))
                       .when(m, F.concat(F.lit("matched: "), body))
                       .otherwise(F.concat(F.lit("unmatched: "), body)))
            return F.struct(m.alias("prev"),
                            (acc["score"] + F.when(m, tg["weight"]).otherwise(0.0)).alias("score"),
                            (acc["tot"] + tg["weight"]).alias("tot"),
                            F.array_append(acc["flags"], m).alias("flags"),
                            F.array_append(acc["details"], detail).alias("details"))

        return let(F.when(gate_ok, first).otherwise(F.lit(0).cast("long")), emit)
    return F.aggregate(pairs, init, step)


def target_error(targets: Column, n_blank: Column) -> Column:
    """Why a case's targets cannot be graded, or null."""
    return (F.when(n_blank != F.size(targets), F.lit("blanks and targets differ in number"))
            .when(F.exists(targets, lambda t: F.exists(t["alts"], lambda a: F.coalesce(a["cond"] == INVALID, F.lit(False)))),
                  F.lit("unsupported rule condition")))


def blank_scores(responses: DataFrame, templates: DataFrame, targets: DataFrame,
                 key: str = "doc_id", text_col: str = "response", gate: float = RATE_GATE) -> DataFrame:
    """Weighted blank score per response: key, case_id, score, tot, rate,
    matched flags, fills. A case whose blanks and targets differ in number, or
    that has an unknown condition, is an error: no score, total or flags."""
    fl = fills(responses, templates, key, text_col)
    j = fl.join(pack_targets(targets), "case_id")
    j = j.select(key, "case_id", "rate", "fills", "end_blank", target_error(F.col("targets"), F.col("n_blank")).alias("error"),
                 fold_targets(F.col("targets"), F.col("fills"), F.col("rate"), gate).alias("__r"))

    def sound(c):
        return F.when(F.col("error").isNull(), F.col(c))
    return j.select(key, "case_id", sound("__r.score").alias("score"), sound("__r.tot").alias("tot"), "rate",
                    sound("__r.flags").alias("matched"), sound("__r.details").alias("details"),
                    "fills", "end_blank", "error")


def fill_handler(fill: Column, main: str, sub_all, main_points: float = 2.0,
                 sub_points: float = 1.0, cap: float = 2.0):
    """Post-handler scoring one fill: points for a main pattern, points for
    all sub patterns together, capped; total = cap."""
    score = F.when(F.contains(fill, F.lit(main)), F.lit(main_points)).otherwise(0.0)
    sub = F.lit(True)
    for s in sub_all:
        sub = sub & F.contains(fill, F.lit(s))
    score = score + F.when(sub, F.lit(sub_points)).otherwise(0.0)
    return F.least(score, F.lit(cap)), F.lit(cap)
