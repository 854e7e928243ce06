"""Catalogue: blank filling and custom hooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradewise.operators import blanks as bl
from gradewise.operators import hooks as hk
from gradewise.plans.registry import big, query, rnd
from gradewise.sources import fixtures as fx


def _targets(spark, sf, pattern, is_regex=False, to_lower=False, weight=1.0):
    c = fx.cases_v(spark, sf)
    alt = F.struct(pattern.alias("pattern"), F.lit(is_regex).alias("is_regex"),
                   F.lit(None).cast("string").alias("cond"))
    return c.select("case_id", F.lit(0).alias("target_no"), F.lit(weight).alias("weight"),
                    F.lit(to_lower).alias("to_lower"), F.lit(False).alias("substr_match"),
                    F.array(alt).alias("alternatives"))


def _w2(col="ref_text"):
    return F.split_part(F.col(col), F.lit(" "), F.lit(2))


def _scores(spark, sf, pattern, **kw):
    return bl.blank_scores(fx.blank_responses(spark, sf), fx.blank_templates(spark, sf),
                           _targets(spark, sf, pattern, **kw))


# Oracle: on this fixture the blank spans from after 'Use ' to ' with '.
_FILL = "trim(substr(b.response, 5, strpos(b.response, ' with ') - 5), ' ''\"`')"
_BASE = fx.with_views("blank_v", "cases_v", "responses_v", extra={
    "bf": f"SELECT b.doc_id, r.case_id, {_FILL} AS fill, split_part(c.ref_text, ' ', 2) AS w2 "
          "FROM blank_v b JOIN responses_v r ON r.doc_id = b.doc_id JOIN cases_v c ON c.case_id = r.case_id"})


@query("blank_align_lcs")
def blank_align_lcs(spark, sf):
    f = bl.fills(fx.blank_responses(spark, sf), fx.blank_templates(spark, sf))
    return f.select("doc_id", big("matched_len").alias("matched_len"), big("n_blank").alias("n_blank"))


@query("blank_align_text")
def blank_align_text(spark, sf):
    """Alignment against whole response texts. No SQL: a recursion over every
    pair of characters is far too slow on whole tables; tests/test_goldens.py
    holds it against the cell rules on a small table."""
    f = bl.fills(fx.blank_responses(spark, sf, whole_text=True), fx.blank_templates(spark, sf))
    return f.select("doc_id", big("matched_len").alias("matched_len"), F.element_at("fills", 1).alias("fill"))


@query("blank_rate_gate")
def blank_rate_gate(spark, sf):
    f = bl.fills(fx.blank_responses(spark, sf), fx.blank_templates(spark, sf))
    return f.select("doc_id", rnd("rate").alias("rate"), (F.col("rate") >= bl.RATE_GATE).alias("follows_template"))


@query("blank_match_exact", _BASE + "SELECT doc_id, fill, fill = w2 AS matched FROM bf")
def blank_match_exact(spark, sf):
    s = _scores(spark, sf, _w2())
    return s.select("doc_id", F.element_at("fills", 1).alias("fill"), F.element_at("matched", 1).alias("matched"))


_RX = "lower(substr(regexp_replace({w}, '[^A-Za-z]', '', 'g'), 1, 2)) || '[^\"]*'"


@query("blank_match_regex", _BASE + f"SELECT doc_id, regexp_full_match(lower(fill), {_RX.format(w='w2')}) AS matched FROM bf")
def blank_match_regex(spark, sf):
    rx = F.concat(F.lower(F.substring(F.regexp_replace(_w2(), "[^A-Za-z]", ""), 1, 2)), F.lit('[^"]*'))
    s = _scores(spark, sf, rx, is_regex=True, to_lower=True)
    return s.select("doc_id", F.element_at("matched", 1).alias("matched"))


@query("blank_score", _BASE + "SELECT doc_id, case_id, round(CAST(CASE WHEN fill = w2 THEN 2.0 ELSE 0.0 END AS DOUBLE), 6) AS score, "
       "round(CAST(2.0 AS DOUBLE), 6) AS tot FROM bf")
def blank_score(spark, sf):
    s = _scores(spark, sf, _w2(), weight=2.0)
    return s.select("doc_id", "case_id", rnd("score").alias("score"), rnd("tot").alias("tot"))


# Post-handler of the fixture (fixed values): +2 when the fill holds 'e',
# +1 when it holds both 'a' and 'n', capped at 2.
@query("fill_post_handler", _BASE + "SELECT doc_id, round(CAST(least(CASE WHEN contains(fill, 'e') THEN 2.0 ELSE 0.0 END + "
       "CASE WHEN contains(fill, 'a') AND contains(fill, 'n') THEN 1.0 ELSE 0.0 END, 2.0) AS DOUBLE), 6) AS score, round(CAST(2.0 AS DOUBLE), 6) AS tot FROM bf")
def fill_post_handler(spark, sf):
    f = bl.fills(fx.blank_responses(spark, sf), fx.blank_templates(spark, sf))
    score, tot = bl.fill_handler(F.element_at("fills", 1), "e", ["a", "n"])
    return f.select("doc_id", rnd(score).alias("score"), rnd(tot).alias("tot"))


# The same queries on whole response texts, every id; tests/test_goldens.py
# holds them against the cell rules on a small table.
def _text_fills(spark, sf):
    return bl.fills(fx.blank_texts(spark, sf), fx.blank_templates(spark, sf))


def _text_scores(spark, sf, pattern, **kw):
    return bl.blank_scores(fx.blank_texts(spark, sf), fx.blank_templates(spark, sf), _targets(spark, sf, pattern, **kw))


@query("blank_align_lcs_text")
def blank_align_lcs_text(spark, sf):
    f = _text_fills(spark, sf)
    return f.select("doc_id", big("matched_len").alias("matched_len"), big("n_blank").alias("n_blank"),
                    F.element_at("fills", 1).alias("fill"))


@query("blank_rate_gate_text")
def blank_rate_gate_text(spark, sf):
    f = _text_fills(spark, sf)
    return f.select("doc_id", rnd("rate").alias("rate"), (F.col("rate") >= bl.RATE_GATE).alias("follows_template"))


@query("blank_match_exact_text")
def blank_match_exact_text(spark, sf):
    s = _text_scores(spark, sf, _w2())
    return s.select("doc_id", F.element_at("fills", 1).alias("fill"), F.element_at("matched", 1).alias("matched"))


@query("blank_match_regex_text")
def blank_match_regex_text(spark, sf):
    rx = F.concat(F.lower(F.substring(F.regexp_replace(_w2(), "[^A-Za-z]", ""), 1, 2)), F.lit('[^"]*'))
    s = _text_scores(spark, sf, rx, is_regex=True, to_lower=True)
    return s.select("doc_id", F.element_at("matched", 1).alias("matched"))


@query("blank_score_text")
def blank_score_text(spark, sf):
    s = _text_scores(spark, sf, _w2(), weight=2.0)
    return s.select("doc_id", "case_id", rnd("score").alias("score"), rnd("tot").alias("tot"))


@query("fill_post_handler_text")
def fill_post_handler_text(spark, sf):
    score, tot = bl.fill_handler(F.element_at("fills", 1), "e", ["a", "n"])
    return _text_fills(spark, sf).select("doc_id", rnd(score).alias("score"), rnd(tot).alias("tot"))


@query("custom_order_handler", fx.with_views("responses_v") +
       "SELECT doc_id, CASE WHEN contains(text, 'th') AND contains(text, ', ') AND strpos(text, 'th') < strpos(text, ', ') "
       "THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS score, CAST(1.0 AS DOUBLE) AS tot, CASE WHEN NOT (contains(text, 'th') AND contains(text, ', ')) "
       "THEN 'keywords not found' WHEN strpos(text, 'th') < strpos(text, ', ') THEN 'good' "
       "ELSE 'all found but wrong placement' END AS detail FROM responses_v")
def custom_order_handler(spark, sf):
    r = fx.responses_base(spark, sf)
    h = hk.CUSTOM["order"](F.col("text"), "th", ", ")
    return r.select("doc_id", h["score"].alias("score"), h["tot"].alias("tot"), h["detail"].alias("detail"))
