"""Catalogue: ROUGE similarity and its normalised score."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradewise.operators import rouge as rg
from gradewise.plans.registry import query, rnd
from gradewise.sources import fixtures as fx


def _refs(spark, sf, multi=False):
    c = fx.cases_v(spark, sf)
    own = c.select("case_id", F.lit(0).alias("ref_no"), F.col("ref_text").alias("text"))
    if not multi:
        return own
    n = fx.n_cases(spark, sf)
    # Second reference of case c: the text of case (c + 1) mod N.
    nxt = c.select(((F.col("case_id") + n - 1) % n).alias("case_id"), F.lit(1).alias("ref_no"),
                   F.col("ref_text").alias("text"))
    return own.unionByName(nxt)


def _resp(spark, sf):
    return fx.responses_base(spark, sf).select("doc_id", "case_id", "text")


def _out(d):
    return d.select("doc_id", "case_id", rnd("precision").alias("precision"),
                    rnd("recall").alias("recall"), rnd("f1").alias("f1"))


_TOK = "list_filter(string_split(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')"
_BIGRAMS = "list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1])"


def _rouge_n_ctes(n, refs_sql="SELECT case_id, 0 AS ref_no, ref_text AS text FROM cases_v", sfx=""):
    grams = (lambda t: t) if n == 1 else (lambda t: _BIGRAMS.format(t=t))
    x = sfx
    return {
        f"refs{x}": refs_sql,
        f"rt{x}": f"SELECT doc_id, case_id, {_TOK.format(c='text')} AS t FROM responses_v",
        f"ct{x}": f"SELECT case_id, ref_no, {_TOK.format(c='text')} AS t FROM refs{x}",
        f"rg0{x}": f"SELECT doc_id, case_id, {grams('t')} AS g FROM rt{x}",
        f"cg0{x}": f"SELECT case_id, ref_no, {grams('t')} AS g FROM ct{x}",
        f"rgc{x}": f"SELECT doc_id, case_id, gram, count(*) AS c FROM (SELECT doc_id, case_id, unnest(g) AS gram FROM rg0{x}) GROUP BY ALL",
        f"cgc{x}": f"SELECT case_id, ref_no, gram, count(*) AS c FROM (SELECT case_id, ref_no, unnest(g) AS gram FROM cg0{x}) GROUP BY ALL",
        f"ov{x}": f"SELECT a.doc_id, b.ref_no, sum(least(a.c, b.c)) AS hits FROM rgc{x} a JOIN cgc{x} b ON b.case_id = a.case_id AND b.gram = a.gram GROUP BY ALL",
        f"pr{x}": f"SELECT r.doc_id, r.case_id, c.ref_no, coalesce(o.hits, 0) / greatest(len(r.g), 1) AS p, coalesce(o.hits, 0) / greatest(len(c.g), 1) AS r FROM rg0{x} r JOIN cg0{x} c ON c.case_id = r.case_id LEFT JOIN ov{x} o ON o.doc_id = r.doc_id AND o.ref_no = c.ref_no",
        f"sc{x}": f"SELECT doc_id, case_id, ref_no, p, r, CASE WHEN p + r > 0 THEN 2.0 * p * r / (p + r) ELSE 0.0 END AS f FROM pr{x}",
    }


def _rouge_n_sql(n, refs_sql="SELECT case_id, 0 AS ref_no, ref_text AS text FROM cases_v", final=None):
    body = fx.with_views("responses_v", "cases_v", extra=_rouge_n_ctes(n, refs_sql))
    return body + (final or "SELECT doc_id, case_id, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1 FROM sc")


@query("rouge1", _rouge_n_sql(1))
def rouge1(spark, sf):
    return _out(rg.rouge_n(_resp(spark, sf), _refs(spark, sf), 1))


@query("rouge2", _rouge_n_sql(2))
def rouge2(spark, sf):
    return _out(rg.rouge_n(_resp(spark, sf), _refs(spark, sf), 2))


_MULTI_REFS = ("SELECT case_id, 0 AS ref_no, ref_text AS text FROM cases_v UNION ALL "
               "SELECT (case_id + (SELECT count(*) FROM cases_v) - 1) % (SELECT count(*) FROM cases_v) AS case_id, "
               "1 AS ref_no, ref_text AS text FROM cases_v")


@query("rouge_multi_ref", _rouge_n_sql(1, _MULTI_REFS,
       "SELECT doc_id, case_id, round(max(f), 6) AS f1, CAST(count(*) AS BIGINT) AS n_refs FROM sc GROUP BY doc_id, case_id"))
def rouge_multi_ref(spark, sf):
    b = rg.best_scores(_resp(spark, sf), _refs(spark, sf, multi=True), ("rouge1",))
    return b.select("doc_id", "case_id", rnd("f1").alias("f1"), "n_refs")


# Similarity rules of the fixture, the same for every case (fixed values):
# rouge1 scaled on [0.0, 0.1] with weight 1; rouge2 with the default
# bounds and weight 2.
_SIM_RULES = [(0, "rouge1", 0.0, 0.1, 1.0), (1, "rouge2", None, None, 2.0)]

_SIM_SQL = fx.with_views("responses_v", "cases_v", extra={
    **_rouge_n_ctes(1, sfx="_1"), **_rouge_n_ctes(2, sfx="_2")}) + (
    "SELECT a.doc_id, a.case_id, round(1.0 * greatest(least((a.f - 0.0) / (0.1 - 0.0), 1.0), 0.0) "
    "+ 2.0 * greatest(least((b.f - 0.30) / (0.51 - 0.30), 1.0), 0.0), 6) AS score, round(CAST(3.0 AS DOUBLE), 6) AS tot "
    "FROM sc_1 a JOIN sc_2 b ON b.doc_id = a.doc_id")


@query("rouge_normalised_score", _SIM_SQL)
def rouge_normalised_score(spark, sf):
    resp, refs = _resp(spark, sf), _refs(spark, sf)
    best = rg.best_scores(resp, refs, ("rouge1", "rouge2"))
    rule_structs = [F.struct(F.lit(r).alias("rule_no"), F.lit(m).alias("metric"),
                             F.lit(lo).cast("double").alias("min_score"),
                             F.lit(hi).cast("double").alias("max_score"),
                             F.lit(w).cast("double").alias("weight"))
                    for r, m, lo, hi, w in _SIM_RULES]
    rules = fx.cases_v(spark, sf).select("case_id", F.explode(F.array(*rule_structs)).alias("r")) \
        .select("case_id", "r.*")
    s = rg.similarity_scores(best, rules)
    return s.select("doc_id", "case_id", rnd("score").alias("score"), rnd("tot").alias("tot"))


_LCS_CTES = {
    "toks": f"SELECT r.doc_id, r.case_id, {_TOK.format(c='r.text')} AS p, {_TOK.format(c='c.ref_text')} AS q FROM responses_v r JOIN cases_v c ON c.case_id = r.case_id",
    "flt": "SELECT doc_id, case_id, list_filter(p, lambda x: list_contains(q, x)) AS fp, q, len(p) AS np, len(q) AS nq FROM toks",
    "dp": ("SELECT doc_id, 0 AS i, list_transform(range(0, nq + 1), lambda j: 0) AS row_ FROM flt UNION ALL "
           "SELECT d.doc_id, d.i + 1, list_reduce(list_transform(range(1, f.nq + 1), lambda k: CASE WHEN f.q[k] = f.fp[d.i + 1] "
           "THEN d.row_[k] + 1 ELSE d.row_[k + 1] END), lambda acc, x: list_append(acc, greatest(acc[-1], x)), [0]) "
           "FROM dp d JOIN flt f ON f.doc_id = d.doc_id WHERE d.i < len(f.fp)"),
    "lc": "SELECT f.doc_id, f.case_id, f.np, f.nq, d.row_[f.nq + 1] AS lcs FROM flt f JOIN dp d ON d.doc_id = f.doc_id AND d.i = len(f.fp)",
    "pr": "SELECT doc_id, case_id, np, nq, CASE WHEN np = 0 OR nq = 0 THEN 0.0 ELSE lcs / np END AS p, CASE WHEN np = 0 OR nq = 0 THEN 0.0 ELSE lcs / nq END AS r FROM lc",
}
_ROUGE_L_SQL = fx.with_views("responses_v", "cases_v", extra=_LCS_CTES).replace("WITH ", "WITH RECURSIVE ", 1) + (
    "SELECT doc_id, case_id, round(p, 6) AS precision, round(r, 6) AS recall, "
    "round(CASE WHEN p + r > 0 THEN 2.0 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM pr")


@query("rougeL", _ROUGE_L_SQL)
def rouge_l(spark, sf):
    return _out(rg.rouge_l(_resp(spark, sf), _refs(spark, sf)))


@query("rougeLsum")
def rouge_lsum(spark, sf):
    return _out(rg.rouge_lsum(_resp(spark, sf), _refs(spark, sf)))
