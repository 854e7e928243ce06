"""Building blocks shared by catalogue queries (Spark side and SQL side)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradewise.operators import keywords as kw
from gradewise.operators import reduce as rd
from gradewise.sources import fixtures as fx

# Report bucket size (samples per best-of-k bucket).
K = 10


def rules(spark: SparkSession, sf: str) -> DataFrame:
    r = fx.keyword_rules_v(spark, sf)
    return r.select("case_id", "rule_no", "pattern", "weight", "neg", "to_lower",
                    F.when(F.col("cond_prev_match"), F.lit("prev_match")).alias("cond"))


def kw_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scored in the scan stage; only the narrow scores are numbered."""
    s = kw.keyword_scores(fx.responses_base(spark, sf), rules(spark, sf), keys=("doc_id", "model", "case_id"))
    return fx.numbered(s)


def case_params(spark: SparkSession, sf: str) -> DataFrame:
    c = fx.cases_v(spark, sf)
    return c.select("case_id", "lang", "qtype", "full_score",
                    F.when(F.col("case_id") % 3 == 0, F.lit(2.0)).alias("max_score"),
                    F.when(F.col("case_id") % 2 == 0, F.lit(0.5)).alias("min_score"))


def sample_now(spark: SparkSession, sf: str) -> DataFrame:
    s = kw_scores(spark, sf).select("model", "case_id", "sample_no",
                                    F.col("score").alias("ans"), "tot")
    return rd.clip_normalise(s, case_params(spark, sf))


def case_scores(spark: SparkSession, sf: str, mode: str = f"avg_max_{K}") -> DataFrame:
    return rd.reduce_samples(sample_now(spark, sf), mode)


# ----------------------------------------------------------------- SQL side
SQL = {
    "kw_raw": "SELECT r.model, r.case_id, r.sample_no, k.rule_no, CAST(k.weight AS DOUBLE) AS weight, k.neg, k.cond_prev_match, CASE WHEN k.to_lower THEN contains(lower(r.text), lower(k.pattern)) ELSE contains(r.text, k.pattern) END AS raw FROM responses_v r JOIN keyword_rules_v k ON k.case_id = r.case_id",
    "kw_eff": "SELECT *, CASE WHEN cond_prev_match THEN raw AND coalesce(lag(raw) OVER (PARTITION BY case_id, sample_no ORDER BY rule_no), false) ELSE raw END AS m FROM kw_raw",
    "kw_scores": "SELECT model, case_id, sample_no, sum(CASE WHEN m THEN (CASE WHEN neg THEN -weight ELSE weight END) ELSE 0.0 END) AS score, sum(CASE WHEN neg THEN 0.0 ELSE weight END) AS tot FROM kw_eff GROUP BY model, case_id, sample_no",
    "case_params": "SELECT case_id, lang, qtype, full_score, CASE WHEN case_id % 3 = 0 THEN CAST(2.0 AS DOUBLE) END AS max_score, CASE WHEN case_id % 2 = 0 THEN CAST(0.5 AS DOUBLE) END AS min_score FROM cases_v",
    "sample_clip": "SELECT s.model, s.case_id, s.sample_no, coalesce(p.max_score, s.tot) AS tot, CASE WHEN p.max_score IS NOT NULL THEN least(s.score, p.max_score) ELSE s.score END AS capped, p.min_score, p.full_score FROM kw_scores s JOIN case_params p ON p.case_id = s.case_id",
    "sample_now": "SELECT model, case_id, sample_no, tot, CASE WHEN min_score IS NOT NULL THEN greatest(capped, min_score) ELSE capped END AS ans, CASE WHEN min_score IS NOT NULL THEN greatest(capped, min_score) ELSE capped END / tot * full_score AS now, full_score FROM sample_clip",
    "bucket_best": f"SELECT model, case_id, CAST(floor(sample_no / {K}) AS BIGINT) AS bucket, max(now) AS best FROM sample_now GROUP BY ALL",
    "case_scores": "SELECT model, case_id, avg(best) AS now_score, coalesce(stddev_samp(best), 0) AS now_std, count(*) AS n_buckets FROM bucket_best GROUP BY ALL",
}
_SQL_ORDER = list(SQL)


def sql_with(*ctes: str, views=("responses_v", "keyword_rules_v", "cases_v"), extra=None) -> str:
    """WITH clause holding the fixture views, the named shared CTEs (plus
    the ones they depend on, in definition order) and ``extra``."""
    need = set()
    deps = {
        "kw_eff": ["kw_raw"], "kw_scores": ["kw_eff"], "sample_clip": ["kw_scores", "case_params"],
        "sample_now": ["sample_clip"], "bucket_best": ["sample_now"], "case_scores": ["bucket_best"],
    }

    def add(n):
        for d in deps.get(n, []):
            add(d)
        need.add(n)

    for c in ctes:
        add(c)
    chosen = {n: SQL[n] for n in _SQL_ORDER if n in need}
    chosen.update(extra or {})
    return fx.with_views(*views, extra=chosen)
