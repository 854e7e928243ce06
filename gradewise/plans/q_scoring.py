"""Catalogue: keyword language, score assembly, reduction, report."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradewise.functions.keywords import compile_clause
from gradewise.operators import keywords as kw
from gradewise.operators import reduce as rd
from gradewise.operators import report as rp
from gradewise.operators.indexing import ordered_index
from gradewise.plans import common as cm
from gradewise.plans.registry import big, query, rnd
from gradewise.sources import fixtures as fx
from gradewise.sources.tables import table

RV = ("responses_v",)
KEYS = ("model", "case_id", "sample_no")
PIVOT_MODELS = ["src1", "src2", "src3"]


def _regex_of(word):
    """Fixture regex: a word starting with the first three ASCII letters."""
    letters = F.lower(F.substring(F.regexp_replace(word, "[^A-Za-z]", ""), 1, 3))
    return F.concat(F.lit("(^|[^a-z])"), letters, F.lit("[a-z]*"))


_SQL_REGEX = "'(^|[^a-z])' || lower(substr(regexp_replace({w}, '[^A-Za-z]', '', 'g'), 1, 3)) || '[a-z]*'"


@query("case_select", fx.with_views("responses_v", "cases_v") +
       "SELECT model, case_id, sample_no, CAST(length(text) AS BIGINT) AS n_chars FROM responses_v "
       "WHERE case_id IN (SELECT case_id FROM cases_v WHERE lang IN ('python', 'go'))")
def case_select(spark, sf):
    sel = fx.cases_v(spark, sf).where(F.col("lang").isin("python", "go")).select("case_id")
    r = fx.responses_base(spark, sf).join(sel, "case_id", "left_semi")
    return fx.numbered(r.select("doc_id", "model", "case_id", big(F.length("text")).alias("n_chars"))).select(*KEYS, "n_chars")


def _matches(spark, sf, **overrides):
    rules = cm.rules(spark, sf)
    for k, v in overrides.items():
        rules = rules.withColumn(k, v)
    m = kw.rule_flags(fx.responses_base(spark, sf), rules, keys=("doc_id", "model", "case_id"))
    return fx.numbered(m).select(*KEYS, F.explode("flags").alias("f")).select(
        *KEYS, big("f.rule_no").alias("rule_no"), "f.matched")


@query("kw_contains", fx.with_views("responses_v", "keyword_rules_v") +
       "SELECT r.model, r.case_id, r.sample_no, CAST(k.rule_no AS BIGINT) AS rule_no, "
       "contains(r.text, k.pattern) AS matched FROM responses_v r JOIN keyword_rules_v k ON k.case_id = r.case_id")
def kw_contains(spark, sf):
    return _matches(spark, sf, to_lower=F.lit(False))


@query("kw_contains_ci", fx.with_views("responses_v", "keyword_rules_v") +
       "SELECT r.model, r.case_id, r.sample_no, CAST(k.rule_no AS BIGINT) AS rule_no, "
       "contains(lower(r.text), lower(k.pattern)) AS matched FROM responses_v r JOIN keyword_rules_v k ON k.case_id = r.case_id")
def kw_contains_ci(spark, sf):
    return _matches(spark, sf, to_lower=F.lit(True))


@query("kw_regex", fx.with_views("responses_v", "keyword_rules_v") +
       "SELECT r.model, r.case_id, r.sample_no, CAST(k.rule_no AS BIGINT) AS rule_no, "
       f"regexp_matches(lower(r.text), {_SQL_REGEX.format(w='k.pattern')}) AS matched "
       "FROM responses_v r JOIN keyword_rules_v k ON k.case_id = r.case_id")
def kw_regex(spark, sf):
    return _matches(spark, sf, pattern=_regex_of(F.col("pattern")), is_regex=F.lit(True),
                    to_lower=F.lit(True))


@query("kw_clause_tree", fx.with_views("responses_v", "cases_v") +
       "SELECT r.model, r.case_id, r.sample_no, ((contains(r.text, split_part(c.ref_text, ' ', 1)) "
       "AND contains(r.text, split_part(c.ref_text, ' ', 2))) OR regexp_matches(r.text, "
       + _SQL_REGEX.format(w="split_part(c.ref_text, ' ', 3)") + ")) AS matched "
       "FROM responses_v r JOIN cases_v c ON c.case_id = r.case_id")
def kw_clause_tree(spark, sf):
    c = fx.cases_v(spark, sf)
    words = c.select("case_id", *[F.split_part("ref_text", F.lit(" "), F.lit(i + 1)).alias(f"w{i}")
                                  for i in range(3)])
    tree = {"or": [{"and": [F.col("w0"), F.col("w1")]},
                   {"content": _regex_of(F.col("w2")), "regex": True}]}
    r = fx.responses_base(spark, sf).join(words, "case_id")
    text = F.col("text")
    m = r.select("doc_id", "model", "case_id", compile_clause(tree, text, F.lower(text)).alias("matched"))
    return fx.numbered(m).select(*KEYS, "matched")


@query("kw_conditional", cm.sql_with("kw_eff") +
       "SELECT model, case_id, sample_no, CAST(rule_no AS BIGINT) AS rule_no, m AS matched FROM kw_eff")
def kw_conditional(spark, sf):
    s = cm.kw_scores(spark, sf)
    return s.select(*KEYS, F.posexplode("statuses").alias("rule_no", "st")).select(
        *KEYS, big("rule_no").alias("rule_no"), (F.col("st") == "match").alias("matched"))


@query("kw_negative", cm.sql_with("kw_eff") +
       "SELECT case_id, CAST(count(*) FILTER (WHERE m) AS BIGINT) AS n_neg_hits, "
       "CAST(count(*) AS BIGINT) AS n_samples, "
       "round(sum(CASE WHEN m THEN -weight ELSE 0.0 END), 6) AS penalty FROM kw_eff WHERE neg GROUP BY case_id")
def kw_negative(spark, sf):
    rules = cm.rules(spark, sf).where(F.col("neg"))
    m = kw.rule_matches(fx.responses_base(spark, sf), rules, keys=("doc_id", "model", "case_id"))
    return m.groupBy("case_id").agg(
        big(F.count_if("matched")).alias("n_neg_hits"), big(F.count(F.lit(1))).alias("n_samples"),
        rnd(F.sum(F.when(F.col("matched"), -F.col("weight")).otherwise(0.0))).alias("penalty"))


@query("kw_weighted_score", cm.sql_with("kw_scores") +
       "SELECT model, case_id, sample_no, round(score, 6) AS score, round(tot, 6) AS tot FROM kw_scores")
def kw_weighted_score(spark, sf):
    s = cm.kw_scores(spark, sf)
    return s.select(*KEYS, rnd("score").alias("score"), rnd("tot").alias("tot"))


@query("score_clip_normalise", cm.sql_with("sample_now") +
       "SELECT model, case_id, sample_no, round(ans, 6) AS ans, round(tot, 6) AS tot, round(now, 6) AS now FROM sample_now")
def score_clip_normalise(spark, sf):
    s = cm.sample_now(spark, sf)
    return s.select(*KEYS, rnd("ans").alias("ans"), rnd("tot").alias("tot"), rnd("now").alias("now"))


@query("reduce_avg_max_min", cm.sql_with("sample_now") +
       "SELECT model, case_id, round(avg(now), 6) AS avg_now, round(max(now), 6) AS max_now, "
       "round(min(now), 6) AS min_now, CAST(count(*) AS BIGINT) AS n_samples FROM sample_now GROUP BY model, case_id")
def reduce_avg_max_min(spark, sf):
    s = cm.sample_now(spark, sf)
    return s.groupBy("model", "case_id").agg(
        rnd(F.avg("now")).alias("avg_now"), rnd(F.max("now")).alias("max_now"), rnd(F.min("now")).alias("min_now"),
        big(F.count(F.lit(1))).alias("n_samples"))


@query("reduce_avg_max_k", cm.sql_with("case_scores") +
       "SELECT model, case_id, round(now_score, 6) AS now_score, round(now_std, 6) AS now_std, "
       "CAST(n_buckets AS BIGINT) AS n_buckets FROM case_scores")
def reduce_avg_max_k(spark, sf):
    c = cm.case_scores(spark, sf)
    return c.select("model", "case_id", rnd("now_score").alias("now_score"),
                    rnd("now_std").alias("now_std"), big("n_buckets").alias("n_buckets"))


@query("suite_totals", cm.sql_with("case_scores") +
       "SELECT model, round(sum(now_score) + 0.0 * ((SELECT count(*) FROM cases_v) - count(*)), 6) AS total_score, "
       "round((SELECT sum(full_score) FROM cases_v), 6) AS total_full, round(sum(now_std), 6) AS sum_of_case_std, "
       "CAST((SELECT count(*) FROM cases_v) AS BIGINT) AS n_cases, CAST(count(*) AS BIGINT) AS n_with_response "
       "FROM case_scores GROUP BY model")
def suite_totals(spark, sf):
    t = rd.suite_totals(cm.case_scores(spark, sf), fx.cases_v(spark, sf))
    return t.select("model", rnd("total_score").alias("total_score"), rnd("total_full").alias("total_full"),
                    rnd("sum_of_case_std").alias("sum_of_case_std"), big("n_cases").alias("n_cases"),
                    big("n_with_response").alias("n_with_response"))


@query("running_total", cm.sql_with("case_scores") +
       "SELECT s.model, s.case_id, round(sum(s.now_score) OVER w, 6) AS running_score, "
       "round(sum(c.full_score) OVER w, 6) AS running_full FROM case_scores s JOIN cases_v c ON c.case_id = s.case_id "
       "WINDOW w AS (PARTITION BY s.model ORDER BY s.case_id ROWS UNBOUNDED PRECEDING)")
def running_total(spark, sf):
    cs = cm.case_scores(spark, sf).join(
        fx.cases_v(spark, sf).select("case_id", "full_score"), "case_id")
    r = rd.running_totals(cs, "case_id")
    return r.select("model", "case_id", rnd("running_score").alias("running_score"),
                    rnd("running_full").alias("running_full"))


def _attr_sql(attr):
    return cm.sql_with("case_scores", extra={
        "pb": f"SELECT b.model, c.{attr}, b.bucket, sum(b.best) AS bucket_total FROM bucket_best b JOIN cases_v c ON c.case_id = b.case_id GROUP BY ALL",
        "st": f"SELECT model, {attr}, avg(bucket_total) AS mean, coalesce(stddev_samp(bucket_total), 0) AS std, count(*) AS n_buckets FROM pb GROUP BY ALL",
        "fu": f"SELECT s.model, c.{attr}, sum(c.full_score) AS full_total, count(*) AS freq FROM case_scores s JOIN cases_v c ON c.case_id = s.case_id GROUP BY ALL",
    }) + (f"SELECT st.model, st.{attr}, round(mean, 6) AS mean, round(std, 6) AS std, CAST(n_buckets AS BIGINT) AS n_buckets, "
          f"round(full_total, 6) AS full_total, CAST(freq AS BIGINT) AS freq FROM st JOIN fu ON fu.model = st.model AND fu.{attr} = st.{attr}")


def _attr_query(spark, sf, attr):
    s = cm.sample_now(spark, sf)
    bb = rd.bucket_best(s, cm.K)
    cs = rd.reduce_samples(s, f"avg_max_{cm.K}")
    r = rp.by_attribute(bb, cs, fx.cases_v(spark, sf), attr)
    return r.select("model", attr, rnd("mean").alias("mean"), rnd("std").alias("std"),
                    big("n_buckets").alias("n_buckets"), rnd("full_total").alias("full_total"), big("freq").alias("freq"))


@query("report_by_lang", _attr_sql("lang"))
def report_by_lang(spark, sf):
    return _attr_query(spark, sf, "lang")


@query("report_by_type", _attr_sql("qtype"))
def report_by_type(spark, sf):
    return _attr_query(spark, sf, "qtype")


_ROLLUP_CTES = {
    "bj": "SELECT b.model, b.bucket, c.lang, c.qtype, b.best FROM bucket_best b JOIN cases_v c ON c.case_id = b.case_id",
    "pb": "SELECT model, bucket, CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(qtype) = 0 THEN 'type' ELSE 'total' END AS dimension, coalesce(lang, qtype, 'Overall') AS key, sum(best) AS bucket_total FROM bj GROUP BY GROUPING SETS ((model, bucket), (model, bucket, lang), (model, bucket, qtype))",
    "st": "SELECT model, dimension, key, avg(bucket_total) AS mean, coalesce(stddev_samp(bucket_total), 0) AS std, count(*) AS n_buckets FROM pb GROUP BY ALL",
    "cj": "SELECT s.model, c.lang, c.qtype, c.full_score FROM case_scores s JOIN cases_v c ON c.case_id = s.case_id",
    "fu": "SELECT model, CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(qtype) = 0 THEN 'type' ELSE 'total' END AS dimension, coalesce(lang, qtype, 'Overall') AS key, sum(full_score) AS full_total, count(*) AS freq FROM cj GROUP BY GROUPING SETS ((model), (model, lang), (model, qtype))",
    "rep": "SELECT st.model, st.dimension, st.key, mean, std, n_buckets, full_total, freq FROM st JOIN fu ON fu.model = st.model AND fu.dimension = st.dimension AND fu.key = st.key",
}


def _rollup(spark, sf):
    s = cm.sample_now(spark, sf)
    bb = rd.bucket_best(s, cm.K)
    cs = rd.reduce_samples(s, f"avg_max_{cm.K}")
    return rp.rollup(bb, cs, fx.cases_v(spark, sf))


@query("report_rollup", cm.sql_with("case_scores", extra=_ROLLUP_CTES) +
       "SELECT model, dimension, key, round(mean, 6) AS mean, round(std, 6) AS std, CAST(n_buckets AS BIGINT) AS n_buckets, "
       "round(full_total, 6) AS full_total, CAST(freq AS BIGINT) AS freq FROM rep")
def report_rollup(spark, sf):
    r = _rollup(spark, sf)
    return r.select("model", "dimension", "key", rnd("mean").alias("mean"), rnd("std").alias("std"),
                    big("n_buckets").alias("n_buckets"), rnd("full_total").alias("full_total"), big("freq").alias("freq"))


@query("report_ratio_alloc", cm.sql_with("case_scores", extra=_ROLLUP_CTES) +
       "SELECT model, dimension, key, round(mean / full_total, 6) AS mean_ratio, round(std / full_total, 6) AS std_ratio, "
       "round(full_total / max(CASE WHEN dimension = 'total' THEN full_total END) OVER (PARTITION BY model), 6) AS allocation FROM rep")
def report_ratio_alloc(spark, sf):
    r = rp.ratios(_rollup(spark, sf))
    return r.select("model", "dimension", "key", rnd("mean_ratio").alias("mean_ratio"),
                    rnd("std_ratio").alias("std_ratio"), rnd("allocation").alias("allocation"))


@query("report_pivot_models", cm.sql_with("case_scores", extra=_ROLLUP_CTES) +
       "SELECT dimension, key, " + ", ".join(
           f"round(max(CASE WHEN model = '{m}' THEN mean END), 6) AS {m}" for m in PIVOT_MODELS) +
       " FROM rep WHERE model IN (" + ", ".join(f"'{m}'" for m in PIVOT_MODELS) + ") GROUP BY dimension, key")
def report_pivot_models(spark, sf):
    p = rp.pivot_models(_rollup(spark, sf), PIVOT_MODELS)
    return p.select("dimension", "key", *[rnd(m).alias(m) for m in PIVOT_MODELS])


@query("best_sample_last_tie", cm.sql_with("kw_scores") +
       f"SELECT model, case_id, bucket, sample_no AS best_sample_no, round(score, 6) AS best_score FROM ("
       f"SELECT *, CAST(floor(sample_no / {cm.K}) AS BIGINT) AS bucket, row_number() OVER (PARTITION BY model, case_id, "
       f"floor(sample_no / {cm.K}) ORDER BY score DESC, sample_no DESC) AS rn FROM kw_scores WHERE score >= 0) t WHERE rn = 1")
def best_sample_last_tie(spark, sf):
    b = rp.best_sample(cm.kw_scores(spark, sf), cm.K)
    return b.select("model", "case_id", "bucket", "best_sample_no", rnd("best_score").alias("best_score"))


@query("sample_index", fx.with_views("responses_v") +
       "SELECT doc_id, model, case_id, row_number() OVER (PARTITION BY model, case_id ORDER BY doc_id) - 1 AS model_sample_no FROM responses_v")
def sample_index(spark, sf):
    r = fx.responses_base(spark, sf, spread_rows=False).select("doc_id", "model", "case_id")
    return ordered_index(r, ["model", "case_id"], "doc_id", "model_sample_no").select(
        "doc_id", "model", "case_id", big("model_sample_no").alias("model_sample_no"))


def _metric_scores(spark, sf):
    """Long metric table of the fixture: keywords for every response, and
    unit_test (pass = quality 1 and not toxic) for labelled responses."""
    k = cm.kw_scores(spark, sf).select(*KEYS, F.lit("keywords").alias("metric"), "score", "tot")
    r = fx.sample_keys(spark, sf)
    lab = table(spark, sf, "labels")
    passed = (lab.quality == 1) & (lab.toxic == 0)
    u = r.join(lab, "doc_id").select(*KEYS, F.lit("unit_test").alias("metric"),
                                     F.when(passed, 1.0).otherwise(0.0).alias("score"), F.lit(1.0).alias("tot"))
    return k.unionByName(u)


_METRIC_CTES = {
    "ms": "SELECT model, case_id, sample_no, 'keywords' AS metric, score, tot FROM kw_scores UNION ALL "
          "SELECT r.model, r.case_id, r.sample_no, 'unit_test' AS metric, CASE WHEN l.quality = 1 AND l.toxic = 0 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END, CAST(1.0 AS DOUBLE) "
          "FROM responses_v r JOIN labels l ON l.doc_id = r.doc_id",
    "raw": "SELECT model, case_id, sample_no, sum(score) AS raw FROM ms GROUP BY ALL",
    "best": f"SELECT model, case_id, bucket, sample_no FROM (SELECT *, CAST(floor(sample_no / {cm.K}) AS BIGINT) AS bucket, "
            f"row_number() OVER (PARTITION BY model, case_id, floor(sample_no / {cm.K}) ORDER BY raw DESC, sample_no DESC) AS rn "
            "FROM raw WHERE raw >= 0) t WHERE rn = 1",
    "lastb": f"SELECT model, case_id, max(CAST(floor(sample_no / {cm.K}) AS BIGINT)) AS last_bucket FROM raw GROUP BY ALL",
    "bm": "SELECT m.*, b.bucket FROM ms m JOIN best b ON b.model = m.model AND b.case_id = m.case_id AND b.sample_no = m.sample_no",
    "lb": "SELECT bm.* FROM bm JOIN lastb l ON l.model = bm.model AND l.case_id = bm.case_id AND l.last_bucket = bm.bucket",
    "tc": "SELECT lb.model, lb.case_id, c.full_score / coalesce(c.max_score, sum(lb.tot)) AS factor FROM lb JOIN case_params c ON c.case_id = lb.case_id "
          "GROUP BY lb.model, lb.case_id, c.full_score, c.max_score",
    "pbm": "SELECT bm.model, bm.metric, bm.bucket, sum(bm.score * tc.factor) AS bucket_total FROM bm JOIN tc ON tc.model = bm.model AND tc.case_id = bm.case_id GROUP BY ALL",
    "stm": "SELECT model, metric, avg(bucket_total) AS mean, coalesce(stddev_samp(bucket_total), 0) AS std, count(*) AS n_buckets FROM pbm GROUP BY ALL",
    "fum": "SELECT lb.model, lb.metric, sum(lb.tot * tc.factor) AS full_total, count(*) AS freq FROM lb JOIN tc ON tc.model = lb.model AND tc.case_id = lb.case_id GROUP BY ALL",
}


@query("report_by_metric", cm.sql_with("kw_scores", "case_params", views=("responses_v", "keyword_rules_v", "cases_v"),
                                       extra=_METRIC_CTES) +
       "SELECT s.model, s.metric, round(mean, 6) AS mean, round(std, 6) AS std, CAST(n_buckets AS BIGINT) AS n_buckets, "
       "round(full_total, 6) AS full_total, CAST(freq AS BIGINT) AS freq FROM stm s JOIN fum f ON f.model = s.model AND f.metric = s.metric")
def report_by_metric(spark, sf):
    """Legacy form: negative totals never win. ``report_by_metric_max`` is the right one."""
    r = rp.by_metric(_metric_scores(spark, sf), cm.case_params(spark, sf), cm.K, negatives=False)
    return r.select("model", "metric", rnd("mean").alias("mean"), rnd("std").alias("std"),
                    big("n_buckets").alias("n_buckets"), rnd("full_total").alias("full_total"), big("freq").alias("freq"))


@query("report_by_metric_max", cm.sql_with("kw_scores", "case_params", views=("responses_v", "keyword_rules_v", "cases_v"), extra={
    **_METRIC_CTES,
    "best": f"SELECT model, case_id, CAST(floor(sample_no / {cm.K}) AS BIGINT) AS bucket, arg_max(sample_no, (raw, sample_no)) AS sample_no FROM raw GROUP BY ALL"}) +
       "SELECT s.model, s.metric, round(mean, 6) AS mean, round(std, 6) AS std, CAST(n_buckets AS BIGINT) AS n_buckets, "
       "round(full_total, 6) AS full_total, CAST(freq AS BIGINT) AS freq FROM stm s JOIN fum f ON f.model = s.model AND f.metric = s.metric")
def report_by_metric_max(spark, sf):
    """``report_by_metric`` with the true maximum of every bucket (T10)."""
    r = rp.by_metric(_metric_scores(spark, sf), cm.case_params(spark, sf), cm.K)
    return r.select("model", "metric", rnd("mean").alias("mean"), rnd("std").alias("std"),
                    big("n_buckets").alias("n_buckets"), rnd("full_total").alias("full_total"), big("freq").alias("freq"))


def _tree_nodes(spark, sf):
    """Node table of one rule per case: or(and(w0, w1), regex(w2)), weight 2,
    post-ordered (leaves 0, 1 -> and 2; regex leaf 3; root or 4)."""
    c = fx.cases_v(spark, sf)
    w = [F.split_part("ref_text", F.lit(" "), F.lit(i + 1)) for i in range(3)]

    def node(nid, parent, op, pat, regex):
        return F.struct(F.lit(nid).alias("node_id"), F.lit(parent).alias("parent_id"), F.lit(op).alias("op"),
                        pat.alias("pattern"), F.lit(regex).alias("is_regex"))

    nodes = F.array(node(0, 2, "leaf", w[0], False), node(1, 2, "leaf", w[1], False),
                    node(2, 4, "and", F.lit(None).cast("string"), False),
                    node(3, 4, "leaf", _regex_of(w[2]), True),
                    node(4, -1, "or", F.lit(None).cast("string"), False))
    return c.select(F.col("case_id"), F.explode(nodes).alias("n")).select(
        "case_id", F.lit(0).alias("rule_no"), "n.*", F.lit(None).cast("string").alias("cond"),
        F.lit(2.0).alias("weight"), F.lit(False).alias("to_lower"), F.lit(False).alias("neg"))


@query("kw_tree_fold", fx.with_views("responses_v", "cases_v") +
       "SELECT r.model, r.case_id, r.sample_no, CASE WHEN ((contains(r.text, split_part(c.ref_text, ' ', 1)) "
       "AND contains(r.text, split_part(c.ref_text, ' ', 2))) OR regexp_matches(r.text, "
       + _SQL_REGEX.format(w="split_part(c.ref_text, ' ', 3)") + ")) THEN CAST(2.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS score, "
       "CAST(2.0 AS DOUBLE) AS tot FROM responses_v r JOIN cases_v c ON c.case_id = r.case_id")
def kw_tree_fold(spark, sf):
    s = kw.keyword_tree_scores(fx.responses_base(spark, sf), _tree_nodes(spark, sf), keys=("doc_id", "model", "case_id"))
    return fx.numbered(s).select(*KEYS, "score", "tot")
