"""Report roll-ups: totals, per language, per question type, per metric.

Every roll-up is "per bucket, sum over cases; then mean and sample std over
buckets". One GROUPING SETS aggregate produces the per-bucket sums of all
sections in a single pass over the bucket table; the second level works on
(model, section, key, bucket) rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


SECTION_ORDER = {"total": 0, "lang": 1, "type": 2, "metric": 3}
SECTION_LABEL = {"total": "Overall Score", "lang": "Lang: ", "type": "Type: ", "metric": "Metric: "}


def _mean_std(per_bucket: DataFrame, keys) -> DataFrame:
    return per_bucket.groupBy(*keys).agg(
        F.avg("bucket_total").alias("mean"),
        F.coalesce(F.stddev_samp("bucket_total"), F.lit(0.0)).alias("std"),
        F.count(F.lit(1)).alias("n_buckets"))


# Key of cases whose language or type is not given.
UNKNOWN = "unknown"


def by_attribute(bucket_best: DataFrame, case_scores: DataFrame, cases: DataFrame,
                 attr: str) -> DataFrame:
    """Mean/std over buckets of the per-bucket sum, full score and frequency
    per (model, attr); a case without the attribute counts as ``unknown``."""
    attrs = cases.select("case_id", F.coalesce(attr, F.lit(UNKNOWN)).alias(attr), "full_score")
    b = bucket_best.join(attrs, "case_id")
    per_bucket = b.groupBy("model", attr, "bucket").agg(F.sum("best").alias("bucket_total"))
    stats = _mean_std(per_bucket, ["model", attr])
    fulls = case_scores.join(attrs, "case_id").groupBy("model", attr).agg(
        F.sum("full_score").alias("full_total"), F.count(F.lit(1)).alias("freq"))
    return stats.join(fulls, ["model", attr])


def rollup(bucket_best: DataFrame, case_scores: DataFrame, cases: DataFrame) -> DataFrame:
    """Total, per-language and per-type sections in one GROUPING SETS pass.

    Output: model, dimension ('total'|'lang'|'type'), key, mean, std, full, freq, and
    where ``cases`` has ``case_no`` also ``first_case``, the first of the key's cases in
    the suite. Cases without a language or type have the key ``unknown`` there."""
    numbered = ["case_no"] if "case_no" in cases.columns else []
    attrs = cases.select("case_id", F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"),
                         F.coalesce("qtype", F.lit(UNKNOWN)).alias("qtype"), "full_score", *numbered)

    def label(df):
        dim = (F.when(F.grouping("lang") == 0, F.lit("lang"))
                .when(F.grouping("qtype") == 0, F.lit("type"))
                .otherwise(F.lit("total")))
        key = F.coalesce(F.col("lang"), F.col("qtype"), F.lit("Overall"))
        return dim, key

    b = bucket_best.join(attrs, "case_id")
    pb = b.groupingSets([["model", "bucket"], ["model", "bucket", "lang"],
                         ["model", "bucket", "qtype"]],
                        "model", "bucket", "lang", "qtype")
    dim, key = label(pb)
    per_bucket = pb.agg(F.sum("best").alias("bucket_total"), dim.alias("dimension"),
                        key.alias("key"))
    stats = _mean_std(per_bucket, ["model", "dimension", "key"])

    c = case_scores.join(attrs, "case_id")
    fc = c.groupingSets([["model"], ["model", "lang"], ["model", "qtype"]],
                        "model", "lang", "qtype")
    dim2, key2 = label(fc)
    fulls = fc.agg(F.sum("full_score").alias("full_total"), F.count(F.lit(1)).alias("freq"),
                   *[F.min("case_no").alias("first_case") for _ in numbered], dim2.alias("dimension"), key2.alias("key"))
    return stats.join(fulls, ["model", "dimension", "key"])


def ratios(report: DataFrame) -> DataFrame:
    """Score and std as a share of the full score; allocation = full score
    of the row over the model's total full score."""
    w = Window.partitionBy("model")
    total_full = F.max(F.when(F.col("dimension") == "total", F.col("full_total"))).over(w)
    return report.select(
        "*", F.try_divide(F.col("mean"), F.col("full_total")).alias("mean_ratio"),
        F.try_divide(F.col("std"), F.col("full_total")).alias("std_ratio"),
        F.try_divide(F.col("full_total"), total_full).alias("allocation"))


def section_order(dimension) -> Column:
    order = F.lit(len(SECTION_ORDER))
    for name, place in SECTION_ORDER.items():
        order = F.when(dimension == name, place).otherwise(order)
    return order


def in_order(report: DataFrame) -> DataFrame:
    """The report with ``place``: its order within a model, sections as in
    SECTION_ORDER, then full score descending, ties by first appearance in the suite."""
    w = Window.partitionBy("model").orderBy(section_order(F.col("dimension")), F.desc("full_total"), "first_case", "key")
    return report.withColumn("place", F.row_number().over(w))


# Models that a side-by-side report takes as columns at most.
MAX_MODELS = 1000


def model_names(report: DataFrame) -> list[str]:
    """The models of a report by name; more than MAX_MODELS are an error."""
    names = [r.model for r in report.select("model").distinct().orderBy("model").limit(MAX_MODELS + 1).collect()]
    if len(names) > MAX_MODELS:
        raise ValueError(f"over {MAX_MODELS} models: name those to set side by side")
    return names


def pivot_models(report: DataFrame, models=None, value: str = "mean") -> DataFrame:
    """Side-by-side columns, one per model of the given list, or of all models."""
    models = model_names(report) if models is None else list(models)
    return (report.where(F.col("model").isin(models))
            .groupBy("dimension", "key").pivot("model", models).agg(F.max(value)))


def best_sample(sample_scores: DataFrame, k: int, score: str = "score",
                keys=("model", "case_id"), negatives: bool = False) -> DataFrame:
    """Best sample per bucket by raw score; the last sample wins ties and
    negative scores never win (the best starts at 0), unless ``negatives``:
    then every bucket has its true maximum."""
    b = F.floor(F.col("sample_no") / F.lit(k)).cast("long")
    best = F.max(F.struct(F.col(score).alias("s"), F.col("sample_no").alias("n")))
    return (sample_scores.where(F.lit(True) if negatives else F.col(score) >= 0)
            .groupBy(*keys, b.alias("bucket")).agg(best.alias("b"))
            .select(*keys, "bucket", F.col("b.n").alias("best_sample_no"),
                    F.col("b.s").alias("best_score")))


def to_text(rows, models, csv: bool = False) -> str:
    """Render collected report rows (a few dozen) as the text or CSV table.

    ``rows``: dicts with dimension, key, full, allocation and per-model
    ``mean``/``std`` (keys ``<model>_mean`` ...)."""
    header = [""]
    for m in models:
        header += [m, "", "", ""]
    header += ["Full Score", "Allocation"]
    table = [header]
    for r in rows:
        name = SECTION_LABEL[r["dimension"]] + ("" if r["dimension"] == "total" else r["key"])
        line = [name]
        for m in models:
            mean, std = r.get(f"{m}_mean", r.get("mean")), r.get(f"{m}_std", r.get("std"))
            line += [f"{mean:.2f}", f"±{std:.2f}", f"{100 * mean / r['full_total']:.2f}%",
                     f"±{100 * std / r['full_total']:.2f}%"]
        line += [f"{r['full_total']:.2f}",
                 "" if r["dimension"] == "total" else f"{100 * r['allocation']:.2f}%"]
        table.append(line)
    if csv:
        return "\n".join(",".join(x) for x in table) + "\n"
    widths = [max(len(row[j]) for row in table) for j in range(len(header))]
    out = []
    for row in table:
        cells = [" " + row[j].ljust(widths[j] + 1) for j in range(len(row))]
        out.append("|".join(cells))
    rule = "-" * len(out[0])
    return "\n".join([rule, out[0], rule] + out[1:] + [rule])


def by_metric(metric_scores: DataFrame, cases: DataFrame, k: int, negatives: bool = True) -> DataFrame:
    """Per-metric section: for every bucket the best sample by raw total
    (its true maximum, last wins ties; without ``negatives``, as once, a case whose
    last bucket has only negative totals drops out) contributes its metric scores,
    rescaled by full_score / case total, where the case total is the metric
    total of the best sample of the case's last bucket (or max_score). The
    metric's full score is that last best sample's metric total, rescaled;
    it is not capped by max_score.

    metric_scores: model, case_id, sample_no, metric, score, tot.
    cases: case_id, full_score, max_score (nullable).
    Output: model, metric, mean, std, n_buckets, full_total, freq."""
    keys = ["model", "case_id"]
    raw = metric_scores.groupBy(*keys, "sample_no").agg(F.sum("score").alias("raw"))
    best = best_sample(raw, k, "raw", keys, negatives)
    last = raw.groupBy(*keys).agg(F.max(F.floor(F.col("sample_no") / F.lit(k)).cast("long")).alias("last_bucket"))
    bm = metric_scores.join(best.withColumnRenamed("best_sample_no", "sample_no"), keys + ["sample_no"])
    c = cases.select("case_id", "full_score", "max_score")
    lastbest = bm.join(last, keys).where(F.col("bucket") == F.col("last_bucket"))
    tot_case = lastbest.groupBy(*keys).agg(F.sum("tot").alias("tc")).join(c, "case_id").select(
        *keys, F.try_divide(F.col("full_score"), F.coalesce("max_score", "tc")).alias("factor"))
    bm = bm.join(tot_case, keys)
    per_bucket = bm.groupBy("model", "metric", "bucket").agg(
        F.sum(F.col("score") * F.col("factor")).alias("bucket_total"))
    stats = _mean_std(per_bucket, ["model", "metric"])
    fulls = lastbest.join(tot_case, keys).groupBy("model", "metric").agg(
        F.sum(F.col("tot") * F.col("factor")).alias("full_total"), F.count(F.lit(1)).alias("freq"))
    return stats.join(fulls, ["model", "metric"])
