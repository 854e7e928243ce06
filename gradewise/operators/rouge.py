"""ROUGE-1/2/N, ROUGE-L and ROUGE-Lsum between responses and references.

The references of a case are tokenised once, packed into one row (per reference
the distinct grams with their counts, the tokens and the sentences, all as 64-bit
hashes) and written as a table in the shared folder. The planner knows the size of
that table, so it builds the side of the references wherever that fits its broadcast
threshold; beyond it the join is a shuffle with AQE's skew handling. Every response
meets the references of its case in one row, whatever the number of metrics: no
grams are exploded and no text or token is shuffled or broadcast.

ROUGE-N counts clipped overlap natively. ROUGE-L and ROUGE-Lsum send the hashes to
sparse kernels (``functions.lcs``) in an Arrow UDF.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradewise.session import ship_package

from gradewise.functions import lcs as lcs_kernels
from gradewise.functions.text import let, rouge_tokens
from gradewise.sources.tables import stored

DEFAULT_TYPES = ("rouge1", "rouge2", "rougeL", "rougeLsum")


def gram_size(rouge_type: str) -> int | None:
    """n of ``rouge<n>``, None for the two LCS metrics; others are an error."""
    if rouge_type in ("rougeL", "rougeLsum"):
        return None
    if rouge_type.startswith("rouge") and rouge_type[5:].isdigit():
        return int(rouge_type[5:])
    raise ValueError(f"unknown rouge type {rouge_type}")


def hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda x: F.xxhash64(x))


def ngrams(hashed: Column, n: int) -> Column:
    """Hashes of the n-grams of a hashed token array; empty when shorter than n.

    Built by zipping the array with its shifted slices (``zip_with`` pads with
    nulls, so the tail is cut to ``size - n + 1``): a flat loop per row."""
    if n == 1:
        return hashed
    acc = hashed
    for k in range(1, n):
        acc = F.zip_with(acc, F.slice(hashed, k + 1, 1 << 30), lambda a, b: F.xxhash64(a, b))
    size = F.size(hashed)
    return F.when(size >= n, F.slice(acc, 1, size - (n - 1))).otherwise(F.array().cast("array<bigint>"))


def fmeasure(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))


def _prf(hits: Column, n_pred: Column, n_ref: Column) -> list[Column]:
    """f1, precision, recall; all 0 where one side is empty."""
    p = hits / F.greatest(n_pred, F.lit(1)).cast("double")
    r = hits / F.greatest(n_ref, F.lit(1)).cast("double")
    return [fmeasure(p, r).alias("f1"), p.alias("precision"), r.alias("recall")]


def gram_counts(grams: Column) -> Column:
    """struct(keys, counts, n) of a gram array, by runs of the sorted array."""
    def runs(s):
        first = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
        return let(first, lambda at: F.struct(
            F.transform(at, lambda i: F.get(s, i)).alias("keys"),
            F.zip_with(at, F.concat(F.slice(at, 2, 1 << 30), F.array(F.size(s))), lambda a, b: b - a).alias("counts"),
            F.size(s).alias("n")))
    return let(F.array_sort(grams), runs)


def clipped_overlap(grams: Column, ref: Column) -> Column:
    """sum over distinct grams of least(count in grams, count in ``ref``).

    Grams become their places among the reference's keys (the others drop
    out); in the sorted places a gram counts as long as its run is no longer
    than the reference's count."""
    places = F.array_sort(F.filter(F.transform(grams, lambda x: F.array_position(ref["keys"], x).cast("int")), lambda p: p > 0))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("run"), F.lit(0).alias("hits"))

    def step(acc, p):
        return let(F.when(p == acc["at"], acc["run"] + 1).otherwise(F.lit(1)), lambda run: F.struct(
            p.alias("at"), run.alias("run"),
            (acc["hits"] + F.when(run <= F.element_at(ref["counts"], p), 1).otherwise(0)).alias("hits")))
    return F.aggregate(places, start, step)["hits"]


def _sentences(text: Column, tokenizer) -> Column:
    """Hashed tokens of the non-empty lines."""
    lines = F.filter(F.split(text, "\n"), lambda s: F.length(s) > 0)
    return F.filter(F.transform(lines, lambda s: hashes(tokenizer(s))), lambda t: F.size(t) > 0)


def _hashed(table: DataFrame, keep: list[str], rouge_types, tokenizer) -> DataFrame:
    """``keep``, the hashed tokens ``t`` and, for rougeLsum, the sentences ``s``; a null text is empty."""
    text = F.coalesce("text", F.lit(""))
    cols = [hashes(tokenizer(text)).alias("t")]
    if "rougeLsum" in rouge_types:
        cols.append(_sentences(text, tokenizer).alias("s"))
    return table.select(*keep, *cols)


def pack_references(references: DataFrame, rouge_types=DEFAULT_TYPES, tokenizer=rouge_tokens) -> DataFrame:
    """One row per case: ``refs``, an array over its references (in order of
    ref_no) of what the metrics need. Written, so its size is known.

    references: case_id, ref_no, text."""
    ref = _hashed(references, ["case_id", "ref_no"], rouge_types, tokenizer)
    fields = ["ref_no"]
    for n in sorted({gram_size(t) for t in rouge_types} - {None}):
        ref = ref.withColumn(f"g{n}", gram_counts(ngrams(F.col("t"), n)))
        fields.append(f"g{n}")
    fields += [c for c, m in (("t", "rougeL"), ("s", "rougeLsum")) if m in rouge_types]
    return stored(ref.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("refs")), "references")


@functools.cache
def _udfs():
    """Arrow UDFs, created once a session exists."""
    ship_package(SparkSession.getActiveSession())
    return (F.pandas_udf(lcs_kernels.token_lcs_batch, "array<int>"),
            F.pandas_udf(lcs_kernels.union_lcs_batch, "array<int>"))


def _in_row(responses: DataFrame, references: DataFrame, rouge_types, tokenizer, key: str) -> DataFrame:
    """key, case_id and per metric a column of its name: an array over the
    references of the case of struct(f1, precision, recall, ref_no)."""
    packed = pack_references(references, rouge_types, tokenizer)
    sizes = sorted({gram_size(t) for t in rouge_types} - {None})
    resp = _hashed(responses, [key, "case_id"], rouge_types, tokenizer)
    resp = resp.select("*", *[ngrams(F.col("t"), n).alias(f"p{n}") for n in sizes if n > 1])
    j = resp.join(packed, "case_id")
    if "rougeL" in rouge_types:
        j = j.withColumn("__L", _udfs()[0](F.col("refs.t"), F.col("t")))
    if "rougeLsum" in rouge_types:
        j = j.withColumn("__Lsum", _udfs()[1](F.col("refs.s"), F.col("s")))

    def total(sentences):
        return F.aggregate(sentences, F.lit(0), lambda a, s: a + F.size(s))

    def scores(metric):
        n = gram_size(metric)

        def one(r, i):
            if n is not None:
                grams = F.col("t" if n == 1 else f"p{n}")
                hits, n_pred, n_ref = clipped_overlap(grams, r[f"g{n}"]), F.size(grams), r[f"g{n}"]["n"]
            elif metric == "rougeL":
                hits, n_pred, n_ref = F.get("__L", i), F.size("t"), F.size(r["t"])
            else:
                hits, n_pred, n_ref = F.get("__Lsum", i), total(F.col("s")), total(r["s"])
            return let(hits, lambda h: F.struct(*_prf(h, n_pred, n_ref), r["ref_no"].alias("ref_no")))
        return F.transform("refs", one).alias(metric)
    return j.select(key, "case_id", *[scores(m) for m in rouge_types])


def rouge(responses: DataFrame, references: DataFrame, rouge_types=DEFAULT_TYPES,
          tokenizer=rouge_tokens, key: str = "doc_id") -> DataFrame:
    """Long form (key, case_id, ref_no, metric, precision, recall, f1).

    responses: key, case_id, text. references: case_id, ref_no, text. All
    metrics come from one pass over the responses."""
    j = _in_row(responses, references, rouge_types, tokenizer, key)

    def named(metric):
        return F.transform(metric, lambda s: F.struct(
            s["ref_no"].alias("ref_no"), F.lit(metric).alias("metric"), s["precision"].alias("precision"),
            s["recall"].alias("recall"), s["f1"].alias("f1")))
    return j.select(key, "case_id", F.inline(F.flatten(F.array(*[named(m) for m in rouge_types]))))


def rouge_n(responses: DataFrame, references: DataFrame, n: int, tokenizer=rouge_tokens, key: str = "doc_id") -> DataFrame:
    """ROUGE-N of each response against each reference of its case: key,
    case_id, ref_no, precision, recall, f1."""
    return rouge(responses, references, (f"rouge{n}",), tokenizer, key).drop("metric")


def rouge_l(responses: DataFrame, references: DataFrame, tokenizer=rouge_tokens, key: str = "doc_id") -> DataFrame:
    """ROUGE-L (token LCS), columns as ``rouge_n``."""
    return rouge(responses, references, ("rougeL",), tokenizer, key).drop("metric")


def rouge_lsum(responses: DataFrame, references: DataFrame, tokenizer=rouge_tokens, key: str = "doc_id") -> DataFrame:
    """ROUGE-Lsum: newline-separated sentences, union LCS per reference
    sentence, hits clipped by token counts; columns as ``rouge_n``."""
    return rouge(responses, references, ("rougeLsum",), tokenizer, key).drop("metric")


def best_scores(responses: DataFrame, references: DataFrame, rouge_types=DEFAULT_TYPES,
                tokenizer=rouge_tokens, key: str = "doc_id") -> DataFrame:
    """``best_over_references`` of ``rouge``, taken in the row: key, case_id, metric,
    precision, recall, f1, n_refs."""
    j = _in_row(responses, references, rouge_types, tokenizer, key)

    def best(metric):
        return let(F.array_max(metric), lambda b: F.struct(
            F.lit(metric).alias("metric"), b["precision"].alias("precision"), b["recall"].alias("recall"), b["f1"].alias("f1"),
            F.size(metric).cast("long").alias("n_refs")))
    return j.select(key, "case_id", F.inline(F.array(*[best(m) for m in rouge_types])))


RULE_TYPES = DEFAULT_TYPES


def pack_rule_references(references: DataFrame, tokenizer=rouge_tokens) -> DataFrame:
    """references of similarity rules (case_id, rule_no, metric, ref_no, text) ->
    one row per case with ``refs``: in order of rule and reference, each with what
    its metric needs and null elsewhere; ``lost`` where there is no text."""
    t = _hashed(references, ["case_id", "rule_no", "metric", "ref_no", "text"], RULE_TYPES, tokenizer)
    for n in (1, 2):
        t = t.withColumn(f"g{n}", F.when(F.col("metric") == f"rouge{n}", gram_counts(ngrams(F.col("t"), n))))
    t = t.withColumn("s", F.when(F.col("metric") == "rougeLsum", F.col("s"))).withColumn(
        "t", F.when(F.col("metric") == "rougeL", F.col("t")))
    return t.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(
        "rule_no", "ref_no", "metric", F.col("text").isNull().alias("lost"), "g1", "g2", "t", "s"))).alias("refs"))


def rules_in_row(j: DataFrame, text: Column, tokenizer=rouge_tokens) -> DataFrame:
    """``j`` with ``sim``: struct(score, tot, error) of the similarity rules in
    ``sims`` (array of metric, bounds, weight) against the packed ``refs`` of a case;
    null where ``refs`` is null. The texts of other cases are not tokenised."""
    here = F.col("refs").isNotNull()
    j = j.withColumn("__t", F.when(here, hashes(tokenizer(text))))
    j = j.withColumn("__p2", F.when(here, ngrams(F.col("__t"), 2))).withColumn("__s", F.when(here, _sentences(text, tokenizer)))

    def of(metric, field):
        return F.transform("refs", lambda r: F.when(r["metric"] == metric, r[field]).otherwise(F.array()))
    j = j.withColumn("__L", _udfs()[0](of("rougeL", "t"), F.col("__t"))).withColumn(
        "__Lsum", _udfs()[1](of("rougeLsum", "s"), F.col("__s")))

    def total(sentences):
        return F.aggregate(sentences, F.lit(0), lambda a, s: a + F.size(s))

    def f1(r, i):
        def by(hits, n_pred, n_ref):
            return let(hits, lambda h: _prf(h, n_pred, n_ref)[0])
        value = (F.when(r["metric"] == "rouge1", by(clipped_overlap(F.col("__t"), r["g1"]), F.size("__t"), r["g1"]["n"]))
                 .when(r["metric"] == "rouge2", by(clipped_overlap(F.col("__p2"), r["g2"]), F.size("__p2"), r["g2"]["n"]))
                 .when(r["metric"] == "rougeL", by(F.get("__L", i), F.size("__t"), F.size(r["t"])))
                 .when(r["metric"] == "rougeLsum", by(F.get("__Lsum", i), total(F.col("__s")), total(r["s"]))))
        return F.struct(r["rule_no"].alias("rule_no"), value.alias("f1"))

    j = j.withColumn("__f", F.transform("refs", f1))

    def rule(sim, k):
        best = F.array_max(F.transform(F.filter("__f", lambda f: f["rule_no"] == k), lambda f: f["f1"]))
        low, high = default_bounds(sim["metric"])
        return F.struct((sim["weight"] * normalised(F.coalesce(best, F.lit(0.0)), F.coalesce(sim["min_score"], low),
                                                    F.coalesce(sim["max_score"], high))).alias("score"), sim["weight"].alias("tot"))

    def add(name):
        return F.aggregate("__r", F.lit(0.0), lambda a, x: a + x[name])
    unknown = F.filter("sims", lambda x: ~x["metric"].isin(*RULE_TYPES))
    error = (F.when(F.size(unknown) > 0, F.concat(F.lit("unknown metric: "), F.get(unknown, F.lit(0))["metric"]))
             .when(F.exists("refs", lambda r: r["lost"]), F.lit("reference text not found")))
    j = j.withColumn("__r", F.transform("sims", rule))
    return j.withColumn("sim", F.when(here, F.struct(add("score").alias("score"), add("tot").alias("tot"), error.alias("error")))) \
        .drop("__t", "__p2", "__s", "__L", "__Lsum", "__f", "__r")


def best_over_references(scores: DataFrame, key: str = "doc_id") -> DataFrame:
    """Multi-reference score: the reference with the highest F1 per metric."""
    best = F.max(F.struct("f1", "precision", "recall"))
    return scores.groupBy(key, "case_id", "metric").agg(best.alias("b")).select(
        key, "case_id", "metric", F.col("b.precision").alias("precision"),
        F.col("b.recall").alias("recall"), F.col("b.f1").alias("f1"))


def default_bounds(metric: Column):
    """Default normalisation bounds: min 0.30; max 0.53 for rouge1 else 0.51."""
    return F.lit(0.30), F.when(metric == "rouge1", F.lit(0.53)).otherwise(F.lit(0.51))


def normalised(raw: Column, min_score: Column, max_score: Column) -> Column:
    """clip((raw - min) / (max - min), 0, 1)."""
    return F.greatest(F.least((raw - min_score) / (max_score - min_score), F.lit(1.0)), F.lit(0.0))


def similarity_scores(best: DataFrame, rules: DataFrame, key: str = "doc_id") -> DataFrame:
    """Weighted normalised similarity per response.

    best: key, case_id, metric, f1 (after best_over_references).
    rules: case_id, rule_no, metric, min_score, max_score, weight (nullable)."""
    r = rules.select("case_id", "rule_no", "metric", "min_score", "max_score", "weight")
    j = best.join(r, ["case_id", "metric"])
    dmin, dmax = default_bounds(F.col("metric"))
    w = F.coalesce(F.col("weight").cast("double"), F.lit(1.0))
    norm = normalised(F.col("f1"), F.coalesce(F.col("min_score"), dmin),
                      F.coalesce(F.col("max_score"), dmax))
    return j.groupBy(key, "case_id").agg(F.sum(w * norm).alias("score"), F.sum(w).alias("tot"))


def corpus_scores(scores: DataFrame) -> DataFrame:
    """Aggregated form (``use_aggregator``): mean F1 per metric over all
    (prediction, reference-set) pairs; for a single pair it equals the pair's
    own score. Algebraic, so it is combined map-side."""
    return scores.groupBy("metric").agg(F.avg("f1").alias("f1"), F.count(F.lit(1)).alias("n_pairs"))
