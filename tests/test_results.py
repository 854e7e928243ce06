"""Stored runs, arrival order over files, ordered completions, report order."""

import tempfile

import pytest
from pyspark.sql import functions as F

from gradewise.operators import indexing, outcomes as oc, reduce as rd, report as rp
from gradewise.plans import common as cm
from gradewise.sources import readers, results, writers

KEYS = ("model", "case_id", "sample_no")


def test_report_from_disk_equals_report_from_memory(spark, sf_small):
    d = tempfile.mkdtemp(prefix="gw-store-")
    scores = cm.kw_scores(spark, sf_small).select(*KEYS, F.lit("keywords").alias("metric"), "score", "tot")
    cases = cm.case_params(spark, sf_small)
    results.store_run(d, "one", scores.withColumn("score", F.lit(9.0)), cases)
    results.store_run(d, "two", scores, cases)
    results.store_run(d, "one", scores.where("model = 'src1'"), cases)  # replaces that model's folder only
    back = results.read_runs(spark, d, ["two"])
    mem = rd.clip_normalise(scores.withColumnsRenamed({"score": "ans"}), cases)
    want = rp.rollup(rd.bucket_best(mem, cm.K), rd.reduce_samples(mem, f"avg_max_{cm.K}"), cases)
    cols = ["model", "dimension", "key", "mean", "std", "full_total", "freq"]

    def rows(df, names):
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*names).collect())
    assert rows(results.stored_report(back, cm.K), cols) == rows(want, cols)
    names = ["model", "metric", "mean", "std", "full_total", "freq"]
    assert rows(results.stored_by_metric(back, cm.K), names) == rows(rp.by_metric(scores, cases, cm.K), names)
    one = results.read_runs(spark, d, ["two"], ["src1", "src2"])
    plan = one.metric_scores._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    assert "run#" in filters and "model#" in filters
    assert {r.model for r in one.metric_scores.select("model").distinct().collect()} == {"src1", "src2"}
    first = results.read_runs(spark, d, ["one"]).metric_scores
    assert first.where("score <> 9.0").select("model").distinct().collect()[0].model == "src1"


def test_cases_with_errors_stay_out_of_stored_reports(spark):
    d = tempfile.mkdtemp(prefix="gw-store2-")
    scores = spark.createDataFrame([("m", "a", 0, "k", 1.0, 2.0, None), ("m", "b", 0, "k", None, None, "bad"), ("m", "b", 1, "k", 1.0, 1.0, None)],
                                   "model string, case_id string, sample_no int, metric string, score double, tot double, error string")
    cases = spark.createDataFrame([("a", 1.0, "go", "t"), ("b", 1.0, "go", "t")], "case_id string, full_score double, lang string, qtype string")
    results.store_run(d, "r", scores, cases)
    r = results.stored_report(results.read_runs(spark, d, ["r"]), 10).where("dimension = 'total'").collect()
    assert [(x.mean, x.full_total, x.freq) for x in r] == [(0.5, 1.0, 1)]


def test_arrival_over_three_files_equals_one_file(spark, monkeypatch):
    rows = [(f"c{(i * 7) % 5 if i % 3 else 0}.yaml", f"text {i}, \"quoted\"\nand more " if i % 11 else None) for i in range(400)]

    def text(part):
        return "filename,completion\n" + "".join(f'{a},{"" if b is None else chr(34) + b.replace(chr(34), chr(34) * 2) + chr(34)}\n' for a, b in part)
    one, many = tempfile.mkdtemp(prefix="gw-one-"), tempfile.mkdtemp(prefix="gw-many-")
    open(f"{one}/all.csv", "w").write(text(rows))
    cuts = [0, 250, 260, 400]  # the largest first: files are dealt to tasks by size, not by name
    for k in range(3):
        open(f"{many}/part-{k}.csv", "w").write(text(rows[cuts[k]:cuts[k + 1]]))

    def numbered(path):
        return sorted(tuple(r) for r in readers.unpack_batch_csv(readers.read_batch_csv(spark, path)).collect())
    got = numbered(one)
    assert numbered(many) == got and len(got) == 400
    monkeypatch.setattr(indexing, "DEFAULT_BLOCK", 7)
    assert numbered(many) == got
    want, seen = [], {}
    for a, b in rows:
        want.append((a, seen.get(a, 0), b or "", b is None))
        seen[a] = seen.get(a, 0) + 1
    assert got == sorted(want)


def test_completions_in_order(spark):
    df = spark.createDataFrame([("hot", (i * 37) % 1000, i % 3 == 0) for i in range(1000)] + [("t", 5, True), ("t", 2000, False)],
                               "case_id string, sample_no int, passed boolean")
    rows = oc.completions_in_order(df, block=64).orderBy("case_id", "block").collect()
    hot = [x for r in rows if r.case_id == "hot" for x in r.completions]
    assert [x["id"] for x in hot] == list(range(1000)) and {(r.first_id, r.last_id) for r in rows if r.case_id == "t"} == {(5, 5), (2000, 2000)}
    assert all(x["passed"] == (((x["id"] * pow(37, -1, 1000)) % 1000) % 3 == 0) for x in hot) and max(len(r.completions) for r in rows) == 64


def test_report_order_and_models(spark):
    rep = spark.createDataFrame([("m", "lang", "go", 2.0, 7), ("m", "lang", "c", 2.0, 3), ("m", "lang", "r", 5.0, 9), ("m", "total", "Overall", 9.0, 0),
                                 ("m", "type", "x", 9.0, 1), ("n", "total", "Overall", 1.0, 0)],
                                "model string, dimension string, key string, full_total double, first_case int")
    got = [r.key for r in rp.in_order(rep).where("model = 'm'").orderBy("place").collect()]
    assert got == ["Overall", "r", "c", "go", "x"] and rp.model_names(rep) == ["m", "n"]
    wide = rp.pivot_models(rep.withColumn("mean", F.col("full_total")))
    assert wide.columns == ["dimension", "key", "m", "n"]
    text = writers.render_report(rep.withColumns({"mean": F.lit(1.0), "std": F.lit(0.0), "allocation": F.lit(1.0)}), ["m"])
    assert text.index("Lang: r") < text.index("Lang: c") < text.index("Lang: go")


def test_too_many_models_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(rp, "MAX_MODELS", 2)
    with pytest.raises(ValueError):
        rp.model_names(spark.createDataFrame([("a",), ("b",), ("c",)], "model string"))


def test_prompts_and_manifest_names(spark):
    from gradewise.operators import requests as rq
    c = spark.createDataFrame([(1, "q one"), (2, " \"q\"\ntwo ")], "idx int, q string")
    p = rq.prompt_table(c, F.col("idx") == 1, F.col("q"), end_newline=True)
    d = tempfile.mkdtemp(prefix="gw-prompt-")
    writers.write_prompts_csv(p, f"{d}/csv")
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{d}/csv").orderBy("idx").collect()
    assert [r.content_prompt for r in back] == ["q one", " \"q\"\ntwo "] and back[0].prompt == rq.QA_SYSTEM_PROMPT + "\nq one\n"
    writers.write_prompts_parquet(rq.bare_prompt_table(c, F.col("idx") == 1, F.col("q")), f"{d}/pq")
    assert {r.prompt for r in spark.read.parquet(f"{d}/pq").collect()} == {"q one", " \"q\"\ntwo "}
    r = spark.createDataFrame([("m", "a/eval_x.yaml", 3, 11), ("m", "a/eval_x.yaml", 0, 11)], "model string, case_path string, sample_no int, idx int")
    assert writers.manifest(r).first().files == ["eval_x_0.txt", "eval_x_3.txt"]
    assert writers.manifest(r, "idx").first().files == ["11_0.txt", "11_3.txt"]
