"""Readers and writers on small files written to a temporary folder."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from gradewise.plans.grading import grade
from gradewise.sources import readers, writers

SUITE = """attempt_reduce_mode: avg_max_2
cases:
  - cases/eval_a.yaml
  - path: cases/eval_b.yaml
    weight: 2
full_score_per_question: 1.0
version: t
"""
CASE_A = """id: a
lang: python
type: code completion
grading:
  keywords:
    - "def "
    - content: "RETURN"
      to_lower: true
      weight: 2
    - content: "bad"
      neg: true
"""
CASE_B = """id: b
lang: go
type: unusual
grading:
  max_score: 1.0
  keywords:
    - "func"
"""


def _setup():
    d = tempfile.mkdtemp(prefix="gw-src-")
    os.makedirs(f"{d}/cases")
    os.makedirs(f"{d}/resp")
    open(f"{d}/suite.yaml", "w").write(SUITE)
    open(f"{d}/cases/eval_a.yaml", "w").write(CASE_A)
    open(f"{d}/cases/eval_b.yaml", "w").write(CASE_B)
    open(f"{d}/cases/broken.yaml", "w").write("id: [unclosed\n")
    texts = {"eval_a_0.txt": "def f():\n    return 1", "eval_a_1.txt": "bad", "eval_a_2.txt": "def g(): return",
             "eval_b_0.txt": "func main() {}", "eval_b_1.txt": "nothing"}
    for k, v in texts.items():
        open(f"{d}/resp/{k}", "w").write(v)
    params = {"answer_paths": {"cases/eval_a.yaml": ["eval_a_0.txt", "eval_a_1.txt", "eval_a_2.txt"],
                               "cases/eval_b.yaml": ["eval_b_0.txt", "eval_b_1.txt", "eval_b_9.txt"]}}
    open(f"{d}/resp/params.yaml", "w").write(json.dumps(params))
    return d


def test_suite_cases_manifest_and_grade(spark):
    d = _setup()
    suite, cases = readers.read_suite(spark, f"{d}/suite.yaml")
    s = suite.first()
    assert s.attempt_reduce_mode == "avg_max_2" and s.null_score_per_question == 0.0
    assert [(r.case_no, r.case_path, r.case_weight) for r in cases.orderBy("case_no").collect()] == \
        [(0, "cases/eval_a.yaml", 1.0), (1, "cases/eval_b.yaml", 2.0)]
    cs, errors = readers.read_cases(spark, f"{d}/cases/*.yaml")
    assert errors.count() == 1
    assert {r.case_id: r.grading_keys for r in cs.collect()} == {"a": ["keywords"], "b": ["keywords"]}
    assert [r.case_id for r in readers.warnings(cs).collect()] == ["b"]
    # relative case paths as in the suite file
    cs = cs.withColumn("case_path", F.regexp_extract("case_path", r"(cases/[^/]+)$", 1))
    m = readers.read_manifest(spark, f"{d}/resp/params.yaml")
    resp = readers.read_responses(spark, f"{d}/resp", m, "m1")
    lost = resp.where("error is not null").collect()  # listed but missing
    assert [(r.case_path, r.sample_no, r.error) for r in lost] == [("cases/eval_b.yaml", 2, "response file not found: eval_b_9.txt")]
    resp = resp.where("error is null")
    assert resp.count() == 5
    rules = readers.keyword_rules(cs)
    assert rules.count() == 4
    from gradewise.operators import keywords as kw
    r = resp.join(cs.select("case_path", "case_id"), "case_path")
    got = {(x.case_id, x.sample_no): (x.score, x.tot) for x in kw.keyword_scores(r, rules).collect()}
    assert got[("a", 0)] == (3.0, 3.0) and got[("a", 1)] == (-1.0, 3.0) and got[("a", 2)] == (3.0, 3.0)
    # end to end: a = best-of-2 buckets of now = ans/tot; b capped by max_score
    cases_file = os.path.join(d, "cases")
    scores, totals = grade(spark, f"{d}/suite.yaml", f"{cases_file}/eval_*.yaml", resp)
    got = {r.case_id: (r.now_score, r.now_std) for r in scores.collect()}
    # a: samples 1.0, -1/3, 1.0 -> buckets (1.0, 1.0); b: 1.0 then 0.0 -> one bucket of 1.0
    assert got["a"] == (1.0, 0.0) and got["b"] == (1.0, 0.0)
    t = totals.first()
    assert (t.n_cases, t.n_with_response, t.total_score, t.total_full) == (2, 2, 2.0, 2.0)


ALL_KINDS = {
    "kw.yaml": 'id: kw\nlang: python\ngrading:\n  keywords:\n    - alpha\n    - content: {content: beta, cond: "context[-1].startswith(\'match\')"}\n',
    "blank.yaml": 'id: blank\nlang: go\ngrading:\n  blank_filling:\n    template: "x = [blank];"\n    targets:\n'
                  '      - content: ["41", {content: "4[0-9]", regex: true}]\n        weight: 2\n',
    "sim.yaml": 'id: sim\nfull_score: 2.0\ngrading:\n  similarity:\n    - metric: rouge1\n      references: [{path: ref.txt}, other words]\n'
                '    - metric: rougeL\n      references: [one two three four]\n      weight: 3\n',
    "test.yaml": 'id: test\nlang: js\ngrading:\n  unit_test:\n    tests:\n      - "assert 1"\n      - {content: "assert 2", weight: 3}\n',
    "mixed.yaml": 'id: mixed\nlang: python\ngrading:\n  keywords: [alpha]\n  unit_test:\n    tests: ["t"]\n',
    "custom.yaml": 'id: custom\ngrading:\n  customized: {module: m, func: has_end}\n',
    "quiet.yaml": 'id: quiet\nnull_score: 0.25\ngrading:\n  keywords: [x]\n',
    "cond.yaml": 'id: cond\ngrading:\n  keywords:\n    - {content: {content: a, cond: "len(context) > 3"}}\n',
    "badspec.yaml": 'id: badspec\ngrading:\n  blank_filling: {template: "a [blank]"}\n',
    "broken.yaml": "id: [unclosed\n",
}


def test_all_kinds_end_to_end(spark):
    from gradewise.plans.grading import grade_suite
    d = tempfile.mkdtemp(prefix="gw-all-")
    os.makedirs(f"{d}/cases")
    for name, text in ALL_KINDS.items():
        open(f"{d}/cases/{name}", "w").write(text)
    names = [*ALL_KINDS, "absent.yaml"]
    open(f"{d}/suite.yaml", "w").write("cases:\n" + "".join(f"  - cases/{n}\n" for n in names) + "null_score_per_question: 0.1\n")
    answers = [("kw.yaml", 0, "alpha beta"), ("kw.yaml", 1, "beta"), ("blank.yaml", 0, "x = 42;"), ("sim.yaml", 0, "one two three four"),
               ("test.yaml", 0, "code"), ("mixed.yaml", 0, "alpha"), ("custom.yaml", 0, "the end"), ("cond.yaml", 0, "a"),
               ("badspec.yaml", 0, "a b"), ("broken.yaml", 0, "z")]
    resp = spark.createDataFrame([("m", f"cases/{n}", i, t) for n, i, t in answers],
                                 "model string, case_path string, sample_no int, text string")
    runs = spark.createDataFrame([("m", "test", 0, 0, 0, "", "", False), ("m", "test", 0, 1, 1, "", "bad", False),
                                  ("m", "mixed", 0, 0, None, "", "", False)],
                                 "model string, case_id string, sample_no int, test_no int, return_code int, stdout string, "
                                 "stderr string, timed_out boolean")
    files = spark.createDataFrame([("ref.txt", "one two three four")], "path string, text string")

    def has_end(text):
        return F.struct(F.when(F.endswith(text, F.lit("end")), 1.0).otherwise(0.0).alias("score"), F.lit(2.0).alias("tot"),
                        F.lit("").alias("detail"))

    g = grade_suite(spark, f"file://{d}/suite.yaml", f"{d}/cases/*.yaml", resp, outcomes=runs, files=files,
                    custom={"has_end": has_end})
    got = {r.case_id: round(r.now_score, 6) for r in g.case_scores.collect()}
    # keywords: samples 1 and 0 averaged; the mixed case fails for lack of a return code
    assert got == {"kw": 0.5, "blank": 1.0, "sim": 2.0, "test": 0.25, "custom": 0.5}
    t = g.totals.first()
    # quiet gives its own null score; full scores: kw, blank, sim (2), test, custom, quiet
    assert round(t.total_score, 6) == 4.25 + 0.25 and t.total_full == 7.0
    assert (t.n_cases, t.n_with_response) == (11, 9)
    errors = {(r.case_path.split("/")[-1], r.stage) for r in g.errors.collect()}
    assert errors == {("broken.yaml", "load"), ("absent.yaml", "load"), ("badspec.yaml", "spec"), ("mixed.yaml", "grade"),
                      ("cond.yaml", "grade")}
    kinds = {(r.case_id, r.metric) for r in g.metric_scores.where("error is null").collect()}
    assert kinds == {("kw", "keywords"), ("blank", "blank_filling"), ("sim", "similarity"), ("test", "unit_test"),
                     ("mixed", "keywords"), ("custom", "custom")}


def test_batch_csv_and_parquet(spark):
    d = tempfile.mkdtemp(prefix="gw-csv-")
    open(f"{d}/b.csv", "w").write('filename,completion\ncases/eval_a.yaml,"x, ""y"""\ncases/eval_a.yaml,\n')
    df = readers.read_batch_csv(spark, f"{d}/b.csv")
    rows = df.orderBy("input_pos").collect()
    assert [r.completion for r in rows] == ['x, "y"', ""] and [r.was_null for r in rows] == [False, True]
    spark.createDataFrame([(["eval_a"], ["r0", "r1"], "0")], "filename array<string>, responses array<string>, idx string") \
        .write.mode("overwrite").parquet(f"{d}/pq")
    p = readers.read_batch_parquet(spark, f"{d}/pq")
    assert p.select(F.element_at("filename", 1).alias("f")).first().f == "eval_a"


def test_writers_and_report_text(spark):
    d = tempfile.mkdtemp(prefix="gw-out-")
    rep = spark.createDataFrame(
        [("m", "total", "Overall", 82.39, 1.88, 135.0, 1.0), ("m", "lang", "python", 14.5, 0.87, 24.0, 24 / 135)],
        "model string, dimension string, key string, mean double, std double, full_total double, allocation double")
    txt = writers.render_report(rep, ["m"])
    assert "Overall Score" in txt and "61.03%" in txt and "Lang: python" in txt and "17.78%" in txt
    tot = spark.createDataFrame([("m", 82.39, 6.17, 135.0, 135, 135)],
                                "model string, total_score double, sum_of_case_std double, total_full double, n_cases long, n_with_response long")
    writers.write_summary(tot, f"{d}/summary")
    assert "Total cases: 135" in spark.read.json(f"{d}/summary").first().summary


def test_manifest_roundtrip_and_resolve(spark):
    d = tempfile.mkdtemp(prefix="gw-man-")
    resp = spark.createDataFrame([("m1", "cases/eval_a.yaml", i, f"t{i}") for i in (2, 0, 1)] +
                                 [("m2", "cases/eval_a.yaml", 0, "u0")],
                                 "model string, case_path string, sample_no int, text string")
    writers.write_responses(resp, f"{d}/responses")
    back = spark.read.parquet(f"{d}/responses").where(F.col("model") == "m1")
    assert back.count() == 3
    m = {(r.model, r.case_path): r.files for r in writers.manifest(resp).collect()}
    assert m[("m1", "cases/eval_a.yaml")] == ["eval_a_0.txt", "eval_a_1.txt", "eval_a_2.txt"]
    rules = spark.createDataFrame([("c", 0, "inline text", None), ("c", 1, None, "refs/r1.txt")],
                                  "case_id string, ref_no int, content string, path string")
    files = spark.createDataFrame([("refs/r1.txt", "from file")], "path string, text string")
    got = {r.ref_no: r.text for r in readers.resolve_texts(rules, files).collect()}
    assert got == {0: "inline text", 1: "from file"}


def test_unpack_batch_csv(spark):
    d = tempfile.mkdtemp(prefix="gw-csv2-")
    open(f"{d}/b.csv", "w").write("filename,completion\na.yaml,x0\nb.yaml,y0\na.yaml,\na.yaml,x2\n")
    rows = readers.read_batch_csv(spark, f"{d}/b.csv")
    got = sorted((r.case_path, r.sample_no, r.text) for r in readers.unpack_batch_csv(rows).collect())
    assert got == [("a.yaml", 0, "x0"), ("a.yaml", 1, ""), ("a.yaml", 2, "x2"), ("b.yaml", 0, "y0")]
    s = readers.null_completion_stats(rows).first()
    assert s.n_null == 1 and s.cases == ["a.yaml"]
