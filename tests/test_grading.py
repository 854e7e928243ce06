"""Handlers named in case files, and errors as rows, end to end."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from gradewise.operators import hooks as hk
from gradewise.plans.grading import grade_suite
from gradewise.sources import specs

TEMPLATE = "function copy () {\\n  const text = 'lorem ipsum';\\n  [blank]\\n}"
CASES = {
    "paste.yaml": f'id: paste\nlang: js\ngrading:\n  max_score: 2.0\n  blank_filling:\n    template: "{TEMPLATE}"\n    targets:\n'
                  '      - content: [board.write, .select(), document.copy]\n        weight: 2.0\n'
                  '    post_handler: {module: my.points, func: handler}\n',
    "all.yaml": "id: all\ngrading:\n  keywords:\n    - alpha\n    - beta\n    - post_handler: {module: any, func: require_all}\n",
    "half.yaml": "id: half\nfull_score: 4\ngrading:\n  keywords: [alpha]\n  customized: {module: c, func: size, real_metric_type: length}\n",
    "named.yaml": "id: named\ngrading:\n  customized: {module: c, func: size}\n",
    "neg.yaml": "id: neg\ngrading:\n  keywords:\n    - {content: bad, neg: true}\n",
    "who.yaml": "id: who\ngrading:\n  keywords: [a, {post_handler: {module: nix, func: body}}]\n",
    "whoblank.yaml": 'id: whoblank\ngrading:\n  blank_filling: {template: "a [blank]", targets: [b], post_handler: {module: x, func: y}}\n',
    "whocustom.yaml": "id: whocustom\ngrading:\n  customized: {module: x, func: y}\n",
    "mute.yaml": "id: mute\ngrading:\n  customized: {module: c, func: mute}\n",
    "blanks.yaml": 'id: blanks\ngrading:\n  blank_filling: {template: "a [blank] c [blank]", targets: [b]}\n',
    "metric.yaml": "id: metric\ngrading:\n  similarity:\n    - {metric: bleu, references: [x]}\n",
    "lost.yaml": "id: lost\ngrading:\n  similarity:\n    - {metric: rouge1, references: [{path: none.txt}]}\n",
    "run.yaml": "id: run\nlang: python\ngrading:\n  unit_test: {tests: [t]}\n",
    "odd.yaml": "id: odd\nlang: cobol\ngrading:\n  unit_test: {tests: [t]}\n",
    "gone.yaml": "id: gone\ngrading:\n  keywords: [a]\n",
    "idle.yaml": "id: idle\nnull_score: 0.5\ngrading:\n  keywords: [a]\n",
    "list.yaml": "- a\n- b\n",
    "empty.yaml": "",
}


def copy(text):
    return TEMPLATE.replace("\\n", "\n").replace("[blank]", text)


ANSWERS = [
    ("m", "paste", 0, copy("board.write(text);")), ("m", "paste", 1, copy("x.select(); document.copy('c');")),
    ("m", "paste", 2, copy("nothing(text);")), ("m", "paste", 3, "no template at all"),
    ("m", "paste", 4, copy("board.write(x.select()); document.copy")),
    ("m", "all", 0, "alpha beta"), ("m", "all", 1, "alpha"), ("m", "half", 0, "alpha xx"), ("m", "named", 0, "abc"),
    ("m", "neg", 0, "fine"), ("m", "who", 0, "a"), ("m", "mute", 0, "a"), ("m", "blanks", 0, "a b c d"), ("m", "metric", 0, "x"),
    ("m", "lost", 0, "x"), ("m", "run", 0, "code"), ("m", "odd", 0, "code"), ("m", "gone", 0, None), ("m", "empty", 0, "a"),
    ("n", "all", 0, "beta alpha"), ("n", "gone", 0, "a"), ("n", "elsewhere", 0, "a"),
]


def size(text):
    return F.struct(F.length(text).cast("double").alias("score"), F.lit(10.0).alias("tot"), F.lit("n").alias("detail"))


size.metric = "size"


def mute(text):
    return F.struct(F.lit(None).cast("double").alias("score"), F.lit(1.0).alias("tot"), F.lit("").alias("detail"))


@pytest.fixture(scope="module")
def graded(spark):
    d = tempfile.mkdtemp(prefix="gw-hand-")
    os.makedirs(f"{d}/cases")
    for name, text in CASES.items():
        open(f"{d}/cases/{name}", "w").write(text)
    open(f"{d}/suite.yaml", "w").write("cases:\n" + "".join(f"  - cases/{n}\n" for n in [*CASES, "absent.yaml"]))
    resp = spark.createDataFrame([(m, f"cases/{c}.yaml", i, t, "response file not found: f" if t is None else None) for m, c, i, t in ANSWERS],
                                 "model string, case_path string, sample_no int, text string, error string")
    return grade_suite(spark, f"{d}/suite.yaml", f"{d}/cases/*.yaml", resp, custom={"size": size, "mute": mute},
                       post_handlers={"my.points.handler": hk.fill_points("board.write", [".select()", "document.copy"])})


def test_post_handlers_from_case_files(graded):
    m = {(r.case_id, r.sample_no): (r.score, r.tot, r.detail) for r in graded.metric_scores.where("model = 'm'").collect()}
    assert m[("paste", 0)] == (2.0, 2.0, "main match") and m[("paste", 1)] == (1.0, 2.0, "sub match")
    assert m[("paste", 2)] == (0.0, 2.0, "") and m[("paste", 3)] == (0.0, 2.0, "")
    assert m[("paste", 4)] == (2.0, 2.0, "main match, sub match")
    assert m[("all", 0)] == (2.0, 2.0, "all matched") and m[("all", 1)] == (0.0, 2.0, "missing keywords")
    scores = {(r.model, r.case_id): r.now_score for r in graded.case_scores.collect()}
    assert scores == {("m", "paste"): 0.5, ("m", "all"): 0.5, ("m", "half"): 4 * 9 / 11, ("m", "named"): 0.3, ("n", "all"): 1.0,
                      ("n", "gone"): 1.0}


def test_custom_metrics_take_their_names(graded):
    names = {(r.case_id, r.metric) for r in graded.metric_scores.where("error is null and model = 'm'").collect()}
    assert {("half", "length"), ("half", "keywords"), ("named", "size")} <= names


def test_every_failure_is_a_row(graded):
    got = {(r.model, (r.case_path or "").split("/")[-1], r.stage): r.reason for r in graded.errors.collect()}
    spec = {"who": "unknown handler: nix.body", "whoblank": "unknown handler: x.y", "whocustom": "unknown handler: x.y"}
    load = {"list": "not a mapping", "empty": None, "absent": "case file not found"}
    grade = {"neg": "m: zero_total", "mute": "m: handler gave no score", "blanks": "m: blanks and targets differ in number",
             "metric": "m: unknown metric: bleu", "lost": "m: reference text not found", "run": "m: error: no return code",
             "odd": "m: unsupported language", "gone": "m: response file not found: f"}
    want = {(None, f"{k}.yaml", "spec"): v for k, v in spec.items()} | {(None, f"{k}.yaml", "load"): v for k, v in load.items()} \
        | {("m", f"{k}.yaml", "grade"): v for k, v in grade.items()}
    assert set(got) == set(want)
    assert {k: got[k] for k, v in want.items() if v is not None and got[k] != v} == {}


def test_counts_add_up(graded):
    t = {r.model: r for r in graded.totals.collect()}
    for r in t.values():
        assert r.n_cases == r.n_graded + r.n_unanswered + r.n_errors == len(CASES) + 1
    assert (t["m"].n_graded, t["m"].n_unanswered, t["m"].n_errors, t["m"].n_with_response) == (4, 1, 14, 14)
    assert (t["n"].n_graded, t["n"].n_unanswered, t["n"].n_errors) == (2, 11, 6)
    assert graded.counts == {"metric_rows": 20, "error_rows": 7, "graded": 6, "failed": 8}
    # full scores of m: paste, all, half (4), named, idle; the failed and unfit add nothing
    assert t["m"].total_full == 8.0 and round(t["m"].total_score, 9) == round(0.5 + 0.5 + 36 / 11 + 0.3 + 0.5, 9)


def test_spec_rows_are_plain_functions():
    row = specs.case_row("x/eval_7.yaml", "grading:\n  keywords: [a, {or: [b]}]\n", [], [])
    assert row["stage"] == "spec" and "content" in row["reason"] and row["case_id"] == "eval_7"
    nodes = specs.flatten({"or": ["a", {"and": ["b", "c"], "regex": True, "cond": "context[-1] == 'match'"}]})
    assert [(n["node_id"], n["parent_id"], n["op"], n["is_regex"]) for n in nodes] == \
        [(0, 4, "leaf", False), (1, 3, "leaf", True), (2, 3, "leaf", True), (3, 4, "and", True), (4, -1, "or", False)]
    assert nodes[3]["cond"] == "prev_match"
