"""Nested keyword rules from case files: the data-driven tree fold equals
the compiled Column form and hand-computed scores."""

import json

from pyspark.sql import functions as F

from gradewise.functions.keywords import compile_rule_list
from gradewise.operators.keywords import keyword_tree_scores

RULES = [
    "alpha",
    {"content": {"or": ["zeta", {"and": ["beta", "Gamma"]}]}, "weight": 2, "to_lower": True},
    {"content": {"content": "delta", "cond": "context[-1] == 'match'"}},
    {"content": {"regex": True, "and": ["e[0-9]+", {"content": "x.z", "regex": False}]}},
    {"content": "bad", "neg": True, "weight": 3},
    {"post_handler": {"module": "m", "func": "f"}},
]
TEXTS = ["alpha beta GAMMA delta", "beta delta e12 x.z", "zeta bad", "nothing", "e1 xyz x.z alpha"]


def test_tree_fold_matches_compiled(spark):
    cases = spark.createDataFrame([("c1", json.dumps({"keywords": RULES}))], "case_id string, g string") \
        .select("case_id", F.parse_json("g").alias("grading"))
    from gradewise.sources.readers import keyword_nodes
    nodes = keyword_nodes(cases)
    resp = spark.createDataFrame([("m", "c1", i, t) for i, t in enumerate(TEXTS)],
                                 "model string, case_id string, sample_no int, text string")
    got = {r.sample_no: (r.score, r.tot, r.statuses) for r in keyword_tree_scores(resp, nodes).collect()}
    score, tot, st = compile_rule_list(RULES, F.col("text"))
    want = {r.sample_no: (r.s, r.t, r.st) for r in resp.select("sample_no", score.alias("s"), tot.alias("t"),
                                                                 st.alias("st")).collect()}
    assert got == want
    # hand check: text 0 matches alpha, (beta and gamma) lowered, delta after a match
    assert got[0] == (1.0 + 2.0 + 1.0, 5.0, ["match", "match", "match", "unmatch", "unmatch"])
    # text 2: zeta (rule 1) but no alpha; delta absent; 'bad' subtracts 3
    assert got[2][0] == 2.0 - 3.0
