"""Keyword scoring of responses against per-case rule tables.

Plan: the rule table (small: a few rules per case) is packed into one
ordered array per case and joined to the responses -- a broadcast hash join
where the planner finds it small -- so every response row meets its case's
rules without exploding responses x rules and without a shuffle. One
``aggregate`` fold per row evaluates the rules in order, carrying the
previous rule's outcome for conditional rules, the signed score, the total
and the match/unmatch statuses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gradewise.functions.keywords import INVALID, cond_holds, cond_kind
from gradewise.functions.text import let, py_regex

# Rule table columns: case_id, rule_no, pattern, and optionally weight
# (default 1.0), neg, to_lower, is_regex (default false), cond (null or any
# condition text that ``functions.keywords.cond_kind`` knows).
RULE_DEFAULTS = {
    "weight": (1.0, "double"),
    "neg": (False, "boolean"),
    "to_lower": (False, "boolean"),
    "is_regex": (False, "boolean"),
    "cond": (None, "string"),
}


def normalise_rules(rules: DataFrame) -> DataFrame:
    """Fill per-rule defaults and precompute the effective pattern."""
    cols = set(rules.columns)
    r = rules
    for name, (value, dtype) in RULE_DEFAULTS.items():
        default = F.lit(value).cast(dtype)
        r = r.withColumn(name, F.coalesce(F.col(name), default) if name in cols else default)
    pat = F.when(F.col("to_lower"), F.lower("pattern")).otherwise(F.col("pattern"))
    return r.select(
        "case_id", F.col("rule_no").cast("int").alias("rule_no"),
        pat.alias("pat"), py_regex(pat).alias("rx"),
        F.col("weight").cast("double").alias("weight"),
        F.col("neg").cast("boolean").alias("neg"),
        F.col("to_lower").cast("boolean").alias("to_lower"),
        F.col("is_regex").cast("boolean").alias("is_regex"),
        cond_kind(F.col("cond").cast("string")).alias("cond"),
    )


def pack_rules(rules: DataFrame) -> DataFrame:
    """One row per case: ``rules`` = array of rule structs sorted by rule_no."""
    r = normalise_rules(rules)
    fields = ["rule_no", "pat", "rx", "weight", "neg", "to_lower", "is_regex", "cond"]
    return r.groupBy("case_id").agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("rules"))


def _match(r: Column, text: Column, ltext: Column) -> Column:
    t = F.when(r["to_lower"], ltext).otherwise(text)
    return F.when(r["is_regex"], F.regexp_like(t, r["rx"])).otherwise(F.contains(t, r["pat"]))


def fold_rules(rules: Column, text: Column, ltext: Column) -> Column:
    """Ordered evaluation of a packed rule array against one text.

    Returns struct(prev, score, tot, statuses)."""
    init = F.struct(F.lit(False).alias("prev"), F.lit(0.0).alias("score"),
                    F.lit(0.0).alias("tot"),
                    F.array().cast("array<string>").alias("statuses"))

    def step(acc, r):
        raw = _match(r, text, ltext)
        ok = F.coalesce(cond_holds(r["cond"], acc["prev"]), F.lit(False))
        signed = F.when(r["neg"], -r["weight"]).otherwise(r["weight"])
        return let(raw & ok, lambda m: F.struct(
            m.alias("prev"),
            (acc["score"] + F.when(m, signed).otherwise(F.lit(0.0))).alias("score"),
            (acc["tot"] + F.when(r["neg"], F.lit(0.0)).otherwise(r["weight"])).alias("tot"),
            F.array_append(acc["statuses"], F.when(m, "match").otherwise("unmatch")).alias("statuses"),
        ))

    return F.aggregate(rules, init, step)


def keyword_scores(responses: DataFrame, rules: DataFrame,
                   keys=("model", "case_id", "sample_no"), text_col: str = "text") -> DataFrame:
    """Per response: keyword score (signed), total, statuses.

    Cases without keyword rules produce no row (the metric is absent)."""
    packed = pack_rules(rules)
    j = responses.select(*keys, text_col).join(packed, "case_id")
    # The lowered text and the fold result are columns of their own, so
    # each is computed once per row (lambda bodies and repeated field
    # accesses would otherwise re-evaluate them).
    j = j.select(*keys, text_col, "rules", F.lower(F.col(text_col)).alias("__lt"))
    bad = F.exists("rules", lambda r: F.coalesce(r["cond"] == INVALID, F.lit(False)) | r["pat"].isNull())
    j = j.select(*keys, bad.alias("__bad"), fold_rules(F.col("rules"), F.col(text_col), F.col("__lt")).alias("__r"))
    return j.select(*keys, *_result())


# An unknown condition, or a rule without pattern (nested, in a flat rule table).
BAD_CONDITION = "unsupported rule condition"


def _result():
    """Score columns of a folded row; a case with an unknown condition has no
    score but an error."""
    def sound(c):
        return F.when(~F.col("__bad"), F.col(c))
    return (sound("__r.score").alias("score"), sound("__r.tot").alias("tot"), sound("__r.statuses").alias("statuses"),
            F.when(F.col("__bad"), F.lit(BAD_CONDITION)).alias("error"))


def rule_flags(responses: DataFrame, rules: DataFrame, keys, text_col: str = "text") -> DataFrame:
    """One row per response: ``flags``, an array of (rule_no, weight, neg,
    matched) in rule order, conditions left aside. Texts go no further than
    this row, so what follows (numbering, exploding) moves narrow rows."""
    j = responses.select(*keys, text_col).join(pack_rules(rules), "case_id")
    j = j.select(*keys, text_col, "rules", F.lower(F.col(text_col)).alias("__lt"))
    return j.select(*keys, F.transform("rules", lambda r: F.struct(
        r["rule_no"].alias("rule_no"), r["weight"].alias("weight"), r["neg"].alias("neg"),
        _match(r, F.col(text_col), F.col("__lt")).alias("matched"))).alias("flags"))


def rule_matches(responses: DataFrame, rules: DataFrame, match: Column | None = None,
                 keys=("model", "case_id", "sample_no"), text_col: str = "text") -> DataFrame:
    """Long form: one row per (response, rule) with the raw match flag.

    ``responses x rules`` equi-joined on case_id."""
    r = normalise_rules(rules)
    j = responses.select(*keys, text_col).join(r, "case_id")
    text = F.col(text_col)
    if match is None:
        t = F.when(F.col("to_lower"), F.lower(text)).otherwise(text)
        match = F.when(F.col("is_regex"), F.regexp_like(t, F.col("rx"))).otherwise(F.contains(t, F.col("pat")))
    return j.select(*keys, "rule_no", "weight", "neg", match.alias("matched"))


def pack_rule_trees(nodes: DataFrame) -> DataFrame:
    """Node table -> one row per case: array of rules (sorted by rule_no),
    each with its post-ordered node array."""
    pat = F.when(F.col("to_lower"), F.lower("pattern")).otherwise(F.col("pattern"))
    n = nodes.select("case_id", "rule_no", "weight", "neg", "to_lower", F.struct(
        "node_id", "parent_id", "op", pat.alias("pat"), py_regex(pat).alias("rx"),
        F.coalesce("is_regex", F.lit(False)).alias("is_regex"), cond_kind(F.col("cond")).alias("cond")).alias("node"))
    per_rule = n.groupBy("case_id", "rule_no").agg(
        F.first("weight").alias("weight"), F.first("neg").alias("neg"), F.first("to_lower").alias("to_lower"),
        F.array_sort(F.collect_list("node")).alias("nodes"))
    return per_rule.groupBy("case_id").agg(F.array_sort(F.collect_list(
        F.struct("rule_no", "weight", "neg", "to_lower", "nodes"))).alias("rules"))


def _tree_value(rule: Column, text: Column, ltext: Column, prev: Column) -> Column:
    """Root value of one rule's node tree: fold over post-ordered nodes,
    keeping node_id -> value in a map (children are decided before their
    parent)."""
    t = F.when(rule["to_lower"], ltext).otherwise(text)
    nodes = rule["nodes"]

    def step(m, nd):
        kids = F.filter(nodes, lambda c: c["parent_id"] == nd["node_id"])
        leaf = F.when(nd["is_regex"], F.regexp_like(t, nd["rx"])).otherwise(F.contains(t, nd["pat"]))
        any_kid = F.exists(kids, lambda c: F.element_at(m, c["node_id"]))
        all_kids = F.forall(kids, lambda c: F.element_at(m, c["node_id"]))
        v = (F.when(nd["op"] == "leaf", leaf).when(nd["op"] == "and", all_kids).otherwise(any_kid))
        ok = F.coalesce(cond_holds(nd["cond"], prev), F.lit(False))
        return F.map_concat(m, F.create_map(nd["node_id"], v & ok))

    values = F.aggregate(nodes, F.create_map().cast("map<int,boolean>"), step)
    return F.coalesce(F.element_at(values, F.element_at(nodes, -1)["node_id"]), F.lit(False))


def prepared_rules(rules: Column) -> Column:
    """A packed rule array as it comes from case files (``sources.specs``) in
    the form that ``fold_trees`` reads: effective patterns and condition kinds."""
    def node(n, low):
        pat = F.when(low, F.lower(n["pattern"])).otherwise(n["pattern"])
        return F.struct(n["node_id"].alias("node_id"), n["parent_id"].alias("parent_id"), n["op"].alias("op"),
                        pat.alias("pat"), py_regex(pat).alias("rx"), n["is_regex"].alias("is_regex"),
                        cond_kind(n["cond"]).alias("cond"))
    return F.transform(rules, lambda r: F.struct(
        r["rule_no"].alias("rule_no"), r["weight"].alias("weight"), r["neg"].alias("neg"), r["to_lower"].alias("to_lower"),
        F.transform(r["nodes"], lambda n: node(n, r["to_lower"])).alias("nodes")))


def bad_trees(rules: Column) -> Column:
    """Whether a rule of a packed array has an unknown condition."""
    return F.exists(rules, lambda r: F.exists(r["nodes"], lambda n: F.coalesce(n["cond"] == INVALID, F.lit(False))))


def fold_trees(rules: Column, text: Column, ltext: Column) -> Column:
    """Ordered evaluation of packed rule trees against one text: struct(prev,
    score, tot, statuses)."""
    init = F.struct(F.lit(False).alias("prev"), F.lit(0.0).alias("score"), F.lit(0.0).alias("tot"),
                    F.array().cast("array<string>").alias("statuses"))

    def step(acc, r):
        signed = F.when(r["neg"], -r["weight"]).otherwise(r["weight"])
        return let(_tree_value(r, text, ltext, acc["prev"]), lambda m: F.struct(
            m.alias("prev"),
            (acc["score"] + F.when(m, signed).otherwise(F.lit(0.0))).alias("score"),
            (acc["tot"] + F.when(r["neg"], F.lit(0.0)).otherwise(r["weight"])).alias("tot"),
            F.array_append(acc["statuses"], F.when(m, "match").otherwise("unmatch")).alias("statuses")))
    return F.aggregate(rules, init, step)


def keyword_tree_scores(responses: DataFrame, nodes: DataFrame,
                        keys=("model", "case_id", "sample_no"), text_col: str = "text") -> DataFrame:
    """Keyword score per response for rule trees of any depth (node table
    from ``sources.readers.keyword_nodes``); same plan as ``keyword_scores``:
    packed per case, one fold per row."""
    packed = pack_rule_trees(nodes)
    j = responses.select(*keys, text_col).join(packed, "case_id")
    j = j.select(*keys, text_col, "rules", F.lower(F.col(text_col)).alias("__lt"))
    j = j.select(*keys, bad_trees(F.col("rules")).alias("__bad"),
                 fold_trees(F.col("rules"), F.col(text_col), F.col("__lt")).alias("__r"))
    return j.select(*keys, *_result())
