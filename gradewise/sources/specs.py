"""Case files as one table: one row per case, with all that grading needs.

A case file is parsed once, in the task that reads it. Its rules come out as typed
arrays, so that a response later meets its whole case in one row of one join.
Whatever cannot be read or graded is found in the same pass: the row then has
``stage`` and ``reason`` and no rules. Handlers are named in the files and known by
name; no module is imported.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from gradewise.functions.keywords import normalise_cond
from gradewise.session import ship_package

NODE = "struct<node_id:int,parent_id:int,op:string,pattern:string,is_regex:boolean,cond:string>"
CASE = f"""case_path string, case_id string, prompt_path string, lang string, qtype string, full_score double, null_score double,
max_score double, min_score double, grading_keys array<string>,
rules array<struct<rule_no:int,weight:double,neg:boolean,to_lower:boolean,nodes:array<{NODE}>>>, rules_post string,
blank struct<template:string,blank_str:string,escape:string,prefix:string,post:string>,
targets array<struct<target_no:int,weight:double,to_lower:boolean,substr_match:boolean,alts:array<struct<pattern:string,is_regex:boolean,cond:string>>>>,
sims array<struct<metric:string,min_score:double,max_score:double,weight:double>>,
refs array<struct<rule_no:int,ref_no:int,text:string,path:string>>,
tests array<struct<test_no:int,content:string,path:string,prefix:string,prefix_path:string,cleanup_path:string,weight:double,timeout:double,only_longest:boolean,lang:string>>,
custom struct<name:string,metric:string>, stage string, reason string"""

KINDS = ("keywords", "blank_filling", "unit_test", "similarity", "customized")


class SpecError(ValueError):
    """A grading spec that cannot be used; its text is the reason."""


def _number(x):
    return None if x is None else float(x)


def _text(x):
    return None if x is None else str(x)


def _handler(spec: dict, known: list[str]) -> str:
    """``module.func`` or ``func``, whichever is known."""
    full = f"{spec['module']}.{spec['func']}"
    for name in (full, spec["func"]):
        if name in known:
            return name
    raise SpecError(f"unknown handler: {full}")


def flatten(content) -> list[dict]:
    """The nodes of a keyword content, children before parents, the root last
    with parent -1. ``or`` wins over ``and`` over ``content``; ``regex`` is
    inherited downwards and may be overridden on any node."""
    out: list[dict] = []

    def walk(node, regex):
        if isinstance(node, str):
            kids, op, pattern, cond = [], "leaf", node, None
        else:
            regex = bool(node.get("regex", regex))
            op = next((k for k in ("or", "and") if k in node), "content")
            kids = [walk(k, regex) for k in (node[op] if op != "content" else [node["content"]])]
            pattern, cond = None, normalise_cond(node.get("cond"))
        me = len(out)
        out.append({"node_id": me, "parent_id": -1, "op": op, "pattern": pattern, "is_regex": regex, "cond": cond})
        for k in kids:
            out[k]["parent_id"] = me
        return me

    walk(content, False)
    return out


def keyword_rules(spec: list, post_handlers: list[str]) -> tuple[list[dict], str | None]:
    """(rules with their nodes, name of the post-handler; the last one counts)."""
    rules, post = [], None
    for rule in spec:
        if isinstance(rule, dict) and "post_handler" in rule:
            post = _handler(rule["post_handler"], post_handlers)
            continue
        rule = rule if isinstance(rule, dict) else {"content": rule}
        rules.append({"rule_no": len(rules), "weight": float(rule.get("weight", 1.0)), "neg": bool(rule.get("neg", False)),
                      "to_lower": bool(rule.get("to_lower", False)), "nodes": flatten(rule["content"])})
    return rules, post


def blank_spec(spec: dict, post_handlers: list[str]) -> tuple[dict, list[dict]]:
    targets = []
    for no, target in enumerate(spec["targets"]):
        rule = target if isinstance(target, dict) else {"content": target}
        some = rule["content"] if isinstance(rule["content"], list) else [rule["content"]]
        alts = [x if isinstance(x, dict) else {"content": x} for x in some]
        targets.append({"target_no": no, "weight": float(rule.get("weight", 1.0)), "to_lower": bool(rule.get("to_lower", False)),
                        "substr_match": bool(rule.get("substr_match", False)),
                        "alts": [{"pattern": str(x["content"]), "is_regex": bool(x.get("regex", False)),
                                  "cond": _text(x.get("cond"))} for x in alts]})
    post = spec.get("post_handler")
    return {"template": spec["template"], "blank_str": spec.get("blank_str"), "escape": spec.get("escape"),
            "prefix": spec.get("prefix"), "post": None if post is None else _handler(post, post_handlers)}, targets


def similarity_spec(spec: list) -> tuple[list[dict], list[dict]]:
    sims = [{"metric": str(r["metric"]), "min_score": _number(r.get("min_score")), "max_score": _number(r.get("max_score")),
             "weight": float(r.get("weight", 1.0))} for r in spec]
    refs = [{"rule_no": no, "ref_no": k, "text": None if isinstance(ref, dict) else str(ref),
             "path": ref["path"] if isinstance(ref, dict) else None}
            for no, r in enumerate(spec) for k, ref in enumerate(r["references"])]
    return sims, refs


def test_spec(spec: dict) -> list[dict]:
    out = []
    for no, test in enumerate(spec["tests"]):
        rule = test if isinstance(test, dict) else {"content": test}
        out.append({"test_no": no, "weight": float(rule.get("weight", 1.0)), "timeout": _number(rule.get("timeout")),
                    "only_longest": bool(rule.get("only_longest", False)), "lang": spec.get("lang"),
                    **{k: rule.get(k) for k in ("content", "path", "prefix", "prefix_path", "cleanup_path")}})
    return out


def case_row(path: str, text: str, custom: list[str], post_handlers: list[str]) -> dict:
    """The row of one case file (columns of CASE; those left out are null)."""
    import yaml
    row: dict = {"case_path": path}
    try:
        doc = yaml.safe_load(text)
        if not isinstance(doc, dict):
            raise ValueError("empty document" if doc is None else "not a mapping")
    except Exception as e:  # noqa: BLE001 - bad file -> error row
        row.update(stage="load", reason=str(e) if type(e) is ValueError else f"{type(e).__name__}: {e}")
        return row
    stem = path.rsplit("/", 1)[-1].split(".")[0]
    row.update(case_id=stem if doc.get("id") is None else str(doc["id"]))
    try:
        g = doc.get("grading") or {}
        row.update({k: _text(doc.get(k)) for k in ("prompt_path", "lang")}, qtype=_text(doc.get("type")),
                   **{k: _number(doc.get(k)) for k in ("full_score", "null_score")},
                   **{k: _number(g.get(k)) for k in ("max_score", "min_score")},
                   grading_keys=[k for k in KINDS if g.get(k) is not None])
        rules: dict = {}
        if "keywords" in row["grading_keys"]:
            rules["rules"], rules["rules_post"] = keyword_rules(g["keywords"], post_handlers)
        if "blank_filling" in row["grading_keys"]:
            rules["blank"], rules["targets"] = blank_spec(g["blank_filling"], post_handlers)
        if "similarity" in row["grading_keys"]:
            rules["sims"], rules["refs"] = similarity_spec(g["similarity"])
        if "unit_test" in row["grading_keys"]:
            rules["tests"] = test_spec(g["unit_test"])
        if "customized" in row["grading_keys"]:
            rules["custom"] = {"name": _handler(g["customized"], custom), "metric": _text(g["customized"].get("real_metric_type"))}
        if not row["grading_keys"]:
            raise SpecError("no grading kind")
        row.update(rules)
    except SpecError as e:
        row.update(stage="spec", reason=str(e))
    except Exception as e:  # noqa: BLE001 - bad spec -> error row
        row.update(stage="spec", reason=f"{type(e).__name__}: {e}")
    return row


def read_cases(spark: SparkSession, paths, custom=(), post_handlers=()) -> DataFrame:
    """One row per case file (CASE). ``custom`` and ``post_handlers``: the names of
    the handlers that are known."""
    ship_package(spark)
    schema, custom, post_handlers = StructType.fromDDL(CASE), list(custom), list(post_handlers)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            rows = [case_row(p, t, custom, post_handlers) for p, t in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    raw = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return raw.mapInArrow(run, schema)
