"""Keyword rule language compiled to Column expressions.

A rule's content is a leaf (a string, or a Column holding the pattern) or a
node ``{"content": ..., "or": [...], "and": [...], "regex": bool, "cond": str}``
nested to any depth. ``or`` wins over ``and``, ``and`` over ``content``;
``regex`` is inherited downwards and may be overridden on any node. The
``to_lower`` flag of the top-level rule applies to every leaf: both the text
and the pattern are lowered (so ``\\S`` in a lowered regex becomes ``\\s``,
as in the original grader). Nested ``to_lower`` keys are ignored.

Conditions are a closed set -- text is never evaluated:
``prev_match`` (the previous rule of the case matched) and ``prev_unmatch``.
``normalise_cond`` and ``cond_kind`` map the forms in use onto them:
``context[-1]`` or ``grading_details[-1]``, either ``.startswith('match')`` or
``== 'match'`` (likewise ``'unmatch'``), in either kind of quotes. Any other
text is ``invalid``: the case gets an error row, never a meaning.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from gradewise.functions.text import as_col, regex_search

INVALID = "invalid"
_BEFORE = r"^\s*(?:prev_|(?:context|grading_details)\s*\[\s*-1\s*\]\s*(?:==\s*|\.startswith\(\s*)(?:'(?=[a-z]+'\s*\)?\s*$)|\"(?=[a-z]+\"\s*\)?\s*$)))"
_COND = _BEFORE + r"(match|unmatch)(?:['\"]\s*\)?)?\s*$"


def normalise_cond(cond: str | None) -> str | None:
    """``prev_match``, ``prev_unmatch``, ``invalid``, or None without one."""
    if cond is None:
        return None
    m = re.match(_COND, str(cond))
    return f"prev_{m.group(1)}" if m else INVALID


def cond_kind(cond: Column) -> Column:
    """``normalise_cond`` as a Column."""
    word = F.regexp_extract(cond, _COND, 1)
    return F.when(cond.isNull(), F.lit(None)).when(word == "", F.lit(INVALID)).otherwise(F.concat(F.lit("prev_"), word))


def cond_holds(kind: Column, prev: Column) -> Column:
    """Whether a rule of this condition kind may count; null when invalid."""
    return (F.when(kind.isNull(), F.lit(True)).when(kind == "prev_match", prev)
            .when(kind == "prev_unmatch", ~prev))


def cond_column(cond: str | None, prev: Column) -> Column:
    c = normalise_cond(cond)
    if c == INVALID:
        raise ValueError(f"unsupported rule condition: {cond!r}")
    if c is None:
        return F.lit(True)
    return prev if c == "prev_match" else ~prev


def leaf_match(pattern, text: Column, lowered_text: Column, to_lower, regex) -> Column:
    """One keyword: substring test, or regex search; optionally lowered."""
    pat = as_col(pattern)
    to_lower = as_col(to_lower)
    regex = as_col(regex)
    t = F.when(to_lower, lowered_text).otherwise(text)
    p = F.when(to_lower, F.lower(pat)).otherwise(pat)
    return F.when(regex, regex_search(t, p)).otherwise(F.contains(t, p))


def compile_clause(content, text: Column, lowered_text: Column, to_lower=False,
                   regex=False, prev: Column | None = None) -> Column:
    """Compile a (possibly nested) keyword content to one boolean Column."""
    prev = F.lit(False) if prev is None else prev
    if isinstance(content, (str, Column)):
        return leaf_match(content, text, lowered_text, to_lower, regex)
    if not isinstance(content, dict):
        raise TypeError(f"bad keyword content: {content!r}")
    regex = content.get("regex", regex)
    if "or" in content:
        parts = [compile_clause(c, text, lowered_text, to_lower, regex, prev) for c in content["or"]]
        out = parts[0]
        for p in parts[1:]:
            out = out | p
    elif "and" in content:
        parts = [compile_clause(c, text, lowered_text, to_lower, regex, prev) for c in content["and"]]
        out = parts[0]
        for p in parts[1:]:
            out = out & p
    else:
        if "content" not in content:
            raise ValueError("keyword node needs one of content/or/and")
        out = compile_clause(content["content"], text, lowered_text, to_lower, regex, prev)
    if content.get("cond") is not None:
        out = out & cond_column(content["cond"], prev)
    return out


def compile_rule_list(rules, text: Column, lowered_text: Column | None = None):
    """Unroll one case's ordered rule list into (score, total, statuses).

    ``rules`` is the list under ``grading.keywords`` of one case: strings or
    dicts with ``content``, ``weight``, ``to_lower``, ``neg``. Returns three
    Columns: signed weighted score, total of non-negative weights, and an
    array of 'match'/'unmatch' per rule (post-handler entries are skipped).
    """
    lowered_text = F.lower(text) if lowered_text is None else lowered_text
    prev = F.lit(False)
    score = F.lit(0.0)
    total = F.lit(0.0)
    statuses = []
    for rule in rules:
        if isinstance(rule, dict) and "post_handler" in rule:
            continue
        if isinstance(rule, str):
            content, weight, to_lower, neg = rule, 1.0, False, False
        else:
            content = rule["content"]
            weight = float(rule.get("weight", 1.0))
            to_lower = bool(rule.get("to_lower", False))
            neg = bool(rule.get("neg", False))
        m = compile_clause(content, text, lowered_text, to_lower, False, prev)
        score = score + F.when(m, F.lit(-weight if neg else weight)).otherwise(F.lit(0.0))
        total = total + F.lit(0.0 if neg else weight)
        statuses.append(F.when(m, F.lit("match")).otherwise(F.lit("unmatch")))
        prev = m
    return score, total, F.array(*statuses) if statuses else F.array().cast("array<string>")
