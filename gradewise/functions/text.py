"""String helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_SHORTHAND = r"\\[wdsbWDSB]"


def as_col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def let(expr, fn) -> Column:
    """Bind ``expr`` once and use it many times in ``fn`` (a one-element
    ``transform``). Spark does not share repeated sub-expressions inside
    lambda bodies, and nested helpers would otherwise copy a large
    sub-expression into the plan at every use."""
    return F.element_at(F.transform(F.array(as_col(expr)), fn), 1)


def py_regex(pattern) -> Column:
    """Make a Java regex behave like Python ``re`` for search/fullmatch.

    ``(?d)``: only ``\\n`` ends a line (Python's ``.`` excludes only ``\\n``).
    ``(?U)``: ``\\w \\d \\s \\b`` are Unicode-aware, as in Python 3, added only
    when the pattern uses them.
    """
    p = as_col(pattern)
    uni = F.when(p.rlike(_SHORTHAND), F.lit("(?U)")).otherwise(F.lit(""))
    return F.concat(F.lit("(?d)"), uni, p)


def regex_search(text, pattern) -> Column:
    """``re.search(pattern, text) is not None``."""
    return F.regexp_like(as_col(text), py_regex(pattern))


def rouge_tokens(text) -> Column:
    """Default ROUGE tokenizer: lower case, every run of characters other
    than a-z/0-9 is a separator, empty tokens dropped."""
    t = F.regexp_replace(F.lower(as_col(text)), "[^a-z0-9]+", " ")
    return F.filter(F.split(t, " "), lambda x: x != "")


def path_stem(path) -> Column:
    """``a/b/eval_0-0-1.yaml`` -> ``eval_0-0-1`` (basename up to the first dot)."""
    base = F.element_at(F.split(as_col(path), "/"), -1)
    return F.split_part(base, F.lit("."), F.lit(1))


def occurrences(text, literal: str) -> Column:
    """Non-overlapping count of a literal, like Python ``str.count``."""
    t = as_col(text)
    return F.when(F.lit(len(literal)) == 0, F.length(t) + 1).otherwise(
        (F.length(t) - F.length(F.replace(t, F.lit(literal), F.lit("")))) / F.lit(len(literal))
    ).cast("long")
