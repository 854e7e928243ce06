"""Custom grading hooks as Column functions (no dynamic imports, no eval).

A customised metric is a registered function ``Column -> struct<score, tot,
detail>``; a post-handler maps an aggregated ``(score, tot, statuses)`` to a
replacement triple. Case files name them as ``module.func``; ``dispatch`` takes, row
by row, the one that the case names. The metric of a custom handler is ``custom``, or
the name given by the case (``real_metric_type``) or else by the handler.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

CUSTOM: dict[str, Callable[..., Column]] = {}
POST: dict[str, Callable[[Column, Column, Column], Column]] = {}

RESULT = "struct<score:double,tot:double,detail:string>"


def register(name: str, metric: str | None = None):
    """Register a custom metric; ``metric`` is its name in reports."""
    def deco(fn):
        CUSTOM[name] = fn
        if metric is not None:
            fn.metric = metric
        return fn
    return deco


def register_post(name: str):
    def deco(fn):
        POST[name] = fn
        return fn
    return deco


def dispatch(name: Column, handlers: dict, *args: Column) -> Column:
    """The result (RESULT) of the handler called ``name`` in each row; null where
    no name is given. Names are checked when the case files are read."""
    out = F.lit(None).cast(RESULT)
    for known, fn in handlers.items():
        out = F.when(name == known, fn(*args).cast(RESULT)).otherwise(out)
    return out


def metric_name(name: Column, given: Column, handlers: dict) -> Column:
    """Metric of a custom result: the case's own name for it, the handler's, or ``custom``."""
    out = F.lit("custom")
    for known, fn in handlers.items():
        if getattr(fn, "metric", None):
            out = F.when(name == known, F.lit(fn.metric)).otherwise(out)
    return F.coalesce(given, out)


def after(score: Column, tot: Column, statuses: Column, name: Column, handlers: dict) -> Column:
    """struct(score, tot, detail): the post-handler's where the case names one,
    else what it would have been given."""
    own = F.struct(score.cast("double").alias("score"), tot.cast("double").alias("tot"), F.lit(None).cast("string").alias("detail"))
    return F.when(name.isNull(), own).otherwise(dispatch(name, handlers, score, tot, statuses)) if handlers else own


@register("order")
def order_handler(text: Column, first: str, second: str) -> Column:
    """1 when ``first`` and ``second`` both occur and ``first`` comes first."""
    both = F.contains(text, F.lit(first)) & F.contains(text, F.lit(second))
    good = F.instr(text, first) < F.instr(text, second)
    score = F.when(both & good, F.lit(1.0)).otherwise(F.lit(0.0))
    detail = (F.when(~both, F.lit("keywords not found"))
               .when(good, F.lit("good")).otherwise(F.lit("all found but wrong placement")))
    return F.struct(score.alias("score"), F.lit(1.0).alias("tot"), detail.alias("detail"))


def apply_post_handler(scores: DataFrame, handler: Callable[[Column, Column, Column], Column],
                       score: str = "score", tot: str = "tot", statuses: str = "statuses") -> DataFrame:
    """Replace (score, tot) by a post-handler's result computed from the
    aggregated triple (score, tot, per-rule statuses); the handler returns
    struct<score double, tot double, detail>."""
    r = handler(F.col(score), F.col(tot), F.col(statuses))
    return (scores.withColumn("__ph", r)
            .withColumn(score, F.col("__ph.score")).withColumn(tot, F.col("__ph.tot"))
            .withColumn("post_handler_detail", F.col("__ph.detail")).drop("__ph"))


@register_post("require_all")
def require_all(score: Column, tot: Column, statuses: Column) -> Column:
    """Post-handler: full marks only when every rule matched."""
    ok = F.forall(statuses, lambda s: s == "match")
    return F.struct(F.when(ok, tot).otherwise(F.lit(0.0)).alias("score"), tot.alias("tot"),
                    F.when(ok, F.lit("all matched")).otherwise(F.lit("missing keywords")).alias("detail"))


def response_in(status: Column) -> Column:
    """The response text that a blank's status line quotes, null if it quotes none."""
    found = F.regexp_extract(status, r"(?s)response string: (.*?), ans:", 1)
    return F.when(status.rlike(r"(?s)response string: .*?, ans:"), found)


def fill_points(main: str, sub_all, main_points: float = 2.0, sub_points: float = 1.0, cap: float = 2.0):
    """A post-handler for blanks: points of the first blank's text for holding
    ``main`` and for holding all of ``sub_all``, capped; the total is the cap."""
    def handler(score: Column, tot: Column, statuses: Column) -> Column:
        fill = F.coalesce(response_in(F.get(statuses, F.lit(0))), F.lit(""))
        whole = F.lit(True)
        for part in sub_all:
            whole = whole & F.contains(fill, F.lit(part))
        first = F.contains(fill, F.lit(main))
        points = F.when(first, F.lit(main_points)).otherwise(0.0) + F.when(whole, F.lit(sub_points)).otherwise(0.0)
        detail = F.concat_ws(", ", F.when(first, F.lit("main match")), F.when(whole, F.lit("sub match")))
        return F.struct(F.least(points, F.lit(cap)).alias("score"), F.lit(cap).alias("tot"), detail.alias("detail"))
    return handler
