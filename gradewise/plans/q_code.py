"""Catalogue: code extraction, check programs, execution outcomes, pass@k."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradewise.functions import code as cd
from gradewise.operators import outcomes as oc
from gradewise.plans.registry import big, query, rnd
from gradewise.sources import fixtures as fx

PASS_KS = (1, 2, 5)


def _with_lang(df, spark, sf):
    c = fx.cases_v(spark, sf).select("case_id", "lang")
    return df.join(c, "case_id")


# ----------------------------------------------------------- DuckDB helpers
def _q(s):
    return "'" + s.replace("'", "''") + "'"


def _sql_lit(s):
    """DuckDB string expression for a Python string (newlines via chr(10))."""
    parts = s.split("\n")
    return " || chr(10) || ".join(_q(p) for p in parts) if len(parts) > 1 else _q(s)


def _sql_count(t, lit):
    return f"((length({t}) - length(replace({t}, {_q(lit)}, ''))) // {len(lit)})"


def _sql_markers(t):
    return " + ".join(_sql_count(t, m) for m in cd.MARKERS)

_SQL_IS_FENCE = " OR ".join(f"contains(l, {_q(m)})" for m in cd.MARKERS)


def _sql_last_brace(t):
    return f"CASE WHEN strpos({t}, '}}') > 0 THEN left({t}, length({t}) - strpos(reverse({t}), '}}') + 1) ELSE {t} END"


def _sql_list(words):
    return "[" + ", ".join(_sql_lit(w) for w in words) + "]"


def _sql_extract_ctes(src, only_longest=False, fenced=True, p="x"):
    """Staged DuckDB CTEs computing ``code`` from ``t`` and ``lang`` of the
    query ``src`` (all other columns pass through). Final CTE: ``{p}9``."""
    stop = "CASE " + " ".join(
        f"WHEN lang = {_q(lg)} THEN list_reduce({_sql_list(ws)}, lambda acc, w: CASE WHEN strpos(acc, w) > 0 "
        f"THEN left(acc, strpos(acc, w) - 1) ELSE acc END, t)" for lg, ws in cd.STOP_WORDS.items()) + " ELSE t END"
    start = "CASE " + " ".join(f"WHEN lang = {_q(lg)} THEN {d}" for lg, d in cd.BRACE_START.items()) + " END"
    ctes = {
        f"{p}0": src,
        f"{p}1": f"SELECT *, {_sql_markers('t')} AS nm, string_split(t, chr(10)) AS lines FROM {p}0",
        f"{p}2": f"SELECT *, list_filter(list_transform(lines, lambda l, i: CASE WHEN {_SQL_IS_FENCE} THEN i - 1 END), lambda x: x IS NOT NULL) AS fidx FROM {p}1",
        f"{p}3": f"SELECT *, list_transform(range(0, len(fidx) // 2), lambda q: [fidx[2 * q + 1], fidx[2 * q + 2]]) AS pairs FROM {p}2",
        f"{p}4": (f"SELECT *, array_to_string(list_transform(pairs, lambda q: array_to_string(list_slice(lines, q[1] + 2, q[2]), chr(10))), chr(10) || chr(10)) AS f_all, "
                  f"pairs[list_position(list_transform(pairs, lambda q: q[2] - q[1]), list_max(list_transform(pairs, lambda q: q[2] - q[1])))] AS best FROM {p}3"),
        f"{p}5": (f"SELECT *, CASE WHEN len(pairs) > 0 THEN array_to_string(list_slice(lines, best[1] + 2, best[2]), chr(10)) ELSE '' END AS f_long, "
                  f"{stop} AS st, {start} AS start FROM {p}4"),
        f"{p}6": (f"SELECT *, string_split(st, chr(10)) AS sl, string_split(st, '}}') AS bp, "
                  f"strpos(st, 'public static void main') AS mp FROM {p}5"),
        f"{p}7": (f"SELECT *, list_position(list_transform(sl, lambda l: regexp_matches(l, {_q(cd.NONBLANK)}) AND left(l, 1) NOT IN (' ', chr(9))), true) AS pyp, "
                  f"CASE WHEN start = 0 AND st <> '' AND left(st, 1) NOT IN ('{{', '}}') THEN 1 ELSE length(array_to_string(list_slice(bp, 1, "
                  f"list_position(list_transform(range(1, len(bp)), lambda i: start + {_sql_count("array_to_string(list_slice(bp, 1, i), '}')", '{')} = i), true)), '}}')) + 1 END AS zp, "
                  f"{_sql_last_brace('(CASE WHEN mp > 0 THEN left(st, mp - 1) || ' + _q('}') + ' ELSE st END)')} AS jv FROM {p}6"),
        f"{p}8": (f"SELECT *, CASE WHEN lang = 'python' THEN (CASE WHEN pyp IS NOT NULL THEN array_to_string(list_slice(sl, 1, pyp - 1), chr(10)) ELSE st END) "
                  f"WHEN start IS NOT NULL THEN (CASE WHEN zp IS NOT NULL THEN left(st, zp) WHEN lang = 'java' THEN "
                  f"(CASE WHEN {_sql_count('jv', '{')} - 1 = {_sql_count('jv', '}')} THEN jv || chr(10) || '}}' ELSE jv END) "
                  f"ELSE {_sql_last_brace('st')} END) ELSE st END AS rlb FROM {p}7"),
        f"{p}9": (f"SELECT *, CASE WHEN nm >= 2 THEN {'f_long' if only_longest else 'f_all'} ELSE rlb END AS code FROM {p}8"
                  if fenced else f"SELECT *, rlb AS code FROM {p}8"),
    }
    return ctes


_SRC_F = "SELECT f.doc_id, f.case_id, f.txt AS t, c.lang FROM fenced_v f JOIN cases_v c ON c.case_id = f.case_id"
_SRC_B = "SELECT f.doc_id, f.case_id, f.txt AS t, c.lang FROM braced_v f JOIN cases_v c ON c.case_id = f.case_id"


@query("fence_blocks", fx.with_views("fenced_v", "cases_v", extra=_sql_extract_ctes(_SRC_F)) +
       "SELECT doc_id, code FROM x9")
def fence_blocks(spark, sf):
    d = _with_lang(fx.fenced_v(spark, sf), spark, sf)
    return d.select("doc_id", cd.extract_code(F.col("txt"), F.col("lang")).alias("code"))


@query("longest_block", fx.with_views("fenced_v", "cases_v", extra=_sql_extract_ctes(_SRC_F, True)) +
       "SELECT doc_id, code, CAST(nm AS BIGINT) AS n_markers FROM x9")
def longest_block(spark, sf):
    d = _with_lang(fx.fenced_v(spark, sf), spark, sf)
    return d.select("doc_id", cd.extract_code(F.col("txt"), F.col("lang"), True).alias("code"),
                    big(cd.marker_count(F.col("txt"))).alias("n_markers"))


@query("brace_cut", fx.with_views("braced_v", "cases_v", extra=_sql_extract_ctes(_SRC_B, fenced=False)) +
       "SELECT doc_id, lang, code FROM x9")
def brace_cut(spark, sf):
    d = _with_lang(fx.braced_v(spark, sf), spark, sf)
    return d.select("doc_id", "lang", cd.remove_last_block(F.col("txt"), F.col("lang")).alias("code"))


# Stop-word input: the response with python/go stop words planted after
# its first line, so every language path has rows that get cut.
_STOP_SPARK = lambda t: F.concat(F.substring_index(t, "\n", 1), F.lit("\nprint(x)\n// c\nfunc main() {}\n"), t)
_STOP_SQL = "split_part(r.text, chr(10), 1) || chr(10) || 'print(x)' || chr(10) || '// c' || chr(10) || 'func main() {}' || chr(10) || r.text"


@query("stopword_cut", fx.with_views("responses_v", "cases_v", extra=_sql_extract_ctes(
    f"SELECT r.doc_id, {_STOP_SQL} AS t, c.lang FROM responses_v r JOIN cases_v c ON c.case_id = r.case_id", fenced=False)) +
       "SELECT doc_id, CAST(length(st) AS BIGINT) AS n_kept FROM x9")
def stopword_cut(spark, sf):
    d = _with_lang(fx.responses_base(spark, sf), spark, sf)
    return d.select("doc_id", big(F.length(cd.stop_word_cut(_STOP_SPARK(F.col("text")), F.col("lang")))).alias("n_kept"))


_FUT_SQL_IN = "'x = 1' || chr(10) || 'from __future__ import annotations' || chr(10) || f.txt || chr(10) || 'from __future__ import division'"


@query("future_hoist", fx.with_views("fenced_v") + "SELECT f.doc_id, array_to_string(list_concat(list_filter(string_split(" + _FUT_SQL_IN +
       ", chr(10)), lambda l: starts_with(l, 'from __future__')), list_filter(string_split(" + _FUT_SQL_IN +
       ", chr(10)), lambda l: NOT starts_with(l, 'from __future__'))), chr(10)) AS program FROM fenced_v f")
def future_hoist(spark, sf):
    d = fx.fenced_v(spark, sf)
    src = F.concat(F.lit("x = 1\nfrom __future__ import annotations\n"), F.col("txt"),
                   F.lit("\nfrom __future__ import division"))
    return d.select("doc_id", cd.hoist_future(src).alias("program"))


def _sql_strip(x):
    return f"regexp_replace({x}, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')"


def _sql_header(code, lang):
    out = code
    for lg, lines in cd.IMPORT_HEADER.items():
        h = _sql_strip(f"{_sql_lit(chr(10).join(lines) + chr(10))} || {code}")
        if lg == "python":
            h = (f"array_to_string(list_concat(list_filter(string_split({h}, chr(10)), lambda l: starts_with(l, 'from __future__')), "
                 f"list_filter(string_split({h}, chr(10)), lambda l: NOT starts_with(l, 'from __future__'))), chr(10))")
        out = f"CASE WHEN {lang} = {_q(lg)} THEN {h} ELSE {out} END"
    return out


# Check programs for the fenced responses: test prefix 'def f(x):', no file
# prefix, test = 'assert f(<case_id>)'.
_CP_SRC = ("SELECT f.doc_id, f.case_id, 'def f(x):' || chr(10) || f.txt AS t, c.lang "
           "FROM fenced_v f JOIN cases_v c ON c.case_id = f.case_id")


@query("check_program", fx.with_views("fenced_v", "cases_v", extra={
    **_sql_extract_ctes(_CP_SRC),
    "cp": "SELECT doc_id, case_id, lang, chr(10) || code AS code FROM x9"}) +
       "SELECT doc_id, " + _sql_header("code", "lang") + " || chr(10) || 'assert f(' || case_id || ')' AS program FROM cp")
def check_program(spark, sf):
    d = _with_lang(fx.fenced_v(spark, sf), spark, sf)
    test = F.concat(F.lit("assert f("), F.col("case_id").cast("string"), F.lit(")"))
    return d.select("doc_id", cd.check_program(F.col("txt"), F.col("lang"), test,
                                               prefix=F.lit("def f(x):")).alias("program"))


# Outcome fixture: stderr on failures, stdout always.
_OUT_SQL = ("SELECT o.case_id, o.sample_no, o.test_no, o.return_code, o.timed_out, c.lang, "
            "CASE WHEN o.return_code = 1 THEN 'Traceback: boom' ELSE '' END AS stderr, 'ok' AS stdout "
            "FROM outcomes_v o JOIN cases_v c ON c.case_id = o.case_id")
_STATUS_SQL = ("CASE WHEN timed_out THEN 'time out' WHEN lang = 'go' THEN (CASE WHEN return_code = 0 THEN 'passed' "
               "ELSE 'failed: ' || CASE WHEN stderr <> '' THEN stderr ELSE stdout END END) "
               "WHEN return_code <> 0 THEN 'failed: returncode: ' || return_code || ' ' || "
               "CASE WHEN stderr <> '' THEN 'stderr: ' || stderr WHEN stdout <> '' THEN 'stdout: ' || stdout ELSE '' END "
               "ELSE 'passed ' || CASE WHEN stderr <> '' THEN 'stderr: ' || stderr WHEN stdout <> '' THEN 'stdout: ' || stdout ELSE '' END END")
_OUT_CTES = {"oc": _OUT_SQL, "st": f"SELECT *, {_STATUS_SQL} AS status FROM oc",
             "ps": "SELECT *, starts_with(status, 'passed') AS passed FROM st"}


def _outcomes(spark, sf):
    o = _with_lang(fx.outcomes_v(spark, sf), spark, sf)
    o = o.withColumn("stderr", F.when(F.col("return_code") == 1, F.lit("Traceback: boom")).otherwise(F.lit(""))) \
         .withColumn("stdout", F.lit("ok"))
    st = oc.exec_status(F.col("return_code"), F.col("stdout"), F.col("stderr"), F.col("timed_out"), F.col("lang"))
    return o.withColumn("status", st).withColumn("passed", oc.passed(F.col("status")))


@query("exec_status", fx.with_views("outcomes_v", "cases_v", extra=_OUT_CTES) +
       "SELECT case_id, sample_no, CAST(test_no AS BIGINT) AS test_no, status, passed FROM ps")
def exec_status(spark, sf):
    return _outcomes(spark, sf).select("case_id", "sample_no", big("test_no").alias("test_no"), "status", "passed")


@query("unit_test_score", fx.with_views("outcomes_v", "cases_v", extra=_OUT_CTES) +
       "SELECT case_id, sample_no, round(sum(CASE WHEN passed THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END), 6) AS score, "
       "round(sum(CAST(1.0 AS DOUBLE)), 6) AS tot, round(avg(CASE WHEN passed THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END), 6) AS pass_rate "
       "FROM ps GROUP BY case_id, sample_no")
def unit_test_score(spark, sf):
    s = oc.unit_test_scores(_outcomes(spark, sf))
    return s.select("case_id", "sample_no", rnd("score").alias("score"), rnd("tot").alias("tot"),
                    rnd("pass_rate").alias("pass_rate"))


_PK_SQL = ("SELECT CAST(k AS BIGINT) AS k, round(avg(CASE WHEN n - c < k THEN CAST(1.0 AS DOUBLE) WHEN c = 0 THEN CAST(0.0 AS DOUBLE) ELSE 1.0 - list_reduce("
           "list_transform(range(n - c + 1, n + 1), lambda i: CAST(1.0 AS DOUBLE) - k / i), lambda a, b: a * b, CAST(1.0 AS DOUBLE)) END), 6) AS pass_at_k "
           "FROM (SELECT case_id, count(*) AS n, count(*) FILTER (WHERE passed) AS c FROM ps GROUP BY case_id) t, "
           "(VALUES " + ", ".join(f"({k})" for k in PASS_KS) + ") ks(k) GROUP BY k HAVING min(n) >= k")


@query("pass_at_k", fx.with_views("outcomes_v", "cases_v", extra=_OUT_CTES) + _PK_SQL)
def pass_at_k(spark, sf):
    p = oc.pass_at_k(_outcomes(spark, sf), PASS_KS)
    return p.select(big("k").alias("k"), rnd("pass_at_k").alias("pass_at_k"))
