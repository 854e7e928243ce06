"""ROUGE: sparse kernels against the full table, ROUGE-Lsum against SQL, plans."""

import random
import re

import duckdb
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from gradewise.functions.lcs import lcs_length, lcs_positions
from gradewise.operators import rouge as rg
from gradewise.plans import catalog


def table_positions(ref, pred):
    """The walk over the full table of LCS lengths."""
    n, m = len(ref), len(pred)
    t = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        for j in range(m):
            t[i + 1][j + 1] = t[i][j] + 1 if ref[i] == pred[j] else max(t[i][j + 1], t[i + 1][j])
    i, j, out = n, m, []
    while i and j:
        if ref[i - 1] == pred[j - 1]:
            i, j = i - 1, j - 1
            out.append(i)
        elif t[i][j - 1] > t[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return out[::-1], t[n][m]


@given(st.integers(1, 6).flatmap(lambda k: st.tuples(st.lists(st.integers(0, k), max_size=18), st.lists(st.integers(0, k + 3), max_size=24))))
@settings(max_examples=600, deadline=None)
def test_sparse_walk_equals_table_walk(pair):
    want, length = table_positions(*pair)
    assert lcs_positions(*pair) == want and lcs_length(*pair) == length == len(want)


LSUM_SQL = """
WITH RECURSIVE lines AS (
  SELECT doc_id, false AS is_ref, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM resp
  UNION ALL SELECT doc_id, true, unnest(string_split(ref, chr(10))), generate_subscripts(string_split(ref, chr(10)), 1) FROM resp),
sents AS (SELECT doc_id, is_ref, no, t FROM (SELECT doc_id, is_ref, no,
  list_filter(string_split(regexp_replace(lower(l), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS t FROM lines) WHERE len(t) > 0),
pairs AS (SELECT r.doc_id, r.no AS ri, p.no AS pi, r.t AS r, p.t AS p FROM sents r JOIN sents p ON p.doc_id = r.doc_id AND r.is_ref AND NOT p.is_ref),
dp AS (SELECT doc_id, ri, pi, 0 AS i, list_transform(range(0, len(p) + 1), lambda j: 0) AS row_ FROM pairs UNION ALL
  SELECT d.doc_id, d.ri, d.pi, d.i + 1, list_reduce(list_transform(range(1, len(f.p) + 1), lambda k: CASE WHEN f.p[k] = f.r[d.i + 1]
    THEN d.row_[k] + 1 ELSE d.row_[k + 1] END), lambda acc, x: list_append(acc, greatest(acc[-1], x)), [0])
  FROM dp d JOIN pairs f USING (doc_id, ri, pi) WHERE d.i < len(f.r)),
walk AS (SELECT doc_id, ri, pi, len(r) AS i, len(p) AS j, 0 AS hit FROM pairs UNION ALL
  SELECT w.doc_id, w.ri, w.pi,
    CASE WHEN f.r[w.i] = f.p[w.j] OR here.row_[w.j] <= above.row_[w.j + 1] THEN w.i - 1 ELSE w.i END,
    CASE WHEN f.r[w.i] = f.p[w.j] OR here.row_[w.j] > above.row_[w.j + 1] THEN w.j - 1 ELSE w.j END,
    CASE WHEN f.r[w.i] = f.p[w.j] THEN w.i ELSE 0 END
  FROM walk w JOIN pairs f USING (doc_id, ri, pi) JOIN dp here ON here.doc_id = w.doc_id AND here.ri = w.ri AND here.pi = w.pi AND here.i = w.i
  JOIN dp above ON above.doc_id = w.doc_id AND above.ri = w.ri AND above.pi = w.pi AND above.i = w.i - 1 WHERE w.i > 0 AND w.j > 0),
hits AS (SELECT DISTINCT doc_id, ri, hit FROM walk WHERE hit > 0),
tokens AS (SELECT s.doc_id, s.t[h.hit] AS tok, count(*) AS c FROM hits h JOIN sents s ON s.doc_id = h.doc_id AND s.no = h.ri AND s.is_ref GROUP BY ALL),
counts AS (SELECT doc_id, is_ref, tok, count(*) AS c FROM (SELECT doc_id, is_ref, unnest(t) AS tok FROM sents) GROUP BY ALL),
total AS (SELECT t.doc_id, sum(least(t.c, a.c, b.c)) AS h FROM tokens t JOIN counts a ON a.doc_id = t.doc_id AND a.tok = t.tok AND a.is_ref
  JOIN counts b ON b.doc_id = t.doc_id AND b.tok = t.tok AND NOT b.is_ref GROUP BY ALL),
size AS (SELECT doc_id, sum(CASE WHEN is_ref THEN c ELSE 0 END) AS nr, sum(CASE WHEN is_ref THEN 0 ELSE c END) AS np FROM counts GROUP BY ALL)
SELECT r.doc_id, coalesce(t.h / greatest(s.np, 1), 0) AS p, coalesce(t.h / greatest(s.nr, 1), 0) AS r
FROM resp r LEFT JOIN size s USING (doc_id) LEFT JOIN total t USING (doc_id)"""


def test_rouge_lsum_against_recursive_sql(spark):
    rnd = random.Random(7)
    words = "the a of cat dog sat mat on ran far".split()

    def text(lines, n):
        return "\n".join(" ".join(rnd.choice(words) for _ in range(rnd.randrange(n))) for _ in range(rnd.randrange(1, lines + 1)))
    rows = [(i, i % 7, text(4, 14), text(3, 10)) for i in range(120)] + [(900, 1, "", "the cat"), (901, 2, "the cat", ""), (902, 3, "!?", "\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, case_id long, text string, ref string")
    refs = df.select(F.col("doc_id").alias("case_id"), F.lit(0).alias("ref_no"), F.col("ref").alias("text"))
    got = {r.doc_id: (r.precision, r.recall) for r in
           rg.rouge_lsum(df.select("doc_id", F.col("doc_id").alias("case_id"), "text"), refs).collect()}
    con = duckdb.connect()
    con.register("resp", df.drop("case_id").toPandas())
    want = {d: (p, r) for d, p, r in con.execute(LSUM_SQL).fetchall()}
    assert set(got) == set(want) == {r[0] for r in rows}
    for d, (p, r) in want.items():
        assert abs(got[d][0] - p) < 1e-12 and abs(got[d][1] - r) < 1e-12, d


def test_counts_of_long_and_repeated_grams(spark):
    df = spark.createDataFrame([(1, 1, "a b a b a b c " * 300), (2, 1, ""), (3, 1, None), (4, 2, "z")], "doc_id long, case_id long, text string")
    refs = spark.createDataFrame([(1, 0, "a b a b x y " * 50), (1, 1, "c"), (2, 0, "q")], "case_id long, ref_no int, text string")
    got = {(r.doc_id, r.ref_no, r.metric): (r.precision, r.recall) for r in rg.rouge(df, refs, ("rouge1", "rouge2", "rouge3", "rougeL")).collect()}
    assert got[(1, 0, "rouge1")] == (200 / 2100, 200 / 300) and got[(1, 1, "rouge1")] == (1 / 2100, 1.0)
    assert got[(1, 0, "rouge2")] == (150 / 2099, 150 / 299) and got[(1, 1, "rouge2")] == (0.0, 0.0)
    assert all(v == (0.0, 0.0) for (d, _, _), v in got.items() if d != 1) and len(got) == 4 * (2 * 3 + 1)
    best = {(r.doc_id, r.metric): (r.precision, r.n_refs) for r in rg.best_scores(df, refs, ("rouge1",)).collect()}
    assert best[(1, "rouge1")] == (200 / 2100, 2) and best[(4, "rouge1")] == (0.0, 1)


def test_references_are_the_built_side(spark):
    """At both thresholds the packed references are broadcast, and neither a text nor a
    token array passes an exchange, the dealing of small scans aside."""
    sf = "/root/testdata/sf0.1"
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for threshold in ("10m", "1m"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            for name in ("rouge1", "rouge2", "rougeL", "rougeLsum", "rouge_multi_ref", "rouge_normalised_score"):
                qe = catalog.QUERIES[name](spark, sf)._jdf.queryExecution()
                plan = qe.executedPlan().toString()
                assert "SortMergeJoin" not in plan and "BuildLeft" not in plan and "BuildRight" in plan, (name, threshold)
                for node in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan):
                    assert "text" not in node
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
