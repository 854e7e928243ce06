"""Golden values from the documented examples and published numbers."""

import math

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from gradewise.functions import code as cd
from gradewise.functions.lcs import lcs_length, union_lcs_hits
from gradewise.operators import outcomes as oc
from gradewise.operators import reduce as rd
from gradewise.operators import rouge as rg


def test_bucket_mean_std_published(spark):
    # Three best-of-10 bucket totals of one run -> 82.39 +- 1.88 (of 135).
    for vals, mean, std in [((80.49660549928024, 84.25483084597717, 82.42070024848911), 82.39, 1.88),
                            ((62.23807707366633, 61.832625454308975, 64.06869518783614), 62.71, 1.19)]:
        df = spark.createDataFrame([("m", 0, i * 10, v) for i, v in enumerate(vals)],
                                   "model string, case_id int, sample_no int, now double")
        r = rd.reduce_samples(df, "avg_max_10").collect()[0]
        assert round(r.now_score, 2) == mean and round(r.now_std, 2) == std
        assert round(100 * r.now_score / 135, 2) == round(100 * mean / 135, 2)


def test_avg_max_2(spark):
    df = spark.createDataFrame([("m", 0, i, float(v)) for i, v in enumerate([0, 1, 0, 0, 1])],
                               "model string, case_id int, sample_no int, now double")
    r = rd.reduce_samples(df, "avg_max_2").collect()[0]
    assert math.isclose(r.now_score, 2 / 3) and math.isclose(r.now_std, 0.5773502691896257)
    assert r.n_buckets == 3


def test_single_bucket_std_zero(spark):
    df = spark.createDataFrame([("m", 0, 0, 0.5)], "model string, case_id int, sample_no int, now double")
    assert rd.reduce_samples(df, "avg_max_10").collect()[0].now_std == 0.0


def test_score_clip(spark):
    s = spark.createDataFrame([("m", 0, 0, 3.0, 4.0)], "model string, case_id int, sample_no int, ans double, tot double")
    c = spark.createDataFrame([(0, 1.0, 2.0, None)], "case_id int, full_score double, max_score double, min_score double")
    r = rd.clip_normalise(s, c).collect()[0]
    assert r.tot == 2.0 and r.now == 1.0


@pytest.mark.parametrize("outcomes,k,expected", [
    ([False, True], 1, 0.5), ([False, True], 2, 1.0), ([True], 1, 1.0), ([False], 1, 0.0)])
def test_pass_at_k_examples(spark, outcomes, k, expected):
    df = spark.createDataFrame([(0, p) for p in outcomes], "case_id int, passed boolean")
    r = {x.k: x.pass_at_k for x in oc.pass_at_k(df, (k,)).collect()}
    assert math.isclose(r[k], expected)


def test_pass_at_k_formula(spark):
    df = spark.createDataFrame([(0, i < 3) for i in range(10)], "case_id int, passed boolean")
    r = {x.k: x.pass_at_k for x in oc.pass_at_k(df, (5, 11)).collect()}
    assert math.isclose(r[5], 1 - math.comb(7, 5) / math.comb(10, 5))
    assert 11 not in r  # only k that every task has samples for


def _rouge(spark, preds, refs, types):
    resp = spark.createDataFrame([(i, 0 if isinstance(refs[i], str) else i, p) for i, p in enumerate(preds)],
                                 "doc_id int, case_id int, text string")
    resp = spark.createDataFrame([(i, i, p) for i, p in enumerate(preds)], "doc_id int, case_id int, text string")
    rows = []
    for i, r in enumerate(refs):
        for j, t in enumerate([r] if isinstance(r, str) else r):
            rows.append((i, j, t))
    ref = spark.createDataFrame(rows, "case_id int, ref_no int, text string")
    s = rg.best_over_references(rg.rouge(resp, ref, types))
    return {(x.doc_id, x.metric): x.f1 for x in s.collect()}


def test_rouge_equal_texts(spark):
    r = _rouge(spark, ["hello there", "general kenobi"], ["hello there", "general kenobi"], rg.DEFAULT_TYPES)
    assert all(math.isclose(v, 1.0) for v in r.values()) and len(r) == 8


def test_rouge_multi_reference(spark):
    r = _rouge(spark, ["hello there", "general kenobi"], [["hello", "there"], ["general kenobi", "general yoda"]],
               rg.DEFAULT_TYPES)
    mean = {m: (r[(0, m)] + r[(1, m)]) / 2 for m in rg.DEFAULT_TYPES}
    assert round(mean["rouge1"], 4) == 0.8333 and round(mean["rouge2"], 4) == 0.5
    assert round(mean["rougeL"], 4) == 0.8333 and round(mean["rougeLsum"], 4) == 0.8333


def test_rouge1_per_pair(spark):
    r = _rouge(spark, ["hello goodbye", "ankh morpork"], ["goodbye", "general kenobi"], ("rouge1",))
    # P = 1/2, R = 1/1 -> F1 = 2/3 by the F-measure definition; the second
    # pair shares no token.
    assert math.isclose(r[(0, "rouge1")], 2 / 3) and r[(1, "rouge1")] == 0.0


def _dp_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i][j] = t[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(t[i - 1][j], t[i][j - 1])
    return t[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=90), st.lists(st.sampled_from("abcde"), max_size=90))
def test_lcs_length_matches_dp(a, b):
    assert lcs_length(a, b) == _dp_lcs(a, b)


def test_union_lcs_single_sentence_equals_lcs():
    a, b = list("abcbdab"), list("bdcaba")
    assert union_lcs_hits([a], [b]) == _dp_lcs(a, b)


def _one(spark, col):
    return spark.range(1).select(col.alias("x")).collect()[0].x


def test_fence_markers_on_one_line(spark):
    # two markers but one marker line -> empty extraction
    assert _one(spark, cd.extract_code(F.lit("a ```x``` b"), F.lit("python"))) == ""


def test_unindented_python_is_cut(spark):
    assert _one(spark, cd.extract_code(F.lit("x = 1"), F.lit("python"))) == ""


def test_brace_cut(spark):
    assert _one(spark, cd.remove_last_block(F.lit("a{b}c}d"), F.lit("javascript"))) == "a{b}c}"


def test_brace_cut_looks_at_braces_only(spark):
    """Against a walk over the characters; the fold has a step per brace, not per character."""
    import random
    rnd = random.Random(4)

    def walk(text, depth):
        for i, ch in enumerate(text):
            depth += (ch == "{") - (ch == "}")
            if depth == 0:
                return text[:i + 1]
        return text[:text.rindex("}") + 1] if "}" in text else text
    rows = [("".join(rnd.choice("{}ab\né😀") for _ in range(rnd.randrange(30))), rnd.randrange(3)) for _ in range(300)]
    rows = [(t, d) for t, d in rows if t] + [("x" * 5000 + "}" + "y" * 5000, 1), ("{", 1), ("}", 1), ("ab", 0)]
    df = spark.createDataFrame(rows, "t string, d int")
    got = df.select("t", "d", cd.brace_cut(F.col("t"), F.col("d"), F.lit(False)).alias("c"))
    assert [r.c for r in got.collect()] == [walk(t, d) for t, d in rows]
    assert _one(spark, cd.brace_cut(F.lit(None).cast("string"), F.lit(1), F.lit(False))) is None
    plan = str(got._jdf.queryExecution().optimizedPlan())
    assert "(?<=[{}])" in plan and ", , -1)" not in plan  # split behind braces, nowhere into characters


def test_fenced_blocks_and_longest(spark):
    t = "intro\n```py\na\n```\nmid\n```\nb\nc\n```\n```"
    assert _one(spark, cd.extract_code(F.lit(t), F.lit("python"))) == "a\n\nb\nc"
    assert _one(spark, cd.extract_code(F.lit(t), F.lit("python"), True)) == "b\nc"


def test_exec_status(spark):
    row = spark.createDataFrame(
        [(1, "", "err", False, "python"), (0, "out", "", False, "python"), (0, "", "", True, "python"),
         (2, "o", "", False, "go"), (None, "", "", False, "python"), (None, "", "", False, "go"),
         (None, "", "", True, "go")], "rc int, so string, se string, to boolean, lang string")
    got = [r.s for r in row.select(oc.exec_status(F.col("rc"), F.col("so"), F.col("se"), F.col("to"),
                                                  F.col("lang")).alias("s")).collect()]
    assert got == ["failed: returncode: 1 stderr: err", "passed stdout: out", "time out", "failed: o",
                   "error: no return code", "error: no return code", "time out"]


def test_grader_lcs_quirk():
    from gradewise.functions.lcs import align_chars
    # the true LCS of 'ab' and 'axb' is 2; the grader's first row does not
    # carry, so its matched length is 1
    assert align_chars("ab", "axb")[0] == 1
    assert align_chars("abc", "abc") == (3, [0, 1, 2])
    assert align_chars("", "a") == align_chars("a", "") == (0, [])


def _aligned_by_definition(t, r):
    """The cell rules, cell by cell, from their definition."""
    from functools import lru_cache

    @lru_cache(None)
    def cell(i, j):  # (matched length, response place)
        same = t[i] == r[j]
        if i == 0:
            return (1, j) if same else (0, 0)
        if j == 0:
            return (int(same), 0)
        if same:
            return cell(i - 1, j - 1)[0] + 1, j
        (a, x), (b, y) = cell(i, j - 1), cell(i - 1, j)
        return (a, max(x, y)) if a == b else max((a, x), (b, y), key=lambda c: c[0])

    n, m = len(t), len(r)
    places, prefix, at = [], m - 1, None
    for i in reversed(range(n)):
        if prefix is not None:
            at = cell(i, prefix % m)[1]
        prefix = at - 1 if t[i] == r[at] else None
        places.append(at if prefix is not None else at + 1)
    return cell(n - 1, m - 1)[0], places[::-1]


def test_missing_language_and_type(spark):
    from gradewise.operators.report import by_attribute, rollup
    best = spark.createDataFrame([("m", 1, 0, 0.5), ("m", 2, 0, 1.0)], "model string, case_id int, bucket long, best double")
    scores = spark.createDataFrame([("m", 1), ("m", 2)], "model string, case_id int")
    cases = spark.createDataFrame([(1, None, "code debugging", 1.0), (2, "go", None, 1.0)],
                                  "case_id int, lang string, qtype string, full_score double")
    got = {(r.dimension, r.key): r["mean"] for r in rollup(best, scores, cases).collect()}
    assert got == {("total", "Overall"): 1.5, ("lang", "unknown"): 0.5, ("lang", "go"): 1.0,
                   ("type", "code debugging"): 0.5, ("type", "unknown"): 1.0}
    assert {r.lang for r in by_attribute(best, scores, cases, "lang").collect()} == {"unknown", "go"}


def test_fill_handler(spark):
    from gradewise.operators.blanks import fill_handler
    main, subs = "navigator.clipboard.writeText", [".select()", 'document.execCommand("copy");']
    fills = [main, main + ".select() document.execCommand(\"copy\");", '.select() document.execCommand("copy");']
    df = spark.createDataFrame([(f,) for f in fills], "fill string")
    sc, tot = fill_handler(F.col("fill"), main, subs)
    got = [(r.s, r.t) for r in df.select(sc.alias("s"), tot.alias("t")).collect()]
    assert got == [(2.0, 2.0), (2.0, 2.0), (1.0, 2.0)]


def test_order_handler(spark):
    from gradewise.operators.hooks import order_handler
    texts = ["console.log(this.newIds)\n});", "});\nconsole.log(this.newIds)", "nothing"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    h = order_handler(F.col("t"), "console.log(this.newIds)", "});")
    assert [r.s for r in df.select(h["score"].alias("s")).collect()] == [1.0, 0.0, 0.0]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab c", min_size=1, max_size=25), st.text(alphabet="abc ", min_size=1, max_size=40))
def test_alignment_follows_its_cell_rules(t, r):
    from gradewise.functions import lcs
    want = _aligned_by_definition(t, r)
    assert lcs.align_chars(t, r) == want
    assert lcs.align_all(t, [r + "ab", r, "c", "", r[:3]])[1] == want
    kept = lcs.KEPT_BYTES
    lcs.KEPT_BYTES = 0  # rows computed anew from marks
    try:
        assert lcs.align_chars(t, r) == want
    finally:
        lcs.KEPT_BYTES = kept


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=25), st.lists(st.sampled_from("abcde"), max_size=25))
def test_lcs_positions_are_a_longest_common_subsequence(a, b):
    from gradewise.functions.lcs import lcs_length, lcs_positions
    got = lcs_positions(a, b)
    assert got == sorted(set(got)) and len(got) == lcs_length(a, b)
    rest = iter(b)
    assert all(a[i] in rest for i in got)


def test_alignment_memory_stays_bounded():
    import tracemalloc
    from gradewise.functions.lcs import align_chars
    t, r = "abc [blank] def " * 31, "xyz abc " * 16_000
    tracemalloc.start()
    matched, places = align_chars(t, r)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20 and len(places) == len(t) and 0 < matched < len(t)


def test_alignment_of_many_templates():
    """A batch of rows, a template each: 113 million cells and 300,000 places, with null
    and empty texts. Against the cell rules on the short rows."""
    import time
    import tracemalloc
    import pyarrow as pa
    from gradewise.functions.lcs import grader_alignment_batch
    words = ["alpha ", "beta ", "[blank] ", "x", "g. "]
    t = [(f"{i} " + "".join(words[(i + k * k + k * i) % 5] for k in range(65)))[:250] for i in range(300)]
    r = [("".join(words[(i * 3 + k * k * 7) % 5] for k in range(400)) + "z" * 1500)[:1500] for i in range(300)]
    small = [("ab", "axb"), ("abc", "abc"), (None, "a"), ("a", None), ("", "a"), ("a", ""), ("a b", "b a b"), ("aaa", "ab")]
    templates = pa.array(t + [x for x, _ in small] + ["use [blank]."] * 1000)
    responses = pa.array(r + [x for _, x in small] + ["use it."] * 1000)
    start = time.process_time()
    got = grader_alignment_batch(templates, responses)
    assert time.process_time() - start < 4  # 10.8 s when each template was aligned by itself
    tracemalloc.start()
    grader_alignment_batch(templates.slice(300), responses.slice(300))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20
    for (x, y), z in zip(small, got.slice(300).to_pylist()):
        if x is None or y is None:
            assert z["spans"] is None and z["matched"] == 0
        else:
            assert (z["matched"], z["spans"]) == (_aligned_by_definition(x, y) if x and y else (0, []))
    assert got[-1].as_py()["spans"] == _aligned_by_definition("use [blank].", "use it.")[1]


def _by_places(texts):
    """The kernel that holds a place for every cell, for one pair at a time."""
    from gradewise.functions import lcs
    out = []
    for t, r in texts:
        matched, places = lcs._Group([lcs._codes(t)], [lcs._codes(r)]).align()
        out.append((int(matched[0]), places[0][:len(t)].tolist()))
    return out


def test_alignment_by_signs(monkeypatch):
    """Signs of neighbours give the places of the cell rules, whole and in blocks, long responses and short ones
    together, and where too many ties leave a row to the cells' places."""
    import random
    from gradewise.functions import lcs
    rand = random.Random(3)
    pick = lambda letters, n: "".join(rand.choices(letters, k=n))
    tied = lcs._Signs([("abcdefgh" * 20, "xyz" * 400), ("ab", "aab")], []).align()[1]
    assert tied[0] is None and tied[1] == _by_places([("ab", "aab")])[0][1]
    for room, long in ((lcs.SIGN_BYTES, lcs.LONG), (0, 30), (3000, 30)):
        monkeypatch.setattr(lcs, "SIGN_BYTES", room)
        monkeypatch.setattr(lcs, "LONG", long)
        for letters in ("a", "ab", "abc", "abcdefgh"):
            t = pick(letters, rand.randint(1, 40))
            r = [pick(letters + "xyz"[:rand.randint(0, 3)], rand.randint(1, 90)) for _ in range(8)] + [t + "zz", "xyz" * 150]
            assert lcs.align_all(t, r) == _by_places([(t, x) for x in r])


def test_alignment_of_a_long_response_by_bits():
    """A row's cells are worked on together: a long response takes a small part of the time of the kernel that holds
    every cell's place, and far less than a byte a cell (9.6 million cells)."""
    import random
    import time
    import tracemalloc
    from gradewise.functions import lcs
    rand = random.Random(7)
    t = "".join(rand.choices("etaoin shrdlu", k=240))
    r = "".join(rand.choices("etaoin shrdlu.", k=40_000))
    start = time.process_time()
    got = lcs.align_chars(t, r)
    middle = time.process_time()
    want = _by_places([(t, r)])[0]
    assert 5 * (middle - start) < time.process_time() - middle
    assert got == want
    tracemalloc.start()
    lcs.align_chars(t, r)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 << 20


def test_alignment_by_signs_takes_less_time():
    import random
    import time
    import pyarrow as pa
    from gradewise.functions import lcs
    rand = random.Random(5)
    words = ["".join(rand.choices("etaoinshrdlu", k=rand.randint(2, 8))) for _ in range(200)]
    refs = [" ".join(rand.choices(words, k=40)) for _ in range(100)]
    t = [f"Use [blank] with {x} done." for x in refs]
    r = [f"Use it with {x} done.\n" + " ".join(rand.choices(words, k=400)) for x in refs]
    t, r = zip(*sorted(zip(t, r), key=lambda x: -len(x[0] + x[1])))
    start = time.process_time()
    got = lcs.grader_alignment_batch(pa.array(t), pa.array(r))
    middle = time.process_time()
    some = lcs._columns(max(map(len, t)), max(map(len, t)) + max(map(len, r)))
    want, at = [], 0
    while at < 100:
        matched, places = lcs._Group([lcs._codes(x) for x in t[at:at + some]], [lcs._codes(x) for x in r[at:at + some]]).align()
        want += [(int(m), p[:len(x)].tolist()) for m, p, x in zip(matched, places, t[at:at + some])]
        at += some
    assert middle - start < time.process_time() - middle
    assert [(x["matched"], x["spans"]) for x in got.to_pylist()] == want


def test_alignment_of_many_pairs_by_words(monkeypatch):
    """Pairs side by side in 64-bit words: the places of the cell rules, whatever the lengths (a response that ends at a word's
    end among them), in one run and in many, as a pair at a time."""
    import random
    import pyarrow as pa
    from gradewise.functions import lcs
    rand = random.Random(11)
    pick = lambda letters, n: "".join(rand.choices(letters, k=n))
    lengths = [1, 2, 62, 63, 64, 65, 126, 127, 128, 129, 191, 192, 300]
    for letters, run in (("a", 40), ("ab", 3), ("abc ", 10_000), ("abcdefgh\u00e9\U0001f600", 20)):
        texts = [(pick(letters, rand.randint(1, 50)), pick(letters + "xyz"[:rand.randint(0, 3)], m)) for m in lengths * 2]
        texts += [(texts[5][0], texts[5][0] + "zz"), ("abcdefgh" * 3, "xyz" * 150)]
        want = _by_places(texts)
        monkeypatch.setattr(lcs, "FEW_WORDS", 0)
        monkeypatch.setattr(lcs, "RUN_WORDS", run)
        got = lcs.grader_alignment_batch(*(pa.array(x) for x in zip(*texts))).to_pylist()
        assert [(x["matched"], x["spans"]) for x in got] == want
    monkeypatch.undo()
    words = [pick("etaoinshrdlu", rand.randint(2, 8)) for _ in range(200)]
    t = [f"Use [blank] with {' '.join(rand.choices(words, k=40))} done." for _ in range(300)]
    r = [x + " ".join(rand.choices(words, k=600)) for x in t]
    got = lcs.grader_alignment_batch(pa.array(t), pa.array(r))
    monkeypatch.setattr(lcs, "FEW_WORDS", 1 << 60)
    assert got == lcs.grader_alignment_batch(pa.array(t), pa.array(r))


def test_conditions():
    from gradewise.functions.keywords import normalise_cond
    for text in ("context[-1].startswith('match')", 'context[-1].startswith("match")', "grading_details[-1] == 'match'",
                 " context[ -1 ]=='match' ", "prev_match"):
        assert normalise_cond(text) == "prev_match", text
    for text in ("context[-1].startswith('unmatch')", 'grading_details[-1].startswith("unmatch")', "prev_unmatch"):
        assert normalise_cond(text) == "prev_unmatch", text
    for text in ("True", "context[-1] == 'x'", "context[-2].startswith('match')", "context[-1] != 'match'", "",
                 "not context[-1].startswith('match')", "context[-1].startswith('match') or True"):
        assert normalise_cond(text) == "invalid", text
    assert normalise_cond(None) is None


def test_conditional_rules_from_text(spark):
    from gradewise.operators.keywords import keyword_scores
    resp = spark.createDataFrame([(1, "m", 0, "has a and b"), (2, "m", 0, "only b"), (3, "m", 1, "has a")],
                                 "sample_no int, model string, case_id int, text string")
    rules = spark.createDataFrame(
        [(0, 0, "a", None), (0, 1, "b", "context[-1].startswith('match')"), (0, 2, "b", 'context[-1].startswith("unmatch")'),
         (1, 0, "a", None), (1, 1, "a", "len(context) > 1")], "case_id int, rule_no int, pattern string, cond string")
    got = {r.sample_no: (r.score, r.statuses, r.error) for r in keyword_scores(resp, rules).collect()}
    assert got[1] == (2.0, ["match", "match", "unmatch"], None)
    assert got[2] == (1.0, ["unmatch", "unmatch", "match"], None)
    assert got[3] == (None, None, "unsupported rule condition")


def test_missing_samples(spark):
    from gradewise.operators.requests import missing_samples, to_resume
    cases = spark.createDataFrame([("a",), ("b",), ("c",)], "case_id string")
    have = spark.createDataFrame([("a", 0), ("a", 2), ("b", 0), ("b", 1), ("b", 2), ("b", 2), ("c", 4), ("c", 5), ("c", 6)],
                                 "case_id string, sample_no int")
    got = sorted((r.case_id, r.sample_no) for r in missing_samples(cases, have, 3).collect())
    assert got == [("a", 1), ("c", 0), ("c", 1), ("c", 2)]
    assert sorted(r.case_id for r in to_resume(cases, have, 3).collect()) == ["a", "c"]


def test_whole_text_alignment_query(spark, tmp_path):
    """The query over whole texts against the cell rules on a small table."""
    from gradewise.plans.catalog import QUERIES
    words = ["Use", "with", "done.", "alpha", "beta", "[", "x"]
    spark.createDataFrame([(i, " ".join(words[(i * 3 + k) % 7] for k in range(12))) for i in range(3)],
                          "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, " ".join(words[(i + k * k) % 7] for k in range(i % 9)), "en", f"src{i}", 1) for i in range(12)],
                          "doc_id long, text string, lang string, source string, n_chars long"
                          ).write.parquet(f"{tmp_path}/documents.parquet")
    refs = {r.item_id: r.text for r in spark.read.parquet(f"{tmp_path}/benchmark.parquet").collect()}
    got = {r.doc_id: (r.matched_len, r.fill) for r in QUERIES["blank_align_text"](spark, str(tmp_path)).collect()}
    for d in spark.read.parquet(f"{tmp_path}/documents.parquet").collect():
        ref = refs[d.doc_id % 3]
        response = f'Use "{ref.split(" ")[1]}" with {ref} done.' + ("\n" + d.text if d.doc_id % 2 else "")
        matched, at = _aligned_by_definition(f"Use [blank] with {ref} done.", response)
        assert got[d.doc_id] == (matched, response[at[3] + 1:max(at[11], at[3] + 1)].strip(" '\"`"))


def test_by_metric_negative_last_bucket(spark):
    from gradewise.operators.report import by_metric
    scores = spark.createDataFrame([("m", "a", 0, "kw", 2.0, 4.0), ("m", "a", 1, "kw", 1.0, 4.0),
                                    ("m", "a", 2, "kw", -3.0, 4.0), ("m", "a", 3, "kw", -1.0, 4.0)],
                                   "model string, case_id string, sample_no int, metric string, score double, tot double")
    cases = spark.createDataFrame([("a", 1.0, None)], "case_id string, full_score double, max_score double")
    r = by_metric(scores, cases, 2).collect()
    assert [(x.mean, x.n_buckets, x.full_total, x.freq) for x in r] == [((0.5 - 0.25) / 2, 2, 1.0, 1)]
    assert by_metric(scores, cases, 2, negatives=False).isEmpty()


def test_whole_text_blank_queries(spark, tmp_path):
    """Alignment, gate, matches, score and post-handler over the whole text of
    every id, against the cell rules."""
    import re
    from gradewise.plans.catalog import QUERIES
    words = ["Use", "with", "done.", "alpha", "beta", "[", "an x"]
    spark.createDataFrame([(i, " ".join(words[(i * 3 + k) % 7] for k in range(12))) for i in range(3)],
                          "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, None if i == 10 else " ".join(words[(i + k * k) % 7] for k in range(i % 9)), "en", f"src{i}", 1)
                           for i in range(12)], "doc_id long, text string, lang string, source string, n_chars long"
                          ).write.parquet(f"{tmp_path}/documents.parquet")
    refs = {r.item_id: r.text for r in spark.read.parquet(f"{tmp_path}/benchmark.parquet").collect()}
    want = {n: {} for n in ("blank_align_lcs_text", "blank_rate_gate_text", "blank_match_exact_text", "blank_match_regex_text",
                            "blank_score_text", "fill_post_handler_text")}
    for d in spark.read.parquet(f"{tmp_path}/documents.parquet").collect():
        ref = refs[d.doc_id % 3]
        word, template = ref.split(" ")[1], f"Use [blank] with {ref} done."
        response = f'Use "{word}" with {ref} done.\n{d.text or ""}'
        matched, at = _aligned_by_definition(template, response)
        fill = response[at[3] + 1:max(at[11], at[3] + 1)].strip(" '\"`")
        rate = matched / (len(template) - len("[blank]"))
        good = rate >= 0.8
        rx = re.sub("[^A-Za-z]", "", word)[:2].lower() + '[^"]*'
        points = min(2.0 * ("e" in fill) + ("a" in fill and "n" in fill), 2.0)
        row = [(matched, 1, fill), (round(rate, 6), good), (fill, good and fill == word),
               (good and re.fullmatch(rx, fill.lower()) is not None,),
               (d.doc_id % 3, 2.0 * (good and fill == word), 2.0), (points, 2.0)]
        for name, value in zip(want, row):
            want[name][d.doc_id] = value
    for name, rows in want.items():
        assert {r[0]: tuple(r)[1:] for r in QUERIES[name](spark, str(tmp_path)).collect()} == rows, name
    assert len({v[0] for v in want["blank_align_lcs_text"].values()}) > 1


def test_blank_scores_details(spark):
    from gradewise.operators.blanks import blank_scores
    tpl = spark.createDataFrame([(0, "x = [blank];")], "case_id int, template string")
    resp = spark.createDataFrame([(1, 0, "x = 42;"), (2, 0, "x = 7;"), (3, 0, "totally different text")],
                                 "doc_id int, case_id int, response string")
    tg = spark.createDataFrame([(0, 0, 1.0, False, False, [("41", False, None), ("4[0-9]", True, None)])],
                               "case_id int, target_no int, weight double, to_lower boolean, substr_match boolean, "
                               "alternatives array<struct<pattern string, is_regex boolean, cond string>>")
    got = {r.doc_id: (r.score, r.fills, r.details) for r in blank_scores(resp, tpl, tg).collect()}
    assert got[1] == (1.0, ["42"], ["matched: response string: 42, ans: 4[0-9]"])
    assert got[2] == (0.0, ["7"], ["unmatched: response string: 7, ans: 4[0-9]"])
    assert got[3][0] == 0.0 and got[3][2][0].startswith("unmatched: match rate too low - ")


def test_post_handler_and_corpus_mean(spark):
    from gradewise.operators.hooks import apply_post_handler, require_all
    df = spark.createDataFrame([(2.0, 3.0, ["match", "match"]), (1.0, 3.0, ["match", "unmatch"])],
                               "score double, tot double, statuses array<string>")
    got = [(r.score, r.tot, r.post_handler_detail) for r in apply_post_handler(df, require_all).collect()]
    assert got == [(3.0, 3.0, "all matched"), (0.0, 3.0, "missing keywords")]
    s = spark.createDataFrame([("rouge1", 0.5), ("rouge1", 0.0)], "metric string, f1 double")
    assert rg.corpus_scores(s).first().f1 == 0.25
    assert _one(spark, oc.preview(F.lit("x" * 50))) == "x" * 40


def test_weighted_totals(spark):
    cs = spark.createDataFrame([("m", 0, 0.5), ("m", 1, 1.0)], "model string, case_id int, now_score double")
    c = spark.createDataFrame([(0, 1.0, 2.0), (1, 1.0, None)], "case_id int, full_score double, case_weight double")
    r = rd.weighted_totals(cs, c).first()
    assert (r.weighted_score, r.weighted_full) == (2.0, 3.0)
