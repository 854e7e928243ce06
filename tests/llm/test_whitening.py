"""Refined eigenvectors against high-precision ones; whitening against a plain
version with exact integers."""

from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from gradewise.llm import eigen, whitening as wh

SCHEMA = "vec_id long, embedding array<float>, x string, n int, component string"


def residual(a, values, x):
    big = a.astype(np.longdouble)
    return float(np.abs(big @ x - x * values).max() / np.abs(a).max()), float(np.abs(x.T.astype(np.longdouble) @ x - np.eye(len(a))).max())


@pytest.mark.parametrize("spectrum", [
    np.linspace(1, 100, 40), np.r_[np.ones(10), 1 + 1e-9 * np.arange(10), np.linspace(2, 3, 20)],
    np.r_[5 + 1e-6 * np.arange(5), 5 + 1e-13 * np.arange(5), 1e-8 * np.arange(5)], np.ones(12), np.zeros(4), np.array([3.0]),
    10.0 ** -np.arange(15)])
def test_eigenvectors_reach_double_precision(spectrum):
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.normal(size=(len(spectrum),) * 2))
    a = (q * spectrum) @ q.T
    a = (a + a.T) / 2
    values, x = eigen.eigenvectors(a)
    error, turned = residual(a, values, x) if np.abs(a).max() else (0, 0)
    assert error < 2e-15 and turned < 2e-15
    assert np.all(np.diff(values) <= 1e-15 * max(1, np.abs(a).max()))
    assert np.allclose(values, np.sort(np.linalg.eigvalsh(a))[::-1], rtol=0, atol=1e-13 * max(1, np.abs(a).max()))


def test_single_precision_start_is_corrected_and_clusters_are_solved():
    rng = np.random.default_rng(5)
    q, _ = np.linalg.qr(rng.normal(size=(30, 30)))
    a = (q * np.r_[np.linspace(1, 2, 20), 7 + 1e-9 * np.arange(10)]) @ q.T
    a = (a + a.T) / 2
    _, start = np.linalg.eigh(a.astype(np.float32))
    before = np.abs(np.tril(start.T.astype(float) @ a @ start, -1)).max()
    values, x = eigen.refine(a, start)
    assert before > 1e-8 and np.abs(np.tril(x.T @ a @ x, -1)).max() < 1e-14
    assert [sorted(g) for g in eigen.clusters(np.array([1.0, 5.0, 1.1, 9.0, 5.05]), 0.2)] == [[0, 2], [1, 4]]


def plain(rows, components=16):
    good = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) and abs(c) < 2**48 for c in v)]
    if not good:
        return []
    lengths = Counter(len(v) for _, v in good)
    d = max(lengths, key=lambda k: (lengths[k], k))
    good = [(i, [int(np.floor(64 * np.float64(np.float32(c)))) + 1000000 for c in v]) for i, v in good if len(v) == d]
    fit = sorted({tuple(x) for _, x in good})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    cov = [[Fraction(sum((n * x[a] - s[a]) * (n * x[b] - s[b]) for x in fit), n ** 3) for b in range(d)] for a in range(d)]
    v = np.array([[float(c) for c in r] for r in cov])
    e, basis = np.linalg.eigh(v)
    e, basis = e[::-1], basis[:, ::-1]
    out = []
    for i, x in good:
        dev = sum((n * c - t) ** 2 for c, t in zip(x, s))
        centred = np.array([float(Fraction(n * c - t, n)) for c, t in zip(x, s)])
        for k in range(min(components, d)):
            if e[k] > 1e-12 * e[0]:
                out.append((i, k + 1, n, dev, float(centred @ basis[:, k] / np.sqrt(e[k])), float(e[k] / np.trace(v))))
    return out


def check(spark, rows, partitions=3):
    df = spark.createDataFrame([(i, v, "clash", 1, "clash") for i, v in rows], SCHEMA).repartition(partitions)
    got = wh.whiten(df).collect()
    want = plain(rows)
    assert len(got) == len(want)

    def key(r):
        return (r[0] is not None, r[0] or 0, r[3], r[1])
    signs = {}
    for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
        assert (g.vec_id, g.component, g.n, int(g.deviation)) == w[:4]
        assert abs(abs(g.whitened) - abs(w[4])) < 1e-9 and abs(g.explained - w[5]) < 1e-12 and g.identity_error < 1e-9
        if abs(w[4]) > 1e-6:
            assert signs.setdefault(g.component, g.whitened * w[4] > 0) == (g.whitened * w[4] > 0)
    return got


def test_against_plain_version(spark):
    rng = np.random.default_rng(1)
    base = [[float(c) for c in rng.normal(size=20) * np.arange(1, 21) / 9] for _ in range(60)]
    nan, inf = float("nan"), float("inf")
    rows = list(enumerate(base)) + [(7, base[3]), (None, base[5]), (900, base[3])] + [(500 + i, base[0]) for i in range(40)]
    rows += [(100, None), (101, []), (102, [None, *base[0][1:]]), (103, [nan, *base[0][1:]]), (104, [inf, *base[0][1:]]),
             (105, base[0][:5]), (106, [1e30, *base[0][1:]])]
    got = check(spark, rows)
    assert len(got) == 103 * 16 and {r.n for r in got} == {60}


def test_few_vectors_and_no_variance(spark):
    assert check(spark, [(1, [1.0, 2.0, 3.0]), (2, [2.0, 2.0, 3.0]), (3, [2.0, 4.0, 3.0])])[0].n == 3
    assert check(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    assert check(spark, [(1, None)]) == [] == check(spark, [])


def test_tree_of_sums_and_long_numbers(spark, monkeypatch):
    monkeypatch.setattr(wh, "FAN_IN", 2)
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=4) * [1e9, 1.0, 1e5, 3.0]]) for i in range(50)]
    df = spark.createDataFrame([(i, v, "", 1, "") for i, v in rows], SCHEMA)
    got = {(r.vec_id, r.component): r for r in wh.whiten(df).collect()}
    for w in plain(rows):
        g = got[w[:2]]
        assert int(g.deviation) == w[3] and abs(abs(g.whitened) - abs(w[4])) < 1e-6


def test_query_on_the_small_table(spark, sf_small):
    from gradewise.llm import common
    rows = [(r.vec_id, r.embedding) for r in common.table(spark, sf_small, "embeddings").collect()]
    want = {(w[0], w[1]): w for w in plain(rows)}
    got = wh.op12_refined_whitening(spark, sf_small).collect()
    assert len(got) == len(want)
    for g in got:
        w = want[(g.vec_id, g.component)]
        assert (g.n, g.deviation) == (w[2], w[3]) and abs(abs(g.whitened) - abs(w[4])) < 1e-8 and g.identity_error < 1e-9
