"""Near duplicates against all pairs; sketch concentration."""

import random

import numpy as np
from pyspark.sql import functions as F

from gradewise.llm import near_dup as nd
from gradewise.llm.components import connected_components

SCHEMA = "doc_id long, text string, node int, cls string, n int"


def plain_set(text):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def brute(rows):
    sets = [plain_set(r[1]) for r in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(sets[i]), least.get(find(i))) for i, r in enumerate(rows)), key=str)


def edited(rnd, words, share):
    return [w if rnd.random() > share else f"e{rnd.randrange(10 ** 6)}" for w in words]


def corpus(seed):
    rnd = random.Random(seed)
    texts = []
    for _ in range(12):
        base = [f"w{rnd.randrange(3000)}" for _ in range(rnd.choice([6, 30, 120, 400]))]
        texts.append(base)
        for _ in range(rnd.choice([1, 3, 25])):
            texts.append(edited(rnd, base, rnd.choice([0, 0.01, 0.03, 0.06])))
        chain = base
        for _ in range(4):
            chain = edited(rnd, chain, 0.02)
            texts.append(chain)
        texts.append(base[:len(base) * 4 // 5])
    out = [" ".join(t) for t in texts] + ["", None, "  \n", "one", "ONE", "one two", "a b c d e", "A b c d E", "É x", "é x"]
    out += [out[0]] * 5 + [out[3].upper()]
    ids = rnd.sample(range(10 ** 6), len(out))
    return [(i, t, 1, "c", 2) for i, t in zip(ids, out)]


def test_against_all_pairs(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        got = nd.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_big_group_of_near_copies(spark):
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(3000)}" for _ in range(150)]
    rows = [(i, " ".join(edited(rnd, base, rnd.choice([0.005, 0.02, 0.03, 0.06]))), 0, "", 0) for i in range(400)]
    got = nd.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)


def test_near_misses_make_few_pairs(spark):
    """A bucket of near misses: parity bits leave every link and few other pairs of the 4,950."""
    rng = np.random.default_rng(4)
    base = rng.integers(-1 << 63, 1 << 63, 150)
    sets = [set(base[rng.random(150) > rng.choice([0.02, 0.3])].tolist()) | set(rng.integers(0, 1 << 63, 5).tolist())
            for _ in range(100)]
    rows = spark.createDataFrame([(i, x) for i, s in enumerate(sets) for x in s], "node long, s long")
    bands = rows.groupBy("node").agg(nd._parity("s").alias("parity"), F.count("*").alias("whole")).withColumn(
        "bands", F.array(F.lit(7).cast("long")))
    ranked = bands.select("node", F.col("whole").alias("n"), F.col("whole").alias("c"), F.lit(7).alias("bucket"), F.lit(0).alias("band"),
                          F.col("node").alias("rank"), F.lit(99).alias("last"))
    reach = ranked.select("node", F.col("node").alias("comp"), "c")
    got = {(r.a, r.b) for r in nd._pairs(ranked, reach, bands, 0, 100, 75).collect()}
    links = {(i, j) for j in range(100) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert len(links) > 50 and links <= got and len(got) < len(links) + 200


def test_repeated_rows_and_null_ids(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(5, long, 0, "", 0)] * 3 + [(None, long + " end", 0, "", 0), (9, long + " more", 0, "", 0), (7, "x", 0, "", 0),
                                        (7, "y z", 0, "", 0), (None, "alone", 0, "", 0)]
    got = nd.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
    left = nd.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.text) for r in left) == [("5", long), ("7", "x"), ("7", "y z"), ("None", "alone")]
    assert {r.node for r in left} == {0}
    assert nd.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_word_repeated(spark):
    texts = ["a " * n for n in (1, 4, 5, 7, 12, 300)] + ["A a\tA a a a", "0 " * 9, "0 " * 6, "a a a a b", "a a a a a b", "b a a a a a"]
    rows = [(i, t, 0, "", 0) for i, t in enumerate(texts, 3)]
    got = nd.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
    assert {r.component_id for r in got if r.doc_id in (5, 6, 7, 8, 9)} == {5}


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    for size in (2, 20, 200, 3000):
        errors = []
        for _ in range(40):
            a = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            b = a.copy()
            cut = size // 4
            b[:cut] = rng.integers(0, 1 << 63, cut, dtype=np.uint64)
            s = nd.sketches([np.unique(a), np.unique(b)])
            assert (s != np.iinfo(np.uint64).max).all()
            errors.append(np.mean(s[0] == s[1]) - (size - cut) / (size + cut))
        assert abs(np.mean(errors)) < 0.04
    many = [np.unique(rng.integers(0, 1 << 63, k, dtype=np.uint64)) for k in (1, 3, 50, 700)]
    assert np.array_equal(nd.sketches(many), np.concatenate([nd.sketches([s]) for s in many]))


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 200), (300, 100), (7, 7)]
    got = {r.node: r.comp for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 200: 100, 300: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_driver_is_swept_in_every_round(spark, monkeypatch):
    """What the jobs of a round leave in the driver's JVM is given back before the next: shuffles that nobody
    uses any more are cleaned, and links stay whole."""
    from gradewise.llm import common
    swept, sweep = [], common.sweep
    monkeypatch.setattr(common, "sweep", lambda s: (swept.append(1), sweep(s)))
    base = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join(base[:59] + [f"x{k}"])) for k in range(12)] + [(99, "something else altogether here now")]
    got = {r.doc_id: r.component_id for r in nd.near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got.values()) == {0, 99} and got[99] == 99
    assert len(swept) >= 2
