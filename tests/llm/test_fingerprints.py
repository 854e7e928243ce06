"""Edits and order against plain Python; collision rate against the exact
generalised Jaccard similarity."""

import hashlib
import random
from collections import Counter

import numpy as np

from gradewise.llm import fingerprints as fp

SCHEMA = "doc_id long, text string, range int, copy string"


def plain_terms(text):
    words = ["<"] + (text or "").encode().lower().decode("utf-8", "replace").split() + [">"]
    return Counter(zip(words, words[1:])) if len(words) > 2 else Counter()


def jaccard(a, b):
    keys = set(a) | set(b)
    return sum(min(a[k], b[k]) for k in keys) / max(1, sum(max(a[k], b[k]) for k in keys))


def test_collision_rate_is_generalised_jaccard():
    rnd = random.Random(2)
    errors = []
    for _ in range(60):
        base = [rnd.choice("abcdefghij") * rnd.randrange(1, 4) for _ in range(rnd.randrange(3, 120))]
        other = [w if rnd.random() < 0.8 else "zz" + w for w in base] + ["tail"] * rnd.randrange(5)
        a, b = " ".join(base), " ".join(other)
        got = fp.likeness(fp.signature(*fp.terms(a), 1024), fp.signature(*fp.terms(b), 1024))
        errors.append(got - jaccard(plain_terms(a), plain_terms(b)))
    assert abs(np.mean(errors)) < 0.01 and np.max(np.abs(errors)) < 0.08


def test_blocks_do_not_matter(monkeypatch):
    text = " ".join(f"w{i % 700} the" for i in range(4000))
    whole = fp.signature(*fp.terms(text))
    monkeypatch.setattr(fp, "TERM_BLOCK", 37)
    assert np.array_equal(whole, fp.signature(*fp.terms(text)))


def check(spark, rows, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = fp.fingerprint_edits(spark.createDataFrame(rows, SCHEMA)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    order = sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for k, (i, text) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        m = len(text) // 2
        edited = text[:len(text) - m] + nxt[:m]
        sig = [fp.signature(*fp.terms(x)) for x in (text, edited, nxt)]
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), fp.to_text(sig[0]), fp.to_text(sig[1]),
                     fp.likeness(sig[0], sig[1]), fp.likeness(sig[0], sig[2])))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_edits_against_plain(spark):
    rnd = random.Random(5)
    rows = [(i * 7 - 90, " ".join(rnd.choice(["alpha", "Ünï", "日本", "x"]) for _ in range(rnd.randrange(60))), 3, "c")
            for i in range(80)]
    rows += [(None, "no id", 1, "c"), (1000, None, 1, "c"), (1001, "", 1, "c"), (1001, "a", 1, "c"), (1001, "a", 1, "c"),
             (1002, "very long " * 3000, 1, "c")]
    rnd.shuffle(rows)
    for partitions in (1, 4, 40):
        check(spark, rows, partitions)
    check(spark, rows[:1], 4)
    assert fp.fingerprint_edits(spark.createDataFrame([], SCHEMA)).collect() == []


def test_columns(spark):
    df = spark.createDataFrame([(1, "a b c", 0, ""), (2, "A b c", 0, ""), (3, None, 0, ""), (4, " ", 0, ""), (5, "q r", 0, "")], SCHEMA)
    f = fp.fingerprint(df).select("doc_id", "fingerprint", "range")
    rows = {r.doc_id: r.fingerprint for r in f.collect()}
    assert rows[1] == rows[2] and rows[3] == rows[4] == "" and len(rows[5]) == 4 * fp.SAMPLES
    a, b = f.alias("a"), f.alias("b")
    from pyspark.sql import functions as F
    got = {(r[0], r[1]): r[2] for r in a.join(b, F.col("a.doc_id") <= F.col("b.doc_id")).select(
        "a.doc_id", "b.doc_id", fp.likeness_column(F.col("a.fingerprint"), F.col("b.fingerprint"))).collect()}
    assert got[1, 2] == 1 and got[3, 4] == 1 and got[1, 3] == 0 and got[1, 5] < 0.1
