"""Naive Bayes against a plain per-text computation, and held-out accuracy."""

import math
import zlib
from collections import Counter

import numpy as np

from gradewise.llm import language as lg

SCHEMA = "doc_id long, text string, lang string, lang_pred int"
TEXTS = ["Der Hund und die Katze", "the dog and the cat", None, "", "123 !!", "Ünïcode ßtraße 日本", "a", " a  b ",
         "x" * 50 + " yz"]


def plain_buckets(text):
    fold, out, last = lg._fold_table(), [], None
    codes = []
    for c in " " + (text or ""):
        v = int(fold[ord(c)])
        if v == 0x20 and last == 0x20:
            continue
        codes.append(v)
        last = v
    for n in lg.ORDERS:
        for i in range(len(codes) - n + 1):
            gram = codes[i:i + n]
            if gram == [0x20]:
                continue
            h = 0
            for v in gram:
                h = (h + v + 1) * 0x9E3779B97F4A7C15 % (1 << 64)
                h ^= h >> 29
            out.append((h * 0xBF58476D1CE4E5B9 % (1 << 64)) >> (64 - lg.BUCKET_BITS))
    return Counter(out)


def counted(texts):
    got = [Counter() for _ in texts]
    for owner, bucket in lg.ngram_buckets(texts):
        for o, b in zip(owner.tolist(), bucket.tolist()):
            got[o][b] += 1
    return got


def test_ngrams_against_plain(monkeypatch):
    want = [plain_buckets(t) for t in TEXTS]
    assert counted(TEXTS) == want
    monkeypatch.setattr(lg, "_chunks", lambda texts, limit=7, f=lg._chunks: f(texts, limit))
    dense = [t.replace(" ", "_") if t else t for t in TEXTS]  # runs of blanks may span a cut
    assert counted(["abcdefghijklmnop", "qr", "stuvwxyzabcdefg"]) == [plain_buckets(t) for t in (
        "abcdefghijklmnop", "qr", "stuvwxyzabcdefg")]
    assert [bool(c) for c in counted(dense)] == [bool(c) for c in [plain_buckets(t) for t in dense]]


def test_model_and_prediction(spark):
    rows = [(i, t, l, 5) for i, (t, l) in enumerate([
        ("der hund und die katze", "de"), ("das haus und der baum", "de"), ("the dog and the cat", "en"),
        (None, "en"), ("no label", None)])]
    model = lg.train(spark.createDataFrame(rows, SCHEMA))
    assert model["langs"] == ["de", "en"]
    counts = [plain_buckets(rows[0][1]) + plain_buckets(rows[1][1]), plain_buckets(rows[2][1])]
    for text in TEXTS:
        logs = []
        for k, c in enumerate(counts):
            total = sum(c.values()) + lg.ALPHA * (1 << lg.BUCKET_BITS)
            logs.append(math.log((2, 1)[k] / 3) + sum(
                n * math.log((c[b] + lg.ALPHA) / total) for b, n in plain_buckets(text).items()))
        (name,), score = lg.score_texts([text], model)
        if not plain_buckets(text):
            assert (name, score[0]) == ("und", 0.0)
            continue
        post = np.exp(np.asarray(logs) - max(logs))
        assert name == model["langs"][int(np.argmax(logs))]
        assert abs(score[0] - post.max() / post.sum()) < 1e-3
    df = spark.createDataFrame([(1, None, "en", 3), (1, None, "en", 3), (None, "the cat", None, 4)], SCHEMA)
    assert sorted(r.lang_pred for r in lg.predict(df, model).collect()) == ["en", "und", "und"]
    (kept,) = lg.keep_identified(df, model).collect()
    assert kept.asDict() == {"doc_id": None, "text": "the cat", "lang": None, "lang_pred": 4}


def test_empty(spark):
    model = lg.train(spark.createDataFrame([], SCHEMA))
    rows = lg.predict(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string"), model).collect()
    assert [(r.lang_pred, r.lang_score) for r in rows] == [("und", 0.0)]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = lg.op7_naive_bayes_language(spark, sf).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    test = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in test) / len(test) > 0.97
