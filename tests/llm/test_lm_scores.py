"""Stupid-backoff scores against plain counting."""

import math
import random
from collections import Counter

import pytest

from gradewise.llm import lm_scores as lm
from gradewise.llm.words import ascii_words

SCHEMA = "doc_id long, text string, block int, part string"


def plain(rows):
    docs = [ascii_words(r[1]) for r in rows]
    uni = [Counter(d) + Counter({None: 1} if d else {}) for d in docs]
    bi = [Counter(zip([None, *d], d)) for d in docs]
    all_u, all_b = sum(uni, Counter()), sum(bi, Counter())
    total = sum(map(len, docs))
    out = []
    for r, d, u, b in zip(rows, docs, uni, bi):
        score, back = 0.0, 0
        for v, w in zip([None, *d], d):
            pair = all_b[v, w] - b[v, w]
            if pair > 0:
                score += math.log(pair / (all_u[v] - u[v]))
            else:
                back += 1
                score += math.log(lm.ALPHA * ((all_u[w] - u[w]) or lm.UNSEEN) / max(1, total - len(d)))
        out.append((r[0], len(d), round(score, 6), back, round(score / len(d), 6) if d else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits,size", [(10, 8 << 20), (2, 300)])
def test_against_plain(spark, bits, size):
    rnd = random.Random(bits)
    vocabulary = ["the", "of", "Über", "日本"] + [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(rnd.choice(vocabulary[:rnd.choice([3, 84])]) for _ in range(rnd.randrange(120))), 0, "p")
            for i in range(60)]
    rows += [(100, None, 0, "p"), (101, "", 0, "p"), (None, "the of the", 0, "p"), (5, "w1 w2", 0, "p"), (5, "w1 w2", 0, "p"),
             (102, "only", 0, "p"), (103, "the the the the", 0, "p"), (104, "w3 " * 5000, 0, "p")]
    got = lm.score_documents(spark.createDataFrame(rows, SCHEMA), bits, size).collect()
    assert sorted(((r.doc_id, r.n_words, round(r.log_score, 6), r.backoffs,
                    None if r.mean_log_score is None else round(r.mean_log_score, 6)) for r in got), key=str) == plain(rows)


def test_small_corpora(spark):
    assert lm.score_documents(spark.createDataFrame([], SCHEMA)).collect() == []
    for text in ("a b", None):
        got = lm.score_documents(spark.createDataFrame([(1, text, 0, "")], SCHEMA)).collect()
        assert sorted(((r.doc_id, r.n_words, round(r.log_score, 6), r.backoffs) for r in got), key=str) == [
            x[:4] for x in plain([(1, text, 0, "")])]
