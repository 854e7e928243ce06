"""Base counts against a plain regex version; bands against texts made to be
repetitive, random or ordinary."""

import base64
import random
import re
from collections import Counter

import zstandard

from gradewise.llm import quality_rules as qr

SCHEMA = "doc_id long, text string, n_words string, kept int"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered),
            n < 20 or 100 * len(covered) > 30 * n)


def prose(n, seed=0):
    rnd = random.Random(seed)
    stock = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randrange(2, 9))) for _ in range(3000)]
    return " ".join(rnd.choice(stock) for _ in range(n))


def texts():
    rnd = random.Random(4)
    noise = base64.b64encode(rnd.randbytes(9000)).decode()
    noise = " ".join(noise[i:i + 9] for i in range(0, len(noise), 9))
    a = prose(400, 1)
    return {
        "null": None, "empty": "", "blank": " \n\t \r\n", "short": "a few words only",
        "prose": prose(300), "long": prose(60000, 2), "noise": noise, "half noise": prose(2500, 3) + "\n" + noise,
        "line": "the very same line again\n" * 300, "stutter": " ".join(w + " " + w + " " + w + " " + w + " " + w
                                                                         for w in prose(40, 5).split()),
        "twice": a + "\n" + prose(30, 6) + "\n" + a, "eight": "a b c d e f g h " * 2 + prose(40, 7),
        "symbols": "x # [a] *b* $5 10% & | <c> " + prose(30, 8), "wide": "ß é x 漢字 \x0b y\x0cz\x1fw " + prose(30, 9),
        "dup lines": "\n".join(["one two", " ", "one two", "one two ", "", "", "one two"]) + "\n" + prose(30, 10),
        "huge word": "z" * 700_000 + " " + prose(40, 11),
    }


def test_base_counts_against_plain_version(spark):
    t = texts()
    rows = [(i, x, "clash", 0) for i, x in enumerate(t.values())] + [(3, t["short"], "clash", 0), (None, t["prose"], "", 1)]
    got = qr.quality(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, (name, x) in enumerate(t.items()):
        r, p = by[i], plain(x)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == p, name
        assert not (r.base_failed and r.kept)
    assert [r.n_words for r in got if r.doc_id is None] == [300]
    assert sum(r.doc_id == 3 for r in got) == 2


def test_bands(spark):
    c = zstandard.ZstdCompressor(level=3)
    kept = {name: qr.judge(x, c)[6] for name, x in texts().items()}
    reasons = {name: qr.judge(x, c)[7] for name, x in texts().items()}
    assert [k for k, v in kept.items() if v] == ["prose", "long", "eight", "symbols", "wide", "dup lines"]
    assert reasons["noise"] == "whole text incompressible" and reasons["stutter"] == "whole text repetitive"
    assert reasons["half noise"] == "chunks incompressible" and reasons["huge word"] == "whole text repetitive"
    assert reasons["line"] == reasons["twice"] == "repeated windows" and reasons["short"] == "too few words"


def test_chunks_hold_every_byte_and_bands_follow_length():
    for n in (0, 1, 2047, 2048, 4096, 6143, 6144, 50_000):
        raw = bytes(i % 251 for i in range(n))
        parts = qr.chunks(raw)
        assert b"".join(parts) == raw and all(len(p) == 4096 for p in parts[:-1]) and len(parts[-1]) < 4096 * 1.5
    assert qr.outside(100, 5.0) is None and qr.outside(128, 1.01) == "incompressible"
    assert qr.outside(127, 0.0) is None and qr.outside(128, 0.29) == "repetitive"
    assert qr.outside(4095, 0.2) == "repetitive" and qr.outside(4096, 0.2) is None
    assert qr.outside(10**9, 0.07) == "repetitive" and qr.outside(10**9, 0.67) == "incompressible"


def test_keep_good_keeps_columns_and_repeated_rows(spark):
    t = texts()
    docs = spark.createDataFrame([(1, t["prose"], "x", 3), (1, t["prose"], "x", 3), (2, t["noise"], "y", 4), (None, None, "z", 5)],
                                 SCHEMA)
    kept = qr.keep_good(docs)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, t["prose"], "x", 3)] * 2
    assert qr.quality(docs.limit(0)).count() == 0


def test_query_on_the_small_table(spark, sf_small):
    from gradewise.llm import common
    docs = common.documents(spark, sf_small)
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    got = qr.op11_compression_bands(spark, sf_small).collect()
    assert len(got) == len(text)
    for r in got:
        p = plain(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == p
    labels = {r.doc_id: r.quality for r in common.table(spark, sf_small, "labels").collect()}
    good = [r.kept for r in got if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(good) == len(good)
