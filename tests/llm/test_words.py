"""Word hashes: equal words hash alike wherever they stand, unlike ones do not."""

import random

import numpy as np

from gradewise.llm import words as w


def test_equal_words_equal_hashes(monkeypatch):
    rnd = random.Random(1)
    vocabulary = list({"".join(rnd.choice("abcdefgh\xe9日.,") for _ in range(rnd.randrange(1, 9))) for _ in range(5000)})
    text = "".join(rnd.choice(vocabulary) + rnd.choice([" ", "\n", "\t \x0b", "  "]) for _ in range(20000))
    words = w.blank_words(text)
    h = w.word_hashes(w.lowered(text))
    assert len(h) == len(words) and len(set(h.tolist())) == len(set(words))
    seen = {}
    assert all(seen.setdefault(a, b) == b for a, b in zip(words, h.tolist()))
    monkeypatch.setattr(w, "_SEGMENT", 700)
    assert np.array_equal(h, w.word_hashes(w.lowered(text)))
    assert len(w.word_hashes(b"")) == len(w.word_hashes(b" \n ")) == 0
    assert len(w.word_hashes(b"x" * 2000)) == 1  # a word beyond a segment stays whole


def test_words_beyond_a_segment():
    rnd = random.Random(2)
    long = "".join(rnd.choice("abcdefgh+/日") for _ in range(1_200_000))
    pieces = [long, "ab", long + "x", long[1:], long[-300_000:], "\x0c", long, "cd", "ab", long + "x"]
    for between in " \t\n\r\v\f":
        text = between.join(pieces)
        for words, h in ((w.blank_words(text), w.word_hashes(w.lowered(text))), (w.ascii_words(text), w.word_hashes(w.folded(text)))):
            assert len(h) == len(words) and len(set(h.tolist())) == len(set(words))
            assert len(set(zip(words, h.tolist()))) == len(set(words))
    assert w.word_hashes(w.lowered("ab")).tolist() == w.word_hashes(w.lowered(text))[1:2].tolist()
    short = "\r".join("".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 9))) for _ in range(300_000))
    assert len(w.word_hashes(w.lowered(short))) == 300_000


def test_segment_ends(monkeypatch):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab \r\f") if rnd.random() < 0.3 else "a" * rnd.randrange(20) for _ in range(60)) for _ in range(200)]
    whole = [w.word_hashes(t.encode()) for t in texts]
    for size in (1, 2, 3, 7, 16):
        monkeypatch.setattr(w, "_SEGMENT", size)
        assert all(np.array_equal(a, w.word_hashes(t.encode())) for a, t in zip(whole, texts))


def test_folded():
    text = "It's A-b \xe93\x7fZ[~` 日本"
    assert w.folded(text).split() == w.ascii_words(text) and w.folded(None) == w.lowered(None) == b""
