"""Token ids, token files and packing against brute force and round trips."""

import random
import zlib
from array import array

import numpy as np
import pytest

from gradewise.llm import dac, packing, token_files, tokens

SCHEMA = "doc_id long, text string, part int, start string"
ODD = ["", None, " ", "a", "The, the. THE.", "x,, y.. z,.", "don't can't I'LL we've", "<|endoftext|> a<|startoftext|>b",
       "ΣΑΣ ς Σ. ÀÉÎ é ́x", "tab\there nbsp em \x85 \x1c.", "123 4,5. 6.7", "日本語 テスト。", "a\n\n\nb\r\nc", "İstanbul ŞİŞ",
       "‍zero 👩‍👩 ok", "under_score snake_case, x_.", "ﬁn, ﬂ."]


def whole(text, lib):
    return lib.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def lib():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokens.default_tokenizer())


def docs_of(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, 1, "s") for i, t in zip(ids, texts)], SCHEMA)


def test_pieces_equal_whole_texts(lib, spark, sf_small):
    texts = [r.text for r in spark.read.parquet(f"{sf_small}/documents.parquet").select("text").collect()] + ODD
    enc = tokens.Encoder(tokens.default_tokenizer(), cache_pieces=500)  # small: the cache turns over
    for text, blob in zip(texts, enc.encode(texts)):
        assert np.frombuffer(blob, "<u4").tolist() == whole(text, lib), repr(text)[:80]


@pytest.mark.parametrize("n", [0, 1, 7, 8, 511, 512, 513, 5000])
def test_image_round_trip_and_random_access(n):
    rng = np.random.default_rng(n)
    ids = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
    r = dac.Reader(dac.encode(ids))
    assert len(r) == n and np.array_equal(r.all(), ids)
    places = rng.integers(0, n, 200) if n else np.zeros(0, int)
    assert np.array_equal(r.take(places), ids[places])
    with pytest.raises(IndexError):
        r[n]


def test_token_files(spark, lib, tmp_path):
    rnd = random.Random(4)
    texts = ODD + [" ".join(rnd.choice(["the", "of", "zebra", "quixotic,", "12"]) for _ in range(rnd.randrange(900)))
                   for _ in range(60)]
    ids = rnd.sample(range(-500, 10 ** 12), len(texts))
    ids[3] = None
    path = str(tmp_path / "t")
    token_files.write_tokens(docs_of(spark, texts, ids), path, segment_tokens=700)
    got = {r.doc_id: r for r in token_files.read_documents(spark, path).collect()}
    back = {r.doc_id: r.ids for r in token_files.read_ids(spark, path).collect()}
    at, flat = 0, []
    for i, text in sorted(zip(ids, texts), key=lambda x: (x[0] is not None, x[0])):
        want = [*whole(text, lib), 1]
        flat += want
        assert (got[i].start, got[i].n_tokens) == (at, len(want))
        assert got[i].ids_crc32 == zlib.crc32(array("I", want).tobytes()) and back[i] == want
        at += len(want)
    places = rnd.sample(range(len(flat)), 300) + [0, len(flat) - 1, len(flat) + 5, -1]
    df = spark.createDataFrame([(p,) for p in places + places[:9]], "position long")
    found = {r.position: r.id for r in token_files.lookup(df, path, block=512).collect()}
    assert found == {p: flat[p] for p in places if 0 <= p < len(flat)}


def test_token_files_empty_and_repeated(spark, tmp_path):
    token_files.write_tokens(docs_of(spark, []), str(tmp_path / "e"))
    assert token_files.read_documents(spark, str(tmp_path / "e")).collect() == []
    token_files.write_tokens(docs_of(spark, ["a b", "a b", None], [5, 5, 5]), str(tmp_path / "r"))
    rows = sorted(tuple(r)[:3] for r in token_files.read_documents(spark, str(tmp_path / "r")).collect())
    assert rows == [(5, 0, 1), (5, 1, 3), (5, 4, 3)]


def test_best_fit_is_best_fit():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 101, 400)
    where, offset, loads = packing.best_fit(lengths, 100)
    free = []
    for i in np.argsort(-lengths, kind="stable"):
        fits = [f for f in free if f[0] >= lengths[i]]
        if fits:
            best = min(fits, key=lambda f: f[0])
            best[0] -= lengths[i]
        else:
            free.append([100 - lengths[i]])
    assert sorted(100 - f[0] for f in free) == sorted(loads)
    assert sum(1 for x in loads if x <= 50) <= 1


@pytest.mark.parametrize("task_pieces,fan_in", [(1 << 15, 16), (6, 2), (20, 3)])
def test_packing(spark, lib, task_pieces, fan_in):
    rnd = random.Random(8)
    texts = ODD + [" ".join(["word"] * rnd.choice([3, 30, 63, 64, 150])) for _ in range(120)]
    docs = docs_of(spark, texts)
    out = packing.pack_documents(docs, capacity=64, task_pieces=task_pieces, fan_in=fan_in).collect()
    pieces, bins = {}, {}
    for i, text in enumerate(texts):
        ids = [*whole(text, lib), 1]
        for p, b in enumerate(range(0, len(ids), 64)):
            part = ids[b:b + 64]
            pieces[i, p] = (b, len(part), zlib.crc32(array("I", part).tobytes()))
    assert len(out) == len(pieces)
    for r in out:
        assert (r.start, r.length, r.ids_crc32) == pieces[r.doc_id, r.piece]
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    least = -(-sum(x[1] for x in pieces.values()) // 64)
    assert len(bins) <= least * 1.05 + 2
    assert sum(1 for p in bins.values() if sum(x[1] for x in p) <= 32) <= 1
    seqs = packing.sequences(packing.pack_documents(docs, capacity=64, task_pieces=task_pieces, fan_in=fan_in),
                             packing.cut_pieces(docs, capacity=64, with_ids=True)).collect()
    assert sum(len(r.ids) for r in seqs) == sum(x[1] for x in pieces.values()) and max(len(r.ids) for r in seqs) <= 64


def test_packing_empty(spark):
    assert packing.pack_documents(docs_of(spark, [])).collect() == []
    rows = packing.pack_documents(docs_of(spark, [None, "", "a"], [1, 1, None])).collect()
    assert sorted((r.length, r.offset) for r in rows) == [(1, 2), (1, 3), (2, 0)]


def test_portions_and_generations(tmp_path):
    import pyarrow as pa
    from gradewise.llm import tokens
    texts = ["ab" * n for n in (1, 3, 0, 50, 2, 2, 2)] + [None, "z" * 500, "é", ""]
    got = tokens.portions(pa.array(texts), 20)
    assert [x for a, n in got for x in texts[a:a + n]] == texts and all(
        n == 1 or sum(len((t or "").encode()) for t in texts[a:a + n]) <= 20 for a, n in got)
    assert tokens.portions(pa.array([], pa.string())) == []
    path = tokens.default_tokenizer()
    small, large = tokens.Encoder(path, 5), tokens.Encoder(path)
    words = ["Alpha", "beta,", "gamma.", "x%%%", "12", "alpha", "delta", "beta", "...", ",", "it's", ".,"]
    for i in range(40):
        text = " ".join(words[(i * k) % len(words)] for k in range(i % 7))
        want = np.asarray(large.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert small.encode([text]) == large.encode([text]) == [want]
    assert len(small.known) < 30 and small.known.old
