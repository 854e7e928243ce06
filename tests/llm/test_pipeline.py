"""The pipeline's stages against plain versions, on a small fixture table."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline as cp
from gradewise.llm import decontamination, language, packing, tokens, toxicity
from tests.llm.test_decontamination import plain as plain_leaks
from tests.llm.test_near_dup import brute as brute_groups

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of sf0.001 with copies, near copies, leaks and odd rows."""
    src, out = "/root/testdata/sf0.001", tmp_path_factory.mktemp("pipe")
    rnd = random.Random(1)
    docs = [tuple(r) for r in spark.read.parquet(f"{src}/documents.parquet").select(
        "doc_id", "text", "lang", "source", "n_chars").collect()]
    items = [r.text for r in spark.read.parquet(f"{src}/benchmark.parquet").collect()]
    extra = [None, "", "12 34 !!!", docs[3][1], docs[3][1] + " one more word here", items[0] + " " + docs[5][1]]
    extra += [" ".join(w if rnd.random() > 0.02 else "changed" for w in docs[8][1].split()) for _ in range(5)]
    docs += [(10_000 + i, t, None if i % 2 else "en", "x", 0) for i, t in enumerate(extra)]
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{out}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{src}/{t}.parquet").write.parquet(f"{out}/{t}.parquet")
    return str(out)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]

    def plain_toxic(data):
        train = sorted((d[0], d[1]) for d in data if d[0] in labels and zlib.crc32(str(d[0]).encode()) % 4 != 2)
        model = toxicity.train([t for _, t in train], [labels[i] for i, _ in train])
        return [d for d, s in zip(data, toxicity.Scorer(model).score([d[1] for d in data])) if s < toxicity.THRESHOLD]

    def plain_language(data):
        model = language.train_documents(spark.createDataFrame(data, COLUMNS))
        names, scores = language.score_texts([d[1] for d in data], model)
        return [d for d, n, s in zip(data, names, scores) if n != "und" and s >= language.MIN_SCORE]

    def plain_groups(data):
        least = {g[0]: g[2] for g in brute_groups(data)}
        return [d for d in data if least[d[0]] in (None, d[0])]

    def plain_benchmark(data):
        bad = {r[0] for r in plain_leaks(data, items)}
        return [d for d in data if d[0] not in bad]

    now = docs
    for (name, stage), plain in zip(cp.STAGES, (plain_toxic, plain_language, plain_groups, plain_benchmark)):
        before = rows(now)
        got = stage(spark, now, folder)
        assert got.columns == docs.columns, name
        want = sorted(plain(before), key=str)
        # 64 training texts are too few for the network to reject any here
        assert rows(got) == want and 0 < len(want) < len(before) + (name == "toxicity"), name
        got.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
    packed = rows(cp.STAGES[-1][1](spark, now, folder))
    enc = tokens.Encoder(tokens.default_tokenizer())
    want = {}
    for d in rows(now):
        (blob,) = enc.encode([d[1]], np.asarray([1], "<u4").tobytes())
        for p, b in enumerate(range(0, len(blob), 4 * packing.CAPACITY)):
            want[d[0], p] = (b // 4, len(blob[b:b + 4 * packing.CAPACITY]) // 4, zlib.crc32(blob[b:b + 4 * packing.CAPACITY]))
    assert {(r[0], r[1]): r[2:5] for r in packed} == want and len(packed) == len(want)
    assert len({r[5] for r in packed}) <= -(-sum(w[1] for w in want.values()) // packing.CAPACITY) + 1
    # run() is these stages, and everything goes the same way again
    assert sorted(r[:5] for r in packed) == sorted(tuple(r)[:5] for r in cp.run(spark, folder).collect())
    assert decontamination.leaked(now, spark.read.parquet(f"{folder}/benchmark.parquet")).isEmpty()
