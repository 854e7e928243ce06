"""Language identification: multinomial naive Bayes over hashed character
n-grams. Counts come from all labelled training rows (Spark sums them per
language and bucket); the log-probability matrix, languages x buckets and so
of fixed size, is broadcast, and texts are scored in numpy by gathering the
columns of their n-grams."""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from gradewise.llm import common

BUCKET_BITS = 16
ORDERS = (1, 2, 3)
ALPHA = 0.5
MIN_SCORE = 0.5
CHUNK_CHARS = 400_000


@cache
def _fold_table() -> np.ndarray:
    """Code point -> its lower-case letter, or a blank for what is no letter
    (one-to-many lower casings keep their first letter)."""
    table = np.full(0x110000, 0x20, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            table[cp] = ord(c.lower()[0])
    return table


def _chunks(texts: list[str | None], limit: int = CHUNK_CHARS):
    """(document number, code points) lists of bounded size. A text longer
    than the limit is cut into pieces that overlap by the longest n-gram less
    one, so that every n-gram of the whole text is counted once."""
    docs, parts, size = [], [], 0
    for number, text in enumerate(texts):
        codes = np.frombuffer((text or "").encode("utf-32-le", "replace"), "<u4")
        for at in range(0, max(1, len(codes)), limit):
            part = codes[at:at + limit]
            docs.append((number, at))
            parts.append((part, codes[max(0, at - max(ORDERS) + 1):at]))
            size += len(part)
            if size >= limit:
                yield docs, parts
                docs, parts, size = [], [], 0
    if docs:
        yield docs, parts


def ngram_buckets(texts: list[str | None], bits: int = BUCKET_BITS):
    """(document number, bucket) of every character n-gram, in blocks.

    Texts are folded to lower-case letters and single blanks, with a blank in
    front; an n-gram of blanks alone does not count."""
    fold = _fold_table()
    for docs, parts in _chunks(texts):
        codes, owner = [], []
        for (number, at), (part, before) in zip(docs, parts):
            lead = before if at else np.asarray([0x20], np.uint32)
            codes.append(np.concatenate([lead, part]))
            owner.append(np.full(len(lead) + len(part), number, np.int32))
            owner[-1][:len(lead) - (at == 0)] = -1 - number  # seen before: context only
        flat, own = fold[np.concatenate(codes)], np.concatenate(owner)
        real = np.where(own < 0, -1 - own, own)
        keep = np.ones(len(flat), bool)
        keep[1:] = (flat[1:] != 0x20) | (flat[:-1] != 0x20) | (real[1:] != real[:-1])
        flat, own, real = flat[keep], own[keep], real[keep]
        hashed = np.zeros(len(flat), np.uint64)
        for n in range(1, max(ORDERS) + 1):
            if n > 1:
                hashed = hashed[:-1]
            here = flat[n - 1:].astype(np.uint64)
            hashed = (hashed + here + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            hashed ^= hashed >> np.uint64(29)
            if n not in ORDERS or not len(hashed):
                continue
            ok = (own[n - 1:] >= 0) & (real[n - 1:] == real[:len(real) - n + 1])
            if n == 1:
                ok &= flat != 0x20
            bucket = (hashed[ok] * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)
            yield own[n - 1:][ok], bucket.astype(np.int64)


def _count(langs: list[str], bits: int):
    def run(batches):
        import pyarrow as pa
        place = {v: i for i, v in enumerate(langs)}
        counts = np.zeros(len(langs) << bits, np.int64)
        for batch in batches:
            lang = np.asarray([place[v] for v in batch.column(1).to_pylist()], np.int64)
            for owner, bucket in ngram_buckets(batch.column(0).to_pylist(), bits):
                counts += np.bincount((lang[owner] << bits) + bucket, minlength=len(counts))
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array((seen >> bits).astype(np.int32)), pa.array((seen & ((1 << bits) - 1)).astype(np.int32)),
             pa.array(counts[seen])], ["lang", "bucket", "n"])
    return run


def train(rows: DataFrame, bits: int = BUCKET_BITS, alpha: float = ALPHA) -> dict:
    """Model from all rows of (text, lang): languages, log prior (by rows) and
    log-probability matrix. Rows without text or lang are left out. At most
    languages x 2**bits sums reach the driver."""
    rows = rows.select("text", F.col("lang").cast("string")).where("text is not null and lang is not null")
    per = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(per)
    if not langs:
        return {"langs": [], "prior": np.zeros(0), "matrix": np.zeros((0, 1 << bits), np.float32), "bits": bits}
    sums = (rows.mapInArrow(_count(langs, bits), "lang int, bucket int, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    matrix = np.full((len(langs), 1 << bits), alpha)
    matrix[sums["lang"].to_numpy(), sums["bucket"].to_numpy()] += sums["n"].to_numpy()
    matrix = np.log(matrix / matrix.sum(axis=1, keepdims=True)).astype(np.float32)
    prior = np.log(np.asarray([per[v] for v in langs], float) / sum(per.values()))
    return {"langs": langs, "prior": prior, "matrix": matrix, "bits": bits}


def score_texts(texts: list[str | None], model: dict) -> tuple[list[str], np.ndarray]:
    """Predicted language and its posterior probability for each text."""
    langs, matrix = model["langs"], model["matrix"]
    total = np.zeros((len(texts), len(langs)))
    letters = np.zeros(len(texts), bool)
    for owner, bucket in ngram_buckets(texts, model["bits"]):
        if not len(owner):
            continue
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        letters[owner[first]] = True
        for k in range(len(langs)):
            total[owner[first], k] += np.add.reduceat(matrix[k][bucket], first, dtype=np.float64)
    if not langs:
        return ["und"] * len(texts), np.zeros(len(texts))
    total += model["prior"]
    total -= total.max(axis=1, keepdims=True)
    share = np.exp(total)
    share /= share.sum(axis=1, keepdims=True)
    best = share.argmax(axis=1)
    names = [langs[b] if ok else "und" for b, ok in zip(best, letters)]
    return names, np.where(letters, share[np.arange(len(texts)), best], 0.0)


def predict_column(spark, model: dict):
    """Column function text -> (lang_pred, lang_score), the model broadcast."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred string, lang_score double>")
    def udf(text):
        import pandas as pd
        names, scores = score_texts([t if isinstance(t, str) else None for t in text], shared.value)
        return pd.DataFrame({"lang_pred": names, "lang_score": scores})
    return udf


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score`` (0 to 1; columns of these
    names are replaced). A null text or one without a letter is ``und`` with
    score 0. Whole texts count, in blocks of bounded size; ties go to the first
    language by name; every other column passes unchanged."""
    found = docs.withColumn("__lang", predict_column(docs.sparkSession, model)("text"))
    return (found.withColumn("lang_pred", F.col("__lang.lang_pred"))
            .withColumn("lang_score", F.col("__lang.lang_score")).drop("__lang"))


def train_documents(docs: DataFrame) -> dict:
    """Model from the text and non-null lang of documents outside the
    evaluation fold."""
    return train(docs.where(~common.held_out("doc_id")).select("text", "lang"))


def keep_identified(docs: DataFrame, model: dict, min_score: float = MIN_SCORE) -> DataFrame:
    """Documents whose language is told with at least ``min_score``; others
    (no letters, or no language likelier than all others together) go."""
    found = docs.withColumn("__lang", predict_column(docs.sparkSession, model)("text"))
    return found.where((F.col("__lang.lang_pred") != "und") & (F.col("__lang.lang_score") >= min_score)).drop("__lang")


def op7_naive_bayes_language(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    scored = predict(docs.select("doc_id", "text"), train_documents(docs))
    return scored.select("doc_id", common.held_out("doc_id").alias("held_out"), "lang_pred",
                         F.col("lang_score").alias("score"))
