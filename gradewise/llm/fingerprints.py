"""Document fingerprints by consistent weighted sampling.

A text's weighted terms are its consecutive word pairs (with a mark before the
first and after the last word), weighted by how often they occur. Sample k
draws, for each term, r and c from Gamma(2, 1) and b from U(0, 1); with
t = floor(ln(weight) / r + b) and ln a = ln c - r (t - b) - r, the term of least
a and its t are the sample. Two texts agree on a sample with the probability of
their generalised Jaccard similarity, sum of minima over sum of maxima, so the
share of equal samples estimates it (standard error at most 0.5 / sqrt(K)).

The draws of (term, k) come from a fixed pool of 2**18 triples, picked by a
multiplicative hash of the term that differs for each k; two terms meet in a
pool place for one k with probability 2**-18. A sample is kept as 16 bits, so
unlike samples look alike with probability 2**-16.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from gradewise.llm import common
from gradewise.llm.words import gram_hashes, lowered, mix, word_hashes

SAMPLES = 64
POOL_BITS = 18
TERM_BLOCK = 1024
_EDGE = np.asarray([0x5851F42D4C957F2D], np.uint64)


@cache
def _pool(samples: int):
    g = np.random.default_rng(20)
    r = g.gamma(2.0, 1.0, 1 << POOL_BITS).astype(np.float32)
    ln_c = np.log(g.gamma(2.0, 1.0, 1 << POOL_BITS)).astype(np.float32)
    b = g.random(1 << POOL_BITS).astype(np.float32)
    odd = g.integers(0, 1 << 63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return r, ln_c, b, ln_c + r * b - r, odd  # the last but one: ln a of weight 1


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct term hashes and their weights (none without words)."""
    words = word_hashes(lowered(text))
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    pairs = gram_hashes(np.concatenate([_EDGE, words, _EDGE + np.uint64(1)]), 2)
    return np.unique(pairs, return_counts=True)


def signature(hashes: np.ndarray, weights: np.ndarray, samples: int = SAMPLES) -> np.ndarray | None:
    """The samples of a weighted set as 16-bit numbers; None of an empty one."""
    if not len(hashes):
        return None
    r, ln_c, b, ln_a1, odd = _pool(samples)
    best = np.full(samples, np.inf, np.float32)
    pick, level = np.zeros(samples, np.uint64), np.zeros(samples, np.int64)
    every = np.arange(samples)
    for at in range(0, len(hashes), TERM_BLOCK):
        h, w = hashes[at:at + TERM_BLOCK], weights[at:at + TERM_BLOCK]
        place = ((h * odd[:, None]) >> np.uint64(64 - POOL_BITS)).view(np.int64)  # (samples, terms)
        ln_a = ln_a1.take(place, mode="clip")
        many = np.flatnonzero(w > 1)
        t = np.zeros((samples, len(many)), np.float32)
        if len(many):
            p = place[:, many]
            t = np.floor(np.log(w[many]).astype(np.float32) / r[p] + b[p])
            ln_a[:, many] = ln_c[p] - r[p] * (t - b[p]) - r[p]
        low = ln_a.argmin(axis=1)
        value = ln_a[every, low]
        column = np.full(len(h), -1)
        column[many] = np.arange(len(many))
        at_level = np.where(column[low] >= 0, t[every, column[low]] if len(many) else 0, 0)
        better = value < best
        best = np.where(better, value, best)
        pick = np.where(better, h[low], pick)
        level = np.where(better, at_level, level)
    return (mix(pick + level.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            & np.uint64(0xFFFF)).astype(">u2")


def to_text(sig: np.ndarray | None) -> str:
    """Fingerprint as hex, four digits a sample; empty for a text without words."""
    return "" if sig is None else sig.tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Share of equal samples; 1 for two texts without words, 0 for one."""
    if a is None or b is None:
        return float(a is None and b is None)
    return float(np.mean(a == b))


def likeness_column(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """``likeness`` of two fingerprint columns, for joins and filters."""
    places = F.sequence(F.lit(0), F.lit(samples - 1))
    same = F.size(F.filter(places, lambda k: F.substring(a, k * 4 + 1, 4) == F.substring(b, k * 4 + 1, 4)))
    return (F.when((F.length(a) == 0) | (F.length(b) == 0), (F.length(a) == F.length(b)).cast("double"))
            .otherwise(same / F.lit(float(samples))))


def fingerprint(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """``docs`` with ``fingerprint`` of the whole text (null counts as empty);
    equal texts get equal fingerprints, other columns pass unchanged."""
    @F.pandas_udf("string")
    def udf(text):
        import pandas as pd
        return pd.Series([to_text(signature(*terms(t if isinstance(t, str) else None), samples)) for t in text],
                         dtype=object)
    return docs.withColumn("fingerprint", udf("text"))


# ------------------------------------------- each document beside the next one
def _range_of(key: Column, cuts: list[int]) -> Column:
    """Number of cuts at or below the key (null: none), in two short looks
    instead of one look through all cuts."""
    if not cuts:
        return F.lit(0)
    step = max(1, round(len(cuts) ** 0.5))
    rows = [cuts[i:i + step] for i in range(0, len(cuts), step)]
    first = F.lit([r[0] for r in rows])
    fine = F.array(*[F.lit(r) for r in rows])
    row = F.size(F.filter(first, lambda c: c <= key))
    inside = F.size(F.filter(F.element_at(fine, F.greatest(row, F.lit(1))), lambda c: c <= key))
    return F.when(row > 0, (row - 1) * step + inside).otherwise(0)


OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
       "near_edited double, near_next double")


def _stream(samples: int):
    """Rows come sorted by (range, order); the last row of a range is a copy of
    the next range's first document and only serves as somebody's next."""
    def run(batches):
        import pyarrow as pa
        held = None  # (range, doc_id, text, signature) that waits for its next
        for batch in batches:
            rows = []
            for where, copy, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                text = text or ""
                sig = signature(*terms(text), samples)
                if held is not None and held[0] == where:
                    _, was_id, was, was_sig = held
                    m = len(was) // 2
                    edited = was[:len(was) - m] + text[:m] if m else was
                    e_sig = signature(*terms(edited), samples)
                    rows.append((was_id, len(was), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(),
                                 to_text(was_sig), to_text(e_sig), likeness(was_sig, e_sig), likeness(was_sig, sig)))
                held = None if copy else (where, doc_id, text, sig)
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            cols = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                             [c.split()[0] for c in OUT.split(", ")])
    return run


def fingerprint_edits(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every whole text and of its edited text (the last
    floor(n/2) code points replaced by the first as many of the next document),
    with the likeness to the edited text and to the next document.

    The order is doc_id (nulls first, equal ids by text), and the first
    document follows the last; a lone document follows itself. Null texts count
    as empty; repeated rows give repeated results; other columns are ignored;
    an empty table gives an empty result. Texts are shuffled once, into ranges
    of doc_id cut at quantiles; one extra row per range carries the document
    that follows it."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    parts = common.shuffle_partitions(spark)
    shares = [i / parts for i in range(1, parts)]
    cuts = sorted({int(c) for c in docs.approxQuantile("doc_id", shares, 0.2 / parts)}) if shares else []
    placed = docs.withColumn("range", _range_of(F.col("doc_id"), cuts))
    # one number per range reaches the driver
    firsts = sorted((r.range, r.first.doc_id) for r in
                    placed.groupBy("range").agg(F.min(F.struct("doc_id")).alias("first")).collect())
    if not firsts:
        return spark.createDataFrame([], OUT)
    follows = [(firsts[i - 1][0], firsts[i][0], firsts[i][1]) for i in range(len(firsts))]
    heads = spark.createDataFrame(follows, "before int, range int, doc_id long")  # a row per range: bounded
    copies = (placed.alias("p").join(F.broadcast(heads).alias("h"),
                                     (F.col("p.range") == F.col("h.range")) & F.col("p.doc_id").eqNullSafe(F.col("h.doc_id")))
              .groupBy("h.before").agg(F.min(F.struct("p.doc_id", F.coalesce("p.text", F.lit("")).alias("text"))).alias("x"))
              .select(F.col("before").alias("range"), F.lit(1).alias("copy"), "x.doc_id", "x.text"))
    rows = placed.select("range", F.lit(0).alias("copy"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return (rows.unionByName(copies).repartition(parts, "range")
            .sortWithinPartitions("range", "copy", "doc_id", "text").mapInArrow(_stream(samples), OUT))


def op3_consistent_sampling(spark, sf_dir: str) -> DataFrame:
    return fingerprint_edits(common.documents(spark, sf_dir))
