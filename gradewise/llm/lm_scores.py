"""Stupid-backoff language-model scores of every document.

With c over all other documents of the corpus (a document never supports
itself) a word w after v scores c(v, w) / c(v) if that pair occurs elsewhere,
else ALPHA * c(w) / N, else ALPHA * UNSEEN / N; a document's score is the sum of
the logs. A mark stands before the first word.

The count tables hold all words and word pairs of the corpus, partitioned by
their hash. Documents are taken in blocks; a block asks each partition for its
distinct n-grams in one packed row (sorted hashes and counts in the block), so
a frequent n-gram is one entry per block and no partition is hot. A partition
adds up the counts and answers in the same order; the block joins its answers
to its n-grams, takes each document's own counts off and sums per document.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from gradewise.llm import common
from gradewise.llm.words import folded, gram_hashes, word_hashes

ALPHA = 0.4
UNSEEN = 0.5
BLOCK_BITS = 10                 # documents per block: at most 2**10
PART_BYTES = 8 << 20            # text bytes per partition of the count tables
_MARK = np.asarray([0x1F83D9ABFB41BD6B], np.uint64)
KINDS = 2                       # words and word pairs


def _grams(texts: list[str | None]):
    """Per kind the hash of each word's n-gram, and each word's document; the
    mark of each document with words is listed behind the words (kind 0)."""
    hashes = [word_hashes(folded(t)) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(h) for h in hashes])
    lead = [np.concatenate([_MARK, h]) for h in hashes if len(h)]
    pairs = [gram_hashes(h, 2) for h in lead]
    empty = np.zeros(0, np.uint64)
    words = np.concatenate(hashes) if hashes else empty
    before = np.concatenate([h[:-1] for h in lead]) if lead else empty
    return words, before, np.concatenate(pairs) if pairs else empty, owner


def _distinct(words, before, pairs):
    """Sorted distinct n-grams of each kind with their counts. A context counts
    like a word, so kind 0 holds the marks too."""
    marks = before[before == _MARK[0]]
    return [np.unique(np.concatenate([words, marks]), return_counts=True), np.unique(pairs, return_counts=True)]


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Partition of each hash: a sorted list of hashes is sorted by it too."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _pack(hashes: np.ndarray) -> bytes:
    """The low 48 bits of each hash; the partition holds part of the rest."""
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


ASK = "kind int, part int, block long, grams binary, counts binary"


def _ask(parts: int):
    def run(batches):
        import pyarrow as pa
        held, block = [], None

        def rows():
            words, before, pairs, _ = _grams(held)
            out = []
            for kind, (grams, counts) in enumerate(_distinct(words, before, pairs)):
                part = _part(grams, parts)
                first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
                for a, b in zip(first, [*first[1:], len(part)]):
                    out.append((kind, int(part[a]), block, _pack(grams[a:b]), counts[a:b].astype("<u4").tobytes()))
            types = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
            cols = zip(*out) if out else [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                              ["kind", "part", "block", "grams", "counts"])

        for batch in batches:
            for b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if b != block and held:
                    yield rows()
                    held = []
                block = b
                held.append(text)
        if held:
            yield rows()
    return run


def _count_words(batches):
    import pyarrow as pa
    n = sum(len(word_hashes(folded(t.as_py()))) for batch in batches for t in batch.column(0))
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])


def _answer(key, pdf):
    """One partition of a count table: totals of every n-gram, given back to
    each block in the order it asked."""
    import pandas as pd
    grams = [_unpack(g) for g in pdf["grams"]]
    counts = [np.frombuffer(c, "<u4") for c in pdf["counts"]]
    _, place = np.unique(np.concatenate(grams), return_inverse=True)
    total = np.bincount(place, np.concatenate(counts))[place].astype("<u8")
    ends = np.cumsum([len(g) for g in grams])
    # most totals are small: four bytes unless one needs more
    answers = [t.astype("<u4").tobytes() if t.max() < 1 << 32 else b"\x00" + t.tobytes()
               for t in np.split(total, ends[:-1])]
    return pd.DataFrame({"block": pdf["block"], "kind": pdf["kind"], "part": pdf["part"], "totals": answers})


def _totals(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4").astype(np.int64) if len(raw) % 4 == 0 else np.frombuffer(raw[1:], "<u8").astype(np.int64)


OUT = "doc_id long, has_id boolean, n_words long, log_score double, backoffs long"


def _score(corpus_words: int):
    def run(key, docs, answers):
        import pandas as pd
        docs = docs.sort_values("row_id", kind="stable")
        texts = [t if isinstance(t, str) else None for t in docs["text"]]
        words, before, pairs, owner = _grams(texts)
        (w_all, _), (p_all, _) = _distinct(words, before, pairs)
        n = np.bincount(owner, minlength=len(texts))
        score = np.zeros(len(texts))
        back = np.zeros(len(texts), np.int64)
        if len(words):
            answers = answers.sort_values(["kind", "part"])
            w_total, p_total = (np.concatenate([_totals(x) for x in answers["totals"][answers["kind"] == k]])
                                for k in range(KINDS))
            if len(w_total) != len(w_all) or len(p_total) != len(p_all):
                raise RuntimeError("the scan dealt documents to other blocks than before")

            def others(grams, all_, total):
                """Count in all other documents, for each word's n-gram."""
                place = np.searchsorted(all_, grams)
                mine = owner * np.int64(len(all_)) + place
                _, inverse, own = np.unique(mine, return_inverse=True, return_counts=True)
                return total[place] - own[inverse]

            pair, word = others(pairs, p_all, p_total), others(words, w_all, w_total)
            # a context's own count is its count as a word; a mark's is 1
            place = np.searchsorted(w_all, before)
            ctx = w_total[place] - _own(before, words, owner, n)
            rest = np.maximum(corpus_words - n[owner], 1)
            value = np.where(pair > 0, pair / np.maximum(ctx, 1), ALPHA * np.where(word > 0, word, UNSEEN) / rest)
            score = np.bincount(owner, np.log(value), len(texts))
            back = np.bincount(owner[pair <= 0], minlength=len(texts))
        return pd.DataFrame({"doc_id": docs["doc_id"], "has_id": docs["has_id"], "n_words": n, "log_score": score,
                             "backoffs": back})
    return run


def _own(before, words, owner, n):
    """How often each context occurs as a word in its own document (marks: 1)."""
    joint = np.concatenate([words, before])
    _, code = np.unique(joint, return_inverse=True)
    span = np.int64(code.max() + 1)
    in_doc = owner * span + code[:len(words)]
    keys, counts = np.unique(in_doc, return_counts=True)
    want = owner * span + code[len(words):]
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return np.where(keys[at] == want, counts[at], 0) + (before == _MARK[0])


def score_documents(docs: DataFrame, block_bits: int = BLOCK_BITS, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_words, log_score (sum of natural logs), mean_log_score (null
    without words) and backoffs (words whose pair occurs in no other document)
    of every row.

    Null and empty texts have no words and score 0; repeated rows support one
    another like any two documents; null ids stay null; other columns are
    ignored; an empty table gives an empty result. A task holds one block of
    documents or one partition of the count tables, whose number follows the
    bytes of text."""
    # pandas would turn a long column with nulls into floats
    rows = docs.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("has_id"), "text",
                       F.monotonically_increasing_id().alias("row_id")).withColumn(
        "block", F.shiftright("row_id", block_bits))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    # counted apart: writing the questions down to read them twice would double their disk
    words = docs.select("text").mapInArrow(_count_words, "n long").agg(F.sum("n")).first()[0] or 0
    asked = rows.select("block", "text").mapInArrow(_ask(parts), ASK)
    answers = asked.groupBy("kind", "part").applyInPandas(
        _answer, "block long, kind int, part int, totals binary")
    scored = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_score(words), OUT)
    return scored.select(
        F.when(F.col("has_id"), F.col("doc_id")).alias("doc_id"), "n_words", "log_score",
        F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).alias("mean_log_score"), "backoffs")


def op5_stupid_backoff(spark, sf_dir: str) -> DataFrame:
    scored = score_documents(common.documents(spark, sf_dir))
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"),
                         F.round("mean_log_score", 6).alias("mean_log_score"), "backoffs")


OP5_SQL = r"""
WITH words AS (
  SELECT row_id, doc_id, w, i FROM (
    SELECT row_id, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM (SELECT row_number() OVER () AS row_id, doc_id, text FROM documents)), 
  LATERAL (SELECT unnest(ws) AS w, generate_subscripts(ws, 1) AS i)),
pairs AS (SELECT row_id, w, i, coalesce(lag(w) OVER (PARTITION BY row_id ORDER BY i), '') AS v FROM words),
own_w AS (SELECT row_id, w, count(*) AS k FROM (SELECT row_id, w FROM words UNION ALL SELECT DISTINCT row_id, '' FROM words) GROUP BY ALL),
own_p AS (SELECT row_id, v, w, count(*) AS k FROM pairs GROUP BY ALL),
all_w AS (SELECT w, sum(k) AS k FROM own_w GROUP BY w),
all_p AS (SELECT v, w, sum(k) AS k FROM own_p GROUP BY v, w),
size AS (SELECT row_id, count(*) AS n FROM words GROUP BY row_id),
total AS (SELECT count(*) AS n FROM words),
each AS (
  SELECT p.row_id, ap.k - op.k AS pair, aw.k - ow.k AS word, av.k - ov.k AS ctx,
         greatest((SELECT n FROM total) - s.n, 1) AS rest
  FROM pairs p JOIN own_p op ON op.row_id = p.row_id AND op.v = p.v AND op.w = p.w
  JOIN all_p ap ON ap.v = p.v AND ap.w = p.w
  JOIN own_w ow ON ow.row_id = p.row_id AND ow.w = p.w JOIN all_w aw ON aw.w = p.w
  JOIN own_w ov ON ov.row_id = p.row_id AND ov.w = p.v JOIN all_w av ON av.w = p.v
  JOIN size s ON s.row_id = p.row_id),
summed AS (
  SELECT row_id, count(*) AS n, sum(ln(CASE WHEN pair > 0 THEN pair::DOUBLE / ctx
         WHEN word > 0 THEN 0.4::DOUBLE * word / rest ELSE 0.4::DOUBLE * 0.5 / rest END)) AS score,
         count(*) FILTER (pair <= 0) AS back FROM each GROUP BY row_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, round(coalesce(score, 0.0), 4) AS log_score,
       round(score / n, 6) AS mean_log_score, coalesce(back, 0)::BIGINT AS backoffs
FROM (SELECT row_number() OVER () AS row_id, doc_id FROM documents) LEFT JOIN summed USING (row_id)
"""
