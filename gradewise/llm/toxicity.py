"""Toxicity: a bidirectional gated recurrent network with attention pooling
over word and character inputs, trained in numpy, scoring all overlapping
windows of every whole text.

A word's input is its hashed word embedding beside the means of its hashed
character n-gram embeddings. A window's states of both directions are pooled
by attention into one logit; a text's score is a logistic function of the
logits of its three highest windows (fewer windows: the lowest repeats).

Training is bounded by one documented parameter: at most ``TRAIN_DOCS`` labelled
documents, chosen by a hash of their id. Labels belong to documents, so every
epoch trains on each document's highest of all its windows and, of a clean one,
one other. Spark tasks read the sample's whole texts, count the first evidence
and choose the windows; the driver gets at most two windows of ``WINDOW`` words
and ``TOP_WINDOWS`` logits of each document. Scoring has no bounds.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from gradewise.llm import common
from gradewise.llm.words import ascii_words

WINDOW, STRIDE = 64, 48
THRESHOLD = 0.3
TRAIN_DOCS, EPOCHS, BATCH = 6000, 6, 128
WORD_BUCKETS, CHAR_BITS, CHAR_ORDERS = 1 << 14, 15, (3, 5)
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 4, 4, 8, 8
TOP_WINDOWS = 3
KNOWN_WORDS = 200_000
SCORE_WINDOWS = 1024


# ---------------------------------------------------------------- inputs
def word_inputs(words: list[bytes]) -> dict:
    """Numeric inputs of words: ``word`` bucket; per character order n the
    flat n-gram buckets of all words (their bytes between two start and two
    end marks), where each word's n-grams begin and how many it has."""
    bucket = np.fromiter((zlib.crc32(w) % WORD_BUCKETS for w in words), np.int64, len(words))
    flat = np.frombuffer(b"".join(b"\x02\x02" + w + b"\x03\x03" for w in words), np.uint8).astype(np.uint32)
    size = np.fromiter((len(w) + 4 for w in words), np.int64, len(words))
    end = np.cumsum(size)
    out = {"word": bucket}
    for n in CHAR_ORDERS:
        gram = np.zeros(len(flat) - n + 1, np.uint32)
        for k in range(n):
            gram = (gram ^ flat[k:len(flat) - n + 1 + k]) * np.uint32(0x01000193) + np.uint32(n)
        gram = ((gram ^ (gram >> np.uint32(15))) * np.uint32(0x27D4EB2F)) >> np.uint32(32 - CHAR_BITS)
        inside = np.ones(len(flat), bool)
        for k in range(1, n):
            inside[end - k] = False
        count = size - n + 1
        out[n] = (gram[inside[:len(gram)]].astype(np.int64), np.cumsum(count) - count, count)
    return out


def take_words(inputs: dict, i: np.ndarray) -> dict:
    """The inputs of words number i (from 0) of a list of words."""
    out = {"word": inputs["word"][i]}
    for n in CHAR_ORDERS:
        chars, begin, count = inputs[n]
        count = count[i]
        at = np.cumsum(count) - count
        out[n] = (chars[np.repeat(begin[i] - at, count) + np.arange(count.sum())], at, count)
    return out


def embed(p: dict, inputs: dict) -> np.ndarray:
    parts = [p["Ew"][inputs["word"]]]
    for n in CHAR_ORDERS:
        chars, begin, count = inputs[n]
        parts.append(np.add.reduceat(p[f"E{n}"][chars], begin, axis=0) / count[:, None])
    return np.concatenate(parts, axis=1).astype(p["Ew"].dtype)


def window_starts(n: int) -> list[int]:
    """Starts of the overlapping windows of a text of n words: every STRIDE
    words, the last one flush with the end."""
    if n <= WINDOW:
        return [0]
    starts = list(range(0, n - WINDOW + 1, STRIDE))
    return starts if starts[-1] == n - WINDOW else [*starts, n - WINDOW]


def windows(rows: np.ndarray) -> np.ndarray:
    """(windows, WINDOW) of word rows, 0 where there is no word."""
    if len(rows) < WINDOW:
        return np.concatenate([rows, np.zeros(WINDOW - len(rows), rows.dtype)])[None]
    return np.lib.stride_tricks.sliding_window_view(rows, WINDOW)[window_starts(len(rows))]


# --------------------------------------------------------------- network
def new_model(seed: int = 7) -> dict:
    g = np.random.default_rng(seed)
    d, h, k = WORD_DIM + CHAR_DIM * len(CHAR_ORDERS), HIDDEN, ATTENTION
    def init(*shape, scale):
        return (g.standard_normal(shape) * scale).astype(np.float32)
    return {"Ew": init(WORD_BUCKETS, WORD_DIM, scale=0.1),
            **{f"E{n}": init(1 << CHAR_BITS, CHAR_DIM, scale=0.2) for n in CHAR_ORDERS}, "W": init(2, d, 3 * h, scale=d ** -0.5), "c": np.zeros((2, 3 * h), np.float32),
            "U": init(2, h, 3 * h, scale=h ** -0.5), "A": init(2 * h, k, scale=(2 * h) ** -0.5),
            "a": np.zeros(k, np.float32), "v": init(k, scale=1.0), "w": init(2 * h, scale=(2 * h) ** -0.5),
            "b": np.zeros(1, np.float32), "top": np.asarray([1.0] + [0.0] * TOP_WINDOWS)}


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def forward(p: dict, inputs: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logits of windows. ``inputs``: (2, time, windows, 3 gates x hidden)
    projected inputs of both directions; ``mask``: (time, windows) of 0 or 1."""
    h = HIDDEN
    _, steps, n, _ = inputs.shape
    states = np.zeros((steps, n, 2 * h), np.float32)
    saved = []
    for d in (0, 1):
        u_zr, u_c = p["U"][d][:, :2 * h], p["U"][d][:, 2 * h:]
        state = np.zeros((n, h), np.float32)
        for t in (range(steps) if d == 0 else range(steps - 1, -1, -1)):
            x = inputs[d, t]
            zr = _sigmoid(x[:, :2 * h] + state @ u_zr)
            z, r = zr[:, :h] * mask[t][:, None], zr[:, h:]
            c = np.tanh(x[:, 2 * h:] + (r * state) @ u_c)
            new = state + z * (c - state)
            if keep:
                saved.append((d, t, state, zr, c))
            states[t, :, d * h:(d + 1) * h] = state = new
    att = np.tanh(states @ p["A"] + p["a"])
    e = np.where(mask > 0, att @ p["v"], -1e9)
    e = np.exp(e - e.max(axis=0)) * mask
    alpha = e / np.maximum(e.sum(axis=0), 1e-9)
    pooled = np.einsum("tn,tnh->nh", alpha, states)
    logit = pooled @ p["w"] + p["b"][0]
    return (logit, (states, saved, att, alpha, pooled)) if keep else logit


def backward(p: dict, d_logit: np.ndarray, mask: np.ndarray, kept, inputs_shape) -> tuple[dict, np.ndarray]:
    """Gradients of the recurrent part and of the projected inputs."""
    states, saved, att, alpha, pooled = kept
    h = HIDDEN
    g = {k: np.zeros_like(p[k]) for k in ("U", "A", "a", "v", "w", "b")}
    g["w"], g["b"][0] = pooled.T @ d_logit, d_logit.sum()
    d_pooled = d_logit[:, None] * p["w"]
    d_states = alpha[:, :, None] * d_pooled
    d_alpha = np.einsum("nh,tnh->tn", d_pooled, states)
    d_e = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
    g["v"] = np.einsum("tn,tnk->k", d_e, att)
    d_att = d_e[:, :, None] * p["v"] * (1 - att * att)
    g["a"] = d_att.sum(axis=(0, 1))
    g["A"] = np.einsum("tnh,tnk->hk", states, d_att)
    d_states += d_att @ p["A"].T
    d_inputs = np.zeros(inputs_shape, np.float32)
    carry = {0: 0.0, 1: 0.0}
    for d, t, state, zr, c in reversed(saved):
        u_zr, u_c = p["U"][d][:, :2 * h], p["U"][d][:, 2 * h:]
        z, r, m = zr[:, :h], zr[:, h:], mask[t][:, None]
        d_new = d_states[t, :, d * h:(d + 1) * h] + carry[d]
        d_c = d_new * z * m * (1 - c * c)
        d_z = d_new * (c - state) * m * z * (1 - z)
        d_rs = d_c @ u_c.T
        d_r = d_rs * state * r * (1 - r)
        d_zr = np.concatenate([d_z, d_r], axis=1)
        g["U"][d][:, 2 * h:] += (r * state).T @ d_c
        g["U"][d][:, :2 * h] += state.T @ d_zr
        carry[d] = d_new * (1 - z * m) + d_rs * r + d_zr @ u_zr.T
        d_inputs[d, t] = np.concatenate([d_zr, d_c], axis=1)
    return g, d_inputs


def loss_and_gradients(p: dict, batch: np.ndarray, labels: np.ndarray, words) -> tuple[float, dict]:
    """Mean cross entropy of windows of word numbers (0: none) and all
    gradients. ``words(numbers)`` gives the inputs of words."""
    mask = (batch.T > 0).astype(np.float32)
    used, place = np.unique(batch.T, return_inverse=True)
    place = place.reshape(batch.T.shape)
    inputs = words(np.maximum(used, 1))
    x = embed(p, inputs)
    proj = x @ p["W"] + p["c"][:, None]
    logit, kept = forward(p, proj[:, place], mask, keep=True)
    prob = _sigmoid(logit)
    loss = float(-np.mean(labels * np.log(prob + 1e-7) + (1 - labels) * np.log(1 - prob + 1e-7)))
    g, d_in = backward(p, ((prob - labels) / len(labels)).astype(np.float32), mask, kept, (2, *place.shape, 3 * HIDDEN))
    d_proj = np.zeros_like(proj)
    order = np.argsort(place.ravel(), kind="stable")
    first = np.searchsorted(place.ravel()[order], np.arange(len(used)))
    for d in (0, 1):
        d_proj[d] = np.add.reduceat(d_in[d].reshape(-1, 3 * HIDDEN)[order], first, axis=0)
    g["W"] = x.T @ d_proj
    g["c"] = d_proj.sum(axis=1)
    d_x = (d_proj @ p["W"].transpose(0, 2, 1)).sum(axis=0)
    g["Ew"] = _summed(inputs["word"], d_x[:, :WORD_DIM], p["Ew"])
    for i, n in enumerate(CHAR_ORDERS):
        chars, _, count = inputs[n]
        at = WORD_DIM + CHAR_DIM * i
        each = np.repeat(d_x[:, at:at + CHAR_DIM] / count[:, None], count, axis=0)
        g[f"E{n}"] = _summed(chars, each, p[f"E{n}"])
    return loss, g


def _summed(rows: np.ndarray, values: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Rows of values added up by row number, in the shape of ``like``."""
    columns = [np.bincount(rows, values[:, k], len(like)) for k in range(values.shape[1])]
    return np.stack(columns, axis=1).astype(like.dtype)


def evidence_counts(texts: list[str | None], labels) -> dict:
    """Per kind of input (``word`` and each character order) and bucket: the
    texts that hold the bucket, and the positive ones among them."""
    sizes = {"word": WORD_BUCKETS, **dict.fromkeys(CHAR_ORDERS, 1 << CHAR_BITS)}
    out = {kind: np.zeros((2, size), np.int64) for kind, size in sizes.items()}
    for text, y in zip(texts, labels):
        words = list(set(ascii_words(text)))
        if words:
            inputs = word_inputs(words)
            for kind, (have, pos) in out.items():
                held = np.unique(inputs[kind] if kind == "word" else inputs[kind][0])
                have[held] += 1
                pos[held] += int(y)
    return out


def _evidence(counts: np.ndarray, share: float) -> np.ndarray:
    """Per bucket: how far its document count among the positive documents
    exceeds its share, in standard deviations, squashed."""
    have, pos = counts
    return np.tanh((pos - have * share) / np.sqrt(have * share * (1 - share) + 1) / 6) * 2


def _top(logits: np.ndarray, owner: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(docs, TOP_WINDOWS) highest window logits of each document, falling, and
    the place of its highest."""
    order = np.lexsort((-logits, owner))
    first = np.searchsorted(owner[order], np.arange(docs))
    count = np.bincount(owner, minlength=docs)
    return logits[order[first[:, None] + np.minimum(np.arange(TOP_WINDOWS), count[:, None] - 1)]], order[first]


def teaching_windows(p: dict, epoch: int, texts: list[str | None], labels) -> list[list[bytes]]:
    """Per text the windows, words between blanks, that an epoch trains on: the
    highest of all, and of a clean text one other, by a hash of text and epoch (a
    positive text's other windows may be clean)."""
    _, highest = Scorer(p).top(texts)
    out = []
    for text, y, at in zip(texts, labels, highest):
        words = ascii_words(text)
        starts = window_starts(len(words))
        chosen = [starts[at]]
        if not y:
            chosen.append(starts[zlib.crc32((text or "").encode("utf-8", "replace"), epoch) % len(starts)])
        out.append([b" ".join(words[a:a + WINDOW]) for a in chosen])
    return out


def fit(labels, evidence, choose, top, epochs: int = EPOCHS, seed: int = 7) -> dict:
    """Model from documents with labels of 0 or 1, which ``evidence()``,
    ``choose(model, epoch)`` and ``top(model)`` read, in the order of the labels.
    The first dimensions start as each bucket's evidence; Adam trains everything."""
    p = new_model(seed)
    y = np.asarray(labels, np.float32)
    if not len(y) or not 0 < y.mean() < 1:
        p["w"][:] = 0
        p["b"][0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else -2.0
        return p
    for kind, counts in evidence().items():
        p["Ew" if kind == "word" else f"E{kind}"][:, 0] = _evidence(counts, float(y.mean()))
    p["b"][0] = np.log(y.mean() / (1 - y.mean()))
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    steps = epochs * -(-2 * len(y) // BATCH)
    for epoch in range(epochs):
        number: dict[bytes, int] = {}
        parts, of = [], []
        for d, some in enumerate(choose(p, epoch)):
            for window in some:
                parts.append(windows(np.asarray([number.setdefault(w, len(number) + 1) for w in window.split()], np.int64)))
                of.append(y[d])
        parts, of = np.concatenate(parts), np.asarray(of, np.float32)
        inputs = word_inputs(list(number) or [b"-"])

        def words(numbers):
            return take_words(inputs, numbers - 1)

        pick = rng.permutation(len(parts))
        for at in range(0, len(pick), BATCH):
            some = pick[at:at + BATCH]
            _, g = loss_and_gradients(p, parts[some], of[some], words)
            step += 1
            rate = 0.01 * min(1.0, step / 20) * (1 - 0.9 * step / max(steps, step))
            for k in g:
                m[k] += 0.1 * (g[k] - m[k])
                s[k] += 0.001 * (g[k] * g[k] - s[k])
                p[k] -= rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.999 ** step)) + 1e-6)
    p["top"] = _logistic(top(p), y)
    return p


def train(texts: list[str | None], labels: list[int], **options) -> dict:
    """``fit`` over texts at hand."""
    return fit(labels, lambda: evidence_counts(texts, labels), lambda p, epoch: teaching_windows(p, epoch, texts, labels),
               lambda p: Scorer(p).top(texts)[0], **options)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights and shift of a ridge logistic regression (Newton steps)."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1).astype(float)
    w = np.zeros(x.shape[1])
    w[0] = 1.0
    hold = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(25):
        q = _sigmoid(x @ w)
        grad = x.T @ (q - y) + hold @ w
        w -= np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + hold, grad)
    return w


# --------------------------------------------------------------- scoring
class Scorer:
    """Scores whole texts. Projected inputs of words seen before are kept, up
    to a fixed number of words; row 0 stands for "no word"."""

    def __init__(self, model: dict, known_words: int = KNOWN_WORDS):
        self.p, self.limit = model, known_words
        self._reset()

    def _reset(self):
        self.row: dict[bytes, int] = {}
        self.table = np.zeros((2, 1024, 3 * HIDDEN), np.float32)

    def _learn(self, new: list[bytes]):
        x = embed(self.p, word_inputs(new))
        at = len(self.row) + 1
        while at + len(new) > self.table.shape[1]:
            self.table = np.concatenate([self.table, np.zeros_like(self.table)], axis=1)
        self.table[:, at:at + len(new)] = x @ self.p["W"] + self.p["c"][:, None]
        self.row.update(zip(new, range(at, at + len(new))))

    def _rows(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.row.__getitem__, words), np.int32, len(words))

    def top(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Per text the logits of its highest windows (fewer windows: the lowest
        repeats; no words: a window without words), and the number of the highest."""
        best = np.full((len(texts), TOP_WINDOWS), -np.inf)
        highest = np.zeros(len(texts), np.int64)
        parts, owner, held = [], [], 0

        def flush():
            nonlocal parts, owner, held
            if not held:
                return
            every, own = np.concatenate(parts), np.concatenate([np.full(len(n), i) for i, n in owner])
            number = np.concatenate([n for _, n in owner])
            size = (every > 0).sum(axis=1)
            order = np.argsort(size, kind="stable")  # windows of like length share a batch
            logits = np.zeros(len(every), np.float32)
            for at in range(0, len(every), SCORE_WINDOWS):
                some = order[at:at + SCORE_WINDOWS]
                part = np.ascontiguousarray(every[some, :max(1, size[some[-1]])].T)
                logits[some] = forward(self.p, self.table[:, part], (part > 0).astype(np.float32))
            ids, place = np.unique(own, return_inverse=True)
            new, first = _top(logits, place, len(ids))
            better = new[:, 0] > best[ids, 0]
            highest[ids[better]] = number[first[better]]
            count = np.bincount(place)
            new[np.arange(TOP_WINDOWS) >= count[:, None]] = -np.inf
            best[ids] = -np.sort(-np.concatenate([best[ids], new], axis=1), axis=1)[:, :TOP_WINDOWS]
            parts, owner, held = [], [], 0

        for at in range(0, len(texts), 64):
            lists = [ascii_words(t) for t in texts[at:at + 64]]
            if len(self.row) > self.limit:
                flush()  # row numbers change with the reset
                self._reset()
            new = [w for w in set().union(*lists) if w not in self.row]
            if new:
                self._learn(new)
            for i, words in enumerate(lists, at):
                every = windows(self._rows(words))
                for a in range(0, len(every), 4 * SCORE_WINDOWS):  # a very long text goes in portions
                    w = every[a:a + 4 * SCORE_WINDOWS]
                    parts.append(w)
                    owner.append((i, np.arange(a, a + len(w))))
                    held += len(w)
                    if held >= 4 * SCORE_WINDOWS:
                        flush()
        flush()
        for k in range(1, TOP_WINDOWS):
            best[:, k] = np.where(np.isinf(best[:, k]), best[:, k - 1], best[:, k])
        return best, highest

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability of each text from its highest windows."""
        return _sigmoid(self.top(texts)[0] @ self.p["top"][:-1] + self.p["top"][-1])


def score_column(spark, model: dict):
    """Column function text -> score (0 to 1), with the model broadcast."""
    shared = spark.sparkContext.broadcast(model)

    def run(texts):
        import pandas as pd
        scorer = Scorer(shared.value)
        for text in common.released(texts):
            yield pd.Series(scorer.score([t if isinstance(t, str) else None for t in text]), dtype=float)
    return F.pandas_udf(run, "double", F.PandasUDFType.SCALAR_ITER)


def score_documents(docs: DataFrame, model: dict, name: str = "tox_score") -> DataFrame:
    """``docs`` with a score column (0 to 1; a column of that name is
    replaced). Null and empty texts get the score of a window without words;
    very long texts are scored in all their windows, a bounded number at a
    time; other columns pass unchanged, repeated rows stay."""
    return docs.withColumn(name, score_column(docs.sparkSession, model)("text"))


def _in_tasks(run):
    """``run(ids, texts, labels)`` -> columns, over the batches of a task."""
    def batches_of(batches):
        for batch in common.released(batches):
            ids, texts, labels = (batch.column(i).to_pylist() for i in range(3))
            yield run(ids, texts, labels)
    return batches_of


class Sample:
    """The training documents (doc_id, text, toxic) as a table in the shared
    folder that Spark tasks read for every step of the training."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        self.labels = [r.toxic for r in rows.select("doc_id", "toxic").orderBy("doc_id").collect()]

    def _collect(self, run, schema: str) -> list:
        """Rows of all documents in the order of the labels."""
        return sorted(self.rows.mapInArrow(_in_tasks(run), schema).collect(), key=lambda r: r.doc_id)

    def _with_model(self, model: dict, run, schema: str) -> list:
        shared = self.rows.sparkSession.sparkContext.broadcast(model)
        try:
            return self._collect(lambda ids, texts, labels: run(shared.value, ids, texts, labels), schema)
        finally:
            shared.destroy()

    def evidence(self) -> dict:
        kinds = ["word", *CHAR_ORDERS]

        def run(ids, texts, labels):
            import pyarrow as pa
            counts = evidence_counts(texts, labels)
            held = [np.flatnonzero(counts[k][0]) for k in kinds]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(kinds)), [len(h) for h in held]), pa.int32()), pa.array(np.concatenate(held), pa.int32()),
                 *(pa.array(np.concatenate([counts[k][i][h] for k, h in zip(kinds, held)]), pa.int64()) for i in (0, 1))],
                ["kind", "bucket", "have", "pos"])

        # a row per bucket at most
        got = (self.rows.mapInArrow(_in_tasks(run), "kind int, bucket int, have long, pos long")
               .groupBy("kind", "bucket").agg(F.sum("have").alias("have"), F.sum("pos").alias("pos")).toPandas())
        out = {k: np.zeros((2, WORD_BUCKETS if k == "word" else 1 << CHAR_BITS), np.int64) for k in kinds}
        for i, k in enumerate(kinds):
            of = got[got["kind"] == i]
            out[k][:, of["bucket"]] = of["have"], of["pos"]
        return out

    def choose(self, model: dict, epoch: int) -> list[list[bytes]]:
        def run(p, ids, texts, labels):
            import pyarrow as pa
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(
                teaching_windows(p, epoch, texts, labels), pa.list_(pa.binary()))], ["doc_id", "windows"])
        return [r.windows for r in self._with_model(model, run, "doc_id long, windows array<binary>")]

    def top(self, model: dict) -> np.ndarray:
        def run(p, ids, texts, labels):
            import pyarrow as pa
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(
                list(Scorer(p).top(texts)[0]), pa.list_(pa.float64()))], ["doc_id", "logits"])
        return np.asarray([r.logits for r in self._with_model(model, run, "doc_id long, logits array<double>")])


def train_documents(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, **options) -> dict:
    """Model from a bounded sample of labelled documents outside the
    evaluation fold: the ``train_docs`` label rows with the smallest id
    hashes, each with its whole text. Null labels and ids teach nothing; of
    several label rows for one id the larger label holds; of several texts, the
    smallest. No text reaches the driver; a window's words do, as long as they are."""
    rows = (labels.where(F.col("toxic").isNotNull() & ~common.held_out("doc_id"))
            .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    # at most train_docs rows of two numbers: bounded, so broadcast
    chosen = (docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
              .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
              .select(F.col("doc_id").cast("long"), "text", (F.col("toxic") > 0).cast("int").alias("toxic")))
    held = Sample(common.written(chosen, "toxicity-sample"))
    model = fit(held.labels, held.evidence, held.choose, held.top, **options)
    common.give_back()
    return model


def keep_clean(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """Documents that score below the threshold, columns as they came."""
    return score_documents(docs, model, "__tox").where(F.col("__tox") < threshold).drop("__tox")


def op10_gru_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    model = train_documents(docs, common.table(spark, sf_dir, "labels"))
    scored = score_documents(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", common.held_out("doc_id").alias("held_out"), F.col("tox_score").alias("score"),
                         F.when(F.col("tox_score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
