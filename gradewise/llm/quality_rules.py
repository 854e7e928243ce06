"""Quality rules with compression bands.

Base rules count words, symbols, repeated lines and repeated windows of eight
words. The method's own rule compresses text with zstandard and looks at the
ratio of compressed to plain bytes: repetitive text shrinks too far, random or
encoded text not far enough. What a ratio should be depends on the length (a
short text cannot shrink much), so each length has a band of its own. The whole
document must lie in its band, and so must its fixed chunks: those outside may
hold at most ``MAX_BAD_SHARE`` of the bytes.

Every text is read whole, in its own row; nothing is shuffled, and no limit
depends on the table.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame

from gradewise.llm import common
from gradewise.llm.words import gram_hashes, word_hashes

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
LEVEL = 3
CHUNK_BYTES = 4096
MAX_BAD_SHARE = 0.3
NO_LIMIT = float("inf")

# (bytes from, least ratio, largest ratio). Prose of any of the usual alphabets
# lies between 0.3 (long) and 0.9 (short); base64 stays near 0.76, random bytes near 1,
# and a line repeated over and over below 0.1.
BANDS = [
    (0, 0.0, NO_LIMIT),
    (128, 0.30, 1.00),
    (256, 0.30, 0.90),
    (512, 0.25, 0.80),
    (1024, 0.22, 0.74),
    (4096, 0.17, 0.70),
    (16384, 0.12, 0.68),
    (65536, 0.08, 0.66),
]

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
BANDED = "whole_ratio double, n_chunks long, bad_chunk_bytes long"
VERDICT = "base_failed boolean, kept boolean, reason string"
OUT = f"doc_id long, {BASE}, {VERDICT}, {BANDED}"

_BLANKS = b" \t\n\v\f\r"
_SYMBOLS = b"#*$%&|<>"


def repeated_words(hashes) -> int:
    """Words that lie in a window of eight words which stands twice or more in
    the text, each word counted once. Windows are compared by 64-bit hashes."""
    import numpy as np
    grams = gram_hashes(hashes, WINDOW)
    if len(grams) < 2:
        return 0
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    again = np.zeros(len(grams) + 1, np.int64)
    again[order[1:][same]] = 1
    again[order[:-1][same]] = 1
    if not same.any():
        return 0
    # a word is covered if one of the windows that start up to seven words before it is repeated
    edge = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(again)
    edge[at] += 1
    np.subtract.at(edge, at + WINDOW, 1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def base_counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of UTF-8 bytes."""
    import numpy as np
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if raw else np.zeros(256, np.int64)
    code_points = int(counts[:0x80].sum() + counts[0xC0:].sum())
    blanks = int(counts[list(_BLANKS)].sum())
    lines = [x for x in raw.split(b"\n") if x.strip(_BLANKS)]
    hashes = word_hashes(raw)
    return (len(hashes), code_points - blanks, int(counts[list(_SYMBOLS)].sum()), len(lines) - len(set(lines)),
            repeated_words(hashes))


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


def outside(length: int, ratio: float, bands=BANDS) -> str | None:
    """``repetitive`` or ``incompressible`` if the ratio is outside the band of
    this length, else None."""
    _, low, high = bands[bisect_right(bands, (length, NO_LIMIT, NO_LIMIT)) - 1]
    return "repetitive" if ratio < low else "incompressible" if ratio > high else None


def chunks(raw: bytes, size: int = CHUNK_BYTES) -> list[bytes]:
    """Chunks of ``size`` bytes; a rest under half a chunk stays with the last."""
    n = max(1, (len(raw) + size // 2) // size)
    return [raw[i * size:(i + 1) * size if i < n - 1 else len(raw)] for i in range(n)]


def compression_verdict(raw: bytes, compressor, bands=BANDS, size: int = CHUNK_BYTES,
                        max_bad: float = MAX_BAD_SHARE) -> tuple[str | None, float, int, int]:
    """(reason or None, ratio of the whole, number of chunks, bytes in chunks
    outside their band). An empty text has ratio 1 and no reason."""
    if not raw:
        return None, 1.0, 0, 0
    whole = len(compressor.compress(raw)) / len(raw)
    reason = outside(len(raw), whole, bands)
    parts = chunks(raw, size)
    if len(parts) == 1:
        return reason and f"whole text {reason}", whole, 1, len(raw) if reason else 0
    found = [(len(p), outside(len(p), len(compressor.compress(p)) / len(p), bands)) for p in parts]
    bad = sum(n for n, why in found if why)
    if reason is None and bad > max_bad * len(raw):
        worst = max(("repetitive", "incompressible"), key=lambda k: sum(n for n, why in found if why == k))
        return f"chunks {worst}", whole, len(parts), bad
    return reason and f"whole text {reason}", whole, len(parts), bad


def judge(text: str | None, compressor, bands=BANDS) -> tuple:
    """The columns of BASE, VERDICT and BANDED of one text."""
    raw = text.encode("utf-8", "replace") if text else b""
    counts = base_counts(raw)
    failed = base_failed(counts[0], counts[4])
    why, ratio, n, bad = compression_verdict(raw, compressor, bands)
    reason = ("too few words" if counts[0] < MIN_WORDS else "repeated windows") if failed else why
    return (*counts, failed, reason is None, reason, ratio, n, bad)


def quality(docs: DataFrame, bands=BANDS) -> DataFrame:
    """One row per document, in the columns of OUT.

    Null and empty texts have no words and fail; a null id stays null; repeated
    rows give repeated results; an empty table gives an empty result; columns
    beyond doc_id and text are ignored, whatever their names. The words of a
    text are cut at the six ASCII blanks only, case kept."""
    def run(batches):
        import pyarrow as pa
        import zstandard
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        i64, f64, yes = pa.int64(), pa.float64(), pa.bool_()
        types = [i64, i64, i64, i64, i64, yes, yes, pa.string(), f64, i64, i64]
        names = [c.split()[0] for c in OUT.split(", ")]
        for batch in batches:
            ids, texts = batch.columns
            rows = [judge(t.as_py(), compressor, bands) for t in texts]
            cols = list(zip(*rows)) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(cols, types))], names)

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, OUT)


def keep_good(docs: DataFrame, bands=BANDS) -> DataFrame:
    """The documents that pass, with their columns as they came: the verdict is
    taken in the row itself, so no id has to be unique."""
    from pyspark.sql import functions as F

    @F.pandas_udf("boolean")
    def passes(text):
        import pandas as pd
        import zstandard
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        return pd.Series([judge(t if isinstance(t, str) else None, compressor, bands)[6] for t in text], dtype=bool)
    return docs.where(passes("text"))


def op11_compression_bands(spark, sf_dir: str) -> DataFrame:
    return quality(common.documents(spark, sf_dir))
