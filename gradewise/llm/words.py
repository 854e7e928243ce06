"""Words of a text as bytes, by ASCII rules (other bytes belong to words)."""

from __future__ import annotations

from functools import cache

# A-Z to a-z; bytes 00-2F, 3A-60 (after lower-casing) and 7B-7F to a blank.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b
              for b in range(256))


def ascii_words(text: str | None) -> list[bytes]:
    """Lower-cased maximal runs of letters, digits and non-ASCII characters:
    ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Null: none."""
    return text.encode("utf-8", "replace").translate(_FOLD).split() if text else []


def blank_words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, cut at ASCII white space: ``[^\\x20\\x09-\\x0D]+``."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def folded(text: str | None) -> bytes:
    """The text's bytes after the folding of ``ascii_words``."""
    return text.encode("utf-8", "replace").translate(_FOLD) if text else b""


def lowered(text: str | None) -> bytes:
    """The text's bytes after the folding of ``blank_words``."""
    return text.encode("utf-8", "replace").lower() if text else b""


_SEGMENT = 1 << 19
_STEP = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


@cache
def _tables():
    import numpy as np
    byte = np.random.default_rng(64).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    power, inverse = (np.full(_SEGMENT + 1, x, np.uint64) for x in (_STEP, pow(_STEP, -1, 1 << 64)))
    power[0] = inverse[0] = 1
    power, inverse = np.cumprod(power, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)
    blank = np.zeros(256, bool)
    blank[[0x20, *range(9, 14)]] = True
    return byte, power, inverse, blank


def word_hashes(raw: bytes):
    """64-bit hashes, in order, of the words between ASCII white space
    (uint64 array): random values of a word's bytes, each times a power by its
    place in the word, summed over running sums, and mixed. The bytes go through
    in segments of bounded size; a word that a segment's end cuts keeps its sum
    and the power of its next place for the segments behind."""
    import numpy as np
    byte, power, inverse, blank = _tables()
    every = np.frombuffer(raw, np.uint8)
    parts, held, scale = [], 0, 0  # scale 0: no word is open
    for at in range(0, len(every), _SEGMENT):
        codes = every[at:at + _SEGMENT]
        inside = np.zeros(len(codes) + 2, bool)
        np.logical_not(blank[codes], out=inside[1:-1])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[::2], edge[1::2]
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(byte[codes] * power[:len(codes)], out=sums[1:])
        own = (sums[end] - sums[start]) * inverse[start]
        if scale:
            if inside[1]:
                own[0] = (held + scale * int(own[0])) % (1 << 64)
            else:
                own = np.append(np.uint64(held), own)
        length = int(end[-1] - start[-1]) if len(end) else 0
        before, scale = scale, 0
        if inside[-2] and at + _SEGMENT < len(every):
            held, own = int(own[-1]), own[:-1]
            scale = (before if before and length == len(codes) else 1) * pow(_STEP, length, 1 << 64) % (1 << 64)
        parts.append(own)
    if not parts:
        return np.zeros(0, np.uint64)
    return mix(parts[0] if len(parts) == 1 else np.concatenate(parts))


def mix(x):
    """A 64-bit finalizer over a uint64 array."""
    import numpy as np
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(hashes, k: int):
    """Hashes of the runs of k consecutive words (empty with fewer words)."""
    import numpy as np
    n = len(hashes) - k + 1
    if n <= 0:
        return hashes[:0]
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = (out + hashes[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out
