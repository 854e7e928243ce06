"""Token ids of whole texts, with the public tokenizer files.

The tokenizer file is a parameter (a local path that exists on every worker,
as an installed package gives it). A text is cut at blanks and newlines, which
no token of a tokenizer with a white-space-dropping pre-tokenizer crosses, and
each distinct piece is encoded once by the library and remembered per Python
worker. The memory has two generations of a fixed number of pieces: a piece that is
used moves to the young one, and when that is full the old one, with all that was not
used since, is let go. The ids equal those of encoding the whole text;
``tests/llm/test_tokens.py`` compares the two.
"""

from __future__ import annotations

import os

import numpy as np

CACHE_PIECES = 450_000  # of a generation
PORTION_BYTES = 4 << 20
_ENCODERS: dict[str, "Encoder"] = {}


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


class _Later(bytes):
    """A piece that has to be encoded first."""


class _Known(dict):
    """Piece -> id bytes, the young generation. Letters with one full stop or comma
    behind them are put together from the two parts, which the pre-tokenizer
    always separates; pieces that have to be encoded first are noted in ``wanted``."""

    def __init__(self):
        super().__init__({b"": b""})
        self.old: dict[bytes, bytes] = {}
        self.wanted: set[bytes] = set()

    def __missing__(self, piece: bytes) -> bytes:
        ids = self.old.get(piece)
        if ids is not None:
            self[piece] = ids
            return ids
        stem, stop = piece[:-1], piece[-1:]
        if (stop == b"," or stop == b".") and stem.isalpha():
            first, last = self.get(stem) or self.old.get(stem), self.get(stop) or self.old.get(stop)
            if first and last:
                # remembered too: the next time it is one look
                self[piece] = ids = first + last
                return ids
            self.wanted.update((stem, stop))
        else:
            self.wanted.add(piece)
        return _Later(piece)

    def turn(self) -> None:
        """The young generation becomes the old one."""
        self.old = dict(self)
        self.clear()
        self[b""] = b""


class Encoder:
    """Encodes texts to little-endian uint32 id bytes. For tokenizers that
    lower-case, drop white space and part letters from punctuation."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(path)
        self.limit = cache_pieces
        self.known = _Known()

    def _learn(self) -> None:
        pieces = [p for p in self.known.wanted if p not in self.known]
        got = self.lib.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)
        self.known.update((p, np.asarray(e.ids, "<u4").tobytes()) for p, e in zip(pieces, got))
        self.known.wanted.clear()

    def encode(self, texts: list[str | None], end: bytes = b"") -> list[bytes]:
        """Id bytes of each text (null: empty), each followed by ``end``."""
        if len(self.known) > self.limit:
            self.known.turn()
        lists, get = [], self.known.__getitem__
        for text in texts:
            raw = (text or "").encode("utf-8", "replace")
            if b"<|" not in raw:  # else a special token's name might arise
                raw = raw.lower()
            lists.append(list(map(get, raw.replace(b"\n", b" ").split(b" "))))
        if self.known.wanted:
            self._learn()
            lists = [[x if x.__class__ is bytes else get(bytes(x)) for x in ids] for ids in lists]
        return [b"".join(ids) + end for ids in lists]


def portions(texts, limit: int = PORTION_BYTES) -> list[tuple[int, int]]:
    """(first, count) of consecutive rows of an Arrow text column that hold about
    ``limit`` bytes together (a longer text alone): many pieces are learned at a time,
    and what a call holds does not depend on how long texts are."""
    import pyarrow.compute as pc
    out, first, size = [], 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if size + n > limit and i > first:
            out.append((first, i - first))
            first, size = i, 0
        size += n
    if len(texts) > first:
        out.append((first, len(texts) - first))
    return out


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file (kept between tasks)."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
