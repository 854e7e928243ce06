"""Directly addressable codes for token ids.

An id is cut into 8-bit chunks, lowest first. Level 0 holds the first chunk
of every id; level k+1 holds the next chunk of those ids that need one, in
order. A level's continuation bitmap says which of its entries go on, and a
rank directory (entries set before every 512th bit) gives an entry's place in
the next level. Token i is read from at most four places, without decoding any
other token.

Image: ``DAC1``, number of levels (u32), number of ids (u64); per level: its
length (u64), the chunks, the bitmap (8 bits a byte, lowest first) and the
directory (u32 each). All integers are little-endian.
"""

from __future__ import annotations

import numpy as np

MAGIC = b"DAC1"
RANK_BITS = 512


def _directory(bitmap: np.ndarray) -> np.ndarray:
    """Set bits before each block of RANK_BITS bits."""
    per_byte = np.bitwise_count(bitmap).astype(np.uint32)
    starts = np.arange(0, max(1, len(bitmap)), RANK_BITS // 8)
    per_block = np.add.reduceat(per_byte, starts) if len(bitmap) else np.zeros(1, np.uint32)
    return np.concatenate([[0], np.cumsum(per_block)[:-1]]).astype("<u4")


def encode(ids: np.ndarray) -> bytes:
    """Image of an array of ids below 2**32."""
    rest = np.ascontiguousarray(ids, dtype=np.uint32)
    parts = []
    while True:
        more = rest > 0xFF
        bitmap = np.packbits(more, bitorder="little")
        parts += [np.uint64(len(rest)).tobytes(), (rest & 0xFF).astype(np.uint8).tobytes(),
                  bitmap.tobytes(), _directory(bitmap).tobytes()]
        rest = rest[more] >> 8
        if not len(rest):
            break
    return b"".join([MAGIC, np.uint32(len(parts) // 4).tobytes(), np.uint64(len(ids)).tobytes(), *parts])


class Reader:
    """Random access into an image (bytes or memory map); nothing is copied."""

    def __init__(self, image):
        buf = memoryview(image)
        if bytes(buf[:4]) != MAGIC:
            raise ValueError("not a token image")
        levels = int(np.frombuffer(buf, "<u4", 1, 4)[0])
        self.n = int(np.frombuffer(buf, "<u8", 1, 8)[0])
        at, self.levels = 16, []
        for _ in range(levels):
            n = int(np.frombuffer(buf, "<u8", 1, at)[0])
            at += 8
            chunks = np.frombuffer(buf, np.uint8, n, at)
            at += n
            bits = (n + 7) // 8
            bitmap = np.frombuffer(buf, np.uint8, bits, at)
            at += bits
            blocks = max(1, -(-bits // (RANK_BITS // 8)))
            directory = np.frombuffer(buf, "<u4", blocks, at)
            at += 4 * blocks
            self.levels.append((chunks, bitmap, directory))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        """Id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value, shift = 0, 0
        for chunks, bitmap, directory in self.levels:
            value |= int(chunks[i]) << shift
            byte = i >> 3
            if not bitmap[byte] >> (i & 7) & 1:
                break
            first = i // RANK_BITS * (RANK_BITS // 8)
            below = int(bitmap[byte]) & ((1 << (i & 7)) - 1)
            i = int(directory[i // RANK_BITS]) + int(np.bitwise_count(bitmap[first:byte]).sum()) + below.bit_count()
            shift += 8
        return value

    def take(self, places: np.ndarray) -> np.ndarray:
        """Ids at many places, in the order given."""
        return np.fromiter((self[int(i)] for i in places), np.uint32, len(places))

    def all(self) -> np.ndarray:
        """Every id, level by level."""
        out = np.zeros(0, np.uint32)
        for chunks, bitmap, _ in reversed(self.levels):
            values = chunks.astype(np.uint32)
            if len(out):
                more = np.unpackbits(bitmap, count=len(chunks), bitorder="little").astype(bool)
                values[more] |= out << 8
            out = values
        return out
