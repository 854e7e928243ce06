"""Minimax contiguous sharding (DataFrame functions only).

Rows with equal texts form one atomic group. Groups are ordered by a 64-bit
hash of their text, so "an ordered run of groups" is "a range of hash
values" and every question about the order is an aggregation by hash prefix:
no global sort and no global window. The smallest feasible shard capacity is
found by binary search with a greedy check on the driver over *block sums*
(at most 2**16 blocks, whatever the table's size). A block that a cut may fall
into and that still holds several groups is split by eight more hash bits in
one Spark job, until every cut that matters lies between two groups; the
capacity is then exact. Shards are cut there, filling each shard up to its
share of what remains, never above that capacity.
"""

from __future__ import annotations

import bisect
import itertools

from pyspark.sql import Column, DataFrame, functions as F

from gradewise.llm import common

TOP_BITS = 16      # first level: at most 2**16 block sums reach the driver
STEP_BITS = 8      # each split refines the few blocks a cut falls into
SLOT_BLOCK = 1 << 16


def text_key(text: Column) -> Column:
    """Order key of a group: hash of the text (null counts as empty). Two
    different texts that share all 64 bits stay together, which is harmless."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


class _Blocks:
    """Ordered blocks of groups on the driver: start key (unsigned), bytes,
    and whether the block is one group. Splits blocks on demand."""

    def __init__(self, rows: DataFrame, top_bits: int, step_bits: int):
        self.rows, self.step = rows, step_bits
        self.blocks = self._sums(rows, top_bits)  # [(prefix, bits, bytes, atomic)]
        self._index()

    @staticmethod
    def _sums(rows: DataFrame, bits: int):
        prefix = F.shiftrightunsigned("key", 64 - bits).cast("decimal(20,0)") if bits < 64 else \
            F.when(F.col("key") < 0, F.col("key").cast("decimal(20,0)") + F.lit(2 ** 64).cast("decimal(20,0)")
                   ).otherwise(F.col("key").cast("decimal(20,0)"))
        got = (rows.groupBy(prefix.alias("p"))
               .agg(F.sum("size").alias("bytes"), (F.min("key") == F.max("key")).alias("atomic"))
               .collect())
        return sorted((int(r.p), bits, int(r.bytes), r.atomic or bits == 64) for r in got)

    def _index(self):
        self.blocks.sort(key=lambda b: b[0] << (64 - b[1]))
        self.starts = [b[0] << (64 - b[1]) for b in self.blocks]
        self.prefix = list(itertools.accumulate((b[2] for b in self.blocks), initial=0))
        self.total = self.prefix[-1]

    def split(self, which: set[int]):
        """Replace the blocks at these positions by blocks of finer prefixes."""
        todo = [i for i in sorted(which) if not self.blocks[i][3]]
        keep = [b for i, b in enumerate(self.blocks) if i not in set(todo)]
        for bits in sorted({self.blocks[i][1] for i in todo}):
            prefixes = [self.blocks[i][0] for i in todo if self.blocks[i][1] == bits]
            inside = self.rows.where(F.shiftrightunsigned("key", 64 - bits).isin(prefixes))
            keep += self._sums(inside, min(64, bits + self.step))
        self.blocks = keep
        self._index()

    def atomic(self, i: int) -> bool:
        return i >= len(self.blocks) or self.blocks[i][3]

    # a position is (block index, bytes before it); fluid cuts may lie inside a block
    def greedy(self, cap: int, shards: int, start: int = 0, fluid: bool = False) -> list[int] | None:
        """Cut positions (in bytes) of the greedy filling, or None when the
        blocks do not fit. ``fluid`` lets a cut fall inside an unsplit block."""
        cuts, at = [], start
        for _ in range(shards):
            to = at + cap
            if to >= self.total:
                return cuts + [self.total] * (shards - len(cuts))
            i = bisect.bisect_right(self.prefix, to) - 1
            if not (fluid and not self.blocks[i][3]):
                to = self.prefix[i]
            if to <= at:
                return None
            cuts.append(to)
            at = to
        return None

    def smallest(self, shards: int, fluid: bool) -> int:
        lo = -(-self.total // shards)
        lo = max([lo, *(b[2] for b in self.blocks if b[3] or not fluid)])
        hi = max(lo, self.total)
        while lo < hi:
            mid = (lo + hi) // 2
            if self.greedy(mid, shards, fluid=fluid) is None:
                lo = mid + 1
            else:
                hi = mid
        return lo

    def inside(self, at: int) -> int | None:
        """The block strictly inside which this byte position lies, if it is
        not a single group."""
        i = bisect.bisect_right(self.prefix, at) - 1
        if i < len(self.blocks) and self.prefix[i] < at < self.prefix[i + 1] and not self.blocks[i][3]:
            return i
        return None


def capacity(blocks: _Blocks, shards: int) -> int:
    """Smallest capacity for which the groups fit, in order, into ``shards``
    runs. Between the fluid bound (below) and the bound with whole blocks
    (above) only blocks between corresponding cuts matter; they are split
    until both bounds agree."""
    while True:
        lo = blocks.smallest(shards, fluid=True)
        whole = blocks.greedy(lo, shards)
        if whole is not None:
            return lo
        hi = blocks.smallest(shards, fluid=False)
        low, high = blocks.greedy(lo, shards, fluid=True), blocks.greedy(hi, shards, fluid=True)
        which: set[int] = set()
        for a, b in zip(low, high or low):
            i = max(0, bisect.bisect_right(blocks.prefix, a) - 1)
            j = min(len(blocks.blocks) - 1, bisect.bisect_right(blocks.prefix, b) - 1)
            which.update(k for k in range(i, j + 1) if not blocks.blocks[k][3])
        which.update(k for k, x in enumerate(blocks.blocks) if x[2] > lo and not x[3])
        if not which:
            return hi
        blocks.split(which)


def cut_keys(blocks: _Blocks, shards: int, cap: int) -> list[int]:
    """Start keys (unsigned) of shards 1..shards-1. Each shard ends at the
    group boundary nearest to its share of what remains, never above the
    capacity and never so early that the rest would not fit."""
    while True:
        at, cuts, split = 0, [], None
        for left in range(shards, 1, -1):
            if at >= blocks.total:
                cuts.append(blocks.total)
                continue
            want = at + (blocks.total - at) / left
            i = bisect.bisect_right(blocks.prefix, want) - 1
            if i < len(blocks.blocks) and blocks.prefix[i] < want and not blocks.blocks[i][3]:
                split = {i}
                break
            below, above = blocks.prefix[i], blocks.prefix[min(i + 1, len(blocks.blocks))]
            options = sorted((x for x in {below, above} if at < x <= at + cap),
                             key=lambda x: (abs(x - want), x))
            at = next((x for x in options if blocks.greedy(cap, left - 1, start=x) is not None or x == blocks.total),
                      None)
            if at is None:  # only a fuller shard leaves a rest that fits
                prev = cuts[-1] if cuts else 0
                inner = blocks.inside(prev + cap)
                if inner is not None:
                    split = {inner}
                    break
                at = blocks.prefix[bisect.bisect_right(blocks.prefix, prev + cap) - 1]
            cuts.append(at)
        if split is None:
            break
        blocks.split(split)
    ends = [bisect.bisect_left(blocks.prefix, c) for c in cuts]
    return [blocks.starts[i] if i < len(blocks.starts) else 1 << 64 for i in ends]


def _signed(u: int) -> int:
    return u - (1 << 64) if u >= 1 << 63 else u


def _shard_of(key: Column, cuts: list[int]) -> Column:
    """Number of cuts at or below the key, in unsigned order (flip the sign
    bit, then signed order is unsigned order)."""
    flip = -(1 << 63)
    flipped = key.bitwiseXOR(F.lit(flip))
    inside = [c for c in cuts if c < 1 << 64]
    if not inside:
        return F.lit(0)
    values = F.array(*[F.lit(_signed(c ^ (1 << 63))).cast("long") for c in inside])
    return F.size(F.filter(values, lambda c: c <= flipped)).cast("int")


def shard_rows(rows: DataFrame, shards: int, top_bits: int = TOP_BITS, step_bits: int = STEP_BITS,
               slot_block: int = SLOT_BLOCK) -> DataFrame:
    """Shard and slot for every row of a table with ``key`` (order of the
    group), ``size`` and ``row_id`` (unique long, stable on recomputation).

    Slots are numbered per shard in row_id order: a window inside (shard,
    block of row_id), at most ``slot_block`` rows each, plus the running count
    of the blocks before it. Empty input gives an empty result."""
    blocks = _Blocks(rows.select("key", "size"), top_bits, step_bits)
    cuts = cut_keys(blocks, shards, capacity(blocks, shards)) if blocks.blocks else []
    width = slot_block.bit_length() - 1
    placed = (rows.withColumn("shard", _shard_of(F.col("key"), cuts))
              .withColumn("__blk", F.shiftright("row_id", width)))
    per = placed.groupBy("shard", "__blk").agg(F.count("*").alias("__n"))
    from pyspark.sql import Window
    before = per.select("shard", "__blk", (F.sum("__n").over(
        Window.partitionBy("shard").orderBy("__blk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    ).alias("__before"))
    number = F.row_number().over(Window.partitionBy("shard", "__blk").orderBy("row_id"))
    return (placed.withColumn("__i", number).join(before, ["shard", "__blk"])
            .withColumn("slot", F.col("__before") + F.col("__i") - 1)
            .drop("__blk", "__i", "__before", "row_id", "key"))


def shard_documents(docs: DataFrame, shards: int = 24, **options) -> DataFrame:
    """Put documents into ``shards`` contiguous shards of near-equal bytes.

    Size is the text's UTF-8 bytes plus 8; a null text counts as no bytes and
    groups with the empty text. Rows with equal texts are never split, so one
    text holding a third of all bytes makes one large shard and the rest is
    spread evenly over the others. Repeated rows stay repeated; a null doc_id
    is kept; an empty table gives an empty result; other columns are ignored.
    Law ``bytes``: ``grown_shard`` is null."""
    text = F.coalesce(F.col("text"), F.lit(""))
    raw = text.cast("binary")
    narrow = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"),
                         F.crc32(raw).alias("text_crc32"), text_key(F.col("text")).alias("key"))
    rows = common.written(narrow.withColumn("row_id", F.monotonically_increasing_id()), "shard-rows")
    return shard_rows(rows, shards, **options).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op9_minimax_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(common.documents(spark, sf_dir))
