"""Best-fit packing of document pieces into fixed-size sequences.

Hierarchical residual packing: pieces are dealt to tasks of bounded size and
packed there by best-fit decreasing. Nearly full bins are done. The underfull
ones go on as items, the bins of up to ``fan_in`` neighbouring tasks to one
task of the next round, until one task is left; a small forest of (bin, parent
bin, shift) rows then gives every piece its sequence and place.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from gradewise.llm import common, tokens

CAPACITY = 4096
PIECES = "row_id long, doc_id long, piece int, start long, length long, ids_crc32 long"
TASK_PIECES = 1 << 15
FAN_IN = 16
KEEP_WIDE = 4096


def cut_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 1,
               with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every document: its ids and the
    end id, cut only when longer. A null text counts as empty (one piece
    holding the end id). ``with_ids`` adds the ids themselves."""
    tokenizer = tokenizer or tokens.default_tokenizer()
    schema = PIECES.replace("row_id long, ", "") + (", ids array<int>" if with_ids else "")

    def run(batches):
        import pyarrow as pa
        enc = tokens.encoder(tokenizer)
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            for at, count in tokens.portions(batch.column(1)):
                cols = [[], [], [], [], [], []]
                texts = batch.column(1).slice(at, count).to_pylist()
                for doc_id, blob in zip(batch.column(0).slice(at, count).to_pylist(), enc.encode(texts, end)):
                    raw = memoryview(blob)
                    for piece, b in enumerate(range(0, len(blob), 4 * capacity)):
                        part = raw[b:b + 4 * capacity]
                        row = (doc_id, piece, b // 4, len(part) // 4, zlib.crc32(part))
                        for c, v in zip(cols, row):
                            c.append(v)
                        if with_ids:
                            cols[5].append(np.frombuffer(part, "<u4").astype(np.int32))
                arrays = [pa.array(c, t) for c, t in zip(
                    cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array(cols[5], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best-fit decreasing: (bin, offset) of every item and every bin's load.
    Bins wait in one stack per free space; a bit per non-empty stack makes
    "least free space that still fits" one shift and one lowest-bit step."""
    where = np.empty(len(lengths), np.int64)
    offset = np.empty(len(lengths), np.int64)
    loads: list[int] = []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    free_bits = 0
    for item in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[item])
        fits = free_bits >> need
        if fits:
            free = need + ((fits & -fits).bit_length() - 1)
            b = stacks[free].pop()
            if not stacks[free]:
                free_bits &= ~(1 << free)
        else:
            free, b = capacity, len(loads)
            loads.append(0)
        where[item], offset[item] = b, loads[b]
        loads[b] += need
        left = free - need
        if left:
            stacks[left].append(b)
            free_bits |= 1 << left
    return where, offset, loads


def _round(capacity: int, slack: int, wide: int):
    """One task's packing: a row per item (kind 0) and a row per bin that goes
    on to the next round (kind 1). Best fit leaves at most one bin no more
    than half full; only such light bins can take or join another, one partner
    each, so the ``wide`` emptiest of the other bins are as good as all."""
    def run(key, pdf):
        import pandas as pd
        node = int(key[0])
        pdf = pdf.sort_values("item", kind="stable")
        where, offset, loads = best_fit(pdf["length"].to_numpy(), capacity)
        bins = np.arange(len(loads), dtype=np.int64) + (np.int64(node) << 32)
        out = pd.DataFrame({"kind": 0, "node": node, "item": pdf["item"].to_numpy(), "bin": bins[where],
                            "shift": offset, "length": pdf["length"].to_numpy()})
        load = np.asarray(loads, np.int64)
        open_ = np.flatnonzero(capacity - load >= slack)
        open_ = open_[np.argsort(load[open_], kind="stable")][:wide + 1]
        on = pd.DataFrame({"kind": 1, "node": node, "item": bins[open_], "bin": bins[open_],
                           "shift": 0, "length": load[open_]})
        return pd.concat([out, on])
    return run


ROUND = "kind int, node long, item long, bin long, shift long, length long"


def pack(pieces: DataFrame, capacity: int = CAPACITY, task_pieces: int = TASK_PIECES, fan_in: int = FAN_IN,
         slack: int = 1, wide: int = KEEP_WIDE) -> DataFrame:
    """``sequence_id`` and ``offset`` for every row of ``pieces`` (columns
    ``row_id``, unique and stable, and ``length``, at most ``capacity``). The
    number of first-round tasks follows the number of pieces, the number of
    rounds its logarithm; every round is a written table. Empty input gives an
    empty result."""
    n = pieces.count()
    tasks = max(1, -(-n // task_pieces))
    items = pieces.select(F.col("row_id").alias("item"), F.col("length"),
                          F.pmod(F.xxhash64("row_id"), F.lit(tasks)).cast("long").alias("node"))
    level = common.written(items.groupBy("node").applyInPandas(_round(capacity, slack, wide), ROUND), "pack")
    placed = level.where("kind = 0").select(F.col("item").alias("row_id"), "bin", F.col("shift").alias("offset"))
    steps = []
    number = 0
    while tasks > 1:
        tasks, number = -(-tasks // fan_in), number + 1
        # bins of round r are numbered apart from those of other rounds
        items = level.where("kind = 1").select(
            "item", "length", F.floor(F.col("node") / fan_in).alias("node"))
        packed = items.groupBy("node").applyInPandas(_round(capacity, slack, wide), ROUND)
        tag = F.lit(number << 56)
        level = common.written(packed.withColumn("bin", F.col("bin").bitwiseOR(tag)).withColumn(
            "item", F.when(F.col("kind") == 1, F.col("item").bitwiseOR(tag)).otherwise(F.col("item"))), "pack")
        steps.append(level.where("kind = 0").select(F.col("item").alias("child"), F.col("bin").alias("parent"), "shift"))
    final = None  # (bin that went on, its last bin, shift), from the last round back
    for step in reversed(steps):
        if final is None:
            final = step
        else:
            up = final.select(F.col("child").alias("parent"), F.col("parent").alias("top"), F.col("shift").alias("more"))
            step = step.join(up, "parent", "left").select(
                "child", F.coalesce("top", "parent").alias("parent"),
                (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
            final = step
    if final is not None:
        up = final.select(F.col("child").alias("bin"), "parent", "shift")
        placed = placed.join(up, "bin", "left").select(
            "row_id", F.coalesce("parent", "bin").alias("bin"),
            (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
    return placed.select("row_id", F.col("bin").alias("sequence_id"), F.col("offset").cast("long").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, **options) -> DataFrame:
    """Every piece of every document with its sequence and place.

    Null and empty texts give one piece with the end id; only documents above
    ``capacity`` ids are cut; repeated rows and null ids are packed like any
    other; other columns are ignored; an empty table gives an empty result.
    Offsets within a sequence are gapless from 0."""
    pieces = common.written(
        cut_pieces(docs, tokenizer, capacity).withColumn("row_id", F.monotonically_increasing_id()), "pieces")
    return pieces.join(pack(pieces, capacity, **options), "row_id").select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(packed: DataFrame, pieces: DataFrame) -> DataFrame:
    """The packed sequences themselves: ids in order of place, at most the
    capacity per row. ``pieces``: ``cut_pieces(..., with_ids=True)`` of
    documents with distinct ids."""
    return (packed.join(pieces.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
            .groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
            .select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids")))


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(common.documents(spark, sf_dir))
