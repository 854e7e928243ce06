"""Token files: all documents' ids in ascending doc_id order, as directly
addressable codes, with random access to any token.

Layout of a token folder: a Parquet table with one row per segment, written by
Spark (its commit protocol covers retried and lost tasks, on any store). A
segment holds whole documents, about ``segment_tokens`` ids of them, and its
``image`` column is a complete image in the format of ``dac``. ``part`` and
``segment`` order the segments; ``local_start`` counts the ids before the
segment within its part, so a part's place in the whole needs one number per
part and no global window.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gradewise.llm import common, dac, tokens

END_ID = 1
SEGMENT_TOKENS = 1 << 20
SEGMENT = ("part int, segment int, local_start long, n_tokens long, doc_ids array<long>, "
           "lengths array<int>, image binary")


def _segments(tokenizer: str, end_id: int, segment_tokens: int):
    def run(batches):
        import pyarrow as pa
        enc = tokens.encoder(tokenizer)
        end = np.asarray([end_id], "<u4").tobytes()
        part, state = TaskContext.get().partitionId(), {"segment": 0, "start": 0}
        ids, blobs, size = [], [], 0

        def flush():
            codes = np.frombuffer(b"".join(blobs), "<u4")
            row = pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "segment": pa.array([state["segment"]], pa.int32()),
                "local_start": pa.array([state["start"]], pa.int64()),
                "n_tokens": pa.array([len(codes)], pa.int64()),
                "doc_ids": pa.array([ids], pa.list_(pa.int64())),
                "lengths": pa.array([[len(b) // 4 for b in blobs]], pa.list_(pa.int32())),
                "image": pa.array([dac.encode(codes)], pa.binary())})
            state["segment"] += 1
            state["start"] += len(codes)
            return row

        for batch in batches:
            texts = batch.column(1)
            for at, count in tokens.portions(texts):
                part_texts = texts.slice(at, count).to_pylist()
                for doc_id, blob in zip(batch.column(0).slice(at, count).to_pylist(), enc.encode(part_texts, end)):
                    ids.append(doc_id)
                    blobs.append(blob)
                    size += len(blob) // 4
                    if size >= segment_tokens:
                        yield flush()
                        ids, blobs, size = [], [], 0
        if ids:
            yield flush()
    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID,
                 segment_tokens: int = SEGMENT_TOKENS) -> None:
    """Write the ids of every whole text to a token folder, in ascending
    doc_id order (null ids first, equal ids by text). A null text counts as
    empty; every document ends with ``end_id``. Repeated rows are all written;
    other columns are ignored; an empty table gives a folder without segments.
    One task holds the ids of one segment and one document at a time."""
    tokenizer = tokenizer or tokens.default_tokenizer()
    ordered = (docs.select("doc_id", "text")
               .repartitionByRange(common.shuffle_partitions(docs.sparkSession), "doc_id")
               .sortWithinPartitions("doc_id", "text"))
    ordered.mapInArrow(_segments(tokenizer, end_id, segment_tokens), SEGMENT).write.parquet(path)


def _parts(spark: SparkSession, path: str) -> DataFrame:
    """(part, ids before it): one row per written part, which is all that the
    window over the whole folder sees."""
    per = spark.read.schema(SEGMENT).parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return per.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))


def segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments with their global ``start`` (ids before them in the folder)."""
    files = spark.read.schema(SEGMENT).parquet(path)
    # one small row per written part: bounded by the number of tasks that wrote
    parts = F.broadcast(_parts(spark, path))
    return (files.join(parts, "part")
            .withColumn("start", F.col("part_start") + F.col("local_start")).drop("part_start"))


def _documents(batches):
    import pyarrow as pa
    for batch in batches:
        for doc_ids, lengths, image, start in zip(*(c.to_pylist() for c in batch.columns)):
            ids = dac.Reader(image).all().astype("<u4")
            ends = np.cumsum(np.asarray(lengths, np.int64))
            begins = ends - lengths
            raw = memoryview(ids.tobytes())
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(begins + start, pa.int64()),
                "n_tokens": pa.array(np.asarray(lengths, np.int64)),
                "ids_crc32": pa.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(begins, ends)], pa.int64())})


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids, from the files."""
    return segments(spark, path).select("doc_ids", "lengths", "image", "start").mapInArrow(
        _documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and the ids of every document, from the files."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for doc_ids, lengths, image, start in zip(*(c.to_pylist() for c in batch.columns)):
                ids = dac.Reader(image).all().astype(np.int64)
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(offsets[:-1] + np.int64(start)),
                    "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))})
    return segments(spark, path).select("doc_ids", "lengths", "image", "start").mapInArrow(
        run, "doc_id long, start long, ids array<long>")


def lookup(positions: DataFrame, path: str, block: int = 1 << 16) -> DataFrame:
    """Ids at global token positions (column ``position``), without decoding.

    Positions and segments meet on the block of ``block`` positions that they
    touch; a segment's image reaches one task per touched block, with at most
    ``block`` distinct positions. Positions outside the folder give no row."""
    spark = positions.sparkSession
    found = segments(spark, path).withColumn("last", F.col("start") + F.col("n_tokens") - 1).select(
        "start", "last", "image", F.explode(F.sequence(
            F.floor(F.col("start") / block), F.floor(F.col("last") / block))).alias("blk"))
    wanted = positions.select("position").distinct().withColumn("blk", F.floor(F.col("position") / block))

    def run(key, left, right):
        import pandas as pd
        out = []
        for start, last, image in zip(left["start"], left["last"], left["image"]):
            here = right["position"][(right["position"] >= start) & (right["position"] <= last)].to_numpy()
            out.append(pd.DataFrame({"position": here, "id": dac.Reader(image).take(here - start).astype("int64")}))
        return pd.concat(out) if out else pd.DataFrame({"position": [], "id": []}).astype("int64")

    return (found.join(wanted.select("blk").distinct(), "blk", "left_semi").groupBy("blk")
            .cogroup(wanted.groupBy("blk")).applyInPandas(run, "position long, id long"))


def op1_token_files(spark, sf_dir: str) -> DataFrame:
    path = common.scratch(spark, "tokens")
    write_tokens(common.documents(spark, sf_dir), path)
    return read_documents(spark, path)
