"""Blocked numbering / running sums / lag equal the plain window functions."""

import random

import pytest
from pyspark.sql import Window, functions as F

from gradewise.operators.indexing import ordered_index, previous_in_order, running_sum


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(7)
    ids = rnd.sample(range(0, 5000), 600)
    # one hot group holding a third of the rows
    rows = [(i, 0 if k % 3 == 0 else rnd.randrange(1, 9), float(rnd.randrange(0, 50))) for k, i in enumerate(ids)]
    return spark.createDataFrame(rows, "id long, g long, v double")


@pytest.mark.parametrize("width", [1, 7, 64, 1 << 16, "auto"])
def test_ordered_index_equals_row_number(data, width):
    w = Window.partitionBy("g").orderBy("id")
    want = {r.id: r.rn for r in data.select("id", (F.row_number().over(w) - 1).alias("rn")).collect()}
    got = {r.id: r.rn for r in ordered_index(data, ["g"], "id", "rn", block_width=width).collect()}
    assert got == want


@pytest.mark.parametrize("width", [5, 1000])
def test_running_sum_equals_window(data, width):
    w = Window.partitionBy("g").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    want = {r.id: r.s for r in data.select("id", F.sum("v").over(w).alias("s")).collect()}
    got = {r.id: r.s for r in running_sum(data, ["g"], "id", "v", "s", block_width=width).collect()}
    assert got == want


def test_previous_equals_lag(data):
    w = Window.partitionBy("g").orderBy("id")
    want = {r.id: r.p for r in data.select("id", F.lag("v").over(w).alias("p")).collect()}
    got = {r.id: r.prev_v for r in previous_in_order(data, ["g"], "id", ["v"], block_width=50).collect()}
    assert got == want


def test_auto_blocks_on_sparse_keys(spark, data):
    import gradewise.operators.indexing as ix
    sparse = data.withColumn("id", F.col("id") * F.lit(10 ** 12) + F.lit(7))
    w = Window.partitionBy("g").orderBy("id")
    want = {r.id: r.rn for r in sparse.select("id", (F.row_number().over(w) - 1).alias("rn")).collect()}
    old = ix.AUTO_BLOCK_ROWS
    ix.AUTO_BLOCK_ROWS = 40  # many blocks on 600 rows
    try:
        got = {r.id: r.rn for r in ordered_index(sparse, ["g"], "id", "rn", block_width="auto").collect()}
    finally:
        ix.AUTO_BLOCK_ROWS = old
    assert got == want


def test_arrival_index_files_grow_with_the_table(spark, tmp_path, monkeypatch):
    """More scan tasks, more CSV files; the same numbers."""
    import hashlib
    from gradewise.plans import q_grading
    from gradewise.sources import writers
    rows = [(i, f"s{i % 3}", None if i % 11 == 0 else f"line {i}\nnext") for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    parts, write = [], writers.write_csv
    monkeypatch.setattr(writers, "write_csv", lambda d, path: (parts.append(d.rdd.getNumPartitions()), write(d, path)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        got = {(r.filename, r.sample_no): (r.completion_md5, r.was_null) for r in q_grading.arrival_index(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert parts[0] >= 7
    assert got == {(s, i // 3): (hashlib.md5((t or "").encode()).hexdigest(), t is None) for i, s, t in rows}
