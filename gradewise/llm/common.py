"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradewise.session import checkpoint_dir, ship_package


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``documents`` table of a data directory (any store Spark reads)."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder path below the cluster's shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back:
    cuts the lineage, survives lost executors, and fixes row ids."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Spark gives shuffle files, broadcasts and plans of earlier steps back only when the driver's JVM
    collects garbage: asked for after a round of many small jobs, it keeps the driver's heap
    from growing to its limit with what nobody uses any more."""
    import gc
    gc.collect()
    try:
        spark.sparkContext._jvm.System.gc()
    except Exception:  # noqa: BLE001 - no JVM at hand (e.g. a Connect session)
        pass


def held_out(doc_id) -> Column:
    """The evaluation fold: crc32 of the id as text, modulo 4, is 2. A null
    id belongs to no fold (held out, so that nothing is learned from it)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Memory that this Python process no longer uses goes back to the system."""
    import ctypes
    import gc

    import pyarrow as pa
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def released(batches):
    """The batches of a task, with ``give_back`` behind the last one: workers live on
    between stages."""
    try:
        yield from batches
    finally:
        give_back()
