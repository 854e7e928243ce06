"""Read the parquet tables of a data directory.

Every reader is lazy: Catalyst prunes unused columns and pushes filters
into the parquet scan, so callers just select what they need.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from gradewise.session import checkpoint_dir

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")


# A scan of fewer tasks than this is a table of a few gigabytes at most.
SPREAD_BELOW = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table of a data directory."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame, min_tasks: int | None = None) -> DataFrame:
    """Spread a small scan over the cluster before CPU-heavy per-row work.

    A small table stored as one parquet row group is read by one task, so
    tokenising or aligning its rows would use one core. When the scan has
    fewer partitions than ``min_tasks`` (default: twice the default
    parallelism, at most ``SPREAD_BELOW``), rows are repartitioned round-robin
    (deterministic on retry: Spark sorts before a round-robin repartition).
    Whatever the cluster's size, only tables of fewer than ``SPREAD_BELOW``
    scan tasks are moved; all others are returned unchanged -- no shuffle."""
    try:
        target = min(SPREAD_BELOW, min_tasks or 2 * df.sparkSession.sparkContext.defaultParallelism)
        n = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - no RDD view (e.g. a Connect session): leave as is
        return df
    return df.repartition(target) if n < target else df


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder path in the cluster's shared folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the cluster's shared folder and read
    back: its lineage ends there, and the planner knows its size."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
