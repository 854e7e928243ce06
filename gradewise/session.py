"""Spark session helpers.

The library never creates its own cluster configuration: on a cluster the
session comes from the launcher. ``get_spark`` is for tests, the bench and
local runs; it only fills in settings that are still unset.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings the library relies on. AQE re-plans joins from runtime sizes
# (so a rule table that turns out large is not broadcast), coalesces small
# shuffle partitions and splits skewed join partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "gradewise") -> SparkSession:
    """Return the active session, or build a local one for tests/bench."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    builder = builder.master(master or os.environ.get("GRADEWISE_MASTER", "local[8]"))
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions",
                             str(shuffle_partitions or 8))
    builder = builder.config("spark.driver.memory", "8g")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster.

    Order: a folder already set on the context, then the launcher's
    ``spark.checkpoint.dir`` (a static setting, read from the context's
    configuration). With neither, a single-machine session (tests) gets a
    scratch folder of its own; on a cluster that folder would not be shared,
    so a missing setting is an error there."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="gradewise-ckpt-"))
    return sc.getCheckpointDir()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``gradewise`` importable on the executors' Python workers (UDFs
    and ``mapInPandas`` helpers are pickled by module reference). The
    package is zipped once per context and distributed with ``addPyFile``,
    as ``--py-files`` would do at submit time."""
    import shutil

    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Connect sessions ship code with addArtifacts
        return
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_parent = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = os.path.join(tempfile.mkdtemp(prefix="gradewise-pyfiles-"), "gradewise")
    archive = shutil.make_archive(out, "zip", root_dir=pkg_parent, base_dir="gradewise")
    sc.addPyFile(archive)
    _SHIPPED.add(key)
