"""Whitening of embeddings by their principal components.

Entries become integers, x = floor(64 c) + 1000000. The fit list holds every
distinct x vector once. Its sums are exact (integers in two halves), its
covariance is added up over tasks from centred vectors, block by block, and the
components come from ``eigen.eigenvectors``: single-precision eigenvectors,
corrected by matrix products in higher precision. Every row is then projected
in its own task. Only sums over all rows reach the driver: matrices of
dimension x dimension, however many rows there are.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame, functions as F

from gradewise.llm import common, eigen

COMPONENTS = 16
SCALE, OFFSET = 64, 1_000_000
# A model of this many dimensions has a covariance of 128 MB, which the driver holds.
MAX_DIMENSION = 4096
# Entries from here on have no exact x; they count as not finite.
LARGEST_ENTRY = float(1 << 48)
# Components with a smaller share of the largest eigenvalue have no variance.
NO_VARIANCE = 1e-12
FAN_IN = 64
BLOCK_ROWS = 2048
_HALF = 20

PARTIAL = "part int, row int, n long, sums array<double>"


def integer_vectors(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and ``x`` of the usable rows: vectors that are not null, not empty, without
    null, non-finite or too large entries."""
    v = F.col(vector)
    sound = v.isNotNull() & (F.size(v) > 0) & F.forall(
        v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < LARGEST_ENTRY), F.lit(False)))
    x = F.transform(v, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + F.lit(OFFSET).cast("long"))
    return table.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def _matrix(column, width: int) -> np.ndarray:
    """The rows of an Arrow list column as one integer matrix."""
    return np.asarray(column.flatten(), np.int64).reshape(-1, width)


def _partials(rows_of, fit: DataFrame, width: int) -> DataFrame:
    """Per task the sum of ``rows_of(x matrix)`` over its rows, one output row per matrix row."""
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        n, total = 0, None
        for batch in batches:
            x = _matrix(batch.column(0), width)
            for at in range(0, len(x), BLOCK_ROWS):
                block = rows_of(x[at:at + BLOCK_ROWS])
                total = block if total is None else total + block
            n += len(x)
        if total is None:
            return
        k = len(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()] * k, pa.int32()), pa.array(range(k), pa.int32()),
             pa.array([n] * k, pa.int64()), pa.array(list(total.astype(np.float64)), pa.list_(pa.float64()))],
            [c.split()[0] for c in PARTIAL.split(", ")])
    return fit.select("x").mapInArrow(run, PARTIAL)


def _added(key, pdf):
    import pandas as pd
    return pd.DataFrame({"part": [key[0]], "row": [key[1]], "n": [int(pdf["n"].sum())],
                         "sums": [np.sum(np.stack(pdf["sums"].to_list()), axis=0)]})


def _total(rows_of, fit: DataFrame, width: int, tasks: int) -> tuple[int, np.ndarray]:
    """(rows, sum over all rows) of ``_partials``, added up in a tree, so that a group
    holds at most FAN_IN rows of a matrix."""
    sums = _partials(rows_of, fit, width)
    while True:
        tasks = -(-tasks // FAN_IN)
        part = F.floor(F.col("part") / FAN_IN).cast("int") if tasks > 1 else F.lit(0)
        sums = sums.groupBy(part.alias("part"), "row").applyInPandas(_added, PARTIAL)
        if tasks == 1:
            break
    rows = sums.orderBy("row").collect()  # one row of `width` sums per dimension
    return rows[0].n, np.array([r.sums for r in rows])


def exact_sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """(n, sums per dimension as exact integers): the two halves of the numbers
    are added up apart, each below 2**63 for up to 2**40 rows."""
    halves = fit.select(F.posexplode("x").alias("dimension", "v")).groupBy("dimension").agg(
        F.count("*").alias("n"), F.sum(F.shiftright("v", _HALF)).alias("high"),
        F.sum(F.col("v").bitwiseAND(F.lit((1 << _HALF) - 1).cast("long"))).alias("low")).collect()
    at = {r.dimension: r for r in halves}  # one row per dimension
    return (at[0].n if at else 0), [(at[j].high << _HALF) + at[j].low for j in range(width)] if at else []


class Centre:
    """S / n as an integer and a rest in [0, 1) per dimension, so that x - S/n keeps all its digits."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.whole = np.array([s // n for s in sums], np.int64)
        self.over = [s % n for s in sums]
        self.rest = np.array([r / n for r in self.over])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n x - S)**2 of every row, exact."""
        y = x - self.whole
        far = (int(np.abs(y).max(initial=0)) + 1) * self.n
        if far * far * len(self.over) < 1 << 62:
            z = y * self.n - np.array(self.over, np.int64)
            return (z * z).sum(axis=1).tolist()
        z = y.astype(object) * self.n - np.array(self.over, object)
        return (z * z).sum(axis=1).tolist()


class Whitening:
    """A fitted whitening: ``n``, the centre, eigenvalues and unit eigenvectors of the
    components with variance, the trace, and the fit's ``identity_error``."""

    def __init__(self, centre: Centre, values: np.ndarray, vectors: np.ndarray, trace: float):
        self.centre, self.values, self.vectors, self.trace = centre, values, vectors, trace
        self.n, self.identity_error = centre.n, 0.0
        self.projection = vectors / np.sqrt(values)

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.projection


def _width(vectors: DataFrame) -> int | None:
    """The commonest length (of equally common ones the longest)."""
    top = vectors.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if top is None:
        return None
    if top.d > MAX_DIMENSION:
        raise ValueError(f"vectors of {top.d} dimensions; the covariance of at most {MAX_DIMENSION} fits the driver")
    return top.d


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Whitening fitted to the distinct ``x`` of ``vectors`` (all of one length);
    None for an empty table.

    The distinct vectors are found by Spark (equal vectors meet in the map
    side's partial aggregate first, so a vector that makes up a third of the
    rows moves once per task) and written as a table that the passes read: sums, covariance and
    the covariance of the whitened vectors, from which the error comes."""
    width = _width(vectors)
    if width is None:
        return None
    spark = vectors.sparkSession
    listed = common.written(vectors.select("x").where(F.size("x") == width).distinct(), "whitening-fit")
    tasks = max(common.shuffle_partitions(spark), listed.rdd.getNumPartitions())
    n, sums = exact_sums(listed, width)
    centre = Centre(n, sums)

    def products(x):
        d = centre.centred(x)
        return d.T @ d
    _, total = _total(products, listed, width, tasks)
    covariance = (total + total.T) / 2 / n
    values, basis = eigen.eigenvectors(covariance)
    keep = [j for j in range(min(components, width)) if values[j] > NO_VARIANCE * max(values[0], 0)]
    model = Whitening(centre, values[keep], basis[:, keep], float(np.trace(covariance)))
    if keep:
        def moments(x):
            w = model.project(x)
            w = np.hstack([w, np.ones((len(w), 1))])
            return w.T @ w
        _, second = _total(moments, listed, width, tasks)
        mean = second[-1, :-1] / n
        model.identity_error = float(np.abs(second[:-1, :-1] / n - np.outer(mean, mean) - np.eye(len(keep))).max())
    return model


OUT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
WIDE = "vec_id long, deviation decimal(38,0), whitened array<double>"


def whiten(table: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable row of ``table`` and component (OUT).

    Rows whose vector is null, empty, or holds null, non-finite or too large entries are left out; so
    are those of another length than the commonest, as they are no vectors
    of the same space. Repeated rows give repeated results and count once in the fit; a null id stays
    null; equal eigenvalues give any orthonormal basis. Components without variance (beyond the
    rank of the fit list, or all of them if it has one vector) have no rows. An empty table gives
    an empty result. Other columns are ignored, whatever their names."""
    rows = integer_vectors(table, vector)
    model = fit(rows, components)
    if model is None or not len(model.values):
        return table.sparkSession.createDataFrame([], OUT)
    width = len(model.centre.over)

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            x = _matrix(batch.column(1), width)
            deviation = pa.array([Decimal(v) for v in model.centre.deviations(x)], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), deviation, pa.array(list(model.project(x)), pa.list_(pa.float64()))],
                [c.split()[0] for c in WIDE.split(", ")])

    wide = rows.where(F.size("x") == width).mapInArrow(run, WIDE)
    explained = F.lit((model.values / model.trace).tolist())
    long = wide.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return long.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
                       "whitened", F.element_at(explained, F.col("at") + 1).alias("explained"),
                       F.lit(model.identity_error).alias("identity_error"))


def op12_refined_whitening(spark, sf_dir: str) -> DataFrame:
    """``deviation`` as long; null where it exceeds a long (from about 1e8 rows on)."""
    d = whiten(common.table(spark, sf_dir, "embeddings"))
    return d.withColumn("deviation", d["deviation"].try_cast("long"))
