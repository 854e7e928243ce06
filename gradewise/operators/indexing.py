"""Skew-safe ordered numbering and running sums.

``row_number() OVER (PARTITION BY g ORDER BY o)`` puts a whole group into
one task: a case holding a third of all responses becomes one straggler.
Here the order key is cut into blocks of ``block_width`` values. Rows are
numbered inside (group, block) -- many small window partitions -- and each
block's offset is the running total of the per-block counts, computed on
the (group, block) count table, which is ``block_width`` times smaller.
The result equals the plain window exactly when the order key is unique
within a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

DEFAULT_BLOCK = 1 << 16
# Rows per block aimed at by ``block_width="auto"``.
AUTO_BLOCK_ROWS = 1 << 16


def _block(order_col: str, block_width, df: DataFrame | None = None):
    """Block number of the order key. A number is a fixed width (suits dense
    integer ids). ``"auto"`` derives the width from the key range and the
    row count (lazy scalar subqueries), so sparse keys such as hashes still
    get blocks of about ``AUTO_BLOCK_ROWS`` rows."""
    if block_width == "auto":
        stats = df.select(F.min(order_col).alias("lo"), F.max(order_col).alias("hi"),
                          F.count(F.lit(1)).alias("n"))
        lo = stats.select("lo").scalar()
        span = stats.select((F.col("hi").cast("double") - F.col("lo").cast("double") + 1.0)
                            * F.lit(float(AUTO_BLOCK_ROWS)) / F.greatest(F.col("n"), F.lit(1))).scalar()
        width = F.greatest(span, F.lit(1.0))
        return F.floor((F.col(order_col).cast("double") - lo.cast("double")) / width).cast("long")
    return F.floor(F.col(order_col) / F.lit(block_width)).cast("long")


def ordered_index(df: DataFrame, group_cols, order_col: str, out_col: str,
                  block_width: int = DEFAULT_BLOCK, start: int = 0) -> DataFrame:
    """Add ``out_col`` = position of the row in its group ordered by
    ``order_col`` (numeric, unique within a group), starting at ``start``."""
    return running_sum(df, group_cols, order_col, None, out_col,
                       block_width=block_width, offset=start - 1)


def running_sum(df: DataFrame, group_cols, order_col: str, value_col,
                out_col: str, block_width: int = DEFAULT_BLOCK,
                offset=0) -> DataFrame:
    """Running total of ``value_col`` (count of rows when None) per group,
    ordered by numeric ``order_col``, rows unbounded preceding to current."""
    group_cols = list(group_cols)
    blk = "__blk"
    val = F.lit(1).cast("long") if value_col is None else F.col(value_col)
    d = df.withColumn(blk, _block(order_col, block_width, df)).withColumn("__v", val)
    inner = Window.partitionBy(*group_cols, blk).orderBy(order_col) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("__in", F.sum("__v").over(inner))
    per_block = d.groupBy(*group_cols, blk).agg(F.sum("__v").alias("__bt"))
    outer = Window.partitionBy(*group_cols).orderBy(blk) \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.withColumn(
        "__off", F.coalesce(F.sum("__bt").over(outer), F.lit(0).cast(per_block.schema["__bt"].dataType))
    ).drop("__bt")
    # The offsets table is block_width times smaller than the input; the
    # planner (static size estimate, then AQE at runtime) broadcasts it
    # when it is small and shuffles it otherwise.
    d = d.join(offsets, on=group_cols + [blk], how="inner")
    res = F.col("__off") + F.col("__in")
    if offset:
        res = res + F.lit(offset)
    return d.withColumn(out_col, res).drop(blk, "__v", "__in", "__off")


def arrival_index(df: DataFrame, group_cols, out_col: str, place: str = "place") -> DataFrame:
    """Add ``out_col`` = position (from 0) of the row in its group by arrival.
    ``place`` is the struct (file, block, row) that ``sources.readers.arrival`` gives:
    files by path, in a file the blocks by their start, in a block the rows as read.

    Rows are numbered inside (group, file, block, stretch of rows); a stretch's offset is the
    running total of the counts before it, a table thousands of times smaller. No group, file
    or block has to fit one task."""
    group_cols = list(group_cols)
    at = [F.col(place)[c].alias(f"__{c}") for c in ("file", "block", "row")]
    d = df.select("*", *at).withColumn("__stretch", F.floor(F.col("__row") / F.lit(DEFAULT_BLOCK)))
    part = ["__file", "__block", "__stretch"]
    inside = Window.partitionBy(*group_cols, *part).orderBy("__row")
    d = d.withColumn("__in", F.row_number().over(inside))
    before = Window.partitionBy(*group_cols).orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = d.groupBy(*group_cols, *part).agg(F.count("*").alias("__n")).withColumn(
        "__off", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    d = d.join(offsets, on=group_cols + part)
    return d.withColumn(out_col, F.col("__off") + F.col("__in") - 1).drop("__row", "__in", "__off", *part)


def previous_in_order(df: DataFrame, group_cols, order_col: str, value_cols,
                      prefix: str = "prev_", block_width: int = DEFAULT_BLOCK) -> DataFrame:
    """``lag(value) OVER (PARTITION BY g ORDER BY o)`` for each value column,
    as an equi self-join on (group, position - 1) instead of one window task
    per group."""
    group_cols = list(group_cols)
    value_cols = list(value_cols)
    idx = ordered_index(df, group_cols, order_col, "__pos", block_width)
    prev = idx.select(*group_cols, (F.col("__pos") + 1).alias("__pos"),
                      *[F.col(c).alias(prefix + c) for c in value_cols])
    return idx.join(prev, on=group_cols + ["__pos"], how="left").drop("__pos")
