"""Percentiles by cumulative frequencies.

1. ``value_counts`` reduces rows to (group, value, count); Spark combines them before the shuffle.
   These counts are the mergeable state: those of days, files or partitions add up (``combine``).
2. ``percentiles`` range-sorts them by (group, value). The ends of the ranges come from the counts
   themselves, so ranges are alike in size however the values lie, and a hot group spreads over as
   many as it fills. The ranges are cut from their lineage by a checkpoint: a task that runs again
   reads the same ranges. Within a range a window makes running sums, and the offset of a range is
   the sum of the group's totals in the ranges before it, from a table of one row per (group, range).
3. The first value whose cumulative count reaches ``ceil(p * n)`` is the percentile.

Error: with ``relative_error = 0`` the result is exact (an observed value). Otherwise values are
first reduced to buckets whose ends differ by the factor ``(1 + e) / (1 - e)``; the representative
is within ``e`` (relative) of each value in the bucket, so each percentile is within ``e`` of the
exact one, after any number of combinations.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quilate.session import ensure_checkpoint_dir

DEFAULT_PERCENTILES = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def _bucketed(value: Column, e: float) -> Column:
    """Representative of the bucket of a value: within e of it, relative."""
    if not 0 < e < 1:
        raise ValueError("relative_error must lie in [0, 1)")
    gamma = (1 + e) / (1 - e)
    index = F.ceil(F.log(F.abs(value)) / math.log(gamma))
    middle = F.pow(F.lit(gamma), index) * (2 / (1 + gamma))
    return F.when(value == 0, F.lit(0.0)).otherwise(F.signum(value) * middle)


def value_counts(df: DataFrame, group_cols: list[str], value_col: str, relative_error: float = 0.0) -> DataFrame:
    """Mergeable counts (group columns, ``pct_value``, ``pct_count``).

    NULL and NaN values, and infinite ones, are left out; NULL groups form a group of their own.
    """
    v = F.col(value_col).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    value = _bucketed(v, relative_error) if relative_error else v + F.lit(0.0)
    return rows.select(*group_cols, value.alias("pct_value")).groupBy(*group_cols, "pct_value").agg(F.count("*").alias("pct_count"))


def combine(parts: list[DataFrame], group_cols: list[str]) -> DataFrame:
    """Counts of several parts (of one relative error) as counts of the whole, or of coarser groups."""
    keys = [*group_cols, "pct_value"]
    whole = reduce(DataFrame.unionByName, [p.select(*keys, "pct_count") for p in parts])
    return whole.groupBy(*keys).agg(F.sum("pct_count").alias("pct_count"))


def range_sorted(counts: DataFrame, group_cols: list[str], ranges: int | None = None) -> DataFrame:
    """``counts`` in ranges of (group, value), with the number of the range, ``pct_block``; of ``ranges`` or as many as the session's shuffles have."""
    ensure_checkpoint_dir(counts.sparkSession)
    by = [*(F.col(c) for c in group_cols), F.col("pct_value")]
    spread = counts.repartitionByRange(*by) if ranges is None else counts.repartitionByRange(ranges, *by)
    return spread.withColumn("pct_block", F.spark_partition_id()).checkpoint()


def percentiles(counts: DataFrame, group_cols: list[str], ps: tuple[float, ...] = DEFAULT_PERCENTILES, ranges: int | None = None) -> DataFrame:
    """One row per group and percentile: group columns, ``pct``, ``value``, ``n_values``.

    The number of ``ranges`` changes no result. Repeated values and ties need no rule (they share one count). Empty counts give no rows.
    """
    if any(not 0 <= p <= 1 for p in ps):
        raise ValueError("percentiles lie between 0 and 1")
    v = F.col("pct_value")
    counts = range_sorted(counts, group_cols, ranges)
    blocks = counts.groupBy(*group_cols, "pct_block").agg(F.sum("pct_count").alias("pct_in_block"))
    by_group = Window.partitionBy(*group_cols) if group_cols else Window.partitionBy(F.lit(1))
    ends = F.sum("pct_in_block").over(by_group.orderBy("pct_block").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    blocks = blocks.withColumn("pct_n", F.sum("pct_in_block").over(by_group)).withColumn("pct_end", ends)
    rank = lambda p: F.greatest(F.lit(1), F.ceil(F.round(p * F.col("pct_n"), 9)))
    targets = F.array(*(F.lit(float(p)) for p in ps))
    # Only blocks that hold a target rank go on.
    blocks = (
        blocks.withColumn("pct_start", F.col("pct_end") - F.col("pct_in_block"))
        .withColumn("pct_hit", F.filter(targets, lambda p: (rank(p) > F.col("pct_start")) & (rank(p) <= F.col("pct_end"))))
        .where(F.size("pct_hit") > 0)
    )
    keys = [*group_cols, "pct_block"]
    blocks = blocks.select(*(F.col(c).alias(f"pct_key_{i}") for i, c in enumerate(keys)), "pct_start", "pct_n", "pct_hit")
    on = [F.col(c).eqNullSafe(F.col(f"pct_key_{i}")) for i, c in enumerate(keys)]
    joined = counts.join(blocks, reduce(lambda x, y: x & y, on)).drop(*(f"pct_key_{i}" for i in range(len(keys))))
    inside = Window.partitionBy(*group_cols, "pct_block").orderBy("pct_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = joined.withColumn("pct_cum", F.col("pct_start") + F.sum("pct_count").over(inside))
    hit = F.filter("pct_hit", lambda p: (rank(p) > F.col("pct_cum") - F.col("pct_count")) & (rank(p) <= F.col("pct_cum")))
    return sums.select(*group_cols, F.explode(hit).alias("pct"), v.alias("value"), F.col("pct_n").alias("n_values"))
