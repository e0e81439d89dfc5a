"""Ranks and running counts over whole columns, without one-task windows.

A global rank written as a window without keys sorts everything in one task,
and one written per class puts a third of the table in one task. Here rows are
first collapsed to one row per distinct value, those are range-partitioned into
blocks, and each block learns how much lies before it from the block totals.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenura.sources.shared import pin

BROADCAST_ROWS = 500_000


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Join condition under which a null key matches a null key."""
    return reduce(and_, [left[k].eqNullSafe(right[k]) for k in keys])


def running_counts(df: DataFrame, order: Sequence[str], groups: Sequence[str] = (),
                   weights: Mapping[str, Column] | None = None,
                   small_groups: bool = False) -> DataFrame:
    """One row per distinct value with the counts at it, below it and in all.

    Columns: ``groups``, ``order``, each weight, ``before`` (rows of the same
    group that sort strictly lower) and ``n_all`` (rows of the group). The
    first weight is the one accumulated. Nulls in ``order`` are left out.
    ``small_groups`` is for callers that have bounded the distinct values per
    group; one window per group then needs no blocks.
    """
    groups, order = list(groups), list(order)
    weights = weights or {"n": F.count(F.lit(1))}
    n = next(iter(weights))
    counts = (
        df.dropna(subset=order)
        .groupBy(*groups, *order)
        .agg(*[w.alias(name) for name, w in weights.items()])
    )
    if small_groups:
        by_group = Window.partitionBy(*groups)
        lower = by_group.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumns({
            "before": F.coalesce(F.sum(n).over(lower), F.lit(0)),
            "n_all": F.sum(n).over(by_group),
        })
    # Written once: the block of a row must not change if a task is retried.
    blocks = pin(
        counts.repartitionByRange(*groups, *order).withColumn("block", F.spark_partition_id()),
        "blocks",
    )
    totals = blocks.groupBy(*groups, "block").agg(F.sum(n).alias("block_n"))
    by_group = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    earlier = by_group.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(g).alias(g) for g in groups], "block",
        F.coalesce(F.sum("block_n").over(earlier), F.lit(0)).alias("before_block"),
        F.sum("block_n").over(by_group).alias("n_all"),
    )
    in_block = (
        Window.partitionBy(*groups, "block").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = blocks.withColumn("in_block", F.coalesce(F.sum(n).over(in_block), F.lit(0)))
    return local.join(offsets, null_safe(local, offsets, [*groups, "block"])).select(
        *[local[c] for c in [*groups, *order, *weights]],
        (F.col("before_block") + F.col("in_block")).alias("before"),
        "n_all",
    )


def average_rank(counts: DataFrame) -> DataFrame:
    """Rank with ties averaged, for the output of :func:`running_counts`."""
    return counts.withColumn("avg_rank", F.col("before") + (F.col("n") + 1) / F.lit(2.0))


def attach_by_value(df: DataFrame, lookup: DataFrame, value: str, out: str, key: Sequence[str],
                    distinct: int, broadcast_rows: int = BROADCAST_ROWS,
                    hot_values: int = 1000) -> DataFrame:
    """Left-join ``lookup(value, n, out)`` to ``df`` on a possibly skewed value.

    ``distinct`` is the counted size of the lookup. Within ``broadcast_rows`` it
    is broadcast. Beyond that, the values
    holding more than 1/``hot_values`` of all rows (so at most ``hot_values`` of
    them) are broadcast, and only the other rows meet the lookup in a shuffle;
    rows already served are spread over it by their key.
    """
    lookup = lookup.select(F.col(value).alias("_v"), "n", F.col(out).alias("_out"))
    if distinct <= broadcast_rows:
        small = F.broadcast(lookup.drop("n"))
        return (
            df.join(small, df[value] == small["_v"], "left")
            .withColumnRenamed("_out", out).drop("_v")
        )
    n_all = lookup.agg(F.sum("n")).first()[0]
    hot = F.broadcast(
        lookup.where(F.col("n") * hot_values > n_all)
        .select(F.col("_v").alias("_hot_v"), F.col("_out").alias("_hot"))
    )
    served = df.join(hot, df[value] == hot["_hot_v"], "left")
    open_row = F.col("_hot").isNull() & F.col(value).isNotNull()
    served = served.withColumns({
        "_open": open_row,
        "_v0": F.when(open_row, F.col(value)).otherwise(F.xxhash64(*key).cast("double")),
    })
    cold = lookup.where(F.col("n") * hot_values <= n_all).select("_v", "_out")
    joined = served.join(
        cold, (F.col("_v0") == F.col("_v")) & (F.col("_open") == F.lit(True)), "left"
    )
    return joined.withColumn(out, F.coalesce("_hot", "_out")).drop(
        "_hot_v", "_hot", "_open", "_v0", "_v", "_out"
    )


def share_of_total(c: str, *partition: str) -> Column:
    """Part of the partition's sum; null when that sum is zero."""
    return F.try_divide(F.col(c), F.sum(c).over(Window.partitionBy(*partition)))


def metric_rank(c: str, *partition: str) -> Column:
    """Dense rank, highest first; a null is not ranked. For aggregated rows."""
    window = Window.partitionBy(*partition).orderBy(F.col(c).desc_nulls_last())
    return F.when(F.col(c).isNotNull(), F.dense_rank().over(window))


def sort_by_rate(df: DataFrame, rate: str, *keys: str) -> DataFrame:
    """Highest rate first, ties by key."""
    return df.orderBy(F.col(rate).desc_nulls_last(), *keys)
