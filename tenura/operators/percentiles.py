"""Exact percentiles and modes whose state stays small.

The built-in exact ``percentile``, ``median`` and ``mode`` keep a map of every
distinct value of a group in one task. Here a mergeable sketch first brackets
each wanted quantile, rows outside the brackets collapse to counts before the
shuffle, and the order statistic is read off distributed running counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.functions.columns import without_nan
from tenura.operators.ranking import running_counts
from tenura.sources.shared import pin

ACCURACY = 2000          # the sketch is within 1/ACCURACY of the wanted rank
SLACK = 4 / ACCURACY     # half-width of a bracket
WINDOW_VALUES = 2_000_000  # distinct values one window may sort


def long_metrics(df: DataFrame, metrics: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Rows of (groups, metric, value) without null and NaN."""
    doubles = df.select(*groups, *[without_nan(F.col(m)).alias(m) for m in metrics])
    return doubles.unpivot(list(groups), list(metrics), "metric", "value").dropna(subset="value")


def _brackets(df: DataFrame, metrics: Sequence[str], probs: Sequence[float], groups: Sequence[str]) -> DataFrame:
    """(groups, per metric the lower and then the upper bracket ends, _rows), written:
    the largest count of values among the metrics is in ``_rows``."""
    ends = [max(0.0, p - SLACK) for p in probs] + [min(1.0, p + SLACK) for p in probs]
    doubles = {m: without_nan(F.col(m)) for m in metrics}
    sketches = df.groupBy(*groups).agg(
        *[F.percentile_approx(c, ends, ACCURACY).alias(m) for m, c in doubles.items()],
        F.greatest(F.lit(0), *[F.count(c) for c in doubles.values()]).alias("_rows"),
    )
    return pin(sketches, "brackets")


def _collapse(value: str, ends: Sequence[str]) -> tuple[str, str]:
    """The value itself inside a bracket; in a gap, the end of the bracket
    below it with mark 1. The mapping keeps the order of values."""
    low, high = ends[:len(ends) // 2], ends[len(ends) // 2:]
    kept = gap = f"CASE WHEN {value} IS NULL THEN NULL"
    for lo, hi in reversed(list(zip(low, high, strict=True))):
        kept += f" WHEN {value} > {hi} THEN {hi} WHEN {value} >= {lo} THEN {value}"
        gap += f" WHEN {value} > {hi} THEN 1 WHEN {value} >= {lo} THEN 0"
    return f"{kept} ELSE double('-Infinity') END", f"{gap} ELSE 1 END"


def _collapsed_rows(df: DataFrame, metrics: Sequence[str], k: int, groups: Sequence[str],
                    brackets: DataFrame) -> DataFrame:
    """Rows of (groups, metric, value, gap) after collapsing to the brackets. Spark
    broadcasts the brackets if their table is below its limit."""
    if groups:
        small = brackets.select(
            *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)],
            *[F.col(m)[i].alias(f"_{m}_{i}") for m in metrics for i in range(2 * k)],
        )
        same = reduce(and_, [
            df[g].eqNullSafe(small[f"_g{i}"]) for i, g in enumerate(groups)
        ])
        df = df.join(small, same)
        ends = {m: [f"`_{m}_{i}`" for i in range(2 * k)] for m in metrics}
    else:
        row = brackets.first()
        ends = {m: [f"double('{v}')" for v in row[m] or [0.0] * (2 * k)] for m in metrics}
    cells = []
    for m in metrics:
        kept, gap = _collapse(f"nanvl(double(`{m}`), double(NULL))", ends[m])
        cells.append(f"struct('{m}' AS metric, {kept} AS value, {gap} AS gap)")
    return df.select(*groups, F.expr(f"inline(array({', '.join(cells)}))")).dropna(subset="value")


def _order_statistics(long: DataFrame, probs: Sequence[float], names: Sequence[str],
                      groups: Sequence[str], small_groups: bool = False) -> DataFrame:
    counts = running_counts(
        long, ["value", "gap"], [*groups, "metric"], small_groups=small_groups
    )
    position = [f"((n_all - 1) * {p!r}D)" for p in probs]

    def at(index: str, what: str) -> str:
        return f"max(CASE WHEN before <= {index} AND {index} < before + n THEN {what} END)"

    indexes = [(f"floor({h})", f"ceil({h})") for h in position]
    picks = counts.groupBy(*groups, "metric").agg(
        F.expr("max(n_all) AS n_all"),
        *[F.expr(f"{at(low, 'value')} AS low{i}") for i, (low, _) in enumerate(indexes)],
        *[F.expr(f"{at(high, 'value')} AS high{i}") for i, (_, high) in enumerate(indexes)],
        F.expr(f"greatest(0, {', '.join(at(i, 'gap') for pair in indexes for i in pair)})"
               " AS missed"),
    )
    between = [
        F.expr(f"low{i} + (high{i} - low{i}) * ({h} - floor({h}))").alias(name)
        for i, (h, name) in enumerate(zip(position, names, strict=True))
    ]
    return picks.select(*groups, "metric", "missed", *between)


def exact_percentiles(df: DataFrame, metrics: Sequence[str], probs: Sequence[float],
                      groups: Sequence[str] = (), names: Sequence[str] | None = None) -> DataFrame:
    """Linearly interpolated percentiles: (groups, metric, one column per prob).

    A group in which a metric has no values has no row for it.
    """
    groups, metrics = list(groups), list(metrics)
    names = names or [f"p{p * 100:g}" for p in probs]
    brackets = _brackets(df, metrics, probs, groups)
    collapsed = _collapsed_rows(df, metrics, len(probs), groups, brackets)
    # Values inside the brackets of the largest group, by the sketch's bound.
    most = brackets.agg(F.max("_rows")).first()[0] or 0
    inside = len(probs) * most * (2 * SLACK + 2 / ACCURACY)
    found = pin(_order_statistics(collapsed, probs, names, groups, inside <= WINDOW_VALUES), "percentiles")
    if not found.agg(F.max("missed")).first()[0]:
        return found.drop("missed")
    # A sketch was outside its error bound.
    full = long_metrics(df, metrics, groups).withColumn("gap", F.lit(0))
    return _order_statistics(full, probs, names, groups).drop("missed")


def value_counts(df: DataFrame, metrics: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    return long_metrics(df, metrics, groups).groupBy(*groups, "metric", "value").count()


def modes(df: DataFrame, metrics: Sequence[str], groups: Sequence[str] = ()) -> DataFrame:
    """Most frequent value per group and metric, the smallest of ties."""
    best = F.max(F.struct("count", (-F.col("value")).alias("minus"))).alias("best")
    return value_counts(df, metrics, groups).groupBy(*groups, "metric").agg(best).select(
        *groups, "metric", (-F.col("best.minus") + F.lit(0.0)).alias("mode")
    )
