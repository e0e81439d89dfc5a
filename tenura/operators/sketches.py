"""Approximate percentiles from states that are kept and merged.

A state is a quantile sketch of one metric in one group. States of days or files are
written as a table, and those of a longer time are merged from it without
reading the rows again. With ``size`` items a sketch is exact up to that many
values; beyond, a rank is off by about 2.3 / size^0.9 of the values (0.1 % for 4096).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenura.functions.columns import without_nan

SIZE = 4096


def rank_error(size: int = SIZE) -> float:
    """Bound of the rank error, as a share of the values, that holds in 99 of 100 cases."""
    return 2.296 / size**0.9021


def quantile_states(df: DataFrame, metrics: Sequence[str], groups: Sequence[str] = (), size: int = SIZE) -> DataFrame:
    """(groups, metric, n, state): one pass; each task sends a sketch per group and
    metric. Null and NaN take no part; a metric without values in a group has no row."""
    values = df.select(*groups, *[without_nan(F.col(m)).alias(m) for m in metrics])
    long = values.unpivot(list(groups), list(metrics), "metric", "value").dropna(subset="value")
    return long.groupBy(*groups, "metric").agg(
        F.count("value").alias("n"), F.kll_sketch_agg_double("value", F.lit(size)).alias("state"))


def merge_states(states: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """The states of coarser ``groups``, from those of any finer ones."""
    return states.groupBy(*groups, "metric").agg(
        F.sum("n").alias("n"), F.kll_merge_agg_double("state").alias("state"))


def read_quantiles(states: DataFrame, groups: Sequence[str], probs: Sequence[float],
                   names: Sequence[str] | None = None) -> DataFrame:
    """(groups, metric, n, one column per prob): the smallest value that at least this
    share of the values does not exceed."""
    names = names or [f"p{p * 100:g}" for p in probs]
    return states.select(*groups, "metric", "n", *[
        F.kll_sketch_get_quantile_double("state", F.lit(float(p))).alias(name) for p, name in zip(probs, names, strict=True)])
